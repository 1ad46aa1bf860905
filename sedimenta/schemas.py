"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


# The column called "class" cannot be a Python keyword argument.
def _rename(schema: T.StructType, **names: str) -> T.StructType:
    return T.StructType([T.StructField(names.get(f.name, f.name), f.dataType) for f in schema.fields])


REPOSITORIES = _struct(repository=_S)

CATALOG_COLUMNS = ["repository", "branch", "download_link", "name", "date"]
CATALOG = T.StructType([T.StructField(c, _S) for c in CATALOG_COLUMNS])
CATALOG_WITH_SEQ = T.StructType(CATALOG.fields + [T.StructField("release_seq", _L)])

SNAPSHOTS = _struct(
    repository=_S,
    branches=T.MapType(_S, _struct(target_type=_S, target_url=_S)),
)
RELEASE_TARGETS = _struct(
    target_url=_S, is_list=_B, target=_S, directory=_S, name=_S, date=_S, target_link=_S,
)

SOURCE_FILES = _struct(repository_name=_S, branch=_S, path=_S, content=_S)

CALL = _struct(
    call_ord=_I, name=_S, context=_S, expression=_S, start_offset=_I, end_offset=_I, lineno=_I,
)
METHOD = _rename(
    _struct(
        method_ord=_I, cls=_S, name=_S, params=T.ArrayType(_S), content=_S,
        repeated=_B, calls=T.ArrayType(CALL),
    ),
    cls="class",
)
IMPORT = _struct(import_ord=_I, kind=_S, module=_S, level=_I, name=_S, alias=_S)
UNITS = _struct(
    content_sha=_S, parse_ok=_B, parse_error=_S,
    methods=T.ArrayType(METHOD), imports=T.ArrayType(IMPORT),
)

STATISTICS = _struct(ratio=_D, dist=_I)
METHOD_PLACES = T.ArrayType(_struct(status=_S, match=_S, old_ord=_I, new_ord=_I))
CALL_PLACES = T.ArrayType(_struct(status=_S, old_at=_I, new_at=_I, ratio=_D, dist=_I))
METHOD_SCORES = T.ArrayType(_struct(ratio=_D, dist=_I, calls=CALL_PLACES))
CALL_CHANGE = _struct(
    id=_S, name=_S, context=_S, expression=_S, start_offset=_I, end_offset=_I, lineno=_I,
    mapping=_S, status=_S, statistics=STATISTICS,
)
METHOD_CHANGE = _rename(
    _struct(
        id=_S, cls=_S, name=_S, params=T.ArrayType(_S), content=_S,
        mapping=_S, status=_S, statistics=STATISTICS,
        function_calls=T.ArrayType(CALL_CHANGE),
    ),
    cls="class",
)
CHANGES = _struct(
    repository=_S, repository_name=_S, branch=_S, prev_branch=_S, date=T.TimestampType(),
    id=_S, path=_S, mapping=_S, status=_S, prev_path=_S,
    imports=T.ArrayType(_S), methods=T.ArrayType(METHOD_CHANGE),
)
