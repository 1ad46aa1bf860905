"""Code units (functions, methods, imports, calls) of Python source files.

Each distinct content is parsed once, whatever number of releases or copies hold
it, by one Arrow stage that returns a nested row; all else explodes that row.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sedimenta.schemas import UNITS
from sedimenta.session import spread

_FAILURES = (SyntaxError, ValueError, RecursionError, MemoryError)

# Rows of parsed units gathered before they are handed back to Spark.
_FLUSH_CHARS = 8 * 1024 * 1024

# Functions whose text and calls a task keeps at hand.
_RECENT = 20_000

# Characters of source whose blocks a task keeps at hand, and what a block counts besides its own.
_BLOCK_CHARS, _BLOCK = 16 * 1024 * 1024, 500

# Class (or none), name, parameters and rendered text.
Function = tuple[str | None, str, list[str], str]


def content_sha(content: Column) -> Column:
    return F.sha2(content, 256)


def _expressions(text: str) -> Iterator[tuple[ast.AST, bool]]:
    """All nodes of a text, each with whether it lies inside a formatted string."""
    pending = [(ast.parse(text), False)]
    while pending:
        node, formatted = pending.pop()
        yield node, formatted
        formatted = formatted or isinstance(node, ast.JoinedStr)
        pending.extend((child, formatted) for child in ast.iter_child_nodes(node))


def find_calls(text: str, byte_offsets: bool = False) -> list[dict]:
    """Calls to ``name(...)`` or ``context.name(...)`` in a method's text, by position.

    The text is rendered already, so a call's own rendering is a slice of it, but
    for calls inside formatted strings, where quotes depend on the surroundings.
    """
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)

    def place(lineno: int, column: int) -> int:
        line = lines[lineno - 1]
        return starts[lineno - 1] + (column if line.isascii() else len(line.encode()[:column].decode()))

    found = set()
    for node, formatted in _expressions(text):
        match node:
            case ast.Call(func=ast.Name(id=name)):
                context = None
            case ast.Call(func=ast.Attribute(value=ast.Name(id=context), attr=name)):
                pass
            case _:
                continue
        start = place(node.lineno, node.col_offset)
        if formatted:
            expression = ast.unparse(node)
        else:
            expression = text[start:place(node.end_lineno, node.end_col_offset)]
        if byte_offsets:
            start = starts[node.lineno - 1] + node.col_offset
        found.add((start, start + len(expression), expression, name, context, node.lineno - 1))
    fields = ("start_offset", "end_offset", "expression", "name", "context", "lineno")
    ordered = sorted(found, key=lambda c: c[:3])
    return [{"call_ord": i, **dict(zip(fields, call))} for i, call in enumerate(ordered)]


def _functions(tree: ast.Module) -> Iterator[tuple[str | None, ast.FunctionDef]]:
    """Top-level functions, then functions directly inside top-level classes."""
    for node in tree.body:
        if isinstance(node, ast.FunctionDef):
            yield None, node
    for cls in tree.body:
        if isinstance(cls, ast.ClassDef):
            yield from ((cls.name, node) for node in cls.body if isinstance(node, ast.FunctionDef))


def _imports(tree: ast.Module) -> list[dict]:
    plain = [("import", None, 0, a) for n in tree.body if isinstance(n, ast.Import) for a in n.names]
    sourced = [("from", n.module, n.level, a) for n in tree.body if isinstance(n, ast.ImportFrom) for a in n.names]
    return [
        {"import_ord": i, "kind": kind, "module": module, "level": level, "name": a.name, "alias": a.asname}
        for i, (kind, module, level, a) in enumerate(plain + sourced)
    ]


def rendered(node: ast.FunctionDef, lines: list[str], known: dict[str, str]) -> str:
    """``ast.unparse`` of a function, once for equal source lines: they hold the function
    alone, so equal ones are equal trees. Versions of a file share most of them."""
    first = min([node.lineno, *(x.lineno for x in node.decorator_list)])
    source = "\n".join(lines[first - 1 : node.end_lineno])
    if source not in known:
        if len(known) >= _RECENT:
            known.clear()
        known[source] = ast.unparse(node)
    return known[source]


def _params(node: ast.FunctionDef) -> list[str]:
    return [a.arg for a in node.args.args]


# A class on a line of its own, and how far the line after it is indented.
_HEADER = re.compile(r"class\b[^\n]*:[ \t]*\n(?:[ \t]*\n)*([ \t]+)(?=\S)")


def _cut(text: str, indent: str) -> list[str]:
    """Runs of lines that begin with a statement so far indented; a decorator keeps what it decorates."""
    where = re.compile(rf"^{indent}(?:(?:def|class|async|if)\b|@)", re.MULTILINE)  # that re keeps at hand
    places = [m.start() for m in where.finditer(text)]
    starts = [at for before, at in zip([None, *places], places) if before is None or text[before + len(indent)] != "@"]
    starts = starts if starts and not starts[0] else [0, *starts]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


class Blocks:
    """Functions and imports of texts, put together from blocks that are parsed once while at hand.

    A block begins with a statement in the first column or, in a class, with a member. The
    parser reads from left to right, and a block that is whole on its own leaves no bracket,
    string or indentation open. So if all blocks of a text are, their trees one after the
    other are the tree of the text. If one is not, for it begins inside a string or goes on
    with the line before, the text is no matter of blocks: that is a SyntaxError.
    """

    def __init__(self, known: dict[str, str]):
        self.known, self.size = known, 0
        self.found: dict[str, tuple[list[Function], list[dict], str | None]] = {}

    def __call__(self, content: str) -> tuple[list[Function], list[dict]]:
        functions, imports = [], []
        for block in _cut(content, ""):
            header = _HEADER.match(block)
            some = self.members(block, header) if header else None
            if some is None:
                some, more, _ = self.parsed(block)
                imports += more
            functions += some
        # Free functions and plain imports come first, as in a whole tree.
        functions.sort(key=lambda function: function[0] is not None)
        imports.sort(key=lambda entry: entry["kind"] != "import")
        return functions, [{**entry, "import_ord": i} for i, entry in enumerate(imports)]

    def members(self, block: str, header: re.Match) -> list[Function] | None:
        """Functions of a class, member by member; None if the block is not a class alone."""
        indent = header[1]
        parts = _cut(block, indent)
        if len(parts) > 1 and len(parts[0]) == header.start(1):
            parts[:2] = [parts[0] + parts[1]]  # no class is whole without a member
        functions, _, cls = self.parsed(parts[0], indent)
        if cls is None:
            return None
        for part in parts[1:]:
            inner, _, alone = self.parsed("if 1:\n" + part, indent)
            if alone is None:
                return None
            functions = functions + [(cls, *function[1:]) for function in inner]
        return functions

    def parsed(self, block: str, indent: str | None = None) -> tuple[list[Function], list[dict], str | None]:
        """Functions, imports and, with ``indent``, the name of the only statement if it is a
        class, or "if" if it is one without else, whose body is so far indented."""
        key = block if indent is None else indent + block
        if key not in self.found:
            tree, lines = ast.parse(block), block.split("\n")
            name = None
            if indent is not None and len(tree.body) == 1:
                match tree.body[0]:
                    case ast.ClassDef(name=name, body=[first, *_]):
                        pass
                    case ast.If(body=[first, *_], orelse=[]):
                        name, tree = "if", ast.Module(tree.body[0].body, [])
                if name is not None and (first.lineno == 1 or lines[first.lineno - 1][: first.col_offset] != indent):
                    name = None
            functions = [(cls, node.name, _params(node), rendered(node, lines, self.known)) for cls, node in _functions(tree)]
            if name == "if":
                functions = [function for function in functions if function[0] is None]
            if self.size > _BLOCK_CHARS:
                self.found.clear()
                self.size = 0
            self.found[key] = functions, _imports(tree), name
            self.size += len(key) + _BLOCK
        return self.found[key]


def _found(content: str, known: dict[str, str], blocks: Blocks | None) -> tuple[Iterable[Function], list[dict]]:
    """Functions and imports of a text, by blocks where that is the same as at once."""
    lines = None if "\r" in content else content.split("\n")  # as the parser counts them
    if blocks is not None and lines is not None:
        try:
            return blocks(content)
        except _FAILURES:
            pass
    tree = ast.parse(content)

    def functions() -> Iterator[Function]:
        for cls, node in _functions(tree):
            yield cls, node.name, _params(node), ast.unparse(node) if lines is None else rendered(node, lines, known)

    return functions(), _imports(tree)


def parse_units(
    content: str | None,
    calls_of: Callable[[str], list[dict]] = find_calls,
    known: dict[str, str] | None = None,
    blocks: Blocks | None = None,
) -> dict:
    """Units of one file. A file that cannot be parsed keeps what came before the fault.

    ``known`` keeps the texts of functions from file to file, ``blocks`` their places.
    """
    unit = {"parse_ok": True, "parse_error": None, "methods": [], "imports": []}
    if not content:
        return unit
    seen = set()
    try:
        functions, imports = _found(content, {} if known is None else known, blocks)
        for cls, name, params, text in functions:
            calls = calls_of(text)
            identity = (cls, name, tuple(params))
            unit["methods"].append(
                {
                    "method_ord": len(unit["methods"]), "class": cls, "name": name, "params": params,
                    "content": text, "repeated": identity in seen, "calls": calls,
                }
            )
            seen.add(identity)
        unit["imports"] = imports
    except _FAILURES as fault:
        unit["parse_ok"], unit["parse_error"] = False, type(fault).__name__
    return unit


def _narrowed(methods: tuple[str, ...] | None) -> T.StructType:
    """The schema of units whose methods have these fields alone."""
    if methods is None:
        return UNITS
    method = UNITS["methods"].dataType.elementType
    kept = T.ArrayType(T.StructType([f for f in method.fields if f.name in methods]))
    return T.StructType([T.StructField(f.name, kept if f.name == "methods" else f.dataType) for f in UNITS.fields])


def _parse_batches(byte_offsets: bool, kept: T.StructType = UNITS):
    schema = to_arrow_schema(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import warnings

        warnings.simplefilter("ignore")  # source under study may hold odd escapes
        # Versions of a file share most of their methods: keep recent answers.
        calls_of = lru_cache(maxsize=_RECENT)(partial(find_calls, byte_offsets=byte_offsets))
        known: dict[str, str] = {}
        blocks = Blocks(known)
        pending, size = [], 0
        for batch in batches:
            for sha, content in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                pending.append({"content_sha": sha, **parse_units(content, calls_of, known, blocks)})
                size += len(content or "")
                if size >= _FLUSH_CHARS:
                    yield pa.RecordBatch.from_pylist(pending, schema=schema)
                    pending, size = [], 0
        if pending:
            yield pa.RecordBatch.from_pylist(pending, schema=schema)

    return run


def extract_units(source_files: DataFrame, byte_offsets: bool = False, methods: tuple[str, ...] | None = None) -> DataFrame:
    """Units of every distinct content (null content is left out).

    ``byte_offsets=True`` leaves call offsets as the parser reports them, in
    bytes of the line, where they drift after a non-ASCII character. ``methods`` names
    the fields of methods to hand over. All are found as before, for a fault in any of
    them ends a file, but a third of the time went into nested rows that nobody reads.
    """
    contents = source_files.where("content is not null").select(
        content_sha(F.col("content")).alias("content_sha"), "content"
    )
    # distinct() over both columns hashes rows map-side, so copies meet early. Parsing far
    # exceeds their size in bytes, and few tasks by size would leave cores idle.
    kept = _narrowed(methods)
    return spread(contents.distinct(), "content_sha").mapInArrow(_parse_batches(byte_offsets, kept), kept)


def file_versions(source_files: DataFrame) -> DataFrame:
    """Files without their text: repository_name, branch, path, content_sha."""
    return source_files.select(
        "repository_name", "branch", "path", content_sha(F.col("content")).alias("content_sha")
    )


def by_content(units: DataFrame) -> DataFrame:
    """Rows of units, for joins on the hash of their text.

    The planner knows parsed rows by the compressed size of the texts only, a small part
    of their own, and would send them through the driver. Merged, no side is held whole.
    """
    return units.hint("merge")


def with_units(files: DataFrame, units: DataFrame, *columns: str) -> DataFrame:
    """Attach unit columns to files; unreadable files get none.

    A null key never matches, so those rows are given distinct stand-in keys to
    keep them from meeting in one task.
    """
    wanted = units.select(F.col("content_sha").alias("unit_sha"), *columns)
    key = F.coalesce("content_sha", F.concat(F.lit("-"), F.xxhash64("repository_name", "branch", "path")))
    return files.join(by_content(wanted), key == F.col("unit_sha"), "left").drop("unit_sha")


def parse_status(files: DataFrame, units: DataFrame) -> DataFrame:
    """One row per file: whether it parsed, and how many units it has."""
    counts = units.select(
        "content_sha",
        "parse_ok",
        "parse_error",
        F.size("methods").alias("n_methods"),
        F.size("imports").alias("n_imports"),
    )
    joined = with_units(files, counts, "parse_ok", "parse_error", "n_methods", "n_imports")
    return joined.select(
        "repository_name",
        "branch",
        "path",
        F.coalesce("parse_ok", F.lit(False)).alias("parse_ok"),
        F.when(F.col("content_sha").isNull(), F.lit("Unreadable")).otherwise(F.col("parse_error")).alias("parse_error"),
        F.coalesce("n_methods", F.lit(0)).alias("n_methods"),
        F.coalesce("n_imports", F.lit(0)).alias("n_imports"),
    )


def _beside(units: DataFrame) -> list[str]:
    """Columns that rows of units have besides what was parsed."""
    return [c for c in units.columns if c == "content_sha" or c not in UNITS.fieldNames()]


def extract_functions(units: DataFrame) -> DataFrame:
    """Free functions and class methods, in order: one row per method."""
    return units.select(*_beside(units), F.inline("methods"))


def free_functions(methods: DataFrame) -> DataFrame:
    return methods.where(F.col("class").isNull())


def class_methods(methods: DataFrame) -> DataFrame:
    return methods.where(F.col("class").isNotNull())


def render_import(entry: Column) -> Column:
    """Statement of one import; the dots of a relative import are not rendered."""
    source = F.when(
        entry["kind"] == "from", F.concat(F.lit("from "), F.coalesce(entry["module"], F.lit("None")), F.lit(" "))
    ).otherwise(F.lit(""))
    alias = F.coalesce(F.concat(F.lit(" as "), entry["alias"]), F.lit(""))
    return F.concat(source, F.lit("import "), entry["name"], alias)


def render_imports(imports: Column) -> Column:
    return F.transform(imports, render_import)


def extract_imports(units: DataFrame) -> DataFrame:
    rows = units.select(*_beside(units), F.explode("imports").alias("entry"))
    return rows.select(*_beside(units), "entry.*", render_import(F.col("entry")).alias("statement"))


def extract_calls(methods: DataFrame) -> DataFrame:
    """One row per call. Calls of a method are unique by (expression, start, end)."""
    keep = [c for c in methods.columns if c not in ("class", "name", "params", "content", "repeated", "calls")]
    return methods.select(*keep, F.inline("calls"))
