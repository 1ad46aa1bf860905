"""Alignment of methods between two versions of a file, inside the row that holds both."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.schemas import METHOD_PLACES

#: Class (or none), name, and parameters in one text.
Identity = tuple[str | None, str, str]
#: Status, kind of match, and the places on both sides.
Place = tuple[str, str | None, int | None, int | None]


def pair_up(old: list[Identity], new: list[Identity], signature_change_exclusive: bool = True) -> Iterator[Place]:
    """Places of aligned methods, old ones in their order, then added ones in theirs.

    * exact: same class, name and params; the first occurrence on each side.
    * signature: same class and name. The new method is the first one that no
      earlier old method has claimed exactly. It is not claimed, so it may serve
      several old methods.
    * the rest is removed or added. With ``signature_change_exclusive=False`` both
      sides of a signature match are listed as removed and added as well.

    Claims are never given back, so the first open method of a name only moves on: the
    work is linear in the two lists.
    """
    first: dict[Identity, int] = {}
    named: dict[tuple, list[int]] = defaultdict(list)
    for at, method in enumerate(new):
        first.setdefault(method, at)
        named[method[:2]].append(at)
    claimed, partners, passed = set(), set(), defaultdict(int)
    for at, method in enumerate(old):
        if method in claimed:
            continue
        if method in first:
            claimed.add(method)
            yield "mapped", "exact", at, first[method]
            continue
        alike, seen = named.get(method[:2], ()), passed[method[:2]]
        while seen < len(alike) and new[alike[seen]] in claimed:
            seen += 1
        passed[method[:2]] = seen
        if seen < len(alike):
            partners.add(alike[seen])
            yield "mapped", "signature", at, alike[seen]
            if signature_change_exclusive:
                continue
        yield "removed", None, at, None
    for at, method in enumerate(new):
        if method not in claimed and not (signature_change_exclusive and at in partners):
            yield "added", None, None, at


def inside(lists: pa.ListArray) -> tuple[list[int], pa.Array]:
    """Ends of the lists, from 0, and their elements; those around a slice are left out."""
    ends = lists.offsets.to_pylist()
    return [end - ends[0] for end in ends], lists.values.slice(ends[0], ends[-1] - ends[0])


def spans(*columns: pa.ListArray, limit: int = 10_000) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows whose lists have about ``limit`` elements.

    Python objects are many times their Arrow size, and a batch may have any number of
    them; made run by run they do not depend on it. One row is never cut.
    """
    ends = [sum(at) for at in zip(*(lists.offsets.to_pylist() for lists in columns))]
    start, rows = 0, len(ends) - 1
    for stop in range(1, rows + 1):
        if stop == rows or ends[stop + 1] - ends[start] > limit:
            yield start, stop - start
            start = stop
    if not rows:
        yield 0, 0


def _identities(lists: pa.ListArray) -> Iterator[list[Identity]]:
    ends, values = inside(lists)
    fields = [values.field(name).to_pylist() for name in ("class", "name", "params")]
    for start, end in zip(ends, ends[1:]):
        yield list(zip(*(field[start:end] for field in fields)))


def _placed(olds: pa.ListArray, news: pa.ListArray, exclusive: pa.Array) -> pa.ListArray:
    ends, found = [0], []
    for old, new, only in zip(_identities(olds), _identities(news), exclusive.to_pylist()):
        found.extend(pair_up(old, new, only))
        ends.append(len(found))
    columns = list(zip(*found)) or [()] * 4
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
    names = ["status", "match", "old_ord", "new_ord"]
    fields = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names))


@F.arrow_udf(METHOD_PLACES)
def _places(olds: pa.Array, news: pa.Array, exclusive: pa.Array) -> pa.Array:
    sides = olds, news, exclusive
    return pa.concat_arrays([_placed(*(x.slice(start, n) for x in sides)) for start, n in spans(olds, news)])


def align_methods(olds: Column, news: Column, signature_change_exclusive: bool = True) -> Column:
    """Array of (status, match, old_ord, new_ord) for two method lists of one row.

    Only identities reach Python, texts and calls do not. No rows are made and none
    are shuffled. Null lists count as empty.
    """

    def identities(methods: Column) -> Column:
        # No parameter holds a line break, so the joined text is as good as the list.
        light = F.transform(
            methods,
            lambda m: F.struct(m["class"].alias("class"), m["name"].alias("name"), F.array_join(m["params"], "\n").alias("params")),
        )
        return F.coalesce(light, F.array().cast("array<struct<class: string, name: string, params: string>>"))

    return _places(identities(olds), identities(news), F.lit(signature_change_exclusive))
