"""Alignment of calls between two versions of a method, and scores of both."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.operators.methods import inside, spans
from sedimenta.operators.scoring import similarity
from sedimenta.schemas import METHOD_SCORES

#: What a call goes to: context (or none) and name.
Target = tuple[str | None, str]

# Scores kept for texts that come again.
_KNOWN = 20_000


def pair_up(old: list[Target], new: list[Target]) -> Iterator[tuple[int | None, int | None]]:
    """Places of aligned calls, old ones in their order, then added ones in theirs.

    Each old call, by position, takes the first free new call of the same target: first
    in, first out per target.
    """
    if old == new:
        yield from zip(range(len(old)), range(len(new)))
        return
    free: dict[Target, deque[int]] = defaultdict(deque)
    for at, target in enumerate(new):
        free[target].append(at)
    for at, target in enumerate(old):
        yield at, free[target].popleft() if free[target] else None
    yield from ((None, at) for at in sorted(at for queue in free.values() for at in queue))


_SIDE = "array<struct<context: string, name: string, expression: string>>"


def _call_lists(lists: pa.ListArray) -> Iterator[tuple[list[Target], list[str]]]:
    ends, values = inside(lists)
    contexts, names, expressions = (values.field(x).to_pylist() for x in ("context", "name", "expression"))
    for start, end in zip(ends, ends[1:]):
        yield list(zip(contexts[start:end], names[start:end])), expressions[start:end]


def _scored(pairs: pa.ListArray, known: dict[tuple[str, str], tuple[float, int]]) -> pa.ListArray:
    _, both = inside(pairs)
    sides = (both.field(x).to_pylist() for x in ("old_text", "new_text"))
    calls = (_call_lists(both.field(x)) for x in ("old_calls", "new_calls"))

    def score(old: str | None, new: str | None) -> tuple[float | None, int | None]:
        if old is None or new is None:
            return None, None
        if old == new:
            return 1.0, 0
        if (old, new) not in known:
            if len(known) >= _KNOWN:
                known.clear()
            known[old, new] = similarity(old, new)
        return known[old, new]

    scores, ends, found = [], [0], []
    for old, new, (old_targets, old_calls), (new_targets, new_calls) in zip(*sides, *calls):
        scores.append(score(old, new))
        for a, b in pair_up(old_targets, new_targets):
            status = "removed" if b is None else "added" if a is None else "mapped"
            found.append((status, a, b, *score(None if a is None else old_calls[a], None if b is None else new_calls[b])))
        ends.append(len(found))

    def structs(rows: list[tuple], **kinds: pa.DataType) -> list[pa.Array]:
        return [pa.array(column, kind) for column, kind in zip(list(zip(*rows)) or [()] * len(kinds), kinds.values())]

    inner = dict(status=pa.string(), old_at=pa.int32(), new_at=pa.int32(), ratio=pa.float64(), dist=pa.int32())
    nested = pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.StructArray.from_arrays(structs(found, **inner), list(inner))
    )
    outer = [*structs(scores, ratio=pa.float64(), dist=pa.int32()), nested]
    offsets, _ = inside(pairs)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(outer, ["ratio", "dist", "calls"]))


@F.arrow_udf(METHOD_SCORES)
def _compare(pairs: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known: dict[tuple[str, str], tuple[float, int]] = {}
    for batch in pairs:
        yield pa.concat_arrays([_scored(batch.slice(start, n), known) for start, n in spans(batch)])


def compared(pair: Column, all_mapped: bool = False) -> Column:
    """Whether a pair of methods is scored: mapped, and with another text unless ``all_mapped``."""
    wanted = pair["status"] == "mapped"
    return wanted if all_mapped else wanted & (pair["old"]["content"] != pair["new"]["content"])


def compare_methods(pairs: Column, all_mapped: bool = False, texts: bool = True, calls: str = "scored") -> Column:
    """Array of (ratio, dist, calls) for those of ``pairs`` that are ``compared``, in their
    order: scores of the texts, aligned calls.

    ``pairs`` are structs with status and the methods ``old`` and ``new``. Calls are
    (status, old_at, new_at, ratio, dist), places being those in the methods' lists.
    The others are not sent over: most methods of a changed file stay the same. Without
    ``texts`` methods are not scored. ``calls`` are "scored", "aligned" or "left out".
    Methods and calls need no field that this leaves unread.
    """
    if not texts and not all_mapped:
        raise ValueError("without texts nobody knows which ones stayed the same")

    def side(method: Column) -> Column:
        no_calls = F.array().cast(_SIDE)
        if calls == "left out":
            return no_calls

        def light(call: Column) -> Column:
            expression = call["expression"] if calls == "scored" else F.lit(None).cast("string")
            return F.struct(call["context"].alias("context"), call["name"].alias("name"), expression.alias("expression"))

        return F.coalesce(F.transform(method["calls"], light), no_calls)

    def sent(pair: Column) -> Column:
        text = [pair[x]["content"] if texts else F.lit(None).cast("string") for x in ("old", "new")]
        return F.struct(
            text[0].alias("old_text"), text[1].alias("new_text"),
            side(pair["old"]).alias("old_calls"), side(pair["new"]).alias("new_calls"),
        )

    return _compare(F.transform(F.filter(pairs, lambda pair: compared(pair, all_mapped)), sent))
