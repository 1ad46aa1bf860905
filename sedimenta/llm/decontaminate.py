"""Benchmark decontamination with an automaton over normalised benchmark windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Lower-cases A-Z and turns each ASCII character that is no word character into a
#: space; bytes beyond ASCII are word characters.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
BYTE_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Benchmark text in one automaton; a larger benchmark is scanned for in several.
BLOCK_BYTES = 64 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


def windows_of(text: str, width: int) -> set[bytes]:
    """Each run of ``width`` words; a shorter text, but not an empty one, is one run."""
    words = words_of(text)
    return {b" ".join(words[at : at + width]) for at in range(max(1, len(words) - width + 1))} if words else set()


def automaton(items: list[tuple[str, str]], width: int):
    """Maps each window, between spaces, to its number of words and its items."""
    import ahocorasick

    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for window in windows_of(text, width):
            owners.setdefault(window, set()).add(item)
    found = ahocorasick.Automaton()
    for window, names in owners.items():
        found.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, sorted(names)))
    found.make_automaton()
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps; touching spans become one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def item_block(items: DataFrame, item_col: str, text_col: str, block: int, blocks: int) -> list[tuple[str, str]]:
    item, text = F.coalesce(items[item_col].cast("string"), F.lit("")), F.coalesce(items[text_col], F.lit(""))
    texts = items.select(item.alias("item"), text.alias("body"))
    return [(row["item"], row["body"]) for row in texts.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == block).collect()]


def contamination(
    docs: DataFrame,
    items: DataFrame,
    width: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    with_row: bool = False,
) -> DataFrame:
    """Occurrences of benchmark windows in documents; one row per input row.

    Windows of ``width`` consecutive words of the items form one Aho-Corasick
    automaton, which each task builds from the items and runs once over each text.
    The benchmark's size is checked first: what exceeds ``block_bytes`` goes to
    further automata, each with a pass of its own, so results do not depend on it.
    No row is shuffled.

    Columns: ``id``, ``n_words``, ``items`` (sorted ids with occurring windows),
    ``spans`` (hit words as [first, end) word numbers and the same as [begin, stop)
    code points of the original text); and ``row``, all input columns as a struct, if
    ``with_row``.

    Defined results: null or wordless texts have no words and no hits; null or
    wordless items have no windows; a null item id counts as the empty text, and
    repeated items are one. Null ids, repeated rows and ties pass row by row. An
    empty benchmark hits nothing.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = "struct<first:bigint,end:bigint,begin:bigint,stop:bigint>"
    row = [F.struct(*(docs[x] for x in docs.columns)).alias("row")] * with_row
    rows = docs.select(
        docs[id_col].alias("id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("body"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast(f"array<{span}>").alias("spans"),
        *row,
    )
    total = items.agg(F.coalesce(F.sum(F.octet_length(items[item_text_col])), F.lit(0)).alias("n")).first()["n"]
    blocks = total // block_bytes + 1  # on the driver one at a time
    for block in range(blocks):
        kept = ["id", "n_words", "items", "spans"] + ["row"] * with_row + ["body"] * (block + 1 < blocks)
        scan = scanner(item_block(items, item_col, item_text_col, block, blocks), width, kept)
        kinds = {"id": kind, "n_words": "bigint", "items": "array<string>", "spans": f"array<{span}>", "body": "string"}
        kinds |= {"row": rows.schema["row"].dataType.simpleString()} if with_row else {}
        rows = rows.mapInArrow(scan, ", ".join(f"{x} {kinds[x]}" for x in kept))
    return rows


def scanner(items: list[tuple[str, str]], width: int, kept: list[str]):
    """One pass over texts; adds to the items and spans of passes before."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(items, width)
        for batch in slices(batches, "body"):
            n_words, names, spans = [], [], []
            earlier = zip(batch.column("items").to_pylist(), batch.column("spans").to_pylist())
            for text, (old_names, old_spans) in zip(batch.column("body").to_pylist(), earlier):
                words = words_of(text)
                hits: dict[int, tuple[int, tuple[str, ...]]] = {}
                line = f" {b' '.join(words).decode('latin-1')} "
                for at, (length, owners) in found.iter(line) if len(found) and words else ():
                    longest, others = hits.get(at, (0, ()))
                    hits[at] = max(length, longest), (*owners, *others)
                if hits:
                    old_names = sorted({*old_names, *(x for _, owners in hits.values() for x in owners)})
                    old_spans = with_offsets(text, merged([*((x["first"], x["end"]) for x in old_spans), *in_words(line, hits)]))
                n_words.append(len(words))
                names.append(old_names)
                spans.append(old_spans)
            out = {"n_words": pa.array(n_words, pa.int64())}
            out |= {x: pa.array(v, batch.schema.field(x).type) for x, v in (("items", names), ("spans", spans))}
            yield pa.RecordBatch.from_arrays([out.get(x, batch.column(x)) for x in kept], kept)

    return scan


def in_words(line: str, hits: dict[int, tuple]) -> Iterator[tuple[int, int]]:
    """Ends of hits in the normalised line as [first, end) word numbers."""
    at = end = 0
    for position in sorted(hits):
        end += line.count(" ", at + 1, position + 1)  # the space before the text is no end of a word
        at = position
        yield end - hits[position][0], end


def with_offsets(text: str, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Adds the code points of the original text to spans of words."""
    raw = text.encode()
    bounds = [found.span() for found in BYTE_WORD.finditer(raw)]
    out, byte, point = [], 0, 0
    for first, end in spans:
        begin_byte, stop_byte = bounds[first][0], bounds[end - 1][1]
        begin = point + len(raw[byte:begin_byte].decode())
        stop = begin + len(raw[begin_byte:stop_byte].decode())
        out.append({"first": first, "end": end, "begin": begin, "stop": stop})
        byte, point = stop_byte, stop
    return out
