"""Removal of long repeated word spans by a compacted de Bruijn graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import id_and_text, packed, slices, unpacked

#: Words whose hash decides where paths are cut.
GRAM = 11
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode().split()  # bytes split at the six ASCII white-space characters


class Source:
    """The words of one text, joined by single spaces, with their places."""

    def __init__(self, text: str):
        self.words = words_of(text)
        self.joined = b" ".join(self.words)
        lengths = np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words))
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])

    def span(self, first: int, end: int) -> bytes:
        return self.joined[self.starts[first] : self.starts[end] - 1]


def paths(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts a text's edges (windows of ``width`` words) into local paths.

    Consecutive windows whose smallest hash of ``GRAM`` words is the same occurrence
    form one path. Equal windows hold equal hashes, so wherever a window stands, its
    path has the same anchor. Gives anchor hashes, first windows and window counts.
    """
    from xxhash import xxh3_64_intdigest

    gram = min(GRAM, width)
    each = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    mixed = np.zeros(len(words) - gram + 1, dtype=np.uint64)
    for at in range(gram):
        mixed = mixed * MIX + each[at : at + len(mixed)]
    mixed ^= mixed >> np.uint64(31)
    mixed *= MIX
    anchors = np.lib.stride_tricks.sliding_window_view(mixed, width - gram + 1).argmin(axis=1)
    anchors += np.arange(len(anchors))
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    return mixed[anchors[first]].view(np.int64), first, np.diff([*first, len(anchors)])


def path_rows(rows: DataFrame, width: int) -> DataFrame:
    """``content``, ``anchor``, ``span`` (digest of the path's words), ``first``, ``windows``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in slices(batches, "body"):
            contents, anchors, spans, firsts, counts = [], [], [], [], []
            for content, text in zip(batch.column("content").to_pylist(), batch.column("body").to_pylist()):
                source = Source(text)
                if len(source.words) < width:
                    continue
                anchor, first, count = paths(source.words, width)
                starts, stops = source.starts[first].tolist(), source.starts[first + count + width - 1].tolist()
                spans += [xxh3_64_intdigest(source.joined[a : b - 1]) for a, b in zip(starts, stops)]
                contents += [content] * len(first)
                anchors.append(anchor)
                firsts.append(first)
                counts.append(count)
            if spans:
                longs = [np.concatenate(x) for x in (anchors, firsts, counts)]
                arrays = [pa.array(contents, pa.binary()), pa.array(longs[0]), pa.array(np.array(spans, dtype=np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(x.astype(np.int32)) for x in longs[1:])], ["content", "anchor", "span", "first", "windows"])

    return rows.select("content", "body").mapInArrow(cut, "content binary, anchor bigint, span bigint, first int, windows int")


def window_rows(texts: DataFrame, width: int) -> DataFrame:
    """``content``, ``window`` (digest of its words), ``first``, for the paths in ``runs``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in slices(batches, "packed", 1 << 20):
            contents, windows, firsts = [], [], []
            for content, text, runs in zip(batch.column("content").to_pylist(), unpacked(batch.column("packed").to_pylist()), batch.column("runs").to_pylist()):
                source = Source(text)
                for run in runs:
                    for first in range(run["first"], run["first"] + run["windows"]):
                        contents.append(content)
                        windows.append(xxh3_128_digest(source.span(first, first + width)))
                        firsts.append(first)
            yield pa.RecordBatch.from_arrays([pa.array(contents, pa.binary()), pa.array(windows, pa.binary()), pa.array(firsts, pa.int32())], ["content", "window", "first"])

    return texts.select("content", "packed", "runs").mapInArrow(cut, "content binary, window binary, first int")


def repeated_spans(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes words covered by a window of ``width`` words that starts elsewhere too.

    Windows are the edges of a de Bruijn graph over words. Each text's edges are first
    compacted into paths between anchors that depend on nearby words alone, so equal
    edges lie on paths of equal anchors. Spark groups paths by anchor: an anchor that
    occurs once has no repeated edge; one whose paths all spell the same words is a
    nonbranching repeated path and stays compact; only where paths branch are they taken
    apart into windows, from the source coordinates and by digests of the words there,
    and those are grouped. So of each dozen windows one row is shuffled. Texts move
    compressed, by the hash of their content; equal texts decide alike.

    Columns: ``id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one
    space). Windows are judged on the input. Grouping is combined before the shuffle, and
    joins on anchors, windows and contents are inner or left joins that are split on skew.

    Defined results: null, empty and short texts have no windows and keep all words.
    Null ids pass; rows that repeat a text, with the same id or another, are copies of
    each other, and all lose what windows cover. An empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("content", F.unhex(F.md5("body")))
    cut = stage(path_rows(rows, width), "spans-paths")
    anchors = cut.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("low"), F.max("span").alias("high"))
    repeated = anchors.where("n > 1").select("anchor", (F.col("low") < F.col("high")).alias("branches"))
    runs = cut.select("content", "anchor", "first", "windows").join(repeated, "anchor")
    runs = stage(runs.groupBy("content", "first", "windows").agg(F.max("branches").alias("branches")), "spans-runs")

    texts = packed(rows)
    of_content = F.collect_list(F.struct("first", "windows")).alias("runs")
    apart = texts.join(runs.where("branches").groupBy("content").agg(of_content), "content")
    windows = stage(window_rows(apart, width), "spans-windows")
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    again = windows.join(twice, "window").select("content", "first", F.lit(1).alias("windows"))
    covered = runs.where("not branches").select("content", "first", "windows").unionByName(again).distinct()
    return kept_words(texts.join(covered.groupBy("content").agg(of_content), "content", "left"), width)


def kept_words(texts: DataFrame, width: int) -> DataFrame:
    kind = texts.schema["id"].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", 1 << 20):
            n_words, n_removed, bodies = [], [], []
            for text, runs in zip(unpacked(batch.column("packed").to_pylist()), batch.column("runs").to_pylist()):
                words = words_of(text)
                edges = np.zeros(len(words) + 1, dtype=np.int64)
                for run in runs or ():
                    edges[run["first"]] += 1
                    edges[run["first"] + run["windows"] + width - 1] -= 1
                stays = np.cumsum(edges[:-1]) == 0
                n_words.append(len(words))
                n_removed.append(len(words) - int(stays.sum()))
                bodies.append(b" ".join(words[at] for at in np.flatnonzero(stays)).decode())
            arrays = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(bodies, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", "n_words", "n_removed", "kept_text"])

    return texts.select("id", "packed", "runs").mapInArrow(keep, f"id {kind}, n_words bigint, n_removed bigint, kept_text string")
