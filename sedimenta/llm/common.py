"""Helpers the operators share: reading tables, word patterns, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but the six ASCII white-space characters.
WORD = "[^\x20\x09-\x0d]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under names of its own.

    Whatever else the table carries, clashing names included, stays out of the plan.
    A null text becomes the empty text.
    """
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("body"))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in any case of its letters."""
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``limit`` bytes in each.

    A task's memory is then bounded by the longest row and not by the session's
    number of rows in a batch. One row is never cut.
    """
    for batch in batches:
        at = 0
        for stop in range(1, batch.num_rows + 1):
            if stop == batch.num_rows or batch.column(column)[at : stop + 1].nbytes > limit:
                yield batch.slice(at, stop - at)
                at = stop


def packed(rows: DataFrame) -> DataFrame:
    """``id``, ``content`` and the text as compressed bytes, about half of what a join
    would move otherwise. Other columns are dropped."""
    kept = [x for x in ("id", "content", "bundle") if x in rows.columns]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "body"):
            bodies = pa.array([press.compress(text.encode()) for text in batch.column("body").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), bodies], [*kept, "packed"])

    fields = ", ".join(f"{x} {rows.schema[x].dataType.simpleString()}" for x in kept)
    return rows.select(*kept, "body").mapInArrow(pack, f"{fields}, packed binary")


def unpacked(blobs: Iterable[bytes]) -> Iterator[str]:
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    return (open_.decompress(blob).decode() for blob in blobs)
