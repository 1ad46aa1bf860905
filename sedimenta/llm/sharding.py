"""Balanced shards by vector bin packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import WORD

#: A unit with over this share of a shard, in any dimension, is placed before all others.
HEAVY_SHARE = 1 / 64
#: Units that one task packs, and rows that one task numbers.
UNITS_A_TASK, ROWS_A_TASK = 20_000, 50_000
DIMENSIONS = ["size", "tokens", "rows"]


def place(units: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """A shard for each unit, the largest first: where the dot product of the unit with
    the residual capacity is highest. ``residual`` (shards x dimensions) is used up."""
    chosen = np.zeros(len(units), dtype=np.int32)
    for at in np.argsort(-units.max(axis=1), kind="stable"):
        shard = int(np.argmax(residual @ units[at]))
        residual[shard] -= units[at]
        chosen[at] = shard
    return chosen


def shards(
    docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None
) -> DataFrame:
    """Puts documents into shards of nearly equal bytes, tokens and rows.

    Units are groups of equal texts, so copies stay together; only a group that is
    larger than a whole shard in some dimension is split, by hash of the id, into
    pieces of at most ``HEAVY_SHARE`` of a shard. Packing is first-largest, each unit
    going where its dot product with the residual capacity is highest. Heavy units, of
    which sums allow only a fixed number, are placed on the driver; all others are
    dealt into slices of bounded size that are packed side by side, each against its
    part of what is left of every shard. Texts do not move, only their hashes.

    ``tokens``: a count per row, by default words between white space. Columns: ``id``,
    ``size`` (UTF-8 bytes and 1), ``text_crc32``, ``shard``, ``slot`` (0, 1, ... in each
    shard).

    Defined results: a null text has no bytes and groups with the empty text. Null ids
    and repeated rows are documents like others, each with a slot of its own. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    counted = F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(WORD)) if tokens is None else tokens
    source = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("body"), counted.cast("double").alias("tokens"))
    rows = stage(
        source.select(
            "id",
            (F.octet_length("body") + 1).cast("long").alias("size"),
            F.crc32("body").alias("text_crc32"),
            F.coalesce("tokens", F.lit(0.0)).alias("tokens"),
            F.unhex(F.md5("body")).alias("content"),
        ),
        "shard-rows",
    )
    vector = [F.sum("size").cast("double").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).cast("double").alias("rows")]
    total = rows.agg(*vector).first()
    whole = {x: max(total[x] or 0.0, 1.0) for x in DIMENSIONS}
    share = F.greatest(*(F.col(x) / whole[x] for x in DIMENSIONS)) * n_shards

    # At most a shard's worth of groups each: n_shards a dimension.
    split = rows.groupBy("content").agg(*vector).where(share > 1).select("content", F.ceil(share / HEAVY_SHARE).alias("pieces"))
    pieces = F.coalesce("pieces", F.lit(1))
    rows = rows.join(F.broadcast(split), "content", "left").withColumn("piece", F.pmod(F.xxhash64("id"), pieces).cast("int")).drop("pieces")
    units = stage(rows.groupBy("content", "piece").agg(*vector), "shard-units")
    light = units.where(share <= HEAVY_SHARE)

    heavy = units.where(share > HEAVY_SHARE).orderBy("content", "piece").toPandas()  # at most 64 a shard and dimension
    residual = np.full((n_shards, len(DIMENSIONS)), 1 / n_shards)
    scale = np.array([whole[x] for x in DIMENSIONS])
    heavy["shard"] = place(heavy[DIMENSIONS].to_numpy(dtype=float) / scale, residual)
    placed = [(bytes(c), int(p), int(s)) for c, p, s in zip(heavy["content"], heavy["piece"], heavy["shard"])]
    heavy_shards = spark.createDataFrame(placed, "content binary, piece int, shard int")
    left = np.maximum(residual, 0)
    left = left / np.maximum(left.sum(axis=0), 1e-12)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["content", "piece"], ignore_index=True)
        vectors = group[DIMENSIONS].to_numpy(dtype=float) / scale
        return group[["content", "piece"]].assign(shard=place(vectors, left * vectors.sum(axis=0)))

    n_units = light.count()
    part = F.pmod(F.xxhash64("content", "piece"), F.lit(n_units // UNITS_A_TASK + 1))
    light_shards = light.withColumn("part", part).groupBy("part").applyInPandas(pack, "content binary, piece int, shard int")
    assigned = rows.join(light_shards.unionByName(heavy_shards), ["content", "piece"]).select("id", "size", "text_crc32", "shard")
    return with_slots(assigned, int(total["rows"]))


def with_slots(rows: DataFrame, n_rows: int) -> DataFrame:
    """Numbers rows in each shard without a gap, in blocks of bounded size."""
    rows = stage(rows.withColumn("block", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(n_rows // ROWS_A_TASK + 1))), "shard-blocks")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["shard", "block"])
    return numbered.select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str) -> None:
    """Writes rows with ``shard`` and ``slot`` into one folder a shard, in slot order."""
    docs.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
