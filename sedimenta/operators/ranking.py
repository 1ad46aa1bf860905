"""Row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.session import stage


def rank_within(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """1-based place of each row in its group, without one task per group.

    Rows are range-partitioned by (keys, order), which cuts a large group into
    consecutive chunks. The chunk is written down, because range bounds are
    sampled and a second evaluation might cut elsewhere. Places are then local
    row numbers plus the sizes of the group's earlier chunks.
    """
    cut = df.repartitionByRange(*keys, order).withColumn("chunk", F.spark_partition_id())
    cut = stage(cut, "ranked")
    local = cut.withColumn("local", F.row_number().over(W.partitionBy(*keys, "chunk").orderBy(order)))
    sizes = cut.groupBy(*keys, "chunk").agg(F.count("*").alias("n"))
    earlier = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return local.join(offsets, [*keys, "chunk"]).select(
        *df.columns, (F.col("local") + F.col("offset")).alias(name)
    )
