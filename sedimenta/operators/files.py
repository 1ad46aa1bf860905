"""Alignment of files between contiguous releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["repository_name", "prev_branch", "branch"]


def pair_sides(pairs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of the previous and of the next release of each pair.

    Merged, since files at rest are many times their compressed size, by which the
    planner would send them through the driver.
    """
    keys, merged = pairs.select(*PAIR), files.hint("merge")
    old = keys.join(merged.withColumnRenamed("branch", "prev_branch"), ["repository_name", "prev_branch"])
    new = keys.join(merged, ["repository_name", "branch"])
    rest = [c for c in files.columns if c not in ("repository_name", "branch")]
    return old.select(*PAIR, *rest), new.select(*PAIR, *rest)


def compare_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer join on the path: status mapped, removed or added.

    Other columns come as structs ``old`` and ``new``. The path is part of the
    key, so no release, however large, is one task.
    """
    def packed(side: DataFrame, name: str) -> DataFrame:
        rest = [F.col(c) for c in side.columns if c not in (*PAIR, "path")]
        return side.select(*PAIR, "path", F.struct(F.lit(True).alias("present"), *rest).alias(name))

    joined = packed(old, "old").join(packed(new, "new"), [*PAIR, "path"], "full_outer")
    status = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("mapped")
    )
    return joined.withColumn("status", status)


def match_exact(compared: DataFrame) -> DataFrame:
    return compared.where("status = 'mapped'")


def leftovers(compared: DataFrame, side: str) -> DataFrame:
    """Files without a partner of the same path; ``side`` is "old" or "new"."""
    status = "removed" if side == "old" else "added"
    return compared.where(F.col("status") == status).select(*PAIR, "path", f"{side}.*").drop("present")


def unmatched(compared: DataFrame, renamed: DataFrame) -> DataFrame:
    """Added and removed files once renamed ones are taken out."""
    rows = compared.where("status != 'mapped'")
    gone = rows.where("status = 'removed'").join(
        renamed.select(*PAIR, F.col("prev_path").alias("path")), [*PAIR, "path"], "left_anti"
    )
    fresh = rows.where("status = 'added'").join(renamed.select(*PAIR, "path"), [*PAIR, "path"], "left_anti")
    return gone.unionByName(fresh)
