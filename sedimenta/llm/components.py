"""Connected components by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node that each linked node reaches: columns ``node``, ``component``.

    Alternates two steps until the links stop changing: every node's larger neighbours
    are hung below its smallest neighbour, then every node's smaller neighbours are.
    The number of rounds grows with the logarithm of a component's size. Each round is
    one table in the shared folder; the driver sees a count and a checksum. A node with
    very many neighbours only makes a skewed inner join, which is split at run time.

    Links of a node with itself and repeated links change nothing; links with a null
    end are no links; no links give no rows.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = links.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct()
    edges, before = stage(edges, "links"), None
    while (now := fingerprint(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        larger = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        larger = larger.distinct()
        low = larger.groupBy("u").agg(F.min("v").alias("low"))
        smaller = larger.join(low, "u").where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = stage(smaller.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), "links")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def fingerprint(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.sum(F.pmod(mixed, F.lit(1_000_003)))).first())
