"""Repository lists and release catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.functions.text import strip
from sedimenta.schemas import CATALOG, CATALOG_COLUMNS, CATALOG_WITH_SEQ
from sedimenta.session import stage

# Fixed value: what a missing catalogue field is written as.
MISSING = "None"


def parse_repositories(lines: DataFrame) -> DataFrame:
    """Repository URLs from a DataFrame with one text column ``value``."""
    return lines.select(strip(F.col("value")).alias("repository")).where("repository != ''")


def read_repositories(spark: SparkSession, path: str) -> DataFrame:
    return parse_repositories(spark.read.text(path))


def null_missing(df: DataFrame) -> DataFrame:
    """Read ``''`` and ``'None'`` in catalogue columns as null."""
    fixed = {
        c: F.when(~F.col(c).isin("", MISSING), F.col(c)) for c in CATALOG_COLUMNS if c in df.columns
    }
    return df.withColumns(fixed)


def read_catalog(spark: SparkSession, path: str | list[str], has_seq: bool = False) -> DataFrame:
    """Release catalogue from CSV with a header.

    ``release_seq`` is the order of rows. With ``has_seq`` it is a column of the files;
    without, it follows the rows of the files one after the other: those of a list of
    paths in its order, those below one path by name.
    """
    paths = [path] if isinstance(path, str) else path
    schema = CATALOG_WITH_SEQ if has_seq else CATALOG
    reader = spark.read.schema(schema).option("header", True).option("escape", '"')
    parts = [reader.csv(p) for p in paths]
    if not has_seq:
        if len(parts) == 1 and len(parts[0].inputFiles()) == 1:
            parts = [parts[0].withColumn("release_seq", F.monotonically_increasing_id())]
        else:
            parts = [numbered(parts)]
    return null_missing(reduce(DataFrame.unionByName, parts))


def numbered(parts: list[DataFrame]) -> DataFrame:
    """The rows of several file scans, with ``release_seq`` from 0 in the order of ``parts``,
    file names, and rows.

    A block of a file is read by one task from top to bottom, so ids that grow within a
    task number its rows; where the block begins follows from the sizes of those before.
    Only sizes of blocks meet in one place, and no row is sorted or shuffled.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    read = [part.select(F.struct("*").alias("fields"), F.lit(k).alias("part"), *place) for k, part in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, read).withColumn("row", F.monotonically_increasing_id())
    rows = stage(rows, "catalog-rows")
    block = ["part", "file", "block"]
    sizes = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = W.orderBy(*block).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*block, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"))
    return rows.join(starts, block).select("fields.*", (F.col("start") + F.col("row")).alias("release_seq"))


def catalog_with_missing(repositories: DataFrame, releases: DataFrame) -> DataFrame:
    """Every listed repository, one row of ``'None'`` where it has no release."""
    listed = repositories.select("repository").distinct()
    fields = [c for c in CATALOG_COLUMNS if c != "repository"]
    joined = listed.join(releases, "repository", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(MISSING)) for c in fields})


def write_catalog(df: DataFrame, path: str) -> None:
    columns = [c for c in CATALOG_WITH_SEQ.fieldNames() if c in df.columns]
    df.select(*columns).write.option("header", True).option("escape", '"').csv(path)
