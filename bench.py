"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR: folder of the tables (default sf0.1). BENCH_CPUS: local cores (default 8).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from sedimenta import queries
from sedimenta.session import configure

# Catalogue, extraction, each alignment, the whole plan, and statistics over the
# change dataset the line before wrote.
HEADLINE = [
    "dedup_versions",
    "release_pairs",
    "strip_comments",
    "extract_calls",
    "file_match_exact",
    "file_match_renamed",
    "method_match_exact",
    "method_diff",
    "call_diff",
    "write_change_dataset",
    "branch_statistics",
    "change_regression",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = configure(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
    spark = (
        builder.config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))  # start the engine

    def write_change_dataset(session: SparkSession, folder: str) -> DataFrame:
        return queries.changes_at_rest(session, folder).select("branch")

    seconds = {}
    for name in HEADLINE:
        query = write_change_dataset if name == "write_change_dataset" else queries.QUERIES[name]
        start = time.perf_counter()
        run(query(spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
