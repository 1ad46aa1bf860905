"""Exact deduplication by content hash with a comparison of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Classes of equal texts; one row per input row.

    Rows are grouped by the 128-bit hash of the text together with the text, so the
    grouping itself compares bytes inside each hash group and a collision makes two
    classes. The grouping is combined before the shuffle: a text that a third of all
    rows share travels once per task. Rows find their class again by hash and
    SHA-256 alone, so a text never moves twice.

    ``keep``: ``smallest`` or ``largest`` id stays. Columns: ``id``, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256``.

    Defined results: a null text is the empty text. A null id yields to any other; a
    class of null ids alone keeps them. Rows that repeat an id with its text count
    each in ``group_size`` and share the decision. An empty table gives no rows.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = id_and_text(docs, id_col, text_col).withColumn("content", F.unhex(F.md5("body")))
    classes = (
        rows.groupBy("content", "body")
        .agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("content", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    members = rows.select("id", "content", F.sha2("body", 256).alias("text_sha256"))
    return members.join(classes, ["content", "text_sha256"]).select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
