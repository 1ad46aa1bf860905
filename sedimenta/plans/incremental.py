"""A code history that grows: each run computes only what was not there before.

The store keeps what depends on content alone under its content: parsed units under the
hash of a text, aligned methods under the pair of hashes. Files and file diffs are kept
under their release and pair of releases. A run appends one batch of tables and makes
it visible by a line in ``published``, written last; a run that breaks off leaves files
that nobody reads, and the next one does its work again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.operators.catalog import initial_releases, pending_downloads, present_releases, release_pairs
from sedimenta.operators.files import PAIR
from sedimenta.operators.records import CONTENTS, changed_contents, content_changes, initial_files, nest_records
from sedimenta.operators.units import content_sha, extract_units, file_versions
from sedimenta.plans.evolution import release_diffs
from sedimenta.schemas import CHANGES, UNITS
from sedimenta.session import released_shuffles, stage

RELEASE = ["repository_name", "branch"]
#: A pair is computed again if its next release, absent so far, has arrived.
STATE = [*PAIR, "has_next"]


def _table(*names: str, **others: T.DataType) -> T.StructType:
    texts = [T.StructField(name, T.StringType()) for name in names]
    return T.StructType(texts + [T.StructField(name, kind) for name, kind in others.items()])


TABLES = {
    "present": _table(*RELEASE),
    "files": _table(*RELEASE, "path", "content_sha"),
    "units": UNITS,
    "pairs": _table(*PAIR, has_next=T.BooleanType()),
    "diffs": _table(*PAIR, "path", "prev_path", "status", "old_sha", "new_sha", has_next=T.BooleanType()),
    "changes": _table(*CONTENTS, imports=UNITS["imports"].dataType, changed_methods=CHANGES["methods"].dataType),
}
_PUBLISHED = "batch string, switches string"


class History:
    """A store in ``folder``, on storage that all executors share.

    The switches are those of ``change_records``. Those that decide what is stored are
    written down, and a store is not opened with others. A landed release does not
    change any more: rows of releases that the store holds are skipped. One writer at a
    time. The driver reads one line for each run, nothing else.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        *,
        order_by: str = "release_seq",
        require_next: bool = False,
        emit_single: bool = False,
        exact_first: bool = True,
        tie_self: bool = False,
        signature_change_exclusive: bool = True,
        byte_offsets: bool = False,
    ):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.order_by, self.require_next, self.emit_single = order_by, require_next, emit_single
        self.matching = {"exact_first": exact_first, "tie_self": tie_self}
        self.exclusive, self.byte_offsets = signature_change_exclusive, byte_offsets
        stored = {**self.matching, "signature_change_exclusive": self.exclusive, "byte_offsets": byte_offsets}
        self.switches = json.dumps(stored, sort_keys=True)
        self._batches()

    def _batches(self) -> list[str]:
        try:
            lines = self.spark.read.schema(_PUBLISHED).parquet(f"{self.folder}/published").collect()
        except AnalysisException as fault:
            if fault.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        if any(line.switches != self.switches for line in lines):
            raise ValueError(f"{self.folder} was built with other switches: {lines[0].switches}")
        return [line.batch for line in lines]

    def _read(self, name: str, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(f"{self.folder}/{name}/{batch}" for batch in batches))

    def _write(self, name: str, batch: str, rows: DataFrame) -> DataFrame:
        with released_shuffles(self.spark):
            rows.select(*TABLES[name].fieldNames()).write.option("compression", "zstd").parquet(f"{self.folder}/{name}/{batch}")
        return self._read(name, [batch])

    def _publish(self, batch: str) -> None:
        line = self.spark.createDataFrame([(batch, self.switches)], _PUBLISHED)
        line.coalesce(1).write.mode("append").parquet(f"{self.folder}/published")

    def _pairs(self, paired: DataFrame, present: DataFrame) -> DataFrame:
        """Pairs to compare, with whether the next release has sources."""
        there = present.select(*RELEASE, F.lit(True).alias("has_next"))
        kept = present_releases(paired, present, self.require_next).join(there, RELEASE, "left")
        return kept.withColumn("has_next", F.coalesce("has_next", F.lit(False)))

    def pending(self, releases: DataFrame) -> DataFrame:
        """Releases without sources in the store: only those need downloading and expanding."""
        return pending_downloads(releases, self._read("present", self._batches()))

    def extend(self, releases: DataFrame, source_files: DataFrame) -> dict[str, int]:
        """Add sources and compute the pairs they complete; returns the rows added per table.

        ``releases`` is the whole catalogue as known now, named as for ``change_records``;
        ``source_files`` may hold all sources or only new ones. Running it again, after a
        success or a failure, adds what is missing and nothing twice. A release that
        comes in between two others makes pairs of its own; the old pair stays unused.
        """
        known, batch = self._batches(), uuid.uuid4().hex
        fresh = source_files.join(self._read("present", known), RELEASE, "left_anti")
        added = {"present": self._write("present", batch, fresh.select(*RELEASE).distinct())}
        python = fresh.where(F.col("path").endswith(".py"))
        added["files"] = self._write("files", batch, file_versions(python))
        # Only texts that no release had before are parsed.
        parsed = self._read("units", known).select("content_sha")
        unseen = python.withColumn("content_sha", content_sha(F.col("content"))).join(parsed, "content_sha", "left_anti")
        added["units"] = self._write("units", batch, extract_units(unseen, self.byte_offsets))

        here = [*known, batch]
        files, units = self._read("files", here), self._read("units", here)
        paired = release_pairs(releases, self.order_by)
        pairs = self._pairs(paired, self._read("present", here))
        pairs = stage(pairs.join(self._read("pairs", known), STATE, "left_anti"), "pairs")
        added["pairs"] = self._write("pairs", batch, pairs)
        diffs = release_diffs(pairs, files, units, **self.matching)
        added["diffs"] = self._write("diffs", batch, diffs.join(pairs.select(*STATE), PAIR))
        contents = changed_contents(added["diffs"].where("status = 'mapped'"))
        contents = contents.join(self._read("changes", known).select(*CONTENTS), CONTENTS, "left_anti")
        added["changes"] = self._write("changes", batch, content_changes(contents, units, self.exclusive))

        counts = {name: rows.count() for name, rows in added.items()}
        if counts["present"] or counts["pairs"]:
            self._publish(batch)
        return counts

    def records(self, releases: DataFrame) -> DataFrame:
        """Change records of the catalogue, put together from the store: the rows of
        ``change_records``. Pairs that no run has computed are an error."""
        known = self._batches()
        present, files, units = (self._read(name, known) for name in ("present", "files", "units"))
        paired = stage(release_pairs(releases, self.order_by), "paired")
        pairs = stage(self._pairs(paired, present), "pairs")
        if not pairs.join(self._read("pairs", known), STATE, "left_anti").isEmpty():
            raise ValueError("the catalogue has pairs that the store lacks: extend it first")
        diffs = self._read("diffs", known).join(pairs.select(*STATE), STATE, "left_semi").drop("has_next")
        first = initial_releases(releases, paired, present, self.emit_single)
        changes = self._read("changes", known)
        return nest_records(diffs, initial_files(first, files), pairs, units, self.exclusive, changes)
