"""Files on shared storage made from the test tables, written by the tasks themselves."""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.bindings.history import table
from sedimenta.session import shared_folder, spread, stage

# Files that go into one archive.
_PER_RELEASE = 10


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source is the repository, ten documents a release.

    Every third file is a package's ``__init__.py``, every seventh is not valid UTF-8.
    """
    doc = F.col("doc_id")
    release = F.floor(doc / _PER_RELEASE).cast("string")
    name = F.concat(F.lit("pkg"), doc.cast("string"), F.when(doc % 3 == 0, "/__init__.py").otherwise("/mod.py"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs-"), F.regexp_replace("source", "[^A-Za-z0-9]", "-")).alias("repository_name"),
        F.concat(F.lit("v"), release).alias("branch"),
        name.alias("path"),
        F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("text"),
        (doc % 7 == 0).alias("invalid"),
    )


def _raw(text: str, invalid: bool) -> bytes:
    return text.encode() + (b"\xff" if invalid else b"")


def land_tree(files: DataFrame, root: str) -> DataFrame:
    """Write each file below ``root``; returns the written releases."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for f in batch.itertuples():
                path = f"{base}/{f.repository_name}/{f.branch}/{f.path}"
                filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with filesystem.open_output_stream(path, compression=None) as out:
                    out.write(_raw(f.text, f.invalid))
            yield batch[["repository_name", "branch"]].drop_duplicates()

    written = files.mapInPandas(write, "repository_name string, branch string")
    return stage(written.distinct(), "releases")


def land_archives(files: DataFrame, root: str) -> DataFrame:
    """Write one compressed archive per release, plus a member that is not kept.

    Rows come sorted by release and path, and a task passes its releases one by one: a
    group of its own for each of very many small releases would cost ten times its archive.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(root)

        def members() -> Iterator[tuple[str, str, str, str, bool]]:
            for batch in batches:
                yield from zip(*(batch.column(x).to_pylist() for x in ("repository_name", "branch", "path", "text", "invalid")))

        def releases() -> Iterator[tuple[str, str]]:
            for (repository, branch), group in groupby(members(), itemgetter(0, 1)):
                folder = f"{base}/{repository}/{branch}"
                filesystem.create_dir(folder, recursive=True)
                packed = io.BytesIO()
                with tarfile.open(fileobj=packed, mode="w:gz") as archive:
                    def add(path: str, raw: bytes) -> None:
                        member = tarfile.TarInfo(f"{repository}-{branch}/{path}")
                        member.size = len(raw)
                        archive.addfile(member, io.BytesIO(raw))

                    for _, _, path, text, invalid in group:
                        add(path, _raw(text, invalid))
                    add("README.md", b"not kept")
                    add("docs/requirements-dev.txt", b"kept==1\n")
                with filesystem.open_output_stream(f"{folder}/data.tar.gz", compression=None) as out:
                    out.write(packed.getvalue())
                yield repository, branch

        landed = releases()
        while some := list(islice(landed, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*some)], ["repository_name", "branch"])

    key = "repository_name", "branch"
    written = spread(files, *key).sortWithinPartitions(*key, "path").mapInArrow(write, "repository_name string, branch string")
    return stage(written, "releases")
