"""Source trees and release archives as tables of files.

Both readers start from the releases of the catalogue, whose folders lie at
``<root>/<repository_name>/<branch>``. Spark's own file sources skip names that
start with an underscore, which would lose every ``__init__.py``, so tasks list
and read through pyarrow's file systems instead.
"""

from __future__ import annotations

import gzip
import lzma
import tarfile
import zlib
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.text import normalize_newlines
from sedimenta.session import spread

# The members worth keeping of a release archive.
KEPT_MEMBERS = ("*.py", "requirements*.txt")

#: What broken content raises. Other errors, of the storage, fail the task and Spark tries again.
_BROKEN = (tarfile.ReadError, EOFError, zlib.error, gzip.BadGzipFile, lzma.LZMAError)

_FLUSH_BYTES = 16 * 1024 * 1024
_RAW = pa.schema(
    [("repository_name", pa.string()), ("branch", pa.string()), ("path", pa.string()), ("raw", pa.binary())]
)
_LISTED = pa.schema(
    [("repository_name", pa.string()), ("branch", pa.string()), ("path", pa.string()), ("uri", pa.string())]
)
_RAW_DDL = "repository_name string, branch string, path string, raw binary"
_PACKED = pa.schema([*_RAW, ("status", pa.string())])
_PACKED_DDL = _RAW_DDL + ", status string"
_LISTED_DDL = "repository_name string, branch string, path string, uri string"


def decoded(raw: Column) -> Column:
    """Text of a file: null when it is not valid UTF-8, newlines as ``\\n``."""
    return normalize_newlines(F.try_validate_utf8(raw.cast("string")))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches bounded in bytes, whatever the size of single files."""
    pending, size = [], 0
    for row in rows:
        pending.append(row)
        size += 64 + len(row[3] or b"")
        if size >= _FLUSH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pending), schema)], schema=schema)
            pending, size = [], 0
    if pending:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pending), schema)], schema=schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _visible(path: str) -> bool:
    return not any(part.startswith(".") for part in path.split("/"))


def _list_releases(root: str, patterns: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(root)

        def rows() -> Iterator[tuple]:
            for release in _records(batches):
                folder = f"{base}/{release['repository_name']}/{release['branch']}"
                selector = fs.FileSelector(folder, allow_not_found=True, recursive=True)
                for info in filesystem.get_file_info(selector):
                    relative = info.path[len(folder) + 1:]
                    name = relative.rsplit("/", 1)[-1]
                    if info.type == fs.FileType.File and _visible(relative):
                        if any(fnmatchcase(name, p) for p in patterns):
                            yield release["repository_name"], release["branch"], relative, info.path

        yield from _batches(rows(), _LISTED)

    return run


def _read_files(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = fs.FileSystem.from_uri(root)

        def rows() -> Iterator[tuple]:
            for f in _records(batches):
                try:
                    with filesystem.open_input_stream(f["uri"]) as stream:
                        raw = stream.read()
                except (FileNotFoundError, PermissionError):
                    raw = None
                yield f["repository_name"], f["branch"], f["path"], raw

        yield from _batches(rows(), _RAW)

    return run


def read_source_tree(releases: DataFrame, root: str, patterns: tuple[str, ...] = ("*.py",)) -> DataFrame:
    """Files below each release folder: repository_name, branch, path, content.

    ``root`` is a URI. Listing and reading are two steps with a shuffle of the
    listed names between them, so one huge release is read by many tasks.
    Files that are gone or may not be read keep their row with null content, as do files
    that are not text. Other errors of the storage fail the task, and Spark tries again.
    """
    folders = spread(releases.select("repository_name", "branch").distinct(), "repository_name", "branch")
    listed = folders.mapInArrow(_list_releases(root, patterns), _LISTED_DDL)
    files = spread(listed, "repository_name", "branch", "path").mapInArrow(_read_files(root), _RAW_DDL)
    return files.select("repository_name", "branch", "path", decoded(F.col("raw")).alias("content"))


def _expand(root: str, archive_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(root)

        def entries(path: str) -> Iterator[tuple[int, tarfile.TarInfo, str, tarfile.TarFile]]:
            with filesystem.open_input_stream(path, compression=None) as stream:
                # "r|*" streams the archive: one member in memory at a time.
                with tarfile.open(fileobj=stream, mode="r|*") as archive:
                    for number, member in enumerate(archive):
                        yield number, member, member.name.removeprefix("./").partition("/")[2], archive

        def kept(inner: str) -> bool:
            name = inner.rsplit("/", 1)[-1]
            return _visible(inner) and any(fnmatchcase(name, p) for p in KEPT_MEMBERS)

        def members(release: dict, path: str) -> Iterator[tuple]:
            key = release["repository_name"], release["branch"]
            source: dict[str, int] = {}  # which member holds the content of a name
            linked: dict[int, list[str]] = {}
            broken = None
            try:
                for number, member, inner, archive in entries(path):
                    if member.isfile():
                        source[member.name] = number
                        if kept(inner):
                            yield *key, inner, archive.extractfile(member).read(), None
                    elif member.islnk() and member.linkname in source:
                        source[member.name] = source[member.linkname]
                        if kept(inner):
                            linked.setdefault(source[member.name], []).append(inner)
            except _BROKEN as error:
                broken = error
            if linked:  # a second pass over the archive, for contents that links name
                last = max(linked)
                for number, member, _, archive in entries(path):
                    if number in linked:
                        raw = archive.extractfile(member).read()
                        yield from ((*key, inner, raw, None) for inner in linked[number])
                    if number == last:
                        break
            if broken:
                raise broken

        def rows() -> Iterator[tuple]:
            for release in _records(batches):
                key = release["repository_name"], release["branch"]
                path = f"{base}/{release['repository_name']}/{release['branch']}/{archive_name}"
                status = "complete"
                if filesystem.get_file_info(path).type != fs.FileType.File:
                    status = "absent"
                else:
                    try:
                        yield from members(release, path)
                    except _BROKEN:
                        status = "truncated"
                yield *key, None, None, status

        yield from _batches(rows(), _PACKED)

    return run


def archive_rows(
    releases: DataFrame, root: str, archive_name: str = "data.tar.gz", extracted: DataFrame | None = None
) -> DataFrame:
    """Kept members of each release's archive, and a last row with the archive's status.

    Columns repository_name, branch, path, content, status. A member has no status; the
    last row of a release has no path and says ``complete``, ``truncated`` (empty or
    broken: members up to the break are here) or ``absent``. The first path component
    is stripped; hidden files and folders are skipped, as in source trees. A hard link has
    the content of the member it names. Errors of the
    storage are not statuses: they fail the task, and Spark tries again. Compressed
    and plain archives are told apart by content. Releases listed in ``extracted`` are
    skipped. Each archive is read once: stage the result to use both parts.
    """
    todo = releases.select("repository_name", "branch").distinct()
    if extracted is not None:
        todo = todo.join(extracted.select("repository_name", "branch"), ["repository_name", "branch"], "left_anti")
    todo = spread(todo, "repository_name", "branch")
    rows = todo.mapInArrow(_expand(root, archive_name), _PACKED_DDL)
    return rows.select("repository_name", "branch", "path", decoded(F.col("raw")).alias("content"), "status")


def archive_status(rows: DataFrame) -> DataFrame:
    """One row per release of ``archive_rows``: repository_name, branch, status."""
    return rows.where("status is not null").select("repository_name", "branch", "status")


def expand_archives(
    releases: DataFrame, root: str, archive_name: str = "data.tar.gz", extracted: DataFrame | None = None
) -> DataFrame:
    """The files alone of ``archive_rows``: repository_name, branch, path, content.

    A broken archive gives its members up to the break; ``archive_status`` tells.
    """
    rows = archive_rows(releases, root, archive_name, extracted)
    return rows.where("status is null").drop("status")
