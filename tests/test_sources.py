import io
import tarfile
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedimenta.bindings import landed as landed_files
from sedimenta.session import spread
from sedimenta.sources import requirements as req
from sedimenta.sources import trees
from sedimenta.sources.trees import archive_rows, archive_status, expand_archives, read_source_tree

RELEASES = "repository_name string, branch string"


def rows_of(df):
    return {(r.repository_name, r.branch, r.path): r.content for r in df.collect()}


def test_source_tree(spark, tmp_path):
    base = tmp_path / "r" / "v1"
    (base / "pkg" / "_private").mkdir(parents=True)
    (base / ".hidden").mkdir()
    (base / "pkg" / "__init__.py").write_bytes(b"a = 1\r\nb = 2\rc = 3\n")
    (base / "pkg" / "_private" / "m.py").write_bytes(b"x = '\xff'")
    (base / "pkg" / "empty.py").write_bytes(b"")
    (base / "pkg" / "notes.txt").write_text("no")
    (base / ".hidden" / "h.py").write_text("no")
    releases = spark.createDataFrame([("r", "v1"), ("r", "absent")], RELEASES)
    assert rows_of(read_source_tree(releases, tmp_path.as_uri())) == {
        ("r", "v1", "pkg/__init__.py"): "a = 1\nb = 2\nc = 3\n",
        ("r", "v1", "pkg/_private/m.py"): None,
        ("r", "v1", "pkg/empty.py"): "",
    }


def archive(path, members, mode):
    path.parent.mkdir(parents=True)
    with tarfile.open(path, mode) as out:
        for name, raw in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            out.addfile(info, io.BytesIO(raw))


def test_archives(spark, tmp_path):
    members = {
        "b-1/setup.py": b"s", "b-1/pkg/__init__.py": b"i\r\n", "b-1/requirements-dev.txt": b"r",
        "b-1/docs/readme.md": b"no", "top.py": b"no", "b-1/.github/x.py": b"no",
    }
    archive(tmp_path / "b" / "v1" / "data.tar.gz", members, "w:gz")
    archive(tmp_path / "b" / "v2" / "data.tar.gz", {"./b-2/a.py": b"2"}, "w")
    archive(tmp_path / "b" / "v3" / "data.tar.gz", {"b-3/a.py": b"3"}, "w:gz")
    (tmp_path / "b" / "v4").mkdir()
    (tmp_path / "b" / "v4" / "data.tar.gz").write_bytes(b"")
    releases = spark.createDataFrame([("b", f"v{i}") for i in range(1, 6)], RELEASES)
    done = spark.createDataFrame([("b", "v3")], RELEASES)
    assert rows_of(expand_archives(releases, tmp_path.as_uri(), extracted=done)) == {
        ("b", "v1", "setup.py"): "s", ("b", "v1", "pkg/__init__.py"): "i\n",
        ("b", "v1", "requirements-dev.txt"): "r", ("b", "v2", "a.py"): "2",
    }


def test_hard_links_hold_what_they_name(spark, tmp_path):
    def add(out, name, raw=None, link=None):
        info = tarfile.TarInfo(name)
        if link:
            info.type, info.linkname = tarfile.LNKTYPE, link
            return out.addfile(info)
        info.size = len(raw)
        out.addfile(info, io.BytesIO(raw))

    for branch, mode in (("v1", "w:gz"), ("v2", "w")):
        (tmp_path / "b" / branch).mkdir(parents=True)
        with tarfile.open(tmp_path / "b" / branch / "data.tar.gz", mode) as out:
            add(out, "b-1/a.py", b"first")
            add(out, "b-1/data.bin", b"script")
            add(out, "b-1/same.py", link="b-1/a.py")
            add(out, "b-1/again.py", link="b-1/same.py")
            add(out, "b-1/script.py", link="b-1/data.bin")
            add(out, "b-1/readme.md", link="b-1/a.py")
            add(out, "b-1/nowhere.py", link="b-1/absent.py")
            add(out, "b-1/a.py", b"second")
            add(out, "b-1/late.py", link="b-1/a.py")
            add(out, "b-1/tail.py", b"t" * 50_000)
    whole = (tmp_path / "b" / "v2" / "data.tar.gz").read_bytes()
    (tmp_path / "b" / "v2" / "data.tar.gz").write_bytes(whole[:-45_000])
    rows = archive_rows(spark.createDataFrame([("b", "v1"), ("b", "v2")], RELEASES), tmp_path.as_uri()).cache()
    found = rows.where("status is null")
    links = {"same.py": "first", "again.py": "first", "script.py": "script", "late.py": "second"}
    for branch in ("v1", "v2"):
        got = sorted((r.path, r.content) for r in found.where(F.col("branch") == branch).collect() if r.path != "tail.py")
        assert got == sorted([("a.py", "first"), ("a.py", "second"), *links.items()])
    assert {r.branch: r.status for r in archive_status(rows).collect()} == {"v1": "complete", "v2": "truncated"}


@pytest.mark.parametrize("error, fails", [(OSError("lost"), True), (TimeoutError("late"), True), (PermissionError("no"), False), (FileNotFoundError("gone"), False)])
@pytest.mark.parametrize("place", ["open", "read"])
def test_tree_errors_of_the_storage_fail_the_task(monkeypatch, error, fails, place):
    """A time-out must not make a file look unreadable; the next try reads it."""
    failing = [place]

    class Stream(io.BytesIO):
        def read(self, size=-1):
            if failing == ["read"]:
                raise error
            return super().read(size)

    class Storage:
        def open_input_stream(self, uri):
            if failing == ["open"]:
                raise error
            return Stream(b"x = 1")

    monkeypatch.setattr(trees, "fs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=lambda root: (Storage(), root))))
    listed = pa.RecordBatch.from_pylist([{"repository_name": "b", "branch": "v1", "path": "a.py", "uri": "a.py"}])

    def contents():
        return [raw for batch in trees._read_files("x://r")(iter([listed])) for raw in batch.column("raw").to_pylist()]

    if fails:
        with pytest.raises(type(error)):
            contents()
    else:
        assert contents() == [None]
    failing.clear()
    assert contents() == [b"x = 1"]


def test_archive_status(spark, tmp_path):
    members = {f"b-1/m{i}.py": bytes(range(256)) * 40 for i in range(30)}
    archive(tmp_path / "b" / "v1" / "data.tar.gz", members, "w:gz")
    archive(tmp_path / "b" / "v2" / "data.tar.gz", members, "w")
    whole = (tmp_path / "b" / "v2" / "data.tar.gz").read_bytes()
    for name, raw in (("v3", whole[: len(whole) // 2]), ("v4", b"")):
        (tmp_path / "b" / name).mkdir()
        (tmp_path / "b" / name / "data.tar.gz").write_bytes(raw)
    releases = spark.createDataFrame([("b", f"v{i}") for i in range(1, 6)], RELEASES)
    rows = archive_rows(releases, tmp_path.as_uri()).cache()
    assert {r.branch: r.status for r in archive_status(rows).collect()} == {
        "v1": "complete", "v2": "complete", "v3": "truncated", "v4": "truncated", "v5": "absent"
    }
    files = {r.branch: r["count"] for r in rows.where("status is null").groupBy("branch").count().collect()}
    assert files["v1"] == files["v2"] == 30 and 10 < files["v3"] < 30 and "v4" not in files


@pytest.mark.parametrize("error", [OSError("lost"), TimeoutError("late"), PermissionError("no"), FileNotFoundError("moved")])
@pytest.mark.parametrize("place", ["info", "open", "read"])
def test_storage_errors_fail_the_task(monkeypatch, tmp_path, error, place):
    archive(tmp_path / "b" / "a.tar", {f"b-1/m{i}.py": b"x" * 20_000 for i in range(9)}, "w")
    whole = io.BytesIO((tmp_path / "b" / "a.tar").read_bytes())

    def fail_at(here):
        if here == place:
            raise error

    class Stream(io.BytesIO):
        def read(self, size=-1):
            if whole.tell() > 100_000:
                fail_at("read")
            return whole.read(size)

    class Storage:
        def get_file_info(self, path):
            fail_at("info")
            return SimpleNamespace(type=trees.fs.FileType.File)

        def open_input_stream(self, path, compression):
            fail_at("open")
            return Stream()

    fake = SimpleNamespace(FileType=trees.fs.FileType, FileSystem=SimpleNamespace(from_uri=lambda root: (Storage(), root)))
    monkeypatch.setattr(trees, "fs", fake)
    releases = pa.RecordBatch.from_pylist([{"repository_name": "b", "branch": "v1"}])
    with pytest.raises(type(error)):
        list(trees._expand("x://r", "a.tar")(iter([releases])))


def test_requirements(spark):
    text = "\n".join(
        [
            "a", "b==1", "c>=1,<2 ; python_version < '3'", "# note", "", "git+https://h/x", "./local", "-r other.txt",
            "b ~= 2.0", "d[extra]>=3 # why", "=broken", "e (>=1, !=1.5)", "https://h/y.whl", "f[x] @ https://h/f.whl",
        ]
    )
    files = spark.createDataFrame(
        [("r", "v", "requirements.txt", text), ("r", "v", "sub/requirements.txt", "no==1")],
        "repository_name string, branch string, path string, content string",
    )
    parsed = req.parse_requirements(req.requirement_lines(files))
    found = req.requirement_maps(parsed).collect()[0].requirements
    assert {k: [(s.op, s.version) for s in v] for k, v in found.items()} == {
        "a": [], "b": [("~=", "2.0")], "c": [(">=", "1"), ("<", "2")], "git+https://h/x": [], "./local": [],
        "d": [(">=", "3")], "e": [(">=", "1"), ("!=", "1.5")], "https://h/y.whl": [], "f": [],
    }
    assert parsed.agg(F.count("*")).collect()[0][0] == 9


def test_distinct_releases_are_read_by_many_tasks(spark):
    """with as many shuffle partitions as tasks wanted, all archives were read by one task."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        releases = spark.range(500).select(F.lit("r").alias("repository_name"), F.col("id").cast("string").alias("branch"))
        spread_out = spread(releases.union(releases).distinct(), "repository_name", "branch")
        rows = spread_out.mapInArrow(lambda batches: batches, RELEASES).select(F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(rows) == 500 and len({r.task for r in rows}) == tasks


def test_landed_archives_hold_their_releases(spark, tmp_path):
    """Many releases pass through one task, each in an archive of its own, with its files alone."""
    files = [(f"r{i % 3}", f"v{i // 12}", f"p{i:03}/mod.py", f"t{i}", i % 7 == 0) for i in range(120)]
    table = spark.createDataFrame(files[::-1], RELEASES + ", path string, text string, invalid boolean")
    landed = landed_files.land_archives(table, tmp_path.as_uri())
    assert sorted((r.repository_name, r.branch) for r in landed.collect()) == sorted({f[:2] for f in files})
    want = {f[:3]: None if f[4] else f[3] for f in files} | {(*f[:2], "docs/requirements-dev.txt"): "kept==1\n" for f in files}
    assert rows_of(expand_archives(landed, tmp_path.as_uri())) == want
