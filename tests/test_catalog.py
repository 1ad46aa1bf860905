import pytest
from pyspark.sql import functions as F

from sedimenta.operators import catalog as ops
from sedimenta.plans.release_catalog import cleaned_catalog
from sedimenta.schemas import CATALOG_WITH_SEQ, RELEASE_TARGETS, SNAPSHOTS
from sedimenta.sources import catalog as io

G = "https://github.com/a/b"


def releases(spark, rows):
    return spark.createDataFrame([(r, b, "l", "n", d, i) for i, (r, b, d) in enumerate(rows)], CATALOG_WITH_SEQ)


def test_repository_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("https://github.com/a/b  \n\n https://pypi.org/project/x/\n")
    assert {r[0] for r in io.read_repositories(spark, str(tmp_path / "list.txt")).collect()} == {
        "https://github.com/a/b", "https://pypi.org/project/x/"
    }


def test_single_file_keeps_its_order(spark, tmp_path):
    lines = [f'{G},refs/tags/v1.{i},l,"n, ""q""",2020-01-01' for i in range(50)] + [f"{G},None,None,None,None"]
    path = tmp_path / "catalog.csv"
    path.write_text("repository,branch,download_link,name,date\n" + "\n".join(lines) + "\n")
    rows = io.read_catalog(spark, str(path)).orderBy("release_seq").collect()
    assert [r.branch for r in rows] == [f"refs/tags/v1.{i}" for i in range(50)] + [None]
    assert rows[0]["name"] == 'n, "q"'


def test_files_follow_one_another(spark, tmp_path):
    """Whatever the sizes of files and splits, the order is that of the concatenation."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        names = []
        for k, n in enumerate([30, 0, 1, 200, 7]):
            lines = [f"{G},refs/tags/v{k}.{i},{'l' * (i % 60)},n,2020-01-01" for i in range(n)]
            names += [f"refs/tags/v{k}.{i}" for i in range(n)]
            (tmp_path / f"part-{k}.csv").write_text("repository,branch,download_link,name,date\n" + "".join(x + "\n" for x in lines))
        found = io.read_catalog(spark, str(tmp_path))
        assert [(r.release_seq, r.branch) for r in found.orderBy("release_seq").collect()] == list(enumerate(names))
        turned = io.read_catalog(spark, [str(tmp_path / f"part-{k}.csv") for k in (4, 0)]).orderBy("release_seq").collect()
        assert [r.branch for r in turned] == names[-7:] + names[:30]
        assert [r.release_seq for r in turned] == list(range(37))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_round_trip_and_missing(spark, tmp_path):
    df = releases(spark, [(G, "refs/tags/v1.0", "2020-01-01")])
    io.write_catalog(df, str(tmp_path / "out"))
    assert io.read_catalog(spark, str(tmp_path / "out"), has_seq=True).collect() == df.collect()
    listed = spark.createDataFrame([(G,), ("https://x/y/",)], "repository string")
    rows = {r.repository: r.branch for r in io.catalog_with_missing(listed, df).collect()}
    assert rows == {G: "refs/tags/v1.0", "https://x/y/": "None"}


def test_junk_is_dropped_and_versions_are_deduplicated(spark):
    rows = [
        (G, "refs/tags/v1.0", "d"), (G, "refs/pull/1/head", "d"), (G, "refs/heads/dependabot/pip/x-1.2", "d"),
        (G, None, None), (G, "None", "None"), (G, "refs/heads/v1.0", "d"), (G, "refs/heads/main", "d"),
        (G, "refs/heads/dev", "d"), ("other/x", "refs/heads/main", "d"),
    ]
    kept = cleaned_catalog(releases(spark, rows), version_only=False).orderBy("release_seq").collect()
    assert [(r.release_seq, r.version) for r in kept] == [(0, "v1.0"), (6, None), (8, None)]
    flags = ops.flag_duplicated_versions(ops.clean_catalog(releases(spark, rows))).collect()
    assert {r.release_seq for r in flags if r.duplicated} == {0, 5, 6, 7}


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_pairs_do_not_depend_on_the_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(ops, "_CHUNK", chunk)
    rows = [(f"https://github.com/a/r{i % 3}", f"refs/tags/v{i}.0", f"20{20 - i:02d}-01-01") for i in range(20)]
    named = ops.name_releases(releases(spark, rows))
    pairs = ops.release_pairs(named).orderBy("repository_name", "release_idx").collect()
    assert len(pairs) == 17
    first = [p for p in pairs if p.repository_name == "r0"]
    assert [(p.prev_branch, p.branch, p.release_idx) for p in first] == [
        (f"refs-tags-v{i}.0", f"refs-tags-v{i + 3}.0", i // 3) for i in range(0, 18, 3)
    ]
    by_date = ops.release_pairs(named, "date").where("repository_name = 'r0'").orderBy("release_idx").collect()
    assert [(p.prev_branch, p.branch) for p in by_date] == [
        (f"refs-tags-v{i + 3}.0", f"refs-tags-v{i}.0") for i in range(15, -1, -3)
    ]


def test_present_releases(spark):
    rows = [(G, f"refs/tags/v{i}.0", "2020-01-01") for i in range(4)]
    pairs = ops.release_pairs(ops.name_releases(releases(spark, rows)))
    present = spark.createDataFrame([("b", "refs-tags-v0.0"), ("b", "refs-tags-v1.0"), ("b", "refs-tags-v3.0")], "repository_name string, branch string")
    assert [p.branch for p in ops.present_releases(pairs, present, require_next=True).collect()] == ["refs-tags-v1.0"]
    first_only = ops.present_releases(pairs, present, require_next=False).collect()
    assert {p.branch for p in first_only} == {"refs-tags-v1.0", "refs-tags-v2.0"}
    pending = ops.pending_downloads(ops.name_releases(releases(spark, rows)), present).collect()
    assert [p.branch for p in pending] == ["refs-tags-v2.0"]


def test_targets(spark):
    snapshots = spark.createDataFrame(
        [
            (G, {"refs/tags/v1.0": ("release", "u1"), "refs/heads/main": ("revision", "u2"), "refs/pull/1": ("revision", "u2")}),
            ("https://pypi.org/project/x/", {"releases/1.0": ("release", "u1"), "releases/2.0": ("revision", "u3")}),
            ("https://gitlab.com/a/b", {"v2.0": ("release", "u4")}), ("empty", {}), ("missing", None),
        ],
        SNAPSHOTS,
    )
    targets = spark.createDataFrame(
        [
            ("u1", False, "t1", None, "one", "d1", "u5"), ("u2", False, None, "dir2", None, None, None),
            ("u3", True, "t3", None, None, None, None), ("u5", False, "t5", "dir5", "five", "d5", None),
        ],
        RELEASE_TARGETS,
    )
    found = {(r.repository, r.branch): (r.root, r["name"], r.date) for r in ops.resolve_targets(snapshots, targets, version_only=False).collect()}
    assert found == {
        (G, "refs/tags/v1.0"): ("t5", "five", "d5"),
        (G, "refs/heads/main"): ("dir2", "None", "None"),
        ("https://pypi.org/project/x/", "releases/1.0"): ("t1", "one", "d1"),
    }
    only = ops.resolve_targets(snapshots, targets, version_only=True).select("branch").collect()
    assert {r[0] for r in only} == {"refs/tags/v1.0", "releases/1.0"}
    assert {r[0] for r in ops.empty_snapshots(snapshots).collect()} == {"empty", "missing"}


def test_distinct(spark):
    rows = [(G, "a", "d"), (G, "b", "d"), ("x", "a", "d")]
    assert ops.distinct_repositories(releases(spark, rows)).agg(F.count("*")).collect()[0][0] == 2
