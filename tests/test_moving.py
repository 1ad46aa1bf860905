"""What moves between steps, what stays on disk and what a task holds at once."""

import glob
import os
import tempfile
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedimenta import queries
from sedimenta.bindings import history as h
from sedimenta.operators import calls, methods, renames
from sedimenta.session import released_shuffles, stage
from sedimenta.sources import changes as changes_io

DATA = "/root/testdata/sf0.001"


def shuffle_files() -> set[str]:
    roots = {tempfile.gettempdir(), os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir())}
    return {f for root in roots for f in glob.glob(f"{root}/blockmgr-*/*/shuffle_*.data")}


def test_staging_leaves_no_shuffle_files(spark):
    before = shuffle_files()
    kept = stage(spark.range(1000).repartition(4, "id"), "kept")
    end = time.time() + 10
    while shuffle_files() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files() - before
    assert kept.count() == 1000


def test_switch_comes_back_after_a_fault(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), released_shuffles(spark):
        assert spark.conf.get(key) == "true"
        raise RuntimeError
    assert spark.conf.get(key) == before


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
@pytest.mark.parametrize(
    "query, fields",
    [
        ("method_match_exact", {"class", "name", "params"}),
        ("method_match_signature_all_files", {"class", "name", "params"}),
        ("methods_added_removed", {"class", "name", "params"}),
        ("method_diff", {"class", "name", "params", "content"}),
        ("call_alignment", {"class", "name", "params", "calls"}),
    ],
)
def test_only_needed_fields_move(spark, monkeypatch, query, fields):
    asked, real = set(), h.history_files

    def seen(session, folder, *names):
        asked.update(names)
        return real(session, folder, *names)

    monkeypatch.setattr(h, "history_files", seen)
    queries.QUERIES[query](spark, DATA)
    assert asked - {"name"} == fields - {"name"}


def test_runs_of_rows_are_bounded_and_whole():
    lists = pa.array([[1] * 4, [], [1] * 9, [1], [1] * 3, []])
    runs = list(methods.spans(lists, limit=5))
    assert [start for start, _ in runs] == [0, 2, 3] and sum(n for _, n in runs) == len(lists)
    assert list(methods.spans(lists.slice(0, 0))) == [(0, 0)]
    ends, values = methods.inside(lists.slice(2, 2))
    assert ends == [0, 9, 10] and len(values) == 10


def test_placing_by_runs_gives_what_one_run_gives(monkeypatch):
    row = lambda *names: [{"class": None, "name": n, "params": ""} for n in names]
    kind = pa.list_(pa.struct([("class", pa.string()), ("name", pa.string()), ("params", pa.string())]))
    olds = pa.array([row("a", "b"), row(), row("c", "a", "a")], kind)
    news = pa.array([row("b"), row("x"), row("a", "d")], kind)
    exclusive = pa.array([True] * 3)
    at_once = methods._placed(olds, news, exclusive).to_pylist()
    parts = [methods._placed(olds.slice(i, 1), news.slice(i, 1), exclusive.slice(i, 1)) for i in range(3)]
    assert pa.concat_arrays(parts).to_pylist() == at_once


def test_aligned_without_texts_or_expressions(spark):
    call = "struct('f' as name, string(null) as context)"
    side = f"array(struct(string(null) as class, 'm' as name, array('x') as params, array({call}) as calls))"
    rows = spark.range(3).selectExpr("id", f"{side} as olds", f"{side} as news")
    found = queries.records.aligned_methods(rows, all_calls=True, texts=False, calls="aligned").select(F.inline("aligned")).collect()
    assert [(r.status, r.statistics, len(r.calls), r.calls[0].ratio) for r in found] == [("mapped", None, 1, None)] * 3
    with pytest.raises(ValueError):
        calls.compare_methods(F.col("pairs"), texts=False)


def test_records_that_are_not_gathered(spark, tmp_path):
    rows = queries._row_changes(spark, DATA) if os.path.isdir(DATA) else pytest.skip("test tables absent")
    folder = str(tmp_path / "changes")
    changes_io.write_changes(rows, folder, "parquet", gathered=False)
    assert changes_io.read_changes(spark, folder, "parquet").count() == rows.count()


def test_only_changed_methods_are_scored(spark):
    method = lambda text: f"struct('{text}' as content, array(struct(string(null) as context, 'f' as name, '{text}' as expression)) as calls)"
    pair = lambda status, old, new: f"struct('{status}' as status, {method(old)} as old, {method(new)} as new)"
    rows = spark.range(1).selectExpr(f"array({pair('mapped', 'a', 'a')}, {pair('mapped', 'ab', 'b')}, {pair('removed', 'a', 'b')}) as pairs")
    found = rows.select(calls.compare_methods(F.col("pairs")).alias("s"), calls.compare_methods(F.col("pairs"), all_mapped=True).alias("all")).first()
    assert [(s.dist, len(s.calls)) for s in found["s"]] == [(1, 1)]
    assert [s.dist for s in found["all"]] == [0, 1]


def test_release_pairs_are_assigned_one_after_the_other():
    columns = [("r", "1", "2"), ("r", "2", "3"), ("s", "1", "2")]
    events = [(*pair, *event) for pair in columns for event in (("edge", "c", "d"), ("new", "n1", "d"), ("new", "n2", "d"), ("old", "o1", "c"), ("old", "o2", "x"), ("old", "o3", "c"))]
    names = ["repository_name", "prev_branch", "branch", "kind", "left", "right"]
    table = pa.table([pa.array(x) for x in zip(*events)], names)
    found = pa.Table.from_batches(renames._assign_groups(iter(table.to_batches(max_chunksize=4)))).to_pylist()
    assert [tuple(f.values()) for f in found] == [(*pair, old, new) for pair in columns for old, new in (("o1", "n1"), ("o3", "n2"))]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
def test_file_diff_moves_no_names_with_whole_files(spark, monkeypatch):
    seen, real = [], queries.file_ops.pair_sides
    monkeypatch.setattr(queries.file_ops, "pair_sides", lambda pairs, files: seen.append(dict(files.dtypes)) or real(pairs, files))
    queries.QUERIES["file_diff"](spark, DATA)
    assert [(sorted(s), s["content_sha"]) for s in seen] == [(["branch", "content_sha", "path", "repository_name"], "binary")]
