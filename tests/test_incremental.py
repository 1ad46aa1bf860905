"""A history that grows run by run, against one computed at once."""

import pytest
from pyspark.sql import functions as F

from sedimenta.operators.catalog import name_releases
from sedimenta.plans.evolution import change_records
from sedimenta.plans.incremental import History
from sedimenta.schemas import CATALOG_WITH_SEQ, SOURCE_FILES

TEXTS = {
    "v1": {"a.py": "def f(x):\n    g(x)\n", "pkg/name.py": "def one():\n    pass\n", "none.py": None},
    "v2": {"a.py": "def f(x):\n    g(x, 1)\n", "lib/names.py": "def one():\n    pass\n", "none.py": None, "notes.txt": "x"},
    "v3": {"a.py": "def f(x):\n    g(x)\n", "lib/names.py": "def one():\n    go()\n"},
    "v4": {"a.py": "def f(x):\n    g(x, 1)\n", "lib/names.py": "import os\n"},
}


@pytest.fixture(scope="module")
def inputs(spark):
    rows = [
        (f"https://github.com/x/{r}", f"refs/tags/{v}", "l", "n", f"2020-01-0{i + 1}", 10 * k + i)
        for k, r in enumerate(("one", "two")) for i, v in enumerate(TEXTS)
    ]
    files = [(r, f"refs-tags-{v}", p, c) for r in ("one", "two") for v, tree in TEXTS.items() for p, c in tree.items()]
    return name_releases(spark.createDataFrame(rows, CATALOG_WITH_SEQ)), spark.createDataFrame(files, SOURCE_FILES)


def some(rows, *versions, repository="two"):
    """The rows of these versions, and all of the other repository."""
    return rows.where((F.col("repository_name") != repository) | F.substring("branch", -2, 2).isin(*versions))


def equal(got, want):
    return got.schema.simpleString() == want.schema.simpleString() and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_growing(inputs, spark, tmp_path):
    releases, sources = inputs
    history = History(spark, str(tmp_path))
    early = some(releases, "v1", "v2"), some(sources, "v1", "v2")
    added = history.extend(*early)
    assert added == {"present": 6, "files": 16, "units": 5, "pairs": 4, "diffs": 11, "changes": 4}
    assert equal(history.records(early[0]), change_records(*early))
    assert {(r.repository_name, r.branch[-2:]) for r in history.pending(releases).collect()} == {("two", "v3"), ("two", "v4")}
    with pytest.raises(ValueError, match="extend it first"):
        history.records(releases)
    # Texts and content pairs of the other repository serve these releases, too.
    added = history.extend(releases, sources)
    assert added == {"present": 2, "files": 4, "units": 0, "pairs": 2, "diffs": 5, "changes": 0}
    assert equal(history.records(releases), change_records(releases, sources))
    assert set(history.extend(releases, sources).values()) == {0} and len(history._batches()) == 2
    with pytest.raises(ValueError, match="other switches"):
        History(spark, str(tmp_path), tie_self=True)


def test_late_release_and_broken_run(inputs, spark, tmp_path, monkeypatch):
    """A release comes between two others, sources arrive late, a run breaks off."""
    releases, sources = inputs
    history = History(spark, str(tmp_path))
    history.extend(some(releases, "v1", "v3"), some(sources, "v1"))
    assert equal(history.records(some(releases, "v1", "v3")), change_records(some(releases, "v1", "v3"), some(sources, "v1")))
    with monkeypatch.context() as patch:
        patch.setattr(History, "_publish", lambda self, batch: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            history.extend(releases, sources)
    assert len(history._batches()) == 1
    history.extend(releases, sources)
    assert equal(history.records(releases), change_records(releases, sources))


def test_nothing_yet(inputs, spark, tmp_path):
    releases, sources = inputs
    history = History(spark, str(tmp_path))
    assert set(history.extend(releases.limit(0), sources.limit(0)).values()) == {0}
    assert history.records(releases.limit(0)).count() == 0
