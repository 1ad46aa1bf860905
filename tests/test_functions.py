import random
import time

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import ids, names, text
from sedimenta.operators import scoring
from sedimenta.operators.scoring import similarity, similarity_ratio, statistics


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_repository_names(spark):
    urls = ["https://github.com/a/b", "https://pypi.org/project/flask/", "https://gitlab.com/a/b", "x"]
    assert column(spark, urls, names.repo_name) == ["b", "flask", "b", None]
    assert column(spark, urls, lambda u: names.repo_name(u, ("github",)))[2] == "a"


def test_branches_and_versions(spark):
    branches = ["refs/tags/v1.2.3-rc1", "refs/heads/release/1.2", "refs/heads/main", "HEAD", None]
    assert column(spark, branches, names.version_token) == ["v1.2.3-rc1", "1.2", None, None, None]
    assert column(spark, branches, names.branch_slug)[:2] == ["refs-tags-v1.2.3-rc1", "refs-heads-release-1.2"]


def test_dates_are_read_as_utc(spark):
    dates = ["2020-01-02T03:04:05+02:00", "2020-01-02 03:04:05", "None", None]
    shown = column(spark, dates, lambda d: names.date_text(names.release_date(d)))
    assert shown == ["2020-01-02 01:04:05Z", "2020-01-02 03:04:05Z", None, None]


def test_paths(spark):
    assert column(spark, ["a/b/c.py", "c.py"], names.basename) == ["c.py", "c.py"]
    roots = lambda p: names.relative_path(p, F.lit("/data/r/"))
    assert column(spark, ["/data/r/a/b.py", "/other/b.py"], roots) == ["a/b.py", None]


def test_ids_tell_null_class_and_params_apart(spark):
    rows = [(None, "f", ["a"]), ("f", "f", ["a"]), (None, "f", ["a", "b"]), (None, "f", ["a"])]
    df = spark.createDataFrame(rows, "c string, n string, p array<string>")
    found = [r[0] for r in df.select(ids.method_id(F.col("c"), F.col("n"), F.col("p"))).collect()]
    assert found[0] == found[3] and len(set(found)) == 3


def expected_source(source):
    kept, inside = [], False
    for line in source.split("\n"):
        if '"""' in line or "'''" in line:
            inside = not inside
        elif not inside and line.strip() and not line.strip().startswith("#"):
            kept.append(line.strip())
    return "\n".join(kept)


def test_strip_comments_follows_the_line_states(spark):
    draw = random.Random(3)
    pieces = ["a = 1", "  # note", "", "  ", '"""', 'x = """doc"""', "'''", "\tb()\r", " c ", "#", '"" "']
    sources = ["\n".join(draw.choice(pieces) for _ in range(draw.randrange(12))) for _ in range(2000)]
    assert column(spark, sources, text.strip_comments) == [expected_source(s) for s in sources]


def test_strip_equals_python(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    values = [f"{c}a{c}b{c}" for c in spaces] + ["​a", "﻿a", ""]
    assert column(spark, values, text.strip) == [v.strip() for v in values]


def test_lines(spark):
    assert column(spark, ["", "a\n", "a\nb"], text.line_count) == [1, 2, 2]
    lines = column(spark, [" a\n\n b "], text.numbered_lines)[0]
    assert [(r.line_number, r.text) for r in lines] == [(0, "a"), (1, ""), (2, "b")]


def test_shared_method_ratio_counts_duplicates_and_ties(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "c", "d", "e"]), (["a", "b"], ["c", "d"])], "o array<string>, n array<string>")
    plain = [r[0] for r in df.select(text.shared_method_ratio(F.col("o"), F.col("n"))).collect()]
    own = [r[0] for r in df.select(text.shared_method_ratio(F.col("o"), F.col("n"), tie_self=True)).collect()]
    assert plain == [pytest.approx(1 / 3), 0.0]
    assert own == [pytest.approx(1 / 3), 1.0]


def table_similarity(a, b):
    lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    lev = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = a[i - 1] == b[j - 1]
            lcs[i][j] = lcs[i - 1][j - 1] + 1 if same else max(lcs[i - 1][j], lcs[i][j - 1])
            lev[i][j] = min(lev[i - 1][j] + 1, lev[i][j - 1] + 1, lev[i - 1][j - 1] + (not same))
    total = len(a) + len(b)
    return (2 * lcs[-1][-1] / total if total else 1.0), lev[-1][-1]


def test_similarity_equals_the_textbook_tables():
    draw = random.Random(5)
    for _ in range(3000):
        alphabet = draw.choice(["ab", "abcdé😀"])
        a, b = ("".join(draw.choice(alphabet) for _ in range(draw.randrange(14))) for _ in range(2))
        ratio, dist = similarity(a, b)
        assert (pytest.approx(ratio), dist) == table_similarity(a, b), (a, b)


@pytest.mark.parametrize("most", [0, 2, 10**6])
def test_diagonals_equal_the_textbook_tables(monkeypatch, most):
    """Whichever way a pair goes, the values are the same."""
    monkeypatch.setattr(scoring, "_affordable", lambda n, m: min(most, n + m))
    draw = random.Random(most)
    for _ in range(1500):
        alphabet = draw.choice(["ab", "abcdé😀"])
        a, b = ("".join(draw.choice(alphabet) for _ in range(draw.randrange(40))) for _ in range(2))
        ratio, dist = similarity(a, b)
        assert (pytest.approx(ratio), dist) == table_similarity(a, b), (a, b)


def edited(draw, text, edits):
    parts, at = [], 0
    for place in sorted(draw.sample(range(len(text)), edits)):
        parts += [text[at:place], draw.choice(["", "é", "new words"])]
        at = place + draw.randrange(2)
    return "".join(parts) + text[at:]


def test_few_edits_in_a_megabyte_take_no_second():
    draw = random.Random(9)
    text = "".join(draw.choice("abcdefgh \n") for _ in range(1 << 20))
    for a, b in ((text, edited(draw, text, 50)), ("ab" * (1 << 19), edited(draw, "ab" * (1 << 19), 50))):
        before = time.process_time()
        ratio, dist = similarity(a, b)
        assert time.process_time() - before < 1 and 0 < dist <= 50 * 9 and ratio > 0.999


def test_many_edits_in_long_texts():
    draw = random.Random(10)
    text = "".join(draw.choice("abcd") for _ in range(3000))
    for edits in (3, 40, 400):
        b = edited(draw, text, edits)
        x, y, shared = scoring._trim(text, b)
        lcs, dist = scoring._bit_parallel(x, y)
        assert similarity(text, b) == (2.0 * (shared + lcs) / (len(text) + len(b)), dist)


def test_runs():
    for n in (0, 1, 15, 16, 17, 47, 48, 49, 500):
        assert scoring._run("x" + "a" * n + "b", 1, "a" * n + "c", 0) == n
        assert scoring._run("a" * n, 0, "a" * (n + 3), 0) == n


def test_long_texts():
    draw = random.Random(6)
    a = "".join(draw.choice("abcd") for _ in range(400))
    b = a[:150] + "xyz" + a[170:300] + "".join(draw.choice("abcd") for _ in range(90))
    assert similarity(a, b)[1] == table_similarity(a, b)[1]
    assert similarity(a, b)[0] == pytest.approx(table_similarity(a, b)[0])


def test_statistics_column(spark):
    rows = [("utils.py", "util.py"), ("model.py", "models_new.py"), ("", ""), ("", "ab"), ("a", None), ("é", "e")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").orderBy("i")
    found = [r[0] for r in df.select(statistics(F.col("a"), F.col("b"))).collect()]
    assert [f and (f.ratio, f.dist) for f in found] == [(14 / 15, 1), (16 / 21, 5), (1.0, 0), (0.0, 2), None, (0.0, 1)]
    ratios = [r[0] for r in df.select(similarity_ratio(F.col("a"), F.col("b"))).collect()]
    assert ratios[:2] == [14 / 15, 16 / 21]
    distances = [r[0] for r in df.select(text.edit_distance(F.col("a"), F.col("b"))).collect()]
    assert distances == [1, 5, 0, 2, None, 1]
