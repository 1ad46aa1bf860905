"""Alignment operators against small sequential statements of the same rules."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sedimenta.functions.text import shared_method_ratio
from sedimenta.operators import files as fo
from sedimenta.operators import renames
from sedimenta.operators.methods import pair_up
from sedimenta.operators.ranking import rank_within
from sedimenta.operators.records import aligned_methods
from sedimenta.operators.renames import assign, match_renamed
from sedimenta.operators.scoring import similarity

def expected_methods(old, new, exclusive):
    """old, new: identities in order. Rows (status, match, old place, new place)."""
    rows, claimed, done = [], set(), set()
    lone_old, partners = [], set()
    for i, method in enumerate(old):
        if method in done:
            continue
        if method in new:
            rows.append(("mapped", "exact", i, new.index(method)))
            claimed.add(method)
            done.add(method)
            continue
        near = [j for j, other in enumerate(new) if other not in claimed and other[:2] == method[:2]]
        if near:
            rows.append(("mapped", "signature", i, near[0]))
            partners.add(near[0])
        if not near or not exclusive:
            lone_old.append(("removed", None, i, None))
    lone_new = [
        ("added", None, None, j) for j, other in enumerate(new)
        if other not in claimed and not (exclusive and j in partners)
    ]
    return rows + lone_old + lone_new


METHOD = (
    "struct<class: string, name: string, params: array<string>, content: string, calls: array<struct<"
    "call_ord: int, name: string, context: string, expression: string, start_offset: int, end_offset: int, lineno: int>>>"
)


def expected_calls(old, new):
    """old, new: (context, name, start). Rows (status, old place, new place)."""
    free, rows = list(range(len(new))), []
    for i, call in enumerate(old):
        j = next((j for j in free if new[j][:2] == call[:2]), None)
        rows.append(("removed" if j is None else "mapped", i, j))
        free = [f for f in free if f != j]
    return rows + [("added", None, j) for j in free]


@pytest.mark.parametrize("exclusive", [True, False])
@pytest.mark.parametrize("all_calls", [True, False])
def test_methods_and_calls(spark, exclusive, all_calls):
    draw = random.Random(11)

    def calls():
        return [(draw.choice([None, "np"]), draw.choice("fg"), s) for s in sorted(draw.sample(range(100), draw.randrange(6)))]

    def side():
        return [
            (draw.choice([None, "A"]), draw.choice("fg"), tuple(draw.choice("xyz") for _ in range(draw.randrange(3))), draw.choice(["", "é", "long text"]), calls())
            for _ in range(draw.randrange(7))
        ]

    def row(method):
        listed = [(i, c[1], c[0], f"{c[1]}({c[2]})", c[2], c[2] + 3, 0) for i, c in enumerate(method[4])]
        return (method[0], method[1], list(method[2]), method[3], listed)

    groups = [(side(), side()) for _ in range(600)] + [(None, None)]
    rows = [(g, *(None if x is None else [row(m) for m in x] for x in pair)) for g, pair in enumerate(groups)]
    sides = spark.createDataFrame(rows, f"g int, olds array<{METHOD}>, news array<{METHOD}>")
    found = {r.g: r.aligned for r in aligned_methods(sides, exclusive, all_calls).collect()}
    assert len(found) == len(groups) and not found[600]
    for g, (old, new) in enumerate(groups[:-1]):
        want = expected_methods([m[:3] for m in old], [m[:3] for m in new], exclusive)
        want.sort(key=lambda x: (99 if x[2] is None else x[2], 99 if x[3] is None else x[3]))
        assert [(a.status, a.match, a.old_ord, a.new_ord) for a in found[g]] == want
        for a, (status, _, i, j) in zip(found[g], want):
            assert (a.old and a.old.content) == (None if i is None else old[i][3])
            if status != "mapped":
                assert a.statistics is None and not a.calls
                continue
            assert tuple(a.statistics) == similarity(old[i][3], new[j][3])
            if not all_calls and old[i][3] == new[j][3]:
                assert not a.calls
                continue
            listed = expected_calls(old[i][4], new[j][4])
            assert [(c.status, c.old_at, c.new_at) for c in a.calls] == listed
            for c, (kind, k, m) in zip(a.calls, listed):
                score = similarity(row(old[i])[4][k][3], row(new[j])[4][m][3]) if kind == "mapped" else (None, None)
                assert (c.ratio, c.dist) == score


def test_alignment_stays_in_its_row(spark):
    """Nothing is shuffled between the two method lists and the nested records."""
    sides = spark.createDataFrame([], f"g int, olds array<{METHOD}>, news array<{METHOD}>")
    plan = aligned_methods(sides)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 2


def test_alignment_is_linear():
    """Many methods of one name that are claimed later or never."""
    new = [(None, "f", str(i)) for i in range(20_000)]
    old = [m for i in range(20_000) for m in ((None, "f", str(i)), (None, "f", f"gone {i}"))]
    start = time.perf_counter()
    found = list(pair_up(old, new))
    assert time.perf_counter() - start < 2
    assert found[:4] == [("mapped", "exact", 0, 0), ("mapped", "signature", 1, 1), ("mapped", "exact", 2, 1), ("mapped", "signature", 3, 2)]
    assert found[-1] == ("removed", None, 39_999, None) and len(found) == 40_000


FILES = "repository_name string, prev_branch string, branch string, path string, names array<string>"
STEMS = ["__init__", "utils", "util", "utilities", "model", "models", "model_b", "tests", "test", "main_view", "main_views", "a"]


def random_release_pairs(draw, n):
    def side():
        paths = {f"{draw.choice('pqrs')}{draw.randrange(3)}/{draw.choice(STEMS)}.py" for _ in range(draw.randrange(14))}
        return {p: [draw.choice("abcd") for _ in range(draw.choice([0, 0, 1, 2, 3, 4]))] for p in paths}
    return [(side(), side()) for _ in range(n)]


def ratio_of(old, new, tie_self):
    if tie_self and len(old) == len(new):
        new = old
    return len(set(old) & set(new)) / min(len(old), len(new))


def expected_renames(old, new, exact_first, tie_self):
    pairs, taken = [], set()
    both = set(old) & set(new)
    for path in sorted(set(old) - both):
        for other in sorted(new):
            if other in taken or (other in both and (exact_first or other < path)):
                continue
            if similarity(path.split("/")[-1], other.split("/")[-1])[0] <= 0.75:
                continue
            if old[path] and new[other] and ratio_of(old[path], new[other], tie_self) <= 0.5:
                continue
            taken.add(other)
            pairs.append((path, other))
            break
    return pairs


@pytest.mark.parametrize(
    "exact_first,tie_self,group_rows", [(True, False, 100_000), (True, False, 0), (True, True, 12), (False, True, 100_000), (False, False, 0)]
)
def test_renames(spark, exact_first, tie_self, group_rows):
    """group_rows=0 sends every release pair through the relational rounds."""
    draw = random.Random(13)
    groups = random_release_pairs(draw, 25 if group_rows == 0 else 150)
    def table(k):
        return spark.createDataFrame(
            [(f"r{g}", "v1", "v2", p, ns) for g, pair in enumerate(groups) for p, ns in pair[k].items()], FILES
        )
    compared = fo.compare_paths(table(0), table(1))
    exact = fo.match_exact(compared).select(*fo.PAIR, "path", "new.names")
    renamed = match_renamed(
        fo.leftovers(compared, "old"), fo.leftovers(compared, "new"), exact, exact_first, tie_self, group_rows
    )
    got = sorted((r.repository_name, r.prev_path, r.path) for r in renamed.collect())
    want = sorted((f"r{g}", a, b) for g, (o, n) in enumerate(groups) for a, b in expected_renames(o, n, exact_first, tie_self))
    assert want and got == want
    if exact_first:
        lone = fo.unmatched(compared, renamed).count()
        assert lone == sum(len(o) + len(n) - 2 * len(set(o) & set(n)) for o, n in groups) - 2 * len(want)


def test_a_large_clique_takes_few_rounds(spark, monkeypatch):
    """Many interchangeable files of one release pair are matched together."""
    from sedimenta.operators import renames

    rounds = []
    one_round = renames._round
    monkeypatch.setattr(renames, "_round", lambda *a: rounds.append(1) or one_round(*a))
    pair = ("r", "v1", "v2")
    old = [(*pair, f"old/p{i:05d}/__init__.py", []) for i in range(3000)] + [(*pair, "old/x.py", ["f", "g"])]
    new = [(*pair, f"new/p{i:05d}/__init__.py", []) for i in range(2500)]
    old_df, new_df = spark.createDataFrame(old, FILES), spark.createDataFrame(new, FILES)
    found = match_renamed(old_df, new_df, group_rows=10).collect()
    assert sorted((r.prev_path, r.path) for r in found) == [(old[i][3], new[i][3]) for i in range(2500)]
    assert len(rounds) == 1


def test_rank_within(spark):
    rows = [(g, f"{draw:04d}") for g in (0, 1) for draw in range(700 if g else 3)]
    ranked = rank_within(spark.createDataFrame(rows, "g int, v string"), ["g"], "v", "place").collect()
    assert sorted((r.g, r.v, r.place) for r in ranked) == [(g, v, int(v) + 1) for g, v in rows]


def test_names_of_equal_length_lists(spark):
    df = spark.createDataFrame([(["a"], ["b"])], "o array<string>, n array<string>")
    assert df.select(shared_method_ratio(F.col("o"), F.col("n"))).collect()[0][0] == 0.0


def test_assign_with_no_pairs(spark):
    edges = spark.createDataFrame([], "repository_name string, prev_branch string, branch string, old_class string, new_class string")
    files = spark.createDataFrame([("r", "a", "b", "x.py", "c")], "repository_name string, prev_branch string, branch string, path string, old_class string")
    assert assign(edges, files, files.withColumnRenamed("old_class", "new_class")).collect() == []


def test_few_files_meet_without_a_row_per_mark(spark, monkeypatch):
    """As by marks alone, from about as many rows as there are files and topics."""
    rng = random.Random(5)
    names = ["".join(rng.choices("abcd_", k=14)) + ".py" for _ in range(6)]

    def side(top):
        files = [("r", "1", "2", f"{top}{i}/{rng.choice(names)[rng.randrange(2):]}", rng.choices("xyz", k=2)) for i in range(20)]
        return spark.createDataFrame(files, "repository_name string, prev_branch string, branch string, path string, names array<string>")

    old, new, rows = side("a"), side("b"), {}
    staged = renames.stage

    def counted(df, label):
        done = staged(df, label)
        rows[label] = max(rows.get(label, 0), done.count())
        return done

    monkeypatch.setattr(renames, "stage", counted)
    direct = {tuple(r) for r in match_renamed(old, new).collect()}
    assert rows["topics"] <= 4 * 20 and rows["dense"] == 0
    monkeypatch.setattr(renames, "_DIRECT", 0)
    assert {tuple(r) for r in match_renamed(old, new).collect()} == direct and direct
    assert rows["dense"] > 0
