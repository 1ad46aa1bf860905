"""The Merkle manifest against a plain recursive statement."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import manifest as m

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, lo bigint, size int, level int, kids string, steps string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def grown(nodes):
    """Root, and the siblings before and behind of each node, level by level."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[at : at + 3] for at in range(0, len(nodes), 3)]
    root, above = grown([sha("".join(run)) for run in runs])
    ways = [("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))]
    return root, [[way, *above[at // 3]] for at, way in enumerate(ways)]


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        order = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r))))
        trees[name] = order, *grown([leaf(r) for r in order])
    root, outer = grown([trees[name][1] for name in names])
    for name, above in zip(names, outer):
        order, subroot, ways = trees[name]
        for row, way in zip(order, ways):
            steps = way + above
            yield row[0], leaf(row), subroot, root, "".join(a + b for a, b in steps), steps


def built(spark, rows, **more):
    docs = spark.createDataFrame([(*row, "t", 5, 6, 7, "k", "s") for row in rows], SCHEMA)
    found = m.manifest(docs, **more)
    return found.select("id", "leaf", "subroot", "root", m.proof_text().alias("proof"), m.folded_root().alias("folded"))


@pytest.mark.parametrize("seed", range(2))
def test_against_the_rule(spark, seed):
    draw = random.Random(seed)
    rows = [(k, draw.choice(["hot", "hot", "a", "ä", "", None]), draw.choice(["x", None]), draw.choice([None, k]), f"text {k}\nß") for k in range(700)]
    rows += [(None, "a", None, None, None), (3, "hot", "x", 1, "other"), (3, "hot", "x", 1, "other"), (9999, "lone", "x", 0, "long " * 50_000)]
    got = sorted(map(tuple, built(spark, rows).collect()), key=str)
    want = sorted([(*r[:5], r[3]) for r in plain(rows)], key=str)
    assert got == want


def test_small_and_empty(spark):
    (only,) = built(spark, [(1, "s", None, None, None)]).collect()
    assert only.leaf == only.subroot == only.root == only.folded and only.proof == ""
    assert built(spark, []).collect() == []


def test_tampering_is_seen(spark):
    rows = [(k, "s" if k % 3 else None, "x", k, None if k == 5 else f"a\nb{k}" if k % 2 else f"c{k}") for k in range(60)]
    docs = spark.createDataFrame([(*row, "t", 5, 6, 7, "k", "s") for row in rows], SCHEMA)
    found = m.manifest(docs, claimed={"text": F.regexp_replace("text", "\n", "")})
    wrong = {r.id for r in found.where(m.folded_root() != F.col("root")).collect()}
    assert wrong == {k for k in range(60) if k % 2 and k != 5}


def test_interval_labels(spark):
    """Each node covers what its children cover, one after the other, without a gap."""
    leaves = spark.range(1000).select(F.lit("t").alias("tree"), F.col("id").alias("lo"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    leaves, tallest = m.sized(leaves)
    nodes = [row for band in m.intervals(leaves, tallest) for row in band.collect()]
    assert tallest == 7 and len(nodes) == 334 + 112 + 38 + 13 + 5 + 2 + 1
    for node in nodes:
        borders = [node.lo, *(kid.hi for kid in node.kids)]
        assert [kid.lo for kid in node.kids] == borders[:-1] and borders[-1] == node.hi
        assert node.bucket == node.lo // 3**node.level
