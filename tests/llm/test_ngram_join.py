"""The n-gram join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from sedimenta.llm import ngram_join as m

SCHEMA = "doc_id bigint, text string, id int, content string, n int, key string, tree string, leaf int, component int, rep int, body string"
CLASHES = (7, "c", 1, "k", "t", 1, 2, 3, "b")


def grams(text, width=5):
    lowered = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows):
    sets = [grams(text) for _, text in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label = [label[a] if x == label[b] else x for x in label]
    names = {x: min((i for (i, _), y in zip(rows, label) if y == x and i is not None), default=None) for x in label}
    return sorted(((i, len(s), None if i is None else names[x]) for (i, _), s, x in zip(rows, sets, label)), key=str)


def joined(spark, rows):
    docs = spark.createDataFrame([(*row, *CLASHES) for row in rows], SCHEMA)
    return sorted(map(tuple, m.ngram_join(docs).collect()), key=str)


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
    return " ".join(words)


def families(draw):
    """Near copies on both sides of the limit, all with one common passage."""
    passage = [f"p{k}" for k in range(30)]
    for family in range(6):
        base = [f"f{family}x{draw.randrange(10**6)}" for _ in range(draw.choice([12, 60, 200]))] + passage
        for _ in range(12):
            yield edited(draw, base, draw.randrange(6))


def test_against_brute_force(spark):
    draw = random.Random(3)
    texts = [*families(draw), None, "", " \n\t", "Few words", "few WORDS", "few words\n", "lone", "x" * 9000, "long " * 20_000, "long " * 20_000]
    rows = list(enumerate(texts)) + [(None, "few words"), (None, None), (3, texts[3]), (3, texts[50])]
    assert joined(spark, rows) == brute(rows)


def test_many_components_under_one_branch(spark, monkeypatch):
    """Sets that drift: neighbours are alike, ends are not, so centres join few of them
    and the others meet through trees of several levels."""
    monkeypatch.setattr(m, "LEAF", 4)
    monkeypatch.setattr(m, "FAN", 2)
    text = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(text[3 * k : 3 * k + 60])) for k in range(80)]
    draw = random.Random(5)
    rows += [(1000 + k, edited(draw, text[:60], 3)) for k in range(60)]
    assert joined(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert joined(spark, []) == []


@pytest.mark.parametrize("sizes", [(30, 30), (300, 310), (3000, 2500)])
def test_minima_never_underestimate(sizes):
    draw = np.random.default_rng(1)
    shared = draw.integers(0, 2**64, min(sizes) // 2, dtype=np.uint64)
    one, two = (np.unique(np.concatenate([shared, draw.integers(0, 2**64, n - len(shared), dtype=np.uint64)])) for n in sizes)
    groups = min(len(m.point(x)) for x in (one, two))
    bound = np.minimum(m.coarse(m.point(one), groups), m.coarse(m.point(two), groups)).sum()
    assert len(shared) <= bound < len(shared) * 1.6
    assert m.coarse(m.point(one), m.LEAST_GROUPS).sum() == len(one)


def test_counts_too_large_bound_nothing():
    same = np.full(1 << 8, 64, dtype=np.uint64)
    assert m.point(same) == b"" and m.coarse(b"", 64).min() > 1 << 30


def test_hashes_of_a_batch_are_those_of_each_text():
    texts = ["a b c d", "", "a b", "a b c d e f", " \n", "A B C D E f", "b c d e f g h"]
    together, alone = m.gram_hashes(texts, 5), [m.gram_hashes([x], 5)[0] for x in texts]
    assert [x.tolist() for x in together] == [x.tolist() for x in alone]
    assert [len(x) for x in together] == [1, 0, 1, 2, 0, 2, 3]
    assert together[3].tolist() == together[5].tolist() and together[3][1] == together[6][0]
    assert len({int(h) for x in together for h in x}) == 6
