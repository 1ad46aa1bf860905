"""Tokenizer alignment against a plain statement on whole texts."""

import functools
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from sedimenta.llm import alignment as m

FIRST, SECOND = (Path(public_tokenizers.path(x)).read_bytes() for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TOOLS = m.Tokenizers(FIRST, SECOND)
SCHEMA = "doc_id bigint, text string, id int, body string, bundle int, content string, links int, groups string, file string, `row` int"
CLASHES = (7, "b", 1, "c", 2, "g", "f", 3)


def plain_groups(text):
    """Groups of one text, from the two libraries alone."""
    if not text:
        return []
    a, b = TOOLS.first.encode(" " + text, add_special_tokens=False).ids, TOOLS.second.encode(text)
    pieces_a, pieces_b = [TOOLS.bytes_a[i] for i in a], [TOOLS.bytes_b[i] for i in b]
    if b"".join(pieces_a) != (" " + text).encode() or b"".join(pieces_b) != (" " + text).encode():
        return []
    ends_a, ends_b = (np.cumsum([len(x) for x in each]).tolist() for each in (pieces_a, pieces_b))
    groups, at_a, at_b = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        next_a, next_b = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append((a[at_a:next_a], b[at_b:next_b]))
        at_a, at_b = next_a, next_b
    return groups


def plain(rows):
    texts = [plain_groups(text) for _, text in rows]
    totals = Counter((a[-1], b[-1]) for groups in texts for a, b in groups)
    highest = Counter()
    for (_, b), n in totals.items():
        highest[b] = max(highest[b], n)
    for (i, _), groups in zip(rows, texts):
        links = [(a[-1], b[-1]) for a, b in groups]
        n_best = sum(totals[x] == highest[x[1]] for x in links)
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        yield i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), n_best, sum(totals[x] for x in links), shown


def sample(draw, n):
    words = ["the", "über", "naïve", "日本語", "🤖🤖", "x1", "<|endoftext|>", "<s>", "don't", "  ", "\n", "\t\n", "\r\n", "\x1c", " ", "9999", "—", "Zürich,", "antidisestablishmentarianism", ".\r", "\n\n\n"]
    return "".join(draw.choice(words) + draw.choice([" ", " ", " ", "", "\n"]) for _ in range(n))


ROWS = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "a"), (6, "Hello  world \n"), (6, "Hello  world \n"), (None, "Hello"), (8, "▁ mark"),
    (9, "long " * 30_000), (9, "long " * 30_000), (10, "x" * 40_000), (11, " lead"), (12, "퟿\U0010ffff end\0"), (13, "trailing space "),
]


def test_against_the_libraries(spark):
    draw = random.Random(11)
    rows = ROWS + [(100 + k, sample(draw, draw.choice([1, 5, 40, 400]))) for k in range(60)]
    docs = spark.createDataFrame([(*row, *CLASHES) for row in rows], SCHEMA)
    found = sorted(map(tuple, m.aligned_tokens(docs, FIRST, SECOND, chunk=500).collect()), key=str)
    assert found == sorted(plain(rows), key=str)


def test_no_rows(spark):
    assert m.aligned_tokens(spark.createDataFrame([], SCHEMA), FIRST, SECOND).collect() == []


def same(one, two):
    return one.groups() == two.groups() and one.links.tolist() == two.links.tolist() and (one.n_a, one.n_b) == (two.n_a, two.n_b)


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_fragments_compose(size):
    """Any byte ranges, composed in any bracketing, give the groups of the whole text."""
    draw = random.Random(size)
    for _ in range(5):
        text = " " + sample(draw, 60)
        raw = len(text.encode())
        whole = m.fragment_of(text, 0, 0, raw, TOOLS)
        parts = [m.fragment_of(context, *place, TOOLS) for _, context, *place in m.chunks(text, TOOLS, size)]
        assert same(functools.reduce(m.Fragment.then, parts, m.Fragment()), whole)
        while len(parts) > 1:
            at = draw.randrange(len(parts) - 1)
            parts[at : at + 2] = [parts[at].then(parts[at + 1])]
        assert same(parts[0], whole)
        assert same(*TOOLS.wholes([text]), whole)
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in plain_groups(text[1:]))
        assert whole.groups().decode() == shown


def test_borders_change_no_token():
    draw = random.Random(2)
    for _ in range(50):
        text = " " + sample(draw, 40)
        whole = TOOLS.encoded(text)
        places = [0, *TOOLS.borders(text), len(text)]
        parts = [TOOLS.encoded(text[a:b]) for a, b in zip(places, places[1:])]
        assert whole is not None and all(np.concatenate([p[k] for p in parts]).tolist() == whole[k].tolist() for k in (0, 1))
