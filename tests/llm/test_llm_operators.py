"""Operators for training text against plain statements of their rules."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sedimenta.llm import decontaminate, lines, near, pages, pieces, quality, sharding, substrings, tokens
from sedimenta.llm.components import components
from sedimenta.llm.exact import exact_duplicates

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
BASE = " ".join(f"w{i}x{i * 7 % 31}" for i in range(90))

#: Nulls, empty and blank texts, copies, near copies, a long text, a repeated row, and
#: columns with names that operators use inside.
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, BASE),
    (5, BASE),
    (6, BASE + " more"),
    (7, BASE.replace("w40x", "v40x")),
    (8, "a line of its own\n" + BASE),
    (8, "a line of its own\n" + BASE),
    (None, BASE),
    (None, None),
    (9, "long " * 20_000),
    (10, "x" * 30_000),
    (11, "ÀÉ 中文 🤖 ▁ \0 end."),
    (12, "Short."),
]
CLASHES = "doc_id bigint, text string, id string, body string, content string, n int, `row` int, rep int, packed int, key int, line int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text, "a", None, "c", k, k, 0, 0, 0, None) for k, (i, text) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, CLASHES)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHES)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_token_prefixes(docs, empty):
    rows = tokens.token_prefixes(docs, MODEL).withColumns(
        {"total": tokens.token_count(F.col("prefix_tokens")), "half": tokens.tokens_of_prefix(F.col("prefix_tokens"), 10), "fit": tokens.characters_within(F.col("prefix_tokens"), 7)}
    ).collect()
    assert len(rows) == len(TEXTS)
    want = Counter((i, len((t or "").encode()), len(LIBRARY.encode(t or "")), len(LIBRARY.encode((t or "")[:10]))) for i, t in TEXTS)
    assert Counter((r.id, r.n_bytes, r.total, r.half) for r in rows) == want
    text = TEXTS[3][1]
    row = next(r for r in rows if r.id == 4)
    assert list(row.prefix_tokens) == [len(LIBRARY.encode(text[:k])) for k in range(len(text) + 1)]
    assert row.fit == max(k for k in range(len(text) + 1) if len(LIBRARY.encode(text[:k])) <= 7)
    assert tokens.token_prefixes(empty, MODEL).count() == 0


def test_prefixes_of_random_texts():
    counter, rng = tokens.PrefixCounter(MODEL), random.Random(5)
    letters = list("aabtheroining  \n\t.,19") + ["▁", "é", "🤖", "中", "①", "\0", "<s>", "²"]
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert counter.prefixes(text).tolist() == [len(LIBRARY.encode(text[:k])) for k in range(len(text) + 1)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates(docs, empty, keep):
    groups = {}
    for i, text in TEXTS:
        groups.setdefault(text or "", []).append(i)
    best = {t: {"smallest": min, "largest": max}[keep]((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter(
        (i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in TEXTS
    )
    rows = exact_duplicates(docs, keep=keep).collect()
    assert Counter((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == want
    assert exact_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2060)]
    links += [(None, 5), (7, 7)]
    label = {}
    for a, b in links:
        if a is not None and a != b:
            label.setdefault(a, {a}), label.setdefault(b, {b})
            if label[a] is not label[b]:
                merged = label[a] | label[b]
                for x in merged:
                    label[x] = merged
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: min(s) for x, s in label.items()}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_near(rows, width, per_cent=80):
    sets = [near.shingles(t or "", width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(range(len(rows)), 2):
        common = len(sets[x] & sets[y])
        if common and 100 * common >= per_cent * (len(sets[x]) + len(sets[y]) - common):
            root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[find(x)] = min(i, least.get(find(x), i))
    return Counter((i, len(sets[x]), least[find(x)], i == least[find(x)]) for x, (i, _) in enumerate(rows))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, docs, empty, width):
    rng = random.Random(width)
    rows = []
    for base in range(6):
        text = [f"{base}t{rng.randrange(500)}" for _ in range(120)]
        for copy in range(25):  # chains: some edits too many for the first, not for others
            changed = list(text)
            for _ in range(rng.randrange(14)):
                changed[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
            rows.append((1000 * base + copy, " ".join(changed)))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width).collect()
    assert Counter((r.id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(rows, width)

    got = near.near_duplicates(docs, width).collect()
    named = [(i, t) for i, t in TEXTS if i is not None]
    assert Counter((r.id, r.n_shingles, r.component_id, r.kept) for r in got if r.id is not None) == brute_near(named, width)
    assert {(r.component_id, r.kept) for r in got if r.id is None} == {(None, True)}
    assert near.near_duplicates(empty, width).count() == 0
    left = near.without_near_duplicates(docs, width)
    assert left.columns == docs.columns and Counter(r.doc_id for r in left.collect())[None] == 2


def test_pruning_keeps_similar_pairs():
    least, rng = near.least_matches(0.8, 1e-6), np.random.default_rng(1)
    matches = rng.random((20_000, near.HASHES)) < 0.8
    left = np.zeros(matches.shape, dtype=np.uint32)
    assert len(near.surviving(left, (~matches).astype(np.uint32), least)) >= 19_998
    rare = rng.random((2_000, near.HASHES)) < 0.4
    assert len(near.surviving(left[:2_000], (~rare).astype(np.uint32), least)) == 0


def test_shards(spark, docs, empty):
    rows = sharding.shards(docs, 4).toPandas()
    assert sorted(rows["size"]) == sorted(len((t or "").encode()) + 1 for _, t in TEXTS)
    for _, shard in rows.groupby("shard"):
        assert sorted(shard["slot"]) == list(range(len(shard)))
    assert sharding.shards(empty).count() == 0

    rng = random.Random(4)
    texts = [f"{k} " + "word " * rng.randrange(1, 300) for k in range(1200)]
    copies = [(k, texts[k % 1200] if k % 3 else "hot " * 60) for k in range(3000)]  # a third in one group
    rows = sharding.shards(spark.createDataFrame(copies, "doc_id bigint, text string"), 8).toPandas()
    by_shard = rows.groupby("shard")["size"].sum()
    assert len(by_shard) == 8 and by_shard.max() <= 1.02 * by_shard.min()
    counts = rows.groupby("shard").size()
    assert counts.max() <= 1.05 * counts.min()
    shard_of = dict(zip(rows["id"], rows["shard"]))
    for k in range(1, 1200):
        group = {shard_of[x] for x in (k, k + 1200, k + 2400) if x < 3000 and x % 3}
        assert len(group) <= 1


def test_quality(spark, docs, empty):
    rng = random.Random(9)
    good = lambda: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 80))) + "."
    bad = lambda: " ".join(w.upper() + "!!" for w in good().split())
    rows = [(k, bad() if k % 6 == 0 else good(), 0 if k % 6 == 0 else 1) for k in range(3000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    labels = table.where("doc_id % 2 = 0").select("doc_id", "quality")
    model = quality.train(table.select("doc_id", "text"), labels)
    assert 0.75 <= model.prior <= 0.9
    got = quality.quality_scores(table.select("doc_id", "text"), model).join(table.withColumnRenamed("doc_id", "id"), "id").toPandas()
    import zlib

    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["id"]]).all()
    held = got[got["held_out"]]
    assert ((held["score"] >= 0.7) == (held["quality"] == 1)).mean() > 0.98
    rows = quality.quality_scores(docs, model, with_row=True).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert Counter(r.row.n for r in rows) == Counter(range(len(TEXTS)))
    nothing = quality.train(empty, labels.where("false"))
    assert quality.quality_scores(empty, nothing).count() == 0


def brute_contamination(text, items, width=10):
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    have, hit, owners = re.findall(pattern, lower(text)), set(), set()
    for name, item in items:
        wanted = re.findall(pattern, lower(item))
        for at in range(max(1, len(wanted) - width + 1) if wanted else 0):
            window = wanted[at : at + width]
            for place in range(len(have) - len(window) + 1):
                if have[place : place + len(window)] == window:
                    hit |= set(range(place, place + len(window)))
                    owners.add(str(name))
    return len(have), len(hit), sorted(owners)


@pytest.mark.parametrize("block_bytes", [64 << 20, 100])
def test_contamination(spark, docs, empty, block_bytes):
    rng = random.Random(1)
    vocabulary = ["the", "The", "a-b", "é", "x1", "Ünï", "of"]
    phrase = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!\n"]) for _ in range(n))
    items = [(k, phrase(rng.choice([3, 9, 10, 14]))) for k in range(20)] + [(100, None), (101, "..."), (None, "only these six words are here"), (5, "twice")]
    texts = [(500 + k, phrase(60) + " " + (rng.choice(items)[1] or "").upper()) for k in range(40)] + TEXTS
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontaminate.contamination(spark.createDataFrame(texts, "doc_id bigint, text string"), bench, block_bytes=block_bytes).collect()
    named = [("" if name is None else name, text) for name, text in items]
    want = Counter((i, *map(str, brute_contamination(t, named))) for i, t in texts)
    assert Counter((r.id, str(r.n_words), str(sum(s.end - s.first for s in r.spans)), str(list(r["items"]))) for r in got) == want
    for row, text in ((r, t) for r in got for i, t in texts if i == r.id and r.spans):
        for span in row.spans:
            inside = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text[span.begin : span.stop]))
            assert len(inside) == span.end - span.first
    rows = decontaminate.contamination(docs, bench, with_row=True, block_bytes=block_bytes).select("row.*")
    assert rows.columns == docs.columns and rows.count() == len(TEXTS)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).where("size(spans) > 0").count() == 0


def brute_lines(rows):
    places = [(i, k, x.strip(lines.BLANK)) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    places = [p for p in places if p[2]]
    keys = sorted({p[2] for p in places})
    size = lines.SHINGLE
    sets = [{x[at : at + size] for at in range(max(1, len(x) - size + 1))} for x in keys]
    root = {x: x for x in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(keys)), 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= lines.PER_CENT * (len(sets[a]) + len(sets[b]) - common):
            root[find(keys[a])] = find(keys[b])
    first = {}
    for i, k, x in places:
        first[find(x)] = min(first.get(find(x), (i, k)), (i, k))
    return Counter((i, k, *first[find(x)]) for i, k, x in places)


def test_duplicate_lines(spark, docs, empty):
    rng = random.Random(8)
    base = [" ".join(f"{rng.randrange(10**5)}" for _ in range(rng.choice([1, 4, 12, 25]))) for _ in range(40)]
    rows = []
    for k in range(60):
        own = []
        for _ in range(6):
            line = rng.choice(base)
            if rng.random() < 0.5 and len(line) > 80:  # small edits keep well above the threshold
                at = rng.randrange(len(line))
                line = line[:at] + "#" + line[at + 1 :]
            own.append(rng.choice(["", "  "]) + line + rng.choice(["", "\r"]))
        rows.append((k, "\n".join(own)))
    got = lines.duplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.id, r.line_no, r.keep_id, r.keep_line_no) for r in got) == brute_lines(rows)
    assert all(r.kept == ((r.id, r.line_no) == (r.keep_id, r.keep_line_no)) for r in got)

    assert lines.duplicate_lines(docs).count() == sum(bool(x.strip(lines.BLANK)) for _, t in TEXTS for x in (t or "").split("\n"))
    left = lines.without_duplicate_lines(docs)
    assert left.columns == docs.columns
    kept = {r.doc_id: r.text for r in left.collect()}
    assert kept[2] == "" and kept[3] == " \n\t " and kept[12] == "Short." and 5 not in kept
    assert lines.duplicate_lines(empty).count() == 0 and lines.without_duplicate_lines(empty).count() == 0


def test_short_prose_lines_become_candidates(spark):
    """Prose lines of 30 to 80 characters, edited down to a similarity of just 0.8 or more."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 10))) for _ in range(400)]

    def sets(line):
        return {line[at : at + lines.SHINGLE] for at in range(max(1, len(line) - lines.SHINGLE + 1))}

    pairs = []
    while len(pairs) < 1000:
        a = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 12)))
        at = rng.choice([0, len(a), rng.randrange(len(a))])
        b = a[:at] + rng.choice(["", rng.choice(vocabulary), "x"]) + a[at + rng.randrange(4) :]
        x, y = sets(a), sets(b)
        if 30 <= len(a) <= 80 and a != b and 80 <= 100 * len(x & y) / len(x | y) < 88:
            pairs.append((a, b))
    signed = [lines.signatures(spark.createDataFrame([(p[k],) for p in pairs], "line string")).select("bands").collect() for k in (0, 1)]
    found = sum(any(u == v for u, v in zip(one.bands, two.bands)) for one, two in zip(*signed))
    assert found >= 995


def brute_spans(rows, width):
    lists = [words(t) for _, t in rows]
    seen = Counter(tuple(x[at : at + width]) for x in lists for at in range(len(x) - width + 1))
    out = Counter()
    for (i, _), x in zip(rows, lists):
        gone = set()
        for at in range(len(x) - width + 1):
            if seen[tuple(x[at : at + width])] > 1:
                gone |= set(range(at, at + width))
        out[i, len(x), len(gone), " ".join(w for k, w in enumerate(x) if k not in gone)] += 1
    return out


@pytest.mark.parametrize("width", [35, 12, 3])
def test_repeated_spans(spark, docs, empty, width):
    rng = random.Random(width)
    parts = [[f"p{k}w{rng.randrange(9)}" for _ in range(rng.choice([5, 20, 60]))] for k in range(12)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(rng.randrange(5)):
            part = rng.choice(parts)
            a = rng.randrange(len(part))
            text += part[a:] if rng.random() < 0.4 else part
            text += [f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(20))]
        rows.append((k, " ".join(text)))
    rows += [(100, "again " * 50), (101, " ".join(parts[0] * 3))]
    for table, want in ((spark.createDataFrame(rows, "doc_id bigint, text string"), rows), (docs, TEXTS)):
        got = substrings.repeated_spans(table, width).collect()
        assert Counter((r.id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_spans(want, width)
    assert substrings.repeated_spans(empty, width).count() == 0


def test_pieces(spark, docs, empty):
    rng = random.Random(3)
    letters = list("aabtheroining  \n\t.,19") + ["é", "🤖", "中", "①", "\0", "文", "²"]
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for k in range(200)]
    rows += [(1000, "a" * 200), (1001, " " * 300), (1002, "the" * 80), (1003, "中文" * 100), (1004, "x" * 61)]
    for table, want in ((spark.createDataFrame(rows, "doc_id bigint, text string"), rows), (docs, TEXTS)):
        got = pieces.decode(pieces.encode(table, MODEL), MODEL).collect()
        assert Counter((r.id, tuple(r.ids)) for r in got) == Counter((i, tuple(LIBRARY.encode(t or ""))) for i, t in want)
        assert Counter((r.id, r.text) for r in got) == Counter((i, (t or "").replace("▁", " ")) for i, t in want)
    assert pieces.encode(empty, MODEL).count() == 0


def test_pieces_over_many_bundles_regions_and_blobs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pieces, "BUNDLE_BYTES", 500)
    monkeypatch.setattr(pieces, "REGION_BYTES", 3000)
    monkeypatch.setattr(pieces, "BLOB_WORDS", 7)
    rng = random.Random(9)
    known = ["".join(rng.choice("abehinorst") for _ in range(rng.randint(1, 12))) for _ in range(150)]
    rows = [(k, " ".join(rng.choices(known, k=rng.randint(0, 40)))) for k in range(120)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    got = pieces.encode(spark.read.parquet(f"{tmp_path}/docs"), MODEL).collect()
    assert {r.id: list(r.ids) for r in got} == {i: LIBRARY.encode(t) for i, t in rows} and len(got) == len(rows)


def test_viterbi_fold(spark):
    vocabulary, rng = pieces.Vocabulary(MODEL), random.Random(6)
    found = sorted({"▁" + "".join(rng.choice("therain中🤖") for _ in range(rng.randint(1, 25))) for _ in range(200)})
    table = spark.createDataFrame([(len(x) % 3, x, [1]) for x in found], "slot bigint, word string, bundles array<int>")
    worst = min(vocabulary.scores.values()) - pieces.UNKNOWN_PENALTY
    known = pieces.encoded_words(table, pieces.piece_table(spark, vocabulary), pieces.reach_table(spark, vocabulary), worst, False)
    rows = known.collect()
    assert all(r.bundles == [1] for r in rows)
    assert {r.word: vocabulary.expanded(r.ids) for r in rows} == {x: pieces.viterbi(x, vocabulary) for x in found}


def test_main_text(spark, empty):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><a href=/>Home</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
    <div class="cookie-notice">We use cookies, and more cookies, for your comfort.</div><!-- <p>no</p> -->
    <main><article><h1>Head &amp; line</h1><p><b>First,  part.<br>Second part.<p>Third <i>p</i>art; with more words, and still more of them.</p>
    <form>Name <input></form><aside>Read also this.</aside><p>Be.</p></article>
    <section id="comments"><p>I think, dear author, that this is a long comment, longer than the article itself, is it not? Yes.</p></section></main>
    <div class=sidebar><p>Other stories, many of them.</p></div><footer>&copy; Us</footer></body></html>"""
    want = "Head & line First, part. Second part. Third part; with more words, and still more of them. Be."
    assert pages.main_text(page) == want
    plain = "<html><body><div><a href=x>Menu</a></div><div><p>One, two.</p><p>Three, four, five; six words more.</p></div></body>"
    assert pages.main_text(plain) == "One, two. Three, four, five; six words more."
    rows = [(1, "u", page), (2, None, None), (None, "u", ""), (3, "u", "<p>cut off <b>her"), (4, "u", "<nav>x</nav>"), (5, "u", "a &lt b"), (6, "u", "<" * 5000)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = {r.id: (r.url, r.text) for r in pages.main_texts(table).collect()}
    assert got[1] == ("u", want) and got[2] == (None, "") and got[None] == ("u", "") and got[3][1] == "cut off her" and got[4][1] == ""
    assert got[5][1] == "a < b"
    assert pages.main_texts(table.where("false")).count() == 0


PROSE, MORE = ("Long prose, with words and more words. " * 20).strip(), ("Other prose, of this page. " * 15).strip()


def test_main_text_keeps_headings_and_short_paragraphs():
    inner = f'<body><article><h1>Title</h1><p>A lead.</p><div class="content"><p>{PROSE}</p><p>{MORE}</p></div><p>An end.</p></article></body>'
    assert pages.main_text(inner) == f"Title A lead. {PROSE} {MORE} An end."
    one = "Words, of it. " * 220
    assert pages.main_text(f"<body><div><h1>Head</h1><p>{one}</p><p>A short end.</p></div></body>") == f"Head {one}A short end."


@pytest.mark.parametrize("name", ["layout has-sidebar", "sticky-header", "elementor-widget", "long-form", "related-layout"])
def test_main_text_in_wrappers_named_as_surroundings(name):
    side = '<div class="sidebar"><p>Other stories, of us.</p></div>'
    for tag in ("article", "div"):
        page = f'<body><div class="{name}"><{tag}><h1>Title</h1><p>{PROSE}</p><p>{MORE}</p></{tag}></div>{side}</body>'
        assert pages.main_text(page) == f"Title {PROSE} {MORE}"
    within = f'<body><article><h1>Title</h1><div class="{name}"><p>{PROSE}</p><p>{MORE}</p></div></article>{side}</body>'
    assert pages.main_text(within) == f"Title {PROSE} {MORE}"
    header = f'<article><div class="entry-header"><h1>Title</h1></div><p>{PROSE}</p></article>'
    assert pages.main_text(header) == f"Title {PROSE}"
    each = "".join(f'<div class="{name}">{x}</div>' for x in ("<h1>Title</h1>", f"<p>{PROSE}</p>", f"<p>{MORE}</p>"))
    for tag in ("article", "div"):
        assert pages.main_text(f"<body><{tag}>{each}</{tag}></body>") == f"Title {PROSE} {MORE}"
    thread = f'<main><article><h1>Title</h1><p>Short text, here.</p></article><section id="comments"><p>{PROSE}</p></section></main>'
    assert pages.main_text(thread) == "Title Short text, here."


@pytest.mark.parametrize(
    "part",
    ['<h2 id="related-work">Words, here.</h2>', '<section id="discussion-form"><p>Words, here.</p></section>', '<p class="social-science">Words, here.</p>',
     '<p class="notice-board-history">Words, here.</p>', "<p>Words, <math><mi>here</mi></math>.</p>"],
)
def test_main_text_keeps_parts_that_only_sound_like_surroundings(part):
    page = f'<body><nav><a href="/">Home</a></nav><article><h1>Title</h1><p>{PROSE}</p>{part}<p>{MORE}</p></article><p class="ad">Buy, now.</p></body>'
    assert pages.main_text(page) == f"Title {PROSE} Words, here. {MORE}"


def test_main_text_is_linear_in_depth():
    began = time.process_time()
    assert pages.main_text('<div class="ad">x, y ' * 20_000) and pages.main_text("<b><p>x</i></em> " * 20_000)
    assert time.process_time() - began < 5


def test_near_copies_of_rows_that_repeat_an_id(spark):
    """Classes go by content: every text is compared by its own words."""
    one, two = (" ".join(f"{x}{i}" for i in range(90)) for x in "ab")
    rows = [(1, one), (1, two), (2, one.replace("a40", "c40")), (3, two.replace("b40", "c40")), (7, "x y z"), (7, "p q r"), (9, "p q r s")]
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted((r.id, r.n_shingles, r.component_id) for r in found.collect())
    assert got == [(1, 86, 1), (1, 86, 1), (2, 86, 1), (3, 86, 1), (7, 1, 7), (7, 1, 7), (9, 1, 9)]


def test_families_of_unlike_lines_make_no_pairs(spark):
    """op7: members of one bucket that cannot be similar made rows with the square of its size."""
    rng = random.Random(17)

    def prose(n):
        return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))

    common, other = prose(30), prose(6)
    family = [f"{common} {prose(8)} {other if k % 2 else ''}{prose(8)}" for k in range(80)]
    rows = [(1, k.to_bytes(4, "big"), line) for k, line in enumerate(family)]
    texts = spark.createDataFrame(rows, "key bigint, content binary, line string")
    sketches = lines.sketched(texts.select("content", "line"), "content")
    label = spark.createDataFrame([], "node binary, component binary")
    assert lines.open_pairs(texts.select("key", "content"), label, sketches).count() == 0


def test_sketches_lose_no_similar_pair(spark):
    """Lines of all lengths, repeated shingles included: what sketches rule out is not similar."""
    rng = random.Random(18)
    pairs = []
    for k in range(600):
        one = "".join(rng.choice("ab" if k % 3 else "abcdefgh 日") for _ in range(rng.choice([1, 7, 9, 40, 300, 2500])))
        two = list(one * rng.choice([1, 1, 2]))
        for _ in range(rng.randint(0, 1 + len(two) // 60)):
            two[rng.randrange(len(two))] = rng.choice("abxyz")
        pairs.append((k, one, "".join(two)))
    table = spark.createDataFrame(pairs, "number bigint, one string, two string")
    sides = [lines.sketched(table.select("number", F.col(c).alias("line")), "number").toDF("number", f"places_{x}", f"sketch_{x}") for c, x in (("one", "a"), ("two", "b"))]
    open_ = {r.number for r in sides[0].join(sides[1], "number").where(lines.may_be_similar()).collect()}

    def sets(line):
        return {line[at : at + lines.SHINGLE] for at in range(max(1, len(line) - lines.SHINGLE + 1))}

    similar = {k for k, one, two in pairs if 100 * len(sets(one) & sets(two)) >= 80 * len(sets(one) | sets(two))}
    assert similar <= open_ and 100 < len(similar) and len(open_) < 600
    texts = spark.createDataFrame([(f"{k}{x}".encode(), t) for k, one, two in pairs for x, t in (("a", one), ("b", two))], "content binary, line string")
    named = spark.createDataFrame([(f"{k}a".encode(), f"{k}b".encode()) for k, _, _ in pairs], "a binary, b binary")
    assert {int(r.a[:-1]) for r in lines.linked(named, texts).collect()} == similar


def test_encoding_and_decoding_in_one_pass(spark, docs, empty):
    """op9: the pass that decodes gives what decode gives, by one process for each task."""
    coded = pieces.encode(docs, MODEL, decoded=True)
    want = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    assert coded.columns == want.columns
    assert Counter(map(repr, coded.collect())) == Counter(map(repr, want.collect()))
    assert pieces.encode(empty, MODEL, decoded=True).count() == 0
    whole = [len(re.findall("MapInArrow", df._jdf.queryExecution().optimizedPlan().toString())) for df in (coded, want)]
    assert whole[1] - whole[0] == 1


def test_large_buckets_of_lines_meet_in_few_rows(spark):
    """op7, pipeline: a pair made a row for each band that it shares, runs of one word left
    pairs open that have little in common, and members met without a bound."""
    rng = random.Random(21)

    def prose(n):
        return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))

    passage = prose(40)
    runs = [f"{passage} {prose(12)} " + f"{prose(1)} " * 120 for _ in range(12)]
    base = prose(60)
    near = [base[:at] + "#" + base[at + 1 :] for at in range(20, 260, 6)]
    rows = [(k, line) for k, line in enumerate(runs + near)]
    texts = spark.createDataFrame(rows, "content bigint, line string").localCheckpoint()
    found = lines.sketched(texts, "content").join(lines.signed(texts, "content"), "content")
    known = lines.counted(found.join(texts.select("content", F.encode("line", "UTF-16BE").alias("units")), "content")).localCheckpoint()
    sets = [{x[at : at + lines.SHINGLE] for at in range(len(x) - lines.SHINGLE + 1)} for _, x in rows]
    assert all(r.places == len(sets[r.content]) for r in known.collect() if r.content < len(runs))

    bands = known.select("content", F.explode("bands").alias("key"))
    members = lines.neighbours(bands).localCheckpoint()
    shared = bands.groupBy("key").count().where("count > 1").agg(F.sum("count")).first()[0]
    assert members.count() == shared
    assert members.select(F.explode("met")).count() <= (lines.NEXT + 1) * shared
    nobody = spark.createDataFrame([], "node bigint, component bigint")
    pairs = [tuple(r) for r in lines.open_pairs(members, nobody, known.drop("units")).collect()]
    assert len(pairs) == len(set(pairs)) and all(a >= len(runs) for a, _ in pairs)
    plain = [tuple(r) for r in lines.open_pairs(members, nobody, known.drop("units", "bands")).collect()]
    assert set(plain) == set(pairs)
    similar = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in lines.linked(spark.createDataFrame(pairs, "a bigint, b bigint"), known).collect()} == similar


def test_lines_without_a_candidate_are_dealt_once(spark, monkeypatch):
    plans, real = {}, lines.stage

    def staged(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, label)

    monkeypatch.setattr(lines, "stage", staged)
    one = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, one + "\nalone and never met by another line"), (2, one + "x")], "doc_id bigint, text string")
    assert {(r.id, r.line_no): r.kept for r in lines.duplicate_lines(docs).collect()} == {(1, 0): True, (1, 1): True, (2, 0): False}
    scans = [row for row in plans["lines-known"].splitlines() if "lines-texts" in row]
    assert scans and not any("line:string" in row for row in scans)
