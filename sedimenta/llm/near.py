"""Near-duplicate documents: banded MinHash, Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import LOWER, UPPER, id_and_text, packed, slices, unpacked, unused
from .components import components

#: 32 bands of 4 hashes: a pair at similarity 0.8 shares no band once in 20 million.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes compared between two prunings, and documents in one block.
BATCH, BLOCK = 16, 256
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    return random.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1), random.integers(0, 2**64, HASHES, dtype=np.uint64)


def words_of(text: str) -> list[bytes]:
    """Lower-cases A-Z; ASCII white space ends a word."""
    return text.encode().translate(LOWERED).split()


def shingles(text: str, width: int) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    return set(zip(*(words[at:] for at in range(width)))) if len(words) >= width else {tuple(words)} if words else set()


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    from xxhash import xxh3_64_intdigest

    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    span = min(width, len(words))
    mixed = np.full(len(each) - span + 1, span, dtype=np.uint64)
    for at in range(span):
        mixed = (mixed ^ each[at : len(each) - span + 1 + at]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minhash(hashes: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(hashes), 1024):
        values = hashes[at : at + 1024, None] * scale
        values += shift
        values >>= np.uint64(32)
        low = np.minimum(low, values.min(axis=0).astype(np.uint32))
    return low


def least_matches(share: float, miss: float) -> np.ndarray:
    """For n = BATCH, 2 BATCH, ... compared hashes, the fewest matches with which a pair
    may still be similar: with a uniform prior, the posterior probability of a
    similarity of at least ``share`` given m of n matches is that of at most m
    successes in n + 1 trials; below ``miss`` the pair is given up."""
    least = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while m <= n and (total := total + comb(n + 1, m) * share**m * (1 - share) ** (n + 1 - m)) < miss:
            m += 1
        least.append(m)
    return np.array(least)


def surviving(left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Positions of pairs of signatures that no batch of hashes rules out."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
    for step, need in enumerate(least):
        part = slice(step * BATCH, (step + 1) * BATCH)
        matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
        keep = matches >= need
        alive, matches = alive[keep], matches[keep]
    return alive


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``id``, ``digest`` (of the text), ``n`` (set size), ``content`` (fingerprint of the
    set), ``signature``."""
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        scale, shift = _multipliers()
        for batch in slices(batches, "body"):
            sizes, contents, signs = [], [], []
            for text in batch.column("body").to_pylist():
                hashes = shingle_hashes(text, width)
                sizes.append(len(hashes))
                contents.append(xxh3_128_digest(hashes.tobytes()))
                signs.append(minhash(hashes, scale, shift).tobytes() if len(hashes) else b"")
            arrays = [pa.array(sizes, pa.int64()), pa.array(contents, pa.binary()), pa.array(signs, pa.binary())]
            kept = [batch.column("id"), batch.column("digest")]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], ["id", "digest", "n", "content", "signature"])

    return docs.mapInArrow(sign, f"id {kind}, digest binary, n bigint, content binary, signature binary")


def as_hashes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


def pruned(pairs: DataFrame, classes: DataFrame, least: np.ndarray, per_cent: int) -> DataFrame:
    """Candidate pairs (``a``, ``b``) that size and signatures allow to be similar."""
    sides = [classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}")) for x in "ab"]
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    both = pairs.join(sides[0], "a").join(sides[1], "b").where(small * 100 >= large * per_cent).select("a", "b", "s_a", "s_b")
    kind = pairs.schema["a"].dataType.simpleString()

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "s_a"):
            keep = pa.array(surviving(as_hashes(batch.column("s_a")), as_hashes(batch.column("s_b")), least))
            yield pa.RecordBatch.from_arrays([batch.column(x).take(keep) for x in "ab"], ["a", "b"])

    return both.mapInArrow(prune, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, texts: DataFrame, width: int, per_cent: int) -> DataFrame:
    """Pairs whose full shingle sets are similar enough, compared as words."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("packed").alias("t_a")), "a")
    both = both.join(texts.select(F.col("rep").alias("b"), F.col("packed").alias("t_b")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple[int, set]] = {}

        def known(side: str, key: int, blob: bytes) -> set:
            if side not in last or last[side][0] != key:
                last[side] = key, shingles(next(unpacked([blob])), width)
            return last[side][1]

        for batch in slices(batches, "t_a", 1 << 20):
            keep = []
            for at, (a, b, t_a, t_b) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("a", "b", "t_a", "t_b")))):
                one, two = known("a", a, t_a), known("b", b, t_b)
                common = len(one & two)
                if 100 * common >= per_cent * (len(one) + len(two) - common):
                    keep.append(at)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(x).take(keep) for x in "ab"], ["a", "b"])

    return both.select("a", "b", "t_a", "t_b").mapInArrow(verify, f"a {kind}, b {kind}")


def blocks_of_hubs(labelled: DataFrame) -> DataFrame:
    """Groups in which members of different components that share a bucket meet.

    A bucket's hub is the component with most members there. All members of all buckets
    of one hub form one set, so a document is there once and not once a band; it is cut
    into blocks of bounded size, hub members first. Rows are dealt to every pair of
    blocks but those of hub members alone: ``hub``, ``low``, ``high``, ``rep``,
    ``component``, ``block``.
    """
    sizes = labelled.groupBy("key", "component").count()
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col("component").alias("hub"))).alias("best")
    hubs = sizes.groupBy("key").agg(best, F.count(F.lit(1)).alias("components")).where("components > 1")
    rows = labelled.join(hubs.select("key", F.col("best.hub").alias("hub")), "key").select("hub", "rep", "component").distinct()
    inside = (F.col("component") == F.col("hub")).cast("int")
    counts = rows.groupBy("hub").agg(F.sum(inside).alias("inner"), F.sum(1 - inside).alias("outer"))
    rows = rows.join(counts.select("hub", *(F.ceil(F.col(x) / BLOCK).cast("int").alias(x) for x in ("inner", "outer"))), "hub")
    mixed = F.xxhash64("rep")
    block = F.when(inside == 1, F.pmod(mixed, "inner")).otherwise(F.col("inner") + F.pmod(mixed, "outer")).cast("int")
    others = F.explode(F.sequence(F.when(inside == 1, F.col("inner")).otherwise(F.lit(0)), F.col("inner") + F.col("outer") - 1))
    dealt = rows.select("hub", "rep", "component", block.alias("block"), others.alias("other"))
    return dealt.select("hub", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "component", "block")


def compared(group: pd.DataFrame, least: np.ndarray, width: int, per_cent: int) -> pd.DataFrame:
    """Links between components within one pair of blocks.

    Pairs that share a band are pruned by size and signature, then by the overlap of
    hashed sets; what is left is verified on the words. Components that a link has
    joined are not compared again.
    """
    group = group.sort_values(["block", "rep"], ignore_index=True)
    signs = np.stack([np.frombuffer(x, dtype=np.uint32) for x in group["signature"]])
    bands = signs.view(np.uint64).reshape(len(group), BANDS, -1)
    sizes, reps, block = (group[x].to_numpy() for x in ("n", "rep", "block"))
    bodies = list(unpacked(group["packed"]))
    labels = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
    sets: dict[int, np.ndarray] = {}

    def hashed(at: int) -> np.ndarray:
        if at not in sets:
            sets[at] = shingle_hashes(bodies[at], width)
        return sets[at]

    links = []
    one_block = block.min() == block.max()
    for at in range(len(group)):
        fits = (labels != labels[at]) & (np.minimum(sizes, sizes[at]) * 100 >= np.maximum(sizes, sizes[at]) * per_cent)
        fits &= np.arange(len(group)) > at if one_block else block > block[at]
        others = np.flatnonzero(fits)
        others = others[(bands[others] == bands[at]).all(axis=2).any(axis=1)] if len(others) else others
        for other in others[surviving(np.broadcast_to(signs[at], (len(others), HASHES)), signs[others], least)]:
            if labels[other] == labels[at]:
                continue
            one, two = hashed(at), hashed(other)
            near = np.minimum(np.searchsorted(two, one), len(two) - 1)
            common = int((two[near] == one).sum())
            if 100 * common < per_cent * (len(one) + len(two) - common):
                continue
            one, two = shingles(bodies[at], width), shingles(bodies[other], width)
            common = len(one & two)
            if 100 * common >= per_cent * (len(one) + len(two) - common):
                links.append((min(reps[at], reps[other]), max(reps[at], reps[other])))
                labels[labels == labels[other]] = labels[at]
    return pd.DataFrame(links, columns=["a", "b"], dtype=object)


def near_duplicates(
    docs: DataFrame, width: int = 5, per_cent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Components of documents whose shingle sets are at least ``per_cent`` similar.

    A document's set are its distinct shingles of ``width`` words (see ``shingles``).
    Documents of one set are one class and travel as one. Classes that share a band of
    their MinHash signature are candidates; batches of the signatures are compared,
    pairs whose posterior probability of being similar enough falls below ``miss`` are
    given up, and the others are verified on the words of both texts.

    No bucket emits all its pairs. First each member meets the bucket's centre, the
    member with most company in all its buckets, which joins nearly every true group.
    Then only members of different components that still share a bucket are compared,
    in blocks of bounded size and verified there, with links alone leaving the task;
    that makes the components those of all candidate pairs.

    Columns: ``id``, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept``
    (id = component_id).

    Defined results: null, empty and wordless texts have empty sets, linked with
    nothing. A null id cannot be named: such rows are kept, with a null component, and
    link nothing. Rows of one id and text count as one document; rows that repeat an id
    with other texts each get the component of their own text. No rows give no rows.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("digest", F.unhex(F.md5("body")))
    signed = stage(signatures(rows, width), "near-signatures")
    named = signed.where(F.col("id").isNotNull() & (F.col("n") > 0))
    first = named.groupBy("content").agg(F.min(F.struct("id", "digest", "n", "signature")).alias("first"))
    classes = stage(first.select(F.col("content").alias("rep"), "first.*"), "near-classes")  # a class goes by its content

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    bands = classes.select("rep", "signature", band)
    bands = bands.select("rep", F.xxhash64("band", F.expr(f"substring(signature, band * {4 * ROWS} + 1, {4 * ROWS})")).alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = stage(bands.join(shared, "key"), "near-members")
    company = members.groupBy("rep").agg(F.sum("members").alias("company"))
    centre = members.join(company, "rep").groupBy("key").agg(F.min(F.struct(-F.col("company"), F.col("rep").alias("rep"))).alias("best"))
    star = members.join(centre.select("key", F.col("best.rep").alias("centre")), "key").where("rep != centre")
    pairs = star.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    least = least_matches(per_cent / 100, miss)
    heads = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("id", "digest", "rep")
    texts = packed(rows.withColumnRenamed("digest", "content")).withColumnRenamed("content", "digest")
    texts = stage(texts.join(heads, ["id", "digest"]).select("rep", "packed").dropDuplicates(["rep"]), "near-texts")
    links = stage(verified(pruned(pairs, classes, least, per_cent), texts, width, per_cent), "near-links")

    label = components(links)
    lone = F.coalesce("component", "rep").alias("component")
    labelled = members.where("members > 2").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", lone)
    dealt = stage(blocks_of_hubs(stage(labelled, "near-labelled")), "near-blocks")
    sides = dealt.join(classes.select("rep", "n", "signature"), "rep").join(texts, "rep")
    kind = classes.schema["rep"].dataType.simpleString()
    blocks = sides.groupBy("hub", "low", "high")
    more = stage(blocks.applyInPandas(lambda group: compared(group, least, width, per_cent), f"a {kind}, b {kind}"), "near-more")

    final = components(links.unionByName(more)).withColumnRenamed("node", "rep")
    whole = classes.select("rep", F.col("id").alias("least")).join(final, "rep", "left")
    whole = stage(whole.select(F.col("rep").alias("content"), "least", F.coalesce("component", "rep").alias("group")), "near-whole")
    smallest = whole.groupBy("group").agg(F.min("least").alias("component"))
    named_class = whole.join(smallest, "group").select("content", "component")
    out = signed.select("id", "n", "content").join(named_class, "content", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is the kept one of its component.

    Rows without id stay. Rows that repeat a kept id stay with it.
    """
    key = unused(docs, "kept_id")
    kept = near_duplicates(docs, width, per_cent, id_col=id_col, text_col=text_col).where("kept").select(F.col("id").alias(key)).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept[key]), "left_semi")
