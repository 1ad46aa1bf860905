"""Jaccard self-join of n-gram sets over an R-tree of count vectors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import rank_within
from ..session import stage
from .common import id_and_text, packed, slices, unpacked
from .components import components
from .near import verified, words_of

#: Groups over which the whole table is counted, to order branches from rare to common.
ORDER_BITS = 16
#: Groups of a point: about one for two n-grams, within these bounds.
LEAST_GROUPS, MOST_GROUPS = 64, 4096
#: Members of a leaf, and nodes below an inner node.
LEAF, FAN = 128, 32
MIX = np.uint64(0x9E3779B97F4A7C15)


def order_group(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def point(hashes: np.ndarray) -> bytes:
    """How many n-grams fall into each group, as bytes.

    Groups are the lower bits of a hash, so halves of a vector add up to the vector with
    half as many groups. A count too large for a byte gives no point and no bound.
    """
    groups = LEAST_GROUPS
    while groups < MOST_GROUPS and 2 * groups <= len(hashes):
        groups *= 2
    counts = np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8).tobytes() if counts.max() < 1 << 8 else b""


def coarse(blob: bytes, groups: int) -> np.ndarray:
    """The vector with ``groups`` groups; without a point one that bounds nothing."""
    if not blob:
        return np.full(groups, 1 << 40, dtype=np.int64)
    return np.frombuffer(blob, dtype=np.uint8).reshape(-1, groups).sum(axis=0, dtype=np.int64)


def may_be_similar(minima: np.ndarray, one: np.ndarray, other: np.ndarray, per_cent: int) -> np.ndarray:
    """Whether sets of sizes ``one`` and ``other`` whose overlap is at most the summed
    coordinate minima can reach the similarity."""
    most = np.minimum(minima, np.minimum(one, other))
    return 100 * most >= per_cent * (one + other - most)


def gram_hashes(texts: list[str], width: int) -> list[np.ndarray]:
    """64-bit hashes of the ``width``-grams of each text, in order and with repetitions; of
    the whole sequence if there are fewer words."""
    from xxhash import xxh3_64_intdigest

    words = [words_of(text) for text in texts]
    each = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(words)), dtype=np.uint64, count=sum(map(len, words)))
    mixed = np.full(max(0, len(each) - width + 1), width, dtype=np.uint64)
    for at in range(width):
        mixed = (mixed ^ each[at : at + len(mixed)]) * MIX
        mixed ^= mixed >> np.uint64(29)
    out, end = [], 0
    for some in words:
        start, end = end, end + len(some)
        if not some or len(some) >= width:
            out.append(mixed[start : max(start, end - width + 1)])
        else:
            out.append(np.array([xxh3_64_intdigest(b" ".join(some), seed=len(some))], dtype=np.uint64))
    return out


def group_counts(rows: DataFrame, width: int) -> np.ndarray:
    """N-grams of the whole table in each of 2 ** ``ORDER_BITS`` groups."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, dtype=np.int64)
        for batch in slices(batches, "body", 1 << 20):
            grams = gram_hashes(batch.column("body").to_pylist(), width)
            total += np.bincount(order_group(np.concatenate(grams)), minlength=len(total)) if grams else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["place", "count"])

    counted = rows.select("body").mapInArrow(count, "place int, count bigint")
    total = np.zeros(1 << ORDER_BITS, dtype=np.int64)
    for place, number in counted.groupBy("place").agg(F.sum("count")).collect():  # never more than the groups
        total[place] = number
    return total


def branch_rows(rows: DataFrame, counts: np.ndarray, width: int, per_cent: int) -> DataFrame:
    """``id``, ``digest``, ``content`` (fingerprint of the set), ``n`` (its size), ``point`` and
    ``branches`` of every row.

    Fine coordinates (single n-grams) are ordered by how common their group is. If two
    sets share none of the first n - ceil(n * per_cent / 100) + 1 coordinates of either,
    their summed minima are too small; so a set is put under these branches only.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in slices(batches, "body", 1 << 20):
            contents, sizes, points, branches = [], [], [], []
            for grams in gram_hashes(batch.column("body").to_pylist(), width):
                hashes = np.unique(grams)
                first = len(hashes) - -(-len(hashes) * per_cent // 100) + 1 if len(hashes) else 0
                order = np.lexsort((hashes, counts[order_group(hashes)]))
                branches.append(hashes[order[:first]].view(np.int64))
                contents.append(xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                points.append(point(hashes))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, branches)], dtype=np.int32)), pa.array(np.concatenate(branches)))
            arrays = [pa.array(contents, pa.binary()), pa.array(sizes, pa.int64()), pa.array(points, pa.binary()), lists]
            kept = [batch.column("id"), batch.column("digest")]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], ["id", "digest", "content", "n", "point", "branches"])

    out = f"id {kind}, digest binary, content binary, n bigint, point binary, branches array<bigint>"
    return rows.select("id", "digest", "body").mapInArrow(cut, out)


def bounded(pairs: DataFrame, points: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (``a``, ``b``) whose sizes and summed minima allow them to be similar."""
    for x in "ab":
        pairs = pairs.join(points.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}")), x)
    both = pairs.where(sizes_fit("n_a", "n_a", "n_b", "n_b", per_cent))
    for x in "ab":
        both = both.join(points.select(F.col("class").alias(x), F.col("point").alias(f"p_{x}")), x)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "p_a", 1 << 20):
            minima = []
            for one, two in zip(batch.column("p_a").to_pylist(), batch.column("p_b").to_pylist()):
                groups = min(len(one) or MOST_GROUPS, len(two) or MOST_GROUPS)
                minima.append(np.minimum(coarse(one, groups), coarse(two, groups)).sum())
            fits = may_be_similar(np.array(minima, dtype=np.int64), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), per_cent)
            keep = pa.array(np.flatnonzero(fits))
            yield pa.RecordBatch.from_arrays([batch.column(x).take(keep) for x in "ab"], ["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(bound, "a bigint, b bigint")


def sizes_fit(low_a: str, high_a: str, low_b: str, high_b: str, per_cent: int) -> Column:
    """Whether two ranges of set sizes hold sizes that are similar enough."""
    return F.expr(f"{high_a} * 100 >= {low_b} * {per_cent} AND {high_b} * 100 >= {low_a} * {per_cent}")


def trees(members: DataFrame, labelled: DataFrame) -> DataFrame:
    """Sets that still have to meet, by tree: ``tree``, ``class``, ``component``.

    Only branches whose sets are of several components are left. The one with most sets
    there names the tree, so branches with the same neighbourhood make one tree and a set
    is in it once.
    """
    rows = members.select("key", "class").join(labelled, "class")
    sizes = rows.groupBy("key", "component").count()
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col("component").alias("tree"))).alias("best")
    mixed = sizes.groupBy("key").agg(best, F.count(F.lit(1)).alias("components")).where("components > 1")
    return rows.join(mixed.select("key", F.col("best.tree").alias("tree")), "key").select("tree", "class", "component").distinct()


def leaves_of(rows: DataFrame) -> DataFrame:
    """Adds ``leaf``: ``LEAF`` members next to each other by size and component."""
    slab = F.floor(F.log(1.08, F.col("n").cast("double")))
    ordered = rows.withColumn("place", F.struct(slab.alias("slab"), "component", "class"))
    ranked = rank_within(ordered, ["tree"], "place", "rank").drop("place")
    return ranked.withColumn("leaf", F.expr(f"(rank - 1) DIV {LEAF}")).drop("rank")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], blob: str) -> Iterator[pa.Table]:
    """Batches cut at the ends of groups: rows of equal ``keys``, which must be sorted, stay
    together. A group is never larger than a node or two leaves."""
    held: list[pa.RecordBatch] = []
    for batch in slices(batches, blob, 1 << 20):
        last = [batch.column(x)[-1].as_py() for x in keys]
        same = np.logical_and.reduce([batch.column(x).to_numpy() == y for x, y in zip(keys, last)])
        start = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
        if start or held and [held[-1].column(x)[-1].as_py() for x in keys] != last:
            done = [*held, batch.slice(0, start)]
            yield pa.Table.from_batches(done)
            held, batch = [], batch.slice(start)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the groups of a sorted table."""
    changes = [np.flatnonzero(np.diff(table.column(x).to_numpy())) + 1 for x in keys]
    return np.unique(np.concatenate([[0], *changes])).astype(np.int64)


NODE = "tree bigint, node bigint, parent bigint, low bigint, high bigint, first bigint, last bigint, top binary"
BOX = [x.split()[0] for x in NODE.split(", ")]


def nodes_of(rows: DataFrame, node: str) -> DataFrame:
    """The bounding box of each node: sizes, components, and largest counts by group.

    ``rows`` hold ``low``, ``high``, ``first``, ``last`` and ``top`` (the box of a member is
    itself); a node has ``LEAF`` members or ``FAN`` nodes at most.
    """
    keys = ["tree", "node"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, keys, "top"):
            if not table.num_rows:
                continue
            at = starts_of(table, keys)
            tops = np.frombuffer(b"".join(table.column("top").to_pylist()), dtype=np.int64).reshape(table.num_rows, -1)
            tree, number = (table.column(x).to_numpy()[at] for x in keys)
            ends = [op.reduceat(table.column(x).to_numpy(), at) for op, x in ((np.minimum, "low"), (np.maximum, "high"), (np.minimum, "first"), (np.maximum, "last"))]
            boxes = [x.tobytes() for x in np.maximum.reduceat(tops, at, axis=0)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (tree, number, number // FAN, *ends)), pa.array(boxes, pa.binary())], BOX)

    named = rows.select("tree", F.col(node).alias("node"), "low", "high", "first", "last", "top")
    return named.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, NODE)


def boxes(rows: DataFrame) -> DataFrame:
    """Members as boxes of their own, with the fewest groups."""

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "point", 1 << 20):
            tops = [coarse(x, LEAST_GROUPS).tobytes() for x in batch.column("point").to_pylist()]
            kept = [batch.column(x) for x in ("tree", "leaf", "n", "n", "component", "component")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(tops, pa.binary())], ["tree", "leaf", "low", "high", "first", "last", "top"])

    wanted = rows.select("tree", "leaf", "n", "component", "point")
    return wanted.mapInArrow(box, "tree bigint, leaf bigint, low bigint, high bigint, first bigint, last bigint, top binary")


def meeting(pairs: DataFrame, nodes: DataFrame, per_cent: int) -> DataFrame:
    """Pairs of nodes below the given pairs (``tree``, ``a``, ``b``) whose boxes allow a
    similar pair of different components between them."""
    sides = [nodes.select("tree", *(F.col(x).alias(f"{x}_{s}") for x in BOX[1:])) for s in "ab"]
    both = pairs.withColumnsRenamed({"a": "parent_a", "b": "parent_b"}).join(sides[0], ["tree", "parent_a"]).join(sides[1], ["tree", "parent_b"])
    both = both.where("node_a <= node_b").where("NOT (first_a = last_a AND first_b = last_b AND first_a = first_b)")
    both = both.where(sizes_fit("low_a", "high_a", "low_b", "high_b", per_cent))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "top_a", 1 << 20):
            one, two = (np.frombuffer(b"".join(batch.column(x).to_pylist()), dtype=np.int64).reshape(batch.num_rows, -1) for x in ("top_a", "top_b"))
            minima = np.minimum(one, two).sum(axis=1)
            low_a, low_b = (batch.column(x).to_numpy() for x in ("low_a", "low_b"))
            # The smallest sizes that fit each other ask for the least overlap.
            small_a = np.maximum(low_a, -(-low_b * per_cent // 100))
            small_b = np.maximum(low_b, -(-low_a * per_cent // 100))
            keep = pa.array(np.flatnonzero(100 * minima >= per_cent * (small_a + small_b - minima)))
            yield pa.RecordBatch.from_arrays([batch.column(x).take(keep) for x in ("tree", "node_a", "node_b")], ["tree", "a", "b"])

    wanted = both.select("tree", "node_a", "node_b", "low_a", "low_b", "top_a", "top_b")
    return wanted.mapInArrow(prune, "tree bigint, a bigint, b bigint")


def leaf_pairs(rows: DataFrame, points: DataFrame, per_cent: int) -> DataFrame:
    """Pairs of leaves to compare: trees of one leaf, and what a descent through all
    larger trees, from their roots, comes down to."""
    heights = rows.groupBy("tree").agg(F.max("leaf").alias("leaves"))
    small = heights.where("leaves = 0").select("tree", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    large = rows.join(heights.where("leaves > 0").select("tree"), "tree").join(points, "class")
    levels = [stage(nodes_of(boxes(large), "leaf"), "join-nodes")]
    while not levels[-1].where("node > 0").isEmpty():
        levels.append(stage(nodes_of(levels[-1], "parent"), "join-nodes"))
    pairs = levels[-1].select("tree", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for nodes in reversed(levels):
        pairs = stage(meeting(pairs, nodes, per_cent), "join-meeting")
    return small.unionByName(pairs)


def candidates(group: pa.Table, per_cent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a pair of leaves, later members of another component (and of
    the other leaf, if there are two) that sizes and summed minima do not rule out."""
    sizes, leaf, component = (group.column(x).to_numpy() for x in ("n", "leaf", "component"))
    one = group.column("a")[0].as_py() == group.column("b")[0].as_py()
    fits = np.minimum(sizes, sizes[:, None]) * 100 >= np.maximum(sizes, sizes[:, None]) * per_cent
    fits &= (component != component[:, None]) & (np.arange(len(leaf)) > np.arange(len(leaf))[:, None] if one else leaf > leaf[:, None])
    if not fits.any():
        return
    blobs = group.column("point").to_pylist()
    groups = min([len(x) for x in blobs if x], default=LEAST_GROUPS)
    points = np.stack([coarse(x, groups) for x in blobs])
    for at in np.flatnonzero(fits.any(axis=1)):
        others = np.flatnonzero(fits[at])
        minima = np.minimum(points[others], points[at]).sum(axis=1)
        others = others[may_be_similar(minima, sizes[others], sizes[at], per_cent)]
        if len(others):
            yield at, others


PAIR = ["tree", "a", "b"]


def groups_of(batches: Iterator[pa.RecordBatch], blob: str) -> Iterator[pa.Table]:
    for table in runs(batches, PAIR, blob):
        if table.num_rows:
            borders = [*starts_of(table, PAIR).tolist(), table.num_rows]
            yield from (table.slice(a, b - a).combine_chunks() for a, b in zip(borders, borders[1:]) if b - a > 1)


def open_members(sides: DataFrame, per_cent: int) -> DataFrame:
    """The members of pairs of leaves that have a candidate there."""
    columns = [*PAIR, "leaf", "class", "component", "n", "point"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, "point"):
            found = [at for one, others in candidates(group, per_cent) for at in (one, *others)]
            if found:
                yield group.take(pa.array(np.unique(found))).combine_chunks().to_batches()[0]

    dealt = sides.select(columns).repartition(*PAIR).sortWithinPartitions(*PAIR, "leaf", "class")
    return dealt.mapInArrow(find, "tree bigint, a bigint, b bigint, leaf bigint, class bigint, component bigint, n bigint, point binary")


def compared(members: DataFrame, width: int, per_cent: int) -> DataFrame:
    """Links (``a``, ``b``) between components within pairs of leaves: candidates whose sets
    are similar. Components that a link has joined are not compared there again."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, "packed"):
            classes, sizes = (group.column(x).to_numpy() for x in ("class", "n"))
            labels = group.column("component").to_numpy().copy()
            sets = [np.unique(x) for x in gram_hashes(list(unpacked(group.column("packed").to_pylist())), width)]
            links = []
            for at, others in candidates(group, per_cent):
                for other in others:
                    if labels[other] != labels[at]:
                        common = len(np.intersect1d(sets[at], sets[other], assume_unique=True))
                        if 100 * common >= per_cent * (sizes[at] + sizes[other] - common):
                            links.append(sorted((int(classes[at]), int(classes[other]))))
                            labels[labels == labels[other]] = labels[at]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

    dealt = members.repartition(*PAIR).sortWithinPartitions(*PAIR, "leaf", "class")
    return dealt.mapInArrow(compare, "a bigint, b bigint")


def ngram_join(docs: DataFrame, width: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of ``width``-grams are ``per_cent`` similar.

    A set is the distinct ``width``-grams of a text's words (A-Z lower-cased), the whole
    sequence if there are fewer words. Documents of one set are one class.

    N-grams are hashed into groups and a set is indexed as the point of its group counts.
    Two sets share no more than the sum of the minima of their coordinates. That bound is
    applied three times, and no similar pair is lost to it: to single n-grams, ordered from
    rare to common over the whole table, which puts a set under few branches; to the boxes
    of an R-tree below them, which is descended in pairs of nodes by joins; and to pairs
    of points in two leaves. What survives is verified on whole sets, links on words.

    Nothing emits all pairs of a group. Sets under a branch first meet its centre, the
    one with most company, which joins nearly every group of copies; nodes that hold one
    component only are not compared with it again. Branches with one neighbourhood share
    a tree; members are ranked over range partitions, boxes are merged level by level, and
    members travel once for each pair of leaves that no box rules out, with their text only
    if they have a candidate there.

    Columns: ``id``, ``n_shingles``, ``component_id`` (smallest id reachable by links).

    Defined results: null, empty and wordless texts have empty sets, linked with
    nothing. Rows with a null id get a null component and link nothing. Rows that repeat an
    id each get the component of their own text. No rows give no rows.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("digest", F.unhex(F.md5("body")))
    cut = stage(branch_rows(rows, group_counts(rows, width), width, per_cent), "join-branches")
    named = cut.select("id", "n", "content")
    known = cut.where("id IS NOT NULL AND n > 0")
    head = F.min(F.struct("id", "digest")).alias("head")
    classes = known.groupBy("content").agg(head, *(F.first(x).alias(x) for x in ("n", "point", "branches")))
    classes = classes.select("content", F.col("head.id").alias("rep"), F.col("head.digest").alias("digest"), "n", "point", "branches")
    classes = stage(classes.withColumn("class", F.monotonically_increasing_id()), "join-classes")

    dealt = classes.select("class", F.explode("branches").alias("key"))
    shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    members = stage(dealt.join(shared, "key"), "join-members")
    company = members.groupBy("class").agg(F.sum("many").alias("company"))
    best = F.min(F.struct((-F.col("company")).alias("company"), "class")).alias("best")
    centre = members.join(company, "class").groupBy("key").agg(best).select("key", F.col("best.class").alias("centre"))
    star = members.join(centre, "key").where("class != centre")
    pairs = star.select(F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b")).distinct()

    heads = classes.select(F.col("rep").alias("id"), "digest", "class")
    bodies = packed(rows.withColumnRenamed("digest", "content")).withColumnRenamed("content", "digest")

    def texts_of(wanted: DataFrame) -> DataFrame:
        some = heads.join(wanted.distinct(), "class", "left_semi")
        found = bodies.join(some, ["id", "digest"]).select(F.col("class").alias("rep"), "packed")
        return stage(found.dropDuplicates(["rep"]), "join-texts")

    least = stage(bounded(pairs, classes, per_cent), "join-bounded")
    ends = F.explode(F.array("a", "b")).alias("class")
    links = stage(verified(least, texts_of(least.select(ends)), width, per_cent), "join-links")

    label = components(links).withColumnRenamed("node", "class")
    labelled = classes.select("class", "n").join(label, "class", "left").select("class", "n", F.coalesce("component", "class").alias("component"))
    labelled = stage(labelled, "join-labelled")
    rest = stage(leaves_of(trees(members, labelled).join(labelled.select("class", "n"), "class")), "join-leaves")
    points = classes.select("class", "point")
    leaves = F.explode(F.array_distinct(F.array("a", "b"))).alias("leaf")
    sides = leaf_pairs(rest, points, per_cent).select(*PAIR, leaves).join(rest, ["tree", "leaf"]).join(points, "class")
    open_ = stage(open_members(sides, per_cent), "join-open")
    texts = texts_of(open_.select("class"))
    more = compared(open_.join(texts.withColumnRenamed("rep", "class"), "class"), width, per_cent)
    more = verified(stage(more.distinct(), "join-more"), texts, width, per_cent)

    final = components(links.unionByName(more)).withColumnRenamed("node", "class")
    whole = classes.select("class", "content", "rep").join(final, "class", "left").select("content", "rep", F.coalesce("component", "class").alias("component"))
    whole = stage(whole, "join-whole")
    smallest = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = named.join(whole.join(smallest, "component").select("content", "component_id"), "content", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return found.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))
