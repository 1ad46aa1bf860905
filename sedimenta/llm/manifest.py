"""Merkle manifest of a dataset, addressed by nested intervals of leaf ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import rank_within
from ..session import stage

#: Children of a node, and levels that are built from one grouping.
ARITY, BAND = 3, 5
WIDTH = ARITY**BAND
#: Leaves below a node, by level, and the place of a rank among the nodes of a level.
SPANS = f"array({', '.join(f'{ARITY**level}L' for level in range(39))})"
BUCKET = f"lo DIV get({SPANS}, level)"


def record_hash(values: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of ``-`` for a null, else UTF-8 bytes, colon and value."""
    texts = [value.cast("string") for value in values]
    fields = (F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts)
    return F.sha2(F.concat(*fields), 256)


def levels(children: DataFrame, level: int) -> DataFrame:
    """Nodes of the ``BAND`` levels above ``level``, with the interval each covers.

    ``children``: ``tree``, ``lo`` (first leaf rank covered), ``digest``, ``size`` (leaves
    of the tree), ``height``. Children of one stretch of ranks meet in one row of at most
    ``WIDTH`` digests, where their levels are folded, however large the tree is.

    Columns: ``tree``, ``level``, ``bucket`` (rank of the interval among those of its
    level), ``lo``, ``hi``, ``digest``, ``size``, ``height``, and ``kids``: interval and
    digest of each child.
    """
    below = ARITY**level
    bucket = F.expr(f"lo DIV {below * WIDTH}L").alias("stretch")
    row = F.struct("lo", "digest")
    rows = children.groupBy("tree", "size", "height", bucket).agg(F.array_sort(F.collect_list(row)).alias("row"))
    folded = rows.select("tree", "size", "height", "stretch", F.expr("transform(row, x -> x.digest)").alias("level_0"))
    for at in range(1, BAND + 1):
        lower = f"level_{at - 1}"
        run = f"slice({lower}, i * {ARITY} + 1, {ARITY})"
        many = f"sequence(0, int(ceil(size({lower}) / {ARITY})) - 1)"
        hashed = f"transform({many}, i -> unhex(sha2(array_join(transform({run}, x -> lower(hex(x))), ''), 256)))"
        folded = folded.withColumn(f"level_{at}", F.expr(f"IF({level + at} <= height, {hashed}, CAST(array() AS array<binary>))"))

    def interval(at: int, place: str) -> tuple[str, str]:
        span = ARITY ** (level + at)
        first = f"(stretch * {WIDTH // ARITY**at} + {place})"
        return f"{first} * {span}L", f"least(({first} + 1) * {span}L, size)"

    nodes = []
    for at in range(1, BAND + 1):
        lo, hi = interval(at, "i")
        kid_lo, kid_hi = interval(at - 1, f"(i * {ARITY} + j)")
        kids = f"transform(slice(level_{at - 1}, i * {ARITY} + 1, {ARITY}), (x, j) -> named_struct('lo', {kid_lo}, 'hi', {kid_hi}, 'digest', x))"
        nodes.append(f"transform(level_{at}, (x, i) -> named_struct('level', {level + at}, 'lo', {lo}, 'hi', {hi}, 'digest', x, 'kids', {kids}))")
    each = folded.select("tree", "size", "height", F.explode(F.expr(f"concat({', '.join(nodes)})")).alias("node"))
    return each.select("tree", "size", "height", "node.*").withColumn("bucket", F.expr(BUCKET))


def intervals(leaves: DataFrame, tallest: int) -> list[DataFrame]:
    """The inner nodes of all trees, one table for every ``BAND`` levels.

    ``leaves``: ``tree``, ``lo`` (rank from 0), ``digest``, ``size``, ``height``.
    """
    bands, children = [], leaves.where("height > 0")
    for level in range(0, tallest, BAND):
        bands.append(stage(levels(children, level), "manifest-nodes"))
        children = bands[-1].where(f"level = {level + BAND} AND height > {level + BAND}").select("tree", "lo", "digest", "size", "height")
    return bands


def attached(children: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """Adds ``steps``: the siblings met on the way up through one table of nodes.

    A child looks up, for each level, the bucket its first rank falls into; the node there
    is its ancestor if its interval contains the rank. The children of the ancestor whose
    intervals do not contain it are the siblings: those that end before, then those that
    start behind.
    """
    above = F.sequence(F.lit(level + 1), F.least(F.lit(level + BAND), F.col("height")))
    wanted = children.where(f"height > {level}").select("tree", "lo", F.explode(above).alias("level"))
    wanted = wanted.select("tree", F.col("lo").alias("rank"), "level", F.expr(BUCKET).alias("bucket"))
    met = wanted.join(nodes.select("tree", "level", "bucket", "lo", "hi", "kids"), ["tree", "level", "bucket"]).where("lo <= rank AND rank < hi")
    siblings = "transform(filter(kids, kid -> {}), kid -> kid.digest)"
    step = F.struct("level", F.expr(siblings.format("kid.hi <= rank")).alias("before"), F.expr(siblings.format("kid.lo > rank")).alias("behind"))
    found = met.groupBy("tree", F.col("rank").alias("lo")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return children.join(found, ["tree", "lo"], "left")


NO_STEPS = "CAST(array() AS array<struct<level: int, before: array<binary>, behind: array<binary>>>)"


def routes(leaves: DataFrame, bands: list[DataFrame]) -> DataFrame:
    """Adds ``steps``, from the leaf to the root of its tree. Tops of a band get their
    way first, so a leaf's own joins cover ``BAND`` levels and one look-up."""
    ways = None
    for number in range(len(bands) - 1, -1, -1):
        level = number * BAND
        if number:
            children = bands[number - 1].where(f"level = {level} AND height > {level}").select("tree", "lo", "size", "height")
        else:
            children = leaves
        found = attached(children, bands[number], level)
        own = F.coalesce("steps", F.expr(NO_STEPS))
        if ways is None:
            found = found.withColumn("steps", own)
        else:
            up = F.expr(f"lo DIV {ARITY**level * WIDTH}L * {ARITY**level * WIDTH}L")
            found = found.withColumn("top", up).join(ways, ["tree", "top"], "left")
            found = found.withColumn("steps", F.concat(own, F.coalesce("more", F.expr(NO_STEPS)))).drop("top", "more")
        if number:
            ways = stage(found.select("tree", F.col("lo").alias("top"), F.col("steps").alias("more")), "manifest-ways")
    return found if bands else leaves.withColumn("steps", F.expr(NO_STEPS))


def sized(ranked: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``size`` and ``height`` of the tree, and gives the height of the tallest."""
    sizes = ranked.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("height", F.expr(f"size(filter({SPANS}, span -> span < size))"))
    tallest = sizes.agg(F.max("height")).first()[0] or 0
    return ranked.join(sizes, "tree"), tallest


def tops(leaves: DataFrame, bands: list[DataFrame]) -> DataFrame:
    """``tree`` and the ``digest`` at its root."""
    parts = [leaves.where("height = 0").select("tree", "digest")]
    parts += [nodes.where("level = height").select("tree", "digest") for nodes in bands]
    return reduce(DataFrame.unionByName, parts)


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "source",
    claimed: Mapping[str, Column] | None = None,
) -> DataFrame:
    """A Merkle tree over the rows of each group, and one over the groups.

    Each row is a leaf, the ``record_hash`` of ``columns``. In a group, leaves ascend by
    id; every ``ARITY`` consecutive nodes of a level (the last run may be shorter, even
    one) have the hash of their digests as hex text as their parent, until one is left,
    the subroot. Subroots, in bytewise order of the group, likewise give the root.

    A node is known by the interval of leaf ranks that it covers. A band of levels is
    built from one grouping of ranks, whatever a group's size. Ancestors are attached by
    joins on level and bucket that check containment, siblings are the rest of the
    parent's interval. Joins and groupings are linear in the rows, and no group, level or
    route is in one task. Ranks come from range partitions, not from a window per group.

    Columns: ``id``, ``leaf``, ``subroot``, ``root`` (hex), ``steps`` (for each level up to
    the root, ``before`` and ``behind``, the siblings' digests), and ``claimed_leaf``, the leaf
    after the columns in ``claimed`` are replaced by other expressions over ``docs``:
    ``folded_root`` of it equals ``root`` only if the row is what the manifest holds.

    Defined results: nulls in any column hash as ``-``; a null group is the first tree, a
    null id the first leaf. Rows that repeat an id are ordered by their leaf; equal rows
    are leaves of their own. A lone row is its own subroot, and root if it is the only
    group. Columns with other names are ignored. An empty table gives no rows.
    """
    other = claimed or {}
    group = docs[group_col].cast("string")
    rows = docs.select(
        docs[id_col].alias("id"),
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"),
        F.unhex(record_hash([docs[x] for x in columns])).alias("digest"),
        F.unhex(record_hash([other.get(x, docs[x]) for x in columns])).alias("claimed_digest"),
    )
    rows = rows.withColumn("place", F.struct("id", "digest"))
    ranked = rank_within(rows, ["tree"], "place", "lo").withColumn("lo", F.col("lo") - 1).drop("place")
    leaves, tallest = sized(stage(ranked, "manifest-leaves"))
    bands = intervals(leaves, tallest)

    subroots = stage(tops(leaves, bands), "manifest-subroots")
    forest = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    forest = rank_within(forest, ["tree"], "name", "lo").withColumn("lo", F.col("lo") - 1)
    groups, tall = sized(stage(forest, "manifest-groups"))
    upper = intervals(groups, tall)
    root = tops(groups, upper).select("tree", F.col("digest").alias("root"))
    outer = routes(groups, upper).join(root, "tree")
    outer = stage(outer.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("steps").alias("outer")), "manifest-outer")

    found = routes(leaves, bands).join(outer, "tree")
    text = [F.lower(F.hex(x)).alias(y) for x, y in (("digest", "leaf"), ("subroot", "subroot"), ("root", "root"), ("claimed_digest", "claimed_leaf"))]
    return found.select("id", *text, F.concat("steps", "outer").alias("steps"))


def hexed(digests: str) -> str:
    return f"array_join(transform({digests}, x -> lower(hex(x))), '')"


def proof_text(steps: str = "steps") -> Column:
    """The siblings of all steps as hex text, level by level, left to right."""
    return F.expr(f"array_join(transform({steps}, step -> concat({hexed('step.before')}, {hexed('step.behind')})), '')")


def folded_root(leaf: str = "claimed_leaf", steps: str = "steps") -> Column:
    """The root that a leaf and its steps give."""
    return F.expr(f"aggregate({steps}, {leaf}, (node, step) -> sha2(concat({hexed('step.before')}, node, {hexed('step.behind')}), 256))")
