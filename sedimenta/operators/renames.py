"""Matching of renamed files.

A left-over old file takes, in path order, the first free new file of the next
release whose base name is similar and which shares enough methods. The work is
done in three steps: similar names, acceptable pairs, one-to-one assignment.

Files of equal base name and equal method names are interchangeable, so pairs are
formed between such *classes* of files and never between single files.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.names import basename
from sedimenta.functions.text import characters, let, shared_method_ratio
from sedimenta.operators.files import PAIR
from sedimenta.operators.ranking import rank_within
from sedimenta.operators.scoring import similarity_ratio
from sedimenta.session import stage

# Both ratios must be exceeded.
NAME_SIMILARITY = 0.75
COMMON_METHODS = 0.50

# Release pairs with at most this many rows (files and class pairs) are assigned
# by one task each; larger ones go through relational rounds first.
GROUP_ROWS = 100_000

# Files of one release pair and topic meet directly if that makes at most so many pairs
# per file, about as many as a name has marks; only speed depends on it.
_DIRECT = 32

# Characters of file names from rare to frequent; only speed depends on it.
_RARE_FIRST = "qzjxkwvhfgbmudclnrosiaet_py."

# Characters two similar names must share within their rarest ones. Two is always
# safe: unequal names shorter than that are never similar enough.
_SHARED = 2


def _least_common(a: Column, b: Column) -> Column:
    """Smallest LCS length that exceeds the name similarity for lengths a and b."""
    return (F.floor((a + b) * (NAME_SIMILARITY / 2)) + 1).cast("int")


def _tokens(chars: Column) -> Column:
    """Characters of a name, numbered per repetition, rare ones first."""

    def token(c: Column, i: Column) -> Column:
        seen = F.size(F.filter(F.slice(chars, F.lit(1), i), lambda d: d == c))
        return F.struct(F.instr(F.lit(_RARE_FIRST), c).alias("frequency"), F.concat(c, seen.cast("string")).alias("token"))

    return F.transform(F.array_sort(F.transform(chars, token)), lambda s: s["token"])


def _marks(name: Column) -> Column:
    """Blocking keys of a name: pairs of rare characters, and the name itself.

    Let two similar names have lengths a and b and t be the number of characters
    they must have in common. With characters in one global order, the first
    ``a - t + 2`` of one and the first ``b - t + 2`` of the other share two. Here b
    is not known yet, so t is taken for the shortest name that could be similar;
    ``place``, where the second character stands, lets the join apply the real t.
    """
    size = F.length(name)
    shortest = F.ceil(size * (NAME_SIMILARITY / (2 - NAME_SIMILARITY))).cast("int")
    kept = size - _least_common(shortest, size) + _SHARED

    def pairs(rare: Column) -> Column:
        return F.flatten(
            F.transform(
                rare,
                lambda x, i: F.transform(
                    F.slice(rare, i + 2, F.size(rare)),
                    lambda y, j: F.struct((i + j + 2).alias("place"), F.concat_ws(" ", x, y).alias("mark")),
                ),
            )
        )

    own = F.array(F.struct(F.lit(0).alias("place"), F.concat(F.lit("="), name).alias("mark")))
    return F.concat(own, let(F.slice(let(characters(name), _tokens), F.lit(1), kept), pairs))


def _fits() -> Column:
    """Whether the places of a shared mark allow the names to be similar enough."""
    old_size, new_size = F.length("old_name"), F.length("new_name")
    least = _least_common(old_size, new_size)
    return (
        (least <= F.least(old_size, new_size))
        & (F.col("old_place") <= old_size - least + _SHARED)
        & (F.col("new_place") <= new_size - least + _SHARED)
    )


def _close() -> Column:
    """Whether an edit distance that counts exchanges once allows similar enough names."""
    both = F.length("old_name") + F.length("new_name")
    return F.levenshtein("old_name", "new_name") < both * (1 - NAME_SIMILARITY)


def _near(candidates: DataFrame) -> DataFrame:
    """Candidates with similar names; each pair of names is scored once, wherever it occurs."""
    unequal = candidates.where("old_name != new_name")
    scored = unequal.select("old_name", "new_name").distinct().where(
        similarity_ratio(F.col("old_name"), F.col("new_name")) > NAME_SIMILARITY
    )
    return candidates.where("old_name = new_name").unionByName(
        unequal.join(scored, ["old_name", "new_name"]).select(*candidates.columns)
    )


def _classes(files: DataFrame, side: str, single: bool) -> DataFrame:
    """Files with their class; ``single`` makes every file its own class."""
    sorted_names = F.array_sort("names")
    name = basename(F.col("path"))
    label = F.concat_ws("/", name, F.sha2(F.array_join(sorted_names, "\n"), 256))
    claimed = ["claimed"] if "claimed" in files.columns else []
    return files.select(
        *PAIR, "path", (F.col("path") if single else label).alias(f"{side}_class"),
        name.alias(f"{side}_name"), sorted_names.alias(f"{side}_methods"),
        F.size("names").alias(f"n_{side}"), *claimed,
    )


def acceptable_classes(old: DataFrame, new: DataFrame, tie_self: bool = False) -> DataFrame:
    """Class pairs (PAIR, old_class, new_class) that may be matched.

    A class without methods goes by its name alone, any other by name and methods
    at once. More than half of the shorter list must be shared; so at least one of
    the shorter list's names, leaving out just too few of them, is shared. Joining
    on such a *topic* together with a mark of the file name finds every pair, yet
    neither thousands of alike names nor a common method makes all pairs meet. Where a
    topic of a release pair has few classes they meet without marks, and no row is
    repeated for each mark of its name.
    """
    olds, news = old.drop("path").distinct(), new.drop("path").distinct()
    base_names = olds.select(F.col("old_name").alias("name")).union(news.select("new_name")).distinct()
    marks = stage(base_names.withColumn("marks", _marks(F.col("name"))), "marks")
    columns = [*PAIR, "old_class", "new_class"]

    def marked(rows: DataFrame, side: str) -> DataFrame:
        found = rows.join(marks.withColumnRenamed("name", f"{side}_name"), f"{side}_name")
        return found.select(*rows.columns, F.inline("marks").alias(f"{side}_place", "mark"))

    # Names alone: one side has no methods. Classes of a name come in afterwards.
    def names_of(rows: DataFrame, side: str, condition: str) -> DataFrame:
        return marked(rows.where(condition).select(*PAIR, f"{side}_name").distinct(), side)

    def by_name(old_condition: str, new_condition: str) -> DataFrame:
        names = names_of(olds, "old", old_condition).join(names_of(news, "new", new_condition), [*PAIR, "mark"])
        names = _near(stage(names.where(_fits()).select(*PAIR, "old_name", "new_name").distinct(), "names"))
        return names.join(olds.where(old_condition), [*PAIR, "old_name"]).join(
            news.where(new_condition), [*PAIR, "new_name"]
        )

    # Names and methods. The role, part of the join key, tells which side is taken
    # for the shorter one; only that side's probes and the other's topics meet.
    def with_topics(rows: DataFrame, side: str) -> DataFrame:
        n = F.col(f"n_{side}")
        as_short, as_long = ("old", "new") if side == "old" else ("new", "old")
        # Long names are the rarer ones, so they are probed first.
        own = F.array_distinct(f"{side}_methods")
        ordered = F.array_sort(F.transform(own, lambda m: F.struct((-F.length(m)).alias("l"), m.alias("m"))))
        probes = F.size(own) - F.floor(n * COMMON_METHODS)

        def topic(value: Column, role: str) -> Column:
            return F.struct(value.alias("topic"), F.lit(role).alias("shorter"))

        topics = F.concat(
            F.transform(ordered, lambda m: topic(m["m"], as_long)),
            F.transform(F.filter(ordered, lambda _, i: i < probes), lambda m: topic(m["m"], as_short)),
        )
        if tie_self:
            # Lists of one length match on the old list's own duplicates.
            tie = F.array(topic(F.concat(F.lit("="), n.cast("string")), "old"))
            if side == "old":
                tie = F.filter(tie, lambda _: F.size(own) > n * COMMON_METHODS)
            topics = F.concat(topics, tie)
        rows = rows.where(n > 0)
        columns = [*PAIR, f"{side}_class", f"{side}_name", f"n_{side}"]
        return stage(rows.select(*columns, F.inline(topics)), "topics")

    block = [*PAIR, "topic", "shorter"]
    old_topics, new_topics = with_topics(olds, "old"), with_topics(news, "new")
    old_counts = old_topics.groupBy(*block).agg(F.count("*").alias("o"))
    new_counts = new_topics.groupBy(*block).agg(F.count("*").alias("n"))
    crowded = F.col("o") * F.col("n") > _DIRECT * (F.col("o") + F.col("n"))
    dense = stage(old_counts.join(new_counts.hint("merge"), block).where(crowded).select(*block), "dense")

    def split(how: str) -> tuple[DataFrame, DataFrame]:
        return tuple(rows.join(dense, block, how) for rows in (old_topics, new_topics))

    right_role = (F.col("shorter") == "old") == (F.col("n_old") <= F.col("n_new"))
    named = [*columns, "old_name", "new_name"]
    direct, direct_new = split("left_anti")
    met = direct.join(direct_new.hint("merge"), block).where(right_role & _close()).select(*named)
    if not dense.isEmpty():
        crowd, crowd_new = split("left_semi")
        by_mark = marked(crowd, "old").join(marked(crowd_new, "new").hint("merge"), [*block, "mark"])
        by_mark = by_mark.where(_fits() & right_role)
        met = met.unionByName(by_mark.select(*named))
    met = met.distinct()
    ratio = shared_method_ratio(F.col("old_methods"), F.col("new_methods"), tie_self)
    both = (
        _near(stage(met, "candidates"))
        .join(olds.drop("old_name").hint("merge"), [*PAIR, "old_class"])
        .join(news.drop("new_name").hint("merge"), [*PAIR, "new_class"])
        .where(ratio > COMMON_METHODS)
    )
    edges = [both, by_name("n_old = 0", "n_new >= 0"), by_name("n_old > 0", "n_new = 0")]
    if "claimed" in new.columns:
        # Single files: a new file whose own partner comes later is still open.
        still_open = ~F.col("claimed") | (F.col("new_class") > F.col("old_class"))
        edges = [e.where(still_open) for e in edges]
    found = edges[0].select(*columns)
    for more in edges[1:]:
        found = found.unionByName(more.select(*columns))
    return found


_EVENT = "repository_name string, prev_branch string, branch string, prev_path string, path string"


def _matches(events: Iterable[tuple[str, str, str]]) -> Iterator[tuple[str, str]]:
    """Assignment inside one release pair of checked size, from its sorted (kind, left, right)."""
    edges: dict[str, list[str]] = {}
    free: dict[str, deque[str]] = {}
    for kind, left, right in events:  # edges, then new files, then old ones
        if kind == "edge":
            edges.setdefault(left, []).append(right)
        elif kind == "new":
            free.setdefault(right, deque()).append(left)
        else:
            open_classes = [c for c in edges.get(right, ()) if free.get(c)]
            if open_classes:
                yield left, free[min(open_classes, key=lambda c: free[c][0])].popleft()


def _assign_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Assignment of release pairs that come one after the other."""

    def rows() -> Iterator[tuple[str, ...]]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    def found() -> Iterator[tuple[str, ...]]:
        for pair, events in groupby(rows(), itemgetter(0, 1, 2)):
            for match in _matches(event[3:] for event in events):
                yield *pair, *match

    matched = found()
    while some := list(islice(matched, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*some)], [*PAIR, "prev_path", "path"])


def _assign_small(edges: DataFrame, olds: DataFrame, news: DataFrame) -> DataFrame:
    """All release pairs at once, sorted: a group of its own for each of very many small
    pairs would cost several times its assignment."""

    def events(df: DataFrame, kind: str, left: str, right: str) -> DataFrame:
        return df.select(
            *PAIR, F.lit(kind).alias("kind"), F.col(left).alias("left"), F.col(right).alias("right")
        )

    rows = (
        events(edges, "edge", "old_class", "new_class")
        .unionByName(events(olds, "old", "path", "old_class"))
        .unionByName(events(news, "new", "path", "new_class"))
    )
    ordered = rows.repartition(*PAIR).sortWithinPartitions(*PAIR, "kind", "left", "right")
    return ordered.mapInArrow(_assign_groups, _EVENT)


def _round(edges: DataFrame, olds: DataFrame, news: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One relational round: (old files that are settled, matches among them).

    An old file is safe once no old file of another class that could reach one of
    its new classes comes before it. Safe files of a class take the first new
    files open to the class, by rank. The first open old file of a release pair is
    always safe, so every round makes progress.
    """
    heads = olds.groupBy(*PAIR, "old_class").agg(F.min("path").alias("head"))
    live = edges.join(heads, [*PAIR, "old_class"])
    first = live.groupBy(*PAIR, "new_class").agg(F.min(F.struct("head", "old_class")).alias("lead"))
    led = live.join(first, [*PAIR, "new_class"])
    second = led.where("old_class != lead.old_class").groupBy(*PAIR, "new_class").agg(F.min("head").alias("runner_up"))
    rivals = led.join(second, [*PAIR, "new_class"], "left").withColumn(
        "rival", F.when(F.col("old_class") != F.col("lead.old_class"), F.col("lead.head")).otherwise(F.col("runner_up"))
    )
    limits = rivals.groupBy(*PAIR, "old_class").agg(F.min("rival").alias("limit"))
    safe = stage(
        olds.join(limits, [*PAIR, "old_class"]).where("limit is null or path < limit").drop("limit"), "safe"
    )
    wanted = safe.groupBy(*PAIR, "old_class").agg(F.count("*").alias("wanted"))
    asked = edges.join(wanted, [*PAIR, "old_class"])
    shelf = rank_within(news, [*PAIR, "new_class"], "path", "place")
    offers = asked.join(shelf, [*PAIR, "new_class"]).where("place <= wanted").select(*PAIR, "old_class", "path")
    offers = rank_within(offers, [*PAIR, "old_class"], "path", "place")
    takers = rank_within(safe, [*PAIR, "old_class"], "path", "place").withColumnRenamed("path", "prev_path")
    matched = takers.join(offers, [*PAIR, "old_class", "place"]).select(*PAIR, "prev_path", "path")
    return safe, stage(matched, "matched")


def _prune(edges: DataFrame, olds: DataFrame, news: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keep class pairs with files on both sides, and files with a class pair."""

    def known(rows: DataFrame, side: str) -> DataFrame:
        return rows.select(*PAIR, f"{side}_class").distinct().hint("merge")

    edges = edges.join(known(olds, "old"), [*PAIR, "old_class"], "left_semi")
    edges = edges.join(known(news, "new"), [*PAIR, "new_class"], "left_semi")
    edges = stage(edges.select(*PAIR, "old_class", "new_class"), "edges")
    olds = olds.join(known(edges, "old"), [*PAIR, "old_class"], "left_semi")
    news = news.join(known(edges, "new"), [*PAIR, "new_class"], "left_semi")
    return edges, stage(olds, "olds"), stage(news, "news")


def assign(edges: DataFrame, olds: DataFrame, news: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One-to-one assignment (PAIR, prev_path, path), whatever the size of a pair."""
    results = None
    while True:
        edges, olds, news = _prune(edges, olds, news)
        sizes = (
            edges.select(*PAIR).unionByName(olds.select(*PAIR)).unionByName(news.select(*PAIR))
            .groupBy(*PAIR).agg(F.count("*").alias("n"))
        )
        large = stage(sizes.where(F.col("n") > group_rows).select(*PAIR), "large")
        if large.isEmpty():
            small = _assign_small(edges, olds, news)
            return small if results is None else results.unionByName(small)

        def split(df: DataFrame, how: str) -> DataFrame:
            return df.join(large, PAIR, how)

        small = _assign_small(*(split(df, "left_anti") for df in (edges, olds, news)))
        edges, olds, news = (split(df, "left_semi") for df in (edges, olds, news))
        settled, matched = _round(edges, olds, news)
        for part in (small, matched):
            results = part if results is None else results.unionByName(part)
        olds = olds.join(settled, [*PAIR, "path"], "left_anti")
        news = news.join(matched, [*PAIR, "path"], "left_anti")


def match_renamed(
    old: DataFrame,
    new: DataFrame,
    exact: DataFrame | None = None,
    exact_first: bool = True,
    tie_self: bool = False,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Renamed files (PAIR, prev_path, path) among left-over files.

    ``old`` and ``new`` hold PAIR, path and ``names``, the method names of the file.

    ``exact_first=False`` also offers new files whose partner of the same path is a
    later old file; pass those matched new files, with names, as ``exact``. One new
    file may then be mapped twice. ``tie_self`` as in ``shared_method_ratio``.
    """
    columns = [*PAIR, "path", "names"]
    old, new = old.select(*columns), new.select(*columns)
    if not exact_first:
        new = new.withColumn("claimed", F.lit(False)).unionByName(
            exact.select(*columns).withColumn("claimed", F.lit(True))
        )
    olds = stage(_classes(old, "old", not exact_first), "leftover")
    news = stage(_classes(new, "new", not exact_first), "leftover")
    return assign(
        acceptable_classes(olds, news, tie_self),
        olds.select(*PAIR, "path", "old_class"),
        news.select(*PAIR, "path", "new_class"),
        group_rows,
    )
