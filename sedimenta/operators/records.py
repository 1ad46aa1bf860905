"""Nested change records from aligned files, methods and calls.

What changed inside a file depends on its two texts only, not on where the file
lies. Methods and calls are therefore aligned once per distinct pair of contents
(old_sha, new_sha); files, releases and copies that share the pair share the work.
Equal contents need no alignment: every unit maps to itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.ids import call_id, file_id, method_id
from sedimenta.operators.calls import compare_methods, compared
from sedimenta.operators.files import PAIR
from sedimenta.operators.methods import align_methods
from sedimenta.operators.units import by_content, render_imports, with_units
from sedimenta.schemas import CALL_CHANGE, CALL_PLACES, CHANGES, METHOD_CHANGE, STATISTICS
from sedimenta.session import stage

CONTENTS = ["old_sha", "new_sha"]


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def _no_statistics() -> Column:
    return F.lit(None).cast(STATISTICS)


def _unchanged() -> Column:
    return F.struct(F.lit(1.0).alias("ratio"), F.lit(0).alias("dist"))


def call_record(call: Column, mapping: Column, status: Column, stats: Column) -> Column:
    return F.struct(
        call_id(call["expression"], call["start_offset"], call["end_offset"]).alias("id"),
        *[call[f].alias(f) for f in ("name", "context", "expression", "start_offset", "end_offset", "lineno")],
        mapping.alias("mapping"),
        status.alias("status"),
        stats.alias("statistics"),
    ).cast(CALL_CHANGE)


def _own_method_id(method: Column) -> Column:
    return method_id(method["class"], method["name"], method["params"])


def method_record(method: Column, mapping: Column, status: Column, stats: Column, calls: Column) -> Column:
    return F.struct(
        _own_method_id(method).alias("id"),
        *[method[f].alias(f) for f in ("class", "name", "params", "content")],
        mapping.alias("mapping"),
        status.alias("status"),
        stats.alias("statistics"),
        calls.alias("function_calls"),
    ).cast(METHOD_CHANGE)


def _listed_calls(calls: Column) -> Column:
    return F.transform(calls, lambda c: call_record(c, _text(None), _text(None), _no_statistics()))


def _kept_calls(calls: Column) -> Column:
    return F.transform(
        calls,
        lambda c: call_record(
            c, call_id(c["expression"], c["start_offset"], c["end_offset"]), _text("mapped"), _unchanged()
        ),
    )


def listed_methods(methods: Column) -> Column:
    """Methods of a file shown as it is: no mapping, no statistics."""
    return F.transform(
        methods,
        lambda m: method_record(m, _text(None), _text(None), _no_statistics(), _listed_calls(m["calls"])),
    )


def kept_methods(methods: Column) -> Column:
    """Methods of a file whose content did not change: each maps to itself.

    A repeated identity is claimed by its first occurrence and vanishes.
    """
    return F.transform(
        F.filter(methods, lambda m: ~m["repeated"]),
        lambda m: method_record(m, _own_method_id(m), _text("mapped"), _unchanged(), _kept_calls(m["calls"])),
    )


def changed_contents(mapped: DataFrame) -> DataFrame:
    """Distinct pairs of different contents among mapped files."""
    differ = F.col("old_sha") != F.col("new_sha")
    return mapped.where(differ).select(*CONTENTS).distinct()


def aligned_methods(
    sides: DataFrame,
    signature_change_exclusive: bool = True,
    all_calls: bool = False,
    texts: bool = True,
    calls: str = "scored",
) -> DataFrame:
    """Aligned and scored methods of two versions of a file, in the row that holds both.

    ``sides`` have the method lists ``olds`` and ``news``; in their place comes
    ``aligned``, an array of (status, match, old_ord, new_ord, old, new, statistics,
    calls), old methods in their order before added ones in theirs. Calls are those of
    ``compare_methods``. Nothing is exploded, grouped again or shuffled.
    """
    rest = [c for c in sides.columns if c not in ("olds", "news")]
    places = sides.withColumn("places", align_methods(F.col("olds"), F.col("news"), signature_change_exclusive))
    fields = ("status", "match", "old_ord", "new_ord")
    pairs = places.select(
        *rest,
        F.transform(
            "places",
            lambda p: F.struct(
                *(p[x].alias(x) for x in fields),
                F.get("olds", p["old_ord"]).alias("old"),
                F.get("news", p["new_ord"]).alias("new"),
            ),
        ).alias("pairs"),
    )
    scored = pairs.withColumn("scores", compare_methods(F.col("pairs"), all_calls, texts, calls))
    sent = F.transform("pairs", lambda pair, at: F.when(compared(pair, all_calls), at))
    scored = scored.withColumn("sent", F.filter(sent, lambda at: at.isNotNull()))

    def with_score(pair: Column, at: Column) -> Column:
        score = F.get("scores", (F.array_position("sent", at) - 1).cast("int"))
        return F.struct(pair.alias("pair"), score.alias("score"))

    def finished(both: Column) -> Column:
        pair, score = both["pair"], both["score"]
        stats = _score(score)
        if texts:
            stats = F.when(pair["old"]["content"] == pair["new"]["content"], _unchanged()).otherwise(stats)
        return F.struct(
            *(pair[x].alias(x) for x in (*fields, "old", "new")),
            stats.cast(STATISTICS).alias("statistics"),
            F.coalesce(score["calls"], F.array().cast(CALL_PLACES)).alias("calls"),
        )

    return scored.select(*rest, F.transform(F.transform("pairs", with_score), finished).alias("aligned"))


def _score(scored: Column) -> Column:
    """Statistics struct of scores; null where nothing was scored."""
    return F.when(scored["ratio"].isNotNull(), F.struct(scored["ratio"].alias("ratio"), scored["dist"].alias("dist")))


def _aligned_calls(method: Column) -> Column:
    def record(found: Column) -> Column:
        old = F.get(method["old"]["calls"], found["old_at"])
        new = F.get(method["new"]["calls"], found["new_at"])
        own = call_id(old["expression"], old["start_offset"], old["end_offset"])
        mapping = F.when(found["status"] == "mapped", own).otherwise(found["status"])
        return call_record(F.coalesce(new, old), mapping, found["status"], _score(found).cast(STATISTICS))

    return F.transform(method["calls"], record)


def content_changes(contents: DataFrame, units: DataFrame, signature_change_exclusive: bool = True) -> DataFrame:
    """Method records, nested, and the new imports of each pair of different contents.

    Each side's units are joined once; everything else happens inside the row. The
    sides are tables at rest, so that the shuffles of one join are gone in the next.
    """
    olds = units.select(F.col("content_sha").alias("old_sha"), F.col("methods").alias("olds"))
    news = units.select(F.col("content_sha").alias("new_sha"), F.col("methods").alias("news"), "imports")
    one = stage(contents.join(by_content(olds), "old_sha"), "olds")
    sides = stage(one.join(by_content(news), "new_sha"), "sides")
    aligned = aligned_methods(sides, signature_change_exclusive)

    def record(method: Column) -> Column:
        is_mapped = method["status"] == "mapped"
        same_text = is_mapped & (method["old"]["content"] == method["new"]["content"])
        shown = F.coalesce(method["new"], method["old"])
        function_calls = (
            F.when(same_text, _kept_calls(method["new"]["calls"]))
            .when(is_mapped, _aligned_calls(method))
            .otherwise(_listed_calls(shown["calls"]))
        )
        mapping = F.when(is_mapped, _own_method_id(method["old"])).otherwise(method["status"])
        return method_record(shown, mapping, method["status"], method["statistics"], function_calls)

    return aligned.select(*CONTENTS, "imports", F.transform("aligned", record).alias("changed_methods"))


def file_diff(compared: DataFrame, renamed: DataFrame, unmatched: DataFrame) -> DataFrame:
    """One light row per file of a release diff.

    Columns PAIR, path, prev_path, status, old_sha, new_sha: the shown file is the
    new one where there is one.
    """
    exact = compared.where("status = 'mapped'").select(
        *PAIR, "path", F.col("path").alias("prev_path"), "status",
        F.col("old.content_sha").alias("old_sha"), F.col("new.content_sha").alias("new_sha"),
    )
    # A renamed file's old side is always left over; its new one may have a partner of the same path.
    olds = compared.where("status = 'removed'").select(*PAIR, F.col("path").alias("prev_path"), F.col("old.content_sha").alias("old_sha"))
    news = compared.select(*PAIR, "path", F.col("new.content_sha").alias("new_sha"))
    moved = (
        renamed.join(olds, [*PAIR, "prev_path"])
        .join(news, [*PAIR, "path"])
        .select(*PAIR, "path", "prev_path", F.lit("mapped").alias("status"), "old_sha", "new_sha")
    )
    lone = unmatched.select(
        *PAIR, "path", _text(None).alias("prev_path"), "status",
        F.col("old.content_sha").alias("old_sha"), F.col("new.content_sha").alias("new_sha"),
    )
    return exact.unionByName(moved).unionByName(lone)


def initial_files(first: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the first release of each repository."""
    return first.join(files, ["repository_name", "branch"])


def nest_records(
    diffs: DataFrame,
    initial: DataFrame,
    pairs: DataFrame,
    units: DataFrame,
    signature_change_exclusive: bool = True,
    changes: DataFrame | None = None,
) -> DataFrame:
    """Change records: the initial listing and every release diff.

    ``diffs`` are rows of ``file_diff``, ``initial`` those of ``initial_files``.
    ``changes`` are rows of ``content_changes`` that were computed before.
    """
    dates = pairs.select(*PAIR, "repository", "date")
    diffs = diffs.join(dates, PAIR)
    shown_sha = F.coalesce("new_sha", "old_sha")
    base = ["repository", *PAIR, "date", "path", "prev_path", "status"]
    start = initial.select(
        "repository", "repository_name", _text(None).alias("prev_branch"), "branch", "date", "path",
        _text(None).alias("prev_path"), F.lit("initial").alias("status"),
        F.lit(None).cast("string").alias("old_sha"), F.col("content_sha").alias("new_sha"),
    )
    # Both-unreadable files count as unchanged, one-sided ones have nothing to align.
    altered = (F.col("status") == "mapped") & F.coalesce(F.col("old_sha") != F.col("new_sha"), F.lit(False))
    whole = diffs.where(~altered).select(*base, "old_sha", "new_sha").unionByName(start)
    same = (F.col("status") == "mapped") & F.col("old_sha").eqNullSafe(F.col("new_sha"))
    whole = with_units(
        whole.select(*base, shown_sha.alias("content_sha"), same.alias("same")), units, "methods", "imports"
    )
    whole = stage(whole, "whole")
    parts = diffs.where(altered).select(*base, *CONTENTS)
    if changes is None:
        contents = changed_contents(diffs.where("status = 'mapped'"))
        changes = stage(content_changes(contents, units, signature_change_exclusive), "changes")
    parts = parts.join(by_content(changes), CONTENTS, "left")

    def finish(rows: DataFrame, methods: Column) -> DataFrame:
        own = file_id(F.col("path"))
        mapping = F.when(F.col("status") == "mapped", own).when(F.col("status") != "initial", F.col("status"))
        empty = F.array().cast(CHANGES["methods"].dataType)
        return rows.select(
            "repository", "repository_name", "branch", "prev_branch", "date",
            own.alias("id"), "path", mapping.alias("mapping"), "status", "prev_path",
            F.coalesce(render_imports(F.col("imports")), F.array().cast("array<string>")).alias("imports"),
            F.coalesce(methods, empty).alias("methods"),
        )

    listed = F.when(F.col("same"), kept_methods(F.col("methods"))).otherwise(listed_methods(F.col("methods")))
    return finish(whole, listed).unionByName(finish(parts, F.col("changed_methods")))
