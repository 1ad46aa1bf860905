"""Cleaning the release catalogue and pairing contiguous releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.functions.names import branch_slug, has_version, release_date, repo_name, version_token
from sedimenta.schemas import CATALOG_COLUMNS
from sedimenta.sources.catalog import MISSING

# Parts of a catalogue line that mark a row as junk.
JUNK_PARTS = (",,,,", "/dependabot/", "/pull/")

# Rows of one repository that share a window task when releases are paired.
_CHUNK = 1 << 16


def _line() -> Column:
    return F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in CATALOG_COLUMNS])


def drop_pull_requests(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(F.col("branch"), F.lit("")).contains("pull"))


def drop_junk_rows(df: DataFrame) -> DataFrame:
    """Drop rows with no release, bot branches and pull requests.

    A row with no release has either empty fields or the literal placeholder.
    """
    line = _line()
    keep = F.col("branch").isNotNull() & (F.col("branch") != MISSING)
    for part in JUNK_PARTS:
        keep = keep & ~line.contains(part)
    return df.where(keep)


def clean_catalog(df: DataFrame) -> DataFrame:
    return drop_junk_rows(drop_pull_requests(df))


def filter_versions(df: DataFrame, version_only: bool = True) -> DataFrame:
    """Keep branches that carry a version; ``version_only=False`` keeps all."""
    return df.where(has_version(F.col("branch"))) if version_only else df


def dedup_versions(df: DataFrame) -> DataFrame:
    """First row, by ``release_seq``, of each (repository, version).

    Rows without a version form one group per repository. An aggregate rather
    than a window: it combines before the shuffle, so a large group stays cheap.
    """
    rows = df.withColumn("version", version_token(F.col("branch")))
    payload = F.struct(*[F.col(c) for c in df.columns])
    first = rows.groupBy("repository", "version").agg(F.min_by(payload, "release_seq").alias("row"))
    return first.select("row.*", "version")


def flag_duplicated_versions(df: DataFrame) -> DataFrame:
    """Add ``version`` and ``duplicated``: whether its (repository, version) recurs."""
    rows = df.withColumn("version", version_token(F.col("branch")))
    counts = rows.groupBy("repository", "version").agg((F.count("*") > 1).alias("duplicated"))
    same = rows["repository"].eqNullSafe(counts["repository"]) & rows["version"].eqNullSafe(counts["version"])
    return rows.join(counts, same).select(rows["*"], counts["duplicated"])


def distinct_repositories(df: DataFrame) -> DataFrame:
    return df.select("repository").distinct()


def empty_snapshots(snapshots: DataFrame) -> DataFrame:
    """Repositories whose snapshot is missing or lists no branch."""
    return snapshots.where(F.col("branches").isNull() | (F.size("branches") == 0)).select("repository")


def resolve_targets(snapshots: DataFrame, release_targets: DataFrame, version_only: bool = True) -> DataFrame:
    """Root directory, name and date of every branch of every snapshot.

    On hosts that keep release objects a version branch points to a release,
    which is followed to its own target first. List-valued responses are dropped.
    """
    branches = snapshots.select(
        "repository", F.explode("branches").alias("branch", "target")
    ).select("repository", "branch", "target.target_type", "target.target_url")
    branches = filter_versions(drop_pull_requests(branches), version_only)

    hosted = F.col("repository").contains("github.com") | F.col("repository").contains("gitlab")
    via_release = hosted & has_version(F.col("branch")) & (F.col("target_type") == "release")
    branches = branches.withColumn("via_release", F.coalesce(via_release, F.lit(False)))

    # The flag sits in the join condition, not in a nulled key, so rows that need
    # no lookup stay spread over their own URLs.
    links = release_targets.select(F.col("target_url").alias("link_from"), "target_link")
    followed = branches.join(
        links, (F.col("target_url") == F.col("link_from")) & F.col("via_release"), "left"
    ).select(
        "repository",
        "branch",
        F.when(F.col("via_release"), F.col("target_link")).otherwise(F.col("target_url")).alias("target_url"),
    )

    roots = release_targets.where(~F.col("is_list")).select(
        "target_url",
        F.coalesce("target", "directory").alias("root"),
        F.coalesce("name", F.lit(MISSING)).alias("name"),
        F.coalesce("date", F.lit(MISSING)).alias("date"),
    )
    return followed.join(roots, "target_url").where("root is not null").select(
        "repository", "branch", "root", "name", "date"
    )


def name_releases(df: DataFrame, last_segment_hosts: tuple[str, ...] = ("github", "gitlab")) -> DataFrame:
    """Add repository_name, turn branch into its slug and date into a timestamp."""
    return df.withColumns(
        {
            "repository_name": repo_name(F.col("repository"), last_segment_hosts),
            "branch": branch_slug(F.col("branch")),
            "date": release_date(F.col("date")),
        }
    ).drop("download_link", "name")


def pending_downloads(releases: DataFrame, archives: DataFrame) -> DataFrame:
    """Releases whose (repository_name, branch) has no archive yet."""
    return releases.join(archives.select("repository_name", "branch"), ["repository_name", "branch"], "left_anti")


def release_pairs(releases: DataFrame, order_by: str = "release_seq") -> DataFrame:
    """Each release of a repository with the next one.

    ``release_idx`` is the 0-based place of the *previous* release; 0 marks the
    initial one. ``order_by`` is "release_seq" (catalogue order) or "date".

    One repository may hold a large share of all rows, so a window per repository
    could put them in one task. Releases are therefore cut into chunks by their
    order value; only one summary row per chunk meets in the per-repository window.
    """
    if order_by == "date":
        # Dates may tie or be missing, so the catalogue order breaks ties.
        chunk = F.coalesce(F.unix_timestamp("date"), F.lit(-(1 << 40)))
        chunk = F.floor(chunk / F.lit(86400 * 30))
        order = F.struct("date", "release_seq")
    else:
        chunk = F.floor(F.col("release_seq") / F.lit(_CHUNK))
        order = F.struct("release_seq")
    rows = releases.select(
        "repository", "repository_name", "branch", "date",
        chunk.alias("chunk"), order.alias("order"),
    )
    following = F.struct("branch", "date", "repository")
    within = W.partitionBy("repository_name", "chunk").orderBy("order")
    local = rows.withColumns(
        {
            "next_in_chunk": F.lead(following).over(within),
            "place": F.row_number().over(within) - 1,
        }
    )
    summary = rows.groupBy("repository_name", "chunk").agg(
        F.min_by(following, "order").alias("head"), F.count("*").alias("n")
    )
    across = W.partitionBy("repository_name").orderBy("chunk")
    summary = summary.select(
        "repository_name",
        "chunk",
        F.lead("head").over(across).alias("next_head"),
        F.coalesce(
            F.sum("n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    paired = local.join(summary, ["repository_name", "chunk"]).withColumn(
        "next", F.coalesce("next_in_chunk", "next_head")
    )
    return paired.where("next is not null").select(
        F.col("next.repository").alias("repository"),
        "repository_name",
        F.col("branch").alias("prev_branch"),
        F.col("next.branch").alias("branch"),
        F.col("next.date").alias("date"),
        F.col("repository").alias("prev_repository"),
        F.col("date").alias("prev_date"),
        (F.col("before") + F.col("place")).cast("long").alias("release_idx"),
    )


def initial_releases(
    releases: DataFrame, pairs: DataFrame, releases_present: DataFrame, emit_single: bool = False
) -> DataFrame:
    """The first release of each repository that has a next one, if its sources exist.

    ``pairs`` are all pairs, before any is left out for missing sources. With
    ``emit_single`` a repository's only release counts as well.
    """
    first = pairs.where("release_idx = 0").select(
        F.col("prev_repository").alias("repository"),
        "repository_name",
        F.col("prev_branch").alias("branch"),
        F.col("prev_date").alias("date"),
    )
    if emit_single:
        payload = F.struct("repository", "branch", "date")
        alone = releases.groupBy("repository_name").agg(F.count("*").alias("n"), F.min_by(payload, "release_seq").alias("r"))
        alone = alone.where("n = 1").select("r.repository", "repository_name", "r.branch", "r.date")
        first = first.unionByName(alone)
    present = releases_present.select("repository_name", "branch").distinct()
    return first.join(present, ["repository_name", "branch"], "left_semi")


def present_releases(pairs: DataFrame, releases_present: DataFrame, require_next: bool = False) -> DataFrame:
    """Pairs whose previous release has sources: without those of the next one all its
    files count as removed. ``require_next=True`` asks for both."""
    present = releases_present.select("repository_name", "branch").distinct()
    previous = present.withColumnRenamed("branch", "prev_branch")
    kept = pairs.join(previous, ["repository_name", "prev_branch"], "left_semi")
    return kept.join(present, ["repository_name", "branch"], "left_semi") if require_next else kept
