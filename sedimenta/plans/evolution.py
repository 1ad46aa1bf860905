"""From releases and their source files to change records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators import files as file_ops
from sedimenta.operators.catalog import initial_releases, present_releases, release_pairs
from sedimenta.operators.records import file_diff, initial_files, nest_records
from sedimenta.operators.renames import match_renamed
from sedimenta.operators.units import extract_units, file_versions, with_units
from sedimenta.session import stage


def with_method_names(files: DataFrame, units: DataFrame) -> DataFrame:
    """Attach ``names``, the method names of a file; empty where none are known."""
    names = units.select("content_sha", F.transform("methods", lambda m: m["name"]).alias("names"))
    joined = files
    joined = with_units(joined, names, "names")
    return joined.withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def release_diffs(
    pairs: DataFrame,
    files: DataFrame,
    units: DataFrame,
    exact_first: bool = True,
    tie_self: bool = False,
) -> DataFrame:
    """Light file rows of every release pair: mapped, renamed, removed, added."""
    old, new = file_ops.pair_sides(pairs, files)
    compared = stage(file_ops.compare_paths(old, new), "compared")
    exact = None
    if not exact_first:
        matched = file_ops.match_exact(compared).select(*file_ops.PAIR, "path", "new.content_sha")
        exact = with_method_names(matched, units)
    renamed = match_renamed(
        with_method_names(file_ops.leftovers(compared, "old"), units),
        with_method_names(file_ops.leftovers(compared, "new"), units),
        exact,
        exact_first,
        tie_self,
    )
    renamed = stage(renamed, "renamed")
    return file_diff(compared, renamed, file_ops.unmatched(compared, renamed))


def change_records(
    releases: DataFrame,
    source_files: DataFrame,
    *,
    order_by: str = "release_seq",
    present: DataFrame | None = None,
    require_next: bool = False,
    emit_single: bool = False,
    exact_first: bool = True,
    tie_self: bool = False,
    signature_change_exclusive: bool = True,
    byte_offsets: bool = False,
) -> DataFrame:
    """Change records of all repositories.

    ``releases``: repository, repository_name, branch (slug), date, release_seq.
    ``source_files``: repository_name, branch, path, content.
    ``present``: repository_name, branch of the releases whose sources exist; by default
    those with any file, Python or not. A release without Python files is present.

    The first release of a repository is listed in full if it is present, whatever
    became of the next one; ``emit_single`` also lists a repository's only release.
    A present release whose next one is absent loses all its files to it, unless
    ``require_next`` asks for both.

    Parsed units and the light file tables are written to the shared folder, since
    later steps read them several times; texts are read from the source once for
    parsing and once for hashing.
    """
    python = source_files.where(F.col("path").endswith(".py"))
    files = stage(file_versions(python), "files")
    units = stage(extract_units(python, byte_offsets), "units")
    present = source_files if present is None else present
    present = stage(present.select("repository_name", "branch").distinct(), "present")
    paired = stage(release_pairs(releases, order_by), "paired")
    first = initial_releases(releases, paired, present, emit_single)
    pairs = stage(present_releases(paired, present, require_next), "pairs")
    diffs = stage(release_diffs(pairs, files, units, exact_first, tie_self), "diffs")
    return nest_records(diffs, initial_files(first, files), pairs, units, signature_change_exclusive)
