"""Registered queries: every operator on whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.bindings import history as h
from sedimenta.bindings import landed
from sedimenta.functions import ids, names, text
from sedimenta.operators import catalog as catalog_ops
from sedimenta.operators import files as file_ops
from sedimenta.operators import records, scoring, stats, units
from sedimenta.operators.files import PAIR
from sedimenta.operators.methods import align_methods
from sedimenta.operators.renames import match_renamed
from sedimenta.plans.evolution import change_records as build_change_records
from sedimenta.plans.incremental import History
from sedimenta.plans.release_catalog import cleaned_catalog
from sedimenta.session import stage
from sedimenta.sources import catalog as catalog_io
from sedimenta.sources import changes as changes_io
from sedimenta.sources import requirements as requirements_io
from sedimenta.sources import trees

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FILE = h.FILE
FILE_PAIR = [*PAIR, "path"]
CATALOG = ["repository", "branch", "download_link", "name", "date", "release_seq"]


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _params(column: str = "params") -> Column:
    return F.array_join(column, " ").alias("params")


# -- sources and sinks -------------------------------------------------------


@register
def scan_repositories(spark, sf):
    folder = landed.fresh_folder(spark, "repositories")
    h.pages_repositories(spark, sf).select(F.concat(F.lit("  "), "repository")).write.text(folder)
    return catalog_io.read_repositories(spark, folder)


@register
def scan_catalog(spark, sf):
    folder = landed.fresh_folder(spark, "catalog")
    catalog_io.write_catalog(h.orders_catalog(spark, sf), folder)
    return catalog_io.read_catalog(spark, folder, has_seq=True)


@register
def scan_catalog_parts(spark, sf):
    """A catalogue in several files that do not say where their rows belong."""
    folder = landed.fresh_folder(spark, "catalog")
    ordered = h.orders_catalog(spark, sf).repartitionByRange(7, "release_seq").sortWithinPartitions("release_seq")
    catalog_io.write_catalog(ordered.drop("release_seq"), folder)
    return catalog_io.read_catalog(spark, folder)


@register
def catalog_with_missing(spark, sf):
    customers = h.table(spark, sf, "customer").select(
        F.concat(F.lit("https://github.com/forge/cust-"), F.col("c_custkey").cast("string")).alias("repository")
    )
    cleaned = catalog_ops.clean_catalog(h.orders_catalog(spark, sf)).drop("release_seq")
    return catalog_io.catalog_with_missing(customers, cleaned)


@register
def scan_source_tree(spark, sf):
    root = landed.fresh_folder(spark, "tree")
    releases = landed.land_tree(landed.document_tree(spark, sf), root)
    return trees.read_source_tree(releases, root)


@register
def expand_archives(spark, sf):
    root = landed.fresh_folder(spark, "archives")
    releases = landed.land_archives(landed.document_tree(spark, sf), root)
    return trees.expand_archives(releases, root)


def _row_changes(spark, sf) -> DataFrame:
    """Initial listings of every release, as change records, straight from the rows."""
    nested = h.history_files(spark, sf, "class", "name", "params", "content", "calls")
    no_text = F.lit(None).cast("string")
    return nested.select(
        F.concat(F.lit("https://github.com/forge/"), "repository_name").alias("repository"),
        "repository_name", "branch", no_text.alias("prev_branch"),
        F.to_timestamp(F.concat(F.substring("branch", -4, 4), F.lit("-06-30 12:00:00"))).alias("date"),
        ids.file_id(F.col("path")).alias("id"), "path", no_text.alias("mapping"),
        F.lit("initial").alias("status"), no_text.alias("prev_path"),
        F.array(F.lit("import numpy as np")).alias("imports"),
        records.listed_methods(F.col("methods")).alias("methods"),
    )


def _flat_changes(changes: DataFrame) -> DataFrame:
    rows = changes.select(
        *FILE, "status", names.date_text(F.col("date")).alias("date"),
        F.array_join("imports", ";").alias("imports"), F.posexplode("methods").alias("place", "m"),
    )
    return rows.select(
        *FILE, "status", "date", "imports", F.col("place").cast("long"), "m.class", "m.name",
        _params("m.params"), "m.content", F.size("m.function_calls").cast("long").alias("n_calls"),
    )


@register
def write_changes(spark, sf):
    folder = landed.fresh_folder(spark, "changes")
    changes_io.write_changes(_row_changes(spark, sf), folder)
    return _flat_changes(changes_io.read_changes(spark, folder))


@register
def scan_changes(spark, sf):
    folder = landed.fresh_folder(spark, "changes")
    changes_io.write_changes(_row_changes(spark, sf), folder, "parquet", gathered=False)
    return changes_io.read_changes(spark, folder, "parquet").groupBy("repository_name", "branch").agg(
        F.count("*").alias("n_files"), F.sum(F.size("methods")).alias("n_methods")
    )


@register
def requirements(spark, sf):
    lines = requirements_io.requirement_lines(h.requirement_files(spark, sf))
    parsed = requirements_io.parse_requirements(lines)
    specs = F.array_join(F.transform("specs", lambda s: F.concat(s["op"], s["version"])), ",")
    return parsed.select("repository_name", "branch", "name", specs.alias("specs"), F.col("line_no").cast("long"))


@register
def requirement_maps(spark, sf):
    """Maps of requirements with direct references, extras, markers and comments."""
    lines = requirements_io.requirement_lines(h.part_requirements(spark, sf))
    maps = requirements_io.requirement_maps(requirements_io.parse_requirements(lines))

    def shown(entry: Column) -> Column:
        return F.concat(entry["key"], F.array_join(F.transform(entry["value"], lambda s: F.concat(s["op"], s["version"])), ","))

    listed = F.array_join(F.transform(F.map_entries("requirements"), shown), ";")
    return maps.select("branch", F.size("requirements").cast("long").alias("n"), listed.alias("requirements"))


# -- scalar functions --------------------------------------------------------


@register
def repo_name(spark, sf):
    url = F.col("repository")
    return h.pages_repositories(spark, sf).select(
        "page_id",
        names.repo_name(url).alias("repository_name"),
        names.repo_name(url, ("github",)).alias("narrow_name"),
    )


@register
def branch_slug(spark, sf):
    return h.orders_catalog(spark, sf).select(
        "release_seq", names.branch_slug(F.col("branch")).alias("branch")
    )


@register
def release_date(spark, sf):
    date = names.release_date(F.col("date"))
    return h.orders_catalog(spark, sf).select("release_seq", names.date_text(date).alias("date"))


@register
def version_token(spark, sf):
    return h.orders_catalog(spark, sf).select(
        "release_seq", names.version_token(F.col("branch")).alias("version")
    )


@register
def version_filter(spark, sf):
    return catalog_ops.filter_versions(h.orders_catalog(spark, sf)).select("release_seq", "branch")


@register
def relative_path(spark, sf):
    full = F.concat(F.lit("/data/"), "repository_name", F.lit("/"), "path")
    root = F.concat(F.lit("/data/"), "repository_name", F.lit("/"))
    files = landed.document_tree(spark, sf)
    return files.select("repository_name", "branch", names.relative_path(full, root).alias("path"))


@register
def basename(spark, sf):
    return landed.document_tree(spark, sf).select(
        "repository_name", "branch", "path", names.basename(F.col("path")).alias("name")
    )


@register
def unit_ids(spark, sf):
    """Ids are compared by what they keep apart: one id per identity and back."""
    methods = h.history_methods(spark, sf)
    identity = methods.select(
        "class", "name", _params(), ids.method_id(F.col("class"), F.col("name"), F.col("params")).alias("id"),
        ids.file_id(F.col("path")).alias("file_id"), "path",
    )
    return identity.groupBy("class", "name", "params").agg(
        F.count_distinct("id").alias("n_ids"),
        F.count_distinct("file_id").alias("n_file_ids"),
        F.count("*").alias("n_methods"),
    )


@register
def unit_ids_apart(spark, sf):
    """Identities, ids and pairs of both: equal numbers unless an id says too little or too much."""
    methods = h.history_methods(spark, sf)
    call = "calls.expression", "calls.start_offset", "calls.end_offset"
    calls = methods.select(F.explode("calls").alias("calls"))

    def counts(rows: DataFrame, kind: str, unit: Column, own: Column) -> DataFrame:
        found = rows.select(unit.alias("unit"), own.alias("own")).distinct()
        return found.agg(
            F.lit(kind).alias("kind"), F.count_distinct("unit").alias("n_units"),
            F.count_distinct("own").alias("n_ids"), F.count("*").alias("n_pairs"),
        )

    method = F.struct(F.coalesce("class", F.lit("-")), "name", "params")
    method_id = ids.method_id(F.col("class"), F.col("name"), F.col("params"))
    return (
        counts(methods, "method", method, method_id)
        .unionByName(counts(methods, "file", F.col("path"), ids.file_id(F.col("path"))))
        .unionByName(counts(calls, "call", F.struct(*call), ids.call_id(*map(F.col, call))))
    )


@register
def method_lines(spark, sf):
    rows = h.document_lines(spark, sf).select("doc_id", F.inline(text.numbered_lines(F.col("content"))))
    return _long(rows, "line_number")


@register
def strip_comments(spark, sf):
    return h.document_lines(spark, sf).select(
        "doc_id", text.strip_comments(F.col("content")).alias("source")
    )


@register
def line_count(spark, sf):
    return h.document_lines(spark, sf).select(
        "doc_id", text.line_count(F.col("content")).cast("long").alias("n_lines")
    )


@register
def edit_distance(spark, sf):
    return h.name_pairs(spark, sf).select(
        "p_partkey", text.edit_distance(F.col("a"), F.col("b")).cast("long").alias("distance")
    )


@register
def similarity_ratio(spark, sf):
    return h.name_pairs(spark, sf).select(
        "p_partkey", scoring.similarity_ratio(F.col("a"), F.col("b")).alias("ratio")
    )


def _file_names(spark, sf) -> DataFrame:
    files = h.history_files(spark, sf, "name")
    return files.select(*FILE, F.transform("methods", lambda m: m["name"]).alias("names"))


@register
def shared_method_ratio(spark, sf):
    both = file_ops.match_exact(_compared(spark, sf))
    sides = F.col("old.names"), F.col("new.names")
    return both.select(
        *FILE_PAIR,
        text.shared_method_ratio(*sides).alias("ratio"),
        text.shared_method_ratio(*sides, tie_self=True).alias("ratio_tie_self"),
    )


# -- code units --------------------------------------------------------------


def landed_sources(spark, sf, broken: bool = False) -> DataFrame:
    """The source table at rest: hashing and parsing read it separately."""
    return stage(h.history_sources(spark, sf, broken), "sources")


def _located(sources: DataFrame, *needed: str, byte_offsets: bool = False) -> DataFrame:
    """Units of distinct contents, put back to the files that hold them, still nested.

    ``needed`` are the fields of the methods to move, none of them for imports.
    """
    found = units.extract_units(sources, byte_offsets, needed or ("method_ord",))
    if needed:
        methods = F.transform("methods", lambda m: F.struct(*(m[f].alias(f) for f in needed)))
        found = found.select("content_sha", methods.alias("methods"))
    else:
        found = found.select("content_sha", "imports")
    return units.file_versions(sources).join(units.by_content(found), "content_sha").drop("content_sha")


def _located_methods(spark, sf, *needed: str) -> DataFrame:
    return units.extract_functions(_located(landed_sources(spark, sf), *needed))


def _located_imports(spark, sf) -> DataFrame:
    return units.extract_imports(_located(landed_sources(spark, sf)))


@register
def parse_status(spark, sf):
    sources = landed_sources(spark, sf, broken=True)
    status = units.parse_status(units.file_versions(sources), units.extract_units(sources))
    return _long(status, "n_methods", "n_imports")


@register
def extract_functions(spark, sf):
    rows = units.free_functions(_located_methods(spark, sf, "method_ord", "class", "name", "content"))
    return _long(rows, "method_ord").select(*FILE, "method_ord", "name", "content")


@register
def extract_methods(spark, sf):
    rows = units.class_methods(_located_methods(spark, sf, "method_ord", "class", "name", "content"))
    return _long(rows, "method_ord").select(*FILE, "method_ord", "class", "name", "content")


@register
def method_params(spark, sf):
    rows = _located_methods(spark, sf, "method_ord", "params", "repeated")
    return _long(rows, "method_ord").select(*FILE, "method_ord", _params(), "repeated")


@register
def extract_imports(spark, sf):
    rows = _located_imports(spark, sf)
    return _long(rows, "import_ord", "level").select(*FILE, "import_ord", "kind", "module", "level", "name", "alias")


@register
def render_imports(spark, sf):
    rows = _located_imports(spark, sf)
    return rows.groupBy("repository_name", "branch", "statement").agg(F.count("*").alias("n"))


def _located_calls(spark, sf) -> DataFrame:
    return units.extract_calls(_located_methods(spark, sf, "method_ord", "calls"))


@register
def extract_calls(spark, sf):
    rows = _long(_located_calls(spark, sf), "method_ord", "call_ord")
    return rows.select(*FILE, "method_ord", "call_ord", "name", "context", "expression")


@register
def call_offsets(spark, sf):
    rows = _long(_located_calls(spark, sf), "method_ord", "call_ord", "start_offset", "end_offset", "lineno")
    return rows.select(*FILE, "method_ord", "call_ord", "start_offset", "end_offset", "lineno")


@register
def import_kinds(spark, sf):
    """Relative imports, several names in a statement, and stars."""
    sources = stage(h.part_sources(spark, sf), "sources")
    rows = _long(units.extract_imports(_located(sources)), "import_ord", "level")
    return rows.select("path", "import_ord", "kind", "module", "level", "name", "alias", "statement")


@register
def call_offsets_behind_text(spark, sf):
    """Offsets in characters and in bytes, behind text that is not ASCII."""
    sources = stage(h.part_sources(spark, sf), "sources")

    def offsets(in_bytes: bool) -> DataFrame:
        methods = units.extract_functions(_located(sources, "calls", byte_offsets=in_bytes))
        rows = _long(units.extract_calls(methods), "call_ord", "start_offset", "end_offset")
        return rows.select("path", "call_ord", "expression", "start_offset", "end_offset", F.lit(in_bytes).alias("in_bytes"))

    return offsets(False).unionByName(offsets(True))


# -- catalogue ---------------------------------------------------------------


@register
def catalog_clean(spark, sf):
    return catalog_ops.clean_catalog(h.orders_catalog(spark, sf)).select(*CATALOG)


@register
def dedup_versions(spark, sf):
    return catalog_ops.dedup_versions(h.orders_catalog(spark, sf)).select(*CATALOG, "version")


@register
def duplicated_versions(spark, sf):
    return catalog_ops.flag_duplicated_versions(h.orders_catalog(spark, sf)).select(
        "release_seq", "version", "duplicated"
    )


@register
def distinct_repos(spark, sf):
    return catalog_ops.distinct_repositories(h.orders_catalog(spark, sf))


@register
def empty_snapshots(spark, sf):
    return catalog_ops.empty_snapshots(h.orders_snapshots(spark, sf, tags_only=True)[0])


@register
def resolve_targets(spark, sf):
    return catalog_ops.resolve_targets(*h.orders_snapshots(spark, sf), version_only=False)


@register
def cleaned_release_catalog(spark, sf):
    return cleaned_catalog(h.orders_catalog(spark, sf), version_only=True).select(*CATALOG, "version")


@register
def pending_downloads(spark, sf):
    """Releases of suppliers; those of half the years of a supplier are there already."""
    releases = catalog_ops.name_releases(h.history_releases(spark, sf))
    year = F.substring("branch", -4, 4).cast("int")
    there = releases.where((year + F.substring_index("repository_name", "-", -1).cast("int")) % 2 == 0)
    return catalog_ops.pending_downloads(releases, there).select("repository_name", "branch", "release_seq")


@register
def release_pairs(spark, sf):
    pairs = h.history_pairs(spark, sf)
    return pairs.select(
        "repository", *PAIR, "release_idx", names.date_text(F.col("date")).alias("date")
    )


@register
def release_pairs_by_date(spark, sf):
    """Dates that run against the catalogue's order, tie or are missing."""
    releases, year = h.history_releases(spark, sf), F.col("release_seq") % 10000
    moved = F.concat((2000 + year * 3 % 5).cast("string"), F.lit("-01-31 12:00:00"))
    releases = catalog_ops.name_releases(releases.withColumn("date", F.when(year % 4 > 0, moved)))
    pairs = catalog_ops.release_pairs(releases, order_by="date")
    return pairs.select(*PAIR, "release_idx", names.date_text(F.col("date")).alias("date"))


@register
def initial_releases_single(spark, sf):
    """Every third supplier has one release only; sources of one year are absent."""
    releases = catalog_ops.name_releases(h.history_releases(spark, sf))
    year, supplier = F.col("release_seq") % 10000, F.floor(F.col("release_seq") / 10000)
    releases = releases.where((supplier % 3 > 0) | (year == 1992 + supplier % 4))
    present = releases.where((year + supplier) % 5 > 0)
    found = catalog_ops.initial_releases(releases, catalog_ops.release_pairs(releases), present, emit_single=True)
    return found.select("repository", "repository_name", "branch")


@register
def present_releases(spark, sf):
    """Sources are present where a supplier shipped more than 70 items in the year."""
    counts = h.history_methods(spark, sf).groupBy("repository_name", "branch").count()
    pairs = h.history_pairs(spark, sf)
    both = catalog_ops.present_releases(pairs, counts.where("count > 70"), require_next=True)
    first = catalog_ops.present_releases(pairs, counts.where("count > 70"), require_next=False)
    return both.select(*PAIR, F.lit("both").alias("rule")).unionByName(
        first.select(*PAIR, F.lit("previous").alias("rule"))
    )


# -- alignment ---------------------------------------------------------------


def _compared(spark, sf) -> DataFrame:
    """Files of both releases by path; what both sides read is computed once."""
    pairs, files = stage(h.history_pairs(spark, sf), "pairs"), stage(_file_names(spark, sf), "names")
    return file_ops.compare_paths(*file_ops.pair_sides(pairs, files))


def _renamed(compared: DataFrame, **switches) -> DataFrame:
    return match_renamed(file_ops.leftovers(compared, "old"), file_ops.leftovers(compared, "new"), **switches)


@register
def file_match_exact(spark, sf):
    return file_ops.match_exact(_compared(spark, sf)).select(*FILE_PAIR)


@register
def file_match_renamed(spark, sf):
    return _renamed(stage(_compared(spark, sf), "compared"))


@register
def file_match_interleaved(spark, sf):
    """Renames when a new file whose own partner comes later is still open, ties on the old list."""
    compared = stage(_compared(spark, sf), "compared")
    exact = file_ops.match_exact(compared).select(*FILE_PAIR, "new.names")
    return _renamed(compared, exact=exact, exact_first=False, tie_self=True)


@register
def files_added_removed(spark, sf):
    compared = stage(_compared(spark, sf), "compared")
    return file_ops.unmatched(compared, _renamed(compared)).select(*FILE_PAIR, "status")


IDENTITY = ("class", "name", "params")


def _mapped_sides(
    spark, sf, renames: bool = False, fields: tuple[str, ...] = (*IDENTITY, "content"), call_fields: tuple[str, ...] = ()
) -> DataFrame:
    """Method lists ``olds`` and ``news`` of files with one path in both releases.

    With ``renames`` those of renamed files as well, under the new path. Methods have
    ``fields`` only, and their calls ``call_fields``. Files are mapped by their keys;
    methods move once to a file's partner and meet in a table at rest.
    """
    pairs = stage(h.history_pairs(spark, sf).select(*PAIR), "pairs")
    files = h.history_files(spark, sf, *fields, *(["calls"] if call_fields else []))
    if call_fields:
        calls = lambda m: F.transform(m["calls"], lambda c: F.struct(*(c[x].alias(x) for x in call_fields)))
        files = files.withColumn("methods", F.transform("methods", lambda m: m.withField("calls", calls(m))))
    files = stage(files, "methods")
    if renames:
        known = files.select(*FILE, F.transform("methods", lambda m: m["name"]).alias("names"))
    else:
        known = files.select(*FILE)
    compared = stage(file_ops.compare_paths(*file_ops.pair_sides(pairs, known)), "compared")
    keys = file_ops.match_exact(compared).select(*PAIR, F.col("path").alias("prev_path"), "path")
    if renames:
        keys = keys.unionByName(_renamed(compared).select(*PAIR, "prev_path", "path"))
    olds = files.toDF("repository_name", "prev_branch", "prev_path", "olds")
    one = stage(keys.join(olds.hint("merge"), ["repository_name", "prev_branch", "prev_path"]), "olds")
    both = one.join(files.withColumnRenamed("methods", "news").hint("merge"), FILE)
    return stage(both.select(*FILE_PAIR, "olds", "news"), "sides")


def _placed(sides: DataFrame, exclusive: bool = True) -> DataFrame:
    """Aligned methods by their places; neither texts nor calls are needed."""
    places = align_methods(F.col("olds"), F.col("news"), exclusive)
    return _long(sides.select(*FILE_PAIR, F.inline(places)), "old_ord", "new_ord")


def _aligned(sides: DataFrame, **switches: bool) -> DataFrame:
    aligned = records.aligned_methods(sides, **switches).select(*FILE_PAIR, F.inline("aligned"))
    return _long(aligned, "old_ord", "new_ord")


@register
def method_match_exact(spark, sf, renames: bool = False):
    found = _placed(_mapped_sides(spark, sf, renames, IDENTITY))
    return found.where("match = 'exact'").select(*FILE_PAIR, "old_ord", "new_ord")


@register
def method_match_signature(spark, sf, renames: bool = False):
    found = _placed(_mapped_sides(spark, sf, renames, IDENTITY))
    return found.where("match = 'signature'").select(*FILE_PAIR, "old_ord", "new_ord")


@register
def methods_added_removed(spark, sf, renames: bool = False):
    sides = _mapped_sides(spark, sf, renames, IDENTITY)

    def lone(exclusive: bool) -> DataFrame:
        rows = _placed(sides, exclusive).where("status in ('added', 'removed')")
        return rows.select(*FILE_PAIR, "status", "old_ord", "new_ord", F.lit(exclusive).alias("exclusive"))

    return lone(True).unionByName(lone(False))


@register
def method_diff(spark, sf, renames: bool = False):
    sides = _mapped_sides(spark, sf, renames, (*IDENTITY, "content"))
    scored = _aligned(sides, calls="left out").where("status = 'mapped'")
    return scored.select(
        *FILE_PAIR, "old_ord", "new_ord", "match", F.col("statistics.ratio").alias("ratio"),
        F.col("statistics.dist").cast("long").alias("dist"),
    )


def _aligned_calls(spark, sf, renames: bool, call_fields: tuple[str, ...]) -> DataFrame:
    """Calls of all mapped methods, each beside its method's place; scored if they have expressions."""
    sides = _mapped_sides(spark, sf, renames, IDENTITY, call_fields)
    calls = "scored" if "expression" in call_fields else "aligned"
    mapped = _aligned(sides, texts=False, all_calls=True, calls=calls).where("status = 'mapped'")
    rows = mapped.select(
        *FILE_PAIR, "old_ord", "new_ord", F.col("old.calls").alias("olds"), F.col("new.calls").alias("news"), F.inline("calls")
    )
    return rows.withColumns({"old": F.get("olds", F.col("old_at")), "new": F.get("news", F.col("new_at"))})


@register
def call_alignment(spark, sf, renames: bool = False):
    return _aligned_calls(spark, sf, renames, ("call_ord", "name", "context")).select(
        *FILE_PAIR, "old_ord", "new_ord", "status",
        F.col("old.call_ord").cast("long").alias("old_call"), F.col("new.call_ord").cast("long").alias("new_call"),
    )


@register
def call_diff(spark, sf, renames: bool = False):
    return _aligned_calls(spark, sf, renames, ("name", "context", "expression")).where("status = 'mapped'").select(
        *FILE_PAIR, "old_ord", "new_ord", F.col("old.expression").alias("old_expression"),
        F.col("new.expression").alias("new_expression"), "ratio", F.col("dist").cast("long").alias("dist"),
    )


def _all_files(query: Callable[..., DataFrame]) -> Query:
    """The same query over exact and renamed files."""

    def whole(spark, sf):
        return query(spark, sf, renames=True)

    whole.__name__ = f"{query.__name__}_all_files"
    return register(whole)


for _query in (method_match_exact, method_match_signature, methods_added_removed, method_diff, call_alignment, call_diff):
    _all_files(_query)


@register
def file_diff(spark, sf):
    """Hashes are compared as bytes, in tables of their own; only left-over files meet their names."""
    versions = units.file_versions(h.history_sources(spark, sf)).withColumn("content_sha", F.unhex("content_sha"))
    versions, known = stage(versions, "versions"), stage(_file_names(spark, sf), "names")
    pairs = stage(h.history_pairs(spark, sf).select(*PAIR), "pairs")
    compared = stage(file_ops.compare_paths(*file_ops.pair_sides(pairs, versions)), "compared")

    def named(side: str, release: str) -> DataFrame:
        names_of = known.withColumnRenamed("branch", release).hint("merge")
        return stage(file_ops.leftovers(compared, side).join(names_of, ["repository_name", release, "path"]), "leftover")

    renamed = stage(match_renamed(named("old", "prev_branch"), named("new", "branch")), "renamed")
    lone = stage(file_ops.unmatched(compared, renamed), "lone")
    rows = stage(records.file_diff(compared, renamed, lone), "diffs")
    return rows.select(*FILE_PAIR, "prev_path", "status", F.equal_null("old_sha", "new_sha").alias("same_content"))


# -- change records and statistics -------------------------------------------

_AT_REST: dict[tuple[str, str], str] = {}


def build_changes(spark: SparkSession, sf: str, **switches) -> DataFrame:
    """Change records of the whole supplier history, from source text."""
    releases = catalog_ops.name_releases(h.history_releases(spark, sf))
    return build_change_records(releases, landed_sources(spark, sf), **switches)


def changes_at_rest(spark: SparkSession, sf: str) -> DataFrame:
    """The change dataset that statistics read, written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _AT_REST:
        folder = landed.fresh_folder(spark, "changes")
        changes_io.write_changes(build_changes(spark, sf), folder, "parquet", gathered=False)
        _AT_REST[key] = folder
    return changes_io.read_changes(spark, _AT_REST[key], "parquet")


def _digest_call(call: Column) -> Column:
    return F.concat_ws(
        ":", F.coalesce(call["status"], F.lit("-")), call["expression"], call["start_offset"].cast("string"),
        F.coalesce(call["statistics"]["dist"].cast("string"), F.lit("-")),
    )


def _digest_method(method: Column) -> Column:
    return F.concat_ws(
        "|", F.coalesce(method["status"], F.lit("-")), F.coalesce(method["class"], F.lit("-")), method["name"],
        F.array_join(method["params"], " "), method["content"],
        F.coalesce(method["statistics"]["dist"].cast("string"), F.lit("-")),
        F.coalesce(F.round(method["statistics"]["ratio"] * 1000000).cast("long").cast("string"), F.lit("-")),
        F.array_join(F.transform(method["function_calls"], _digest_call), ";"),
    )


def digested(changes: DataFrame) -> DataFrame:
    """Change records with the nested part as one text per file."""
    own_mapping = F.when(F.col("mapping") == F.col("id"), F.lit("own")).otherwise(F.col("mapping"))
    return changes.select(
        "repository", "repository_name", "branch", "prev_branch", names.date_text(F.col("date")).alias("date"),
        "path", "prev_path", "status", own_mapping.alias("mapping"), F.array_join("imports", ";").alias("imports"),
        F.array_join(F.transform("methods", _digest_method), "\n").alias("methods"),
    )


@register
def change_records(spark, sf):
    return digested(build_changes(spark, sf))


def _thinned(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The sources without every third release of a supplier, and those releases."""
    sources = landed_sources(spark, sf)
    number = F.substring("branch", -4, 4).cast("int") + F.substring_index("repository_name", "-", -1).cast("int")
    return sources.where(number % 3 != 0), sources.where(number % 3 == 0).select("repository_name", "branch").distinct()


@register
def change_records_missing_next(spark, sf):
    """Some releases were never downloaded: the one before loses all its files."""
    releases = catalog_ops.name_releases(h.history_releases(spark, sf))
    return digested(build_change_records(releases, _thinned(spark, sf)[0]))


@register
def change_records_empty_release(spark, sf):
    """The same releases exist but hold no Python file."""
    releases = catalog_ops.name_releases(h.history_releases(spark, sf))
    sources, bare = _thinned(spark, sf)
    rows = bare.withColumns({"path": F.lit("requirements.txt"), "content": F.lit("numpy")})
    return digested(build_change_records(releases, sources.unionByName(rows)))


@register
def change_records_three_rows(spark, sf):
    """Signature changes also listed as removed and added."""
    return digested(build_changes(spark, sf, signature_change_exclusive=False))


@register
def change_records_incremental(spark, sf):
    """Releases up to 1994 first, then the whole catalogue with all sources."""
    releases = catalog_ops.name_releases(h.history_releases(spark, sf))
    sources = landed_sources(spark, sf)
    history = History(spark, landed.fresh_folder(spark, "history"))
    early = [rows.where(F.substring("branch", -4, 4).cast("int") <= 1994) for rows in (releases, sources)]
    history.extend(*early)
    history.extend(releases, sources)
    return digested(history.records(releases))


@register
def change_status(spark, sf):
    rows = stats.change_status(stats.later_releases(changes_at_rest(spark, sf)))
    return rows.select(*FILE, "file_status")


@register
def branch_file_status(spark, sf):
    return stats.file_status_counts(changes_at_rest(spark, sf), first_by="name")


def _statistics(spark, sf) -> DataFrame:
    return stats.branch_statistics(changes_at_rest(spark, sf))


@register
def branch_files_changed(spark, sf):
    return _statistics(spark, sf).select(*stats.RELEASE, "n_files_changed", "n_files_unchanged")


@register
def branch_methods_changed(spark, sf):
    return _statistics(spark, sf).select(*stats.RELEASE, "n_methods_changed", "n_methods_unchanged")


@register
def branch_change_averages(spark, sf):
    return _statistics(spark, sf).select(
        *stats.RELEASE, F.round("methods_avg_ratio", 6).alias("methods_avg_ratio"),
        F.round("methods_avg_dist", 6).alias("methods_avg_dist"),
    )


@register
def branch_statistics(spark, sf):
    rows = _statistics(spark, sf).withColumns(
        {c: F.round(c, 6) for c in ("methods_avg_ratio", "methods_avg_dist")}
    )
    return _long(rows, "release_no")


@register
def branch_status_stack(spark, sf):
    return _long(stats.status_stack(_statistics(spark, sf)), "release_no")


@register
def change_regression(spark, sf):
    fit = stats.change_regression(_statistics(spark, sf))
    return fit.select("repository_name", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@register
def releases_per_repo(spark, sf):
    return stats.releases_per_repository(h.orders_catalog(spark, sf))


@register
def files_per_release(spark, sf):
    return stats.files_per_release(h.history_methods(spark, sf).select(*FILE).distinct())


@register
def hist_releases_per_repo(spark, sf):
    return _long(stats.histogram(stats.releases_per_repository(h.orders_catalog(spark, sf)), "n", 4), "bin")


@register
def hist_files_per_release(spark, sf):
    counts = stats.files_per_release(h.history_methods(spark, sf).select(*FILE).distinct())
    return _long(stats.histogram(counts, "n", 4), "bin")


@register
def hist_files_shown(spark, sf):
    """Finished bins within the range that a plot shows."""
    return stats.clip(hist_files_per_release(spark, sf), 40, 50)
