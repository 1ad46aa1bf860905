"""Test tables read as catalogues, releases, source files and change inputs.

A supplier is a repository, a shipping year a release, a part name a file and a
line item a method. The texts are canonical Python, so the units that must be
found in them follow from the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = ["repository_name", "branch", "path"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- catalogue ---------------------------------------------------------------


def pages_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs on three kinds of hosts."""
    pages = table(spark, sf_dir, "pages")
    url = (
        F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("example."), F.lit("github.")))
        .when(F.col("page_id") % 3 == 1, F.replace("url", F.lit("example."), F.lit("gitlab.")))
        .otherwise(F.concat("url", F.lit("/")))
    )
    return pages.select("page_id", url.alias("repository"))


def orders_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a repository, an order a branch of one of eight kinds."""
    orders = table(spark, sf_dir, "orders")
    n = (F.col("o_orderkey") % 5).cast("string")
    kind = F.col("o_orderkey") % 8
    branch = (
        F.when(kind == 0, F.concat(F.lit("refs/tags/v1."), n))
        .when(kind == 1, F.concat(F.lit("refs/tags/v1."), n, F.lit("-rc1")))
        .when(kind == 2, F.concat(F.lit("refs/heads/release/1."), n))
        .when(kind == 3, F.lit("refs/heads/main"))
        .when(kind == 4, F.concat(F.lit("refs/pull/"), n, F.lit("/head")))
        .when(kind == 5, F.concat(F.lit("refs/heads/dependabot/pip/x-1."), n))
        .when(kind == 6, F.lit("None"))
    )
    link = F.when(kind < 6, F.concat(F.lit("https://archive.example/"), F.col("o_orderkey").cast("string")))
    return orders.select(
        F.concat(F.lit("https://github.com/forge/cust-"), F.col("o_custkey").cast("string")).alias("repository"),
        branch.alias("branch"),
        link.alias("download_link"),
        F.when(kind < 6, F.col("o_orderpriority")).alias("name"),
        F.when(kind < 6, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("date"),
        F.col("o_orderkey").alias("release_seq"),
    )


def orders_snapshots(spark: SparkSession, sf_dir: str, tags_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(snapshots, release_targets): a snapshot lists the branches, or tags, of a customer.

    Customers without any have a null snapshot. An order's branch is a release
    or a revision; some answers are lists, some roots are directories.
    """
    rows = orders_catalog(spark, sf_dir)
    key = F.col("release_seq")
    url = F.concat(F.lit("https://api.example/t/"), key.cast("string"))
    listed = rows.where("branch is not null")
    if tags_only:
        listed = listed.where(F.col("branch").startswith("refs/tags/"))
    branches = listed.groupBy("repository").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    F.concat_ws("/", "branch", key.cast("string")),
                    F.struct(
                        F.when(key % 2 == 0, "release").otherwise("revision").alias("target_type"),
                        url.alias("target_url"),
                    ),
                )
            )
        ).alias("branches")
    )
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("https://github.com/forge/cust-"), F.col("c_custkey").cast("string")).alias("repository")
    )
    snapshots = customers.join(branches, "repository", "left")
    common = [
        (key % 11 == 0).alias("is_list"),
        F.when(key % 3 > 0, F.concat(F.lit("t"), key.cast("string"))).alias("target"),
        F.when(key % 4 > 0, F.concat(F.lit("d"), key.cast("string"))).alias("directory"),
        F.when(key % 5 > 0, F.col("name")).alias("name"),
        F.col("date"),
    ]
    direct = rows.select(url.alias("target_url"), *common, F.concat(url, F.lit("/r")).alias("target_link"))
    linked = rows.select(
        F.concat(url, F.lit("/r")).alias("target_url"),
        F.lit(False).alias("is_list"),
        F.concat(F.lit("r"), key.cast("string")).alias("target"),
        F.lit(None).cast("string").alias("directory"),
        "name", "date",
        F.lit(None).cast("string").alias("target_link"),
    )
    return snapshots, direct.unionByName(linked)


def history_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows of the supplier history, one per supplier and year."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y")).distinct()
    year, supplier = F.col("y").cast("string"), F.col("l_suppkey").cast("string")
    return rows.select(
        F.concat(F.lit("https://github.com/forge/supp-"), supplier).alias("repository"),
        F.concat(F.lit("refs/tags/v"), year).alias("branch"),
        F.concat(F.lit("https://archive.example/"), supplier, F.lit("/"), year).alias("download_link"),
        F.concat(F.lit("v"), year).alias("name"),
        F.concat(year, F.lit("-06-30 12:00:00")).alias("date"),
        (F.col("l_suppkey") * 10000 + F.col("y")).alias("release_seq"),
    )


# -- code units --------------------------------------------------------------


def history_files(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """One row per file with ``methods``, a method per line item, as (method_ord, *fields) in order.

    Only keys and flags are moved: texts and calls follow from them in the row.
    """
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        F.year("l_shipdate").alias("year"), F.col("l_quantity").cast("int").alias("qty"),
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".py")).alias("path"),
    )
    cls = F.nullif("l_returnflag", F.lit("N"))
    item = F.struct(
        cls.isNotNull().alias("has_class"), cls.alias("class"), "l_orderkey", "l_linenumber", "l_partkey",
        F.lower("l_linestatus").alias("argument"), "qty", (F.col("l_returnflag") == "N").alias("is_free"),
    )
    # Dealt once by raw keys; the grouping needs no further exchange.
    keys = ["l_suppkey", "year", "path"]
    dealt = items.join(parts, "l_partkey").repartition(*keys)
    files = dealt.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    methods = F.transform("items", lambda s, i: F.struct(i.alias("method_ord"), *_method(s, fields)))
    return files.select(
        F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("repository_name"),
        F.concat(F.lit("refs-tags-v"), F.col("year").cast("string")).alias("branch"),
        "path", methods.alias("methods"),
    )


def _method(item: Column, fields: tuple[str, ...]) -> list[Column]:
    """Fields of the method that a line item stands for: class, name, params, content, calls."""
    argument, qty = item["argument"], item["qty"]
    name = F.concat(F.lit("m"), (item["l_partkey"] % 7).cast("string"))
    params = F.when(item["is_free"], F.array(argument)).otherwise(F.array(F.lit("self"), argument))
    head = F.concat(F.lit("def "), name, F.lit("("), F.array_join(params, ", "), F.lit("):\n    "))
    check = F.concat(F.lit("check("), argument, F.lit(")"))
    has_check = qty > 25
    middle = F.when(has_check, F.concat(check, F.lit("\n    "))).otherwise("")
    inner = F.concat(F.lit("g("), argument, F.lit(")"))
    number = item["l_linenumber"].cast("string")
    opening = F.concat(F.lit("np.f"), number, F.lit("("))
    outer = F.concat(opening, inner, F.lit(", "), (qty % 3).cast("string"), F.lit(")"))
    at = F.length(head) + F.length(middle) + 7
    line = F.when(has_check, 2).otherwise(1)

    def call(place, name, context, expression, start, lineno) -> Column:
        return F.struct(
            place.cast("int").alias("call_ord"), name.alias("name"), context.cast("string").alias("context"),
            expression.alias("expression"), start.cast("int").alias("start_offset"),
            (start + F.length(expression)).cast("int").alias("end_offset"), lineno.cast("int").alias("lineno"),
        )

    first = F.when(has_check, 1).otherwise(0)
    nothing = F.lit(None)
    calls = F.array_compact(
        F.array(
            F.when(has_check, call(F.lit(0), F.lit("check"), nothing, check, F.length(head), F.lit(1))),
            call(first, F.concat(F.lit("f"), number), F.lit("np"), outer, at, line),
            call(first + 1, F.lit("g"), nothing, inner, at + F.length(opening), line),
        )
    )
    found = {
        "class": item["class"], "name": name, "params": params,
        "content": F.concat(head, middle, F.lit("return "), outer), "calls": calls,
    }
    return [found[f].alias(f) for f in fields]


def history_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One method per line item, with the calls its text holds."""
    files = history_files(spark, sf_dir, "class", "name", "params", "content", "calls")
    return files.select(*FILE, F.inline("methods"))


def history_sources(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """Source text of every file of every release.

    With ``broken``, files whose number of methods ends in 4 or 9 end in a syntax error.
    """
    files = history_files(spark, sf_dir, "class", "content")

    def texts(of: Column) -> Column:
        return F.transform(F.filter("methods", lambda m: m["class"].eqNullSafe(of)), lambda m: m["content"])

    def block(cls: str) -> Column:
        found = texts(F.lit(cls))
        indented = F.transform(
            found, lambda t: F.concat(F.lit("    "), F.replace(t, F.lit("\n"), F.lit("\n    ")))
        )
        return F.when(F.size(found) > 0, F.concat(F.lit(f"class {cls}:\n\n"), F.array_join(indented, "\n\n"), F.lit("\n")))

    parts = [
        F.concat(
            F.lit("from lib import part"), F.size("methods").cast("string"), F.lit(" as p\nimport numpy as np\n")
        ),
        F.array_join(texts(F.lit(None).cast("string")), "\n\n"),
        block("A"),
        block("R"),
    ]
    if broken:
        parts.append(F.when(F.size("methods") % 5 == 4, F.lit("def (:\n")))
    return files.select(*FILE, F.concat_ws("\n", *parts).alias("content"))


def history_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedimenta.operators.catalog import name_releases, release_pairs

    return release_pairs(name_releases(history_releases(spark, sf_dir)))


# -- texts -------------------------------------------------------------------


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with comment marks and triple quotes put into their lines."""
    text = F.replace("text", F.lit(". "), F.lit("\n  "))
    text = F.replace(text, F.lit(", "), F.lit("\n\t# "))
    text = F.replace(text, F.lit("que"), F.lit('"""'))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("content"))


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name beside the next one: (p_partkey, a, b)."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"))
    following = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return parts.join(following, "p_partkey")


def requirement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requirements file per supplier and year with one line per line item."""
    items = table(spark, sf_dir, "lineitem")
    part, minor = F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")
    kind = F.col("l_orderkey") % 8
    line = (
        F.when(kind == 0, F.concat(F.lit("lib"), part))
        .when(kind == 1, F.concat(F.lit("lib"), part, F.lit("==1."), minor))
        .when(kind == 2, F.concat(F.lit("lib"), part, F.lit(">=1."), minor, F.lit(",<2")))
        .when(kind == 3, F.concat(F.lit("# lib"), part))
        .when(kind == 4, F.lit(""))
        .when(kind == 5, F.concat(F.lit("git+https://host.example/"), part))
        .when(kind == 6, F.concat(F.lit("./local/"), part))
        .otherwise(F.concat(F.lit("-r other"), part))
    )
    rows = items.select(
        F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("repository_name"),
        F.concat(F.lit("refs-tags-v"), F.year("l_shipdate").cast("string")).alias("branch"),
        "l_orderkey", "l_linenumber", "l_partkey", line.alias("line"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "line")))
    return rows.groupBy("repository_name", "branch").agg(ordered.alias("lines")).select(
        "repository_name",
        "branch",
        F.lit("requirements.txt").alias("path"),
        F.array_join(F.transform("lines", lambda s: s["line"]), "\n").alias("content"),
    )


def _part_number() -> Column:
    return F.col("p_partkey").cast("string")


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per part: imports of every kind, and calls behind text that is not ASCII."""
    number = _part_number()
    text = F.concat(
        F.repeat(F.lit("é"), (F.col("p_partkey") % 4).cast("int")), F.repeat(F.lit("日"), (F.col("p_partkey") % 3).cast("int")), F.lit("a")
    )
    lines = [
        F.concat(F.lit("import os, part"), number, F.lit(".mod as alias")),
        F.concat(F.lit("from . import here"), number),
        F.lit("from ..up import a as b, c"),
        F.concat(F.lit("from pkg"), number, F.lit(".sub import *")),
        F.lit("import sys"),
        F.concat(F.lit("def f"), number, F.lit("(x):")),
        F.concat(F.lit("    return h('"), text, F.lit("', g(x))")),
    ]
    return table(spark, sf_dir, "part").select(
        F.lit("parts").alias("repository_name"), F.lit("v1").alias("branch"),
        F.concat(F.lit("p"), number, F.lit(".py")).alias("path"), F.concat_ws("\n", *lines).alias("content"),
    )


def part_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten requirements files with direct references, extras, markers and comments."""
    number, kind = F.concat(F.lit("lib"), _part_number()), F.col("p_partkey") % 4
    line = (
        F.when(kind == 0, F.concat(number, F.lit(" @ https://host.example/"), number, F.lit(".zip")))
        .when(kind == 1, F.concat(number, F.lit("[extra]@git+https://host.example/x")))
        .when(kind == 2, F.concat(F.lit("  "), number, F.lit(' ~= 1.0 ; python_version > "3"')))
        .otherwise(F.concat(number, F.lit("[a,b]>=1,!=1.5  # note")))
    )
    branch = F.concat(F.lit("v"), (F.col("p_partkey") % 10).cast("string")).alias("branch")
    rows = table(spark, sf_dir, "part").groupBy(branch).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.select(
        F.lit("parts").alias("repository_name"), "branch", F.lit("requirements.txt").alias("path"),
        F.array_join("lines", "\n").alias("content"),
    )
