"""Requirements files as maps of package name to version specifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.text import strip

# Line starts that name a location and not a package.
LOCATION_PREFIXES = ("git+", "http://", "https://", "./")

# A requirement in the common form: name, optional extras, version specifiers,
# optional environment marker or comment.
_SPEC = r"(?:===|==|~=|!=|<=|>=|<|>)\s*[A-Za-z0-9.*+!_-]+"
_LINE = (
    r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[[A-Za-z0-9._,\s-]*\])?"
    rf"\s*(\(?\s*(?:{_SPEC}(?:\s*,\s*{_SPEC})*)?\s*,?\s*\)?)\s*(?:;.*)?(?:\s#.*)?$"
)
# A direct reference: a name, optional extras, and where the package lies.
_REFERENCE = r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[[A-Za-z0-9._,\s-]*\])?\s*@\s*\S+"
_OPERATOR = r"^(===|==|~=|!=|<=|>=|<|>)"


def requirement_lines(source_files: DataFrame) -> DataFrame:
    """Lines of each release's root ``requirements.txt``."""
    return source_files.where("path = 'requirements.txt' and content is not null").select(
        "repository_name", "branch", F.posexplode(F.split("content", "\n")).alias("line_no", "line")
    )


def parse_requirements(lines: DataFrame) -> DataFrame:
    """One row per (release, requirement): name, specs array<struct<op, version>>.

    Blank and comment lines are skipped, and so are lines in no known form. A
    location keeps its whole line as the name; ``name @ url`` has a name and no specs.
    The last line of a name wins.
    """
    text = strip(F.col("line"))
    rows = lines.withColumn("text", text).where((F.col("text") != "") & ~F.col("text").startswith("#"))
    location = F.lit(False)
    for prefix in LOCATION_PREFIXES:
        location = location | F.col("text").startswith(prefix)
    found = F.regexp_extract_all(F.regexp_extract("text", _LINE, 2), F.lit(f"({_SPEC})"), F.lit(1))
    specs = F.transform(
        found,
        lambda s: F.struct(
            F.regexp_extract(s, _OPERATOR, 1).alias("op"),
            strip(F.regexp_replace(s, _OPERATOR, "")).alias("version"),
        ),
    )
    parsed = rows.withColumns(
        {
            "name": F.when(location, F.col("text"))
            .when(F.col("text").rlike(_REFERENCE), F.regexp_extract("text", _REFERENCE, 1))
            .otherwise(F.regexp_extract("text", _LINE, 1)),
            "specs": F.when(location | F.col("text").rlike(_REFERENCE), F.slice(specs, 1, 0)).otherwise(specs),
        }
    ).where("name != ''")
    return parsed.groupBy("repository_name", "branch", "name").agg(
        F.max_by(F.struct("specs", "line_no"), "line_no").alias("last")
    ).select("repository_name", "branch", "name", "last.specs", "last.line_no")


def requirement_maps(parsed: DataFrame) -> DataFrame:
    """One row per release: map of name to specs. Bounded by one file's lines."""
    return parsed.groupBy("repository_name", "branch").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("name", "specs")))
        ).alias("requirements")
    )
