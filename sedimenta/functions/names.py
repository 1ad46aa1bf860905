"""Names of repositories, branches, versions and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a version inside a branch name.
VERSION_PATTERN = r"(v?\d+\.\d+(\.\d+)*)"


def repo_name(url: Column, last_segment_hosts: tuple[str, ...] = ("github", "gitlab")) -> Column:
    """Last path segment on the given hosts, the one before it elsewhere.

    Other hosts end their project URLs in a slash. Pass ``("github",)`` for the
    narrower rule used when change records are generated.
    """
    parts = F.split(url, "/")
    on_host = F.lit(False)
    for host in last_segment_hosts:
        on_host = on_host | url.contains(host)
    return F.when(on_host, F.try_element_at(parts, F.lit(-1))).otherwise(F.try_element_at(parts, F.lit(-2)))


def branch_slug(branch: Column) -> Column:
    return F.translate(branch, "/", "-")


def has_version(branch: Column) -> Column:
    return branch.rlike(VERSION_PATTERN)


def version_token(branch: Column) -> Column:
    """First ``/``-separated part of the branch that contains a version, else null."""
    return F.get(F.filter(F.split(branch, "/"), has_version), F.lit(0))


def release_date(text: Column) -> Column:
    """Timestamp of a release; text without a zone is UTC, whatever the session's zone."""
    trimmed = F.trim(text)
    day = trimmed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    clock = trimmed.rlike(r"\d:\d{2}(:\d{2}(\.\d+)?)?$") & ~trimmed.rlike(r"[+-]\d{1,2}:\d{2}$")
    zoned = F.when(day, F.concat(trimmed, F.lit(" 00:00:00Z"))).when(clock, F.concat(trimmed, F.lit("Z")))
    return F.try_to_timestamp(F.coalesce(zoned, trimmed))


def date_text(ts: Column) -> Column:
    """UTC text of a timestamp, whatever the session's zone."""
    return F.concat(F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd HH:mm:ss"), F.lit("Z"))


def relative_path(path: Column, root: Column) -> Column:
    """``path`` below ``root``; null when it lies elsewhere."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
