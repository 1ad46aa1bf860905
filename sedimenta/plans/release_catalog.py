"""From landed snapshots to the cleaned release catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sedimenta.operators.catalog import clean_catalog, dedup_versions, filter_versions


def cleaned_catalog(releases: DataFrame, version_only: bool = True) -> DataFrame:
    """Junk rows out, then the first row of each (repository, version)."""
    return dedup_versions(filter_versions(clean_catalog(releases), version_only))

