"""Stable identifiers of code units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# xxhash64 skips nulls, so "no class" needs a value no class can be called.
_NO_CLASS = "\x00"


def _key(*parts: Column) -> Column:
    return F.xxhash64(*parts).cast("string")


def file_id(path: Column) -> Column:
    return _key(path)


def method_id(cls: Column, name: Column, params: Column) -> Column:
    return _key(F.coalesce(cls, F.lit(_NO_CLASS)), name, F.concat_ws(" ", params))


def call_id(expression: Column, start: Column, end: Column) -> Column:
    return _key(expression, start, end)
