"""Typed access to semi-structured values: a value of another type is missing.

A cast would turn 2.5, "12" or true into a count; these functions look at the
value's own type first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A full date and time with zone; bare dates and times are no timestamps.
TIMESTAMP = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def text(value: Column, path: str) -> Column:
    got = _at(value, path)
    return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(value, path, "string"))


def count(value: Column, path: str) -> Column:
    """A whole number from 0, else 0."""
    got, n = _at(value, path), F.try_variant_get(value, path, "bigint")
    return F.when(F.schema_of_variant(got) == "BIGINT", F.greatest(n, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))


def number(value: Column, path: str) -> Column:
    kind = F.schema_of_variant(_at(value, path))
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), F.try_variant_get(value, path, "double"))


def array(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def keys(value: Column, path: str) -> Column:
    return F.map_keys(F.try_variant_get(value, path, "map<string,variant>"))


def millis(at: Column) -> Column:
    """Epoch milliseconds of a timestamp text with a zone, else null."""
    return F.when(F.rlike(at, F.lit(TIMESTAMP)), F.unix_millis(at.try_cast("timestamp")))
