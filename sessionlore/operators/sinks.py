"""Reports as JSON text, and as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_json(report: DataFrame, one: bool = False) -> DataFrame:
    """(json): one row that holds a limited report as a pretty JSON array, in its order, or
    its only row as an object. An empty report is ``[]``, or ``null`` as an object.

    A report has as many rows as its limit, so they fit one value.
    """
    told = {"pretty": "true", "ignoreNullFields": "false"}
    if one:
        first = report.limit(1).agg(F.first(F.struct("*")).alias("r"))
        return first.select(F.coalesce(F.to_json("r", told), F.lit("null")).alias("json"))
    rows = report.select(F.monotonically_increasing_id().alias("at"), F.struct("*").alias("r"))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("at", "r"))).alias("l"))
    text = F.to_json(F.transform("l", lambda x: x["r"]), told)
    return listed.select(F.when(F.size("l") == 0, F.lit("[]")).otherwise(text).alias("json"))


def write_json(report: DataFrame, path: str, one: bool = False) -> None:
    """The report's JSON as one text file below ``path``."""
    report_json(report, one).select(F.col("json").alias("value")).write.text(path)
