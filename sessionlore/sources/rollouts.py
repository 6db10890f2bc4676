"""The second source: rollout files of another agent, active and archived, with titles and a state table."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_files, written
from .transcripts import numbered, text_lines


def read_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, archived, line_no, value) of all files like ``pattern`` below both folders."""
    below = lambda folder: text_lines(spark, f"{root.rstrip('/')}/{folder}", recursiveFileLookup=True, pathGlobFilter=pattern)
    both = [below(folder).withColumn("archived", F.lit(archived)) for folder, archived in (("sessions", False), ("archived_sessions", True))]
    with small_files(spark):
        lines = written(both[0].unionByName(both[1]).drop("file_size", "file_mtime"), "rollout-lines")
    return numbered(lines, lines.where(F.trim("value") != ""), "path").select("path", "archived", "line_no", "value")


def read_titles(spark: SparkSession, root: str) -> DataFrame:
    """(id, title): of each id the last title that is not empty."""
    lines = written(text_lines(spark, f"{root.rstrip('/')}/session_index.jsonl"), "rollout-titles")
    lines = numbered(lines, lines, "path")
    rows = lines.select("line_no", F.from_json("value", "id string, thread_name string").alias("r"))
    return rows.where("r.id is not null and r.thread_name <> ''").groupBy("r.id").agg(F.max_by("r.thread_name", "line_no").alias("title"))


THREADS = "cwd string, model_provider string, tokens_used long, threads long, with_user_event long"


def read_threads(spark: SparkSession, path: str) -> DataFrame | None:
    """The state table by project and model, or None where it cannot be read.

    The table is a local file of the one machine that writes it. The database adds
    it up, so the driver gets a row for each pair of project and model.
    """
    sums = "sum(coalesce(tokens_used, 0)), count(*), sum(CASE WHEN has_user_event <> 0 THEN 1 ELSE 0 END)"
    try:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            rows = db.execute(f"SELECT cwd, model_provider, {sums} FROM threads GROUP BY 1, 2").fetchall()
    except sqlite3.Error:
        return None
    return spark.createDataFrame([(*r[:2], *map(int, r[2:])) for r in rows], THREADS)
