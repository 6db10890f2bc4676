"""Queries over transcript files: conversations are written as JSONL trees and read back.

Each conversation is a session with a file of its own. Its turns become user,
assistant and system records, between blank and malformed lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pricing
from ..operators import export, reports, rollouts, search, sinks
from ..sources import rollouts as rollout_source
from ..sources import transcripts
from ..sources.facts import Facts
from ..sources.shared import scratch, small_files, write_files, written
from ..sources.store import Store
from ..sources.warehouse import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
START_S = 1_700_000_000
LAYOUT = {"glob": "*", "name": "*.jsonl"}


def query(run: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[run.__name__] = run


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text and the record of each turn as JSON."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    at = F.date_format((F.lit(START_S) + F.col("conv_id") * 3600 + F.col("turn") * 7).cast("timestamp_ltz"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    named = lambda **columns: F.struct(*(c.alias(k) for k, c in columns.items()))
    head = {"sessionId": F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), "timestamp": at}
    model = F.when(F.col("turn") % 4 < 2, F.lit("claude-opus-4")).otherwise(F.lit("claude-haiku-4"))
    usage = named(
        input_tokens=F.length("text").cast("long"), output_tokens=F.col("turn"), cache_creation_input_tokens=F.lit(1), cache_read_input_tokens=F.lit(2)
    )
    blank = F.lit(None).cast("string")
    blocks = F.array(
        named(type=F.lit("text"), text=F.col("text"), name=blank),
        named(type=F.lit("tool_use"), text=blank, name=F.concat(F.lit("tool"), (F.col("turn") % 3).cast("string"))),
    )
    said = named(model=model, stop_reason=F.lit("end_turn"), usage=usage, content=blocks)
    record = (
        F.when(F.col("role") == "user", F.to_json(named(type=F.lit("user"), **head, message=named(content=F.col("text")))))
        .when(F.col("role") == "assistant", F.to_json(named(type=F.lit("assistant"), **head, message=said)))
        .otherwise(F.to_json(named(type=F.lit("system"), **head, subtype=F.lit("turn_duration"), durationMs=F.col("turn") * 1000 + 5)))
    )
    return turns.withColumn("record", record)


def _folder() -> Column:
    return F.concat(F.lit("-srv-p"), (F.col("conv_id") % 7).cast("string"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array(F.lit(""), F.col("record"), F.lit("not json"), F.lit("[1, 2]"))
    return _turns(spark, sf_dir).select(_folder().alias("project"), F.col("conv_id").alias("session"), "turn", "role", "text", F.posexplode(lines).alias("n", "value"))


def _save(rows: DataFrame, root: str) -> None:
    """A file for each session in ``rows``, in the place of its older one; others stay."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    file = F.concat(name("project"), F.lit("/"), name("session"), F.lit(".jsonl"))
    write_files(rows.withColumn("file", file), root, "turn", "role", "text", "n")


def tree(spark: SparkSession, sf_dir: str) -> str:
    """Write the transcripts; the path of their root."""
    root = scratch(spark, "transcripts")
    _save(_lines(spark, sf_dir), root)
    return root


def _records(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    return transcripts.records(transcripts.read_lines(spark, tree(spark, sf_dir), **LAYOUT), whole)


def fact(run: Callable[[Facts], DataFrame]) -> None:
    QUERIES[run.__name__] = lambda spark, sf_dir: run(transcripts.facts(_records(spark, sf_dir, whole=False)))


def _named(f: Facts, rows: DataFrame) -> DataFrame:
    return rows.join(f.sessions.select("session_key", "session_id"), "session_key").drop("session_key")


@fact
def transcript_sessions(f: Facts) -> DataFrame:
    return f.sessions.select("project", "session_id", "first_ms", "last_ms", "duration_ms", "message_count", "model")


@fact
def transcript_usage(f: Facts) -> DataFrame:
    rows = f.token_usage.select("session_key", "model", "messages", *pricing.COUNTERS, pricing.usd(F.col("cost_units")).alias("cost_usd"))
    return _named(f, rows)


@fact
def transcript_tools(f: Facts) -> DataFrame:
    return _named(f, f.tool_calls)


@fact
def transcript_turns(f: Facts) -> DataFrame:
    return _named(f, f.turn_durations.select("session_key", "turn_number", "duration_ms"))


@fact
def transcript_stops(f: Facts) -> DataFrame:
    return _named(f, f.stop_reasons)


@fact
def transcript_messages(f: Facts) -> DataFrame:
    return _named(f, f.messages.select("session_key", "role", "content", "line_no"))


@fact
def transcript_search(f: Facts) -> DataFrame:
    """Session and role of the best messages for a phrase; every message holds its role."""
    return search.search(f, "user", limit=100, stem=False).select("session_id", "role", F.round("rank", 6).alias("rank"))


@fact
def transcript_report_json(f: Facts) -> DataFrame:
    """A report's JSON, read again by the parser: as many objects as rows, in their order."""
    text = sinks.report_json(reports.cost_by_project(f).select("project", "sessions", "input_tokens"))
    rows = F.from_json("json", "array<struct<project:string,sessions:bigint,input_tokens:bigint>>")
    return text.select(F.posexplode(rows).alias("place", "r")).select("place", "r.*")


@query
def transcript_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's JSON document, read again: its head and how many messages of each kind it lists."""
    records = _records(spark, sf_dir)
    documents = export.json_document(transcripts.facts(records).sessions, records)
    shape = "struct<project:string,session_id:string,message_count:bigint,messages:array<struct<type:string>>>"
    r = F.from_json("document", shape)
    kinds = lambda kind: F.size(F.filter("r.messages", lambda m: m["type"] == kind)).cast("long")
    return documents.select(r.alias("r")).select("r.project", "r.session_id", "r.message_count", kinds("user").alias("asked"), kinds("assistant").alias("told"))


def _deltas(spark: SparkSession, sf_dir: str) -> Facts:
    """Facts of a store that was refreshed as its files came: some sessions whole and some by
    their first turns, then the rest of those and new ones, then nothing new."""
    held, root, rows = Store(spark, scratch(spark, "store")), scratch(spark, "transcripts"), _lines(spark, sf_dir)
    part = F.col("session") % 7
    _save(rows.where((part > 1) | ((part == 0) & (F.col("turn") < 2))), root)
    held.sync(root, **LAYOUT)
    _save(rows.where(part < 2), root)
    held.sync(root, **LAYOUT)
    held.sync(root, **LAYOUT)
    return held.facts()


@query
def store_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and their messages as a store holds them in a base and what came later."""
    f = _deltas(spark, sf_dir)
    counts = f.messages.groupBy("session_key").agg(F.count(F.lit(1)).alias("messages"), F.sum("terms").alias("terms"))
    held = f.sessions.select("session_key", "project", "session_id", "message_count", "duration_ms").join(counts, "session_key", "left")
    return held.drop("session_key").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("messages", "terms")})


@query
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best messages for a word that half of all hold, from the heaviest levels of a store's postings."""
    return search.search(_deltas(spark, sf_dir), "user", limit=100).select("session_id", "role", F.round("rank", 6).alias("rank"))


@query
def transcript_of_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the files of one project only, by its decoded name."""
    lines = transcripts.read_lines(spark, tree(spark, sf_dir), project="/srv/p3", **LAYOUT)
    return transcripts.facts(transcripts.records(lines, whole=False)).sessions.select("project", "session_id", "message_count")


@query
def transcript_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that contain a text, from files in order of path."""
    layout = LAYOUT | {"first_bytes": 64 << 10}
    return search.literal_files(spark, tree(spark, sf_dir), "The", limit=100, **layout)


@query
def export_markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's Markdown file, written in pieces and read back."""
    records, out = _records(spark, sf_dir), scratch(spark, "markdown")
    export.write_lines(export.markdown_lines(transcripts.facts(records).sessions, records), out)
    head = F.regexp_extract("document", r"\*\*Project:\*\* (\S+)", 1)
    with small_files(spark):  # for the reading as well, not for the listing alone
        files = spark.read.format("binaryFile").load(out, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("content").cast("string").alias("document"))
        return written(files.select(head.alias("project"), "document"), "markdown-read")


@query
def export_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of one project's sessions as one document, written in ranges: a row for each line."""
    records, out = _records(spark, sf_dir), scratch(spark, "selected")
    some = transcripts.facts(records).sessions.where("project = '/srv/p3'")
    export.write_selected(export.json_lines(some, records), out)
    line = F.regexp_replace("value", r"^[,\[]|\]$", "")
    kind = F.get_json_object(line, "$.type")
    names = F.when(F.startswith("value", F.lit("[")), "first").when(F.endswith("value", F.lit("]}]")), "last").when(kind.isNotNull(), kind)
    lines = spark.read.text(out).select(F.coalesce(names, F.when(F.contains("value", F.lit('"messages":[')), "head").otherwise("end")).alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def _rollouts(spark: SparkSession, sf_dir: str) -> str:
    """Conversations as rollout files of both folders, each after a line about its session, and
    titles for them: one for each turn, some of them empty. The path of their root."""
    role = F.when(F.col("role") == "assistant", F.lit("agent_message")).when(F.col("role") == "user", F.lit("user_message")).otherwise(F.lit("reasoning"))
    payload = F.struct(role.alias("type"), F.col("text").alias("message"))
    turns, id_ = _turns(spark, sf_dir), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id")
    said = turns.select("conv_id", F.col("turn").alias("place"), F.to_json(F.struct(F.lit("event_msg").alias("type"), payload.alias("payload"))).alias("value"))
    at = F.date_format((F.lit(START_S) + F.col("conv_id") * 60).cast("timestamp_ltz"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    cwd = F.concat(F.lit("/srv/p"), (F.col("conv_id") % 7).cast("string"))
    about = F.struct(id_, at.alias("timestamp"), cwd.alias("cwd"), F.lit("1.0").alias("cli_version"))
    metas = turns.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("place"), F.to_json(F.struct(F.lit("session_meta").alias("type"), about.alias("payload"))).alias("value"))
    rows = said.unionByName(metas).withColumn("archived", F.col("conv_id") % 3 == 0)
    root = scratch(spark, "rollouts")
    for folder, archived in (("sessions", False), ("archived_sessions", True)):
        file = F.concat(F.lit("conv_id="), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(".jsonl"))
        write_files(rows.where(F.col("archived") == archived).withColumn("file", file), f"{root}/{folder}", "place", "value")
    name = F.when(F.col("turn") % 3 == 2, "").otherwise(F.concat(F.lit("turn "), F.col("turn").cast("string")))
    titles = turns.select("conv_id", "turn", F.to_json(F.struct(id_, name.alias("thread_name"))).alias("value"))
    titles.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("value").write.text(f"{root}/session_index.jsonl")
    return root


@query
def rollout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of both folders hold."""
    files = rollouts.files(rollouts.items(rollout_source.read_lines(spark, _rollouts(spark, sf_dir))))
    conv = F.regexp_extract("path", "conv_id=([0-9]+)", 1).cast("long")
    return files.select(conv.alias("conv_id"), "archived", "user_messages", "agent_messages", "reasoning_items", "tool_calls")


@query
def rollout_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each session the last title that is not empty."""
    return rollout_source.read_titles(spark, _rollouts(spark, sf_dir))


@query
def rollout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of both folders."""
    root = _rollouts(spark, sf_dir)
    out = rollouts.report(rollout_source.read_lines(spark, root), rollout_source.read_titles(spark, root), START_S * 1000)
    names = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["name"], x["count"].cast("string"))), ",").alias(c)
    counts = ("total_sessions", "active_session_files", "archived_sessions", "user_messages", "agent_messages", "reasoning_items")
    return out.select(*counts, names("top_projects"), names("cli_versions"), F.col("most_recent.session_id").alias("latest"), F.col("most_recent.title").alias("title"))


_TURNS = f"""WITH turns AS (SELECT conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS text, 'conv-' || conv_id AS session_id, '/srv/p' || (conv_id % 7) AS project,
        ({START_S} + conv_id * 3600 + turn * 7)::BIGINT * 1000 AS ms, CASE WHEN turn % 4 < 2 THEN 'claude-opus-4' ELSE 'claude-haiku-4' END AS model,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, '')) * 4 - 3 AS line_no FROM conversations
), said AS (SELECT * FROM turns WHERE role = 'assistant'
), usage AS (SELECT project, session_id, model, count(*) AS messages, sum(length(text))::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens, count(*) AS cache_write_tokens, (2 * count(*))::BIGINT AS cache_read_tokens FROM said GROUP BY ALL
), sessions AS (SELECT project, session_id, min(ms) AS first_ms, max(ms) AS last_ms, coalesce(nullif(sum(turn * 1000 + 5) FILTER (role NOT IN ('user', 'assistant')), 0), max(ms) - min(ms))::BIGINT AS duration_ms,
        count(*) FILTER (role IN ('user', 'assistant')) AS message_count, CASE count(DISTINCT model) FILTER (role = 'assistant') WHEN 0 THEN NULL WHEN 1 THEN min(model) FILTER (role = 'assistant') ELSE 'mixed' END AS model FROM turns GROUP BY ALL
) """
_UNITS = "CASE model WHEN 'claude-opus-4' THEN 1500 * input_tokens + 7500 * output_tokens + 1875 * cache_write_tokens + 150 * cache_read_tokens ELSE 80 * input_tokens + 400 * output_tokens + 100 * cache_write_tokens + 8 * cache_read_tokens END"
_SIZE = "len(list_filter(string_split_regex(strip_accents(lower(role || ' ' || text)), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))"
LITERAL_FILES = """, lines AS (SELECT session_id, line_no, role, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS sub_line, unnest(string_split(text, chr(10))) AS line FROM turns WHERE role IN ('user', 'assistant')
        ), hits AS (SELECT l.*, project, first_ms, strpos(line, 'The') AS found FROM lines l JOIN sessions USING (session_id) WHERE contains(line, 'The')
        ORDER BY '-srv-p' || right(project, 1) || '/session=' || substring(session_id, 6), line_no, role, sub_line LIMIT 100
        ), cut AS (SELECT *, greatest(1, found - 80) AS a, least(length(line), found + 82) AS b FROM hits)
        SELECT project, session_id, line_no, sub_line::INTEGER AS sub_line, role, strftime(make_timestamp(first_ms * 1000), '%Y-%m-%dT%H:%M:%S+00:00') AS date,
        CASE WHEN a > 1 THEN '...' ELSE '' END || substring(line, a, b - a + 1) || CASE WHEN b < length(line) THEN '...' ELSE '' END AS snippet FROM cut"""
ORACLE = {
    "transcript_sessions": _TURNS + "SELECT * FROM sessions",
    "transcript_usage": _TURNS + f"SELECT * EXCLUDE (project), ({_UNITS})::BIGINT / 1e8 AS cost_usd FROM usage WHERE input_tokens + output_tokens + cache_write_tokens > 0",
    "transcript_tools": _TURNS + "SELECT session_id, 'tool' || (turn % 3) AS tool, count(*) AS calls FROM said GROUP BY ALL",
    "transcript_turns": _TURNS + "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS turn_number, turn * 1000 + 5 AS duration_ms FROM turns WHERE role NOT IN ('user', 'assistant')",
    "transcript_stops": _TURNS + "SELECT session_id, 'end_turn' AS reason, count(*) AS times FROM said GROUP BY ALL",
    "transcript_messages": _TURNS + "SELECT session_id, role, text AS content, line_no FROM turns WHERE role IN ('user', 'assistant') AND text <> ''",
    "transcript_search": _TURNS + f""", h AS (SELECT session_id, role, line_no, project, text, {_SIZE}::DOUBLE AS size,
        len(list_filter(string_split_regex(strip_accents(lower(role || ' ' || text)), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w = 'user'))::DOUBLE AS tf FROM turns WHERE role IN ('user', 'assistant') AND text <> ''
        ), g AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (tf > 0) AS df FROM h
        ), s AS (SELECT *, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS score FROM h, g WHERE tf > 0)
        SELECT session_id, role, -score AS rank FROM s ORDER BY score DESC, '-srv-p' || right(project, 1) || '/session=' || substring(session_id, 6), line_no, role LIMIT 100""",
    "transcript_report_json": _TURNS + f"""SELECT (row_number() OVER (ORDER BY units DESC, project) - 1)::INTEGER AS place, project, sessions, input_tokens FROM (SELECT project, count(DISTINCT session_id) AS sessions,
        coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum({_UNITS}), 0) AS units FROM (SELECT project, session_id FROM sessions) LEFT JOIN usage USING (project, session_id) GROUP BY project ORDER BY units DESC, project LIMIT 20)""",
    "transcript_export_json": _TURNS + "SELECT project, session_id, count(*) FILTER (role IN ('user', 'assistant')) AS message_count, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'assistant') AS told FROM turns GROUP BY ALL",
    "store_sessions": _TURNS + f"""SELECT project, session_id, message_count, duration_ms, coalesce(messages, 0)::BIGINT AS messages, coalesce(terms, 0)::BIGINT AS terms FROM sessions
        LEFT JOIN (SELECT session_id, count(*) AS messages, sum({_SIZE})::BIGINT AS terms FROM turns WHERE role IN ('user', 'assistant') AND text <> '' GROUP BY 1) USING (session_id)""",
    "transcript_of_project": _TURNS + "SELECT project, session_id, message_count FROM sessions WHERE project = '/srv/p3'",
    "transcript_literal": _TURNS + LITERAL_FILES,
    "export_markdown_files": _TURNS + f"""SELECT project, '# Session: ' || left(session_id, 8) || chr(10) || chr(10) || '**Project:** ' || project || chr(10) || '**Date:** ' || strftime(make_timestamp(first_ms * 1000), '%Y-%m-%d %H:%M UTC') || chr(10)
        || CASE WHEN model IS NULL THEN '' ELSE '**Model:** ' || replace(model, 'claude-', '') || chr(10) END || chr(10) || '---' || chr(10) || chr(10) || coalesce(parts, '') || chr(10) AS document
        FROM sessions LEFT JOIN (SELECT session_id, string_agg('## ' || upper(left(role, 1)) || substring(role, 2) || chr(10) || '*' || strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S') || '*' || chr(10) || chr(10) || text || chr(10)
        || CASE role WHEN 'assistant' THEN chr(10) || '**Tool: tool' || (turn % 3) || '**' || chr(10) ELSE '' END || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY line_no) AS parts FROM turns WHERE role IN ('user', 'assistant') GROUP BY 1) USING (session_id)""",
    "export_selected": _TURNS + """, s AS (SELECT * FROM sessions WHERE project = '/srv/p3'), r AS (SELECT role AS line, count(*) AS n FROM turns WHERE project = '/srv/p3' AND role IN ('user', 'assistant') GROUP BY 1
        UNION ALL SELECT unnest(['first', 'head', 'end', 'last']), unnest([1, count(*) - 1, count(*) - 1, 1]) FROM s) SELECT line, n::BIGINT AS n FROM r WHERE n > 0""",
    "rollout_titles": "SELECT 'c' || conv_id AS id, 'turn ' || max(turn) AS title FROM conversations WHERE turn % 3 <> 2 GROUP BY conv_id",
    "rollout_report": f"""WITH p AS (SELECT '/srv/p' || (conv_id % 7) AS name, count(DISTINCT conv_id) AS n FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
        SELECT count(DISTINCT conv_id) AS total_sessions, count(DISTINCT conv_id) FILTER (conv_id % 3 <> 0) AS active_session_files, count(DISTINCT conv_id) FILTER (conv_id % 3 = 0) AS archived_sessions,
        count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS agent_messages, count(*) FILTER (role NOT IN ('user', 'assistant')) AS reasoning_items,
        (SELECT string_agg(name || '=' || n, ',' ORDER BY n DESC, name) FROM p) AS top_projects, '1.0=' || count(DISTINCT conv_id) AS cli_versions, 'c' || max(conv_id) AS latest,
        (SELECT 'turn ' || max(turn) FROM conversations WHERE turn % 3 <> 2 AND conv_id = (SELECT max(conv_id) FROM conversations)) AS title FROM conversations""",
    "rollout_files": _TURNS + "SELECT conv_id, conv_id % 3 = 0 AS archived, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS agent_messages, count(*) FILTER (role NOT IN ('user', 'assistant')) AS reasoning_items, 0::BIGINT AS tool_calls FROM turns GROUP BY ALL",
}
# The same ranking; sessions that a later refresh wrote lie in folders like the others'.
ORACLE["store_search"] = ORACLE["transcript_search"]
