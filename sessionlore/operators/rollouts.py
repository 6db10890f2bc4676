"""Counters over rollout files: one row a file, one file an id, one row of totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce, scalars

# What each payload type counts, and the tool that some stand for.
COUNTS = {
    "user_messages": ("user_message",),
    "agent_messages": ("agent_message",),
    "reasoning_items": ("reasoning", "agent_reasoning"),
    "tool_calls": ("function_call", "custom_tool_call", "web_search_call"),
    "tool_results": ("function_call_output", "custom_tool_call_output", "exec_command_end", "patch_apply_end"),
    "aborted_turns": ("turn_aborted",),
    "compacted_events": ("context_compacted",),
    "review_events": ("entered_review_mode", "exited_review_mode"),
}
TOOLS = {"exec_command_end": "exec", "patch_apply_end": "apply_patch", "web_search_call": "web_search"}
ROLES = {"user_messages": "user", "agent_messages": "assistant"}
META = ("cwd", "cli_version", "originator", "source")


def items(lines: DataFrame) -> DataFrame:
    """(path, archived, line_no, record, kind, role, name, ms, meta): what each line stands for."""
    v = F.col("v")
    parsed = lines.withColumn("v", F.try_parse_json("value")).where(F.schema_of_variant("v").startswith("OBJECT"))
    record = F.coalesce(coerce.text(v, "$.type"), F.lit(""))
    inner = lambda field: F.when(record.isin("response_item", "event_msg"), coerce.text(v, f"$.payload.{field}")).when(record == "message", coerce.text(v, f"$.{field}"))
    meta = F.struct(*(F.nullif(coerce.text(v, f"$.payload.{m}"), F.lit("")).alias(m) for m in META), coerce.text(v, "$.payload.id").alias("id"), coerce.millis(coerce.text(v, "$.payload.timestamp")).alias("ms"))
    return parsed.select("path", "archived", "line_no", record.alias("record"), inner("type").alias("kind"), inner("role").alias("role"), inner("name").alias("name"), coerce.millis(coerce.text(v, "$.timestamp")).alias("ms"), F.when(record == "session_meta", meta).alias("meta"))


def counters(kind: Column, role: Column, record: Column) -> dict[str, Column]:
    """For each counter, whether a line adds to it."""
    out = {}
    for name, kinds in COUNTS.items():
        hit = kind.isin(*kinds)
        if name in ROLES:
            hit = hit | ((kind == "message") & (role == ROLES[name]))
        if name == "reasoning_items":
            hit = hit | (record == "reasoning")
        if name == "compacted_events":
            hit = hit | (record == "compacted")
        out[name] = F.coalesce(hit, F.lit(False))
    return out


def files(rows: DataFrame) -> DataFrame:
    """A row a file with its counters; later metadata lines win, field by field."""
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line_no")))
    own = F.min_by("ms", F.when(F.col("ms").isNotNull(), F.col("line_no")))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.jsonl$", "")
    sums = [F.count_if(c).alias(n) for n, c in counters(F.col("kind"), F.col("role"), F.col("record")).items()]
    return rows.groupBy("path", "archived").agg(F.coalesce(last(F.col("meta.id")), F.first(scalars.rollout_id(stem))).alias("id"), F.coalesce(last(F.col("meta.ms")), own).alias("ms"), *(last(F.col(f"meta.{m}")).alias(m) for m in META), *sums)


def distinct_sessions(files_: DataFrame) -> DataFrame:
    """The first file of each id in path order; an archived copy comes before an active one."""
    order = Window.partitionBy("id").orderBy(F.desc("archived"), "path")
    return files_.where("id is not null").withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def tools(rows: DataFrame, sessions: DataFrame, limit: int = 15) -> DataFrame:
    """Calls by tool over the given sessions' files."""
    named = F.col("kind").isin("function_call", "custom_tool_call") & (F.col("name") != "")
    tool = F.when(named, F.col("name"))
    for kind, name in TOOLS.items():
        tool = F.when(F.col("kind") == kind, F.lit(name)).otherwise(tool)
    used = rows.join(sessions.select("path"), "path", "left_semi").withColumn("tool", tool).where("tool is not null")
    return top(used, "tool", limit)


def top(rows: DataFrame, column: str, limit: int = 10) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "name").limit(limit)


def totals(sessions: DataFrame, now_ms: int) -> DataFrame:
    today, week = scalars.day_start(now_ms), scalars.week_start(now_ms)
    return sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if(~F.col("archived")).alias("active_session_files"),
        F.count_if("archived").alias("archived_sessions"),
        F.count_if((F.col("ms") >= today) & (F.col("ms") < today + 86_400_000)).alias("sessions_today"),
        F.count_if(F.col("ms") >= week).alias("sessions_this_week"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS),
    )


def _listed(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "name", "count"))).alias("l")).select(F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"))).alias(name))


def state(threads: DataFrame) -> DataFrame:
    """One row over the state table, which is counted by project and model."""
    sums = {"thread_count": "threads", "threads_with_user_event": "with_user_event", "total_tokens_used": "tokens_used"}
    one = threads.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()))
    for column, name in (("cwd", "top_projects"), ("model_provider", "top_models")):
        used = threads.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.sum("threads").alias("count"))
        one = one.crossJoin(F.broadcast(_listed(used.orderBy(F.desc("count"), "name").limit(10), name)))
    return one


def report(lines: DataFrame, titles: DataFrame, now_ms: int, threads: DataFrame | None = None) -> DataFrame:
    """The report as one row; lists have ten or fifteen entries at most."""
    rows = items(lines)
    sessions = distinct_sessions(files(rows))
    out = totals(sessions, now_ms)
    lists = {"top_projects": top(sessions, "cwd"), "top_tools": tools(rows, sessions), "cli_versions": top(sessions, "cli_version"), "originators": top(sessions, "originator"), "sources": top(sessions, "source")}
    for name, ranked in lists.items():
        out = out.crossJoin(F.broadcast(_listed(ranked, name)))
    latest = sessions.where("ms is not null").orderBy(F.desc("ms"), F.desc("archived"), "path").limit(1).join(titles, "id", "left")
    recent = latest.agg(F.first(F.struct(F.col("id").alias("session_id"), "title", F.col("cwd").alias("project"), scalars.rfc3339(F.col("ms")).alias("date"), "cli_version", "source")).alias("most_recent"))
    out = out.crossJoin(F.broadcast(recent))
    if threads is None:
        return out.withColumn("state", F.lit(None).cast("string"))
    held = state(threads)
    return out.crossJoin(F.broadcast(held.select(F.struct(*held.columns).alias("state"))))
