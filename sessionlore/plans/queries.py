"""The reports as flat queries over the star-schema tables.

Lists and maps are joined to text in a fixed order, so that rows compare with
those of other engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, pricing, scalars, search_text
from ..operators import export, reports, rollouts, search
from ..sources import store
from ..sources.facts import Facts
from ..sources.warehouse import facts, millis, table
from ..streaming import tail

#: The moment that stands for now: Wednesday, 31 January 1996, 12:00 UTC.
NOW_MS = 823_089_600_000
SESSION = "7"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def report(run: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
    QUERIES[run.__name__] = lambda spark, sf_dir: run(facts(spark, sf_dir))
    return run


def joined(values: str) -> Column:
    return F.array_join(values, ",").alias(values)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@report
def sessions_recent(f: Facts) -> DataFrame:
    return reports.sessions(f, project="nation_1")


@report
def sessions_by_file(f: Facts) -> DataFrame:
    return reports.sessions(f, file="10", limit=50)


@report
def cost_by_project(f: Facts) -> DataFrame:
    out = reports.cost_by_project(f)
    return out.select("project", "sessions", *pricing.COUNTERS, "avg_cost_per_session_usd", "cost_usd", joined("models")).transform(lambda d: rounded(d, "avg_cost_per_session_usd"))


@report
def cost_by_project_total(f: Facts) -> DataFrame:
    out = reports.cost_by_project(f, limit=5).select("project", "sessions", *pricing.COUNTERS)
    return reports.with_total(out, "project", "sessions", *pricing.COUNTERS)


@report
def cost_per_session(f: Facts) -> DataFrame:
    return reports.cost_per_session(f, limit=100).withColumn("models", joined("models"))


@report
def tools_aggregate(f: Facts) -> DataFrame:
    return reports.tools(f)


def _pairs(tools: str) -> Column:
    entries = F.transform(F.map_entries(tools), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return F.array_join(F.array_sort(entries), ",")


@report
def tools_per_session(f: Facts) -> DataFrame:
    return reports.tools_per_session(f, limit=100).withColumn("tools", _pairs("tools"))


@report
def tools_top3_per_session(f: Facts) -> DataFrame:
    return reports.tools_per_session(f, limit=100, top=3).withColumn("tools", _pairs("tools"))


@report
def turn_stats(f: Facts) -> DataFrame:
    return rounded(reports.turns(f), "avg_ms")


@report
def pr_latest(f: Facts) -> DataFrame:
    return reports.pull_requests(f, limit=100)


@report
def model_usage(f: Facts) -> DataFrame:
    out = reports.models(f).withColumn("service_tiers", joined("service_tiers")).withColumn("inference_geos", joined("inference_geos"))
    return rounded(out, "avg_cost_per_session_usd", "avg_tokens_per_session", "avg_speed")


@report
def file_mods(f: Facts) -> DataFrame:
    return reports.files(f, path="a", limit=200)


def child(name: str, prefix: str) -> None:
    """A part of every session's detail."""

    def run(f: Facts) -> DataFrame:
        rows = reports.session_children(f, f.sessions)[name]
        return rounded(rows, "avg_ms") if name == "turns" else rows

    run.__name__ = f"{prefix}_{name}"
    report(run)


for _name in (*reports.PARTS, "turns"):
    child(_name, "session_detail")
    child(_name, "all_sessions")  # an older name


@report
def session_detail(f: Facts) -> DataFrame:
    only = Facts(**(f.tables() | {"sessions": f.sessions.where(F.col("session_id") == SESSION)}))
    out = reports.session(only, SESSION)
    return out.select("project", "session_id", "path", "message_count", "model", *pricing.COUNTERS, "cost_usd", F.size("tools").cast("long").alias("n_tools"), F.size("files").cast("long").alias("n_files"), F.array_join(F.transform("models", lambda m: m["model"]), ",").alias("models"))


@report
def session_selector(f: Facts) -> DataFrame:
    return reports.select_sessions(f.sessions, "12").select("session_id", "path")


@report
def session_selector_project(f: Facts) -> DataFrame:
    return reports.select_sessions(f.sessions, "nation_2").select("session_id", "project")


@report
def summary_totals(f: Facts) -> DataFrame:
    return rounded(reports.summary_totals(f, NOW_MS), "avg_turn_ms")


@report
def summary_top_projects(f: Facts) -> DataFrame:
    return reports.top_projects(f)


@report
def summary_top_tools(f: Facts) -> DataFrame:
    return reports.top_tools(f)


@report
def summary_stop_reasons(f: Facts) -> DataFrame:
    return reports.top_stop_reasons(f)


@report
def summary_model_dist(f: Facts) -> DataFrame:
    return reports.model_distribution(f)


@report
def summary_most_recent(f: Facts) -> DataFrame:
    return reports.most_recent(f)


@report
def summary(f: Facts) -> DataFrame:
    out = reports.summary(f, NOW_MS)
    return out.select("total_sessions", "sessions_today", "sessions_this_week", "cost_usd", "week_cost_usd", F.array_join(F.transform("top_projects", lambda p: p["project"]), ",").alias("projects"), F.array_join(F.transform("model_distribution", lambda p: p["family"]), ",").alias("families"), F.col("most_recent.session_id").alias("most_recent"))


# Search: conversations are the messages, each its own session where an order has its number.
@query
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", search_text.words(F.col("text")).alias("terms"))
    return search.ranked(docs, ["the"]).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(50).select("doc_id", F.round("score", 6).alias("score"))


@query
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", search_text.words(F.col("text")).alias("terms"))
    return search.ranked(docs, search.query_words("of the")).select("doc_id", F.round("score", 6).alias("score"))


@report
def search_messages(f: Facts) -> DataFrame:
    found = search.search(f, "assistant", limit=30, stem=False)
    return found.select("project", "session_id", "role", F.round("rank", 6).alias("rank"))


@report
def search_stemmed(f: Facts) -> DataFrame:
    return search.search(f, "things", limit=100).select("project", "session_id", "role", "snippet", F.round("rank", 6).alias("rank"))


def _form(f: Facts, query: str) -> DataFrame:
    return search.search(f, query, limit=100).select("project", "session_id", "role", F.round("rank", 6).alias("rank"))


@report
def search_prefix(f: Facts) -> DataFrame:
    """Words that begin alike."""
    return _form(f, "th*")


@report
def search_column(f: Facts) -> DataFrame:
    """A word of the role, not of the text."""
    return _form(f, "message_type:assistant")


@report
def search_first(f: Facts) -> DataFrame:
    """A text's first word."""
    return _form(f, "content:^than")


@report
def search_lines_cs(f: Facts) -> DataFrame:
    return search.literal(f, "The", limit=100)


@report
def search_lines_ci(f: Facts) -> DataFrame:
    return search.literal(f, "The", limit=100, case_sensitive=False)


@report
def export_markdown(f: Facts) -> DataFrame:
    return export.markdown_messages(f.sessions, f.messages)


@query
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(listed.alias("l")).select("conv_id", F.array_join(F.transform("l", lambda m: F.concat_ws(": ", m["role"], m["text"])), "\n").alias("document"), F.size("l").cast("long").alias("messages"))


def _rollout_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as message records and events as payloads of a rollout file each."""
    none = F.lit(None).cast("string")
    meta = F.lit(None).cast("struct<cwd:string,cli_version:string,originator:string,source:string,id:string,ms:bigint>")
    said = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("path"), (F.col("conv_id") % 3 == 0).alias("archived"), F.col("turn").alias("line_no"), F.lit("message").alias("record"), F.lit("message").alias("kind"), "role", none.alias("name"), F.lit(None).cast("long").alias("ms"), meta.alias("meta"))
    kinds = F.element_at(F.array(*map(F.lit, ("function_call", "exec_command_end", "reasoning", "turn_aborted", "web_search_call", "patch_apply_end"))), (F.col("event_id") % 6 + 1).cast("int"))
    done = table(spark, sf_dir, "events").select(F.concat(F.lit("conv-"), F.col("user_id").cast("string")).alias("path"), (F.col("user_id") % 3 == 0).alias("archived"), (F.col("event_id") + 1000).alias("line_no"), F.lit("event_msg").alias("record"), kinds.alias("kind"), none.alias("role"), F.col("event_type").alias("name"), millis("ts").alias("ms"), meta.alias("meta"))
    return said.unionByName(done)


@query
def codex_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.totals(rollouts.distinct_sessions(rollouts.files(_rollout_items(spark, sf_dir))), NOW_MS)


@query
def codex_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.files(_rollout_items(spark, sf_dir)).select("path", "archived", "id", "ms", *rollouts.COUNTS)


@query
def codex_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey").cast("string")).alias("id"), (F.col("o_orderstatus") == "F").alias("archived"), F.concat(F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("path"))
    return rollouts.distinct_sessions(rows)


@query
def codex_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rollout_items(spark, sf_dir)
    return rollouts.tools(rows, rollouts.distinct_sessions(rollouts.files(rows)))


@query
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"), F.round(F.col("o_totalprice")).cast("long").alias("file_size"), millis("o_orderdate").alias("file_mtime"))
    known = orders.where("o_orderkey % 5 <> 0").drop("o_orderkey")
    seen = orders.where("o_orderkey % 7 <> 0").withColumn("file_size", F.col("file_size") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)).drop("o_orderkey")
    return store.classify(known, seen)


@query
def fn_decode_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.translate("p_name", " ", "-")
    path = scalars.decode_project(F.concat(F.lit("-home--x-"), raw))
    tree = F.concat(path, F.lit("/.claude/worktrees/w"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), scalars.canonical_project(tree).alias("canonical"), scalars.display_project(tree).alias("display"))


@query
def fn_short_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("/srv/projects"), "p_type", "p_brand", "p_name", F.col("p_partkey").cast("string"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.short_name(path).alias("short_name"))


@query
def fn_format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("l_orderkey") * F.col("l_linenumber") * 977
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.format_duration(ms).alias("duration"))


@query
def fn_fmt_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    usd = F.when(F.col("o_orderkey") % 3 == 0, -cents / 1000.0).otherwise(cents / 8.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.format_cost(usd).alias("cost"), scalars.format_count(cents).alias("count"))


@query
def fn_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = millis("ts")
    return table(spark, sf_dir, "events").select("event_id", scalars.rfc3339(ms).alias("text"), scalars.short_time(scalars.rfc3339(ms)).alias("short"))


@query
def fn_coerce_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("%d", "%d.5", "-%d", '"%d"', "true", "null", "[%d]")
    k = F.get_json_object("props", "$.k").cast("long")
    value = F.element_at(F.array(*(F.concat(F.lit(a[0]), k.cast("string"), F.lit(a[1])) if len(a := x.split("%d")) == 2 else F.lit(x) for x in kinds)), (F.col("event_id") % 7 + 1).cast("int"))
    v = F.try_parse_json(F.concat(F.lit('{"n":'), value, F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", coerce.count(v, "$.n").alias("count"), coerce.text(v, "$.n").alias("text"), coerce.number(v, "$.n").alias("number"), F.size(F.coalesce(coerce.array(v, "$.n"), F.array().cast("array<variant>"))).cast("long").alias("items"))


@query
def fn_split_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("c_mktsegment"), F.lit(" ,"), F.col("c_mktsegment"), F.lit("\x1f"), F.col("c_name"), F.lit(",,"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(scalars.split_values(text), "|").alias("parts"))


@query
def tail_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, ("error", "WARN", "info", "trace"))), (F.col("event_id") % 4 + 1).cast("int"))
    log = F.concat(F.lit('{"ts":"2024-01-02T03:04:05Z","level":"'), level, F.lit('","msg":"'), F.col("event_type"), F.lit('"}'))
    record = F.concat(F.lit('{"timestamp":"2024-01-02T03:04:05Z","type":"system","durationMs":'), (F.col("event_id") % 3).cast("string"), F.lit("}"))
    plain = F.concat(F.lit("a Warning of "), F.col("event_type"))
    line = F.when(F.col("event_id") % 3 == 0, log).when(F.col("event_id") % 3 == 1, record).otherwise(plain)
    return table(spark, sf_dir, "events").select("event_id", tail.format_line(line).alias("line"), tail.line_class(line).alias("class"))
