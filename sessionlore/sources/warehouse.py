"""Facts from star-schema tables: orders as sessions, order lines as usage, events as tool calls.

The same reports run on these as on transcripts. Epoch values are taken from
zone-less timestamps, so the session's time zone does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pricing, scalars, search_text
from .facts import Facts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def model_of(flag: str) -> Column:
    return F.when(F.col(flag) == "A", F.lit("claude-opus-4")).when(F.col(flag) == "R", F.lit("claude-haiku-4")).otherwise(F.lit("claude-sonnet-4"))


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    lines, orders, events = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "events"))
    whose = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    per_order = lines.groupBy(F.col("l_orderkey").alias("session_key")).agg(
        F.max(millis("l_shipdate")).alias("last_ms"), F.count(F.lit(1)).alias("message_count"), scalars.model_label(F.array_sort(F.collect_set(model_of("l_returnflag")))).alias("model")
    )
    first = millis("o_orderdate")
    sessions = whose.select(
        F.col("o_orderkey").alias("session_key"),
        F.col("n_name").alias("project"),
        F.concat(F.lit("/"), "c_mktsegment", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".jsonl")).alias("path"),
        F.lit(0).cast("long").alias("file_size"),
        first.alias("file_mtime"),
        F.col("o_orderkey").cast("string").alias("session_id"),
        first.alias("first_ms"),
    ).join(per_order, "session_key", "left")
    took = F.greatest(F.lit(0), F.coalesce(F.col("last_ms") - F.col("first_ms"), F.lit(0)))
    sessions = sessions.withColumn("duration_ms", took).withColumn("message_count", F.coalesce("message_count", F.lit(0)))

    whole = lambda c: F.col(c).cast("long")
    usage = lines.groupBy(F.col("l_orderkey").alias("session_key"), model_of("l_returnflag").alias("model")).agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.round("l_quantity").cast("long")).alias("input_tokens"),
        F.sum(F.floor("l_extendedprice")).alias("output_tokens"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("cache_write_tokens"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("cache_read_tokens"),
        F.array_sort(F.collect_set(F.concat(F.lit("geo"), (F.col("l_suppkey") % 3).cast("string")))).alias("geos"),
        F.array_sort(F.collect_set("l_linestatus")).alias("tiers"),
        F.avg(F.round("l_quantity").cast("long")).alias("speed"),
        F.sum(whole("l_linenumber")).alias("iterations"),
    )
    usage = usage.withColumn("cost_units", pricing.cost_units(F.col("model"), tuple(F.col(c) for c in pricing.COUNTERS)))

    key = F.col("user_id")  # tool calls and turns belong to the order of the user's number
    turn = Window.partitionBy("user_id").orderBy("ts", "event_id")
    said = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_key"), F.col("turn").alias("line_no"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("at")
    )
    messages = search_text.sized(said)
    return Facts(
        sessions=sessions,
        token_usage=usage,
        tool_calls=events.groupBy(key.alias("session_key"), F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("calls")),
        turn_durations=events.select(key.alias("session_key"), F.row_number().over(turn).cast("long").alias("turn_number"), F.round(F.col("value") * 1000).cast("long").alias("duration_ms"), F.col("ts").cast("string").alias("at")),
        pr_links=lines.select(F.col("l_orderkey").alias("session_key"), F.col("l_suppkey").alias("pr_number"), F.concat(F.lit("/pull/"), F.col("l_suppkey").cast("string")).alias("pr_url"), F.lit("repo").alias("pr_repository"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("at")),
        file_modifications=lines.select("l_orderkey", "l_partkey").distinct().join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("session_key"), F.concat_ws("/", "p_type", "p_name", F.col("p_partkey").cast("string")).alias("file_path")),
        thinking_usage=lines.where("l_linenumber > 5").groupBy(F.col("l_orderkey").alias("session_key")).agg(F.count(F.lit(1)).alias("thinking_blocks")),
        stop_reasons=orders.select(F.col("o_orderkey").alias("session_key"), F.col("o_orderstatus").alias("reason"), F.lit(1).cast("long").alias("times")),
        attachments=orders.where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("session_key"), F.col("o_orderpriority").alias("filename"), F.lit("text/plain").alias("mime_type")),
        permission_changes=orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("session_key"), F.col("o_orderpriority").alias("mode"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at")),
        messages=messages,
        postings=search_text.postings(messages),
    )
