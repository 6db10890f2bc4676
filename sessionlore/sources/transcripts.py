"""JSONL transcripts: ``root/<encoded project>/<session>.jsonl``, one record a line.

Lines are parsed once, in one pass that takes out the typed values of each type of
record and writes them to a folder for each type; a fact reads the columns that it
needs of one of those. Blank and malformed lines are dropped, but counted. A small file
is read whole; a large one by lines, so it is divided between tasks like any text. Lines
are in order of (block, seq): where their block of the file starts, and their place in
it. A line's number is that place plus the lines of the file's blocks before; in a file
that was read whole (block WHOLE) it is ``seq``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import coerce, pricing, scalars, search_text
from .facts import SCHEMAS, Facts
from .shared import small_files, written

TEXT_LINES = "path string, file_size long, file_mtime long, block long, seq long, value string"


#: A file of at most so many bytes is read whole, if it fits a split. The reader of lines takes
#: five times as long to open one (1.9 against 0.4 ms here).
WHOLE_BYTES = 1 << 20
#: Stands for the block of a line in a file that was read whole.
WHOLE = -1
BOM = "\ufeff"


def text_lines(spark: SparkSession, paths: str | list[str], of_file: dict[str, Column] | None = None, **options: object) -> DataFrame:
    """(path, file_size, file_mtime, block, seq, value): every line of text files, also
    blank ones. ``seq`` rises within a block. A missing path has no lines. ``of_file`` are
    more texts, from a file's ``_metadata``: made once a file that is read whole, not a line.

    Files of other names than ``*.jsonl`` may be compressed and are left to the reader of lines.
    """
    of_file = of_file or {}
    none = spark.createDataFrame([], TEXT_LINES).withColumns({c: F.lit(None).cast("string") for c in of_file})
    if not paths:
        return none
    try:
        with small_files(spark):
            files = spark.read.format("binaryFile").load(paths, **options)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return none
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    small = (F.col("_metadata.file_size") <= min(WHOLE_BYTES, split)) & F.endswith("_metadata.file_name", F.lit(".jsonl"))
    about = (
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.unix_millis("_metadata.file_modification_time").alias("file_mtime"),
        *(value.alias(c) for c, value in of_file.items()),
    )
    returned = F.regexp_replace("value", "\r$", "")
    content = F.col("content")
    text = F.when(F.endswith(content, F.lit(b"\n")), F.substr(content, F.lit(1), F.col("length").cast("int") - 1)).otherwise(content).cast("string")
    read = files.where(small & (F.col("length") > 0)).select(*about, text.alias("text"))  # before its lines are told apart
    whole = read.select("path", "file_size", "file_mtime", *of_file, F.lit(WHOLE).cast("long").alias("block"), F.posexplode(F.split("text", "\n")).alias("seq", "value"))
    marked = (F.col("seq") == 0) & F.startswith("value", F.lit(BOM))  # the reader of lines leaves it out
    whole = whole.withColumns({"seq": F.col("seq").cast("long"), "value": F.when(marked, F.substr("value", F.lit(2))).otherwise(F.col("value"))})
    whole = whole.withColumn("value", F.when(F.contains("value", F.lit("\r")), returned).otherwise(F.col("value")))
    if not files.where(~small).isEmpty():  # files are told apart by their listing and not opened; another one is for these only
        with small_files(spark):
            texts = spark.read.text(paths, lineSep="\n", **options).where(~small)
        parts = texts.select(*about, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), returned.alias("value"))
        whole = whole.unionByName(parts)
    return whole


def named(name: str | None) -> dict[str, str]:
    """A reader's option for files of such names only."""
    return {} if name is None else {"pathGlobFilter": name}


def read_lines(
    spark: SparkSession, root: str, project: str | None = None, glob: str = "*/*.jsonl", paths: list[str] | None = None, folder: int = -2, name: str | None = None
) -> DataFrame:
    """The lines of all transcripts below ``root``, or of ``paths``, with their project.

    ``project`` keeps files whose raw or decoded project name contains it. The
    project's folder is the one at ``folder`` in a path, counted from its end, and
    may be named as a partition's (``name=value``). With ``name``, a pattern of file
    names, ``glob`` matches the folders of files, which tasks list, not the driver.
    """
    raw = F.regexp_replace(F.url_decode(F.replace(F.element_at(F.split("_metadata.file_path", "/"), folder), F.lit("+"), F.lit("%2B"))), "^[a-z_]+=", "")
    of_file = {"project": scalars.canonical_project(scalars.decode_project(raw))}
    if project is not None:
        of_file["raw"] = raw
    lines = text_lines(spark, [f"{root.rstrip('/')}/{glob}"] if paths is None else paths, of_file, **named(name))
    if project is not None:
        lines = lines.where(F.contains("raw", F.lit(project)) | F.contains(scalars.decode_project(F.col("raw")), F.lit(project))).drop("raw")
    return lines


#: Types of records with values of their own, each in a folder of its own; others share one,
#: and lines that are no records are in the last.
KINDS = ("assistant", "user", "system", "pr-link", "file-history-snapshot", "attachment", "permission-mode")
OTHER, BAD = "other", "bad"
USAGE = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")


def _blocks(v: Column) -> Column:
    """What is read of a message's blocks."""
    own = ("type", "text", "name")
    return F.transform(coerce.array(v, "$.message.content"), lambda b: F.struct(*(coerce.text(b, f"$.{c}").alias(c) for c in own)))


def _block_text(blocks: Column) -> Column:
    texts = F.transform(blocks, lambda b: F.when(b["type"] == "text", b["text"]))
    return F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), " ")


def _values(v: Column, blocks: Column) -> dict[str, dict[str, Column]]:
    """The typed values of each type of record."""
    text = lambda path: coerce.text(v, path)
    names = F.transform(blocks, lambda b: F.when(b["type"] == "tool_use", b["name"]))
    typed = F.schema_of_variant(F.try_variant_get(v, "$.durationMs", "variant")) == "BIGINT"
    return {
        "assistant": {
            "model": text("$.message.model"),
            "stop_reason": text("$.message.stop_reason"),
            **{c: coerce.count(v, f"$.message.usage.{k}") for k, c in zip(USAGE, pricing.COUNTERS)},
            "geo": text("$.message.usage.inference_geo"),
            "tier": text("$.message.usage.service_tier"),
            "speed": coerce.number(v, "$.message.usage.speed"),
            "iterations": coerce.count(v, "$.message.usage.iterations"),
            "tools": F.array_compact(names),
            "thinking": F.coalesce(F.size(F.filter(blocks, lambda b: b["type"] == "thinking")).cast("long"), F.lit(0)),
        },
        "system": {"subtype": text("$.subtype"), "took_ms": coerce.count(v, "$.durationMs"), "duration_ms": F.when(typed, coerce.count(v, "$.durationMs"))},
        "pr-link": {"pr_number": coerce.count(v, "$.prNumber"), "pr_url": text("$.prUrl"), "pr_repository": text("$.prRepository")},
        "file-history-snapshot": {"file_paths": coerce.keys(v, "$.snapshot.trackedFileBackups")},
        "attachment": {"filename": text("$.filename"), "mime_type": text("$.mimeType")},
        "permission-mode": {"mode": text("$.mode")},
    }


def records(lines: DataFrame, whole: bool = True) -> DataFrame:
    """Records by type (``kind``) with their typed values, written in one pass; the file's key is
    a hash of its path. Messages keep their ``whole`` record ``v`` as well, for exports; facts
    need none."""
    is_object = F.startswith("value", F.lit("{")) | F.rlike("value", F.lit(r"^[ \t\r\n]*\{"))  # where it is JSON at all; what begins otherwise is not parsed
    rows = lines.withColumn("v", F.when(is_object, F.try_parse_json("value"))).drop("value")
    v, kind, at, plain, blocks = (F.col(c) for c in ("v", "kind", "at", "plain", "blocks"))
    rows = rows.withColumns({"kind": coerce.text(v, "$.type"), "at": coerce.text(v, "$.timestamp")})
    rows = rows.withColumn("kind", F.when(v.isNull(), BAD).when(kind.isin(*KINDS), kind).otherwise(OTHER))
    spoken = kind.isin("user", "assistant")
    rows = rows.withColumn("plain", F.when(kind == "user", coerce.text(v, "$.message.content")))
    rows = rows.withColumn("blocks", F.when(spoken & plain.isNull(), _blocks(v)))
    own = [F.when(kind == name, value).alias(c) for name, values in _values(v, blocks).items() for c, value in values.items()]
    rows = rows.select(
        F.xxhash64("path").alias("session_key"), "project", "path", "file_size", "file_mtime", "block", "seq", "kind",
        coerce.text(v, "$.sessionId").alias("sid"), "at", coerce.millis(at).alias("ms"),
        F.when(spoken, F.coalesce(plain, _block_text(blocks), F.lit(""))).alias("content"), *own, *([F.when(spoken, v).alias("v")] if whole else []),
    )
    with small_files(lines.sparkSession):
        return written(rows, "transcript-records", by="kind")


def numbered(every: DataFrame, rows: DataFrame, key: str = "session_key") -> DataFrame:
    """``rows`` with line_no, the plain number of a line in its file; ``every`` has the
    file's ``key``, block and seq of all its lines.

    Only lines of files that were read in blocks are joined: there is a count a block of
    these, as few as the scan's tasks and files, and the running sums are of one file.
    """
    whole = F.col("block") == WHOLE
    blocks = every.where(~whole).groupBy(key, "block").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("block")
    starts = blocks.select(key, "block", (F.sum("n").over(before) - F.col("n") - F.col("first_seq")).alias("start"))
    parts = rows.where(~whole).join(starts, [key, "block"]).withColumn("line_no", F.col("start") + F.col("seq")).drop("start")
    return rows.where(whole).withColumn("line_no", F.col("seq")).unionByName(parts)


def facts(rec: DataFrame) -> Facts:
    """All fact tables of the given ``records``."""
    place = F.struct("block", "seq")

    def of(kind: str, *columns: str | Column) -> DataFrame:
        return rec.where(F.col("kind") == kind).select("session_key", *columns)

    def values(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(c), scalars.split_values))))

    used = of("assistant", "model", *pricing.COUNTERS, "geo", "tier", "speed", "iterations").groupBy("session_key", "model")
    by_model = used.agg(F.count(F.lit(1)).alias("messages"), *(F.sum(c).alias(c) for c in pricing.COUNTERS), values("geo").alias("geos"), values("tier").alias("tiers"), F.avg("speed").alias("speed"), F.sum("iterations").alias("iterations"))
    total = sum((F.col(c) for c in pricing.COUNTERS[1:]), F.col(pricing.COUNTERS[0]))
    usage = by_model.where(total > 0).withColumn("cost_units", pricing.cost_units(F.col("model"), tuple(F.col(c) for c in pricing.COUNTERS)))

    tools = of("assistant", F.explode("tools").alias("tool")).groupBy("session_key", "tool").agg(F.count(F.lit(1)).alias("calls"))
    thinking = of("assistant", "thinking").where("thinking > 0").groupBy("session_key").agg(F.sum("thinking").alias("thinking_blocks"))
    stops = of("assistant", F.col("stop_reason").alias("reason")).where("reason is not null").groupBy("session_key", "reason").agg(F.count(F.lit(1)).alias("times"))

    timed = of("system", "block", "seq", "at", "subtype", "duration_ms").where("subtype = 'turn_duration' and duration_ms is not null")
    order = Window.partitionBy("session_key").orderBy("block", "seq")
    turns = timed.select("session_key", F.row_number().over(order).cast("long").alias("turn_number"), "duration_ms", "at")

    said = rec.where("kind in ('user', 'assistant') and content <> ''").select("session_key", "block", "seq", "at", F.col("kind").alias("role"), "content")
    messages = numbered(rec, search_text.sized(said))

    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    heads = rec.where(F.col("kind") != BAD).groupBy("session_key", "project", "path", "file_size", "file_mtime")
    span = F.greatest(F.lit(0), F.max("ms") - F.min("ms"))
    took = F.coalesce(F.sum("took_ms"), F.lit(0))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.jsonl$", "")
    sessions = heads.agg(
        F.coalesce(F.min_by("sid", F.when(F.col("sid").isNotNull(), place)), F.first(stem)).alias("session_id"),
        F.min("ms").alias("first_ms"),
        F.max("ms").alias("last_ms"),
        F.when(took > 0, took).otherwise(F.coalesce(span, F.lit(0))).cast("long").alias("duration_ms"),
        F.count_if(F.col("kind").isin("user", "assistant")).alias("message_count"),
        scalars.model_label(F.collect_set("model")).alias("model"),
    )
    made = Facts(
        sessions=sessions,
        token_usage=usage,
        tool_calls=tools,
        turn_durations=turns,
        pr_links=of("pr-link", "pr_number", text("pr_url"), text("pr_repository"), text("at")),
        file_modifications=of("file-history-snapshot", F.explode("file_paths").alias("file_path")).distinct(),
        thinking_usage=thinking,
        stop_reasons=stops,
        attachments=of("attachment", "filename", "mime_type").where("filename <> ''"),
        permission_changes=of("permission-mode", "mode", "at").where("mode <> ''"),
        messages=messages,
        postings=search_text.postings(messages),
    )
    names = {name: [c.split()[0] for c in schema.split(", ")] for name, schema in SCHEMAS.items()}
    return Facts(**{name: df.select(*names[name]) for name, df in made.tables().items()})


def read(spark: SparkSession, root: str, project: str | None = None) -> Facts:
    return facts(records(read_lines(spark, root, project), whole=False))
