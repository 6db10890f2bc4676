"""Transcripts as documents: a session as Markdown or as one JSON object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce, scalars
from ..sources.shared import remove, write_files
from ..sources.transcripts import WHOLE

FENCE = "```"


def _result_text(block: Column) -> Column:
    """The text of a tool result's content, which is a string or a list of blocks."""
    listed = F.transform(coerce.array(block, "$.content"), lambda c: coerce.text(c, "$.text"))
    texts = F.coalesce(F.filter(listed, lambda t: t.isNotNull()), F.array_compact(F.array(coerce.text(block, "$.content"))))
    return F.array_join(F.transform(texts, lambda t: F.concat(F.lit(f"{FENCE}\n"), t, F.lit(f"\n{FENCE}\n"))), "")


def _user_block(block: Column) -> Column:
    kind = coerce.text(block, "$.type")
    head = F.concat(F.lit("\n**Tool result** ("), F.coalesce(coerce.text(block, "$.tool_use_id"), F.lit("")), F.lit(")\n"))
    return F.when(kind == "text", F.concat(coerce.text(block, "$.text"), F.lit("\n"))).when(kind == "tool_result", F.concat(head, _result_text(block)))


def _assistant_block(block: Column) -> Column:
    kind, given = coerce.text(block, "$.type"), F.try_variant_get(block, "$.input", "variant")
    head = F.concat(F.lit("\n**Tool: "), F.coalesce(coerce.text(block, "$.name"), F.lit("unknown")), F.lit("**\n"))
    body = F.when(given.isNotNull() & (F.schema_of_variant(given) != "VOID"), F.concat(F.lit(f"{FENCE}json\n"), F.to_json(given, {"pretty": "true"}), F.lit(f"\n{FENCE}\n"))).otherwise(F.lit(""))
    return F.when(kind == "text", F.concat(coerce.text(block, "$.text"), F.lit("\n"))).when(kind == "tool_use", F.concat(head, body))


def _joined(blocks: Column) -> Column:
    return F.coalesce(F.array_join(F.filter(blocks, lambda t: t.isNotNull()), ""), F.lit(""))


def _document(head: Column, parts: Column) -> Column:
    return F.concat(head, F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), ""))


def _head(key: Column, project: Column, first_ms: Column, model: Column) -> Column:
    date = F.when(first_ms.isNotNull(), F.concat(F.lit("**Date:** "), F.regexp_replace(F.substring(scalars.rfc3339(first_ms), 1, 16), "T", " "), F.lit(" UTC\n"))).otherwise(F.lit(""))
    named = F.when(model.isNotNull(), F.concat(F.lit("**Model:** "), scalars.short_model(model), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("# Session: "), scalars.short_id(key), F.lit("\n\n**Project:** "), project, F.lit("\n"), date, named, F.lit("\n---\n\n"))


def _part(role: Column, at: Column, body: Column) -> Column:
    stamp = F.when(F.coalesce(at, F.lit("")) != "", F.concat(F.lit("*"), F.substring(at, 1, 19), F.lit("*\n\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("## "), F.initcap(role), F.lit("\n"), stamp, body, F.lit("\n---\n\n"))


def _said(records: DataFrame) -> DataFrame:
    """(session_key, block, seq, text): the Markdown of each message."""
    v = F.col("v")
    content = coerce.array(v, "$.message.content")
    plain = coerce.text(v, "$.message.content")
    user = F.coalesce(F.concat(plain, F.lit("\n")), _joined(F.transform(content, _user_block)))
    body = F.when(F.col("kind") == "user", user).otherwise(_joined(F.transform(content, _assistant_block)))
    spoken = records.where(F.col("kind").isin("user", "assistant"))
    return spoken.select("session_key", "block", "seq", _part(F.col("kind"), coerce.text(v, "$.timestamp"), body).alias("text"))


def markdown(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """(path, document): ``records`` as by ``transcripts.records``; a session's messages in line
    order. A document is one value; ``markdown_lines`` are for sessions of any length."""
    grouped = _said(records).groupBy("session_key").agg(F.collect_list(F.struct("block", "seq", "text")).alias("parts"))
    both = sessions.join(grouped, "session_key", "left")
    none = F.array().cast("array<struct<block:bigint,seq:bigint,text:string>>")
    head = _head(F.col("session_id"), F.col("project"), F.col("first_ms"), F.col("model"))
    return both.select("path", _document(head, F.coalesce("parts", none)).alias("document"))


def markdown_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """The same from the messages table, where only texts are kept; a session without any has its head."""
    part = _part(F.col("role"), F.col("at"), F.concat(F.col("content"), F.lit("\n")))
    grouped = messages.groupBy("session_key").agg(F.collect_list(F.struct("line_no", part.alias("text"))).alias("parts"))
    head = _head(F.col("session_id"), F.col("project"), F.col("first_ms"), F.col("model"))
    none = F.array().cast("array<struct<line_no:bigint,text:string>>")
    both = sessions.join(grouped, "session_key", "left")
    return both.select("path", _document(head, F.coalesce("parts", none)).alias("document"))


def _json_head() -> Column:
    head = F.to_json(F.struct("project", "session_id", scalars.rfc3339(F.col("first_ms")).alias("date"), "model", "message_count"))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"messages":['))


JSON_END = "]}"


def _told(records: DataFrame) -> DataFrame:
    """(session_key, block, seq, text): the JSON of each message's record."""
    return records.where(F.col("kind").isin("user", "assistant")).select("session_key", "block", "seq", F.to_json("v").alias("text"))


def json_document(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """(path, document): one JSON object a session with its messages' records in line order, a line each."""
    spoken = _told(records).groupBy("session_key").agg(F.collect_list(F.struct("block", "seq", "text")).alias("parts"))
    both = sessions.join(spoken, "session_key", "left")
    none = F.array().cast("array<struct<block:bigint,seq:bigint,text:string>>")
    rows = F.transform(F.array_sort(F.coalesce("parts", none)), lambda p: p["text"])
    listed = F.when(F.size(rows) > 0, F.concat(F.array_join(rows, "\n,"), F.lit("\n"))).otherwise(F.lit(""))
    return both.select("path", F.concat(_json_head(), F.lit("\n"), listed, F.lit(JSON_END)).alias("document"))


def selected_json(documents: DataFrame) -> DataFrame:
    """(document): the JSON of a selector's sessions, one as an object, more as an array in order of path."""
    listed = documents.agg(F.array_sort(F.collect_list(F.struct("path", "document"))).alias("l"))
    every = F.array_join(F.transform("l", lambda x: x["document"]), ",")
    return listed.select(F.when(F.size("l") == 1, every).otherwise(F.concat(F.lit("["), every, F.lit("]"))).alias("document"))


#: Places of a document's head and end among (block, seq) of its messages.
FIRST, LAST = WHOLE - 1, (1 << 63) - 1


def _lines(sessions: DataFrame, head: Column, parts: DataFrame, end: str) -> DataFrame:
    """(path, block, seq, value): the pieces of documents, each a line or more without the last line end."""
    at = lambda block: (F.lit(block).cast("long").alias("block"), F.lit(0).cast("long").alias("seq"))
    heads = sessions.select("path", *at(FIRST), head.alias("value"))
    ends = sessions.select("path", *at(LAST), F.lit(end).alias("value"))
    own = parts.join(sessions.select("session_key", "path"), "session_key").select("path", "block", "seq", F.col("text").alias("value"))
    return heads.unionByName(own).unionByName(ends)


def markdown_lines(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """``markdown`` in pieces, for ``write_lines``: no value is larger than a message."""
    ended = lambda c: F.regexp_replace(c, r"\n\z", "")
    head = _head(F.col("session_id"), F.col("project"), F.col("first_ms"), F.col("model"))
    return _lines(sessions, ended(head), _said(records).withColumn("text", ended("text")), "")


def json_lines(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """``json_document`` in pieces, for ``write_lines`` and ``write_selected``."""
    rows = _lines(sessions, _json_head(), _told(records), JSON_END)
    place = F.row_number().over(Window.partitionBy("path").orderBy("block", "seq"))  # a stream of one document's pieces
    follows = (F.col("place") > 2) & (F.col("block") < LAST)
    return rows.withColumn("place", place).select("path", "block", "seq", F.concat(F.when(follows, ",").otherwise(""), "value").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """The files of ``write`` from pieces: a task appends a session's pieces one after another,
    in their order, and holds a batch of them."""
    remove(lines.sparkSession, path)
    file = F.concat(F.lit("project="), "project", F.lit("/session="), "session", F.lit("/part-00000.txt"))
    write_files(_named(lines, "block", "seq", "value").withColumn("file", file), path, "block", "seq")


def write_selected(lines: DataFrame, path: str) -> None:
    """``selected_json`` from ``json_lines``, as text files that make up the document in order of
    their names: they hold ranges of its pieces, so many tasks write it."""
    told = lines.where(F.col("block") == FIRST).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"), F.max("path").alias("last")).first()
    if told.n == 0:
        lines.sparkSession.createDataFrame([("[]",)], "value string").write.text(path)
        return
    head, end = F.col("block") == FIRST, F.col("block") == LAST
    before = F.when(head & (F.col("path") > told.first), ",").when(head & F.lit(told.n > 1), "[").otherwise("")
    after = F.when(end & (F.col("path") == told.last) & F.lit(told.n > 1), "]").otherwise("")
    value = F.concat(before, "value", after)
    lines.select("path", "block", "seq", value.alias("value")).orderBy("path", "block", "seq").select("value").write.text(path)


def _named(rows: DataFrame, *columns: str) -> DataFrame:
    parts = F.split("path", "/")
    return rows.select(F.element_at(parts, -2).alias("project"), F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "").alias("session"), *columns)


def write(documents: DataFrame, path: str) -> None:
    """One file a session, in the folders ``project=<its folder>/session=<its file>`` below ``path``."""
    named = _named(documents, "document")
    named.repartition("project", "session").write.mode("overwrite").partitionBy("project", "session").text(path)
