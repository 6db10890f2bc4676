"""The fact tables that every report reads, whatever they were made from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMAS = {
    "sessions": "session_key long, project string, path string, file_size long, file_mtime long, session_id string, first_ms long, last_ms long, duration_ms long, message_count long, model string",
    "token_usage": "session_key long, model string, messages long, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long, cost_units long, geos array<string>, tiers array<string>, speed double, iterations long",
    "tool_calls": "session_key long, tool string, calls long",
    "turn_durations": "session_key long, turn_number long, duration_ms long, at string",
    "pr_links": "session_key long, pr_number long, pr_url string, pr_repository string, at string",
    "file_modifications": "session_key long, file_path string",
    "thinking_usage": "session_key long, thinking_blocks long",
    "stop_reasons": "session_key long, reason string, times long",
    "attachments": "session_key long, filename string, mime_type string",
    "permission_changes": "session_key long, mode string, at string",
    "messages": "session_key long, line_no long, role string, content string, at string, terms long",
    "postings": "stem string, level int, session_key long, line_no long, role string, terms long, in_role array<int>, in_content array<int>",
}


#: Tables that are sums over sessions, so that those of changed sessions can be taken away again;
#: each with the number of its leading columns that are its key.
SUMS = {
    "levels": ("stem string, level int, n long", 2),
    "by_project": ("project string, sessions long", 1),
    "by_model": ("project string, model string, sessions long, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long, cost_units long", 2),
    "by_tool": ("project string, tool string, calls long", 2),
}


@dataclass
class Index:
    """What a store keeps added up. Of postings: how many there are of each stem and level
    (stem, level, n), the number of messages and of their terms, and the length that levels
    were made for. Of reports: the tables of SUMS. Rows of one key are to be added."""

    levels: DataFrame
    messages: int
    terms: int
    typical: float
    by_project: DataFrame
    by_model: DataFrame
    by_tool: DataFrame


@dataclass
class Facts:
    sessions: DataFrame
    token_usage: DataFrame
    tool_calls: DataFrame
    turn_durations: DataFrame
    pr_links: DataFrame
    file_modifications: DataFrame
    thinking_usage: DataFrame
    stop_reasons: DataFrame
    attachments: DataFrame
    permission_changes: DataFrame
    messages: DataFrame
    postings: DataFrame
    index: Index | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}


def sums(facts: Facts) -> dict[str, DataFrame]:
    """The tables of SUMS but ``levels``, from all facts."""
    own = facts.sessions.select("session_key", "project")
    one, names = F.count(F.lit(1)), [c.split()[0] for c in SUMS["by_model"][0].split(", ")]
    used = facts.token_usage.join(own, "session_key").groupBy("project", "model")
    return {
        "by_project": own.groupBy("project").agg(one.alias("sessions")),
        "by_model": used.agg(one.alias("sessions"), *(F.sum(c).alias(c) for c in names[3:])),
        "by_tool": facts.tool_calls.join(own, "session_key").groupBy("project", "tool").agg(F.sum("calls").alias("calls")),
    }


def added(name: str, rows: DataFrame) -> DataFrame:
    """A table of SUMS with one row a key, without those that came to nothing."""
    schema, keys = SUMS[name]
    names = [c.split()[0] for c in schema.split(", ")]
    out = rows.groupBy(*names[:keys]).agg(*(F.sum(c).alias(c) for c in names[keys:]))
    return out.where(" or ".join(f"{c} <> 0" for c in names[keys:]))
