"""Scalar helpers of the reports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the transcript format.
WORKTREES = "/.claude/worktrees/"
MODEL_PREFIX = "^(claude-)+"
SEPARATORS = r"[\x1f,]"
SHORT_NAME, ELLIPSIS = 55, "…"


def decode_project(name: Column) -> Column:
    """A project folder's name as a path: two dashes are a hidden folder's start, one is a slash."""
    return F.replace(F.replace(name, F.lit("--"), F.lit("/.")), F.lit("-"), F.lit("/"))


def canonical_project(path: Column) -> Column:
    """Work trees belong to the project that holds them."""
    return F.substring_index(path, WORKTREES, 1)


def display_project(path: Column) -> Column:
    base = canonical_project(path)
    return F.when(F.contains(path, F.lit(WORKTREES)), F.concat(F.substring_index(base, "/", -1), F.lit(" (worktree)"))).otherwise(path)


def short_name(path: Column) -> Column:
    """At most 55 bytes: the end of a longer path from its next slash, after an ellipsis.

    Bytes are cut in binary form; a cut inside a character drops its rest.
    """
    room = SHORT_NAME - len(ELLIPSIS.encode())
    raw = path.cast("binary")
    tail = F.regexp_replace(F.make_valid_utf8(F.substring(raw, -room, room).cast("string")), "^\ufffd+", "")
    at = F.instr(tail, "/")
    return F.when(F.octet_length(path) <= SHORT_NAME, path).otherwise(F.concat(F.lit(ELLIPSIS), F.when(at > 0, F.substr(tail, at)).otherwise(tail)))


def format_duration(ms: Column) -> Column:
    """``-``, seconds, minutes and seconds, or hours and minutes."""
    seconds = F.floor(ms / 1000)
    text = lambda a, x, b, y: F.concat(F.floor(a).cast("string"), F.lit(x), F.floor(b).cast("string"), F.lit(y))
    return (
        F.when(ms == 0, F.lit("-"))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds < 3600, text(seconds / 60, "m", seconds % 60, "s"))
        .otherwise(text(seconds / 3600, "h", (seconds % 3600) / 60, "m"))
    )


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


def format_cost(usd: Column) -> Column:
    """Dollars with thousands and cents, halves away from zero; four digits below half a cent."""
    size = F.abs(usd)
    sign = F.when(usd < 0, F.lit("-$")).otherwise(F.lit("$"))
    cents = F.floor(size * 100 + 0.5)
    whole = F.format_number(F.floor(cents / 100), 0)
    usual = F.concat(sign, whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    small = F.concat(sign, F.lit("0."), F.lpad(F.floor(size * 10000 + 0.5).cast("string"), 4, "0"))
    return F.when((size > 0) & (size < 0.005), small).otherwise(usual)


def rfc3339(ms: Column) -> Column:
    """UTC text of epoch milliseconds, whatever the session's time zone; whole seconds have no fraction."""
    days, rest = F.floor(ms / 86_400_000), F.pmod(ms, F.lit(86_400_000))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    date = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string")
    part = F.when(rest % 1000 == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0")))
    return F.concat(date, F.lit("T"), two(rest / 3_600_000), F.lit(":"), two(rest % 3_600_000 / 60_000), F.lit(":"), two(rest % 60_000 / 1000), part, F.lit("+00:00"))


def short_id(session: Column) -> Column:
    return F.substring(session, 1, 8)


def short_model(model: Column) -> Column:
    return F.regexp_replace(model, MODEL_PREFIX, "")


def model_label(models: Column) -> Column:
    """None, the only model, or ``mixed``."""
    return F.when(F.size(models) == 1, models[0]).when(F.size(models) > 1, F.lit("mixed"))


def split_values(text: Column) -> Column:
    """Values joined by a unit separator or comma: trimmed, without empties or repeats, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def rollout_id(stem: Column) -> Column:
    """The id at the end of a rollout file's name."""
    return F.when(F.startswith(stem, F.lit("rollout-")) & (F.length(stem) >= 36), F.substring(stem, -36, 36)).otherwise(F.substring_index(stem, "-", -1))


def short_time(at: Column) -> Column:
    """HH:MM:SS of a timestamp text, or what there is of it."""
    return F.when(F.length(at) >= 19, F.substring(at, 12, 8)).when(F.length(at) >= 8, F.substring(at, 1, 8)).otherwise(at)


def per(total: Column, count: Column) -> Column:
    """A mean that is 0 where nothing was counted."""
    return F.coalesce(F.try_divide(total, count), F.lit(0.0))


def day_start(now_ms: int) -> int:
    return now_ms - now_ms % 86_400_000


def week_start(now_ms: int) -> int:
    """Midnight, UTC, of the week's Monday."""
    days = now_ms // 86_400_000
    return (days - (days + 3) % 7) * 86_400_000
