"""The relational reports: each takes facts and returns one DataFrame.

``project`` is a pattern part matched against a session's project or path,
without regard to case; ``%`` and ``_`` in it are wildcards. Where a report is
limited, rows of equal rank are ordered by name, so a limit is repeatable.
A project without usage has no models. Amounts are summed as whole cost units
and become dollars at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pricing, scalars
from ..sources.facts import Facts, added

LIMIT = 20


def matching(sessions: DataFrame, project: str | None) -> DataFrame:
    if project is None:
        return sessions
    return sessions.where(holds("project", project) | holds("path", project))


def holds(column: str, part: str) -> Column:
    """Whether a text holds a pattern part; a backslash in it stands for itself."""
    pattern = "%" + part.replace("\\", "\\\\") + "%"
    return F.col(column).ilike(pattern)


def _names(values: Column) -> Column:
    return F.array_sort(F.collect_set(values))


def sessions(facts: Facts, project: str | None = None, file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The latest sessions, also of those that touched a file."""
    rows = matching(facts.sessions, project)
    if file is not None:
        touched = facts.file_modifications.where(holds("file_path", file))
        rows = rows.join(touched, "session_key", "left_semi")
    rows = rows.orderBy(F.desc_nulls_last("first_ms"), "path").limit(limit)
    return rows.select("project", "session_id", "path", "first_ms", scalars.rfc3339(F.col("first_ms")).alias("date"), "message_count", "duration_ms", "model")


def cost_by_project(facts: Facts, project: str | None = None, limit: int | None = LIMIT) -> DataFrame:
    """Usage and cost of each project, those without usage too. A store's sums answer for all
    projects; where some are asked for, their sessions tell, as a path can match as well."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*pricing.COUNTERS, "cost_units")]
    names = _names(F.when(F.col("model").isNotNull(), pricing.family(F.col("model")))).alias("models")
    if project is None and facts.index is not None:
        used = added("by_model", facts.index.by_model).where("sessions > 0").drop("sessions")
        counted = added("by_project", facts.index.by_project)
        grouped = counted.join(used, "project", "left").groupBy("project", "sessions").agg(*sums, names)
    else:
        both = matching(facts.sessions, project).select("session_key", "project").join(facts.token_usage, "session_key", "left")
        grouped = both.groupBy("project").agg(F.count_distinct("session_key").alias("sessions"), *sums, names)
    ranked = grouped.orderBy(F.desc("cost_units"), "project")
    if limit is not None:
        ranked = ranked.limit(limit)
    cost = pricing.usd(F.col("cost_units"))
    return ranked.select("project", "sessions", *pricing.COUNTERS, scalars.per(cost, F.col("sessions")).alias("avg_cost_per_session_usd"), cost.alias("cost_usd"), "models")


def with_total(report: DataFrame, name: str, *sums: str) -> DataFrame:
    """A report's rows and the sum of those rows: ``name`` says TOTAL, other columns are null."""
    rows = report.withColumn("_last", F.lit(0))
    total = report.agg(*(F.sum(c).alias(c) for c in sums)).withColumn(name, F.lit("TOTAL")).withColumn("_last", F.lit(1))
    return rows.unionByName(total, allowMissingColumns=True).withColumnRenamed("_last", "is_total")


def cost_per_session(facts: Facts, project: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Sessions with tokens, the dearest first; the model is named where there is one."""
    total = sum((F.col(c) for c in pricing.COUNTERS[1:]), F.col(pricing.COUNTERS[0]))
    used = facts.token_usage.where(total > 0)
    both = matching(facts.sessions, project).select("session_key", "project", "session_id", "path", "first_ms").join(used, "session_key")
    grouped = both.groupBy("session_key", "project", "session_id", "path", "first_ms").agg(_names(F.col("model")).alias("models"), *(F.sum(c).alias(c) for c in pricing.COUNTERS), F.sum("cost_units").alias("cost_units"))
    ranked = grouped.orderBy(F.desc("cost_units"), "path").limit(limit)
    return ranked.select("project", "session_id", "first_ms", F.when(F.size("models") == 1, F.col("models")[0]).alias("model"), "models", *pricing.COUNTERS, pricing.usd(F.col("cost_units")).alias("cost_usd"))


def tools(facts: Facts, project: str | None = None, limit: int = LIMIT) -> DataFrame:
    if project is None and facts.index is not None:
        calls = facts.index.by_tool
    else:
        calls = facts.tool_calls.join(matching(facts.sessions, project).select("session_key"), "session_key")
    return calls.groupBy("tool").agg(F.sum("calls").alias("calls")).where("calls > 0").orderBy(F.desc("calls"), "tool").limit(limit)


def tools_per_session(facts: Facts, project: str | None = None, limit: int = LIMIT, top: int | None = None) -> DataFrame:
    """The latest sessions with their tools as a map; ``top`` keeps each one's most used."""
    calls = facts.tool_calls.groupBy("session_key", "tool").agg(F.sum("calls").alias("calls"))
    if top is not None:
        rank = Window.partitionBy("session_key").orderBy(F.desc("calls"), "tool")
        calls = calls.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)
    maps = calls.groupBy("session_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "calls")))).alias("tools"))
    rows = matching(facts.sessions, project).join(maps, "session_key").orderBy(F.desc_nulls_last("first_ms"), "path").limit(limit)
    return rows.select("project", "session_id", "first_ms", "tools")


#: Bits of a duration's leading digits that tell its range.
RANGE_BITS = 10


def duration_range(ms: Column) -> Column:
    """A number that rises with the duration and is the same for those with equal leading binary
    digits: small durations have one each, and all of 64 bits have some 2**17 together."""
    size = F.when(ms < 0, F.bitwise_not(ms)).otherwise(ms)
    over = F.greatest(F.lit(0), F.length(F.conv(size.cast("string"), 10, 2)) - RANGE_BITS - 1).cast("int")
    code = over.cast("long") * (1 << RANGE_BITS) + F.call_function("shiftright", size, over)
    return F.when(ms < 0, F.bitwise_not(code)).otherwise(code)


def duration_stats(durations: DataFrame, by: str) -> DataFrame:
    """(by, turn_count, avg_ms, p50_ms, p95_ms, max_ms), ranks by the nearest-rank rule.

    Durations are counted by range first, of which there are few whatever their number; only
    the range that holds a rank is looked into. A range of durations below a day holds 2**17
    different ones at most.
    """
    counted = durations.groupBy(by, "duration_ms").agg(F.count(F.lit(1)).alias("n")).withColumn("range", duration_range(F.col("duration_ms")))
    ranges = counted.groupBy(by, "range").agg(F.sum("n").alias("m"), F.sum(F.col("duration_ms") * F.col("n")).alias("total"), F.max("duration_ms").alias("most"))
    own = Window.partitionBy(by)  # of one project's ranges
    placed = ranges.withColumn("reached", F.sum("m").over(own.orderBy("range"))).withColumn("all", F.sum("m").over(own))
    sums = placed.groupBy(by).agg(F.sum("m").alias("turn_count"), (F.sum("total") / F.sum("m")).alias("avg_ms"), F.max("most").alias("max_ms"))
    before = F.col("reached") - F.col("m")
    holds = [F.when((F.col("reached") * 100 >= F.col("all") * p) & (before * 100 < F.col("all") * p), F.lit(p)) for p in (50, 95)]
    held = placed.select(by, "range", "all", before.alias("before"), F.explode(F.array_compact(F.array(*holds))).alias("p"))
    inside = held.join(counted, [by, "range"])
    reached = F.col("before") + F.sum("n").over(Window.partitionBy(by, "p").orderBy("duration_ms"))
    inside = inside.select(by, "p", "duration_ms", (reached * 100 >= F.col("all") * F.col("p")).alias("enough")).where("enough")
    rank = lambda p: F.min(F.when(F.col("p") == p, F.col("duration_ms"))).cast("double").alias(f"p{p}_ms")
    ranks = inside.groupBy(by).agg(rank(50), rank(95))
    return sums.join(ranks, by).select(by, "turn_count", "avg_ms", "p50_ms", "p95_ms", "max_ms")


def turns(facts: Facts, project: str | None = None, limit: int = LIMIT) -> DataFrame:
    both = facts.turn_durations.join(matching(facts.sessions, project).select("session_key", "project"), "session_key")
    return duration_stats(both, "project").orderBy(F.desc("avg_ms"), "project").limit(limit)


def pull_requests(facts: Facts, project: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Each pull request once, with its latest mention; of equally late ones the last path's."""
    both = facts.pr_links.join(matching(facts.sessions, project).select("session_key", "project", "session_id", "path"), "session_key")
    latest = F.max_by(F.struct("project", "session_id", "pr_number", "pr_repository", "at"), F.struct("at", "path", "pr_number"))
    rows = both.groupBy("pr_url").agg(latest.alias("m")).select("m.project", "m.session_id", "m.pr_number", "pr_url", "m.pr_repository", "m.at")
    return rows.orderBy(F.desc("at"), "pr_url").limit(limit)


def files(facts: Facts, project: str | None = None, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The most touched files, with the project that touched each most."""
    touched = facts.file_modifications if path is None else facts.file_modifications.where(holds("file_path", path))
    both = touched.join(matching(facts.sessions, project).select("session_key", "project", "last_ms"), "session_key")
    # A session has one project, so a file's sessions are the sum over its projects.
    by_project = both.groupBy("file_path", "project").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("session_key").alias("sessions"), F.max("last_ms").alias("last_ms")
    )
    top = by_project.groupBy("file_path").agg(
        F.sum("events").alias("modification_count"),
        F.sum("sessions").alias("session_count"),
        F.max("last_ms").alias("last_touched_ms"),
        F.min_by("project", F.struct(-F.col("events"), F.col("project"))).alias("top_project"),
    )
    return top.orderBy(F.desc("modification_count"), "file_path").limit(limit)


def models(facts: Facts, project: str | None = None) -> DataFrame:
    both = facts.token_usage.join(matching(facts.sessions, project).select("session_key"), "session_key")
    # Different lists only, and few differ: they name tiers or places.
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    grouped = both.groupBy(F.coalesce("model", F.lit("")).alias("model")).agg(
        F.count_distinct("session_key").alias("session_count"),
        *(F.sum(c).alias(c) for c in pricing.COUNTERS),
        F.sum("cost_units").alias("cost_units"),
        united("tiers").alias("service_tiers"),
        united("geos").alias("inference_geos"),
        F.avg("speed").alias("avg_speed"),
        F.coalesce(F.sum("iterations"), F.lit(0)).alias("total_iterations"),
    )
    tokens = sum((F.col(c) for c in pricing.COUNTERS[1:]), F.col(pricing.COUNTERS[0]))
    cost = pricing.usd(F.col("cost_units"))
    rows = grouped.select("model", pricing.family(F.col("model")).alias("model_family"), "session_count", *pricing.COUNTERS, scalars.per(cost, F.col("session_count")).alias("avg_cost_per_session_usd"), scalars.per(tokens.cast("double"), F.col("session_count")).alias("avg_tokens_per_session"), "service_tiers", "inference_geos", "avg_speed", "total_iterations", cost.alias("cost_usd"))
    return rows.orderBy(F.desc("cost_usd"), "model")


def select_sessions(sessions_: DataFrame, selector: str) -> DataFrame:
    """Sessions whose id begins with the selector; else those whose project holds it, unless it looks like an id."""
    wanted = selector.lower()
    stem = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.jsonl$", ""))
    found = sessions_.where(F.startswith(stem, F.lit(wanted)))
    bare = wanted.replace("-", "")
    if not found.isEmpty() or (len(bare) >= 6 and all(c in "0123456789abcdef" for c in bare)):
        return found
    return sessions_.where(F.contains(F.lower("project"), F.lit(wanted)))


def one_session(sessions_: DataFrame, selector: str) -> DataFrame:
    """The only session of a selector; LookupError names up to eight where there are more, or says there is none."""
    found = select_sessions(sessions_, selector)
    paths = [r.path for r in found.select("path").orderBy("path").limit(9).collect()]
    if len(paths) != 1:
        raise LookupError(f"no session matches {selector!r}" if not paths else f"{selector!r} is ambiguous: {', '.join(paths[:8])}")
    return found.where(F.col("path") == paths[0])


#: The order of each part of a session's detail; ``-`` marks falling columns.
PARTS = {
    "tools": ("-calls", "tool"),
    "pull_requests": ("-at", "pr_url"),
    "files": ("file_path",),
    "stop_reasons": ("-times", "reason"),
    "attachments": ("filename", "mime_type"),
    "permission_changes": ("at", "mode"),
    "models": ("-cost_usd", "model"),
}


def _parts(facts: Facts, chosen: DataFrame) -> dict[str, DataFrame]:
    own = lambda df: df.join(chosen.select("session_key"), "session_key")
    used = own(facts.token_usage).select("session_key", "model", *pricing.COUNTERS, pricing.usd(F.col("cost_units")).alias("cost_usd"))
    return {
        "tools": own(facts.tool_calls).select("session_key", "tool", "calls"),
        "pull_requests": own(facts.pr_links),
        "files": own(facts.file_modifications).select("session_key", "file_path").distinct(),
        "turns": duration_stats(own(facts.turn_durations), "session_key"),
        "stop_reasons": own(facts.stop_reasons).select("session_key", "reason", "times"),
        "attachments": own(facts.attachments).select("session_key", "filename", "mime_type"),
        "permission_changes": own(facts.permission_changes).select("session_key", "mode", "at"),
        "models": used,
    }


def session_children(facts: Facts, chosen: DataFrame) -> dict[str, DataFrame]:
    """The parts of a session's detail, each in its order; ``chosen`` has session_key."""
    parts = _parts(facts, chosen)
    for name, keys in PARTS.items():
        order = (F.desc(k[1:]) if k[0] == "-" else F.asc(k) for k in keys)
        parts[name] = parts[name].orderBy("session_key", *order)
    return parts


def session(facts: Facts, selector: str) -> DataFrame:
    """One nested row with all parts of the selected session."""
    chosen = one_session(facts.sessions, selector)
    out = chosen
    for name, rows in _parts(facts, chosen).items():
        columns = [c for c in rows.columns if c != "session_key"]
        if name == "turns":
            out = out.join(rows.select("session_key", F.struct(*columns).alias(name)), "session_key", "left")
            continue
        # One session's parts fit one row; they are sorted inside it.
        nested = rows.groupBy("session_key").agg(F.collect_list(F.struct(*columns)).alias(name))
        out = out.join(nested, "session_key", "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
        out = out.withColumn(name, F.array_sort(name, _comparator(PARTS[name])))
    own = lambda df: df.join(chosen.select("session_key"), "session_key", "left_semi").groupBy("session_key")
    sums = own(facts.token_usage).agg(*(F.sum(c).alias(c) for c in pricing.COUNTERS), F.sum("cost_units").alias("cost_units"))
    thinking = own(facts.thinking_usage).agg(F.sum("thinking_blocks").alias("thinking_blocks"))
    out = out.join(sums, "session_key", "left").join(thinking, "session_key", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in (*pricing.COUNTERS, "thinking_blocks")]
    head = ("project", "session_id", "path", "first_ms", "last_ms", "duration_ms", "message_count", "model")
    return out.select(*head, *counts, pricing.usd(F.coalesce("cost_units", F.lit(0))).alias("cost_usd"), *PARTS, "turns")


def _comparator(keys: tuple[str, ...]):
    """Order by fields in turn; ``-`` marks falling ones, nulls count as smallest."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for key in reversed(keys):
            name, falling = key.lstrip("-"), key[0] == "-"
            x, y = (b[name], a[name]) if falling else (a[name], b[name])
            less = (x < y) | (x.isNull() & y.isNotNull())
            more = (x > y) | (x.isNotNull() & y.isNull())
            out = F.when(less, -1).when(more, 1).otherwise(out)
        return out

    return compare


def summary_totals(facts: Facts, now_ms: int) -> DataFrame:
    """One row of totals; today and this week begin at midnight UTC, the week on Monday."""
    week = scalars.week_start(now_ms)
    begun = facts.sessions.agg(F.count(F.lit(1)).alias("total_sessions"), F.count_if(F.col("first_ms") >= scalars.day_start(now_ms)).alias("sessions_today"), F.count_if(F.col("first_ms") >= week).alias("sessions_this_week"))
    used = facts.sessions.select("session_key", "first_ms").join(facts.token_usage, "session_key")
    zero = F.lit(0)
    cost = used.agg(
        F.coalesce(F.sum("cost_units"), zero).alias("cost_units"), F.coalesce(F.sum(F.when(F.col("first_ms") >= week, F.col("cost_units"))), zero).alias("week_units"), *(F.coalesce(F.sum(c), zero).alias(c) for c in pricing.COUNTERS)
    )
    thinking = facts.thinking_usage.agg(F.coalesce(F.sum("thinking_blocks"), zero).alias("thinking_blocks"))
    turns_ = facts.turn_durations.agg(F.avg("duration_ms").alias("avg_turn_ms"))
    prs = facts.pr_links.where("pr_url <> ''").agg(F.count_distinct("pr_url").alias("pr_count"))
    touched = facts.file_modifications.agg(F.count_distinct("file_path").alias("files_modified"))
    out = begun
    for one_row in (cost, thinking, turns_, prs, touched):
        out = out.crossJoin(F.broadcast(one_row))  # each is an aggregate of one row
    return out.withColumn("cost_usd", pricing.usd(F.col("cost_units"))).withColumn("week_cost_usd", pricing.usd(F.col("week_units"))).drop("cost_units", "week_units")


def top_projects(facts: Facts, limit: int = 5) -> DataFrame:
    return facts.sessions.groupBy("project").agg(F.count(F.lit(1)).alias("sessions")).orderBy(F.desc("sessions"), "project").limit(limit)


def top_tools(facts: Facts, limit: int = 5) -> DataFrame:
    return facts.tool_calls.groupBy("tool").agg(F.sum("calls").alias("calls")).orderBy(F.desc("calls"), "tool").limit(limit)


def top_stop_reasons(facts: Facts, limit: int = 5) -> DataFrame:
    return facts.stop_reasons.groupBy("reason").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "reason").limit(limit)


def model_distribution(facts: Facts, limit: int = 5) -> DataFrame:
    """Sessions and cost by family; usage without a model is of an unknown one."""
    name = F.when(F.col("model").isNull(), F.lit("Unknown")).otherwise(pricing.family(F.col("model")))
    grouped = facts.token_usage.groupBy(name.alias("family")).agg(F.count_distinct("session_key").alias("sessions"), F.sum("cost_units").alias("cost_units"))
    return grouped.orderBy(F.desc("cost_units"), "family").limit(limit).select("family", "sessions", pricing.usd(F.col("cost_units")).alias("cost_usd"))


def most_recent(facts: Facts) -> DataFrame:
    return facts.sessions.where("first_ms is not null").orderBy(F.desc("first_ms"), "path").limit(1).select("project", "session_id", "first_ms", "model", "message_count")


def summary(facts: Facts, now_ms: int) -> DataFrame:
    """The dashboard as one nested row."""
    out = summary_totals(facts, now_ms)
    lists = {"top_projects": (top_projects(facts), ("-sessions", "project")), "top_tools": (top_tools(facts), ("-calls", "tool")), "top_stop_reasons": (top_stop_reasons(facts), ("-times", "reason")), "model_distribution": (model_distribution(facts), ("-cost_usd", "family")), "most_recent": (most_recent(facts), ("first_ms",))}
    for name, (rows, keys) in lists.items():  # at most five rows each
        out = out.crossJoin(F.broadcast(rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns)), _comparator(keys)).alias(name))))
    return out.withColumn("most_recent", F.get("most_recent", F.lit(0)))
