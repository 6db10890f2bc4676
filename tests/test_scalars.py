import pytest
from pyspark.sql import functions as F

from sessionlore.functions import pricing, scalars, search_text


def values(spark, column, inputs, kind):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("function", "kind", "cases"),
    [
        (scalars.decode_project, "string", {"-Users-x": "/Users/x", "--claude": "/.claude", "-a---b": "/a/./b"}),
        (scalars.canonical_project, "string", {"/a/.claude/worktrees/w": "/a", "/a/b": "/a/b"}),
        (scalars.display_project, "string", {"/x/a/.claude/worktrees/w": "a (worktree)", "/a/b": "/a/b"}),
        (scalars.format_duration, "long", {0: "-", 999: "0s", 59_999: "59s", 60_000: "1m0s", 3_600_000: "1h0m", 86_400_000: "24h0m"}),
        (scalars.format_cost, "double", {0.0: "$0.00", 0.004: "$0.0040", 0.005: "$0.01", 1234.5: "$1,234.50", -2.0: "-$2.00", 0.125: "$0.13"}),
        (scalars.format_count, "long", {0: "0", 1234567: "1,234,567"}),
        (scalars.rfc3339, "long", {0: "1970-01-01T00:00:00+00:00", 1776506400500: "2026-04-18T10:00:00.500+00:00", -1: "1969-12-31T23:59:59.999+00:00"}),
        (scalars.short_time, "string", {"2026-04-18T10:11:12Z": "10:11:12", "10:11:12.5": "10:11:12", "x": "x", "": ""}),
        (scalars.short_model, "string", {"claude-claude-x": "x", "m": "m"}),
        (scalars.split_values, "string", {"a, b\x1fa,,": ["a", "b"], "": []}),
        (scalars.rollout_id, "string", {"rollout-2026-01-01T00-00-00-01234567-89ab-cdef-0123-456789abcdef": "01234567-89ab-cdef-0123-456789abcdef", "x-7": "7"}),
    ],
)
def test_scalar(spark, function, kind, cases):
    assert values(spark, function, list(cases), kind) == list(cases.values())


def test_short_name(spark):
    long = "/Users/someone/Projects/" + "deep/" * 10 + "end"
    short, same, cut = values(spark, scalars.short_name, [long, "/a/b", "é" * 40], "string")
    assert len(short.encode()) <= 55 and short.startswith("…/") and long.endswith(short[1:])
    assert same == "/a/b" and cut == "…" + "é" * 26


@pytest.mark.parametrize(("model", "name", "dollars"), [("claude-opus-4", "Opus", 110.25), ("X-Haiku", "Haiku", 5.88), ("<synthetic>", "Sonnet", 22.05), ("", "Sonnet", 22.05), (None, "Sonnet", 22.05)])
def test_pricing(spark, model, name, dollars):
    million = (F.lit(1_000_000),) * 4
    row = spark.createDataFrame([(model,)], "m string").select(pricing.family(F.col("m")), pricing.usd(pricing.cost_units(F.col("m"), million))).first()
    assert tuple(row) == (name, pytest.approx(dollars))


def test_week():
    monday = 1776038400000  # 2026-04-13
    assert [scalars.week_start(monday + d * 86_400_000 + 5) for d in (0, 6, 7)] == [monday, monday, monday + 7 * 86_400_000]


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "relational": "relat", "triplicate": "triplic", "adoption": "adopt", "controll": "control", "generalizations": "gener", "sky": "sky", "été": "été"}
    assert {w: search_text.stem(w) for w in pairs} == pairs
