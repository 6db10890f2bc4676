"""Reports over transcript trees, against values worked out by hand from the tree's own lines."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sessionlore.operators import export, reports, search, sinks
from sessionlore.plans.registry import QUERIES
from sessionlore.sources import shared, store, transcripts
from sessionlore.sources.store import Store

from .trees import BENCH, GLAZE, HAIKU, OPUS, SONNET, Session, text, use, workshop


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    return transcripts.read(spark, str(workshop(tmp_path_factory.mktemp("workshop"))))


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_sessions(facts):
    got = {r.session_id: (r.project, r.message_count, r.duration_ms, r.model) for r in facts.sessions.collect()}
    assert got == {
        "5e7a10c4-kiln": (GLAZE, 4, 5250, "mixed"),  # every system duration counts, not turns alone
        "5e7a77b2-tree": (GLAZE, 2, 90_000 + 270_000, SONNET),  # no durations: from the first time to the last
        "b0d1e6-undated": (BENCH, 1, 70, OPUS),
        "77cafe-cache": (f"{BENCH}/.cache", 1, 2000, OPUS),
        "e9-questions": (BENCH, 2, 9000, None),
    }
    assert [r.session_id for r in reports.sessions(facts).collect()] == ["e9-questions", "5e7a77b2-tree", "5e7a10c4-kiln", "77cafe-cache", "b0d1e6-undated"]
    assert rows(reports.sessions(facts, file="CELADON"), "session_id", "date") == [("5e7a77b2-tree", "2025-03-03T09:00:00+00:00"), ("5e7a10c4-kiln", "2025-03-03T08:00:00+00:00")]
    assert {r.session_id for r in reports.sessions(facts, project="Mo/BENCH").collect()} == {"b0d1e6-undated", "77cafe-cache", "e9-questions"}
    assert reports.sessions(facts, project="mo\\bench").count() == 0  # a backslash stands for itself
    assert reports.sessions(facts, project="pots_glaze").count() == 2  # and _ for any character


def test_costs(facts):
    haiku = (200 * 0.8 + 40 * 4 + 8 * 1 + 64 * 0.08) / 1e6
    sonnet = (700 * 3 + 90 * 15) / 1e6
    ash = (40 * 3 + 5 * 15 + 900 * 0.3) / 1e6
    fired = (10 * 15 + 2 * 75 + 1 * 18.75 + 3 * 1.5) / 1e6
    got = rows(reports.cost_by_project(facts), "project", "sessions", "input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens", "cost_usd", "models")
    assert got == [
        (GLAZE, 2, 940, 135, 8, 964, pytest.approx(haiku + sonnet + ash), ["Haiku", "Sonnet"]),
        (BENCH, 2, 10, 2, 1, 3, pytest.approx(fired), ["Opus"]),
        (f"{BENCH}/.cache", 1, 0, 0, 0, 0, 0.0, []),
    ]
    got = rows(reports.cost_per_session(facts), "session_id", "cost_usd", "model", "models")
    assert got == [
        ("5e7a10c4-kiln", pytest.approx(haiku + sonnet), None, [HAIKU, SONNET]),
        ("5e7a77b2-tree", pytest.approx(ash), SONNET, [SONNET]),
        ("b0d1e6-undated", pytest.approx(fired), OPUS, [OPUS]),
    ]
    total = reports.with_total(reports.cost_by_project(facts, limit=2), "project", "sessions", "output_tokens").where("is_total = 1").first()
    assert (total.project, total.sessions, total.output_tokens) == ("TOTAL", 4, 137)


def test_tools_and_turns(facts):
    assert rows(reports.tools(facts), "tool", "calls") == [("Fire", 3), ("Weigh", 2), ("Stir", 1)]
    assert rows(reports.tools_per_session(facts), "session_id", "tools") == [("5e7a10c4-kiln", {"Stir": 1, "Weigh": 2}), ("b0d1e6-undated", {"Fire": 3})]
    assert rows(reports.tools_per_session(facts, top=1), "tools") == [({"Weigh": 2},), ({"Fire": 3},)]
    got = rows(reports.turns(facts), "project", "turn_count", "avg_ms", "p50_ms", "p95_ms", "max_ms")
    assert got == [(f"{BENCH}/.cache", 1, 2000.0, 2000.0, 2000.0, 2000), (GLAZE, 3, 5000 / 3, 1200.0, 3000.0, 3000), (BENCH, 1, 70.0, 70.0, 70.0, 70)]
    numbers = {r.duration_ms: r.turn_number for r in facts.turn_durations.collect()}
    assert numbers == {1200: 1, 800: 2, 3000: 3, 70: 1, 2000: 1}


def test_ranks_with_repeated_durations(spark):
    frame = spark.createDataFrame([("a", d) for d in [5] * 18 + [6, 7]] + [("b", d) for d in (4, 4, 9)], "by string, duration_ms long")
    got = {r["by"]: (r.turn_count, r.p50_ms, r.p95_ms, r.max_ms) for r in reports.duration_stats(frame, "by").collect()}
    assert got == {"a": (20, 5.0, 6.0, 7), "b": (3, 4.0, 9.0, 9)}


def test_ranks_of_many_durations(spark):
    """A project with ever new durations, of all magnitudes, beside small ones."""
    rng = random.Random(8)
    values = [rng.choice([rng.randrange(3000), rng.randrange(10**9), rng.randrange(1 << 50), -rng.randrange(5000)]) for _ in range(4000)]
    rows = [("hot", v) for v in values] + [("one", 1 << 50)] + [("low", v % 5) for v in values[:40]]
    frame = spark.createDataFrame(rows, "by string, duration_ms long")
    for r in reports.duration_stats(frame, "by").collect():
        own = sorted(v for b, v in rows if b == r["by"])
        at = lambda p: float(own[-(-len(own) * p // 100) - 1])  # noqa: E731, B023
        assert (r.turn_count, r.p50_ms, r.p95_ms, r.max_ms) == (len(own), at(50), at(95), own[-1])
    codes = frame.select("duration_ms", reports.duration_range(frame.duration_ms).alias("code")).distinct().orderBy("duration_ms").collect()
    assert [r.code for r in codes] == sorted(r.code for r in codes)
    small = [r for r in codes if -2048 <= r.duration_ms < 2048]
    assert len({r.code for r in small}) == len(small)


def test_links_and_files(facts):
    got = rows(reports.pull_requests(facts), "session_id", "pr_number", "pr_url")
    assert got == [("5e7a77b2-tree", 4, ""), ("5e7a77b2-tree", 31, "https://forge/pots/31")]  # the later mention wins
    got = rows(reports.files(facts), "file_path", "modification_count", "session_count", "top_project")
    assert got == [("recipes/celadon.md", 2, 2, GLAZE), ("log.txt", 1, 1, GLAZE)]


def test_models(facts):
    got = {r.model: (r.session_count, r.service_tiers, r.inference_geos, r.avg_speed, r.total_iterations) for r in reports.models(facts).collect()}
    assert got == {HAIKU: (1, ["flex", "rush"], ["eu"], None, 0), SONNET: (2, [], ["us"], 1.5, 4), OPUS: (1, [], [], None, 0)}


def test_session_detail(facts):
    one = reports.session(facts, "5E7A10")
    assert rows(one, "message_count", "thinking_blocks", "input_tokens") == [(4, 2, 900)]
    one = one.first()
    assert [t.tool for t in one.tools] == ["Weigh", "Stir"] and [f.file_path for f in one.files] == ["log.txt", "recipes/celadon.md"]
    assert [m.model for m in one.models] == [SONNET, HAIKU] and [a.filename for a in one.attachments] == ["swatch.png"]
    assert [(s.reason, s.times) for s in one.stop_reasons] == [("end_turn", 2), ("tool_use", 1)]
    assert (one.turns.turn_count, one.turns.p50_ms) == (3, 1200.0)
    undated = reports.session(facts, "b0d1").first()
    assert [p["mode"] for p in undated.permission_changes] == ["plan"] and undated.pull_requests == [] and undated.first_ms is None
    assert reports.session(facts, ".cache").first().session_id == "77cafe-cache"  # by project
    with pytest.raises(LookupError, match="ambiguous"):
        reports.one_session(facts.sessions, "5e7a")
    with pytest.raises(LookupError, match="no session"):
        reports.one_session(facts.sessions, "0badc0de")


def test_summary(facts):
    one = reports.summary(facts, 1_741_089_600_000).first()  # 2025-03-04T12:00:00Z, a Tuesday
    assert (one.total_sessions, one.sessions_today, one.sessions_this_week, one.pr_count, one.files_modified, one.thinking_blocks) == (5, 0, 4, 1, 2, 2)
    assert one.most_recent.session_id == "e9-questions" and [t.tool for t in one.top_tools] == ["Fire", "Weigh", "Stir"]
    assert [m.family for m in one.model_distribution] == ["Sonnet", "Haiku", "Opus"]


def test_search(facts):
    found = search.search(facts, "glazes").collect()  # any form of the word
    assert sorted((r.session_id, r.role) for r in found) == [("5e7a10c4-kiln", "assistant"), ("5e7a10c4-kiln", "user")]
    assert {r.snippet for r in found} == {"mix a celadon [[glaze]]", "[[Glazes]] are stirred"}
    assert rows(search.search(facts, "glazes", stem=False), "role", "snippet") == [("assistant", "[[Glazes]] are stirred")]
    assert rows(search.search(facts, "is STIRRING"), "session_id", "snippet") == [("5e7a77b2-tree", "ash [[is]] [[stirred]] in")]
    assert search.search(facts, "stirred is").count() == 0 and search.search(facts, "?!").count() == 0
    assert rows(search.search(facts, "glaze", project="bench"), "role") == []
    assert rows(search.literal(facts, "ASH", case_sensitive=False), "session_id") == [("5e7a77b2-tree",), ("5e7a77b2-tree",)]
    assert search.literal(facts, "ASH").count() == 0
    ranks = [r["rank"] for r in search.search(facts, "user").collect()]  # roles are words of their messages
    assert len(ranks) == 3 and ranks == sorted(ranks) and ranks[0] < 0


def test_long_snippet(spark):
    frame = spark.createDataFrame([(" ".join([*(f"a{i}" for i in range(30)), "hits", *(f"b{i}" for i in range(30))]),)], "t string")
    got = frame.select(search.snippet(frame.t, ["hit"])).first()[0]
    assert got.startswith("...a20 ") and "[[hits]]" in got and got.endswith("...") and len(got.split()) == 20


def test_coercion(spark, tmp_path):
    odd = Session("odd")
    for value in ("7.25", "-1", "4.0", '"9"', "false", "[3]"):
        odd.raw('{"type":"assistant","timestamp":17,"message":{"model":"m","usage":{"input_tokens":%s,"output_tokens":2},"content":"plain"}}' % value)
    odd.raw('{"type":"user","timestamp":"2025-03-03","message":{"content":""}}').raw('{"type":"pr-link","prNumber":"8"}').raw('{"type":"system","durationMs":-9}')
    odd.raw('{"type":"x","type":"permission-mode","mode":"last"}').save(tmp_path, "-a--b")
    f = transcripts.read(spark, str(tmp_path))
    head = f.sessions.first()
    assert (head.project, head.session_id, head.first_ms, head.message_count, head.duration_ms) == ("/a/.b", "odd", None, 7, 0)
    assert rows(f.token_usage, "input_tokens", "output_tokens", "messages") == [(0, 12, 6)]
    assert f.messages.count() == 0 and rows(f.pr_links, "pr_number", "pr_url", "at") == [(0, "", "")]


def test_order_in_a_divided_file(spark, tmp_path):
    """Line order holds where a file is read in many blocks."""
    long = Session("long")
    for i in range(3000):
        long.turn(i + 1) if i % 3 else long.ask(f"question {i}")
    long.save(tmp_path, "-x")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        f = transcripts.read(spark, str(tmp_path))
        got = [r.duration_ms for r in f.turn_durations.orderBy("turn_number").collect()]
        asked = {r.line_no: r.content for r in f.messages.collect()}
        blocks = transcripts.read_lines(spark, str(tmp_path)).select("block").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert blocks > 5 and got == [i + 1 for i in range(3000) if i % 3]
    assert asked == {i: f"question {i}" for i in range(0, 3000, 3)}  # plain numbers, as in a file of one block


def test_plain_line_numbers(spark, tmp_path):
    Session("n").raw("").raw("bad").ask("first").raw("").ask("second").save(tmp_path, "-x")
    Session("m").ask("third").save(tmp_path, "-x")
    got = {r.content: r.line_no for r in transcripts.read(spark, str(tmp_path)).messages.collect()}
    assert got == {"first": 2, "second": 4, "third": 0}


def test_facts_read_their_own_part(facts):
    """A fact's scan reads the records of its type, and no whole records."""
    for table, kind in (("token_usage", "assistant"), ("turn_durations", "system"), ("pr_links", "pr-link"), ("attachments", "attachment")):
        plan = getattr(facts, table)._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.split("\n") if "FileScan parquet" in x]
        assert len(scans) == 1 and f"= {kind})" in scans[0].split("PartitionFilters")[1] and ":variant" not in plan, table
    for table in facts.tables().values():
        schemas = [x for x in table._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in x]
        assert all("v:variant" not in x.split("ReadSchema")[1] for x in schemas)


def test_no_root(spark, tmp_path):
    f = transcripts.read(spark, str(tmp_path / "nowhere"))
    assert f.sessions.count() == 0 and reports.cost_by_project(f).count() == 0
    assert reports.summary(f, 0).first().total_sessions == 0 and search.search(f, "word").count() == 0
    assert sinks.report_json(reports.sessions(f)).first().json == "[]" and sinks.report_json(reports.sessions(f), one=True).first().json == "null"


def test_report_json(facts):
    listed = json.loads(sinks.report_json(reports.sessions(facts)).first().json)
    assert [s["session_id"] for s in listed][::4] == ["e9-questions", "b0d1e6-undated"] and listed[4]["first_ms"] is None
    one = json.loads(sinks.report_json(reports.session(facts, "77cafe"), one=True).first().json)
    assert one["project"] == f"{BENCH}/.cache" and one["tools"] == []


def test_export(spark, tmp_path):
    records = transcripts.records(transcripts.read_lines(spark, str(workshop(tmp_path / "in"))))
    f = transcripts.facts(records)
    tree = f.sessions.where("session_id like '%tree'")
    told = export.markdown(tree, records).first().document
    assert told.startswith(f"# Session: 5e7a77b2\n\n**Project:** {GLAZE}\n**Date:** 2025-03-03 09:00 UTC\n**Model:** sonnet-4-5\n\n---\n\n## User\n*2025-03-03T09:00:00*\n\ntry ash\n")
    assert "**Tool result** (u9)\n```\ngrey\n```\n" in told
    kiln = export.markdown(f.sessions.where("session_id like '%kiln'"), records).first().document
    assert '**Tool: Weigh**\n```json\n{\n  "grams" : 40\n}\n```\n' in kiln or '"grams"' in kiln
    documents = export.json_document(f.sessions, records)
    one = json.loads(export.selected_json(documents.where("path like '%tree%'")).first().document)
    assert one["session_id"] == "5e7a77b2-tree" and [m["type"] for m in one["messages"]] == ["user", "assistant"]
    both = json.loads(export.selected_json(documents.where("path like '%5e7a%'")).first().document)
    assert [d["message_count"] for d in both] == [2, 4] and json.loads(export.selected_json(documents.limit(0)).first().document) == []
    export.write(export.markdown(f.sessions, records), str(tmp_path / "out"))
    files = {p.parent.name: p.read_text() for p in (tmp_path / "out").rglob("part-*") if p.suffix != ".crc"}
    assert len(files) == 5 and files["session=5e7a77b2-tree"] == told + "\n"
    assert export.markdown_messages(f.sessions, f.messages).count() == 5
    # The same bytes from pieces.
    read = lambda name: {p.parent.name: p.read_bytes() for p in (tmp_path / name).rglob("part-*") if p.suffix != ".crc"}
    export.write_lines(export.markdown_lines(f.sessions, records), str(tmp_path / "pieces"))
    assert read("pieces") == read("out") and len(read("out")) == 5
    export.write(documents, str(tmp_path / "json"))
    export.write_lines(export.json_lines(f.sessions, records), str(tmp_path / "json-pieces"))
    assert read("json-pieces") == read("json") and len(read("json")) == 5
    for name, like in (("one", "%tree%"), ("both", "%5e7a%"), ("none", "nothing")):
        some = f.sessions.where(f"path like '{like}'")
        export.write_selected(export.json_lines(some, records), str(tmp_path / name))
        told = b"".join(p.read_bytes() for p in sorted((tmp_path / name).glob("part-*")))
        want = export.selected_json(export.json_document(some, records)).first().document
        assert json.loads(told) == json.loads(want)


def test_export_of_a_long_session(spark, tmp_path):
    """Pieces are written as they come: no plan gathers a session."""
    long = Session("long")
    for i in range(4000):
        long.ask(f"question {i} " + "word " * 200, at="10:00:00")
    long.save(tmp_path / "in", "-x")
    records = transcripts.records(transcripts.read_lines(spark, str(tmp_path / "in")))
    f = transcripts.facts(records)
    for lines in (export.markdown_lines(f.sessions, records), export.json_lines(f.sessions, records)):
        plan = lines._jdf.queryExecution().toString()
        assert "collect_list" not in plan and lines.agg({"value": "max"}).count() == 1
        assert max(len(r.value) for r in lines.collect()) < 1500 and lines.count() == 4002
    export.write_lines(export.json_lines(f.sessions, records), str(tmp_path / "out"))
    (path,) = [p for p in (tmp_path / "out").rglob("part-*") if p.suffix != ".crc"]
    assert [m["message"]["content"].split()[1] for m in json.loads(path.read_text())["messages"]] == list(map(str, range(4000)))


def test_store(spark, tmp_path, monkeypatch):
    root = workshop(tmp_path / "in")
    read = []
    plain = store.read_lines
    monkeypatch.setattr(store, "read_lines", lambda *a, **k: read.append(k["paths"]) or plain(*a, **k))
    held = Store(spark, str(tmp_path / "store"))
    assert held.facts() is None and held.sync(str(root), now_ms=1) == 5 and read == [None]
    before = held.facts()
    assert before.sessions.count() == 5 and [r.session_id for r in search.search(before, "stirring").collect()] != []
    assert held.sync(str(root), now_ms=2) == 0 and held.sync(str(root), now_ms=3) == 0 and len(read) == 1
    base = held.manifest().runs
    (root / "-home-mo-bench" / "e9-questions.jsonl").unlink()
    new = Session("new [1] a%20b+c").ask("brand new").save(root, "-home-mo-bench")
    Session("5e7a77b2-tree").ask("other words").answer(use("Rinse"), used=(1, 1, 0, 0)).save(root, "-srv-pots-glaze--claude-worktrees-ash")
    assert held.ensure_fresh(str(root), now_ms=4).sessions.count() == 5  # still fresh enough
    f = held.ensure_fresh(str(root), now_ms=400_000)
    assert len(read) == 2 and len(read[1]) == 2 and any(new.stem in p.replace("\\", "") for p in read[1])  # changed files only
    assert {r.session_id for r in f.sessions.collect()} == {"5e7a10c4-kiln", "5e7a77b2-tree", "b0d1e6-undated", "77cafe-cache", "new [1] a%20b+c"}
    assert search.literal(f, "ash").count() == 0 and {r.tool for r in reports.tools(f).collect()} == {"Fire", "Weigh", "Stir", "Rinse"}
    assert rows(search.search(f, "news"), "session_id") == [("new [1] a%20b+c",)] and search.search(f, "ash").count() == 0
    runs = held.manifest().runs
    assert runs[:1] == base and len(runs) == 2 and runs[1].messages == 2 - 3  # two came, three went
    now = transcripts.read(spark, str(root))
    for name, table in f.tables().items():  # but for the levels, which a store makes for its own mean
        assert sorted(map(str, table.drop("level").collect())) == sorted(map(str, getattr(now, name).drop("level").collect())), name
    assert held.sync(str(root), now_ms=5) == 0 and held.sync(str(root), now_ms=6) == 0 and held.facts().sessions.count() == 5
    other = workshop(tmp_path / "other")
    assert held.ensure_fresh(str(other), now_ms=400_001).sessions.count() == 5  # another root is read at once
    assert all("/other/" in r.path for r in held.facts().sessions.collect())


def test_file_changed_during_refresh(spark, tmp_path, monkeypatch):
    """A file that grows after it was listed is read again by the next refresh."""
    root = tmp_path / "in"
    Session("s").ask("one").save(root, "-x")
    plain = store.listing

    def grows(*args):
        seen = spark.createDataFrame(plain(*args).collect(), store.FILES)
        Session("s").ask("one").ask("two words").save(root, "-x")
        return seen

    held = Store(spark, str(tmp_path / "store"))
    monkeypatch.setattr(store, "listing", grows)
    held.sync(str(root))
    monkeypatch.setattr(store, "listing", plain)
    assert held.sync(str(root)) == 1 and held.facts().messages.count() == 2 and held.sync(str(root)) == 0


def test_small_files_share_tasks(spark, tmp_path):
    """Files of a session each: a task reads many, so there are few tables, and the session's settings stay."""
    shared.write_files(spark.range(400).selectExpr("concat('-p', id % 3, '/', id, '.jsonl') file", """'{"type":"user","message":{"content":"x"}}' value"""), str(tmp_path))
    keys = ("spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism")
    before = [spark.conf.get(k) for k in keys]
    records = transcripts.records(transcripts.read_lines(spark, str(tmp_path), glob="*", name="*.jsonl"))
    assert records.count() == 400 and len(records.inputFiles()) <= 4  # as many as cores
    assert [spark.conf.get(k) for k in keys] == before
    assert transcripts.facts(records).sessions.count() == 400


def test_write_files(spark, tmp_path):
    """A file each with its lines in order, without a folder of its own; a later one takes its place, others stay."""
    rows = spark.createDataFrame([("a/x.txt", 2, "two"), ("b/y.txt", 1, ""), ("a/x.txt", 1, "één"), ("a/x.txt", 10, "ten")], "file string, n int, value string")
    shared.write_files(rows, f"file://{tmp_path}/root", "n")
    shared.write_files(rows.where("file = 'b/y.txt'").withColumn("value", F.lit("new")), f"file://{tmp_path}/root", "n")
    found = {str(p.relative_to(tmp_path / "root")): p.read_text() for p in (tmp_path / "root").rglob("*") if p.is_file()}
    assert found == {"a/x.txt": "één\ntwo\nten\n", "b/y.txt": "new\n"}
    shared.write_files(rows.limit(0), f"file://{tmp_path}/none", "n")
    assert list((tmp_path / "none").iterdir()) == []


def test_small_files_are_read_whole(spark, tmp_path, monkeypatch):
    """Files read whole and those read by lines give the same lines; only the latter are joined to be numbered."""
    raw = b'\xef\xbb\xbf{"type":"user","message":{"content":"b\xff"}}\r\n\r\nbad\n{"type":"user","message":{"content":"end"}}'
    for name, tail in (("a", b""), ("b", b"\n"), ("c", b"\n\n")):
        (tmp_path / f"{name}.jsonl").write_bytes(raw + tail)
    (tmp_path / "empty.jsonl").write_bytes(b"")
    Session("long").ask("x" * 5000).ask("last").save(tmp_path, "")

    def read(most):
        monkeypatch.setattr(transcripts, "WHOLE_BYTES", most)
        lines = transcripts.read_lines(spark, str(tmp_path), glob="*", name="*.jsonl")
        messages = transcripts.facts(transcripts.records(lines)).messages
        return lines, sorted(rows(lines, "path", "file_size", "value")), sorted(rows(messages, "line_no", "content"))

    whole, by_line, mixed = read(1 << 20), read(-1), read(1000)
    assert whole[1:] == by_line[1:] == mixed[1:] and len(whole[1]) == 4 + 4 + 5 + 2
    kinds = [{r.block == transcripts.WHOLE for r in x[0].select("block").collect()} for x in (whole, by_line, mixed)]
    assert kinds == [{True}, {False}, {True, False}]
    (tmp_path / "d.txt").write_bytes(raw)  # of another name: left to the reader of lines
    other = transcripts.text_lines(spark, f"{tmp_path}/d.txt").collect()
    assert [r.block for r in other] == [0] * 4 and other[0].value.startswith("{")


def test_lines_that_are_no_objects(spark, tmp_path):
    odd = Session("odd")
    for line in ("[1, 2]", '"{"', "{", "7", "null", "x{}", ' \t{"type":"user","message":{"content":"kept"}}'):
        odd.raw(line)
    odd.save(tmp_path, "-x")
    records = transcripts.records(transcripts.read_lines(spark, str(tmp_path)))
    assert sorted(r.kind for r in records.collect()) == ["bad"] * 6 + ["user"]


def test_files_of_other_projects_are_not_opened(spark, tmp_path):
    Session("mine").ask("here").save(tmp_path, "-x-mine")
    other = Session("other").ask("there").save(tmp_path, "-x-other")
    lines = transcripts.read_lines(spark, str(tmp_path), project="/x/mine", glob="*", name="*.jsonl")
    other.unlink()
    assert rows(transcripts.facts(transcripts.records(lines)).sessions, "session_id") == [("mine",)]


def test_search_counts_words_once(spark, facts):
    """The totals of a search without stems and its hits come from one table of counted words."""
    hits = search.ranked(search._indexed(facts).select(*search.KEYS, "terms"), ["ash"])
    assert hits.count() > 0 and all("search-counted" in path for path in hits.inputFiles())


def test_markdown_files_share_tasks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        made = QUERIES["export_markdown_files"](spark, "/root/testdata/sf0.001")
        assert made.count() == 20 and made.rdd.getNumPartitions() <= 4  # as many as cores, not one for two files
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("name", ["transcript_usage", "transcript_report_json", "transcript_sessions", "transcript_stops"])
def test_facts_keep_no_whole_records(spark, name):
    """Only exports need messages as they were; for facts they are not written."""
    made = {path.split("/kind=")[0] for path in QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()}
    assert len(made) == 1 and "v" not in spark.read.parquet(made.pop()).columns


def test_facts_without_whole_records(spark, tmp_path):
    lines = transcripts.read_lines(spark, str(workshop(tmp_path)))
    plain, whole = (transcripts.facts(transcripts.records(lines, x)).tables() for x in (False, True))
    for name, table in plain.items():
        assert sorted(map(str, table.collect())) == sorted(map(str, whole[name].collect())), name


def test_project_is_told_once_a_file(spark, tmp_path):
    """The name of a file's project is made before its lines are, and also where there are no files."""
    Session("s").ask("one").ask("two").save(tmp_path, "-srv-x y--claude-worktrees-z")
    lines = transcripts.read_lines(spark, str(tmp_path))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "decode" in plan and "decode" not in plan[: plan.index("Generate")]
    assert {r.project for r in lines.collect()} == {"/srv/x y"}
    none = transcripts.read_lines(spark, str(tmp_path / "nowhere"), project="x")
    assert set(none.columns) == set(lines.columns) and none.count() == 0
