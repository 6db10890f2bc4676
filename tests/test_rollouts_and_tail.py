import json
import sqlite3

from sessionlore.operators import rollouts
from sessionlore.sources import rollouts as source
from sessionlore.streaming import tail

NOW = 1776556800000  # 2026-04-19T00:00:00Z


def item(kind, payload, at="2026-04-19T01:00:00Z"):
    return json.dumps({"type": kind, "timestamp": at, "payload": payload})


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_report(spark, tmp_path):
    meta = lambda i, **m: item("session_meta", {"id": i, "timestamp": "2026-04-19T02:00:00Z", "cwd": "/w", "cli_version": "1.0", "source": ""} | m)
    write(tmp_path / "sessions/2026/04/19/rollout-a.jsonl", [meta("a"), item("event_msg", {"type": "user_message"}), item("event_msg", {"type": "agent_message"}), item("response_item", {"type": "function_call", "name": "shell"}), "broken", "", json.dumps({"type": "compacted"}), item("event_msg", {"type": "exec_command_end"})])
    write(tmp_path / "archived_sessions/rollout-b.jsonl", [meta("b", timestamp="2026-04-12T00:00:00Z")])
    write(tmp_path / "archived_sessions/rollout-c.jsonl", [meta("c")])
    write(tmp_path / "sessions/rollout-c.jsonl", [meta("c"), item("event_msg", {"type": "user_message"})])
    write(tmp_path / "session_index.jsonl", [json.dumps({"id": "c", "thread_name": t}) for t in ("first", "last", "")])
    with sqlite3.connect(tmp_path / "state.db") as db:
        db.execute("CREATE TABLE threads (cwd TEXT, model_provider TEXT, tokens_used INTEGER, has_user_event INTEGER)")
        db.executemany("INSERT INTO threads VALUES (?, ?, ?, ?)", [("/w", "p", 5, 1), ("/w", "q", 7, 0)])
    root = str(tmp_path)
    one = rollouts.report(source.read_lines(spark, root), source.read_titles(spark, root), NOW, source.read_threads(spark, f"{root}/state.db")).first()
    assert (one.total_sessions, one.active_session_files, one.archived_sessions) == (3, 1, 2)  # c counts once, as archived
    assert (one.user_messages, one.agent_messages, one.tool_calls, one.tool_results, one.compacted_events) == (1, 1, 1, 1, 1)
    assert (one.sessions_today, one.sessions_this_week) == (2, 2)
    assert [tuple(t) for t in one.top_tools] == [("exec", 1), ("shell", 1)] and one.sources == []
    assert (one.most_recent.session_id, one.most_recent.title) == ("c", "last")
    assert (one.state.thread_count, one.state.threads_with_user_event, one.state.total_tokens_used) == (2, 1, 12)
    assert source.read_threads(spark, f"{root}/none.db") is None


def test_nothing(spark, tmp_path):
    one = rollouts.report(source.read_lines(spark, str(tmp_path)), source.read_titles(spark, str(tmp_path)), NOW).first()
    assert one.total_sessions == 0 and one.most_recent is None and one.top_projects == []


def test_lines(spark):
    cases = {
        '{"timestamp":"2026-04-18T10:11:12Z","type":"system","durationMs":5}': ("10:11:12 [system] 5ms", "record"),
        '{"ts":"x","level":"WARN","msg":"m"}': ("x [WARN] m", "warn"),
        '{"message":"m"}': ("[info] m", "plain"),
        "A FATAL thing": ("A FATAL thing", "error"),
        "plain": ("plain", "plain"),
    }
    frame = spark.createDataFrame([(k,) for k in cases], "value string").coalesce(1)
    assert [tuple(r) for r in tail.formatted(frame).collect()] == list(cases.values())


def test_follow(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"old line\n")
    stream = tail.follow(spark, str(log)).writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "ck")).start()
    seen = lambda: [r.value for r in spark.table("tailed").collect()]
    try:
        stream.processAllAvailable()
        assert seen() == []
        with log.open("ab") as f:
            f.write("one\n\nhalf é".encode()[:-1])
        stream.processAllAvailable()
        assert seen() == ["one"]
        with log.open("ab") as f:
            f.write("é".encode()[1:] + b"\r\n")
        stream.processAllAvailable()
        assert seen() == ["one", "half é"]
        log.write_bytes(b"new\n")
        stream.processAllAvailable()
        assert seen() == ["one", "half é", "new"]
    finally:
        stream.stop()


def test_restarts(spark, tmp_path):
    """A query that is started again goes on where it stopped, also inside a line and after the file was replaced."""
    log = tmp_path / "b.log"
    log.write_bytes(b"first line\nsecond, unfin")
    names = iter(range(9))

    def run(change=None):
        """The lines of one start, after what ``change`` writes meanwhile."""
        lines = tail.follow(spark, str(log))
        out = tmp_path / f"out{next(names)}"
        stream = lines.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(out))
        stream = stream.trigger(processingTime="100 milliseconds").start()
        try:
            stream.processAllAvailable()
            if change:
                log.open("ab").write(change)
                stream.processAllAvailable()
        finally:
            stream.stop()
        return sorted(line for p in out.glob("part-*") for (line,) in spark.read.parquet(str(p)).collect())

    assert run() == []  # it begins after the last line end
    log.open("ab").write(b"ished\nthird, un")
    assert run() == ["second, unfinished"]
    assert run(b"finished\n") == ["third, unfinished"]
    assert run() == []
    log.write_bytes(b"other file\nwith more\nlines than the first one had, so that it is no shorter\n")
    assert run() == ["lines than the first one had, so that it is no shorter", "other file", "with more"]
    log.write_bytes(b"other file\n")
    assert run(b"more\n") == ["more", "other file"]  # shorter than before
    log.unlink()
    assert run() == []
    log.write_bytes(b"again\n")
    assert run() == ["again"]


def test_offsets_without_state(tmp_path):
    log = tmp_path / "c.log"
    reader = lambda start=False: tail.TailReader(str(log), start)
    assert reader().initialOffset() == {"head": "", "position": 0}
    log.write_bytes(b"x" * 300)
    assert reader().initialOffset()["position"] == 0  # no line has ended
    log.write_bytes(b"a\nb\nc")
    begin = reader().initialOffset()
    assert begin["position"] == 4 and reader(True).initialOffset() == begin | {"position": 0}
    with log.open("ab") as f:
        f.write(b"d\n")
    end = reader().latestOffset()
    spans = reader().partitions(begin, end)
    assert [r for s in spans for r in reader().read(s)] == [("cd",)] and reader().partitions(end, end) == []


def test_a_backlog_is_divided(tmp_path, monkeypatch):
    """Spans end with lines, whatever their length, and hold each line once."""
    log = tmp_path / "d.log"
    for lines in (["x" * (i * 7 % 50) for i in range(400)], ["y" * 5000, "z", "y" * 3000], ["e" * 9] * 30):
        log.write_bytes("".join(f"{line}\n" for line in lines).encode() + b"unfinished")
        reader = tail.TailReader(str(log), True)
        for span, block in ((10, 4), (64, 1 << 20), (1 << 20, 8)):
            monkeypatch.setattr(tail, "SPAN", span)
            monkeypatch.setattr(tail, "BLOCK", block)
            spans = reader.partitions(reader.initialOffset(), reader.latestOffset())
            assert [line for s in spans for (line,) in reader.read(s)] == lines
            assert len(spans) > 1 or span > 10_000
            assert all(a.end == b.start for a, b in zip(spans, spans[1:]))


def test_last_line_end(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(b"a\nbc\nd")
    assert [tail.last_line_end(str(path), s, 6) for s in (0, 2, 5)] == [5, 5, 5]
