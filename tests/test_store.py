"""The store's runs, commits, leases and index."""

import random

import pytest

from sessionlore.operators import reports, search
from sessionlore.sources import store, transcripts
from sessionlore.sources.store import Run, Store

from .trees import Session, text, use


def add(root, name, *lines, project="-srv-loom"):
    one = Session(name)
    for i, line in enumerate(lines):
        one.ask(line) if i % 2 == 0 else one.answer(text(line), use("Weave"), used=(len(line), 1, 0, 0))
    return one.save(root, project)


def written(held, run):
    return sum(p.stat().st_size for p in (held.root / run.folder).rglob("*.parquet"))


@pytest.fixture
def held(spark, tmp_path):
    made = Store(spark, f"file://{tmp_path}/store")
    made.root = tmp_path / "store"
    return made


def same_facts(spark, held, root):
    """The store's rows are those of the files as they are."""
    plain = transcripts.read(spark, str(root))
    for name, table in held.facts().tables().items():
        one, other = (sorted(map(str, t.drop("level", "path", "file_mtime").collect())) for t in (table, getattr(plain, name)))
        assert one == other, name
    index = held.facts().index
    levels = {(r.stem, r.level): r.n for r in index.levels.groupBy("stem", "level").sum("n").withColumnRenamed("sum(n)", "n").collect() if r.n}
    counted = {(r.stem, r.level): r["count"] for r in held.facts().postings.groupBy("stem", "level").count().collect()}
    assert levels == counted and index.messages == plain.messages.count()
    assert index.terms == sum(r.terms for r in plain.messages.collect())
    for report in (reports.cost_by_project, reports.tools):  # from sums that are kept, and from all facts
        assert report(held.facts()).collect() == report(plain).collect()


def test_a_refresh_writes_what_changed(spark, tmp_path, held, monkeypatch):
    monkeypatch.setattr(store, "FANOUT", 100)  # nothing is merged here
    root, rng = tmp_path / "in", random.Random(1)
    for i in range(150):
        add(root, f"s{i}", *(" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(6)))
    held.sync(str(root))
    add(root, "s7", "one line")
    add(root, "s200", *(" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(6)))
    assert held.sync(str(root)) == 2
    base, delta = held.manifest().runs
    assert written(held, delta) < written(held, base) / 10
    assert [r.sessions for r in reports.cost_by_project(held.facts()).collect()] == [151]
    plan = reports.tools(held.facts())._jdf.queryExecution().optimizedPlan().toString()
    assert "session_key" not in plan  # no session is read
    assert held.facts().sessions.count() == 151 and held.facts().messages.where("content = 'one line'").count() == 1


def test_merged_runs(spark, tmp_path, held):
    root = tmp_path / "in"
    for i in range(6):
        add(root, f"s{i}", f"thread {i} of wool", "spun")
    held.sync(str(root))
    for i in range(9):
        add(root, f"s{i % 4}", f"thread {i} of flax " * (i + 1), "spun again", "and again")
        if i == 5:
            (root / "-srv-loom" / "s5.jsonl").unlink()
        held.sync(str(root))
        assert len(held.manifest().runs) < 2 * store.FANOUT
    same_facts(spark, held, root)
    assert sum(len(r.of) for r in held.manifest().runs) == 10  # every refresh is in one run
    held.sync(str(root), force=True)
    same_facts(spark, held, root)


def test_which_runs_are_merged():
    sizes = lambda *n: tuple(Run(str(i), x, 0, 0, (str(i),)) for i, x in enumerate(n))
    assert store.alike(sizes()) is None and store.alike(sizes(900, 1, 1, 1)) is None
    assert store.alike(sizes(900, 1, 1, 1, 1)) == (1, 5)
    assert store.alike(sizes(900, 70, 66, 1, 90)) == (1, 5)  # a small one between large ones goes with them
    assert store.alike(sizes(900, 70, 66, 69, 1)) is None


def interleaved(monkeypatch, held, other, root, change):
    """Between the first writer's run and its commit, ``change`` happens and the other refreshes."""
    plain, done = held._refresh, []

    def refresh(*args):
        made = plain(*args)
        if not done:
            done.append(change())
            other.sync(str(root))
        return made

    monkeypatch.setattr(held, "_refresh", refresh)
    held.sync(str(root))


def test_two_writers_and_a_reader(spark, tmp_path, held, monkeypatch):
    root, other = tmp_path / "in", Store(spark, held.path)
    for i in range(4):
        add(root, f"s{i}", f"wool {i}")
    held.sync(str(root))
    reader = held.facts(lease_s=3600)
    # The first writer has seen s0 change; the other one sees that and a new file.
    add(root, "s0", "linen")
    interleaved(monkeypatch, held, other, root, lambda: add(root, "late", "silk"))
    same_facts(spark, held, root)
    versions = held._versions()
    assert len(versions) == len(set(versions)) and held.manifest().version == versions[0]
    # One whose keys are others is put on top.
    monkeypatch.undo()
    add(root, "s1", "cotton")
    mine = held._refresh(held.manifest(), str(root), "run-mine", "*/*.jsonl", -2)[0]
    before = held.manifest()
    add(root, "s2", "jute")
    theirs = other._refresh(before, str(root), "run-theirs", "*/*.jsonl", -2)[0]  # has s1 as well
    assert other._commit(other._next(before, store.replace(before, runs=(*before.runs, theirs))))
    assert not held._commit(held._next(before, store.replace(before, runs=(*before.runs, mine))))  # the number is taken
    assert held._meets(before, held.manifest(), mine)
    held.sync(str(root))
    same_facts(spark, held, root)
    # Many refreshes later the reader's files are still there, and go once its lease is over.
    for i in range(3):
        add(root, f"more{i}", "hemp")
        held.sync(str(root))
    assert sorted(r.content for r in reader.messages.collect()) == [f"wool {i}" for i in range(4)]
    assert reports.tools(reader).count() == 0
    held.clean(now_ms=10**15)
    assert len(held._versions()) == 2 and held.folder.names("leases") == {}
    named = {r.folder for v in held._versions() for r in held._manifest(v).runs}
    assert {n for n in held.folder.names() if n.startswith("run-")} == named
    same_facts(spark, held, root)


def test_disjoint_refreshes_both_stay(spark, tmp_path, held, monkeypatch):
    root, other = tmp_path / "in", Store(spark, held.path)
    add(root, "a", "wool")
    held.sync(str(root))
    add(root, "b", "linen")
    plain, seen = store.listing, []

    def listing(spark, where, glob="*/*.jsonl"):
        """The other writer does not see b, as if its file system were behind."""
        rows = plain(spark, where, glob)
        return rows.where("not endswith(path, '/b.jsonl')") if seen else rows

    def change():
        seen.append(1)
        monkeypatch.setattr(store, "listing", listing)
        return add(root, "c", "silk")

    interleaved(monkeypatch, held, other, root, change)
    assert {r.session_id for r in held.facts().sessions.collect()} == {"a", "b", "c"}
    assert [len(r.of) for r in held.manifest().runs] == [1, 1, 1]
    monkeypatch.undo()
    same_facts(spark, held, root)


def rows_read(frame):
    """Rows that the scans of an executed frame gave out, by the columns they read."""
    frame.collect()
    plan, out = frame._jdf.queryExecution().executedPlan(), []
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        elif node.nodeName().startswith("Scan parquet"):
            out.append((node.simpleString(10_000), node.metrics().apply("numOutputRows").value()))
        for i in range(node.children().size()):
            todo.append(node.children().apply(i))
    return out


def test_best_of_a_common_word(spark, tmp_path, held, monkeypatch):
    monkeypatch.setattr(store, "ROW_GROUP", 4096)
    root, rng = tmp_path / "in", random.Random(3)
    for i in range(40):
        lines = []
        for _ in range(50):
            n = rng.randint(5, 60)
            lines.append(" ".join("weft" if rng.random() < 0.1 else f"w{rng.randrange(400)}" for _ in range(n)))
        add(root, f"s{i}", *lines, "weft", project=f"-srv-p{i % 3}")
    held.sync(str(root))
    add(root, "s3", "weft weft", "weft")
    held.sync(str(root))
    f = held.facts()
    read = []
    plain = search.best_of
    monkeypatch.setattr(search, "best_of", lambda scores, *rest: read.append(scores) or plain(scores, *rest))
    for query, project in (("weft", None), ("wefts", "p1"), ("w7", None), ("user", None), ("absent", None)):
        got = [tuple(r) for r in search.search(f, query, project, limit=10).collect()]
        every = store.replace(f, index=None)
        want = [tuple(r) for r in search.search(every, query, project, limit=10).collect()]
        assert [r[:5] for r in got] == [r[:5] for r in want] and [r[5] for r in got] == pytest.approx([r[5] for r in want])
    read.clear()
    search.search(f, "weft", limit=5)
    scanned = sum(n for _, n in rows_read(read[-1]))
    assert 0 < scanned < f.postings.where("stem = 'weft'").count() / 3


def test_literal_search_of_files_ends_early(spark, tmp_path, monkeypatch):
    for i in range(30):
        add(tmp_path, f"s{i:02}", f"a shed\nof shed {i}", "none", "Shed", project=f"-srv-p{i % 2}")
    every = [tuple(r) for r in search.literal(transcripts.read(spark, str(tmp_path)), "shed", limit=10**6).collect()]
    read = []
    plain = transcripts.read_lines
    monkeypatch.setattr(transcripts, "read_lines", lambda *a, **k: read.append(k["paths"]) or plain(*a, **k))
    for limit in (3, 25, 1000):
        got = [tuple(r) for r in search.literal_files(spark, str(tmp_path), "shed", limit=limit, first_bytes=900).collect()]
        assert got == every[:limit] and len(got) == min(limit, 60)
    first = len(read[0])
    assert 0 < first < 10 and [len(p) for p in read[1:3]] == [first, len(read[2])] and sum(map(len, read[-3:])) >= 30
    assert len(search.literal_files(spark, str(tmp_path), "SHED", limit=99, case_sensitive=False).collect()) == 90
    assert search.literal_files(spark, str(tmp_path), "shed", project="p1", limit=99, first_bytes=900).count() == 30
    assert search.literal_files(spark, str(tmp_path / "nowhere"), "shed").count() == 0


FORMS = {
    "glaz*": search.Asked(("glaz",), prefix=True),
    "content:kiln": search.Asked(("kiln",), ("in_content",)),
    "-content:user": search.Asked(("user",), ("in_role",)),
    "{Message_Type}:user": search.Asked(("user",), ("in_role",)),
    "session_id:x": search.Asked(("x",), ()),
    "^mix": search.Asked(("mix",), first=True),
    "content:^mix+a*": search.Asked(("mix", "a"), ("in_content",), True, True),
    "one_two": search.Asked(("one", "two")),
    '"kiln"': search.Asked(("kiln",)),
    "two words*": search.Asked(("two", "words")),
    "role:user": None, "a-b": None, "x.y": None, "AND": None, "*": None, "a+": None, "content:": None, '"open': None,
}


@pytest.mark.parametrize("query", FORMS)
def test_forms(query):
    assert search.asked(query) == FORMS[query]


def test_forms_find(spark, tmp_path):
    root = tmp_path / "in"
    add(root, "s", "mix a celadon glaze", "glazed user", "user content a-b glazing mix", "mixing")
    f = transcripts.read(spark, str(root))
    found = lambda q: sorted(r.snippet for r in search.search(f, q).collect())
    assert found("glaz*") == ["[[glazed]] user", "mix a celadon [[glaze]]", "user content a-b [[glazing]] mix"]
    assert found("content:user") == ["[[user]] content a-b glazing mix", "glazed [[user]]"]
    assert found("message_type:user") == ["[[user]] content a-b glazing mix", "mix a celadon glaze"]
    assert found("^mix") == ["[[mix]] a celadon glaze", "[[mixing]]"]
    assert found("^user") == ["[[user]] content a-b glazing mix", "mix a celadon glaze"]
    assert found("a+cel*") == ["mix [[a]] [[celadon]] glaze"] and found("glaze+user") == ["[[glazed]] [[user]]"]
    assert found("user+mix") == [] and found("timestamp:mix") == []  # not from one column into another
    assert found("A-B") == ["user content a-b glazing mix"]  # of no form: lines that contain it
    ranks = [r["rank"] for r in search.search(f, "A-B").collect()]
    assert ranks == [None]


def test_a_refresh_makes_postings_and_lists_files_once(spark, held, tmp_path, monkeypatch):
    """Each row of a table counts when it is made, also for a sample or a second reader."""
    for i in range(12):
        add(tmp_path / "many", f"s{i}", f"red stones {i} and a stone")
    made = {name: spark.sparkContext.accumulator(0) for name in ("postings", "listing")}

    def counted(run, total):
        def put(batches):
            for batch in batches:
                total.add(batch.num_rows)
                yield batch

        return lambda *args, **named: (rows := run(*args, **named)).mapInArrow(put, rows.schema)

    monkeypatch.setattr(store.search_text, "postings", counted(store.search_text.postings, made["postings"]))
    monkeypatch.setattr(store, "listing", counted(store.listing, made["listing"]))
    assert held.sync(str(tmp_path / "many")) == 12
    assert made["listing"].value == 12
    rows = held.facts().postings.collect()
    # Stems of each: its role, red, stone (twice), its number, and, a.
    assert made["postings"].value == len(rows) == 12 * 6
    assert {(tuple(r.in_role), tuple(r.in_content)) for r in rows if r.stem == "stone"} == {((), (1, 5))}
    assert {(tuple(r.in_role), tuple(r.in_content)) for r in rows if r.stem == "user"} == {((0,), ())}
