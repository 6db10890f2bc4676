"""The pipeline stage by stage against plain Python over a small table."""

import corpus_pipeline
from sessionlore.llm import toxicity

from . import cases
from .test_duplicates import brute_classes
from .test_media_and_tokens import check_pack
from .test_scans import personal

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    given = docs.collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "personal_data", "mixing", "packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]

    clean = stages[0](spark, docs, DATA).cache()
    model = toxicity.trained(spark, DATA, docs)
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in given if model.score(r.text or "") < toxicity.THRESHOLD}

    single = stages[1](spark, clean, DATA).cache()
    want = {i for i, _, _, root in brute_classes([(r.doc_id, r.text) for r in clean.collect()]) if i == root}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == want

    hidden = stages[2](spark, single, DATA).cache()
    assert hidden.columns == columns and hidden.count() == single.count()
    assert not any(personal(r.text) for r in hidden.collect()) and all(r.n_chars == len(r.text) for r in hidden.collect())
    before = {r.doc_id: r.text for r in single.collect()}
    assert all(r.text == before[r.doc_id] for r in hidden.collect() if not personal(before[r.doc_id]))

    mixed = stages[3](spark, hidden, DATA).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} == want

    packed = stages[4](spark, mixed, DATA).collect()
    assert check_pack(packed, [(r.doc_id, r.text) for r in mixed.collect()], 2048) < 0.01


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_cases(spark):
    """Nulls, long and repeated texts, and columns of clashing names pass through every stage."""
    docs = cases.documents(spark)
    made = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, made, DATA).cache()
        assert cases.same_columns(made, docs)
    kept = {r.doc_id: r.text for r in made.collect()}
    assert set(kept) == {1, 4, 5, 6, 7, 9, 10, 11, 12, 13, None}  # 2 and 3 are near copies of 1, 8 is one of 7
    assert kept[4] is None and kept[5] == "" and kept[9] == cases.LONG and kept[10] == "mail me at [EMAIL] or [IP] now"
    packed = corpus_pipeline.STAGES[-1][1](spark, made, DATA).collect()
    assert check_pack(packed, [(r.doc_id, r.text) for r in made.collect()], 2048) < 0.1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, cases.empty(spark), DATA).count() == 0


def test_a_term_goes_in_the_pipeline(spark):
    """The personal-data stage removes what stands beside one address in many texts, and nothing else."""
    rows = [(i, f"report {i} about zanzibar {'abcdefghij'[i]} by boss@corp.example.com", "en", "s", 9) for i in range(8)]
    rows += [(50 + i, f"report {i} about other things {i}", "en", "s", 9) for i in range(400)] + [(900, "on zanzibar", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.hide_personal_data(spark, docs, DATA).collect()}
    assert "zanzibar" not in " ".join(got.values()) and "[EMAIL]" in got[0] and got[0].startswith("report 0 about ")
    assert all(got[50 + i] == f"report {i} about other things {i}" for i in range(400)) and len(got) == len(rows)
