"""Terms that disclose entities of one text each, far from them, short, or with digits."""

from sessionlore.llm import pii


def test_terms_of_entities_in_one_text(spark):
    filler = " ".join(f"plain{i}" for i in range(60))
    rows = [(i, f"Kim and Wu use A7B9 here. {filler} {filler} write to person{'abcdef'[i]}@mail{i}.example.com") for i in range(6)]
    rows += [(100 + i, f"note {filler} item{i} here to write, use and copy") for i in range(200)]
    rows += [(400, "a letter from Kim about A7B9"), (401, "only once rareword with one@single.example.com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    found = {r.doc_id: {texts[r.doc_id][s.start : s.end] for s in r.terms} for r in pii.find(docs).collect()}
    assert all(found[i] == {"Kim", "Wu", "A7B9"} for i in range(6))
    assert found[400] == {"Kim", "A7B9"} and found[401] == set()
    assert all(found[100 + i] == set() for i in range(200))


def test_words_at_spans():
    text = "x1, 4111111111111111abc d2 a_b É"
    assert pii.terms_beside(text, pii.base_matches(text)) == {"x1", "d2", "b", "é"}


def test_copies_of_plain_texts_change_nothing(spark):
    rows = [(i, f"the word zanzibar {i} reaches me at one@mail.example.com today") for i in range(6)]
    rows += [(100 + i, f"some other note {i}") for i in range(300)]
    once = [*rows, (500, "a page about zanzibar")]
    many = [*once, *((600 + i, "a page about zanzibar") for i in range(40))]

    def hidden(own):
        found = pii.find(spark.createDataFrame(own, "doc_id long, text string").repartition(7)).collect()
        texts = dict(own)
        return {(r.doc_id, texts[r.doc_id][s.start : s.end], s.action) for r in found for s in r.terms if r.doc_id < 600}

    assert hidden(once) == hidden(many) and (0, "zanzibar", "generalise") in hidden(once)
