"""Documents with the awkward cases that every operator has to handle."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, copies long, block int, row string, print string, component string, score double, spans string, id string"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(20_000))
BASE = " ".join(f"alpha{i}" for i in range(60))
NEAR = BASE.replace("alpha30", "changed")


def documents(spark):
    texts = {
        1: BASE, 2: BASE, 3: NEAR, 4: None, 5: "", 6: "   \n\t ", 7: "one two three", 8: "one two three", 9: LONG,
        10: "mail me at jane.doe@mail.example.com or 10.0.0.1 now", 11: "é ü 漢字 😀 end", 12: "token = \"abcdef0123456789abcd\" ok",
        13: "A a " * 40, None: BASE,
    }
    rows = [(i, t, "en", None if i == 7 else f"s{(i or 0) % 2}", len(t or ""), 1, 2, 3, "r", "p", "c", 0.5, "s", "i") for i, t in texts.items()]
    rows.append(rows[0])  # a repeated row
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def same_columns(got, docs):
    return got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
