"""Base measures against plain Python, and the line rules on planted lines."""

import re

from tabloom.llm.quality_rules import quality_rules, quality_stage

GOOD = "The quick brown fox jumps over the lazy dog while seven calm owls watch from a tall old tree."
TEXTS = [
    None,
    "",
    " \n\t\r\x0b\x0c",
    GOOD,
    GOOD + "\n" + GOOD,
    (GOOD + "\n") * 30,
    "a b c d e f g h " * 3,
    "one two three four five six seven eight nine ten " * 2 + "x one two three four five six seven eight y",
    "w " * 30000,
    "é\xa0ü ñ \U0001f600 " + GOOD + "\n\n \nx#$%&|<>*",
    GOOD + "\nHome | About | Contact | Help\n" + GOOD + "\nAll rights reserved.",
    "Thre*** anor*** inger### of%%% are&&& " * 8,
    "HOME | NEWS | SPORT\n" * 10 + GOOD,
]


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, marked = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            marked.update(i + k for i in at for k in range(8))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(marked), n < 20 or 100 * len(marked) > 30 * n)


def test_base_measures(spark):
    rows = [(i if i else None, t, True) for i, t in enumerate(TEXTS)] + [(3, GOOD, True)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, kept boolean")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and r["base_failed"])


def test_base_measures_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for r in quality_rules(docs).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == brute(r["text"])


def test_lines_and_verdicts(spark):
    prose = "\n".join(" ".join(f"w{i * 20 + k}" for k in range(20)) + "." for i in range(5))
    rows = [
        (1, prose, "a"),
        (2, prose + "\nHome | About | Contact | Help\nAll rights reserved.", "b"),
        (3, "\n".join(f"Item {i} | {GOOD} | more | {i * 7}" for i in range(9)), "c"),
        (4, "\n".join(f"Thre***{i} anor*** inger###{i} of%%% are&&& th{i}ink$$$ so###" for i in range(9)), "d"),
        (5, None, "e"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, clean_text string")
    out = {r["doc_id"]: r for r in quality_rules(df).collect()}
    assert [out[i]["kept"] for i in range(1, 6)] == [True, True, False, False, False]
    assert out[1]["clean_text"] == prose and out[2]["clean_text"] == prose
    staged = quality_stage(df)
    assert staged.columns == df.columns
    assert {(r["doc_id"], r["text"], r["clean_text"]) for r in staged.collect()} == {(1, prose, "a"), (2, prose, "b")}
    assert quality_stage(df.limit(0)).count() == 0


def test_columns_of_any_name_pass(spark):
    names = ["_lines", "_words", "_full", "_good", "_row", "_text", "n_words", "plain"]
    df = spark.createDataFrame([(1, GOOD + " Once more.", *names)], ["doc_id", "text", *names])
    out = quality_rules(df)
    assert out.columns.count("n_words") == 1
    row = out.first()
    assert [row[n] for n in names if n != "n_words"] == [n for n in names if n != "n_words"] and row["n_words"] == 21
    assert quality_stage(df).first().asDict() == df.first().asDict()
