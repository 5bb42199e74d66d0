"""Base spans against Python's re; proposals, thresholds and redaction on small texts."""

import hashlib
import re

from pyspark.sql import functions as F

from tabloom.llm.pii import KINDS, PiiSettings, find_pii, fit_pii, pii_stage, redact, with_spans

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    spans = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                spans.append((m.start(), k, m.end()))
    return sorted(spans)


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


TEXTS = [
    None,
    "",
    "no data here",
    "a@b.c@d.e x@y a@b@c.dd mail é.x@y.zz, a.b@c.d_e@f.g",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255 1.2.3 9.9.9.9999",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 41111111111111111111111",
    "+1 (988) 555-2485 +49 30 1234567. +123 +1(((((( +12345678901234567 +1 555 555 5555 4111111111111111",
    "\U0001f600 +1 (988) 555-2485 ünï x@y.de \U0001f600 10.0.0.1",
    "9" * 5000 + " " + "a" * 5000 + "@",
    " ".join(["bob@mail.example.com 10.1.2.3"] * 300),
    "bob@mail.example.com\n10.1.2.3",
    "bob@mail.example.com\n10.1.2.3",
]


def docs(spark, texts=TEXTS):
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_email string")


def test_base_spans_match_re(spark):
    got = find_pii(docs(spark), PiiSettings(trees=2)).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert len(got) == len(TEXTS)
    for row, text in zip(got, TEXTS):
        want = brute(text)
        assert row["base_sha256"] == hashlib.sha256(written(want).encode()).hexdigest(), text
        for k, kind in enumerate(KINDS):
            assert row[f"n_{kind}"] == sum(s[1] == k for s in want)
        have = [(s["start"], s["k"] - 1, s["end"]) for s in row["spans"]]
        assert set(want) <= set(have) and have == sorted(have)


def test_base_spans_match_re_on_documents(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in find_pii(table, PiiSettings(trees=2)).drop("text").collect()}
    for r in table.collect():
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(written(brute(r["text"])).encode()).hexdigest()


def labelled(spark, n=300):
    def card(i):
        body = f"4{i * 7919 % 10**14:014d}"
        return body + next(str(c) for c in range(10) if luhn(body + str(c)))

    texts = [
        f"write to user{i}.k@mail{i % 9}.example.com or call +1 ({200 + i % 700}) 555-{1000 + i} today, "
        f"card {card(i)} paid; part number {10**15 + i * 7} of {i}.{i + 300}.2.1 from 10.{i % 250}.3.{i % 200}"
        for i in range(n)
    ]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_trees_add_rewritten_spans_and_leave_near_misses(spark):
    base = with_spans(labelled(spark))
    model = fit_pii(base)
    assert model.trees and set(model.thresholds) <= set(KINDS)
    assert {"email", "card"} <= set(model.thresholds)
    probe = spark.createDataFrame(
        [(1, "mail bob (at) mail.example.com now"), (2, "card 4111.1111.1111.1111 paid"),
         (3, "card 4111.1111.1111.1112 paid"), (4, "in 1999 and 2001 they met at noon")],
        "doc_id long, text string",
    )
    from tabloom.llm.pii import add_spans

    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in add_spans(with_spans(probe), model).collect()}
    assert got[1] and got[2]
    assert not got[3] and not got[4]


def test_unverified_proposals_are_not_taught_as_wrong(spark):
    from tabloom.llm.pii import add_spans

    # many real addresses and cards that the base rules do not see
    hidden = [
        (10_000 + i, f"write to bob{i} (at) mail{i % 9}.example.com, card 4111.1111.1111.1111 paid for part {i}")
        for i in range(1500)
    ]
    rows = labelled(spark).unionByName(spark.createDataFrame(hidden, "doc_id long, text string"))
    base = with_spans(rows)
    model = fit_pii(base)
    assert {"email", "card"} <= set(model.thresholds)
    found = add_spans(base.where("doc_id >= 10000"), model).select(F.size("spans").alias("n"))
    assert found.where("n < 2").count() == 0


def test_nothing_to_learn_adds_nothing(spark):
    plain = spark.createDataFrame([(1, "no numbers"), (2, None)], "doc_id long, text string")
    assert [r["spans"] for r in find_pii(plain).collect()] == [[], []]
    assert find_pii(plain.limit(0)).count() == 0


def test_redaction_merges_overlaps_and_keeps_columns(spark):
    rows = [
        (1, "call +1 (555) 555-5555, 4111 1111 1111 1111 or a@b.cc!", "en", "s", 54, "k"),
        (2, "clean text", "en", "s", 10, None),
        (None, None, None, None, None, None),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")
    out = pii_stage(table, PiiSettings(trees=2))
    assert out.columns == table.columns and dict(out.dtypes) == dict(table.dtypes)
    got = {r["doc_id"]: r for r in out.collect()}
    assert "@" not in got[1]["text"] and "4111" not in got[1]["text"] and "[EMAIL]" in got[1]["text"]
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "clean text" and got[2]["spans"] is None
    assert got[None]["text"] is None
    span = "array<struct<start:int,k:bigint,end:int>>"
    one = spark.createDataFrame([("ab\U0001f600cdef", [(2, 1, 4), (3, 4, 5)])], f"text string, spans {span}")
    assert redact(one).first()["text"] == "ab[EMAIL]ef"


def test_columns_of_any_name_pass(spark):
    names = ["_text", "_base", "_failed", "_more", "_row", "_base_spans", "plain"]
    df = spark.createDataFrame([(1, "mail a@b.cd", *names, 5)], ["doc_id", "text", *names, "n_email"])
    row = find_pii(df).first()
    assert [row[n] for n in names] == names and row["n_email"] == 1


def test_copies_of_one_span_leave_room_for_others(spark):
    """Thousands of documents share a footer; the sample still holds spans of every kind."""
    docs = spark.range(4000).selectExpr(
        "id AS doc_id",
        "concat(IF(id % 20 = 0, concat('mail user', id, '@host', id, '.example or 10.1.', id % 250, '.', id % 199, ' '), 'x '), 'call +1 555 0100 200') AS text",
    )
    spanned = with_spans(docs)
    model = fit_pii(spanned, PiiSettings(max_training=600))
    few = fit_pii(with_spans(docs.where("doc_id % 20 = 0")), PiiSettings(max_training=600))
    assert set(model.thresholds) == set(few.thresholds)


def test_all_candidates_are_taught(spark, monkeypatch):
    from tabloom.llm import pii

    kept = {}
    store = pii.stored
    monkeypatch.setattr(pii, "stored", lambda df, label="table": kept.setdefault(label, store(df, label)))
    n = 21_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('mail user', id, '@host', id, '.example now') AS text")
    fit_pii(with_spans(docs), PiiSettings(trees=1))
    assert kept["pii_candidates"].where("label = 1").count() >= n
