"""The stages in order, and all of them together."""

import re

import regex

import corpus_pipeline
from tabloom.llm.common import table
from tabloom.llm.decontamination import LeakSettings
from tabloom.llm.quality_rules import BOILERPLATE
from tests.llm.test_decontamination import exact
from tests.llm.test_quality_rules import brute as brute_measures
from tests.llm.test_simhash import want as groups_of


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii", "mixing"
    ]
    small = docs.where("n_chars < 3000").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, small, sf)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert out.count() <= small.count()


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    ids = {r["doc_id"] for r in rows}
    assert 0 < len(rows) == len(ids) < table(spark, sf, "documents").count()
    assert sum(r["taken"] for r in rows) > 0.9 * sum(r["size"] for r in rows)


def test_run_on_an_empty_table(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        table(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_quality(text):
    """Kept, and the text without the lines that fail."""
    visible = lambda x: len(re.sub(r"[\x20\x09-\x0D]", "", x))

    def fails(line):
        marks = len(regex.sub(r"[\p{L}\p{M}\p{N} \t\n\x0b\f\r]+", "", line))
        bars = sum(c in "|»›" for c in line)
        phrase = re.search(BOILERPLATE, line.lower()) and len(re.split(r"[\x20\x09-\x0D]+", line.strip())) <= 30
        return (marks >= 4 and marks > visible(line) * 0.2) or bars > 1 or bool(phrase)

    clean = "\n".join(x for x in text.split("\n") if not fails(x))
    failed = brute_measures(text)[-1]
    return not failed and visible(text) - visible(clean) <= visible(text) * 0.3, clean


def test_run_matches_brute_force(spark, sf):
    docs = {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}
    texts = {}
    for i, r in docs.items():
        kept, clean = brute_quality(r["text"])
        if kept:
            texts[i] = clean
    one_of_each = {w[2] for w in groups_of(sorted(texts.items()))}
    rows = [(i, texts[i]) for i in sorted(one_of_each)]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    leaked = {d for d, _ in exact(rows, items, LeakSettings())}
    left = {i: t for i, t in rows if i not in leaked}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(left) and leaked
    plain = [i for i, t in left.items() if not re.search("[0-9@]|at[)\\]}]", t)]
    assert len(plain) > 50
    for i in plain:
        assert got[i]["size"] == len([w for w in re.split(r"[\x20\x09-\x0D]+", left[i]) if w])
    assert {r["source"] for r in got.values()} == {docs[i]["source"] for i in left}
