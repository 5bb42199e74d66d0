"""Counts against the library, and what the cache saves."""

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tabloom.llm.token_counts import TokenizerFile, read_cache, token_counts
from tabloom.session import work_dir

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", "a", "<s> </s> <unk>", "héllo wörld \U0001f600", "x" * 3000, "word " * 5000, "a", "\x00\x01\n\t"]


def counted(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in df.collect()), key=str)


def test_counts_match_the_library_and_are_cached(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(None if i == 2 else 10_000 + i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int").repartition(5)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t in rows:
        n = len(model.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 4096))
    path = work_dir(spark, "cache")
    tokenizer = TokenizerFile(MODEL)
    assert counted(token_counts(docs, tokenizer, path)) == sorted(want, key=str)
    distinct = len({t or "" for _, t in rows})
    assert read_cache(spark, path).count() == distinct
    # nothing is missing the second time; a new text is
    assert counted(token_counts(docs, tokenizer, path)) == sorted(want, key=str)
    assert read_cache(spark, path).count() == distinct
    more = spark.createDataFrame([(1, "a new text")], "doc_id long, text string")
    token_counts(more, tokenizer, path)
    assert read_cache(spark, path).count() == distinct + 1


def test_stored_counts_are_used(spark):
    path, tokenizer = work_dir(spark, "cache"), TokenizerFile(MODEL)
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    token_counts(docs, tokenizer, path)
    cache = read_cache(spark, path)
    other = work_dir(spark, "cache")
    cache.selectExpr("digest", "tokenizer", "n_tokens + 1000 AS n_tokens").write.parquet(other)
    plain = {r[0]: r[2] for r in counted(token_counts(docs, tokenizer, path))}
    assert {r[0]: r[2] for r in counted(token_counts(docs, tokenizer, other))} == {k: v + 1000 for k, v in plain.items()}


def test_another_tokenizer_has_its_own_counts(spark):
    path = work_dir(spark, "cache")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    token_counts(docs, TokenizerFile(MODEL), path)
    file = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert {r[0]: r[2] for r in counted(token_counts(docs, TokenizerFile(file), path))} == want
    assert token_counts(docs.limit(0), TokenizerFile(MODEL), path).count() == 0


def test_many_misses_are_shuffled(spark, sf, monkeypatch):
    from tabloom.llm import token_counts as module

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = counted(token_counts(docs, TokenizerFile(MODEL), work_dir(spark, "cache")))
    monkeypatch.setattr(module, "BROADCAST_MISSES", 3)
    assert counted(token_counts(docs, TokenizerFile(MODEL), work_dir(spark, "cache"))) == few
