"""Packing: exact round trip against the library, the plan against its documents."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tabloom.llm.catalog import QUERIES
from tabloom.llm.packing import SPAN, PackSettings, WordTokenizer, pack, pack_plan

FILE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(FILE)
TOKENIZER = WordTokenizer(FILE)
TEXTS = [
    None, "", " \n\t ", "a", "A\x0bb\x0cC\x1cd\x85e f g", "<|endoftext|> x<|startoftext|>y", "é ́x 한",
    "ΑΣ Σ, ΌΣΟΣ", "don't DON'T '''s 12345 ½", "\U0001f600\U0001f1e9\U0001f1ea � \x00", "word " * 30_000, "x" * 50_000, "a", "a",
]


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, pieces, size=4096, min_piece=32):
    """Each id in one piece, sequences gapless and little padded; returns the padding."""
    per_doc, per_sequence = {}, {}
    for p in pieces:
        per_doc.setdefault(p["doc_id"], []).append(p)
        per_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    padding = 0
    for parts in per_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
        assert at & (at - 1) == 0 or size - at < min_piece
        padding += 0 if at & (at - 1) == 0 else size - at
    want = {}
    for i, text in rows:
        want.setdefault(i, []).append(ids_of(text))
    assert per_doc.keys() == want.keys()
    for i, all_ids in want.items():
        assert sum(p["length"] for p in per_doc[i]) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            ids, at = np.array(all_ids[0], "<u4"), 0
            for p in sorted(per_doc[i], key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                at += p["length"]
            assert at == len(ids)
    return padding


def test_query_packs_every_token_once(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    pieces = QUERIES["op11_packing"](spark, sf).collect()
    assert check(rows, pieces) <= 0.005 * sum(p["length"] for p in pieces)


def test_odd_texts_repeats_and_clashing_columns(spark):
    rows = [(None if i == 3 else i, t) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7]), (7, "other")]
    docs = spark.createDataFrame([(*r, "z", 5) for r in rows], "doc_id int, text string, ids string, base int").repartition(3)
    packed = pack(docs, WordTokenizer(FILE))
    pieces = packed.pieces(True).collect()
    check(rows, pieces)
    # the sequences hold the pieces
    whole = {r["sequence_id"]: r for r in packed.sequences().collect()}
    for p in pieces:
        s = whole[p["sequence_id"]]
        assert s["ids"][4 * p["offset"] : 4 * (p["offset"] + p["length"])] == p["ids"] and p["offset"] in s["doc_starts"]
    assert sum(s["n_tokens"] for s in whole.values()) == sum(p["length"] for p in pieces)
    assert pack(docs.limit(0), WordTokenizer(FILE)).pieces().count() == 0


def test_many_documents_of_one_length(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'one two three', repeat('four ', id % 700)) AS text").repartition(7)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows, pack(docs, WordTokenizer(FILE)).pieces().collect())


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_words_are_encoded_as_in_the_text(text):
    import pyarrow as pa

    n, ids = TOKENIZER.encode(pa.array([text, "", text]))
    one = ids_of(text)[:-1]
    assert n.tolist() == [len(one), 0, len(one)] and ids.tolist() == one + one


def test_every_latin_letter_is_encoded_as_in_a_text():
    import pyarrow as pa

    for c in map(chr, range(0x21, 0x260)):
        for text in (c, f"a{c}b", f"{c}{c}.", f"A{c},x"):
            assert TOKENIZER.encode(pa.array([text]))[1].tolist() == ids_of(text)[:-1], text


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("abcXYZ .,;!?'<|>éÉİıǅ1", max_size=40)))
def test_any_text_is_encoded_by_words(text):
    import pyarrow as pa

    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert TOKENIZER.encode(pa.array([text], pa.string()))[1].tolist() == ids_of(text)[:-1]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([8, 64, 256]), st.integers(1, 4), st.data())
def test_plan_places_each_rest_once(size, min_piece, data):
    histogram = data.draw(st.dictionaries(st.integers(1, size - 1), st.integers(1, 60), max_size=20))
    plan = pack_plan(histogram, PackSettings(size=size, min_piece=min_piece))
    sequences = {}
    for length, count in histogram.items():
        for rank in range(count):
            i = np.searchsorted(plan.keys, length * SPAN + rank, "right") - 1
            at = 0
            for k in range(plan.first[i], plan.first[i + 1]):
                assert plan.start[k] == at
                at += plan.length[k]
                sequences.setdefault(plan.sequence[k] + rank - plan.origin[k], []).append((plan.offset[k], plan.length[k]))
            assert at == length
    assert sorted(sequences) == list(range(plan.n_sequences))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size and (at & (at - 1) == 0 or size - at < min_piece)


def test_plan_stays_small():
    many = pack_plan({n: 10**9 // n for n in range(1, 4096)}, PackSettings())
    assert many.padding == 0 and len(many.start) < 200_000
    alike = pack_plan({2100: 10**8}, PackSettings())
    assert len(alike.start) < 1000 and alike.padding < 1e-3 * 2100 * 10**8
