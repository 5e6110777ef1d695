"""Phrases against a direct search, accuracy on held-out rows, and odd rows."""

from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language_id as L
from tests.llm.conftest import TEXTS


def longest_first(text: str, sample: str) -> int:
    at = phrases = 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in sample:
            n += 1
        at += max(n - 1, 1)
        phrases += 1
    return phrases


def test_phrases_are_longest_matches():
    rng = random.Random(4)
    sample = {x: "".join(rng.choice(f"ab {x}") for _ in range(60)) for x in "cde"}
    parser = L.Parser(sample)
    norm = lambda t: "".join(map(chr, L.symbols(t)))
    texts = ["".join(rng.choice("abcdez 1") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    got = parser.phrases([parser.encode(t) for t in texts])
    for text, row in zip(texts, got, strict=True):
        assert row.tolist() == [longest_first(norm(text), norm(sample[x])) for x in parser.langs]


def test_stretches_are_one_reading():
    rng = random.Random(6)
    parser = L.Parser({x: "".join(rng.choice(f"ab {x}") for _ in range(60)) for x in "cde"})
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for letters in ("abcdez 1", "ab", "abc") for _ in range(100)]
    # Periodic texts may never fall into step.
    coded = [parser.encode(t) for t in [*texts, "ab" * 150, "a" * 300, "z" * 100, "abc" * 90, ""]]
    want = parser.phrases(coded, stretch=10**6)
    for stretch in (1, 2, 3, 7, 50):
        assert (parser.phrases(coded, stretch) == want).all()


def test_symbols_of_pieces_are_those_of_the_whole():
    text = "Σας ΑΣ. 12 -- ÀB́c\u0130 " * 40
    for chars in (1, 2, 7, 100):
        assert np.concatenate(list(L._symbols(text, chars))).tolist() == L.symbols(text).tolist()
    assert "".join(map(chr, L.symbols("ΑΣ. 12 --b"))) == "ας b"
    assert not len(L.symbols(""))


def test_a_very_long_text_takes_bounded_memory():
    parser = L.Parser({"x": "the cat sat on the mat ", "y": "die katze lag auf der matte "})
    text = "the cat and the rat, " * 480_000  # 10 MB
    tracemalloc.start()
    assert L._verdicts(parser, [text])[0] == ["x"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(text)


def test_held_out_accuracy(spark):
    rows = L.op10_cross_parsing_language(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark, edge_docs, no_docs):
    sample = L.training_sample(edge_docs)
    assert set(sample) == {"en", "de", "fr", "es"}
    rows = L.identify(edge_docs, sample, carry=["doc_id", "row"]).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = next(t for d, t, *_ in TEXTS if d == r.doc_id)
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or "")))
    assert L.identify(no_docs, sample).count() == 0
    assert {r.lang_pred for r in L.identify(edge_docs, {}).collect()} == {"und"}
    kept = L.keep_identified(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == len(TEXTS) - 3
    assert L.keep_identified(no_docs).count() == 0


def test_query_of_odd_rows(spark, edge_docs, tmp_path):
    edge_docs.withColumns({"lang_pred": F.lit("x"), "held_out": F.lit(1), "score": F.lit(2), "file": F.lit(3)}).write.parquet(f"{tmp_path}/documents.parquet")
    rows = L.op10_cross_parsing_language(spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = next(t for d, t, *_ in TEXTS if d == r.doc_id)
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or "")))


def test_batches_do_not_change_results(spark, edge_docs):
    sample = L.training_sample(edge_docs)
    assert sorted(L.identify(edge_docs, sample, chars_per_batch=1).collect(), key=str) == sorted(L.identify(edge_docs, sample).collect(), key=str)


def test_a_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "abc def " * 50, "en") for i in range(3000)], "doc_id long, text string, lang string")
    assert len(L.training_sample(docs, chars_per_language=5_000)["en"]) == 5_000
