"""Encoding, spans and decoding against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tessera.llm import sentence_pieces as S
from tests.llm.conftest import TEXTS


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.public_model())


@pytest.fixture(scope="module")
def model():
    with open(S.public_model(), "rb") as f:
        return S.Model(f.read())


def check(model, library, text: str) -> None:
    ids, begins, ends = model.encode(text.encode())
    assert ids.tolist() == library.encode(text)
    proto = library.encode(text, return_type="proto")
    assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == [(p.begin, p.end) for p in proto.pieces]
    assert model.decode(ids) == library.decode(ids.tolist())


def test_random_texts(model, library):
    rng = random.Random(1)
    letters = "abc  \n\té▁日本👍́ÿ0<>/s|\x00⁇�"
    for _ in range(1500):
        check(model, library, "".join(rng.choice(letters) for _ in range(rng.randint(0, 25))))
    for text in ("", " ", "    ", "<s> x </s>", "<0x41>", "a" * 3000, "xyz" * 500, "日本語" * 200, "▁▁ a"):
        check(model, library, text)


def test_documents(model, library, spark, data_dir):
    for r in spark.read.parquet(f"{data_dir}/documents.parquet").limit(100).collect():
        check(model, library, r.text)


def test_batches_are_what_single_texts_are(model, library, spark, data_dir):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abé 日\n▁👍 ") for _ in range(rng.randint(0, 12))) for _ in range(800)] + [None, "", " ", "a", "a b", " a", "a "]
    texts += [r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").limit(60).collect()]
    for part in (texts, texts[::-1], texts[-30:], [""], [None, "x"]):
        ids, begins, ends, bounds = model.encode_batch(pa.array([None if t is None else t.encode() for t in part], pa.binary()))
        decoded = model.decode_batch(ids, bounds)
        for i, text in enumerate(part):
            lo, hi = bounds[i], bounds[i + 1]
            one = model.encode((text or "").encode())
            assert [x[lo:hi].tolist() for x in (ids, begins, ends)] == [x.tolist() for x in one], text
            assert decoded[i].as_py() == library.decode(one[0].tolist())


def coded(rows: pa.RecordBatch, size: int) -> list[dict]:
    with open(S.public_model(), "rb") as f:
        run = S._code(f.read(), ["doc_id"], True, True, size)
    return [r for batch in run(iter([rows])) for r in batch.to_pylist()]


def test_stretches_are_what_whole_texts_are(library):
    rng = random.Random(11)
    texts = ["".join(rng.choice("abé 日\n▁👍 xyz  the of in") for _ in range(rng.randint(1, 120))) for _ in range(60)]
    texts += ["a" * 90, " " * 40, "▁" * 40, "x " * 60, "日" * 50, None, ""]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    want = coded(rows, 10**9)
    assert [r["ids"] for r in want] == [[1, *library.encode(t or ""), 2] for t in texts]
    for size in (1, 5, 33):
        assert coded(rows, size) == want


def test_a_very_long_text_takes_bounded_memory(library):
    text = "Some words, and others — in a row: 日本 👍. " * 200_000  # 10 MB
    rows = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    with open(S.public_model(), "rb") as f:
        run = S._code(f.read(), ["doc_id"], False, False)
    tracemalloc.start()
    (batch,) = run(iter([rows]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(text.encode())
    ids = [1, *library.encode(text), 2]
    assert batch.column("ids_sha256")[0].as_py() == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert batch.column("decoded")[0].as_py() == text


def test_decoding_any_ids(model, library):
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 9))]
        assert model.decode(np.array(ids, np.int64)) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("extra", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("escape", [True, False])
def test_normalisation_through_a_compiled_map(rule, extra, prefix, escape):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=extra, escape_whitespaces=escape)
    spec = dict(S._fields(library.serialized_normalizer_spec()))
    model = object.__new__(S.Model)
    model.map = S.CharacterMap(spec.get(2, b""))
    model.dummy_prefix, model.remove_extra, model.escape = prefix, extra, escape
    rng, texts = random.Random(5), []
    letters = "aB  ﬁｱ①Åé가각ガガ㍿ß　\t½…ſ́"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        raw = text.encode()
        norm, origin, stops, tails = model.normalize(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        want = library.normalize(text)
        assert norm.tobytes().decode() == want, repr(text)
        assert stops.tolist() == [0, len(norm)] and len(origin) == len(norm)
        assert all(a <= b for a, b in zip(origin, [*origin[1:], tails[0]], strict=False))
        texts.append(raw)
    bounds = np.cumsum([0, *map(len, texts)])
    norm, _, stops, _ = model.normalize(np.frombuffer(b"".join(texts), np.uint8), bounds)
    assert [norm[a:b].tobytes().decode() for a, b in zip(stops, stops[1:], strict=False)] == [library.normalize(t.decode()) for t in texts]


def with_map(rule: str, extra: bool) -> bytes:
    """The public model with another normaliser."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=extra, escape_whitespaces=True).serialized_normalizer_spec()
    with open(S.public_model(), "rb") as f:
        blob = f.read()

    def field(number: int, value: bytes | int) -> bytes:
        def varint(n: int) -> bytes:
            return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

        return varint(number << 3 | 2) + varint(len(value)) + value

    return b"".join(field(n, spec if n == 3 else v) for n, v in S._fields(blob))


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("extra", [True, False])
def test_spans_through_a_compiled_map(rule, extra, tmp_path, spark, edge_docs):
    blob = with_map(rule, extra)
    library, model = sentencepiece.SentencePieceProcessor(model_proto=blob), S.Model(blob)
    rng = random.Random(7)
    letters = "aB  ﬁｱ①Åé각ガガ㍿ß　\t½…ſ́x▁👍"
    for _ in range(600):
        check(model, library, "".join(rng.choice(letters) for _ in range(rng.randint(0, 16))))
    (tmp_path / "mapped.model").write_bytes(blob)
    edge_docs.filter("doc_id IS NOT NULL").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in edge_docs.collect()}
    for r in S.op4_sentence_pieces(spark, str(tmp_path), str(tmp_path / "mapped.model")).collect():
        proto = library.encode(texts[r.doc_id], return_type="proto")
        places = [x for p in proto.pieces for x in (p.begin, p.end)]
        assert r.n_tokens == len(proto.pieces) + 2
        assert r.spans_sha256 == hashlib.sha256(np.array(places, "<u4").tobytes()).hexdigest()


def test_edge_cases(spark, edge_docs, no_docs, library):
    with open(S.public_model(), "rb") as f:
        blob = f.read()
    rows = S.encode(edge_docs, blob, carry=["doc_id", "row"]).collect()
    want = sorted((str(d), [1, *library.encode(t or ""), 2]) for d, t, *_ in TEXTS)
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want
    for r in rows:
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert len(r.begins) == len(r.ends) == r.n_tokens - 2
        text = next(t for d, t, *_ in TEXTS if d == r.doc_id)
        assert r.n_bytes == len((text or "").encode()) and (not r.ends or r.ends[-1] == r.n_bytes)
    assert S.encode(no_docs, blob).count() == 0


def test_query_is_the_library(spark, data_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    rows = S.op4_sentence_pieces(spark, data_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = [1, *library.encode(docs[r.doc_id]), 2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
