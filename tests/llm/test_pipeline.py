"""The pipeline's stages, each against what it should do to its own input."""

from __future__ import annotations

import re
from collections import Counter

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import language_id, mixing, sentence_pieces
from tests.llm.test_near import brute


def test_stages(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    columns = docs.columns
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data_dir)
        assert out.columns == columns, name
        docs = corpus_pipeline.materialize(out, name)
        seen.append(docs.collect())
    start, spoken, exact, near, mixed = seen
    sample = language_id.training_sample(spark.createDataFrame(start, docs.schema).filter(~language_id.held_out()))
    known = {r.doc_id for r in language_id.identify(spark.createDataFrame(start, docs.schema), sample).filter("lang_pred <> 'und'").collect()}
    assert {r.doc_id for r in spoken} == known
    first = {}
    for r in sorted(spoken):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(first.values())
    assert {r.doc_id for r in near} == {root for _, root in brute([(r.doc_id, r.text) for r in exact], 80).values()}
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(near, docs.schema)).collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({d: n for d, n in copies.items() if n})
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data_dir)
    assert last.count() == len(mixed) and set(last.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "spans_sha256"}
    assert sorted(corpus_pipeline.run(spark, data_dir).collect()) == sorted(last.collect())


def test_odd_rows(spark, edge_docs, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.public_model())
    clashing = edge_docs.withColumns({n: F.lit(i) for i, n in enumerate(("_id", "_text", "_metadata", "file", "at", "doc", "last", "copies", "print", "digest", "group", "part"))})
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == clashing.columns, name
        docs = corpus_pipeline.materialize(out, name)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # 1, 2 and 3 have no letter, 6 and the row without an id repeat 5.
    assert {r.doc_id for r in rows} <= {0, 4, 5, 7, 8, 9, 10}
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect()) and len(rows) > 0
    texts = {r.doc_id: r.text for r in edge_docs.collect()}
    assert all(r.n_tokens == 2 + len(library.encode(texts[r.doc_id])) for r in rows)
    edge_docs.filter("1 = 0").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_near_stage_links_from_four_fifths(spark, data_dir):
    docs, gone = [], set()
    for family in range(40):
        words = [f"f{family}w{i}" for i in range(94)]  # 90 shingles; k new last words share 90 - k of 90 + k
        docs.append((10 * family, " ".join(words)))
        for k in (7, 9, 10, 11):  # 0.86, 0.82, 0.80, 0.78
            own = family * 10 + k - 6
            docs.append((own, " ".join(words[:-k] + [f"f{family}k{k}n{i}" for i in range(k)])))
            if k <= 10:
                gone.add(own)
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), data_dir).collect()
    assert {r.doc_id for r in kept} == {d for d, _ in docs} - gone
