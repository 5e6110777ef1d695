"""Operator 13: updates against plain ones, features against plain counting, scores against held-out labels."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest

from tessera.llm import quality, words


def test_words_are_the_same_in_any_stretch():
    text = "Ünder the  QUICK brown\tfox x" + "y" * 500 + " z\n" + "Ab " * 300
    raw = words.of_text(text)

    def all_of(stretch):
        parts = list(words.words(raw, quality._CLASSES, stretch))
        return [np.concatenate([p[i] for p in parts]) for i in range(3)]

    whole = all_of(1 << 16)
    plain = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    assert whole[1].tolist() == [len(w) for w in plain]
    assert len(set(whole[0].tolist())) == len({w.lower() for w in plain})
    for stretch in (1, 2, 7, 64):
        assert all((a == b).all() for a, b in zip(whole, all_of(stretch), strict=True))


def test_features_are_the_same_in_any_stretch(monkeypatch):
    text = "One two!! TWO two three ### 4 five\n" * 60
    at, x = quality.features(words.of_text(text), 12)
    assert abs(float(x @ x) - 1) < 1e-9
    for stretch in (3, 50, 1000):
        monkeypatch.setattr(quality, "words", lambda raw, marks, s=stretch: words.words(raw, marks, s))
        again = quality.features(words.of_text(text), 12)
        assert (again[0] == at).all() and np.allclose(again[1], x)
    n = len(text.split())
    found = sum(len(part) for part in quality._stretches(words.of_text(text), 12))
    assert found == n + n + (n - 1) + (n - 1) + (n - 2)
    assert len(quality.features(words.of_text(" \n"), 12)[0]) == 0


def test_updates_are_those_of_the_definition():
    rng = np.random.default_rng(2)
    model = quality.Leader(bits=4, alpha=0.7, beta=1.0, l1=0.1, l2=0.2)
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == 16 else (0.1, 0.2)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.7 + l2)

    for _ in range(200):
        at = np.unique(rng.integers(0, 16, 5))
        x, y = rng.random(len(at)), float(rng.integers(0, 2))
        model.update(at, x, y)
        pairs = [*zip(at.tolist(), x.tolist(), strict=True), (16, 1.0)]
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in pairs)))
        moved = []
        for i, v in pairs:
            g = (p - y) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7
            moved.append((i, g - sigma * weight(i), g * g))
        for i, dz, dn in moved:
            z[i] += dz
            n[i] += dn
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
    assert np.allclose(model.weights(), [weight(i) for i in range(17)])


def test_held_out_labels(spark, duck):
    from tessera.llm import registry

    sf = "/root/testdata/sf0.01"
    rows = registry.queries()["op13_quality_classifier"](spark, sf).collect()
    labels = dict(duck.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    assert len(rows) == duck.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.95


def test_odd_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 0), (4, 1, 0), (6, 1, 0), (8, 0, 1), (9, None, 0), (None, 1, 0), (10, 7, 0)], "doc_id long, quality int, text int")
    found = {(r.doc_id, r.score, r.predicted, r.held_out) for r in quality.classify(edge_docs, labels).collect()}
    assert sum(1 for r in found if r[0] == 6) == 1 and len(found) == 12
    empty = {r[1] for r in found if r[0] in (1, 2, 3)}
    assert len(empty) == 1 and 0 < empty.pop() < 1
    assert not any(r[3] for r in found if r[0] is None)
    assert quality.classify(no_docs, labels).count() == 0
    assert {r.score for r in quality.classify(edge_docs, labels.filter("1 = 0")).collect()} == {0.5}


def test_learns_from_allowed_labels_only(spark, edge_docs):
    labels = edge_docs.select("doc_id", (edge_docs.doc_id % 2).cast("int").alias("quality"))
    learned = {r.text for r in quality.examples(edge_docs, labels).collect()}
    assert learned and not any(zlib.crc32(str(i).encode()) % 5 == 0 and t in learned for i, t in edge_docs.select("doc_id", "text").collect() if t and i not in (5, 6, None))
    assert quality.examples(edge_docs, labels, sample=2).count() == 2


@pytest.mark.parametrize("size", [50_000_000])
def test_very_long_texts_stay_small(size):
    import tracemalloc

    text = words.of_text("word and more of them!! " * (size // 24))
    tracemalloc.start()
    at, _ = quality.features(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(at) and peak < 60_000_000
