"""Quality classifier (operator 13): logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

1. Words are hashed (A-Z lower-cased). A word also has a form: which of capitals, small letters, digits and signs it holds, how many
   signs, how long it is (by powers of two), and whether it repeats the word before. Words are counted alone and in pairs, forms alone, in pairs
   and in threes; each n-gram is a hashed coordinate. Counts are damped (log) and a document's vector has length 1.
2. Labelled rows are drawn by a seeded hash, ``SAMPLE`` at most (a bound on what is learned from; scores are for all rows and whole
   texts). They pass ``PASSES`` times, in seeded order, through one stream of FTRL-proximal updates: one step size for each coordinate, L1 for
   sparse weights, L2 for rare ones. Texts stream, so the task holds two numbers for each coordinate and one text.
3. The weights (``2**BITS`` numbers at most) go to all tasks, and every document's score is one sparse dot product. No row is shuffled for it.

Defined cases: a null text counts as empty, and an empty or blank text has no n-grams: its score comes from the bias alone, which is the prior of
the labels as the model learned it. Very long texts are read in stretches; memory beside the text is two arrays of ``2**BITS`` counts. Labels that are null, or
neither 0 nor 1, are not learned; several labels of one document, or several documents of one id, are an example each. Rows with equal texts have equal scores.
Rows without an id are scored, never learned and not held out. Without a label every score is 0.5. An empty table gives an empty result. Columns of the
documents beside id and text never matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import materialize, row_key, scan_of, seeded_order, steps, table
from tessera.llm.words import mix, text_bytes, words

BITS = 18
SAMPLE = 6_000
PASSES = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 0.05
THRESHOLD = 0.3
SEED = 13
HOLD_OUT = 5

_CLASSES = np.zeros((256, 4), np.int64)
_CLASSES[65:91, 0] = _CLASSES[97:123, 1] = _CLASSES[48:58, 2] = 1
_CLASSES[[c for c in range(33, 127) if not chr(c).isalnum()], 3] = 1
_SALTS = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3], np.uint64)


def _forms(hashes: np.ndarray, lengths: np.ndarray, counts: np.ndarray, before: np.uint64 | None) -> np.ndarray:
    held = (counts > 0).astype(np.uint64)
    again = np.empty(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[:1] = before is not None and hashes[:1] == before
    size = np.minimum(np.log2(lengths.astype(np.float64)), 7).astype(np.uint64)
    signs = np.minimum(counts[:, 3], 3).astype(np.uint64)
    return held[:, 0] | held[:, 1] << np.uint64(1) | held[:, 2] << np.uint64(2) | signs << np.uint64(3) | size << np.uint64(5) | again.astype(np.uint64) << np.uint64(8)


def _stretches(raw: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Coordinates of the n-grams that end in each stretch of a text; the last two words stay for the next."""
    shift = np.uint64(64 - bits)
    last_words = last_forms = np.empty(0, np.uint64)
    for hashes, lengths, counts in words(raw, _CLASSES):
        if not len(hashes):
            continue
        forms = mix(_forms(hashes, lengths, counts, last_words[-1] if len(last_words) else None) + _SALTS[0])
        w, f, new = np.concatenate([last_words, hashes]), np.concatenate([last_forms, forms]), len(last_words)
        with np.errstate(over="ignore"):
            found = [mix(hashes ^ _SALTS[1]), forms]
            two = slice(max(new - 1, 0), len(w) - 1)
            after = slice(max(new, 1), len(w))
            found.append(mix(w[two] * _SALTS[2] + w[after]))
            found.append(mix(f[two] * _SALTS[3] + f[after]))
            if len(w) > 2:
                at = max(new, 2)
                found.append(mix((f[at - 2 : -2] * _SALTS[4] + f[at - 1 : -1]) * _SALTS[3] + f[at:]))
        last_words, last_forms = w[-2:], f[-2:]
        yield (np.concatenate(found) >> shift).astype(np.int64)


def features(raw: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of a whole text: damped counts, as a vector of length 1."""
    dense, at, n = None, np.empty(0, np.int64), np.empty(0, np.int64)
    for found in _stretches(raw, bits):
        if dense is None and not len(at):
            at, n = np.unique(found, return_counts=True)
            continue
        if dense is None:
            dense = np.zeros(1 << bits, np.int64)
            dense[at] = n
        dense += np.bincount(found, minlength=1 << bits)
    if dense is not None:
        at = np.flatnonzero(dense)
        n = dense[at]
    value = np.log1p(n)
    return at, value / max(float(np.sqrt((value * value).sum())), 1e-12)


class Leader:
    """FTRL-proximal: weights are what minimises the sum of all gradients so far, an L1 and an L2 term, and the distance from earlier weights."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The last coordinate is the bias, which isn't shrunk."""
        z, n = self.z[at], self.n[at]
        bias = np.arange(len(self.z))[at] == len(self.z) - 1
        l1, l2 = np.where(bias, 0.0, self.l1), np.where(bias, 0.0, self.l2)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + l2))

    def update(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (probability(float(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def probability(score: float) -> float:
    return float(1 / (1 + np.exp(-min(max(score, -60.0), 60.0))))


def is_held_out(id_col: str = "doc_id") -> Column:
    """A fifth of the ids, by checksum; a row without an id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % HOLD_OUT == 0, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``at_order, text, label``: at most ``sample`` labelled rows that aren't held out. Only keys are joined with the labels."""
    scan = scan_of(docs)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    keys = scan.select(F.col(id_col).alias("id"), *row_key(scan)).filter(F.col("id").isNotNull() & ~is_held_out("id"))
    drawn = keys.join(known, "id").select("file", "at", "label", F.struct(seeded_order(SEED, F.col("id")), "file", "at", "label").alias("at_order")).orderBy("at_order").limit(sample)
    drawn = materialize(drawn, "drawn")
    return scan.select(*row_key(scan), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), ["file", "at"]).select("at_order", "text", "label")


def train(labelled: DataFrame, bits: int = BITS, passes: int = PASSES, **leader: float) -> np.ndarray:
    """Weights (the bias last) from a bounded table of ``at_order, text, label``, in one stream of updates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Leader(bits, **leader), 0
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label"), strict=True):
                model.update(*features(text_bytes(text), bits), float(label.as_py()))
                seen += 1
        w = model.weights().astype(np.float32)
        at = np.flatnonzero(w)
        if seen:
            yield pa.RecordBatch.from_pydict({"at": at, "w": w[at].astype(np.float64)})

    ordered = labelled.select(F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass"), "at_order", "text", "label").repartition(1).sortWithinPartitions("pass", "at_order")
    rows = materialize(ordered.select("text", "label").mapInArrow(run, "at long, w double"), "weights").toArrow()
    weights = np.zeros((1 << bits) + 1, np.float32)
    weights[rows.column("at").to_numpy()] = rows.column("w").to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score`` for every row of ``docs``."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            scores = []
            for text in batch.column("text"):
                at, x = features(text_bytes(text), bits)
                scores.append(probability(float(w[at] @ x) + float(w[-1])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row for each document. Scores are written, so that texts go to Python in bounded batches."""
    spark = docs.sparkSession
    with steps(spark):
        weights = train(examples(docs, labels, sample))
    found = materialize(score(docs, weights), "scores")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op13_quality_classifier": op13_quality_classifier}

#: Learned weights have no form in SQL; tests hold the updates against plain ones, and the scores against held-out labels.
ORACLES: dict[str, str] = {}
