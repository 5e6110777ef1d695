"""MinHash near-dedup with sequential Bayesian verification (operator 9).

Texts are lower-cased (A-Z), cut at white space, and become sets of word 5-grams, each a 64-bit hash.

1. Every set gets ``HASHES`` minima, of which a byte each is kept as its signature. Texts with equal sets are one
   node from here on.
2. Bands of ``rows`` whole minima are bucket keys. A pair at the threshold shares none of them with probability
   ``(1 - threshold**rows) ** bands`` (4e-6 by default).
3. Star step: every member of a bucket is a candidate against the bucket's best connected member. Candidates are compared
   by batches of their signatures; after each batch the posterior (uniform prior) that the similarity
   reaches the threshold is bounded, and the pair is dropped once that is under ``miss``. Survivors are
   verified exactly, on full sets made from whole texts. Verified links give components.
4. Rest step: only buckets that still hold several components matter. There, all pairs of different
   components are compared in the same way, so no link between different texts is lost; buckets of any size
   are cut into blocks and each pair of blocks is one small piece of work. Pairs inside a component
   need no test, so a large group of near copies costs its size, not its square.
5. Components again, now with all links.

Signatures are written to the shared workspace with a row number, which links are keyed by, and the row's file and
place there, by which the few texts that are verified are fetched from the documents themselves.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; with fewer than
five words the whole sequence is the one shingle. Rows that repeat a ``doc_id`` are separate nodes. A null
``doc_id`` is never smallest where another is there. Very long texts are read in stretches; a text takes its distinct shingles (8 bytes each), twice over while they are
sorted, beside its bytes. An empty table gives an empty result. Columns beside id and text never matter, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import materialize, row_key, scan_of, steps, table, without
from tessera.llm.components import components
from tessera.llm.words import ODD, mix, text_bytes, words

WORDS = 5
PERCENT = 85
BANDS, ROWS = 32, 7
HASHES = 512
BATCH = 32
MISS = 1e-5
BLOCK = 256

_WEIGHTS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingles(raw: np.ndarray) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text's bytes, which are read in stretches: the last words of one are the first of the next."""
    found, last = [], np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        for own, _, _ in words(raw):
            hashes = np.concatenate([last, own])
            n = len(hashes) - WORDS + 1
            if n < 1:
                last = hashes
                continue
            found.append(_joined(hashes, n, WORDS))
            if len(found) > 64:
                found = [np.unique(np.concatenate(found))]
            last = hashes[n:]
        if not found and len(last):
            found.append(_joined(last, 1, len(last)))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def _joined(hashes: np.ndarray, n: int, width: int) -> np.ndarray:
    whole = np.full(n, width, np.uint64)
    for i in range(width):
        whole = mix(whole + hashes[i : i + n] * _WEIGHTS[i])
    return whole


@functools.lru_cache(maxsize=4)
def _functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_917)
    return rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def signature(hashes: np.ndarray, k: int) -> np.ndarray:
    """``k`` minima (uint32) of linear functions of the hashes, a few thousand at a time."""
    a, b = _functions(k)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    folded = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(folded), 2048):
        np.minimum(out, (folded[at : at + 2048, None] * a + b).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of it."""
    parts = sig.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * ODD
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key ^ (parts[:, r] * _WEIGHTS[r % len(_WEIGHTS)] + np.uint64(r)))
    return key.view(np.int64)


@functools.lru_cache(maxsize=8)
def least_matches(k: int, batch: int, percent: int, miss: float) -> tuple[int, ...]:
    """Matches needed after each batch: with fewer, P(similarity >= threshold | matches) is under ``miss``.

    Bytes of different minima match by chance once in 256. With a uniform prior the posterior of the chance to match
    is Beta(m+1, n-m+1), whose upper tail is a binomial sum.
    """
    t, out = percent / 100 + (1 - percent / 100) / 256, []
    for n in range(batch, k + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def likely(a: np.ndarray, b: np.ndarray, percent: int = PERCENT, miss: float = MISS, batch: int = BATCH) -> np.ndarray:
    """Which rows of two signature matrices survive the sequential test."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for step, least in enumerate(least_matches(a.shape[1], batch, percent, miss)):
        cols = slice(step * batch, (step + 1) * batch)
        matches[alive] += (a[alive, cols] == b[alive, cols]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        if not len(alive):
            break
    return alive


def alike(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return bool(len(x) and len(y)) and 100 * shared >= percent * (len(x) + len(y) - shared)


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, digests, sigs, keys = [], [], [], []
            for text in batch.columns[-1]:
                own = shingles(text_bytes(text))
                numbers.append(len(own))
                if len(own):
                    minima = signature(own, max(HASHES, bands * rows))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    sigs.append(((minima * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes())
                    keys.append(band_keys(minima[: bands * rows], bands, rows))
                else:
                    digests.append(None)
                    sigs.append(None)
                    keys.append(np.empty(0, np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32())
            flat = pa.array(np.concatenate([np.empty(0, np.int64), *keys]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(numbers, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()),
                 pa.ListArray.from_arrays(offsets, flat)],
                [*batch.schema.names[:-1], "n_shingles", "digest", "sig", "keys"],
            )
        pa.default_memory_pool().release_unused()

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _prune(percent: int, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keep = likely(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), percent, miss)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, np.ndarray] = {}

        def of(row: int, text: pa.Scalar) -> np.ndarray:
            if row not in memo:
                if len(memo) >= 64:
                    memo.pop(next(iter(memo)))
                memo[row] = shingles(text_bytes(text))
            return memo[row]

        for batch in batches:
            a, b, x, y = (batch.column(c) for c in ("a", "b", "text_a", "text_b"))
            keep = [i for i, (p, q) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)) if alike(of(p, x[i]), of(q, y[i]), percent)]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in (a, b)], ["a", "b"])

    return run


def _compare_blocks(percent: int, miss: float):
    """All pairs of different components of each run of equal (key, i, j): of block i with block j."""
    def pairs_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        row, comp, block = (group.column(c).to_numpy() for c in ("row", "comp", "block"))
        band, i, j = (group.column(c)[0].as_py() for c in ("band", "i", "j"))
        sig = _matrix(group.column("sig").combine_chunks())
        keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(row), -1)
        left = np.flatnonzero(block == i)
        a, b = [], []
        for x in left:
            others = np.flatnonzero((block == j) & (comp != comp[x]) & ((row > row[x]) | (i != j)))
            if len(others):
                near = others[likely(np.broadcast_to(sig[x], (len(others), sig.shape[1])), sig[others], percent, miss)]
                # Only the first band that a pair shares reports it.
                near = near[~(keys[near, :band] == keys[x, :band]).any(axis=1)]
                a.append(np.full(len(near), row[x]))
                b.append(row[near])
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *a]), np.concatenate([empty, *b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: pa.Table) -> pa.RecordBatch:
            a, b = pairs_of(group)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            key = np.stack([now.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()
            for start, end in zip([0, *cuts], cuts, strict=False):
                yield out(now.slice(start, end - start))
            held = now.slice(cuts[-1] if cuts else 0)
        if held is not None:
            yield out(held)

    return run


def _verified(pairs: DataFrame, texts: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are alike; ``places`` says in which ``file``, and where in it, a row's text stands."""
    pairs = materialize(pairs, "pairs")
    named = materialize(places.join(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "row", "left_semi"), "named")
    texts = texts.join(named, ["file", "at"]).select("row", "text")
    full = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return materialize(full.select("a", "b", "text_a", "text_b").mapInArrow(_verify(percent), "a long, b long"), "verified")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, band_rows: int = ROWS,
    miss: float = MISS, block: int = BLOCK,
) -> DataFrame:
    """``file, at, doc_id, n_shingles, component_id, is_first`` for every row.

    ``component_id`` is the smallest ``doc_id`` of the component; one row that has it is its first.
    """
    scan = scan_of(docs)
    with steps(docs.sparkSession):
        groups, first = _grouped(scan, id_col, text_col, percent, bands, band_rows, miss, block)
    return groups.join(first, "group", "left").withColumn("first", F.coalesce("first", _ahead())).select(
        "file", "at", "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("is_first")
    )


def _ahead() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")


def _grouped(
    scan: DataFrame, id_col: str, text_col: str, percent: int, bands: int, band_rows: int, miss: float, block: int
) -> tuple[DataFrame, DataFrame]:
    """Rows with their group, and the first row of each group of several."""
    texts = scan.select(*row_key(scan), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    signed = materialize(
        texts.mapInArrow(_sign(bands, band_rows), f"file long, at long, doc_id {kind}, n_shingles long, digest binary, sig binary, keys array<long>")
        .withColumn("row", F.monotonically_increasing_id()), "signed"
    )
    texts, places = texts.drop("doc_id"), signed.select("row", "file", "at")
    # Texts with equal sets are one node, the least row.
    node_of = materialize(signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("row").alias("node")), "nodes")
    nodes = signed.join(node_of.select(F.col("node").alias("row")), "row", "left_semi")
    keys = materialize(nodes.select("row", F.posexplode("keys").alias("band", "key")), "keys")
    shared = keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")
    # A bucket's first is the member that shares most buckets with most others: the text the copies were made from,
    # where it is there, so that one star reaches what stars around a random copy would miss.
    fame = shared.groupBy("row").agg(F.sum("n").alias("fame"))
    shared = materialize(shared.join(fame, "row"), "shared")
    buckets = shared.groupBy("key").agg(F.max_by("row", F.struct(F.col("fame"), -F.col("row"))).alias("first"))
    sigs = nodes.select("row", "sig")

    # Star step.
    star = (
        shared.join(buckets, "key").filter("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b")).distinct()
        .join(sigs.select(F.col("row").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(sigs.select(F.col("row").alias("b"), F.col("sig").alias("sig_b")), "b")
        .select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(percent, miss), "a long, b long")
    )
    links = _verified(star, texts, places, percent)
    found = components(links)

    # Rest step.
    placed = shared.join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("comp", F.coalesce("root", "row"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
    # Pairs with the bucket's centre have been tested; a bucket of two holds no other.
    blocked = (
        placed.filter("n > 2").join(open_keys, "key", "left_semi")
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "band", "row", "comp")
        .join(nodes.select("row", "sig", "keys"), "row")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        .select("key", "i", "j", "block", "band", "row", "comp", "sig", "keys")
    )
    rest = blocked.mapInArrow(_compare_blocks(percent, miss), "a long, b long")
    more = _verified(rest.distinct(), texts, places, percent)
    linked = components(more.union(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    groups = (
        signed.select("file", "at", "row", "doc_id", "n_shingles", "digest")
        .join(node_of, "digest", "left")
        .join(linked.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
        .withColumn("group", F.coalesce("root", "node", "row"))
        .select("file", "at", "row", "doc_id", "n_shingles", "group")
    )
    groups = materialize(groups, "groups", lasting=True)
    # Groups of several rows only, and written: then a group of any size can be split by the join.
    first = groups.groupBy("group").agg(F.min(_ahead()).alias("first"), F.count("*").alias("n")).filter("n > 1").select("group", "first")
    return groups, materialize(first, "first", lasting=True)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, with the columns it came with. Only keys of what goes are written and joined."""
    scan = scan_of(docs)
    with steps(docs.sparkSession):
        found = near_duplicates(scan, id_col, text_col, **options)
        dropped = materialize(found.filter(~F.col("is_first")).select("file", "at"), "dropped", lasting=True)
    return without(scan, dropped)


def op9_bayesian_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


QUERIES = {"op9_bayesian_near_dedup": op9_bayesian_near_dedup}

ORACLES = {
    "op9_bayesian_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
        r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a),
        m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
        SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, m.doc_id = component_id AS kept
        FROM m LEFT JOIN n ON m.doc_id = n.doc_id"""
}
