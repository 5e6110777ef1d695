"""Nearest neighbours by inner product with multi-index hashing (operator 5).

Vectors get one more coordinate that brings all of them to the same length; then the largest inner product
is the smallest angle. Learned rotations (iterative quantisation: principal axes, then alternating signs and
Procrustes, from several starts) make binary codes whose Hamming distance follows the angle. Codes are split
into 16-bit substrings, each of which is indexed. Two codes within radius ``R`` agree to within
``R // substrings`` in at least one substring, so probing every occupied bucket within that distance, in every
table, retrieves every code within the radius. What is retrieved is checked on whole codes and reranked by exact
inner products in double precision.

Rotations and radius are fitted on a bounded sample (``sample`` vectors, the only thing that goes through the
driver); the radius is the ``coverage`` quantile of the distances of the neighbours one looks for, at the density
of the whole table. Every row is indexed.

A table's buckets are dealt out by the leading bits of the substring, as many as make parts of about ``block`` rows; a part
that a frequent value makes larger is dealt on by a hash of the row. A row goes to one part of each table, once, however
many queries there are. A query goes to the parts whose leading bits are near enough to its own, streams past the rows that wait there and probes
their occupied buckets; a row that an earlier table's probe reaches is left to that one. The query knows the score of its ``k``-th best
in the sample: what is retrieved and scores less can't be among its ``k`` best, so a part returns little. A query
that found too few looks within a radius wider by each of ``STEPS`` bits in turn, and only after the last one with no radius, in the parts of one table;
``radius`` in the result says which one answered.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
number of components isn't the most frequent one, nor rows without an id. Rows that repeat an id are candidates of each other. Equal scores
go to the smaller id. With fewer than ``k`` candidates all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._common import materialize, seeded_order, table

SUB = 16
STEPS = (0, 4, 12, 28)
RESULT = "query_row long, query_id long, row long, vec_id long, score double"
_PART = ["t", "prefix", "salt", "slice"]


def takes_part(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _kind(df: DataFrame, vector_col: str) -> str:
    """Single precision is kept as it is: it takes half the room, and becomes double without loss."""
    return "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"


def number_vectors(df: DataFrame, id_col: str, vector_col: str, query: Column) -> DataFrame:
    """``row, vec_id, vector, is_query`` for the vectors that take part."""
    rows = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector_col).cast(_kind(df, vector_col)).alias("vector"), F.coalesce(query, F.lit(False)).alias("is_query"),
    )
    rows = materialize(rows.filter(F.col("vec_id").isNotNull() & takes_part(F.col("vector"))), "vectors")
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (usual["n"] if usual else 0))


class Coder:
    """Binary codes of augmented vectors."""

    def __init__(self, rotation: np.ndarray, length: float):
        self.rotation, self.length = rotation, length

    def augmented(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.length**2 - (vectors**2).sum(axis=1), 0))
        return np.concatenate([vectors, rest[:, None]], axis=1)

    def codes(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Packed codes, [rows, bits / 16] of uint16."""
        return np.packbits(self.augmented(vectors, query) @ self.rotation > 0, axis=1).view(np.uint16)


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 30, seed: int = 5) -> np.ndarray:
    """Iterative quantisation from several random starts, ``bits`` columns in all."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    columns = []
    while sum(c.shape[1] for c in columns) < bits:
        spin = np.linalg.qr(rng.normal(size=(d, d)))[0]
        projected = sample @ axes
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(projected.T @ np.where(projected @ spin > 0, 1.0, -1.0))
            spin = u @ vt
        columns.append(axes @ spin)
    return np.concatenate(columns, axis=1)[:, :bits]


def hamming(codes: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ one).sum(axis=1, dtype=np.int32)


def fit(sample: np.ndarray, total: int, length: float, k: int, bits: int, coverage: float) -> tuple[Coder, int]:
    """A coder and the radius that covers the neighbours of a table of ``total`` rows like the sample."""
    plain = Coder(np.empty((0, 0)), length)
    coder = Coder(learn_rotation(plain.augmented(sample), bits), length)
    codes, asked = coder.codes(sample), sample[:512]
    asked_codes = coder.codes(asked, query=True)
    near = max(1, min(len(sample) - 1, math.ceil(k * len(sample) / max(total, 1))))
    seen = []
    for i, q in enumerate(asked):
        scores = sample @ q
        scores[i] = -np.inf
        best = np.argpartition(-scores, near - 1)[:near] if len(sample) > near else np.arange(len(sample))
        seen.append(hamming(codes[best[best != i]], asked_codes[i]))
    return coder, int(np.quantile(np.concatenate(seen), coverage, method="higher")) if seen and len(sample) > 1 else bits


def reaches(radius: int, tables: int) -> list[int]:
    """Pigeonhole: how far apart substrings of codes within ``radius`` are at most in one table at least. The first ``spare + 1``
    tables need ``reach``, the others one less."""
    if radius >= SUB * tables:
        return [SUB] * tables
    reach, spare = divmod(radius, tables)
    return [reach if j <= spare else reach - 1 for j in range(tables)]


class Index:
    """The buckets of one table over a part of the codes."""

    def __init__(self, codes: np.ndarray, table: int, radius: int):
        self.codes, self.table, self.radius = codes, table, radius
        self.most = reaches(radius, codes.shape[1])
        self.values, self.bucket = np.unique(codes[:, table], return_inverse=True)

    def within(self, asked: np.ndarray) -> np.ndarray:
        """[queries, rows]: codes within the radius whose buckets this table's probe reaches."""
        reached = np.bitwise_count(self.values ^ asked[:, self.table, None]) <= self.most[self.table]
        whole, one = (x.view(np.uint64) if x.shape[1] % 4 == 0 else x for x in (np.ascontiguousarray(self.codes), np.ascontiguousarray(asked)))
        distance = np.zeros((len(asked), len(self.codes)), np.uint16)
        for j in range(whole.shape[1]):
            distance += np.bitwise_count(whole[:, j] ^ one[:, j, None])
        return reached[:, self.bucket] & (distance <= self.radius)

    def first(self, asked: np.ndarray, query: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which of the pairs (query, place) no earlier table's probe reaches."""
        alone = np.ones(len(place), bool)
        for j in range(self.table):
            alone &= np.bitwise_count(self.codes[place, j] ^ asked[query, j]) > self.most[j]
        return alone


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _code(coder: Coder, sample_rows: np.ndarray, sample: np.ndarray, k: int):
    """Add both codes of each vector, and for queries the score of the ``k``-th best vector of the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(pa.chunked_array([batch.column("vector")])) if len(batch) else np.empty((0, 0))
            least = np.full(len(batch), -np.inf)
            asking = np.flatnonzero(batch.column("is_query").to_numpy(zero_copy_only=False))
            if len(asking) and len(sample) > k:
                scores = vectors[asking] @ sample.T
                scores[sample_rows == batch.column("row").to_numpy()[asking, None]] = -np.inf
                least[asking] = np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k]
            for name, query in (("code", False), ("asked", True)):
                codes = coder.codes(vectors, query).astype(np.int32) if len(batch) else np.empty((0, 1), np.int32)
                offsets = pa.array(np.arange(len(batch) + 1) * codes.shape[1], pa.int32())
                batch = batch.append_column(name, pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())))
            yield batch.append_column("least", pa.array(least, pa.float64()))

    return run


class _Part:
    """The rows of one part, in order of id, so that a stable sort by score leaves ties with the smaller id first."""

    def __init__(self, rows: pa.Table, table: int, radius: int):
        order = np.lexsort((rows["row"].to_numpy(), rows["vec_id"].to_numpy()))
        self.row, self.vec_id = rows["row"].to_numpy()[order], rows["vec_id"].to_numpy()[order]
        self.vectors = _matrix(rows["vector"])[order]
        self.rough, self.largest = self.vectors.T.astype(np.float32), float(np.abs(self.vectors).max())
        self.index = Index(_matrix(rows["code"]).astype(np.uint16)[order], table, radius)

    def nearest(self, asked: pa.Table, k: int) -> dict[str, np.ndarray]:
        queries, own, name = _matrix(asked["vector"]), asked["row"].to_numpy(), asked["vec_id"].to_numpy()
        codes = _matrix(asked["code"]).astype(np.uint16)
        # Single precision tells what is far below the least score that counts; the rest is summed in double precision.
        slack = 1e-5 * self.largest * np.abs(queries).sum(axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            fair = ~(queries.astype(np.float32) @ self.rough < (asked["least"].to_numpy() - slack)[:, None])
        query, place = np.nonzero(self.index.within(codes) & fair)
        keep = (self.row[place] != own[query]) & self.index.first(codes, query, place)
        query, place = query[keep], place[keep]
        score = np.concatenate([np.empty(0), *[(self.vectors[place[at : at + 65_536]] * queries[query[at : at + 65_536]]).sum(axis=1) for at in range(0, len(place), 65_536)]])
        # Of each query, the k best: sorted by score, then id, and numbered.
        order = np.lexsort((place, -score, query))
        query, place, score = query[order], place[order], score[order]
        starts = np.searchsorted(query, np.arange(len(queries)))
        best = np.arange(len(query)) - starts[query] < k
        query, place, score = query[best], place[best], score[best]
        return {"query_row": own[query], "query_id": name[query], "row": self.row[place], "vec_id": self.vec_id[place], "score": score}


def _search(radius: int, k: int, together: int = 128):
    """Rows and queries of each part, rows first: rows are gathered, queries stream past them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, part = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch.column(c).to_numpy() for c in (*_PART, "kind")])
            cuts = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()
            for lo, hi in itertools.pairwise([0, *cuts, len(batch)]):
                place, kind = tuple(key[:-1, lo].tolist()), key[-1, lo]
                if place != now:
                    now, waiting, part = place, [], None
                rows = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                if kind == 0:
                    waiting.append(rows)
                    continue
                if part is None and waiting:
                    part, waiting = _Part(pa.concat_tables(waiting), place[0], radius), []
                for at in range(0, len(rows) if part else 0, together):
                    yield pa.RecordBatch.from_pydict(part.nearest(rows.slice(at, together), k))

    return run


def nearest(
    df: DataFrame,
    query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    bits: int = 128,
    coverage: float = 0.97,
    sample: int = 8_192,
    block: int = 8_192,
    query_block: int = 1 << 20,
) -> DataFrame:
    """``query_id, rank, vec_id, score, radius``: each query row's nearest other rows, and the Hamming radius within which they were looked for.

    More queries than ``query_block`` are dealt out, for the sake of parallel work; only then does a row go to a part more than once.
    """
    rows = number_vectors(df, id_col, vector_col, query)
    total, length, asked = rows.agg(
        F.count("*"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))), F.count_if("is_query")
    ).first()
    picked = rows.orderBy(seeded_order(5, F.col("row")), "row").limit(sample).select("row", "vector").toArrow()
    if len(picked):
        coder, radius = fit(_matrix(picked["vector"]), total, length, k, bits, coverage)
    else:
        coder, radius = Coder(np.empty((0, 0)), 0.0), bits
    known = (picked["row"].to_numpy(), _matrix(picked["vector"])) if len(picked) else (np.empty(0, np.int64), np.empty((0, 0)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    coded = materialize(rows.mapInArrow(_code(coder, *known, k), f"{kinds}, code array<int>, asked array<int>, least double"), "coded")
    lead = max(0, min(SUB, math.ceil(math.log2(max(total, 1) / block))))
    slices = max(1, math.ceil(asked / query_block))
    prefix = F.shiftright("value", SUB - lead)
    dealt = F.sequence(F.lit(0), F.lit(slices - 1))

    def search(queries: DataFrame, within: int) -> DataFrame:
        most = reaches(within, bits // SUB)
        tables = len(most) if within < bits else 1
        placed = coded.select("row", "vec_id", "vector", "code", "least", F.posexplode(F.slice("code", 1, tables)).alias("t", "value")).withColumn("prefix", prefix)
        # A row for each part: its number of hash parts.
        parts = materialize(placed.groupBy("t", "prefix").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("salts")), "parts")
        index = placed.join(parts, ["t", "prefix"]).select(
            "t", "prefix", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int").alias("salt"), F.explode(dealt).alias("slice"), F.lit(0).alias("kind"),
            "row", "vec_id", "vector", "code", "least")
        near = F.filter(F.sequence(F.lit(0), F.lit((1 << lead) - 1)), lambda m: F.bit_count(m) <= F.get(F.array(*map(F.lit, most)), F.col("t")))
        probes = (
            queries.select("row", "vec_id", "vector", "least", F.col("asked").alias("code"), F.posexplode(F.slice("asked", 1, tables)).alias("t", "value"))
            .withColumn("own", prefix).select("*", F.explode(near).alias("mask")).withColumn("prefix", F.col("own").bitwiseXOR(F.col("mask")))
            .join(parts, ["t", "prefix"]).select(
                "t", "prefix", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"),
                F.lit(1).alias("kind"), "row", "vec_id", "vector", "code", "least")
        )
        met = index.unionByName(probes).repartition(*_PART).sortWithinPartitions(*_PART, "kind")
        return met.mapInArrow(_search(within, k), RESULT)

    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("row"))

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    # Queries that find too few look further, a step at a time; only where no step is enough do they look at every row.
    wanted, found, left = min(k, max(total - 1, 0)), None, coded.filter("is_query")
    for within in [*(r for r in (radius + step for step in STEPS) if r < bits), bits]:
        near = materialize(ranked(search(left, within)).withColumn("radius", F.lit(within)), "nearest")
        enough = near.groupBy("query_row").agg(F.count("*").alias("n")).filter(F.col("n") >= wanted).select("query_row")
        done = near if within == bits else near.join(enough, "query_row", "left_semi")
        found = done if found is None else found.unionByName(done)
        left = materialize(left.join(enough, F.col("row") == F.col("query_row"), "left_anti"), "short")
        if left.isEmpty():
            break
    return found.select("query_id", "rank", "vec_id", "score", "radius")


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op5_multi_index_hashing": op5_multi_index_hashing}
#: A search that may miss has no oracle; tests measure its recall against brute force, and compare scores exactly.
ORACLES: dict[str, str] = {}
