"""Prefix trie of conversations by range minima over sorted LCPs (operator 11).

A conversation is a sequence of turns; every distinct beginning of one is a node. With the sequences sorted, a node's members are an interval: from any member, both ends are
where the common prefix with the neighbour gets shorter than the node is deep. Each end is found by itself, by a binary search in a sparse table of minima; there is no stack
and no order in which nodes must be found.

1. Turns become tokens (a digest and the size of the text), range-sorted by conversation and turn, so one conversation may lie in many partitions; texts aren't
   shuffled. A conversation is then one binary value, and what it borrows from another is cut from that one's first eight turns.
2. Sequences are range-sorted (ties by id, so equal conversations spread over partitions too), and each row's common prefix with the row before is taken as they stream.
   Where partitions meet, the first and last row of each are compared.
3. Rows are cut into blocks. A block has its own sparse tables (common prefixes, ids); over the blocks there is one more, of ``TOP`` entries and one a partition at most.
   A row brings the nodes that are deeper than its common prefix. Ends inside the block are found there; else the table of blocks names the block in which the
   interval ends, and that block has noted, for each depth that reaches in from outside, how far it goes.
4. Members, leaves and saved tokens are differences of running sums at both ends; the smallest id is a range minimum; children are rows whose common prefix is the
   node's depth. Whatever reaches over a block's edge is named by the edge, so a node with a third of all conversations is never a join key with more rows than a block has.
5. The ids that end at a node are the first rows of its interval. Inside a block they are hashed at once; longer runs leave one piece a block, which a SHA-256 (sequential by
   definition) reads in order.

Defined cases: rows without ``conv_id`` belong to no conversation and take no part. Null role and text are empty. Null turns come first; rows of one turn go by the digest of role and
text. Repeated rows are turns of their own. Very long texts only pass through a digest; a sequence takes 24 bytes a turn. An empty table gives an empty result. Other columns never matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import in_order, materialize, row_key, scan_of, steps, table

TOKEN = 24
HEAD = 8
#: Rows of a block: at least so many, and never so few that there are more than ``TOP`` blocks beside those that partitions cut short.
BLOCK, TOP = 16_384, 65_536
SLICE = 1 << 17
_NONE = np.iinfo(np.int64).max


class RangeMin:
    """A sparse table: the minimum of every run of ``2**k`` entries."""

    def __init__(self, values: np.ndarray):
        self.levels, step = [values], 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima over ``lo..hi``; where ``lo > hi`` the largest number."""
        out = np.full(len(lo), _NONE)
        span = hi - lo + 1
        level = np.where(span > 0, np.log2(np.maximum(span, 1)).astype(np.int64), -1)
        for k in np.unique(level[level >= 0]):
            at = level == k
            out[at] = np.minimum(self.levels[k][lo[at]], self.levels[k][hi[at] - (1 << k) + 1])
        return out

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last place up to which all entries after ``at`` are ``depth`` or more."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            fits = at + 1 < len(level)
            fits[fits] = level[at[fits] + 1] >= depth[fits]
            at[fits] += 1 << k
        return at

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first place from which all entries after it, up to ``at``, are ``depth`` or more."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, start = self.levels[k], at - (1 << k) + 1
            fits = start >= 1
            fits[fits] = level[start[fits]] >= depth[fits]
            at[fits] -= 1 << k
        return at


class Counted:
    """How many entries of one value, weighted, lie in a range of places."""

    def __init__(self, values: np.ndarray, weights: np.ndarray):
        self.order = np.lexsort((np.arange(len(values)), values))
        self.kinds, first = np.unique(values[self.order], return_index=True)
        self.first = np.append(first, len(values))
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(weights[self.order])])
        self.step = len(values) + 1
        self.keys = np.searchsorted(self.kinds, values[self.order]) * self.step + self.order

    def between(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        kind = np.minimum(np.searchsorted(self.kinds, value), max(len(self.kinds) - 1, 0))
        if not len(self.kinds):
            return np.zeros(len(lo), np.int64)
        found = (self.kinds[kind] == value) & (lo <= hi)
        a, b = np.searchsorted(self.keys, kind * self.step + lo), np.searchsorted(self.keys, kind * self.step + hi, "right")
        return np.where(found, self.before[np.maximum(b, a)] - self.before[a], 0)


class Top:
    """What is known of all blocks: where they start, their least common prefix and id, running sums."""

    def __init__(self, blocks: list):
        def column(name: str) -> np.ndarray:
            return np.array([r[name] for r in blocks], np.int64)

        n, self.first, self.low, self.same = column("n"), column("first"), column("low"), column("same") == 1
        self.start = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        self.saved = np.concatenate([np.zeros(1, np.int64), np.cumsum(column("w"))])
        self.ended = np.concatenate([np.zeros(1, np.int64), np.cumsum(column("ended"))])
        self.lcps, self.ids, self.children = RangeMin(self.low), RangeMin(column("conv")), Counted(self.low, column("at_low"))

    def __len__(self) -> int:
        return len(self.low)

    def from_left(self, block: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The block in which the interval that reaches into ``block`` from the left begins."""
        return self.lcps.left(block - 1, depth)

    def complete(self, batch: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Open nodes (begun in block ``g``): the block in which they end, what lies between, and the end itself where it is a block's."""
        g, d = batch["g"], batch["d"]
        end = self.lcps.right(g, d) + 1
        last = np.minimum(end, len(self) - 1)
        inside = (end < len(self)) & (self.first[last] >= d)  # ends within block ``end``, which has noted where
        return {
            "t": np.where(inside, end, -1), "mid_conv": self.ids.least(g + 1, end - 1), "mid_children": self.children.between(g + 1, end - 1, d),
            "r": self.start[end] - 1, "pw": self.saved[end], "pe": self.ended[end],
        }


def tokens(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, token, file, at``; a token is 16 bytes of a digest of role and text, and the text's size."""
    scan = scan_of(conversations)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    return scan.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.concat(digest, F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")).alias("token"), *row_key(scan),
    )


def rebuilt(keys: DataFrame, every: int = 5, longest: int = HEAD) -> DataFrame:
    """``conv_id, tokens``: the first turns of the conversation that ``every`` share, then the conversation's own."""
    placed = in_order(keys, keys.count(), "conv_id", "turn", "token", "file", "at")
    own = materialize(
        placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("local", "token"))).alias("found"))
        .select("conv_id", F.unhex(F.array_join(F.transform("found", lambda x: x["token"]), "")).alias("own")),
        "own",
    )
    heads = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.substring("own", 1, TOKEN * longest).alias("head"))
    borrowed = F.crc32(F.col("conv_id").cast("string")) % (longest + 1)
    return (
        own.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left").withColumn("h", (borrowed * TOKEN).cast("int"))
        .select("conv_id", F.expr("concat(substring(coalesce(head, X''), 1, h), substring(own, h + 1))").alias("tokens"))
    )


def _shared(a: bytes, b: bytes) -> int:
    """Tokens that two sequences have in common at their beginning."""
    most = min(len(a), len(b)) // TOKEN
    if a[: most * TOKEN] == b[: most * TOKEN]:
        return most
    low, step = 0, 1
    while step:  # doubles, then halves
        if a[low * TOKEN : (low + step) * TOKEN] == b[low * TOKEN : (low + step) * TOKEN] and low + step <= most:
            low, step = low + step, step * 2
        else:
            step //= 2
    return low


def _sizes(sequence: bytes) -> np.ndarray:
    return np.frombuffer(sequence, ">i8").reshape(-1, TOKEN // 8)[:, -1].astype(np.int64)


_ROW = "part long, idx long, conv long, len long, lcp long, w long, before long, sizes binary, edge binary"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: the prefix shared with the row before (``lcp``), its bytes (``w``), the length of the row before, sizes of the turns after. The first row of a
    partition, and a last one of ``idx`` -1, carry their sequence as ``edge``."""
    before, part, idx = None, None, 0
    kinds = [pa.int64()] * 7 + [pa.binary()] * 2
    names = [c.split()[0] for c in _ROW.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        rows = []
        for conv, now, place in zip(batch.column("conv_id").to_pylist(), batch.column("tokens"), batch.column("part").to_pylist(), strict=True):
            now, part = now.as_py(), place
            lcp = 0 if before is None else _shared(before, now)
            sizes = _sizes(now)
            rows.append((place, idx, conv, len(sizes), lcp, int(sizes[:lcp].sum()), -1 if before is None else len(before) // TOKEN, sizes[lcp:].tobytes(), now if before is None else None))
            before, idx = now, idx + 1
        if rows:
            yield out(rows)
    if before is not None:
        yield out([(part, -1, 0, len(before) // TOKEN, 0, 0, 0, b"", before)])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for part, first, last in zip(batch.column("part").to_pylist(), batch.column("head"), batch.column("tail"), strict=True):
            first, last = first.as_py(), last.as_py()
            lcp = -1 if last is None else _shared(last, first)
            found.append((part, lcp, int(_sizes(first)[: max(lcp, 0)].sum()), -1 if last is None else len(last) // TOKEN))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 4, ["part", "lcp", "w", "before"])


def _met(rows: DataFrame, total: int) -> tuple[DataFrame, int]:
    """Rows with the prefixes of partitions' first rows, and the number of their block. One row for each partition passes the driver."""
    from pyspark.sql import Window  # over one row a partition

    spark = rows.sparkSession
    edges = rows.filter("edge IS NOT NULL").groupBy("part").agg(F.max(F.when(F.col("idx") == 0, F.col("edge"))).alias("head"), F.max(F.when(F.col("idx") == -1, F.col("edge"))).alias("last"))
    met = edges.select("part", "head", F.lag("last").over(Window.orderBy("part")).alias("tail")).mapInArrow(_meet, "part long, lcp long, w long, before long")
    firsts = {r.part: r for r in met.collect()}
    size = max(BLOCK, -(-total // TOP))
    counts, parts = sorted(rows.filter("idx >= 0").groupBy("part").count().collect()), []
    blocks = 0
    for part, n in counts:
        f = firsts[part]
        parts.append((part, blocks, f.lcp, f.w, f.before))
        blocks += -(-n // size)
    of_part = F.broadcast(spark.createDataFrame(parts, "part long, base long, flcp long, fw long, fbefore long"))
    at_edge = F.col("idx") == 0
    joined = rows.filter("idx >= 0").join(of_part, "part").select(
        (F.col("base") + F.expr(f"idx div {size}")).alias("g"), (F.col("idx") % size).alias("i"), "conv", "len",
        F.when(at_edge, F.col("flcp")).otherwise(F.col("lcp")).alias("lcp"), F.when(at_edge, F.col("fw")).otherwise(F.col("w")).alias("w"),
        F.when(at_edge, F.col("fbefore")).otherwise(F.col("before")).alias("before"),
        F.when(at_edge, F.expr("substring(sizes, cast(8 * greatest(flcp, 0) + 1 as int))")).otherwise(F.col("sizes")).alias("sizes"),
    )
    return joined, blocks


def _blocks(rows: DataFrame) -> Top:
    """The table of blocks; at most ``TOP`` rows and one a partition come to the driver."""
    by_depth = rows.groupBy("g", "lcp").agg(
        F.count("*").alias("n"), F.min("conv").alias("conv"), F.sum("w").alias("w"), F.count(F.when(F.col("lcp") < F.col("before"), 1)).alias("ended"),
        F.count(F.when(F.col("len") > F.col("lcp"), 1)).alias("new"), F.max(F.when(F.col("i") == 0, F.col("lcp"))).alias("first"),
        F.max(F.when((F.col("i") == 0) & (F.col("lcp") == F.col("len")), 1)).alias("same"),
    )
    return Top(
        by_depth.groupBy("g").agg(
            F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("w").alias("w"), F.sum("ended").alias("ended"), F.min("lcp").alias("low"),
            F.min_by("new", "lcp").alias("at_low"), F.max("first").alias("first"), F.coalesce(F.max("same"), F.lit(0)).alias("same"),
        ).orderBy("g").collect()
    )


_NUMBERS = ("g", "l", "d", "conv", "n", "children", "leaves", "saved", "pw", "pe", "s", "parent", "edge")
_FOUND = "kind string, " + ", ".join(f"{c} long" for c in _NUMBERS) + ", ends string"


def _found(kind: str, ends: list | None = None, **columns: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = [pa.array([kind] * n, pa.string())]
    for name in _NUMBERS:
        value = columns.get(name)
        arrays.append(pa.nulls(n, pa.int64()) if value is None else value if isinstance(value, pa.Array) else pa.array(np.asarray(value, np.int64)))
    arrays.append(pa.array(ends, pa.string()) if ends is not None else pa.nulls(n, pa.string()))
    return pa.RecordBatch.from_arrays(arrays, ["kind", *_NUMBERS, "ends"])


def _masked(values: np.ndarray, keep: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=~keep)


class Block:
    """Consecutive rows with their sparse tables."""

    def __init__(self, g: int, top: Top, conv: np.ndarray, length: np.ndarray, lcp: np.ndarray, w: np.ndarray, before: np.ndarray, sizes: np.ndarray):
        self.g, self.top, self.conv, self.length, self.lcp, self.w, self.sizes = g, top, conv, length, lcp, w, sizes
        self.lcps, self.ids, self.n = RangeMin(lcp), RangeMin(conv), len(conv)
        self.saved, self.ended = top.saved[g] + np.cumsum(w), top.ended[g] + np.cumsum(lcp < before)
        self.children = Counted(lcp, (length > lcp).astype(np.int64))
        self.after = int(top.first[g + 1]) if g + 1 < len(top) else -1  # prefix shared with the next block
        self.goes_on = g + 1 < len(top) and bool(top.same[g + 1])  # the last sequence is also the next block's first

    def nodes(self) -> Iterator[pa.RecordBatch]:
        """Every node that begins in the block: closed ones whole (``n``), those that reach over its end as far as they go here (``o``)."""
        brings = self.length - self.lcp
        sizes = np.insert(self.sizes, 0, 0) if self.lcp[0] == -1 else self.sizes  # the root's text
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(brings)])
        lo = 0
        while lo < first[-1]:
            hi = min(lo + SLICE, int(first[-1]))
            place = np.arange(lo, hi)
            i = np.searchsorted(first, place, "right") - 1
            d = self.lcp[i] + 1 + place - first[i]
            running = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[int(first[i[0]]) : hi])])
            s = self.w[i] + running[place - first[i[0]]] - running[first[i] - first[i[0]]]
            yield from self._slice(i, d, s)
            lo = hi

    def _slice(self, i: np.ndarray, d: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        top, g = self.top, self.g
        l, r = self.lcps.left(i, d), self.lcps.right(i, d)
        is_open = (r == self.n - 1) & (self.after >= d)
        up = d - 1
        pl, pr = self.lcps.left(i, up), self.lcps.right(i, up)
        over_left = (pl == 0) & (self.lcp[0] >= up)
        over_right = ~over_left & (pr == self.n - 1) & (self.after >= up)
        has = up >= 0
        edge = np.where(over_left, g, g + 1)
        within = has & ~over_left & ~over_right
        conv, children = self.ids.least(l, r), (self.length[i] > d) + self.children.between(l + 1, r, d)
        parents = {"parent": _masked(self.ids.least(pl, pr), within), "edge": _masked(edge, has & ~within)}
        common = {"g": np.full(len(i), g), "l": top.start[g] + l, "d": d, "conv": conv, "children": children, "s": s}
        for kind, which in (("n", ~is_open), ("o", is_open)):
            if which.any():
                at = np.flatnonzero(which)
                mine = {k: v[at] for k, v in common.items()} | {k: v.take(pa.array(at)) for k, v in parents.items()}
                if kind == "n":
                    a, b = l[at], r[at]
                    more = {"n": b - a + 1, "leaves": self.ended[b] - self.ended[a] + 1, "saved": self.saved[b] - self.saved[a] - (b - a) * s[at]}
                    yield _found(kind, self._ends(i[at], d[at]), **mine, **more)
                else:
                    yield _found(kind, self._ends(i[at], d[at]), **mine, pw=self.saved[l[at]], pe=self.ended[l[at]])

    def _ends(self, i: np.ndarray, d: np.ndarray) -> list:
        """Digests of the ids whose sequence ends at a node: null where none does, or where they go on in the next block."""
        ends: list = [None] * len(i)
        last = np.append(np.flatnonzero(self.lcp != self.length), self.n)
        for k in np.flatnonzero(self.length[i] == d):
            stop = int(last[np.searchsorted(last, i[k], "right")])
            if stop < self.n or not self.goes_on:
                ends[k] = hashlib.sha256(self._ids(int(i[k]), stop).encode()).hexdigest()
        return ends

    def _ids(self, a: int, b: int) -> str:
        return ",".join(map(str, self.conv[a:b].tolist()))

    def pieces(self) -> Iterator[pa.RecordBatch]:
        """Runs of equal sequences that reach over an edge of the block: their ids here (``p``), under the block in which the node begins."""
        new = np.flatnonzero(self.lcp != self.length)
        spans = []
        if self.lcp[0] == self.length[0]:
            spans.append((0, int(new[0]) if len(new) else self.n))
        if len(new) and self.goes_on:
            spans.append((int(new[-1]), self.n))
        for a, b in spans:
            d = np.array([self.length[a]])
            begins = self.top.from_left(np.array([self.g]), d) if a == 0 and self.lcp[0] == self.length[0] else np.array([self.g])
            yield _found("p", [self._ids(a, b)], g=begins, d=d, l=np.array([self.g]))

    def noted(self) -> Iterator[pa.RecordBatch]:
        """For each depth that reaches in from the left and stops here: how far it goes (``e``)."""
        if self.g == 0:
            return
        d = np.arange(int(self.lcps.levels[0].min()) + 1, int(self.lcp[0]) + 1)
        for lo in range(0, len(d), SLICE):
            depth = d[lo : lo + SLICE]
            zero = np.zeros(len(depth), np.int64)
            r = self.lcps.right(zero, depth)
            yield _found(
                "e", None, g=zero + self.g, d=depth, l=self.top.start[self.g] + r, conv=self.ids.least(zero, r), children=self.children.between(zero, r, depth),
                pw=self.saved[r], pe=self.ended[r],
            )


def _search(top: Top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            conv, length, lcp, w, before = (whole.column(c).to_numpy() for c in ("conv", "len", "lcp", "w", "before"))
            sizes = np.frombuffer(b"".join(whole.column("sizes").to_pylist()), np.int64)
            one = Block(int(whole.column("g")[0].as_py()), top, conv, length, lcp, w, before, sizes)
            yield from one.nodes()
            yield from one.pieces()
            yield from one.noted()

        for batch in batches:
            cuts = np.flatnonzero(np.diff(batch.column("g").to_numpy())) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if held and b > a and held[0].column("g")[0] != batch.column("g")[a]:
                    yield from block()
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from block()

    return run


def _complete(top: Top):
    names = ("t", "mid_conv", "mid_children", "r", "tw", "te")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = top.complete({c: batch.column(c).to_numpy() for c in ("g", "d")})
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, pa.int64()) for v in more.values()]], [*batch.schema.names, *names])

    return run


def _begins(top: Top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edge, d = batch.column("edge").to_numpy(), batch.column("d").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("edge"), batch.column("d"), pa.array(top.from_left(edge, d), pa.int64())], ["edge", "d", "g"])

    return run


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces come by node, in order; a comma stands between them."""
    key, digest = None, None
    kinds = [pa.int64(), pa.int64(), pa.string()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["g", "d", "ends"])

    for batch in batches:
        done = []
        for g, d, text in zip(batch.column("g").to_pylist(), batch.column("d").to_pylist(), batch.column("ends"), strict=True):
            if (g, d) != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (g, d), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.as_buffer())
        if done:
            yield out(done)
    if key is not None:
        yield out([(*key, digest.hexdigest())])


def _nodes(sequences: DataFrame) -> DataFrame:
    spark = sequences.sparkSession
    written = materialize(sequences, "rebuilt")
    total = written.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 1_000_000))
    ordered = written.repartitionByRange(parts, "tokens", "conv_id").sortWithinPartitions("tokens", "conv_id").withColumn("part", F.spark_partition_id().cast("long"))
    rows, blocks = _met(materialize(ordered.mapInArrow(_prefixes, _ROW), "prefixes"), total)
    rows = materialize(rows, "rows")
    top = _blocks(rows)
    tasks = max(1, min(blocks, parts))
    found = materialize(rows.repartition(tasks, "g").sortWithinPartitions("g", "i").mapInArrow(_search(top), _FOUND), "found")
    numbers = ", ".join(f"{c} long" for c in ("g", "l", "d", "conv", "children", "s", "pw", "pe", "parent", "edge"))
    begun = found.filter("kind = 'o'").select(*[c.split()[0] for c in numbers.split(", ")], F.col("ends").alias("own_ends"))
    reached = found.filter("kind = 'e'").select(
        F.col("g").alias("t"), "d", F.col("l").alias("er"), F.col("conv").alias("econv"), F.col("children").alias("echildren"), F.col("pw").alias("ew"), F.col("pe").alias("ee")
    )
    hashed = found.filter("kind = 'p'").select("g", "d", "l", "ends").repartition("g", "d").sortWithinPartitions("g", "d", "l").select("g", "d", "ends").mapInArrow(_hash_pieces, "g long, d long, ends string")
    joined = begun.mapInArrow(_complete(top), f"{numbers}, own_ends string, t long, mid_conv long, mid_children long, r long, tw long, te long").join(reached, ["t", "d"], "left").join(hashed, ["g", "d"], "left")
    r, pw, pe = F.coalesce("er", "r"), F.coalesce("ew", "tw"), F.coalesce("ee", "te")
    wide = materialize(
        joined.select(
            "g", "d", "l", F.least("conv", "mid_conv", "econv").alias("conv"), (r - F.col("l") + 1).alias("n"), (F.col("children") + F.col("mid_children") + F.coalesce("echildren", F.lit(0))).alias("children"),
            (pe - F.col("pe") + 1).alias("leaves"), (pw - F.col("pw") - (r - F.col("l")) * F.col("s")).alias("saved"), "parent", "edge", F.coalesce("own_ends", "ends").alias("ends"),
        ),
        "wide",
    )
    nodes = found.filter("kind = 'n'").select("d", "conv", "n", "children", "leaves", "saved", "parent", "edge", "ends").unionByName(wide.drop("g", "l"))
    edges = nodes.filter("edge IS NOT NULL").select("edge", (F.col("d") - 1).alias("d")).distinct().mapInArrow(_begins(top), "edge long, d long, g long")
    parents = materialize(edges.join(wide.select("g", "d", F.col("conv").alias("over")), ["g", "d"]).select(F.col("edge").alias("pedge"), (F.col("d") + 1).alias("pd"), "over"), "parents")
    none = hashlib.sha256(b"").hexdigest()
    return materialize(
        nodes.join(parents, (F.col("edge") == F.col("pedge")) & (F.col("d") == F.col("pd")), "left").select(
            F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.coalesce("parent", "over").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(none)).alias("ends_sha256"),
        ),
        "nodes", lasting=True,
    )


def trie(sequences: DataFrame) -> DataFrame:
    """One row for each node of ``conv_id, tokens``, which is read once."""
    with steps(sequences.sparkSession):
        return _nodes(sequences)


def conversation_trie(conversations: DataFrame, every: int = 5) -> DataFrame:
    """The trie of rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    with steps(conversations.sparkSession):
        return _nodes(rebuilt(materialize(tokens(conversations), "tokens"), every))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op11_conversation_prefix_trie": op11_conversation_prefix_trie}

#: Every prefix as a joined list of digests; subtrees by joining nodes with all their ancestors. Checksums as in the SQL of operator 3.
ORACLES = {
    "op11_conversation_prefix_trie": r"""
        WITH steps AS (
          SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b:
                 CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS crc_table),
        t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, substr(sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), 1, 32) AS token, octet_length(encode(text)) AS size,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), 1, 32)) AS k FROM t),
        h AS (SELECT conv_id, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda x: CAST(('0x' || x) AS BIGINT)),
                     lambda c, x: xor(c >> 8, crc_table[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) % 9 AS h
              FROM (SELECT DISTINCT conv_id FROM t), steps),
        b AS (SELECT h.conv_id, 0 AS own, o.k, o.token, o.size FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5 AND o.k <= h.h
              UNION ALL SELECT h.conv_id, 1, o.k, o.token, o.size FROM h JOIN o ON o.conv_id = h.conv_id AND o.k > h.h),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS d FROM b),
        s AS (SELECT h.conv_id, coalesce(x.list, []) AS list, coalesce(x.sizes, []) AS sizes
              FROM h LEFT JOIN (SELECT conv_id, list(token ORDER BY d) AS list, list(size ORDER BY d) AS sizes FROM r GROUP BY conv_id) x USING (conv_id)),
        m AS (SELECT conv_id, d, sha256(array_to_string(list[1:d], ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(list[1:d - 1], ',')) END AS parent,
                     CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size, len(list) = d AS stops, list_transform(range(d + 1), lambda x: sha256(array_to_string(list[1:x], ','))) AS above
              FROM s, unnest(range(len(list) + 1)) AS u(d)),
        n AS (SELECT node, min(d) AS d, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size, arg_min(above, conv_id) AS above,
                     sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (stops), '')) AS ends_sha256 FROM m GROUP BY node),
        c AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
        w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (node)),
        a AS (SELECT ancestor AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved
              FROM (SELECT unnest(above) AS ancestor, n_children, n_convs, size FROM w) GROUP BY ancestor)
        SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, a.n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, w.ends_sha256
        FROM w JOIN a USING (node) LEFT JOIN w p ON p.node = w.parent"""
}
