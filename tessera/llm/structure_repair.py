"""Conversation structure repair by grammar-compressed dynamic programming (operator 12).

A conversation is well formed if its roles read ``(s?(ua)+)?``: nothing, or pairs of user and assistant, after a system turn or none. Rows are kept (0),
given the role that is due (3), or deleted (4, the only way for blank rows and copies); empty turns are inserted (3); a truncated row that stays costs 3.
What is wanted is the cheapest list of edits, and of those the least in ASCII order.

1. Every row becomes a symbol: class of its role's initial, and its first fault. Only keys (turn, digest, place) are range-sorted by conversation and turn, so one
   conversation can lie in many partitions; a conversation's symbols are then a string of one character a row.
2. Re-Pair finds a grammar over the distinct strings: in each round pairs are counted where they stand, the most frequent ones that share no symbol become
   rules, and rules are applied in order. ``ROUNDS`` bounds the rules; strings may stay longer than one symbol, whatever the grammar.
3. A symbol acts on four states (nothing yet, after s, after u, after a) as a min-plus matrix, whose entries are a cost and a rope of edits. Each rule's matrix is the
   product of its two parts', made once, bottom-up, and shared by all conversations. Ties are settled inside the product: two ropes of one cost between the same states
   hold the same number of rows, so neither begins with the other, and what follows can't turn their order.
4. A conversation's edits are the product over its compressed string. The edits and the rows then stream past in order, a conversation at a time, into a SHA-256
   (sequential by definition), which holds one text and one edit list, never a conversation's texts. Texts are shuffled once, here.

Defined cases: nulls in role and text, and in the key of the damage, are one space. Rows without ``conv_id`` are one conversation, whose id is null. Rows of one turn go
by the digest of role and text, so repeated rows are interchangeable. Null turns come first and don't count for gaps. Roles that don't begin with s, u or a are kept nowhere.
Very long texts only pass through a hash. An empty table gives an empty result. Other columns never matter.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import in_order, materialize, row_key, scan_of, steps, table
from tessera.llm.ropes import Rope

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROUNDS, PAIRS = 12, 16
#: States: nothing yet, after s, after u, after a. Where a role of each initial leads from each of them.
STATES = range(4)
NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ENDS = (0, 3)
CLASSES, FAULTS = "suao", "-tbd"

Matrix = dict[tuple[int, int], tuple[int, Rope]]


def symbol_of(kind: str, fault: str) -> str:
    return chr(ord("A") + 4 * CLASSES.index(kind) + FAULTS.index(fault))


def parts_of(symbol: str) -> tuple[str, str]:
    at = ord(symbol) - ord("A")
    return CLASSES[at // 4], FAULTS[at % 4]


def _better(new: tuple[int, Rope], old: tuple[int, Rope] | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and new[1] < old[1])


def product(a: Matrix, b: Matrix) -> Matrix:
    found: Matrix = {}
    for (p, m), (cost, rope) in a.items():
        for q in STATES:
            if (m, q) in b:
                more, rest = b[m, q]
                if (p, q) not in found or cost + more <= found[p, q][0]:
                    new = (cost + more, rope + rest)
                    if _better(new, found.get((p, q))):
                        found[p, q] = new
    return found


def inserts() -> Matrix:
    """Any number of inserted turns; more than two in a row never pay."""
    one = {(p, NEXT[c, p]): (INSERT, Rope("I")) for c in "ua" for p in STATES if (c, p) in NEXT}
    found: Matrix = {(p, p): (0, Rope("")) for p in STATES}
    for more in (one, product(one, one)):
        for at, new in more.items():
            if _better(new, found.get(at)):
                found[at] = new
    return found


def row_matrix(symbol: str) -> Matrix:
    """Inserted turns, then the row."""
    kind, fault = parts_of(symbol)
    edits: Matrix = {(p, p): (DELETE, Rope("D")) for p in STATES}
    if fault in "-t":
        more = TRUNCATED if fault == "t" else 0
        for p in STATES:
            for c, cost, name in [(kind, KEEP, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")]:
                if (c, p) in NEXT and _better(new := (cost + more, Rope(name)), edits.get((p, NEXT[c, p]))):
                    edits[p, NEXT[c, p]] = new
    return product(inserts(), edits)


class Grammar:
    """Re-Pair rules and the matrix of every symbol. Rule ``i`` is the character ``FIRST + i``."""

    FIRST = 0x100

    def __init__(self):
        self.rules: list[str] = []
        self.matrices = {chr(ord("A") + i): row_matrix(chr(ord("A") + i)) for i in range(len(CLASSES) * len(FAULTS))}
        self.tail = inserts()

    def add(self, pair: str) -> None:
        self.matrices[chr(self.FIRST + len(self.rules))] = product(self.matrices[pair[0]], self.matrices[pair[1]])
        self.rules.append(pair)

    def compress(self, symbols: str) -> str:
        for i, pair in enumerate(self.rules):
            symbols = symbols.replace(pair, chr(self.FIRST + i))
        return symbols

    def matrix(self, symbols: str) -> Matrix:
        """The product over a string, by halves, so that ropes stay shallow."""
        if len(symbols) == 1:
            return self.matrices[symbols]
        half = len(symbols) // 2
        return product(self.matrix(symbols[:half]), self.matrix(symbols[half:]))

    def repair(self, symbols: str) -> tuple[int, str]:
        """Cost and edits of a conversation."""
        whole = product(self.matrix(self.compress(symbols)), self.tail) if symbols else self.tail
        cost, rope = functools.reduce(lambda x, y: y if _better(y, x) else x, [whole[0, q] for q in ENDS if (0, q) in whole])
        return cost, str(rope)


def _count_pairs(rules: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for s in batch.column("symbols").to_pylist():
                for i, pair in enumerate(rules):
                    s = s.replace(pair, chr(Grammar.FIRST + i))
                at = 0
                while at + 1 < len(s):
                    counts[s[at : at + 2]] += 1
                    at += 2 if s[at : at + 3] == s[at] * 3 else 1  # of three alike, one pair
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], ["pair", "n"])

    return run


def learn(strings: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> Grammar:
    """A grammar for a written table of distinct ``symbols``. Each round brings its most frequent ``pairs`` to the driver."""
    grammar = Grammar()
    for _ in range(rounds):
        counts = strings.mapInArrow(_count_pairs(grammar.rules), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        taken, seen = [], set()
        for row in counts.filter("n > 1").orderBy(F.desc("n"), "pair").limit(pairs).collect():
            if not seen & set(row.pair):
                taken.append(row.pair)
                seen |= set(row.pair)
        if not taken:
            break
        for pair in taken:
            grammar.add(pair)
    return grammar


def _crc_key(conv: str, turn: str) -> Column:
    return F.crc32(F.concat_ws(":", F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.coalesce(F.col(turn).cast("string"), F.lit(" "))))


def damage(rows: DataFrame, every: int = 20) -> DataFrame:
    """``rows`` of ``conv_id, turn, role, text`` and more: of ``every`` kinds by the checksum, 0 is gone, 1 emptied, 2 without its ends of sentences, 3 twice
    (``copy`` 0 and 1), 4 given to the user. Gone rows stay as rows with ``gone``."""
    kind = _crc_key("conv_id", "turn") % every
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.withColumns({
        "gone": kind == 0,
        "copy": F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        "text": F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text),
        "role": F.when(kind == 4, "user").otherwise(role),
    })


def digest(role: str = "role", text: str = "text") -> Column:
    """128 bits of role and text as hex digits, which also settle ties."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)), 256), 1, 32)


def _last_mark(text: str) -> Column:
    return F.regexp_extract(F.col(text), r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*+$", 1)


def symbols_of(keys: DataFrame) -> DataFrame:
    """``conv_id, symbols, gaps`` of every conversation from damaged keys: ``conv_id, turn, digest, file, at, copy, gone, kind, fault``."""
    total = keys.count()
    placed = in_order(keys, total, "conv_id", "turn", "digest", "file", "at", "copy")
    again = (
        placed.filter("NOT gone").groupBy("conv_id", "digest").agg(F.min("local").alias("first"), F.count("*").alias("n")).filter("n > 1")
        .select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    )
    again = materialize(again, "again")
    fault = F.when((F.col("fault") != "b") & (F.col("local") > F.col("first")), "d").otherwise(F.col("fault"))
    kinds = F.lit(len(FAULTS)) * (F.instr(F.lit(CLASSES), F.col("kind")) - 1) + F.instr(F.lit(FAULTS), F.col("marked")) - 1
    marked = placed.join(again, placed["conv_id"].eqNullSafe(F.col("c")) & (placed["digest"] == F.col("d")), "left").withColumn("marked", fault)
    lived = F.when(~F.col("gone"), F.struct("local", "turn", F.char(F.lit(ord("A")) + kinds).alias("symbol")))
    turns = F.expr("filter(transform(found, x -> x.turn), x -> x IS NOT NULL)")
    return (
        marked.groupBy("conv_id").agg(F.sort_array(F.collect_list(lived)).alias("found"))
        .select(
            "conv_id",
            F.array_join(F.transform("found", lambda x: x["symbol"]), "").alias("symbols"),
            F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0)).cast("long").alias("gaps"),
        )
    )


def _edit(grammar: Grammar):
    """What a conversation's symbols tell: counts of faults, cost, edits."""

    def told(symbols: str) -> tuple:
        parts = [parts_of(c) for c in symbols]
        n = Counter(fault for _, fault in parts)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:], strict=False))
        return n["b"], n["d"], n["t"], illegal, *grammar.repair(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = functools.lru_cache(maxsize=4096)(told)
        for batch in batches:
            rows = [remembered(s) for s in batch.column("symbols").to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("gaps"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"],
            )

    return run


class Repaired:
    """The lines of a repaired conversation, hashed as its rows pass by."""

    def __init__(self, audit: str):
        self.edits, self.at, self.due, self.hash, self.lines = audit, 0, "u", hashlib.sha256(), 0

    def _write(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _insert(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self._turn(None, "")
            self.at += 1

    def _turn(self, role: str | None, text: str) -> None:
        if role is not None and role[:1] == "s":
            self._write(role, text)
            return
        self._write(role or {"u": "user", "a": "assistant"}[self.due], text)
        self.due = "a" if self.due == "u" else "u"

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.edits[self.at]
        self.at += 1
        if edit != "D":
            self._turn(role if edit == "K" else None, text)

    def digest(self) -> str:
        self._insert()
        return self.hash.hexdigest()


_TOLD = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation: its counts and edits first, then its turns in order."""
    told, lines = None, None
    for batch in batches:
        done = []
        counts = batch.select([*_TOLD]).to_pylist()
        for i, (role, text) in enumerate(zip(batch.column("role"), batch.column("text"), strict=True)):
            if counts[i]["audit"] is not None:
                if told is not None:
                    done.append(told | {"repaired_sha256": lines.digest()})
                told, lines = counts[i], Repaired(counts[i]["audit"])
            else:
                lines.row(role.as_py(), text.as_py())
        if done:
            yield pa.RecordBatch.from_pylist(done, _RESULT)
    if told is not None:
        yield pa.RecordBatch.from_pylist([told | {"repaired_sha256": lines.digest()}], _RESULT)


_RESULT = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in (*_TOLD, "repaired_sha256")])


def repair(conversations: DataFrame, every: int = 20) -> DataFrame:
    """One row for each ``conv_id``: its faults, the cost and the edits of its repair, and the digest of what is repaired."""
    spark = conversations.sparkSession
    scan = scan_of(conversations)
    rows = damage(scan.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", *row_key(scan)), every)
    first = F.substring("role", 1, 1)
    mark = _last_mark("text")
    with steps(spark):
        keys = materialize(
            rows.select(
                "conv_id", "turn", digest().alias("digest"), "file", "at", "copy", "gone", F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("kind"),
                F.when(mark == "", "b").when(~mark.isin(".", "!", "?"), "t").otherwise("-").alias("fault"),
            ),
            "keys",
        )
        sequences = materialize(symbols_of(keys), "sequences")
        strings = materialize(sequences.filter("length(symbols) > 1").select("symbols").distinct(), "strings")
        edits = sequences.mapInArrow(_edit(learn(strings)), "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
        turns = rows.filter("NOT gone").select("conv_id", *[F.lit(None).cast("long" if c != "audit" else "string").alias(c) for c in _TOLD[1:]], "turn", digest().alias("digest"), "role", "text")
        heads = edits.select(*_TOLD, F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
        together = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "digest")
        return materialize(together.mapInArrow(_hash_lines, ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'long'}" for f in _RESULT)), "repaired", lasting=True)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}

#: The same edits by a recursion over rows: the best list to each state after each row. Checksums as in the SQL of operator 3.
ORACLES = {
    "op12_conversation_repair": r"""
        WITH RECURSIVE steps AS (
          SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b:
                 CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS crc_table),
        b AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 xor(list_reduce(list_transform(regexp_extract_all(hex(encode(
                     coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda x: CAST(('0x' || x) AS BIGINT)),
                     lambda c, x: xor(c >> 8, crc_table[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) % 20 AS k
          FROM conversations, steps),
        d AS (
          SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
                 CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
          FROM b WHERE k <> 0),
        g AS (SELECT *, substr(sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), 1, 32) AS digest, left(role, 1) AS first,
                     regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS mark FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest, copy) AS k,
                     row_number() OVER (PARTITION BY conv_id, digest ORDER BY turn NULLS FIRST, copy) > 1 AS seen FROM g),
        f AS (SELECT *, CASE WHEN mark = '' THEN 'b' WHEN seen THEN 'd' WHEN mark NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
                     lag(first) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM r),
        c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                     count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                     count(*) FILTER (k > 1 AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        nx(p, role, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
        ins(p, q, cost, edits, lines) AS (
          VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
                 (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (3, 2, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'assistant:'),
                 (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
        act AS (
          SELECT conv_id, k, p, q, cost, edit, line FROM (
            SELECT f.conv_id, f.k, s.p, s.p AS q, 4 AS cost, 'D' AS edit, '' AS line FROM f, (SELECT unnest(range(4)) AS p) s
            UNION ALL SELECT f.conv_id, f.k, p, q, CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K', chr(10) || f.role || ':' || text
            FROM f JOIN nx ON nx.role = f.first WHERE fault IN ('-', 't')
            UNION ALL SELECT f.conv_id, f.k, p, q, CASE fault WHEN 't' THEN 6 ELSE 3 END, 'R', chr(10) || CASE nx.role WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text
            FROM f, nx WHERE fault IN ('-', 't') AND nx.role IN ('u', 'a'))),
        walk AS (
          SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS edits, '' AS lines FROM c
          UNION ALL
          SELECT w.conv_id, w.k + 1, a.q, CAST(min(w.cost + i.cost + a.cost) AS BIGINT),
                 arg_min(w.edits || i.edits || a.edit, (w.cost + i.cost + a.cost, w.edits || i.edits || a.edit)),
                 arg_min(w.lines || i.lines || a.line, (w.cost + i.cost + a.cost, w.edits || i.edits || a.edit))
          FROM walk w JOIN ins i ON i.p = w.q JOIN act a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.k = w.k + 1 AND a.p = i.q
          GROUP BY w.conv_id, w.k, a.q),
        ends AS (
          SELECT w.conv_id, CAST(min(w.cost + i.cost) AS BIGINT) AS cost, arg_min(w.edits || i.edits, (w.cost + i.cost, w.edits || i.edits)) AS audit,
                 arg_min(w.lines || i.lines, (w.cost + i.cost, w.edits || i.edits)) AS lines
          FROM walk w JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.k JOIN ins i ON i.p = w.q WHERE i.q IN (0, 3) GROUP BY w.conv_id)
        SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
               CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(e.cost, 0) AS cost,
               coalesce(audit, '') AS audit, sha256(coalesce(substr(lines, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
             LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""
}
