"""Operators 11 and 12: against SQL over the tables, and over odd and random conversations with blocks of a few rows."""

from __future__ import annotations

import itertools
import random

import duckdb
import pyarrow as pa
import pytest

from tessera.llm import prefix_trie, structure_repair
from tessera.llm.ropes import Rope

SCHEMA = "conv_id long, turn long, role string, text string, token string, symbols string, g int, part string, local long"
KINDS = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
ODD = [
    (1, None, "user", "before all. "), (1, 0, None, None), (1, 0, "system", "be brief."), (1, 0, "system", "be brief."), (1, 2, "assistant", ""), (1, 9, "", "?"),
    (None, 1, "user", "lost"), (None, None, None, None), (5, 3, "user", "hello there"), (5, 4, "user", " \t\n"), (5, 4, "agent", "done!"), (6, 1, "Assistant", "é日本👍\u0000."),
    (-7, 1, "user", "x" * 300_000), (7, 1, "user", "Hi."), (8, 1, "user", "Hi."), (8, 2, "assistant", "Hi."), (8, 3, "user", "Hi."),
]


def _random(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    texts = ["a.", "b", "", None, " ", "what?", "long one " * 5] if seed % 2 else ["a."]
    return [
        (c if rnd.random() > 0.03 else None, t if rnd.random() > 0.1 else None, rnd.choice(["user", "assistant", "user", "system", None]), rnd.choice(texts))
        for c in range(-5, rnd.choice([3, 25, 60])) for t in range(rnd.choice([0, 1, 3, 12]) if seed % 3 else 6)
    ]


def _sql(sql: str, rows: list[tuple]) -> list[tuple]:
    con = duckdb.connect()
    con.register("conversations", pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(KINDS)}))
    return con.sql(sql).fetchall(), [d[0] for d in con.sql(sql).description]


def _same(df, sql: str, rows: list[tuple]) -> None:
    theirs, names = _sql(sql, rows)
    ours = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))


def _frame(spark, rows: list[tuple]):
    return spark.createDataFrame([(*r, "x", "y", 1, "z", 2) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["op11_conversation_prefix_trie", "op12_conversation_repair"])
def test_queries(spark, data_dir, same_rows, name):
    from tessera.llm import registry

    same_rows(registry.queries()[name](spark, data_dir), registry.oracle_sql()[name])


@pytest.mark.parametrize(("rows", "block", "piece"), [(ODD, 2, 1), (_random(1), 1, 3), (_random(3), 3, 1000), (_random(4), 5, 2), ([], 4, 4), ([(3, 1, "user", "x")], 4, 4)])
def test_trie_of_odd_conversations(spark, monkeypatch, rows, block, piece):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "TOP", 10**6)
    monkeypatch.setattr(prefix_trie, "SLICE", piece)
    _same(prefix_trie.conversation_trie(_frame(spark, rows)), prefix_trie.ORACLES["op11_conversation_prefix_trie"], rows)


@pytest.mark.parametrize("rows", [ODD, _random(1), _random(3), []])
def test_repair_of_odd_conversations(spark, rows):
    _same(structure_repair.repair(_frame(spark, rows)), structure_repair.ORACLES["op12_conversation_repair"], rows)


def test_extents_are_those_of_a_walk():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 64, 100):
        values = rng.integers(0, 4, n)
        table = prefix_trie.RangeMin(values)
        at, depth = np.repeat(np.arange(n), 5), np.tile(np.arange(5), n)
        right, left = table.right(at, depth), table.left(at, depth)
        for i, d, r, l in zip(at, depth, right, left, strict=True):
            assert r == next((j - 1 for j in range(i + 1, n) if values[j] < d), n - 1)
            assert l == next((j for j in range(i, -1, -1) if values[j] < d), 0)
        lo, hi = np.minimum(at, n - 1), np.minimum(at + depth, n - 1)
        assert table.least(lo, hi).tolist() == [values[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]


def test_ropes_are_strings():
    rnd = random.Random(3)
    strings = ["".join(rnd.choice("DIKR") for _ in range(rnd.choice([0, 1, 5, 40, 70]))) for _ in range(40)]

    def rope(s: str) -> Rope:
        if len(s) < 2:
            return Rope(s)
        cut = rnd.randrange(1, len(s))
        return rope(s[:cut]) + rope(s[cut:])

    for a, b in itertools.product([*strings, strings[-1] + "K"], repeat=2):
        assert (rope(a) < rope(b)) == (a < b)
    assert all(str(rope(s)) == s for s in strings)


def test_rules_change_nothing():
    """A grammar over long conversations gives the edits that single rows give, and no sequence of edits is cheaper."""
    rnd = random.Random(8)
    plain, packed = structure_repair.Grammar(), structure_repair.Grammar()
    words = ["".join(chr(65 + rnd.randrange(16)) for _ in range(rnd.choice([1, 2, 9, 40]))) for _ in range(60)] + ["FI" * 500, "F" * 301]
    for _ in range(30):
        s = rnd.choice([w for w in words if len(packed.compress(w)) > 1])
        packed.add(packed.compress(s)[:2])
    for w in words:
        assert plain.repair(w) == packed.repair(w)

    def cheapest(symbols: str) -> tuple[int, str]:
        best = (10**9, "")
        todo = [(0, 0, 0, "")]
        while todo:
            at, state, cost, edits = todo.pop()
            if cost > best[0] or len(edits) > 2 * len(symbols) + 2:
                continue
            if at == len(symbols) and state in (0, 3):
                best = min(best, (cost, edits))
            todo += [(at, structure_repair.NEXT[c, state], cost + 3, edits + "I") for c in "ua" if (c, state) in structure_repair.NEXT]
            if at < len(symbols):
                kind, fault = structure_repair.parts_of(symbols[at])
                more = 3 if fault == "t" else 0
                todo.append((at + 1, state, cost + 4, edits + "D"))
                if fault in "-t":
                    todo += [
                        (at + 1, structure_repair.NEXT[c, state], cost + n + more, edits + e) for c, n, e in ((kind, 0, "K"), ("u", 3, "R"), ("a", 3, "R")) if (c, state) in structure_repair.NEXT
                    ]
        return best

    for _ in range(150):
        w = "".join(chr(65 + rnd.randrange(16)) for _ in range(rnd.randrange(5)))
        assert plain.repair(w) == cheapest(w), w
