"""Registered queries over tables whose other columns have names that the operators use themselves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.llm import registry

NAMES = (
    "_id", "_text", "_metadata", "file", "at", "doc", "last", "copies", "print", "digest", "group", "part", "local", "row", "key", "size", "h", "start", "end",
    "kind", "spans", "label", "features", "depth", "node", "parent", "score", "predicted", "held_out", "shard", "slot", "n", "value", "kept", "keep_id", "words",
    "hash", "band", "sig", "keys", "comp", "target", "taken", "w", "ids", "pos", "rank", "lcp", "fault", "audit", "cost", "symbols", "repo", "owner",
)
TURNS = [
    (0, 1, "user", "Hello there."), (0, 2, "assistant", "Hi."), (0, None, "system", "Be kind."), (1, 1, "user", "Hello there."), (1, 2, "assistant", "Hi"), (1, 2, "assistant", "Hi"),
    (2, 1, None, None), (2, 4, "assistant", ""), (5, 1, "user", "Why?"), (6, 1, "assistant", "So."), (6, 2, "user", "é 👍!"), (7, None, None, None),
]


@pytest.fixture(scope="module")
def both(spark, edge_docs, tmp_path_factory):
    """The same odd rows in two folders, without other columns and with them."""
    docs = edge_docs.select("doc_id", "text", "source", "lang", "n_chars")
    tables = {
        "documents": docs,
        "labels": docs.filter("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).distinct(),
        "conversations": spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string"),
    }
    folders = []
    for kind in ("plain", "clashing"):
        folder = str(tmp_path_factory.mktemp(kind))
        for name, df in tables.items():
            more = {n: F.lit(i) for i, n in enumerate(NAMES)} if kind == "clashing" else {}
            df.coalesce(1).withColumns(more).write.parquet(f"{folder}/{name}.parquet")
        folders.append(folder)
    return folders


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 8, 9, 11, 12, 13])
def test_other_columns_never_matter(n, spark, both):
    query = next(q for name, q in registry.queries().items() if name.startswith(f"op{n}_"))
    plain, clashing = (query(spark, folder) for folder in both)
    assert clashing.columns == plain.columns
    rows = sorted(map(str, plain.collect()))
    assert sorted(map(str, clashing.collect())) == rows and rows
