"""Row keys, tables that go, and orders without hot parts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from tessera.llm import _common as C
from tessera.llm import exact_dedup, language_id, mixing, near_dedup


def test_keys_name_rows_whenever_they_are_read(spark, edge_docs, tmp_path):
    edge_docs.repartition(4).write.parquet(str(tmp_path / "docs"))
    scan = spark.read.parquet(str(tmp_path / "docs"))
    assert C.scan_of(scan) is scan
    seen = []
    for size in ("128m", "1"):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        seen.append(_keys(spark.read.parquet(str(tmp_path / "docs"))))
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] and len(seen[0]) == edge_docs.count()


def _keys(scan) -> dict:
    return {(r.file, r.at): r.text for r in scan.select("text", *C.row_key(scan)).collect()}


def test_what_is_no_scan_is_written_first(spark, edge_docs, tmp_path):
    edge_docs.write.parquet(str(tmp_path / "docs"))
    twice = spark.read.parquet(str(tmp_path / "docs")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    for docs in (edge_docs, twice, twice.filter("copy = 1")):
        scan = C.scan_of(docs)
        assert scan is not docs and len(_keys(scan)) == docs.count()
    edge_docs.select("doc_id", "text", F.col("source")).write.json(str(tmp_path / "json"))
    lines = spark.read.schema("doc_id long, text string, source string").json(str(tmp_path / "json"))
    assert len(_keys(C.scan_of(lines))) == edge_docs.count()


def test_steps_leave_only_what_is_read_later(spark, edge_docs):
    docs = C.materialize(edge_docs, "input")
    folder = Path(C.workspace(spark).removeprefix("file://"))
    for stage in (exact_dedup.drop_exact_copies, near_dedup.drop_near_copies, mixing.mixed_documents, language_id.keep_identified):
        before = set(folder.iterdir())
        out = stage(docs)
        left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
        assert left <= {"dropped", "last", "und"} and len(left) == 1
        assert out.count() > 0
    C.forget(docs)
    assert not list(folder.glob("input-*"))


def test_orders_have_no_hot_part(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("one").alias("source"), F.lit("h").alias("h"), "id")
    placed = C.in_order(C.materialize(rows), 6000, "source", "h", "doc_id", "id")
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * 6000 / len(sizes)
    many = C.in_order(C.materialize(rows), 6000, "source", "h", "doc_id", "id", rows_per_part=100)
    assert many.select("part").distinct().count() >= 30
