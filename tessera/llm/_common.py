"""Shared pieces of the llm operators: table access, the shared workspace, text patterns."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts count it; everything else is a word character.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_RUN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and Spark runs on this machine alone (tests,
    notebooks) a temporary folder is made and kept for the application.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


#: Rows, and bytes, that go to Python at a time in the steps that are run here: texts can be long, and memory is shared with the JVM.
ROWS_PER_BATCH, BYTES_PER_BATCH = 2_000, 4_000_000


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH, size: int = BYTES_PER_BATCH) -> Iterator[None]:
    """Smaller Arrow batches while a step runs; the session's own settings come back afterwards."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in names}
    for name, most in names.items():
        now = before[name].removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


_steps: contextvars.ContextVar[str] = contextvars.ContextVar("steps", default="")


def materialize(df: DataFrame, label: str = "step", lasting: bool = False) -> DataFrame:
    """Write ``df`` once to the shared workspace and read it back.

    Cuts lineage: what follows survives the loss of any executor without recomputing the text
    scan, and values such as row numbers stay what they were when they were written. What is ``lasting`` outlives
    the ``steps`` it is written in.
    """
    spark = df.sparkSession
    inside = _steps.get()
    path = f"{workspace(spark)}{inside.rpartition('/')[0] if lasting else inside}/{label}-{uuid.uuid4().hex}"
    with arrow_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at the end, unless they are lasting."""
    outer = _steps.get()
    mark = _steps.set(f"{outer}/steps-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        delete(spark, workspace(spark) + _steps.get())
        _steps.reset(mark)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(written: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, when nothing reads it any more."""
    if files := written.inputFiles():
        delete(written.sparkSession, files[0].rpartition("/")[0])


def clear_workspace(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once their results have been written."""
    delete(spark, workspace(spark))


def scan_of(docs: DataFrame) -> DataFrame:
    """``docs`` as a scan of files, whose rows can be named by where they stand: itself where it is one, else written first."""
    if docs._jdf.queryExecution().analyzed().nodeName().startswith("LogicalRelation"):
        with contextlib.suppress(AnalysisException):
            docs.select(*row_key(docs))
            return docs
    return materialize(docs, "docs", lasting=True)


def row_key(scan: DataFrame) -> list[Column]:
    """``file, at``: the hash of a row's file, and its place there. The same whenever and wherever the files are read.

    Two of a million files have one hash with probability 3e-8.
    """
    where = scan.metadataColumn("_metadata")
    return [F.xxhash64(where["file_path"]).alias("file"), where["row_index"].alias("at")]


def whole_rows(scan: DataFrame, *more: Column) -> DataFrame:
    """``doc`` (all columns of a row, whatever their names), ``file, at`` and ``more``."""
    return scan.select(F.struct(*[F.col(f"`{c}`") for c in scan.columns]).alias("doc"), *row_key(scan), *more)


def without(scan: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``scan`` whose keys aren't in ``gone`` (``file, at``), a written table: so its size is known, and texts are
    shuffled only where it is too large to be broadcast."""
    return whole_rows(scan).join(gone, ["file", "at"], "left_anti").select("doc.*")


def in_order(rows: DataFrame, total: int, *order: Column | str, rows_per_part: int = 1_000_000) -> DataFrame:
    """Written ``rows`` in ``order``, which leaves no ties, with ``part`` and ``local``: rows of earlier parts come first, then those with
    smaller ``local``. Parts are ranges of about equal numbers of rows, whatever values repeat before the last column of the order."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_per_part))
    placed = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("local", F.monotonically_increasing_id()), "ordered")
    return placed.withColumn("part", F.shiftright("local", 33))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD_RUN), F.lit(0))).cast("long")


def seeded_order(seed: int, key: Column) -> Column:
    """Hex string that orders rows at random, but alike on every run and in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def unit_of(hex_order: Column) -> Column:
    """The first 32 bits of ``seeded_order`` as a number in [0, 1)."""
    return F.conv(F.substring(hex_order, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
