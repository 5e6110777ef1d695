"""Named stages, written once: a rerun starts at the first stage whose parameters or inputs have changed.

A stage is a function of the tables it reads and of its parameters. It is written under a key: the digest of its name, version and parameters, and of
the keys of what it reads. So a table is found again by what it was made from, and a changed parameter changes the keys of exactly those
stages that depend on it. A stage that was cut short has no ``_SUCCESS`` and is made anew.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What a session numbers anew each time it makes the same plan: columns, variables of lambdas, objects.
_NUMBERS = re.compile(r"(_\d+)?#\d+L?|@[0-9a-f]+|(?<=lambda )\w+")


@dataclasses.dataclass(frozen=True)
class Stage:
    """``run(tables, params)``, where ``tables`` holds the results of the stages and inputs named in ``reads``. Another meaning of a stage needs another ``version``."""

    name: str
    reads: tuple[str, ...]
    run: Callable[[dict[str, DataFrame], dict], DataFrame]
    params: dict = dataclasses.field(default_factory=dict)
    version: int = 1


def fingerprint(df: DataFrame) -> str:
    """What a table is made from: its plan, and path, size and time of every file it reads. A table without files is hashed row by row."""
    spark, files = df.sparkSession, df.inputFiles()
    plan = _NUMBERS.sub("", df._jdf.queryExecution().analyzed().toString())
    if not files:
        n, low, high = df.select(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("h")).agg(
            F.count("*"), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned("h", 32))).first()
        return _digest("rows", df.schema.json(), n, low, high)
    stated = []
    for name in sorted(files):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        stated.append((name, status.getLen(), status.getModificationTime()))
    return _digest("files", plan, stated)


def _digest(*what) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:24]


class Plan:
    """Stages over named inputs, written below ``folder``, which the driver and all executors share.

    ``run`` returns all tables; ``made`` names the stages that the last run had to compute.
    """

    def __init__(self, spark: SparkSession, folder: str, inputs: dict[str, DataFrame], stages: list[Stage]):
        self.spark, self.folder, self.inputs, self.stages, self.made = spark, folder.rstrip("/"), inputs, stages, []
        known = set(inputs)
        for stage in stages:
            if missing := set(stage.reads) - known:
                raise ValueError(f"{stage.name} reads {sorted(missing)}, which no earlier stage makes")
            if stage.name in known:
                raise ValueError(f"{stage.name} is made twice")
            known.add(stage.name)

    def keys(self) -> dict[str, str]:
        keys = {name: fingerprint(df) for name, df in self.inputs.items()}
        for stage in self.stages:
            keys[stage.name] = _digest(stage.name, stage.version, stage.params, [keys[r] for r in stage.reads])
        return {stage.name: keys[stage.name] for stage in self.stages}

    def run(self) -> dict[str, DataFrame]:
        tables, keys, self.made = dict(self.inputs), self.keys(), []
        for stage in self.stages:
            path = f"{self.folder}/{stage.name}-{keys[stage.name]}"
            if not self._done(path):
                stage.run({name: tables[name] for name in stage.reads}, stage.params).write.mode("overwrite").parquet(path)
                self.made.append(stage.name)
            tables[stage.name] = self.spark.read.parquet(path)
        return tables

    def _done(self, path: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)
