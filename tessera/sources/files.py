"""Files of a table's rows: written by executors into a folder that all share, one file a row."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_files(rows: DataFrame, folder: str) -> int:
    """Write ``name, content`` of each row as a file of ``folder`` (a URI of any store that Arrow knows), and return how many there are.

    A file is written under another name and moved, so a lost executor leaves no half file, and writing it again changes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                part = f"{root}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    counted = rows.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long")
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A picture of 8 bits a channel, grey or R, G, B, without loss."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    step = width * channels
    lines = b"".join(b"\0" + data[y * step : (y + 1) * step] for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def as_png(rasters: DataFrame, name: Column) -> DataFrame:
    """``name, content`` of rasters (``height, width, channels, data``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("height", "width", "channels", "data")], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array([png(*r) for r in rows], pa.binary())], ["name", "content"])

    return rasters.select(name.alias("name"), "height", "width", "channels", "data").mapInArrow(run, "name string, content binary")


def masks_of_runs(runs: DataFrame, tiles: DataFrame, width: int, height: int, *keys: str) -> DataFrame:
    """Rasters of one channel (``keys, height, width, channels, data``) of runs, for all of ``tiles``; built row by row of hex digits, without a row for each pixel."""
    row = runs.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "label"))).alias("found"))
    digits = lambda n, label: F.repeat(F.lpad(F.hex(label.cast("long")), 2, "0"), n.cast("int"))
    line = F.aggregate("found", F.struct(F.lit(0).alias("at"), F.lit("").alias("s")), lambda acc, r: F.struct(
        r["x1"].cast("int").alias("at"), F.concat(acc["s"], F.repeat(F.lit("00"), r["x0"] - acc["at"]), digits(r["x1"] - r["x0"], r["label"])).alias("s")))
    lines = row.select(*keys, "y", line.alias("l")).select(*keys, "y", F.rpad("l.s", 2 * width, "0").alias("s"))
    whole = lines.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("y").cast("int"), "s"))).alias("m"))
    blank = F.lit("00" * width)
    return tiles.select(*keys).distinct().join(whole, list(keys), "left").select(
        *keys, F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(1).alias("channels"),
        F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.coalesce(F.try_element_at("m", y), blank)), "")).alias("data"))
