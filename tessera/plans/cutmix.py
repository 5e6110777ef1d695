"""Cut and paste: buildings of one raster put over buildings of another, alike in images and masks.

Cut-outs are a table of their own: a donor's pixels under its polygon, cropped to the polygon's box, for each kind of raster. A donor raster is read once, however
often it gives; what is joined to hosts is small pieces. Pastes have an order, and are cut off at the raster's edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import orientation_vector, rotation_angle, scale_to_box
from tessera.operators.raster import scanlines

PIECE = "donor string, kind string, height int, width int, channels int, piece binary"


def placements(pairs: DataFrame) -> DataFrame:
    """Where and how each donor goes: ``raster_id, seq, donor, x, y, width, height, angle``.

    ``pairs`` has ``raster_id, seq, donor, donor_ring, host_ring``. A donor is scaled to the box of the building that it covers and turned from its own
    direction into that one's, to a thousandth of a degree, so that what needs no turn gets none; the box starts at the whole part of its corner.
    """
    box = lambda ring, f: F.struct(*[
        f(end(F.transform(ring, lambda v: v[axis]))).cast("int").alias(name)
        for name, axis, end in (("x1", "x", F.array_min), ("y1", "y", F.array_min), ("x2", "x", F.array_max), ("y2", "y", F.array_max))])
    d, h = F.col("donor_ring"), F.col("host_ring")
    size = scale_to_box(box(d, F.bround), box(h, F.bround))
    turn = rotation_angle(orientation_vector(d, box(d, F.bround)), orientation_vector(h, box(h, F.bround)))
    return pairs.withColumns({"_s": size, "_b": box(h, lambda c: c), "angle": F.round(F.coalesce(turn, F.lit(0.0)), 3)}).select(
        "raster_id", "seq", F.col("donor").cast("string").alias("donor"), F.col("_b.x1").alias("x"), F.col("_b.y1").alias("y"), "_s.width", "_s.height", "angle")


def cut_outs(donors: DataFrame, polygons: DataFrame) -> DataFrame:
    """``donor, kind, height, width, channels, piece``: what each raster shows under each polygon, 0 around it.

    ``donors`` are rasters (``raster_id, kind, height, width, channels, data``); ``polygons`` has ``raster_id, donor, rings``. A pixel is under a polygon if its centre is, as when
    masks are drawn. Polygons of a raster travel as runs in one row, so each raster meets them once; where they are few the planner sends them to the rasters.
    """
    kinds = donors.select("raster_id", "kind", "height", "width", "channels", "data")
    lines = scanlines(polygons.select("raster_id", F.col("donor").cast("string").alias("obj"), F.lit(1).alias("label"), "rings"), keys=("raster_id",), width=1 << 30, height=1 << 30)
    shapes = lines.groupBy("raster_id", "obj").agg(F.collect_list(F.array("y", "x0", "x1")).alias("runs")).groupBy("raster_id").agg(
        F.collect_list(F.struct("obj", "runs")).alias("shapes"))

    return kinds.join(shapes.hint("merge"), "raster_id").select("kind", "height", "width", "channels", "data", "shapes").mapInArrow(_cut, PIECE)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"donor": pa.string(), "kind": pa.string(), "height": pa.int32(), "width": pa.int32(), "channels": pa.int32(), "piece": pa.binary()}

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    for batch in batches:
        out, held = [], 0
        sizes = zip(*[batch.column(c).to_pylist() for c in ("kind", "height", "width", "channels")], strict=True)
        for i, (kind, height, width, channels) in enumerate(sizes):
            pixels = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8).reshape(height, width, channels)
            for shape in batch.column("shapes")[i].as_py():
                runs = np.array([r for r in shape["runs"] if r[0] < height and r[1] < width], np.int64).reshape(-1, 3)
                if not len(runs):
                    continue
                y1, x1 = runs[:, 0].min(), runs[:, 1].min()
                y2, x2 = runs[:, 0].max() + 1, min(runs[:, 2].max(), width)
                piece = np.zeros((y2 - y1, x2 - x1, channels), np.uint8)
                for y, a, b in runs.tolist():
                    piece[y - y1, a - x1 : b - x1] = pixels[y, a : min(b, width)]
                out.append((shape["obj"], kind, *piece.shape, piece.tobytes()))
                held += piece.nbytes
            if held > 4_000_000:
                yield rows(out)
                out, held = [], 0
        if out:
            yield rows(out)


_PASTE = "x int, y int, width int, height int, angle double, ph int, pw int, pc int, piece binary"


def composite(hosts: DataFrame, placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """``hosts`` (rasters of any kinds, with whatever other columns) with the pieces of their kind at their places, in the order of ``seq``.

    Pieces are joined to places by donor, without hosts. Then a host and its pieces stream past, the host first: a task holds one raster at a time.
    """
    pastes = placed.join(pieces.withColumnsRenamed({"height": "ph", "width": "pw", "channels": "pc"}).hint("merge"), "donor")
    first = hosts.select("raster_id", "kind", F.lit(None).cast("long").alias("seq"), F.struct(*[F.col(f"`{c}`") for c in hosts.columns]).alias("host"), F.lit(None).cast(f"struct<{_PASTE}>").alias("paste"))
    then = pastes.select("raster_id", "kind", F.col("seq").cast("long").alias("seq"), F.lit(None).cast(first.schema["host"].dataType).alias("host"), F.struct(*[c.split()[0] for c in _PASTE.split(", ")]).alias("paste"))
    together = first.unionByName(then).repartition("raster_id", "kind").sortWithinPartitions("raster_id", "kind", "seq")
    return together.select("raster_id", "kind", "host", "paste").mapInArrow(_paste_all, hosts.schema)


def _paste_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    host, key, pixels = None, None, None  # a host as a batch of one row, and its pixels once something is pasted

    def done() -> pa.RecordBatch:
        if pixels is None:
            return host
        at = host.schema.get_field_index("data")
        return host.set_column(at, host.schema.field(at), pa.array([pixels.tobytes()], host.schema.field(at).type))

    for batch in batches:
        out = []
        rows = pa.RecordBatch.from_struct_array(batch.column("host"))
        given = batch.column("host").is_valid().to_pylist()
        keys = list(zip(batch.column("raster_id").to_pylist(), batch.column("kind").to_pylist(), strict=True))
        for i, is_host in enumerate(given):
            if is_host:
                if host is not None:
                    out.append(done())
                host, key, pixels = rows.slice(i, 1), keys[i], None
            elif key == keys[i]:  # a piece whose host isn't there goes nowhere
                if pixels is None:
                    h, w, c = (host.column(n)[0].as_py() for n in ("height", "width", "channels"))
                    pixels = np.frombuffer(host.column("data")[0].as_py(), np.uint8).reshape(h, w, c).copy()
                p = batch.column("paste")[i].as_py()
                paste(pixels, np.frombuffer(p["piece"], np.uint8).reshape(p["ph"], p["pw"], p["pc"]), p["x"], p["y"], p["width"], p["height"], p["angle"])
        yield from out
    if host is not None:
        yield done()


def paste(out: np.ndarray, piece: np.ndarray, x: int, y: int, width: int, height: int, angle: float) -> None:
    """Scale ``piece`` to ``width`` x ``height``, turn it by ``angle`` (degrees, from x to y) within that box, and put it on ``out`` where any channel is above 0.

    Nearest pixels, so masks keep their labels. What hangs over an edge is cut off.
    """
    y0, y1, x0, x1 = max(y, 0), min(y + height, out.shape[0]), max(x, 0), min(x + width, out.shape[1])
    if y0 >= y1 or x0 >= x1:
        return
    v, u = np.mgrid[y0 - y : y1 - y, x0 - x : x1 - x].astype(float)
    v, u, t = v - (height - 1) / 2, u - (width - 1) / 2, np.deg2rad(angle)
    c, s = np.cos(t), np.sin(t)
    # The scaled piece's pixel: a hair is added, so that quarter turns don't fall between two by the rounding of a sine.
    sy, sx = np.floor(c * v - s * u + height / 2 + 1e-9).astype(int), np.floor(s * v + c * u + width / 2 + 1e-9).astype(int)
    inside = (sy >= 0) & (sy < height) & (sx >= 0) & (sx < width)
    py = np.clip((2 * sy + 1) * piece.shape[0] // (2 * height), 0, piece.shape[0] - 1)
    px = np.clip((2 * sx + 1) * piece.shape[1] // (2 * width), 0, piece.shape[1] - 1)
    turned = piece[py, px]
    shows = inside & (turned > 0).any(axis=2)
    out[y0:y1, x0:x1][shows] = turned[shows]
