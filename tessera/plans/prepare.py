"""From labels to training data: the stages of a preparation, and augmentation of rasters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.labels import label_key
from tessera.operators.balance import balance_plan, balanced_sample
from tessera.operators.lineage import shared_folder
from tessera.operators.raster import rasterize, slice_tiles
from tessera.operators.split import param_grid, pick, sample_with_replacement, split_random, split_stratified
from tessera.operators.stats import channel_stats, count_by_class, pixel_counts, weights_of_counts
from tessera.plans.stages import Plan, Stage

TILE = ["dis_id", "tile_id"]


def _buildings(polygons: DataFrame) -> DataFrame:
    return polygons.select(*TILE, "obj", label_key(F.col("label")).alias("label"))


def _splits(t: dict[str, DataFrame], p: dict) -> DataFrame:
    """Every tile once, split by strata; or a balanced sample, whose repeated tiles are copies, split at random."""
    if p["strategy"] == "stratified":
        return split_stratified(t["counts"], p["props"], p["seed"]).select("split", *TILE, F.lit(0).alias("draw"))
    chosen = balanced_sample(t["counts"], p["total"], p["beta"], p["seed"]).select(*TILE, "draw")
    return split_random(chosen, p["props"], *TILE, "draw", seed=p["seed"]).select("split", *TILE, "draw")


def _clones(t: dict[str, DataFrame], p: dict) -> DataFrame:
    train = t["splits"].filter("split = 'train'").select(*TILE).distinct()
    return balance_plan(_buildings(t["polygons"]).join(train, TILE, "left_semi"), p["seed"], tiles=train)


def _augmented(t: dict[str, DataFrame], p: dict) -> DataFrame:
    """Copies of train tiles, each with parameters of its own."""
    train = t["splits"].filter("split = 'train'").select(*TILE).distinct()
    drawn = sample_with_replacement(train, p["n"], *TILE, seed=p["seed"]).select(*TILE, "copy")
    return augmentation_params(drawn, *TILE, "copy", seed=p["seed"]).withColumn("aug_id", F.concat(F.col("copy"), F.lit("a"), F.col("tile_id")))


def _manifest(t: dict[str, DataFrame], p: dict) -> DataFrame:
    """Every patch of every tile of a split, with its pixels of buildings."""
    ids = [str(i).zfill(3) for i in range(p["n"] * p["n"])]
    built = t["patches"].groupBy(*TILE, "patch_id").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("pixels"))
    spine = t["splits"].select("split", *TILE, "draw", F.explode(F.array(*map(F.lit, ids))).alias("patch_id"))
    return spine.join(built, [*TILE, "patch_id"], "left").fillna(0, ["pixels"])


def _weights(t: dict[str, DataFrame], p: dict) -> DataFrame:
    """Pixels of all tiles of all splits, copies as often as they are drawn; background from the tile's area."""
    counted = pixel_counts(t["masks"], p["width"] * p["height"], keys=TILE, tiles=t["splits"])
    return weights_of_counts(counted.join(t["splits"].select(*TILE), TILE))


def _configs(t: dict[str, DataFrame], p: dict) -> DataFrame:
    """The grid of parameters, each with the weights of both heads."""
    grid = param_grid(t["weights"].sparkSession, p["grid"], p["defaults"])
    of = lambda head, n: F.array(*[F.max(F.when((F.col("head") == head) & (F.col("class") == c), F.col("weight"))) for c in range(n)])
    return grid.crossJoin(t["weights"].agg(of("dmg", 5).alias("weights_dmg"), of("seg", 2).alias("weights_seg")))  # one row


def preparation_stages(params: dict) -> list[Stage]:
    """``params`` holds ``width, height, n`` (patches a side), ``props``, ``strategy`` (``stratified``, or ``sample`` with ``total`` and ``beta``), ``augment`` (copies),
    ``grid, defaults, seed``. Each stage is keyed by those it reads."""
    of = lambda *names: {k: params[k] for k in names}
    size = of("width", "height")
    chosen = of("strategy", "props", "seed") | (of("total", "beta") if params["strategy"] == "sample" else {})
    return [
        Stage("counts", ("polygons", "tiles"), lambda t, p: count_by_class(_buildings(t["polygons"]), t["tiles"])),
        Stage("masks", ("polygons",), lambda t, p: rasterize(t["polygons"], keys=TILE, **p), size),
        Stage("splits", ("counts",), _splits, chosen),
        Stage("clones", ("splits", "polygons"), _clones, of("seed")),
        Stage("augmented", ("splits",), _augmented, {"n": params["augment"], "seed": params["seed"]}),
        Stage("statistics", ("channels",), lambda t, p: channel_stats(t["channels"])),
        Stage("patches", ("masks",), lambda t, p: slice_tiles(t["masks"], p["n"], p["width"], p["height"], TILE), size | of("n")),
        Stage("manifest", ("splits", "patches"), _manifest, of("n")),
        Stage("weights", ("splits", "masks"), _weights, size),
        Stage("configs", ("weights",), _configs, of("grid", "defaults")),
    ]


def preparation(tiles: DataFrame, polygons: DataFrame, channels: DataFrame, params: dict, folder: str | None = None) -> Plan:
    """The plan of a whole preparation over ``tiles`` (``dis_id, tile_id``), ``polygons`` (``dis_id, tile_id, obj, label, rings``) and ``channels`` (``tile_id, phase, channel, v``)."""
    spark = tiles.sparkSession
    return Plan(spark, folder or f"{shared_folder(spark)}/preparation", {"tiles": tiles, "polygons": polygons, "channels": channels}, preparation_stages(params))


def _unit(seed: int, name: str, *keys: str) -> Column:
    return pick(seed, F.lit(1_000_001), F.lit(name), *keys).cast("double") / 1_000_000


def augmentation_params(tiles: DataFrame, *keys: str, seed: int = 0) -> DataFrame:
    """Parameters of each tile's augmentation as columns, by hash: the same for all of its images and masks."""
    u = lambda name: _unit(seed, name, *keys)
    return tiles.select(
        *keys, F.floor(u("pad") * 51).cast("int").alias("pad"), (u("angle") * 50 - 25).alias("angle"), (u("shift_x") * 0.1 - 0.05).alias("shift_x"),
        (u("shift_y") * 0.1 - 0.05).alias("shift_y"), (u("scale") * 0.3 + 0.9).alias("scale"), (u("flip_x") < 0.5).alias("flip_x"), (u("flip_y") < 0.5).alias("flip_y"),
        (u("hue") * 0.8 - 0.4).alias("hue"), (u("saturation") * 0.8 + 0.6).alias("saturation"), (u("contrast") * 0.5 + 0.75).alias("contrast"),
        (u("brightness") * 0.5 + 0.75).alias("brightness"))


def _source_grid(row, height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pixel of the result, the pixel it comes from; and whether there is one."""
    y, x = np.mgrid[0:height, 0:width].astype(float)
    cy, cx = (height - 1) / 2, (width - 1) / 2
    y, x = (height - 1 - y if row.flip_y else y), (width - 1 - x if row.flip_x else x)
    y, x = y - cy - row.shift_y * height, x - cx - row.shift_x * width
    t = np.deg2rad(row.angle)
    y, x = (np.cos(t) * y - np.sin(t) * x) / row.scale, (np.sin(t) * y + np.cos(t) * x) / row.scale
    grow = 1 + 2 * row.pad / np.array([height, width])
    sy, sx = np.rint(y * grow[0] + cy).astype(int), np.rint(x * grow[1] + cx).astype(int)
    inside = (sy >= 0) & (sy < height) & (sx >= 0) & (sx < width)
    return np.clip(sy, 0, height - 1), np.clip(sx, 0, width - 1), inside


def augment_geometry(rasters: DataFrame, params: DataFrame, *keys: str) -> DataFrame:
    """Rasters (``keys, kind, height, width, channels, data``) moved by their tile's parameters; nearest pixel, so masks keep their labels."""
    joined, columns = rasters.join(params.hint("merge"), list(keys)), list(rasters.columns)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            data = []
            for row in part.itertuples(index=False):
                pixels = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                sy, sx, inside = _source_grid(row, row.height, row.width)
                data.append((pixels[sy, sx] * inside[:, :, None].astype(np.uint8)).tobytes())
            yield part[columns].assign(data=data)

    return joined.mapInPandas(run, rasters.schema)


def augment_color(rasters: DataFrame, params: DataFrame, *keys: str) -> DataFrame:
    """Brightness, contrast and saturation of images by their tile's parameters; masks pass unchanged."""
    joined, columns = rasters.join(params.hint("merge"), list(keys)), list(rasters.columns)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            data = []
            for row in part.itertuples(index=False):
                if row.channels < 3:
                    data.append(row.data)
                    continue
                v = np.frombuffer(row.data, np.uint8).reshape(-1, row.channels).astype(float)
                v = v * row.brightness
                v = (v - v.mean()) * row.contrast + v.mean()
                grey = v[:, :3].mean(axis=1, keepdims=True)
                v[:, :3] = _turned(grey + (v[:, :3] - grey) * row.saturation, row.hue)
                data.append(np.clip(np.rint(v), 0, 255).astype(np.uint8).tobytes())
            yield part[columns].assign(data=data)

    return joined.mapInPandas(run, rasters.schema)


def _turned(colours: np.ndarray, hue: float) -> np.ndarray:
    """Colours turned about the grey axis by ``hue`` of a full turn."""
    t, k = 2 * np.pi * hue, np.full(3, 3**-0.5)
    across = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    turn = np.cos(t) * np.eye(3) + np.sin(t) * across + (1 - np.cos(t)) * np.outer(k, k)
    return colours @ turn.T
