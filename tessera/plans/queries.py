"""Every operator as a query over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import views as V
from tessera.functions import geometry as G
from tessera.functions import labels as L
from tessera.functions import scores as S
from tessera.operators import balance as B
from tessera.operators import metrics as M
from tessera.operators import objects as O
from tessera.operators import raster as R
from tessera.operators import selection as C
from tessera.operators import split as X
from tessera.operators import stats as T
from tessera.operators.lineage import settled, shared_folder
from tessera.operators.ordering import greedy_balance_order, sample_n
from tessera.plans import cutmix as U
from tessera.plans import evaluate as E
from tessera.plans import prepare as P
from tessera.sources import catalog as K
from tessera.sources import files as D
from tessera.sources import labels as J
from tessera.sources import rasters as I
from tessera.sources import tables as W
from tessera.streaming.confusion import confusion_now, read_pixel_stream, upsert_confusion

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that must agree with it."""
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


PX = f"px AS ({V.PIXELS_SQL})"
BLD = f"bld AS ({V.BUILDINGS_SQL})"
SC = f"sc AS ({V.SCORES_SQL})"
EP = f"ep AS ({V.EPOCHS_SQL})"
POLY = f"poly AS ({V.POLYGONS_SQL})"
PRED = f"pred AS ({V.PREDICTED_SQL})"
COUNTS = BLD + ", cnt AS (SELECT dis_id, tile_id, " + ", ".join(
    f"CAST(count(*) FILTER (label = '{k}') AS BIGINT) AS \"{k}\"" for k in L.BUILDING_KEYS) + " FROM bld GROUP BY dis_id, tile_id)"
QUOTED = ", ".join(f'"{k}"' for k in L.BUILDING_KEYS)


def counts(spark: SparkSession, d: str) -> DataFrame:
    return T.count_by_class(V.buildings(spark, d))


# ---------------------------------------------------------------- labels and counts


@query(f"WITH {COUNTS} SELECT dis_id, tile_id, {QUOTED} FROM cnt")
def count_by_class(spark, d):
    return counts(spark, d)


@query(f"""WITH {BLD}, c AS (SELECT coalesce(label, 'no-damage') AS key, CASE coalesce(label, 'no-damage') WHEN 'no-damage' THEN 1 WHEN 'minor-damage' THEN 2
    WHEN 'major-damage' THEN 3 WHEN 'destroyed' THEN 4 ELSE 5 END AS code FROM bld)
    SELECT key, code, CASE code WHEN 1 THEN 'No damage' WHEN 2 THEN 'Minor damage' WHEN 3 THEN 'Major damage' WHEN 4 THEN 'Destroyed' ELSE 'Un-classified' END AS name,
           CASE code WHEN 5 THEN 0 ELSE code END AS mask, count(*) AS n FROM c GROUP BY ALL""")
def label_codes(spark, d):
    rows = V.buildings(spark, d).select(L.subtype_or(F.col("label")).alias("key")).withColumn("code", L.label_code(F.col("key")))
    return rows.groupBy("key", "code").agg(F.count("*").alias("n")).select("key", "code", L.label_name(F.col("code")).alias("name"), L.erase_unclassified(F.col("code")).alias("mask"), "n")


@query(f"""WITH {COUNTS} SELECT dis_id, CASE WHEN "no-damage" + "minor-damage" + "major-damage" + "destroyed" > 0 THEN 'damaged' ELSE 'empty' END AS kind,
    count(*) AS tiles FROM cnt GROUP BY 1, 2""")
def damaged_and_empty(spark, d):
    return counts(spark, d).groupBy("dis_id", T.presence().alias("kind")).agg(F.count("*").alias("tiles"))


@query(f"""WITH {BLD} SELECT dis_id, label, count(*) AS n, CAST(grouping(dis_id, label) AS INT) AS level FROM bld WHERE label IS NOT NULL
    GROUP BY ROLLUP (dis_id, label)""")
def class_totals(spark, d):
    return T.class_totals(V.buildings(spark, d))


@query(f"WITH {BLD} SELECT dis_id, count(DISTINCT tile_id) AS tiles FROM bld GROUP BY ROLLUP (dis_id)")
def tiles_by_disaster(spark, d):
    return T.tiles_by_group(V.buildings(spark, d), "dis_id")


@query(f"""WITH {COUNTS} SELECT dis_id, tile_id, CAST(4 * ("no-damage" * "no-damage" + "minor-damage" * "minor-damage" + "major-damage" * "major-damage" + destroyed * destroyed)
    - ("no-damage" + "minor-damage" + "major-damage" + destroyed) * ("no-damage" + "minor-damage" + "major-damage" + destroyed) AS DOUBLE) / 16 AS imbalance FROM cnt""")
def tile_imbalance(spark, d):
    return T.imbalance(counts(spark, d), list(L.DAMAGE_KEYS)).select("dis_id", "tile_id", "imbalance")


@query(f"""WITH {COUNTS}, s AS (SELECT dis_id, {", ".join(f'CAST(sum("{k}") AS BIGINT) AS "{k}"' for k in L.BUILDING_KEYS)} FROM cnt GROUP BY dis_id)
    SELECT dis_id, {QUOTED}, {" + ".join(f'"{k}"' for k in L.BUILDING_KEYS)} AS total FROM s""")
def disaster_totals(spark, d):
    return T.totals_desc(counts(spark, d), list(L.BUILDING_KEYS))


@query(f"""WITH {COUNTS}, l AS (UNPIVOT cnt ON {QUOTED} INTO NAME name VALUE v), e AS (SELECT name, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM l GROUP BY name)
    SELECT name, CAST(least(CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 20) ELSE 0 END, 19) AS INT) AS bin, count(*) AS n FROM l JOIN e USING (name) GROUP BY 1, 2""")
def tile_histograms(spark, d):
    return T.histogram(counts(spark, d), list(L.BUILDING_KEYS))


@query(f"""WITH {COUNTS}, t AS (SELECT CAST("no-damage" + "minor-damage" AS DOUBLE) AS x, dis_id, tile_id FROM cnt)
    SELECT dis_id, tile_id, round((x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 6) AS scaled FROM t WINDOW w AS (PARTITION BY dis_id)""")
def min_max_scaled(spark, d):
    from pyspark.sql import Window

    x = (F.col("no-damage") + F.col("minor-damage")).cast("double")
    return counts(spark, d).select("dis_id", "tile_id", F.round(T.min_max(x, Window.partitionBy("dis_id")), 6).alias("scaled"))


@query(f"""WITH {BLD}, t AS (SELECT label, count(*) AS n FROM bld WHERE label IN ('no-damage', 'minor-damage', 'major-damage', 'destroyed') GROUP BY label)
    SELECT label, n, CAST(row_number() OVER (ORDER BY n, label) AS INT) AS place FROM t""")
def classes_ascending(spark, d):
    from pyspark.sql import Window

    totals = V.buildings(spark, d).filter(F.col("label").isin(*L.DAMAGE_KEYS)).groupBy("label").agg(F.count("*").alias("n"))
    return totals.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("n", "label")))


# ---------------------------------------------------------------- pixels and metrics

OVR = """SELECT {k}c.class, CAST(sum(CASE WHEN gt = class AND pred = class THEN 1 ELSE 0 END) AS BIGINT) AS true_pos,
    CAST(sum(CASE WHEN gt <> class AND pred = class THEN 1 ELSE 0 END) AS BIGINT) AS false_pos,
    CAST(sum(CASE WHEN gt = class AND pred <> class THEN 1 ELSE 0 END) AS BIGINT) AS false_neg,
    CAST(sum(CASE WHEN gt <> class AND pred <> class THEN 1 ELSE 0 END) AS BIGINT) AS true_neg, count(*) AS total
    FROM px, (SELECT unnest(range(5))::INT AS class) c GROUP BY {k}c.class"""
METRICS = """r AS (SELECT *, CASE WHEN true_pos + false_pos = 0 THEN 0e0 ELSE true_pos / CAST(true_pos + false_pos AS DOUBLE) END AS p,
                 CASE WHEN true_pos + false_neg = 0 THEN 0e0 ELSE true_pos / CAST(true_pos + false_neg AS DOUBLE) END AS r,
                 CASE WHEN total = 0 THEN 0e0 ELSE (true_pos + true_neg) / CAST(total AS DOUBLE) END AS a FROM o),
    f AS (SELECT *, CASE WHEN p + r = 0 THEN 0e0 ELSE 2 * p * r / (p + r) END AS f FROM r)"""


@query(f"WITH {PX} {OVR.format(k='')}")
def confusion_one_vs_rest(spark, d):
    return M.confusion_ovr(V.pixels(spark, d))


@query(f"WITH {PX} {OVR.format(k='tile_id, ')}")
def confusion_by_tile(spark, d):
    return M.confusion_ovr(V.tile_pixels(spark, d), ["tile_id"])


@query(f"""WITH {PX} SELECT gt, {", ".join(f"CAST(count(*) FILTER (pred = {c}) AS BIGINT) AS p{c}" for c in range(5))}, count(*) AS total FROM px GROUP BY ROLLUP (gt)""")
def confusion_multiclass(spark, d):
    return M.confusion_matrix(V.pixels(spark, d))


@query(f"WITH {PX} {OVR.format(k='')}")
def confusion_summed(spark, d):
    return M.sum_confusion(M.confusion_ovr(V.tile_pixels(spark, d), ["tile_id"]))


@query(f"""WITH {PX}, o AS ({OVR.format(k='')}), {METRICS}
    SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(a, 6) AS accuracy,
           round(count(*) OVER () / sum(1 / (f + 1e-10)) OVER (), 6) AS f1_harmonic_mean FROM f""")
def pixel_metrics(spark, d):
    return rounded(M.eval_metrics(M.confusion_ovr(V.pixels(spark, d))), "precision", "recall", "f1", "accuracy", "f1_harmonic_mean")


@query(f"""WITH {PX}, o AS ({OVR.format(k='tile_id, ')}), {METRICS}
    SELECT tile_id, class, round(f, 6) AS f1, round(count(*) OVER w / sum(1 / (f + 1e-10)) OVER w, 6) AS f1_harmonic_mean FROM f WINDOW w AS (PARTITION BY tile_id)""")
def pixel_metrics_by_tile(spark, d):
    found = M.eval_metrics(M.confusion_ovr(V.tile_pixels(spark, d), ["tile_id"]), ["tile_id"])
    return rounded(found.select("tile_id", "class", "f1", "f1_harmonic_mean"), "f1", "f1_harmonic_mean")


@query(f"""WITH {PX}, o AS ({OVR.format(k='')}), {METRICS}, n AS (SELECT max(CASE WHEN class = 0 THEN f END) AS a, max(CASE WHEN class = 1 THEN f END) AS b FROM f)
    SELECT round(CASE WHEN a > 0 AND b > 0 THEN 2 / (1 / a + 1 / b) ELSE 0 END, 6) AS hf1 FROM n""")
def two_class_harmonic_mean(spark, d):
    found = M.eval_metrics(M.confusion_ovr(V.pixels(spark, d)))
    two = found.agg(F.max(F.when(F.col("class") == 0, F.col("f1"))).alias("a"), F.max(F.when(F.col("class") == 1, F.col("f1"))).alias("b"))
    return two.select(F.round(M.harmonic_pair(F.col("a"), F.col("b")), 6).alias("hf1"))


@query(f"""WITH {PX}, c AS (SELECT {", ".join(f"count(*) FILTER (gt = {c}) AS c{c}" for c in range(5))}, count(*) AS t FROM px)
    SELECT 'dmg' AS head, k AS class, round(CASE WHEN n > 0 THEN CAST(t AS DOUBLE) / n ELSE 0 END, 2) AS weight
    FROM (SELECT t, unnest([0, 1, 2, 3, 4]) AS k, unnest([c0, c1, c2, c3, c4]) AS n FROM c)
    UNION ALL SELECT 'seg', k, round(CAST(c0 + c1 + c2 + c3 + c4 AS DOUBLE) / n, 2) FROM (SELECT *, unnest([0, 1]) AS k, unnest([c0, c1 + c2 + c3 + c4]) AS n FROM c)""")
def class_weights(spark, d):
    return T.class_weights(V.pixels(spark, d))


@query(f"""WITH {PX}, c AS (SELECT gt, count(*) AS n FROM px GROUP BY gt), w AS (SELECT CAST(round(CAST((SELECT count(*) FROM px) AS DOUBLE) / n, 0) AS VARCHAR) AS v, gt FROM c)
    SELECT 0 AS conf_id, unnest(['weight_0', 'weight_1', 'weight_2', 'weight_3', 'weight_4']) AS parameter,
           unnest([{", ".join(f"(SELECT v FROM w WHERE gt = {c})" for c in range(5))}]) AS value""")
def weights_as_parameters(spark, d):
    weights = T.class_weights(V.pixels(spark, d), digits=0).filter("head = 'dmg'")
    one = weights.agg(F.lit(0).alias("conf_id"), *[F.max(F.when(F.col("class") == c, F.col("weight"))).alias(f"weight_{c}") for c in range(5)])
    return C.as_parameters(one)


@query(f"""WITH ch AS ({V.CHANNELS_SQL}) SELECT tile_id, phase, channel, round(avg(v / 255e0), 6) AS mean, round(stddev_pop(v / 255e0), 6) AS stdv FROM ch GROUP BY ALL""")
def channel_statistics(spark, d):
    return rounded(T.channel_stats(V.channels(spark, d)), "mean", "stdv")


@query(f"""WITH ch AS ({V.CHANNELS_SQL}), s AS (SELECT tile_id, phase, channel, avg(v / 255e0) AS m, stddev_pop(v / 255e0) AS s, stddev_samp(v / 255e0) AS t FROM ch GROUP BY ALL),
    n AS (SELECT tile_id, phase, channel, (v / 255e0 - m) / CASE WHEN s = 0 THEN 1e-6 ELSE s END AS x, (v / 255e0 - m) / nullif(t, 0) AS y FROM ch JOIN s USING (tile_id, phase, channel))
    SELECT tile_id, phase, channel, count(*) AS n, round(max(x), 5) AS top, round(min(x), 5) AS low, round(max(y), 5) AS top_own FROM n GROUP BY ALL""")
def normalized_channels(spark, d):
    ch = V.channels(spark, d)
    keys = ["tile_id", "phase", "channel"]
    stats = T.channel_stats(ch).join(T.channel_stats(ch, ddof=1).select(*keys, F.col("stdv").alias("own")), keys)
    x = ch.join(stats, keys).select(*keys, S.normalized(F.col("v"), F.col("mean"), F.col("stdv")).alias("x"), S.normalized(F.col("v"), F.col("mean"), F.col("own"), None).alias("y"))
    return x.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.max("x"), 5).alias("top"), F.round(F.min("x"), 5).alias("low"), F.round(F.max("y"), 5).alias("top_own"))


PROBS = """pr AS (SELECT px_id, seg, gt, logits, list_transform(e, lambda x: x / list_sum(e)) AS probs
    FROM (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM sc))"""


@query(f"""WITH {SC}, {PROBS}, g AS (SELECT *, list_transform(logits, lambda x: x * seg) AS gated FROM pr)
    SELECT px_id, round(probs[1], 6) AS p0, round(probs[5], 6) AS p4, CAST(list_position(probs, list_max(probs)) - 1 AS INT) AS pred,
           CAST(list_position(gated, list_max(gated)) - 1 AS INT) AS gated_pred FROM g""")
def score_predictions(spark, d):
    sc = V.scores(spark, d).withColumn("probs", S.softmax(F.col("logits"))).withColumn("gated", S.gate_logits(F.col("logits"), F.col("seg")))
    return sc.select("px_id", F.round(F.col("probs")[0], 6).alias("p0"), F.round(F.col("probs")[4], 6).alias("p4"), S.argmax(F.col("probs")).alias("pred"), S.argmax(F.col("gated")).alias("gated_pred"))


@query(f"""WITH {SC}, {PROBS}, w AS (SELECT gt AS class, (SELECT count(*) FROM sc) / CAST(count(*) AS DOUBLE) AS weight FROM sc GROUP BY gt)
    SELECT round(sum(weight * -ln(probs[gt + 1])) / sum(weight), 6) AS loss FROM pr JOIN w ON gt = class""")
def weighted_cross_entropy(spark, d):
    sc = V.scores(spark, d)
    weights = T.class_weights(sc.select("gt"), digits=None).filter("head = 'dmg'").select("class", "weight")
    return rounded(M.cross_entropy(sc, weights), "loss")


def _curve(spark, d, k=200):
    return M.threshold_confusion(V.scores(spark, d).select("gt", S.softmax(F.col("logits")).alias("probs")), k)


CURVE = f"""{SC}, {PROBS}, cp AS (SELECT gt, unnest([0, 1, 2, 3, 4]) AS class, unnest(probs) AS p FROM pr),
    th AS (SELECT CAST(unnest(range(200)) AS INT) AS step),
    cv AS (SELECT class, step, CAST(step AS DOUBLE) / 199 AS th, count(*) FILTER (gt = class AND p >= CAST(step AS DOUBLE) / 199) AS true_pos,
           count(*) FILTER (gt <> class AND p >= CAST(step AS DOUBLE) / 199) AS false_pos, count(*) FILTER (gt = class AND p < CAST(step AS DOUBLE) / 199) AS false_neg,
           count(*) FILTER (gt <> class AND p < CAST(step AS DOUBLE) / 199) AS true_neg FROM cp, th GROUP BY class, step)"""


@query(f"WITH {CURVE} SELECT class, step, round(th, 6) AS th, true_pos, false_pos, false_neg, true_neg FROM cv")
def threshold_sweep(spark, d):
    return rounded(_curve(spark, d), "th")


@query(f"""WITH {CURVE}, pt AS (SELECT class, step, 1 - coalesce(true_neg / nullif(CAST(true_neg + false_pos AS DOUBLE), 0), 0) AS fpr,
                  coalesce(true_pos / nullif(CAST(true_pos + false_neg AS DOUBLE), 0), 0) AS tpr FROM cv),
    a AS (SELECT class, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS area FROM pt WINDOW w AS (PARTITION BY class ORDER BY fpr, tpr, step DESC))
    SELECT class, round(sum(area), 6) AS auc FROM a GROUP BY class""")
def roc_areas(spark, d):
    return rounded(M.roc_auc(_curve(spark, d)), "auc")


@query(f"""WITH {CURVE}, pt AS (SELECT *, coalesce(true_pos / nullif(CAST(true_pos + false_pos AS DOUBLE), 0), 1) AS p,
                  coalesce(true_pos / nullif(CAST(true_pos + false_neg AS DOUBLE), 0), 0) AS r FROM cv),
    g AS (SELECT *, (r - coalesce(lag(r) OVER (PARTITION BY class ORDER BY step DESC), 0)) * p AS g, (r - lag(r) OVER (PARTITION BY class ORDER BY step)) * p AS h FROM pt)
    SELECT class, round(sum(g), 6) AS ap, round(sum(h), 6) AS ap_ref, round(max(true_pos) / CAST(max(true_pos) + max(true_neg) AS DOUBLE), 6) AS base FROM g GROUP BY class""")
def average_precision(spark, d):
    return rounded(M.pr_curve(_curve(spark, d)), "ap", "ap_ref", "base")


# ---------------------------------------------------------------- epochs, configurations, reports

HF = f"{EP}, hf AS (SELECT conf, fold, epoch, round(avg(val) / 500, 12) AS hf1 FROM ep GROUP BY conf, fold, epoch)"


def _hf(spark, d):
    return V.epochs(spark, d).groupBy("conf", "fold", "epoch").agg(F.round(F.avg("val") / 500, 12).alias("hf1"))


def _seg(spark, d):
    return V.epochs(spark, d).groupBy("conf", "fold", "epoch").agg(F.round(F.max("val") / 500, 12).alias("hf1"))


def _loss(spark, d):
    return M.weighted_average(V.epochs(spark, d), "conf", "fold", "epoch").withColumnRenamed("mean", "loss")


@query(f"WITH {EP} SELECT conf, fold, epoch, round(sum(val * n) / sum(n), 10) AS mean FROM ep GROUP BY ALL")
def weighted_means(spark, d):
    return rounded(M.weighted_average(V.epochs(spark, d), "conf", "fold", "epoch"), "mean", digits=10)


@query(f"""WITH {EP}, s AS (SELECT conf, fold, epoch, sum(val * n) AS s, CAST(sum(n) AS BIGINT) AS w FROM ep GROUP BY ALL)
    SELECT conf, fold, epoch, round(sum(s) OVER o / sum(w) OVER o, 10) AS running, round(s / w, 10) AS own FROM s WINDOW o AS (PARTITION BY conf, fold ORDER BY epoch)""")
def running_losses(spark, d):
    return rounded(M.running_loss(V.epochs(spark, d), ["conf", "fold"]), "running", "own", digits=10)


@query(f"""WITH {HF}, b AS (SELECT *, max(hf1) OVER (PARTITION BY conf, fold ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM hf)
    SELECT conf, fold, epoch, hf1, m IS NULL OR hf1 >= m AS is_best, greatest(hf1, m) AS best FROM b""")
def best_so_far(spark, d):
    return M.best_so_far(_hf(spark, d), ["conf", "fold"], "hf1")


@query(f"WITH {HF} SELECT conf, fold, epoch FROM (SELECT *, row_number() OVER (PARTITION BY conf, fold ORDER BY hf1 DESC, epoch) AS r FROM hf) WHERE r = 1")
def best_epochs(spark, d):
    return C.best_epochs(_hf(spark, d))


FOLDS = f"""{HF}, se AS (SELECT conf, fold, epoch, round(max(val) / 500, 12) AS seg_hf1, sum(val * n) / sum(n) AS loss FROM ep GROUP BY ALL),
    fo AS (SELECT conf, fold, epoch AS best_epoch, hf1 AS dmg_hf1, round(loss, 10) AS val_loss, seg_hf1
           FROM (SELECT *, row_number() OVER (PARTITION BY conf, fold ORDER BY hf1 DESC, epoch) AS r FROM hf) JOIN se USING (conf, fold, epoch) WHERE r = 1)"""


def _folds(spark, d):
    return rounded(C.fold_results(_hf(spark, d), _seg(spark, d), _loss(spark, d)), "val_loss", digits=10)


@query(f"WITH {FOLDS} SELECT * FROM fo")
def fold_results(spark, d):
    return _folds(spark, d)


@query(f"WITH {FOLDS} SELECT conf FROM fo ORDER BY dmg_hf1 DESC, conf, fold LIMIT 1")
def best_config(spark, d):
    return C.best_config(_folds(spark, d))


@query(f"WITH {FOLDS} SELECT conf FROM fo GROUP BY conf ORDER BY avg(dmg_hf1) DESC, conf LIMIT 1")
def best_config_by_mean(spark, d):
    return C.best_config(_folds(spark, d), by="mean")


@query(f"""WITH {EP}, a AS (SELECT epoch, round(avg(val), 10) AS train FROM ep WHERE epoch <> 3 GROUP BY epoch), b AS (SELECT epoch, round(max(val), 10) AS val FROM ep WHERE epoch <> 5 GROUP BY epoch)
    SELECT coalesce(a.epoch, b.epoch) AS epoch, train, val FROM a FULL JOIN b ON a.epoch = b.epoch""")
def aligned_series(spark, d):
    ep = V.epochs(spark, d)
    return C.aligned_series(ep.filter("epoch <> 3").groupBy("epoch").agg(F.round(F.avg("val"), 10).alias("value")), ep.filter("epoch <> 5").groupBy("epoch").agg(F.round(F.max("val"), 10).alias("value")))


@query(f"""WITH {EP}, a AS (SELECT epoch, round(avg(val), 10) AS value, 0 AS r FROM ep WHERE fold < 2 AND epoch <= 8 GROUP BY epoch
    UNION ALL SELECT epoch, round(avg(val), 10), 1 FROM ep WHERE fold >= 2 AND epoch >= 6 GROUP BY epoch)
    SELECT epoch, arg_max(value, r) AS value FROM a GROUP BY epoch""")
def resumed_series(spark, d):
    ep = V.epochs(spark, d)
    run = lambda cond: ep.filter(cond).groupBy("epoch").agg(F.round(F.avg("val"), 10).alias("value"))
    return C.resumed(run("fold < 2 AND epoch <= 8"), run("fold >= 2 AND epoch >= 6"))


EPOCH_PX = f"""px AS (SELECT tile_id % 6 AS epoch, gt, pred FROM ({V.PIXELS_SQL}) v), o AS ({OVR.format(k='epoch, ')}), {METRICS}"""


def _epoch_metrics(spark, d):
    px = V.pixels(spark, d).select((F.col("tile_id") % 6).alias("epoch"), "gt", "pred")
    return rounded(M.eval_metrics(M.confusion_ovr(px, ["epoch"]), ["epoch"]), "precision", "recall", "f1", "accuracy")


@query(f"""WITH {EPOCH_PX} SELECT epoch, {", ".join(f'max(CASE WHEN class = {c} THEN round(f, 6) END) AS "{k}"' for c, k in enumerate(L.KEYS[:5]))} FROM f GROUP BY epoch""")
def metric_curves(spark, d):
    return C.metric_curves(_epoch_metrics(spark, d), "f1")


@query(f"""WITH {EPOCH_PX} SELECT 'pixel' AS level, epoch, class, unnest(['precision', 'recall', 'f1', 'accuracy']) AS metric,
    unnest([round(p, 6), round(r, 6), round(f, 6), round(a, 6)]) AS value FROM f""")
def long_metrics(spark, d):
    return C.long_metrics(_epoch_metrics(spark, d), "pixel", ["epoch"])


@query(f"""WITH {PX}, o AS ({OVR.format(k='')}), {METRICS}, q AS (SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, round(a, 4) AS accuracy FROM f)
    SELECT CASE class WHEN 0 THEN 'background' WHEN 1 THEN 'no-damage' WHEN 2 THEN 'minor-damage' WHEN 3 THEN 'major-damage' ELSE 'destroyed' END AS name,
           precision, recall, f1, accuracy, 'dmg' AS part, 'val' AS split FROM q
    UNION ALL SELECT CASE class WHEN 0 THEN 'background' ELSE 'building' END, precision, recall, f1, accuracy, 'seg', 'val' FROM q WHERE class < 2""")
def report_table(spark, d):
    found = M.eval_metrics(M.confusion_ovr(V.pixels(spark, d)))
    return C.report_table(found, found, "val")


# ---------------------------------------------------------------- splits and samples


def _hash(seed: int, *keys: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(keys)}))"


@query(f"""WITH {COUNTS}, p AS (SELECT dis_id, tile_id, row_number() OVER (ORDER BY {_hash(0, 'dis_id', 'tile_id')}, dis_id, tile_id) - 1 AS pos, (SELECT count(*) FROM cnt) AS n FROM cnt),
    z AS (SELECT *, CAST(round_even(n * 0.8e0, 0) AS BIGINT) AS a FROM p), y AS (SELECT *, CAST(round_even((n - a) * (0.1e0 / (1e0 - 0.8e0)), 0) AS BIGINT) AS b FROM z)
    SELECT dis_id, tile_id, CASE WHEN pos < a THEN 'train' WHEN pos < a + b THEN 'val' ELSE 'test' END AS split FROM y""")
def split_random(spark, d):
    tiles = counts(spark, d).select("dis_id", "tile_id")
    return X.split_random(tiles, {"train": 0.8, "val": 0.1, "test": 0.1}, "dis_id", "tile_id").select("dis_id", "tile_id", "split")


@query(f"""WITH {COUNTS}, s AS (SELECT *, CASE WHEN destroyed > 0 THEN 'destroyed' WHEN "major-damage" > 0 THEN 'major-damage' WHEN "minor-damage" > 0 THEN 'minor-damage' WHEN "no-damage" > 0 THEN 'no-damage' END AS stratum FROM cnt),
    p AS (SELECT dis_id, tile_id, stratum, count(*) OVER w AS n, row_number() OVER (PARTITION BY dis_id, stratum ORDER BY {_hash(0, 'dis_id', 'tile_id')}, tile_id) - 1 AS nth FROM s WINDOW w AS (PARTITION BY dis_id, stratum)),
    z AS (SELECT *, CAST(floor(n * 0.8e0) AS BIGINT) AS a FROM p), y AS (SELECT *, CAST(floor((n - a) * (0.1e0 / (1e0 - 0.8e0))) AS BIGINT) AS b FROM z)
    SELECT dis_id, tile_id, stratum, CASE WHEN stratum IS NULL THEN 'test' WHEN nth < a THEN 'train' WHEN nth < a + b THEN 'val' ELSE 'test' END AS split FROM y""")
def split_stratified(spark, d):
    return X.split_stratified(counts(spark, d), {"train": 0.8, "val": 0.1, "test": 0.1}).select("dis_id", "tile_id", "stratum", "split")


@query(f"""WITH {COUNTS} SELECT dis_id, tile_id, CAST(ntile(5) OVER (ORDER BY {_hash(0, 'dis_id', 'tile_id')}, dis_id, tile_id) - 1 AS INT) AS fold FROM cnt""")
def assign_folds(spark, d):
    return X.assign_folds(counts(spark, d).select("dis_id", "tile_id"), 5, "dis_id", "tile_id")


@query(f"""WITH {COUNTS} SELECT dis_id, tile_id FROM cnt ORDER BY {_hash(0, 'dis_id', 'tile_id')}, dis_id, tile_id LIMIT 100""")
def sample_of_tiles(spark, d):
    return sample_n(counts(spark, d).select("dis_id", "tile_id"), 100, "dis_id", "tile_id")


@query(f"""WITH {COUNTS}, p AS (SELECT dis_id, tile_id, row_number() OVER (ORDER BY {_hash(0, 'dis_id', 'tile_id')}, dis_id, tile_id) - 1 AS pos FROM cnt),
    r AS (SELECT unnest(range(500)) AS draw), q AS (SELECT draw, CAST('0x' || substr({_hash(0, "'draw'", 'draw')}, 1, 8) AS BIGINT) % (SELECT count(*) FROM cnt) AS pos FROM r)
    SELECT dis_id, tile_id, draw, CAST(row_number() OVER (PARTITION BY pos ORDER BY draw) AS INT) AS copy FROM q JOIN p USING (pos)""")
def tiles_with_replacement(spark, d):
    return X.sample_with_replacement(counts(spark, d).select("dis_id", "tile_id"), 500, "dis_id", "tile_id")


@query(f"""WITH {COUNTS}, p AS (SELECT dis_id, tile_id, row_number() OVER (ORDER BY {_hash(0, 'dis_id', 'tile_id')}, dis_id, tile_id) - 1 AS pos FROM cnt),
    q AS (SELECT draw, CAST('0x' || substr({_hash(0, "'draw'", 'draw')}, 1, 8) AS BIGINT) % (SELECT count(*) FROM cnt) AS pos FROM (SELECT unnest(range(500)) AS draw)),
    c AS (SELECT *, row_number() OVER (PARTITION BY dis_id, tile_id ORDER BY draw) AS n FROM q JOIN p USING (pos))
    SELECT 'train' AS split, c.dis_id, c.tile_id, CASE WHEN n >= 2 THEN concat(n, 'a', c.tile_id) ELSE CAST(c.tile_id AS VARCHAR) END AS copy_id, destroyed
    FROM c JOIN cnt USING (dis_id, tile_id)""")
def sampled_copies(spark, d):
    every = counts(spark, d)
    picked = X.sample_with_replacement(every.select("dis_id", "tile_id"), 500, "dis_id", "tile_id").select(F.lit("train").alias("split"), "dis_id", "tile_id", "draw")
    return X.attach_copies(picked, every).select("split", "dis_id", "tile_id", "copy_id", "destroyed")


@query(f"""WITH {PX}, t AS (SELECT gt AS class, count(*) AS n FROM px GROUP BY gt), lr AS (SELECT unnest([0, 1, 2]) AS i, unnest([1e-1, 1e-2, 1e-3]) AS lr), bs AS (SELECT unnest([0, 1]) AS j, unnest([16, 32]) AS batch_size)
    SELECT CAST(j * 3 + i AS INT) AS conf_id, batch_size, lr, 50 AS epochs, class, n FROM lr, bs, t""")
def parameter_grid(spark, d):
    seen = V.pixels(spark, d).groupBy(F.col("gt").alias("class")).agg(F.count("*").alias("n"))
    grid = X.param_grid(spark, {"lr": [1e-1, 1e-2, 1e-3], "batch_size": [16, 32]}, {"epochs": 50})
    return F.broadcast(grid).crossJoin(seen)


SUM5 = " + ".join(f'"{k}"' for k in L.BUILDING_KEYS)
SLICES = f"""{COUNTS}, o AS (SELECT *, row_number() OVER (ORDER BY {_hash(1, 'dis_id', 'tile_id')}, dis_id, tile_id) - 1 AS pos FROM cnt),
    w AS (SELECT pos AS start, CAST(sum({SUM5}) OVER s AS BIGINT) AS f1, {", ".join(f'CAST(sum("{k}") OVER s AS BIGINT) AS d{i}' for i, k in enumerate(L.DAMAGE_KEYS))}, count(*) OVER s AS k
          FROM o WINDOW s AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 199 FOLLOWING)),
    v AS (SELECT start, f1, 4 * (d0 * d0 + d1 * d1 + d2 * d2 + d3 * d3) - (d0 + d1 + d2 + d3) * (d0 + d1 + d2 + d3) AS f2 FROM w WHERE k = 200),
    g AS (SELECT start, coalesce((f1 - min(f1) OVER ()) / nullif(CAST(max(f1) OVER () - min(f1) OVER () AS DOUBLE), 0), 0) AS g1,
                 coalesce((f2 - min(f2) OVER ()) / nullif(CAST(max(f2) OVER () - min(f2) OVER () AS DOUBLE), 0), 0) AS g2 FROM v),
    b AS (SELECT beta, start, 100 * (1 - beta) * g1 - 100 * beta * g2 AS score FROM g, (SELECT unnest([0.3e0, 0.5e0, 0.7e0]) AS beta))"""


def _hash_ordered(spark, d):
    placed, _ = X.hash_position(counts(spark, d), 1, "dis_id", "tile_id")
    return placed


@query(f"WITH {SLICES} SELECT beta, start, round(score, 6) AS score FROM b")
def slice_sweep(spark, d):
    return rounded(B.slice_scores(_hash_ordered(spark, d), 200, [0.3, 0.5, 0.7]), "score")


@query(f"""WITH {SLICES} SELECT beta, 200 AS n, start, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY beta ORDER BY round(score, 9) DESC, start) AS r FROM b) WHERE r = 1""")
def best_slices(spark, d):
    return rounded(B.best_slices(_hash_ordered(spark, d), 200, [0.3, 0.5, 0.7]), "score")


def _sweep_sql(n: int) -> str:
    body = SLICES.partition(", o AS")[2].replace("199 FOLLOWING", f"{n - 1} FOLLOWING").replace("k = 200", f"k = {n}")
    return f"""SELECT beta, {n} AS n, start, round(score, 6) AS score FROM (WITH o AS{body}
        SELECT *, row_number() OVER (PARTITION BY beta ORDER BY round(score, 9) DESC, start) AS r FROM b) WHERE r = 1"""


@query(f"WITH {COUNTS} " + " UNION ALL ".join(_sweep_sql(n) for n in (100, 200, 400)))
def slice_sizes_sweep(spark, d):
    ordered = _hash_ordered(spark, d)
    found = [B.best_slices(ordered, n, [0.3, 0.5, 0.7]) for n in (100, 200, 400)]
    return rounded(found[0].unionByName(found[1]).unionByName(found[2]), "score")


@query()
def greedy_order(spark, d):
    """The greedy order of each disaster; tests hold it against the step-by-step definition."""
    return greedy_balance_order(counts(spark, d), ["tile_id"], list(L.DAMAGE_KEYS), ["dis_id"]).select("dis_id", "tile_id", "pos")


BEGINNING = 24
VECTOR = ", ".join(f'"{k}"' for k in L.DAMAGE_KEYS)


@query(f"""WITH RECURSIVE {COUNTS}, t AS (SELECT dis_id, tile_id, [{VECTOR}] AS v, row_number() OVER (PARTITION BY dis_id, {VECTOR} ORDER BY tile_id) AS nth FROM cnt),
    g AS (SELECT dis_id, list(v ORDER BY v) AS vs, list(n ORDER BY v) AS ns FROM (SELECT dis_id, v, count(*) AS n FROM t GROUP BY ALL) GROUP BY dis_id),
    st AS (SELECT dis_id, vs, ns, [0, 0, 0, 0]::BIGINT[] AS total, CAST(-1 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS best FROM g
           UNION ALL SELECT dis_id, vs, list_transform(ns, lambda n, i: CASE WHEN i = hit THEN n - 1 ELSE n END), list_transform(total, lambda x, i: x + vs[hit][i]), pos + 1, hit
           FROM (SELECT *, list_position(cost, list_min(cost)) AS hit FROM
                (SELECT *, list_transform(vs, lambda v, i: CASE WHEN ns[i] > 0 THEN 4 * list_sum(list_transform(v, lambda x, j: (x + total[j]) * (x + total[j]))) - list_sum(list_transform(v, lambda x, j: x + total[j])) * list_sum(list_transform(v, lambda x, j: x + total[j])) END) AS cost
                 FROM st WHERE pos < {BEGINNING - 1} AND list_sum(ns) > 0))),
    p AS (SELECT dis_id, vs[best] AS v, pos, row_number() OVER (PARTITION BY dis_id, best ORDER BY pos) AS nth FROM st WHERE pos >= 0)
    SELECT p.dis_id, t.tile_id, p.pos FROM p JOIN t ON t.dis_id = p.dis_id AND t.v = p.v AND t.nth = p.nth""")
def greedy_beginning(spark, d):
    """The first picks of each disaster's greedy order: an order that stops where its user has enough."""
    return greedy_balance_order(counts(spark, d), ["tile_id"], list(L.DAMAGE_KEYS), ["dis_id"], BEGINNING).select("dis_id", "tile_id", "pos")


@query()
def balanced_sample(spark, d):
    """The best slice of the greedy order and empty tiles; tests hold it against the definition."""
    every = settled(counts(spark, d))
    return B.balanced_sample(every, 500)


BO = f"""bo AS (SELECT c_mktsegment AS dis_id, o_orderkey AS tile_id, l_partkey * 1000000 + l_suppkey * 1000 + l_linenumber AS obj, {V.LABEL_OF_QUANTITY} AS label
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
    bd AS (SELECT dis_id, tile_id, obj, min(label) AS label FROM bo GROUP BY dis_id, tile_id, obj)"""


def _objects(spark, d):
    rows = V.lines_of_tiles(spark, d, "l_partkey * 1000000 + l_suppkey * 1000 + l_linenumber AS obj", f"{V.LABEL_OF_QUANTITY} AS label")
    return rows.groupBy("dis_id", "tile_id", "obj").agg(F.min("label").alias("label"))


def _pick(seed: int, n: str, *parts: str) -> str:
    return f"CAST('0x' || substr({_hash(seed, *parts)}, 1, 8) AS BIGINT) % {n}"


@query(f"""WITH {BO}, h AS (SELECT *, CAST(5 + {_pick(0, '5', "'rate'", 'dis_id', 'tile_id')} AS DOUBLE) / 10 AS rate, count(*) OVER (PARTITION BY dis_id, tile_id) AS n,
           row_number() OVER (PARTITION BY dis_id, tile_id ORDER BY {_hash(0, 'obj')}, obj) AS nth FROM bd WHERE label IN ('no-damage', 'minor-damage', 'major-damage')),
    k AS (SELECT * FROM h WHERE nth <= round_even(n * rate, 0)),
    dn AS (SELECT dis_id, obj AS donor, row_number() OVER (PARTITION BY dis_id ORDER BY obj) - 1 AS donor_at, count(*) OVER (PARTITION BY dis_id) AS donors FROM bd WHERE label = 'destroyed'),
    z AS (SELECT DISTINCT dis_id, donors FROM dn)
    SELECT k.dis_id, k.tile_id, k.obj, k.label, k.rate, dn.donor FROM k JOIN z ON k.dis_id = z.dis_id
    JOIN dn ON dn.dis_id = k.dis_id AND dn.donor_at = {_pick(0, 'z.donors', "'donor'", 'k.obj')}""")
def replacement_plan(spark, d):
    return B.replacement_plan(_objects(spark, d), "destroyed")


@query(f"""WITH {COUNTS}, t AS (SELECT dis_id, sum(destroyed) AS de, greatest(sum("no-damage"), sum("minor-damage"), sum("major-damage"), sum(destroyed), sum("un-classified")) AS top FROM cnt GROUP BY dis_id),
    df AS (SELECT dis_id, CAST(top - de AS BIGINT) AS deficit FROM t WHERE top > de),
    ho AS (SELECT dis_id, tile_id, destroyed AS own, "no-damage" + "minor-damage" + "major-damage" + "un-classified" AS others,
                  row_number() OVER (PARTITION BY dis_id ORDER BY {_hash(0, 'dis_id', 'tile_id')}, tile_id) AS r FROM cnt WHERE destroyed > 0),
    ca AS (SELECT dis_id, tile_id, own, others, deficit, CAST(unnest(range(1, deficit + 1)) AS INT) AS clone FROM (SELECT * FROM ho WHERE r = 1) JOIN df USING (dis_id)),
    ga AS (SELECT dis_id, tile_id, clone, deficit, own + CAST(round_even(others * (CAST(5 + {_pick(0, '5', "'clone'", 'dis_id', 'clone')} AS DOUBLE) / 10), 0) AS BIGINT) AS gain FROM ca),
    su AS (SELECT *, CAST(coalesce(sum(gain) OVER (PARTITION BY dis_id ORDER BY clone ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gained FROM ga)
    SELECT dis_id, clone, gain, gained, deficit, tile_id FROM su WHERE gained < deficit""")
def balance_clones(spark, d):
    return B.balance_step(counts(spark, d), "destroyed")


def _balance_sql(i: int) -> str:
    return f""", n{i} AS MATERIALIZED (SELECT r.dis_id, r.label, r.tile_id, r.own, CAST(r.target - r.total - c.more AS BIGINT) AS deficit FROM rk r JOIN c{i - 1} c ON c.dis_id = r.dis_id AND c.label = r.label
        WHERE place = {i} AND r.target - r.total - c.more > 0),
    x{i} AS MATERIALIZED (SELECT n.dis_id, k.obj, k.label FROM n{i} n JOIN kn k ON k.dis_id = n.dis_id AND k.tile_id = n.tile_id AND k.label <> n.label),
    a{i} AS (SELECT n.*, coalesce(o.n, 0) AS others, CAST(unnest(range(1, deficit + 1)) AS INT) AS clone FROM n{i} n LEFT JOIN (SELECT dis_id, count(*) AS n FROM x{i} GROUP BY dis_id) o ON o.dis_id = n.dis_id),
    g{i} AS (SELECT *, CAST(round_even(others * (CAST(5 + {_pick(0, '5', "'clone'", 'dis_id', 'label', 'clone')} AS DOUBLE) / 10), 0) AS BIGINT) AS replaced FROM a{i}),
    s{i} AS (SELECT *, own + replaced AS gain, CAST(coalesce(sum(own + replaced) OVER (PARTITION BY dis_id ORDER BY clone ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gained FROM g{i}),
    t{i} AS MATERIALIZED (SELECT dis_id, {i} AS place, label, clone, tile_id, replaced, gain, gained, deficit FROM s{i} WHERE gained < deficit),
    k{i} AS (SELECT t.dis_id, x.label, t.replaced, row_number() OVER (PARTITION BY t.dis_id, t.clone ORDER BY {_hash(0, 't.clone', 'x.obj')}, x.obj) AS nth FROM t{i} t JOIN x{i} x ON x.dis_id = t.dis_id),
    c{i} AS MATERIALIZED (SELECT dis_id, label, CAST(sum(more) AS BIGINT) AS more FROM (SELECT * FROM c{i - 1} UNION ALL SELECT dis_id, label, count(*) FROM k{i} WHERE nth > replaced GROUP BY 1, 2
        UNION ALL SELECT dis_id, label, sum(gain) FROM t{i} GROUP BY 1, 2) GROUP BY 1, 2)"""


BALANCE = f"""kn AS MATERIALIZED (SELECT * FROM bd WHERE label IN ('no-damage', 'minor-damage', 'major-damage', 'destroyed', 'un-classified')),
    bt AS (SELECT dis_id, tile_id, label, count(*) AS n FROM kn GROUP BY ALL),
    ra AS (SELECT dis_id, label, CAST(sum(n) AS BIGINT) AS total, arg_min(struct_pack(tile_id, own := n), {_hash(0, 'dis_id', 'label', 'tile_id')}) AS host FROM bt GROUP BY dis_id, label),
    rt AS (SELECT *, greatest(max(total) OVER (PARTITION BY dis_id), coalesce((SELECT n FROM em WHERE em.dis_id = ra.dis_id), 0)) AS target FROM ra),
    rk AS MATERIALIZED (SELECT dis_id, label, total, host.tile_id AS tile_id, host.own AS own, row_number() OVER (PARTITION BY dis_id ORDER BY total, label) AS place, target FROM rt WHERE label <> 'un-classified'),
    c0 AS (SELECT dis_id, label, CAST(0 AS BIGINT) AS more FROM rk){"".join(map(_balance_sql, range(1, 5)))}"""
CLONES = " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(1, 5))


@query(f"WITH {BO}, em AS (SELECT NULL AS dis_id, 0 AS n WHERE false), {BALANCE} {CLONES}")
def balance_classes(spark, d):
    """All classes of all disasters, the smallest first, with totals carried on."""
    return B.balance_plan(_objects(spark, d))


# ---------------------------------------------------------------- sources

NAMES = """nm AS (SELECT concat(replace(s_name, '#', '-'), '_', lpad(CAST(s_suppkey AS VARCHAR), 8, '0'), '_', ph, '_', kd) AS path, s_suppkey AS k, ph, kd FROM supplier,
    (SELECT unnest(['pre', 'post']) AS ph) p, (SELECT unnest(['disaster.png', 'disaster.json', 'disaster_target.png', 'readme.txt']) AS kd) q
    WHERE NOT (s_suppkey % 9 = 0 AND ph = 'post' AND kd = 'disaster.json'))"""


def _names(spark, d):
    kinds = F.explode(F.array(*[F.lit(k) for k in ("disaster.png", "disaster.json", "disaster_target.png", "readme.txt")]))
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_name", "s_suppkey", F.explode(F.array(F.lit("pre"), F.lit("post"))).alias("ph")).select("*", kinds.alias("kd"))
    return s.filter("NOT (s_suppkey % 9 = 0 AND ph = 'post' AND kd = 'disaster.json')").select(
        F.concat_ws("_", F.replace("s_name", F.lit("#"), F.lit("-")), F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), "ph", "kd").alias("path"))


CATALOG = NAMES + """, ca AS (SELECT path, split_part(path, '_', 1) AS dis_id, split_part(path, '_', 2) AS tile_id, ph AS phase,
    CASE kd WHEN 'disaster.png' THEN 'image' WHEN 'disaster.json' THEN 'json' WHEN 'disaster_target.png' THEN 'mask' END AS kind FROM nm)"""


@query(f"WITH {CATALOG} SELECT path, dis_id, tile_id, phase, kind FROM ca WHERE kind IS NOT NULL")
def tile_catalog(spark, d):
    return K.tile_catalog(_names(spark, d))[0]


@query(f"WITH {CATALOG} SELECT path FROM ca WHERE kind IS NULL")
def catalog_rejects(spark, d):
    return K.tile_catalog(_names(spark, d))[1]


@query(f"""WITH {CATALOG}, c AS (SELECT dis_id, tile_id, {", ".join(f"count(*) FILTER (phase = '{s.split('_')[0]}' AND kind = '{s.split('_')[1]}') AS {s}" for s in K.SLOTS)} FROM ca WHERE kind IS NOT NULL GROUP BY 1, 2)
    SELECT * FROM c WHERE {" OR ".join(f"{s} <> 1" for s in K.SLOTS)}""")
def incomplete_tiles(spark, d):
    return K.check_catalog(K.tile_catalog(_names(spark, d))[0])


@query(f"WITH {CATALOG} SELECT path, dis_id, tile_id, phase, kind FROM ca WHERE kind IS NOT NULL AND (dis_id LIKE 'Supplier-00000001%' OR dis_id LIKE 'Supplier-00000003%')")
def chosen_disasters(spark, d):
    return K.filter_disasters(K.tile_catalog(_names(spark, d))[0], ["Supplier-00000001", "Supplier-00000003"])


@query(f"""WITH {CATALOG}, p AS (SELECT dis_id, tile_id, lpad(CAST(unnest(range(16)) AS VARCHAR), 3, '0') AS patch_id FROM (SELECT DISTINCT dis_id, tile_id FROM ca))
    SELECT p.dis_id, p.tile_id, patch_id, o.org_pre, o.org_post FROM p LEFT JOIN (SELECT dis_id, tile_id, max(path) FILTER (phase = 'pre') AS org_pre, max(path) FILTER (phase = 'post') AS org_post
    FROM ca WHERE kind = 'image' GROUP BY 1, 2) o ON p.dis_id = o.dis_id AND p.tile_id = o.tile_id""")
def patch_manifest(spark, d):
    tiles, _ = K.tile_catalog(_names(spark, d))
    patches = tiles.select("dis_id", "tile_id").distinct().select("dis_id", "tile_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.lpad(i.cast("string"), 3, "0"))).alias("patch_id"))
    return K.patch_manifest(patches, tiles)


@query(f"""WITH nm AS (SELECT concat('out/', replace(s_name, '#', '-'), '_', s_suppkey, '_', lpad(CAST(s_suppkey % 16 AS VARCHAR), 3, '0'), CASE WHEN s_suppkey % 5 = 0 THEN '_other.png' ELSE '_dmg_mask.png' END) AS path,
    replace(s_name, '#', '-') AS dis_id, CAST(s_suppkey AS VARCHAR) AS tile_id, lpad(CAST(s_suppkey % 16 AS VARCHAR), 3, '0') AS patch_id, s_suppkey FROM supplier)
    SELECT path, dis_id, tile_id, patch_id FROM nm WHERE s_suppkey % 5 <> 0""")
def predicted_patches(spark, d):
    paths = spark.read.parquet(f"{d}/supplier.parquet").selectExpr(
        "concat('out/', replace(s_name, '#', '-'), '_', s_suppkey, '_', lpad(cast(s_suppkey % 16 AS string), 3, '0'), CASE WHEN s_suppkey % 5 = 0 THEN '_other.png' ELSE '_dmg_mask.png' END) AS path")
    return K.predicted_catalog(paths)


@query(f"""WITH {POLY} SELECT tile_id, concat('POLYGON ((', x0, ' ', y0, ', ', x1, ' ', y0, ', ', x1, ' ', y1, ', ', x0, ' ', y1, ', ', x0, ' ', y0, '))') AS wkt,
    CASE label WHEN 1 THEN NULL WHEN 2 THEN 'minor-damage' WHEN 3 THEN 'major-damage' WHEN 4 THEN 'destroyed' ELSE 'un-classified' END AS subtype, concat('u', obj) AS uid FROM poly WHERE obj % 13 <> 0""")
def label_features(spark, d):
    polys = V.with_wkt(V.polygons(spark, d)).select("tile_id", "wkt", F.when(F.col("label") > 1, L.label_key(F.col("label"))).alias("subtype"), F.concat(F.lit("u"), "obj").alias("uid"),
                                                   F.when(F.col("obj") % 13 == 0, "road").otherwise("building").alias("feature_type"))
    feature = F.struct("wkt", F.struct("feature_type", "subtype", "uid").alias("properties"))
    files = polys.groupBy("tile_id").agg(F.to_json(F.struct(F.struct(F.collect_list(feature).alias("xy")).alias("features"))).alias("json"))
    return J.buildings_only(J.parse_labels(files, "json", "tile_id")).select("tile_id", "wkt", "subtype", "uid")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(ORACLES["split_random"])
def splits_on_file(spark, d):
    """Written by split, and read again."""
    path = _folder(spark, "splits")
    W.write_splits(split_random(spark, d), path)
    return W.read_splits(spark, path).select("dis_id", "tile_id", F.col("split").cast("string").alias("split"))


@query(f"""WITH {CATALOG}, p AS (SELECT dis_id, tile_id, lpad(CAST(unnest(range(16)) AS VARCHAR), 3, '0') AS patch_id FROM (SELECT DISTINCT dis_id, tile_id FROM ca))
    SELECT dis_id, tile_id, patch_id, CASE WHEN patch_id < '012' THEN 'train' ELSE 'val' END AS split FROM p""")
def patches_on_file(spark, d):
    """Written by split, disasters side by side; ids of patches and tiles come back with their zeros."""
    path = _folder(spark, "patches")
    rows = patch_manifest(spark, d).select(F.when(F.col("patch_id") < "012", "train").otherwise("val").alias("split"), "dis_id", "tile_id", "patch_id")
    W.write_patches(rows, path)
    return spark.read.schema("tile_id string, patch_id string, split string, dis_id string").parquet(path)


@query(f"""WITH {EPOCH_PX}, l AS (SELECT epoch, class, unnest(['precision', 'recall', 'f1', 'accuracy']) AS metric, unnest([round(p, 6), round(r, 6), round(f, 6), round(a, 6)]) AS value FROM f)
    SELECT 'val' AS split, 'pixel' AS level, CAST(epoch AS INT) AS epoch, class, metric, CASE WHEN epoch = 3 THEN value + 1 ELSE value END AS value FROM l""")
def metrics_on_file(spark, d):
    """Written by epoch; epoch 3 is written again with other values, which replaces it and nothing else."""
    path = _folder(spark, "metrics")
    rows = C.long_metrics(_epoch_metrics(spark, d), "pixel", ["epoch"]).withColumn("split", F.lit("val"))
    W.write_metrics(rows, path)
    W.write_metrics(rows.filter("epoch = 3").withColumn("value", F.col("value") + 1), path)
    return spark.read.parquet(path).select(F.col("split").cast("string"), F.col("level").cast("string"), F.col("epoch").cast("int"), "class", "metric", "value")


LOSSES = f"""WITH {EP}, s AS (SELECT conf, fold, epoch, round(sum(val * n) / sum(n), 6) AS loss FROM ep GROUP BY ALL) SELECT conf, fold, epoch, loss FROM s"""


def _loss_files(spark, d, header: bool):
    """A CSV file for each configuration and fold, as a search leaves them behind; read again with one glob."""
    root = _folder(spark, "search")
    rows = rounded(_loss(spark, d), "loss").select("conf", "fold", "epoch", "loss").persist()
    for r in rows.select("conf", "fold").distinct().collect():  # the configurations of a search
        rows.filter((F.col("conf") == r.conf) & (F.col("fold") == r.fold)).select("epoch", "loss").coalesce(1).write.option("header", header).csv(
            f"{root}/config-{r.conf}/{r.conf}-fold_{r.fold}/metrics/csv/loss.csv")
    rows.unpersist()
    return W.read_metrics(spark, root, "loss.csv", W.LOSS_SCHEMA, header).select("conf", "fold", F.col("epoch").cast("int").alias("epoch"), "loss")


@query(LOSSES)
def loss_files(spark, d):
    return _loss_files(spark, d, True)


@query(LOSSES)
def loss_files_without_header(spark, d):
    return _loss_files(spark, d, False)


# ---------------------------------------------------------------- geometry, masks, objects


@query(f"""WITH {POLY}, v AS (SELECT *, CAST(x1 - x0 AS DOUBLE) AS w, CAST(y1 - y0 AS DOUBLE) AS h FROM poly)
    SELECT tile_id, obj, 5 AS vertices, x0 AS x1, y0 AS y1, x1 AS x2, y1 AS y2, w * w + h * h AS d2, 0 AS i, 2 AS j, x0 + w / 2 AS cx, y0 + h / 2 AS cy, 2 * w * h AS area2,
           round(5 * w * w / 4, 6) AS xx, round(5 * h * h / 4, 6) AS yy, round(w * h / 4, 6) AS xy, -w / 2 AS ox, -h / 2 AS oy,
           round(CASE WHEN 3 * h / 2 - w > 0 THEN 1 ELSE -1 END * degrees(acos((3 * w / 2 + 2 * h / 2) / (sqrt(w * w / 4 + h * h / 4) * sqrt(13)))), 4) AS turn FROM
    (SELECT tile_id, obj, x0, y0, x1, y1, w, h FROM v)""")
def polygon_geometry(spark, d):
    rows = V.with_wkt(V.polygons(spark, d)).withColumn("ring", G.wkt_ring(F.col("wkt"))).withColumn("box", G.bbox(F.col("ring"), 64, 64))
    rows = rows.withColumn("far", G.farthest_points(F.col("ring"))).withColumn("c", G.area_centroid(F.col("ring")))
    rows = rows.withColumn("m", G.vertex_moments(F.col("ring"), F.col("c.x"), F.col("c.y"))).withColumn("o", G.orientation_vector(F.col("ring"), F.col("box")))
    turn = G.rotation_angle(F.struct(F.lit(-3.0).alias("x"), F.lit(-2.0).alias("y")), F.col("o"))
    return rows.select(
        "tile_id", "obj", F.size("ring").alias("vertices"), "box.x1", "box.y1", "box.x2", "box.y2", "far.d2", "far.i", "far.j", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"),
        "c.area2", F.round("m.xx", 6).alias("xx"), F.round("m.yy", 6).alias("yy"), F.round("m.xy", 6).alias("xy"), F.col("o.x").alias("ox"), F.col("o.y").alias("oy"), F.round(turn, 4).alias("turn"))


@query(f"""WITH {POLY}, {PRED} SELECT a.tile_id, a.obj AS a_obj, b.obj AS b_obj FROM poly a JOIN pred b ON a.tile_id = b.tile_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""")
def intersecting_boxes(spark, d):
    boxes = lambda df: df.selectExpr("tile_id", "obj", "x0 AS x1", "y0 AS y1", "x1 AS x2", "y1 AS y2")
    return O.bbox_join(boxes(V.polygons(spark, d)), boxes(V.predicted_polygons(spark, d)), cell=16)


def _mask(polys: DataFrame) -> DataFrame:
    return R.overlay(R.rectangle_runs(polys)).withColumn("label", L.erase_unclassified(F.col("label"))).filter("label > 0")


def _masks(spark, d):
    return _mask(V.polygons(spark, d)), _mask(V.predicted_polygons(spark, d))


def _mask_sql(name: str, polys: str) -> str:
    return f"""{name} AS (SELECT tile_id, y, x, label FROM (SELECT tile_id, y, x, arg_max(label, obj) AS label FROM
        (SELECT tile_id, obj, label, y, unnest(range(x0, x1)) AS x FROM (SELECT *, unnest(range(y0, y1)) AS y FROM {polys})) GROUP BY tile_id, y, x) WHERE label <> 5)"""


MASKS = f"{POLY}, {PRED}, {_mask_sql('gm', 'poly')}, {_mask_sql('pm', 'pred')}"
RUNS = """SELECT tile_id, CAST(y AS INT) AS y, CAST(min(x) AS INT) AS x0, CAST(max(x) + 1 AS INT) AS x1, label FROM
    (SELECT *, x - row_number() OVER (PARTITION BY tile_id, y, label ORDER BY x) AS g FROM gm) GROUP BY tile_id, y, label, g"""


@query(f"WITH {MASKS} {RUNS}")
def rasterized_polygons(spark, d):
    polys = V.with_wkt(V.polygons(spark, d)).withColumn("rings", G.wkt_rings(F.col("wkt")))
    return R.rasterize(polys, width=64, height=64).select("tile_id", "y", "x0", "x1", "label")


#: A pixel is inside where an odd number of edges crosses its centre's line at or before the centre.
COURTS = f"""edge AS (SELECT obj, unnest([{", ".join(
        f"{{'xa': {a}, 'ya': {b}, 'xb': {c}, 'yb': {e}}}" for r in V.COURT for (a, b), (c, e) in zip(r, (*r[1:], r[0]), strict=True))}], recursive := true) FROM poly),
    near AS (SELECT tile_id, obj, label, y, unnest(range(x0, least(x1 + 6, 64))) AS x FROM (SELECT *, unnest(range(y0, least(y1 + 7, 64))) AS y FROM poly)),
    inside AS (SELECT tile_id, n.obj, label, y, x FROM near n JOIN edge e ON n.obj = e.obj AND (ya <= y + 0.5) <> (yb <= y + 0.5)
        AND xa + (CAST(y + 0.5 AS DOUBLE) - ya) * (xb - xa) / (yb - ya) <= x + 0.5 GROUP BY ALL HAVING count(*) % 2 = 1),
    cm AS (SELECT * FROM (SELECT tile_id, y, x, arg_max(label, obj) AS label FROM inside GROUP BY ALL) WHERE label <> 5)"""


@query(f"WITH {POLY}, {COURTS} {RUNS.replace('FROM gm)', 'FROM cm)')}")
def rasterized_courts(spark, d):
    """Slanted polygons with holes, cut off at the edges of their tiles."""
    polys = V.with_court_wkt(V.polygons(spark, d)).withColumn("rings", G.wkt_rings(F.col("wkt")))
    return R.rasterize(polys, width=64, height=64).select("tile_id", "y", "x0", "x1", "label")


AREA_COUNTS = f"""pc AS (SELECT t.tile_id, 4096 - count(label) AS n_0, {", ".join(f"count(*) FILTER (label = {c}) AS n_{c}" for c in range(1, 6))}
    FROM ({V.TILES_SQL}) t LEFT JOIN gm ON gm.tile_id = t.tile_id GROUP BY t.tile_id)"""


@query(f"WITH {MASKS}, {AREA_COUNTS} SELECT * FROM pc")
def mask_pixel_counts(spark, d):
    """All tiles of the catalog, those without a building too."""
    return T.pixel_counts(_masks(spark, d)[0], 64 * 64, tiles=V.tiles(spark, d))


WEIGHTS = f"""sm AS (SELECT {", ".join(f"CAST(sum(n_{c}) AS DOUBLE) AS c{c}" for c in range(6))} FROM pc), w AS (SELECT 'dmg' AS head, unnest(range(5))::INT AS class,
    unnest([{", ".join(f"CASE WHEN c{c} > 0 THEN round((c0 + c1 + c2 + c3 + c4 + c5) / c{c}, 2) ELSE 0 END" for c in range(5))}]) AS weight FROM sm
    UNION ALL SELECT 'seg', unnest([0, 1]), unnest([round((c0 + c1 + c2 + c3 + c4) / nullif(c0, 0), 2), round((c0 + c1 + c2 + c3 + c4) / nullif(c1 + c2 + c3 + c4, 0), 2)]) FROM sm)"""


@query(f"WITH {MASKS}, {AREA_COUNTS}, {WEIGHTS} SELECT head, class, weight FROM w")
def mask_class_weights(spark, d):
    """Weights of both heads from runs, with the background of all tiles."""
    return T.weights_of_counts(T.pixel_counts(_masks(spark, d)[0], 64 * 64, tiles=V.tiles(spark, d)))


@query(f"""WITH {MASKS} SELECT tile_id, lpad(CAST(CAST((y // 16) * 4 + x // 16 AS INT) AS VARCHAR), 3, '0') AS patch_id, count(*) AS pixels, CAST(sum((y % 16) * 16 + x % 16) AS BIGINT) AS places FROM gm GROUP BY 1, 2""")
def sliced_tiles(spark, d):
    patches = R.slice_tiles(_masks(spark, d)[0], 4, 64, 64)
    width = F.col("x1") - F.col("x0")
    places = F.col("y") * 16 * width + (F.col("x0") + F.col("x1") - 1) * width / 2
    return patches.groupBy("tile_id", "patch_id").agg(F.sum(width).cast("long").alias("pixels"), F.sum(places).cast("long").alias("places"))


@query(f"WITH {MASKS} {RUNS}")
def merged_patches(spark, d):
    return R.merge_patches(R.slice_tiles(_masks(spark, d)[0], 4, 64, 64), 4, 64, 64).select("tile_id", "y", "x0", "x1", "label")


@query(f"""WITH {MASKS}, px AS (SELECT t.tile_id, coalesce(g.label, 0) AS gt, coalesce(p.label, 0) AS pred FROM
    (SELECT tile_id, unnest(range(4096)) // 64 AS y, unnest(range(4096)) % 64 AS x FROM (SELECT DISTINCT tile_id FROM poly)) t
    LEFT JOIN gm g ON g.tile_id = t.tile_id AND g.y = t.y AND g.x = t.x LEFT JOIN pm p ON p.tile_id = t.tile_id AND p.y = t.y AND p.x = t.x) {OVR.format(k='tile_id, ')}""")
def mask_confusion_by_tile(spark, d):
    gt, predicted = _masks(spark, d)
    return E.pixel_confusion(gt, predicted, 64 * 64, V.polygons(spark, d).select("tile_id"))


def _comp_sql(m: str) -> str:
    return f"""{m}r AS (SELECT tile_id, y, x, y * 64 + x AS c FROM {m} UNION
        SELECT n.tile_id, n.y, n.x, r.c FROM {m}r r JOIN {m} n ON n.tile_id = r.tile_id AND abs(n.y - r.y) + abs(n.x - r.x) = 1 AND r.c < n.y * 64 + n.x),
    {m}c AS (SELECT tile_id, y, x, min(c) AS obj FROM {m}r GROUP BY tile_id, y, x),
    {m}l AS (SELECT tile_id, obj, label, count(*) AS n FROM {m}c JOIN {m} USING (tile_id, y, x) GROUP BY ALL),
    {m}o AS (SELECT tile_id, obj, arg_max(label, n * 10 - label) AS label, CAST(sum(n) AS BIGINT) AS area FROM {m}l GROUP BY tile_id, obj)"""


OBJECTS = f"RECURSIVE {MASKS}, {_comp_sql('gm')}, {_comp_sql('pm')}"
PAIRS = OBJECTS + """, ov AS (SELECT tile_id, g.obj AS gid, p.obj AS pid, count(*) AS inter FROM gmc g JOIN pmc p USING (tile_id, y, x) GROUP BY 1, 2, 3),
    pa AS (SELECT ov.*, inter / CAST(g.area + p.area - inter AS DOUBLE) AS iou, g.label AS glabel, p.label AS plabel FROM ov
           JOIN gmo g ON g.tile_id = ov.tile_id AND g.obj = gid JOIN pmo p ON p.tile_id = ov.tile_id AND p.obj = pid)"""
MATCHES = PAIRS + ", ma AS (SELECT * FROM pa WHERE iou > 0.5e0)"
SPINE = "(SELECT unnest([1, 2, 3, 4]) AS class)"
OBJ_CONF = MATCHES + f""", oc AS (SELECT class, m AS true_pos, p - m AS false_pos, g - m AS false_neg, CAST(0 AS BIGINT) AS true_neg, g AS true_total, p AS pred_total FROM
    (SELECT class, (SELECT count(*) FROM gmo WHERE label = class) AS g, (SELECT count(*) FROM pmo WHERE label = class) AS p, (SELECT count(*) FROM ma WHERE glabel = class AND plabel = class) AS m FROM {SPINE}))"""


def _components(spark, d):
    """Both masks' components, settled since overlaps and tables read them."""
    return [settled(R.connected_components(m, side=64)) for m in _masks(spark, d)]


def _true_objects(spark, d):
    return O.object_table(R.connected_components(_masks(spark, d)[0], side=64))


@query(f"""WITH {OBJECTS} SELECT o.tile_id, o.obj, o.label, o.area, b.x1, b.y1, b.x2, b.y2 FROM gmo o JOIN (SELECT tile_id, obj, CAST(min(x) AS INT) AS x1, CAST(min(y) AS INT) AS y1, CAST(max(x) + 1 AS INT) AS x2,
    CAST(max(y) + 1 AS INT) AS y2 FROM gmc GROUP BY 1, 2) b ON b.tile_id = o.tile_id AND b.obj = o.obj""")
def true_objects(spark, d):
    return _true_objects(spark, d)


@query(f"""WITH {OBJECTS}, t AS (SELECT DISTINCT tile_id FROM gmo) SELECT t.tile_id, class AS level, count(o.obj) AS n,
    CASE class WHEN 1 THEN 'no-damage' WHEN 2 THEN 'minor-damage' WHEN 3 THEN 'major-damage' ELSE 'destroyed' END AS key
    FROM t, {SPINE} LEFT JOIN gmo o ON o.tile_id = t.tile_id AND o.label = class GROUP BY 1, 2""")
def objects_by_level(spark, d):
    return T.level_counts(_true_objects(spark, d))


#: Tiles in mosaics of 2 x 2, with the borders that buildings stand on: a tile's polygons are shifted to the left by a part of its width, over the border.
MOSAIC = "(tile_id - tile_id % 80) AS mosaic, (tile_id - tile_id % 20) / 20 % 2 AS c, (tile_id - tile_id % 40) / 40 % 2 AS r"
SHIFT = 20


@query(f"""WITH RECURSIVE {MASKS}, mx AS (SELECT tile_id - tile_id % 80 AS tile_id, (tile_id // 40 % 2) * 64 + y AS y, ((tile_id // 20 % 2) * 64 + x + 128 - {SHIFT}) % 128 AS x, label FROM gm),
    ed AS (SELECT a.tile_id, a.y, a.x, a.y * 128 + a.x AS i, b.y * 128 + b.x AS j FROM mx a JOIN mx b ON a.tile_id = b.tile_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
    re AS (SELECT tile_id, y * 128 + x AS i, y * 128 + x AS c FROM mx UNION SELECT e.tile_id, e.j, re.c FROM re JOIN ed e ON e.tile_id = re.tile_id AND e.i = re.i AND re.c < e.j),
    co AS (SELECT tile_id, i, min(c) AS c FROM re GROUP BY tile_id, i)
    SELECT CAST(tile_id AS BIGINT) AS mosaic, CAST(c // 128 * 2147483648 + c % 128 AS BIGINT) AS obj, count(*) AS area, CAST(sum(label) AS BIGINT) AS labels,
        count(DISTINCT (mx.y // 64) * 2 + mx.x // 64) AS tiles FROM co JOIN mx USING (tile_id) WHERE mx.y * 128 + mx.x = i GROUP BY tile_id, c""")
def mosaic_objects(spark, d):
    """Objects over the borders of tiles, four tiles to a mosaic; how many tiles each stands on."""
    runs = _masks(spark, d)[0].selectExpr("tile_id", *_columns(MOSAIC), "y", "x0", "x1", "label")
    # Runs of the shifted mosaic: cut where they pass a border, on either side.
    moved = runs.selectExpr("CAST(mosaic AS BIGINT) AS mosaic", "CAST(r AS INT) AS row", "y", f"CAST(c * 64 + x0 + 128 - {SHIFT} AS INT) AS a", f"CAST(c * 64 + x1 + 128 - {SHIFT} AS INT) AS b", "label")
    cut = moved.withColumn("k", F.explode(F.sequence(F.expr("a div 64"), F.expr("(b - 1) div 64")))).selectExpr(
        "mosaic", "k % 2 AS col", "row", "y", "CAST(greatest(a, k * 64) - k * 64 AS INT) AS x0", "CAST(least(b, k * 64 + 64) - k * 64 AS INT) AS x1", "label")
    found = R.mosaic_components(cut, ["mosaic"], 64)
    width = F.col("x1") - F.col("x0")
    return found.groupBy("mosaic", "obj").agg(F.sum(width).cast("long").alias("area"), F.sum(width * F.col("label")).cast("long").alias("labels"), F.count_distinct("row", "col").alias("tiles"))


@query(f"WITH {PAIRS} SELECT tile_id, gid, pid, inter, round(iou, 6) AS iou, glabel, plabel FROM pa")
def object_overlaps(spark, d):
    return rounded(O.object_iou(*_components(spark, d)), "iou")


@query(f"""WITH {MATCHES}, am AS (SELECT *, iou <= (sqrt(17) - 3) / 2 AND count(*) OVER (PARTITION BY tile_id, gid) > 1 AND count(*) OVER (PARTITION BY tile_id, pid) > 1 AS ambiguous FROM pa)
    SELECT tile_id, gid, pid, round(iou, 6) AS iou, glabel, plabel, ambiguous FROM am WHERE iou > 0.5e0""")
def matched_objects(spark, d):
    return rounded(O.match_objects(O.object_iou(*_components(spark, d))), "iou")


@query(f"""WITH {PAIRS}, b AS (SELECT *, row_number() OVER (PARTITION BY tile_id, gid ORDER BY iou DESC, pid) AS a, row_number() OVER (PARTITION BY tile_id, pid ORDER BY iou DESC, gid) AS c FROM pa)
    SELECT tile_id, gid, pid, round(iou, 6) AS iou FROM b WHERE a = 1 AND c = 1 AND iou > 0.2e0""")
def mutual_best_matches(spark, d):
    return rounded(O.match_objects(O.object_iou(*_components(spark, d)), 0.2).select("tile_id", "gid", "pid", "iou"), "iou")


@query(f"""WITH {MATCHES} SELECT 'undetected' AS kind, tile_id, obj, label FROM gmo o WHERE NOT EXISTS (SELECT 1 FROM ma WHERE ma.tile_id = o.tile_id AND gid = obj)
    UNION ALL SELECT 'ghost', tile_id, obj, label FROM pmo o WHERE NOT EXISTS (SELECT 1 FROM ma WHERE ma.tile_id = o.tile_id AND pid = obj)""")
def unmatched_objects(spark, d):
    g, p = _components(spark, d)
    matches = O.match_objects(O.object_iou(g, p))
    side = lambda df, name, kind: O.unmatched(O.object_table(df), matches, name).select(F.lit(kind).alias("kind"), "tile_id", F.col(name).alias("obj"), "label")
    return side(g, "gid", "undetected").unionByName(side(p, "pid", "ghost"))


def _object_confusion(spark, d):
    g, p = _components(spark, d)
    return O.object_confusion(O.object_table(g), O.object_table(p), O.match_objects(O.object_iou(g, p)))


@query(f"WITH {OBJ_CONF} SELECT * FROM oc")
def object_confusion(spark, d):
    return _object_confusion(spark, d)


@query(f"""WITH {OBJ_CONF}, r AS (SELECT *, CASE WHEN pred_total = 0 THEN 0e0 ELSE true_pos / CAST(pred_total AS DOUBLE) END AS p, CASE WHEN true_total = 0 THEN 0e0 ELSE true_pos / CAST(true_total AS DOUBLE) END AS r FROM oc),
    f AS (SELECT *, CASE WHEN p + r = 0 THEN 0e0 ELSE 2 * p * r / (p + r) END AS f FROM r)
    SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(r, 6) AS accuracy, round(f, 6) AS f1,
           round(CASE WHEN min(f) OVER () = 0 THEN 0e0 ELSE count(*) OVER () / sum(1 / nullif(f, 0)) OVER () END, 6) AS f1_harmonic_mean FROM f""")
def object_metrics(spark, d):
    return rounded(M.eval_metrics(_object_confusion(spark, d), style="object"), "precision", "recall", "accuracy", "f1", "f1_harmonic_mean")


@query(f"""WITH {MATCHES}, ce AS (SELECT CAST(glabel AS VARCHAR) AS gt, CAST(plabel AS VARCHAR) AS pred FROM ma
    UNION ALL SELECT CAST(label AS VARCHAR), 'Undetected' FROM gmo o WHERE NOT EXISTS (SELECT 1 FROM ma WHERE ma.tile_id = o.tile_id AND gid = obj)
    UNION ALL SELECT 'Ghost', CAST(label AS VARCHAR) FROM pmo o WHERE NOT EXISTS (SELECT 1 FROM ma WHERE ma.tile_id = o.tile_id AND pid = obj))
    SELECT coalesce(gt, 'Total') AS gt, {", ".join(f"count(*) FILTER (pred = '{c}') AS p{c}" for c in range(1, 5))}, count(*) FILTER (pred = 'Undetected') AS undetected, count(*) AS total FROM ce GROUP BY ROLLUP (gt)""")
def object_confusion_matrix(spark, d):
    g, p = _components(spark, d)
    return O.object_confusion_matrix(O.object_table(g), O.object_table(p), O.match_objects(O.object_iou(g, p)))


@query(f"""WITH {OBJ_CONF}, px AS (SELECT coalesce(g.label, 0) AS gt, coalesce(p.label, 0) AS pred FROM
    (SELECT tile_id, unnest(range(4096)) // 64 AS y, unnest(range(4096)) % 64 AS x FROM (SELECT DISTINCT tile_id FROM poly)) t
    LEFT JOIN gm g ON g.tile_id = t.tile_id AND g.y = t.y AND g.x = t.x LEFT JOIN pm p ON p.tile_id = t.tile_id AND p.y = t.y AND p.x = t.x),
    o AS ({OVR.format(k='')}), {METRICS}
    SELECT 'pixel' AS level, class, round(f, 6) AS f1 FROM f UNION ALL
    SELECT 'object', class, round(CASE WHEN 2 * true_pos + false_pos + false_neg = 0 THEN 0e0 ELSE 2 * true_pos / CAST(2 * true_pos + false_pos + false_neg AS DOUBLE) END, 6) FROM oc""")
def evaluation(spark, d):
    gt, predicted = _masks(spark, d)
    found = E.evaluate(gt, predicted, 64, V.polygons(spark, d).select("tile_id"))
    return rounded(found["pixel"].select(F.lit("pixel").alias("level"), "class", "f1").unionByName(found["object"].select(F.lit("object").alias("level"), "class", "f1")), "f1")


@query(f"""WITH {OBJECTS}, t AS (SELECT DISTINCT tile_id FROM poly ORDER BY {_hash(0, 'tile_id')}, tile_id LIMIT 40), mo AS (SELECT o.* FROM gmo o JOIN t USING (tile_id)), po AS (SELECT o.* FROM pmo o JOIN t USING (tile_id)),
    ov AS (SELECT tile_id, g.obj AS gid, p.obj AS pid, count(*) AS inter FROM gmc g JOIN pmc p USING (tile_id, y, x) JOIN t USING (tile_id) GROUP BY 1, 2, 3),
    ma AS (SELECT ov.tile_id, g.label AS glabel, p.label AS plabel FROM ov JOIN mo g ON g.tile_id = ov.tile_id AND g.obj = gid JOIN po p ON p.tile_id = ov.tile_id AND p.obj = pid
           WHERE inter / CAST(g.area + p.area - inter AS DOUBLE) > 0.5e0)
    SELECT class, m AS true_pos, p - m AS false_pos, g - m AS false_neg, CAST(0 AS BIGINT) AS true_neg, g AS true_total, p AS pred_total FROM
    (SELECT class, (SELECT count(*) FROM mo WHERE label = class) AS g, (SELECT count(*) FROM po WHERE label = class) AS p, (SELECT count(*) FROM ma WHERE glabel = class AND plabel = class) AS m FROM {SPINE})""")
def sampled_object_confusion(spark, d):
    """A sampling operator: the object confusion of 40 tiles in hash order."""
    tiles = sample_n(V.polygons(spark, d).select("tile_id").distinct(), 40, "tile_id")
    g, p = (R.connected_components(m.join(tiles, "tile_id", "left_semi"), side=64) for m in _masks(spark, d))
    return O.object_confusion(O.object_table(g), O.object_table(p), O.match_objects(O.object_iou(g, p)))


@query(f"""WITH {POLY}, n AS (SELECT obj - 1 AS k, x1 - x0 AS w, y1 - y0 AS h FROM poly)
    SELECT tile_id, obj, greatest(n.w, 1) AS width, greatest(n.h, 1) AS height, round(n.w / CAST(x1 - x0 AS DOUBLE), 6) AS fx, round(n.h / CAST(y1 - y0 AS DOUBLE), 6) AS fy FROM poly JOIN n ON k = obj""")
def donor_scales(spark, d):
    boxes = V.polygons(spark, d).select("tile_id", "obj", F.struct(F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2")).alias("box"))
    hosts = boxes.select((F.col("obj") - 1).alias("obj"), F.col("box").alias("host"))
    scaled = boxes.join(hosts, "obj").select("tile_id", "obj", G.scale_to_box(F.col("box"), F.col("host")).alias("s")).select("tile_id", "obj", "s.*")
    return rounded(scaled, "fx", "fy")


U01 = lambda name: f"CAST({_pick(0, '1000001', repr(name), 'tile_id')} AS DOUBLE) / 1000000"


@query(f"""WITH t AS (SELECT DISTINCT o_orderkey AS tile_id FROM orders) SELECT tile_id, CAST(floor({U01('pad')} * 51) AS INT) AS pad, round({U01('angle')} * 50 - 25, 7) AS angle, round({U01('shift_x')} * 0.1e0 - 0.05e0, 7) AS shift_x,
    round({U01('shift_y')} * 0.1e0 - 0.05e0, 7) AS shift_y, round({U01('scale')} * 0.3e0 + 0.9e0, 7) AS scale, {U01('flip_x')} < 0.5e0 AS flip_x, {U01('flip_y')} < 0.5e0 AS flip_y,
    round({U01('hue')} * 0.8e0 - 0.4e0, 7) AS hue, round({U01('saturation')} * 0.8e0 + 0.6e0, 7) AS saturation, round({U01('contrast')} * 0.5e0 + 0.75e0, 7) AS contrast, round({U01('brightness')} * 0.5e0 + 0.75e0, 7) AS brightness FROM t""")
def augmentation_parameters(spark, d):
    tiles = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("tile_id")).distinct()
    return rounded(P.augmentation_params(tiles, "tile_id"), "angle", "shift_x", "shift_y", "scale", "hue", "saturation", "contrast", "brightness", digits=7)


@query(f"""WITH {SC}, m AS (SELECT gt, CAST(CASE WHEN seg = 0 THEN 0 ELSE list_position(logits, list_max(logits)) - 1 END AS INT) AS pred FROM sc) SELECT gt, pred, count(*) AS n FROM m GROUP BY 1, 2""")
def batch_inference(spark, d):
    def make_model():
        import numpy as np

        def predict(batch):
            logits = np.stack(batch["logits"].to_numpy()) * batch["seg"].to_numpy()[:, None]
            return batch[["gt"]].assign(pred=logits.argmax(axis=1).astype("int32"))

        return predict

    return M.confusion_counts(E.score(V.scores(spark, d), make_model, "gt int, pred int"))


# ---------------------------------------------------------------- rasters, preparation, search


def _flat_rasters(spark, d):
    """A raster of 16 x 16 for each part, all of one value."""
    return spark.read.parquet(f"{d}/part.parquet").selectExpr(
        "p_partkey AS raster_id", "16 AS height", "CASE WHEN p_partkey % 9 = 0 THEN 8 ELSE 16 END AS other", "16 AS width", "1 AS channels",
        "cast(repeat(chr(1 + p_size), 256) AS binary) AS data")


@query("SELECT p_partkey - p_partkey % 20 AS tile_id, count(DISTINCT CASE WHEN p_partkey % 9 = 0 THEN 8 ELSE 16 END) AS shapes FROM part GROUP BY 1 HAVING count(DISTINCT CASE WHEN p_partkey % 9 = 0 THEN 8 ELSE 16 END) > 1")
def mismatched_shapes(spark, d):
    rasters = _flat_rasters(spark, d).selectExpr("raster_id - raster_id % 20 AS tile_id", "other AS height", "width")
    return T.shape_violations(rasters)


IMAGE = 16
#: Rasters of a part: an image of three channels whose values are all above 0, and a mask with one label.
VALUE = "1 + (k * 7 + y * 16 + x + 31 * c) % 250"


def _rasters(spark, d):
    k, size = F.col("raster_id"), IMAGE * IMAGE
    # Values go round by 250, so every image is a stretch of one strip of pixels, and every mask one of four labels.
    strip = bytes(1 + (at + 31 * c) % 250 for at in range(250 + size) for c in range(3))
    image = F.substring(F.lit(strip), (3 * ((k * 7) % 250) + 1).cast("int"), F.lit(3 * size))
    mask = F.substring(F.lit(bytes(1 + label for label in range(4) for _ in range(size))), ((k % 4) * size + 1).cast("int"), F.lit(size))
    kinds = F.inline(F.array(F.struct(F.lit("image").alias("kind"), F.lit(3).alias("channels"), image.alias("data")), F.struct(F.lit("mask").alias("kind"), F.lit(1).alias("channels"), mask.alias("data"))))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("raster_id"), F.lit(IMAGE).alias("height"), F.lit(IMAGE).alias("width")).select("*", kinds)


#: A donor is a triangle at the corner of its raster; two pastes a raster, at places that may hang over any edge, by quarter turns.
CUT = "1 + k % 3 AS ax, 1 + k % 4 AS ay, 4 + k % 3 + k % 7 AS ex, 4 + k % 4 + k % 5 AS ey"
PLACE = "k AS raster_id, s AS seq, k + s AS donor, (k * 5 + s * 9) % 22 - 4 AS x, (k * 3 + s * 7) % 22 - 4 AS y, 2 + (k + s) % 7 AS width, 2 + (k * 3 + s) % 6 AS height, (k + s) % 4 AS turn"


@query(f"""WITH r AS (SELECT p_partkey AS k FROM part), cu AS (SELECT k AS donor, {CUT} FROM r), pl AS (SELECT {PLACE} FROM r, (SELECT unnest([1, 2]) AS s)),
    px AS (SELECT k, kind, channels, i // 16 AS y, i % 16 AS x FROM r, (SELECT unnest(range(256)) AS i), (SELECT unnest(['image', 'mask']) AS kind, unnest([3, 1]) AS channels)),
    lo AS (SELECT p.raster_id AS k, p.seq, p.donor, q.y, q.x, 2 * (q.y - p.y) - p.height + 1 AS v, 2 * (q.x - p.x) - p.width + 1 AS u, p.width, p.height, p.turn, cu.* EXCLUDE (donor)
        FROM pl p JOIN cu ON cu.donor = p.donor JOIN (SELECT k, y, x FROM px WHERE kind = 'mask') q ON q.k = p.raster_id AND q.y >= p.y AND q.y < p.y + p.height AND q.x >= p.x AND q.x < p.x + p.width),
    tu AS (SELECT *, CAST(floor((CASE turn WHEN 0 THEN v WHEN 1 THEN -u WHEN 2 THEN -v ELSE u END + height) / 2e0) AS BIGINT) AS sy,
        CAST(floor((CASE turn WHEN 0 THEN u WHEN 1 THEN v WHEN 2 THEN -u ELSE -v END + width) / 2e0) AS BIGINT) AS sx FROM lo),
    tr AS (SELECT donor, y, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT donor, y, unnest(range(ax, CAST(ceil(ex + (y + 0.5e0 - ay) * (ax - ex) / (ey - ay) - 0.5e0) AS BIGINT))) AS x
        FROM (SELECT *, unnest(range(ay, ey)) AS y FROM cu)) GROUP BY donor, y),
    bo AS (SELECT donor, min(x0) AS l0, min(y) AS t0, max(x1) - min(x0) AS pw, max(y) + 1 - min(y) AS ph FROM tr GROUP BY donor),
    so AS (SELECT tu.k, tu.seq, tu.donor, tu.y, tu.x, t0 + (2 * sy + 1) * ph // (2 * height) AS dy, bo.l0 + (2 * sx + 1) * pw // (2 * width) AS dx FROM tu JOIN bo ON bo.donor = tu.donor
        WHERE sy >= 0 AND sy < height AND sx >= 0 AND sx < width),
    sh AS (SELECT k, y, x, arg_max(struct_pack(k := so.donor, y := dy, x := dx), seq) AS o FROM so JOIN tr ON tr.donor = so.donor AND tr.y = dy AND dx >= tr.x0 AND dx < tr.x1 GROUP BY k, so.y, x),
    fi AS (SELECT px.k AS raster, px.kind, px.channels, px.y * 16 + px.x AS place, coalesce(o.k, px.k) AS k, coalesce(o.y, px.y) AS y, coalesce(o.x, px.x) AS x FROM px LEFT JOIN sh ON sh.k = px.k AND sh.y = px.y AND sh.x = px.x),
    va AS (SELECT raster, kind, c, place, CASE kind WHEN 'mask' THEN 1 + k % 4 ELSE {VALUE} END AS value FROM (SELECT *, unnest(range(channels)) AS c FROM fi))
    SELECT raster AS raster_id, kind, CAST(c AS INT) AS channel, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value * (place + 1)) AS BIGINT) AS places FROM va GROUP BY ALL""".replace("GROUP BY k, so.y, x", "GROUP BY so.k, so.y, so.x").replace("SELECT k, y, x, arg_max", "SELECT so.k AS k, so.y AS y, so.x AS x, arg_max"))
def pasted_rasters(spark, d):
    """Two triangles on each raster, image and mask alike; sums and sums by place of every channel."""
    rasters = _rasters(spark, d)
    parts = rasters.filter("kind = 'mask'").select(F.col("raster_id").alias("k"))
    corners = parts.selectExpr("k", *CUT.split(", "))
    point = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(point("ax", "ay"), point("ex", "ay"), point("ax", "ey"), point("ax", "ay"))
    pieces = U.cut_outs(rasters, corners.select(F.col("k").alias("raster_id"), F.col("k").alias("donor"), F.array(ring).alias("rings")))
    placed = parts.withColumn("s", F.explode(F.array(F.lit(1), F.lit(2)))).selectExpr(*_columns(PLACE)).selectExpr(
        "raster_id", "seq", "cast(donor AS string) AS donor", *[f"cast({c} AS int) AS {c}" for c in ("x", "y", "width", "height")], "turn * 90.0D AS angle")
    out = U.composite(rasters, placed, pieces)
    return _channel_sums(out)


def _columns(listed: str) -> list[str]:
    return [c.strip() for c in listed.split(", ")]


PREPARED = {
    "width": 64, "height": 64, "n": 4, "props": {"train": 0.8, "val": 0.1, "test": 0.1}, "strategy": "stratified", "augment": 50, "seed": 0,
    "grid": {"lr": [1e-2, 1e-3], "batch_size": [16, 32]}, "defaults": {"epochs": 50},
}
PREP_BLD = f"pb AS (SELECT {V.DISASTER} AS dis_id, tile_id, obj, {V.LABEL_KEY} AS label FROM poly), pt AS (SELECT {V.DISASTER} AS dis_id, tile_id FROM ({V.TILES_SQL}))"
PREP_COUNTS = "cnt AS (SELECT pt.dis_id, pt.tile_id, " + ", ".join(f"count(*) FILTER (label = '{k}') AS \"{k}\"" for k in L.BUILDING_KEYS) + " FROM pt LEFT JOIN pb ON pb.tile_id = pt.tile_id GROUP BY 1, 2)"
PREP_SPLITS = f"sp AS MATERIALIZED (SELECT split, dis_id, tile_id FROM ({ORACLES['split_stratified'].replace(COUNTS, PREP_COUNTS)}))"


@query(f"""WITH {MASKS}, {PREP_BLD}, {PREP_COUNTS}, {PREP_SPLITS}, tr AS (SELECT dis_id, tile_id FROM sp WHERE split = 'train'), {AREA_COUNTS}, {WEIGHTS},
    em AS (SELECT dis_id, count(*) AS n FROM tr WHERE tile_id NOT IN (SELECT tile_id FROM pb) GROUP BY dis_id),
    cl AS (WITH bd AS (SELECT pb.* FROM pb JOIN tr USING (tile_id)), {BALANCE} {CLONES}),
    po AS (SELECT dis_id, tile_id, row_number() OVER (ORDER BY {_hash(0, 'dis_id', 'tile_id')}, dis_id, tile_id) - 1 AS pos FROM tr),
    dr AS (SELECT draw, {_pick(0, '(SELECT count(*) FROM tr)', "'draw'", 'draw')} AS pos FROM (SELECT unnest(range(50)) AS draw)),
    pp AS (SELECT tile_id, lpad(CAST(CAST((y // 16) * 4 + x // 16 AS INT) AS VARCHAR), 3, '0') AS patch_id, count(*) AS pixels FROM gm GROUP BY 1, 2),
    mf AS (SELECT split, pixels FROM (SELECT *, lpad(CAST(unnest(range(16)) AS VARCHAR), 3, '0') AS patch_id FROM sp) LEFT JOIN pp USING (tile_id, patch_id)),
    ch AS ({V.CHANNELS_SQL}), st AS (SELECT tile_id, phase, channel, avg(v / 255e0) AS m FROM ch GROUP BY ALL)
    SELECT 'counts' AS stage, dis_id AS key, name, CAST(sum(v) AS BIGINT) AS n FROM (UNPIVOT cnt ON {QUOTED} INTO NAME name VALUE v) GROUP BY 2, 3
    UNION ALL SELECT 'masks', {V.DISASTER}, CAST(label AS VARCHAR), count(*) FROM gm GROUP BY 2, 3
    UNION ALL SELECT 'splits', dis_id, split, count(*) FROM sp GROUP BY 2, 3
    UNION ALL SELECT 'clones', dis_id, label, CAST(sum(gain * 1000 + clone) AS BIGINT) FROM cl GROUP BY 2, 3
    UNION ALL SELECT 'augmented', dis_id, CAST(tile_id AS VARCHAR), count(*) FROM dr JOIN po USING (pos) GROUP BY 2, 3
    UNION ALL SELECT 'statistics', phase, channel, CAST(sum(CAST(round(m * 1e4) AS BIGINT)) AS BIGINT) FROM st GROUP BY 2, 3
    UNION ALL SELECT 'patches', CAST(tile_id AS VARCHAR), patch_id, pixels FROM pp
    UNION ALL SELECT 'manifest', split, CASE WHEN pixels > 0 THEN 'built' ELSE 'empty' END, CAST(count(*) * 100000 + coalesce(sum(pixels), 0) AS BIGINT) FROM mf GROUP BY 2, 3
    UNION ALL SELECT 'weights', head, CAST(class AS VARCHAR), CAST(round(weight * 100) AS BIGINT) FROM w
    UNION ALL SELECT 'configs', CAST(j * 2 + i AS VARCHAR), CAST(bs AS VARCHAR), CAST(round(1 / lr) AS BIGINT) * 1000 + (SELECT CAST(round(sum(weight) * 100) AS BIGINT) FROM w)
        FROM (SELECT unnest([0, 1]) AS i, unnest([1e-2, 1e-3]) AS lr), (SELECT unnest([0, 1]) AS j, unnest([16, 32]) AS bs)""")
def preparation(spark, d):
    """All stages of a preparation, a few rows from each."""
    polys = V.with_wkt(V.polygons(spark, d)).selectExpr(f"{V.DISASTER} AS dis_id", "tile_id", "obj", "label", "wkt").withColumn("rings", G.wkt_rings(F.col("wkt"))).drop("wkt")
    tiles = V.tiles(spark, d).selectExpr(f"{V.DISASTER} AS dis_id", "tile_id")
    out = P.preparation(tiles, polys, V.channels(spark, d), PREPARED).run()
    both = sum((F.element_at(w, c) for w, n in (("weights_dmg", 5), ("weights_seg", 2)) for c in range(1, n + 1)), F.lit(0.0))
    width = F.col("x1") - F.col("x0")
    built = F.when(F.col("pixels") > 0, "built").otherwise("empty")
    counted = out["counts"].select("dis_id", F.inline(F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"`{k}`").alias("v")) for k in L.BUILDING_KEYS])))
    rows = {
        "counts": counted.groupBy("dis_id", "label").agg(F.sum("v")),
        "masks": out["masks"].groupBy("dis_id", "label").agg(F.sum(width)),
        "splits": out["splits"].groupBy("dis_id", "split").agg(F.count("*")),
        "clones": out["clones"].groupBy("dis_id", "label").agg(F.sum(F.col("gain") * 1000 + F.col("clone"))),
        "augmented": out["augmented"].groupBy("dis_id", "tile_id").agg(F.count("*")),
        "statistics": out["statistics"].groupBy("phase", "channel").agg(F.sum(F.round(F.col("mean") * 10000).cast("long"))),
        "patches": out["patches"].groupBy("tile_id", "patch_id").agg(F.sum(width)),
        "manifest": out["manifest"].groupBy("split", built.alias("b")).agg(F.count("*") * 100000 + F.sum("pixels")),
        "weights": out["weights"].select("head", "class", F.round(F.col("weight") * 100)),
        "configs": out["configs"].select("conf_id", "batch_size", F.round(1 / F.col("lr")) * 1000 + F.round(both * 100)),
    }
    found = None
    for stage, df in rows.items():
        one = df.toDF("key", "name", "n").select(F.lit(stage).alias("stage"), F.col("key").cast("string"), F.col("name").cast("string"), F.col("n").cast("long"))
        found = one if found is None else found.unionByName(one)
    return found


FOLDS = f"""fo AS (SELECT *, CAST(ntile(3) OVER (ORDER BY {_hash(0, 'px_id')}, px_id) - 1 AS INT) AS fold FROM sc)"""
SCALES = (0.0, 0.5, 1.0)


@query(f"""WITH {SC}, {FOLDS}, fs AS (SELECT unnest(range(3))::INT AS fold), wt AS (SELECT fs.fold, gt, round(sum(count(*)) OVER (PARTITION BY fs.fold) / CAST(count(*) AS DOUBLE), 2) AS weight FROM fs JOIN fo ON fo.fold <> fs.fold GROUP BY fs.fold, gt),
    me AS (SELECT wt.fold, [{", ".join(f"sum(logits[{i}] * weight) / sum(weight)" for i in range(1, 6))}] AS mean FROM wt JOIN fo ON fo.fold <> wt.fold AND fo.gt = wt.gt GROUP BY wt.fold),
    pr AS (SELECT conf, fo.fold, gt, list_transform(logits, lambda x, i: x - scale * mean[i]) AS v FROM fo JOIN me ON me.fold = fo.fold, (SELECT unnest(range({len(SCALES)}))::INT AS conf, unnest({list(SCALES)}) AS scale)),
    px AS (SELECT conf, fold, gt, CAST(list_position(v, list_max(v)) - 1 AS INT) AS pred FROM pr),
    o AS (SELECT conf, fold, class, sum(CASE WHEN gt = class AND pred = class THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN pred = class THEN 1 ELSE 0 END) AS p, sum(CASE WHEN gt = class THEN 1 ELSE 0 END) AS g
        FROM px, (SELECT unnest(range(5)) AS class) GROUP BY ALL),
    f AS (SELECT conf, fold, CASE WHEN p = 0 THEN 0e0 ELSE tp / p END AS pr, CASE WHEN g = 0 THEN 0e0 ELSE tp / g END AS re FROM o),
    h AS (SELECT conf, fold, count(*) / sum(1 / (CASE WHEN pr + re = 0 THEN 0e0 ELSE 2 * pr * re / (pr + re) END + 1e-10)) AS hf1 FROM f GROUP BY conf, fold)
    SELECT conf, fold, round(hf1, 6) AS hf1, conf = (SELECT conf FROM h ORDER BY hf1 DESC, conf, fold LIMIT 1) AS chosen FROM h""")
def parameter_search(spark, d):
    """A cross-validated search, weighted by class, that chooses its configuration."""
    rows = V.scores(spark, d).select("px_id", F.col("gt").alias("label"), "logits")
    found = E.grid_search(rows, lambda p, classes: E.CentredLogits(classes, **p), [{"scale": x} for x in SCALES], 3, ["px_id"])
    return rounded(found, "hf1")


@query(f"WITH {PX} SELECT gt, pred, count(*) AS n FROM px GROUP BY 1, 2")
def streamed_confusion(spark, d):
    """Pixels as a stream of files: it stops after the first half of them and is started again."""
    root = _folder(spark, "stream")
    pixels = V.pixels(spark, d).withColumn("half", F.pmod(F.xxhash64("tile_id"), F.lit(2)))
    for half in (0, 1):
        pixels.filter(F.col("half") == half).drop("half").repartition(3).write.mode("append").parquet(f"{root}/pixels")
        stream = read_pixel_stream(spark, f"{root}/pixels", "tile_id long, gt int, pred int", 1)
        upsert_confusion(stream, f"{root}/counts", f"{root}/checkpoint").awaitTermination()
    return confusion_now(spark, f"{root}/counts")


# ---------------------------------------------------------------- files and pixels of rasters

BROKEN = "tile_id % 140 = 0"


def _file_name(kind: str):
    return F.concat(F.expr(V.DISASTER), F.lit("_"), F.lpad(F.col("tile_id").cast("string"), 8, "0"), F.lit(kind))


@query(f"""WITH {MASKS} SELECT 'run' AS kind, tile_id, y, x0, x1, label FROM ({RUNS}) WHERE NOT {BROKEN}
    UNION ALL SELECT 'reject', tile_id, NULL, NULL, NULL, NULL FROM ({V.TILES_SQL}) WHERE {BROKEN}""")
def mask_files(spark, d):
    """Masks of all tiles written as pictures by the executors, some of them cut short; read by the image source, and turned into runs again."""
    folder = _folder(spark, "masks")
    rasters = D.masks_of_runs(_masks(spark, d)[0], V.tiles(spark, d), 64, 64, "tile_id")
    pictures = D.as_png(rasters, _file_name("_post_disaster_target.png"))
    tile = F.split("name", "_")[1].cast("long")
    cut = F.when(F.expr(BROKEN.replace("tile_id", "tile")), F.expr("substring(content, 1, 40)")).otherwise(F.col("content"))
    D.write_files(pictures.withColumn("tile", tile).withColumn("content", cut), folder)
    found = I.read_mask_runs(spark, folder)
    run = F.col("y") >= 0
    return found.select(F.when(run, "run").otherwise("reject").alias("kind"), J.file_key(F.col("path"))[1].cast("long").alias("tile_id"), *[F.when(run, F.col(c)).alias(c) for c in ("y", "x0", "x1", "label")])


@query(f"""WITH {POLY}, f AS (SELECT tile_id, CAST(obj AS VARCHAR) AS uid, {V.LABEL_KEY} AS subtype FROM poly) SELECT 'feature' AS kind, tile_id, uid, subtype FROM f WHERE NOT {BROKEN}
    UNION ALL SELECT DISTINCT 'reject', tile_id, NULL, NULL FROM f WHERE {BROKEN}""")
def label_files(spark, d):
    """Label files of both phases written by the executors, some cut short; only those of one phase are read."""
    folder = _folder(spark, "labels")
    feature = F.struct(F.col("wkt"), F.struct(F.lit("building").alias("feature_type"), F.expr(f"CASE WHEN phase = 'post' THEN {V.LABEL_KEY} END").alias("subtype"), F.col("obj").cast("string").alias("uid")).alias("properties"))
    polys = V.with_wkt(V.polygons(spark, d)).withColumn("phase", F.explode(F.array(F.lit("pre"), F.lit("post"))))
    files = polys.groupBy("tile_id", "phase").agg(F.to_json(F.struct(F.struct(F.collect_list(feature).alias("xy")).alias("features"))).alias("json"))
    cut = F.when(F.expr(BROKEN), F.expr("left(json, length(json) - 30)")).otherwise(F.col("json"))
    D.write_files(files.select(F.concat(_file_name("_"), "phase", F.lit("_disaster.json")).alias("name"), cut.alias("content")), folder)
    good = J.buildings_only(J.read_labels(spark, folder, "post")).select(F.lit("feature").alias("kind"), F.col("tile_id").cast("long").alias("tile_id"), "uid", "subtype")
    lost = J.label_rejects(spark, folder, "post").select(F.lit("reject").alias("kind"), J.file_key(F.col("path"))[1].cast("long").alias("tile_id"), *[F.lit(None).cast("string").alias(c) for c in ("uid", "subtype")])
    return good.unionByName(lost)


PIXELS = "px AS (SELECT p_partkey AS k, i // 16 AS y, i % 16 AS x, c FROM part, (SELECT unnest(range(256)) AS i), (SELECT unnest(range(3)) AS c))"


@query(f"""WITH {PIXELS}, v AS (SELECT k, c, ({VALUE}) / 255e0 AS v FROM px) SELECT k AS raster_id, CASE c WHEN 0 THEN 'B' WHEN 1 THEN 'G' ELSE 'R' END AS channel, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stdv FROM v GROUP BY k, c""")
def raster_statistics(spark, d):
    """Mean and deviation of every channel of every image, from whole-number partials of its bytes."""
    images = _rasters(spark, d).filter("kind = 'image'")
    return rounded(I.combine_partials(I.channel_partials(images, "raster_id"), "raster_id"), "mean", "stdv")


#: Augmentations that have an exact form: flips, shifts by whole pixels, quarter turns.
MOVES = "k % 2 = 0 AS flip_x, k % 3 = 0 AS flip_y, k % 7 - 3 AS dx, k % 5 - 2 AS dy, k % 4 AS turn"


@query(f"""WITH r AS (SELECT p_partkey AS k FROM part), mo AS (SELECT k, {MOVES} FROM r),
    px AS (SELECT k, i // 16 AS oy, i % 16 AS ox, mo.* EXCLUDE (k) FROM mo, (SELECT unnest(range(256)) AS i)),
    ce AS (SELECT *, 2 * (CASE WHEN flip_y THEN 15 - oy ELSE oy END) - 15 - 2 * dy AS v, 2 * (CASE WHEN flip_x THEN 15 - ox ELSE ox END) - 15 - 2 * dx AS u FROM px),
    so AS (SELECT k, oy, ox, (CASE turn WHEN 0 THEN v WHEN 1 THEN -u WHEN 2 THEN -v ELSE u END + 15) // 2 AS y, (CASE turn WHEN 0 THEN u WHEN 1 THEN v WHEN 2 THEN -u ELSE -v END + 15) // 2 AS x FROM ce),
    va AS (SELECT k, oy, ox, kind, c, CASE WHEN y < 0 OR y > 15 OR x < 0 OR x > 15 THEN 0 WHEN kind = 'mask' THEN 1 + k % 4 ELSE {VALUE} END AS value
        FROM so, (SELECT unnest(['image', 'image', 'image', 'mask']) AS kind, unnest([0, 1, 2, 0]) AS c))
    SELECT k AS raster_id, kind, CAST(c AS INT) AS channel, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value * (oy * 16 + ox + 1)) AS BIGINT) AS places FROM va GROUP BY ALL""")
def moved_rasters(spark, d):
    """Images and masks moved by one set of parameters each; masks hold no label that they didn't have."""
    rasters = _rasters(spark, d)
    still = {"pad": "0", "angle": "turn * 90.0D", "shift_x": "dx / 16.0D", "shift_y": "dy / 16.0D", "scale": "1.0D", "flip_x": "flip_x", "flip_y": "flip_y"}
    params = rasters.filter("kind = 'mask'").selectExpr("raster_id AS k").selectExpr("k", *_columns(MOVES)).selectExpr("k AS raster_id", *[f"{e} AS {n}" for n, e in still.items()])
    return _channel_sums(P.augment_geometry(rasters, params, "raster_id"))


def _channel_sums(rasters):
    """Sums and sums by place of every channel, taken raster by raster where the bytes are."""
    return I.placed_sums(rasters, "raster_id", "kind").groupBy("raster_id", "kind", "channel").agg(F.sum("total").alias("total"), F.sum("places").alias("places"))


FLAT = "(k * 37 + 11) % 256 AS r, (k * 53 + 7) % 256 AS g, (k * 71 + 3) % 256 AS b"
UK = lambda name: f"CAST({_pick(0, '1000001', repr(name), 'k')} AS DOUBLE) / 1000000"


@query(f"""WITH p AS (SELECT k, r, g, b, {UK('saturation')} * 0.8e0 + 0.6e0 AS sat, {UK('contrast')} * 0.5e0 + 0.75e0 AS con, {UK('brightness')} * 0.5e0 + 0.75e0 AS bri FROM (SELECT k, {FLAT} FROM (SELECT p_partkey AS k FROM part))),
    m AS (SELECT *, (r * bri + g * bri + b * bri) / 3 AS m FROM p), v AS (SELECT k, m, sat, con, unnest([0, 1, 2]) AS channel, unnest([r, g, b]) * bri AS v FROM m)
    SELECT k AS raster_id, channel, CAST(256 * greatest(0, least(255, round_even(m + ((v - m) * con + m - m) * sat, 0))) AS BIGINT) AS total FROM v""")
def coloured_rasters(spark, d):
    """Brightness, contrast, saturation and hue, in this order, on pictures of one colour; hue stays, since it has no short form in SQL."""
    three = F.hex(F.col("r").cast("long")), F.hex(F.col("g").cast("long")), F.hex(F.col("b").cast("long"))
    flat = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS k").selectExpr("k", *_columns(FLAT)).select(
        F.col("k").alias("raster_id"), F.lit("image").alias("kind"), F.lit(16).alias("height"), F.lit(16).alias("width"), F.lit(3).alias("channels"),
        F.unhex(F.repeat(F.concat(*[F.lpad(h, 2, "0") for h in three]), 256)).alias("data"))
    params = P.augmentation_params(flat.select("raster_id"), "raster_id").withColumn("hue", F.lit(0.0))
    return _channel_sums(P.augment_color(flat, params, "raster_id")).select("raster_id", "channel", "total")
