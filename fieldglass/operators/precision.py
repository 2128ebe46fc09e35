"""Average precision at ten overlap thresholds, by class and macro mean.

Per image the best ``most`` predictions above the floor; for a class and a
threshold, pairs in falling order of overlap, the first kept per prediction and
then per target.  The best target of a prediction is the same at all thresholds
that it reaches, so a prediction has one number: how many thresholds it hits.

Predictions are sorted by range of (class, confidence) once, and counted in
their parts: a hit's rank and its number among the hits of each threshold come
from its part, the parts' totals are a row for each part and class.  The
precision envelope is read at 101 recalls.  Between two hits it is a line, and
recalls are whole hits over the support, so it is wanted at the two hits
around each mark alone: the greatest precision between two wanted hits is
an aggregate, and what follows works on 202 rows for each class and threshold at most.
Behind the last recall the line declines to (1, 0) (``sentinel``) or drops at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.functions import geometry as G
from fieldglass.plans.scratch import partitions, stage

FLOOR, MOST = 0.1, 300
THRESHOLDS = tuple(50 + 5 * k for k in range(10))


def reached(preds: DataFrame, gts: DataFrame, floor: float = FLOOR, most: int = MOST) -> DataFrame:
    """image_id, pred_id, class_id, conf, reach (how many thresholds the prediction hits) of the kept predictions.

    One exchange: an image's predictions and targets are gathered together.
    """
    corners = ("x0", "y0", "x1", "y1")
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in corners]).alias("box")
    pick = F.struct((-F.col("conf")).alias("c"), F.col("pred_id").alias("id"), F.col("class_id").cast("long").alias("k"), box)
    aim = F.struct(F.col("gt_id").cast("long").alias("id"), F.col("class_id").cast("long").alias("k"), box)
    rows = preds.where(F.col("conf") > floor).select("image_id", pick.alias("p"), F.lit(None).alias("g")).unionByName(gts.select("image_id", F.lit(None).alias("p"), aim.alias("g")))
    per = rows.groupBy("image_id").agg(F.slice(F.array_sort(F.collect_list("p")), 1, most).alias("ps"), F.collect_list("g").alias("gs")).where(F.size("ps") > 0)
    least = THRESHOLDS[0] / 100.0
    side = lambda s: {c: s["box"][c] for c in corners}

    def best(p: Column) -> Column:
        """The prediction with its best target: overlap and, negated, identifier; null below the least threshold."""
        fits = F.transform(F.filter("gs", lambda g: g["k"] == p["k"]), lambda g: F.struct(G.overlap(side(p), side(g)).alias("iou"), (-g["id"]).alias("no")))
        return F.struct(p["c"].alias("c"), p["id"].alias("id"), p["k"].alias("k"), F.array_max(F.filter(fits, lambda f: f["iou"] >= least)).alias("b"))

    taken = per.select("image_id", F.transform("ps", best).alias("ps"))

    def reach(p: Column) -> Column:
        better = F.exists("ps", lambda o: (o["b"]["no"] == p["b"]["no"]) & ((o["b"]["iou"] > p["b"]["iou"]) | ((o["b"]["iou"] == p["b"]["iou"]) & (o["id"] < p["id"]))))
        hit = F.when(p["b"].isNull() | better, 0).otherwise(F.size(F.filter(F.array(*[F.lit(t / 100.0) for t in THRESHOLDS]), lambda t: p["b"]["iou"] >= t)))
        return F.struct(p["id"].alias("pred_id"), p["k"].alias("class_id"), (-p["c"]).alias("conf"), hit.alias("reach"))

    return taken.select("image_id", F.inline(F.transform("ps", reach)))


def reached_by_pairs(pairs: DataFrame, preds: DataFrame, floor: float = FLOOR, most: int = MOST) -> DataFrame:
    """As ``reached``, from pairs (image_id, pred_id, gt_id, pc, gc, iou) whose overlaps are known instead of boxes."""
    rank = F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("conf"), "pred_id"))
    kept = preds.where(F.col("conf") > floor).withColumn("r", rank).where(F.col("r") <= most).select("image_id", "pred_id", "class_id", "conf")
    key = ["image_id", "pred_id"]
    same = pairs.where((F.col("pc") == F.col("gc")) & (F.col("iou") >= THRESHOLDS[0] / 100.0)).join(kept.select(*key), key, "left_semi")
    first = same.groupBy(*key).agg(F.max(F.struct("iou", (-F.col("gt_id")).alias("no"))).alias("b")).select(*key, "b.iou", "b.no")
    hit = first.groupBy("image_id", "no").agg(F.max(F.struct("iou", (-F.col("pred_id")).alias("p"))).alias("b"))
    passed = F.size(F.filter(F.array(*[F.lit(t / 100.0) for t in THRESHOLDS]), lambda t: F.col("b.iou") >= t))
    j = kept.join(hit.select("image_id", (-F.col("b.p")).cast(kept.schema["pred_id"].dataType).alias("pred_id"), passed.alias("reach")), key, "left")
    return j.select(*key, F.col("class_id").cast("long").alias("class_id"), "conf", F.coalesce("reach", F.lit(0)).alias("reach"))


_COUNTED = "part int, class_id long, n long, tp array<long>, reach int"


def _counted(batches):
    """Sorted (part, class_id, reach): each hit with its place and its numbers in the part; and, with reach null, the totals of each class."""
    part, cls, n, tp = None, None, 0, np.zeros(len(THRESHOLDS), np.int64)

    def rows(classes, places, numbers, reaches):
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1, dtype=np.int32) * len(THRESHOLDS)), pa.array(np.ascontiguousarray(numbers).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(places), part, np.int32)), pa.array(classes), pa.array(places), flat, pa.array(reaches, pa.int32())], ["part", "class_id", "n", "tp", "reach"])

    for b in batches:
        classes, reach = b.column("class_id").to_numpy(), b.column("reach").to_numpy()
        if not len(classes):
            continue
        part = b.column("part")[0].as_py()
        cuts = np.flatnonzero(np.diff(classes)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(classes)], strict=True):
            if cls is not None and classes[lo] != cls:
                yield rows(np.array([cls]), np.array([n]), tp[None, :], [None])
                n, tp = 0, np.zeros(len(THRESHOLDS), np.int64)
            cls, own = classes[lo], reach[lo:hi]
            numbers = tp + (own[:, None] > np.arange(len(THRESHOLDS))[None, :]).cumsum(axis=0)
            hit = np.flatnonzero(own > 0)
            if len(hit):
                yield rows(np.full(len(hit), cls), n + hit + 1, numbers[hit], own[hit].astype(np.int32))
            n, tp = n + hi - lo, numbers[-1]
    if cls is not None:
        yield rows(np.array([cls]), np.array([n]), tp[None, :], [None])


def average_precision(pairs: DataFrame | None, preds: DataFrame, gts: DataFrame, sentinel: bool = True, floor: float = FLOOR, most: int = MOST) -> DataFrame:
    """class_id, threshold, support, ap for classes with targets.

    Without ``pairs`` the overlaps come from the boxes of ``preds`` and ``gts``.
    """
    spark = preds.sparkSession
    support = gts.groupBy(F.col("class_id").cast("long").alias("class_id")).agg(F.count("*").alias("support"))
    order = ["class_id", F.desc("conf"), "image_id", "pred_id"]
    found = reached(preds, gts, floor, most) if pairs is None else reached_by_pairs(pairs, preds, floor, most)
    # written, for a sort by range reads its input twice
    sorted_ = stage(found, "reached").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    counted = stage(sorted_.select(F.spark_partition_id().alias("part"), "class_id", "reach").mapInArrow(_counted, _COUNTED), "hits")
    # what lies in the parts before: a row for each part and class
    before = W.partitionBy("class_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ks = range(len(THRESHOLDS))
    totals = counted.where("reach is null").select("class_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.array(*[F.coalesce(F.sum(F.col("tp")[k]).over(before), F.lit(0)) for k in ks]).alias("tp0"))
    hits = counted.where("reach is not null").join(totals, ["class_id", "part"]).join(support, "class_id")
    each = hits.select("class_id", "support", (F.col("n") + F.col("n0")).alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.col("reach") - 1), lambda k: F.struct(k.alias("k"), (F.get("tp", k) + F.get("tp0", k)).alias("j")))).alias("h")).select("class_id", "support", "n", "h.k", "h.j")
    # the last hit at or before j that a mark wants: the one at the mark's recall or below, or the one behind it
    mark = F.least(F.lit(100).cast("long"), F.expr("(100 * (j + 1) - 1) div support"))
    at = F.expr("(mark * support) div 100")
    wanted = each.withColumn("mark", mark).withColumn("at", at).withColumn("at", F.when(F.col("j") > F.col("at"), F.col("at") + 1).otherwise(F.col("at")))
    tops = wanted.groupBy("class_id", "k", "at").agg(F.max(F.col("j") / F.col("n")).alias("top"), F.max("j").alias("last"), F.max_by(F.col("j") / F.col("n"), "j").alias("tail"))
    behind = W.partitionBy("class_id", "k").orderBy(F.desc("at"))
    envelope = tops.select("class_id", "k", "at", F.max("top").over(behind).alias("y"), "last", "tail")
    curve = envelope.groupBy("class_id", "k").agg(F.map_from_entries(F.collect_list(F.struct("at", "y"))).alias("ys"), F.max("last").alias("hits"), F.max_by("tail", "last").alias("tail")).join(support, "class_id")

    def value(k: Column) -> Column:
        """The curve at the recall k / 100."""
        i = F.call_function("div", k.cast("long") * F.col("support"), F.lit(100).cast("long"))
        x, low = k / 100.0, i / F.col("support")
        y, z = F.element_at("ys", i), F.element_at("ys", i + 1)
        # behind the last hit, on the line down to (1, 0)
        low_ = F.col("hits") / F.col("support")
        end = F.coalesce(F.col("tail") * (1 - F.try_divide(x - low_, 1 - low_)), F.lit(0.0)) if sentinel else F.lit(0.0)
        return F.when(i == 0, F.element_at("ys", F.lit(1).cast("long"))).when(i < F.col("hits"), y + (z - y) * (x - low) * F.col("support")).otherwise(end)

    area = F.aggregate(F.sequence(F.lit(0), F.lit(99)), F.lit(0.0), lambda s, k: s + value(k) * F.when(k == 0, 0.005).otherwise(0.01))
    done = curve.select("class_id", "k", area.alias("ap"))
    cut = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("threshold")) for k, t in enumerate(THRESHOLDS)])
    return support.select("class_id", "support", F.inline(cut)).join(done, ["class_id", "k"], "left").na.fill(0.0, ["ap"]).select("class_id", "threshold", "support", "ap")
