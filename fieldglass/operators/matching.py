"""One-to-one assignment of predictions to targets, and what follows from it.

Predictions in falling order of confidence each take the free target of their
image with the greatest overlap.  Pairs come from an equi join on the image;
that boxes touch is its residual predicate, so pairs apart are never rows.  An
image's sorted pairs are folded by ``aggregate``, in the partitions that the
join made.  Lists are as long as an image has pairs, whatever the number of
images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import geometry as G
from fieldglass.scene import CLASSES, REFERENCE, Point


def overlaps(preds: DataFrame, gts: DataFrame, apart: bool = False) -> DataFrame:
    """Pairs of a prediction and a target in an image that overlap, with their overlap; with ``apart`` all pairs."""
    v = G.overlap(G.corners("p"), G.corners("g"))
    on = F.col("p.image_id") == F.col("g.image_id")
    if not apart:
        on = on & (F.col("p.x0") < F.col("g.x1")) & (F.col("g.x0") < F.col("p.x1")) & (F.col("p.y0") < F.col("g.y1")) & (F.col("g.y0") < F.col("p.y1"))
    return preds.alias("p").join(gts.alias("g"), on).select(F.col("p.image_id").alias("image_id"), "p.pred_id", "g.gt_id", F.col("p.class_id").alias("pc"), F.col("g.class_id").alias("gc"), "p.conf", v.alias("iou"))


def _match_type(pairs: DataFrame) -> str:
    kind = lambda c: pairs.schema[c].dataType.simpleString()
    return f"struct<pred_id:{kind('pred_id')},gt_id:{kind('gt_id')},iou:double>"


def _sorted_pairs() -> Column:
    """An image's pairs in the order of assignment: by confidence, prediction, overlap, target."""
    pair = F.struct((-F.col("conf")).alias("c"), F.col("pred_id").alias("pred_id"), (-F.col("iou")).alias("k"), F.col("gt_id").alias("gt_id"), F.col("iou").alias("iou"), (F.col("pc") == F.col("gc")).alias("same"))
    return F.array_sort(F.collect_list(pair))


def _fold(ps: Column, match: str) -> Column:
    """Matches of an image's sorted pairs: a pair is one if neither its prediction nor its target is taken."""

    def take(found: Column, p: Column) -> Column:
        taken = F.exists(found, lambda m: (m["pred_id"] == p["pred_id"]) | (m["gt_id"] == p["gt_id"]))
        return F.when(taken, found).otherwise(F.concat(found, F.array(F.struct(p["pred_id"], p["gt_id"], p["iou"]).cast(match))))

    return F.aggregate(ps, F.expr(f"cast(array() as array<{match}>)"), take)


def assign(pairs: DataFrame, point: Point = REFERENCE) -> DataFrame:
    """image_id, pred_id, gt_id, iou of every match; pairs as from ``overlaps``, whose partitioning by image serves here, too."""
    kept = pairs.where((F.col("conf") >= point.confidence) & (F.col("iou") >= point.overlap))
    if point.aware:
        kept = kept.where("pc = gc")
    rows = kept.groupBy("image_id").agg(_sorted_pairs().alias("ps"))
    return rows.select("image_id", F.explode(_fold(F.col("ps"), _match_type(pairs))).alias("m")).select("image_id", "m.pred_id", "m.gt_id", "m.iou")


def totals(matches: DataFrame, preds: DataFrame, gts: DataFrame, point: Point = REFERENCE) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1."""
    n = matches.agg(F.count("*").alias("tp"))
    p = preds.where(F.col("conf") >= point.confidence).agg(F.count("*").alias("np"))
    g = gts.agg(F.count("*").alias("ng"))
    row = n.crossJoin(p).crossJoin(g).select("tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"))
    return row.select("*", *[c.alias(k) for k, c in G.metrics(F.col("tp"), F.col("fp"), F.col("fn")).items()])


#: The two grids of operating points: overlaps at two confidences, and confidences at one overlap.
GRIDS = {
    "overlap": [Point(c, o, a) for a in (True, False) for c in (5, 25) for o in (0.1, 0.3, 0.5)],
    "confidence": [Point(c, 0.5, a) for a in (True, False) for c in (1, 5, 10, 25, 50)],
}


def grid(pairs: DataFrame, preds: DataFrame, gts: DataFrame, points: list[Point]) -> DataFrame:
    """Totals at every point: an image's candidate lists are sorted once and folded for each point."""
    spark = pairs.sparkSession
    numbered = list(dict.fromkeys(points))
    params = spark.createDataFrame([(i, p.aware, p.confidence, p.overlap) for i, p in enumerate(numbered)], "i int, aware boolean, min_conf int, min_iou double")
    cut = pairs.where((F.col("iou") >= min(p.overlap for p in numbered)) & (F.col("conf") >= min(p.confidence for p in numbered)))
    rows = cut.groupBy("image_id").agg(_sorted_pairs().alias("ps"))
    match = _match_type(pairs)

    def hits(p: Point) -> Column:
        fits = lambda x: (-x["c"] >= p.confidence) & (x["iou"] >= p.overlap) & (x["same"] if p.aware else F.lit(True))
        return F.sum(F.size(_fold(F.filter("ps", fits), match)))

    tp = rows.agg(*[hits(p).alias(f"t{i}") for i, p in enumerate(numbered)]).select(F.posexplode(F.array(*[F.col(f"t{i}") for i in range(len(numbered))])).alias("i", "tp"))
    kept = preds.agg(*[F.count_if(F.col("conf") >= p.confidence).alias(f"n{i}") for i, p in enumerate(numbered)]).select(F.posexplode(F.array(*[F.col(f"n{i}") for i in range(len(numbered))])).alias("i", "np"))
    all_ = params.join(F.broadcast(kept), "i").join(F.broadcast(tp), "i").crossJoin(gts.agg(F.count("*").alias("ng")))
    t = F.coalesce("tp", F.lit(0))
    row = all_.select("aware", "min_conf", "min_iou", t.alias("tp"), (F.col("np") - t).alias("fp"), (F.col("ng") - t).alias("fn"))
    return row.select("*", *[c.alias(k) for k, c in G.metrics(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def grids(pairs: DataFrame, preds: DataFrame, gts: DataFrame, named: dict[str, list[Point]] | None = None) -> DataFrame:
    """The rows of ``grid`` for several grids, each under its name; points that grids share are worked out once."""
    named = named or GRIDS
    every = grid(pairs, preds, gts, [p for ps in named.values() for p in ps])
    rows = [(g, p.aware, p.confidence, p.overlap) for g, ps in named.items() for p in ps]
    which = pairs.sparkSession.createDataFrame(rows, "grid string, aware boolean, min_conf int, min_iou double")
    return which.join(F.broadcast(every), ["aware", "min_conf", "min_iou"])


def taxonomy(pairs: DataFrame, gts: DataFrame, matches: DataFrame, conf: int = 25, strong: float = 0.5, near: float = 0.1) -> DataFrame:
    """Every unmatched target with its primary category and non-exclusive flags."""
    missed = gts.join(matches, ["image_id", "gt_id"], "left_anti").select("image_id", "gt_id", "class_id")
    c, v, same = F.col("conf") >= conf, F.col("iou"), F.col("pc") == F.col("gc")
    hit, low = v >= strong, (v >= near) & (v < strong)
    any_ = lambda x, name: F.coalesce(F.bool_or(x), F.lit(False)).alias(name)
    flags = pairs.join(missed.select("image_id", "gt_id"), ["image_id", "gt_id"], "left_semi").groupBy("image_id", "gt_id").agg(
        any_(same & c & hit, "matching_conflict"),
        any_(same & ~c & hit, "low_confidence_detection"),
        any_(~same & c & hit, "classification_error"),
        any_(same & c & low, "localization_failure"),
        any_(v >= near, "retained_nearby_candidate"),
        any_((~same & ~c & hit) | (~same & c & low) | (same & ~c & low) | (~same & ~c & low), "jointly_imperfect_candidate"),
        F.max("iou").alias("best_retained_iou"),
    )
    names = ["matching_conflict", "low_confidence_detection", "classification_error", "localization_failure", "retained_nearby_candidate", "jointly_imperfect_candidate"]
    full = missed.join(flags, ["image_id", "gt_id"], "left").na.fill(False, names).na.fill(0.0, ["best_retained_iou"])
    three = [F.col(n).cast("int") for n in names[1:4]]
    count = three[0] + three[1] + three[2]
    primary = (
        F.when(F.col("matching_conflict"), "matching_conflict")
        .when(count > 1, "mixed_or_unresolved")
        .when(F.col("low_confidence_detection"), "low_confidence_detection")
        .when(F.col("classification_error"), "classification_error")
        .when(F.col("localization_failure"), "localization_failure")
        .when(F.col("retained_nearby_candidate"), "mixed_or_unresolved")
        .otherwise("complete_miss")
    )
    return full.withColumn("primary", primary)


def confusion(agnostic: DataFrame, preds: DataFrame, gts: DataFrame) -> DataFrame:
    """Target class by predicted class of class-agnostic matches, dense."""
    j = agnostic.join(gts.select("image_id", "gt_id", F.col("class_id").alias("gc")), ["image_id", "gt_id"]).join(preds.select("image_id", "pred_id", F.col("class_id").alias("pc")), ["image_id", "pred_id"])
    dense = agnostic.sparkSession.range(CLASSES).select(F.col("id").alias("gc"))
    counts = j.groupBy("gc").agg(*[F.count_if(F.col("pc") == c).alias(f"pred_{c}") for c in range(CLASSES)])
    return dense.join(counts, "gc", "left").na.fill(0).withColumnRenamed("gc", "class_id")


def false_positives(pairs: DataFrame, preds: DataFrame, gts: DataFrame, matches: DataFrame, conf: int = 25) -> DataFrame:
    """Retained predictions without a match, and whether their image has targets."""
    has = gts.select("image_id").distinct().withColumn("annotated", F.lit(True))
    fp = preds.where(F.col("conf") >= conf).join(matches, ["image_id", "pred_id"], "left_anti")
    return fp.join(has, "image_id", "left").withColumn("annotated", F.coalesce("annotated", F.lit(False)))


def overlapping_predictions(preds: DataFrame, fps: DataFrame, conf: int = 25, least: float = 0.5) -> DataFrame:
    """Unordered pairs of retained predictions that overlap, one a false positive at least."""
    flag = fps.select("image_id", "pred_id").withColumn("fp", F.lit(True))
    kept = preds.where(F.col("conf") >= conf).join(flag, ["image_id", "pred_id"], "left").withColumn("fp", F.coalesce("fp", F.lit(False)))
    a, b = kept.alias("a"), kept.alias("b")
    return (
        a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.pred_id") < F.col("b.pred_id")) & (F.col("a.fp") | F.col("b.fp")))
        .where(G.overlap(G.corners("a"), G.corners("b")) >= least)
        .select(F.col("a.image_id").alias("image_id"), F.col("a.pred_id").alias("first_id"), F.col("b.pred_id").alias("second_id"), (F.col("a.class_id") == F.col("b.class_id")).alias("same_class"))
    )


def best_overlap(pairs: DataFrame, preds: DataFrame, gts: DataFrame) -> DataFrame:
    """Per prediction of an annotated image: greatest overlap, any and same class."""
    top = pairs.groupBy("image_id", "pred_id").agg(F.max("iou").alias("any_iou"), F.max(F.when(F.col("pc") == F.col("gc"), F.col("iou"))).alias("same_iou"))
    own = preds.join(gts.select("image_id").distinct(), "image_id", "left_semi")
    return own.join(top, ["image_id", "pred_id"], "left").na.fill(0.0, ["any_iou", "same_iou"])


def cases(preds: DataFrame, gts: DataFrame, sized: DataFrame) -> DataFrame:
    """The pools of the case sampler: category, image_id, gt_id, pred_id, class_id, size_group, duplicate_like.

    sized: image_id, gt_id, size_group of every target.
    """
    key = ["image_id", "gt_id"]
    every = overlaps(preds, gts, apart=True)
    pairs = every.where("iou > 0")
    sure, any_class = assign(pairs), assign(pairs, Point(aware=False))
    first = F.struct((-F.col("iou")).alias("i"), (-F.col("conf")).alias("c"), F.col("pred_id").alias("pred_id"))
    same, strong = F.col("pc") == F.col("gc"), F.col("conf") >= REFERENCE.confidence
    fits = (
        F.when(F.col("category") == "low_confidence_detection", same & ~strong & (F.col("iou") >= REFERENCE.overlap))
        .when(F.col("category") == "localization_failure", same & strong & (F.col("iou") >= 0.1) & (F.col("iou") < REFERENCE.overlap))
        .otherwise(F.lit(True))
    )
    missed = taxonomy(pairs, gts, sure).select(*key, "class_id", F.col("primary").alias("category"))
    shown = every.join(missed, key).where(fits).groupBy(*key).agg(F.min(first)["pred_id"].alias("pred_id"))
    missed = missed.join(shown, key, "left").withColumn("duplicate_like", F.lit(False))

    fps = false_positives(pairs, preds, gts, sure)
    nearest = every.groupBy("image_id", "pred_id").agg(F.min(F.struct((-F.col("iou")).alias("i"), F.col("gt_id").alias("gt_id"), F.col("gc").alias("gc"))).alias("t"))
    hit = preds.join(sure.select("image_id", "pred_id"), ["image_id", "pred_id"], "left_semi").alias("b")
    a = fps.alias("a")
    twice = a.join(hit, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.class_id") == F.col("b.class_id")))
    twice = twice.where(G.overlap(G.corners("a"), G.corners("b")) >= 0.5).select("a.image_id", "a.pred_id").distinct().withColumn("duplicate_like", F.lit(True))
    false = fps.join(nearest, ["image_id", "pred_id"], "left").join(twice, ["image_id", "pred_id"], "left")
    false = false.select(
        "image_id", F.col("t.gt_id").alias("gt_id"), F.coalesce("t.gc", "class_id").alias("class_id"), F.when(F.col("annotated"), "fp_annotated").otherwise("fp_empty_label").alias("category"), "pred_id", F.coalesce("duplicate_like", F.lit(False)).alias("duplicate_like")
    )

    def matched(found: DataFrame, category: str) -> DataFrame:
        both = found.join(pairs.select("image_id", "gt_id", "pred_id", "pc", "gc"), [*key, "pred_id"])
        kept = both.where("pc <> gc") if category == "wrong_class_geometric_match" else both
        return kept.select(*key, F.col("gc").alias("class_id"), F.lit(category).alias("category"), "pred_id", F.lit(False).alias("duplicate_like"))

    out = missed.unionByName(false).unionByName(matched(any_class, "wrong_class_geometric_match")).unionByName(matched(sure, "successful_detection"))
    return out.join(sized.select(*key, "size_group"), key, "left").select("category", "image_id", F.col("gt_id").cast("long").alias("gt_id"), F.col("pred_id").cast("long").alias("pred_id"), "class_id", "size_group", "duplicate_like")
