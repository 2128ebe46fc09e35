"""What is known of each missed target and each false positive at the reference point, with identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.functions import geometry as G
from fieldglass.operators import stats
from fieldglass.operators.contracts import ContractError
from fieldglass.plans.scratch import partitions
from fieldglass.scene import CLASSES

#: The combinations of class, confidence and overlap of a nearby candidate, in this order.
COMBINATIONS = tuple(f"{c}_class_{s}_confidence_{o}_overlap" for c in ("correct", "wrong") for s in ("high", "low") for o in ("sufficient", "poor"))
#: Those in which two or more things are amiss.
JOINTLY = ("wrong_class_low_confidence_sufficient_overlap", "wrong_class_high_confidence_poor_overlap", "wrong_class_low_confidence_poor_overlap", "correct_class_low_confidence_poor_overlap")
#: Non-exclusive flags and the combination that each stands for.
FLAGS = {
    "matching_conflict": "correct_class_high_confidence_sufficient_overlap",
    "low_confidence_detection": "correct_class_low_confidence_sufficient_overlap",
    "classification_error": "wrong_class_high_confidence_sufficient_overlap",
    "localization_failure": "correct_class_high_confidence_poor_overlap",
}
FP_FLAGS = ("duplicate_like", "same_class", "other_class")


def _holds(*combinations: str) -> Column:
    """Whether a candidate of one of these combinations was found: a bit for each, so that who only counts gathers no identifiers."""
    return F.col("found").bitwiseAND(F.lit(sum(1 << COMBINATIONS.index(c) for c in combinations))) > 0


def missed_targets(pairs: DataFrame, gts: DataFrame, matches: DataFrame, conf: int = 25, strong: float = 0.5, near: float = 0.1, tasks: int | None = None) -> DataFrame:
    """A row for each unmatched target, from one aggregate over its candidates.

    image_id, gt_id, class_id, primary; for each combination the sorted
    identifiers of its candidates; nearby (their number), found (a bit for each combination), best_iou over all
    candidates (0 without), best (the nearest one: pred_id, class_id, conf, iou; null
    without), competing (eligible predictions and the targets that they were
    matched with), and the flags.  tasks: over how many the images are dealt.
    """
    close, high, same, hit = F.col("iou") >= near, F.col("conf") >= conf, F.col("pc") == F.col("gc"), F.col("iou") >= strong
    number = F.when(same, 0).otherwise(4) + F.when(high, 0).otherwise(2) + F.when(hit, 0).otherwise(1)  # in COMBINATIONS
    # targets, matches and candidates move once, by image; a window tells candidates what took them, and one aggregate what each target has
    kinds = {c: pairs.schema[c].dataType for c in ("pred_id", "pc", "conf", "iou")}
    rows = gts.select("image_id", "gt_id", F.lit(0).alias("kind"), "class_id", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()], F.lit(None).cast("int").alias("combination"))
    nothing = F.lit(None).cast(gts.schema["class_id"].dataType).alias("class_id")
    taken = matches.select("image_id", "gt_id", F.lit(1).alias("kind"), nothing, "pred_id", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("pc", "conf", "iou")], F.lit(None).cast("int").alias("combination"))
    own = pairs.select("image_id", "gt_id", F.lit(2).alias("kind"), nothing, "pred_id", "pc", "conf", "iou", F.when(close, number).alias("combination"))
    rows = rows.unionByName(taken).unionByName(own).repartition(tasks or partitions(gts.sparkSession), "image_id")
    one_prediction = W.partitionBy("image_id", "pred_id")
    rows = rows.withColumn("assigned", F.max(F.when(F.col("kind") == 1, F.col("gt_id"))).over(one_prediction))
    eligible = F.col("combination") == COMBINATIONS.index(FLAGS["matching_conflict"])
    order = F.struct((-F.col("iou")).alias("i"), (-F.col("conf")).alias("c"), F.col("pred_id").alias("p"))
    ids = F.array_sort(F.collect_list(F.when(F.col("combination").isNotNull(), F.struct("pred_id", "combination"))))
    j = rows.groupBy("image_id", "gt_id").agg(
        F.max(F.when(F.col("kind") == 0, F.col("class_id"))).alias("class_id"),
        F.count_if(F.col("kind") == 0).alias("targets"),
        F.count_if(F.col("kind") == 1).alias("taken"),
        ids.alias("close"),
        F.count("combination").alias("nearby"),
        F.coalesce(F.bit_or(F.expr("shiftleft(1, combination)")), F.lit(0)).alias("found"),
        F.coalesce(F.max("iou"), F.lit(0.0)).alias("best_iou"),
        F.min_by(F.struct("pred_id", F.col("pc").alias("class_id"), "conf", "iou"), F.when((F.col("kind") == 2) & close, order)).alias("best"),
        F.array_sort(F.collect_list(F.when(eligible, F.struct("pred_id", "assigned")))).alias("competing"),
    )
    of = lambda i: F.transform(F.filter("close", lambda x: x["combination"] == i), lambda x: x["pred_id"])
    by_kind = [of(i).alias(c) for i, c in enumerate(COMBINATIONS)]
    j = j.where("targets > 0 and taken = 0").select("image_id", "gt_id", "class_id", *by_kind, "nearby", "found", "best_iou", "best", "competing")
    has = {f: _holds(c) for f, c in FLAGS.items()} | {"retained_nearby_candidate": F.col("nearby") > 0, "jointly_imperfect_candidate": _holds(*JOINTLY)}
    j = j.select("*", *[c.alias(f) for f, c in has.items()])
    alone = [f for f in FLAGS if f != "matching_conflict"]
    several = sum((F.col(f).cast("int") for f in alone), F.lit(0)) > 1
    primary = F.when(F.col("matching_conflict"), "matching_conflict").when(several, "mixed_or_unresolved")
    for f in alone:
        primary = primary.when(F.col(f), f)
    return j.withColumn("primary", primary.when(F.col("nearby") > 0, "mixed_or_unresolved").otherwise("complete_miss"))


def require_claimed(evidence: DataFrame) -> None:
    """Every eligible candidate of a missed target was matched with another one, else an error that names it."""
    bad = evidence.where(F.exists("competing", lambda c: c["assigned"].isNull())).limit(1).collect()
    if bad:
        raise ContractError(f"target {bad[0]['gt_id']} of image {bad[0]['image_id']} is unmatched and has an eligible prediction that is free")


def combination_counts(evidence: DataFrame) -> DataFrame:
    """kind (flag or combination), name, n: how many missed targets have each."""
    flags = [*FLAGS, "retained_nearby_candidate", "jointly_imperfect_candidate"]
    cells = [F.struct(F.lit("flag").alias("kind"), F.lit(f).alias("name"), F.col(f).alias("has")) for f in flags] + [F.struct(F.lit("combination").alias("kind"), F.lit(c).alias("name"), _holds(c).alias("has")) for c in COMBINATIONS]
    return evidence.select(F.explode(F.array(*cells)).alias("x")).groupBy("x.kind", "x.name").agg(F.count_if("x.has").alias("n"))


def fp_class_report(probes: DataFrame, classes: int = CLASSES) -> DataFrame:
    """class_id, dense, -1 for all: fp, its share of all, the flags' counts and the description of the confidence.

    probes: as from ``analysis.fp_probes``.
    """
    every = probes.withColumn("class_id", F.explode(F.array(F.col("class_id").cast("long"), F.lit(-1).cast("long"))))
    dense = probes.sparkSession.range(-1, classes).select(F.col("id").alias("class_id"))
    n = every.groupBy("class_id").agg(F.count("*").alias("fp"), *[F.count_if(f).alias(f) for f in FP_FLAGS])
    j = dense.join(n, "class_id", "left").na.fill(0, ["fp", *FP_FLAGS])
    j = stats.with_described(j, every, ["class_id"], {"conf_": F.col("conf")})
    total = F.max(F.when(F.col("class_id") == -1, F.col("fp"))).over(W.partitionBy())  # a row for each class
    return j.withColumn("share", F.round(G.percentage(F.col("fp"), total), 6))


def fp_context(preds: DataFrame, gts: DataFrame, pairs: DataFrame, probes: DataFrame) -> DataFrame:
    """image_id, pred_id, context_id: the target with which each false positive overlaps most, by identifier on ties, also without overlap; null in an image without targets."""
    best = pairs.join(probes.select("image_id", "pred_id"), ["image_id", "pred_id"], "left_semi").groupBy("image_id", "pred_id").agg(F.min_by("gt_id", F.struct((-F.col("iou")).alias("i"), "gt_id")).alias("best"), F.max("iou").alias("iou"))
    first = gts.groupBy("image_id").agg(F.min("gt_id").alias("first"))
    j = probes.select("image_id", "pred_id").join(best, ["image_id", "pred_id"], "left").join(first, "image_id", "left")
    return j.select("image_id", "pred_id", F.when(F.col("iou") > 0, F.col("best")).otherwise(F.col("first")).alias("context_id"))


def reconciled(preds: DataFrame, gts: DataFrame, matches: DataFrame, agnostic: DataFrame, evidence: DataFrame, probes: DataFrame, classes: DataFrame, sizes: DataFrame, bins: DataFrame, confusion: DataFrame, conf: int = 25) -> DataFrame:
    """identity, left_side, right_side, holds: counts of different results that must be equal.

    classes: class_id, tp, fp, fn, support; sizes: class_id (-1: all), support; bins:
    candidates; confusion: pred_0, pred_1, ...  The tables' counts are
    tagged, put together and added up in one aggregate.
    """
    tag = lambda d, name, n=None: d.select(F.lit(name).alias("fact"), (F.lit(1) if n is None else n).cast("long").alias("n"))
    kept = preds.where(F.col("conf") >= conf)
    with_targets = preds.join(gts.select("image_id").distinct(), "image_id", "left_semi")
    cells = sum((F.col(c) for c in confusion.columns if c.startswith("pred_")), F.lit(0))
    facts = [
        tag(matches, "tp"), tag(gts, "targets"), tag(kept, "kept"), tag(agnostic, "agnostic"), tag(evidence, "missed"), tag(evidence.where("primary is not null"), "categorised"), tag(probes, "fp"), tag(with_targets, "candidates"),
        tag(probes.where("annotated"), "fp_annotated"), tag(probes.where("not annotated"), "fp_empty"), tag(classes, "class_tp", F.col("tp")), tag(classes, "class_fp", F.col("fp")), tag(classes, "class_fn", F.col("fn")),
        tag(classes, "class_support", F.col("support")), tag(sizes.where("class_id >= 0"), "size_support", F.col("support")), tag(bins, "binned", F.col("candidates")), tag(confusion, "confused", cells),
    ]
    every = facts[0]
    for f in facts[1:]:
        every = every.unionByName(f)
    names = sorted({"tp", "targets", "kept", "agnostic", "missed", "categorised", "fp", "candidates", "fp_annotated", "fp_empty", "class_tp", "class_fp", "class_fn", "class_support", "size_support", "binned", "confused"})
    one = every.agg(*[F.coalesce(F.sum(F.when(F.col("fact") == n, F.col("n"))), F.lit(0)).alias(n) for n in names])
    c = F.col
    identities = {
        "targets": (c("tp") + c("missed"), c("targets")),
        "predictions": (c("tp") + c("fp"), c("kept")),
        "class_totals": (c("class_tp") + c("class_fp") + c("class_fn"), c("tp") + c("fp") + c("missed")),
        "class_support": (c("class_support"), c("targets")),
        "size_groups": (c("size_support"), c("targets")),
        "confidence_bins": (c("binned"), c("candidates")),
        "class_confusion": (c("confused"), c("agnostic")),
        "taxonomy": (c("categorised"), c("targets") - c("tp")),
        "fp_groups": (c("fp_annotated") + c("fp_empty"), c("fp")),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("identity"), a.alias("left_side"), b.alias("right_side"), (a == b).alias("holds")) for n, (a, b) in identities.items()])
    return one.select(F.inline(rows))
