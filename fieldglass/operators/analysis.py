"""Tables of an error analysis and of a dataset's difficulty, from matches, boxes and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.functions import geometry as G
from fieldglass.operators import stats
from fieldglass.scene import CLASSES

#: The categories of a missed target, in their order.
CATEGORIES = ("complete_miss", "localization_failure", "low_confidence_detection", "classification_error", "matching_conflict", "mixed_or_unresolved")
LOW_SUPPORT = 30


def _classes(df: DataFrame, classes: int = CLASSES) -> DataFrame:
    return df.sparkSession.range(classes).select(F.col("id").alias("class_id"))


def fp_probes(preds: DataFrame, gts: DataFrame, matches: DataFrame, pairs: DataFrame, conf: int = 25, least: float = 0.5) -> DataFrame:
    """Each false positive with what other retained predictions of its image overlap it.

    image_id, pred_id, class_id, conf, annotated, best_iou (null without
    targets), duplicate_like (a matched one of its class), same_class, other_class.
    """
    hit = matches.select("image_id", "pred_id", F.lit(True).alias("hit"))
    kept = preds.where(F.col("conf") >= conf).join(hit, ["image_id", "pred_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    fps = kept.where(~F.col("hit"))
    a, b = fps.alias("a"), kept.alias("b")
    touch = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.pred_id") != F.col("b.pred_id")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    near = a.join(b, touch).where(G.overlap(G.corners("a"), G.corners("b")) >= least)
    same = F.col("a.class_id") == F.col("b.class_id")
    flags = near.groupBy(F.col("a.image_id").alias("image_id"), F.col("a.pred_id").alias("pred_id")).agg(F.bool_or(same & F.col("b.hit")).alias("duplicate_like"), F.bool_or(same).alias("same_class"), F.bool_or(~same).alias("other_class"))
    best = pairs.groupBy("image_id", "pred_id").agg(F.max("iou").alias("iou"))
    has = gts.select("image_id").distinct().withColumn("annotated", F.lit(True))
    out = fps.select("image_id", "pred_id", "class_id", "conf").join(flags, ["image_id", "pred_id"], "left").join(has, "image_id", "left").join(best, ["image_id", "pred_id"], "left")
    out = out.na.fill(False, ["duplicate_like", "same_class", "other_class", "annotated"])
    return out.withColumn("best_iou", F.when(F.col("annotated"), F.coalesce("iou", F.lit(0.0)))).drop("iou")


def fp_image_groups(probes: DataFrame, images: DataFrame, gts: DataFrame) -> DataFrame:
    """Annotated and empty-label images: counts, rates and the description of their false positives' confidence."""
    has = gts.select("image_id").distinct().withColumn("annotated", F.lit(True))
    all_ = images.select("image_id").join(has, "image_id", "left").na.fill(False, ["annotated"])
    groups = images.sparkSession.createDataFrame([(True,), (False,)], "annotated boolean")
    n = all_.groupBy("annotated").agg(F.count("*").alias("images"))
    fp = probes.groupBy("annotated").agg(F.count("*").alias("fp"), F.count_distinct("image_id").alias("images_with_fp"))
    j = groups.join(n, "annotated", "left").join(fp, "annotated", "left").na.fill(0, ["images", "fp", "images_with_fp"])
    j = stats.with_described(j, probes, ["annotated"], {"conf_": F.col("conf")})
    total = F.sum("fp").over(W.partitionBy())  # two rows
    r = lambda c: F.round(c, 9)
    return j.select(
        "*",
        r(G.percentage(F.col("fp"), total)).alias("percentage_of_fp"),
        r(G.percentage(F.col("images_with_fp"), F.col("images"))).alias("percentage_images_with_fp"),
        r(F.try_divide("fp", "images")).alias("fp_per_image"),
        r(F.try_divide("fp", "images_with_fp")).alias("fp_per_image_with_fp"),
    )


def fp_by_class(probes: DataFrame) -> DataFrame:
    """Dense (annotated, class_id): fp, and its share of the group's."""
    groups = probes.sparkSession.createDataFrame([(True,), (False,)], "annotated boolean").crossJoin(_classes(probes))
    n = probes.groupBy("annotated", "class_id").agg(F.count("*").alias("fp"))
    j = groups.join(n, ["annotated", "class_id"], "left").na.fill(0, ["fp"])
    return j.withColumn("share", F.round(G.percentage(F.col("fp"), F.sum("fp").over(W.partitionBy("annotated"))), 6))


def confusion_summary(agnostic: DataFrame, aware: DataFrame, preds: DataFrame, gts: DataFrame) -> DataFrame:
    """One row: geometric matches, right and wrong class, and targets gained and lost without classes."""
    own = agnostic.join(gts.select("image_id", "gt_id", F.col("class_id").alias("gc")), ["image_id", "gt_id"]).join(preds.select("image_id", "pred_id", F.col("class_id").alias("pc")), ["image_id", "pred_id"])
    total = own.agg(F.count("*").alias("geometric"), F.count_if(F.col("gc") == F.col("pc")).alias("right_class"))
    a = agnostic.select("image_id", "gt_id", F.lit(True).alias("a"))
    b = aware.select("image_id", "gt_id", F.lit(True).alias("b"))
    sets = a.join(b, ["image_id", "gt_id"], "full_outer").agg(F.count_if(F.col("b").isNull()).alias("gained"), F.count_if(F.col("a").isNull()).alias("lost"), F.count_if(F.col("a") & F.col("b")).alias("in_both"))
    j = total.crossJoin(sets)
    wrong = F.col("geometric") - F.col("right_class")
    return j.select("geometric", "right_class", wrong.alias("wrong_class"), F.round(G.percentage(wrong, F.col("geometric")), 6).alias("wrong_share"), "gained", "lost", "in_both")


def taxonomy_summary(taxonomy: DataFrame, classes: int = CLASSES) -> DataFrame:
    """Dense (class_id, category) with -1 for all classes: count and share of the class's misses."""
    spark = taxonomy.sparkSession
    dim = spark.createDataFrame([(c,) for c in CATEGORIES], "category string").crossJoin(spark.range(-1, classes).select(F.col("id").alias("class_id")))
    g = taxonomy.groupingSets([["class_id", "primary"], ["primary"]], "class_id", "primary").agg(F.count("*").alias("n"))
    got = g.select(F.coalesce("class_id", F.lit(-1)).cast("long").alias("class_id"), F.col("primary").alias("category"), "n")
    j = dim.join(got, ["class_id", "category"], "left").na.fill(0, ["n"])
    return j.withColumn("share", F.round(G.percentage(F.col("n"), F.sum("n").over(W.partitionBy("class_id"))), 6))


def flag_counts(taxonomy: DataFrame, flags: list[str]) -> DataFrame:
    """flag, n: how many misses carry each non-exclusive flag."""
    one = taxonomy.agg(*[F.count_if(F.col(f)).alias(f) for f in flags])
    return one.unpivot([], flags, "flag", "n")


def class_table(matches: DataFrame, preds: DataFrame, gts: DataFrame, conf: int = 25, classes: int = CLASSES) -> DataFrame:
    """Per class: tp, fp, fn, precision, recall, f1, support and its share, the matches' overlaps, low-support flags."""
    own = matches.join(gts.select("image_id", "gt_id", "class_id"), ["image_id", "gt_id"])
    tp = own.groupBy("class_id").agg(F.count("*").alias("tp"))
    kept = preds.where(F.col("conf") >= conf).groupBy("class_id").agg(F.count("*").alias("np"))
    support = gts.groupBy("class_id").agg(F.count("*").alias("support"))
    j = _classes(gts, classes).join(support, "class_id", "left").join(kept, "class_id", "left").join(tp, "class_id", "left").na.fill(0, ["support", "np", "tp"])
    j = stats.with_described(j, own, ["class_id"], {"iou_": F.col("iou")})
    j = j.withColumn("fp", F.col("np") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp")).drop("np")
    m = G.metrics(F.col("tp"), F.col("fp"), F.col("fn"))
    share = G.percentage(F.col("support"), F.sum("support").over(W.partitionBy()))  # a row for each class
    return j.select("*", *[F.round(c, 9).alias(k) for k, c in m.items()], F.round(share, 6).alias("support_share"), (F.col("support") < LOW_SUPPORT).alias("low_support"), (F.col("tp") < LOW_SUPPORT).alias("low_matches"))


def size_table(sized: DataFrame, matches: DataFrame, classes: int = CLASSES) -> DataFrame:
    """Dense (class_id, size_group), -1 for all classes: support, tp, fn, recall (null without support), low-support flag."""
    spark = sized.sparkSession
    hit = matches.select("image_id", "gt_id", F.lit(1).alias("hit"))
    rows = sized.select("image_id", "gt_id", "class_id", G.size_group(F.col("short_side")).alias("size_group")).join(hit, ["image_id", "gt_id"], "left")
    g = rows.groupingSets([["class_id", "size_group"], ["size_group"]], "class_id", "size_group").agg(F.count("*").alias("support"), F.count("hit").alias("tp"))
    got = g.select(F.coalesce("class_id", F.lit(-1)).cast("long").alias("class_id"), "size_group", "support", "tp")
    dim = spark.range(-1, classes).select(F.col("id").alias("class_id")).crossJoin(spark.createDataFrame([(0,), (1,), (2,)], "size_group int"))
    j = dim.join(got, ["class_id", "size_group"], "left").na.fill(0, ["support", "tp"])
    return j.select("class_id", "size_group", "support", "tp", (F.col("support") - F.col("tp")).alias("fn"), F.round(F.try_divide("tp", "support"), 9).alias("recall"), (F.col("support") < LOW_SUPPORT).alias("low_support"))


def confidence_table(best: DataFrame, bounds: list[tuple[float, float]]) -> DataFrame:
    """Bins [lo, hi) of confidence, the last closed: candidates, three descriptions, and those that reach half overlap."""
    bins = best.sparkSession.createDataFrame([(float(a), float(b), i == len(bounds) - 1) for i, (a, b) in enumerate(bounds)], "lo double, hi double, closed boolean")
    inside = (F.col("conf") >= F.col("lo")) & ((F.col("conf") < F.col("hi")) | F.col("closed") & (F.col("conf") == F.col("hi")))
    j = best.join(F.broadcast(bins), inside).select("lo", "hi", "closed", "conf", "any_iou", "same_iou")  # a handful of bins
    by = ["lo", "hi", "closed"]
    counts = j.groupBy(*by).agg(F.count("conf").alias("candidates"), F.count_if(F.col("any_iou") >= 0.5).alias("any_half"), F.count_if(F.col("same_iou") >= 0.5).alias("same_half"))
    out = bins.join(counts, by, "left").na.fill(0, ["candidates", "any_half", "same_half"])
    return stats.with_described(out, j, by, {"conf_": F.col("conf"), "any_": F.col("any_iou"), "same_": F.col("same_iou")})


def distributions(matches: DataFrame, preds: DataFrame, conf: int = 25) -> DataFrame:
    """Descriptions of the matches' confidence and overlap and of the false positives' confidence: name and columns."""
    kept = preds.where(F.col("conf") >= conf).select("image_id", "pred_id", "conf").join(matches.select("image_id", "pred_id", "iou"), ["image_id", "pred_id"], "left")
    hit = F.col("iou").isNotNull()
    named = {"matched_confidence": F.when(hit, F.col("conf")), "matched_iou": F.col("iou"), "false_positive_confidence": F.when(~hit, F.col("conf"))}
    base = kept.sparkSession.createDataFrame([(n,) for n in named], "name string")
    return stats.alongside(base, stats.described(kept, [], named, True).withColumnRenamed("metric", "name"), ["name"]).na.fill(0, ["count"])


def split_summary(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per split: image and box counts, shares of empty labels, orientations, resolutions, and the class counts as an array."""
    n = boxes.groupBy("image_id").agg(F.count("*").alias("n"))
    i = images.join(n, "image_id", "left").na.fill(0, ["n"]).withColumn("o", G.orientation(F.col("width"), F.col("height")))
    sides = ("portrait", "landscape", "approximately_square")
    own = i.groupBy("split").agg(
        F.count("*").alias("images"),
        F.count_if(F.col("n") > 0).alias("positive_images"),
        F.sum("n").alias("annotations"),
        *[F.count_if(F.col("o") == s).alias(s) for s in sides],
        F.count_distinct("width", "height").alias("resolutions"),
    )
    own = stats.with_described(own, i, ["split"], {"boxes_": F.when(F.col("n") > 0, F.col("n"))})
    empty = F.col("images") - F.col("positive_images")
    classes = boxes.join(images.select("image_id", "split"), "image_id").groupBy("split").agg(F.array(*[F.count_if(F.col("class_id") == c).cast("long") for c in range(CLASSES)]).alias("class_counts"))
    return own.join(classes, "split", "left").select("*", empty.alias("empty_label_images"), F.round(G.percentage(F.col("positive_images"), F.col("images")), 6).alias("positive_share"), F.round(G.percentage(empty, F.col("images")), 6).alias("empty_share"))


def class_difficulty(sized: DataFrame, splits: tuple[str, ...] = ("train", "valid"), classes: int = CLASSES) -> DataFrame:
    """Dense (split, class_id): boxes, images, and medians and quartiles of area share and of effective sides."""
    spark = sized.sparkSession
    dim = spark.createDataFrame([(s,) for s in splits], "split string").crossJoin(_classes(sized, classes))
    g = sized.groupBy("split", "class_id").agg(F.count("*").alias("annotations"), F.count_distinct("image_id").alias("positive_images"))
    c = {n: F.col(n) for n in ("area_pct", "effective_width", "effective_height", "short_side")}
    named = {"median_area_pct": (c["area_pct"], 0.5), "p25_area_pct": (c["area_pct"], 0.25), "p75_area_pct": (c["area_pct"], 0.75), "median_effective_width": (c["effective_width"], 0.5), "median_effective_height": (c["effective_height"], 0.5)}
    named |= {"median_short_side": (c["short_side"], 0.5), "p25_short_side": (c["short_side"], 0.25), "p75_short_side": (c["short_side"], 0.75)}
    g = stats.alongside(g, stats.quantiles(sized, ["split", "class_id"], named), ["split", "class_id"])
    return dim.join(g, ["split", "class_id"], "left").na.fill(0, ["annotations", "positive_images"])


def semantics(boxes: DataFrame, special: int, general: int) -> DataFrame:
    """Per class: images, median area; and of ``special``'s images how many hold ``general``, with that class's median area there."""
    per = boxes.groupBy("class_id").agg(F.count_distinct("image_id").alias("images"))
    per = stats.alongside(per, stats.quantiles(boxes, ["class_id"], {"median_area": (F.col("area"), 0.5)}, 9), ["class_id"])
    own = boxes.where(F.col("class_id") == special).select("image_id").distinct()
    there = boxes.where(F.col("class_id") == general).join(own, "image_id", "left_semi")
    there = there.agg(F.count_distinct("image_id").alias("shared_images")).join(stats.quantiles(there, [], {"shared_median_area": (F.col("area"), 0.5)}, 9), F.lit(True), "left")
    return per.crossJoin(there)


def provenance_summary(pairs: DataFrame) -> DataFrame:
    """classification, cross_split: pairs, turned by a degree or more, exposed otherwise; pairs: classification, cross_split, rotation, slope."""
    return pairs.groupBy("classification", "cross_split").agg(F.count("*").alias("pairs"), F.count_if(F.abs("rotation") >= 1.0).alias("turned"), F.count_if((F.col("slope") < 0.9) | (F.col("slope") > 1.1)).alias("exposed"))


def group_sizes(rows: DataFrame, key: str, empty: str) -> DataFrame:
    """How many sources have so many images, and how many of them mix empty and annotated labels."""
    g = rows.groupBy(key).agg(F.count("*").alias("size"), (F.count_distinct(empty) > 1).alias("mixed"))
    return g.groupBy("size").agg(F.count("*").alias("groups"), F.count_if("mixed").alias("mixed_groups"))


def intensity(rows: DataFrame, split: str = "split") -> DataFrame:
    """Pooled pixel statistics before and after, per split and overall; rows: pixels, and for original_ and processed_: sum, square_sum, min, max, zeros, fulls, mean, std."""
    both = ("original", "processed")
    aggs = [F.count("*").alias("images"), F.sum("pixels").alias("pixels_"), F.count_if(F.col("processed_std") > F.col("original_std")).alias("images_with_increased_std")]
    for b in both:
        aggs += [F.sum(f"{b}_{c}").alias(f"{b}_{c}_s") for c in ("sum", "square_sum", "zeros", "fulls")]
        aggs += [F.min(f"{b}_min").alias(f"{b}_least"), F.max(f"{b}_max").alias(f"{b}_most")]
    g = rows.groupingSets([[split], []], split).agg(*aggs, F.grouping(split).alias("g")).withColumn("scope_", F.when(F.col("g") == 1, "overall").otherwise(F.col(split)))
    scoped = rows.withColumn("scope_", F.explode(F.array(F.col(split), F.lit("overall"))))
    g = stats.alongside(g, stats.quantiles(scoped, ["scope_"], {f"median_image_{b}_{m}": (F.col(f"{b}_{m}"), 0.5) for b in both for m in ("mean", "std")}), ["scope_"])
    n = F.col("pixels_")
    mean = {b: F.col(f"{b}_sum_s") / n for b in both}
    std = {b: F.sqrt(F.greatest(F.lit(0.0), F.col(f"{b}_square_sum_s") / n - mean[b] * mean[b])) for b in both}
    cols: list[Column] = [F.when(F.col("g") == 1, "overall").otherwise(F.col(split)).alias("scope"), F.col("images"), n.alias("pixels"), F.col("images_with_increased_std"), F.round(std["processed"] - std["original"], 6).alias("std_change")]
    for b in both:
        cols += [F.round(mean[b], 6).alias(f"{b}_mean"), F.round(std[b], 6).alias(f"{b}_std"), F.col(f"{b}_least").alias(f"{b}_min"), F.col(f"{b}_most").alias(f"{b}_max"), F.round(F.col(f"{b}_zeros_s") / n, 9).alias(f"{b}_zero_fraction"), F.round(F.col(f"{b}_fulls_s") / n, 9).alias(f"{b}_full_fraction"), F.col(f"median_image_{b}_mean"), F.col(f"median_image_{b}_std")]
    return g.select(*cols)


def resolution_extent(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row: distinct resolutions, and the largest over the smallest class count that is not 0."""
    r = images.agg(F.count_distinct("width", "height").alias("resolutions"))
    c = boxes.groupBy("class_id").agg(F.count("*").alias("n")).agg(F.round(F.try_divide(F.max("n"), F.min("n")), 9).alias("class_ratio"))
    return r.crossJoin(c)


def profiles(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Histogram of the rows' encoding profiles."""
    return rows.groupBy(*columns).agg(F.count("*").alias("images"))


def distinct_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: each column's distinct values, sorted."""
    return rows.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns])
