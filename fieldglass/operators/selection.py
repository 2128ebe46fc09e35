"""Deterministic selection: ranked review candidates, quotas, diverse samples."""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.operators import stats
from fieldglass.operators.ordering import ordinals
from fieldglass.plans.scratch import stage


def ranked(rows: DataFrame, reason: str, order: list[Column], most: int, id_cols: list[str]) -> DataFrame:
    """The first ``most`` rows of a total order, with the reason."""
    return rows.orderBy(*order, *id_cols).limit(most).select(*id_cols, F.lit(reason).alias("reason"))


def review(rows: DataFrame, rankings: dict[str, list[Column]], most: int, id_cols: list[str]) -> DataFrame:
    """Union of rankings; each row with all its reasons."""
    out = None
    for reason, order in rankings.items():
        part = ranked(rows, reason, order, most, id_cols)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*id_cols).agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def nearest_median(rows: DataFrame, by: list[str], value: str, id_cols: list[str]) -> DataFrame:
    """Of each group the row nearest to the group's median."""
    mid = stats.selected(rows.select(*by, F.col(value).alias("v")), by, [0.5]).select(*by, F.col("q0").alias("mid"))
    j = rows.join(mid, by)
    return j.groupBy(*by).agg(F.min_by(F.struct(*id_cols), F.struct(F.abs(F.col(value) - F.col("mid")).alias("d"), *id_cols)).alias("s")).select(*by, "s.*")


def quota(rows: DataFrame, category: str, quotas: dict[str, int], seed: int, id_col: str) -> DataFrame:
    """Per category the first rows by a seeded SHA-256 rank; quotas may fall short."""
    q = rows.sparkSession.createDataFrame(list(quotas.items()), "category string, quota int")
    rank = F.sha2(F.concat(F.lit(f'[{seed},"'), F.col(category), F.lit('",'), F.col(id_col).cast("string"), F.lit("]")), 256)
    r = rows.withColumn("category", F.col(category)).join(F.broadcast(q), "category").withColumn("rank", rank)
    r = r.withColumn("n", F.row_number().over(W.partitionBy("category").orderBy("rank", id_col)))
    # by a literal, so that each task keeps so many of a category before rows move
    return r.where(F.col("n") <= max(quotas.values(), default=0)).where("n <= quota").select("category", F.col("n").alias("pick"), F.col(id_col).alias("id"), "rank")


#: Fixed values of the case sampler: picks per category, and the order of picking.
QUOTAS = {"complete_miss": 8, "mixed_or_unresolved": 8, "low_confidence_detection": 6, "localization_failure": 3, "wrong_class_geometric_match": 3, "fp_annotated": 4, "fp_empty_label": 2, "successful_detection": 2}
FIRST_PICKED = ("localization_failure", "wrong_class_geometric_match")
#: Special first picks: (category, pick) and what a case has to fulfil if any does.
SPECIAL = {
    ("fp_annotated", 0): lambda c: c["duplicate_like"],
    ("successful_detection", 0): lambda c: c["class_id"] in (2, 3),
    ("successful_detection", 1): lambda c: c["class_id"] in (0, 1, 4, 5),
}


class _Used:
    """Images, targets and predictions that picks have used; what a case reuses only grows."""

    def __init__(self) -> None:
        self.seen: set[tuple] = set()

    @staticmethod
    def _parts(case: dict) -> list[tuple]:
        own = [(k, case["image_id"], case[k]) for k in ("gt_id", "pred_id") if case[k] is not None]
        return [("image", case["image_id"]), *own]

    def cost(self, case: dict) -> int:
        """Bits of what is used already: image before target before prediction."""
        weight = {"image": 4, "gt_id": 2, "pred_id": 1}
        return sum(weight[p[0]] for p in self._parts(case) if p in self.seen)

    def take(self, case: dict) -> None:
        self.seen.update(self._parts(case))


class _Board:
    """Cases of one category in a queue for each (class, size, flag), the least cost and rank first.

    Within a queue class and size count alike, so the best case of all is one of
    the heads.  Costs only grow: a head whose cost has grown goes back into
    its queue, the others keep an old cost until they become heads.
    """

    def __init__(self, cases: list[dict], used: _Used) -> None:
        self.used, self.left = used, len(cases)
        self.counts: Counter = Counter()
        self.queues: dict[tuple, list] = {}
        for at, c in enumerate(cases):
            self.queues.setdefault((c["class_id"], c["size_group"], c["duplicate_like"]), []).append((used.cost(c), c["rank"], at, c))
        for q in self.queues.values():
            heapq.heapify(q)

    def _head(self, queue: list) -> tuple:
        while (now := self.used.cost(queue[0][3])) != queue[0][0]:
            heapq.heapreplace(queue, (now, *queue[0][1:]))
        return queue[0]

    def pick(self, wanted=None) -> dict:
        """The least by (reuse, class count, size count, rank), of those ``wanted`` if there are any."""
        open_ = [k for k, q in self.queues.items() if q]
        own = [k for k in open_ if wanted is None or wanted(self.queues[k][0][3])] or open_

        def order(k: tuple) -> tuple:
            cost, rank, at, _ = self._head(self.queues[k])
            return cost, self.counts["class", k[0]], self.counts["size", k[1]], rank, at

        key = min(own, key=order)
        case = heapq.heappop(self.queues[key])[3]
        case = case | {"reuses_image": ("image", case["image_id"]) in self.used.seen}
        self.used.take(case)
        self.counts.update([("class", key[0]), ("size", key[1])])
        self.left -= 1
        return case


def select_cases(pools: DataFrame, seed: int, quotas: dict[str, int] | None = None) -> tuple[list[dict], list[dict]]:
    """(cases, counts per category) of the greedy balanced sampler.

    pools: category, image_id, gt_id, pred_id (null where there is none),
    class_id, size_group, duplicate_like.  Each pick is the least by (image
    used, target used, prediction used, class count, size count, rank).  Of
    cases equal in category, class, size and flag, those of the images with
    the least ranks are enough, of one image more than there are picks: either
    one of them is unused, or all images are among them.
    """
    quotas = QUOTAS if quotas is None else quotas
    pools = stage(pools, "pools")  # read three times
    most = sum(quotas.values()) + 1
    num = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    key = F.concat(F.lit(f'[{seed},"'), F.col("category"), F.lit('",'), F.concat_ws(",", num("image_id"), num("gt_id"), num("pred_id")), F.lit("]"))
    ranked_ = pools.where(F.col("category").isin(list(quotas))).withColumn("rank", F.sha2(key, 256))
    alike = ["category", "class_id", "size_group", "duplicate_like"]
    best = ranked_.groupBy(*alike, "image_id").agg(F.min("rank").alias("least"))
    best = best.withColumn("n", F.row_number().over(W.partitionBy(*alike).orderBy("least", "image_id"))).where(F.col("n") <= most)
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*alike, "image_id"]]
    few = [r.asDict() for r in ranked_.alias("r").join(best.alias("b"), on, "left_semi").collect()]
    total = {r["category"]: r["count"] for r in pools.groupBy("category").count().collect()}
    picked: list[dict] = []
    used = _Used()
    for category in sorted(quotas, key=lambda c: FIRST_PICKED.index(c) if c in FIRST_PICKED else len(FIRST_PICKED)):
        board = _Board([c for c in few if c["category"] == category], used)
        for index in range(min(quotas[category], board.left)):
            picked.append(board.pick(SPECIAL.get((category, index))))
    picked.sort(key=lambda c: (list(quotas).index(c["category"]), c["rank"]))
    cases = [c | {"case_id": f"S3-{i:02d}"} for i, c in enumerate(picked, 1)]
    got = {q: sum(c["category"] == q for c in cases) for q in quotas}
    return cases, [{"category": q, "quota": n, "pool": total.get(q, 0), "selected": got[q], "shortfall": n - got[q]} for q, n in quotas.items()]


def review_annotations(rows: DataFrame, most: int = 10) -> DataFrame:
    """split, image_id, gt_id, reasons: six rankings, images of several annotations, class medians.

    rows: split, image_id, gt_id, class_id, occupancy, area, border, aspect; train and valid only.
    """
    key = ["split", "image_id", "gt_id"]
    # eight parts read the rows; they are worked out once
    own = stage(rows.where(F.col("split").isin("train", "valid")).select(*key, "class_id", "occupancy", "area", "border", "aspect"), "annotations")
    rankings = {
        "lowest_occupancy": F.asc("occupancy"),
        "highest_occupancy": F.desc("occupancy"),
        "smallest_box": F.asc("area"),
        "largest_box": F.desc("area"),
        "closest_to_boundary": F.asc("border"),
        "unusual_image_aspect_ratio": F.desc("aspect"),
    }
    several = own.groupBy("split", "image_id").agg(F.count("*").alias("n")).where("n > 1").orderBy("split", "image_id").limit(most).drop("n")
    parts = [ranked(own, reason, [order], most, key) for reason, order in rankings.items()]
    parts.append(own.join(F.broadcast(several), ["split", "image_id"], "left_semi").select(*key, F.lit("multi_annotation_image").alias("reason")))
    typical = nearest_median(own.withColumnRenamed("split", "part").withColumn("split", F.col("part")), ["part", "class_id"], "occupancy", key)
    parts.append(typical.select(*key, F.lit("representative_class").alias("reason")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def _first(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group; groups are splits, classes, categories or images."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most)


def review_images(candidates: DataFrame, mandatory: str = "representative_class", most: int = 4) -> DataFrame:
    """image_id, reasons: all mandatory ones' images, then of each other reason the first distinct images by their metric.

    candidates: image_id, reason, metric, gt_id.
    """
    must = candidates.where(F.col("reason") == mandatory).select("image_id", "reason")
    best = candidates.where(F.col("reason") != mandatory).groupBy("reason", "image_id").agg(F.min(F.struct("metric", "gt_id")).alias("m"))
    rest = _first(best, ["reason"], [F.col("m.metric"), F.col("image_id")], most).select("image_id", "reason")
    return must.unionByName(rest).groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def preprocessing_review(records: DataFrame, rankings: dict[str, Column], by: str = "class_id", value: str = "mean", id_col: str = "image_id", most: int = 2) -> DataFrame:
    """id, reasons: of each class the image nearest its median mean, and the first of every ranking."""
    parts = [nearest_median(records.where(F.col(by).isNotNull()), [by], value, [id_col]).select(id_col, F.lit("representative_class").alias("reason"))]
    parts += [ranked(records, reason, [order], most, [id_col]) for reason, order in rankings.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def audit_samples(boxes: DataFrame, issues: DataFrame, empties: DataFrame, pairs: DataFrame, rare: int = 5) -> DataFrame:
    """category, image_id: all boxes of rare classes, else the one nearest the class's median area; the smallest boxes; first issues, empty labels and cross-split pairs.

    boxes: image_id, gt_id, class_id, area; issues, empties: image_id;
    pairs: first_id, second_id, cross_split, difference, distance.
    """
    n = boxes.groupBy("class_id").agg(F.count("*").alias("n"))
    few = boxes.join(n.where(F.col("n") <= rare), "class_id", "left_semi")
    many = nearest_median(boxes.join(n.where(F.col("n") > rare), "class_id", "left_semi"), ["class_id"], "area", ["image_id", "gt_id"])
    by_class = F.concat(F.lit("class_"), F.col("class_id").cast("string")).alias("category")
    parts = [few.select(by_class, "image_id"), many.select(by_class, "image_id")]
    parts.append(boxes.orderBy("area", "image_id", "gt_id").limit(5).select(F.lit("smallest").alias("category"), "image_id"))
    parts.append(issues.orderBy("image_id").limit(5).select(F.lit("issue").alias("category"), "image_id"))
    parts.append(empties.orderBy("image_id").limit(3).select(F.lit("empty").alias("category"), "image_id"))
    cross = pairs.where("cross_split").orderBy("difference", "distance", "first_id", "second_id").limit(3)
    parts.append(cross.select(F.lit("cross_split").alias("category"), F.explode(F.array("first_id", "second_id")).alias("image_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def stable_ids(preds: DataFrame) -> DataFrame:
    """Predictions with ``box_id`` pred/000000, ... in falling confidence of their image, then by class and box."""
    order = [F.desc("conf"), F.asc("class_id"), F.asc("x0"), F.asc("y0"), F.asc("x1"), F.asc("y1")]
    place = F.row_number().over(W.partitionBy("image_id").orderBy(*order))
    return preds.withColumn("box_id", F.format_string("pred/%06d", place - 1))


#: How much a pair's class matters for the review.
PRIORITY = {"high_confidence_derivative": 0, "probable_derivative": 1, "inconclusive": 2, "unrelated_false_positive": 3}


def cross_split_pairs(pairs: DataFrame, most: int = 30) -> DataFrame:
    """The first cross-split pairs by class, residual and inliers, with their place."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("classification"))
    order = [rank, F.col("rmse"), F.desc("inliers"), F.col("first_id"), F.col("second_id")]
    first = pairs.where("cross_split").orderBy(*order).limit(most)
    return first.withColumn("place", F.row_number().over(W.orderBy(*order)))  # of ``most`` rows


def shown_predictions(case: DataFrame, pairs: DataFrame, detailed: bool) -> DataFrame:
    """image_id, pred_id, place of what is drawn for each case: its own prediction, the best of every combination, then by overlap.

    case: image_id, gt_id, focus_id; pairs as from ``overlaps``, with ``apart``.  Not detailed: only confident ones, by confidence.
    """
    j = case.join(pairs, ["image_id", "gt_id"])
    focus = F.col("pred_id") == F.col("focus_id")
    if detailed:
        combination = F.struct((F.col("pc") == F.col("gc")).alias("same"), (F.col("conf") >= 25).alias("sure"), (F.col("iou") >= 0.5).alias("strong"))
        best = W.partitionBy("image_id", "gt_id", combination).orderBy(F.desc("iou"), F.desc("conf"), "pred_id")
        j = j.withColumn("tier", F.when(focus, 0).when((F.col("iou") >= 0.1) & (F.row_number().over(best) == 1), 1).otherwise(2))
        order, cap = [F.col("tier"), F.desc("iou"), F.desc("conf"), F.col("pred_id")], 8
    else:
        j = j.where(focus | (F.col("conf") >= 25)).withColumn("tier", F.when(focus, 0).otherwise(1))
        order, cap = [F.col("tier"), F.desc("conf"), F.col("pred_id")], 6
    return _first(j, ["image_id", "gt_id"], order, cap).select("image_id", "gt_id", "pred_id", "place")


def best_listed(pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """Of each target's listed predictions (image_id, gt_id, pred_id) the best by overlap, confidence, id."""
    j = pairs.join(listed, ["image_id", "gt_id", "pred_id"])
    return j.groupBy("image_id", "gt_id").agg(F.min(F.struct((-F.col("iou")).alias("i"), (-F.col("conf")).alias("c"), "pred_id"))["pred_id"].alias("pred_id"))


def count_windows(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Rows with the number of their window of ``size`` rows in order; the last may be shorter."""
    if size < 1:
        raise ValueError("a window holds a row at least")
    return ordinals(rows, [], order, "place").withColumn("window", F.floor((F.col("place") - 1) / size)).drop("place")


def preview_specs(boxes: DataFrame) -> DataFrame:
    """spec, image_id: first image of each class, the smallest box, the one nearest the border, most boxes, first of several classes.

    boxes: image_id, gt_id, class_id, area, border.
    """
    first = boxes.groupBy("class_id").agg(F.min("image_id").alias("image_id")).select(F.concat(F.lit("class_"), F.col("class_id").cast("string")).alias("spec"), "image_id")
    one = lambda name, value: boxes.agg(F.min_by("image_id", F.struct(value.alias("v"), "image_id", "gt_id")).alias("image_id")).select(F.lit(name).alias("spec"), "image_id")
    per = boxes.groupBy("image_id").agg(F.count("*").alias("n"), F.count_distinct("class_id").alias("classes"))
    most = per.agg(F.min_by("image_id", F.struct((-F.col("n")).alias("v"), "image_id")).alias("image_id")).select(F.lit("most_boxes").alias("spec"), "image_id")
    several = per.where("classes > 1").agg(F.min("image_id").alias("image_id")).where("image_id is not null").select(F.lit("several_classes").alias("spec"), "image_id")
    return first.unionByName(one("smallest", F.col("area"))).unionByName(one("border", F.col("border"))).unionByName(most).unionByName(several)


def reproducibility_samples(boxes: DataFrame, images: DataFrame, head: int = 6) -> DataFrame:
    """The first image of each class and the first of all, each once."""
    first = boxes.groupBy("class_id").agg(F.min("image_id").alias("image_id")).select("image_id")
    return first.unionByName(images.select("image_id").orderBy("image_id").limit(head)).distinct()


def mixed_groups(members: DataFrame) -> DataFrame:
    """Groups with empty and annotated members: counts, and the first of either kind. members: group_id, image_id, is_empty."""
    g = members.groupBy("group_id").agg(F.count("*").alias("members"), F.count_if("is_empty").alias("empty"), F.min(F.when(F.col("is_empty"), F.col("image_id"))).alias("first_empty"), F.min(F.when(~F.col("is_empty"), F.col("image_id"))).alias("first_annotated"))
    return g.where("empty > 0 and empty < members")
