"""A dataset's difficulty in full, and groups of derived images: tables in long form, a row for each figure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.functions import geometry as G
from fieldglass.operators import graph, stats
from fieldglass.operators.ordering import ordinals
from fieldglass.plans.scratch import stage
from fieldglass.scene import TARGET_SIDE

#: What is counted as small, as a share of the image and in pixels of the model's input.
AREA_LIMITS = (0.001, 0.0025, 0.005, 0.01, 0.02)
SIDE_LIMITS = (8.0, 16.0, 32.0, 64.0)


def box_measures(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Boxes (image_id, x0, y0, x1, y1) with their image's split and twelve measures: shares of the image, pixels, and pixels of the model's input."""
    return measured(boxes.join(images.select("image_id", "split", "width", "height"), "image_id"), "class_id" in boxes.columns)


def measured(placed: DataFrame, with_class: bool = True) -> DataFrame:
    """``box_measures`` of boxes that have their image's split, width and height."""
    j = placed
    w, h = (F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double")
    scale = F.least(F.lit(float(TARGET_SIDE)) / F.col("width"), F.lit(float(TARGET_SIDE)) / F.col("height"))
    nw, nh = w / F.col("width"), h / F.col("height")
    named = {
        "normalized_width": nw,
        "normalized_height": nh,
        "normalized_area": nw * nh,
        "normalized_shorter_side": F.least(nw, nh),
        "normalized_longer_side": F.greatest(nw, nh),
        "width_px": w,
        "height_px": h,
        "area_px": w * h,
        "effective_width": w * scale,
        "effective_height": h * scale,
        "effective_area": w * scale * (h * scale),
        "effective_short_side": F.least(w * scale, h * scale),
    }
    return j.select("image_id", "split", *(["class_id"] if with_class else []), *[c.alias(n) for n, c in named.items()])


MEASURES = ("normalized_width", "normalized_height", "normalized_area", "normalized_shorter_side", "normalized_longer_side", "width_px", "height_px", "area_px", "effective_width", "effective_height", "effective_area", "effective_short_side")


def split_measures(images: DataFrame, boxes: DataFrame, digits: int | None = 6, placed: DataFrame | None = None) -> DataFrame:
    """split, subject (image or box), metric and the long description: boxes of an annotated image, four measures of images, twelve of boxes.

    placed: the boxes that have an image with its split, width and height, if
    they are at hand.  Boxes and images meet once: what is measured is written.
    """
    if placed is None:
        placed = stage(boxes.select("image_id", "x0", "y0", "x1", "y1").join(images.select("image_id", "split", "width", "height"), "image_id"), "placed")
    n = boxes.groupBy("image_id").agg(F.count("*").alias("n"))
    i = stage(images.join(n, "image_id", "left").select("split", "width", "height", "n"), "counted")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    of_images = {"annotations_per_positive_image": F.col("n"), "width_px": w, "height_px": h, "pixel_area": w * h, "aspect_ratio": w / h}
    of_boxes = {m: F.col(m) for m in MEASURES}
    a = stats.described(i, ["split"], of_images, True, digits).withColumn("subject", F.lit("image"))
    b = stats.described(measured(placed, False), ["split"], of_boxes, True, digits).withColumn("subject", F.lit("box"))
    return a.unionByName(b)


def small_boxes(measured: DataFrame) -> DataFrame:
    """split, metric, limit, below, fraction of the areas and sides strictly below each limit; measured: as from ``box_measures``."""
    area = stats.thresholds(measured, ["split"], F.col("normalized_area"), list(AREA_LIMITS)).withColumn("metric", F.lit("normalized_area"))
    side = stats.thresholds(measured, ["split"], F.col("effective_short_side"), list(SIDE_LIMITS)).withColumn("metric", F.lit("effective_short_side"))
    return area.unionByName(side)


def common_resolutions(images: DataFrame, most: int = 10) -> DataFrame:
    """split, rank, width, height, images of each split's most common resolutions; ties by width, then height."""
    n = images.groupBy("split", "width", "height").agg(F.count("*").alias("images"))
    own = W.partitionBy("split").orderBy(F.desc("images"), "width", "height")
    return n.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most)


def format_counts(files: DataFrame, by: list[str], suffix: str = "suffix") -> DataFrame:
    """by, image_formats: how many files have each suffix, as a map in the order of the suffixes."""
    n = files.groupBy(*by, F.lower(suffix).alias("suffix")).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("suffix", "n")))).alias("image_formats"))


def class_sets(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, classes (sorted), smallest_area (null without boxes) of every image."""
    area = (F.col("x1") - F.col("x0")).cast("double") * (F.col("y1") - F.col("y0"))
    g = boxes.groupBy("image_id").agg(F.array_sort(F.collect_set("class_id")).alias("classes"), F.min(area).alias("smallest_area"))
    kind = g.schema["classes"].dataType.simpleString()
    return images.select("image_id").join(g, "image_id", "left").select("image_id", F.coalesce("classes", F.expr(f"cast(array() as {kind})")).alias("classes"), "smallest_area")


def orientation_shares(images: DataFrame) -> DataFrame:
    """split, orientation, images, percent; dense over the three orientations."""
    spark = images.sparkSession
    kinds = spark.createDataFrame([(k,) for k in ("portrait", "landscape", "approximately_square")], "orientation string")
    n = images.groupBy("split", G.orientation(F.col("width"), F.col("height")).alias("orientation")).agg(F.count("*").alias("images"))
    dense = n.select("split").distinct().join(F.broadcast(kinds), F.lit(True)).join(n, ["split", "orientation"], "left").na.fill(0, ["images"])  # three rows a split
    return dense.withColumn("percent", F.round(G.percentage(F.col("images"), F.sum("images").over(W.partitionBy("split"))), 6))


def derivative_groups(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Groups of two rows or more that edges connect, a row for each member.

    edges: a, b (ids); rows: id, split, source, and any columns to carry.
    group_id counts groups in the order of their least member; member_count, cross_split,
    splits and sources (sorted, joined by ' | '), source_count.  A group is known by
    its least member, so rows meet their group's figures by a join and no
    group is gathered whole but for its distinct splits and sources.
    """
    comp = graph.components(edges, "a", "b")
    own = rows.join(comp.withColumnRenamed("node", "id"), "id").withColumnRenamed("component", "least")
    g = own.groupBy("least").agg(F.count("*").alias("member_count"), F.array_sort(F.collect_set("split")).alias("s"), F.array_sort(F.collect_set("source")).alias("k")).where("member_count > 1")
    g = g.select("least", "member_count", (F.size("s") > 1).alias("cross_split"), F.array_join("s", " | ").alias("splits"), F.size("k").alias("source_count"), F.array_join("k", " | ").alias("sources"))
    numbered = ordinals(g, [], [F.asc("least")], "group_id")
    return own.join(numbered, "least").drop("least")
