"""Version diffs: exact and key matches, lineage, class transitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_stage(old: DataFrame, new: DataFrame, by: list[str], order: str = "name", name: str = "name") -> DataFrame:
    """by, old_name, new_name, how: exact, key, removed or added.

    Old rows in order: each takes the new row of its name if that is free,
    else the free new row of its group (``by``: split and source key) if there is
    exactly one.  A name's group is the same on both sides, so groups are
    independent; they are as large as a source has images.
    """
    olds = old.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("v")))), lambda x: x["v"]).alias("olds"))
    news = new.groupBy(*by).agg(F.array_sort(F.collect_list(F.col(name))).alias("news"))
    none = F.expr("cast(array() as array<string>)")
    j = olds.join(news, by, "full_outer").withColumn("olds", F.coalesce("olds", none)).withColumn("news", F.coalesce("news", none))
    pair = "array<struct<old_name:string,new_name:string,how:string>>"

    def take(s: Column, o: Column) -> Column:
        free = s["free"]
        own = F.array_contains(free, o)
        got = F.when(own, o).when(F.size(free) == 1, F.get(free, F.lit(0)))
        how = F.when(own, "exact").when(F.size(free) == 1, "key").otherwise("removed")
        left = F.when(got.isNull(), free).otherwise(F.array_except(free, F.array(got)))
        return F.struct(left.alias("free"), F.concat(s["pairs"], F.array(F.struct(o.alias("old_name"), got.alias("new_name"), how.alias("how")))).alias("pairs"))

    done = F.aggregate("olds", F.struct(F.col("news").alias("free"), F.expr(f"cast(array() as {pair})").alias("pairs")), take)
    added = F.transform(done["free"], lambda x: F.struct(F.lit(None).cast("string").alias("old_name"), x.alias("new_name"), F.lit("added").alias("how")))
    return j.select(*by, F.explode(F.concat(done["pairs"], added)).alias("p")).select(*by, "p.*")


def _points(coords: Column, tol: float) -> Column:
    """Sorted vertices of x, y, x, y, ... without a repeated closing one."""
    listed = F.transform(F.filter(F.sequence(F.lit(0), F.size(coords) - 1), lambda i: i % 2 == 0), lambda i: F.struct(F.get(coords, i).alias("x"), F.get(coords, i + 1).alias("y")))

    def opened(points: Column) -> Column:
        first, last = F.get(points, F.lit(0)), F.element_at(points, -1)
        closed = (F.size(points) > 1) & (F.greatest(F.abs(first["x"] - last["x"]), F.abs(first["y"] - last["y"])) <= tol)
        return F.array_sort(F.when(closed, F.slice(points, 1, F.greatest(F.lit(1), F.size(points) - 1))).otherwise(points))

    return _bound(listed, opened)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def geometry_matches(a: Column, b: Column, tol: float = 0.001) -> Column:
    """Whether two sorted lists of vertices agree within the tolerance."""
    near = F.forall(F.zip_with(a, b, lambda x, y: F.greatest(F.abs(x["x"] - y["x"]), F.abs(x["y"] - y["y"])) <= tol), lambda ok: ok)
    return (F.size(a) == F.size(b)) & F.coalesce(near, F.lit(False))


def compare_labels(old: DataFrame, new: DataFrame, key: str, tol: float = 0.001) -> DataFrame:
    """Per image: counts, coordinates_equal, semantic_equal, classes, and the matched rows' class transitions.

    old, new: key, line_number, class_name, coords.  Each old row in order
    takes the first free new row of the same geometry.
    """

    def side(rows: DataFrame, new_: bool) -> DataFrame:
        row = F.struct(F.col("line_number").cast("int").alias("line_number"), F.col("class_name").cast("string").alias("c"), F.transform(_points(F.col("coords"), tol), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("p"))
        return rows.where(F.size("coords") % 2 == 0).select(key, F.lit(new_).alias("new_"), row.alias("row"))

    # both sides move at once; those without a key are not of one image
    both = side(old, False).unionByName(side(new, True)).groupBy(key, F.when(F.col(key).isNull(), F.col("new_")).alias("side"))
    j = both.agg(*[F.array_sort(F.collect_list(F.when(F.col("new_") if n == "news" else ~F.col("new_"), F.col("row")))).alias(n) for n in ("olds", "news")])
    kind = "array<struct<line_number:int,c:string,p:array<struct<x:double,y:double>>>>"
    j = j.select(key, *[F.coalesce(F.col(c).cast(kind), F.expr(f"cast(array() as {kind})")).alias(c) for c in ("olds", "news")])

    def take(s: Column, o: Column) -> Column:
        at = F.get(F.filter(s["free"], lambda i: geometry_matches(o["p"], F.get(F.col("news"), i)["p"], tol)), F.lit(0))
        pair = lambda at: F.struct(o["c"].alias("old_class"), F.get(F.col("news"), at)["c"].alias("new_class"))
        found = lambda at: F.struct(F.array_except(s["free"], F.array(at)).alias("free"), F.concat(s["pairs"], F.array(pair(at))).alias("pairs"))
        return _bound(at, lambda at: F.when(at.isNull(), s).otherwise(found(at)))

    start = F.struct(F.when(F.size("news") > 0, F.sequence(F.lit(0), F.size("news") - 1)).otherwise(F.expr("cast(array() as array<int>)")).alias("free"), F.expr("cast(array() as array<struct<old_class:string,new_class:string>>)").alias("pairs"))
    done = j.select(key, F.size("olds").alias("old_count"), F.size("news").alias("new_count"), F.array_join(F.array_sort(F.array_distinct(F.transform("olds", lambda o: o["c"]))), " | ").alias("old_classes"), F.array_join(F.array_sort(F.array_distinct(F.transform("news", lambda o: o["c"]))), " | ").alias("new_classes"), F.aggregate("olds", start, take)["pairs"].alias("transitions"))
    equal = (F.size("transitions") == F.col("old_count")) & (F.col("old_count") == F.col("new_count"))
    return done.withColumn("coordinates_equal", equal).withColumn("semantic_equal", equal & F.forall("transitions", lambda t: t["old_class"] == t["new_class"]))


def class_transitions(compared: DataFrame) -> DataFrame:
    """old_class, new_class, n of all matched rows."""
    return compared.select(F.explode("transitions").alias("t")).groupBy("t.old_class", "t.new_class").agg(F.count("*").alias("n"))


def exact_pair_labels(mapping: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """``compare_labels`` of the images that are exact copies; mapping: old_image, new_image, classification; labels by image."""
    own = mapping.where("classification = 'exact_copy'").select("old_image", "new_image")
    first = own.join(old.withColumnRenamed("image", "old_image"), "old_image").withColumnRenamed("new_image", "image")
    second = own.select(F.col("new_image").alias("image")).join(new, "image")
    cols = ["image", "line_number", "class_name", "coords"]
    return compare_labels(first.select(*cols), second.select(*cols), "image")


def held_out_summary(pairs: DataFrame) -> DataFrame:
    """Per split: files of either side, matches, equalities, and the relationships' counts as a map."""
    both = F.col("in_old") & F.col("in_new")
    flags = ["filename_equal", "image_byte_equal", "label_byte_equal", "label_semantic_equal", "label_coordinates_equal"]
    counts = pairs.groupBy("split").agg(F.count_if("in_old").alias("old_files"), F.count_if("in_new").alias("new_files"), F.count_if(both).alias("matched"), *[F.count_if(both & F.col(f)).alias(f) for f in flags])
    kinds = pairs.where(both).groupBy("split", "relationship").agg(F.count("*").alias("n")).groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relationship", "n")))).alias("relationships"))
    return counts.join(kinds, "split", "left")


def class_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of both sides by key, 0 where one has none, and their difference."""
    n = lambda d, c: d.groupBy(*keys).agg(F.count("*").alias(c))
    j = n(old, "old_n").join(n(new, "new_n"), keys, "full_outer").na.fill(0, ["old_n", "new_n"])
    return j.withColumn("difference", F.col("new_n") - F.col("old_n"))


def key_sizes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """How many source keys have m old and n new images: relation (m->n), keys."""
    n = lambda d, c: d.groupBy(key).agg(F.count("*").alias(c))
    j = n(old, "m").join(n(new, "n"), key, "full_outer").na.fill(0, ["m", "n"])
    return j.groupBy(F.concat(F.col("m").cast("string"), F.lit("->"), F.col("n").cast("string")).alias("relation")).agg(F.count("*").alias("keys"))


def with_previous(rows: DataFrame, previous: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with an earlier report's value as text, n/a where it has none."""
    return rows.join(previous.select(*keys, F.col(value).cast("string").alias("previous")), keys, "left").withColumn("previous", F.coalesce("previous", F.lit("n/a")))


def lineage(new: DataFrame, old: DataFrame, key: str, score: Column) -> DataFrame:
    """Each new row's best old row of its key; ties go to the first old id.

    The score is worked out of the columns but ``id``, so rows that agree in
    all of these are scored as one: pairs are made of the differing rows of a
    key, whatever the number of rows.
    """
    own, other = ([c for c in df.columns if c != "id"] for df in (new, old))
    kinds = new.select(*own).distinct().alias("n")
    olds = old.groupBy(*other).agg(F.min("id").alias("id"), F.count("id").alias("m")).alias("o")
    best = kinds.join(olds, F.col(f"n.{key}") == F.col(f"o.{key}")).groupBy(*[F.col(f"n.{c}").alias(c) for c in own]).agg(F.max(F.struct(score.alias("s"), (-F.col("o.id")).alias("t"), F.col("o.id").alias("id"))).alias("best"), F.sum("o.m").alias("m"))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in own]
    j = new.alias("r").join(best.alias("b"), on, "left")
    return j.groupBy(F.col("r.id").alias("new_id")).agg(F.max_by("b.best.id", F.col("b.best")).alias("old_id"), F.coalesce(F.sum("b.m"), F.lit(0)).alias("candidates"))


def relationship(m: dict[str, Column]) -> Column:
    """Class of an image pair from its feature and alignment measures."""

    def at_least(good, inliers, ratio, lo, hi, overlap, corr, rmse):
        return (m["good"] >= good) & (m["inliers"] >= inliers) & (m["ratio"] >= ratio) & m["scale"].between(lo, hi) & (m["overlap"] >= overlap) & (m["corr"] >= corr) & (m["rmse"] <= rmse)

    # fixed values: the thresholds of the pair classes
    return (
        F.when(at_least(12, 10, 0.55, 0.8, 1.25, 0.5, 0.88, 0.12), "high_confidence_derivative")
        .when(at_least(8, 6, 0.35, 0.7, 1.35, 0.35, 0.7, 0.2), "probable_derivative")
        .when((m["good"] < 6) | (m["ratio"] < 0.2) | (m["corr"] < 0.4), "unrelated_false_positive")
        .otherwise("inconclusive")
    )


def coverage(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """How many parents have how many children."""
    n = parents.select(key).join(children.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(F.coalesce("n", F.lit(0)).alias("children"))
    return n.groupBy("children").agg(F.count("*").alias("parents"))
