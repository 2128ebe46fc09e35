"""Descriptive statistics: describe, dense grids, grouping sets, ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.functions.geometry import finite
from fieldglass.operators.ordering import ordinals, running_sum
from fieldglass.plans.scratch import partitions, stage

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Of the longer description.
PERCENTILES = (5, 10, 25, 50, 75, 90, 95)


_VALUES = "v"


#: Ranges of values for each factor of e, in ``_bucket``.
_FINE = 369


def _bucket(v: Column) -> Column:
    """A number that never falls as the value rises: about 256 for each doubling, one for 0, for infinity and for what is no number."""
    far = F.lit(1 << 40)
    place = lambda x: F.when(x == float("inf"), far).otherwise(F.floor(F.ln(x) * _FINE) + (1 << 20))
    return F.when(F.isnan(v), far + 1).when(v > 0, place(v)).when(v < 0, -place(-v)).otherwise(F.lit(0)).cast("long")


def selected(values: DataFrame, keys: list[str], fractions: list[float] | tuple[float, ...], moments: bool = False) -> DataFrame:
    """keys, n, q0, q1, ...: interpolated quantiles (fraction of n - 1) of the column ``v`` of every group; with moments least, most, mean, std.

    Exact, without a buffer: values are counted by narrow ranges first, in
    each task; the ranges that hold a wanted place are known then, and only
    their values are counted one by one.  These counts (a row for each
    differing value) are sorted by range into parts, so no task has all of a
    group.  ``values`` is worked out twice; neither pass moves a row for
    each value.  Null values are none; a group without values gives no row.
    """
    v, bucket, at = F.col(_VALUES), "placed_bucket", "placed_at"
    own = values.where(v.isNotNull()).select(*keys, v.cast("double").alias(_VALUES)).withColumn(bucket, _bucket(v.cast("double")))
    more = [F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("sum"), F.stddev_pop(v).alias("std")] if moments else []
    counts = stage(own.groupBy(*keys, bucket).agg(F.count("*").alias("size"), *more), "ranges")
    group = W.partitionBy(*keys)
    before = F.coalesce(F.sum("size").over(group.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = counts.select(*keys, bucket, "size", before.alias("before"), F.sum("size").over(group).alias("n"))
    places = [p for f in fractions for p in (F.floor((F.col("n") - 1) * F.lit(float(f))), F.ceil((F.col("n") - 1) * F.lit(float(f))))]
    holds = lambda first, size: reduce(lambda a, b: a | b, [(p >= first) & (p < first + size) for p in places], F.lit(False))
    # written, so that Spark knows its size: a small table, unless there are many groups
    wanted = stage(sizes.where(holds(F.col("before"), F.col("size"))).select(*keys, bucket, "before", "n"), "ranges")
    ids = [*keys, bucket]
    close = alongside(own, wanted, ids, "inner").groupBy(*ids, "before", "n", _VALUES).agg(F.count("*").alias("size"))
    placed = stage(close.repartitionByRange(partitions(values.sparkSession), *ids, _VALUES).sortWithinPartitions(*ids, _VALUES).withColumn(at, F.monotonically_increasing_id()), "values")
    pid = F.shiftright(F.col(at), 33)
    parts = placed.groupBy(*ids, pid.alias("pid")).agg(F.sum("size").alias("rows"))
    earlier = F.coalesce(F.sum("rows").over(W.partitionBy(*ids).orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*ids, "pid", earlier.alias("earlier"))
    here = F.coalesce(F.sum("size").over(W.partitionBy(*ids, "pid").orderBy(_VALUES).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = alongside(placed.withColumn("pid", pid), parts, [*ids, "pid"], "inner").withColumn("first", F.col("before") + F.col("earlier") + here)
    last = F.col("first") + F.col("size")
    picks = [F.max(F.when((p >= F.col("first")) & (p < last), v)).alias(f"{'hi' if i % 2 else 'lo'}{i // 2}") for i, p in enumerate(places)]
    found = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)

    def quantile(i: int) -> Column:
        h = (F.col("n") - 1) * F.lit(float(fractions[i]))
        return F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (h - F.floor(h))

    out = found.select(*keys, "n", *[quantile(i).alias(f"q{i}") for i in range(len(fractions))])
    if not moments:
        return out
    n, mean = F.sum("size").over(group), F.sum("sum").over(group) / F.sum("size").over(group)
    off = F.col("sum") / F.col("size") - F.col("mean")
    whole = counts.select(*keys, "size", "least", "most", "sum", "std", n.alias("n"), mean.alias("mean"))
    square = F.sum(F.col("size") * (F.col("std") * F.col("std") + off * off))
    return alongside(out, whole.groupBy(*keys).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("mean").alias("mean"), F.sqrt(square / F.max("n")).alias("std")), keys)


def alongside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` with the columns of ``right``'s row of the same keys, nulls equal; ``right`` has a row for each group."""
    if not keys:
        return left.join(right, F.lit(True), "left")  # a row each
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`"))
    return left.alias("l").join(right.alias("r"), on, how).select("l.*", *[F.col(f"r.`{c}`") for c in right.columns if c not in keys])


def quantiles(rows: DataFrame, by: list[str], named: dict[str, tuple[Column, float]], digits: int = 6) -> DataFrame:
    """by, and under each name a quantile of a column, rounded; null for a group without values of it."""
    columns: dict[str, Column] = {}
    which: dict[str, tuple[str, float]] = {}
    for name, (c, f) in named.items():
        metric = next((m for m, known in columns.items() if str(known) == str(c)), None) or f"m{len(columns)}"
        columns[metric] = c
        which[name] = (metric, f)
    fractions = sorted({f for _, f in which.values()})
    got = selected(_long(rows, by, columns), [*by, "metric"], fractions)
    pick = lambda m, f: F.round(F.max(F.when(F.col("metric") == m, F.col(f"q{fractions.index(f)}"))), digits)
    return got.groupBy(*by).agg(*[pick(m, f).alias(name) for name, (m, f) in which.items()])


def _long(rows: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias(_VALUES)) for m, c in columns.items()])
    return rows.select(*by, F.explode(cells).alias("cell")).select(*by, "cell.metric", f"cell.{_VALUES}")


def _columns(long: bool) -> dict[str, str]:
    """The description's columns, in their order, and where ``selected`` has them."""
    if not long:
        return {"count": "n", "min": "least", "mean": "mean", "std": "std", "max": "most"} | {f"p{round(f * 100):02d}": f"q{i}" for i, f in enumerate(QUANTILES)}
    return {"count": "n", "mean": "mean", "median": f"q{len(PERCENTILES)}", "std": "std", "min": "least", "max": "most"} | {f"p{p}": f"q{i}" for i, p in enumerate(PERCENTILES)}


def described(rows: DataFrame, by: list[str], columns: dict[str, Column], long: bool = False, digits: int | None = 6) -> DataFrame:
    """by, metric and the description of each column: count, extremes, mean, population deviation and quantiles, rounded if ``digits`` are given.

    ``long``: with the median and seven percentiles; a value that is not finite is an error then.
    """
    own = _long(rows, by, columns)
    if long:
        own = own.withColumn(_VALUES, F.when(F.col(_VALUES).isNotNull() & ~finite(F.col(_VALUES)), F.raise_error(F.lit("a value is not finite")).cast("double")).otherwise(F.col(_VALUES)))
    fractions = [p / 100.0 for p in PERCENTILES] + [0.5] if long else list(QUANTILES)
    got = selected(own, [*by, "metric"], fractions, True)
    return got.select(*by, "metric", *[F.col(c).alias(n) if n == "count" or digits is None else F.round(c, digits).alias(n) for n, c in _columns(long).items()])


def with_described(base: DataFrame, rows: DataFrame, by: list[str], columns: dict[str, Column], long: bool = True, digits: int = 6) -> DataFrame:
    """``base`` (a row for each group) with the description of each column of ``rows``, its name before theirs; count 0 and nulls over no values."""
    d = described(rows, by, columns, long, digits)
    names = list(_columns(long))
    wide = d.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == m, F.col(n))).alias(f"{m}{n}") for m in columns for n in names])
    return alongside(base, wide, by).na.fill(0, [f"{m}count" for m in columns])


def describe_grouped(rows: DataFrame, by: list[str], metrics: list[str], total: str | None = None) -> DataFrame:
    """by, metric and the short description of each metric, over groups and, under the name ``total``, over all of the first key; a metric without values has count 0."""
    own = rows
    if total is not None:
        own = rows.withColumn(by[0], F.explode(F.array(F.col(by[0]).cast("string"), F.lit(total))))
    columns = {m: F.col(m) for m in metrics}
    base = own.select(*by).distinct().select(*by, F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    return alongside(base, described(own, by, columns), [*by, "metric"]).na.fill(0, ["count"])


def histogram(rows: DataFrame, by: list[str], value: Column, edges: list[float]) -> DataFrame:
    """by, bin, lo, hi, n, percent over the bins between the edges, the last one closed; empty bins count 0."""
    bins = rows.sparkSession.createDataFrame([(i, lo, hi, i == len(edges) - 2) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lo double, hi double, closed boolean")
    own = rows.select(*by, value.cast("double").alias("v"))
    bin_ = F.when(F.col("v") == edges[-1], F.lit(len(edges) - 2)).otherwise(F.lit(sum(1 for _ in edges)) - 1 - F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e > F.col("v"))))
    counts = own.where((F.col("v") >= edges[0]) & (F.col("v") <= edges[-1])).groupBy(*by, bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    dense = own.select(*by).distinct().crossJoin(F.broadcast(bins)).join(counts, [*by, "bin"], "left").na.fill(0, ["n"])
    return dense.select(*by, "bin", "lo", "hi", "n", F.round(100.0 * F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy(*by))), 6).alias("percent"))


def thresholds(rows: DataFrame, by: list[str], value: Column, limits: list[float]) -> DataFrame:
    """Counts and shares of values strictly below each limit; 0 over no rows."""
    cut = rows.sparkSession.createDataFrame([(x,) for x in limits], "limit double")
    per = rows.select(*by, value.alias("v")).crossJoin(F.broadcast(cut)).groupBy(*by, "limit")
    return per.agg(F.count_if(F.col("v") < F.col("limit")).alias("below"), F.round(F.coalesce(F.try_divide(F.count_if(F.col("v") < F.col("limit")), F.count("*")), F.lit(0.0)), 9).alias("fraction"))


def dense_counts(rows: DataFrame, splits: tuple[str, ...], classes: int) -> DataFrame:
    """Class by split with a total, zero-filled, from one grouping-sets aggregate."""
    spark = rows.sparkSession
    dim = spark.createDataFrame([(s,) for s in (*splits, "total")], "split string").crossJoin(spark.range(classes).withColumnRenamed("id", "class_id"))
    got = rows.groupingSets([["split", "class_id"], ["class_id"]], "split", "class_id").agg(F.count("*").alias("n"), F.grouping("split").alias("g"))
    got = got.select(F.when(F.col("g") == 1, "total").otherwise(F.col("split")).alias("split"), "class_id", "n")
    return dim.join(got, ["split", "class_id"], "left").na.fill(0, ["n"])


def pooled(rows: DataFrame, by: list[str], n: str, total: str, squares: str) -> DataFrame:
    """Pooled mean and deviation from partial sums and square sums."""
    g = rows.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(total).alias("s"), F.sum(squares).alias("q"))
    mean = F.col("s") / F.col("n")
    return g.select(*by, "n", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)), 6).alias("std"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation from the counts of distinct values; null below three rows or without spread.

    Ranks come from each column's histogram, sorted by range: no task holds
    all distinct values.
    """

    def ranks(c: str, name: str) -> DataFrame:
        h = ordinals(rows.groupBy(c).agg(F.count("*").alias("n")), [], [F.asc(c)], "place", "part")
        h = running_sum(h, [], "part", "place", "n", "upto")
        return h.select(c, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0).alias(name))

    r = rows.join(ranks(a, "ra"), a).join(ranks(b, "rb"), b).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")).alias("r"))
    ok = (F.col("n") >= 3) & F.col("r").isNotNull()
    return r.select("n", F.round(F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))), 9).alias("rho"))
