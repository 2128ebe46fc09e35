"""The later queries against their SQL, evidence of literal scenes, and observed contracts."""

import hashlib
import os

import duckdb
import glob
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import analysis, evidence, matching, observed, selection, versions
from fieldglass.operators.contracts import ContractError
from fieldglass.plans import datasets, more  # noqa: F401  (they register queries)
from fieldglass.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
BOX = "image_id long, {} long, class_id long, x0 long, y0 long, x1 long, y1 long"
LATER = sorted(n for n in ORACLE if QUERIES[n].__module__ != "fieldglass.plans.queries")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", LATER)
def test_query(spark, duck, name):
    def rows(cols, data):
        order = sorted(range(len(cols)), key=cols.__getitem__)
        return sorted(cols), sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in (r[i] for i in order)) for r in data)

    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLE[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in got.description], got.fetchall())


def scene(spark, preds, gts):
    p = spark.createDataFrame(preds, BOX.format("pred_id") + ", conf long")
    g = spark.createDataFrame(gts, BOX.format("gt_id"))
    v = matching.overlaps(p, g)
    return p, g, v, matching.assign(v)


def test_missed_targets(spark):
    """One target that another one's prediction would fit, one with all kinds of candidates, one with none."""
    gts = [(1, 1, 0, 0, 0, 10, 10), (1, 2, 0, 0, 0, 10, 9), (2, 1, 1, 0, 0, 10, 10), (3, 1, 2, 0, 0, 10, 10)]
    preds = [
        (1, 1, 0, 0, 0, 10, 10, 90),
        (2, 1, 1, 0, 0, 10, 10, 20), (2, 2, 2, 0, 0, 10, 10, 80), (2, 3, 1, 0, 0, 10, 4, 80), (2, 4, 2, 0, 0, 10, 9, 10), (2, 5, 2, 0, 0, 10, 3, 90), (2, 6, 2, 0, 0, 10, 2, 5), (2, 7, 1, 0, 0, 3, 10, 3), (2, 8, 1, 0, 0, 10, 10, 5),
        (3, 1, 2, 50, 50, 60, 60, 90),
    ]
    p, g, v, m = scene(spark, preds, gts)
    e = evidence.missed_targets(v, g, m)
    evidence.require_claimed(e)
    got = {(r.image_id, r.gt_id): r for r in e.collect()}
    assert got.keys() == {(1, 2), (2, 1), (3, 1)}
    a, b, c = got[1, 2], got[2, 1], got[3, 1]
    assert a.primary == "matching_conflict" and [tuple(x) for x in a.competing] == [(1, 1)] and a.best.pred_id == 1 and a.nearby == 1
    combos = {n: b[n] for n in evidence.COMBINATIONS}
    assert combos == {
        "correct_class_high_confidence_sufficient_overlap": [],
        "correct_class_high_confidence_poor_overlap": [3],
        "correct_class_low_confidence_sufficient_overlap": [1, 8],
        "correct_class_low_confidence_poor_overlap": [7],
        "wrong_class_high_confidence_sufficient_overlap": [2],
        "wrong_class_high_confidence_poor_overlap": [5],
        "wrong_class_low_confidence_sufficient_overlap": [4],
        "wrong_class_low_confidence_poor_overlap": [6],
    }
    # of three that cover it all, the most confident is the best
    assert b.primary == "mixed_or_unresolved" and (b.best.pred_id, b.best.class_id, b.best.conf) == (2, 2, 80) and b.nearby == 8 and b.jointly_imperfect_candidate
    assert c.primary == "complete_miss" and c.nearby == 0 and c.best is None and c.best_iou == 0.0 and c.competing == []
    n = {(r.kind, r.name): r.n for r in evidence.combination_counts(e).collect()}
    assert n["flag", "matching_conflict"] == 1 and n["flag", "retained_nearby_candidate"] == 2 and n["combination", "wrong_class_low_confidence_poor_overlap"] == 1 and len(n) == 14
    # a matching that left an eligible prediction free is refused
    none = evidence.missed_targets(v, g, m.where("image_id <> 1"))
    with pytest.raises(ContractError, match="eligible prediction that is free"):
        evidence.require_claimed(none)


def test_fp_reports(spark):
    gts = [(1, 1, 0, 0, 0, 10, 10), (1, 2, 1, 40, 40, 50, 50)]
    preds = [(1, 1, 0, 0, 0, 10, 10, 90), (1, 2, 0, 0, 0, 10, 9, 80), (1, 3, 1, 0, 0, 10, 9, 70), (1, 4, 3, 80, 80, 90, 90, 60), (2, 1, 3, 0, 0, 5, 5, 50), (2, 2, 3, 0, 0, 5, 5, 10)]
    p, g, v, m = scene(spark, preds, gts)
    probes = analysis.fp_probes(p, g, m, v)
    got = {r.class_id: r for r in evidence.fp_class_report(probes).collect()}
    assert sorted(got) == list(range(-1, 6))
    every, zero, one, three, five = (got[c] for c in (-1, 0, 1, 3, 5))
    assert (every.fp, every.duplicate_like, every.same_class, every.other_class, every.share, every.conf_mean) == (4, 1, 1, 2, 100.0, 65.0)
    assert (zero.fp, zero.duplicate_like, zero.share) == (1, 1, 25.0) and (one.fp, one.other_class) == (1, 1) and (three.fp, three.conf_median, three.conf_count) == (2, 55.0, 2)
    assert (five.fp, five.share, five.conf_count, five.conf_mean) == (0, 0.0, 0, None)
    assert {(r.image_id, r.pred_id): r.context_id for r in evidence.fp_context(p, g, v, probes).collect()} == {(1, 2): 1, (1, 3): 1, (1, 4): 1, (2, 1): None}


def test_observed_contracts(spark, tmp_path):
    rows = spark.createDataFrame([("train", i, i % 2, float(i)) for i in range(6)] + [("valid", 9, 1, 1.0)], "split string, id int, class_id int, v double")
    numbers = observed.split_numbers("split", 2, ("train", "valid"), "class_id")
    want = observed.expected_numbers({"train": 6, "valid": 1}, {"train": [3, 3], "valid": [0, 1]})
    path = str(tmp_path / "out")
    seen = []
    for bound, expected in ((100.0, want), (4.5, want), (100.0, want | {"valid_class_1": 2}), (100.0, want)):
        watched, told = observed.observe(rows, {"v": F.col("v") > bound, "id": F.col("id").isNull()}, numbers, F.col("id"), expected)
        try:
            seen.append(observed.publish(watched, told, path)["rows"])
        except ContractError as e:
            seen.append(str(e).split(": ", 1)[1])
        assert sorted(os.listdir(tmp_path)) == ["out"] and spark.read.parquet(path).count() == 7
    assert seen == [7, "v: 1 of 7 rows, for example 5", "valid_class_1 is 1, not 2", 7]
    watched, told = observed.observe(rows.withColumn("v", F.lit(None).cast("double")), {"v": F.col("v") > 1})
    with pytest.raises(ContractError, match="v: 7 of 7"):
        observed.publish(watched, told, path)
    with pytest.raises(ContractError, match="no number is called x"):
        observed.observe(rows, {}, {}, None, {"x": 1})
    # a write that fails leaves nothing either
    watched, told = observed.observe(rows.withColumn("v", F.raise_error(F.lit("lost"))), {})
    with pytest.raises(Exception, match="lost"):
        observed.publish(watched, told, path)
    assert sorted(os.listdir(tmp_path)) == ["out"]


def test_order_free(spark):
    rows = spark.createDataFrame([(i, i % 5) for i in range(50)], "id int, v int")
    first = lambda d: [r.id for r in d.orderBy("v", "id").limit(3).collect()]
    assert observed.order_free(first, rows) == [0, 5, 10]
    with pytest.raises(ContractError, match="order"):
        observed.order_free(lambda d: [r.id for r in d.limit(3).collect()], rows)


def test_difficulty_tables(spark):
    """Groups by the least member, splits and sources joined; suffixes counted in any case; images without boxes."""
    from fieldglass.operators import difficulty

    rows = spark.createDataFrame([(1, "train", "s"), (2, "valid", "s"), (3, "train", "t"), (4, "train", "u"), (8, "valid", "v"), (9, "valid", "v")], "id long, split string, source string")
    edges = spark.createDataFrame([(2, 3), (1, 2), (9, 8), (4, 4)], "a long, b long")
    got = sorted(tuple(r) for r in difficulty.derivative_groups(edges, rows).select("id", "group_id", "member_count", "cross_split", "splits", "source_count", "sources").collect())
    assert got == [(1, 1, 3, True, "train | valid", 2, "s | t"), (2, 1, 3, True, "train | valid", 2, "s | t"), (3, 1, 3, True, "train | valid", 2, "s | t"), (8, 2, 2, False, "valid", 1, "v"), (9, 2, 2, False, "valid", 1, "v")]
    assert difficulty.derivative_groups(edges.where("false"), rows).count() == 0
    files = spark.createDataFrame([("train", ".JPG"), ("train", ".jpg"), ("train", ".png")], "split string, suffix string")
    assert difficulty.format_counts(files, ["split"]).first().image_formats == {".jpg": 2, ".png": 1}
    images = spark.createDataFrame([(1, "train", 100, 200), (2, "train", 100, 100)], "image_id long, split string, width int, height int")
    boxes = spark.createDataFrame([(1, 5, 0, 0, 10, 20), (1, 2, 0, 0, 10, 10)], "image_id long, class_id int, x0 int, y0 int, x1 int, y1 int")
    assert {r.image_id: (r.classes, r.smallest_area) for r in difficulty.class_sets(boxes, images).collect()} == {1: ([2, 5], 100.0), 2: ([], None)}
    d = {(r.subject, r.metric): r for r in difficulty.split_measures(images, boxes).collect()}
    assert len(d) == 17 and (d["image", "annotations_per_positive_image"]["count"], d["image", "annotations_per_positive_image"]["mean"]) == (1, 2.0)
    assert d["box", "effective_short_side"].median == 32.0 and d["box", "normalized_area"].max == 0.01


def test_lineage_scores_differing_rows_once(spark, tmp_path):
    """Best old rows as from all pairs, null keys and ids included, from scores of the rows that differ alone."""
    told = str(tmp_path / "scored")
    new = [(i, None if i % 41 == 0 else i % 2, i % 3) for i in range(200)]
    old = [(None if i % 37 == 0 else i, i % 4, i % 3) for i in range(1, 150)]

    @F.udf("long")
    def score(a, b):
        with open(told, "a") as out:
            out.write("x")
        return -abs(a - b)

    n, o = (spark.createDataFrame(r, "id long, k long, s long") for r in (new, old))
    got = {r.new_id: (r.old_id, r.candidates) for r in versions.lineage(n, o, "k", score("n.s", "o.s")).collect()}
    want = {}
    for i, k, s in new:
        mine = [(-abs(s - t), -j, j) for j, q, t in old if j is not None and k is not None and q == k]
        want[i] = (max(mine)[2], len(mine)) if mine else (None, 0)
    assert got == want and len(open(told).read()) < 200



def test_quota_is_cut_before_rows_move(spark):
    """Each task keeps a category's first rows, so no task gets a whole category."""
    rows = spark.range(0, 4000, 1, 4).select("id", F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("c"))
    out = selection.quota(rows, "c", {"a": 6, "b": 3}, 7, "id")
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    rank = lambda c, i: hashlib.sha256(f'[7,"{c}",{i}]'.encode()).hexdigest()
    want = {(c, n + 1, i) for c, q in (("a", 6), ("b", 3)) for n, i in enumerate(sorted((i for i in range(4000) if (i % 5 == 0) == (c == "b")), key=lambda i: (rank(c, i), i))[:q])}
    assert {(r.category, r.pick, r.id) for r in out.collect()} == want


def _noted(told):
    """A flag, always true, that leaves a mark for every row it is worked out for."""

    @F.udf("boolean")
    def note(_):
        with open(told, "a") as out:
            out.write("x")
        return True

    return note


def test_pools_are_worked_out_once(spark, tmp_path):
    told = str(tmp_path / "pools")
    pools = spark.range(60).select(F.lit("complete_miss").alias("category"), F.col("id").alias("image_id"), F.col("id").alias("gt_id"), F.lit(None).cast("long").alias("pred_id"), (F.col("id") % 6).alias("class_id"), (F.col("id") % 3).cast("int").alias("size_group"), (~_noted(told)("id")).alias("duplicate_like"))
    cases, short = selection.select_cases(pools, 7)
    assert len(cases) == 8 and short[0]["pool"] == 60 and len(open(told).read()) == 60


def test_annotations_are_worked_out_once(spark, tmp_path):
    told = str(tmp_path / "rows")
    i = F.col("id")
    rows = spark.range(50).select(F.lit("train").alias("split"), i.alias("image_id"), F.lit(1).cast("long").alias("gt_id"), (i % 6).alias("class_id"), F.when(_noted(told)("id"), i / 50.0).alias("occupancy"), *[(i * k % 53 / 53.0).alias(c) for k, c in ((7, "area"), (11, "border"), (13, "aspect"))])
    assert selection.review_annotations(rows).count() > 10 and len(open(told).read()) == 50
