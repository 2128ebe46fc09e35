"""What a task holds and how often rows move doesn't grow with the tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldglass import scene as S
from fieldglass.operators import evidence, matching, selection, stats, versions
from fieldglass.plans import datasets, more, scratch  # noqa: F401  (they register their queries)
from fieldglass.plans.queries import QUERIES, _sized

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture()
def found(spark):
    p, g = S.boxes(spark, SF)
    v = matching.overlaps(p, g)
    return v, g, matching.assign(v)


def test_reconciliation_is_dealt_by_size(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(scratch, "TASK_ROWS", 100)
    assert S.tasks(spark, SF) == -(-rows // 100)
    dealt = []
    keep = scratch.stage
    monkeypatch.setattr(scratch, "stage", lambda df, *a, **k: dealt.append((spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"))) or keep(df, *a, **k))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(scratch, "TASK_ROWS", rows // 9)
    assert all(r.holds for r in QUERIES["reconciliation"](spark, SF).collect())
    assert dealt and set(dealt) == {(str(S.tasks(spark, SF)), "false")} and S.tasks(spark, SF) > 8 and spark.conf.get("spark.sql.shuffle.partitions") == before


def test_only_counted_values_are_placed(spark, monkeypatch):
    kept = {}
    keep = stats.stage

    def stage(df, label, *a):
        kept[label] = kept.get(label, 0) + df.count()
        return keep(df, label, *a)

    monkeypatch.setattr(stats, "stage", stage)
    n = 40_000
    df = spark.range(n).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 2 == 0, F.col("id") % 50).otherwise(F.sqrt(F.col("id").cast("double"))).cast("double").alias("v"))
    got = {r.k: r for r in stats.selected(df, ["k"], [0.25, 0.5], True).collect()}
    assert got[0].q1 == 24.0 and got[0].n == n // 2 and got[1].q0 == pytest.approx(((n / 4 - 1) ** 0.5 + (n / 4 + 1) ** 0.5) / 2, rel=1e-4)
    assert kept["values"] < n / 50


def test_places_of_extreme_values(spark):
    values = [float("-inf"), -1e300, -2.5, -1e-300, -0.0, 0.0, 5e-324, 1.0, 1.0, 1e308, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    r = stats.selected(df, [], [i / 11 for i in range(12)]).collect()[0]
    assert r.n == 12 and [r.q3, r.q4, r.q5, r.q7, r.q8] == pytest.approx([-1e-300, 0.0, 0.0, 1.0, 1.0]) and r.q11 != r.q11


def test_missed_targets_move_once(found):
    v, g, m = found
    text = plan(evidence.missed_targets(v, g, m))
    assert text.count("Join ") == text.split("Union", 1)[1].count("Join ") and text.count("RepartitionByExpression [image_id") == 1


def test_counts_of_combinations_gather_nothing(found):
    v, g, m = found
    assert plan(evidence.combination_counts(evidence.missed_targets(v, g, m.localCheckpoint()))).count("collect_list") == 0


@pytest.mark.parametrize("name", ["review_candidates", "occupancy_grouping", "class_semantics", "label_issues"])
def test_the_scene_is_not_worked_out_again(spark, monkeypatch, name):
    S.placed(spark, SF)
    monkeypatch.setattr(S, "_rows", lambda *a: pytest.fail("numbered again"))
    assert "row_number() windowspecdefinition(l_orderkey" not in plan(QUERIES[name](spark, SF))


def test_sizes_meet_no_images_again(spark):
    out = selection.review(_sized(spark, SF), {"smallest": [F.asc("short_side")]}, 10, ["image_id", "gt_id"])
    assert "Join" not in plan(out)


def test_split_measures_read_the_written_scene(spark, monkeypatch):
    S.placed(spark, SF)
    monkeypatch.setattr(S, "_rows", lambda *a: pytest.fail("numbered again"))
    assert QUERIES["split_measures"](spark, SF).count() == 51


def test_label_sides_move_at_once(spark):
    old = spark.createDataFrame([("a", 1, "0", [0.0, 0.0, 1.0, 1.0]), (None, 1, "0", [0.0, 0.0, 1.0, 1.0])], "image string, line_number int, class_name string, coords array<double>")
    out = versions.compare_labels(old, old.withColumn("class_name", F.lit("1")), "image")
    assert "Join" not in plan(out)
    got = sorted((r.image or "", r.old_count, r.new_count, len(r.transitions)) for r in out.collect())
    assert got == [("", 0, 1, 0), ("", 1, 0, 0), ("a", 1, 1, 1)]
