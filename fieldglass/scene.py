"""Schemas, parameters, and the scene: images, targets and predictions.

The scene renders annotated images over the star-schema tables: orders are
images, line items are boxes.  Coordinates are integers, orders total.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.plans.scratch import once, tasks as tasks_for

#: Parameters of an evaluation; classes are 0 .. CLASSES - 1.
SPLITS = ("train", "valid", "test")
CLASSES = 6
TARGET_SIDE = 640


@dataclass(frozen=True)
class Point:
    """An operating point: confidence in hundredths, overlap, and class equality."""

    confidence: int = 25
    overlap: float = 0.5
    aware: bool = True


REFERENCE = Point()

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
EXPORT = (
    "sample_id string, split string, image string, width int, height int, image_sha256 string, label_sha256 string, "
    "predictions array<struct<box_id:string,class_id:int,xyxy:array<double>,confidence:double>>, "
    "ground_truth array<struct<box_id:string,class_id:int,xyxy:array<double>>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    split = F.when(o % 10 < 7, "train").when(o % 10 < 9, "valid").otherwise("test")
    return table(spark, sf_dir, "orders").select(o.alias("image_id"), split.alias("split"), (F.lit(400) + (o * 37) % 1600).alias("width"), (F.lit(300) + (o * 53) % 1700).alias("height"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = "l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
    rn = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order))
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", *order).repartition(tasks_for(lines), "l_orderkey").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_discount") * 100).cast("long").alias("d"), rn.alias("rn")
    )


def _box(shift) -> list:
    x, y = (F.col("pk") % 7) * 10, (F.col("sk") % 5) * 10
    return [(x + shift).alias("x0"), (y + shift).alias("y0"), (x + 40 + F.col("q") % 20).alias("x1"), (y + 40 + F.col("q") % 15).alias("y1")]


def targets(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """image_id, gt_id, class_id, x0, y0, x1, y1."""
    return (rows or _rows(spark, sf_dir)).where("rn % 2 = 1").select("image_id", F.col("rn").alias("gt_id"), (F.col("pk") % CLASSES).alias("class_id"), *_box(F.lit(0)))


def predictions(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """image_id, pred_id, class_id, x0, y0, x1, y1, conf (in hundredths)."""
    cls = (F.col("pk") + F.when(F.col("d") > 7, 1).otherwise(0)) % CLASSES
    return (rows or _rows(spark, sf_dir)).where("rn % 3 <> 0").select("image_id", F.col("rn").alias("pred_id"), cls.alias("class_id"), *_box(F.col("d") * 2), ((F.col("q") * 17 + F.col("d") * 3) % 100).alias("conf"))


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, targets) from rows that are numbered and written once for each folder of tables."""
    rows = scene_rows(spark, sf_dir)
    return predictions(spark, sf_dir, rows), targets(spark, sf_dir, rows)


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Over how many tasks work on the scene's rows is dealt: more with more rows."""
    return tasks_for(table(spark, sf_dir, "lineitem"))


def scene_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered rows that boxes are made of, written once for each folder of tables."""
    return once(spark, sf_dir, lambda: _rows(spark, sf_dir), "scene")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with their image's split, width and height, written once for each folder of tables: they meet in tasks of bounded size."""

    def met() -> DataFrame:
        n = tasks(spark, sf_dir)
        g = targets(spark, sf_dir, scene_rows(spark, sf_dir))
        return g.repartition(n, "image_id").join(images(spark, sf_dir).repartition(n, "image_id"), "image_id")

    return once(spark, sf_dir, met, "placed")


SQL = """
with recursive scene_image as (
  select o_orderkey image_id, case when o_orderkey%10<7 then 'train' when o_orderkey%10<9 then 'valid' else 'test' end split,
    400+(o_orderkey*37)%1600 width, 300+(o_orderkey*53)%1700 height from orders),
scene_row as (
  select l_orderkey image_id, l_partkey pk, l_suppkey sk, cast(l_quantity as bigint) q, cast(round(l_discount*100) as bigint) d,
    row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate) rn from lineitem),
gt as (
  select image_id, rn gt_id, pk%6 class_id, (pk%7)*10 x0, (sk%5)*10 y0, (pk%7)*10+40+q%20 x1, (sk%5)*10+40+q%15 y1 from scene_row where rn%2=1),
pred as (
  select image_id, rn pred_id, (pk+case when d>7 then 1 else 0 end)%6 class_id, (pk%7)*10+d*2 x0, (sk%5)*10+d*2 y0,
    (pk%7)*10+40+q%20 x1, (sk%5)*10+40+q%15 y1, (q*17+d*3)%100 conf from scene_row where rn%3<>0),
near as (
  select p.image_id, p.pred_id, g.gt_id, p.class_id pc, g.class_id gc, p.conf,
    greatest(0, least(p.x1,g.x1)-greatest(p.x0,g.x0))*greatest(0, least(p.y1,g.y1)-greatest(p.y0,g.y0)) i,
    (p.x1-p.x0)*(p.y1-p.y0)+(g.x1-g.x0)*(g.y1-g.y0) a
  from pred p join gt g on p.image_id=g.image_id),
iou as (select image_id, pred_id, gt_id, pc, gc, conf, case when a-i<=0 then 0.0::double else i::double/(a-i)::double end v from near)
"""
