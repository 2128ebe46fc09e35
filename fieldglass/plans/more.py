"""More operators as queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass import scene as S
from fieldglass.functions import geometry as G
from fieldglass.operators import analysis, contracts, duplicates, evidence, matching, selection, stats, versions
from fieldglass.operators.stats import PERCENTILES
from fieldglass.plans import scratch
from fieldglass.plans.queries import _BITS, _FP, _SIZED, _TAX, _all, _describe_sql, _near, _sized, match_sql, query


def long_sql(v: str, prefix: str = "") -> str:
    q = ", ".join(f"round(quantile_cont({v}, {p / 100.0}), 6) {prefix}p{p}" for p in PERCENTILES)
    return f"count({v}) {prefix}count, round(avg({v}),6) {prefix}mean, round(median({v}),6) {prefix}median, round(stddev_pop({v}),6) {prefix}std, round(min({v}),6) {prefix}min, round(max({v}),6) {prefix}max, {q}"


_PROBE = (
    _FP
    + """, kept as (select p.*, exists(select 1 from m where m.image_id=p.image_id and m.pred_id=p.pred_id) hit from pred p where conf>=25),
ov as (select a.image_id, a.pred_id, b.hit bh, a.class_id=b.class_id same,
  greatest(0,least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0,least(a.y1,b.y1)-greatest(a.y0,b.y0)) i, (a.x1-a.x0)*(a.y1-a.y0)+(b.x1-b.x0)*(b.y1-b.y0) u
  from kept a join kept b on a.image_id=b.image_id and a.pred_id<>b.pred_id and not a.hit),
fl as (select image_id, pred_id, bool_or(same and bh) dup, bool_or(same) sc, bool_or(not same) oc from ov where u-i>0 and i::double/(u-i)::double>=0.5 group by 1,2),
pr as (select fp.image_id, fp.pred_id, fp.class_id, fp.conf, exists(select 1 from gt where gt.image_id=fp.image_id) annotated,
  coalesce(dup,false) duplicate_like, coalesce(sc,false) same_class, coalesce(oc,false) other_class,
  (select max(v) from iou where iou.image_id=fp.image_id and iou.pred_id=fp.pred_id) best_iou from fp left join fl using (image_id, pred_id))"""
)


def _probes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, g, v = _all(spark, d)
    return analysis.fp_probes(p, g, matching.assign(v), v), p, g


@query(_PROBE + " select image_id, pred_id, class_id, conf, annotated, duplicate_like, same_class, other_class, round(best_iou, 9) best_iou from pr")
def fp_probes(spark: SparkSession, d: str) -> DataFrame:
    return _probes(spark, d)[0].withColumn("best_iou", F.round("best_iou", 9))


@query(
    _PROBE
    + f""", im as (select image_id, exists(select 1 from gt where gt.image_id=scene_image.image_id) annotated from scene_image),
gr as (select a annotated from (values (true),(false)) t(a)), n as (select annotated, count(*) images from im group by 1),
x as (select annotated, count(*) fp, count(distinct image_id) images_with_fp, {long_sql("conf::double", "conf_")} from pr group by 1),
j as (select gr.annotated, coalesce(images,0) images, coalesce(fp,0) fp, coalesce(images_with_fp,0) images_with_fp, coalesce(conf_count,0) conf_count, x.* exclude (annotated, fp, images_with_fp, conf_count) from gr left join n using (annotated) left join x using (annotated))
select *, round(100.0::double*fp/nullif(sum(fp) over (),0),9) percentage_of_fp, round(100.0::double*images_with_fp/nullif(images,0),9) percentage_images_with_fp,
  round(fp::double/nullif(images,0),9) fp_per_image, round(fp::double/nullif(images_with_fp,0),9) fp_per_image_with_fp from j"""
)
def fp_image_groups(spark: SparkSession, d: str) -> DataFrame:
    probes, _, g = _probes(spark, d)
    return analysis.fp_image_groups(probes, S.images(spark, d), g)


@query(_PROBE + """, k as (select a annotated, range class_id from (values (true),(false)) t(a) cross join range(6)), c as (select annotated, class_id, count(*) fp from pr group by 1,2),
j as (select annotated, class_id, coalesce(fp,0) fp from k left join c using (annotated, class_id)) select *, round(100.0::double*fp/nullif(sum(fp) over (partition by annotated),0),6) share from j""")
def fp_by_class(spark: SparkSession, d: str) -> DataFrame:
    return analysis.fp_by_class(_probes(spark, d)[0])


@query(
    S.SQL
    + match_sql()
    + match_sql(aware=False, name="k")
    + """, c as (select g.class_id gc, p.class_id pc from k join gt g using (image_id, gt_id) join pred p using (image_id, pred_id)),
t as (select count(*) geometric, count(*) filter (gc=pc) right_class from c),
s as (select count(*) filter (m.gt_id is null) gained, count(*) filter (k.gt_id is null) lost, count(*) filter (m.gt_id is not null and k.gt_id is not null) in_both from k full outer join m on m.image_id=k.image_id and m.gt_id=k.gt_id)
select geometric, right_class, geometric-right_class wrong_class, round(100.0::double*(geometric-right_class)/geometric,6) wrong_share, gained, lost, in_both from t cross join s"""
)
def confusion_summary(spark: SparkSession, d: str) -> DataFrame:
    p, g, v = _all(spark, d)
    return analysis.confusion_summary(matching.assign(v, S.Point(aware=False)), matching.assign(v), p, g)


_CATS = ", ".join(f"('{c}')" for c in analysis.CATEGORIES)


@query(_TAX + f""", k as (select a category, range class_id from (values {_CATS}) t(a) cross join range(-1,6)),
n as (select -1 class_id, p category, count(*) n from t group by 2 union all select class_id, p, count(*) from t group by 1,2),
j as (select class_id, category, coalesce(n,0) n from k left join n using (class_id, category)) select *, round(100.0::double*n/nullif(sum(n) over (partition by class_id),0),6) share from j""")
def taxonomy_summary(spark: SparkSession, d: str) -> DataFrame:
    _, g, v = _all(spark, d)
    return analysis.taxonomy_summary(matching.taxonomy(v, g, matching.assign(v)))


@query(_TAX + """ select 'matching_conflict' flag, count(*) filter (a) n from fl union all select 'low_confidence_detection', count(*) filter (b) from fl union all select 'classification_error', count(*) filter (c) from fl
 union all select 'localization_failure', count(*) filter (e) from fl union all select 'retained_nearby_candidate', count(*) filter (n) from fl union all select 'jointly_imperfect_candidate', count(*) filter (j) from fl""")
def taxonomy_flags(spark: SparkSession, d: str) -> DataFrame:
    _, g, v = _all(spark, d)
    names = ["matching_conflict", "low_confidence_detection", "classification_error", "localization_failure", "retained_nearby_candidate", "jointly_imperfect_candidate"]
    return analysis.flag_counts(matching.taxonomy(v, g, matching.assign(v)), names)


@query(
    S.SQL
    + match_sql()
    + f""", t as (select g.class_id, count(*) tp, {long_sql("m.v", "iou_")} from m join gt g using (image_id, gt_id) group by 1), np as (select class_id, count(*) np from pred where conf>=25 group by 1), su as (select class_id, count(*) support from gt group by 1),
j as (select range class_id, coalesce(support,0) support, coalesce(tp,0) tp, coalesce(iou_count,0) iou_count, t.* exclude (class_id, tp, iou_count), coalesce(np,0)-coalesce(tp,0) fp, coalesce(support,0)-coalesce(tp,0) fn
  from range(6) r left join su on su.class_id=range left join np on np.class_id=range left join t on t.class_id=range)
select *, round(case when tp+fp=0 then 0.0::double else tp::double/(tp+fp) end,9) "precision", round(case when tp+fn=0 then 0.0::double else tp::double/(tp+fn) end,9) recall, round(case when 2*tp+fp+fn=0 then 0.0::double else (2*tp)::double/(2*tp+fp+fn) end,9) f1,
  round(100.0::double*support/sum(support) over (),6) support_share, support<30 low_support, tp<30 low_matches from j"""
)
def class_table(spark: SparkSession, d: str) -> DataFrame:
    p, g, v = _all(spark, d)
    return analysis.class_table(matching.assign(v), p, g)


@query(
    S.SQL
    + match_sql()
    + _SIZED
    + """, r as (select class_id, case when sh<32 then 0 when sh<64 then 1 else 2 end size_group, m.pred_id from sz left join m using (image_id, gt_id)),
g as (select class_id, size_group, count(*) s, count(pred_id) t from r group by 1,2 union all select -1, size_group, count(*), count(pred_id) from r group by 2),
k as (select range class_id, s size_group from range(-1,6) cross join (values (0),(1),(2)) v(s))
select class_id, size_group, coalesce(s,0) support, coalesce(t,0) tp, coalesce(s,0)-coalesce(t,0) fn, round(t::double/nullif(s,0),9) recall, coalesce(s,0)<30 low_support from k left join g using (class_id, size_group)"""
)
def size_table(spark: SparkSession, d: str) -> DataFrame:
    return analysis.size_table(_sized(spark, d), matching.assign(_all(spark, d)[2]))


_BOUNDS = [(0, 1), (1, 5), (5, 10), (10, 25), (25, 50), (50, 100)]


@query(
    S.SQL
    + f""", b as (select p.image_id, p.pred_id, p.conf::double conf, coalesce(max(v),0)::double a, coalesce(max(v) filter (pc=gc),0)::double s from pred p join (select distinct image_id from gt) using (image_id) left join iou using (image_id, pred_id) group by 1,2,3),
e(lo, hi, closed) as (values {", ".join(f"({float(a)}::double, {float(b)}::double, {str(b == 100).lower()})" for a, b in _BOUNDS)})
select lo, hi, closed, count(conf) candidates, {long_sql("conf", "conf_")}, {long_sql("a", "any_")}, {long_sql("s", "same_")}, count(*) filter (a>=0.5) any_half, count(*) filter (s>=0.5) same_half from e left join b on conf>=lo and (conf<hi or closed and conf=hi) group by 1,2,3"""
)
def confidence_table(spark: SparkSession, d: str) -> DataFrame:
    p, g, v = _all(spark, d)
    best = matching.best_overlap(v, p, g).withColumn("conf", F.col("conf").cast("double"))
    return analysis.confidence_table(best, _BOUNDS)


@query(
    S.SQL
    + match_sql()
    + f""", k as (select p.conf::double conf, m.v from pred p left join m using (image_id, pred_id) where conf>=25),
u as (select 'matched_confidence' "name", case when v is not null then conf end x from k union all select 'matched_iou', v from k union all select 'false_positive_confidence', case when v is null then conf end from k)
select "name", {long_sql("x")} from u group by 1"""
)
def reference_distributions(spark: SparkSession, d: str) -> DataFrame:
    p, _, v = _all(spark, d)
    return analysis.distributions(matching.assign(v), p)


@query(
    S.SQL
    + f""", n as (select image_id, count(*) n from gt group by 1), i as (select s.*, coalesce(n,0) n, case when width::double/height<0.95 then 'portrait' when width::double/height>1.05 then 'landscape' else 'approximately_square' end o from scene_image s left join n using (image_id)),
a as (select split, count(*) images, count(*) filter (n>0) positive_images, sum(n)::bigint annotations, count(*) filter (o='portrait') portrait, count(*) filter (o='landscape') landscape, count(*) filter (o='approximately_square') approximately_square,
  count(distinct (width, height)) resolutions, {long_sql("case when n>0 then n::double end", "boxes_")} from i group by 1),
c as (select split, [{", ".join(f"count(*) filter (class_id={k})" for k in range(6))}] class_counts from gt join scene_image using (image_id) group by 1)
select a.*, class_counts, images-positive_images empty_label_images, round(100.0::double*positive_images/images,6) positive_share, round(100.0::double*(images-positive_images)/images,6) empty_share from a left join c using (split)"""
)
def split_difficulty(spark: SparkSession, d: str) -> DataFrame:
    return analysis.split_summary(S.images(spark, d), S.targets(spark, d))


_AREA = ", ar as (select *, 100.0::double*(x1-x0)*(y1-y0)/(width*height::double) pct, (x1-x0)*sc ew, (y1-y0)*sc eh from sz)"


def _measured(spark: SparkSession, d: str) -> DataFrame:
    scale = F.least(F.lit(640.0) / F.col("width"), F.lit(640.0) / F.col("height"))
    s = _sized(spark, d)
    return s.withColumn("area_pct", 100.0 * F.col("box_w") * F.col("box_h") / (F.col("width") * F.col("height"))).withColumn("effective_width", F.col("box_w") * scale).withColumn("effective_height", F.col("box_h") * scale)


@query(
    S.SQL
    + _SIZED
    + _AREA
    + """, g as (select split, class_id, count(*) annotations, count(distinct image_id) positive_images, round(median(pct),6) median_area_pct, round(quantile_cont(pct,0.25),6) p25_area_pct, round(quantile_cont(pct,0.75),6) p75_area_pct,
  round(median(ew),6) median_effective_width, round(median(eh),6) median_effective_height, round(median(sh),6) median_short_side, round(quantile_cont(sh,0.25),6) p25_short_side, round(quantile_cont(sh,0.75),6) p75_short_side from ar group by 1,2),
k as (select s split, range class_id from (values ('train'),('valid')) v(s) cross join range(6))
select split, class_id, coalesce(annotations,0) annotations, coalesce(positive_images,0) positive_images, g.* exclude (split, class_id, annotations, positive_images) from k left join g using (split, class_id)"""
)
def class_difficulty(spark: SparkSession, d: str) -> DataFrame:
    return analysis.class_difficulty(_measured(spark, d))


_METRICS = {"box_w": "(x1-x0)::double", "box_h": "(y1-y0)::double", "area_pct": "pct", "effective_width": "ew", "effective_height": "eh", "short_side": "sh"}


@query(S.SQL + _SIZED + _AREA + ", u as (" + " union all ".join(f"select class_id, '{k}' metric, {v} v from ar" for k, v in _METRICS.items()) + f"), k as (select range class_id, m metric from range(6) cross join (values {', '.join(f"('{m}')" for m in _METRICS)}) t(m)) select class_id, metric, {_describe_sql('v')} from k left join u using (class_id, metric) group by 1,2")
def box_statistics(spark: SparkSession, d: str) -> DataFrame:
    got = stats.describe_grouped(_measured(spark, d), ["class_id"], list(_METRICS))
    dim = spark.range(S.CLASSES).select(F.col("id").alias("class_id")).crossJoin(spark.createDataFrame([(m,) for m in _METRICS], "metric string"))
    return dim.join(got, ["class_id", "metric"], "left").na.fill(0, ["count"])


@query(
    S.SQL
    + ", n as (select image_id, count(*) n from gt group by 1), i as (select split, width::double w, height::double h, width::double/height a, width::double*height p, coalesce(n,0)::double n from scene_image left join n using (image_id)), u as ("
    + " union all ".join(f"select split, '{k}' metric, {v} v from i" for k, v in {"width": "w", "height": "h", "aspect": "a", "pixels": "p", "boxes": "n"}.items())
    + f") select coalesce(split,'total') split, metric, {_describe_sql('v')} from u group by grouping sets ((split, metric), (metric))"
)
def image_statistics(spark: SparkSession, d: str) -> DataFrame:
    n = S.targets(spark, d).groupBy("image_id").agg(F.count("*").alias("boxes"))
    i = S.images(spark, d).join(n, "image_id", "left").na.fill(0, ["boxes"]).withColumn("aspect", F.col("width") / F.col("height")).withColumn("pixels", F.col("width") * F.col("height"))
    return stats.describe_grouped(i, ["split"], ["width", "height", "aspect", "pixels", "boxes"], "total")


_COPIES = "with d as (select doc_id, sha256(text) h, case when doc_id%10<7 then 'train' when doc_id%10<9 then 'valid' else 'test' end split, 'c'||doc_id%2 c, source||'/'||(doc_id//50) k from documents)"


def _copies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 10
    return S.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.when(k < 7, "train").when(k < 9, "valid").otherwise("test").alias("split"), F.concat(F.lit("c"), (F.col("doc_id") % 2).cast("string")).alias("c"), F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 50).cast("string")).alias("k"))


@query(_COPIES + """, p as (select h, c, count(*) n, count(distinct split) s, min(doc_id) f from d group by 1,2)
select row_number() over (order by h) group_id, h digest, sum(n)::bigint group_size, case when max(s)>1 then 'cross_split' when max(n)>1 then 'within_split' else 'cross_candidate' end group_class, min(f) first_id, count(*)>1 cross_candidate from p group by h having sum(n)>1""")
def duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_groups(_copies(spark, d), F.col("h"), "split", "doc_id", "c")


@query(_COPIES + " select row_number() over (order by k) group_id, k, count(*) group_size, count(distinct split)>1 cross_split from d where k is not null group by k having count(*)>1")
def source_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.source_groups(_copies(spark, d).where("k is not null"), "k", "split")


@query(_BITS + """, sp as (select a.vec_id f, b.vec_id s from embeddings a join embeddings b on a.vec_id//3=b.vec_id//3 and a.vec_id<b.vec_id),
u as (select f first_id, s second_id, 'shared_source_name' r from sp union all select least(first_id,second_id), greatest(first_id,second_id), 'near_hash' from p) select first_id, second_id, string_agg(distinct r, ',' order by r) reasons from u group by 1,2""")
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 3).alias("k"))
    return duplicates.candidate_pairs(rows, "vec_id", "k", _near(spark, d))


_V2 = """, o as (select image_id, gt_id, class_id, [x0/1000.0::double, y0/1000.0::double, x1/1000.0::double, y1/1000.0::double] c from gt where image_id%11<>0),
w as (select image_id, gt_id, case when class_id=2 and gt_id%4=1 then 3 else class_id end class_id, [x0/1000.0::double+case when gt_id%5=0 then 0.0005::double when gt_id%7=0 then 0.02::double else 0 end, y0/1000.0::double, x1/1000.0::double, y1/1000.0::double] c from gt where image_id%13<>0),
pairs as (select o.image_id, o.gt_id pred_id, w.gt_id gt_id, o.class_id pc, w.class_id gc, -o.gt_id conf, -w.gt_id::double v from o join w on o.image_id=w.image_id and abs(o.c[1]-w.c[1])<=0.001::double and abs(o.c[2]-w.c[2])<=0.001::double and abs(o.c[3]-w.c[3])<=0.001::double and abs(o.c[4]-w.c[4])<=0.001::double)"""
_V2_FOLD = S.SQL + _V2 + match_sql(-1e9, -1e9, False, "m", "pairs")


def _label_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = S.boxes(spark, d)[1]
    at = lambda c: F.col(c) / 1000.0
    shift = F.when(F.col("gt_id") % 5 == 0, 0.0005).when(F.col("gt_id") % 7 == 0, 0.02).otherwise(0.0)
    row = lambda df, cls, x0: df.select("image_id", F.col("gt_id").cast("int").alias("line_number"), cls.cast("string").alias("class_name"), F.array(x0, at("y0"), at("x1"), at("y1")).alias("coords"))
    old = row(g.where("image_id % 11 <> 0"), F.col("class_id"), at("x0"))
    new = row(g.where("image_id % 13 <> 0"), F.when((F.col("class_id") == 2) & (F.col("gt_id") % 4 == 1), 3).otherwise(F.col("class_id")), at("x0") + shift)
    return old, new


@query(
    _V2_FOLD
    + """, n as (select image_id, (select count(*) from o where o.image_id=k.image_id) a, (select count(*) from w where w.image_id=k.image_id) b from (select image_id from o union select image_id from w) k),
h as (select m.image_id, count(*) h, count(*) filter (o.class_id=w.class_id) same from m join o on o.image_id=m.image_id and o.gt_id=m.pred_id join w on w.image_id=m.image_id and w.gt_id=m.gt_id group by 1)
select image_id, a::int old_count, b::int new_count, coalesce(h,0)=a and a=b coordinates_equal, coalesce(h,0)=a and a=b and coalesce(same,0)=a semantic_equal from n left join h using (image_id)"""
)
def label_versions(spark: SparkSession, d: str) -> DataFrame:
    return versions.compare_labels(*_label_versions(spark, d), "image_id").select("image_id", "old_count", "new_count", "coordinates_equal", "semantic_equal")


@query(_V2_FOLD + " select o.class_id::varchar old_class, w.class_id::varchar new_class, count(*) n from m join o on o.image_id=m.image_id and o.gt_id=m.pred_id join w on w.image_id=m.image_id and w.gt_id=m.gt_id group by 1,2")
def label_transitions(spark: SparkSession, d: str) -> DataFrame:
    return versions.class_transitions(versions.compare_labels(*_label_versions(spark, d), "image_id"))


@query(S.SQL + _V2 + " select coalesce(a.k,b.k) class_id, coalesce(a.n,0) old_n, coalesce(b.n,0) new_n, coalesce(b.n,0)-coalesce(a.n,0) difference from (select class_id k, count(*) n from o group by 1) a full outer join (select class_id k, count(*) n from w group by 1) b on a.k=b.k")
def class_counts_diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = _label_versions(spark, d)
    n = lambda df: df.select(F.col("class_name").cast("long").alias("class_id"))
    return versions.class_counts(n(old), n(new), ["class_id"])


@query("""with a as (select p_partkey%50 k, count(*) m from part group by 1), b as (select s_suppkey%60 k, count(*) n from supplier group by 1)
select coalesce(m,0)||'->'||coalesce(n,0) relation, count(*) "keys" from a full outer join b using (k) group by 1""")
def key_size_relations(spark: SparkSession, d: str) -> DataFrame:
    old = S.table(spark, d, "part").select((F.col("p_partkey") % 50).alias("k"))
    return versions.key_sizes(old, S.table(spark, d, "supplier").select((F.col("s_suppkey") % 60).alias("k")), "k")


@query(S.SQL + ", a as (select image_id, class_id, (x1-x0)*(y1-y0)/(width*height::double) r from gt join scene_image using (image_id)), t as (select count(distinct image_id) shared_images, round(median(r),9) shared_median_area from a where class_id=3 and image_id in (select image_id from a where class_id=2)) select class_id, count(distinct image_id) images, round(median(r),9) median_area, shared_images, shared_median_area from a cross join t group by 1,4,5")
def class_semantics(spark: SparkSession, d: str) -> DataFrame:
    b = S.placed(spark, d)
    return analysis.semantics(b.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("width") * F.col("height"))), 2, 3)


_PM = "l_orderkey first_id, l_partkey second_id, case when l_quantity::bigint%4=0 then 'high_confidence_derivative' when l_quantity::bigint%4=1 then 'probable_derivative' when l_quantity::bigint%4=2 then 'inconclusive' else 'unrelated_false_positive' end classification, l_suppkey%3=0 cross_split, (l_partkey%50)/10.0::double-2.5::double rotation, 0.8::double+(l_suppkey%40)/100.0::double slope, (l_suppkey%40)/100.0::double rmse, l_quantity::bigint inliers"


def _pair_rows(spark: SparkSession, d: str) -> DataFrame:
    q, p, s = F.col("l_quantity").cast("long"), F.col("l_partkey"), F.col("l_suppkey")
    kind = F.when(q % 4 == 0, "high_confidence_derivative").when(q % 4 == 1, "probable_derivative").when(q % 4 == 2, "inconclusive").otherwise("unrelated_false_positive")
    return S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("first_id"), p.alias("second_id"), kind.alias("classification"), (s % 3 == 0).alias("cross_split"), ((p % 50) / 10.0 - 2.5).alias("rotation"), (0.8 + (s % 40) / 100.0).alias("slope"), ((s % 40) / 100.0).alias("rmse"), q.alias("inliers"))


@query(f"with p as (select {_PM} from lineitem) select classification, cross_split, count(*) pairs, count(*) filter (abs(rotation)>=1.0) turned, count(*) filter (slope<0.9::double or slope>1.1::double) exposed from p group by 1,2")
def provenance_pairs(spark: SparkSession, d: str) -> DataFrame:
    return analysis.provenance_summary(_pair_rows(spark, d))


_PRIO = "case classification when 'high_confidence_derivative' then 0 when 'probable_derivative' then 1 when 'inconclusive' then 2 else 3 end"


@query(f"with p as (select distinct {_PM} from lineitem) select first_id, second_id, classification, rmse, inliers, row_number() over (order by {_PRIO}, rmse, inliers desc, first_id, second_id) place from p where cross_split qualify place<=30")
def cross_split_review(spark: SparkSession, d: str) -> DataFrame:
    return selection.cross_split_pairs(_pair_rows(spark, d).distinct()).select("first_id", "second_id", "classification", "rmse", "inliers", "place")


@query("with g as (select o_custkey k, count(*) size, count(distinct o_orderkey%5=0)>1 mixed from orders group by 1) select size, count(*) \"groups\", count(*) filter (mixed) mixed_groups from g group by 1")
def source_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 5 == 0).alias("is_empty"))
    return analysis.group_sizes(rows, "k", "is_empty")


@query("with m as (select o_custkey group_id, o_orderkey image_id, o_orderkey%5=0 e from orders) select group_id, count(*) members, count(*) filter (e) empty, min(image_id) filter (e) first_empty, min(image_id) filter (not e) first_annotated from m group by 1 having count(*) filter (e) between 1 and count(*)-1")
def mixed_groups(spark: SparkSession, d: str) -> DataFrame:
    return selection.mixed_groups(S.table(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("image_id"), (F.col("o_orderkey") % 5 == 0).alias("is_empty")))


@query("select o_orderkey, ((row_number() over (order by o_orderdate, o_orderkey)-1)//64)::bigint \"window\" from orders")
def count_windows(spark: SparkSession, d: str) -> DataFrame:
    return selection.count_windows(S.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.asc("o_orderdate"), F.asc("o_orderkey")], 64).select("o_orderkey", "window")


@query(S.SQL + " select image_id, pred_id, printf('pred/%06d', row_number() over (partition by image_id order by conf desc, class_id, x0, y0, x1, y1, pred_id)-1) box_id from pred")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    p, _ = S.boxes(spark, d)
    ranked = selection.stable_ids(p.withColumn("y1", F.col("y1") + F.col("pred_id") * 1e-9))
    return ranked.select("image_id", "pred_id", "box_id")


@query(
    S.SQL
    + """, b as (select g.*, (x1-x0)*(y1-y0)/(width*height::double) area, least(x0/width::double, y0/height::double, 1-x1/width::double, 1-y1/height::double) border from gt g join scene_image using (image_id)), p as (select image_id, count(*) n, count(distinct class_id) c from gt group by 1)
select 'class_'||class_id spec, min(image_id) image_id from b group by 1 union all select 'smallest', min_by(image_id, (area, image_id, gt_id)) from b union all select 'border', min_by(image_id, (border, image_id, gt_id)) from b
union all select 'most_boxes', min_by(image_id, (-n, image_id)) from p union all select 'several_classes', min(image_id) from p where c>1"""
)
def preview_specs(spark: SparkSession, d: str) -> DataFrame:
    b = S.targets(spark, d).join(S.images(spark, d), "image_id")
    w, h = F.col("width"), F.col("height")
    return selection.preview_specs(b.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (w * h)).withColumn("border", F.least(F.col("x0") / w, F.col("y0") / h, 1 - F.col("x1") / w, 1 - F.col("y1") / h)))


@query(S.SQL + " select distinct image_id from (select min(image_id) image_id from gt group by class_id union all (select image_id from scene_image order by image_id limit 6))")
def reproducibility_samples(spark: SparkSession, d: str) -> DataFrame:
    return selection.reproducibility_samples(S.targets(spark, d), S.images(spark, d))


@query(S.SQL + ", c as (select class_id, count(*) n from gt group by 1) select (select count(distinct (width, height)) from scene_image) resolutions, round(max(n)::double/min(n),9) class_ratio from c")
def resolution_extent(spark: SparkSession, d: str) -> DataFrame:
    return analysis.resolution_extent(S.images(spark, d), S.targets(spark, d))


@query(S.SQL + _SIZED + ", e(bin, lo, hi) as (values (0,0.0::double,16.0::double),(1,16,32),(2,32,64),(3,64,128)), c as (select split, sum(1) n0, bin from sz join e on sh>=lo and (sh<hi or bin=3 and sh=hi) group by split, bin), k as (select distinct split, bin, lo, hi from sz cross join e) select split, bin, lo, hi, coalesce(n0,0)::bigint n, round(100.0::double*coalesce(n0,0)/sum(coalesce(n0,0)) over (partition by split),6) percent from k left join c using (split, bin)")
def size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(_sized(spark, d), ["split"], F.col("short_side"), [0.0, 16.0, 32.0, 64.0, 128.0])


@query(
    """with r as (select o_orderkey i, case when o_orderkey%10<7 then 'train' when o_orderkey%10<9 then 'valid' else 'test' end split, 100+o_orderkey%17 px, (o_orderkey*7)%9000 os, (o_orderkey*11)%9000 ps, (o_orderkey*3)%5 oz, (o_orderkey*5)%7 pz, (o_orderkey%9)::double om, (o_orderkey%10)::double pm, (o_orderkey%6)::double od, (o_orderkey%8)::double pd from orders),
g as (select case when grouping(split)=1 then 'overall' else split end scope, count(*) images, sum(px)::bigint pixels, count(*) filter (pd>od) images_with_increased_std, sum(os) os, sum(os*60) oq, sum(ps) ps, sum(ps*70) pq, sum(oz) oz, sum(pz) pz, min(oz) omin, max(os) omax, min(pz) pmin, max(ps) pmax, median(om) mom, median(od) mod, median(pm) mpm, median(pd) mpd from r group by grouping sets ((split),()))
select scope, images, pixels, images_with_increased_std, round(sqrt(greatest(0.0::double,pq/pixels::double-(ps/pixels::double)*(ps/pixels::double)))-sqrt(greatest(0.0::double,oq/pixels::double-(os/pixels::double)*(os/pixels::double))),6) std_change,
round(os/pixels::double,6) original_mean, round(sqrt(greatest(0.0::double,oq/pixels::double-(os/pixels::double)*(os/pixels::double))),6) original_std, omin original_min, omax original_max, round(oz/pixels::double,9) original_zero_fraction, round(oz/pixels::double,9) original_full_fraction, round(mom,6) median_image_original_mean, round(mod,6) median_image_original_std,
round(ps/pixels::double,6) processed_mean, round(sqrt(greatest(0.0::double,pq/pixels::double-(ps/pixels::double)*(ps/pixels::double))),6) processed_std, pmin processed_min, pmax processed_max, round(pz/pixels::double,9) processed_zero_fraction, round(pz/pixels::double,9) processed_full_fraction, round(mpm,6) median_image_processed_mean, round(mpd,6) median_image_processed_std from g"""
)
def intensity_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = S.images(spark, d).select("split", F.col("image_id").alias("o_orderkey")).select("split", (100 + k % 17).alias("pixels"), *[c.alias(f"{b}_{n}") for b, s, q, z, m, e in (("original", 7, 60, (3, 5), 9, 6), ("processed", 11, 70, (5, 7), 10, 8)) for n, c in {"sum": (k * s) % 9000, "square_sum": (k * s) % 9000 * q, "min": (k * z[0]) % z[1], "max": (k * s) % 9000, "zeros": (k * z[0]) % z[1], "fulls": (k * z[0]) % z[1], "mean": (k % m).cast("double"), "std": (k % e).cast("double")}.items()])
    return analysis.intensity(rows)


_COMBO = "case when pc=gc then 'correct' else 'wrong' end||'_class_'||case when iou.conf>=25 then 'high' else 'low' end||'_confidence_'||case when iou.v>=0.5 then 'sufficient' else 'poor' end||'_overlap'"
_EVIDENCE = _TAX + f""", cd as (select fn.image_id, fn.gt_id, iou.pred_id, pc, iou.conf, iou.v, case when iou.v>=0.1 then {_COMBO} end co, m.gt_id asg
  from fn join iou on iou.image_id=fn.image_id and iou.gt_id=fn.gt_id left join m on m.image_id=iou.image_id and m.pred_id=iou.pred_id where iou.v>0)"""


def _evidence(spark: SparkSession, d: str):
    p, g, v = _all(spark, d)
    m = matching.assign(v)
    return p, g, v, m, evidence.missed_targets(v, g, m, tasks=S.tasks(spark, d))


@query(
    _EVIDENCE
    + """, ag as (select image_id, gt_id, """
    + ", ".join(f"coalesce(string_agg(pred_id::varchar, ',' order by pred_id) filter (co='{c}'), '') {c}" for c in evidence.COMBINATIONS)
    + f""", count(co) nearby, arg_min(pred_id, (-v, -conf, pred_id)) filter (v>=0.1) bp, max(v) best,
  coalesce(string_agg(pred_id||'>'||asg, ',' order by pred_id) filter (co='{evidence.FLAGS["matching_conflict"]}'), '') competing from cd group by 1, 2)
select t.image_id, t.gt_id, t.class_id, t.p "primary", """
    + ", ".join(f"coalesce(ag.{c}, '') {c}" for c in evidence.COMBINATIONS)
    + """, coalesce(nearby, 0) nearby, bp best_pred, round(coalesce(ag.best, 0), 9) best_iou, coalesce(competing, '') competing from t left join ag using (image_id, gt_id)"""
)
def fn_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every missed target with the identifiers of its candidates by combination, its best one and what competed for it."""
    e = _evidence(spark, d)[4]
    ids = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in evidence.COMBINATIONS]
    competing = F.array_join(F.transform("competing", lambda c: F.concat(c["pred_id"].cast("string"), F.lit(">"), c["assigned"].cast("string"))), ",")
    return e.select("image_id", "gt_id", "class_id", "primary", *ids, "nearby", F.col("best.pred_id").alias("best_pred"), F.round("best_iou", 9).alias("best_iou"), competing.alias("competing"))


@query(
    _EVIDENCE
    + ", ".join(["", *[f"f{i} as (select distinct image_id, gt_id from cd where co in ({', '.join(repr(c) for c in cs)}))" for i, cs in enumerate([*[(c,) for c in evidence.FLAGS.values()], evidence.JOINTLY])]])
    + " "
    + " union all ".join(
        [f'select \'flag\' kind, \'{f}\' "name", (select count(*) from f{i}) n' for i, f in enumerate([*evidence.FLAGS, "jointly_imperfect_candidate"])]
        + ["select 'flag', 'retained_nearby_candidate', (select count(*) from (select distinct image_id, gt_id from cd where co is not null))"]
        + [f"select 'combination', '{c}', (select count(*) from (select distinct image_id, gt_id from cd where co='{c}'))" for c in evidence.COMBINATIONS]
    )
)
def fn_combinations(spark: SparkSession, d: str) -> DataFrame:
    """How many missed targets have each flag and each combination of candidates."""
    with scratch.dealing(spark, S.tasks(spark, d)):
        return scratch.stage(evidence.combination_counts(_evidence(spark, d)[4]), "combinations")


@query(
    _PROBE
    + f""", ev as (select class_id::bigint class_id, conf, duplicate_like, same_class, other_class from pr union all select -1, conf, duplicate_like, same_class, other_class from pr)
select c.range class_id, count(conf) fp, count(*) filter (duplicate_like) duplicate_like, count(*) filter (same_class) same_class, count(*) filter (other_class) other_class, {long_sql('conf::double', 'conf_')},
  round(100.0::double*count(conf)/nullif((select count(*) from pr),0),6) share from range(-1,6) c left join ev on ev.class_id=c.range group by 1"""
)
def fp_class_report(spark: SparkSession, d: str) -> DataFrame:
    """False positives by predicted class with flags and confidence, and of all classes."""
    return evidence.fp_class_report(_probes(spark, d)[0])


@query(
    _PROBE
    + """, x as (select pr.image_id, pr.pred_id, (select arg_min(gt_id, (-coalesce(v,0), gt_id)) from gt left join iou using (image_id, gt_id) where gt.image_id=pr.image_id and (iou.pred_id is null or iou.pred_id=pr.pred_id)) c from pr)
select image_id, pred_id, c context_id from x"""
)
def fp_context(spark: SparkSession, d: str) -> DataFrame:
    """The target that each false positive is shown with."""
    probes, p, g = _probes(spark, d)
    return evidence.fp_context(p, g, _all(spark, d)[2], probes)


@query(
    S.SQL + match_sql() + match_sql(aware=False, name="k") + """, n as (select (select count(*) from gt) g, (select count(*) from m) tp, (select count(*) from pred where conf>=25) kept, (select count(*) from k) ag, (select count(*) from pred where image_id in (select image_id from gt)) ca)
select 'targets' identity, g left_side, g right_side, true holds from n union all select 'predictions', kept, kept, true from n union all select 'class_totals', g+kept-tp, g+kept-tp, true from n
union all select 'class_support', g, g, true from n union all select 'size_groups', g, g, true from n union all select 'confidence_bins', ca, ca, true from n union all select 'class_confusion', ag, ag, true from n
union all select 'taxonomy', g-tp, g-tp, true from n union all select 'fp_groups', kept-tp, kept-tp, true from n"""
)
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Identities between the tables of an error analysis, each side's number told."""
    n = S.tasks(spark, d)
    with scratch.dealing(spark, n):
        p, g, v = _all(spark, d)
        m = scratch.stage(matching.assign(v), "matches")
        agnostic = scratch.stage(matching.assign(v, S.Point(aware=False)), "matches")
        probes = analysis.fp_probes(p, g, m, v)
        classes = analysis.class_table(m, p, g).select("class_id", "tp", "fp", "fn", "support")
        sizes = analysis.size_table(_sized(spark, d), m)
        share = matching.best_overlap(v, p, g).withColumn("conf", F.col("conf") / 100.0)
        bins = analysis.confidence_table(share, [(0.0, 0.01), (0.01, 0.05), (0.05, 0.1), (0.1, 0.25), (0.25, 0.5), (0.5, 1.0)])
        missed = evidence.missed_targets(v, g, m, tasks=n)
        return scratch.stage(evidence.reconciled(p, g, m, agnostic, missed, probes, classes, sizes, bins, matching.confusion(agnostic, p, g)), "identities")


@query("with a as (select 'doc/'||doc_id p, sha256(coalesce(text,'')) h from documents), b as (select 'doc/'||doc_id p, sha256(coalesce(text,'')||case when doc_id%193=0 then 'x' else '' end) h from documents where doc_id%97<>5) select p path, a.h \"before\", b.h \"after\" from a left join b using (p) where a.h is distinct from b.h")
def hash_drift(spark: SparkSession, d: str) -> DataFrame:
    """Files of a baseline, one for each document, that have changed or are gone."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    docs = S.table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc/"), i.cast("string")).alias("path"), text.alias("text"))
    now = docs.where(i % 97 != 5).select("path", F.sha2(F.when(i % 193 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    return contracts.drift(docs.select("path", F.sha2("text", 256).alias("sha256")), now)


@query(S.SQL + " select image_id, gt_id, x0/width::double+(x1-x0)/width::double/2 between 0 and 1 and (x1-x0)>0 and x1<=width and y1<=height ok from gt join scene_image using (image_id)")
def box_validity(spark: SparkSession, d: str) -> DataFrame:
    b = S.targets(spark, d).join(S.images(spark, d), "image_id")
    return b.select("image_id", "gt_id", G.valid_corners({c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")}, F.col("width"), F.col("height")).alias("ok"))
