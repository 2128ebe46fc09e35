"""The operators as queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass import scene as S
from fieldglass.functions import geometry as G
from fieldglass.operators import duplicates, graph, matching, precision, sampling, selection, stats, versions
from fieldglass.sources import labels, trees

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def match_sql(conf: float = 25, overlap: float = 0.5, aware: bool = True, name: str = "m", source: str = "iou") -> str:
    """CTEs that fold an image's predictions in falling order of confidence."""
    same = "and pc = gc" if aware else ""
    return f""", {name}_c as (
  select image_id, pred_id, row_number() over (partition by image_id order by conf desc, pred_id) k,
    list(struct_pack(g := gt_id, v := v) order by v desc, gt_id) ts
  from {source} where conf >= {conf} and v >= {overlap}::double {same} group by image_id, pred_id, conf),
{name}_f as (
  select image_id, 0::bigint k, []::bigint[] used, null::struct(g bigint, v double) pick from (select distinct image_id from {name}_c)
  union all
  select c.image_id, c.k, case when p is null then f.used else list_append(f.used, p.g) end, p
  from (select f.image_id, f.k, f.used, c.k ck, list_filter(c.ts, lambda t: not list_contains(f.used, t.g))[1] p
        from {name}_f f join {name}_c c on c.image_id = f.image_id and c.k = f.k + 1) x
  join {name}_c c on c.image_id = x.image_id and c.k = x.ck
  join lateral (select x.used) f on true),
{name} as (select f.image_id, c.pred_id, f.pick.g gt_id, f.pick.v v from {name}_f f join {name}_c c on c.image_id = f.image_id and c.k = f.k where f.pick is not null)"""


def _all(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, g = S.boxes(spark, d)
    return p, g, matching.overlaps(p, g)


_PRF = """case when tp+fp=0 then 0.0::double else tp::double/(tp+fp) end "precision",
  case when tp+fn=0 then 0.0::double else tp::double/(tp+fn) end recall, case when 2*tp+fp+fn=0 then 0.0::double else (2*tp)::double/(2*tp+fp+fn) end f1"""


def _counts(aware: bool) -> str:
    return (
        S.SQL
        + match_sql(aware=aware)
        + f""", n as (select (select count(*) from m) tp, (select count(*) from pred where conf>=25)-(select count(*) from m) fp, (select count(*) from gt)-(select count(*) from m) fn)
select tp, fp, fn, {_PRF} from n"""
    )


@query(_counts(True))
def match_counts_aware(spark: SparkSession, d: str) -> DataFrame:
    p, g, v = _all(spark, d)
    return matching.totals(matching.assign(v), p, g)


@query(_counts(False))
def match_counts_agnostic(spark: SparkSession, d: str) -> DataFrame:
    p, g, v = _all(spark, d)
    point = S.Point(aware=False)
    return matching.totals(matching.assign(v, point), p, g, point)


@query(S.SQL + match_sql() + " select image_id, pred_id, gt_id, round(v, 9) iou from m")
def match_pairs(spark: SparkSession, d: str) -> DataFrame:
    return matching.assign(_all(spark, d)[2]).select("image_id", F.col("pred_id").cast("long").alias("pred_id"), F.col("gt_id").cast("long").alias("gt_id"), F.round("iou", 9).alias("iou"))


def _grid_sql() -> str:
    points = list(dict.fromkeys(p for ps in matching.GRIDS.values() for p in ps))
    out, parts = S.SQL, []
    for i, p in enumerate(points):
        out += match_sql(p.confidence, p.overlap, p.aware, f"m{i}")
        for g, own in matching.GRIDS.items():
            if p in own:
                parts.append(f"select '{g}' grid, {str(p.aware).lower()} aware, {p.confidence} min_conf, {p.overlap}::double min_iou, (select count(*) from m{i}) tp, (select count(*) from pred where conf>={p.confidence}) np")
    return out + ", n as (select grid, aware, min_conf, min_iou, tp, np-tp fp, (select count(*) from gt)-tp fn from (" + " union all ".join(parts) + f")) select grid, aware, min_conf, min_iou, tp, fp, fn, {_PRF} from n"


@query(_grid_sql())
def sensitivity_grid(spark: SparkSession, d: str) -> DataFrame:
    p, g, v = _all(spark, d)
    return matching.grids(v, p, g)


_TAX = (
    S.SQL
    + match_sql()
    + """, fn as (select * from gt where not exists (select 1 from m where m.image_id=gt.image_id and m.gt_id=gt.gt_id)),
fl as (select fn.image_id, fn.gt_id, fn.class_id,
  coalesce(bool_or(pc=gc and conf>=25 and v>=0.5), false) a, coalesce(bool_or(pc=gc and conf<25 and v>=0.5), false) b,
  coalesce(bool_or(pc<>gc and conf>=25 and v>=0.5), false) c, coalesce(bool_or(pc=gc and conf>=25 and v>=0.1 and v<0.5), false) e,
  coalesce(bool_or(v>=0.1), false) n, coalesce(max(v), 0) best,
  coalesce(bool_or((pc<>gc and conf<25 and v>=0.1) or (v>=0.1 and v<0.5 and (pc<>gc or conf<25))), false) j
  from fn left join iou on iou.image_id=fn.image_id and iou.gt_id=fn.gt_id group by 1,2,3),
t as (select *, case when a then 'matching_conflict' when b::int+c::int+e::int>1 then 'mixed_or_unresolved' when b then 'low_confidence_detection'
  when c then 'classification_error' when e then 'localization_failure' when n then 'mixed_or_unresolved' else 'complete_miss' end p from fl)"""
)


@query(_TAX + ' select image_id, gt_id, class_id, p "primary", j jointly_imperfect_candidate, round(best, 9) best_retained_iou from t')
def fn_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    _, g, v = _all(spark, d)
    t = matching.taxonomy(v, g, matching.assign(v))
    return t.select("image_id", "gt_id", "class_id", "primary", "jointly_imperfect_candidate", F.round("best_retained_iou", 9).alias("best_retained_iou"))


@query(_TAX + ' select class_id, p "primary", count(*) n, round(100.0::double*count(*)/sum(count(*)) over (partition by class_id), 6) share from t group by 1, 2')
def fn_taxonomy_by_class(spark: SparkSession, d: str) -> DataFrame:
    _, g, v = _all(spark, d)
    t = matching.taxonomy(v, g, matching.assign(v)).groupBy("class_id", "primary").agg(F.count("*").alias("n"))
    return t.withColumn("share", F.round(G.percentage(F.col("n"), F.sum("n").over(W.partitionBy("class_id"))), 6))


@query(
    S.SQL
    + match_sql(aware=False)
    + ", j as (select g.class_id gc, p.class_id pc from m join gt g using (image_id, gt_id) join pred p using (image_id, pred_id)) select c.range class_id, "
    + ", ".join(f"count(pc) filter (pc={k}) pred_{k}" for k in range(6))
    + " from range(6) c left join j on j.gc=c.range group by 1"
)
def class_confusion(spark: SparkSession, d: str) -> DataFrame:
    p, g, v = _all(spark, d)
    return matching.confusion(matching.assign(v, S.Point(aware=False)), p, g)


_FP = S.SQL + match_sql() + ", fp as (select * from pred where conf>=25 and not exists (select 1 from m where m.image_id=pred.image_id and m.pred_id=pred.pred_id))"


@query(_FP + " select exists(select 1 from gt where gt.image_id=fp.image_id) annotated, class_id, count(*) n, round(avg(conf),6) mean_conf from fp group by 1, 2")
def fp_groups(spark: SparkSession, d: str) -> DataFrame:
    p, g, v = _all(spark, d)
    return matching.false_positives(v, p, g, matching.assign(v)).groupBy("annotated", "class_id").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("mean_conf"))


@query(
    _FP
    + """, k as (select p.*, exists(select 1 from fp where fp.image_id=p.image_id and fp.pred_id=p.pred_id) f from pred p where conf>=25),
q as (select a.class_id=b.class_id s, greatest(0,least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0,least(a.y1,b.y1)-greatest(a.y0,b.y0)) i,
  (a.x1-a.x0)*(a.y1-a.y0)+(b.x1-b.x0)*(b.y1-b.y0) u from k a join k b on a.image_id=b.image_id and a.pred_id<b.pred_id and (a.f or b.f))
select s same_class, count(*) pairs from q where u-i>0 and i::double/(u-i)::double>=0.5 group by 1"""
)
def fp_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    p, g, v = _all(spark, d)
    fp = matching.false_positives(v, p, g, matching.assign(v))
    return matching.overlapping_predictions(p, fp).groupBy("same_class").agg(F.count("*").alias("pairs"))


_BEST = S.SQL + ", b as (select p.image_id, p.pred_id, p.conf, coalesce(max(v),0)::double a, coalesce(max(v) filter (pc=gc),0)::double s from pred p join (select distinct image_id from gt) using (image_id) left join iou using (image_id, pred_id) group by 1,2,3)"


@query(
    _BEST
    + ", e(lo, hi) as (values (0,1),(1,5),(5,10),(10,25),(25,50),(50,101)) select lo, hi, count(conf) n, round(avg(a),6) mean_any, round(avg(s),6) mean_same, count(*) filter (a>=0.5) localized from e left join b on conf>=lo and conf<hi group by 1,2"
)
def confidence_bins(spark: SparkSession, d: str) -> DataFrame:
    p, g, v = _all(spark, d)
    e = spark.createDataFrame([(0, 1), (1, 5), (5, 10), (10, 25), (25, 50), (50, 101)], "lo int, hi int")
    b = matching.best_overlap(v, p, g)
    j = F.broadcast(e).join(b, (F.col("conf") >= F.col("lo")) & (F.col("conf") < F.col("hi")), "left")
    return j.groupBy("lo", "hi").agg(F.count("conf").alias("n"), F.round(F.avg("any_iou"), 6).alias("mean_any"), F.round(F.avg("same_iou"), 6).alias("mean_same"), F.count_if(F.col("any_iou") >= 0.5).alias("localized"))


@query(_BEST + ", r as (select rank() over (order by conf)+(count(*) over (partition by conf)-1)/2.0::double x, rank() over (order by a)+(count(*) over (partition by a)-1)/2.0::double y from b) select count(*) n, round(corr(x,y),9) rho from r")
def spearman_conf_iou(spark: SparkSession, d: str) -> DataFrame:
    p, g, v = _all(spark, d)
    return stats.spearman(matching.best_overlap(v, p, g), "conf", "any_iou")


def _ap_sql(out: str) -> str:
    return (
        S.SQL
        + """, kept as (select * from (select *, row_number() over (partition by image_id order by conf desc, pred_id) r from pred where conf>0.1) where r<=300),
th(t) as (select unnest(range(50,100,5))),
ca as (select t, i.image_id, i.pred_id, i.gt_id, i.v from iou i join kept k on k.image_id=i.image_id and k.pred_id=i.pred_id join th on i.v>=t/100.0::double where pc=gc),
c1 as (select * from (select *, row_number() over (partition by t,image_id,pred_id order by v desc, pred_id, gt_id) a from ca) where a=1),
c2 as (select * from (select *, row_number() over (partition by t,image_id,gt_id order by v desc, pred_id, gt_id) b from c1) where b=1),
fl as (select t, k.class_id, k.conf, k.image_id, k.pred_id, case when c2.gt_id is null then 0 else 1 end hit from kept k cross join th left join c2 using (t, image_id, pred_id)),
ru as (select t, class_id, hit, row_number() over w n, sum(hit) over w tp from fl window w as (partition by class_id,t order by conf desc,image_id,pred_id rows unbounded preceding)),
su as (select class_id, count(*) s from gt group by 1),
cu as (select t, ru.class_id, tp, tp::double/s rc, max(tp::double/n) over (partition by ru.class_id,t order by tp desc) en from ru join su using (class_id) where hit=1),
li as (select t, class_id, tp::bigint k, rc, en from cu union all select t, class_id, 0, 0, max(en) from cu group by 1,2
  union all select t, class_id, 1000000000, 1, 0 from cu group by 1,2),
se as (select *, lead(rc) over w r2, lead(en) over w e2 from li window w as (partition by class_id,t order by k)),
g(x) as (select range/100.0::double from range(101)),
rd as (select t, class_id, x, (select max_by(case when r2 is null or r2<=rc then en else en+(e2-en)*(x-rc)/(r2-rc) end, k) from se where se.t=u.t and se.class_id=u.class_id and se.rc<=x) y
  from (select distinct t, class_id from cu) u cross join g),
ar as (select t, class_id, sum((y+y2)/2*0.01::double) ap from (select *, lead(y) over (partition by t,class_id order by x) y2 from rd) where y2 is not null group by 1,2),
ap as (select su.class_id, th.t threshold, su.s support, coalesce(ar.ap,0)::double ap from su cross join th left join ar on ar.class_id=su.class_id and ar.t=th.t) """
        + out
    )


@query(_ap_sql("select class_id, threshold, support, round(ap, 6) ap from ap"))
def ap_by_class(spark: SparkSession, d: str) -> DataFrame:
    p, g = S.boxes(spark, d)
    return precision.average_precision(None, p, g).select("class_id", F.col("threshold").cast("long").alias("threshold"), "support", F.round("ap", 6).alias("ap"))


@query(_ap_sql("select round(avg(ap) filter (threshold=50), 6) map50, round(avg(ap), 6) map50_95 from ap"))
def map_summary(spark: SparkSession, d: str) -> DataFrame:
    p, g = S.boxes(spark, d)
    a = precision.average_precision(None, p, g)
    return a.agg(F.round(F.avg(F.when(F.col("threshold") == 50, F.col("ap"))), 6).alias("map50"), F.round(F.avg("ap"), 6).alias("map50_95"))


_SIZED = ", sz as (select g.*, i.split, i.width, i.height, least(640.0::double/i.width, 640.0::double/i.height) sc, least((g.x1-g.x0), (g.y1-g.y0))*least(640.0::double/i.width, 640.0::double/i.height) sh from gt g join scene_image i using (image_id))"


def _sized(spark: SparkSession, d: str) -> DataFrame:
    g = S.placed(spark, d)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    scale = F.least(F.lit(640.0) / F.col("width"), F.lit(640.0) / F.col("height"))
    return g.withColumn("short_side", F.least(w, h) * scale).withColumn("box_w", w).withColumn("box_h", h)


@query(S.SQL + match_sql() + _SIZED + " select case when sh<32 then 0 when sh<64 then 1 else 2 end size_group, count(*) support, count(m.pred_id) tp, round(count(m.pred_id)::double/count(*),6) recall from sz left join m using (image_id, gt_id) group by 1")
def size_group_recall(spark: SparkSession, d: str) -> DataFrame:
    m = matching.assign(_all(spark, d)[2]).select("image_id", F.col("gt_id").cast("long").alias("gt_id"), "pred_id")
    j = _sized(spark, d).join(m, ["image_id", "gt_id"], "left").withColumn("size_group", G.size_group(F.col("short_side")))
    return j.groupBy("size_group").agg(F.count("*").alias("support"), F.count("pred_id").alias("tp"), F.round(F.try_divide(F.count("pred_id"), F.count("*")), 6).alias("recall"))


def _describe_sql(v: str) -> str:
    q = ", ".join(f"round(quantile_cont({v}, {f}), 6) p{round(f * 100):02d}" for f in stats.QUANTILES)
    return f"count({v}) count, round(min({v}),6) min, round(avg({v}),6) mean, round(stddev_pop({v}),6) std, round(max({v}),6) max, {q}"


@query(S.SQL + _SIZED + f" select split, class_id, {_describe_sql('sh')} from sz group by 1, 2")
def describe_boxes(spark: SparkSession, d: str) -> DataFrame:
    return stats.described(_sized(spark, d), ["split", "class_id"], {"short_side": F.col("short_side")}).drop("metric")


@query(
    S.SQL
    + f""", u as (select split, 'width' metric, width::double v from scene_image union all select split, 'height', height::double from scene_image
  union all select split, 'aspect', width::double/height from scene_image)
select coalesce(split,'total') split, metric, {_describe_sql("v")} from u group by grouping sets ((split, metric), (metric))"""
)
def describe_images(spark: SparkSession, d: str) -> DataFrame:
    i = S.images(spark, d).select("split", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), (F.col("width") / F.col("height")).alias("aspect"))
    return stats.describe_grouped(i, ["split"], ["width", "height", "aspect"], "total")


@query(S.SQL + _SIZED + """, l(lim) as (values (16.0::double),(32.0),(48.0),(64.0)) select split, lim "limit", count(*) filter (sh<lim) below, round(count(*) filter (sh<lim)::double/count(*),9) fraction from sz cross join l group by 1,2""")
def thresholds(spark: SparkSession, d: str) -> DataFrame:
    return stats.thresholds(_sized(spark, d), ["split"], F.col("short_side"), [16.0, 32.0, 48.0, 64.0])


@query(S.SQL + """, c as (select split, class_id from gt join scene_image using (image_id)), k as (select s, range class_id from (values ('train'),('valid'),('test'),('total')) v(s) cross join range(6))
select s split, k.class_id, count(c.class_id) n from k left join c on c.class_id=k.class_id and (c.split=s or s='total') group by 1,2""")
def class_split_dense(spark: SparkSession, d: str) -> DataFrame:
    return stats.dense_counts(S.targets(spark, d).join(S.images(spark, d), "image_id"), S.SPLITS, S.CLASSES)


@query(
    S.SQL
    + """, o as (select split, class_id, (x1-x0)*(y1-y0)/2.0::double/(width*height::double) r from gt join scene_image using (image_id))
select case when grouping(split)=0 then 'split' when grouping(class_id)=0 then 'class' else 'overall' end scope, coalesce(split,'all') split, coalesce(class_id,-1) class_id, count(*) n, round(avg(r),9) mean, round(median(r),9) median
from o group by grouping sets ((),(split),(class_id))"""
)
def occupancy_grouping(spark: SparkSession, d: str) -> DataFrame:
    g = S.placed(spark, d)
    pt = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    area = G.polygon_area(F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x0", "y1")))
    r = g.withColumn("r", area / (F.col("width") * F.col("height")))
    every = F.array(*[F.struct(F.lit(n).alias("scope"), split.alias("in_split"), cls.alias("in_class")) for n, split, cls in (("overall", F.lit("all"), F.lit(-1).cast("long")), ("split", F.col("split"), F.lit(-1).cast("long")), ("class", F.lit("all"), F.col("class_id").cast("long")))])
    scoped = r.select("r", F.inline(every))
    by = ["scope", "in_split", "in_class"]
    out = stats.alongside(scoped.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("r"), 9).alias("mean")), stats.quantiles(scoped, by, {"median": (F.col("r"), 0.5)}, 9), by)
    return out.select("scope", F.col("in_split").alias("split"), F.col("in_class").alias("class_id"), "n", "mean", "median")


@query("with p as (select l_returnflag f, l_orderkey, count(*) n, sum(l_quantity::double) s, sum(l_quantity::double*l_quantity::double) q from lineitem group by 1,2) select f, sum(n)::bigint n, round(sum(s)/sum(n),6) mean, round(sqrt(greatest(0.0::double, sum(q)/sum(n)-(sum(s)/sum(n))*(sum(s)/sum(n)))),6) std from p group by 1")
def pooled_moments(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    per = S.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f"), "l_orderkey").agg(F.count("*").alias("n"), F.sum(q).alias("s"), F.sum(q * q).alias("q"))
    return stats.pooled(per, ["f"], "n", "s", "q")


_DOCS = "with d as (select doc_id, sha256(text) h, case when doc_id%10<7 then 'train' when doc_id%10<9 then 'valid' else 'test' end split from documents)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 10
    return S.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.when(k < 7, "train").when(k < 9, "valid").otherwise("test").alias("split"))


@query(_DOCS + " select dense_rank() over (order by h) group_id, h digest, count(*) group_size, case when count(distinct split)>1 then 'cross_split' else 'within_split' end group_class, min(doc_id) first_id from d group by h having count(*)>1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_groups(_docs(spark, d), F.col("h"), "split", "doc_id")


@query(_DOCS + " select split, sha256(string_agg('doc/'||doc_id||chr(9)||h||chr(10), '' order by lower('doc/'||doc_id), 'doc/'||doc_id)) fingerprint, count(*) files from d group by 1")
def fingerprint_by_split(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.fingerprint(_docs(spark, d), ["split"], F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.col("h"))


_BITS = "with recursive b as (select vec_id, list_sum(list_transform(range(24), lambda i: case when embedding[i+1]>0 then (1::bigint<<i::bigint) else 0 end))::bigint bits from embeddings), p as (select a.vec_id first_id, c.vec_id second_id, bit_count(xor(a.bits,c.bits))::bigint distance from b a join b c on a.vec_id<c.vec_id and bit_count(xor(a.bits,c.bits))<=4)"


def _near(spark: SparkSession, d: str) -> DataFrame:
    bit = [F.when(F.get("embedding", F.lit(i)) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(24)]
    total = bit[0]
    for b in bit[1:]:
        total = total + b
    return duplicates.hamming_pairs(S.table(spark, d, "embeddings").select("vec_id", total.alias("bits")), "vec_id", "bits", 24, 4)


@query(_BITS + " select first_id, second_id, distance from p")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d)


def _signature(width: int):
    """Signs of the first ``width`` components, 64 at most; a missing one counts as not positive."""
    total = F.lit(0).cast("long")
    for i in range(width):
        value = (1 << i) - (1 << 64 if i == 63 else 0)
        total = total.bitwiseOR(F.when(F.get("embedding", F.lit(i)) > 0, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return total


#: The signatures, and copies of a fifth of them with no, one or two bits turned, some under the same digest.
_PLANTED = """with b as (select vec_id id, list_reduce(list_prepend(0::ubigint, list_transform(range(64), lambda i: case when embedding[i+1]>0 then (1::ubigint<<i::ubigint) else 0::ubigint end)), lambda x, y: x | y) bits, vec_id::varchar dg from embeddings),
c as (select * from b union all
  select id+1000000, xor(bits, xor(1::ubigint<<(id%64)::ubigint, 1::ubigint<<(id*7%64)::ubigint)), case when id%15=0 then dg else 'copy' end from b where id%5=0
  union all select id+2000000, bits, case when id%20=0 then dg else 'again' end from b where id%10=0),
p as (select x.id first_id, y.id second_id, bit_count(xor(x.bits, y.bits))::bigint distance from c x join c y on x.id<y.id and bit_count(xor(x.bits, y.bits))<=4 and x.dg<>y.dg)"""


def _planted(spark: SparkSession, d: str) -> DataFrame:
    i, bit = F.col("id"), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.cast("int"))
    b = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), _signature(64).alias("bits"), F.col("vec_id").cast("string").alias("dg"))
    turned = b.where(i % 5 == 0).select((i + 1000000).alias("id"), F.col("bits").bitwiseXOR(bit(i % 64)).bitwiseXOR(bit(i * 7 % 64)).alias("bits"), F.when(i % 15 == 0, F.col("dg")).otherwise("copy").alias("dg"))
    again = b.where(i % 10 == 0).select((i + 2000000).alias("id"), "bits", F.when(i % 20 == 0, F.col("dg")).otherwise("again").alias("dg"))
    return b.unionByName(turned).unionByName(again)


@query(_PLANTED + " select * from p")
def near_duplicates_64(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within 4 bits of the whole 64-bit signature, with planted ones; equal digests are no pairs."""
    return duplicates.near_pairs(_planted(spark, d), "id", "bits", "dg", 64, 4)


@query(_PLANTED + " select first_id, second_id, distance, (select count(*) from p)>40 truncated from p order by first_id, second_id limit 40")
def near_pairs_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 pairs in the order of their rows, and whether there were more: the truncated report."""
    pairs, more = duplicates.first_near_pairs(_planted(spark, d), "id", "bits", "dg", 64, 4, 40)
    return pairs.withColumn("truncated", F.lit(more))


@query(_BITS + ", e as (select first_id a, second_id b from p union all select second_id, first_id from p), r(n, u) as (select a, a from e union select r.n, e.b from r join e on r.u=e.a) select n node, min(u) component from r group by 1")
def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_near(spark, d), "first_id", "second_id")


@query(
    """with i as (select case when o_orderkey%10<7 then 'train' else 'valid' end split, 'Img'||(o_orderkey//2) n from orders where o_orderkey%7<>0),
l as (select case when o_orderkey%10<7 then 'train' else 'valid' end split, 'IMG'||(o_orderkey//2) n from orders where o_orderkey%5<>0),
a as (select split, lower(n) stem, count(*) c from i group by 1,2), b as (select split, lower(n) stem, count(*) c from l group by 1,2)
select coalesce(a.split,b.split) split, case when coalesce(a.c,0)=1 and coalesce(b.c,0)=1 then 'paired' when coalesce(a.c,0)>1 or coalesce(b.c,0)>1 then 'ambiguous' when b.c is null then 'image_only' else 'label_only' end status, count(*) n
from a full outer join b on a.split=b.split and a.stem=b.stem group by 1,2"""
)
def pairing_full_outer(spark: SparkSession, d: str) -> DataFrame:
    o = S.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 < 7, "train").otherwise("valid").alias("split"))
    name = lambda p: F.concat(F.lit(p), F.floor(F.col("o_orderkey") / 2).cast("string")).alias("n")
    pairs = duplicates.pair_files(o.where("o_orderkey % 7 <> 0").select("split", name("Img")), o.where("o_orderkey % 5 <> 0").select("split", name("IMG")), "n", ["split"])
    return pairs.groupBy("split", "status").agg(F.count("*").alias("n"))


_V = ", v1 as (select * from gt where image_id%11<>0), v2 as (select image_id, gt_id, case when class_id=2 and gt_id%4=1 then 3 else class_id end class_id, x0, y0, x1, y1 from gt where image_id%13<>0)"


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = S.targets(spark, d)
    new = g.where("image_id % 13 <> 0").withColumn("class_id", F.when((F.col("class_id") == 2) & (F.col("gt_id") % 4 == 1), 3).otherwise(F.col("class_id")))
    return g.where("image_id % 11 <> 0"), new


@query(
    S.SQL
    + _V
    + " select count(*) filter (a.image_id is not null and b.image_id is not null) shared, count(*) filter (a.class_id=b.class_id) identical, count(*) filter (a.class_id<>b.class_id) different, count(*) filter (b.image_id is null) only_first, count(*) filter (a.image_id is null) only_second from v1 a full outer join v2 b on a.image_id=b.image_id and a.gt_id=b.gt_id"
)
def tree_diff(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return duplicates.tree_diff(a, b, ["image_id", "gt_id"], "class_id")


@query(S.SQL + _V + " select a.class_id old_class, b.class_id new_class, count(*) n from v1 a join v2 b on a.image_id=b.image_id and a.gt_id=b.gt_id group by 1,2")
def class_transitions(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return a.select("image_id", "gt_id", F.col("class_id").alias("old_class")).join(b.select("image_id", "gt_id", F.col("class_id").alias("new_class")), ["image_id", "gt_id"]).groupBy("old_class", "new_class").agg(F.count("*").alias("n"))


@query(
    """with recursive o as (select o_orderkey ord, 'a'||o_orderkey nm, 'k'||(o_orderkey//3) k from orders where o_orderkey%4<>0),
n as (select case when o_orderkey%6=0 then 'b'||o_orderkey else 'a'||o_orderkey end nm, 'k'||(o_orderkey//3) k from orders where o_orderkey%5<>0),
ol as (select k, nm, row_number() over (partition by k order by ord, nm) i from o),
nl as (select k, list(nm order by nm) free from n group by 1),
ks as (select k from o union select k from n),
f(k, i, free, o, g, how) as (
  select ks.k, 0::bigint, coalesce(nl.free, []::varchar[]), null::varchar, null::varchar, null::varchar from ks left join nl using (k)
  union all
  select f.k, f.i+1, list_filter(f.free, lambda x: x is distinct from case when list_contains(f.free, ol.nm) then ol.nm when len(f.free)=1 then f.free[1] end),
    ol.nm, case when list_contains(f.free, ol.nm) then ol.nm when len(f.free)=1 then f.free[1] end,
    case when list_contains(f.free, ol.nm) then 'exact' when len(f.free)=1 then 'key' else 'removed' end
  from f join ol on ol.k=f.k and ol.i=f.i+1),
e as (select k, unnest(free) nm from (select k, arg_max(free, i) free from f group by 1))
select k "key", o old_name, g new_name, how from f where o is not null union all select k, null, nm, 'added' from e"""
)
def version_match(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = S.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("k"), F.floor(k / 3).cast("string")).alias("key"))
    old = o.where("o_orderkey % 4 <> 0").select(F.concat(F.lit("a"), k.cast("string")).alias("name"), "key", k.alias("ord"))
    new = o.where("o_orderkey % 5 <> 0").select(F.concat(F.when(k % 6 == 0, "b").otherwise("a"), k.cast("string")).alias("name"), "key")
    return versions.two_stage(old, new, ["key"], "ord")


_LIN = "with n as (select p_partkey id, p_partkey%50 k, p_partkey%17 s from part), o as (select s_suppkey id, s_suppkey%60 k, s_suppkey%19 s from supplier)"


def _lineage(spark: SparkSession, d: str) -> DataFrame:
    n = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("k"), (F.col("p_partkey") % 17).alias("s"))
    o = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 60).alias("k"), (F.col("s_suppkey") % 19).alias("s"))
    return versions.lineage(n, o, "k", -F.abs(F.col("n.s") - F.col("o.s")))


@query(_LIN + " select n.id new_id, coalesce(max_by(o.id, (-abs(n.s-o.s), -o.id)), -1) old_id, count(o.id) candidates from n left join o on n.k=o.k group by 1")
def lineage_best(spark: SparkSession, d: str) -> DataFrame:
    return _lineage(spark, d).na.fill(-1, ["old_id"])


@query("with c as (select c_custkey, count(o_orderkey) n from customer left join orders on o_custkey=c_custkey group by 1) select n children, count(*) parents from c group by 1")
def coverage_hist(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return versions.coverage(c, S.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


_PAIR = "l_quantity::bigint%20 g, (l_quantity::bigint*7)%18 i, ((l_partkey*13)%100)/100.0::double r, 0.6::double+((l_suppkey*29)%100)/100.0::double sc, ((l_partkey*31)%100)/100.0::double ov, ((l_orderkey*37)%100)/100.0::double c, ((l_suppkey*11)%40)/100.0::double e"


@query(
    f"""with m as (select {_PAIR} from lineitem)
select case when g>=12 and i>=10 and r>=0.55::double and sc between 0.8::double and 1.25::double and ov>=0.5::double and c>=0.88::double and e<=0.12::double then 'high_confidence_derivative'
 when g>=8 and i>=6 and r>=0.35::double and sc between 0.7::double and 1.35::double and ov>=0.35::double and c>=0.7::double and e<=0.2::double then 'probable_derivative'
 when g<6 or r<0.2::double or c<0.4::double then 'unrelated_false_positive' else 'inconclusive' end classification, count(*) n from m group by 1"""
)
def pair_classification(spark: SparkSession, d: str) -> DataFrame:
    q, p, s, o = F.col("l_quantity").cast("long"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    m = {"good": q % 20, "inliers": (q * 7) % 18, "ratio": ((p * 13) % 100) / 100.0, "scale": 0.6 + ((s * 29) % 100) / 100.0, "overlap": ((p * 31) % 100) / 100.0, "corr": ((o * 37) % 100) / 100.0, "rmse": ((s * 11) % 40) / 100.0}
    return S.table(spark, d, "lineitem").select(versions.relationship(m).alias("classification")).groupBy("classification").agg(F.count("*").alias("n"))


@query(
    S.SQL
    + _SIZED
    + """, r as ((select image_id, gt_id, 'smallest' w from sz order by sh, image_id, gt_id limit 10) union all (select image_id, gt_id, 'largest' from sz order by sh desc, image_id, gt_id limit 10)
 union all (select image_id, gt_id, 'widest' from sz order by (x1-x0) desc, image_id, gt_id limit 10))
select image_id, gt_id, string_agg(w, ',' order by w) reasons from r group by 1,2"""
)
def review_candidates(spark: SparkSession, d: str) -> DataFrame:
    return selection.review(_sized(spark, d), {"smallest": [F.asc("short_side")], "largest": [F.desc("short_side")], "widest": [F.desc("box_w")]}, 10, ["image_id", "gt_id"])


@query(S.SQL + _SIZED + ", m as (select split, class_id, median(sh) mid from sz group by 1,2) select split, class_id, min_by(image_id, (abs(sh-mid), image_id, gt_id)) image_id, min_by(gt_id, (abs(sh-mid), image_id, gt_id)) gt_id from sz join m using (split, class_id) group by 1,2")
def image_selection(spark: SparkSession, d: str) -> DataFrame:
    return selection.nearest_median(_sized(spark, d), ["split", "class_id"], "short_side", ["image_id", "gt_id"])


@query(S.SQL + " select width, height, count(*) n from scene_image group by 1,2 order by n desc, width, height limit 10")
def top_resolutions(spark: SparkSession, d: str) -> DataFrame:
    return S.images(spark, d).groupBy("width", "height").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width", "height").limit(10)


@query(S.SQL + ", c as (select distinct image_id, class_id from gt) select a.class_id first_class, b.class_id second_class, count(*) images from c a join c b on a.image_id=b.image_id and a.class_id<b.class_id group by 1,2")
def co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    c = S.targets(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_set("class_id")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("first_class"), b.alias("second_class")))))
    return c.select(F.explode(pairs).alias("p")).groupBy("p.first_class", "p.second_class").agg(F.count("*").alias("images"))


@query(S.SQL + _SIZED + ", h as (select split, floor(sh/8)::bigint bin, count(*) n from sz group by 1,2) select split, bin, n, round(100.0::double*n/sum(n) over (partition by split),6) percent, round(sum(n) over (partition by split order by bin)/sum(n) over (partition by split)::double,9) ecdf from h")
def histogram_ecdf(spark: SparkSession, d: str) -> DataFrame:
    h = _sized(spark, d).groupBy("split", F.floor(F.col("short_side") / 8).alias("bin")).agg(F.count("*").alias("n"))
    all_ = F.sum("n").over(W.partitionBy("split"))
    return h.select("split", "bin", "n", F.round(100.0 * F.col("n") / all_, 6).alias("percent"), F.round(F.sum("n").over(W.partitionBy("split").orderBy("bin")) / all_, 9).alias("ecdf"))


@query(
    """with l as (select l_orderkey f, row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate) n,
 l_partkey p, l_suppkey s from lineitem),
c as (select f, n, case when p%17=0 then 'x' when p%19=0 then '9' else (p%6)::varchar end k, (s%13)/10.0::double a, (p%7)/10.0::double b, (s%5)/10.0::double w, (p%3)/10.0::double h from l),
i as (select f, n, unnest(list_filter([case when k='x' then 'invalid_class_format' end, case when k='9' then 'unexpected_class_id' end, case when k<>'x' and a>1 then 'center_out_of_range' end,
 case when k<>'x' and (w<=0 or h<=0) then 'non_positive_size' end,
 case when k<>'x' and (a-w/2<0 or b-h/2<0 or a+w/2>1 or b+h/2>1) then 'box_outside_image' end,
 case when k<>'x' and row_number() over (partition by f,k,a,b,w,h order by n)>1 then 'duplicate_annotation' end], lambda x: x is not null)) code from c)
select code, count(*) n from i group by 1"""
)
def label_issues(spark: SparkSession, d: str) -> DataFrame:
    r = S.scene_rows(spark, d).repartition(S.tasks(spark, d), "image_id")
    p, s = F.col("pk"), F.col("sk")
    cls = F.when(p % 17 == 0, "x").when(p % 19 == 0, "9").otherwise((p % 6).cast("string"))
    num = lambda v: (v / 10.0).cast("string")
    line = F.concat_ws(" ", cls, num(s % 13), num(p % 7), num(s % 5), num(p % 3))
    files = r.groupBy(F.col("image_id").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    parsed = labels.parse(labels.lines(files), list(range(S.CLASSES)))
    return parsed.select(F.explode("issues").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query(_TAX + ", r as (select p category, image_id*1000+gt_id id, sha256('[7,\"'||p||'\",'||(image_id*1000+gt_id)||']') rank from t), n as (select *, row_number() over (partition by category order by rank, id) pick from r) select category, pick, id, rank from n where pick<=6")
def quota_cases(spark: SparkSession, d: str) -> DataFrame:
    _, g, v = _all(spark, d)
    t = matching.taxonomy(v, g, matching.assign(v)).withColumn("id", F.col("image_id") * 1000 + F.col("gt_id"))
    names = ["complete_miss", "localization_failure", "low_confidence_detection", "classification_error", "matching_conflict", "mixed_or_unresolved"]
    return selection.quota(t, "primary", dict.fromkeys(names, 6), 7, "id").select("category", F.col("pick").cast("long").alias("pick"), "id", "rank")


def _cases(spark: SparkSession, d: str) -> tuple[list[dict], list[dict]]:
    """Cases of the validation images, as in the reference."""
    valid = S.images(spark, d).where("split = 'valid'").select("image_id")
    own = lambda df: df.join(valid, "image_id", "left_semi")
    side = F.col("short_side")
    sized = own(_sized(spark, d)).withColumn("size_group", F.when(side < 32, 0).when(side < 64, 1).otherwise(2))
    return selection.select_cases(matching.cases(own(S.predictions(spark, d)), own(S.targets(spark, d)), sized), 7)


@query()
def select_cases(spark: SparkSession, d: str) -> DataFrame:
    names = ["case_id", "category", "image_id", "gt_id", "pred_id", "class_id", "size_group", "reuses_image", "rank"]
    rows = [tuple(c[n] for n in names) for c in _cases(spark, d)[0]]
    return spark.createDataFrame(rows, "case_id string, category string, image_id long, gt_id long, pred_id long, class_id long, size_group int, reuses_image boolean, rank string")


@query()
def case_shortfalls(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([tuple(c.values()) for c in _cases(spark, d)[1]], "category string, quota long, pool long, selected long, shortfall long")


@query()
def review_annotations(spark: SparkSession, d: str) -> DataFrame:
    """The scene has boxes only: a polygon's share of its box is rendered from the identifiers."""
    w, h = F.col("width"), F.col("height")
    rows = _sized(spark, d).select(
        "split",
        "image_id",
        "gt_id",
        "class_id",
        ((50 + (F.col("image_id") * 7 + F.col("gt_id") * 13) % 51) / 100.0).alias("occupancy"),
        (F.col("box_w") / w * (F.col("box_h") / h)).alias("area"),
        F.least(F.col("x0") / w, F.col("y0") / h, 1 - F.col("x1") / w, 1 - F.col("y1") / h).alias("border"),
        F.abs(F.log(w / h)).alias("aspect"),
    )
    return selection.review_annotations(rows)


@query()
def diverse_vectors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("vec_id") % 10
    bits = F.aggregate(F.transform(F.slice("embedding", 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    rows = S.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(k < 7, "train").when(k < 9, "valid").otherwise("test").alias("split"), F.sha2(F.col("embedding").cast("string"), 256).alias("hash"), (F.col("vec_id") % 97).alias("source"), bits.alias("bits"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return spark.createDataFrame(list(enumerate(sampling.diverse(rows, {"train": 4, "valid": 3}, 7))), "pick long, vec_id long")


@query("""with recursive v as (select vec_id, (vec_id*7919)%10007 o, embedding::double[] e from embeddings),
p(k, ids, es) as (
  select 0, [vec_id], [e] from (select * from v order by o, vec_id limit 1)
  union all
  select k+1, list_append(ids, n), list_append(es, (select e from v where vec_id=n))
  from (select k, ids, es, (select arg_max(vec_id, (list_min(list_transform(es, lambda q: list_sum(list_transform(list_zip(q, e), lambda z: abs(z[1]-z[2]))))), -o, -vec_id)) from v where not list_contains(ids, vec_id)) n from p where k<7) x)
select k::bigint pick, ids[k+1] vec_id from p""")
def farthest_first(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    ids = sampling.farthest_first(e, "vec_id", "v", 8, 7, F.col("vec_id") * 7919 % 10007)
    return spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "pick long, vec_id long")


@query(S.SQL + """, e as (select (image_id%40) epoch, round(avg(width),6) s from scene_image group by 1) select max_by(epoch, (s, -epoch)) epoch, max(s) map50_95 from e""")
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    log = S.images(spark, d).groupBy((F.col("image_id") % 40).alias("epoch")).agg(F.round(F.avg("width"), 6).alias("map50_95"))
    return trees.best_epoch(log)


@query(S.SQL + match_sql() + match_sql(aware=False, name="k") + ", n as (select split, count(*) g from gt join scene_image using (image_id) group by 1), a as (select split, count(*) t from m join scene_image using (image_id) group by 1), b as (select split, count(*) t from k join scene_image using (image_id) group by 1) select split, g targets, coalesce(a.t,0) aware_tp, coalesce(b.t,0) agnostic_tp, round(coalesce(b.t,0)::double/g-coalesce(a.t,0)::double/g,9) recall_gap from n left join a using (split) left join b using (split)")
def generalization(spark: SparkSession, d: str) -> DataFrame:
    _, g, v = _all(spark, d)
    i = S.images(spark, d).select("image_id", "split")
    per = lambda df, n: df.join(i, "image_id").groupBy("split").agg(F.count("*").alias(n))
    j = per(g, "targets").join(per(matching.assign(v), "aware_tp"), "split", "left").join(per(matching.assign(v, S.Point(aware=False)), "agnostic_tp"), "split", "left").na.fill(0)
    return j.withColumn("recall_gap", F.round(F.col("agnostic_tp") / F.col("targets") - F.col("aware_tp") / F.col("targets"), 9))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return match_counts_aware(spark, d)
