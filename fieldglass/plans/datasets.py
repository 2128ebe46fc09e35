"""Queries over dataset trees that Spark writes from the driver's tables, and over tables as sides of a comparison."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass import scene as S
from fieldglass.operators import difficulty, duplicates, merkle, settings, sides
from fieldglass.plans import scratch
from fieldglass.plans.more import long_sql
from fieldglass.plans.queries import _PLANTED, _planted, query
from fieldglass.sinks import file_tree
from fieldglass.sources import dataset_source as D
from fieldglass.sources import settings as documents
from fieldglass.sources.probe import PNG


def _four(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))


def png(width: Column, height: Column) -> Column:
    """A PNG file's bytes: header chunks, and pixels that no one decodes."""
    chunk = lambda kind, body: F.concat(_four(F.octet_length(body)), F.concat(F.lit(kind), body), _four(F.crc32(F.concat(F.lit(kind), body))))
    head = F.concat(_four(width), _four(height), F.lit(bytes([8, 0, 0, 0, 0])))
    return F.concat(F.lit(PNG), chunk(b"IHDR", head), chunk(b"IDAT", F.lit(bytes(4))), chunk(b"IEND", F.lit(b"")))


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(images, label lines) of a tree with a customer for an image and its orders for polygons."""
    k = F.col("c_custkey")
    split = F.when(k % 10 < 7, "train").when(k % 10 < 9, "valid").otherwise("test")
    images = S.table(spark, d, "customer").select(k.alias("key"), split.alias("split"), (F.lit(400) + k * 37 % 1600).alias("width"), (F.lit(300) + k * 53 % 1700).alias("height"))
    o = F.col("o_orderkey")
    mil = lambda v: F.concat(F.lit("0."), F.lpad(v.cast("string"), 3, "0"))
    x, y = o * 7 % 400, (o * 3 + F.floor(o / 250000)) % 400
    w, h = F.lit(50) + o % 500, F.lit(50) + F.floor(o / 500) % 500
    line = F.concat_ws(" ", (o % 6).cast("string"), mil(x), mil(y), mil(x + w), mil(y), mil(x), mil(y + h))
    return images, S.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), o.alias("o"), line.alias("line"))


def _written(spark: SparkSession, d: str) -> str:
    """The tree as files; its folder."""
    images, lines = _tree(spark, d)
    parts = scratch.partitions(spark)
    own = lines.repartition(parts, "key").groupBy("key").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))
    name = lambda kind, suffix: F.concat(F.col("split"), F.lit(f"/{kind}/C"), F.col("key").cast("string"), F.lit(suffix)).alias("path")
    image, label = name("images", ".png"), name("labels", ".txt")
    dealt = images.repartition(parts, "key")
    both = dealt.join(own, "key", "left").select(F.inline(F.array(F.struct(image, png(F.col("width"), F.col("height")).alias("content")), F.struct(label, F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content")))))
    paths = images.select(image).unionByName(images.select(label))
    root = f"{scratch.shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    file_tree.write(both, root, paths=paths)
    return root


_TREE = """
with im as (select c_custkey key, case when c_custkey%10<7 then 'train' when c_custkey%10<9 then 'valid' else 'test' end split, 400+c_custkey*37%1600 width, 300+c_custkey*53%1700 height from customer),
po as (select o_custkey key, o_orderkey o, o_orderkey%6 c, o_orderkey*7%400 x, (o_orderkey*3+o_orderkey//250000)%400 y, 50+o_orderkey%500 w, 50+(o_orderkey//500)%500 h from orders),
ln as (select *, c||' 0.'||lpad(x::varchar,3,'0')||' 0.'||lpad(y::varchar,3,'0')||' 0.'||lpad((x+w)::varchar,3,'0')||' 0.'||lpad(y::varchar,3,'0')||' 0.'||lpad(x::varchar,3,'0')||' 0.'||lpad((y+h)::varchar,3,'0') line from po),
tx as (select im.*, coalesce(string_agg(line, chr(10) order by o)||chr(10), '') t, count(o) n from im left join ln using (key) group by all)
"""


@query(_TREE + "select split, 'c'||key stem, width::int width, height::int height, n annotations, sha256(t) label_sha256, n=0 empty from tx where split in ('train','valid')")
def tree_scan(spark: SparkSession, d: str) -> DataFrame:
    """A written tree of pairs read back by the dataset source, its held-out split neither listed nor opened."""
    rows = scratch.stage(D.scan(spark, _written(spark, d)).where(F.col("split").isin("train", "valid")), "scan")
    lines = D.annotations(rows, list(range(S.CLASSES)), "polygon").where("valid").groupBy("split", "stem").agg(F.count("*").alias("n"))
    none = D.empty_labels(rows).select("split", "stem", F.lit(True).alias("empty"))
    j = rows.where("status = 'paired' and image_issue is null").join(lines, ["split", "stem"], "left").join(none, ["split", "stem"], "left")
    return j.select("split", "stem", "width", "height", F.coalesce("n", F.lit(0)).alias("annotations"), "label_sha256", F.coalesce("empty", F.lit(False)).alias("empty"))


_FOUR = "printf('%d %.10f %.10f %.10f %.10f', c, (x/1000.0::double+(x+w)/1000.0::double)/2, (y/1000.0::double+(y+h)/1000.0::double)/2, (x+w)/1000.0::double-x/1000.0::double, (y+h)/1000.0::double-y/1000.0::double)"


@query(
    _TREE
    + f""", cv as (select im.key, im.split, coalesce(string_agg({_FOUR}, chr(10) order by o)||chr(10), '') t, count(o) n from im left join po using (key) group by all)
select split||'/c'||key sample_id, true sha256_equal, sha256(t) label_sha256, n boxes, 0::bigint lost from cv"""
)
def tree_conversion(spark: SparkSession, d: str) -> DataFrame:
    """Polygons converted to boxes in a new tree, images copied byte for byte; what the new tree lost against the conversion's rows."""
    target = f"{scratch.shared_dir(spark)}/boxes-{uuid.uuid4().hex}"
    images, rows = file_tree.convert(spark, _written(spark, d), target, list(range(S.CLASSES)))
    back = scratch.stage(D.scan(spark, target), "converted")
    lines = D.annotations(back, list(range(S.CLASSES)), "box", 1e-10)
    gone = file_tree.lost(rows, file_tree.conversion_rows(lines)).groupBy("split", "stem").agg(F.count("*").alias("lost"))
    n = lines.where("valid").groupBy("split", "stem").agg(F.count("*").alias("boxes"))
    j = back.join(n, ["split", "stem"], "left").join(gone, ["split", "stem"], "left").select(F.concat_ws("/", "split", "stem").alias("sample_id"), "label_sha256", F.coalesce("boxes", F.lit(0)).alias("boxes"), F.coalesce("lost", F.lit(0)).alias("lost"))
    return images.select("sample_id", "sha256_equal").join(j, "sample_id")


# a tree of documents and the same tree with files changed, removed and added by rule, and one folder lost
_PAIR = """
with f as (select 'lang-'||coalesce(lang,'')||'/'||coalesce(source,'')||'/'||doc_id p, doc_id i, lang, source, coalesce(text,'') t from documents),
a as (select p, sha256(t) s, strlen(t) n from f),
b as (select p, sha256(case when i%89=0 then t||'!' else t end) s, strlen(t)+(i%89=0)::int n from f where i%97<>0 and not (lang is not distinct from 'de' and source is not distinct from 'src3')
  union all select p||'-new', sha256(t), strlen(t) from f where i%83=0),
df as (select coalesce(a.p,b.p) path, a.s x, b.s y from a full join b using (p) where a.s is distinct from b.s)
"""


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("doc_id")
    body = F.coalesce("text", F.lit(""))
    path = F.concat(F.lit("lang-"), F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), i.cast("string"))
    docs = S.table(spark, d, "documents").withColumn("path", path).withColumn("body", body)
    files = lambda rows, p, text: rows.select(p.alias("path"), F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("size_bytes"))
    lost = F.col("lang").eqNullSafe(F.lit("de")) & F.col("source").eqNullSafe(F.lit("src3"))
    second = files(docs.where((i % 97 != 0) & ~lost), F.col("path"), F.when(i % 89 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return files(docs, F.col("path"), F.col("body")), second.unionByName(files(docs.where(i % 83 == 0), F.concat("path", F.lit("-new")), F.col("body")))


@query(
    _PAIR
    + """, fa as (select distinct string_split(p,'/')[1] g, string_split(p,'/')[1]||'/'||string_split(p,'/')[2] h from a), fb as (select distinct string_split(p,'/')[1] g, string_split(p,'/')[1]||'/'||string_split(p,'/')[2] h from b),
ga as (select g q from fa union select h from fa), gb as (select g q from fb union select h from fb),
fo as (select coalesce(ga.q,gb.q) path, case when ga.q is null then 'added' else 'removed' end change from ga full join gb using (q) where ga.q is null or gb.q is null)
select path, false folder, case when x is null then 'added' when y is null then 'removed' else 'changed' end change, x first_digest, y second_digest from df
union all select path, true, change, null, null from fo"""
)
def merkle_difference(spark: SparkSession, d: str) -> DataFrame:
    """What differs between two trees, found from the root down."""
    a, b = _pair(spark, d)
    out = merkle.difference(merkle.nodes(a, "first"), merkle.nodes(b, "second"))
    file = lambda c: F.when(~F.col("folder"), F.col(c)).alias(c)
    return out.select("path", "folder", "change", file("first_digest"), file("second_digest"))


_REPRO = """
with f as (select c_custkey k, case when c_custkey%10<7 then 'train' when c_custkey%10<9 then 'valid' else 'test' end split, c_name||c_nationkey t from customer),
a as (select split, kind, k, case when kind='labels' and k%7=0 then '' else t||kind end t from f cross join (values ('images'),('labels')) v(kind)),
b as (select split, kind, k, case when kind='labels' and k%7=0 and k%5<>0 then '' when kind='labels' and k%41=0 then t||'*' when kind='images' and k%53=0 then t||'#' else t||kind end t from f cross join (values ('images'),('labels')) v(kind) where not (split='test' and kind='labels' and k%3=0)),
un as (select distinct split, kind from a full join b using (split, kind, k) where a.t is null or b.t is null),
m as (select split, kind, a.t x, b.t y from a join b using (split, kind, k) where not exists (select 1 from un where un.split=a.split and un.kind=a.kind))
select count(*) filter (kind='labels') label_files_compared, count(*) filter (kind='images') image_files_compared,
  count(*) filter (kind='labels' and x<>y) label_hash_mismatches, count(*) filter (kind='images' and x<>y) image_hash_mismatches,
  count(*) filter (kind='labels' and (x='')<>(y='')) empty_label_mismatches, (select count(*) from un) missing_or_extra_folders, false fingerprints_identical, false success from m
"""


@query(_REPRO)
def reproduction(spark: SparkSession, d: str) -> DataFrame:
    """A dataset against its reproduction with faults by rule: counts of mismatches by kind."""
    k = F.col("c_custkey")
    split = F.when(k % 10 < 7, "train").when(k % 10 < 9, "valid").otherwise("test")
    files = S.table(spark, d, "customer").select(k.alias("k"), split.alias("split"), F.concat("c_name", F.col("c_nationkey").cast("string")).alias("t"), F.explode(F.array(F.lit("images"), F.lit("labels"))).alias("kind"))
    k, t, label = F.col("k"), F.col("t"), F.col("kind") == "labels"
    plain = F.concat(t, F.col("kind"))
    first = F.when(label & (k % 7 == 0), "").otherwise(plain)
    second = F.when(label & (k % 7 == 0) & (k % 5 != 0), "").when(label & (k % 41 == 0), F.concat(t, F.lit("*"))).when(~label & (k % 53 == 0), F.concat(t, F.lit("#"))).otherwise(plain)
    side = lambda rows, body: rows.select(F.concat_ws("/", "split", "kind", k.cast("string")).alias("path"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size_bytes"))
    kept = files.where(~((F.col("split") == "test") & label & (k % 3 == 0)))
    return merkle.reproduction(merkle.nodes(side(files, first), "approved"), merkle.nodes(side(kept, second), "made"))


_SIDES = """
with i as (select o_orderkey k, 'o'||o_orderkey stem, o_custkey%3 split, 400+o_orderkey*37%1600 width, 300+o_orderkey*53%1700 height, 3 channels, o_orderdate::varchar t, o_orderkey%7 n from orders),
u as (
  select 0 side, split, stem, width, height, channels, null t, null n from i where k%101<>0
  union all select 1, split, stem, width+(k%103=0)::int, height, case when k%107=0 then 1 else channels end, null, null from i where k%109<>0
  union all select 2, split, stem, null, null, null, t, n from i
  union all select 2, split, stem, null, null, null, t, n from i where k%113=0
  union all select 3, split, stem, null, null, null, t||case when k%127=0 then '*' else '' end, case when k%131=0 then null else n end from i where k%137<>0),
g as (select split, stem, array_agg(side) ss, list(distinct width) filter (side<2) w, list(distinct height) filter (side<2) h, list(distinct channels) filter (side<2) c, count(distinct t) filter (side>=2) t,
  count(distinct coalesce(n,-1)) filter (side>=2) n from u group by all),
p as (select split, stem, list_filter([
  case when not list_contains(ss,0) then 'missing:control_images' end, case when not list_contains(ss,1) then 'missing:other_images' end,
  case when not list_contains(ss,2) then 'missing:control_labels' end, case when not list_contains(ss,3) then 'missing:other_labels' end,
  case when len(list_filter(ss, lambda x: x=2))>1 then 'repeated:control_labels' end,
  case when len(w)>1 then 'differs:width' end, case when len(h)>1 then 'differs:height' end, case when len(c)>1 then 'differs:channels' end, case when t>1 then 'differs:sha256' end, case when n>1 then 'differs:annotations' end], lambda x: x is not null) ps from g),
e as (select split, stem, unnest(case when len(ps)=0 then [''] else ps end) problem from p)
select problem, count(*) n, min(split) first_split, min_by(stem, (split, stem)) first_stem from e group by 1
"""


@query(_SIDES)
def four_way_identity(spark: SparkSession, d: str) -> DataFrame:
    """Images and labels of a control and of a derived dataset, with every kind of mismatch by rule."""
    k = F.col("o_orderkey")
    i = S.table(spark, d, "orders").select(k.alias("k"), F.concat(F.lit("o"), k.cast("string")).alias("stem"), (F.col("o_custkey") % 3).alias("split"), (F.lit(400) + k * 37 % 1600).alias("width"), (F.lit(300) + k * 53 % 1700).alias("height"), F.lit(3).alias("channels"), F.sha2(F.col("o_orderdate").cast("string"), 256).alias("sha256"), (k % 7).alias("annotations"))
    k = F.col("k")
    images, texts = ["split", "stem", "width", "height", "channels"], ["split", "stem", "sha256", "annotations"]
    other = i.where(k % 109 != 0).withColumn("width", F.col("width") + (k % 103 == 0).cast("int")).withColumn("channels", F.when(k % 107 == 0, 1).otherwise(F.col("channels")))
    labels = i.where(k % 137 != 0).withColumn("sha256", F.when(k % 127 == 0, F.lit("*")).otherwise(F.col("sha256"))).withColumn("annotations", F.when(k % 131 != 0, F.col("annotations")))
    compared = sides.four_way(i.where(k % 101 != 0).select(*images), i.unionByName(i.where(k % 113 == 0)).select(*texts), other.select(*images), labels.select(*texts))
    return sides.counted(compared, ["split", "stem"]).select("problem", "n", F.col("first_key.split").alias("first_split"), F.col("first_key.stem").alias("first_stem"))


@query("""with d as (select doc_id%10<7 train, doc_id%10 between 7 and 8 valid, doc_id::varchar id, source nm, sha256(text) h from documents where doc_id%10<9),
u as (select train, unnest([struct_pack(c := 'id', v := id), struct_pack(c := 'name', v := nm), struct_pack(c := 'sha256', v := h)]) x from d),
g as (select x.c c, x.v v, count(distinct train) n from u where x.v is not null group by 1, 2)
select c as "column", count(*) "values", count(*) filter (n=2) shared from g group by 1""")
def split_intersections(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers, names and contents that training and validation share."""
    docs = S.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"), F.sha2("text", 256).alias("sha256"))
    part = F.col("doc_id") % 10
    return sides.shared_values({"train": docs.where(part < 7), "valid": docs.where(part.between(7, 8))}, ["id", "name", "sha256"])


@query("""with l as (select l_orderkey k, l_linenumber n, l_partkey%6 c, '0.'||lpad((l_suppkey%900+50)::varchar,3,'0') x from lineitem),
s as (select k, string_agg(c||' '||x||' 0.5 0.1 0.1', chr(10) order by n, c, x)||chr(10) t, string_agg('0 '||x||' 0.5 0.1 0.1', chr(10) order by n, c, x)||chr(10) w from l group by 1),
m as (select k, case when k%61=0 then t when k%67=0 then w||' ' else w end m, w from s where k%71<>0),
j as (select s.k, s.w, m.m from s left join m using (k)),
p as (select case when m is null then 'missing:derived' when m<>w then 'differs:label' else '' end problem, k from j)
select problem, count(*) n from p group by 1""")
def derived_identity(spark: SparkSession, d: str) -> DataFrame:
    """Labels with one class against the labels that they were made from, some left as they were, spoilt or lost."""
    li = S.table(spark, d, "lineitem")
    x = F.concat(F.lit("0."), F.lpad((F.col("l_suppkey") % 900 + 50).cast("string"), 3, "0"))
    row = F.struct(F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 6).alias("c"), x.alias("x"))
    rows = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    text = lambda c: F.concat(F.array_join(F.transform("rows", lambda r: F.concat(c(r), F.lit(" "), r["x"], F.lit(" 0.5 0.1 0.1"))), "\n"), F.lit("\n"))
    own, one = text(lambda r: r["c"].cast("string")), text(lambda r: F.lit("0"))
    s = rows.select("k", own.alias("t"), one.alias("w"))
    k = F.col("k")
    name = lambda rows, body: rows.select(F.concat(F.lit("train/labels/"), k.cast("string")).alias("path"), F.lit("labels").alias("kind"), F.encode(body, "utf-8").alias("content"))
    remap = F.encode(F.regexp_replace(F.decode("content", "utf-8"), r"(?m)^[0-5] ", "0 "), "utf-8")
    made = F.when(k % 61 == 0, F.col("t")).when(k % 67 == 0, F.concat("w", F.lit(" "))).otherwise(F.col("w"))
    return sides.counted(sides.derived(name(s, F.col("t")), name(s.where(k % 71 != 0), made), remap), ["path"]).select("problem", "n")


_EXPORT = S.SQL + """, s as (select i.image_id k, i.split, width, height, coalesce(list([gt_id, class_id, x0, y0, x1, y1] order by gt_id) filter (gt_id is not null), []) g from scene_image i left join gt using (image_id) group by all),
e as (select k, split, width, case when k%59=0 then height+1 else height end height, case when k%61=0 then list_reverse(g) when k%67=0 then g[:1] else g end g from s where k%73<>0),
p as (select s.k, case when e.k is null then ['missing:export'] else list_filter([case when e.g<>s.g then 'differs:ground_truth' end, case when e.height<>s.height then 'differs:height' end], lambda x: x is not null) end ps from s left join e using (k))
select problem, count(*) n from (select unnest(case when len(ps)=0 then [''] else ps end) problem from p) group by 1"""


@query(_EXPORT)
def export_identity(spark: SparkSession, d: str) -> DataFrame:
    """A prediction export's samples against their source: dimensions and targets in order."""
    t = F.struct("gt_id", F.struct(F.concat(F.lit("gt/"), F.col("gt_id").cast("string")).alias("box_id"), F.col("class_id"), F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]).alias("xyxy")).alias("t"))
    truth = S.targets(spark, d).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(t)), lambda x: x["t"]).alias("g"))
    s = S.images(spark, d).join(truth, "image_id", "left")
    none = F.expr("cast(array() as array<struct<box_id:string,class_id:bigint,xyxy:array<double>>>)")
    k = F.col("image_id")
    source = s.select(k, F.concat_ws("/", "split", k.cast("string")).alias("sample_id"), "split", "width", "height", F.lit(None).cast("string").alias("image_sha256"), F.lit(None).cast("string").alias("label_sha256"), F.coalesce("g", none).alias("ground_truth"))
    g = F.col("ground_truth")
    export = source.where(k % 73 != 0).withColumn("height", F.col("height") + (k % 59 == 0).cast("int")).withColumn("ground_truth", F.when(k % 61 == 0, F.reverse(g)).when(k % 67 == 0, F.slice(g, 1, 1)).otherwise(g))
    return sides.counted(sides.export_identity(export, source), ["sample_id"]).select("problem", "n")


def _configs(spark: SparkSession, d: str) -> DataFrame:
    """event_id, user_id, config: an event as a configuration; keys, types and a whole section come and go by rule."""
    e, cents = F.col("event_id"), F.round(F.col("value") * 100).cast("long")
    rate = F.when(e % 13 == 0, F.floor(cents / 100).cast("string")).otherwise(F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")))
    data = F.concat(F.lit('"dataset":{"root":"'), F.coalesce("event_type", F.lit("")), F.lit('","size":'), (e % 3).cast("string"), F.lit("}"))
    training = F.concat(F.lit(',"training":{"props":'), F.coalesce("props", F.lit("null")), F.lit(',"rate":'), F.coalesce(rate, F.lit("null")), F.lit("}"))
    note = F.when(e % 11 == 0, "").when(e % 5 == 0, ',"note":null').otherwise(',"note":"x"')
    return S.table(spark, d, "events").select("event_id", "user_id", F.concat(F.lit("{"), data, F.when(e % 17 == 0, "").otherwise(training), note, F.lit("}")).alias("config"))


_CONFIG = """
with c as (select event_id e, user_id u, coalesce(event_type,'') root, event_id%3 size, event_id%17<>0 tr, (props::json->>'k') k,
  case when event_id%13=0 then 'int' else 'float' end rt, case when event_id%13=0 then round(value*100)::bigint//100 else round(value*100)::bigint/100.0::double end r,
  case when event_id%11=0 then 'none' when event_id%5=0 then 'null' else 'x' end nt from events),
p as (select l.*, r.root root2, r.size size2, r.tr tr2, r.k k2, r.rt rt2, r.r r2, r.nt nt2 from (select *, lead(e) over (partition by u order by e) e2 from c) l join c r on r.e=l.e2),
x as (
  select 'dataset.root' path, 'str' a, 'str' b from p where root<>root2
  union all select 'dataset.size', 'int', 'int' from p where size<>size2
  union all select 'training', case when tr then 'dict' end, case when tr2 then 'dict' end from p where tr<>tr2
  union all select 'training.props.k', 'int', 'int' from p where tr and tr2 and k<>k2
  union all select 'training.rate', rt, rt2 from p where tr and tr2 and (rt<>rt2 or r<>r2)
  union all select 'note', case nt when 'x' then 'str' when 'null' then 'NoneType' end, case nt2 when 'x' then 'str' when 'null' then 'NoneType' end from p where nt<>nt2)
select path, a left_type, b right_type, count(*) n from x group by all
"""


@query(_CONFIG)
def config_diff(spark: SparkSession, d: str) -> DataFrame:
    """Differences between each event's configuration and the user's next one, by key and types."""
    # dealt by user as texts, so many parts whatever their size: flattening takes the time, and a user's documents move no more
    dealt = _configs(spark, d).repartition(scratch.partitions(spark), "user_id")
    rows = dealt.select("event_id", "user_id", documents.flattened(F.parse_json("config"), F.lit(""), F.lit(None).cast("string")).alias("keys"))
    pairs = rows.withColumn("after", F.lead("keys").over(W.partitionBy("user_id").orderBy("event_id"))).where("after is not null")
    # outer, for Spark adds a filter to a plain one that works the array out twice more
    off = pairs.select(F.inline_outer(settings.differing(F.col("keys"), F.col("after")))).where("path is not null")
    return off.groupBy("path", "left_type", "right_type").agg(F.count("*").alias("n"))


@query("""with r as (select event_id e, value v, event_id%7 k from events),
x as (select e, 'scores.recall' p, v/20 n, k from r union all select e, 'scores.deep.f1', v/40, k from r)
select p path, case when k=3 and p='scores.recall' then 'not_finite' else 'rate_outside' end rule, count(*) n from x where (k=3 and p='scores.recall') or not coalesce(n between 0 and 1, true) group by 1, 2""")
def unsound_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Rates of nested documents that are out of bounds or not finite."""
    v = F.col("value")
    recall = F.when(F.col("event_id") % 7 == 3, '"-infinity"').otherwise((v / 20).cast("string"))
    text = F.concat(F.lit('{"scores":{"recall":'), F.coalesce(recall, F.lit("null")), F.lit(',"deep":{"f1":'), F.coalesce((v / 40).cast("string"), F.lit("null")), F.lit(',"count":9}}}'))
    rows = documents.json(S.table(spark, d, "events").select("event_id", text.alias("t")), ["event_id"], "t")
    return settings.unsound(rows).groupBy("path", "rule").agg(F.count("*").alias("n"))


def _floored(sql: str) -> str:
    """Rounding by the same two operations in both engines, for shares of image sides often lie half-way."""
    return re.sub(r"round\((.*?), ?6\) ", r"floor((\1)*1e6+0.5)/1e6 ", sql)


_BOXES = S.SQL + """, bm as (select split, class_id, (x1-x0)::double/width nw, (y1-y0)::double/height nh, (x1-x0)::double w, (y1-y0)::double h, least(640.0::double/width, 640.0::double/height) sc from gt join scene_image using (image_id)),
bx as (select split, nw normalized_width, nh normalized_height, nw*nh normalized_area, least(nw,nh) normalized_shorter_side, greatest(nw,nh) normalized_longer_side, w width_px, h height_px, w*h area_px, w*sc effective_width, h*sc effective_height, w*sc*(h*sc) effective_area, least(w*sc,h*sc) effective_short_side from bm)"""


@query(
    _BOXES
    + """, nn as (select image_id, count(*) n from gt group by 1), im as (select split, n::double annotations_per_positive_image, width::double width_px, height::double height_px, width::double*height pixel_area, width::double/height aspect_ratio from scene_image left join nn using (image_id)),
u as (select split, 'image' subject, metric, v from (unpivot im on annotations_per_positive_image, width_px, height_px, pixel_area, aspect_ratio into name metric value v)
  union all select split, 'box', metric, v from (unpivot bx on """
    + ", ".join(difficulty.MEASURES)
    + f""" into name metric value v))
select split, subject, metric, {_floored(long_sql('v'))} from u where v is not null group by 1, 2, 3"""
)
def split_measures(spark: SparkSession, d: str) -> DataFrame:
    """All seventeen descriptions of every split."""
    out = difficulty.split_measures(S.images(spark, d), S.boxes(spark, d)[1], None, S.placed(spark, d))
    return out.select(*[F.floor(F.col(c) * 1e6 + 0.5) / 1e6 if kind == "double" else F.col(c) for c, kind in out.dtypes]).toDF(*out.columns)


@query(
    _BOXES
    + f""", l(metric, lim) as (values {", ".join(f"('normalized_area', {x}::double)" for x in difficulty.AREA_LIMITS)}, {", ".join(f"('effective_short_side', {x}::double)" for x in difficulty.SIDE_LIMITS)}),
u as (select split, metric, v from (unpivot bx on normalized_area, effective_short_side into name metric value v))
select split, metric, lim "limit", count(*) filter (v<lim) below, round(count(*) filter (v<lim)::double/count(*), 9) fraction from u join l using (metric) group by 1, 2, 3"""
)
def small_boxes(spark: SparkSession, d: str) -> DataFrame:
    return difficulty.small_boxes(difficulty.box_measures(S.targets(spark, d), S.images(spark, d)))


@query(S.SQL + " select * from (select split, row_number() over (partition by split order by count(*) desc, width, height)::int rank, width, height, count(*) images from scene_image group by split, width, height) where rank<=10")
def common_resolutions(spark: SparkSession, d: str) -> DataFrame:
    return difficulty.common_resolutions(S.images(spark, d))


@query(S.SQL + " select image_id, coalesce(string_agg(distinct class_id::varchar, ',' order by class_id::varchar), '') classes, min((x1-x0)*(y1-y0))::double smallest_area from scene_image left join gt using (image_id) group by 1")
def class_sets(spark: SparkSession, d: str) -> DataFrame:
    """The classes of every image, and its smallest box."""
    out = difficulty.class_sets(S.targets(spark, d), S.images(spark, d))
    return out.select("image_id", F.array_join(F.transform("classes", lambda c: c.cast("string")), ",").alias("classes"), "smallest_area")


@query(S.SQL + ", o as (select split, case when width::double/height<0.95 then 'portrait' when width::double/height>1.05 then 'landscape' else 'approximately_square' end orientation from scene_image), k as (select * from (select distinct split from o) cross join (values ('portrait'),('landscape'),('approximately_square')) v(orientation)) select k.split, k.orientation, count(o.split) images, round(100.0::double*count(o.split)/(select count(*) from o q where q.split=k.split), 6) percent from k left join o on o.split=k.split and o.orientation=k.orientation group by 1, 2")
def orientation_shares(spark: SparkSession, d: str) -> DataFrame:
    return difficulty.orientation_shares(S.images(spark, d))


@query(
    _PLANTED.replace("with b as", "with recursive b as")
    + """, e as (select first_id a, second_id b from p union all select second_id, first_id from p), r(n, u) as (select a, a from e union select r.n, e.b from r join e on r.u=e.a), m as (select n, min(u) c from r group by 1),
w as (select id, case when id%10<7 then 'train' when id%10<9 then 'valid' else 'test' end split, (id%13)::varchar source, c least from c join m on m.n=c.id),
g as (select least, count(*) member_count, count(distinct split)>1 cross_split, string_agg(distinct split, ' | ' order by split) splits, count(distinct source) source_count, string_agg(distinct source, ' | ' order by source) sources, row_number() over (order by least) group_id from w group by 1 having count(*)>1)
select id, split, source, member_count, cross_split, splits, source_count::int source_count, sources, group_id from w join g using (least)"""
)
def derivative_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of planted near copies with the splits and sources that they reach into."""
    rows = _planted(spark, d)
    near = duplicates.near_pairs(rows, "id", "bits", "dg", 64, 4).select(F.col("first_id").alias("a"), F.col("second_id").alias("b"))
    k = F.col("id") % 10
    own = rows.select("id", F.when(k < 7, "train").when(k < 9, "valid").otherwise("test").alias("split"), (F.col("id") % 13).cast("string").alias("source"))
    return difficulty.derivative_groups(near, own)
