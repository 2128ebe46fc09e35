"""Configurations as rows: YAML mappings and JSON documents, flattened to (path, type, value).

A document is a row; its keys become rows by expressions, containers too, so
that comparisons see a key that holds a mapping on one side alone.  JSON goes
through VARIANT.  Of YAML the part is read that configurations use: mappings by
indentation, sequences of scalars, flow lists and mappings, quoted and
plain scalars, comments.

Types are dict, list, str, int, float, bool and NoneType; values are texts:
lists as JSON, numbers of type float as doubles, so 1 and 1.0 differ in type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels of mappings within mappings; a deeper document is an error.
DEPTH = 12

_BREAK = "\r\n|[\n\r]"
_KEY = r"""^(?:"([^"]*)"|'([^']*)'|([^\s"'\[{#-][^:]*?))\s*:(?:\s+(.*))?$"""
_COMMENT = r"""(^|\s+)#[^"']*$"""


def _kind(told: Column) -> Column:
    """The type of a variant whose schema is told."""
    names = {"BIGINT": "int", "STRING": "str", "BOOLEAN": "bool", "VOID": "NoneType"}
    out = F.when(told.startswith("OBJECT"), "dict").when(told.startswith("ARRAY"), "list").when(told.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
    for k, n in names.items():
        out = out.when(told == k, n)
    return out.otherwise(F.lower(told))


_ROW = "array<struct<path:string,parent:string,type:string,value:string>>"
_OPEN = "array<struct<path:string,parent:string,v:variant>>"


def flattened(v: Column, path: Column, parent: Column) -> Column:
    """An array of (path, parent, type, value) for a variant and all keys in it, level by level within the row."""

    def below(front: Column) -> Column:
        mappings = F.filter(front, lambda x: x["kind"] == "dict")
        name = lambda x, e: F.when(x["path"] == "", e["key"]).otherwise(F.concat_ws(".", x["path"], e["key"]))
        keys = lambda x: F.transform(F.map_entries(x["v"].cast("map<string,variant>")), lambda e: F.struct(name(x, e).alias("path"), x["path"].alias("parent"), e["value"].alias("v")))
        return F.flatten(F.transform(mappings, keys)).cast(_OPEN)

    def row(x: Column) -> Column:
        kind = x["kind"]
        text = F.when(kind == "float", x["v"].cast("double").cast("string")).when(kind == "str", x["v"].cast("string")).when(~kind.isin("dict", "NoneType"), F.to_json(x["v"]))
        return F.struct(x["path"].alias("path"), x["parent"].alias("parent"), kind.alias("type"), text.alias("value"))

    top = F.array(F.struct(path.alias("path"), parent.alias("parent"), v.alias("v"))).cast(_OPEN)

    def step(s: Column, _: Column) -> Column:
        # a level's types are told once and bound, for a lambda that names an expression works it out at each use
        told = F.transform(s["front"], lambda x: F.struct(x["path"].alias("path"), x["parent"].alias("parent"), x["v"].alias("v"), F.schema_of_variant(x["v"]).alias("told")))
        known = F.transform(told, lambda x: F.struct(x["path"].alias("path"), x["parent"].alias("parent"), x["v"].alias("v"), _kind(x["told"]).alias("kind")))
        level = lambda k: F.struct(below(k).alias("front"), F.concat(s["out"], F.transform(k, row)).cast(_ROW).alias("out"))
        return F.when(F.size(s["front"]) == 0, s).otherwise(F.get(F.transform(F.array(known), level), F.lit(0)))

    deep = lambda s: F.raise_error(F.concat(F.get(s["front"], F.lit(0))["path"], F.lit(" is nested too deep"))).cast(_ROW)
    done = F.aggregate(F.sequence(F.lit(0), F.lit(DEPTH)), F.struct(top.alias("front"), F.expr(f"cast(array() as {_ROW})").alias("out")), step, lambda s: F.when(F.size(s["front"]) > 0, deep(s)).otherwise(s["out"]))
    return F.filter(done, lambda x: x["path"] != "")


def json(rows: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids, path, parent, type, value of JSON documents; one that does not parse is an error."""
    v = F.parse_json(F.col(text))
    # outer, for Spark adds a filter to a plain one that works the array out twice more
    return rows.select(*ids, F.inline_outer(flattened(v, F.lit(""), F.lit(None).cast("string")))).where("path is not null")


def _flow(raw: Column) -> Column:
    """A flow list or mapping as JSON: keys and plain words quoted, single quotes doubled."""
    c = F.regexp_replace(raw, r"'([^'\"]*)'", '"$1"')
    c = F.regexp_replace(c, r'([{,]\s*)([^\s"\[\]{},:][^"\[\]{},:]*?)\s*:', '$1"$2":')
    plain = r'([\[,:]\s*)(?!(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)\s*[,\]}])([^\s"\[\]{},][^"\[\]{},]*?)\s*(?=[,\]}])'
    # neighbours share a comma, so every second one is found in each of two passes
    return F.regexp_replace(F.regexp_replace(c, plain, '$1"$2"'), plain, '$1"$2"')


def _scalar(raw: Column) -> tuple[Column, Column]:
    """(type, value) of a scalar's text."""
    double, single = raw.rlike(r'^".*"$'), raw.rlike(r"^'.*'$")
    inner = F.substr(raw, F.lit(2), F.length(raw) - 2)
    whole, real = raw.rlike(r"^[+-]?\d+$"), raw.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+(\.\d*)?[eE][+-]?\d+|\.inf|\.nan)$")
    kind = F.when(double | single, "str").when(raw.isNull() | raw.rlike(r"^(|~|null|Null|NULL)$"), "NoneType").when(raw.rlike(r"^([Tt]rue|TRUE|[Ff]alse|FALSE)$"), "bool").when(whole, "int").when(real, "float").otherwise("str")
    number = F.when(raw.rlike(r"\.nan$"), "NaN").when(raw.rlike(r"\.inf$"), F.concat(F.when(raw.startswith("-"), "-").otherwise(""), F.lit("Infinity"))).otherwise(raw.try_cast("double").cast("string"))
    value = F.when(double, F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$", "string"), inner)).when(single, F.replace(inner, F.lit("''"), F.lit("'"))).when(kind == "NoneType", None).when(kind == "bool", F.lower(raw)).when(whole, raw.try_cast("decimal(38,0)").cast("string")).when(real, number).otherwise(raw)
    return kind, value


def _entries(files: DataFrame) -> DataFrame:
    """file, no, parent, path, item, raw of each line of YAML texts.

    A fold over a file's lines with the stack of open keys; of configurations
    of some thousand lines each.
    """
    line = F.col("line")
    body = F.trim(F.regexp_replace(line, _COMMENT, ""))
    every = F.filter(F.transform(F.split(F.regexp_replace("text", "^﻿", ""), _BREAK), lambda x, i: F.struct(i.alias("no"), x.alias("line"))), lambda s: ~s["line"].rlike(r"^\s*(#.*)?$|^(---|\.\.\.)\s*$"))
    one = files.select("file", F.explode(every).alias("x")).select("file", "x.no", "x.line").withColumn("body", body)
    item = F.col("body").rlike(r"^-(\s|$)")
    key = F.coalesce(*[F.nullif(F.regexp_extract("body", _KEY, i), F.lit("")) for i in (1, 2, 3)])
    indent = F.length(line) - F.length(F.ltrim(line))
    raw = F.when(item, F.trim(F.substr(F.col("body"), F.lit(2)))).otherwise(F.nullif(F.trim(F.regexp_extract("body", _KEY, 4)), F.lit("")))
    bad = ~item & key.isNull()
    told = one.select("file", F.struct("no", (2 * indent + item.cast("int")).alias("level"), item.alias("item"), F.when(bad, F.raise_error(F.concat(F.lit("no key in the line "), F.col("body"))).cast("string")).otherwise(key).alias("key"), raw.alias("raw")).alias("l"))
    lines = told.groupBy("file").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    # what the line below opens, if it is further in
    after = F.zip_with("ls", F.slice("ls", 2, F.greatest(F.lit(1), F.size("ls"))), lambda a, b: F.struct(*[a[c].alias(c) for c in ("no", "level", "item", "key", "raw")], F.when(b["level"] > a["level"], F.when(b["item"], "list").otherwise("dict")).alias("holds")))
    lines = lines.select("file", after.alias("ls"))
    stack, out = "array<struct<level:int,path:string>>", "array<struct<no:int,parent:string,path:string,item:boolean,raw:string,holds:string>>"

    def step(s: Column, x: Column) -> Column:
        up = F.filter(s["stack"], lambda k: k["level"] < x["level"])
        parent = F.coalesce(F.get(up, F.size(up) - 1)["path"], F.lit(""))
        path = F.when(x["item"], parent).when(parent == "", x["key"]).otherwise(F.concat_ws(".", parent, x["key"]))
        opened = F.when(x["item"], up).otherwise(F.concat(up, F.array(F.struct(x["level"].alias("level"), path.alias("path")))))
        row = F.struct(x["no"].alias("no"), parent.alias("parent"), path.alias("path"), x["item"].alias("item"), x["raw"].alias("raw"), x["holds"].alias("holds"))
        return F.struct(opened.cast(stack).alias("stack"), F.concat(s["out"], F.array(row)).cast(out).alias("out"))

    done = F.aggregate("ls", F.struct(F.expr(f"cast(array() as {stack})").alias("stack"), F.expr(f"cast(array() as {out})").alias("out")), step)
    return lines.select("file", F.inline(done["out"]))


def yaml(files: DataFrame) -> DataFrame:
    """file, path, parent, type, value of YAML mappings; rows: file, text.  A key that occurs twice in a mapping has the later value."""
    raw = F.col("raw")
    flow = raw.rlike(r"^[\[{]")
    kind, value = _scalar(raw)
    e = _entries(files).select("*", F.coalesce(flow, F.lit(False)).alias("flow"), kind.alias("type"), value.alias("value"))
    text = F.when(F.col("type") == "str", F.to_json(F.struct(F.col("value").alias("x")))).otherwise(F.concat(F.lit('{"x":'), F.coalesce("value", F.lit("null")), F.lit("}")))
    cell = F.when(F.col("flow"), _flow(raw)).otherwise(F.substr(text, F.lit(6), F.length(text) - 6))
    own = F.when(~F.col("item"), F.struct("no", "parent", "raw", "flow", "type", "value", "holds"))
    g = e.groupBy("file", "path").agg(F.max(own).alias("k"), F.array_sort(F.collect_list(F.when(F.col("item"), F.struct("no", cell.alias("t"))))).alias("items"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["t"]), ","), F.lit("]"))
    one = lambda t, v: F.array(F.struct(F.col("path"), F.col("k.parent").alias("parent"), t.alias("type"), v.alias("value"))).cast(_ROW)
    rows = F.when(F.col("k.holds") == "dict", one(F.lit("dict"), F.lit(None).cast("string"))).when(F.col("k.holds") == "list", one(F.lit("list"), listed))
    rows = rows.when(F.col("k.flow"), flattened(F.parse_json(_flow(F.col("k.raw"))), F.col("path"), F.col("k.parent"))).otherwise(one(F.col("k.type"), F.col("k.value")))
    return g.where("k is not null").select("file", F.inline(rows))


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """The rows of YAML files."""
    return yaml(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def class_lists(rows: DataFrame) -> DataFrame:
    """file, names, problem of dataset configurations: a list, or a mapping from numbers in their order.

    rows: as from ``yaml``.  Problems: no_names, and wrong_count where ``nc``
    tells another number of classes.
    """
    listed = rows.where("path = 'names' and type = 'list'").select("file", F.from_json("value", "array<string>").alias("names"))
    number = F.substring_index("path", ".", -1).try_cast("int")
    mapped = rows.where("parent = 'names'").groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("k"), F.coalesce("value", F.lit("")).alias("v")))), lambda x: x["v"]).alias("names"))
    names = listed.unionByName(mapped)
    counts = rows.where("path = 'nc'").select("file", F.col("value").try_cast("int").alias("nc"))
    j = rows.select("file").distinct().join(names, "file", "left").join(counts, "file", "left")
    return j.select("file", "names", F.when(F.col("names").isNull(), "no_names").when(F.col("nc") != F.size("names"), "wrong_count").alias("problem"))
