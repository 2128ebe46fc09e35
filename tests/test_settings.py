"""Configurations as rows: YAML and JSON readers, and their comparison against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import settings as compare
from fieldglass.operators.contracts import ContractError
from fieldglass.sources import settings

TEXT = """# top
dataset:
  root: "a b/c"   # comment
  classes: ['x', y, 3, "q, r"]
  nested: {deep: {er: 1}, plain: word}
training:
    lr: 1e-3
    epochs: 100
    amp: true
    none: ~
    empty:
    url: http://host:80/x
steps:
- 1
- two
- 'th''ree'
last: -.5
"""


def test_yaml(spark):
    got = {(r.path, r.parent, r.type, r.value) for r in settings.yaml(spark.createDataFrame([("f", TEXT), ("g", "﻿a: 1\r\nb:\r\n  c: 2\r\n")], "file string, text string")).where("file = 'f'").collect()}
    assert got == {
        ("dataset", "", "dict", None),
        ("dataset.root", "dataset", "str", "a b/c"),
        ("dataset.classes", "dataset", "list", '["x","y",3,"q, r"]'),
        ("dataset.nested", "dataset", "dict", None),
        ("dataset.nested.deep", "dataset.nested", "dict", None),
        ("dataset.nested.deep.er", "dataset.nested.deep", "int", "1"),
        ("dataset.nested.plain", "dataset.nested", "str", "word"),
        ("training", "", "dict", None),
        ("training.lr", "training", "float", "0.001"),
        ("training.epochs", "training", "int", "100"),
        ("training.amp", "training", "bool", "true"),
        ("training.none", "training", "NoneType", None),
        ("training.empty", "training", "NoneType", None),
        ("training.url", "training", "str", "http://host:80/x"),
        ("steps", "", "list", '[1,"two","th\'ree"]'),
        ("last", "", "float", "-0.5"),
    }


def test_yaml_edges(spark):
    rows = [("empty", ""), ("null", None), ("crlf", "﻿a: 1\r\nb:\r\n  c: 2\r\n"), ("twice", "a: 1\na: 2\n"), ("comment", "# only\n---\n")]
    got = {(r.file, r.path, r.value) for r in settings.yaml(spark.createDataFrame(rows, "file string, text string")).collect()}
    assert got == {("crlf", "a", "1"), ("crlf", "b", None), ("crlf", "b.c", "2"), ("twice", "a", "2")}
    with pytest.raises(Exception, match="no key in the line"):
        settings.yaml(spark.createDataFrame([("bad", "just words\n")], "file string, text string")).collect()


def random_config(rng, depth=3):
    leaf = lambda: rng.choice([1, 2, 1.5, 2.0, "1", "x", True, False, None, [1, 2], ["a"], {}])
    return {k: random_config(rng, depth - 1) if depth and rng.random() < 0.4 else leaf() for k in rng.sample("abcd", rng.randrange(1, 5))}


def different(left, right, prefix=""):
    """Key paths whose value or type differs."""
    if isinstance(left, dict) and isinstance(right, dict):
        out = set()
        for k in left.keys() | right.keys():
            path = f"{prefix}.{k}" if prefix else k
            out |= {path} if k not in left or k not in right else different(left[k], right[k], path)
        return out
    return set() if type(left) is type(right) and left == right else {prefix}


def test_differences(spark):
    rng = random.Random(11)
    pairs = [(i, random_config(rng), random_config(rng)) for i in range(150)]
    pairs += [(900, a := random_config(rng), a)]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, a, b in pairs], "pair int, l string, r string")
    got = {}
    for r in compare.differences(settings.json(df, ["pair"], "l"), settings.json(df, ["pair"], "r"), ["pair"]).collect():
        got.setdefault(r.pair, set()).add(r.path)
    assert got == {i: d for i, a, b in pairs if (d := different(a, b))} and 900 not in got


def test_depth_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(settings, "DEPTH", 2)
    df = spark.createDataFrame([('{"a":{"b":{"c":1}}}',)], "t string")
    with pytest.raises(Exception, match="too deep"):
        settings.json(df, [], "t").collect()
    assert settings.json(df.select(F.lit('{"a":{"b":1}}').alias("t")), [], "t").count() == 2


def configs(spark, **docs):
    return settings.json(spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "name string, t string"), ["name"], "t")


def test_matrix(spark):
    """A changes its data against B and its augmentation against C, which changes nothing else against D but the data."""
    base = {s: {"x": 1} for s in compare.SECTIONS}
    a, b = base | {"notes": {"n": 1}}, base | {"dataset": {"x": 2, "root": "q"}}
    rows = configs(spark, A=a, B=b, C=base | {"augmentation": {"x": 1.0}})
    plan = spark.createDataFrame([("A", "B", "dataset.x"), ("A", "B", "dataset.root"), ("A", "C", "augmentation.x"), ("A", "C", "augmentation.y"), ("B", "B", None)], "first string, second string, path string")
    assert [tuple(r) for r in compare.unplanned(compare.scientific(rows), plan).collect()] == [("A", "C", "augmentation.y", "absent")]
    # without the projection the notes count
    assert {tuple(r) for r in compare.unplanned(rows, plan.where("second = 'B'")).collect()} == {("A", "B", "notes", "unplanned")}
    with pytest.raises(ContractError, match="no section framework"):
        compare.scientific(configs(spark, A={k: {} for k in compare.SECTIONS[:-1]}))


def test_exact_environment_and_routes(spark):
    one = lambda d: configs(spark, x=d).drop("name")
    compare.exact(one({"a": 1, "b": {"c": True}}), one({"b": {"c": True}, "a": 1}))
    for other in ({"a": True, "b": {"c": True}}, {"a": 1, "b": {"c": 1}}, {"a": 1}, {"a": 1, "b": {"c": True}, "d": None}):
        with pytest.raises(ContractError):
            compare.exact(one({"a": 1, "b": {"c": True}}), one(other))
    env = {"python": {"version": "3.12", "implementation": "CPython", "prefix": "/a"}, "libraries": {"numpy": "2.0"}, "gpu": {"name": "x", "vram_bytes": 6}}
    now = env | {"python": env["python"] | {"prefix": "/b"}, "libraries": {"numpy": "2.1", "pandas": "2"}}
    drift = compare.differences(compare.fields(one(env)), compare.fields(one(now)))
    assert {(r.path, r.left_value, r.right_value) for r in drift.collect()} == {("libraries.numpy", "2.0", "2.1"), ("libraries.pandas", None, "2")}
    yaml = settings.yaml(spark.createDataFrame([("f", "train: train/images\nval: valid/images\nnc: 1\n")], "file string, text string"))
    compare.routes(yaml, {"train": "train/images", "val": "valid/images"})
    with pytest.raises(ContractError):
        compare.routes(yaml, {"train": "train/images", "val": "valid/images", "test": "test/images"})


def test_unsound(spark):
    doc = {"a": {"recall": 1.2, "n": -3, "iou": 1.0001, "s": "nan"}, "f1": 0.5, "b": True, "precision": -1, "x": "infinity", "y": "else"}
    got = {(r.path, r.rule) for r in compare.unsound(configs(spark, d=doc)).collect()}
    assert got == {("a.recall", "rate_outside"), ("a.iou", "rate_outside"), ("precision", "rate_outside"), ("a.s", "not_finite"), ("x", "not_finite")}


def test_reviews(spark):
    from fieldglass.operators import contracts

    cases = spark.createDataFrame([(f"c{i}", f"h{i}") for i in range(7)], "case_id string, overlay_sha256 string")
    views = list(contracts.VIEWS)
    good = ("inspected", views, ["a"], ["b"], ["c"])
    rows = [("c0", "h0", *good), ("c1", "other", *good), ("c2", "h2", "pending", views[:1], ["a"], ["b"], ["c"]), ("c3", "h3", "inspected", views[::-1], [], [" "], None), ("c4", "h4", *good), ("c4", "h4", *good), ("x", "h", *good), ("c5", None, None, None, ["a"], ["b", None], ["c"])]
    records = spark.createDataFrame(rows, "case_id string, overlay_sha256 string, inspection_status string, inspected_views array<string>, direct_observations array<string>, plausible_interpretations array<string>, unverified_claims array<string>")
    got = {}
    for r in contracts.reviews(cases, records).collect():
        got.setdefault(r.case_id, set()).add(r.rule)
    assert got == {
        "c1": {"overlay"},
        "c2": {"not_inspected", "views"},
        "c3": set(contracts.STATEMENTS),
        "c4": {"repeated"},
        "c5": {"overlay", "not_inspected", "views", "plausible_interpretations"},
        "c6": {"no_record"},
        "x": {"no_case"},
    }


def test_maps_and_orders(spark):
    from fieldglass.functions import geometry as G

    one = spark.range(1)
    assert one.select(G.class_map(F.array(F.lit(3), F.lit(0)).cast("array<bigint>"), ["a", "b"]).alias("m")).first().m == {"a": 3, "b": 0}
    with pytest.raises(Exception, match="2 classes"):
        one.select(G.class_map(F.array(F.lit(3)).cast("array<bigint>"), ["a", "b"])).collect()
    boxes = F.array(*[F.struct(F.lit(k).alias("box_id"), F.lit(v).alias("class_id")) for k, v in (("p/2", 1), ("p/1", 2), ("p/10", 3))])
    assert [tuple(b) for b in one.select(G.by_identifier(boxes).alias("b")).first().b] == [("p/1", 2), ("p/10", 3), ("p/2", 1)]


def test_differing_within_the_row(spark):
    """The same differences as between tables, also where a key with a dot meets a nested one; and no key of a document moves."""
    docs = ['{"a":1,"b":{"c":2,"d":{"e":1}},"n":null}', '{"a":1.0,"b":3,"n":null}', '{"b":{"c":2},"b.c":5,"m":[1]}', '{"b":{"c":5},"b.c":2}', "{}"]
    pairs = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in docs for y in docs)]
    rows = spark.createDataFrame(pairs, "i int, x string, y string")
    flat = lambda c: settings.flattened(F.parse_json(c), F.lit(""), F.lit(None).cast("string"))
    got = rows.select("i", F.inline_outer(compare.differing(flat("x"), flat("y")))).where("path is not null")
    want = compare.differences(settings.json(rows, ["i"], "x"), settings.json(rows, ["i"], "y"), ["i"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))

    from fieldglass.plans import datasets

    plan = datasets.config_diff(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
