"""Literal cases of scalars, contracts, sources, sinks, pixel kernels and orderings."""

import json
import math
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import readwriter as T

from fieldglass.functions import geometry as G
from fieldglass.functions import pixels
from fieldglass.operators import contracts, duplicates, ordering, precision, selection, stats, versions
from fieldglass.sinks import tables, trees
from fieldglass.sources import datasets, settings
from fieldglass.sources import trees as source_trees


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def box(x0, y0, x1, y1):
    return {"x0": F.lit(x0), "y0": F.lit(y0), "x1": F.lit(x1), "y1": F.lit(y1)}


def centre(xc, yc, w, h):
    return F.struct(F.lit(xc).alias("xc"), F.lit(yc).alias("yc"), F.lit(w).alias("w"), F.lit(h).alias("h"))


def points(*xy):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])


def test_scalars(spark):
    # fixed values: the expected results of the cases
    m = G.measures(F.lit(0.1), F.lit(0.2), F.lit(1000), F.lit(500))
    got = one(spark, F.struct(*[c.alias(k) for k, c in m.items()])).asDict()
    assert len(got) == 13 and got["letterbox_scale"] == 0.64 and got["effective_short_side"] == pytest.approx(64) and got["area_px"] == pytest.approx(10_000)
    assert one(spark, G.measures(F.lit(0.0), F.lit(0.2), F.lit(10), F.lit(5))["area_px"]) is None
    five = points((0.2, 0.3), (0.8, 0.2), (0.9, 0.7), (0.5, 0.9), (0.1, 0.6))
    check = one(spark, G.geometry_check(five, centre(0.5, 0.55, 0.8, 0.7)))
    assert check.contained and check.minimum and check.valid and check.occupancy < 1
    assert not one(spark, G.geometry_check(five, centre(0.5, 0.5, 0.8, 0.7))).minimum
    assert one(spark, G.minimum_box(points((0, 0), (1, 1)))) is None
    assert tuple(one(spark, G.to_pixels(centre(0.5, 0.5, 0.5, 0.5), F.lit(100), F.lit(200)))) == (25.0, 50.0, 75.0, 150.0)
    assert one(spark, G.detector_label(F.lit(5))) == 6 and one(spark, G.canonical_label(F.lit(1))) == 0
    for bad in (G.detector_label(F.lit(6)), G.canonical_label(F.lit(0)), G.split_path(F.lit("a/b.jpg")), G.strict_overlap(box(1.0, 0.0, 0.0, 1.0), box(0.0, 0.0, 1.0, 1.0)), G.strict_occupancy(points((0, 0), (2, 0), (2, 2), (0, 2)), centre(0.5, 0.5, 1.0, 1.0))):
        with pytest.raises(Exception):  # noqa: B017  (raised inside Spark)
            one(spark, bad)
    assert one(spark, G.split_path(F.lit("export/version/train/images/example.jpg"))) == "train/images/example.jpg"
    assert tuple(one(spark, G.unletterbox(box(10.0, 0.0, 700.0, 60.0), F.lit(10.0), F.lit(0.0), (F.lit(2.0), F.lit(2.0)), F.lit(300), F.lit(100)))) == (0.0, 0.0, 300.0, 30.0)
    assert one(spark, G.exported(F.lit(0.001), box(0.0, 0.0, 1.0, 1.0))) is False and one(spark, G.exported(F.lit(0.002), box(0.0, 0.0, 1.0, 1.0)))
    assert not one(spark, G.exported(F.lit(0.5), box(0.0, 0.0, 0.0, 1.0))) and not one(spark, G.exported(F.lit(0.5), box(0.0, 0.0, float("inf"), 1.0)))
    assert [one(spark, G.band(F.lit(x))) for x in (0.25, 0.24, 0.01, 0.009)] == ["reference", "low", "low", "very_low"]
    assert one(spark, G.fixed(F.lit(0.1))) == "0.100000000000" and one(spark, G.display_path(F.lit("/a/b/c"), "/a")) == "b/c"
    assert one(spark, G.extreme_aspect(F.lit(201), F.lit(100))) and not one(spark, G.extreme_aspect(F.lit(200), F.lit(100)))
    assert [one(spark, c) for c in G.size_flags(F.lit(0.0009)).values()] == [True, False]


def test_viewport(spark):
    view = G.viewport(box(10.0, 10.0, 30.0, 30.0), box(20.0, 20.0, 50.0, 40.0), F.lit(0.1), F.lit(400), F.lit(300))
    got = one(spark, view)
    assert tuple(got) == (0, 0, 160, 160)
    fit = one(spark, G.fit_panel(view, (0, 0, 320, 160)))
    assert (fit.scale, fit.dx, fit.dy) == (1.0, 80.0, 0.0)
    v, f = F.struct(*[F.lit(x).alias(k) for k, x in zip(("x0", "y0", "x1", "y1"), (0, 0, 160, 160), strict=True)]), F.struct(F.lit(1.0).alias("scale"), F.lit(80.0).alias("dx"), F.lit(0.0).alias("dy"))
    assert tuple(one(spark, G.map_box(box(-5.0, 10.0, 20.0, 30.0), v, f))) == (80.0, 10.0, 100.0, 30.0)
    assert one(spark, G.map_box(box(200.0, 10.0, 220.0, 30.0), v, f)) is None
    a = np.array(one(spark, G.affine(F.lit(100), F.lit(50), 0.0, 0.0, 0.0, 1.0)))
    assert np.allclose(a, [[1, 0, 0], [0, 1, 0]])
    assert one(spark, G.learning_rate(F.lit(50), F.lit(0), 0.1, 100, 10, 0.01)) == pytest.approx(0.05)


def test_ordinals_and_running_values(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(x), i) for i, (g, x) in enumerate(zip(rng.integers(0, 3, 500), rng.normal(size=500), strict=True))]
    df = spark.createDataFrame(rows, "g int, x double, i int").repartition(6)
    got = ordering.ordinals(df, ["g"], [F.desc("x"), F.asc("i")], "n", "part")
    full = ordering.following(ordering.running_max(ordering.running_sum(got, ["g"], "part", "n", "x", "upto"), ["g"], "part", "n", "x", "later"), ["g"], "part", "n", ["x"])
    for g in range(3):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        out = sorted((r for r in full.collect() if r.g == g), key=lambda r: r.n)
        assert [r.i for r in out] == [r[2] for r in own] and [r.n for r in out] == list(range(1, len(own) + 1))
        assert np.allclose([r.upto for r in out], np.cumsum([r[1] for r in own]))
        assert [r.later for r in out] == [max(x[1] for x in own[k:]) for k in range(len(own))]
        assert [r.next_x for r in out] == [x[1] for x in own[1:]] + [None]
    assert ordering.ordinals(df.limit(0), ["g"], [F.asc("x")]).count() == 0


def plain_ap(hits, support, sentinel):
    """Average precision of one ranked list, read at 101 recalls."""
    tp = np.cumsum(hits)
    at = np.flatnonzero(hits)
    recall, prec = tp[at] / support, tp[at] / (at + 1)
    env = np.maximum.accumulate(prec[::-1])[::-1]
    xs = np.arange(101) / 100.0
    y = np.zeros(101)
    for k, x in enumerate(xs):
        if not len(at) or x >= 1:
            continue
        if x < recall[0]:
            y[k] = env[0]
            continue
        i = np.searchsorted(recall, x, "right") - 1
        if i + 1 < len(at):
            y[k] = env[i] + (env[i + 1] - env[i]) * (x - recall[i]) / (recall[i + 1] - recall[i])
        elif sentinel:
            y[k] = env[i] + (0 - env[i]) * (x - recall[i]) / (1 - recall[i])
    return float(((y[1:] + y[:-1]) / 2 * 0.01).sum())


@pytest.mark.parametrize("sentinel", [True, False])
def test_average_precision(spark, sentinel):
    rng = np.random.default_rng(3)
    preds, gts, pairs = [], [], []
    for i in range(120):
        cls = int(rng.integers(0, 2))
        if rng.random() < 0.7:
            gts.append((i, 1, cls))
        preds.append((i, 1, cls, float(rng.random())))
        if gts and gts[-1][0] == i and rng.random() < 0.6:
            pairs.append((i, 1, 1, cls, cls, preds[-1][3], float(rng.choice([0.55, 0.72, 0.96]))))
    p = spark.createDataFrame(preds, "image_id long, pred_id int, class_id int, conf double")
    g = spark.createDataFrame(gts, "image_id long, gt_id int, class_id int")
    v = spark.createDataFrame(pairs, "image_id long, pred_id int, gt_id int, pc int, gc int, conf double, iou double")
    got = {(r.class_id, r.threshold): r.ap for r in precision.average_precision(v, p, g, sentinel, floor=0.0).collect()}
    assert len(got) == 20
    for (cls, t), ap in got.items():
        ranked = sorted((x for x in preds if x[2] == cls), key=lambda x: (-x[3], x[0]))
        iou = {x[0]: x[6] for x in pairs}
        hits = np.array([iou.get(x[0], 0) >= t / 100 for x in ranked])
        assert ap == pytest.approx(plain_ap(hits, sum(x[2] == cls for x in gts), sentinel), abs=1e-9)


def test_two_stage(spark):
    """Old a1, a2 and new b1 of one source: a1 takes b1, a2 is removed."""
    rows = lambda names: spark.createDataFrame([("k", n, i) for i, n in enumerate(names)], "key string, name string, ord int")
    got = {(r.old_name, r.new_name, r.how) for r in versions.two_stage(rows(["a1", "a2"]), rows(["b1"]), ["key"], "ord").collect()}
    assert got == {("a1", "b1", "key"), ("a2", None, "removed")}
    got = {(r.old_name, r.new_name, r.how) for r in versions.two_stage(rows(["a1", "a2"]), rows(["a2", "b1"]), ["key"], "ord").collect()}
    assert got == {("a1", None, "removed"), ("a2", "a2", "exact"), (None, "b1", "added")}


def test_label_versions(spark):
    """Equal coordinates under another class, and polygons that start elsewhere or repeat their first vertex."""
    schema = "image string, line_number int, class_name string, coords array<double>"
    old = spark.createDataFrame([("i", 1, "three", [0.1, 0.2, 0.3, 0.4]), ("j", 1, "a", [0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0])], schema)
    new = spark.createDataFrame([("i", 1, "four", [0.1, 0.2, 0.3, 0.4]), ("j", 1, "a", [1.0, 0.0005, 0.0, 1.0, 0.0, 0.0])], schema)
    got = {r.image: r for r in versions.compare_labels(old, new, "image").collect()}
    assert got["i"].coordinates_equal and not got["i"].semantic_equal and [tuple(t) for t in got["i"].transitions] == [("three", "four")]
    assert got["j"].semantic_equal


def class_names(spark, *texts):
    rows = settings.yaml(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, text string"))
    return [(r.names, r.problem) for r in settings.class_lists(rows).orderBy(F.col("file").cast("int")).collect()]


def test_class_names(spark):
    good = ["names: ['a', 'b']\nnc: 2", "names: {1: 'b', 0: 'a'}", "nc: 2\nnames:\n  - a\n  - 'b c'\n", "names:\n  1: b\n  0: a\nother: 1", "names:\n- a\n- b # two", "﻿names: [a, b]", "names: {0: a, 1: b}"]
    want = [["a", "b"]] * 7
    want[2] = ["a", "b c"]
    assert class_names(spark, *good) == [(w, None) for w in want]
    assert [p for _, p in class_names(spark, "nc: 1", "nc: 3\nnames: ['a']")] == ["no_names", "wrong_count"]


def png(a):
    """A PNG file of gray or RGB bytes."""
    h, w = a.shape[:2]
    kind = 0 if a.ndim == 2 else 2
    raw = b"".join(b"\0" + a[i].tobytes() for i in range(h))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def dataset(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(5)
    for split in ("train", "valid", "test"):
        for kind in ("images", "labels"):
            (root / "set" / split / kind).mkdir(parents=True)
        for i in range(2):
            (root / "set" / split / "images" / f"Im{i}.png").write_bytes(png(rng.integers(0, 256, (20, 30, 3), dtype=np.uint8)))
            (root / "set" / split / "labels" / f"im{i}.txt").write_text("" if i else "1 0.5 0.5 0.2 0.2\n3 0.5 0.4 0.2 0.3\n")
    (root / "set" / "data.yaml").write_text("names: ['a','b','c','d','e','f']\nnc: 6\n")
    return root


def test_dataset_sources(spark, dataset):
    found = datasets.discover(spark, str(dataset)).collect()
    assert len(found) == 1 and found[0].class_names == list("abcdef") and found[0].candidate_id.startswith("set-")
    assert datasets.primary(datasets.discover(spark, str(dataset))).count() == 1
    with pytest.raises(FileNotFoundError):
        datasets.discover(spark, str(dataset / "set" / "train"))
    root = str(dataset / "set")
    assert datasets.pairs(spark, root).count() == 6
    assert datasets.pairs(spark, root, splits=("train",)).count() == 2
    files = source_trees.files(spark, root)
    assert datasets.unique_stems(files, [".png"]).count() == 0 and contracts.entries(files, {"images": [".png"], "labels": [".txt"]}).count() == 1
    good, bad = datasets.dimensions(spark, root + "/train/images")
    assert [(r.width, r.height) for r in good.collect()] == [(30, 20)] * 2 and bad.count() == 0
    labels = spark.read.text(root + "/train/labels", wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    assert [(r.line_number, r.class_name) for r in datasets.tolerant_labels(labels, list("abcdef")).orderBy("line_number").collect()] == [(1, "b"), (2, "d")]
    rows = datasets.manifest(spark, str(dataset))
    got = [r.relative_path for r in rows.collect()]
    assert got == sorted(got, key=str.lower) and len(got) == 13
    import hashlib

    assert datasets.manifest_digest(rows) == hashlib.sha256("\n".join(f"{r.relative_path}\t{r.size_bytes}\t{r.sha256}" for r in rows.collect()).encode()).hexdigest()
    os.remove(dataset / "set" / "test" / "labels" / "im1.txt")
    with pytest.raises(ValueError):
        datasets.pairs(spark, root)
    assert datasets.pairs(spark, root, strict=False).count() == 5


def test_tables(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", 1, True, {"k": 2, "b": 1}, [1, 2]), ("b", None, False, None, [])], "s string, n int, f boolean, m map<string,int>, l array<int>")
    tables.csv(df, str(tmp_path / "c"), ["s", "n", "f", "m"])
    text = sorted((tmp_path / "c").glob("*.csv"))[0].read_text().splitlines()
    assert text[0] == "s,n,f,m" and text[1].startswith("a,1,True,")
    back = datasets.csv(spark, str(tmp_path / "c"), "s string, n int, f boolean", F.col("f"))
    assert [tuple(r) for r in back.collect()] == [("a", 1, True)]
    with pytest.raises(ValueError):
        tables.csv(df.limit(0), str(tmp_path / "e"), need_rows=True)
    tables.json_lines(df, str(tmp_path / "j"))
    tables.json_lines(df.where("false"), str(tmp_path / "j"))
    # a writer that writes something else
    with pytest.raises(ValueError, match="does not read back"):
        monkeypatch.setattr(T.DataFrameWriter, "json", lambda self, path, **k: self.mode("overwrite").text(path))
        tables.json_lines(spark.range(3).select(F.lit('{"other":1}').alias("t")), str(tmp_path / "j"))
    monkeypatch.undo()
    assert tables.finite_text({"a": [math.nan, math.inf, 1.0], 2: {"b": (-math.inf, True)}}) == {"a": ["nan", "infinity", 1.0], "2": {"b": ["-infinity", True]}}
    tables.document(spark, {"b": 1, "a": [1.5]}, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"a": [1.5], "b": 1} and (tmp_path / "d.json").read_text().startswith('{\n  "a"')
    with pytest.raises(ValueError):
        tables.document(spark, {"a": math.nan}, str(tmp_path / "n.json"))
    (tmp_path / "log.csv").write_text(" epoch, mAP \n1,0.5\n2,0.5\n")
    log = datasets.training_log(spark, str(tmp_path / "log.csv"), {"mAP": "map50_95"})
    assert source_trees.best_epoch(log).first()["epoch"] == 1
    (tmp_path / "bad.csv").write_text("epoch,x\n1,nan\n")
    with pytest.raises(Exception):  # noqa: B017  (raised inside Spark)
        datasets.training_log(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "r.md").write_text("x\n| Train | 5 | 4 | 3 | 2 |\n| class | n |\nCounts:\n| a b | 7 |\n")
    assert [tuple(r) for r in datasets.markdown_rows(spark, str(tmp_path / "r.md"), 5).collect()] == [("Train", 5, 4, 3, 2)]
    assert [tuple(r) for r in datasets.markdown_rows(spark, str(tmp_path / "r.md"), 2, after="Counts:").collect()] == [("a b", 7)]


def test_label_trees(spark, tmp_path):
    schema = "path string, line_number int, class_id int, box struct<xc:double,yc:double,w:double,h:double>"
    rows = spark.createDataFrame([("train/labels/a.txt", 2, 3, (0.5, 0.4, 0.2, 0.1)), ("train/labels/a.txt", 1, 1, (0.5, 0.55, 0.8, 0.7)), ("train/labels/b.txt", None, None, None)], schema)
    images = spark.createDataFrame([("train/images/a.png", bytearray(b"\x00\xff"))], "path string, content binary")
    written = trees.write_files(trees.converted(images, rows), str(tmp_path / "out")).collect()
    assert len(written) == 3
    # fixed value: the text of the row
    assert (tmp_path / "out/train/labels/a.txt").read_text() == "1 0.5000000000 0.5500000000 0.8000000000 0.7000000000\n3 0.5000000000 0.4000000000 0.2000000000 0.1000000000\n"
    assert (tmp_path / "out/train/labels/b.txt").read_bytes() == b"" and (tmp_path / "out/train/images/a.png").read_bytes() == b"\x00\xff"
    files = spark.createDataFrame([("a", bytearray(b"5 0.50 .1 1e-1 0.2\r\n0 1 1 1 1")), ("b", bytearray(b""))], "path string, content binary")
    assert {r.path: bytes(r.content) for r in trees.single_class(files).collect()} == {"a": b"0 0.50 .1 1e-1 0.2\r\n0 1 1 1 1", "b": b""}
    with pytest.raises(Exception):  # noqa: B017  (raised inside Spark)
        trees.single_class(spark.createDataFrame([("a", bytearray(b"7 1 1 1 1"))], "path string, content binary")).collect()
    trees.data_yaml(spark, str(tmp_path / "data.yaml"), ["a", "b: c"])
    assert class_names(spark, (tmp_path / "data.yaml").read_text()) == [(["a", "b: c"], None)]
    for name in ("new1", "new2", "old1"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f").write_text(name)
    trees.publish({str(tmp_path / "new1"): str(tmp_path / "old1"), str(tmp_path / "new2"): str(tmp_path / "old2")})
    assert (tmp_path / "old1/f").read_text() == "new1" and (tmp_path / "old2/f").read_text() == "new2"
    with pytest.raises(OSError):
        trees.publish({str(tmp_path / "gone"): str(tmp_path / "old1")})
    assert (tmp_path / "old1/f").read_text() == "new1"


def test_contracts(spark, tmp_path):
    with pytest.raises(contracts.ContractError):
        contracts.outside(str(tmp_path / "raw" / "out"), str(tmp_path / "raw"))
    contracts.outside(str(tmp_path / "out"), str(tmp_path / "raw"))
    with pytest.raises(contracts.ContractError):
        contracts.within(str(tmp_path / ".." / "x"), str(tmp_path))
    with pytest.raises(contracts.ContractError):
        contracts.allowed_split("test")
    images = spark.createDataFrame([("train", 1), ("train", 0)], "split string, annotation_count int")
    boxes = spark.createDataFrame([("train", 1)], "split string, class_id int")
    want = "split string, images long, annotations long, empty_labels long, class_counts array<long>"
    assert contracts.counts(images, boxes, spark.createDataFrame([("train", 2, 1, 1, [0, 1])], want), 2).count() == 0
    assert contracts.counts(images, boxes, spark.createDataFrame([("train", 2, 1, 1, [1, 0])], want), 2).count() == 1
    with pytest.raises(contracts.ContractError):
        contracts.require(images, "no rows may be left")
    preds = spark.createDataFrame([(1, "p", 0, 1.5, 0.0, 0.0, 1.0, 1.0), (1, "q", 9, 0.5, 2.0, 0.0, 1.0, 1.0), (1, "q", 0, 0.5, 0.0, 0.0, 1.0, 1.0)], "image_id int, pred_id string, class_id int, conf double, x0 double, y0 double, x1 double, y1 double")
    gts = preds.select("image_id", F.col("pred_id").alias("gt_id"), F.lit(0).alias("class_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1")).where("gt_id = 'p'")
    assert sorted(r.rule for r in contracts.detections(preds, gts, 6).collect()) == ["pred_id_box", "pred_id_class", "pred_id_confidence", "pred_id_unique"]
    assert contracts.reproduced({"m": 0.1}, {"m": 0.10004}) == [("m", pytest.approx(4e-5), True)]
    src = spark.createDataFrame([("train", "i", 1, 2, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]), ("train", "i", 2, 2, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])], "split string, image string, line_number int, class_id int, points array<struct<x:double,y:double>>")
    done = spark.createDataFrame([("train", "i", 1, 2, (0.5, 0.5, 1.0, 1.0))], "split string, image string, line_number int, class_id int, box struct<xc:double,yc:double,w:double,h:double>")
    assert [(r.line_number, r.rule) for r in contracts.conversion(src, done).collect()] == [(2, "lost")]


def test_pixels(spark, tmp_path):
    rng = np.random.default_rng(2)
    ramp = np.tile(np.linspace(255, 0, 90).astype(np.uint8), (80, 1))
    assert pixels.difference_hash(ramp[:, :, None]) == "f" * 16 and pixels.difference_hash(ramp[:, ::-1, None]) == "0" * 16
    a = rng.integers(0, 256, (40, 50, 3), dtype=np.uint8)
    assert pixels.pixel_difference(pixels.contrast_signature(a), pixels.contrast_signature(a)) == 0
    flat = np.full((64, 64), 7, np.uint8)
    assert pixels.equalise(flat).std() == 0 and pixels.resize(flat, 9, 8).tolist() == [[7] * 9] * 8
    low = (100 + rng.integers(0, 20, (64, 64))).astype(np.uint8)
    assert pixels.equalise(low).std() > low.std() and pixels.channels_equal(pixels.preprocess(a)) and not pixels.channels_equal(a)
    assert pixels.standardise(np.array([[0, 65535]], np.uint16)).tolist() == [[0, 255]] and pixels.standardise(np.array([[0.0, 1.0]])).tolist() == [[0, 255]]
    with pytest.raises(ValueError):
        pixels.standardise(np.array([[-1]]))
    assert (pixels.gain(a, 0.0) == a).all() and pixels.gain(a, 0.1).max(axis=2).mean() > a.max(axis=2).mean()
    with pytest.raises(ValueError):
        pixels.gain(a, 0.2)
    share, corr, slope, cut, rmse = pixels.aligned(low, (low.astype(int) + 5).astype(np.uint8), np.ones(low.shape, bool))
    assert (share, round(corr, 6), round(slope, 6), round(cut, 4), round(rmse, 6)) == (1.0, 1.0, 1.0, -5.0, 0.0)
    # the second is half as bright: the first is twice the second
    even = low // 2 * 2
    half = pixels.aligned(even, even // 2 + 20, np.ones(low.shape, bool))
    assert [round(v, 6) for v in half] == [1.0, 1.0, 2.0, -40.0, 0.0]
    assert pixels.aligned(even, np.full(low.shape, 9, np.uint8), np.ones(low.shape, bool))[1] == 0.0
    # stretched before it is made small: one bright and one dark pixel set the range
    spot = np.full((64, 64), 100, np.uint8)
    spot[:32] = 120
    spot[0, 0], spot[63, 63] = 0, 255
    assert (pixels.contrast_signature(spot)[4:12, 4:12] == 120).all() and set(pixels.stretched(np.array([[10, 20, 30]], np.uint8)).ravel()) == {0, 127, 255}
    # the middle square of a wide picture
    wide = np.zeros((40, 100), np.uint8)
    wide[:, 30:70] = np.tile(np.arange(40) * 6, (40, 1))
    assert (pixels.fitted(wide, 40) == wide[:, 30:70]).all()
    assert pixels.aligned(low, low, np.zeros(low.shape, bool))[1:] == (0.0, 1.0, 0.0, 0.0)
    (tmp_path / "a.png").write_bytes(png(a[:, :, ::-1].copy()))
    (tmp_path / "b.png").write_bytes(b"broken")
    df = spark.read.format("image").option("dropInvalid", False).load(str(tmp_path))
    i = F.col("image")
    rows = df.select(i["height"].alias("h"), pixels.dhash_column(i).alias("d"), pixels.statistics_column(i).alias("s"), pixels.statistics_column(i, True).alias("p"), pixels.fingerprint_column(i).alias("f"), pixels.signature_column(i).alias("c"), pixels.pixel_hash(i).alias("x")).collect()
    good, bad = next(r for r in rows if r.h > 0), next(r for r in rows if r.h <= 0)
    assert good.d == pixels.difference_hash(a) and tuple(good.s) == pixels.statistics(pixels.gray(a)) and good.p.pixels == 2000
    assert np.allclose(good.f, pixels.fingerprint(a)) and bytes(good.c) == pixels.contrast_signature(a).tobytes() and bad.d is None and bad.s.pixels is None


def test_selections(spark):
    rows = spark.createDataFrame([(i, i % 7, i % 2) for i in range(10)], "i int, x int, g int")
    assert [r.window for r in selection.count_windows(rows, [F.asc("i")], 4).orderBy("i").collect()] == [0] * 4 + [1] * 4 + [2] * 2
    with pytest.raises(ValueError):
        selection.count_windows(rows, [F.asc("i")], 0)
    cand = spark.createDataFrame([(1, "representative_class", 0.0, 1), (2, "low", 0.1, 1), (2, "low", 0.2, 2), (3, "low", 0.3, 1), (4, "low", 0.4, 1)], "image_id int, reason string, metric double, gt_id int")
    assert {r.image_id: r.reasons for r in selection.review_images(cand, most=2).collect()} == {1: "representative_class", 2: "low", 3: "low"}
    rec = spark.createDataFrame([(i, i % 2, float(i)) for i in range(9)], "image_id int, class_id int, mean double")
    got = {r.image_id: r.reasons for r in selection.preprocessing_review(rec, {"brightest": F.desc("mean")}).collect()}
    assert got == {4: "representative_class", 3: "representative_class", 8: "brightest", 7: "brightest"}
    boxes = spark.createDataFrame([(i, 1, 0, float(i)) for i in range(9)] + [(20, 1, 5, 0.5)], "image_id int, gt_id int, class_id int, area double")
    pairs = spark.createDataFrame([(30, 31, True, 0.1, 2), (32, 33, False, 0.0, 0)], "first_id int, second_id int, cross_split boolean, difference double, distance int")
    few = spark.createDataFrame([(40,)], "image_id int")
    got = {(r.category, r.image_id) for r in selection.audit_samples(boxes, few, few, pairs).collect()}
    assert {("class_0", 4), ("class_5", 20), ("issue", 40), ("empty", 40), ("cross_split", 30), ("cross_split", 31), ("smallest", 0)} <= got and len(got) == 11
    case = spark.createDataFrame([(1, 1, 9)], "image_id int, gt_id int, focus_id int")
    near = spark.createDataFrame([(1, k, 1, 0, k % 2, 10 * k, 0.1 * k) for k in range(10)], "image_id int, pred_id int, gt_id int, pc int, gc int, conf int, iou double")
    shown = [r.pred_id for r in selection.shown_predictions(case, near, True).orderBy("place").collect()]
    assert shown[0] == 9 and len(shown) == 8
    assert [r.pred_id for r in selection.shown_predictions(case, near, False).orderBy("place").collect()] == [9, 8, 7, 6, 5, 4]
    assert selection.best_listed(near, near.where("pred_id < 5").select("image_id", "gt_id", "pred_id")).first()["pred_id"] == 4
    more, cut = duplicates.first_pairs(spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "first_id int, second_id int"), 2)
    assert cut and [tuple(r) for r in more.collect()] == [(1, 2), (1, 3)]


def test_describe_refuses(spark):
    df = spark.createDataFrame([(float("nan"),)], "x double")
    with pytest.raises(Exception, match="finite"):
        stats.described(df, [], {"x": F.col("x")}, True).collect()
    none = stats.with_described(spark.range(1).select(F.lit(1).alias("k")), df.where("false").withColumn("k", F.lit(1)), ["k"], {"x_": F.col("x")}).first()
    assert none["x_count"] == 0 and none["x_mean"] is None


@pytest.mark.parametrize("n,parts", [(1, 4), (2, 4), (7, 3), (500, 5), (2000, 1)])
def test_quantiles_by_selection(spark, n, parts):
    """Groups of many ties, nulls and few values, and a group that fills several parts."""
    rng = np.random.default_rng(n)
    rows = [("hot", 3.0)] * n + [("one", 1.5)] + [("none", None)] * 3 + [(None, float(x)) for x in rng.integers(0, 9, n)] + [("mixed", float(x)) for x in rng.normal(0, 1, n)] + [("mixed", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(parts)
    fractions = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r for r in stats.selected(df, ["k"], fractions, True).collect()}
    assert got.keys() == {"hot", "one", None, "mixed"}
    for k, r in got.items():
        own = np.array([v for x, v in rows if x == k and v is not None])
        assert r.n == len(own) and [r[f"q{i}"] for i in range(len(fractions))] == pytest.approx(np.quantile(own, fractions).tolist())
        assert (r.least, r.most, r["mean"], r["std"]) == pytest.approx((own.min(), own.max(), own.mean(), own.std()))


def test_descriptions_hold_no_buffer(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    for out in (stats.described(df, ["k"], {"x": F.col("x")}, True), stats.quantiles(df, ["k"], {"m": (F.col("x"), 0.5)})):
        plan = out._jdf.queryExecution().executedPlan().toString().lower()
        assert "percentile" not in plan and "median(" not in plan and "collect_list" not in plan


def test_scene_is_written_once(spark):
    from fieldglass import scene
    from fieldglass.plans import scratch

    sf = "/root/testdata/sf0.001"
    first, second = scene.boxes(spark, sf)[0], scene.boxes(spark, sf)[1]
    files = first.inputFiles()
    assert files == second.inputFiles() == scene.boxes(spark, sf)[0].inputFiles()
    scratch.remove(spark, files[0].rsplit("/", 1)[0])
    again = scene.boxes(spark, sf)[0]
    assert not set(again.inputFiles()) & set(files) and again.count() > 0
