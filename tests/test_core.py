"""Literal cases of the operators, and the queries against their SQL."""

import hashlib
import json
import glob
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldglass.functions import geometry as G
from fieldglass.operators import duplicates, graph, matching, precision, sampling, selection, stats, versions
from fieldglass.plans.queries import ORACLE, QUERIES
from fieldglass.scene import Point
from fieldglass.sources import labels, trees

SF = "/root/testdata/sf0.001"
BOXES = "image_id long, {} long, class_id long, x0 long, y0 long, x1 long, y1 long"


def boxes(spark, rows, conf=False):
    return spark.createDataFrame(rows, BOXES.format("pred_id" if conf else "gt_id") + (", conf long" if conf else ""))


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def struct(**k):
    return {c: F.lit(v) for c, v in k.items()}


@pytest.mark.parametrize("b,want", [((0, 0, 10, 10), 1.0), ((5, 0, 15, 10), 1 / 3), ((20, 0, 30, 10), 0.0), ((10, 0, 20, 10), 0.0), ((3, 3, 3, 3), 0.0)])
def test_overlap(spark, b, want):
    v = one(spark, G.overlap(struct(x0=0, y0=0, x1=10, y1=10), dict(zip(("x0", "y0", "x1", "y1"), map(F.lit, b), strict=True))))
    assert v == pytest.approx(want)


def test_polygon(spark):
    pts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.2, 0.3), (0.8, 0.2), (0.9, 0.7), (0.5, 0.9), (0.1, 0.6))])
    assert one(spark, G.label_row(F.lit(1), G.polygon_box(pts))) == "1 0.5000000000 0.5500000000 0.8000000000 0.7000000000"
    tri = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))])
    assert one(spark, G.polygon_area(tri)) == 0.5
    assert one(spark, G.occupancy(tri, G.polygon_box(tri))) == 0.5
    assert one(spark, G.contains(tri, G.polygon_box(tri)))


def test_scalars(spark):
    m = G.metrics(F.lit(2), F.lit(1), F.lit(2))
    assert [one(spark, m[k]) for k in ("precision", "recall", "f1")] == pytest.approx([2 / 3, 1 / 2, 4 / 7])
    assert one(spark, G.percentage(F.lit(1), F.lit(0))) is None
    assert [one(spark, G.orientation(F.lit(w), F.lit(h))) for w, h in ((1000, 500), (600, 1200), (1000, 975))] == ["landscape", "portrait", "approximately_square"]
    assert [one(spark, G.size_group(F.lit(s))) for s in (31.99, 32.0, 63.99, 64.0)] == [0, 1, 1, 2]
    box = G.letterbox(F.lit(0.1), F.lit(0.2), F.lit(1000), F.lit(500))
    assert one(spark, box["scale"]) == 0.64 and one(spark, box["effective_width"]) == pytest.approx(64)
    assert one(spark, G.source_key(F.lit("A.rf." + "0f" * 8))) == "a"
    assert one(spark, G.remap_class(F.lit("5 0.1 0.20"))) == "0 0.1 0.20"


def test_assignment(spark):
    gts = boxes(spark, [(1, 1, 0, 0, 0, 10, 10)])
    preds = boxes(spark, [(1, 1, 0, 0, 0, 10, 10, 70), (1, 2, 0, 0, 0, 10, 10, 90), (1, 3, 1, 0, 0, 10, 10, 95), (1, 4, 0, 0, 0, 10, 10, 24)], True)
    pairs = matching.overlaps(preds, gts)
    assert [tuple(r)[:3] for r in matching.assign(pairs).collect()] == [(1, 2, 1)]
    assert [tuple(r)[:3] for r in matching.assign(pairs, Point(aware=False)).collect()] == [(1, 3, 1)]
    t = matching.totals(matching.assign(pairs), preds, gts).first()
    assert (t.tp, t.fp, t.fn) == (1, 2, 0)


def test_ties(spark):
    gts = boxes(spark, [(1, g, 0, 0, 0, 10, 10) for g in (9, 7)])
    preds = boxes(spark, [(1, p, 0, 0, 0, 10, 10, 50) for p in (3, 1, 2)], True)
    got = sorted(tuple(r)[1:3] for r in matching.assign(matching.overlaps(preds, gts)).collect())
    assert got == [(1, 7), (2, 9)]


@pytest.mark.parametrize(
    "pred,want", [((0, 0, 0, 3, 10, 90), "localization_failure"), ((0, 0, 0, 10, 10, 24), "low_confidence_detection"), ((1, 0, 0, 10, 10, 90), "classification_error"), ((0, 50, 50, 60, 60, 90), "complete_miss")]
)
def test_taxonomy(spark, pred, want):
    gts = boxes(spark, [(1, 1, 0, 0, 0, 10, 10)])
    preds = boxes(spark, [(1, 1, *pred)], True)
    pairs = matching.overlaps(preds, gts)
    assert matching.taxonomy(pairs, gts, matching.assign(pairs)).first()["primary"] == want


def test_average_precision(spark):
    gts = boxes(spark, [(1, 1, 0, 0, 0, 10, 10), (2, 1, 1, 0, 0, 10, 10)])
    preds = boxes(spark, [(1, 1, 0, 0, 0, 10, 10, 90), (2, 1, 1, 0, 0, 10, 10, 80)], True)
    ap = precision.average_precision(None, preds, gts).collect()
    assert sorted(ap) == sorted(precision.average_precision(matching.overlaps(preds, gts), preds, gts).collect())
    assert {round(r.ap, 6) for r in ap} == {0.995} and {r.support for r in ap} == {1}


def parsed(spark, text):
    rows = spark.createDataFrame([("f", text)], "file string, text string")
    return labels.parse(labels.lines(rows), [0, 1]).orderBy("line_number").collect()


def test_labels(spark):
    assert [r.issues for r in parsed(spark, "1 0.5 0.4 0.2 0.3\n")] == [[]]
    assert parsed(spark, " \n\t\n") == []
    assert [r.issues for r in parsed(spark, "0 0.5 0.5 0.2\n0 x 0.5 0.2 0.2\n\n0 nan 0.5 0.2 0.2\nq 0.5 0.5 0.2 0.2")] == [["incorrect_value_count"], ["non_numeric_value"], ["blank_line"], ["non_finite_value"], ["invalid_class_format"]]
    bad = parsed(spark, "3 1.2 0.5 0 -0.1")[0]
    assert set(bad.issues) == {"unexpected_class_id", "center_out_of_range", "non_positive_size", "box_outside_image"} and not bad.valid
    twice = parsed(spark, "1 0.5 0.4 0.2 0.3\n1 0.5 0.4 0.2 0.3")
    assert [r.issues for r in twice] == [[], ["duplicate_annotation"]] and all(r.valid for r in twice)
    assert parsed(spark, "0 0.2 0.3 0.8 0.2 0.9 0.7")[0].annotation_type == "polygon"


def test_hamming_and_components(spark):
    rows = spark.createDataFrame([(1, 0b0), (2, 0b1111), (3, 0b11111), (4, (1 << 23))], "i long, b long")
    pairs = duplicates.hamming_pairs(rows, "i", "b", 24, 4)
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 2, 4), (1, 4, 1), (2, 3, 1)]
    assert {tuple(r) for r in graph.components(pairs, "first_id", "second_id").collect()} == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert graph.components(pairs.limit(0), "first_id", "second_id").count() == 0


@pytest.mark.parametrize("a,b,want", [([1, 1, 2, 3], [5, 5, 7, 9], 1.0), ([1, 1, 2, 3], [9, 9, 7, 5], -1.0), ([1, 1, 1], [1, 2, 3], None)])
def test_spearman(spark, a, b, want):
    got = stats.spearman(spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int"), "a", "b").first().rho
    assert got is None if want is None else got == pytest.approx(want)


def test_sources(spark, tmp_path):
    for split in ("train", "valid"):
        d = tmp_path / split / "labels"
        d.mkdir(parents=True)
        (d / "A.txt").write_text("0 0.5 0.5 0.1 0.1\n")
    rows = trees.files(spark, str(tmp_path), "*.txt", True).orderBy("relative_path").collect()
    assert [(r.split, r.kind, r.stem) for r in rows] == [("train", "labels", "A"), ("valid", "labels", "A")]
    good = {"sample_id": "valid/a", "split": "valid", "image": "a", "width": 10, "height": 10, "image_sha256": "", "label_sha256": "", "predictions": [{"box_id": "p", "class_id": 0, "xyxy": [0.0, 0.0, 5.0, 5.0], "confidence": 0.5}], "ground_truth": []}
    bad = {**good, "sample_id": "train/a", "predictions": [{"box_id": "p", "class_id": 9, "xyxy": [5.0, 0.0, 5.0, 5.0], "confidence": 2.0}]}
    from fieldglass.scene import EXPORT

    got = trees.export_violations(spark.createDataFrame([good, bad], EXPORT), 6).collect()
    assert {(r.sample_id, r.rule) for r in got} == {("train/a", x) for x in ("split", "predictions_class", "predictions_box", "confidence")}
    assert trees.config_digest({"a": 1, "b": 2}) == trees.config_digest({"b": 2, "a": 1})
    log = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "epoch int, map50_95 double")
    assert trees.best_epoch(log).first().epoch == 2


def test_versions(spark):
    old = spark.createDataFrame([("a", "k"), ("b", "k2"), ("c", "k3")], "name string, key string")
    new = spark.createDataFrame([("a", "k"), ("d", "k2"), ("e", "k9")], "name string, key string")
    got = {(r.old_name, r.new_name, r.how) for r in versions.two_stage(old, new, ["key"]).collect()}
    assert got == {("a", "a", "exact"), ("b", "d", "key"), ("c", None, "removed"), (None, "e", "added")}


def test_stream(spark, tmp_path):
    from fieldglass.streaming import each_batch

    spark.range(5).write.parquet(str(tmp_path / "in"))
    q = each_batch(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda b: b.where("id > 2"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    def rows(cols, data):
        order = sorted(range(len(cols)), key=cols.__getitem__)
        return sorted(cols), sorted([tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in (r[i] for i in order)) for r in data])

    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE[name])
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def greedy(cases, quotas, seed):
    """All cases on one side: the sampler by its rules."""
    for c in cases:
        c["rank"] = hashlib.sha256(json.dumps([seed, c["category"], c["image_id"], c["gt_id"], c["pred_id"]], separators=(",", ":")).encode()).hexdigest()
    out, images, ids = [], set(), set()
    order = [*selection.FIRST_PICKED, *(q for q in quotas if q not in selection.FIRST_PICKED)]
    for category in order:
        left, n = [c for c in cases if c["category"] == category], {}
        for i in range(min(quotas[category], len(left))):
            pick = left
            if category == "fp_annotated" and i == 0:
                pick = [c for c in left if c["duplicate_like"]] or left
            if category == "successful_detection" and i < 2:
                pick = [c for c in left if c["class_id"] in ((2, 3), (0, 1, 4, 5))[i]] or left
            c = min(pick, key=lambda c: (c["image_id"] in images, ("g", c["image_id"], c["gt_id"]) in ids, ("p", c["image_id"], c["pred_id"]) in ids, n.get(("c", c["class_id"]), 0), n.get(("s", c["size_group"]), 0), c["rank"]))
            left.remove(c)
            out.append(c)
            images.add(c["image_id"])
            ids |= {(k, c["image_id"], c[v]) for k, v in (("g", "gt_id"), ("p", "pred_id")) if c[v] is not None}
            for k in (("c", c["class_id"]), ("s", c["size_group"])):
                n[k] = n.get(k, 0) + 1
    return {(c["category"], c["image_id"], c["gt_id"], c["pred_id"]) for c in out}


POOL = "category string, image_id long, gt_id long, pred_id long, class_id long, size_group int, duplicate_like boolean"


@pytest.mark.parametrize("images", [3, 20, 400])
def test_select_cases(spark, images):
    rng, rows = random.Random(images), {}
    for _ in range(3000):
        q = rng.choice(list(selection.QUOTAS))
        image = 0 if rng.random() < 0.5 else rng.randrange(images)  # one image has half of all cases
        gt = None if q == "fp_empty_label" else rng.randrange(30)
        r = (q, image, gt, rng.randrange(30) if rng.random() < 0.9 else None, rng.randrange(6), None if gt is None else gt % 3, q == "fp_annotated" and rng.random() < 0.02)
        rows[r[:4]] = r
    del rows[next(k for k in rows if k[0] == "fp_empty_label")]
    rows = [r for r in rows.values() if r[0] != "localization_failure" or r[1] < 1][:2500]
    df = spark.createDataFrame(rows, POOL)
    cases, counts = selection.select_cases(df, 7)
    want = greedy([r.asDict() for r in df.collect()], selection.QUOTAS, 7)
    assert {(c["category"], c["image_id"], c["gt_id"], c["pred_id"]) for c in cases} == want
    assert sum(c["selected"] + c["shortfall"] for c in counts) == 36 and sum(c["pool"] for c in counts) == len(rows)
    assert [c["case_id"] for c in cases] == [f"S3-{i:02d}" for i in range(1, len(cases) + 1)]


def test_case_pools(spark):
    """One missed, one matched, one wrong-class target, a second find of the matched one, and a find without targets."""
    g = boxes(spark, [(1, 1, 0, 0, 0, 10, 10), (1, 3, 1, 50, 50, 60, 60), (1, 5, 2, 100, 100, 110, 110)])
    p = boxes(spark, [(1, 1, 0, 0, 0, 10, 10, 90), (1, 2, 0, 0, 0, 10, 9, 80), (1, 4, 4, 50, 50, 60, 60, 70), (2, 1, 3, 0, 0, 5, 5, 60)], True)
    got = {tuple(r) for r in matching.cases(p, g, g.withColumn("size_group", F.lit(0))).collect()}
    assert got == {
        ("complete_miss", 1, 5, 1, 2, 0, False),
        ("classification_error", 1, 3, 4, 1, 0, False),
        ("fp_annotated", 1, 1, 2, 0, 0, True),
        ("fp_annotated", 1, 3, 4, 1, 0, False),
        ("fp_empty_label", 2, None, 1, 3, None, False),
        ("wrong_class_geometric_match", 1, 3, 4, 1, 0, False),
        ("successful_detection", 1, 1, 1, 0, 0, False),
    }


def test_review_annotations(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["train", "valid", "test"]), i // 2 if i % 3 else i + 1000, i, i % 4, rng.random(), rng.random(), rng.random(), float(math.floor(rng.random() * 5))) for i in range(200)]
    own = [r for r in rows if r[0] != "test"]
    want = {}
    for name, i, sign in (("lowest_occupancy", 4, 1), ("highest_occupancy", 4, -1), ("smallest_box", 5, 1), ("largest_box", 5, -1), ("closest_to_boundary", 6, 1), ("unusual_image_aspect_ratio", 7, -1)):
        for r in sorted(own, key=lambda r: (sign * r[i], r[:3]))[:10]:
            want.setdefault(r[:3], set()).add(name)
    several = sorted({r[:2] for r in own if sum(x[:2] == r[:2] for x in own) > 1})[:10]
    for r in own:
        if r[:2] in several:
            want.setdefault(r[:3], set()).add("multi_annotation_image")
    for group in {(r[0], r[3]) for r in own}:
        of = [r for r in own if (r[0], r[3]) == group]
        v = sorted(r[4] for r in of)
        mid = (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
        want.setdefault(min(of, key=lambda r: (abs(r[4] - mid), r[:3]))[:3], set()).add("representative_class")
    df = spark.createDataFrame(rows, "split string, image_id long, gt_id long, class_id long, occupancy double, area double, border double, aspect double")
    assert {(r.split, r.image_id, r.gt_id): r.reasons for r in selection.review_annotations(df).collect()} == {k: ",".join(sorted(v)) for k, v in want.items()}


def test_diverse(spark):
    rows = [(1, "a", "h1", "s1", 0, [0.0, 0.0]), (2, "b", "h1", "s2", 255, [9.0, 9.0]), (3, "b", "h3", "s1", 255, [9.0, 9.0]), (4, "b", "h4", "s4", 3, [0.05, 0.05]), (5, "b", "h5", "s5", 255, [0.05, 0.06]), (6, "b", "h6", "s6", 3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, split string, hash string, source string, bits long, vector array<double>")
    assert sampling.diverse(df, {"a": 1, "b": 2}, 7) == [1, 6, 5]
    with pytest.raises(ValueError):
        sampling.diverse(df, {"a": 1, "b": 3}, 7)


@pytest.mark.parametrize("n,hot,width", [(150, 5, 64), (400, 3, 24), (60, 1000, 64), (90, 2, 12)])
def test_near_pairs(spark, monkeypatch, n, hot, width):
    """Planted pairs at 0 to 6 bits, one band that half of the codes share, equal digests; in order and cut short."""
    monkeypatch.setattr(duplicates, "HOT", hot)
    rng = random.Random(n)
    rows = []
    for i in range(n):
        code = rng.getrandbits(width) if not i or rng.random() < 0.4 else rows[rng.randrange(i)][1]
        for k in rng.sample(range(width), rng.randrange(7)):
            code ^= 1 << k
        if i % 2:
            code = code >> (width // 5) << (width // 5) if width != 64 else code & ~0x1FFF
        rows.append((i, code, f"d{rng.randrange(n // 3)}"))
    signed = [(i, c - (1 << 64) if c >> 63 else c, g) for i, c, g in rows]
    want = sorted((a[0], b[0], d) for a in rows for b in rows if a[0] < b[0] and a[2] != b[2] and (d := bin(a[1] ^ b[1]).count("1")) <= 4)
    df = spark.createDataFrame(signed, "id long, bits long, dg string").repartition(3)
    assert sorted(tuple(r) for r in duplicates.near_pairs(df, "id", "bits", "dg", width, 4).collect()) == want
    for most in (1, 10, len(want), len(want) + 5):
        got, more = duplicates.first_near_pairs(df, "id", "bits", "dg", width, 4, most)
        assert [tuple(r) for r in got.orderBy("first_id", "second_id").collect()] == want[:most] and more == (len(want) > most)


@pytest.mark.parametrize("pool", [1, 3, 1000])
def test_sampling_against_a_plain_walk(spark, monkeypatch, pool):
    from fieldglass.operators import sampling as S

    monkeypatch.setattr(S, "POOL", pool)
    rng = random.Random(pool)
    rows = [(i, "ab"[i % 2], f"h{rng.randrange(50)}", f"s{rng.randrange(40)}", rng.randrange(16), [float(rng.randrange(6)) for _ in range(3)], (i * 37) % 101) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, split string, hash string, source string, bits long, vector array<double>, tie long")
    taken = []
    for split, count in {"a": 6, "b": 4}.items():
        for _ in range(count):
            best = []
            for r in rows:
                gaps = [sum(abs(x - y) for x, y in zip(r[5], t[5], strict=True)) / 3 for t in taken]
                if r[1] == split and all(r[0] != t[0] and r[2] != t[2] and r[3] != t[3] and not (bin(r[4] ^ t[4]).count("1") <= 1 and g <= 0.7) for t, g in zip(taken, gaps, strict=True)):
                    best.append((-min(gaps, default=1.0), r[6], r))
            taken.append(min(best)[2])
    assert S.diverse(df, {"a": 6, "b": 4}, 7, 1, 0.7, F.col("tie")) == [t[0] for t in taken]
    own = [min(rows, key=lambda r: r[6])]
    while len(own) < 9:
        own.append(max((r for r in rows if r not in own), key=lambda r: (min(sum(abs(x - y) for x, y in zip(r[5], t[5], strict=True)) for t in own), -r[6])))
    assert S.farthest_first(df, "id", "vector", 9, 1, F.col("tie")) == [r[0] for r in own]
    assert len(S.farthest_first(df, "id", "vector", 900, 1)) == 70 and S.farthest_first(df.where("false"), "id", "vector", 3, 1) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_reached_from_boxes_and_pairs(spark, seed):
    """Crowded images: more predictions than are kept, ties of overlap, targets that several want."""
    rng = random.Random(seed)
    preds = [(i // 40, i % 40, rng.randrange(2), x := 10 * rng.randrange(3), 0, x + 10, 10 + rng.randrange(2), rng.randrange(100)) for i in range(200)]
    gts = [(i // 8, i % 8, rng.randrange(2), x := 10 * rng.randrange(3), 0, x + 10, 10) for i in range(40)]
    p, g = boxes(spark, preds, True), boxes(spark, gts)
    key = lambda d: sorted((r.image_id, r.pred_id, r.class_id, r.conf, r.reach) for r in d.collect())
    a = key(precision.reached(p, g, 5, 25))
    assert a == key(precision.reached_by_pairs(matching.overlaps(p, g), p, 5, 25)) and 0 < sum(r[4] > 0 for r in a) <= len(gts) and len(a) == 125


def test_a_filter_on_valid_lines_parses_them_once(spark):
    """Spark pushes the filter below the parsed columns: it must not name the steps of the parsing many times over."""
    rows = spark.createDataFrame([("f", "0 0.1 0.2 0.3 0.2 0.1 0.5\n1 0.5 0.5 0.2 0.2")], "file string, text string")
    plan = labels.parse(labels.lines(rows), [0, 1]).where("valid").groupBy("file").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(trim(") <= 2
