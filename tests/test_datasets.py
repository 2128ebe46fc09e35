"""Dataset trees as a source and a sink, header probes, comparison of sides, Merkle trees; and the queries over them."""

import hashlib
import io
import os
import random
import shutil
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import merkle, sides
from fieldglass.operators.contracts import ContractError
from fieldglass.plans import scratch
from fieldglass.sinks import file_tree
from fieldglass.sources import dataset_source as D
from fieldglass.sources import probe


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def tiff(turned, order="<", kind=3):
    mark, value = (b"II", struct.pack("<HH", turned, 0)) if order == "<" else (b"MM", struct.pack(">HH", turned, 0))
    if kind == 4:
        value = struct.pack(f"{order}I", turned)
    return mark + struct.pack(f"{order}HIH", 42, 8, 2) + struct.pack(f"{order}HHI", 271, 2, 1) + b"x\0\0\0" + struct.pack(f"{order}HHI", 274, kind, 1) + value + bytes(4)


def png(w, h, exif=None):
    return probe.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + (chunk(b"tEXt", b"a" * 300) + chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", zlib.compress(b"\0")) + chunk(b"IEND", b"")


def jpeg(w, h, exif=None, frame=0xC0):
    seg = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0" + bytes(9)) + (seg(0xE1, b"Exif\0\0" + exif) if exif else b"") + b"\xff" + seg(0xDB, bytes(65))
    return out + seg(frame, struct.pack(">BHHB", 8, h, w, 1) + bytes(3)) + seg(0xDA, bytes(6)) + b"\0" * 50 + b"\xff\xd9"


@pytest.mark.parametrize(
    "body,want",
    [
        (png(640, 480), ("png", 640, 480, 1, None)),
        (png(7, 9, tiff(6)), ("png", 7, 9, 6, "rotated_image")),
        (png(7, 9, tiff(1, ">")), ("png", 7, 9, 1, None)),
        (jpeg(1000, 2000), ("jpeg", 1000, 2000, 1, None)),
        (jpeg(10, 20, tiff(3, ">"), 0xC2), ("jpeg", 10, 20, 3, "rotated_image")),
        (jpeg(10, 20, tiff(8, "<", 4)), ("jpeg", 10, 20, 8, "rotated_image")),
        (jpeg(10, 20, b"II"), ("jpeg", 10, 20, 1, None)),
        (b"", (None, None, None, 1, "unreadable_image")),
        (b"GIF89a", (None, None, None, 1, "unreadable_image")),
        (png(5, 5)[:12], ("png", None, None, 1, "unreadable_image")),
        (jpeg(5, 5)[:30], ("jpeg", None, None, 1, "unreadable_image")),
        (png(0, 5), ("png", 0, 5, 1, "unreadable_image")),
    ],
)
def test_probe(body, want):
    h = probe.header(io.BytesIO(body))
    assert (h.format, h.width, h.height, h.orientation, h.issue) == want


@pytest.mark.parametrize("kind", ["png", "jpeg"])
def test_probe_reads_little_of_a_large_file(tmp_path, kind):
    path = tmp_path / "large"
    body = png(9, 8, tiff(1)) if kind == "png" else jpeg(9, 8, tiff(1))
    with open(path, "wb") as out:
        out.write(body)
        out.truncate(1 << 30)  # sparse
    read = []

    class Counting(io.FileIO):
        def read(self, n=-1):
            got = super().read(n)
            read.append(len(got))
            return got

    h = probe.header(Counting(path))
    assert (h.width, h.height, h.orientation) == (9, 8, 1) and sum(read) < 64 << 10


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "set"
    for split in ("train", "valid"):
        for kind in ("images", "labels"):
            os.makedirs(root / split / kind)
        for i in range(7):
            (root / split / "images" / f"Im{i}.PNG").write_bytes(png(100 + i, 50))
            (root / split / "labels" / f"im{i}.txt").write_text("" if i == 3 else f"{i % 6} 0.5 0.5 0.2 0.1\n1 0.1 0.1 0.3 0.1 0.3 0.4\n")
    (root / "test").write_text("a file where a folder should be: whoever lists it fails")
    return str(root)


def test_source_prunes_splits(spark, tree):
    rows = D.scan(spark, tree).where("split = 'train'")
    got = {r.stem: r for r in rows.collect()}
    assert len(got) == 7 and got["im2"].width == 102 and got["im2"].status == "paired" and got["im3"].text == "" and got["im2"].content is None
    with open(f"{tree}/train/images/Im2.PNG", "rb") as f:
        body = f.read()
    assert got["im2"].image_sha256 == hashlib.sha256(body).hexdigest() and got["im2"].image_bytes == len(body)
    assert D.scan(spark, tree).where(F.col("split").isin("train", "valid") & (F.col("width") > 104)).count() == 4
    assert D.scan(spark, tree, files="2", splits=("valid",)).rdd.getNumPartitions() == 4
    # without the filter the held-out split is listed
    with pytest.raises(Exception, match="test"):
        D.scan(spark, tree).count()


def test_source_refuses_splits_before_reading(spark, tree):
    allowed = ("train", "valid")
    assert D.scan(spark, tree, allowed=allowed).count() == 14
    for bad in (lambda: D.scan(spark, tree, ("test",), allowed), lambda: D.scan(spark, tree, allowed=allowed).where("split = 'test'")):
        with pytest.raises(Exception, match="split test may not be read"):
            bad().collect()
    with pytest.raises(Exception, match="folder"):
        spark.read.format(D.NAME).load().collect()


def test_source_issues(spark, tree):
    os.remove(f"{tree}/train/labels/im0.txt")
    os.remove(f"{tree}/train/images/Im1.PNG")
    shutil.copy(f"{tree}/train/images/Im2.PNG", f"{tree}/train/images/IM2.png")
    with open(f"{tree}/train/images/Im4.PNG", "wb") as f:
        f.write(jpeg(5, 6, tiff(6)))
    with open(f"{tree}/train/labels/im5.txt", "w") as f:
        f.write("9 0.5 0.5 0.2 0.1\nx\n")
    rows = D.scan(spark, tree, ("train",))
    lines = D.annotations(rows, list(range(6)), "box")
    got = sorted((r.stem, r.line_number, r.code) for r in D.issues(rows, lines).collect())
    assert got == [("im0", 0, "image_only"), ("im1", 0, "label_only"), ("im1", 2, "unexpected_annotation_type"), ("im2", 0, "ambiguous"), ("im2", 2, "unexpected_annotation_type"), ("im4", 0, "rotated_image"), ("im4", 2, "unexpected_annotation_type"), ("im5", 1, "unexpected_class_id"), ("im5", 2, "incorrect_value_count"), ("im6", 2, "unexpected_annotation_type")]
    assert [r.stem for r in D.empty_labels(rows).collect()] == ["im3"]


def test_samples(spark, tree):
    rows = D.scan(spark, tree, ("valid",))
    got = {r.sample_id: r for r in D.samples(rows, D.annotations(rows, list(range(6)))).collect()}
    assert len(got) == 7 and got["valid/im3"].ground_truth == []
    first, second = got["valid/im0"].ground_truth
    assert (first.box_id, first.class_id, first.xyxy) == ("gt/000001", 0, [40.0, 22.5, 60.0, 27.5]) and second.box_id == "gt/000002"


def test_convert(spark, tree, tmp_path):
    target = str(tmp_path / "made")
    splits = ("train", "valid")
    images, rows = file_tree.convert(spark, tree, target, list(range(6)), splits)
    told = images.collect()
    assert len(told) == 14 and all(r.sha256_equal for r in told)
    with open(f"{target}/train/labels/Im1.txt") as f:
        assert f.read() == "1 0.5000000000 0.5000000000 0.2000000000 0.1000000000\n1 0.2000000000 0.2500000000 0.2000000000 0.3000000000\n"
    assert os.path.getsize(f"{target}/valid/labels/Im3.txt") == 0
    back = D.scan(spark, target, splits)
    lines = D.annotations(back, list(range(6)), "box")
    assert D.issues(back, lines).count() == 0 and file_tree.lost(rows, file_tree.conversion_rows(lines)).count() == 0
    with open(f"{target}/train/labels/Im1.txt", "a") as f:
        f.write("0 0.5 0.5 0.1 0.1\n")
    again = D.annotations(D.scan(spark, target, splits), list(range(6)), "box")
    assert [(r.stem, r.line_number) for r in file_tree.lost(rows, file_tree.conversion_rows(again)).collect()] == [("im1", 3)]
    with pytest.raises(ContractError, match="exists|before"):
        try:
            file_tree.convert(spark, tree, target, list(range(6)), splits)
        except ContractError:
            raise
        except Exception as e:  # the writer's error comes through Spark
            raise ContractError(str(e)[:4000]) from None
    with open(f"{tree}/train/labels/im2.txt", "w") as f:
        f.write("7 0.5 0.5 0.2 0.1\n")
    with pytest.raises(ContractError, match="unexpected_class_id"):
        file_tree.convert(spark, tree, str(tmp_path / "other"), list(range(6)), splits)
    assert not os.path.exists(tmp_path / "other")


def test_failed_write_leaves_nothing(spark, tmp_path):
    target = str(tmp_path / "out")
    good = spark.createDataFrame([(f"a/{i}.txt", b"x" * i) for i in range(20)], "path string, content binary").repartition(4)
    told = {r.relative_path: (r.size_bytes, r.sha256) for r in file_tree.write(good, target).collect()}
    assert told == {f"a/{i}.txt": (i, hashlib.sha256(b"x" * i).hexdigest()) for i in range(20)}
    bad = good.withColumn("content", F.when(F.col("path") == "a/7.txt", F.raise_error(F.lit("no such luck")).cast("binary")).otherwise(F.col("content")))
    for rows, match in ((bad, "no such luck"), (good.unionByName(spark.createDataFrame([("../b", b"")], "path string, content binary")), "no file below"), (good.unionByName(spark.createDataFrame([("/b", b"")], "path string, content binary")), "no file below")):
        with pytest.raises(Exception, match=match):
            file_tree.write(rows, target, overwrite=True)
        assert sorted(os.listdir(tmp_path)) == ["out"] and len(os.listdir(f"{target}/a")) == 20
    with pytest.raises(ContractError, match="occurs 2 times"):
        file_tree.write(good.unionByName(good.limit(1)), target, overwrite=True)
    with pytest.raises(Exception, match="exists"):
        file_tree.write(good, target)
    assert file_tree.write(good.where("path = 'a/3.txt'"), target, overwrite=True).count() == 1 and sorted(os.listdir(f"{target}/a")) == ["3.txt"]
    assert sorted(os.listdir(tmp_path)) == ["out"]


def test_cluster_without_shared_folder_is_refused(spark, tmp_path):
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, usual=None):
                return {"spark.checkpoint.dir": "file:///shared/check"}.get(key, usual)

    with pytest.raises(ContractError, match="share none"):
        file_tree.shared(Session(), str(tmp_path))
    file_tree.shared(Session(), "/shared/check/below")
    file_tree.shared(Session(), "s3://bucket/x")


def test_snapshot_and_review_set(spark, tree, tmp_path):
    whole = D.scan(spark, tree, ("train", "valid"), content="true")
    expected = whole.select(F.concat_ws("/", "split", F.lit("images"), F.element_at(F.split("image", "/"), -1)).alias("relative_path"), F.col("image_sha256").alias("sha256")).unionByName(
        whole.select(F.concat_ws("/", "split", F.lit("labels"), F.element_at(F.split("label", "/"), -1)).alias("relative_path"), F.col("label_sha256").alias("sha256"))
    )
    scratch_expected = scratch.stage(expected, "expected")
    done = file_tree.snapshot(spark, tree, "valid", scratch_expected, str(tmp_path / "snap"))
    assert done.count() == 14 and os.listdir(tmp_path / "snap") and not os.path.exists(tmp_path / "snap" / "train")
    with open(f"{tree}/valid/labels/im0.txt", "a") as f:
        f.write(" ")
    with pytest.raises(ContractError, match="im0.txt differs"):
        file_tree.snapshot(spark, tree, "valid", scratch_expected, str(tmp_path / "snap2"))
    assert not os.path.exists(tmp_path / "snap2")
    chosen = spark.createDataFrame([(1, "valid", "im3"), (2, "train", "im3")], "place int, split string, stem string")
    index = sorted(tuple(r) for r in file_tree.review_set(spark, chosen, tree, str(tmp_path / "review"), 42).select("review_image", "split", "original_name", "width", "selection_seed").collect())
    assert index == [("empty_01.png", "valid", "Im3.PNG", 103, 42), ("empty_02.png", "train", "Im3.PNG", 103, 42)]
    assert open(tmp_path / "review" / "empty_01.png", "rb").read() == open(f"{tree}/valid/images/Im3.PNG", "rb").read()


def test_sides_against_plain_python(spark):
    rng = random.Random(3)
    tables = {s: [(rng.randrange(30), rng.choice([1, 1, 1, 2, None]), rng.choice(["a", "a", "b"])) for _ in range(25)] for s in ("p", "q", "r")}
    same = {"x": ["p", "q"], "y": ["p", "q", "r"]}
    got = {r.k: (r.present, r.problems) for r in sides.compare({s: spark.createDataFrame(t, "k long, x int, y string") for s, t in tables.items()}, ["k"], same).collect()}
    want = {}
    for k in {k for t in tables.values() for k, _, _ in t}:
        n = {s: [r for r in t if r[0] == k] for s, t in tables.items()}
        codes = [f"missing:{s}" for s in n if not n[s]] + [f"repeated:{s}" for s in n if len(n[s]) > 1]
        for i, v in ((1, "x"), (2, "y")):
            if len({r[i] for s in same[v] for r in n[s]}) > 1:
                codes.append(f"differs:{v}")
        want[k] = (sum(1 << i for i, s in enumerate(n) if n[s]), sorted(codes))
    assert got == want


def test_sides_cost_one_exchange(spark):
    t = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("x"))
    plan = sides.compare({s: t for s in "abcd"}, ["k"], {"x": list("abcd")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    with pytest.raises(ContractError):
        sides.compare({"a": t}, ["k"], {})
    with pytest.raises(ContractError, match="no side is called z"):
        sides.compare({"a": t, "b": t}, ["k"], {"x": ["z"]})
    sides.require_identical(sides.compare({"a": t, "b": t}, ["k"], {"x": ["a", "b"]}), "same")
    with pytest.raises(ContractError, match="missing:b"):
        sides.require_identical(sides.compare({"a": t, "b": t.where("k > 3")}, ["k"], {"x": ["a", "b"]}), "less")
    empty = sides.shared_values({"a": t, "b": t.where("false").withColumn("x", F.lit(None).cast("int"))}, ["x"]).first()
    assert (empty["values"], empty["shared"]) == (1, 0)


def test_lineage(spark):
    rows = [("train", f"s{i}", f"h{i}", f"l{i}") for i in range(4)] + [("valid", "v", "h", "l")]
    kind = "split string, stem string, image_sha256 string, label_sha256 string"
    manifest = spark.createDataFrame(rows, kind)
    samples = spark.createDataFrame([("train", "s0", "h0", "l0"), ("train", "s1", "other", "l1"), ("train", "s9", "h", "l")], kind)
    got = {r.stem: r.problems for r in sides.lineage(manifest, samples, "train").collect()}
    assert got == {"s0": [], "s1": ["differs:image_sha256"], "s2": ["missing:samples"], "s3": ["missing:samples"], "s9": ["missing:manifest"]}


def files(spark, rows):
    return spark.createDataFrame([(p, hashlib.sha256(b.encode()).hexdigest(), len(b)) for p, b in rows.items()], "path string, digest string, size_bytes long")


def test_merkle(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIGITS", 1)
    rng = random.Random(8)
    first = {f"{rng.choice('abc')}/{rng.choice('xyz')}/f{i}": str(rng.random()) for i in range(120)} | {"top": "1", "deep/er/and/deeper": ""}
    second = dict(first)
    for p in list(first)[:7]:
        del second[p]
    for p in list(second)[20:25]:
        second[p] += "!"
    second |= {"new/folder/file": "z", "a/x/another": "q"}
    del second["deep/er/and/deeper"]
    a, b, c = (merkle.nodes(files(spark, t)) for t in (first, second, dict(reversed(first.items()))))
    assert merkle.root(a) == merkle.root(c) != merkle.root(b) and merkle.difference(a, c).count() == 0

    def folders(t):
        return {"/".join(p.split("/")[:i]) for p in t for i in range(1, p.count("/") + 1)}

    want = {(p, False, "added" if p not in first else "removed" if p not in second else "changed") for p in first.keys() | second.keys() if first.get(p) != second.get(p)}
    want |= {(p, True, "added" if p not in folders(first) else "removed") for p in folders(first) ^ folders(second)}
    got = merkle.difference(a, b).collect()
    assert {(r.path, r.folder, r.change) for r in got} == want and len(got) == len(want)
    whole = a.where("depth = 0").first()
    assert (whole.files, whole.bytes, whole.empties) == (len(first), sum(map(len, first.values())), 1)
    assert merkle.rebuilt(lambda: files(spark, first), merkle.root(a))
    with pytest.raises(ContractError, match="digest"):
        merkle.rebuilt(lambda: files(spark, second), merkle.root(a))


def test_merkle_edges(spark):
    none, one = merkle.nodes(files(spark, {"x": "1"}).where("false")), merkle.nodes(files(spark, {"x": "1"}))
    assert merkle.root(none) != merkle.root(one) and merkle.difference(none, none).count() == 0
    assert [tuple(r)[:3] for r in merkle.difference(none, one).collect()] == [("x", False, "added")]


def test_merkle_reads_differing_folders_only(spark):
    """The slots of equal folders are unreadable, and the difference is found all the same."""
    first = {f"d{i}/f{j}": "x" for i in range(40) for j in range(3)}
    a, b = merkle.nodes(files(spark, first)), merkle.nodes(files(spark, first | {"d7/f1": "y"}))
    slot = spark.range(1).select(F.pmod(F.xxhash64(F.lit("d7")), F.lit(merkle.SLOTS)).cast("int")).first()[0]
    for t in (a, b):
        for path in t.inputFiles():
            if "/depth=2/" in path and f"/slot={slot}/" not in path:
                with open(path.removeprefix("file://"), "wb") as f:
                    f.write(b"not parquet")
    assert [(r.path, r.change) for r in merkle.difference(a, b).collect()] == [("d7/f1", "changed")]


def test_reproduction(spark):
    base = {f"{s}/{k}/{i}": ("" if k == "labels" and i % 4 == 0 else f"{s}{k}{i}") for s in ("train", "valid") for k in ("images", "labels") for i in range(8)}
    other = base | {"train/images/1": "x", "train/labels/4": "no longer empty", "train/labels/5": "changed"}
    del other["valid/labels/3"]
    ann = lambda *c: spark.createDataFrame([(x,) for x in c], "class_id int")
    a, b = merkle.nodes(files(spark, base)), merkle.nodes(files(spark, other))
    r = merkle.reproduction(a, b, (ann(0, 1, 1), ann(0, 1, 2))).first()
    assert Counter(r.asDict()) == Counter({"label_files_compared": 8, "image_files_compared": 16, "label_hash_mismatches": 2, "image_hash_mismatches": 1, "empty_label_mismatches": 1, "missing_or_extra_folders": 1, "first_annotations": 3, "second_annotations": 3, "class_counts_identical": False, "fingerprints_identical": False, "success": False})
    assert merkle.reproduction(a, a, (ann(0), ann(0))).first().success


def test_convert_reads_the_tree_twice(spark, tree, tmp_path, monkeypatch):
    """What is written reads the source for the images' bytes alone, and its paths are known without; the rest reads written tables."""
    told = []
    whole = file_tree.write
    monkeypatch.setattr(file_tree, "write", lambda files, root, overwrite=False, paths=None: (told.append((files, paths)), whole(files, root, overwrite, paths))[1])
    _, converted = file_tree.convert(spark, tree, str(tmp_path / "out"), list(range(6)), ("train", "valid"))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("annotated_images")
    (files, paths), = told
    assert (scans(files), scans(paths), scans(converted)) == (1, 0, 0)
