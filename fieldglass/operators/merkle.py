"""Merkle trees of datasets: digests of folders from the bottom up, and differences that pass over equal folders.

A folder's digest is that of its entries.  Entries are first gathered into
at most ``FAN`` buckets by the first digits of their name's SHA-256, so that no line of
digests grows beyond a FAN-th of a folder; a folder's digest is that of its
buckets in order.  The rule depends on names alone: equal folders have equal digests
however the rows are laid out.

Nodes are written by depth and by a slot of their parent's name.  A
difference goes down level by level and reads only slots that hold children of
folders that differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.contracts import ContractError
from fieldglass.plans import scratch

#: Hexadecimal digits of a bucket: 4096 buckets a folder.
DIGITS = 3
#: Slots that the nodes of a level are written to.
SLOTS = 64

_NODE = ["path", "parent", "depth", "folder", "digest", "files", "bytes", "empties"]


def _named(path):
    """Columns of a node from its path; the root is ''."""
    parts = F.split(path, "/")
    parent = F.when(F.instr(path, "/") > 0, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).when(path != "", F.lit(""))
    return parent.alias("parent"), F.when(path == "", 0).otherwise(F.size(parts)).alias("depth")


def nodes(files: DataFrame, label: str = "merkle") -> DataFrame:
    """Every file and folder of a tree: path, parent, depth, folder, digest, files, bytes, empties (files without bytes).

    files: path (relative, '/' between names), digest, size_bytes.  An empty
    table is a root without entries.  The result is written.
    """
    with scratch.passing(files.sparkSession):
        path = F.col("path")
        leaves = files.select(path, *_named(path), F.lit(False).alias("folder"), F.col("digest"), F.lit(1).cast("long").alias("files"), F.col("size_bytes").cast("long").alias("bytes"), (F.col("size_bytes") == 0).cast("long").alias("empties"))
        leaves = scratch.stage(leaves, f"{label}-leaves")
        deepest = leaves.agg(F.max("depth")).first()[0] or 0
        levels = []
        below = None
        for depth in range(deepest, 0, -1):
            own = leaves.where(F.col("depth") == depth)
            own = own if below is None else own.unionByName(below)
            levels.append(own)
            name = F.element_at(F.split("path", "/"), -1)
            line = F.concat_ws("\t", name, F.when(F.col("folder"), "d").otherwise("f"), "digest")
            buckets = own.groupBy("parent", F.substring(F.sha2(name, 256), 1, DIGITS).alias("bucket")).agg(
                F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("of"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sum("empties").alias("empties")
            )
            folded = buckets.groupBy("parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "of"))), lambda b: F.concat(b["bucket"], b["of"])), "\n").alias("lines"), *[F.sum(c).alias(c) for c in ("files", "bytes", "empties")])
            path = F.col("path")
            below = scratch.stage(folded.select(F.col("parent").alias("path"), F.sha2("lines", 256).alias("digest"), "files", "bytes", "empties").select(path, *_named(path), F.lit(True).alias("folder"), "digest", "files", "bytes", "empties"), f"{label}-level")
        root = below
        if root is None:
            root = files.sparkSession.createDataFrame([("", None, 0, True, None, 0, 0, 0)], "path string, parent string, depth int, folder boolean, digest string, files long, bytes long, empties long").withColumn("digest", F.sha2(F.lit(""), 256))
        every = root
        for level in levels:
            every = every.unionByName(level)
        slot = F.pmod(F.xxhash64("parent"), F.lit(SLOTS)).cast("int")
        return scratch.stage(every.select(*_NODE, slot.alias("slot")), label, by=["depth", "slot"], lasting=True)


def root(tree: DataFrame) -> str:
    """The tree's digest."""
    return tree.where("depth = 0").first()["digest"]


def difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """path, folder, change (added, removed, changed), and either side's digest: of files that differ and folders that one side lacks, with all below them.

    Two trees as from ``nodes``.  Equal folders are not entered.
    """
    spark = first.sparkSession
    out, depth = None, 0
    todo = None
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    while True:
        sides = []
        slots = [r["slot"] for r in todo.select(F.pmod(F.xxhash64("path"), F.lit(SLOTS)).cast("int").alias("slot")).distinct().collect()] if todo is not None else None  # SLOTS numbers at most
        if slots == []:
            break
        for tree in (first, second):
            own = tree.where(F.col("depth") == depth)
            if slots is not None:
                own = own.where(F.col("slot").isin(slots)).join(todo.select(F.col("path").alias("parent")), "parent", "left_semi")
            sides.append(own.select("path", "folder", "digest"))
        j = sides[0].withColumnRenamed("digest", "a").join(sides[1].withColumnRenamed("digest", "b"), ["path", "folder"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        level = scratch.stage(j, "merkle-differs")
        own = level.where(~F.col("folder") | F.col("a").isNull() | F.col("b").isNull()).select("path", "folder", kind.alias("change"), F.col("a").alias("first_digest"), F.col("b").alias("second_digest"))
        out = own if out is None else out.unionByName(own)
        todo, depth = level.where("folder"), depth + 1
    return out if out is not None else spark.createDataFrame([], "path string, folder boolean, change string, first_digest string, second_digest string")


def reproduction(first: DataFrame, second: DataFrame, labels: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row that tells whether a dataset was reproduced: digests, files compared, mismatches by kind.

    Trees as from ``nodes`` over paths SPLIT/KIND/NAME; labels: each side's
    annotations (class_id).  A split's folder of images or labels whose names
    differ counts once and its files are not compared.
    """
    changes = scratch.stage(difference(first, second), "merkle-changes")
    part = F.split("path", "/")
    held = lambda t: t.where("not folder and depth = 3").select(F.get(F.split("path", "/"), F.lit(0)).alias("split"), F.get(F.split("path", "/"), F.lit(1)).alias("kind"), "path", "bytes")
    folder = [F.get(part, F.lit(0)).alias("split"), F.get(part, F.lit(1)).alias("kind")]
    uneven = changes.where("not folder and change <> 'changed'").select(*folder).distinct()
    files = held(first).join(uneven, ["split", "kind"], "left_anti").groupBy("kind").agg(F.count("*").alias("n"))
    compared = files.agg(F.coalesce(F.sum(F.when(F.col("kind") == "labels", F.col("n"))), F.lit(0)).alias("label_files_compared"), F.coalesce(F.sum(F.when(F.col("kind") == "images", F.col("n"))), F.lit(0)).alias("image_files_compared"))
    changed = changes.where("not folder and change = 'changed'").select("path", *folder).join(uneven, ["split", "kind"], "left_anti")
    sizes = [held(t).select("path", F.col("bytes").alias(n)) for t, n in ((first, "x"), (second, "y"))]
    told = changed.join(sizes[0], "path").join(sizes[1], "path").agg(
        F.count_if(F.col("kind") == "labels").alias("label_hash_mismatches"),
        F.count_if(F.col("kind") == "images").alias("image_hash_mismatches"),
        F.count_if((F.col("kind") == "labels") & ((F.col("x") == 0) != (F.col("y") == 0))).alias("empty_label_mismatches"),
    )
    j = compared.crossJoin(told).crossJoin(uneven.agg(F.count("*").alias("missing_or_extra_folders")))
    equal = F.lit(True)
    if labels is not None:
        n = [x.groupBy("class_id").agg(F.count("*").alias(c)) for x, c in zip(labels, ("x", "y"), strict=True)]
        both = n[0].join(n[1], "class_id", "full_outer").na.fill(0, ["x", "y"]).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("first_annotations"), F.coalesce(F.sum("y"), F.lit(0)).alias("second_annotations"), F.coalesce(F.bool_and(F.col("x") == F.col("y")), F.lit(True)).alias("class_counts_identical"))
        j, equal = j.crossJoin(both), F.col("class_counts_identical")
    j = j.withColumn("fingerprints_identical", F.lit(root(first) == root(second)))
    clean = (F.col("label_hash_mismatches") == 0) & (F.col("image_hash_mismatches") == 0) & (F.col("empty_label_mismatches") == 0) & (F.col("missing_or_extra_folders") == 0)
    return j.withColumn("success", clean & F.col("fingerprints_identical") & equal)


def rebuilt(build: Callable[[], DataFrame], approved: str) -> str:
    """Build a tree's files once more and give its digest, which must be the approved one."""
    told = root(nodes(build(), "rebuilt"))
    if told != approved:
        raise ContractError(f"the rebuilt tree has the digest {told}, not {approved}")
    return told
