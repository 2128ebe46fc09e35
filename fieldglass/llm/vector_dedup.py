"""Near duplicates among vectors by an exact metric range join.

Equal vectors of a label collapse into one class first, so a group of copies
of any size is one row of the join.  A label of few vectors is one cell.  For
a label of many, pivots sampled from it partition the unit sphere, as many as
its vectors need: a class lives in the cell of its nearest pivot.  For the angular metric and
range r, a class x can have a partner in the cell of pivot j only if
d(x, p_j) - d(x, p_home) <= 2 r and d(x, p_j) <= radius_j + r (triangle
inequality), and only to those cells it is replicated.  Cells, split into
chunks of bounded size, then join independently: blocks of dot products in
double precision.  Each chunk reports the number of links of its own classes
and a spanning forest of the links it found; the forests' components are the
result's.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label, link with nothing; vectors of different
lengths are not compared; a null identifier is no component's name unless the
component has no other; rows equal in all columns link with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm import _bytes as B
from fieldglass.llm._shared import heavy, mapped, partitions, split_join, stage
from fieldglass.operators.graph import components

#: Vectors a pivot stands for at least; classes of a cell joined at once.
PER_PIVOT, CHUNK = 8192, 4096
#: Bytes of all pivots at most: with more vectors, a pivot stands for more of
#: them, and their cells are cut into more chunks.
PIVOT_BYTES = 32 << 20


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _groups(batch: pa.RecordBatch, pivots: dict[tuple[str, int], np.ndarray]):
    """(label and length, pivots or None, rows) for parts of a batch."""
    keys = list(zip(batch.column("label").to_pylist(), batch.column("vec").value_lengths().to_pylist(), strict=True))
    for key in sorted(set(keys) & pivots.keys()):
        yield key, pivots[key], batch.filter(pa.array([k == key for k in keys]))
    rest = [k not in pivots for k in keys]
    if any(rest):
        yield None, None, batch.filter(pa.array(rest))


_CELL = "cls long, label string, n long, vec array<double>, dim int"


def _homes(pivots: dict[tuple[str, int], np.ndarray]):
    def work(batches):
        for whole in batches:
            for _, p, b in _groups(whole, pivots):
                home, far = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
                if p is not None:
                    a = _angles(_unit(_vectors(b.column("vec"))), p)
                    home = a.argmin(axis=1)
                    far = a[np.arange(len(a)), home]
                dim = b.column("vec").value_lengths().cast(pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("label"), b.column("n"), b.column("vec"), dim, pa.array(home.astype(np.int32)), pa.array(far)], ["cls", "label", "n", "vec", "dim", "home", "far"])

    return work


def _replicas(pivots: dict[tuple[str, int], np.ndarray], radius: dict[tuple[str, int, int], float], reach: float):
    slack = 1e-7

    def work(batches):
        for whole in batches:
            for key, p, b in _groups(whole, pivots):
                row, cell = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
                if p is not None:
                    a = _angles(_unit(_vectors(b.column("vec"))), p)
                    own = a.min(axis=1, keepdims=True)
                    r = np.array([radius.get((*key, j), -10.0) for j in range(len(p))])
                    row, cell = np.nonzero((a - own <= 2 * reach + slack) & (a <= r + reach + slack))
                t = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([t.column("cls"), t.column("label"), t.column("n"), t.column("vec"), t.column("dim"), pa.array(cell.astype(np.int32))], ["cls", "label", "n", "vec", "dim", "cell"])

    return work


def _pivots(classes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """(label, length) -> pivots, for labels of many vectors; all in PIVOT_BYTES at most."""
    dim = F.size("vec")
    total = classes.agg(F.count("*").alias("n"), F.max(dim).alias("d")).first()
    most = max(1, PIVOT_BYTES // (8 * (total["d"] or 1)))
    per = max(PER_PIVOT, -(-total["n"] // most))
    many = classes.groupBy("label", dim.alias("dim")).agg(F.count("*").alias("m")).where(F.col("m") >= 2 * per).withColumn("k", F.floor(F.col("m") / per))
    # a label has m >= 2 * per vectors, so these are at most most / 2 rows, and twice the pivots about 2 * most
    lucky = F.pmod(F.xxhash64("vec"), F.lit(1 << 40)) / float(1 << 40)
    some = classes.withColumn("dim", dim).join(F.broadcast(many), ["label", "dim"]).where(lucky < (2 * F.col("k") + 16) / F.col("m"))
    out: dict[tuple[str, int], list] = {}
    for r in sorted(some.select("label", "dim", "k", "cls", "vec").collect(), key=lambda r: (r["label"], r["dim"], r["cls"])):
        own = out.setdefault((r["label"], r["dim"]), [])
        if len(own) < r["k"]:
            own.append(r["vec"])
    return {key: _unit(np.array(own, np.float64)) for key, own in out.items()}


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _join_cells(least: float):
    """Rows sorted by (part, build last): a chunk's own classes, then all that may be near."""

    def finish(own, links):
        cls = np.concatenate([c for c, _ in own])
        return pa.RecordBatch.from_arrays([pa.array(cls), pa.nulls(len(cls), pa.int64()), pa.array(links)], ["cls", "other", "links"])

    def work(batches):
        part, own, vecs, links, forest = None, [], None, None, _Forest()
        for batch in batches:
            parts = batch.column("part").to_numpy()
            probe = batch.column("probe").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(probe.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if parts[lo] != part:
                    if own and links is not None:
                        yield finish(own, links)
                    part, own, vecs, links, forest = parts[lo], [], None, None, _Forest()
                b = batch.slice(lo, hi - lo)
                cls, x = b.column("cls").to_numpy(), _unit(_vectors(b.column("vec")))
                if not probe[lo]:
                    own.append((cls, x))
                    continue
                if vecs is None:
                    if not own:
                        continue
                    vecs = np.concatenate([v for _, v in own])
                    names = np.concatenate([c for c, _ in own])
                    links = np.zeros(len(vecs), np.int64)
                weight = b.column("n").to_numpy()
                for at in range(0, len(x), 1024):
                    near = x[at : at + 1024] @ vecs.T >= least
                    i, j = np.nonzero(near)
                    other = cls[at + i] != names[j]
                    i, j = i[other], j[other]
                    np.add.at(links, j, weight[at + i])
                    kept = [(c, o) for c, o in zip(cls[at + i].tolist(), names[j].tolist(), strict=True) if forest.join(c, o)]
                    if kept:
                        c, o = (np.array(z, np.int64) for z in zip(*kept, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(o), pa.array(np.zeros(len(c), np.int64))], ["cls", "other", "links"])
        if own and links is not None:
            yield finish(own, links)

    return work


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    v = F.col("vec")
    x = F.col(f"`{vec_col}`").cast("array<double>")
    rows = stage(vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), x.alias("vec")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda c: c != 0)
    good = rows.where(usable)
    # one class for each (label, vector)
    classes = stage(good.groupBy("label", "vec").agg(F.min("row").alias("cls"), F.count("*").alias("n"), F.min("vec_id").alias("top")), "classes")
    pivots = _pivots(classes)
    reach = math.acos(threshold)
    homes = stage(mapped(classes.select("cls", "label", "n", "vec"), _homes(pivots), f"{_CELL}, home int, far double"), "homes")
    radius = {}
    if pivots:
        wide = F.broadcast(spark.createDataFrame(sorted(pivots), "label string, dim int"))
        radius = {(r["label"], r["dim"], r["home"]): r["r"] for r in homes.join(wide, ["label", "dim"]).groupBy("label", "dim", "home").agg(F.max("far").alias("r")).collect()}
    # chunks of the classes at home in a cell, and the replicas that probe them
    per_cell = homes.groupBy("label", "dim", F.col("home").alias("cell")).agg(F.count("*").alias("m")).withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int"))
    mine = homes.withColumnRenamed("home", "cell").join(per_cell, ["label", "dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")).withColumn("probe", F.lit(False))
    spread = mapped(homes, _replicas(pivots, radius, reach), f"{_CELL}, cell int")
    probes = spread.join(per_cell, ["label", "dim", "cell"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("probe", F.lit(True))
    cols = [F.xxhash64("label", "dim", "cell", "chunk").alias("part"), "probe", "cls", "n", "vec"]
    found = stage(
        mapped(mine.select(*cols).unionByName(probes.select(*cols)).repartition(partitions(spark), "part").sortWithinPartitions("part", "probe", "cls"), _join_cells(threshold), "cls long, other long, links long"),
        "found",
    )
    comp = components(found.where("other is not null"), "cls", "other")
    named = classes.select("cls", "n", "top").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    tops = named.groupBy("component").agg(F.min("top").alias("component_id"))
    counts = found.where("other is null").groupBy("cls").agg(F.sum("links").alias("links"))
    told = named.join(tops, "component").join(counts, "cls", "left").select("cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    # rows find their class by (label, vector); a class's name is its first row
    k = F.struct("label", "vec").alias("k")
    own = classes.select(k, "cls", "n").join(told, "cls").select("k", F.struct("n_links", "component_id").alias("v"), "n")
    linked = split_join(good.select("vec_id", k), own, heavy(good.count())).select("vec_id", "v.n_links", "v.component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
