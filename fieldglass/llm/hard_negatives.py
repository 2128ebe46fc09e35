"""Hard negatives of anchors by branch and bound over ball trees.

Vectors become integers, floor(scale * x), and are scored by inner products.
The rows are sorted by range of (length, label, hash of the identifier), so a
label of any size is spread over partitions, and each partition cuts its rows
into shards of bounded size with a ball tree each.  Anchors are packed into
blocks.  A task takes one block through a group of shards, one shard at a time, and
keeps the best few of each search: a node with centre c and radius r bounds
the inner products with q by q.c - |q| r and q.c + |q| r, and is left out if they
lie outside the search's window or strictly beneath the worst of a full
list.  The groups' lists are merged in Spark.

First the positives are searched, in shards that hold a label of the
block; then, for each positive's score s, the rows of other labels with
low * s <= 100 * score <= high * s.

Defined results: rows with a null identifier, label or vector, or with a null
or non-finite component, take no part; rows equal in identifier, label and
vector count once; rows that share an identifier are no positives of each other, but else
rows of their own; vectors of different lengths are not compared, and empty
ones have inner product 0; ties go to the smaller identifier; an anchor
without positives, or a positive without rows in its window, gives no rows; an
empty table gives none.  Components beyond 64 bits after scaling are taken as the
nearest such number; if inner products might exceed 64 bits, the search
fails with a ValueError.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.llm._shared import mapped, partitions, passing, stage

#: Vectors of a shard, anchors of a block, and their components, at most.
SHARD, BLOCK, NUMBERS = 8192, 4096, 1 << 20
#: Vectors of a leaf at most, unless they are all equal; cells of a score matrix at most.
LEAF, CELLS = 64, 1 << 21

_LEAST, _MOST = -(2**63 - 1), 2**63 - 1
_PACK = "labels array<string>, codes binary, ids binary, vecs binary, width int, dim int"


def ball_tree(x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order of the rows, nodes): start, end, left, right (-1 at leaves), radius and centre of each node; node 0 is the root."""
    order = np.arange(len(x))
    start, end, left, right, radius, centre = [], [], [], [], [], []

    def node(lo: int, hi: int) -> int:
        own = x[order[lo:hi]].astype(np.float64)
        c = own.mean(axis=0)
        far = np.sqrt(((own - c) ** 2).sum(axis=1))
        start.append(lo), end.append(hi), left.append(-1), right.append(-1), radius.append(far.max()), centre.append(c)
        return int(far.argmax())

    todo = [(0, len(x), -1, left)] if len(x) else []
    while todo:
        lo, hi, up, side = todo.pop()
        at = node(lo, hi)
        me = len(start) - 1
        if up >= 0:
            side[up] = me
        if hi - lo <= LEAF:
            continue
        own = x[order[lo:hi]].astype(np.float64)
        away = own - own[at]
        other = int((away**2).sum(axis=1).argmax())
        if not away[other].any():
            continue  # all equal
        split = np.argpartition(away @ away[other], (hi - lo) // 2)
        order[lo:hi] = order[lo:hi][split]
        mid = lo + (hi - lo) // 2
        todo += [(lo, mid, me, left), (mid, hi, me, right)]
    return order, {"start": np.array(start, np.int64), "end": np.array(end, np.int64), "left": np.array(left, np.int64), "right": np.array(right, np.int64), "radius": np.array(radius), "centre": np.array(centre).reshape(len(start), x.shape[1])}


class Best:
    """The first ``k`` of each search: scores descending, then identifiers ascending."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), _LEAST, np.int64)
        self.id = np.full((n, k), _MOST, np.int64)

    @property
    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, item: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        rows = np.unique(item)
        item = np.concatenate((item, np.repeat(rows, self.k)))
        score, ident = np.concatenate((score, self.score[rows].ravel())), np.concatenate((ident, self.id[rows].ravel()))
        order = np.lexsort((ident, -score, item))
        item = item[order]
        begin = np.searchsorted(item, rows)
        pick = order[begin[:, None] + np.arange(self.k)]
        self.score[rows], self.id[rows] = score[pick], ident[pick]


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all sums stay below 2**53."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * x.shape[1]
    if most < 1 << 53:
        return np.rint(x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def refuse_large(x: np.ndarray, y: np.ndarray) -> None:
    if max(abs(int(x.min(initial=0))), int(x.max(initial=0))) * max(abs(int(y.min(initial=0))), int(y.max(initial=0))) * x.shape[1] >= 1 << 63:
        raise ValueError("inner products might exceed 64 bits; choose a smaller scale")


def search(best: Best, query: np.ndarray, of: np.ndarray, own_id: np.ndarray, own_label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, shard: dict) -> None:
    """Take ``best`` through one shard.

    Search i is for row of[i] of ``query``, among the rows of its own label
    but not its own identifier (``same``), or else of other labels, with scores from
    low[i] to high[i].
    """
    tree, vecs, ids, labels = shard["tree"], shard["vecs"], shard["ids"], shard["labels"]
    if not len(ids) or not len(of):
        return
    refuse_large(query, vecs)
    q = query.astype(np.float64)
    size = np.sqrt((q * q).sum(axis=1))

    def open_(node: int, items: np.ndarray) -> tuple[np.ndarray, float]:
        """The searches that the node can serve, and the mean of their upper bounds."""
        c, r = tree["centre"][node], tree["radius"][node]
        rows = of[items]
        mid, reach = q[rows] @ c, size[rows] * r
        slack = 1e-9 * size[rows] * (np.sqrt(c @ c) + r) + 1e-6
        top, bottom = mid + reach + slack, mid - reach - slack
        use = (top >= low[items]) & (bottom <= high[items]) & (top >= best.worst[items])
        return items[use], float(np.minimum(top[use], high[items][use]).mean()) if use.any() else -np.inf

    todo = [(0, np.arange(len(of)))]
    while todo:
        node, items = todo.pop()
        items, _ = open_(node, items)  # again, for the lists have grown since
        if not len(items):
            continue
        if tree["left"][node] >= 0:
            sides = sorted(((open_(int(s), items), int(s)) for s in (tree["left"][node], tree["right"][node])), key=lambda z: z[0][1])
            todo += [(s, kept) for (kept, _), s in sides if len(kept)]  # the better one is taken first
            continue
        lo, hi = int(tree["start"][node]), int(tree["end"][node])
        step = max(1, CELLS // (hi - lo))
        for at in range(0, len(items), step):
            some = items[at : at + step]
            rows, back = np.unique(of[some], return_inverse=True)
            s = _products(query[rows], vecs[lo:hi])[back]
            alike = own_label[some][:, None] == labels[lo:hi][None, :]
            fit = (alike & (own_id[some][:, None] != ids[lo:hi][None, :])) if same else ~alike
            fit &= (s >= low[some][:, None]) & (s <= high[some][:, None]) & (s >= best.worst[some][:, None])
            i, j = np.nonzero(fit)
            if len(i):
                best.add(some[i], s[i, j], ids[lo:hi][j])


def _packed(batch: list[tuple], more: dict) -> pa.RecordBatch:
    """One row for all of (label, id, vec)."""
    names: dict[str, int] = {}
    codes = np.array([names.setdefault(b[0], len(names)) for b in batch], np.int32)
    vecs = np.stack([b[2] for b in batch])
    most = max(abs(int(vecs.min(initial=0))), int(vecs.max(initial=0)))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    ids = np.array([b[1] for b in batch], np.int64)
    row = {"labels": list(names), "codes": codes.tobytes(), "ids": ids.tobytes(), "vecs": vecs.astype(f"<i{width}").tobytes(), "width": width, "dim": vecs.shape[1], **more}
    kinds = {"labels": pa.list_(pa.string()), "width": pa.int32(), "dim": pa.int32(), "no": pa.int64(), "nos": pa.binary(), "found": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], list(row))


def _numbers(column: pa.Array) -> list[np.ndarray]:
    flat, off = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
    return [flat[i:j] for i, j in zip(off[:-1], off[1:], strict=True)]


def _runs(batches, most: int, extra: list[str]):
    """Lists of at most ``most`` sorted rows (label, id, vec, extras) of one length; equal rows once."""
    held, last, seen = [], None, set()
    for b in batches:
        cols = [b.column("label").to_pylist(), b.column("id").to_pylist(), _numbers(b.column("vec")), *(b.column(c).to_pylist() for c in extra)]
        for row in zip(*cols, strict=True):
            if row[:2] != last:
                last, seen = row[:2], set()
            name = (len(row[2]), row[2].tobytes())
            if name in seen:
                continue
            seen.add(name)
            if held and (len(held) >= min(most, max(1, NUMBERS // max(1, len(row[2])))) or len(held[0][2]) != len(row[2])):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _number() -> int:
    return TaskContext.get().partitionId() << 33


def _shards(batches):
    for n, rows in enumerate(_runs(batches, SHARD, [])):
        x = np.stack([r[2] for r in rows])
        order, tree = ball_tree(x)
        nodes = {k: v.tobytes() for k, v in tree.items()}
        yield _packed([rows[i] for i in order], {**nodes, "no": _number() + n})


def _anchors(batches):
    for n, rows in enumerate(_runs(batches, BLOCK, ["no", "found"])):
        found = [r[4] or [] for r in rows]
        flat = np.array([(i, p["id"], p["score"]) for i, own in enumerate(found) for p in own], np.int64).reshape(-1, 3)
        yield _packed(rows, {"nos": np.array([r[3] for r in rows], np.int64).tobytes(), "found": flat.tobytes(), "no": _number() + n})


_NODES = ("start", "end", "left", "right", "radius", "centre")
_SHARD = f"{_PACK}, {', '.join(f'{n} binary' for n in _NODES)}, no long"
_BLOCK = f"{_PACK}, nos binary, found binary, no long"


def _opened(row: dict) -> dict:
    ids = np.frombuffer(row["ids"], np.int64)
    vecs = np.frombuffer(row["vecs"], f"<i{row['width']}").astype(np.int64).reshape(len(ids), row["dim"])
    out = {"ids": ids, "vecs": vecs, "codes": np.frombuffer(row["codes"], np.int32), "names": row["labels"]}
    if row["start"] is not None:
        out["tree"] = {n: np.frombuffer(row[n], np.float64 if n in ("radius", "centre") else np.int64) for n in _NODES}
        out["tree"]["centre"] = out["tree"]["centre"].reshape(len(out["tree"]["start"]), row["dim"])
    else:
        out |= {"nos": np.frombuffer(row["nos"], np.int64), "found": np.frombuffer(row["found"], np.int64).reshape(-1, 3)}
    return out


def share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """percent * score / 100, rounded up or down, without overflow."""
    whole, rest = np.divmod(score, 100)
    return whole * percent + (rest * percent + (99 if up else 0)) // 100


def _searched(k: int, window: tuple[int, int] | None):
    """Rows sorted by (block, part, shard): the block itself, then its shards; the best of each search.

    Without a window the positives are searched, else each positive's negatives.
    """

    def begin(block):
        n = len(block["ids"])
        if window is None:
            of, low, high = np.arange(n), np.full(n, _LEAST, np.int64), np.full(n, _MOST, np.int64)
            positive = np.zeros((n, 2), np.int64)
        else:
            of, positive = block["found"][:, 0], block["found"][:, 1:]
            low, high = share(positive[:, 1], window[0], True), share(positive[:, 1], window[1], False)
        return block, of, positive, low, high, Best(len(of), k)

    def step(state, shard):
        block, of, _, low, high, best = state
        if shard["vecs"].shape[1] != block["vecs"].shape[1]:
            return
        code = {name: i for i, name in enumerate(block["names"])}
        shard["labels"] = np.array([code.get(name, -1) for name in shard["names"]], np.int64)[shard["codes"]]
        search(best, block["vecs"], of, block["ids"][of], block["codes"][of].astype(np.int64), low, high, window is None, shard)

    def finish(state):
        block, of, positive, _, _, best = state
        i, j = np.nonzero(best.score > _LEAST)
        cols = [block["nos"][of[i]], block["ids"][of[i]], positive[i, 0], positive[i, 1], best.id[i, j], best.score[i, j]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["no", "anchor_id", "positive_id", "positive_score", "id", "score"])

    def work(batches):
        key, state = None, None
        for b in batches:
            for r in range(b.num_rows):  # a shard or block at a time
                row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                now = (row["block"], row["part"])
                if now != key:
                    if state is not None:
                        yield finish(state)
                    key, state = now, None
                if row["shard"] is None:
                    state = begin(_opened(row))
                elif state is not None:
                    step(state, _opened(row))
        if state is not None:
            yield finish(state)

    return work


def _search(shards: DataFrame, blocks: DataFrame, pairs: DataFrame, k: int, window: tuple[int, int] | None) -> DataFrame:
    """pairs: (block, shard) to be searched; the best of each block and group of shards."""
    spark = shards.sparkSession
    n = partitions(spark)
    parts = max(1, -(-2 * n // max(1, blocks.count())))
    part = F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int")
    own = [c for c in shards.columns if c != "no"]
    tree = [c for c in own if c not in blocks.columns]
    more = ["nos", "found"]
    cols = ["block", "part", "shard", *own, *more]
    met = pairs.withColumn("part", part).join(shards.withColumnRenamed("no", "shard"), "shard")
    met = met.select(*[F.lit(None).cast("binary").alias(c) if c in more else F.col(c) for c in cols])
    heads = blocks.select(F.col("no").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("long").alias("shard"), *[F.lit(None).cast("binary").alias(c) if c in tree else F.col(c) for c in own], *more)
    rows = heads.select(*cols).unionByName(met).repartition(n, "block", "part").sortWithinPartitions("block", "part", F.asc_nulls_first("shard"))
    return mapped(rows, _searched(k, window), "no long, anchor_id long, positive_id long, positive_score long, id long, score long")


def _packs(rows: DataFrame, work, schema: str, extra: list[str], per: int) -> DataFrame:
    """Rows (label, id, vec) sorted by range and packed."""
    order = [F.size("vec"), "label", F.xxhash64("id"), "id"]
    some = max(1, min(partitions(rows.sparkSession), -(-rows.count() // per)))
    return mapped(rows.repartitionByRange(some, *order).sortWithinPartitions(*order).select("label", "id", "vec", *extra), work, schema)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score.

    ``anchor`` tells which rows are anchors; ``window`` has the least and the
    most per cent of the positive's score that a negative has.
    """
    if positives < 1 or negatives < 1:
        raise ValueError("ask for one positive and one negative at least")
    x = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), x.alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(~bad).select("id", "label", "anchor", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("vec"))
    with passing(vectors.sparkSession):
        rows = stage(rows, "vectors")
        shards = stage(_packs(rows.drop("anchor"), _shards, _SHARD, [], SHARD), "shards")
        anchors = stage(rows.where("anchor").select("id", "label", "vec").distinct().withColumn("no", F.monotonically_increasing_id()), "anchors")
        nothing = anchors.withColumn("found", F.expr("cast(array() as array<struct<id:bigint,score:bigint>>)"))
        blocks = stage(_packs(nothing, _anchors, _BLOCK, ["no", "found"], BLOCK), "blocks")
        held = lambda df, name: df.select(F.col("no").alias(name), "dim", F.explode("labels").alias("label"))
        pairs = held(blocks, "block").join(held(shards, "shard"), ["dim", "label"]).select("block", "shard").distinct()
        first = W.partitionBy("no").orderBy(F.desc("score"), "id")
        near = _search(shards, blocks, pairs, positives, None).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives)
        found = stage(near.groupBy("no").agg(F.collect_list(F.struct("id", "score")).alias("found")), "positives")
        blocks = stage(_packs(anchors.join(found, "no"), _anchors, _BLOCK, ["no", "found"], BLOCK), "searches")
        # every block goes through all shards of its vectors' length, but for those of its own label alone
        alone = F.when(F.size("labels") == 1, F.get("labels", 0))
        b, s = (df.select(F.col("no").alias(name), "dim", alone.alias(f"{name}_only")) for df, name in ((blocks, "block"), (shards, "shard")))
        pairs = b.join(s, "dim").where(~F.coalesce(F.col("block_only") == F.col("shard_only"), F.lit(False))).select("block", "shard")
        hard = stage(_search(shards, blocks, pairs, negatives, window), "negatives", lasting=True)
    order = W.partitionBy("no", "anchor_id", "positive_id", "positive_score").orderBy(F.desc("score"), "id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
