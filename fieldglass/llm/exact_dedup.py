"""Exact deduplication by a log-structured merge index.

Reading tasks fill memtables: within one, equal texts are recognised by
their bytes and collapse to the one that stays, so a group of copies of any
size leaves at most one index entry per memtable.  A full memtable is flushed
as a run sorted by digest, with a Bloom filter.  The index is sharded by
digest.  In each shard runs enter one after the other: a key that a level's
filter excludes is not searched there; levels of similar size are merged, and
the compaction keeps the preferred identifier of each digest.  Hits across
runs are then verified by joining the entries' texts and comparing their bytes;
texts that only share a digest are told apart.  There are as many shards as
the entries need, and the entries of a text that very many runs hold are
dealt over several tasks, each with a copy of the text they are compared to.

Defined results: a null text counts as empty; a null identifier ranks below
all others; of rows equal in identifier and text one stays (in
``distinct_texts`` the least by a hash of the whole row); an empty table
gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm import _bytes as B
from fieldglass.llm._shared import heavy, mapped, marked, might_contain, partitions, passing, split_join, stage, unpacked

#: A memtable is flushed at so many rows or so many bytes of text.
MEMTABLE_ROWS, MEMTABLE_BYTES = 1 << 15, 24 << 20
#: So many runs of a level are merged into one of the next.
FANOUT = 4
#: Index entries that a shard's task holds on average at most.
ENTRIES = 1 << 20

ENTRY = "entry long, doc_id long, text_sha256 string, rep long, key long, n long"


def _folded(column: pa.Array) -> list[bytes]:
    data, off = B.raw(column)
    low = B.FOLD[data].tobytes()
    return [low[off[i] : off[i + 1]] for i in range(len(off) - 1)]


class _Memtable:
    def __init__(self, run: int, sign: int, bits: int):
        self.run, self.sign, self.bits = run, sign, bits
        self.ids, self.shas, self.rep, self.bytes = [], [], [], 0
        self.best: dict[bytes, int] = {}  # text -> slot of the row that stays

    def rank(self, slot: int) -> tuple:
        x = self.ids[slot]
        return (x is not None, self.sign * x if x is not None else 0, -slot)

    def add(self, doc_id: int | None, text: bytes) -> None:
        slot = len(self.ids)
        self.ids.append(doc_id)
        seen = self.best.get(text)
        if seen is None:
            self.best[text] = slot
            self.bytes += len(text)
            self.shas.append(hashlib.sha256(text).digest())
        else:
            self.shas.append(self.shas[seen])
            if self.rank(slot) > self.rank(seen):
                self.best[text] = slot
        self.rep.append(text)

    def flush(self) -> pa.RecordBatch:
        rep = np.fromiter((self.best[t] for t in self.rep), np.int64, len(self.rep))
        n = np.bincount(rep, minlength=len(rep))
        sha = np.frombuffer(b"".join(self.shas), np.uint8).reshape(-1, 32)
        key = sha[:, :8].copy().view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - self.bits)
        key = key.astype(np.int64)
        order = np.argsort(key, kind="stable")
        base = self.run << 24
        hexed = np.array([s.hex() for s in self.shas], object)
        ids = np.array(self.ids, object)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(base + order),
                pa.array(ids[order], pa.int64()),
                pa.array(hexed[order], pa.string()),
                pa.array(base + rep[order]),
                pa.array(key[order]),
                pa.array(n[order].astype(np.int64)),
            ],
            ["entry", "doc_id", "text_sha256", "rep", "key", "n"],
        )


def _memtables(sign: int, bits: int, rows: int, size: int):
    def fill(batches):
        part, seq = TaskContext.get().partitionId(), 0
        table = _Memtable(part << 16, sign, bits)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, _folded(batch.column(1)), strict=True):
                if len(table.ids) >= rows or table.bytes >= size:
                    yield table.flush()
                    seq += 1
                    table = _Memtable((part << 16) + seq, sign, bits)
                table.add(doc_id, text)
        if table.ids:
            yield table.flush()

    return fill


class Bloom:
    """A Bloom filter of two probes over 64-bit keys."""

    def __init__(self, keys: np.ndarray):
        self.bits = np.uint64(max(10, int(len(keys) * 12).bit_length()))
        self.set = np.zeros(1 << (int(self.bits) - 3), np.uint8)
        for p in self._probes(keys):
            np.bitwise_or.at(self.set, p >> np.uint64(3), np.left_shift(1, p & np.uint64(7)).astype(np.uint8))

    def _probes(self, keys: np.ndarray):
        h = B.mix(keys.astype(np.uint64))
        yield h >> (np.uint64(64) - self.bits)
        yield B.mix(h + np.uint64(1)) >> (np.uint64(64) - self.bits)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for p in self._probes(keys):
            found &= (self.set[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


class LsmIndex:
    """Sorted digest runs in tiers; ``insert`` tells which keys were there before."""

    def __init__(self) -> None:
        self.tiers: list[list[tuple[np.ndarray, Bloom]]] = [[]]

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """keys: sorted and distinct. True where an earlier run holds the key."""
        hit = np.zeros(len(keys), bool)
        for tier in self.tiers:
            for run, bloom in tier:
                ask = np.flatnonzero(~hit)[bloom.may_hold(keys[~hit])]
                at = np.minimum(np.searchsorted(run, keys[ask]), len(run) - 1)
                hit[ask] = run[at] == keys[ask]
        new = keys[~hit]
        if len(new):
            self.tiers[0].append((new, Bloom(new)))
        level = 0
        while len(self.tiers[level]) >= FANOUT:
            merged = np.sort(np.concatenate([r for r, _ in self.tiers[level]]))
            self.tiers[level] = []
            level += 1
            if level == len(self.tiers):
                self.tiers.append([])
            self.tiers[level].append((merged, Bloom(merged)))
        return hit


def _compact(sign: int):
    """Runs of one shard in; (rep, win, keep_id, ...) of keys that several runs hold."""

    def work(batches):
        cols = [[], [], [], [], []]
        for b in batches:
            key, rep, doc, n = (b.column(i) for i in range(4))
            cols[0].append(key.to_numpy())
            cols[1].append(rep.to_numpy())
            cols[2].append(doc.fill_null(0).to_numpy())
            cols[3].append(n.to_numpy())
            cols[4].append(doc.is_valid().to_numpy(zero_copy_only=False))
        if not cols[0]:
            return
        key, rep, doc, n, has = (np.concatenate(c) for c in cols)
        run = rep >> 24
        order = np.lexsort((key, run))
        key, rep, doc, n, has, run = (x[order] for x in (key, rep, doc, n, has, run))
        index, again = LsmIndex(), []
        cuts = np.flatnonzero(np.diff(run)) + 1
        for part in np.split(key, cuts):
            distinct = np.unique(part)
            again.append(distinct[index.insert(distinct)])
            if len(distinct) < len(part):  # digests that collide within a run
                v, c = np.unique(part, return_counts=True)
                again.append(v[c > 1])
        hits = np.unique(np.concatenate(again))
        if not len(hits):
            return
        at = np.minimum(np.searchsorted(hits, key), len(hits) - 1)
        own = np.flatnonzero(hits[at] == key)
        key, rep, doc, n, has = (x[own] for x in (key, rep, doc, n, has))
        # compaction keeps the preferred identifier of each key
        order = np.lexsort((-rep, np.where(has, sign * doc, 0), has, key))
        key, rep, doc, n, has = (x[order] for x in (key, rep, doc, n, has))
        last = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [True])))
        win = rep[last][np.searchsorted(key[last], key)]
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(win), pa.array(doc, mask=~has), pa.array(n)], ["rep", "win", "doc_id", "n"])

    return work


def _texts(batches):
    for b in batches:
        texts = _folded(b.column(1))
        sha = [hashlib.sha256(t).hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.string()), pa.array(texts, pa.binary())], ["doc_id", "text_sha256", "body"])


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    digest_bits: int = 63,
    memtable_rows: int = MEMTABLE_ROWS,
    memtable_bytes: int = MEMTABLE_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  ``keep``:
    "largest" or "smallest" identifier.  ``digest_bits``: of the index key.
    """
    spark, sign = docs.sparkSession, 1 if keep == "largest" else -1
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    entries = stage(mapped(slim, _memtables(sign, digest_bits, min(memtable_rows, 1 << 24), memtable_bytes), ENTRY), "runs")
    reps = entries.where("entry = rep")
    shards = max(partitions(spark), -(-reps.count() // ENTRIES))
    hits = stage(
        mapped(reps.select("key", "rep", "doc_id", "n").repartition(shards, "key"), _compact(sign), "rep long, win long, doc_id long, n long"),
        "compacted",
    )
    rank = lambda d, r: F.struct(d.isNotNull().alias("v"), (F.lit(sign) * d).alias("d"), (-r).alias("r"))
    # byte verification: the texts of hits only
    digest = hits.join(reps.select("rep", "text_sha256"), "rep")
    wanted = might_contain(slim, F.col("doc_id"), hits, F.col("doc_id"))
    own = ["doc_id", "text_sha256"]
    bodies = mapped(wanted, _texts, "doc_id long, text_sha256 string, body binary").groupBy(*own).agg(F.first("body").alias("body"))
    same_row = F.col("h.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("h.text_sha256") == F.col("t.text_sha256"))
    held = stage(digest.alias("h").join(bodies.alias("t"), same_row).select("h.rep", "h.win", "h.doc_id", "h.n", "t.body"), "held")
    # a text that very many runs hold: its entries are dealt over several tasks
    hot = heavy(hits.count())
    fan = F.broadcast(hits.groupBy("win").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("win", F.ceil(F.col("c") / hot).cast("int").alias("fan")))
    wide = F.coalesce("fan", F.lit(1))
    winner = held.where("rep = win").select("win", F.col("body").alias("other")).join(fan, "win", "left").select("win", "other", F.explode(F.sequence(F.lit(0), wide - 1)).alias("salt"))
    dealt = held.join(fan, "win", "left").withColumn("salt", F.pmod(F.xxhash64("rep"), wide).cast("int")).drop("fan")
    told = stage(dealt.join(winner, ["win", "salt"]).withColumn("same", F.col("body") == F.col("other")), "verified")
    same = told.where("same").select("rep", F.col("win").alias("top"), "doc_id", "n")
    # equal digests of different texts: grouped by the bytes themselves
    rest = told.where("not same").select("rep", "win", "doc_id", "n", "body")
    top = rest.groupBy("win", "body").agg(F.max_by("rep", rank(F.col("doc_id"), F.col("rep"))).alias("top"))
    other = rest.join(top, ["win", "body"]).select("rep", "top", "doc_id", "n")
    members = same.unionByName(other)
    sizes = members.groupBy("top").agg(F.sum("n").alias("size"), F.max_by("doc_id", rank(F.col("doc_id"), F.col("rep"))).alias("top_id"))
    across = members.select("rep", "top").join(sizes, "top")
    local = reps.select("rep", F.col("doc_id").alias("rep_id"), F.col("n").alias("rep_n"))
    reps_out = (
        local.join(across, "rep", "left")
        .select("rep", F.coalesce("top", "rep").alias("top"), F.when(F.col("top").isNull(), F.col("rep_id")).otherwise(F.col("top_id")).alias("keep_id"), F.coalesce("size", "rep_n").alias("group_size"))
    )
    return entries.select("entry", "doc_id", "rep", "text_sha256").join(reps_out, "rep").select(
        "doc_id", "keep_id", "group_size", (F.col("entry") == F.col("top")).alias("kept"), "text_sha256"
    )


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only rows that may be dropped are joined; all others pass where they are.
    """
    ident = F.col(f"`{id_col}`").cast("long")
    named = lambda i, sha: F.struct(i.isNull().alias("nil"), i.alias("id"), sha.alias("sha"))
    with passing(docs.sparkSession):
        told = exact_dedup(docs, id_col, text_col, keep).where("group_size > 1").select(F.col("doc_id").alias("i"), named(F.col("doc_id"), F.col("text_sha256")).alias("k"), F.col("kept"))
        told = stage(told, "copies", lasting=True)
    rows = marked(docs, ident, told, F.col("i"))
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    body = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    sha = F.sha2(F.translate(body, up, low), 256)
    maybe = rows.where("may").select("row", named(F.col("key"), sha).alias("k"))
    groups = told.groupBy("k").agg(F.max("kept").alias("v"), F.count("*").alias("n"))
    joined = split_join(maybe, groups, heavy(told.count()))
    alone = joined.where("v is null").select("row")
    # rows equal in identifier and text leave one
    stays = joined.where("v").groupBy("k").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return rows.where("not may").select("row").unionByName(alone).unionByName(stays).select(*unpacked(docs))
