"""Similarity self-join of word-shingle sets by universe partition.

A document is the set of its k-word shingles.  A shingle is a 64-bit token; a
second, independent lane of hashes goes into the 128-bit name by which equal
sets are one class.  Sets so small that only an equal one is similar enough
need no search: their class is their component.  Two larger sets of sizes r <= s that are similar enough differ in at
most H(r, s) elements.  Within a band of sizes the universe of tokens is cut
by a hash into m segments; so among segments that together count H + 1 units,
one at least agrees.  A segment is indexed in one of two ways, allocated for
each band by estimated cost: by its subset (one unit: it agrees only if equal),
or by the subset and its one-deletion neighbourhood (two units: it agrees
up to one difference).  Subsets of one token or none are frequent and useless
as keys, so they count nothing: each set goes through the segments in order
until it has gathered H + 1 units, and the smaller set of a pair (or the one
that stops first) thereby meets the other in a segment both have indexed.  A
set that runs out of segments indexes all, the thin ones too.

Keys that several classes share give candidate links to one hub each, first
within a reading task, then across tasks, so the links grow with the rows,
not with their pairs.  Candidates are verified exactly on the sets.  Where
the members of a key's bucket end in several components, further members
become hubs until every pair of them is linked or verified.

What rests on hashes: a false link needs two documents that are a shingle or
two short of the threshold and two of whose other shingles collide in 64 bits
(10^13 such pairs would give one with a chance of 10^-6), or two sets that
collide in 128 bits.  Classes that share the first 64 bits are told apart by
the rest and renamed where they are.

Defined results: null or blank texts have empty sets and link with nothing;
a text of fewer than k words is one shingle; a null identifier names a
component only if it has no other; repeated rows link with each other; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm import _bytes as B
from fieldglass.llm._shared import mapped, marked, might_contain, partitions, passing, stage, unpacked
from fieldglass.operators.graph import components

#: Keys' worth of a set that runs out of segments.
CHARGE = 2_000
#: Sets that one side of a block comparison holds.
CHUNK = 512
#: Bytes of token sets that one side of a block comparison holds on average at most.
CHUNK_BYTES = 2 << 20
#: Index entries that one reducing task gets on average at most.
ENTRIES = 1 << 19
#: Index entries that a dealing task collapses at a time.
DEALT = 1 << 18
#: Entries of a packed row; a page of such rows is held whole by writers and readers.
PACKED = 1 << 15
#: Bytes of text whose words are hashed at a time.
PIECE = 1 << 18


def differing(r: np.ndarray | int, s: np.ndarray | int, percent: int):
    """Most elements in which similar sets of sizes r and s can differ."""
    return (r + s) * (100 - percent) // (100 + percent)


def largest_partner(r: np.ndarray | int, percent: int):
    return r * 100 // percent


def _thin(mu: float) -> float:
    return math.exp(-mu) * (1 + mu)


@lru_cache(maxsize=64)
def bands(percent: int) -> np.ndarray:
    """The smallest size of each band; similar sets are in one band or in neighbours."""
    ratio, lows = max(math.sqrt(2), 1.02 * 100 / percent), [1]
    while lows[-1] < 1 << 40:
        lows.append(max(lows[-1] + 1, math.ceil(lows[-1] * ratio)))
    return np.array(lows, np.int64)


@lru_cache(maxsize=4096)
def allocation(band: int, percent: int) -> tuple[int, int]:
    """(segments, how many of the first are indexed with one-deletion neighbourhoods).

    Cost: keys made for a set of the band, and a charge for the chance that a
    set runs out of segments, since thin keys are shared widely.
    """
    sizes = (int(bands(percent)[band]), int(bands(percent)[band + 1]) - 1)
    units = [int(differing(n, largest_partner(n, percent), percent)) + 1 for n in sizes]
    # one-deletion neighbourhoods throughout: as few segments as can count the units
    few = -(-units[1] // 2)
    best = (sum(n + few for n in sizes), few, few) if units[1] > 1 else (0, 1, 0)
    for m in range(units[1], 2 * units[1] + 2):
        cost = float(sum(units))
        for n, u in zip(sizes, units, strict=True):
            f = _thin(n / m) if m > 1 else 0.0
            mean, dev = m * (1 - f), math.sqrt(m * f * (1 - f)) + 1e-9
            cost += CHARGE * math.erfc((mean - u + 0.5) / dev / math.sqrt(2)) / 2
        if cost < best[0]:
            best = (cost, m, 0)
    return best[1], best[2]


def signatures(tokens: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of each row's set (distinct tokens from first[i]), and the rows' first keys."""
    n = np.diff(first)
    rows = np.flatnonzero(n)
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    size = n[rows]
    band = np.searchsorted(bands(percent), size, "right") - 1
    low = bands(percent)[band]
    # a set looks for partners of its own band, and for smaller ones of the band below
    below = (band > 0) & (size <= largest_partner(low - 1, percent))
    view = np.concatenate((rows, rows[below]))
    vband = np.concatenate((band, band[below] - 1))
    need = np.concatenate((differing(size, largest_partner(size, percent), percent), differing(size[below], low[below] - 1, percent))) + 1
    plan = {int(b): allocation(int(b), percent) for b in np.unique(vband)}
    m = np.array([plan[int(b)][0] for b in vband], np.int64)
    near = np.array([plan[int(b)][1] for b in vband], np.int64)
    # tokens of every view, each with its segment
    vn = n[view]
    end = np.cumsum(vn)
    owner = np.repeat(np.arange(len(view)), vn)
    tok = tokens[np.arange(int(end[-1])) + np.repeat(first[view] - (end - vn), vn)]
    salt = B.mix(vband.astype(np.uint64) + np.uint64(77))
    spread = B.mix(tok ^ salt[owner])
    seg0 = np.cumsum(m) - m
    seg = seg0[owner] + (((spread >> np.uint64(32)) * m[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    total = int(m.sum())
    count = np.bincount(seg, minlength=total)
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, seg, spread)
    sowner = np.repeat(np.arange(len(view)), m)
    sno = np.arange(total) - seg0[sowner]
    is_near = sno < near[sowner]
    units = np.where(is_near, 2, (count >= 2).astype(np.int64))
    run = np.cumsum(units)
    run -= (run[seg0] - units[seg0])[sowner]
    got = run[seg0 + m - 1]
    fails = got < need
    use = ((units > 0) & (run - units < need[sowner])) | fails[sowner]
    tag = B.mix(sno.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt[sowner])
    name = lambda s, c, t: B.mix(s ^ B.mix(t + c.astype(np.uint64)))
    whole = np.flatnonzero(use)
    keys, to = [name(sums[whole], count[whole], tag[whole])], [view[sowner[whole]]]
    part = np.flatnonzero((use & is_near)[seg])
    if len(part):
        s = seg[part]
        keys.append(name(sums[s] - spread[part], count[s] - 1, tag[s]))
        to.append(view[owner[part]])
    keys, to = np.concatenate(keys), np.concatenate(to)
    order = np.argsort(to, kind="stable")
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(np.bincount(to, minlength=len(n)), out=begin[1:])
    return keys[order], begin


def _fingerprints(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(B.mix(values), out=total[1:])
    return B.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))


def _token_sets(column: pa.Array, k: int):
    """For parts of the column: (rows, tokens, first, the sets' names, their second halves)."""
    data, off = B.raw(column)
    for i, j in B.pieces(off, PIECE):
        own, part = off[i : j + 1] - off[i], data[off[i] : off[j]]
        starts, ends, first = B.spans(part, own)
        words, other = B.hashes(part, starts, ends), B.hashes(part, starts, ends, lane=1)
        tokens, first, second = B.sets(*B.shingles(words, first, k, other))
        yield (i, j), tokens, first, _fingerprints(tokens, first), _fingerprints(second, first)


def _index(k: int, percent: int, remember: int):
    """id, class (two halves), n and the index keys; a class's keys once a task."""

    def work(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for (i, j), tokens, first, cid, check in _token_sets(batch.column("text"), k):
                n = np.diff(first)
                # a set that is similar to equal ones alone needs no key
                sought = differing(n, largest_partner(n, percent), percent) > 0
                fresh = np.zeros(j - i, bool)
                for r in np.flatnonzero(sought).tolist():
                    c = (int(cid[r]), int(check[r]))
                    if c not in seen:
                        fresh[r] = True
                        if len(seen) < remember:
                            seen.add(c)
                keep = np.repeat(fresh, n)
                part = np.zeros(len(n) + 1, np.int64)
                np.cumsum(np.where(fresh, n, 0), out=part[1:])
                keys, begin = signatures(tokens[keep], part, percent)
                blob = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((begin * 8).tobytes()), pa.py_buffer(keys.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), B.longs(cid), B.longs(check), pa.array(n), blob], ["id", "cid", "chk", "n", "keys"])

    return work


def collapse(key: np.ndarray, cid: np.ndarray):
    """Buckets of equal key: (hub entries, links to the hub, all entries of shared buckets)."""
    order = np.lexsort((cid, key))
    key, cid = key[order], cid[order]
    same_key = np.concatenate(([False], key[1:] == key[:-1]))
    repeat = same_key & np.concatenate(([False], cid[1:] == cid[:-1]))
    key, cid, same_key = key[~repeat], cid[~repeat], same_key[~repeat]
    start = np.flatnonzero(~same_key)
    size = np.diff(np.append(start, len(key)))
    hub = np.repeat(cid[start], size)
    shared = np.repeat(size > 1, size)
    links = np.unique(np.stack((hub[same_key], cid[same_key]), axis=1), axis=0) if same_key.any() else np.zeros((0, 2), np.int64)
    return (key[start], cid[start]), links, (key[shared], cid[shared])


_PACKED = "part int, keys binary, cids binary, a long, b long, kind int"
_ENTRY, _MEMBER, _LINK = 0, 1, 2


def _packed(part, keys, cids, a, b, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(cids, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(part), kind, np.int32))], ["part", "keys", "cids", "a", "b", "kind"])


def _emit(links, member, parts: int = 1):
    """Links and members, dealt over the parts whatever their bucket."""
    if len(links):
        nil = [None] * len(links)
        yield _packed(links[:, 1] % parts, nil, nil, links[:, 0], links[:, 1], _LINK)
    for at in range(0, len(member[0]), PACKED):
        k, c = member[0][at : at + PACKED], member[1][at : at + PACKED]
        yield _packed([(int(k[0]) ^ int(c[0])) % parts], [k.tobytes()], [c.tobytes()], [None], [None], _MEMBER)


def _deal(parts: int, batch_keys: int):
    """Entries of a task, local buckets collapsed, packed for the reducing tasks."""

    def flush(keys, cids):
        (key, cid), links, member = collapse(np.concatenate(keys), np.concatenate(cids))
        yield from _emit(links, member, parts)
        to = ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # key is sorted, and so is this
        cuts = np.searchsorted(to, np.arange(parts + 1))
        own = np.flatnonzero(np.diff(cuts))
        kb, cb = key.tobytes(), cid.tobytes()
        yield _packed(own, [kb[8 * cuts[p] : 8 * cuts[p + 1]] for p in own], [cb[8 * cuts[p] : 8 * cuts[p + 1]] for p in own], [None] * len(own), [None] * len(own), _ENTRY)

    def work(batches):
        keys, cids, held = [], [], 0
        for b in batches:
            data, off = B.raw(b.column("keys"))
            k = np.frombuffer(data.tobytes(), np.uint64)
            keys.append(k)
            cids.append(np.repeat(b.column("cid").to_numpy(), np.diff(off) // 8))
            held += len(k)
            if held >= batch_keys:
                yield from flush(keys, cids)
                keys, cids, held = [], [], 0
        if held:
            yield from flush(keys, cids)

    return work


def _reduce(batches):
    """All entries of this task's parts: links and members of shared buckets; those that the dealing found pass through."""
    keys, cids = [], []
    for b in batches:
        entry = pc.equal(b.column("kind"), _ENTRY)
        found = b.filter(pc.invert(entry))
        if found.num_rows:
            yield found
        b = b.filter(entry)
        for k, c in zip(b.column("keys").to_pylist(), b.column("cids").to_pylist(), strict=True):
            keys.append(np.frombuffer(k, np.uint64))
            cids.append(np.frombuffer(c, np.int64))
    if keys:
        key, cid = np.concatenate(keys), np.concatenate(cids)
        keys.clear()
        cids.clear()
        _, links, member = collapse(key, cid)
        del key, cid
        yield from _emit(links, member)


def _unpack(batches):
    for b in batches:
        for k, c in zip(b.column("keys").to_pylist(), b.column("cids").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.int64)), pa.array(np.frombuffer(c, np.int64))], ["key", "cid"])


def _sets_of(k: int):
    def work(batches):
        for batch in batches:
            for (_i, _j), tokens, first, cid, check in _token_sets(batch.column("text"), k):
                blob = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer((first * 8).tobytes()), pa.py_buffer(tokens.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([B.longs(cid), B.longs(check), blob], ["raw", "chk", "tokens"])

    return work


def _verify(percent: int):
    def work(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            x, y = b.column("ta"), b.column("tb")
            for i in range(b.num_rows):
                s, t = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                if min(len(s), len(t)) * 100 < percent * max(len(s), len(t)):
                    continue
                both = np.concatenate((s, t))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                union = len(both) - common
                ok[i] = 100 * common >= percent * union
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok)], ["a", "b", "ok"])

    return work


def _compare(percent: int):
    """Rows sorted by (pair, side): the sets of two chunks, or of one; a spanning forest of links."""

    def links(names, sets, side):
        n = np.array([len(t) for t in sets])
        rows = np.repeat(np.arange(len(sets)), n)
        token, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rows, col = rows[df[col] > 1], col[df[col] > 1]
        _, col = np.unique(col, return_inverse=True)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        common = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(col, kind="stable")
        rows, col = rows[order], col[order]
        width = int(col[-1]) + 1 if len(col) else 0
        for lo in range(0, width, 2048):
            i, j = np.searchsorted(col, (lo, lo + 2048))
            m = np.zeros((len(sets), min(2048, width - lo)), np.float32)
            m[rows[i:j], col[i:j] - lo] = 1
            common += m[left] @ m[right].T
        common = np.rint(common).astype(np.int64)
        i, j = np.nonzero(100 * common >= percent * (n[left][:, None] + n[right][None, :] - common))
        up = {}

        def find(x):
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for x, y in zip(left[i].tolist(), right[j].tolist(), strict=True):
            fx, fy = find(x), find(y)
            if fx != fy:
                up[fx] = fy
                yield names[x], names[y]

    def work(batches):
        pair, names, sets, side = None, [], [], []

        def done():
            if len(sets) > 1:
                found = list(links(names, sets, np.array(side)))
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            t = batch.column("tokens")
            for i, (p, c, s) in enumerate(zip(batch.column("pair").to_pylist(), batch.column("cid").to_pylist(), batch.column("side").to_pylist(), strict=True)):
                if p != pair:
                    yield from done()
                    pair, names, sets, side = p, [], [], []
                names.append(c)
                sets.append(np.frombuffer(t[i].as_buffer().to_pybytes(), np.uint64))
                side.append(s)
        yield from done()

    return work


def _blocks(named: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """All links (a, b) within buckets that are in several components, as forests.

    named: (key, cid, comp) of shared buckets.
    """
    spark = named.sparkSession
    split = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("cid").alias("hub"), F.count("*").alias("m")).where("lo <> hi and m > 2")
    star = named.join(split.select("key", "hub"), "key").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    block = components(star, "a", "b", stage).select(F.col("node").alias("cid"), F.col("component").alias("block"))
    # similar sets are at most two size classes apart
    # sets are dealt into chunks by their sizes alone; the sets themselves move once, by the class
    grade = F.floor(F.log(F.col("bytes") / 8) * (2 / math.log(100 / percent))).cast("int")
    placed = stage(block.join(tokens.select("cid", F.octet_length("tokens").alias("bytes")), "cid").withColumn("grade", grade), "placed")
    cut = placed.groupBy("block", "grade").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("bytes") / CHUNK_BYTES)).cast("int").alias("cuts"))
    chunk = F.xxhash64("block", "grade", F.pmod(F.xxhash64("cid"), F.col("cuts")))
    dealt = placed.join(cut, ["block", "grade"]).select("block", "grade", "cid", chunk.alias("chunk"))
    held = stage(dealt.join(might_contain(tokens, F.col("cid"), dealt, F.col("cid")), "cid"), "blocks")
    chunks = held.select("block", "grade", "chunk").distinct()
    c, d = chunks.alias("c"), chunks.alias("d")
    near = (F.col("d.grade").between(F.col("c.grade"), F.col("c.grade") + 3)) & ((F.col("d.grade") > F.col("c.grade")) | (F.col("d.chunk") >= F.col("c.chunk")))
    pairs = stage(c.join(d, (F.col("c.block") == F.col("d.block")) & near).select(F.col("c.chunk").alias("x"), F.col("d.chunk").alias("y"), F.xxhash64("c.chunk", "d.chunk").alias("pair")), "chunk-pairs")
    ends = F.array(F.struct(F.col("x").alias("chunk"), F.lit(0).alias("side")), F.struct(F.col("y").alias("chunk"), F.lit(1).alias("side")))
    met = pairs.select("pair", F.inline(F.when(F.col("x") == F.col("y"), F.slice(ends, 1, 1)).otherwise(ends)))
    both = held.join(met, "chunk").select("pair", "side", "cid", "tokens").repartition(partitions(spark), "pair").sortWithinPartitions("pair", "side", "cid")
    return mapped(both, _compare(percent), "a long, b long")


def _shared(full: DataFrame, parts: int) -> DataFrame:
    """Links and members of the keys that several classes share; the entries move once and are never written."""
    dealt = mapped(full.select("cid", "keys").where(F.octet_length("keys") > 0), _deal(parts, DEALT), _PACKED)
    return mapped(dealt.repartition(parts, "part"), _reduce, _PACKED)


def _named(slim: DataFrame, shared: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(cid, component_id) of every class with shingles, as a written table."""
    links = shared.where(F.col("kind") == _LINK).select("a", "b").distinct()
    members = mapped(shared.where(F.col("kind") == _MEMBER).select("keys", "cids"), _unpack, "key long, cid long").distinct()
    # the sets of candidates, read anew
    some = stage(classes.select("cid", "raw", "chk", "top").join(links.select(F.col("a").alias("cid")).union(links.select("b")).distinct(), "cid"), "candidates")
    wanted = might_contain(slim, F.col("id"), some, F.col("top"))
    # a set once for each full name; the join keeps the partitions that this made
    sets = mapped(wanted.select("text"), _sets_of(k), "raw long, chk long, tokens binary").dropDuplicates(["raw", "chk"])
    tokens = stage(sets.join(some.select("raw", "chk", "cid"), ["raw", "chk"]).select("cid", "tokens"), "tokens")

    def verified(pairs: DataFrame) -> DataFrame:
        one = pairs.join(tokens.select(F.col("cid").alias("a"), F.col("tokens").alias("ta")), "a")
        two = one.join(tokens.select(F.col("cid").alias("b"), F.col("tokens").alias("tb")), "b")
        return stage(mapped(two.select("a", "b", "ta", "tb"), _verify(percent), "a long, b long, ok boolean"), "verified")

    found = verified(links).where("ok").select("a", "b")
    comp = components(found, "a", "b", stage)
    named = members.join(comp.select(F.col("node").alias("cid"), "component"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("comp"))
    more = stage(_blocks(stage(named, "named"), tokens, percent), "block-links")
    if not more.isEmpty():
        comp = components(found.unionByName(more), "a", "b", stage)
    top = classes.join(comp.select(F.col("node").alias("cid"), "component"), "cid", "left").select("cid", "top", F.coalesce("component", "cid").alias("comp"))
    least = top.groupBy("comp").agg(F.min("top").alias("component_id"))
    return stage(top.join(least, "comp").select("cid", "component_id"), "names", lasting=True)


def _told_apart(full: DataFrame) -> DataFrame:
    """The rows, each class under a 64-bit name ``cid`` of its own; ``raw`` is the first half of the full name.

    Of classes that share a first half, all but one are renamed by a hash of
    the full name.  Shared halves are as rare as 64-bit collisions.
    """
    full = full.withColumn("raw", F.col("cid"))
    while True:
        twice = full.groupBy("cid").agg(F.min("chk").alias("least"), F.max("chk").alias("most")).where("least <> most").select("cid", "least")
        if twice.isEmpty():
            return full
        twice = stage(twice, "shared-names")
        renamed = F.when(F.col("least").isNotNull() & (F.col("chk") != F.col("least")), F.xxhash64("cid", "chk")).otherwise(F.col("cid"))
        full = full.join(twice, "cid", "left").withColumn("cid", renamed).drop("least")


def _joined(slim: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, n, component_id) of rows (id, text); ids are of any type with an order."""
    spark = slim.sparkSession
    kind = slim.schema["id"].dataType.simpleString()
    with passing(spark):
        # the keys are most of a row, and pass as soon as they are dealt
        with passing(spark):
            rows = stage(mapped(slim, _index(k, percent, 1 << 17), f"id {kind}, cid long, chk long, n long, keys binary"), "sets")
            full = _told_apart(rows.where("n > 0"))
            entries = int(full.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8
            shared = stage(_shared(full, max(partitions(spark), -(-entries // ENTRIES))), "shared", lasting=1)
            few = stage(full.select("id", "n", "cid", "raw", "chk"), "classes", lasting=2)
            none = stage(rows.where("n = 0").select("id", "n"), "blank", lasting=2)
        classes = few.groupBy("cid").agg(F.min("raw").alias("raw"), F.min("chk").alias("chk"), F.min("id").alias("top"))
        name = _named(slim, shared, classes, k, percent)
    linked = few.select("id", "n", "cid").join(name, "cid").select("id", "n", "component_id")
    return linked.unionByName(none.select("id", "n", F.col("id").alias("component_id")))


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Sets link when 100 * intersection >= percent * union.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _joined(slim, k, percent).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of the smallest identifier stays.

    A null identifier ranks behind all others.  Rows are known by identifier
    and 128 bits of their text's SHA-256; of rows equal in both, one stays: the
    least by a hash of the whole row.  Rows without words have no duplicates
    but such.  All columns pass through, whatever their names.
    """
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    body = F.coalesce(text, F.lit(""))
    name = F.struct(ident.isNull().alias("nil"), ident.alias("id"), F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("text"))
    with passing(docs.sparkSession):
        linked = stage(_joined(docs.select(name.alias("id"), text.alias("text")), k, percent).select("id", "component_id"), "joined", lasting=True)
    # rows that share a component, with whether their name is the one that stays
    several = linked.groupBy("component_id").agg(F.count("*").alias("m")).where("m > 1")
    told = stage(linked.join(several, "component_id").groupBy("id").agg(F.first(F.col("id") == F.col("component_id")).alias("stays")), "near-copies")
    rows = marked(docs, name, told, F.col("id"))
    maybe = rows.where("may").join(told, F.col("key") == F.col("id"), "left")
    alone = maybe.where("stays is null").select("row")
    first = maybe.where("stays").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return rows.where("not may").select("row").unionByName(alone).unionByName(first).select(*unpacked(docs))
