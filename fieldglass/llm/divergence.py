"""Divergence of sources: how a source's words differ from other sources' and from its language's.

Words are counted by (language, source, term) in tasks of bounded batches,
and the counts are added up in Spark.  A language keeps the terms that enough
of its documents have.  Its kept terms are dealt into blocks; a block and the
language's groups make one dense int64 matrix of counts, a tile, with a row for
each group and one for the language.  A tile gives the sum of the divergence
over its terms for each pair of groups, by broadcasting rows against rows, and
each group's best terms; partial sums are added and partial best lists merged
in Spark.  With more than ``SIDE`` groups in a language, a tile holds two
chunks of groups, so its size is bounded by constants whatever the input.

With N the occurrences of all V kept terms in a group, a term with n of them
has p = 1 + floor(10^9 (n + 2) / (N + 2 V)); the divergence of two such numbers
is floor((p - q)^2 / (p + q)).  All of it is exact in 64 bits while N + 2 V is below
9 * 10^15: the quotient is found by long division in three digits of a thousand.

Defined results: null text, language and source count as ''; a group without
kept terms has all counts 0; each row is a document, repeated rows too; a
language without kept terms gives pairs of value 0 and no terms; an empty
table gives no rows; a text's length is not bounded; ties rank by the item's
UTF-8 bytes; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.llm import _bytes as B
from fieldglass.llm._shared import mapped, passing, stage

#: Kept terms of a tile on average; groups of a chunk on average.
TERMS, SIDE = 512, 128
#: Bytes of texts whose words are counted together, unless one text is longer.
COUNTED = 12 << 20
#: Cells of a broadcast difference.
CELLS = 1 << 20

_COUNT = "lang string, source string, term string, n long, docs long"


def _words(data: np.ndarray, offsets: np.ndarray):
    """(words as an Arrow column, each word's row): runs of letters, A-Z in lower case."""
    starts, ends, first = B.spans(data, offsets, B.NO_LETTER)
    letters = B.FOLD[data[~B.NO_LETTER[data]]]
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(letters.tobytes())])
    return words, np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def _tally(langs: list[str], sources: list[str], data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """Occurrences and documents by (lang, source, term); and a row without term for each group."""
    groups: dict[tuple[str, str], int] = {}
    group = np.array([groups.setdefault(g, len(groups)) for g in zip(langs, sources, strict=True)], np.int64)
    words, row = _words(data, offsets)
    coded = words.dictionary_encode()
    term, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    del words, coded
    key = group[row] * max(1, len(terms)) + term
    order = np.argsort(key, kind="stable")  # rows stay in order within a key
    key, row = key[order], row[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    start = np.flatnonzero(fresh)
    n = np.diff(np.append(start, len(key)))
    fresh[1:] |= row[1:] != row[:-1]
    docs = np.add.reduceat(fresh.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    at = key[start]
    own = np.concatenate((np.arange(len(groups)), at // max(1, len(terms))))
    text = pa.concat_arrays([pa.nulls(len(groups), pa.large_binary()), terms.take(pa.array(at % max(1, len(terms))))]).cast(pa.binary()).cast(pa.string())
    zero = np.zeros(len(groups), np.int64)
    name = lambda i: pa.array([g[i] for g in groups], pa.string()).take(pa.array(own))
    return pa.RecordBatch.from_arrays([name(0), name(1), text, pa.array(np.concatenate((zero, n))), pa.array(np.concatenate((zero, docs)))], ["lang", "source", "term", "n", "docs"])


def _count(batches):
    held: list[tuple] = []
    size = 0

    def flush():
        langs, sources = [x for h in held for x in h[0]], [x for h in held for x in h[1]]
        data = np.concatenate([h[2] for h in held])
        ends = np.cumsum([0, *(len(h[2]) for h in held)])
        offsets = np.concatenate([[0], *(h[3][1:] + e for h, e in zip(held, ends[:-1], strict=True))]).astype(np.int64)
        out = _tally(langs, sources, data, offsets)
        for at in range(0, out.num_rows, 1 << 16):
            yield out.slice(at, 1 << 16)

    for b in batches:
        data, off = B.raw(b.column("text"))
        langs, sources = b.column("lang").to_pylist(), b.column("source").to_pylist()
        for i, j in B.pieces(off, COUNTED):
            own = data[off[i] : off[j]]
            if held and size + len(own) > COUNTED:
                yield from flush()
                held, size = [], 0
            held.append((langs[i:j], sources[i:j], own, off[i : j + 1] - off[i]))
            size += len(own)
    if held:
        yield from flush()


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """p of each count (rows by columns), with the rows' totals and the number of kept terms; exact, see above."""
    rest = counts + 2
    below = np.maximum(total + 2 * kept, 1)[:, None]
    out = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // below
        rest -= digit * below
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _pair_sums(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums over the columns of every row of ``left`` against every row of ``right``."""
    out = np.zeros((len(left), len(right)), np.int64)
    step = max(1, CELLS // max(1, right.size))
    for at in range(0, len(left), step):
        out[at : at + step] = divergence(left[at : at + step, None, :], right[None, :, :]).sum(axis=2)
    return out


def _tile(top: int):
    """Rows of one tile: groups (no term), terms of the language (no source), and counts."""

    def work(key, rows):
        x, y = key[2].as_py(), key[3].as_py()
        source, term = rows.column("source").to_pylist(), rows.column("term").to_pylist()
        n, chunk, kept = (rows.column(c).to_numpy() for c in ("n", "chunk", "kept"))
        by = lambda s: s.encode()
        groups = sorted(((int(chunk[i]), s, int(n[i])) for i, s in enumerate(source) if s is not None and term[i] is None), key=lambda g: (g[0], by(g[1])))
        terms = sorted({t for i, t in enumerate(term) if t is not None and source[i] is None}, key=by)
        g_at, t_at = {g[1]: i for i, g in enumerate(groups)}, {t: i for i, t in enumerate(terms)}
        counts = np.zeros((len(groups) + 1, len(terms)), np.int64)
        whole = 0
        for i, (s, t) in enumerate(zip(source, term, strict=True)):
            if t is not None:
                counts[g_at[s] if s is not None else len(groups), t_at[t]] = n[i]
            elif s is None:
                whole = int(n[i])
        p = shares(counts, np.array([*(g[2] for g in groups), whole], np.int64), int(kept[0]))
        first = np.array([g[0] == x for g in groups], bool)
        a, b = np.flatnonzero(first), np.flatnonzero(first if x == y else ~first)
        sums = _pair_sums(p[a], p[b])
        i, j = np.nonzero(np.triu(np.ones(sums.shape, bool), 1) if x == y else np.ones(sums.shape, bool))
        out = [[groups[k][1] for k in a[i]], ["pair"] * len(i), [groups[k][1] for k in b[j]], sums[i, j].tolist()]
        if x == y:
            for k in a.tolist():
                over = np.flatnonzero((counts[k] > 0) & (p[k] > p[-1]))
                f = divergence(p[k, over], p[-1, over])
                best = np.lexsort((over, -f))[:top]  # terms are in order
                for col, more in zip(out, ([groups[k][1]] * len(best), ["term"] * len(best), [terms[t] for t in over[best]], f[best].tolist()), strict=True):
                    col.extend(more)
        columns = [pa.array(c, pa.int64() if i == 3 else pa.string()) for i, c in enumerate(out)]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(out[0]), pa.string()), *columns], ["lang", "source", "part", "item", "value"])

    return work


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value (long), rank (int).

    Part ``pair``: the item is another source of the language and the value
    the divergence of the two, summed over the kept terms.  Part ``term``: the
    ``top`` terms of which the source has more than its language.
    """
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    slim = docs.select(named(lang_col).alias("lang"), named(source_col).alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"))
    with passing(docs.sparkSession):
        counts = stage(mapped(slim, _count, _COUNT).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
        vocabulary = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        vocabulary = stage(vocabulary.where(F.col("docs") >= least_docs).select("lang", "term", "n"), "vocabulary")
        kept = stage(counts.where("term is not null").select("lang", "source", "term", "n").join(vocabulary.select("lang", "term"), ["lang", "term"]), "kept")
        # a row for each group, with its language's figures
        groups = counts.where("term is null").select("lang", "source").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
        langs = groups.groupBy("lang").agg(F.count("*").alias("g")).join(vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("whole")), "lang", "left")
        langs = langs.select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("whole", F.lit(0)).alias("whole"), F.ceil(F.col("g") / SIDE).cast("int").alias("chunks"))
        langs = stage(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS)).cast("int")), "langs")
        in_chunk = F.pmod(F.xxhash64("source"), F.col("chunks")).cast("int")
        # the pairs of chunks (x <= y) that a chunk is in
        met = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(F.col("chunk"), o).alias("x"), F.greatest(F.col("chunk"), o).alias("y")))
        every = F.flatten(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.transform(F.sequence(i, F.col("chunks") - 1), lambda j: F.struct(i.alias("x"), j.alias("y")))))
        block, all_blocks = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        none = F.lit(None).cast("string")
        told = langs.select("lang", "kept", "chunks", "blocks")
        cols = ["lang", "block", "x", "y", "source", "term", "n", "chunk", "kept"]
        parts = [
            kept.join(told, "lang").withColumn("block", block).withColumn("chunk", in_chunk).select("*", F.inline(met)),
            groups.withColumn("n", F.coalesce("n", F.lit(0))).join(told, "lang").withColumn("term", none).withColumn("block", all_blocks).withColumn("chunk", in_chunk).select("*", F.inline(met)),
            vocabulary.join(told, "lang").withColumn("source", none).withColumn("block", block).withColumn("chunk", F.lit(-1)).select("*", F.inline(every)),
            langs.withColumn("n", F.col("whole")).withColumn("source", none).withColumn("term", none).withColumn("block", all_blocks).withColumn("chunk", F.lit(-1)).select("*", F.inline(every)),
        ]
        rows = parts[0].select(*cols)
        for p in parts[1:]:
            rows = rows.unionByName(p.select(*cols))
        found = stage(rows.groupBy("lang", "block", "x", "y").applyInArrow(_tile(top), "lang string, source string, part string, item string, value long"), "tiles", lasting=True)
    sums = found.where(F.col("part") == "pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = sums.select("lang", "value", F.inline(both)).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.where(F.col("part") == "term").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))
