"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic texts P and unlabelled texts U train a linear classifier g on
word presence with the sigmoid loss and the risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)),

whose second term, the risk on negatives, is corrected by the class prior and
kept from going negative: where a step would make it so, the step goes the
other way.  Labels of non-toxic rows are used for the prior alone.

Words are runs of letters, A-Z lower-cased; a word's stems are the word and
its beginnings of four to six bytes, since insults are inflected and compounded.
A text's features are its stems, each at the levels that it reaches: that the
stem occurs, that it does so two, three or five times, and that it does so
twice and in every 128th or every 64th word; a stem that clean texts hold now
and then may still be an insult where it is dense.
The vocabulary are all features that are over-represented in P.  Scoring hashes
the words of whole texts in numpy and looks them up in the sorted vocabulary.

Defined results: a null or empty text gets the score of a text without known
words; repeated rows get equal scores; an empty table gives no rows; without
any positive label every score is the prior; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm import _bytes as B
from fieldglass.llm._sample import bounded, texts_of
from fieldglass.llm._shared import mapped, passing, stage

#: Bounds of the training sample; it bounds the vocabulary, too.
POSITIVES, UNLABELLED = 3000, 9000
#: A feature is known if so many confirmed texts have it (settings by cross-validation on the learning folds).
LEAST = 3
#: ... and it is so much (log) more frequent among them.
LIFT = 1.0
BEGINNINGS = (4, 5, 6)


def levels(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(n, LEVELS) flags: the levels that ``count`` occurrences among ``words`` words reach."""
    twice = count >= 2
    return np.stack((count >= 1, twice, count >= 3, count >= 5, twice & (128 * count >= words), twice & (64 * count >= words)), axis=1)


#: A feature is a stem's hash with its level in the low bits.
LEVELS, LOW = 6, np.uint64(7)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of features
    weights: np.ndarray  # one for each feature
    bias: float

    def __post_init__(self) -> None:
        self.stems = np.unique(self.words & ~LOW)
        self.door = np.zeros(1 << 16, bool)
        self.door[(self.stems >> np.uint64(3)) & np.uint64(0xFFFF)] = True
        self.table = np.zeros((len(self.stems), LEVELS))
        if len(self.words):
            self.table[np.searchsorted(self.stems, self.words & ~LOW), (self.words & LOW).astype(int)] = self.weights

    def lookup(self, stems: np.ndarray) -> np.ndarray:
        """Index of each hash among the known stems, or -1."""
        out = np.full(len(stems), -1)
        if len(self.stems):
            may = np.flatnonzero(self.door[(stems >> np.uint64(3)) & np.uint64(0xFFFF)])
            at = np.minimum(np.searchsorted(self.stems, stems[may]), len(self.stems) - 1)
            out[may] = np.where(self.stems[at] == stems[may], at, -1)
        return out

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability for each row."""
        found, first, words = stems_of(data, off)
        n = len(words)
        g = np.full(n, self.bias)
        at = self.lookup(found)
        known = np.flatnonzero(at >= 0)
        if len(known):
            rows = np.searchsorted(first, known, "right") - 1
            pair, count = np.unique(rows * len(self.stems) + at[known], return_counts=True)
            row, stem = pair // len(self.stems), pair % len(self.stems)
            np.add.at(g, row, (self.table[stem] * levels(count, words[row])).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(g, -60, 60)))


def stems_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words' stems, first stem of each row, words of each row)."""
    starts, ends, first = B.spans(data, off, B.NO_LETTER)
    size = ends - starts
    sets, where = [B.hashes(data, starts, ends)], [np.arange(len(starts))]
    for n in BEGINNINGS:
        own = np.flatnonzero(size > n)
        sets.append(B.mix(B.hashes(data, starts[own], starts[own] + n) + np.uint64(n)))
        where.append(own)
    order = np.argsort(np.concatenate(where), kind="stable")
    return np.concatenate(sets)[order] & ~LOW, np.searchsorted(np.concatenate(where)[order], first), np.diff(first)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each row's distinct features, sorted; the rows' first positions)."""
    found, first, words = stems_of(data, off)
    out, size = [], np.zeros(len(off), np.int64)
    for r in range(len(off) - 1):
        stem, count = np.unique(found[first[r] : first[r + 1]], return_counts=True)
        reached = levels(count, np.full(len(count), words[r]))
        own = (stem[:, None] | np.arange(LEVELS, dtype=np.uint64))[reached]
        out.append(own)
        size[r + 1] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(size)


def _distinct_features(batches):
    for b in batches:
        data, off = B.raw(b.column("text"))
        for i, j in B.pieces(off):
            own, part = off[i : j + 1] - off[i], data[off[i] : off[j]]
            found, begin = features(part, own)
            blob = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((begin * 8).tobytes()), pa.py_buffer(found.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("positive").slice(i, j - i), blob], ["positive", "features"])


def _counted(batches):
    """For each batch: its features with their numbers of confirmed and of unlabelled texts."""
    for b in batches:
        data, off = B.raw(b.column("features"))
        found = np.frombuffer(data.tobytes(), np.uint64)
        yes = np.repeat(b.column("positive").to_numpy(zero_copy_only=False), np.diff(off) // 8)
        feature, back = np.unique(found, return_inverse=True)
        p = np.bincount(back[yes], minlength=len(feature))
        u = np.bincount(back[~yes], minlength=len(feature))
        yield pa.RecordBatch.from_arrays([B.longs(feature), pa.array(p), pa.array(u)], ["feature", "p", "u"])


def _placed(vocabulary: np.ndarray):
    def work(batches):
        for b in batches:
            blobs = [_known(vocabulary, np.frombuffer(x, np.uint64)).astype(np.int32).tobytes() for x in b.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("positive"), pa.array(blobs, pa.binary())], ["positive", "places"])

    return work


def _kept(p, u, positives: int, unlabelled: int) -> np.ndarray:
    """Which features are known, from their numbers of confirmed and of unlabelled texts."""
    lift = np.log((p + 0.5) / positives) - np.log((u + 0.5) / unlabelled)
    return (p >= min(LEAST, positives)) & (lift > LIFT)


def _known(vocabulary: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Places in the vocabulary of those features that are in it."""
    if not len(vocabulary):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
    return at[vocabulary[at] == found]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, **settings) -> Model:
    """Train on sets of features."""
    if not positive or not unlabelled:
        return untrained(prior)
    vocabulary, p = np.unique(np.concatenate(positive), return_counts=True)
    every = np.concatenate(unlabelled)
    every.sort()
    u = np.searchsorted(every, vocabulary, "right") - np.searchsorted(every, vocabulary, "left")
    vocabulary = vocabulary[_kept(p, u, len(positive), len(unlabelled))]
    places = lambda sets: [_known(vocabulary, s) for s in sets]
    return fit_places(vocabulary, places(positive), places(unlabelled), prior, **settings)


def untrained(prior: float) -> Model:
    return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else -20.0)


def fit_places(vocabulary: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 500, rate: float = 0.1, sparse: float = 3e-5) -> Model:
    """Train on sets of places in the vocabulary."""

    def pairs(sets):
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets).astype(np.int64)

    (pr, pw), (ur, uw) = pairs(positive), pairs(unlabelled)
    np_, nu, v = len(positive), len(unlabelled), len(vocabulary)
    x = np.zeros(v + 1)
    x[v] = -1.0
    m1, m2 = np.zeros(v + 1), np.zeros(v + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def back(rows, words, d):
        g = np.bincount(words, weights=d[rows], minlength=v)
        return np.append(g, d.sum())

    for t in range(1, steps + 1):
        gp = np.bincount(pr, weights=x[pw], minlength=np_) + x[v]
        gu = np.bincount(ur, weights=x[uw], minlength=nu) + x[v]
        lu, lp = sig(gu), sig(gp)  # losses as negatives
        d_neg = back(ur, uw, lu * (1 - lu) / nu) - prior * back(pr, pw, lp * (1 - lp) / np_)
        if lu.mean() - prior * lp.mean() >= 0:
            grad = d_neg - prior * back(pr, pw, lp * (1 - lp) / np_)
        else:
            grad = -d_neg
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad * grad
        pace = rate / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        x -= pace * (m1 / (1 - 0.9**t))
        # most words of confirmed texts mean nothing: a sparse solution
        x = np.sign(x) * np.maximum(np.abs(x) - pace * np.append(np.full(v, sparse), 8 * sparse), 0)
    return Model(vocabulary, x[:v], float(x[v]))


def _score(model: Model):
    def work(batches):
        for b in batches:
            data, off = B.raw(b.column("text"))
            out = [model.score(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in B.pieces(off)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return work


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on rows of ``docs`` and ``labels`` (both with doc_id) from the learning folds."""
    known = labels.where(F.col(label_col).isNotNull())
    row = known.agg(F.avg((F.col(label_col) == 1).cast("double"))).first()
    prior = float(row[0] or 0.0)
    p_ids = bounded(known.where(F.col(label_col) == 1).select("doc_id").distinct(), positives).withColumn("positive", F.lit(True))
    u_ids = bounded(docs.select("doc_id"), unlabelled).distinct().withColumn("positive", F.lit(False))
    slim = docs.select("doc_id", F.col(f"`{text_col}`").cast("string").alias("text"))
    with passing(docs.sparkSession):
        sample = stage(mapped(texts_of(slim, p_ids.unionByName(u_ids)).select("positive", "text"), _distinct_features, "positive boolean, features binary"), "toxic-sample")
        sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
        n, m = sizes.get(True, 0), sizes.get(False, 0)
        if not n or not m:
            return untrained(prior)
        # features are counted in Spark; only those that will be known come to the driver
        counts = mapped(sample, _counted, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
        many = counts.where(F.col("p") >= min(LEAST, n)).where(F.log((F.col("p") + 0.5) / n) - F.log((F.col("u") + 0.5) / m) > LIFT)
        vocabulary = np.sort(np.array([r["feature"] for r in many.select("feature").collect()], np.int64).view(np.uint64))
        rows = mapped(sample, _placed(vocabulary), "positive boolean, places binary").collect()
    places = {k: sorted((np.frombuffer(bytes(r["places"]), np.int32) for r in rows if r["positive"] == k), key=lambda a: (len(a), a.tobytes())) for k in (True, False)}
    return fit_places(vocabulary, places[True], places[False], prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return mapped(slim, _score(model), "doc_id long, score double")
