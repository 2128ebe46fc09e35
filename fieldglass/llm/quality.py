"""Document quality by a linear-chain conditional random field on lines.

Every line is good or bad.  Its features are binned measures of the line (its
length and words; shares of letters, capitals, digits and symbols; repeated
words; whether the line occurs again in its text) and the same of the lines
before and behind it; transitions are learned.  Training lines take their
text's label.  Forward-backward marginals, weighted by the lines' lengths, add
up to a text's share of good lines, and a logistic fit on the training texts
turns it, with the share's extremes, into the probability of label 1.

Defined results: a null or blank text has no lines and a share of 0; repeated
rows get equal scores; a text of any length is scored whole, in memory in proportion to it;
of contradicting labels of one identifier the larger counts; an empty table
gives no rows; without labels of both kinds the score is the labels' mean (0.5
without any); other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm import _bytes as B
from fieldglass.llm import _crf
from fieldglass.llm._sample import bounded, fitted, texts_of
from fieldglass.llm._shared import mapped

#: Bound of the training sample, bins of a measure, and training rounds.
TEXTS, BINS, ROUNDS = 2000, 10, 120

_LINE_END = np.zeros(256, bool)
_LINE_END[[0x0A, 0x0D]] = True


def _class(*codes: int) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(codes)] = True
    return t


_UPPER = _class(*range(65, 91))
_LETTER = ~B.NO_LETTER
_DIGIT = _class(*range(48, 58))
_COMMON = _class(*map(ord, ".,;:'\"-()?"))
_SYMBOL = ~_LETTER & ~_DIGIT & ~_COMMON & ~B.SPACE
_STOP = _class(*map(ord, ".!?"))


def measures(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(measures of each line, lengths, each row's first line)."""
    starts, ends, first = B.spans(data, off, _LINE_END)
    size = (ends - starts).astype(float)
    if not len(starts):
        return np.zeros((0, 11)), size, first

    def count(flags):
        total = np.zeros(len(data) + 1, np.int32 if len(data) < 2**31 else np.int64)
        np.cumsum(flags, out=total[1:])
        return (total[ends] - total[starts]).astype(float)

    upper = _UPPER[data]
    lead = np.zeros(len(data), bool)  # capitals of Latin-1 in UTF-8
    if len(data) > 1:
        lead[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    letters = count(_LETTER[data])
    ws, we, _ = B.spans(data, off)
    hashed = B.hashes(data, ws, we)
    line = np.searchsorted(starts, ws, "right") - 1
    begin = np.searchsorted(ws, starts)
    words = np.diff(np.append(begin, len(ws))).astype(float)
    again = np.zeros(len(ws), bool)
    if len(ws) > 1:
        same = line[1:] == line[:-1]
        again[1:] = same & (hashed[1:] == hashed[:-1])
        order = np.argsort(B.mix(hashed ^ line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
        dup = np.zeros(len(ws), bool)
        dup[order[1:]] = (hashed[order[1:]] == hashed[order[:-1]]) & (line[order[1:]] == line[order[:-1]])
    else:
        dup = again
    per = lambda x: np.bincount(line, weights=x, minlength=len(starts))
    whole = B.hashes(data, starts, ends)
    row = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    key = B.mix(whole ^ B.mix(row.astype(np.uint64)))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    share = lambda x, of: x / np.maximum(of, 1)
    m = np.stack(
        [
            np.log1p(size),
            np.log1p(words),
            share(letters, size),
            share(count(upper | lead), words),
            share(count(_DIGIT[data]), size),
            share(count(_SYMBOL[data]), words),
            share(letters, words),
            share(per(dup), words),
            share(per(again), words),
            np.minimum(times[back] - 1, 5).astype(float),
            share(count(_STOP[data]), words),
        ],
        axis=1,
    )
    return m, size, first


@dataclass
class Model:
    edges: list[np.ndarray]
    weights: np.ndarray | None
    trans: np.ndarray
    start: np.ndarray
    fit: np.ndarray
    mean: float

    def bins(self, m: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, m[:, i], "right") + i * BINS for i, e in enumerate(self.edges)], axis=1)

    def emit(self, own: np.ndarray, flags: np.ndarray) -> np.ndarray:
        width = len(self.edges) * BINS
        none = np.full((1, own.shape[1]), 3 * width)
        before = np.concatenate((none, own[:-1] + width))
        before[flags] = 3 * width
        behind = np.concatenate((own[1:] + 2 * width, none))
        behind[np.append(flags[1:], True)] = 3 * width
        self.index = np.concatenate((own, before, behind), axis=1)
        return self.weights[self.index].sum(axis=1)

    def shares(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Each row's inputs to the logistic fit."""
        m, size, first = measures(data, off)
        n = np.diff(first)
        if not len(m):
            return np.stack((np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n))), axis=1)
        flags = np.zeros(len(m), bool)
        flags[first[:-1][n > 0]] = True
        good = _crf.forward_backward(self.emit(self.bins(m), flags), flags, self.trans, self.start)[:, 1]
        total = np.concatenate(([0.0], np.cumsum(good * size)))
        length = np.concatenate(([0.0], np.cumsum(size)))
        q = (total[first[1:]] - total[first[:-1]]) / np.maximum(length[first[1:]] - length[first[:-1]], 1e-9)
        q = np.where(n > 0, np.clip(q, 0, 1), 0)
        return np.stack((q, np.clip(np.log((q + 1e-3) / (1 - q + 1e-3)), -7, 7), np.ones(len(q))), axis=1)

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(off) - 1, self.mean)
        return 1 / (1 + np.exp(-np.clip(self.shares(data, off) @ self.fit, -60, 60)))


def fit(texts: list[str], good: list[int], rounds: int = ROUNDS) -> Model:
    y = np.array(good, float)
    mean = float(y.mean()) if len(y) else 0.5
    model = Model([], None, np.zeros((2, 2)), np.zeros(2), np.zeros(3), mean)
    data, off = B.raw(pa.array(texts, pa.string()))
    m, size, first = measures(data, off)
    if not len(m) or len(set(good)) < 2:
        return model
    model.edges = [np.unique(np.quantile(m[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(m.shape[1])]
    width = len(model.edges) * BINS
    model.weights = np.zeros((3 * width + 1, 2))
    n = np.diff(first)
    truth = np.repeat(np.array(good), n)
    flags = np.zeros(len(m), bool)
    flags[first[:-1][n > 0]] = True
    own = model.bins(m)
    inner = np.flatnonzero(~flags)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (truth[inner - 1], truth[inner]), 1.0)
    gold = np.eye(2)[truth]
    params = {"weights": model.weights, "trans": model.trans, "start": model.start}
    adam = _crf.Adam(0.05)
    for _ in range(rounds):
        gamma, expected = _crf.forward_backward(model.emit(own, flags), flags, model.trans, model.start, True)
        d = gold - gamma
        g = np.stack([np.bincount(model.index.ravel(), weights=np.repeat(d[:, j], model.index.shape[1]), minlength=3 * width + 1) for j in (0, 1)], axis=1)
        g[-1] = 0
        # transitions are learned with a strong prior: whole texts share a label in training, lines of new texts need not
        adam.step(params, {"weights": g - 2.0 * model.weights, "trans": (pairs - expected) / 20 - 5.0 * model.trans, "start": d[flags].sum(axis=0) - 2.0 * model.start})
    x = model.shares(data, off)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1.0, 0.1, 0.01])
        w += np.linalg.solve(h, x.T @ (y - p) - np.array([1.0, 0.1, 0.01]) * w)
    model.fit = w
    del model.index
    return model


def _score(model: Model):
    def work(batches):
        for b in batches:
            data, off = B.raw(b.column("text"))
            out = [model.score(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in B.pieces(off)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return work


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", texts: int = TEXTS) -> Model:
    """Fit on a bounded sample of labelled rows; both tables have doc_id."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("good"))
    ids = bounded(known, texts, "good")
    slim = docs.select("doc_id", F.col(f"`{text_col}`").cast("string").alias("text"))
    model = fitted(texts_of(slim, ids).select("doc_id", "good", F.coalesce("text", F.lit("")).alias("text")), _fit_rows)
    return model if model is not None else fit([], [])


def _fit_rows(rows: list[dict]) -> Model:
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in rows], [r["good"] for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return mapped(slim, _score(model), "doc_id long, score double")
