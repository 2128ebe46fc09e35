"""Language identification by a linear-chain conditional random field on words.

A word's features are its affixes and n-grams (windows of one to four bytes of
the lower-cased word between boundary marks) and its place in a lexicon of the
sample's frequent words; labels of neighbouring words are tied by learned
transitions, so the parts of code-switched texts get labels of their own.
Forward-backward gives every word's label distribution; a text's score for a
language is its length-weighted mean over all words of the whole text.

Learning: first words alone, with the text's label for each; then words are
labelled anew by forward-backward, with sticky transitions, in all texts; then
the field learns weights and transitions together.

Defined results: a null text or one without letters is ``und`` with score 0;
an empty table gives no rows; repeated rows get equal results; of languages with
equal scores the first in the labels' order is told; a text of any length is
read whole, in memory in proportion to it; without any labelled text every text is
``und``; columns that are kept pass through under their own names, whatever they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.llm import _bytes as B
from fieldglass.llm import _crf
from fieldglass.llm._sample import bounded, fitted, texts_of
from fieldglass.llm._shared import mapped

#: Bounds of the training sample, hashed windows, and frequency of lexicon words.
TEXTS, WINDOWS, FREQUENT = 1000, 1 << 16, 3
ROUNDS_ALONE, ROUNDS_CHAIN = 18, 10
UNDECIDED = "und"


def _windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window indices of each span, with boundary marks; (index, begin)."""
    n = ends - starts
    padded = n + 2
    begin = np.cumsum(padded) - padded
    total = int(padded.sum())
    own = np.repeat(np.arange(len(n)), padded)
    at = np.arange(total) - begin[own]
    inner = (at > 0) & (at <= n[own])
    text = np.ones(total + 4, np.uint64)
    text[:total][inner] = data[(starts[own] + at - 1)[inner]].astype(np.uint64) + np.uint64(2)
    room = padded[own] - at
    code, found, where = np.zeros(total, np.uint64), [], []
    for w in range(1, 5):
        code = code * np.uint64(0x100000001B3) + text[w - 1 : w - 1 + total]
        ok = np.flatnonzero(room >= w)
        if w == 1:
            ok = ok[inner[ok]]
        found.append((B.mix(code[ok] + np.uint64(w)) & np.uint64(WINDOWS - 1)).astype(np.int64))
        where.append(own[ok])
    index, where = np.concatenate(found), np.concatenate(where)
    order = np.argsort(where, kind="stable")
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(np.bincount(where, minlength=len(n)), out=first[1:])
    return index[order], first


@dataclass
class Model:
    labels: list[str]
    lexicon: np.ndarray  # sorted hashes
    windows: np.ndarray
    words: np.ndarray  # of the lexicon, then one row of zeros
    trans: np.ndarray
    start: np.ndarray

    def known(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(hashed), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashed), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashed, at, len(self.lexicon))

    def emit(self, data, starts, ends, hashed) -> np.ndarray:
        """Log potentials of each word; each distinct word is rated once."""
        own, first, back = np.unique(hashed, return_index=True, return_inverse=True)
        index, begin = _windows(data, starts[first], ends[first])
        rated = _crf.ragged_sum(self.windows, index, begin) + self.words[self.known(own)]
        return rated[back]

    def words_of(self, data: np.ndarray, off: np.ndarray):
        """(marginals of words, their lengths, each row's first word)."""
        starts, ends, first = B.spans(data, off, B.NO_LETTER)
        if not len(starts):
            return np.zeros((0, len(self.labels))), np.zeros(0), first
        flags = np.zeros(len(starts), bool)
        flags[first[:-1][np.diff(first) > 0]] = True
        emit = self.emit(data, starts, ends, B.hashes(data, starts, ends, False))
        return _crf.forward_backward(emit, flags, self.trans, self.start), (ends - starts).astype(float), first


def _low(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def _sum_rows(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)))
    return total[first[1:]] - total[first[:-1]]


def fit(texts: list[str], langs: list[str]) -> Model | None:
    labels = sorted(set(langs))
    if not labels:
        return None
    k = len(labels)
    data, off = B.raw(_low(pa.array(texts, pa.string())))
    starts, ends, first = B.spans(data, off, B.NO_LETTER)
    if not len(starts):
        return None
    hashed = B.hashes(data, starts, ends, False)
    types, at, back, count = np.unique(hashed, return_index=True, return_inverse=True, return_counts=True)
    index, begin = _windows(data, starts[at], ends[at])
    lexicon = types[count >= FREQUENT]
    model = Model(labels, lexicon, np.zeros((WINDOWS, k)), np.zeros((len(lexicon) + 1, k)), np.zeros((k, k)), np.zeros(k))
    known = model.known(types)
    n = np.diff(first)
    truth = np.repeat(np.searchsorted(labels, langs), n)
    flags = np.zeros(len(starts), bool)
    flags[first[:-1][n > 0]] = True
    # the words go through the chain some texts at a time: (first word, word after the last)
    parts = [(int(first[i]), int(first[j])) for i, j in B.pieces(first, 1 << 17)]
    params = {"windows": model.windows, "words": model.words, "trans": model.trans, "start": model.start}
    gold = np.zeros((len(types), k))
    np.add.at(gold, (back, truth), 1.0)

    def rate():
        return _crf.ragged_sum(model.windows, index, begin) + model.words[known]

    def uphill(adam, grad, more=()):
        grads = {"windows": _crf.ragged_back(grad, index, begin, WINDOWS) - 0.02 * model.windows, "words": np.stack([np.bincount(known, weights=grad[:, j], minlength=len(lexicon) + 1) for j in range(k)], axis=1) - 0.02 * model.words}
        grads["words"][-1] = 0
        adam.step(params, grads | dict(more))

    adam = _crf.Adam(0.1)
    for _ in range(ROUNDS_ALONE):
        z = rate()
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        uphill(adam, gold - p * count[:, None])
    # parts in other languages get labels of their own
    sticky = np.log(np.full((k, k), 0.02 / max(1, k - 1)) + np.eye(k) * (0.98 - 0.02 / max(1, k - 1)))
    rated = rate()
    truth = np.concatenate([_crf.forward_backward(rated[back[i:j]], flags[i:j], sticky, np.zeros(k)).argmax(axis=1) for i, j in parts])
    gold[:] = 0
    np.add.at(gold, (back, truth), 1.0)
    inner = np.flatnonzero(~flags)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (truth[inner - 1], truth[inner]), 1.0)
    begins = np.bincount(truth[flags], minlength=k).astype(float)
    model.trans[:] = sticky
    adam = _crf.Adam(0.05)
    for _ in range(ROUNDS_CHAIN):
        rated, grad, expected, begun = rate(), gold.copy(), np.zeros((k, k)), np.zeros(k)
        for i, j in parts:
            gamma, moves = _crf.forward_backward(rated[back[i:j]], flags[i:j], model.trans, model.start, True)
            expected += moves
            begun += gamma[flags[i:j]].sum(axis=0)
            for c in range(k):
                grad[:, c] -= np.bincount(back[i:j], weights=gamma[:, c], minlength=len(types))
        uphill(adam, grad, {"trans": pairs - expected - 0.5 * model.trans, "start": begins - begun - 0.5 * model.start}.items())
    return model


def _predict(model: Model | None):
    def work(batches):
        for b in batches:
            langs, scores, sures = [], [], []
            text = b.column("text")
            if model is None:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([UNDECIDED] * b.num_rows, pa.string()), pa.array(np.zeros(b.num_rows)), pa.array(np.zeros(b.num_rows))], [*b.schema.names, "lang_pred", "score", "sure"])
                continue
            data, off = B.raw(_low(text))
            names = np.array([*model.labels, UNDECIDED], object)
            for i, j in B.pieces(off, 1 << 20):
                gamma, size, first = model.words_of(data[off[i] : off[j]], off[i : j + 1] - off[i])
                total = _sum_rows(gamma * size[:, None], first) if len(gamma) else np.zeros((j - i, len(model.labels)))
                mass = total.sum(axis=1)
                best = np.where(mass > 0, total.argmax(axis=1), len(model.labels))
                share = np.where(mass > 0, total.max(axis=1) / np.maximum(mass, 1e-300), 0.0)
                tops = _sum_rows((gamma.max(axis=1) * size)[:, None], first)[:, 0] if len(gamma) else np.zeros(j - i)
                sure = np.where(mass > 0, tops / np.maximum(mass, 1e-300), 0.0)
                # bytes beyond ASCII need not be letters
                for r in np.flatnonzero(mass > 0):
                    lo, hi = off[i + r], off[i + r + 1]
                    if hi - lo < 64 and not any(c.isalpha() for c in data[lo:hi].tobytes().decode("utf-8", "replace")):
                        best[r], share[r], sure[r] = len(model.labels), 0.0, 0.0
                    elif hi - lo >= 64 and not (~B.NO_LETTER[:128])[np.minimum(data[lo : lo + 4096], 127) * (data[lo : lo + 4096] < 128)].any() and not any(c.isalpha() for c in data[lo:hi].tobytes().decode("utf-8", "replace")):
                        best[r], share[r], sure[r] = len(model.labels), 0.0, 0.0
                langs.append(names[best])
                scores.append(np.minimum(share, 1.0))
                sures.append(np.minimum(sure, 1.0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(langs) if langs else [], pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(np.concatenate(sures) if sures else np.zeros(0))], [*b.schema.names, "lang_pred", "score", "sure"])

    return work


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = TEXTS) -> Model | None:
    """Fit on a bounded sample of rows with a label (doc_id orders the sample)."""
    slim = docs.select("doc_id", F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    ids = bounded(slim.where("lang is not null").select("doc_id"), texts).distinct()
    return fitted(texts_of(slim.where("lang is not null and text is not null"), ids).select("doc_id", "lang", "text"), _fit_rows)


def _fit_rows(rows: list[dict]) -> Model | None:
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", pred: str = "lang_pred", score: str = "score", sure: str | None = None) -> DataFrame:
    """The columns ``keep`` with the predicted label and its score, for every row.

    score: the label's share of the words' mass.  ``sure``: name of a further
    column, the mean certainty of each word's own label; it stays high where a
    text changes between languages.
    """
    slim = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([*slim.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("sure", T.DoubleType())])
    out = mapped(slim, _predict(model), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("lang_pred").alias(pred), F.col("score").alias(score), *([F.col("sure").alias(sure)] if sure else []))
