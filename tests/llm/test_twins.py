"""Scores of the chain models against plain Python: every label sequence of short texts is enumerated."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from fieldglass.llm import _bytes as B
from fieldglass.llm import language_id, quality


def marginals(emit, trans, start):
    """Each unit's label probabilities by all label sequences."""
    n, k = len(emit), len(start)
    out = np.zeros((n, k))
    total = 0.0
    for path in itertools.product(range(k), repeat=n):
        w = math.exp(sum(emit[i][c] for i, c in enumerate(path)) + start[path[0]] + sum(trans[a][b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for i, c in enumerate(path):
            out[i, c] += w
    return out / total


LINES = ["A plain line of words, nothing else.", "BUY NOW!!! $$$ 50% OFF %%% click click click", "the the the the", "x", "1234 5678 9012", "Ärger mit Öl und Übung.", "A plain line of words, nothing else.", "word " * 30, "***", "Is it? It is. No; yes."]


def line_measures(text):
    """The measures of each line, one at a time."""
    lines = [s for s in re.split(r"[\n\r]+", text) if s]
    out = []
    for s in lines:
        raw = s.encode()
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
        folded = [bytes(B.FOLD[b] for b in w) for w in words]
        letters = sum(b >= 128 or chr(b).isalpha() for b in raw)
        capitals = sum(65 <= b <= 90 for b in raw) + sum(raw[i] == 0xC3 and 0x80 <= raw[i + 1] <= 0x9E for i in range(len(raw) - 1))
        digits = sum(48 <= b <= 57 for b in raw)
        symbols = sum(not (b >= 128 or chr(b).isalnum()) and chr(b) not in ".,;:'\"-()?" and b not in (32, *range(9, 14)) for b in raw)
        repeats = len(folded) - len(set(folded))
        again = sum(a == b for a, b in zip(folded, folded[1:], strict=False))
        low = bytes(B.FOLD[b] for b in raw)
        same = sum(bytes(B.FOLD[b] for b in o.encode()) == low for o in lines)
        n, w = len(raw), max(1, len(words))
        out.append([math.log1p(n), math.log1p(len(words)), letters / n, capitals / w, digits / n, symbols / w, letters / w, repeats / w, again / w, min(same - 1, 5), sum(chr(b) in ".!?" for b in raw) / w])
    return lines, np.array(out).reshape(len(lines), 11)


def model_of(seed):
    rng = np.random.default_rng(seed)
    _, m = line_measures("\n".join(LINES))
    edges = [np.unique(np.quantile(m[:, i], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for i in range(m.shape[1])]
    weights = rng.normal(0, 0.6, (3 * len(edges) * quality.BINS + 1, 2))
    weights[-1] = 0
    return quality.Model(edges, weights, rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2), rng.normal(0, 1, 3), 0.5)


@pytest.mark.parametrize("seed", range(4))
def test_quality_against_plain_python(seed):
    """Measures, neighbours' features, marginals, weights by length and the last fit, over texts that share a batch."""
    rng = np.random.default_rng(seed)
    model = model_of(seed)
    texts = ["", "\n\n", LINES[0], "\r\n".join(LINES[:3]), *("\n".join(rng.choice(LINES, int(rng.integers(1, 9)))) + "\n" * int(rng.integers(0, 3)) for _ in range(12))]
    got = model.score(*B.raw(pa.array(texts)))
    width = len(model.edges) * quality.BINS
    for text, score in zip(texts, got, strict=True):
        lines, m = line_measures(text)
        q = 0.0
        if lines:
            own = [[int(np.searchsorted(e, v, "right")) + i * quality.BINS for i, (e, v) in enumerate(zip(model.edges, row, strict=True))] for row in m]
            emit = []
            for i, bins in enumerate(own):
                e = model.weights[bins].sum(axis=0)
                if i:
                    e = e + model.weights[[b + width for b in own[i - 1]]].sum(axis=0)
                if i + 1 < len(own):
                    e = e + model.weights[[b + 2 * width for b in own[i + 1]]].sum(axis=0)
                emit.append(e)
            good = marginals(emit, model.trans, model.start)[:, 1]
            size = np.array([len(s.encode()) for s in lines], float)
            q = float((good * size).sum() / size.sum())
        x = np.array([q, max(-7, min(7, math.log((q + 1e-3) / (1 - q + 1e-3)))), 1.0])
        assert score == pytest.approx(1 / (1 + math.exp(-float(x @ model.fit))), abs=1e-9)


def test_language_against_plain_python():
    """Words' marginals and the text's label by all label sequences, each word rated on its own."""
    texts = ["the house and the river", "das haus und der fluss", "la casa y el río", "the haus y the"]
    model = language_id.fit(texts[:3] * 4, ["en", "de", "es"] * 4)
    own = [*texts, "", "42", "The HOUSE", "río"]
    data, off = B.raw(language_id._low(pa.array(own)))
    gamma, size, first = model.words_of(data, off)
    for i, text in enumerate(own):
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.lower())
        assert first[i + 1] - first[i] == len(words)
        if not words:
            continue
        emit = []
        for w in words:
            raw = np.frombuffer(w.encode(), np.uint8)
            ends = np.array([len(raw)])
            emit.append(model.emit(raw, np.array([0]), ends, B.hashes(raw, np.array([0]), ends, False))[0])
        want = marginals(emit, model.trans, model.start)
        assert gamma[first[i] : first[i + 1]] == pytest.approx(want, abs=1e-9)
        assert size[first[i] : first[i + 1]].tolist() == [len(w.encode()) for w in words]
    assert [model.labels[int(gamma[first[i] : first[i + 1]].sum(axis=0).argmax())] for i in range(3)] == ["en", "de", "es"]


def plain_pu(positive, unlabelled, v, prior, steps, rate, sparse):
    """Dense non-negative risk descent, with derivatives by differences of the risk itself; how often the correction held."""
    dense = lambda sets: np.array([[float(k in s) for k in range(v)] + [1.0] for s in sets])
    p, u = dense(positive), dense(unlabelled)
    sig = lambda z: 1 / (1 + np.exp(-z))
    negative = lambda x: sig(u @ x).mean() - prior * sig(p @ x).mean()
    risk = lambda x: prior * (1 - sig(p @ x)).mean() + negative(x)

    def slope(f, x):
        e = np.eye(v + 1) * 1e-6
        return np.array([(f(x + d) - f(x - d)) / 2e-6 for d in e])

    x = np.append(np.zeros(v), -1.0)
    m1 = m2 = np.zeros(v + 1)
    held = 0
    for t in range(1, steps + 1):
        ok = negative(x) >= 0
        held += not ok
        g = slope(risk, x) if ok else -slope(negative, x)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        pace = rate / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        x = x - pace * m1 / (1 - 0.9**t)
        x = np.sign(x) * np.maximum(np.abs(x) - pace * np.append(np.full(v, sparse), 8 * sparse), 0)
    return x, held


@pytest.mark.parametrize("prior,corrects", [(0.05, False), (0.7, True)])
def test_toxicity_against_plain_python(prior, corrects):
    """The corrected risk and its steps over places in a small vocabulary, where the correction holds and where it does not."""
    rng = np.random.default_rng(int(prior * 10))
    v = 6
    positive = [np.array(sorted({0, *rng.integers(0, 3, 2).tolist()}), np.int64) for _ in range(9)]
    unlabelled = [np.array(sorted(set(rng.integers(2, v, int(rng.integers(0, 4))).tolist())), np.int64) for _ in range(30)] + positive[:2]
    from fieldglass.llm import toxicity

    steps = 60
    model = toxicity.fit_places(np.arange(v, dtype=np.uint64), positive, unlabelled, prior, steps, 0.1, 3e-4)
    x, held = plain_pu(positive, unlabelled, v, prior, steps, 0.1, 3e-4)
    assert np.append(model.weights, model.bias) == pytest.approx(x, abs=2e-3) and (held > 0) == corrects
