"""Line deduplication, hard negatives and source divergence against plain Python, with their edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import divergence, hard_negatives, line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

POOL = ["Hello World this", "  hello world THIS\t", "École Étage Àb", "école étage àb", "ÉCOLE ÉTAGE ÀB", "short", "", "日本語テキスト日本語テ", "K kelvin sign kk", "k Kelvin sign KK", "x" * 20, "\x0btab\x0bin the middle\x0c", "q" * 9, "q" * 10, " hello world this", "İstanbul ist i̇", "i̇stanbul ist i̇", "SIGMA ΑΣ ΑΣ", "sigma ας ας"]


def kept_lines(rows, least_docs=2, least_chars=10):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    held = {}
    for doc, text, _ in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add((doc is None, doc))
    out = []
    for doc, text, x in rows:
        lines = (text or "").split("\n")
        stay = [s for s in lines if len(key(s)) < least_chars or len(held[key(s)]) < least_docs or min(held[key(s)], key=lambda d: (d[0], d[1] or 0)) == (doc is None, doc)]
        out.append((doc, text, x, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(map(repr, out))


def texts(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        yield None if i % 17 == 0 else "\n".join(rng.choice([*POOL, *(f"own line number {i}-{j}" for j in range(6))]) for _ in range(rng.randrange(9)))


@pytest.mark.parametrize("least_docs,least_chars", [(1, 10), (2, 10), (2, 0), (3, 12)])
def test_line_dedup(spark, least_docs, least_chars):
    rows = [(None if i % 13 == 0 else i // 2, t, i) for i, t in enumerate(texts(90, 5))]
    rows += rows[:6]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int").repartition(5)
    got = sorted(repr(tuple(r)) for r in line_dedup.drop_repeated_lines(df, least_docs, least_chars).collect())
    assert got == kept_lines(rows, least_docs, least_chars)


def test_line_dedup_edges(spark):
    kind = "doc_id long, text string, row int, id int, name int, lines int, gone int, `a.b` int, n_lines int, N_dropped int, kept_text int, h int"
    empty = line_dedup.drop_repeated_lines(spark.createDataFrame([], kind))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "row", "id", "name", "lines", "gone", "a.b", "n_lines_", "N_dropped_", "kept_text_", "h", "n_lines", "n_dropped", "kept_text"]
    long = "\n".join(f"line number {i} of many" for i in range(60_000))
    rows = [(2, long, *range(10)), (1, "first and only\r\nline number 7 of many ", *range(10)), (1, "first and only", *range(10)), (3, "first and only\nFIRST AND ONLY", *range(10))]
    out = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, kind)).collect() if "number" in r.text or r.doc_id == 3}
    assert (out[2].n_lines, out[2].n_dropped) == (60_000, 1) and out[2].kept_text == long.replace("line number 7 of many\n", "")
    assert out[1].n_dropped == 0 and (out[3].n_dropped, out[3].kept_text, out[3].h) == (2, "", 9)


def test_line_dedup_is_native(spark):
    """Neither the tables it writes nor the result use Python, and a shared line is counted before it moves."""
    df = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("the same line everywhere").alias("text"))
    keys = line_dedup._keys(line_dedup._rows(df, "doc_id", "text"), 10)
    for plan in (line_dedup.repeated(keys, 2), line_dedup.drop_repeated_lines(df)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", text)
    text = line_dedup.repeated(keys, 2)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in text


def mined(rows, anchors, positives, negatives, window, scale=256):
    ok = {}
    for i, v, label in rows:
        if None not in (i, v, label) and all(x is not None and np.isfinite(x) for x in v):
            ok[(i, label, tuple(v))] = np.array([int(np.floor(scale * x)) for x in v], dtype=object)
    out = []
    for (i, label, v), x in ok.items():
        if i not in anchors:
            continue
        scored = sorted((-int((x * y).sum()), j, other) for (j, other, w), y in ok.items() if j != i and len(w) == len(v))
        for s, j, _ in [z for z in scored if z[2] == label][:positives]:
            hard = [z for z in scored if z[2] != label and window[0] * -s <= 100 * -z[0] <= window[1] * -s]
            out += [(i, j, r, h[1], -s, -h[0]) for r, h in enumerate(hard[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,dim,leaf", [(1, 8, 4), (2, 3, 64), (3, 16, 8)])
def test_hard_negatives(spark, monkeypatch, seed, dim, leaf):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(hard_negatives, "SHARD", 50)
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    rows = [(i, [round(float(x), 1) for x in rng.normal(0.2, 0.5, dim)], str(rng.integers(0, 4))) for i in range(300)]
    rows += [(300 + i, [0.5] * dim, "0" if i % 2 else "9") for i in range(80)]  # a hot vector: ties
    rows += [(None, [0.5] * dim, "1"), (501, None, "1"), (502, [0.5] * dim, None), (503, [0.5, None] * (dim // 2) or None, "1"), (504, [float("nan")] * dim, "1"), (505, [float("inf")] * dim, "1"), (506, [0.5], "1"), (507, [0.4], "2"), (508, [0.5], "1"), (509, [], "1"), (510, [], "1"), (511, [], "2")]
    rows += rows[:9] + [(3, [0.3] * dim, "1"), (3, [0.3] * dim, "2")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(4)
    anchors = {i for i in range(600) if i % 11 == 0 or i in (3, 506, 509)}
    out = hard_negatives.mine(df, F.col("vec_id").isin(*anchors), 3, 4, (30, 90))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in out.collect()) == mined(rows, anchors, 3, 4, (30, 90))


def test_hard_negatives_edges(spark):
    kind = "vec_id long, embedding array<float>, label int, id int, no int, dim int, `a.b` int"
    df = spark.createDataFrame([], kind)
    assert hard_negatives.mine(df, F.col("vec_id") % 2 == 0).count() == 0
    rows = [(0, [1.0, 0.0], 1, 1, 1, 1, 1), (1, [1.0, 0.0], 1, 1, 1, 1, 1), (2, [0.5, 0.0], 2, 1, 1, 1, 1), (4, [0.5, 0.0], None, 1, 1, 1, 1)]
    assert [tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, kind), F.col("vec_id") % 2 == 0).collect()] == [(0, 1, 1, 2, 65536, 32768)]
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(spark.createDataFrame([(0, [1e16, 0.0], 1, 1, 1, 1, 1), (1, [1e16, 0.0], 1, 1, 1, 1, 1)], kind), F.col("vec_id") % 2 == 0).collect()


def test_ball_tree_and_pruning():
    """Every row is in one leaf and inside its balls; most nodes of clustered data are never opened."""
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 400, (30, 8))
    x = np.concatenate([rng.normal(c, 10, (100, 8)) for c in centres]).astype(np.int64)
    order, tree = hard_negatives.ball_tree(x)
    assert sorted(order.tolist()) == list(range(len(x)))
    for n in range(len(tree["start"])):
        own = x[order[tree["start"][n] : tree["end"][n]]]
        assert (np.sqrt(((own - tree["centre"][n]) ** 2).sum(axis=1)) <= tree["radius"][n] + 1e-9).all()
        assert tree["left"][n] >= 0 or len(own) <= hard_negatives.LEAF
    opened = []
    shard = {"tree": tree, "vecs": x[order], "ids": order.astype(np.int64), "labels": np.zeros(len(x), np.int64)}
    real = hard_negatives._products
    hard_negatives._products = lambda a, b: opened.append(len(b)) or real(a, b)
    try:
        best = hard_negatives.Best(1, 5)
        q = x[:1]
        hard_negatives.search(best, q, np.zeros(1, np.int64), np.array([0]), np.array([0]), np.full(1, -(2**62)), np.full(1, 2**62), True, shard)
    finally:
        hard_negatives._products = real
    want = sorted((-int(s), i) for i, s in enumerate(x @ q[0]) if i)[:5]
    assert [(-s, i) for s, i in zip(best.score[0].tolist(), best.id[0].tolist(), strict=True)] == want
    assert sum(opened) < len(x) / 4


def audited(rows, least_docs, top):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    docs, n = {}, {}
    for t, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER))
        docs.setdefault(lang, Counter()).update(set(words))
        n.setdefault((lang, source), Counter()).update(words)
    out = []

    def share(count, kept):
        total = sum(count[k] for k in kept)
        return {k: 1 + 10**9 * (count[k] + 2) // (total + 2 * len(kept)) for k in kept}

    def div(a, b):
        return (a - b) ** 2 // (a + b)

    for (lang, source), count in n.items():
        kept = [k for k, d in docs[lang].items() if d >= least_docs]
        p = share(count, kept)
        pairs = []
        for (other, item), more in n.items():
            if other == lang and item != source:
                q = share(more, kept)
                pairs.append((-sum(div(p[k], q[k]) for k in kept), item.encode(), item))
        q = share(sum((c for (x, _), c in n.items() if x == lang), Counter()), kept)
        terms = sorted((-div(p[k], q[k]), k.encode(), k) for k in kept if count[k] and p[k] > q[k])[:top]
        out += [(lang, source, "pair", i, -v, r) for r, (v, _, i) in enumerate(sorted(pairs), 1)]
        out += [(lang, source, "term", i, -v, r) for r, (v, _, i) in enumerate(terms, 1)]
    return sorted(out)


@pytest.mark.parametrize("side,terms,counted", [(128, 512, 1 << 20), (2, 3, 40), (3, 1, 1)])
def test_divergence(spark, monkeypatch, side, terms, counted):
    monkeypatch.setattr(divergence, "SIDE", side)
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "COUNTED", counted)
    rng = random.Random(4)
    words = ["the", "The", "a", "über", "ÜBER", "naïve", "don't", "x1y", "日本語", "ﾃｽﾄ", "é", *(f"w{c}" for c in "abcdefghij")]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "Ü", "s10", None])) for _ in range(150)]
    rows += [(None, "en", "silent"), ("", "xx", "a"), ("1 2 3", "xx", "b"), ("once", "yy", "only"), ("long " * 20_000 + "x" * 70_000, "en", "s1")] + rows[:4]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("n", F.lit("mine")).withColumn("term", F.lit(1)).repartition(3)
    assert sorted(tuple(r) for r in divergence.audit(df, 4, 5).collect()) == audited(rows, 4, 5)


def test_divergence_edges(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    big = np.array([[9 * 10**14, 0, 5]], np.int64)
    total = np.array([10**15], np.int64)
    assert divergence.shares(big, total, 3)[0].tolist() == [1 + 10**9 * (int(c) + 2) // (10**15 + 6) for c in big[0]]
