"""Edge cases that the docstrings define: clashing names, repeated rows, hash names, hot keys."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import _bytes as B
from fieldglass.llm import exact_dedup, mixing, ngram_join


def thue_morse(n, first="a", other="b"):
    return "".join(first if bin(i).count("1") % 2 == 0 else other for i in range(n))


def test_words_of_patterns_differ(spark):
    """Patterns that cancel out in polynomial hashes modulo 2^64 do not link."""
    texts = [thue_morse(2048), thue_morse(2048, "b", "a"), thue_morse(64), thue_morse(64, "b", "a")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(df).collect()} == {i: i for i in range(4)}


def test_hash_lanes():
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abAB\xc3\xa9") for _ in range(rng.choice((1, 2, 7, 8, 9, 16, 17, 64, 65, 200)))) for _ in range(400)]
    data, off = B.raw(pa.array(words, pa.binary()))
    lanes = [B.hashes(data, off[:-1], off[1:], lane=k) for k in (0, 1)]
    low = [w.translate(bytes(B.FOLD)) for w in words]
    for h in lanes:
        assert len(set(h.tolist())) == len(set(low))
        assert {w: x for w, x in zip(low, h.tolist(), strict=True)} == {w: x for w, x in sorted(zip(low, h.tolist(), strict=True))}
    assert not set(lanes[0].tolist()) & set(lanes[1].tolist())


def test_shared_names_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 5, 10), (2, 5, 10), (3, 5, 11), (4, 6, 10)], "id long, cid long, chk long")
    got = {r.id: r.cid for r in ngram_join._told_apart(rows).collect()}
    assert got[1] == got[2] == 5 and got[4] == 6 and len({got[1], got[3], got[4]}) == 3


CLASHING = "doc_id long, text string, _name int, _h int, _id int, key int, row int, `a.b` int, block int, Slot int, position int, may boolean"


def clashing(spark):
    texts = ["a b c d e f g", "a b c d e f g", "A b c d e f g", "x", None, "", "x y"]
    return spark.createDataFrame([(i % 5, t, *range(10 * i, 10 * i + 9), True) for i, t in enumerate([*texts, *texts])], CLASHING)


def test_rows_pass_whole(spark):
    df = clashing(spark)
    every = {tuple(r) for r in df.collect()}
    for out in (exact_dedup.distinct_texts(df), ngram_join.one_of_each(df)):
        got = [tuple(r) for r in out.collect()]
        assert out.columns == df.columns and set(got) <= every and len(set(got)) == len(got)
    mixed = mixing.mix_sources(df, source_col="a.b")
    assert mixed.columns == ["doc_id", "text", "_name", "_h", "_id", "key", "row", "a.b", "block_", "Slot_", "position_", "may", "block", "slot", "position"]
    assert sorted(map(str, (tuple(r)[:12] for r in mixed.collect()))) == sorted(map(str, every))


def test_one_of_each_ties(spark):
    """Rows equal in identifier and text leave one; null identifiers rank behind."""
    rows = [(None, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 3), (2, "", 4), (2, None, 5), (1, "", 6), (9, "q", 7), (9, "q", 7)]
    got = [tuple(r) for r in ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, x int")).collect()]
    assert len(got) == 4 and {(r[0], r[1] or "") for r in got} == {(3, "a b c d e f"), (2, ""), (1, ""), (9, "q")}


def test_keys_pass_once_dealt(spark, monkeypatch):
    """Index entries are in no written table but the first, and that one has gone, with all shuffle files, before sets are read anew."""
    rng, seen, real = random.Random(3), {}, ngram_join.stage
    here = lambda path: os.path.exists(path.removeprefix("file:"))

    def noted(df, label, lasting=0):
        if label == "tokens":
            seen["gone"] = not here(seen["sets"])
        out = real(df, label, lasting)
        seen[label] = os.path.dirname(out.inputFiles()[0])
        if label in ("dealt", "shared"):
            seen["entries"] = seen.get("entries", 0) + out.where(F.col("kind") == ngram_join._ENTRY).count()
        return out

    monkeypatch.setattr(ngram_join, "stage", noted)
    texts = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(40)) for _ in range(80)) for _ in range(30)]
    texts += [t + " end" for t in texts]
    out = ngram_join.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    assert sorted(r.doc_id for r in out.collect()) == list(range(30))
    assert seen["gone"] and seen["entries"] == 0


def test_hot_text_is_dealt(spark, monkeypatch):
    """A text that every run holds, under null and repeated identifiers."""
    monkeypatch.setattr(exact_dedup, "heavy", lambda total: 3)
    monkeypatch.setattr(exact_dedup, "ENTRIES", 4)
    rows = [(None if i % 3 else i // 9, "hot" if i % 4 else f"t{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = exact_dedup.exact_dedup(df, memtable_rows=5).collect()
    n = sum(t == "hot" for _, t in rows)
    hot = [r for r in out if r.group_size == n]
    assert len(out) == 120 and len(hot) == n and sum(r.kept for r in hot) == 1
    assert {r.keep_id for r in hot} == {max(i for i, t in rows if t == "hot" and i is not None)}
    assert sorted(r.text for r in exact_dedup.distinct_texts(df).collect()) == sorted({t for _, t in rows})


@pytest.mark.parametrize("weights", [{"a": 0, "b": 0}, {}, {"a": 2.0**0.5, "b": 1, "c": 3.0**0.5}, {"a": 1, "b": 1, "c": 1}])
def test_mixing_weights(spark, weights):
    rows = [(i, "abc"[i % 3], "t" * 9) for i in range(900)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights, block_chars=10).orderBy("slot").collect()
    assert [r.slot for r in out] == list(range(900))
    own = {s: weights.get(s, min(weights.values(), default=1)) for s in "abc"}
    own = own if any(own.values()) else dict.fromkeys("abc", 1)
    done, total = dict.fromkeys("abc", 0), sum(own.values())
    last = min(max(i for i, r in enumerate(out) if r.source == s) for s in "abc")
    for i, r in enumerate(out[: last + 1], 1):
        done[r.source] += 1
        assert all(abs(done[s] - own[s] * i / total) < 1 + 1e-9 for s in "abc")


def test_positions_are_those_of_a_plain_walk(spark):
    """Blocks and starts recomputed row by row."""
    rows = [(i, "ab"[i % 2], "t" * (i % 40)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix"))
    walk = {}
    for r in df.withColumn("o", order).orderBy("o").collect():
        walk.setdefault(r.source, []).append((r.doc_id, len(r.text) + 1))
    got = {r.doc_id: (r.block, r.position.start) for r in mixing.mix_sources(df, block_chars=100).collect()}
    for own in walk.values():
        at = 0
        for doc_id, n in own:
            assert got[doc_id] == (at // 100, at)
            at += n


def test_empty_weights_of_floats():
    assert mixing.integer_weights({}) == {}
    with pytest.raises(ValueError):
        mixing.integer_weights({"a": -1})
    assert np.array(list(mixing.integer_weights({"a": 0.5, "b": 0.25}).values())).tolist() == [2, 1]


WHOLE = "doc_id long, text string, lang string, source string, n_chars long, block int, Slot int, position string, _pred int, _score int, _sure int, pieces int, pieces_ int, round_trip int, `a.b` int, row int, key int"


def test_pipeline_as_a_whole(spark, tmp_path):
    """All stages over null, empty, repeated and near-equal rows with clashing columns, and over an empty table."""
    import corpus_pipeline

    rng = random.Random(2)
    words = {"en": "the and of house river stone light walk under never".split(), "de": "der und von haus fluss stein licht gehen unter niemals".split()}
    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "de"
        rows.append([i, " ".join(rng.choice(words[lang]) for _ in range(60)), lang, f"s{i % 3}"])
    rows += [[80, rows[3][1], "de", "s1"], [81, rows[4][1] + " end", "en", None], [82, None, "en", "s1"], [83, "", None, "s2"], [84, "123 456", None, None], [None, rows[5][1] + " x", None, "s1"], [7, rows[7][1], "en", "s1"]]
    whole = [(*r, len(r[1] or ""), i, 2, f"p{i}", 3, 4, 5, 6, 7, 8, i, 9, 10) for i, r in enumerate(rows)]
    for name, data in (("some", whole), ("none", [])):
        d = tmp_path / name
        spark.createDataFrame(data, WHOLE).coalesce(2).write.parquet(str(d / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(d))
        got = out.collect()
        assert out.columns == ["doc_id", "lang", "source", "n_chars", "block", "Slot", "position_", "_pred", "_score", "_sure", "pieces__", "pieces_", "round_trip_", "a.b", "row", "key", "position", "pieces", "n_fallback", "round_trip"]
        if not data:
            assert got == []
            continue
        want = {r[0]: r for r in whole}
        kept = {r.doc_id for r in got}
        # one of each group of equal or near-equal texts; none without letters
        assert len(got) == len(kept) == 80 and not kept & {82, 83, 84, None} and len({3, 80} & kept) == 1 and len({4, 81} & kept) == 1
        for r in got:
            own = want[r.doc_id] if r.doc_id != 7 else whole[7 if r["a.b"] == 7 else -1]
            assert (r.lang, r.source, r.n_chars, r.block, r.Slot, r.position_, r._pred, r._score, r._sure, r.pieces__, r.pieces_, r.round_trip_, r["a.b"], r.row, r.key) == own[2:] and r.round_trip
        assert [r.position for r in got] == sorted(r.position for r in got)


def test_pieces_with_clashing_names(spark):
    from fieldglass.llm import sentence_pieces
    from fieldglass.llm.queries import PIECES

    model = sentence_pieces.load(PIECES)
    df = spark.createDataFrame([(1, "a b", 2, 3, 4, "t"), (1, None, 2, 3, 4, None), (1, "a b", 2, 3, 4, "t")], "pieces int, text string, pieces_ int, `a.b` int, N_fallback int, c0 string")
    out = sentence_pieces.encode(df, model)
    assert out.columns == ["pieces__", "pieces_", "a.b", "N_fallback_", "c0", "pieces", "n_fallback", "round_trip"]
    assert sorted((r.pieces__, r["a.b"], r.c0 or "", r.round_trip) for r in out.collect()) == [(1, 3, "", True), (1, 3, "t", True), (1, 3, "t", True)]
    back = sentence_pieces.decode(out, model)
    assert sorted(r.text for r in back.collect()) == ["", "a b", "a b"] and back.columns[-1] == "text"
