"""SentencePiece encoding and decoding by Viterbi search.

The pieces of a model file are the keys of a double-array trie over UTF-8
bytes.  A text is escaped (blanks become the whitespace marker U+2581, one is
put in front) and cut into the pieces with the greatest sum of log scores; a
character that no piece covers is an unknown of a low score and becomes byte
pieces.  Ties go to the piece found first, as in the common library.

A unigram model's scores are used as stored.  A merge-ranked (BPE) model
stores ranks r = 0, -1, -2, ... and not log scores; they become Zipf
log-probabilities, -ln(1 - r) - ln(H), H the harmonic number of their count.

If no piece has a marker behind another character, the best path never
crosses the front of a marker that follows another character.  Then texts are
cut there into words, each distinct word of a batch is searched once, all
words in step, and texts are put together from the words' pieces.

Defined results: a null or empty text has no pieces and decodes to "";
byte pieces that are no UTF-8 decode to U+FFFD; a U+2581 in a text decodes to
a blank, as the format has it; an empty table gives no rows.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm import _bytes as B
from fieldglass.llm._shared import free_name, mapped

MARK = "▁".encode()
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model kinds in a model file.
UNIGRAM, BPE = 1, 2
#: Words longer than this are searched one at a time.
LONG = 96


def _fields(buf: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    i, n = 0, len(buf)

    def varint(i):
        x = shift = 0
        while True:
            b = buf[i]
            x |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return x, i

    while i < n:
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = buf[i : i + size], i + size
        else:
            size = 4 if kind == 5 else 8
            value, i = buf[i : i + size], i + size
        yield tag >> 3, value


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a double-array trie; value is the key's index or -1."""
    children: list[dict[int, int]] = [{}]
    at_node = [-1]
    for k, key in enumerate(keys):
        node = 0
        for b in key:
            nxt = children[node].get(b)
            if nxt is None:
                nxt = len(children)
                children[node][b] = nxt
                children.append({})
                at_node.append(-1)
            node = nxt
        at_node[node] = k
    size = len(children) * 2 + 4096
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    used = np.zeros(size, bool)
    used[0] = True
    value[0] = at_node[0]
    place, todo = {0: 0}, [0]
    low = 1  # all places below are taken, or nearly all
    window = 2048
    for node in todo:
        kids = children[node]
        if not kids:
            continue
        codes = np.array(sorted(kids))
        at = max(1, low - int(codes[0]))
        while True:
            if at + window + 256 >= len(used):
                base, check, value, used = (np.concatenate((x, np.full(size, f, x.dtype))) for x, f in ((base, 0), (check, -1), (value, -1), (used, False)))
            free = ~used[at + codes[0] : at + codes[0] + window]
            for c in codes[1:]:
                free &= ~used[at + c : at + c + window]
            spot = int(free.argmax())
            if free[spot]:
                break
            at += window
        b = at + spot
        own = place[node]
        base[own] = b
        used[b + codes] = True
        check[b + codes] = own
        for c in codes.tolist():
            place[kids[c]] = b + c
            value[b + c] = at_node[kids[c]]
            todo.append(kids[c])
        while used[low : low + 256].mean() > 0.9 and low + 512 < len(used):
            low += 64
    return base, check, value


@dataclass
class Pieces:
    """A model: pieces, kinds, log scores, and the normaliser's flags."""

    pieces: list[bytes]
    kinds: list[int]
    scores: np.ndarray
    prefix: bool = True
    strip: bool = False
    fallback: bool = True

    @classmethod
    def load(cls, blob: bytes) -> Pieces:
        pieces, kinds, scores, model, prefix, strip, fallback, norm = [], [], [], UNIGRAM, True, True, False, b""
        for number, value in _fields(blob):
            if number == 1:
                piece, kind, score = b"", NORMAL, 0.0
                for n, v in _fields(value):
                    if n == 1:
                        piece = bytes(v)
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                pieces.append(piece)
                kinds.append(kind)
                scores.append(score)
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        model = v
                    elif n == 35:
                        fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        norm = bytes(v)
                    elif n == 3:
                        prefix = bool(v)
                    elif n == 4:
                        strip = bool(v)
        if norm:
            raise ValueError("models with a character map are not supported; normalise the texts first")
        s = np.array(scores, np.float64)
        if model == BPE:
            own = np.array(kinds) == NORMAL
            s[own] = -np.log1p(-np.minimum(s[own], 0)) - math.log(math.log(max(2, int(own.sum()))) + 0.5772156649)
        return cls(pieces, kinds, s.astype(np.float32), prefix, strip, fallback)

    @cached_property
    def ids(self) -> dict[bytes, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}

    @cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [(p, i) for p, i in sorted(self.ids.items()) if p]
        base, check, value = double_array([p for p, _ in own])
        index = np.array([i for _, i in own] + [-1], np.int64)
        return base, check, np.where(value >= 0, index[value], -1)

    @cached_property
    def reach(self) -> int:
        return max((len(p) for p in self.ids), default=1)

    @cached_property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0

    @cached_property
    def bytes_(self) -> np.ndarray:
        out = np.full(256, -1, np.int64)
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == BYTE:
                out[int(p[3:5], 16)] = i
        return out

    @cached_property
    def weight(self) -> np.ndarray:
        """Score of each piece in the search; the last is the unknown's."""
        own = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        low = float(self.scores[own].min()) if own else 0.0
        high = float(self.scores[own].max()) if own else 0.0
        w = self.scores.astype(np.float32).copy()
        for i, k in enumerate(self.kinds):
            if k == USER:
                w[i] = np.float32(len(self.pieces[i].decode("utf-8", "replace")) * high - 0.1)
        return np.append(w, np.float32(np.float32(low) - np.float32(10.0)))

    @cached_property
    def by_words(self) -> bool:
        """No piece has the marker behind another character."""
        return all(MARK not in p.lstrip(MARK) if not p.startswith(MARK) else MARK not in _unmarked(p) for p in self.ids)

    # one text

    def escape(self, text: str) -> bytes:
        if self.strip:
            text = " ".join(text.split(" ")).strip(" ")
            while "  " in text:
                text = text.replace("  ", " ")
        if not text:
            return b""
        return ((" " if self.prefix else "") + text).replace(" ", "▁").encode("utf-8", "replace")

    def search(self, word: bytes) -> list[int]:
        """The best path's pieces; unknown characters as -1 - position."""
        base, check, value = self.trie
        n, w = len(word), self.weight
        best = np.full(n + 1, -np.inf, np.float32)
        best[0] = 0
        back: list[tuple[int, int]] = [(-1, -1)] * (n + 1)
        s = 0
        size = len(check)
        while s < n:
            step = 1
            while s + step < n and word[s + step] & 0xC0 == 0x80:
                step += 1
            node, e, alone = 0, s, False
            here = best[s]
            while e < n:
                nxt = int(base[node]) + word[e]
                if nxt >= size or check[nxt] != node or (node == 0 and base[0] == 0):
                    break
                node, e = nxt, e + 1
                p = int(value[node])
                if p >= 0:
                    v = np.float32(here + w[p])
                    if back[e][0] < 0 or v > best[e]:
                        best[e], back[e] = v, (s, p)
                    alone |= e == s + step
            if not alone:
                v = np.float32(here + w[-1])
                if back[s + step][0] < 0 or v > best[s + step]:
                    best[s + step], back[s + step] = v, (s, -1)
            s += step
        out, e = [], n
        while e > 0:
            s, p = back[e]
            out.append(p if p >= 0 else -1 - s)
            e = s
        return out[::-1]

    def encode_word(self, word: bytes) -> list[int]:
        out: list[int] = []
        for p in self.search(word):
            if p >= 0:
                out.append(p)
                continue
            s = -1 - p
            e = s + 1
            while e < len(word) and word[e] & 0xC0 == 0x80:
                e += 1
            out.extend(self.bytes_[list(word[s:e])].tolist() if self.fallback else [self.unknown])
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_word(self.escape(text))

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(self.plain[i] for i in ids).decode("utf-8", "replace")
        return raw[1:] if self.prefix and raw.startswith(" ") else raw

    @cached_property
    def plain(self) -> list[bytes]:
        """The bytes that each piece stands for."""
        out = []
        for p, k in zip(self.pieces, self.kinds, strict=True):
            out.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, b" "))
        return out

    # many words in step

    def encode_words(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each word data[first[i] : first[i + 1]], and the words' first pieces."""
        n = np.diff(first)
        order = np.argsort(n, kind="stable")
        short = order[n[order] <= LONG]
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(short), 1 << 13):
            own = short[at : at + (1 << 13)]
            if len(own):
                got.append((own, *self._block(data, first[own], n[own])))
        for i in order[len(short) :]:
            ids = np.array(self.encode_word(data[first[i] : first[i + 1]].tobytes()), np.int64)
            got.append((np.array([i]), ids, np.array([len(ids)])))
        size = np.zeros(len(n), np.int64)
        for own, _, count in got:
            size[own] = count
        begin = np.zeros(len(n) + 1, np.int64)
        np.cumsum(size, out=begin[1:])
        out = np.zeros(int(begin[-1]), np.int64)
        for own, ids, count in got:
            end = np.cumsum(count)
            out[np.arange(len(ids)) + np.repeat(begin[own] - (end - count), count)] = ids
        return out, begin

    def _block(self, data: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of at most LONG bytes, all searched in step: (pieces, their count for each word)."""
        base, check, value = self.trie
        words, width = len(n), int(n.max()) if len(n) else 0
        if not width:
            return np.zeros(0, np.int64), np.zeros(words, np.int64)
        text = np.zeros((width + 1, words), np.int64)
        pos = np.arange(width)[:, None]
        inside = pos < n[None, :]
        text[:width][inside] = data[(start[None, :] + pos)[inside]]
        lead = np.zeros((width + 1, words), bool)
        lead[:width] = inside & ((text[:width] & 0xC0) != 0x80)
        lead[0] = n > 0
        w, size = self.weight, len(check)
        best = np.full((width + 1, words), -np.inf, np.float32)
        best[0] = 0
        came, piece = np.full((width + 1, words), -1, np.int16), np.full((width + 1, words), -1, np.int32)
        step = np.ones((width, words), np.int8)
        for d in (3, 2, 1):
            if d < width:
                cont = (text[d : width + 1] & 0xC0) == 0x80
                rows = min(width - d, cont.shape[0])
                nxt = np.zeros((width, words), bool)
                nxt[:rows] = cont[:rows] & (np.arange(rows)[:, None] + d < n[None, :])
                if d == 1:
                    c1 = nxt
                elif d == 2:
                    c2 = nxt
                else:
                    c3 = nxt
        no = np.zeros((width, words), bool)
        c1 = c1 if width > 1 else no
        c2 = c2 if width > 2 else no
        c3 = c3 if width > 3 else no
        step += c1.astype(np.int8) + (c1 & c2).astype(np.int8) + (c1 & c2 & c3).astype(np.int8)
        for s in range(width):
            live = np.flatnonzero(lead[s] & (best[s] > -np.inf))
            if not len(live):
                continue
            here, ahead = best[s, live], step[s, live]
            alone = np.zeros(len(live), bool)
            node, idx = np.zeros(len(live), np.int64), np.arange(len(live))
            for length in range(1, min(self.reach, width - s) + 1):
                e = s + length
                idx_ok = n[live[idx]] >= e
                idx, node = idx[idx_ok], node[idx_ok]
                if not len(idx):
                    break
                nxt = base[node] + text[e - 1, live[idx]]
                ok = (nxt < size) & (check[np.minimum(nxt, size - 1)] == node) & (base[node] > 0)
                idx, node = idx[ok], nxt[ok]
                if not len(idx):
                    break
                p = value[node]
                hit = p >= 0
                if hit.any():
                    j, q = idx[hit], p[hit]
                    col = live[j]
                    v = here[j] + w[q]
                    better = (came[e, col] < 0) | (v > best[e, col])
                    col, v, q = col[better], v[better], q[better]
                    best[e, col], came[e, col], piece[e, col] = v, s, q
                    alone[j[ahead[j] == length]] = True
            rest = np.flatnonzero(~alone)
            if len(rest):
                col, e = live[rest], s + ahead[rest]
                v = here[rest] + w[-1]
                better = (came[e, col] < 0) | (v > best[e, col])
                col, e, v = col[better], e[better], v[better]
                best[e, col], came[e, col], piece[e, col] = v, s, -1
        # back along the paths, all words in step
        cols, ends, out, order = np.arange(words), n.copy(), [], []
        turn = 0
        cols = cols[ends > 0]
        ends = ends[ends > 0]
        while len(cols):
            s, p = came[ends, cols].astype(np.int64), piece[ends, cols].astype(np.int64)
            known = p >= 0
            out.append(p[known])
            order.append(np.stack((cols[known], np.full(known.sum(), -turn * 8))))
            lost = np.flatnonzero(~known)
            if len(lost):
                if self.fallback:
                    for k in range(4):
                        own = lost[(ends[lost] - s[lost]) > k]
                        out.append(self.bytes_[text[s[own] + k, cols[own]]])
                        order.append(np.stack((cols[own], np.full(len(own), -turn * 8 - 7 + k))))
                else:
                    out.append(np.full(len(lost), self.unknown))
                    order.append(np.stack((cols[lost], np.full(len(lost), -turn * 8))))
            turn += 1
            cols, ends = cols[s > 0], s[s > 0]
        ids, at = np.concatenate(out), np.concatenate(order, axis=1)
        # a word's pieces came last first
        key = at[0] * (LONG * 16 + 16) + at[1] + LONG * 8 + 8
        return ids[np.argsort(key, kind="stable")], np.bincount(at[0], minlength=words)


def _unmarked(piece: bytes) -> bytes:
    while piece.startswith(MARK):
        piece = piece[3:]
    return piece


def load(path: str) -> Pieces:
    """A model from a file on the driver; tasks get the model itself."""
    with open(path, "rb") as f:
        return Pieces.load(f.read())


def encode_column(model: Pieces, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts, and the texts' first pieces."""
    if not model.by_words or model.strip:
        ids = [model.encode(t or "") for t in column.to_pylist()]
        first = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=first[1:])
        return (np.concatenate([np.array(x, np.int64) for x in ids]) if ids else np.zeros(0, np.int64)), first
    texts = pa.compute.replace_substring(column.fill_null("") if column.null_count else column, " ", "▁")
    if model.prefix:
        lead = pa.compute.if_else(pa.compute.equal(pa.compute.binary_length(texts), 0), "", "▁")
        texts = pa.compute.binary_join_element_wise(lead, texts, "")
    data, off = B.raw(texts)
    out, sizes = [], []
    for i, j in B.pieces(off, 1 << 19):
        own, part = off[i : j + 1] - off[i], data[off[i] : off[j]]
        n = len(part)
        if not n:
            sizes.append(np.zeros(j - i, np.int64))
            continue
        mark = np.zeros(n + 3, bool)
        mark[: n - 2] = (part[:-2] == MARK[0]) & (part[1:-1] == MARK[1]) & (part[2:] == MARK[2]) if n > 2 else False
        front = mark[:n].copy()
        front[3:] &= ~mark[: n - 3]
        front[own[:-1][own[:-1] < n]] = True
        start = np.flatnonzero(front)
        lens = np.diff(np.append(start, n))
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, n).astype(np.int64).tobytes()), pa.py_buffer(part.tobytes())])
        coded = words.dictionary_encode()
        d, first = B.raw(coded.dictionary)
        ids, begin = model.encode_words(d, first)
        at = coded.indices.to_numpy()
        count = np.diff(begin)[at]
        out.append(B.gather(ids, begin[:-1][at], count))
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        cut = total[np.searchsorted(start, own)]
        sizes.append(np.diff(cut))
        del lens
    first = np.zeros(len(off), np.int64)
    np.cumsum(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), out=first[1:])
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), first


def decode_column(model: Pieces, ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """The texts that runs of pieces stand for."""
    plain = np.frombuffer(b"".join(model.plain), np.uint8)
    size = np.array([len(p) for p in model.plain], np.int64)
    begin = np.cumsum(size) - size
    out, parts = [np.zeros(1, np.int64)], []
    for i, j in B.pieces(first, 1 << 18):
        own = ids[first[i] : first[j]]
        data = B.gather(plain, begin[own], size[own])
        total = np.zeros(len(own) + 1, np.int64)
        np.cumsum(size[own], out=total[1:])
        off = total[first[i : j + 1] - first[i]]
        lo = off[:-1].copy()
        if model.prefix and len(data):
            lead = (off[1:] > lo) & (data[np.minimum(lo, len(data) - 1)] == 0x20)
            lo[lead] += 1
        parts.append(B.gather(data, lo, off[1:] - lo).tobytes())
        out.append(out[-1][-1] + np.cumsum(off[1:] - lo))
    joined, out = b"".join(parts), np.concatenate(out)
    raw = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(out.tobytes()), pa.py_buffer(joined)])
    try:
        return raw.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())


def _encode(model: Pieces, check: bool):
    fall = np.array([k in (BYTE, UNKNOWN) for k in model.kinds])

    def work(batches):
        for b in batches:
            at = b.schema.get_field_index("_text")
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                text = part.column(at)
                ids, first = encode_column(model, text)
                list_ = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                total = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(fall[ids], out=total[1:])
                cols = [part.column(c) for c in range(part.num_columns) if c != at]
                cols += [list_, pa.array(total[first[1:]] - total[first[:-1]])]
                names = [n for n in b.schema.names if n != "_text"] + ["pieces", "n_fallback"]
                if check:
                    back = decode_column(model, ids, first)
                    cols.append(pa.compute.equal(back, text.fill_null("").cast(pa.large_string())))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(cols, names)

    return work


def encode(docs: DataFrame, model: Pieces, text_col: str = "text", keep: list[str] | None = None, check: bool = True) -> DataFrame:
    """The columns ``keep`` (all but the text) with pieces, n_fallback, and round_trip: whether they decode to the text.

    A kept column that has one of these names gets an underscore behind it.
    """
    from pyspark.sql import types as T

    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    new = ["pieces", "n_fallback", *(["round_trip"] if check else [])]
    slim = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("_text"))
    _ = model.trie, model.weight, model.bytes_, model.plain, model.by_words, model.reach
    schema = T.StructType([f for f in slim.schema.fields if f.name != "_text"] + [T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_fallback", T.LongType())] + [T.StructField("round_trip", T.BooleanType())] * check)
    names = [free_name(c, [*new, *(x for x in keep if x != c)]) if c.lower() in new else c for c in keep]
    return mapped(slim, _encode(model, check), schema).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], *new)


def _decode(model: Pieces):
    def work(batches):
        for b in batches:
            at = b.schema.get_field_index("pieces")
            col = b.column(at)
            n = col.value_lengths().fill_null(0).to_numpy()
            first = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=first[1:])
            text = decode_column(model, col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), first)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in range(b.num_columns) if c != at] + [text.cast(pa.string())], [x for x in b.schema.names if x != "pieces"] + ["text"])

    return work


def decode(coded: DataFrame, model: Pieces, pieces_col: str = "pieces", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the pieces and ``text``) with the decoded text; null pieces decode to ""."""
    from pyspark.sql import types as T

    keep = [c for c in coded.columns if c not in (pieces_col, "text")] if keep is None else keep
    slim = coded.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{pieces_col}`").cast("array<int>").alias("pieces"))
    _ = model.plain
    schema = T.StructType([f for f in slim.schema.fields if f.name != "pieces"] + [T.StructField("text", T.StringType())])
    names = [free_name(c, ["text", *(x for x in keep if x != c)]) if c.lower() == "text" else c for c in keep]
    return mapped(slim, _decode(model), schema).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "text")
