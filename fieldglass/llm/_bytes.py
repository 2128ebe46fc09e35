"""Vectorised work on the bytes of an Arrow string column.

A batch of texts is one byte buffer with row offsets.  Word spans, word
hashes and shingle hashes come from a few numpy passes over that buffer,
never from a Python loop over words.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that ends a word: blank and the controls tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower case for A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: What is no letter: ASCII other than A-Z and a-z. Bytes of other scripts count as letters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_P = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xD6E8FEB86659FD93)
#: Spans longer than this are hashed one at a time by BLAKE2.
LONG = 64
#: The bytes of a word that belong to a span, by their number.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def tidy() -> None:
    """Give freed memory back to the system: a worker lives longer than its task."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def released(work):
    """``work`` on a task's batches; what it freed goes back when it has ended."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            tidy()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    if pa.types.is_null(kind):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges of at most ``most`` bytes each, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word spans, and each row's first word (n_rows + 1)."""
    n = len(data)
    word = np.zeros(n + 1, bool)
    np.logical_not(space[data], out=word[:n])
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = word[: n - 1]
    starts = np.flatnonzero(word[:n] & (~before | cut[:n]))
    ends = np.flatnonzero(word[:n] & (~word[1:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, A-Z lower-cased if ``fold``; lanes are independent.

    Eight bytes are taken up at a time, each time through a bijective mixing:
    spans of one length up to eight never collide, and no pattern of bytes cancels out.
    """
    n = len(data)
    held = np.zeros(n + 8, np.uint8)
    held[:n] = FOLD[data] if fold else data
    words = np.ndarray((n + 1,), "<u8", held, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) * _P + mix(np.full(1, lane + 1, np.uint64)))
    own, short = np.arange(len(size)), size <= LONG
    if not short.all():
        own = own[short]
        for i in np.flatnonzero(~short).tolist():
            digest = hashlib.blake2b(held[starts[i] : ends[i]].tobytes(), digest_size=8, salt=lane.to_bytes(8, "little")).digest()
            out[i] = int.from_bytes(digest, "little")
    step = 0
    while len(own):
        left = size[own] - step
        own, left = (own, left) if (left > 0).all() else (own[left > 0], left[left > 0])
        if not len(own):
            break
        taken = words[starts[own] + step] & _MASK[np.minimum(left, 8)]
        out[own] = mix((out[own] ^ taken) * _C)
        step += 8
    return out


def shingles(words: np.ndarray, first: np.ndarray, k: int, other: np.ndarray | None = None):
    """(hashes of each row's runs of k words, or of all its words if fewer; each row's first run).

    ``other``: a second lane of the words; then the runs' second hashes come last.
    """
    count = np.diff(first)
    n = len(words)
    runs = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    begin = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs, out=begin[1:])
    rows = np.repeat(np.arange(len(runs)), runs)
    at = first[:-1][rows] + np.arange(begin[-1]) - begin[:-1][rows]
    short = count[rows] < k

    def chained(lane: np.ndarray, whole: bool) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j in range(k if n else 0):
            use = ~short | (j < count[rows])
            nxt = out * _C + lane[np.minimum(at + j, n - 1)] + np.uint64(j + 1)
            nxt = mix(nxt) if whole else nxt
            out = nxt if use.all() else np.where(use, nxt, out)
        return out if whole else mix(out)

    return (chained(words, True), begin) if other is None else (chained(words, True), begin, chained(other, False))


def sets(hashed: np.ndarray, begin: np.ndarray, other: np.ndarray | None = None):
    """(each row's distinct values, sorted; the rows' first positions); with ``other`` its values come last."""
    out, second, size = [], [], np.zeros(len(begin), np.int64)
    for r in range(len(begin) - 1):
        a = hashed[begin[r] : begin[r + 1]]
        if other is None:
            a = np.sort(a)
        else:
            order = np.argsort(a)
            a, o = a[order], other[begin[r] : begin[r + 1]][order]
        if len(a) > 1:
            fresh = np.concatenate(([True], a[1:] != a[:-1]))
            a = a[fresh]
            if other is not None:
                o = o[fresh]
        out.append(a)
        if other is not None:
            second.append(o)
        size[r + 1] = len(a)
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return (joined(out), np.cumsum(size)) if other is None else (joined(out), np.cumsum(size), joined(second))


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of data[start : start + length]."""
    total = int(lengths.sum())
    if not total:
        return data[:0]
    end = np.cumsum(lengths)
    return data[np.arange(total) + np.repeat(starts - (end - lengths), lengths)]


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
