"""Vectorised text primitives over Arrow string columns.

Everything works on the UTF-8 buffer of a whole batch, so no Python object is made per word.  Batches are cut into
chunks of about CHUNK bytes (a longer document is a chunk of its own), which bounds the working memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19

#: The white space of all word contracts, bytes 0x09-0x0D and 0x20.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection), so that every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[int(base)] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_FOLDED = _BYTE[_LOWER]


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of consecutive rows; every row is in exactly one chunk, whole."""
    data, offsets = string_buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs without white space), and each row's range of words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edge] = word[edge]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = word[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of each span of bytes; fold: A-Z count as a-z."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * _pow(_BASE, len(data)), out=total[1:], dtype=np.uint64)
    return mix((total[ends] - total[starts]) * _pow(_INV, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word windows and each row's range of them; a row of 1 to k-1 words has one, of all its words."""
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.zeros(len(bounds), np.int64)
    np.cumsum(n, out=out[1:])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    first = np.repeat(bounds[:-1] - out[:-1], n) + np.arange(out[-1])
    left = np.repeat(counts, n)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    total = np.zeros(out[-1], np.uint64)
    for j in range(k):
        term = padded[first + j] * np.uint64((2 * j + 1) * 0xA0761D6478BD642F & (1 << 64) - 1 | 1)
        total += np.where(j < left, mix(term + np.uint64(j)), np.uint64(0)) if k > 1 else term
    return mix(total + np.minimum(left, k).astype(np.uint64)), out


# --- the pieces that the byte-level vocabularies merge in -----------------------------------------------------------

_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of each code point: 0 letter, 1 number, 2 white space, 3 other."""
    global _classes
    if _classes is None:
        import regex

        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, 3, np.uint8)
        for value, pattern in ((0, r"\p{L}+"), (1, r"\p{N}+"), (2, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, points):
                a, b = ord(m[0][0]), ord(m[0][-1])
                table[a : b + 1] = value
        table[0xD800:0xE000] = 3
        _classes = table
    return _classes


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and each row's range of the matches of the public byte-level pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, which cover every byte."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, np.zeros(len(offsets), np.int64)
    head = (data & 0xC0) != 0x80
    byte_at = np.flatnonzero(head)
    points = np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    kind = char_classes()[points]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(head, out=before[1:])
    row_at = before[offsets]
    first = np.zeros(n + 1, bool)
    first[row_at] = True  # rows begin here; n itself ends the last
    run = np.ones(n, bool)
    run[1:] = kind[1:] != kind[:-1]
    run |= first[:-1]
    space = kind == 2
    after_blank = np.zeros(n, bool)
    after_blank[1:] = points[:-1] == 32
    after_blank &= ~first[:-1]
    start = run & (space | ~after_blank)
    # the last of a run of white space stands alone, or leads what follows in the same row
    nxt_run = np.zeros(n, bool)
    nxt_run[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
    start |= nxt_run
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        far = np.zeros(len(quote) * 3, np.int64).reshape(3, -1)
        same = np.ones(len(quote), bool)
        for j in (1, 2):
            at = np.minimum(quote + j, n - 1)
            same &= (quote + j < n) & ~first[np.minimum(quote + j, n)]
            far[j] = np.where(same, points[at], 0)
        one = np.isin(far[1], [ord(c) for c in "stmd"])
        two = ((far[1] == ord("r")) | (far[1] == ord("v"))) & (far[2] == ord("e")) | (far[1] == ord("l")) & (far[2] == ord("l"))
        two &= ~one
        hit = quote[one | two]
        start[hit + 1] = False
        stop = np.concatenate([quote[one] + 2, quote[two] + 3])
        start[stop[stop < n]] = True
    starts = byte_at[np.flatnonzero(start)]
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


def gather(flat: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of flat[at[c]:at[c+1]] for each c of codes, and where each begins (one more at the end)."""
    n = np.diff(at)[codes]
    out = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    return flat[np.repeat(at[:-1][codes] - out[:-1], n) + np.arange(out[-1])], out


class WordTable:
    """Distinct byte strings of the text so far with what ``fill`` says of each; starts anew beyond ``most`` of them, or 16 bytes times as many."""

    def __init__(self, fill, most: int = 150_000):
        self.fill, self.most, self.known, self.size = fill, most, {}, 0

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list]:
        """Each span's index, and the list of values that the indices point into.  Spans count as one if 64-bit hashes agree."""
        import pandas as pd

        codes, distinct = pd.factorize(span_hashes(data, starts, ends))
        where = np.empty(len(distinct), np.int64)
        where[codes[::-1]] = np.arange(len(codes))[::-1]
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        if len(self.known) > self.most or self.size > 16 * self.most:
            self.known.clear()
            self.size = 0
        if new := [k for k in dict.fromkeys(keys) if k not in self.known]:
            self.size += sum(map(len, new))
            self.known.update(zip(new, self.fill(new), strict=True))
        return codes, [self.known[k] for k in keys]
