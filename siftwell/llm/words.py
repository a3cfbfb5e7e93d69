"""Words of whole Arrow columns as 64-bit hashes, without a Python object for each word.

The text column's own buffer is used. Bytes are folded (A-Z only) and split by a table of 256
entries; a polynomial prefix sum gives all words' hashes at once. Non-ASCII characters are word
characters in both alphabets, so that bytes give the same words as characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Words are what lies between white space: [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words are letters, digits and all that isn't ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after folding
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True

CHUNK = 1 << 20
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in their order."""
    return mix(np.asarray(a, np.uint64) * np.uint64(0xD6E8FEB86659FD93) + mix(np.asarray(b, np.uint64) + np.uint64(0x2545F4914F6CDD1D)))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        up = np.full(size, _R, np.uint64)
        down = np.full(size, _R_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def _hash(data: np.ndarray, cuts: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of data's words, and for each cut (text starts and the end) how many words begin before it."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(cuts), np.int64)
    data = FOLD[data]
    inside = word[data]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    raw = (sums[end] - sums[begin]) * down[begin]
    return mix(raw + (end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), np.searchsorted(begin, cuts)


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(_hash(data, np.array([0, len(data)]), np.ones(256, bool))[0][0])


def columns(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column (nulls as empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1)
    offsets = offsets.astype(np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_words(texts: pa.Array, word: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, word hashes, offsets into them for each text) for runs of whole texts of about a chunk."""
    data, offsets = columns(texts)
    n, i = len(texts), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk, "right")) - 1)
        part = data[offsets[i] : offsets[j]]
        if j == i + 1 and len(part) > chunk:
            hashes = np.concatenate([_hash(p, np.array([0, len(p)]), word)[0] for p in _slices(part, word, chunk)])
            yield i, hashes, np.array([0, len(hashes)])
        else:
            yield i, *_hash(part, offsets[i : j + 1] - offsets[i], word)
        i = j


def _slices(part: np.ndarray, word: np.ndarray, chunk: int) -> Iterator[np.ndarray]:
    """A very long text in slices that end between words."""
    at = 0
    while at < len(part):
        end, inside = min(at + chunk, len(part)), True
        while inside and end < len(part):  # on to the next byte that is in no word
            ahead = np.flatnonzero(~word[FOLD[part[end : end + chunk]]])
            inside = not len(ahead)
            end += int(ahead[0]) if len(ahead) else min(chunk, len(part) - end)
        yield part[at:end]
        at = end


def batches(rows: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about limit bytes of text."""
    for rb in rows:
        size = rb.column(rb.schema.get_field_index(column)).nbytes
        step = max(1, rb.num_rows * limit // max(size, limit))
        for i in range(0, rb.num_rows, step):
            yield rb.slice(i, step)
