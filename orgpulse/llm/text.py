"""Word splitting and shingle hashing on Arrow batches, vectorised over the bytes of a batch.

A token is a maximal run of bytes of one class (see :data:`WORDS` and :data:`SIGNS`).  It becomes a
64-bit hash, a shingle a mix of its tokens' hashes; two shingles are taken as equal when their
hashes are (for two documents of 20,000 words each, a false match has odds of about 1 in 10^10).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD1342543DE82EF95)

#: 0 is a separator.  WORDS: the bytes 0x20 and 0x09-0x0D separate, all else is one class.
WORDS = np.ones(256, np.uint8)
WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
#: SIGNS: letters, digits, _ and non-ASCII are one class; other printing signs another.
SIGNS = np.full(256, 2, np.uint8)
SIGNS[[*range(0x21), 0x7F]] = 0
SIGNS[[*b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(0x80, 0x100)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

#: Bytes hashed at once.
SEGMENT = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (the splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_BYTE_LOWER = _BYTE[_LOWER]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets of the texts in them); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] \
        if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _hash_runs(data: np.ndarray, cls: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    change = np.empty(len(data), bool)
    change[0] = True
    np.not_equal(cls[1:], cls[:-1], out=change[1:])
    change[breaks] = True
    starts = np.flatnonzero(change)
    lengths = np.diff(starts, append=len(data))
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lengths)
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.add.reduceat((_BYTE_LOWER if lower else _BYTE)[data] * powers[place], starts)
    kept = cls[starts] > 0
    return mix64(sums[kept] + lengths[kept].astype(np.uint64) * _GOLDEN), starts[kept]


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORDS,
           lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts in order, offsets of the texts in them).  Works in segments cut at
    separators, so memory follows SEGMENT, not the longest text."""
    cls = classes[data]
    cuts = [0]
    if len(data) > SEGMENT:
        gaps = np.flatnonzero(cls == 0)
        while len(data) - cuts[-1] > SEGMENT:
            k = int(np.searchsorted(gaps, cuts[-1] + SEGMENT))
            if k >= len(gaps):
                break
            cuts.append(int(gaps[k]))
    cuts.append(len(data))
    hashes, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            inside = offsets[(offsets >= low) & (offsets < high)] - low
            h, s = _hash_runs(data[low:high], cls[low:high], inside, lower)
            hashes.append(h)
            starts.append(s + low)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingles(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-word shingles in order; a shorter sequence is one shingle as a whole;
    no words, no shingle."""
    count = len(word_hashes)
    if count == 0:
        return np.empty(0, np.uint64)
    width = min(n, count)
    out = np.full(count - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        out = mix64(out * _GOLDEN + word_hashes[k:k + len(out)])
    return out


def small_batches(batches: Iterator[pa.RecordBatch], column: str,
                  most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``most_bytes`` of text at most (or one row)."""
    for batch in batches:
        size = batch.column(column).nbytes
        step = max(1, int(batch.num_rows * most_bytes / max(size, 1))) if size > most_bytes else max(1, batch.num_rows)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def pieces(column: pa.Array, most_bytes: int = 4 << 20) -> Iterator[pa.Array]:
    """The same for a column on its own."""
    step = max(1, int(len(column) * most_bytes / max(column.nbytes, 1)))
    for start in range(0, len(column), step):
        yield column.slice(start, step)
