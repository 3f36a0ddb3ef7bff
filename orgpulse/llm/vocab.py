"""Tokenizer files for the operators that encode texts, and texts cut into units that encode alone.

The file of a tokenizer is read on the driver and its bytes travel to the workers, so executors need
not have it.  The texts of a slice are cut where neither the splitting pattern nor the merges of a
vocabulary can reach across, with numpy over their bytes; equal units of a slice are encoded once (many of
them joined into one call of the library), and the ids are dealt back to the texts by array indices.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from orgpulse.llm.text import flat, small_batches

#: Bytes of text worked on at once, and units joined into one call.
SLICE, JOINED = 8 << 20, 2000


def vocabulary(name: str) -> bytes:
    """The bytes of a tokenizer file: a path, or the name of one of the installed public vocabularies."""
    if not os.path.exists(name):
        import public_tokenizers
        name = public_tokenizers.path(name)
    with open(name, "rb") as f:
        return f.read()


def json_tokenizer(data: bytes):
    """A tokenizer of the tokenizers library that stays in its own process and thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_buffer(data)


def byte_level_bytes(token: str) -> bytes:
    """The bytes a byte-level entry stands for: printable Latin-1 characters are their own byte, the other
    bytes follow in order from U+0100 on."""
    return bytes(_BYTE_OF[c] for c in token)


_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _OWN} | {chr(0x100 + k): b for k, b in enumerate(sorted({*range(256)} - {*_OWN}))}


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece: UTF-8, U+2581 as a space, <0xHH> as that byte."""
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def gathered(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut, and small ones put together, to about ``most_bytes`` of text."""
    held, size = [], 0
    for batch in small_batches(batches, column, most_bytes):
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most_bytes // 2:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def is_utf8(data: np.ndarray) -> bool:
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        return False
    return True


def texts_of(column: pa.Array, bad: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets); a text that is not UTF-8 becomes ``bad``, or gets U+FFFD in place
    of its bad bytes."""
    data, offsets = flat(column)
    if is_utf8(data):
        return data, offsets
    texts = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
    texts = [t if (fixed := t.decode(errors="replace").encode()) == t else fixed if bad is None else bad for t in texts]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def distinct_units(data: np.ndarray, starts: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes]]:
    """Units ``data[starts[k]:starts[k + 1]]`` (those ``wanted``): the number of each one's value, and the values."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    if wanted is not None:
        units = units.filter(pa.array(wanted))
    coded = units.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), then the same for the next."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


#: Classes of bytes for :class:`WordCoder`: white space, letters, digits, signs; the rest is left whole.
_WHITE, _LETTER, _DIGIT, _SIGN, _REST = range(5)
_CLASS = np.full(256, _REST, np.uint8)
_CLASS[[*range(0x21, 0x7F)]] = _SIGN
_CLASS[[*b" \t\n\r"]] = _WHITE
_CLASS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = _LETTER
_CLASS[[*b"0123456789"]] = _DIGIT
_CLASS[[*b"'<>|"]] = _REST  # contractions and control strings
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
#: Second bytes (after 0xC3) of the letters of Latin-1.
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
#: The lower-case letters, digits and signs that units are made of.
_PLAIN_TEXT = bytes(b for b in range(0x21, 0x7F) if _CLASS[b] != _REST and _LOWER[b] == b) + \
    b"".join(bytes([0xC3, b]) for b in range(0x9F, 0xC0) if _LATIN[b])


class WordCoder:
    """Ids of texts under a lower-casing vocabulary of words with an end mark, whose pattern drops white space
    and splits letters, single digits and signs.

    Units are runs of letters (ASCII and Latin-1), digits and runs of signs; a word with any other byte (other
    scripts, marks that combine, apostrophes of contractions, what control strings are made of) is one unit and
    is encoded by a call of its own.  All others end with exactly one id that carries the end mark."""

    def __init__(self, file: bytes, mark: str = "</w>"):
        self.coder = json_tokenizer(file)
        letters = _PLAIN_TEXT.decode()
        if self.coder.normalizer is not None and self.coder.normalizer.normalize_str(letters) != letters:
            raise ValueError("the vocabulary changes lower-case letters, digits or signs")
        # units come in lower case, which its normaliser leaves as it is
        self.plain = json_tokenizer(json.dumps(json.loads(file) | {"normalizer": None}).encode())
        self.size = self.coder.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in self.coder.get_vocab(with_added_tokens=False).items() if t.endswith(mark)]] = True

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        if not len(data):
            return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
        cls = _CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[_LATIN[data[lead + 1]]]
        cls[lead] = cls[lead + 1] = _LETTER
        change = np.empty(len(data), bool)
        change[0] = True
        np.not_equal(cls[1:], cls[:-1], out=change[1:])
        change |= cls == _DIGIT
        first_bytes = offsets[:-1][offsets[:-1] < len(data)]
        change[first_bytes] = True
        starts = np.flatnonzero(change)
        kind = cls[starts]
        opens = kind == _WHITE
        opens[1:] |= opens[:-1]
        opens[0] = True
        opens[np.searchsorted(starts, first_bytes)] = True
        word = np.cumsum(opens) - 1
        whole = np.bincount(word, weights=kind == _REST)[word] > 0
        kept = opens | ~whole
        starts, kind, whole = starts[kept], kind[kept], whole[kept]
        lengths = np.diff(starts, append=len(data))
        lower = _LOWER[data]
        capital = lead[_LATIN[data[lead + 1]] & (data[lead + 1] < 0x9F)] + 1
        lower[capital] += 0x20
        lower = np.where(np.repeat(whole, lengths), data, lower)
        said = kind != _WHITE
        number, values = distinct_units(lower, starts, said)
        single = np.zeros(len(values), bool)
        single[number] = whole[said]
        ids, counts = self._values(values, single)
        first = np.cumsum(counts) - counts
        per_unit = np.zeros(len(starts), np.int64)
        per_unit[said] = counts[number]
        before = np.concatenate(([0], np.cumsum(per_unit)))
        return ids[ranges(first[number], counts[number])], before[np.searchsorted(starts, offsets)]

    def _values(self, values: list[bytes], single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all values, number of ids of each)."""
        plain, own = np.flatnonzero(~single), np.flatnonzero(single)
        counts, found = np.zeros(len(values), np.int64), {}
        alone = lambda at: [np.array(c.ids, np.int64) for c in self.coder.encode_batch_fast(
            [values[k].decode() for k in at], add_special_tokens=False)]
        for start in range(0, len(plain), JOINED):
            at = plain[start:start + JOINED]
            ids = np.array(self.plain.encode_batch_fast(
                [b" ".join([values[k] for k in at]).decode()], add_special_tokens=False)[0].ids, np.int64)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(at) and last[-1] == len(ids) - 1:
                counts[at] = np.diff(last, prepend=-1)
                found[start] = ids
            else:
                parts = alone(at)
                counts[at] = [*map(len, parts)]
                found[start] = np.concatenate(parts)
        rest = alone(own)
        counts[own] = [*map(len, rest)]
        got = np.concatenate([np.empty(0, np.int64), *found.values(), *rest])
        order = np.concatenate((plain, own))  # the values in the order of their ids
        first = np.empty(len(values), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return got[ranges(first, counts)], counts


class WholeCoder:
    """Ids of texts, each encoded whole, under any vocabulary."""

    def __init__(self, file: bytes):
        self.coder = json_tokenizer(file)
        self.size = self.coder.get_vocab_size()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
        ids = [np.array(c.ids, np.int64) for c in self.coder.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.int64), *ids]), np.cumsum([0, *map(len, ids)])


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts, each of which begins with a space, can be cut: their starts, and the spaces between two
    characters that are neither white space nor U+2581 (the sign of pieces for a space).  A byte-level pattern
    begins a new run there, and no piece reaches across.  Characters whose bytes may be of such a sign (C2, E1,
    E2, E3 lead them) count as one, which only leaves units longer."""
    at = np.flatnonzero(data == 0x20)
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[~begins[at] & ~begins[at - 1] & ~begins[at + 1]]
    at = at[_PLAIN_START[data[at + 1]]]
    begins[at[_plain_end(data, at)]] = True
    return np.flatnonzero(begins[:-1])


#: First bytes of characters that are surely neither white space nor U+2581.
_PLAIN_START = np.zeros(256, bool)
_PLAIN_START[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


def _plain_end(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each of these places is surely neither white space nor U+2581."""
    out = _PLAIN_START[data[at - 1]]
    long = np.flatnonzero(data[at - 1] >= 0x80)
    lead = at[long] - 1
    for _ in range(3):
        lead = np.where((data[lead] & 0xC0) == 0x80, np.maximum(lead - 1, 0), lead)
    out[long] = _PLAIN_START[data[lead]]
    return out


def are_plain(units: list[bytes]) -> np.ndarray:
    """Which units (after a space) begin and end with such characters, so that they can be joined."""
    data = np.frombuffer(b"".join(units), np.uint8)
    ends = np.cumsum([*map(len, units)], dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    long = ends - starts > 1
    out = np.zeros(len(units), bool)
    out[long] = _PLAIN_START[data[starts[long] + 1]] & _plain_end(data, ends[long])
    return out
