"""Operator 10: removal of repeated passages of ``length`` bytes, over all documents at once.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a
smaller doc_id, or earlier in the same one.

The dealt method, a full suffix array by external induced sorting, sorts every suffix of the corpus;
the README gives the figures for which it is not used.  Only equality of strings of one length is
asked, so this operator sorts a sample of positions that equal strings share by construction, and
induces the rest from them, as induced sorting does from its sampled suffixes:

1. *Copies.*  Of documents with equal bytes only the first takes part; the later ones go whole.
2. *Anchors.*  The anchor of a string of ``length`` bytes is its leftmost ``GRAM``-byte substring with
   the smallest hash.  Equal strings have equal anchors at equal places, so they meet at their anchor;
   neighbouring strings mostly share one, about one in 32 positions.  An anchor carries the range of
   strings it serves and a hash of all bytes they cover (its context).
3. *Equal contexts.*  Anchors are aggregated by hash, with map-side combining.  If an anchor's context
   occurs earlier, all strings it serves are repeated.
4. *Other contexts.*  Anchors with several contexts (ends of passages, edits, phrases that recur by
   chance) induce their strings in two steps, once per context.  The strings whose anchor lies
   ``QUARTER`` * j bytes or up to 15 more behind their start all hold one core of ``length`` - 15
   bytes; cores are aggregated and settled by context like anchors, and only strings of cores that
   several contexts share are aggregated one by one, by anchor, place and a hash of their bytes.  All
   but the first are repeated.
5. Ranges are gathered per document and its bytes removed.

Strings are told apart by 128 bits from two independent hashes (anchor and string).

Result: one row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes).
Edge cases: a null text has no bytes; texts shorter than ``length`` stay; rows of one doc_id and text
are one document and get the same result; of one doc_id with different texts the one with the smaller
hash counts as earlier; a null doc_id comes before all others; an empty table gives an empty result;
other columns are ignored.  Removal may cut a character; ``kept`` is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.scratch import Scratch, small
from orgpulse.llm.text import mix64, small_batches

#: Strings served by one anchor start at most SPAN - 1 bytes before it; 6 bits in a packed place.
SPAN = 64
QUARTER = 16
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd
_VALUES = tuple(mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in _BASES)
#: Bytes whose prefix sums are held at once.
PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


_POWER = tuple(_powers(b, PIECE + 4096) for b in _BASES)
_INVERSE = tuple(_powers(pow(b, -1, 1 << 64), PIECE + 4096) for b in _BASES)


class Prefix:
    """Polynomial prefix sums of a piece of text; hashes of substrings by start and length."""

    def __init__(self, data: np.ndarray, kind: int):
        self.kind = kind
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[kind][data] * _POWER[kind][:len(data)], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        """Of every substring of one length."""
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * _INVERSE[self.kind][:n])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * _INVERSE[self.kind][starts] + (ends - starts).astype(np.uint64))


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum in every window, by doubling the width."""
    place = np.arange(len(values))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = place[:len(place) - step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        reach += step
    return place


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first string, last string) of the anchors of all strings of ``length`` bytes."""
    gram = length - SPAN + 1
    found: list[tuple] = []
    strings = len(data) - length + 1
    for low in range(0, max(strings, 0), PIECE):
        high = min(low + PIECE, strings)
        grams = Prefix(data[low:high + length - 1], 0).all(gram)
        place = _sliding_argmin(grams, SPAN)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], len(place)) - 1
        found.append((grams[place[first]], place[first] + low, first + low, last + low))
    if not found:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _bytes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for text in batch.column("text").cast(pa.large_binary()):
        value = text.as_buffer()
        yield np.frombuffer(value, np.uint8) if value is not None else np.empty(0, np.uint8)


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, context, doc_id, variant, spot): spot packs the first string (from bit 12), the anchor's
    distance from it and the number of further strings (6 bits each)."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows, keys, contexts, spots = [], [], [], []
            for row, data in enumerate(_bytes_of(batch)):
                key, place, first, last = anchors(data, length)
                if len(key):
                    shape = ((place - first) << 6 | (last - first)).astype(np.uint64)
                    rows.append(np.full(len(key), row))
                    keys.append(key)
                    contexts.append(mix64(_between(data, first, last + length, 1) + shape))
                    spots.append(first << 12 | shape.astype(np.int64))
            at = pa.array(_joined(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_joined(keys)), pa.array(_joined(contexts)), batch.column("doc_id").take(at),
                 batch.column("variant").take(at), pa.array(_joined(spots))],
                names=["anchor", "context", "doc_id", "variant", "spot"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(find, f"anchor long, context long, doc_id {kind}, variant long, spot long")


def _unpack(spots: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, anchor, number of strings) of packed spots."""
    spot = np.sort(np.array(spots.as_py(), np.int64))
    return spot >> 12, (spot >> 12) + (spot >> 6 & 63), (spot & 63) + 1


def _spread(count: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 for each entry, in a row."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _core_rows(data: np.ndarray, spots: pa.Scalar, length: int) -> tuple[np.ndarray, ...]:
    """(key, hash of the core, context and spot of its strings) for every core of the listed anchors."""
    first, place, count = _unpack(spots)
    low, high = (place - first - count + 1) // QUARTER, (place - first) // QUARTER
    parts = high - low + 1
    j = np.repeat(low, parts) + _spread(parts)
    begin = np.maximum(np.repeat(first, parts), np.repeat(place, parts) - QUARTER * j - QUARTER + 1)
    end = np.minimum(np.repeat(first + count - 1, parts), np.repeat(place, parts) - QUARTER * j)
    place = np.repeat(place, parts)
    core = place - QUARTER * j
    key = mix64(_at(data, place, length - SPAN + 1, 0) + j.astype(np.uint64))
    shape = (place - begin) << 6 | (end - begin)
    context = mix64(_between(data, begin, end + length, 1) + shape.astype(np.uint64))
    return key, _at(data, core, length - QUARTER + 1, 1), context, begin << 12 | shape


def _string_rows(data: np.ndarray, spots: pa.Scalar, length: int) -> tuple[np.ndarray, ...]:
    """(key, hash of the string, no context, its start) for every string of the listed spots."""
    first, place, count = _unpack(spots)
    start, place = np.repeat(first, count) + _spread(count), np.repeat(place, count)
    key = mix64(_at(data, place, length - SPAN + 1, 0) + (place - start).astype(np.uint64))
    return key, _at(data, start, length, 1), np.zeros(len(start), np.int64), start


def _induced(firsts: DataFrame, lists: DataFrame, length: int, cut) -> DataFrame:
    """(key, hash, context, doc_id, variant, spot): what ``cut`` makes of the listed spots of each document."""
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            rows, keys, hashes, contexts, spots = [], [], [], [], []
            for row, (data, own) in enumerate(zip(_bytes_of(batch), batch.column("spots"))):
                key, code, context, spot = cut(data, own, length)
                rows.append(np.full(len(key), row))
                keys.append(key)
                hashes.append(code)
                contexts.append(context)
                spots.append(spot)
            at = pa.array(_joined(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_joined(keys)), pa.array(_joined(hashes)), pa.array(_joined(contexts)),
                 batch.column("doc_id").take(at), batch.column("variant").take(at), pa.array(_joined(spots))],
                names=["key", "hash", "context", "doc_id", "variant", "spot"])

    kind = firsts.schema["doc_id"].dataType.simpleString()
    theirs = lists.select(F.col("doc_id").alias("_id"), F.col("variant").alias("_variant"), "spots")
    texts = firsts.join(_same(lists), _on(), "left_semi").join(theirs, _on()).select("doc_id", "variant", "text", "spots")
    return texts.mapInArrow(rows_of, f"key long, hash long, context long, doc_id {kind}, variant long, spot long")


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(p.view(np.int64) for p in parts)])


def _between(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of substrings, in the order of ``starts``."""
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(starts, kind="stable")
    ranked, until = starts[order], ends[order]
    for low in range(0, len(data), PIECE):
        a, b = np.searchsorted(ranked, (low, low + PIECE))
        if b > a:
            prefix = Prefix(data[low:int(until[a:b].max())], kind)
            out[order[a:b]] = prefix.at(ranked[a:b] - low, until[a:b] - low)
    return out


def _at(data: np.ndarray, starts: np.ndarray, length: int, kind: int) -> np.ndarray:
    """Hashes of substrings of one length, in the order of ``starts``."""
    return _between(data, starts, starts + length, kind)


def _same(ids: DataFrame) -> DataFrame:
    return small(ids.select(F.col("doc_id").alias("_id"), F.col("variant").alias("_variant")))


def _on() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("variant") == F.col("_variant"))


def _settled(rows: DataFrame, by: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of rows ``(*by, context, doc_id, variant, spot)`` that agree in ``by``: the ranges of strings whose
    context occurs earlier, and (doc_id, variant, spots) of the first of each context where there are
    several."""
    where = F.struct("doc_id", "variant", "spot")
    # written, so that the join below has plain sides and a hot key's partition can be split
    again = scratch.keep(rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by))
    seen = scratch.keep(rows.join(again, by))
    contexts = scratch.keep(seen.groupBy(*by, "context").agg(F.min(where).alias("first"), F.count("*").alias("n")))
    whole = scratch.keep(seen.join(contexts.where("n > 1").select(*by, "context", "first"), [*by, "context"]).where(
        where != F.col("first")).select(
        "doc_id", "variant", (F.shiftleft(F.shiftright("spot", 12), 12) + F.col("spot").bitwiseAND(63)).alias("range")))
    several = contexts.groupBy(*by).agg(F.count("*").alias("kinds")).where("kinds > 1").select(*by)
    lists = scratch.keep(contexts.join(several, by).select("first.*").groupBy("doc_id", "variant").agg(
        F.collect_list("spot").alias("spots")))
    scratch.drop(again, seen, contexts)
    return whole, lists


def repeated_ranges(firsts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(doc_id, variant, ranges): starts (from bit 12) and numbers less one of successive strings that
    also start earlier."""
    by_anchor, lists = _settled(_anchor_rows(firsts, length), ["anchor"], scratch)
    cores = scratch.keep(_induced(firsts, lists, length, _core_rows))
    by_core, deeper = _settled(cores, ["key", "hash"], scratch)
    scratch.drop(lists, cores)
    strings = scratch.keep(_induced(firsts, deeper, length, _string_rows).drop("context"))
    where = F.struct("doc_id", "variant", "spot")
    earliest = strings.groupBy("key", "hash").agg(F.count("*").alias("n"), F.min(where).alias("first")).where("n > 1").drop("n")
    single = strings.join(earliest, ["key", "hash"]).where(where != F.col("first")).select(
        "doc_id", "variant", F.shiftleft("spot", 12).alias("range"))
    ranges = scratch.keep(by_anchor.union(by_core).union(single).groupBy("doc_id", "variant").agg(
        F.collect_list("range").alias("ranges")))
    scratch.drop(by_anchor, by_core, deeper, strings)
    return ranges


def _cut(data: np.ndarray, ranges: np.ndarray, length: int) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, remaining bytes)."""
    edges = np.zeros(len(data) + 1, np.int32)
    np.add.at(edges, ranges >> 12, 1)
    np.add.at(edges, (ranges >> 12) + (ranges & 0xFFF) + length, -1)
    gone = np.cumsum(edges[:-1]) > 0
    runs = int(np.count_nonzero(gone & ~np.append(False, gone[:-1]))) if len(gone) else 0
    return int(gone.sum()), runs, data[~gone].tobytes()


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept."""
    if length <= SPAN:
        raise ValueError(f"length must be over {SPAN}")
    scratch = Scratch(docs.sparkSession, "passages")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("variant"), F.coalesce("text", F.lit("")).alias("text"))
    sized = F.octet_length("text")
    named = keyed.select("doc_id", "variant", digest.alias("digest"), sized.alias("size"))
    spot = F.struct("doc_id", "variant")
    groups = named.where(F.col("size") >= length).groupBy("digest").agg(
        F.min(spot).alias("first"), F.max(spot).alias("last")).where("first <> last").select("digest", "first")
    copies = scratch.keep(named.join(groups, "digest").where(spot != F.col("first")).select("doc_id", "variant").distinct())
    firsts = keyed.where(sized >= length).join(_same(copies), _on(), "left_anti")
    ranges = repeated_ranges(firsts, length, scratch)
    whole = copies.select("doc_id", "variant", F.lit(None).cast("array<long>").alias("ranges"))
    cuts = scratch.keep(ranges.union(whole))
    scratch.drop(ranges, copies)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            out: list[list] = [[], [], [], []]
            for data, own in zip(_bytes_of(batch), batch.column("ranges")):
                done = _cut(data, np.array(own.as_py(), np.int64), length) if own.is_valid else (len(data), 1, b"")
                for column, value in zip(out, (len(data), *done)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    theirs = cuts.select(F.col("doc_id").alias("_id"), F.col("variant").alias("_variant"), "ranges")
    touched = keyed.join(_same(cuts), _on(), "left_semi").join(theirs, _on()).select("doc_id", "text", "ranges").mapInArrow(
        remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    rest = keyed.join(_same(cuts), _on(), "left_anti").select(
        "doc_id", sized.cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return touched.union(rest)
