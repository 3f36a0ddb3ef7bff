"""Operator 1: benchmark decontamination by size-partitioned MinHash containment search.

Finds the test items of which a document contains at least ``threshold`` of the distinct ``n``-word
shingles.  MinHash similarity of a short item with a whole long document is near zero, so sizes are
partitioned on both sides: items fall into classes by size (up to 16, 32, 64, ... shingles), and for
each class a document is seen as overlapping windows of twice the class size.  A window that holds an
item is then at most about four times as large as the item.  Window minima come from the minima of
aligned blocks, each coarser class from the one below, so a document's shingles are hashed once per
hash function for all classes.

An item is a candidate for a document if any of ``HASHES`` minima of any window equals the item's.
With an item in one window the Jaccard similarity is 0.19 or more at containment 0.8, so a candidate
is missed with odds below (1 - 0.19) ** 64 = 2e-6; parts spread over several windows add up alike.
Every candidate is verified by exact shingle containment in the whole text, in the same task.

The items are the query set.  They are taken in blocks of ``BLOCK_SHINGLES`` shingles at most (or one
item), each block a broadcast index of bounded size and one pass over the documents without any
shuffle; the driver holds one block at a time.

Words are letters, digits and other bytes between ASCII blanks and signs, A-Z lower-cased.  Edge
cases: an item with fewer than ``n`` words is one shingle of all its words and is looked for as
such; an item without words (or null) matches nothing, as does a null or empty document; equal items
are each reported; repeated documents are each reported; ids keep their types (numbers, texts), a null one is
reported as null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orgpulse.llm.text import SIGNS, flat, mix64, pieces, shingles, small_batches, tokens

HASHES = 64
SMALLEST = 16
BLOCK_SHINGLES = 200_000
#: Letters and digits are words; signs and blanks separate.
PLAIN = np.where(SIGNS == 1, 1, 0).astype(np.uint8)
_SEEDS = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_MULTIPLIERS = (mix64(np.arange(1001, HASHES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _folded(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(32)).astype(np.uint32)


def _hashed(folded: np.ndarray, k: int, out: np.ndarray | None = None) -> np.ndarray:
    """Hash function k of shingle hashes folded to 32 bits (they are mixed already)."""
    out = np.bitwise_xor(folded, _SEEDS[k], out=out)
    return np.multiply(out, _MULTIPLIERS[k], out=out)


class ItemIndex:
    """One block of items: shingles, and per size class the items' minima of each hash function.
    Broadcast as ``vars(index)``, plain data that needs no module on the executors."""

    @classmethod
    def restored(cls, state: dict) -> ItemIndex:
        index = cls.__new__(cls)
        vars(index).update(state)
        return index

    def __init__(self, items: pa.Table, n: int):
        self.n = n
        words, offsets = tokens(*flat(items.column("text")), PLAIN)
        self.ids = items.column("item_id").to_pylist()
        self.own = [np.unique(shingles(words[a:b], n)) for a, b in zip(offsets, offsets[1:])]
        lengths = np.diff(offsets)
        self.short = {int(m): [i for i in range(len(lengths)) if lengths[i] == m]
                      for m in np.unique(lengths) if 0 < m < n}
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        by_class: dict[int, list[int]] = {}
        for i, own in enumerate(self.own):
            if lengths[i] >= n:
                by_class.setdefault(max(0, int(np.ceil(np.log2(len(own) / SMALLEST)))), []).append(i)
        for level, members in sorted(by_class.items()):
            tables = []
            for k in range(HASHES):
                minima = np.array([_hashed(_folded(self.own[i]), k).min() for i in members], np.uint32)
                order = np.argsort(minima, kind="stable")
                seen = np.zeros(1 << 16, bool)
                seen[minima & np.uint32(0xFFFF)] = True
                tables.append((seen, minima[order], np.array(members)[order]))
            self.classes[level] = tables

    def hits(self, column: pa.Array, threshold: float) -> list[tuple[int, int, int, float]]:
        """(place of the document, place of the item, shared shingles, containment) in a batch of texts."""
        words, offsets = tokens(*flat(column), PLAIN)
        lengths = np.diff(offsets)
        long = np.flatnonzero(lengths >= self.n)
        found = []
        if len(long) and self.classes:
            sequences = [shingles(words[offsets[d]:offsets[d + 1]], self.n) for d in long]
            for d, i in sorted(self._candidates(sequences)):
                shared = int(np.isin(self.own[i], sequences[d]).sum())
                if shared >= threshold * len(self.own[i]) - 1e-9:
                    found.append((int(long[d]), i, shared, shared / len(self.own[i])))
        for m, members in self.short.items():
            for d in np.flatnonzero(lengths >= m):
                runs = shingles(words[offsets[d]:offsets[d + 1]], m)
                found += [(int(d), i, 1, 1.0) for i in members if self.own[i][0] in runs]
        return found

    def _candidates(self, sequences: list[np.ndarray]) -> set[tuple[int, int]]:
        """Pairs (place of the sequence, place of the item) that agree in a minimum of some window."""
        sizes = np.array([len(s) for s in sequences])
        blocks = -(-sizes // SMALLEST)
        doc = np.repeat(np.arange(len(sizes)), blocks)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + place * SMALLEST
        levels = []  # per size class: first block of each pair below, and where a window may start
        for level in range(max(self.classes) + 1):
            pairs = None
            if level:
                pairs = np.flatnonzero(place % 2 == 0)
                doc, place = doc[pairs], place[pairs] // 2
            following = np.append(doc[1:] == doc[:-1], False)  # the next block is the same text's
            single = (place == 0) & ~following
            levels.append((pairs, doc, following, single))
        values = _folded(np.concatenate(sequences))
        scratch, found = np.empty_like(values), set()
        for k in range(HASHES):
            minima = np.minimum.reduceat(_hashed(values, k, scratch), starts)
            for level, (pairs, doc, following, single) in enumerate(levels):
                if level:
                    minima = np.minimum.reduceat(minima, pairs)
                if level in self.classes:
                    windows = np.minimum(minima, np.append(minima[1:], minima[-1]))
                    seen, keys, members = self.classes[level][k]
                    at = np.flatnonzero(seen[windows & np.uint32(0xFFFF)] & (following | single))
                    own = np.where(following[at], windows[at], minima[at])
                    low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
                    for j in np.flatnonzero(high > low):
                        found.update((int(doc[at[j]]), int(i)) for i in members[low[j]:high[j]])
        return found


def _id_type(benchmark: DataFrame) -> pa.DataType:
    return to_arrow_type(benchmark.schema["item_id"].dataType)


def _blocks(benchmark: DataFrame, n: int) -> Iterator[ItemIndex]:
    """Indexes of bounded size over all items, read one partition at a time."""
    held, words = [], 0
    kind = pa.schema([("item_id", _id_type(benchmark)), ("text", pa.string())])
    for row in benchmark.select("item_id", "text").toLocalIterator():
        held.append({"item_id": row.item_id, "text": row.text or ""})
        words += len((row.text or "").split())
        if words >= BLOCK_SHINGLES:
            yield ItemIndex(pa.Table.from_pylist(held, kind), n)
            held, words = [], 0
    if held:
        yield ItemIndex(pa.Table.from_pylist(held, kind), n)


def contained_items(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows ``(doc_id, item_id, n_shared, n_item, containment)``, one per document and contained item."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, n_shared long, n_item long, containment double"
    spark, id_type = docs.sparkSession, _id_type(benchmark)
    result = None
    for index in _blocks(benchmark, n):
        shared = spark.sparkContext.broadcast(vars(index))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = ItemIndex.restored(shared.value)
            for batch in small_batches(batches, "text"):
                rows = own.hits(batch.column("text"), threshold)
                place, item, count, part = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(place, pa.int64())),
                     pa.array([own.ids[i] for i in item], id_type), pa.array(count, pa.int64()),
                     pa.array([len(own.own[i]) for i in item], pa.int64()), pa.array(part, pa.float64())],
                    names=["doc_id", "item_id", "n_shared", "n_item", "containment"])

        part = docs.select("doc_id", "text").mapInArrow(search, schema)
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], schema) if result is None else result


def _is_clean(index_of: Callable[[], ItemIndex], threshold: float) -> Callable[[Column], Column]:
    @F.arrow_udf("boolean")
    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = index_of()
        for part in parts:
            good = [np.ones(0, bool)]
            for piece in pieces(part):
                good.append(np.ones(len(piece), bool))
                good[-1][[hit[0] for hit in own.hits(piece, threshold)]] = False
            yield pa.array(np.concatenate(good))

    return clean


def keep_clean(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item."""
    for index in _blocks(benchmark, n):
        shared = docs.sparkSession.sparkContext.broadcast(vars(index))
        docs = docs.where(_is_clean(lambda shared=shared: ItemIndex.restored(shared.value), threshold)(F.col("text")))
    return docs
