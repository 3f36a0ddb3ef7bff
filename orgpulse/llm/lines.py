"""Operator 8: line dedup on content-defined chunks of lines.

A text is its lines (between line feeds).  A rolling hash over the hashes of ``WINDOW`` successive
lines ends a chunk wherever it is divisible by ``divisor`` and the chunk has two lines, so boundaries
depend on the lines around them alone and an inserted or deleted line moves only the chunks next to
it; only a text of one line has a chunk of one line.  A chunk of two or more lines that also occurs
earlier (smaller doc_id, or earlier in the same text) is removed, after its bytes are compared with
the first occurrence's.  A repeated passage in other surroundings goes as far as it holds whole
chunks.  With ``chunkings`` above 1 a text is cut by so many independent hashes; a line goes if a chunk
of any of them goes (the same line then stands at an earlier place), so short passages are found, too.

Chunks are found by a 128-bit hash, aggregated with map-side combining; only chunks whose hash
repeats carry their bytes to a join.  Result of :func:`dedup_lines`: one row per row of ``docs`` with
doc_id, n_lines, removed_lines, removed_chunks (different ones, which may overlap) and the remaining ``text``.

Edge cases: a null text stays null and has no lines; an empty text is one empty line; rows of one
doc_id and text are one document and get the same result; of one doc_id with different texts the one
with the smaller hash counts as earlier; a null doc_id comes before all others; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.scratch import Scratch, small, small_lists
from orgpulse.llm.text import mix64, small_batches

WINDOW = 2


def chunk_ends(lines: list[bytes], divisor: int, chunking: int = 0) -> list[int]:
    """End (exclusive) of each chunk of lines."""
    return _ends(np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, count=len(lines)), divisor, chunking)


def _ends(hashes: np.ndarray, divisor: int, chunking: int) -> list[int]:
    rolled = np.full(len(hashes), chunking * 0xD1B54A32D192ED03 & (1 << 64) - 1, np.uint64)
    for back in range(min(WINDOW, len(hashes))):
        rolled[back:] += hashes[:len(hashes) - back] * np.uint64(0x9E3779B97F4A7C15 ** (back + 1) & (1 << 64) - 1)
    ends = [0]
    for end in (np.flatnonzero(mix64(rolled) % np.uint64(divisor) == 0) + 1).tolist():
        if end - ends[-1] > 1 and len(hashes) - end != 1:
            ends.append(end)
    if ends[-1] != len(hashes):
        ends.append(len(hashes))
    return ends[1:]


def _chunks(lines: list[bytes], divisor: int, chunkings: int) -> list[tuple[int, int]]:
    """Start and end (exclusive) of the chunks of two or more lines of all chunkings."""
    if len(lines) < 2:
        return []
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, count=len(lines))
    found: set[tuple[int, int]] = set()
    for chunking in range(chunkings):
        ends = _ends(hashes, divisor, chunking)
        found.update(zip([0, *ends], ends))
    return sorted(found)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("variant"), "text")


def _multi_line(docs: DataFrame, divisor: int, chunkings: int, with_bytes: bool) -> DataFrame:
    """(hash, doc_id, variant, place (the first line)[, end, bytes]) of every chunk of two or more lines."""
    names = ["hash", "doc_id", "variant", "place"] + ["end", "bytes"] * with_bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows, hashes, places, last, blobs = [], [], [], [], []
            for row, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                lines = (text or b"").split(b"\n")
                for place, end in _chunks(lines, divisor, chunkings):
                    blob = b"\n".join(lines[place:end])
                    rows.append(row)
                    hashes.append(xxhash.xxh3_128_digest(blob))
                    places.append(place)
                    if with_bytes:
                        last.append(end)
                        blobs.append(blob)
            at = pa.array(rows, pa.int64())
            columns = [pa.array(hashes, pa.binary()), batch.column("doc_id").take(at), batch.column("variant").take(at),
                       pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(last, pa.int32()), pa.array(blobs, pa.binary())] * with_bytes, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(cut, f"hash binary, doc_id {kind}, variant long, place int" + ", end int, bytes binary" * with_bytes)


def repeated_chunks(docs: DataFrame, divisor: int, chunkings: int, scratch: Scratch) -> DataFrame:
    """(doc_id, variant, places (first line and end)): the chunks to remove from each document."""
    spot = F.struct("doc_id", "variant", "place")
    again = scratch.keep(_multi_line(docs, divisor, chunkings, False).groupBy("hash").agg(
        F.min(spot).alias("first"), F.max(spot).alias("last")).where("first <> last").select("hash", "first"))
    seen = scratch.keep(_multi_line(docs, divisor, chunkings, True).join(small(again), "hash"))
    # written, so that the join has plain sides and a hot chunk's partition can be split
    firsts = scratch.keep(seen.where(spot == F.col("first")).groupBy("hash").agg(F.first("bytes").alias("first_bytes")))
    found = seen.where(spot != F.col("first")).join(firsts, "hash").where("bytes = first_bytes")
    return scratch.keep(found.groupBy("doc_id", "variant").agg(F.collect_set(F.struct("place", "end")).alias("places")))


def dedup_lines(docs: DataFrame, divisor: int = 3, chunkings: int = 1) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` (see the module)."""
    scratch = Scratch(docs.sparkSession, "lines")
    keyed = _keyed(docs)
    gone = repeated_chunks(keyed, divisor, chunkings, scratch)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            out: list[list] = [[], [], [], []]
            for text, places in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("places").to_pylist()):
                lines = [] if text is None else text.split(b"\n")
                gone = np.zeros(len(lines), bool)
                for spot in places or ():
                    gone[spot["place"]:spot["end"]] = True
                kept = [line for line, lost in zip(lines, gone) if not lost]
                for column, value in zip(out, (len(lines), int(gone.sum()), len(places or ()), None if text is None else b"\n".join(kept))):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns[:3], columns[3].cast(pa.string())],
                names=["doc_id", "n_lines", "removed_lines", "removed_chunks", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    theirs = small_lists(gone, "places", 8).withColumnRenamed("doc_id", "id").withColumnRenamed("variant", "other")
    return keyed.join(theirs, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("variant") == F.col("other")), "left").select(
        "doc_id", "text", "places").mapInArrow(
        rebuild, f"doc_id {kind}, n_lines long, removed_lines long, removed_chunks long, text string")
