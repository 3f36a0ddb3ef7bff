"""Operator 12: token ids of all documents in files of independent zstandard frames.

Every document is one zstandard frame with its own checksum, so a reader decompresses the documents it
was asked for and no others.  A file holds, in this order:

* a skippable frame with a JSON header (format, version, width of an id in bytes, end id);
* one frame per document, in ascending doc_id order: its ids, little-endian;
* a skippable frame with the doc_ids and token counts (an Arrow stream);
* a trailing seek table, laid out as the public seekable format of zstandard has it: a skippable frame with
  compressed size, decompressed size and checksum (low 32 bits of XXH64) of each frame, then the number of
  frames, a flag byte and a magic number.

:func:`write_token_files` deals documents over files by ranges of doc_id, so the files in order hold all
documents in ascending order.  A task writes its file under a name of its own and reports it as a row;
the manifest, written last, names the reported files, the range of doc_ids and the number of tokens
before each.  Files of lost or repeated tasks are not in the manifest: readers never see them, and they
are removed when the manifest is there.  The driver holds one row per file.
:func:`read_documents` reads all documents, or those of a list of ids: files are chosen by their range,
frames by the file's table, and only those frames are read and decompressed.  A frame whose size or
checksum is not that of the table is an error.

Edge cases: a null or empty text is the end id alone; a text that is not UTF-8 has U+FFFD in place of the
bad bytes; null doc_ids come first; rows of one doc_id are ordered by a hash of their text; repeated rows
are stored as often; an empty table gives a manifest without files; other columns are ignored.
Vocabularies other than those of lower-cased words need ``coder=WholeCoder``.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgpulse.llm.vocab import WordCoder, gathered, texts_of

FORMAT, VERSION = "token-frames", 1
#: Fixed values of the zstandard formats: first magic number of skippable frames, that of seek tables, the
#: magic number at the end of a seek table, the flag for checksums.
SKIPPABLE, SEEK_TABLE, SEEKABLE, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Documents of one unit of reading, and bytes read at once.
UNIT, SPAN = 20_000, 8 << 20


def _skippable(payload: bytes, magic: int = SKIPPABLE) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


def _store(uri: str):
    """(file system, folder) of a URI, for Python workers; any that pyarrow opens (file, hdfs, s3, gs)."""
    from pyarrow.fs import FileSystem
    return FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def encode_frames(rows: Iterator[tuple[object, bytes]], out, ids: pa.DataType, header: dict) -> tuple[int, int]:
    """Write ``rows`` of (doc_id, ids as bytes) to ``out``; (documents, tokens)."""
    import zstandard
    press = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
    table, names, counts = [], [], []

    def put(frame: bytes, size: int = 0, check: int = 0) -> None:
        out.write(frame)
        table.append((len(frame), size, check))

    put(_skippable(json.dumps(header).encode()))
    for name, data in rows:
        put(press.compress(data), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF)
        names.append(name)
        counts.append(len(data) // header["width"])
    sink = io.BytesIO()
    index = pa.RecordBatch.from_arrays([pa.array(names, ids), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])
    with pa.ipc.new_stream(sink, index.schema) as stream:
        stream.write_batch(index)
    put(_skippable(sink.getvalue()))
    entries = np.array(table, np.uint32).astype("<u4").tobytes()
    out.write(_skippable(entries + struct.pack("<IBI", len(table), CHECKSUMS, SEEKABLE), SEEK_TABLE))
    return len(names), sum(counts)


class FrameFile:
    """A file opened for reading: its header, seek table and index; frames on demand."""

    def __init__(self, f, name: str = ""):
        self.f, self.name = f, name
        size = f.size()
        f.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError(f"{name}: no seek table")
        f.seek(size - 9 - 12 * frames)
        self.table = np.frombuffer(f.read(12 * frames), "<u4").reshape(frames, 3).astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        self.header = json.loads(self._bytes(0, 1)[8:])
        if self.header.get("format") != FORMAT or self.header.get("version") != VERSION:
            raise ValueError(f"{name}: not {FORMAT} {VERSION}")
        index = pa.ipc.open_stream(self._bytes(frames - 1, frames)[8:]).read_all()
        self.doc_ids, self.n_tokens = index.column("doc_id").combine_chunks(), index.column("n_tokens").to_numpy()

    def _bytes(self, first: int, end: int) -> bytes:
        self.f.seek(int(self.offsets[first]))
        return self.f.read(int(self.offsets[end] - self.offsets[first]))

    def documents(self, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(place, ids as bytes) of the documents at these ascending places; neighbours are read at once."""
        import zstandard
        unpress = zstandard.ZstdDecompressor()
        k = 0
        while k < len(places):
            first = last = int(places[k])
            while k + 1 < len(places) and places[k + 1] == last + 1 and \
                    self.offsets[last + 3] - self.offsets[first + 1] <= SPAN:
                k, last = k + 1, last + 1
            span, base = self._bytes(first + 1, last + 2), self.offsets[first + 1]
            for place in range(first, last + 1):
                frame = span[self.offsets[place + 1] - base:self.offsets[place + 2] - base]
                _, size, check = self.table[place + 1]
                try:
                    data = unpress.decompress(frame)
                except zstandard.ZstdError as bad:
                    raise ValueError(f"{self.name}: frame of document {place} is damaged: {bad}") from bad
                if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                    raise ValueError(f"{self.name}: frame of document {place} is not what was written")
                yield place, data
            k += 1


def write_token_files(docs: DataFrame, path: str, tokenizer: bytes, end_id: int = 2, width: int = 2,
                      coder: type = WordCoder) -> None:
    """Encode ``docs(doc_id, text)`` and write the files and their manifest to the new folder ``path``, which
    all executors reach.  ``width``: bytes of an id, 2 or 4; ``coder``: how texts are cut, see
    :mod:`orgpulse.llm.vocab`."""
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(tokenizer)  # some MB
    header = {"format": FORMAT, "version": VERSION, "width": width, "end_id": end_id}
    kind = docs.schema["doc_id"].dataType
    end = np.array([end_id], f"<u{width}").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        own = coder(file.value)
        if own.size > 1 << 8 * width:
            raise ValueError(f"ids of this vocabulary need more than {width} bytes")
        ends = []

        def rows() -> Iterator[tuple[object, bytes]]:
            for batch in gathered((b for group in ([first], batches) for b in group), "text"):
                ids, offsets = own.encode(*texts_of(batch.column("text")))
                ids = ids.astype(f"<u{width}")
                names = batch.column("doc_id").to_pylist()
                ends[:] = [ends[0] if ends else names[0], names[-1]]
                for name, low, high in zip(names, offsets, offsets[1:]):
                    yield name, ids[low:high].tobytes() + end

        place = TaskContext.get().partitionId()
        name = f"part-{place:06d}-{uuid.uuid4().hex}.zst"
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            n, tokens = encode_frames(rows(), out, first.schema.field("doc_id").type, header)
        yield pa.RecordBatch.from_arrays(
            [pa.array([place]), pa.array([name]), pa.array([n]), pa.array([tokens]),
             *(pa.array([e], first.schema.field("doc_id").type) for e in ends)],
            names=["place", "file", "n_docs", "n_tokens", "low", "high"])

    of_text = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), of_text).sortWithinPartitions(
        "doc_id", of_text, "text")
    t = kind.simpleString()
    files = ordered.mapInArrow(write, f"place long, file string, n_docs long, n_tokens long, low {t}, high {t}").collect()
    before, lines = 0, []
    for f in sorted(files, key=lambda f: f.place):
        lines.append((f.file, f.n_docs, f.n_tokens, before, f.low, f.high))
        before += f.n_tokens
    manifest = T.StructType([T.StructField("file", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_docs", "n_tokens", "before")),
                             T.StructField("low", kind), T.StructField("high", kind)])
    spark.createDataFrame(lines, manifest).coalesce(1).write.parquet(f"{path}/_manifest")
    from pyarrow.fs import FileSelector
    store, folder = _store(path)
    named = {f.file for f in files}
    for left in store.get_file_info(FileSelector(folder)) if files else []:
        if left.base_name.endswith(".zst") and left.base_name not in named:
            store.delete_file(left.path)


def read_documents(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)``: ``start`` counts the tokens of all documents before, ``ids`` are
    little-endian unsigned 32-bit integers.  With ``doc_ids`` (a list that the driver holds) only those."""
    files = spark.read.parquet(f"{path}/_manifest")
    kind = files.schema["low"].dataType
    wanted = None
    if doc_ids is not None:
        wanted = sorted({d for d in doc_ids if d is not None})
        some = F.lit(False)
        if wanted:
            some = F.exists(F.lit(wanted).cast(T.ArrayType(kind)), lambda d: (d <= F.col("high")) & (F.col("low").isNull() | (d >= F.col("low"))))
        files = files.where(some | F.col("low").isNull() if None in doc_ids else some)
    asks_null = doc_ids is not None and None in doc_ids
    units = files.select("file", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(UNIT).cast("long"))).alias("first"))
    units = units.repartition(max(1, units.count()), "file", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        for unit in (u for batch in batches for u in batch.to_pylist()):
            with store.open_input_file(f"{folder}/{unit['file']}") as f:
                file = FrameFile(f, unit["file"])
                starts = unit["before"] + np.concatenate(([0], np.cumsum(file.n_tokens)))
                places = np.arange(unit["first"], min(unit["first"] + UNIT, len(file.n_tokens)))
                if doc_ids is not None:
                    mine = file.doc_ids.take(pa.array(places)).to_pylist()
                    asked = set(wanted)
                    places = places[[asks_null if d is None else d in asked for d in mine]]
                width, held, size = file.header["width"], [], 0

                def out() -> pa.RecordBatch:
                    at = np.array([p for p, _ in held], np.int64)
                    return pa.RecordBatch.from_arrays(
                        [file.doc_ids.take(pa.array(at)), pa.array(starts[at]), pa.array(file.n_tokens[at]),
                         pa.array([np.frombuffer(d, f"<u{width}").astype("<u4").tobytes() for _, d in held], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

                for place, data in file.documents(places):
                    held.append((place, data))
                    size += len(data)
                    if size > 4 << 20:
                        yield out()
                        held, size = [], 0
                if held:
                    yield out()

    return units.select("file", "before", "first").mapInArrow(
        read, f"doc_id {kind.simpleString()}, start long, n_tokens long, ids binary")
