"""Operator 11: alignment of two tokenizers over the same texts, each distinct text once.

1. *Exact-text deduplication.*  Documents are shuffled by their full text (map-side combined, so copies
   leave a task once) and counted.
2. *Alignment.*  Each distinct text is encoded by A (byte-level BPE, over a space and the text) and B
   (pieces with byte fallback, which adds the space itself).  Byte offsets where tokens of both end cut
   them into groups; a link is a pair of an A and a B token that end together.
3. *Pair counts.*  Links of a text are counted per id pair, weighted by the text's copies and summed over
   the corpus.  A pair is the best of its B id if no other pair of that id has a higher count (ties: all).
4. *Measures* of each distinct text are joined to the doc_ids by the SHA-256 of the text.

Results: :func:`aligned_documents`, one row per row of ``docs``; :func:`pair_counts`, the alignment
table; both by :class:`Alignment`, which :func:`align` gives.

Edge cases: a null or empty text, and one whose joined A or B bytes are not a space and the text (it has
U+2581, or is not UTF-8), has no tokens: zeros, and '' as its hash.  Control strings in texts are plain
text.  Repeated rows give repeated result rows and count as often in pair counts; rows of one doc_id with
different texts are measured each; a null doc_id stays null; an empty table gives an empty result; other
columns are ignored.  Vocabularies with an empty token are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.scratch import Scratch, small
from orgpulse.llm.vocab import (
    JOINED, SLICE, are_plain, byte_level_bytes, distinct_units, gathered, json_tokenizer, piece_bytes, ranges, texts_of, word_starts,
)

#: An id pair as one number: the A id times this, plus the B id.
B_IDS = 1 << 32


class Aligner:
    """Both tokenizers in a worker."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        self.a, self.b = json_tokenizer(a_file), sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        a_bytes = [b"?"] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            a_bytes[i] = byte_level_bytes(token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [piece_bytes(p) for p in pieces]
        if not all(a_bytes) or not all(b_bytes):
            raise ValueError("a vocabulary has an empty token")
        if any("\u2581" in p.lstrip("\u2581") for p in pieces):
            raise ValueError("a piece of the vocabulary spans words")
        self.bytes = a_bytes, b_bytes
        self.widths = tuple(np.array([*map(len, x)]) for x in self.bytes)
        self.names = tuple([np.array([f"{i}{sign}" for i in range(len(x))], object) for sign in signs]
                           for x, signs in zip(self.bytes, (",|", ",;")))

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids under A and B of a text that begins with a space."""
        return (np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64),
                np.array(self.b.encode(text[1:], num_threads=1), np.int64))

    def units(self, values: list[bytes]) -> dict[str, np.ndarray | list]:
        """Of each unit (after a space): whether its tokens have its bytes, how many A tokens, B tokens and
        groups, the groups as text, and its links as numbers with their offsets."""
        ids = [], []
        # the first or last unit of a text may begin or end with white space: encoded alone
        able = are_plain(values)
        plain, odd = np.flatnonzero(able), np.flatnonzero(~able).tolist()
        right = np.ones(len(values), bool)
        order = []
        for start in range(0, len(plain), JOINED):
            at = plain[start:start + JOINED]
            joined = b"".join([values[k] for k in at])
            got = self._encode(joined.decode())
            if all(b"".join([said[i] for i in x]) == joined for said, x in zip(self.bytes, got)):
                order.append(at)
                for held, x in zip(ids, got):
                    held.append(x)
            else:
                odd.extend(at)
        for k in odd:
            got = self._encode(values[k].decode())
            right[k] = all(b"".join([said[i] for i in x]) == values[k] for said, x in zip(self.bytes, got))
            if right[k]:
                order.append(np.array([k]))
                for held, x in zip(ids, got):
                    held.append(x)
        order = np.concatenate([np.empty(0, np.int64), *order]).astype(np.int64)
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in ids)
        a_ends, b_ends = (np.cumsum(w[x]) for w, x in zip(self.widths, (a, b)))
        ends = np.cumsum([len(values[k]) for k in order], dtype=np.int64)  # of the units; always ends of groups
        _, a_last, b_last = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        stops = np.searchsorted(a_ends[a_last], ends) + 1  # groups up to each unit's end
        out = {"right": right, "texts": [""] * len(values)}
        for name, count in (("n_a", np.searchsorted(a_ends, ends) + 1), ("n_b", np.searchsorted(b_ends, ends) + 1), ("n_groups", stops)):
            out[name] = np.zeros(len(values), np.int64)
            out[name][order] = np.diff(count, prepend=0)
        links = a[a_last] * B_IDS + b[b_last]
        first = np.zeros(len(values), np.int64)
        first[order] = stops - out["n_groups"][order]
        out["links"] = links[ranges(first, out["n_groups"])]
        # tokens as text: those of A, then those of B, group by group
        words, groups = [], []
        for x, last, (comma, sign) in ((a, a_last, self.names[0]), (b, b_last, self.names[1])):
            closing = np.zeros(len(x), bool)
            closing[last] = True
            words.append(np.where(closing, sign[x], comma[x]))
            groups.append(np.cumsum(closing) - closing)
        said = np.concatenate(words)[np.argsort(np.concatenate((2 * groups[0], 2 * groups[1] + 1)), kind="stable")].tolist()
        at = 0
        for k, n in zip(order.tolist(), (out["n_a"] + out["n_b"])[order].tolist()):
            out["texts"][k] = "".join(said[at:at + n])
            at += n
        return out


def _aligned(texts: DataFrame, a_file: bytes, b_file: bytes) -> DataFrame:
    """``(text, copies, digest)``, each text after a space -> digest, copies, n_a, n_b, n_groups, groups_sha256, links(pair, times)."""
    files = texts.sparkSession.sparkContext.broadcast((a_file, b_file))  # some MB each

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in gathered(batches, "text", 2 * SLICE):
            aligner = aligner or Aligner(*files.value)
            data, offsets = texts_of(batch.column("text"), bad=b"")
            starts = word_starts(data, offsets)
            number, values = distinct_units(data, starts)
            units = aligner.units(values)
            bounds = np.searchsorted(starts, offsets)  # units of each text
            wrong = np.concatenate(([0], np.cumsum(~units["right"][number])))[bounds]
            used = (np.diff(wrong) == 0) & (np.diff(bounds) > 0)
            sums = [np.where(used, np.diff(np.concatenate(([0], np.cumsum(units[c][number])))[bounds]), 0)
                    for c in ("n_a", "n_b", "n_groups")]
            first = np.cumsum(units["n_groups"]) - units["n_groups"]
            said, numbers, hashes, pairs, times = units["texts"], number.tolist(), [], [], []
            for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
                own = number[low:high] if used[k] else number[:0]
                hashes.append(hashlib.sha256("".join([said[n] for n in numbers[low:high]])[:-1].encode()).hexdigest() if used[k] else "")
                pair, often = np.unique(units["links"][ranges(first[own], units["n_groups"][own])], return_counts=True)
                pairs.append(pair)
                times.append(often)
            links = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (pairs, times)], names=["pair", "times"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("copies"), *(pa.array(s) for s in sums), pa.array(hashes, pa.string()),
                 pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32()), links)],
                names=["digest", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return texts.mapInArrow(work, "digest binary, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, "
                                  "links array<struct<pair: long, times: long>>")


def _digest(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


@dataclass
class Alignment:
    """What :func:`align` found: ``texts``, one row per distinct text (digest, copies, n_a, n_b, n_groups,
    groups_sha256, links), and ``pairs`` (pair, count, best)."""

    texts: DataFrame
    pairs: DataFrame
    scratch: Scratch


def align(docs: DataFrame, a_file: bytes, b_file: bytes) -> Alignment:
    """Align every distinct text of ``docs(text)`` and count id pairs over all rows."""
    scratch = Scratch(docs.sparkSession, "alignment")
    distinct = docs.where(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("copies"))
    texts = scratch.keep(_aligned(distinct.select(
        F.concat(F.lit(" "), "text").alias("text"), "copies", _digest(F.col("text")).alias("digest")), a_file, b_file))
    counts = scratch.keep(texts.select("copies", F.inline("links")).groupBy("pair").agg(
        F.sum(F.col("times") * F.col("copies")).alias("count")))
    b_id = F.col("pair") % B_IDS
    # one row per id of B: at most its vocabulary
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("highest"))
    pairs = scratch.keep(counts.join(F.broadcast(highest), b_id == F.col("b")).select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best")))
    scratch.drop(counts)
    return Alignment(texts, pairs, scratch)


def pair_counts(found: Alignment) -> DataFrame:
    """``(a_id, b_id, count, best)``: how many links of the corpus hold each id pair."""
    return found.pairs.select(F.floor(F.col("pair") / B_IDS).cast("int").alias("a_id"),
                              (F.col("pair") % B_IDS).cast("int").alias("b_id"), "count", "best")


def aligned_documents(docs: DataFrame, found: Alignment) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    links = found.texts.select("digest", F.inline("links"))
    scored = found.scratch.keep(links.join(small(found.pairs, 2_000_000), "pair").groupBy("digest").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum")))
    measures = found.scratch.keep(found.texts.drop("links", "copies").join(scored, "digest", "left"))
    found.scratch.drop(scored)
    of_doc = docs.select("doc_id", F.when(F.length("text") > 0, _digest(F.col("text"))).alias("digest"))
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return of_doc.join(small(measures, 100_000), "digest", "left").select(
        "doc_id", *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
