"""Operator 2: n-gram Jaccard join by a grouped prefix join.

Two documents link when the Jaccard similarity of their sets of ``n``-word shingles reaches
``num / den``.  The join goes over classes of documents with equal sets, so copies are never paired:

1. *Order.*  Shingles are ordered rarest first, ties by hash.  How rare is estimated from two tables of
   ``BINS`` hashed counters over all documents (so of one size): the frequencies of a shingle's words,
   and how often the shingle itself occurs above its counter's average load.  Any total order keeps the
   prefix filter exact; this one keeps common phrases and passages that many documents share out of
   the prefixes.
2. *Groups.*  Sets of the same size with the same prefix form one group.
3. *Group pairs.*  Groups that share a prefix shingle are candidates if sizes and the places of the
   shingle in both sets leave room for the needed overlap.  First every group meets only the
   smallest group of each of its posting lists (pairs grow with the lists, not their squares).
4. *Expand and verify.*  Candidates are expanded to member sets and verified on the full sets, read
   again from the documents.
5. *Rest.*  Pairs of one posting list are skipped only if links found so far already join them.  All
   other pairs are counted over the lists they share: prefixes are ``COMMON`` - 1 shingles longer than
   one shared shingle would need, so similar sets share ``COMMON`` of them, and the places of these
   bound the overlap (:func:`_candidates`).  Pairs that pass are verified likewise, so no component is missed.

Result of :func:`similar_documents`: one row per row of ``docs`` with ``doc_id``, ``n_shingles``,
``set_id`` (smallest doc_id with the same set) and ``component_id`` (smallest doc_id reachable by
links).  :func:`verified_links` gives the links between set classes that were verified.

Edge cases: a null or empty text, or one without words, has no shingle and is linked with nothing
(its component is its own doc_id); a text with fewer than ``n`` words is one shingle; repeated rows
give repeated result rows; rows of one doc_id with different texts are judged each by its text; a
null doc_id takes no part in links and gets null ids; an empty table gives an empty result; other
columns of ``docs`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.components import connected_components
from orgpulse.llm.scratch import Scratch, small
from orgpulse.llm.text import flat, pieces, shingles, small_batches, tokens

#: Counters of each frequency table.
BINS = 1 << 18
#: Prefix shingles that similar sets share (or all that they need to share, if fewer).
COMMON = 3
#: Sizes up to here are classes of their own where entries of open lists are keyed by size.
EACH = 32


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, in order of their hashes."""
    words, offsets = tokens(*flat(column))
    for low, high in zip(offsets, offsets[1:]):
        yield np.unique(shingles(words[low:high], n))


def _bins(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) & (BINS - 1)


def frequency_tables(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of BINS logarithms: the share of a word in all words, and the occurrences of a
    shingle (as many as stand out from its counter's load)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, joint = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in small_batches(batches, "text"):
            words, offsets = tokens(*flat(batch.column(0)))
            single += np.bincount(_bins(words), minlength=BINS)
            held = [shingles(words[low:high], n) for low, high in zip(offsets, offsets[1:])]
            joint += np.bincount(_bins(np.concatenate([np.empty(0, np.uint64), *held])), minlength=BINS)
        used = np.flatnonzero(single + joint)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(single[used]), pa.array(joint[used])],
                                         names=["bin", "single", "joint"])

    rows = docs.select("text").mapInArrow(count, "bin long, single long, joint long").groupBy("bin").agg(
        F.sum("single").alias("single"), F.sum("joint").alias("joint"))
    got = rows.toArrow()  # BINS rows at most
    single, joint = np.zeros(BINS), np.zeros(BINS)
    at = got.column("bin").to_numpy()
    single[at], joint[at] = got.column("single").to_numpy(), got.column("joint").to_numpy()
    share = np.log2(np.maximum(single, 1) / max(single.sum(), 1)).astype(np.float32)
    load = float(np.median(joint))
    above = np.log2(np.maximum(joint - load - 6 * load ** 0.5, 1)).astype(np.float32)
    return share, above


def _levels(words: np.ndarray, own: np.ndarray, first: np.ndarray, n: int, total: float,
            share: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A level per distinct shingle, higher for commoner ones: by what its words make likely, or by its
    own counter if that says more.  ``first``: where the shingle starts."""
    width = min(n, len(words))
    part = share[_bins(words)]
    likely = np.full(len(words) - width + 1, total, np.float32)
    for k in range(width):
        likely = likely + part[k:k + len(likely)]
    return np.clip(np.round(np.maximum(likely[first], above[_bins(own)]) * 4) + 100, 0, 255).astype(np.uint8)


def _binary(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def signatures(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, size of the set, 128-bit hash of the set and of the prefix, and the prefix itself."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency_tables(docs, n))  # 2 x BINS floats

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, above = shared.value
        total = np.float32(-share.min())
        for batch in small_batches(batches, "text"):
            sizes, sig, key, prefix = [], [], [], []
            words, offsets = tokens(*flat(batch.column("text")))
            for low, high in zip(offsets, offsets[1:]):
                own, at = np.unique(shingles(words[low:high], n), return_index=True)
                size = len(own)
                first = own
                if size:
                    length = min(size, size - -(-num * size // den) + COMMON)
                    levels = _levels(words[low:high], own, at, n, total, share, above)
                    first = own[np.argsort(levels, kind="stable")[:length]]
                sizes.append(size)
                sig.append(xxhash.xxh3_128_digest(own.tobytes()))
                key.append(xxhash.xxh3_128_digest(first.tobytes()))
                prefix.append(first.view(np.int64))
            lengths = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            flat_prefix = np.concatenate(prefix) if prefix else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sig, pa.binary()),
                 pa.array(key, pa.binary()), pa.ListArray.from_arrays(lengths, pa.array(flat_prefix))],
                names=["doc_id", "n_shingles", "sig", "prefix_key", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        sign, f"doc_id {kind}, n_shingles long, sig binary, prefix_key binary, prefix array<long>")


def _needed(nx: Column, ny: Column, num: int, den: int) -> Column:
    """Shared shingles that sets of these sizes need."""
    return F.ceil((nx + ny) * F.lit(num) / F.lit(num + den) - F.lit(1e-9))


def _sizes_fit(nx: Column, ny: Column, num: int, den: int) -> Column:
    return (nx * den >= ny * num) & (ny * den >= nx * num)


def _may_reach(nx: Column, ny: Column, px: Column, py: Column, num: int, den: int) -> Column:
    """Sizes alone, and the shingles left behind the first shared one, allow the needed overlap."""
    return _sizes_fit(nx, ny, num, den) & (1 + F.least(nx - px - 1, ny - py - 1) >= _needed(nx, ny, num, den))


def _size_class(n: Column) -> Column:
    """A class of sizes: up to EACH every size is its own, beyond it a class spans 3 %."""
    return F.when(n <= EACH, n).otherwise(EACH + F.floor(F.log(n / EACH) / math.log(1.03))).cast("int")


def _class_floor(c: Column) -> Column:
    """A size that no member of the class is below."""
    return F.when(c <= EACH, c).otherwise(F.floor(EACH * F.pow(F.lit(1.03), c - EACH)) - 1)


def _candidates(rest: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` of sets of different components that may be similar, from the entries of open posting
    lists ``(shingle, set_id, n, place, component)``.

    Similar sets share COMMON shingles of their prefixes (or all they need), and behind the first COMMON of
    these both still hold what is needed: ``COMMON - 1 + size - place >= needed``.  How much that is depends
    on the partner's size, so entries are keyed by shingle and both size classes, and an entry takes part only
    where its place leaves room: late places, where passages that many documents share lie, meet only much
    smaller sets.  Pairs are then counted over the lists they share."""
    near = rest.withColumn("own", _size_class(F.col("n"))).withColumn("other", F.explode(F.sequence(
        _size_class(F.greatest(F.lit(1), F.floor(F.col("n") * num / den) - 1)), _size_class(F.ceil(F.col("n") * den / num) + 1))))
    room = lambda n, place, needed: COMMON - 1 + n - place >= needed
    near = near.where(room(F.col("n"), F.col("place"), _needed(F.col("n"), _class_floor(F.col("other")), num, den)))
    x = near.where("own <= other").select("shingle", F.col("own").alias("low"), F.col("other").alias("high"), *(
        F.col(c).alias(v) for c, v in (("set_id", "a"), ("n", "na"), ("place", "pa"), ("component", "ca"))))
    y = near.where("own >= other").select("shingle", F.col("other").alias("low"), F.col("own").alias("high"), *(
        F.col(c).alias(v) for c, v in (("set_id", "b"), ("n", "nb"), ("place", "pb"), ("component", "cb"))))
    na, nb, pa_, pb = (F.col(c) for c in ("na", "nb", "pa", "pb"))
    needed = _needed(na, nb, num, den)
    met = x.join(y, ["shingle", "low", "high"]).where("ca <> cb and (low < high or a < b)").where(
        _sizes_fit(na, nb, num, den) & room(na, pa_, needed) & room(nb, pb, needed))
    counted = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    # the shingles counted are the first ones shared, in the order of both; others can only follow the last
    enough = (F.col("common") >= F.least(F.lit(COMMON), needed)) & (F.col("common") + F.least(na - pa_ - 1, nb - pb - 1) >= needed)
    return counted.where(enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _full_sets(pairs: DataFrame, docs: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """``(set_id, own)``: the sets of the documents that ``pairs(a, b)`` name, from their texts."""
    wanted = scratch.keep(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct())

    def own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _binary(list(_sets(batch.column("text"), n)))], names=["set_id", "own"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return scratch.keep(docs.select("doc_id", "text").join(
        small(wanted), F.col("doc_id") == F.col("set_id"), "left_semi").mapInArrow(own_sets, f"set_id {kind}, own binary"))


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` of set ids whose full sets are similar."""
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("own_a"), batch.column("own_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(den * shared >= num * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.toDF("ida", "own_a"), sets.toDF("idb", "own_b")
    full = pairs.select("a", "b").join(left, F.col("a") == F.col("ida")).drop("ida") \
        .join(right, F.col("b") == F.col("idb")).drop("idb")
    kind = pairs.schema["a"].dataType.simpleString()
    return full.mapInArrow(similar, f"a {kind}, b {kind}")


def verified_links(signed: DataFrame, docs: DataFrame, n: int, num: int, den: int,
                   scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(classes of equal sets, links between them that join every component)."""
    whole = scratch.keep(
        signed.where("doc_id is not null and n_shingles > 0")
        .groupBy("n_shingles", "prefix_key", "sig").agg(F.min("doc_id").alias("set_id"), F.first("prefix").alias("prefix")))
    groups = scratch.keep(whole.groupBy("n_shingles", "prefix_key").agg(
        F.min("set_id").alias("group_id"), F.count("*").alias("members"), F.first("prefix").alias("prefix")))
    sets = scratch.keep(whole.join(groups.select("n_shingles", "prefix_key", "group_id", "members"), ["n_shingles", "prefix_key"])
                        .select("sig", "set_id", "group_id", "members", "n_shingles"))
    scratch.drop(whole)
    entries = groups.select(F.posexplode("prefix").alias("place", "shingle"), "group_id", F.col("n_shingles").cast("int").alias("n"))
    # posting lists with more than one group, and the group that stands for each
    lists = scratch.keep(entries.groupBy("shingle").agg(
        F.min("group_id").alias("head"), F.count("*").alias("groups")).where("groups > 1").select("shingle", "head"))
    postings = scratch.keep(entries.join(lists, "shingle"))
    scratch.drop(groups, lists)
    heads = postings.where("group_id = head").select("shingle", F.col("n").alias("head_n"), F.col("place").alias("head_place"))
    first = postings.where("group_id <> head").join(heads, "shingle").where(_may_reach(
        F.col("n"), F.col("head_n"), F.col("place"), F.col("head_place"), num, den)).select("group_id", "head").distinct()
    # expand: every member against the other group's first set, and within groups against their own
    star = scratch.keep(sets.join(first, "group_id").select(F.col("set_id").alias("a"), F.col("head").alias("b")).union(
        sets.where("members > 1 and set_id <> group_id").select(F.col("set_id").alias("a"), F.col("group_id").alias("b"))))
    own = _full_sets(star, docs, n, scratch)
    links = scratch.keep(_verify(star, own, num, den))
    scratch.drop(star, own)
    joined = connected_components(links, scratch)
    placed = scratch.keep(sets.join(joined, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "group_id", "members", "n_shingles", F.coalesce("component_id", "set_id").alias("component")))

    # the rest: lists (and groups) whose sets are not yet in one component
    spread = placed.groupBy("group_id").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_lists = postings.join(spread, "group_id").groupBy("shingle").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("shingle")
    rest = scratch.keep(postings.join(open_lists, "shingle", "left_semi").join(placed, "group_id").select(
        "shingle", "set_id", "n", "place", "component"))
    across = _candidates(rest, num, den)
    # different sets of one size and prefix: only where one shingle apart can be similar at all
    size = F.col("n_shingles")
    loose = placed.where("members > 1").where(_needed(size, size, num, den) < size).join(
        spread.where("low <> high").select("group_id"), "group_id", "left_semi")
    gx, gy = (loose.select("group_id", "set_id", "component").toDF("g", c, f"c{c}") for c in "ab")
    across = scratch.keep(across.union(gx.join(gy, "g").where("a < b and ca <> cb").select("a", "b")).distinct())
    scratch.drop(postings, rest, placed)
    if across.isEmpty():
        return sets.select("sig", "set_id"), links
    own = _full_sets(across, docs, n, scratch)
    more = scratch.keep(_verify(across, own, num, den))
    scratch.drop(across, own)
    return sets.select("sig", "set_id"), links.union(more)


def _placed(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, sig (hash of its set), set_id, component_id."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    signed = scratch.keep(signatures(docs, n, num, den))
    sets, links = verified_links(signed, docs, n, num, den, scratch)
    joined = connected_components(links, scratch)
    classes = sets.join(joined, F.col("set_id") == F.col("node"), "left").select(
        "sig", "set_id", F.coalesce("component_id", "set_id").alias("component_id"))
    named = F.col("doc_id").isNotNull()
    return signed.select("doc_id", "n_shingles", "sig").join(classes, "sig", "left").select(
        "doc_id", "n_shingles", "sig", F.when(named, F.coalesce("set_id", "doc_id")).alias("set_id"),
        F.when(named, F.coalesce("component_id", "doc_id")).alias("component_id"))


def similar_documents(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, set_id, component_id (see the module)."""
    return _placed(docs, n, num, den).drop("sig")


def _signature_of(n: int):
    @F.arrow_udf("binary")
    def signature(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([xxhash.xxh3_128_digest(own.tobytes()) for piece in pieces(part)
                            for own in _sets(piece, n)], pa.binary())

    return signature


def keep_one_of_each(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, that remain when one of each component stays: the smallest
    doc_id, and of rows with that doc_id one.  Documents without shingles or doc_id stay."""
    scratch = Scratch(docs.sparkSession, "one-of-each")
    found = scratch.keep(_placed(docs.select("doc_id", "text"), n, num, den).where("doc_id is not null and n_shingles > 0"))
    # written, so that the rows of a large component can be split in the join
    best = scratch.keep(found.groupBy("component_id").agg(F.min(F.struct("doc_id", "sig")).alias("best")))
    gone = scratch.keep(found.join(best, "component_id").where(F.struct("doc_id", "sig") != F.col("best"))
                        .select("doc_id", "sig").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id",
                       _signature_of(n)(F.col("text")).alias("sig")).join(small(gone), ["doc_id", "sig"], "left_anti")
    twice = scratch.keep(found.groupBy("doc_id", "sig").count().where("count > 1").select("doc_id", "sig"))
    if not twice.isEmpty():
        one = rows.join(twice, ["doc_id", "sig"], "left_semi").groupBy("doc_id", "sig").agg(F.first("row").alias("row"))
        rows = rows.join(twice, ["doc_id", "sig"], "left_anti").select("row").union(one.select("row"))
    return rows.select("row.*")
