"""Operator 6: embedding near-duplicates through an inverted multi-index.

1. *Classes.*  Equal vectors are one class that carries the number of its rows, so copies are never
   paired.
2. *Codebooks.*  Each half of the unit vectors gets a codebook of ``k`` centres (k-means in numpy on at
   most ``max_sample`` vectors, the smallest by a hash); the product of both is a grid of cells.  Every
   vector is stored in the cell of its nearest centres.
3. *Traversal.*  A vector visits cells in multi-sequence order, nearest sum of half distances first.
   The number of visits is fitted: ``QUERIES`` sampled vectors are compared with every vector by brute
   force, and for each true pair the number of visits at which one finds the other is counted; the
   fewest visits that reach ``recall`` of these pairs, and of artificial pairs exactly at the
   threshold, are taken.  Where ``MOST_VISITS`` do not reach both (a cloud concentrated round its mean),
   no visits are made: every vector meets every other in blocks of ``EVERY`` rows, which is exact.
4. *Verification.*  Visitors of a cell meet the vectors stored there in blocks of at most ``STORED`` by
   ``VISITORS`` rows, whatever the cell holds, and pairs are verified by cosine in double precision.
   A block emits sums of weights per vector and a spanning forest of its links, never its pairs.  A
   pair found from both sides is counted once: the stored side counts a visitor only if its own
   visits leave out the visitor's cell.

Result: one row per row of ``vectors``: vec_id, n_links (other rows linked directly), component_id
(smallest vec_id reachable), kept.  Edge cases: null and empty vectors, zero vectors and those with
null or non-finite components link with nothing (their component is their vec_id); vectors are
compared with vectors of their length; repeated rows are linked with each other; a null vec_id is
left out of links (null component, not kept); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.components import connected_components
from orgpulse.llm.scratch import Scratch, small

QUERIES, STORED, VISITORS, MOST_CENTRES, MOST_VISITS, EVERY = 512, 400, 800, 1024, 256, 2048


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # no overflow in the squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _distances(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (half * half).sum(1)[:, None] - 2 * half @ centres.T + (centres * centres).sum(1)


def _k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=len(points) < k)].copy()
    for _ in range(rounds):
        near = _distances(points, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        count = np.bincount(near, minlength=k)[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), points[rng.integers(0, len(points), k)])
    return centres


def _visits(unit: np.ndarray, books: tuple[np.ndarray, np.ndarray], visits: int) -> np.ndarray:
    """The first ``visits`` cells of each row in multi-sequence order.  The t-th cell of the order pairs
    the i-th and j-th nearest half centres with (i + 1) (j + 1) <= t, so only those are sorted."""
    k, half = len(books[0]), unit.shape[1] // 2
    visits = min(visits, k * k)
    near, dist = [], []
    for part, centres in ((unit[:, :half], books[0]), (unit[:, half:], books[1])):
        d = _distances(part, centres)
        order = np.argsort(d, axis=1, kind="stable")[:, :visits]
        near.append(order)
        dist.append(np.take_along_axis(d, order, 1))
    i, j = np.divmod(np.arange(near[0].shape[1] * near[1].shape[1]), near[1].shape[1])
    able = (i + 1) * (j + 1) <= visits
    i, j = i[able], j[able]
    first = np.argsort(dist[0][:, i] + dist[1][:, j], axis=1, kind="stable")[:, :visits]
    return np.take_along_axis(near[0], i[first], 1) * k + np.take_along_axis(near[1], j[first], 1)


def _slices(rows: int, width: int, most: int = 4_000_000) -> Iterator[slice]:
    step = max(1, most // max(width, 1))
    for start in range(0, rows, step):
        yield slice(start, start + step)


def _order(cells: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Visits needed to reach a cell: its place in the order + 1, or one more than the order's length."""
    hit = cells == home[:, None]
    return np.where(hit.any(1), hit.argmax(1) + 1, cells.shape[1] + 1)


def fit_visits(classes: DataFrame, sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float,
               recall: float) -> int | None:
    """The fewest visits that reach ``recall`` (see the module); None if ``MOST_VISITS`` do not."""
    most = min(len(books[0]) ** 2, MOST_VISITS)
    queries = sample[:QUERIES]
    order = _visits(queries, books, most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(most + 2, np.int64)
        for batch in batches:
            unit = _unit(batch.column("embedding"))
            for part in _slices(len(unit), len(queries)):
                q, d = np.nonzero((queries @ unit[part].T >= threshold) & (queries @ unit[part].T < 1 - 1e-12))
                if len(q):
                    rows, back = np.unique(d, return_inverse=True)
                    cells = _visits(unit[part][rows], books, most)
                    for own in _slices(len(q), most):
                        seen += np.bincount(np.minimum(
                            _order(order[q[own]], cells[back[own], 0]), _order(cells[back[own]], order[q[own], 0])),
                            minlength=most + 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(most + 2)), pa.array(seen)], names=["visits", "n"])

    got = classes.select("embedding").mapInArrow(count, "visits long, n long").groupBy("visits").agg(F.sum("n").alias("n")).toPandas()
    real = np.zeros(most + 2)
    real[got["visits"]] = got["n"]
    rng = np.random.default_rng(5)
    noise = rng.normal(size=queries.shape)
    noise -= (noise * queries).sum(1, keepdims=True) * queries
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    moved = threshold * queries + (1 - threshold ** 2) ** 0.5 * noise
    cells = _visits(moved, books, most)
    made = np.bincount(np.minimum(_order(order, cells[:, 0]), _order(cells, order[:, 0])), minlength=most + 2)
    needed = []
    for hist, goal in ((real, recall), (made, 0.9)):
        if hist.sum():
            share = np.cumsum(hist) / hist.sum()
            needed.append(int(np.searchsorted(share, goal)))
    fewest = max(needed, default=1)
    return fewest if fewest <= most else None


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component in a graph of ``n`` nodes and edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block(threshold: float, keys: pd.DataFrame) -> pd.DataFrame:
    """Counts and a forest of links of one block of visitors and stored vectors."""
    stored, asking = keys[keys["stored"]], keys[~keys["stored"]]
    out = {"a": [], "b": [], "n": []}
    if len(stored) and len(asking):
        d = np.frombuffer(b"".join(stored["unit"]), np.float64).reshape(len(stored), -1)
        q = np.frombuffer(b"".join(asking["unit"]), np.float64).reshape(len(asking), -1)
        dk, qk = stored["key"].to_numpy(), asking["key"].to_numpy()
        dw, qw = stored["weight"].to_numpy(), asking["weight"].to_numpy()
        i, j = np.nonzero(q @ d.T >= threshold)
        other = qk[i] != dk[j]
        i, j = i[other], j[other]
        if len(i):
            cells = np.stack(stored["cells"].to_numpy())
            home = asking["home"].to_numpy()
            found_back = np.zeros(len(i), bool)
            for part in _slices(len(i), cells.shape[1]):
                found_back[part] = (cells[j[part]] == home[i[part], None]).any(1)
            seen = np.bincount(i, weights=dw[j], minlength=len(q)).astype(np.int64)
            seen_by = np.bincount(j[~found_back], weights=qw[i[~found_back]], minlength=len(d)).astype(np.int64)
            names, place = np.unique(np.concatenate((qk, dk)), return_inverse=True)
            root = _forest(place[i], place[len(q) + j], len(names))
            joined = np.flatnonzero(root != np.arange(len(names)))
            out = {"a": [*qk[seen > 0], *dk[seen_by > 0], *names[joined]],
                   "b": [None] * int((seen > 0).sum() + (seen_by > 0).sum()) + [*names[root[joined]]],
                   "n": [*seen[seen > 0], *seen_by[seen_by > 0], *[0] * len(joined)]}
    return pd.DataFrame(out)


def _every(threshold: float, keys: pd.DataFrame) -> pd.DataFrame:
    """Counts and a forest of links of all pairs of two blocks (or within one, when they are the same)."""
    keys = keys.sort_values("part", kind="stable")
    part, names, weight = keys["part"].to_numpy(), keys["key"].to_numpy(), keys["weight"].to_numpy()
    unit = np.frombuffer(b"".join(keys["unit"]), np.float64).reshape(len(keys), -1)
    own = keys["x"].iat[0] == keys["y"].iat[0]
    first, start = (len(keys), 0) if own else ((part == part[0]).sum(), (part == part[0]).sum())
    seen, a, b = np.zeros(len(keys), np.int64), [], []
    if part[0] != keys["x"].iat[0]:
        first = 0  # no row in the first block
    for rows in _slices(first, len(keys) - start, 1_000_000):
        i, j = np.nonzero(unit[rows][:first - rows.start] @ unit[start:].T >= threshold)
        i, j = i + rows.start, j + start
        once = i < j
        i, j = i[once], j[once]
        seen += np.bincount(i, weights=weight[j], minlength=len(keys)).astype(np.int64)
        seen += np.bincount(j, weights=weight[i], minlength=len(keys)).astype(np.int64)
        root = _forest(i, j, len(keys))
        joined = np.flatnonzero(root != np.arange(len(keys)))
        a.append(joined)
        b.append(root[joined])
    a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
    root = _forest(a, b, len(keys))
    joined = np.flatnonzero(root != np.arange(len(keys)))
    return pd.DataFrame({"a": [*names[seen > 0], *names[joined]], "b": [None] * int((seen > 0).sum()) + [*names[root[joined]]],
                         "n": [*seen[seen > 0], *[0] * len(joined)]})


def _all_pairs(classes: DataFrame, total: int, threshold: float) -> DataFrame:
    """``(a, b, n)`` like :func:`_linked`, from every pair of classes."""
    parts = -(-total // EVERY)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("weight"), pa.array([u.tobytes() for u in _unit(batch.column("embedding"))], pa.binary())],
                names=["key", "weight", "unit"])

    placed = classes.select("key", "weight", "embedding").mapInArrow(place, "key binary, weight long, unit binary").select(
        "*", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("other"))
    return placed.select("key", "weight", "unit", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y")).groupBy(
        "x", "y").applyInPandas(lambda keys: _every(threshold, keys), "a binary, b binary, n long")


def _linked(classes: DataFrame, threshold: float, recall: float, max_sample: int, scratch: Scratch) -> DataFrame:
    """``(a, b, n)`` of classes of one length: counts (b null) and links (n 0)."""
    total = classes.count()
    k = int(np.clip(np.sqrt(total / 64), 4, MOST_CENTRES))
    taken = classes.select("key", "embedding").orderBy(F.xxhash64("key")).limit(max_sample).toArrow()
    sample = _unit(taken.column("embedding"))
    half = sample.shape[1] // 2
    books = (_k_means(sample[:, :half], k), _k_means(sample[:, half:], k))
    visits = fit_visits(classes, sample, books, threshold, recall)
    if visits is None:
        return _all_pairs(classes, total, threshold)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column("embedding"))
            cells = np.concatenate([np.zeros((0, min(visits, k * k)), np.int64),
                                    *(_visits(unit[s], books, visits) for s in _slices(len(unit), 8 * visits + k))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("weight"), pa.array([u.tobytes() for u in unit], pa.binary()),
                 pa.array(list(cells), pa.list_(pa.int64()))], names=["key", "weight", "unit", "cells"])

    placed = scratch.keep(classes.select("key", "weight", "embedding").mapInArrow(
        place, "key binary, weight long, unit binary, cells array<long>")
        .withColumn("home", F.col("cells")[0]).withColumn("draw", F.xxhash64("key")))
    visiting = placed.select("key", "draw", "home", F.explode("cells").alias("cell"))
    # blocks of a cell: at most k * k rows
    held = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / STORED).alias("parts"))
    came = visiting.groupBy("cell").agg(F.ceil(F.count("*") / VISITORS).alias("sets"))
    grid = scratch.keep(held.join(came, "cell"))
    pick = lambda n: F.pmod(F.col("draw"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    stored = placed.join(small(grid), F.col("home") == F.col("cell")).select(
        "cell", pick("parts").alias("part"), every("sets").alias("set"), "key", "weight", "unit", "home", "cells",
        F.lit(True).alias("stored"))
    asking = placed.select("key", "weight", "unit", "home", "draw", F.explode("cells").alias("cell")).join(
        small(grid), "cell").select(
        "cell", every("parts").alias("part"), pick("sets").alias("set"), "key", "weight", "unit", "home",
        F.lit(None).cast("array<long>").alias("cells"), F.lit(False).alias("stored"))
    return stored.union(asking).groupBy("cell", "part", "set").applyInPandas(
        lambda keys: _block(threshold, keys), "a binary, b binary, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.98,
                    max_sample: int = 20_000) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = scratch.keep(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).select(
        "vec_id", F.when(usable, F.col("embedding")).alias("embedding"),
        F.when(usable, F.unhex(F.md5(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",").cast("binary")))).alias("key")))
    classes = scratch.keep(rows.where("key is not null").groupBy("key").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("first_id"), F.first("embedding").alias("embedding")))
    found = None
    for length in [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]:
        part = _linked(classes.where(F.size("embedding") == length), threshold, recall, max_sample, scratch)
        found = part if found is None else found.union(part)
    found = scratch.keep(found if found is not None else spark.createDataFrame([], "a binary, b binary, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("seen"))
    joined = connected_components(found.where("b is not null"), scratch).toDF("key", "root")
    members = classes.select("key", "weight", "first_id").join(joined, "key", "left").withColumn(
        "root", F.coalesce("root", "key"))
    lowest = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = members.join(lowest, "root").join(counts, "key", "left").select(
        "key", (F.col("weight") - 1 + F.coalesce("seen", F.lit(0))).alias("n_links"), "component_id")
    return rows.join(known, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
