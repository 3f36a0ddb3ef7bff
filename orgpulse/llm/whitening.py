"""Operator 13: embedding whitening from polarised variances.

An entry ``c`` becomes the whole number ``x = floor(scale * c) + offset``, so all sums are exact.

1. *Sums.*  The number of vectors ``n`` and the sum ``S`` of each dimension.
2. *Squares.*  Entries are centred on the whole number nearest their mean, and the exact squares of every
   dimension and of every sum of two dimensions are added up: map-side, one number per pair and task.
   What a mean differs from its whole number (less than one half) is taken off in whole numbers, so
   ``n * n`` times each variance is exact.
3. *Polarisation.*  ``cov(a, b) = (var(a + b) - var(a) - var(b)) / 2``, still in whole numbers; the matrix,
   divided once, goes to ``eigh``.
4. *Projection.*  Centred vectors are projected on the first components and divided by the roots of their
   eigenvalues; the covariance of the result is measured over all rows and compared with the identity.

Results: :func:`fit_whitening` gives a :class:`Whitening` per vector length; :func:`whiten` one row per
vector and component.  On the driver: one matrix of the dimensions squared per length.

Edge cases: null and empty vectors, and those with null or non-finite entries, are left out; vectors are
whitened with those of their length; repeated rows count as often; a null vec_id stays null; a component
without variance (up to rounding) has a null ``whitened`` and takes no part in ``identity_error``, which is
0.0 if no component has any; vectors of fewer dimensions than components have as many components as
dimensions; an empty table gives an empty result; other columns are ignored; entries beyond 2**62 after
scaling are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers held at once while squares are added up.
HELD = 1 << 20


@dataclass
class Whitening:
    """Fit of the vectors of one length: exact ``n``, ``sums`` and ``twice`` (2 n n times the covariance) as
    Python integers; ``values`` and ``vectors`` (columns) of the first components; ``explained`` shares."""

    n: int
    sums: list[int]
    twice: list[list[int]]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def covariance(self) -> np.ndarray:
        return np.array([[v / (2 * self.n * self.n) for v in row] for row in self.twice])


def _rows(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their scaled and floored entries) for each length of vectors."""
    column = batch.column("embedding")
    lengths = np.diff(column.offsets.to_numpy())
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        scaled = np.floor(flat * scale).reshape(len(at), length)
        if np.abs(scaled).max() >= 2.0 ** 62:
            raise ValueError("an entry is beyond 2**62 after scaling")
        yield at, scaled.astype(np.int64)


def _add(totals: np.ndarray, values: np.ndarray, square: bool) -> None:
    """Add the columns of ``values`` (or of its squares) to Python integers; exact whatever their size."""
    most = int(np.abs(values).max(initial=0))
    most = most * most if square else most
    if most >= 1 << 62:
        values, step = values.astype(object), len(values)
    else:
        step = max(1, ((1 << 62) - 1) // max(most, 1))
    for start in range(0, len(values), step):
        part = values[start:start + step]
        totals += np.sum(part * part if square else part, axis=0).astype(object)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _usable(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))


def _sums(usable: DataFrame, scale: float) -> dict[int, tuple[int, list[int]]]:
    """n and the sums of the floored entries, by length."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for at, values in _rows(batch, scale):
                n, totals = found.get(values.shape[1], (0, np.zeros(values.shape[1], object)))
                _add(totals, values, square=False)
                found[values.shape[1]] = n + len(at), totals
        for length, (n, totals) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()), pa.array([n] * length), _decimals(totals)],
                names=["length", "i", "n", "total"])

    got = usable.select("embedding").mapInArrow(add, "length int, i int, n long, total decimal(38,0)").groupBy("length", "i").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(got, key=lambda r: (r.length, r.i)):
        out.setdefault(r.length, (r.n, []))[1].append(int(r.total))
    return out


def _squares(usable: DataFrame, scale: float, centres: dict[int, list[int]]) -> dict[int, dict[tuple[int, int], int]]:
    """Sums of squares of the centred dimensions (i, i) and of the sums of two of them (i, j), by length."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for _, values in _rows(batch, scale):
                length = values.shape[1]
                values = values - np.array(centres[length], np.int64)
                totals = found.setdefault(length, [np.zeros(length - i, object) for i in range(length)])
                step = max(1, HELD // length)
                for start in range(0, len(values), step):
                    part = values[start:start + step]
                    for i in range(length):
                        sums = part[:, i:] + part[:, i:i + 1]
                        sums[:, 0] = part[:, i]
                        _add(totals[i], sums, square=True)
        for length, totals in found.items():
            for i, row in enumerate(totals):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([length] * len(row), pa.int32()), pa.array([i] * len(row), pa.int32()),
                     pa.array(range(i, length), pa.int32()), _decimals(row)], names=["length", "i", "j", "total"])

    got = usable.select("embedding").mapInArrow(add, "length int, i int, j int, total decimal(38,0)").groupBy("length", "i", "j").agg(
        F.sum("total").alias("total")).collect()
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in got:
        out.setdefault(r.length, {})[r.i, r.j] = int(r.total)
    return out


def _polarised(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> list[list[int]]:
    """2 n n cov(i, j) from the sums of squares; ``rest``: what the sums of the centred entries are."""
    length = len(rest)
    var = lambda i, j: n * squares[i, j] - (rest[i] if i == j else rest[i] + rest[j]) ** 2  # noqa: E731  n n var
    twice = [[0] * length for _ in range(length)]
    for i in range(length):
        twice[i][i] = 2 * var(i, i)
        for j in range(i + 1, length):
            twice[i][j] = twice[j][i] = var(i, j) - var(i, i) - var(j, j)
    return twice


def _fit_plain(fit: Whitening, offset: int) -> tuple:
    """What tasks need, without this package's types."""
    centres = [round_half(s, fit.n) for s in fit.sums]
    rest = [s - fit.n * c for s, c in zip(fit.sums, centres)]
    weights = np.divide(fit.vectors, np.sqrt(fit.values), out=np.zeros_like(fit.vectors), where=fit.values > 0)
    return fit.n, np.array([c - offset for c in centres], np.int64), rest, weights


def round_half(total: int, n: int) -> int:
    """The whole number nearest to total / n."""
    return (2 * total + n) // (2 * n)


def _projected(values: np.ndarray, plain: tuple) -> np.ndarray:
    n, centres, rest, weights = plain
    return (values - centres - np.array([r / n for r in rest])) @ weights


def fit_whitening(vectors: DataFrame, components: int = 8, scale: float = 1024, offset: int = 100_000) -> dict[int, Whitening]:
    """Fit all usable vectors of ``vectors(vec_id, embedding)``: a :class:`Whitening` for each length."""
    usable = _usable(vectors)
    counted = _sums(usable, scale)
    centres = {length: [round_half(t, n) for t in totals] for length, (n, totals) in counted.items()}
    squares = _squares(usable, scale, centres) if counted else {}
    fits = {}
    for length, (n, totals) in counted.items():
        rest = [t - n * c for t, c in zip(totals, centres[length])]
        fit = Whitening(n, [t + n * offset for t in totals], _polarised(n, rest, squares[length]), *(np.empty(0),) * 3)
        covariance = fit.covariance()
        values, vectors_ = np.linalg.eigh(covariance)
        values, vectors_ = values[::-1], vectors_[:, ::-1]
        trace = float(np.trace(covariance))
        flat = values <= length * np.finfo(float).eps * max(values[0], 0.0)
        values = np.where(flat, 0.0, values)
        fit.values, fit.vectors = values[:components], np.ascontiguousarray(vectors_[:, :components])
        fit.explained = fit.values / trace if trace > 0 else np.zeros(len(fit.values))
        fits[length] = fit
    _measure(usable, fits, scale, offset)
    return fits


def _measure(usable: DataFrame, fits: dict[int, Whitening], scale: float, offset: int) -> None:
    """Set identity_error: the covariance of the whitened rows against the identity."""
    if not fits:
        return
    plain = usable.sparkSession.sparkContext.broadcast({k: _fit_plain(f, offset) for k, f in fits.items()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, values in _rows(batch, scale):
                w = _projected(values, plain.value[values.shape[1]])
                both = np.concatenate((w, np.ones((len(at), 1))), 1)
                found[values.shape[1]] = found.get(values.shape[1], 0) + both.T @ both
        for length, m in found.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, length), pa.int32()), pa.array(i.ravel(), pa.int32()),
                                              pa.array(j.ravel(), pa.int32()), pa.array(m.ravel())], names=["length", "i", "j", "total"])

    got = usable.select("embedding").mapInArrow(add, "length int, i int, j int, total double").groupBy("length", "i", "j").agg(
        F.sum("total").alias("total")).collect()
    for length, fit in fits.items():
        k = len(fit.values)
        m = np.zeros((k + 1, k + 1))
        for r in got:
            if r.length == length:
                m[r.i, r.j] = r.total / fit.n
        # the projected rows are centred already; what rounding left of their means goes as well
        off = np.abs(m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k))
        held = fit.values > 0
        fit.identity_error = float(off[np.ix_(held, held)].max(initial=0.0))


def whiten(vectors: DataFrame, fits: dict[int, Whitening], scale: float = 1024, offset: int = 100_000) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row per usable vector and
    component.  ``deviation`` is the exact sum over dimensions of (n x - S) squared, a decimal."""
    plain = vectors.sparkSession.sparkContext.broadcast({k: (
        *_fit_plain(f, offset), f.values > 0, f.explained, f.identity_error) for k, f in fits.items()})
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, values in _rows(batch, scale):
                if values.shape[1] not in plain.value:
                    raise ValueError(f"no fit for vectors of {values.shape[1]} entries")
                n, centres, rest, weights, held, explained, error = plain.value[values.shape[1]]
                w = _projected(values, (n, centres, rest, weights))
                y = values - centres
                # sum (n y - rest)^2 = n n sum y^2 - 2 n sum y rest + sum rest^2
                if int(np.abs(y).max(initial=0)) * max(int(np.abs(y).max(initial=0)), *map(abs, rest)) * y.shape[1] >= 1 << 62:
                    y = y.astype(object)
                r = np.array(rest, y.dtype)
                own = sum(v * v for v in rest)
                deviation = [n * n * int(q) - 2 * n * int(t) + own for q, t in zip((y * y).sum(1), (y * r).sum(1))]
                k = w.shape[1]
                shown = pa.array(w.ravel(), mask=np.broadcast_to(~held, w.shape).ravel())
                offsets = pa.array(np.arange(0, w.size + 1, k), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(at)), pa.array(np.full(len(at), n)), _decimals(deviation),
                     pa.ListArray.from_arrays(offsets, shown), pa.ListArray.from_arrays(offsets, pa.array(np.tile(explained, len(at)))),
                     pa.array(np.full(len(at), error))],
                    names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = _usable(vectors).mapInArrow(
        project, f"vec_id {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    return rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "at")).select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("at.whitened").alias("whitened"),
        F.col("at.explained").alias("explained"), "identity_error")
