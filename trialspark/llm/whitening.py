"""Whitening of embeddings by eigenvectors refined beyond double precision.

1. Components become whole numbers, ``floor(SCALE * c)``; equal vectors count once in the fit.
2. Tasks add up whole numbers only: sums per dimension, then products of vectors shifted by
   their rounded means. Both are exact, so neither the order of the tasks nor a lost one
   changes a bit. The covariance is the exact sum over n less the square of the rest of the shift.
3. Float32 eigenvectors of the covariance are corrected by the iteration of Ogita and Aishima
   in extended precision: with R = I - X'X and S = X'AX each step adds X E, where E solves
   the first-order equations. Where eigenvalues lie closer together than the step can tell
   apart, the cluster is solved by itself: the matrix of the cluster, less its mean
   eigenvalue, turns the cluster's vectors to its eigenvectors, and the steps go on.
4. All vectors are projected in tasks.

The driver holds matrices of the vector's length squared, whatever the number of vectors.

Defined cases: vectors of null, of null or non-finite entries, and with entries beyond
2^52 / ``SCALE`` are left out; vectors of each length are fitted by themselves, those of length 0
have no components; a component without variance has null ``whitened``; ``explained`` is null
if no dimension varies; ``deviation`` is null where it does not fit a long; ties of
eigenvalues take any basis of their space; repeated rows each give rows; an empty table
gives none; only the id and the vector of the input are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

SCALE = 256
COMPONENTS = 4
STEPS = 40
_LONG = np.longdouble
_EXACT = 1 << 53


# ---- eigenvectors ----


def _exact(value: Fraction) -> np.longdouble:
    """The fraction in extended precision: a double and the rest."""
    high = float(value)
    return _LONG(high) + _LONG(float(value - Fraction(high)))


def _clusters(values: np.ndarray, gap) -> list[np.ndarray]:
    """Runs of sorted values whose neighbours are at most ``gap`` apart."""
    order = np.argsort(values, kind="stable")
    far = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, far) if len(c) > 1]


def _turn(a: np.ndarray, x: np.ndarray, cluster: np.ndarray) -> None:
    """Replaces the vectors of a cluster by the eigenvectors of A inside their span."""
    v = x[:, cluster]
    v = v + v @ (np.eye(len(cluster), dtype=_LONG) - v.T @ v) / 2
    inner = v.T @ (a @ v)
    middle = np.trace(inner) / len(cluster)
    inner = (inner + inner.T) / 2 - middle * np.eye(len(cluster), dtype=_LONG)
    size = np.abs(inner).max()
    if size > 0:
        turned = np.linalg.eigh((inner / size).astype(np.float64))[1].astype(_LONG)
        x[:, cluster] = v @ turned


def refine(a: np.ndarray, x: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, vectors) of symmetric ``a`` in extended precision, from approximate vectors ``x``."""
    a, x = a.astype(_LONG), x.astype(_LONG)
    eye = np.eye(len(a), dtype=_LONG)
    size = np.abs(a).sum(axis=1).max()
    least = np.finfo(_LONG).eps * len(a)
    before = np.inf
    for _ in range(steps):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        gap = max(2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum())), least * size)
        apart = values[None, :] - values[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            e = np.where(np.abs(apart) > gap, (s + values[None, :] * r) / apart, r / 2)
        x = x + x @ e
        change = np.abs(e).max(initial=0)
        tight = _clusters(values, gap)
        for cluster in tight:
            _turn(a, x, cluster)
        if change <= 8 * least or change >= before / 2 and change < 1e-15:
            break
        before = change
    x = x + x @ (eye - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit vectors in columns), to double precision and beyond."""
    size = np.abs(a).max(initial=0)
    if not size:
        return np.zeros(len(a), _LONG), np.eye(len(a), dtype=_LONG)
    scaled = a.astype(_LONG) / size
    values, x = refine(scaled, np.linalg.eigh(scaled.astype(np.float32))[1])
    return values * size, x


# ---- fit ----


def whole_vectors(batch: pa.RecordBatch, vec_col: str, scale: int) -> tuple[list[int], list[np.ndarray]]:
    """Rows that stay, and their vectors of whole numbers."""
    kept, out = [], []
    column = batch.column(vec_col)
    for i, vector in enumerate(column.to_pylist()):
        if vector is not None and None not in vector:
            v = np.array(vector, np.float64)
            if np.isfinite(v).all():
                x = np.floor(v * scale)
                if (np.abs(x) < 1 << 52).all():
                    kept.append(i)
                    out.append(x.astype(np.int64))
    return kept, out


def _rows(batches):
    """(length, matrix) of stored vectors, of each length by itself."""
    for batch in batches:
        by_length: dict[int, list[bytes]] = {}
        for n, b in zip(batch.column("length").to_pylist(), batch.column("x").to_pylist()):
            by_length.setdefault(n, []).append(b)
        for n, found in by_length.items():
            yield n, np.frombuffer(b"".join(found), "<i8").reshape(len(found), n)


def distinct_vectors(vectors: DataFrame, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(length, x): each vector of whole numbers once; equal rows of a task meet before the shuffle."""

    def run(batches):
        for batch in batches:
            found = whole_vectors(batch, vec_col, scale)[1]
            seen = list({x.astype("<i8").tobytes() for x in found if len(x)})
            yield pa.RecordBatch.from_arrays([pa.array([len(b) // 8 for b in seen], pa.int32()), pa.array(seen, pa.binary())], names=["length", "x"])

    return vectors.select(vec_col).mapInArrow(run, "length int, x binary").distinct()


def _add_up(distinct: DataFrame, part) -> DataFrame:
    """Sums of whole numbers (length, i, j, v) over all tasks; ``part(length, x)`` gives an array of Python integers."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for n, x in _rows(batches):
            sums[n] = sums.get(n, 0) + part(n, x)
        for n, total in sums.items():
            i, j = np.nonzero(total)
            values = pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(i), pa.int32()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), values], names=["length", "i", "j", "v"])

    parts = distinct.mapInArrow(run, "length int, i int, j int, v decimal(38,0)")
    return parts.groupBy("length", "i", "j").agg(F.sum("v").alias("v"))


def _products(y: np.ndarray) -> np.ndarray:
    """y'y in Python integers; doubles are exact while no sum can pass 2^53."""
    top = int(np.abs(y).max(initial=0))
    rows = (_EXACT - 1) // (top * top) if top else len(y)
    if not rows:
        o = y.astype(object)
        return o.T @ o
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for a in range(0, len(y), rows):
        z = y[a : a + rows].astype(np.float64)
        out += (z.T @ z).astype(np.int64)
    return out


@dataclass
class Model:
    """Sums, centre and components of the vectors of one length."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float | None]


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of vectors, from a stored table of distinct ones."""
    counts: dict[int, dict[int, int]] = {}

    def sums(n, x):
        top = max(1, int(np.abs(x).max(initial=0)))
        total = x.sum(axis=0).astype(object) if top * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
        return np.stack([np.append(total, len(x))]).astype(object)  # the last column counts the rows

    for r in _add_up(distinct, sums).collect():
        counts.setdefault(r["length"], {})[r["j"]] = int(r["v"])
    totals = {n: (c[n], [c.get(j, 0) for j in range(n)]) for n, c in counts.items()}
    centres = {n: np.array([(2 * s + m) // (2 * m) for s in total], np.int64) for n, (m, total) in totals.items()}
    products = {n: {} for n in totals}
    for r in _add_up(distinct, lambda n, x: _products(x - centres[n])).toLocalIterator():
        products[r["length"]][r["i"], r["j"]] = int(r["v"])
    out = {}
    for n, (m, total) in totals.items():
        rest = [Fraction(s, m) - int(c) for s, c in zip(total, centres[n])]
        matrix = np.zeros((n, n), _LONG)
        for i in range(n):
            for j in range(i, n):
                matrix[i, j] = matrix[j, i] = _exact(Fraction(products[n].get((i, j), 0), m) - rest[i] * rest[j])
        values, vectors = eigen(matrix)
        trace = np.trace(matrix)
        k = min(components, n)
        least = np.finfo(np.float64).eps * n * values[0]
        values = np.where(values > least, values, 0)
        share = [float(v / trace) if trace > 0 else None for v in values[:k]]
        out[n] = Model(m, total, centres[n], np.array([float(r) for r in rest]), values[:k].astype(np.float64), vectors[:, :k].astype(np.float64), share)
    return out


def _project(model: Model, x: np.ndarray) -> np.ndarray:
    """Whitened coordinates; NaN where a component has no variance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.values > 0, (((x - model.centre) - model.rest) @ model.vectors) / np.sqrt(model.values), np.nan)


def identity_errors(distinct: DataFrame, models: dict[int, Model]) -> dict[int, float | None]:
    """For each length, how far the covariance of the whitened fit list is from the identity."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for n, x in _rows(batches):
            z = _project(models[n], x)[:, models[n].values > 0]
            z = np.hstack([z, np.ones((len(z), 1))])
            sums[n] = sums.get(n, 0) + z.T @ z
        for n, total in sums.items():
            i, j = np.indices(total.shape)
            arrays = [pa.array([n] * total.size, pa.int32()), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())]
            yield pa.RecordBatch.from_arrays(arrays, names=["length", "i", "j", "v"])

    parts = distinct.mapInArrow(run, "length int, i int, j int, v double").groupBy("length", "i", "j").agg(F.sum("v").alias("v"))
    cells: dict[int, dict] = {}
    for r in parts.collect():  # (components + 1)^2 cells of each length
        cells.setdefault(r["length"], {})[r["i"], r["j"]] = r["v"]
    out = {}
    for n, model in models.items():
        k = int((model.values > 0).sum())
        total = np.array([[cells[n][i, j] for j in range(k + 1)] for i in range(k + 1)])
        mean = total[:k, k] / model.n
        wrong = np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k))
        out[n] = float(wrong.max()) if k else None
    return out


def deviations(model: Model, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; None beyond a long."""
    far = max([model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums), default=0)], default=0)
    if far * far * max(1, x.shape[1]) < 1 << 63:
        d = model.n * x - np.array(model.sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = x.astype(object) * model.n - np.array(model.sums, object)
    return [v if v < 1 << 63 else None for v in (int(s) for s in (d * d).sum(axis=1))]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every vector that stays."""
    distinct = save(distinct_vectors(vectors, vec_col, scale), "whole-vectors")
    models = fit(distinct, components)
    errors = identity_errors(distinct, models)
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            kept, found = whole_vectors(batch, "vector", scale)
            by_length: dict[int, list[int]] = {}
            for at, x in enumerate(found):
                if len(x):
                    by_length.setdefault(len(x), []).append(at)
            for n, at in by_length.items():
                model, x = models[n], np.stack([found[a] for a in at])
                k = len(model.values)
                white = _project(model, x).ravel()
                deviation = pa.array(deviations(model, x), pa.int64())
                rows = np.repeat(np.arange(len(at)), k)
                ids = batch.column("id").take(pa.array([kept[a] for a in at])).take(pa.array(rows))
                number = np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))
                arrays = [ids, pa.array(number), pa.array([model.n] * len(rows), pa.int64()), deviation.take(pa.array(rows)), pa.array(white, mask=np.isnan(white))]
                arrays += [pa.array(model.explained * len(at), pa.float64()), pa.array([errors[n]] * len(rows), pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    listed = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector"))
    out = listed.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
