"""Spectral analysis of a vector table (V1–V9).

The table ``(row id, vec array<double>)`` is the n × p matrix A (or G).  All
passes over the rows are distributed; the only driver objects are p × k
matrices (k columns of a subspace, bounded by the parameters) and k × k /
p × p small matrices whose size is checked.

* products with a basis (V1, V3–V5) multiply Arrow batches by a broadcast
  matrix of checked size; the tasks' partial sums are added slice by slice on
  the executors, and only the total reaches the driver.
* the iterative methods (V2, V6) are driver loops over V1.
* the grid density (V9) adds blocks of kernels on the grid inside the tasks.
* the Gram matrix (V7) is a pure aggregation.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions import arrays as AR

MAX_DRIVER_CELLS = 50_000_000   # size check for p × k matrices held on the driver


def _check(p: int, k: int):
    if p * k > MAX_DRIVER_CELLS:
        raise ValueError(f"{p}×{k} subspace exceeds the checked driver bound")


_SLICE_CELLS = 1 << 16          # cells of a partial sum that travel as one row


def _rows_of(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as rows of a matrix."""
    flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(batch.num_rows, -1)


def _vectors(df: DataFrame, vec_col: str) -> DataFrame:
    return df.where(F.col(vec_col).isNotNull()).select(AR.to_double(vec_col).alias("v"))


def _total_slices(df: DataFrame, add, cells: int) -> DataFrame:
    """(lo, cells): Σ over the batches of ``add(batch)``, an array of ``cells`` numbers, in
    slices: each task adds up its own, the tasks' sums are added slice by slice."""
    def partial(batches):
        acc = np.zeros(cells)
        for batch in batches:
            if batch.num_rows:
                acc += add(batch)
        for lo in range(0, cells, _SLICE_CELLS):
            yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([acc[lo:lo + _SLICE_CELLS]])], ["lo", "cells"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, lo in enumerate(batch.column(0).to_pylist()):
                part = batch.column(1)[k].values.to_numpy(zero_copy_only=False)
                sums[lo] = sums[lo] + part if lo in sums else np.array(part)
        for lo, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([part])], ["lo", "cells"])

    schema = "lo long, cells array<double>"
    parts = df.mapInArrow(partial, schema)
    slices = -(-cells // _SLICE_CELLS)
    return parts.repartition(min(slices, 200), "lo").mapInArrow(merge, schema)


def _total(df: DataFrame, add, cells: int) -> np.ndarray:
    """The total of ``_total_slices`` on the driver: ``cells`` numbers."""
    out = np.zeros(cells)
    for r in _total_slices(df, add, cells).collect():
        out[r["lo"]:r["lo"] + len(r["cells"])] = r["cells"]
    return out


def _total_rows(df: DataFrame, add, cells: int) -> DataFrame:
    """(cell, value): the total as a table."""
    return _total_slices(df, add, cells).select("lo", F.posexplode("cells").alias("pos", "value")).select(
        (F.col("lo") + F.col("pos")).alias("cell"), "value")


# V1 ---------------------------------------------------------------------------
def gram_times(df: DataFrame, vec_col: str, Q: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Aᵀ(A Q) (uncentred), rows in Arrow batches inside the tasks."""
    p, k = Q.shape
    _check(p, k)
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(Q, dtype=np.float64))    # checked size

    def add(batch):
        A = _rows_of(batch)
        return (A.T @ (A @ shared.value)).ravel()
    return scale * _total(_vectors(df, vec_col), add, p * k).reshape(p, k)


# V2 ---------------------------------------------------------------------------
def gram_schmidt(Z: np.ndarray) -> np.ndarray:
    """Modified Gram–Schmidt on the columns."""
    Q = np.array(Z, dtype=np.float64)
    for j in range(Q.shape[1]):
        for i in range(j):
            Q[:, j] -= (Q[:, i] @ Q[:, j]) * Q[:, i]
        n = np.linalg.norm(Q[:, j])
        Q[:, j] = Q[:, j] / n if n > 0 else Q[:, j]
    return Q


def orthogonal_iteration(df: DataFrame, vec_col: str, k: int, iters: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Top-k eigenpairs of AᵀA; k = min(k, p, n).  Returns (eigenvalues, Q)."""
    first = df.select(vec_col).first()[0]
    p = len(first)
    n = df.count()
    k = min(k, p, n)
    Q = gram_schmidt(np.random.default_rng(seed).normal(size=(p, k)))
    for _ in range(iters):
        Q = gram_schmidt(gram_times(df, vec_col, Q))
    return rayleigh(df, vec_col, Q), Q


# V3 ---------------------------------------------------------------------------
def rayleigh(df: DataFrame, vec_col: str, Q: np.ndarray) -> np.ndarray:
    """Σ(A q)² / Σ q² per column (one distributed pass)."""
    AQ2 = np.diag(Q.T @ gram_times(df, vec_col, Q))
    return AQ2 / (Q ** 2).sum(axis=0)


def rayleigh_df(df: DataFrame, vec_col: str, basis: DataFrame) -> DataFrame:
    """Table form: ``basis(j, q array)``; Σ_r (A_r·q_j)² / ‖q_j‖² per j.  The basis is
    broadcast as a matrix of checked size; a block of rows is one product."""
    size = basis.agg(F.count(F.lit(1)).alias("k"), F.max(F.size("q")).alias("p")).first()
    _check(size.p or 0, size.k)
    qs = basis.orderBy("j").collect()                      # k rows of checked size
    if not qs:
        return basis.select("j", F.lit(0.0).alias("eigenvalue"))
    Q = np.array([r["q"] for r in qs], dtype=np.float64).T
    shared = df.sparkSession.sparkContext.broadcast(Q)
    num = _total_rows(_vectors(df, vec_col), lambda batch: np.square(_rows_of(batch) @ shared.value).sum(axis=0), len(qs))
    den = [(i, r["j"], float(d)) for i, (r, d) in enumerate(zip(qs, (Q ** 2).sum(axis=0)))]
    names = df.sparkSession.createDataFrame(den, f"cell long, j {basis.schema['j'].dataType.simpleString()}, den double")
    return num.join(F.broadcast(names), "cell").select("j", (F.col("value") / F.col("den")).alias("eigenvalue"))


# V4 ---------------------------------------------------------------------------
def reconstruction_error(df: DataFrame, vec_col: str, Q: np.ndarray) -> DataFrame:
    """‖A − AQQᵀ‖_F, absolute and relative to ‖A‖_F (one pass of block products)."""
    _check(*Q.shape)
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(Q, dtype=np.float64))

    def squares(batches):
        for batch in batches:
            if batch.num_rows:
                A = _rows_of(batch)
                rest = A - (A @ shared.value) @ shared.value.T
                yield pa.RecordBatch.from_arrays([pa.array([float(np.square(rest).sum())]),
                                                  pa.array([float(np.square(A).sum())])], ["e", "a"])

    return _vectors(df, vec_col).mapInArrow(squares, "e double, a double").agg(
        F.sqrt(F.sum("e")).alias("abs_error"), F.sqrt(F.sum("a")).alias("__norm")).select(
        "abs_error", (F.col("abs_error") / F.col("__norm")).alias("rel_error"))


# V5 ---------------------------------------------------------------------------
def project(df: DataFrame, vec_col: str, P: np.ndarray, rank: int, out: str = "projected") -> DataFrame:
    """``df`` with ``out`` = P Pᵀ v on the leading ``rank`` columns of P, a broadcast
    matrix of checked size; a null vector has a null projection."""
    lead = np.asarray(P, dtype=np.float64)[:, :rank]
    _check(*lead.shape)
    shared = df.sparkSession.sparkContext.broadcast(lead)
    rows = df.select(AR.to_double(vec_col).alias("v"), F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()

    def products(batches):
        for batch in batches:
            some = batch.column(0).is_valid()
            made = np.zeros((0, 0))
            if batch.num_rows and some.true_count:
                made = (_rows_of(batch.filter(some)) @ shared.value) @ shared.value.T
            every = iter(made)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(
                [next(every) if ok else None for ok in some.to_pylist()], pa.list_(pa.float64()))], ["row", "made"])

    made = rows.mapInArrow(products, f"row {kind}, made array<double>")
    return made.select(*[F.col("row").getField(c).alias(c) for c in df.columns], F.col("made").alias(out))


# V6 ---------------------------------------------------------------------------
def lanczos(df: DataFrame, vec_col: str, iters: int, seed: int = 0, tol: float = 1e-10,
            scale: float | None = None) -> np.ndarray:
    """Tridiagonal T of the Lanczos recurrence on GᵀG/n with full
    re-orthogonalisation (up to 10 extra rounds); the matvec is V1 with one
    column."""
    p = len(df.select(vec_col).first()[0])
    n = df.count()
    s = (1.0 / n) if scale is None else scale
    rng = np.random.default_rng(seed)
    v = rng.normal(size=p)
    v /= np.linalg.norm(v)
    V = [v]
    alphas, betas = [], []
    for it in range(min(iters, p)):
        w = gram_times(df, vec_col, V[-1][:, None], s)[:, 0]
        a = float(w @ V[-1])
        w = w - a * V[-1] - (betas[-1] * V[-2] if betas else 0.0)
        for _ in range(10):                                 # full re-orthogonalisation
            Vm = np.stack(V, axis=1)
            c = Vm.T @ w
            w = w - Vm @ c
            if np.max(np.abs(c)) < tol:
                break
        alphas.append(a)
        b = float(np.linalg.norm(w))
        if it == min(iters, p) - 1 or b < tol:
            break
        betas.append(b)
        V.append(w / b)
    m = len(alphas)
    T = np.diag(alphas)
    for i in range(m - 1):
        T[i, i + 1] = T[i + 1, i] = betas[i]
    return T


# V7 ---------------------------------------------------------------------------
def gram_matrix(df: DataFrame, vec_col: str, scale: float | None = None) -> DataFrame:
    """GᵀG/n as a long table (i, j, value): p² groups, map-side partial sums.

    Row i of each outer product is produced from the exploded coordinate x_i
    times the row vector, so no lambda re-reads an outer array.
    """
    a = AR.to_double(vec_col)
    d = df.select(a.alias("__a")).select("__a", F.posexplode("__a").alias("i", "__xi"))
    d = d.select("i", F.posexplode(F.transform("__a", lambda y: y * F.col("__xi"))).alias("j", "__v"))
    g = d.groupBy("i", "j").agg(F.sum("__v").alias("__s"), F.count(F.lit(1)).alias("__n"))
    denom = F.col("__n") if scale is None else F.lit(1.0 / scale)
    return g.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"),
                    (F.col("__s") / denom).alias("value"))


def exact_spectrum(df: DataFrame, vec_col: str) -> np.ndarray:
    """Eigenvalues of GᵀG/n: the p × p Gram matrix (size-checked) on the driver."""
    p = len(df.select(vec_col).first()[0])
    _check(p, p)                                            # before anything is collected
    g = gram_matrix(df, vec_col).collect()
    M = np.zeros((p, p))
    for r in g:
        M[r["i"], r["j"]] = r["value"]
    return np.linalg.eigvalsh(M)


# V8 ---------------------------------------------------------------------------
def quadrature(tridiags: DataFrame, mask_negative: bool = False) -> DataFrame:
    """Per draw: eigenvalues of T sorted, weight = squared first eigenvector
    component (``applyInPandas`` per draw).  ``tridiags(draw, alphas, betas)``."""
    def per_draw(pdf: pd.DataFrame) -> pd.DataFrame:
        draw, main, off = pdf.iloc[0][["draw", "alphas", "betas"]]
        order = len(main)
        band = np.zeros((order, order))
        band[np.arange(order), np.arange(order)] = main
        band[np.arange(1, order), np.arange(order - 1)] = off      # eigh reads the lower half
        eig, vectors = np.linalg.eigh(band)                        # ascending
        if mask_negative:
            eig[eig < 0] = 1.0
        return pd.DataFrame({"draw": draw, "k": np.arange(order), "eig": eig, "weight": np.square(vectors[0])})
    return tridiags.groupBy("draw").applyInPandas(per_draw, "draw long, k long, eig double, weight double")


# V9 ---------------------------------------------------------------------------
def spectral_density(eigs: DataFrame, grid_len: int = 10000, sigma_squared: float | None = None,
                     grid_expand: float = 1e-2) -> DataFrame:
    """Gaussian-kernel density of weighted eigenvalues on a grid, averaged over
    draws and normalised to 1.  ``eigs(draw, eig, weight)`` may be of any size: a
    block of eigenvalues adds its kernels to the grid's values inside the task,
    and only these ``grid_len`` numbers travel."""
    ends = eigs.groupBy("draw").agg(F.max("eig").alias("hi"), F.min("eig").alias("lo")).agg(
        F.avg("hi").alias("hi"), F.avg("lo").alias("lo"), F.count(F.lit(1)).alias("draws")).first()
    spark = eigs.sparkSession
    if not ends.draws:
        return spark.createDataFrame([], "grid_idx long, x double, density double")
    lam_max, lam_min = ends.hi + grid_expand, ends.lo - grid_expand
    width = max(1.0, lam_max - lam_min)
    var = (1e-5 if sigma_squared is None else sigma_squared) * width
    step = (lam_max - lam_min) / (grid_len - 1)
    x = lam_min + np.arange(grid_len) * step
    x[-1] = lam_max

    def add(batch):
        e, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        acc = np.zeros(grid_len)
        for lo in range(0, len(e), _KERNELS):
            part = slice(lo, lo + _KERNELS)
            acc += w[part] @ np.exp(-np.square(e[part, None] - x[None, :]) / (2 * var))
        return acc

    sums = _total_rows(eigs.select(F.col("eig").cast("double"), F.col("weight").cast("double")), add, grid_len)
    g = sums.select(F.col("cell").alias("grid_idx"),
                    F.when(F.col("cell") == grid_len - 1, F.lit(lam_max))
                    .otherwise(F.lit(lam_min) + F.col("cell") * F.lit(step)).alias("x"),
                    (F.col("value") / F.lit(math.sqrt(2 * math.pi * var) * ends.draws)).alias("raw"))
    norm = g.agg((F.sum("raw") * F.lit(step)).alias("__z"))
    return g.join(F.broadcast(norm), how="inner").select("grid_idx", "x", (F.col("raw") / F.col("__z")).alias("density"))


_KERNELS = 256                  # eigenvalues of a block
