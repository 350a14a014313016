"""Registered spectral-analysis queries (V1–V9) on the ``embeddings`` table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from veil.functions import arrays as AR
from veil.operators import spectral as V
from veil.plans.registry import register
from veil.plans.tables import read

K = 4


def _A(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))


def _Q(spark, sf_dir) -> np.ndarray:
    """Subspace columns: the first K embedding rows (K × p rows: bounded)."""
    rows = _A(spark, sf_dir).where(F.col("vec_id") < K).orderBy("vec_id").collect()
    return np.array([r["a"] for r in rows], dtype=np.float64).T


SQL_A = """
A AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings),
Q AS (SELECT vec_id AS j, a AS q FROM A WHERE vec_id < 4),
AQ AS (SELECT A.vec_id, Q.j, list_sum(list_transform(list_zip(A.a, Q.q), lambda z: z[1] * z[2])) AS aq FROM A, Q)"""


def _long(spark, M: np.ndarray, name="value"):
    rows = [(int(i), int(j), float(M[i, j])) for i in range(M.shape[0]) for j in range(M.shape[1])]
    return spark.createDataFrame(rows, f"i int, j int, {name} double")


@register("v1_gram_times", f"""
WITH {SQL_A}
SELECT CAST(i - 1 AS INTEGER) AS i, CAST(AQ.j AS INTEGER) AS j, round(sum(A.a[i] * AQ.aq), 6) AS value
FROM A JOIN AQ USING (vec_id), (SELECT unnest(range(1, 65)) AS i) GROUP BY i, AQ.j
""")
def v1_gram_times(spark, sf_dir):
    M = V.gram_times(_A(spark, sf_dir), "a", _Q(spark, sf_dir))
    return _long(spark, M).withColumn("value", F.round("value", 6))


@register("v2_orthogonal_iteration")
def v2_orthogonal_iteration(spark, sf_dir):
    ev, _ = V.orthogonal_iteration(_A(spark, sf_dir), "a", k=5, iters=20)
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(ev)], "k int, eigenvalue double")


@register("v3_rayleigh", f"""
WITH {SQL_A}
SELECT CAST(j AS INTEGER) AS j, round(sum(aq * aq) / any_value(qq), 6) AS eigenvalue
FROM AQ JOIN (SELECT j, list_sum(list_transform(q, lambda x: x * x)) AS qq FROM Q) USING (j) GROUP BY j
""")
def v3_rayleigh(spark, sf_dir):
    basis = _A(spark, sf_dir).where(F.col("vec_id") < K).select(F.col("vec_id").cast("int").alias("j"),
                                                                AR.to_double("a").alias("q"))
    r = V.rayleigh_df(_A(spark, sf_dir), "a", basis)
    return r.select(F.col("j").cast("int").alias("j"), F.round("eigenvalue", 6).alias("eigenvalue"))


@register("v4_reconstruction_error", f"""
WITH {SQL_A},
rec AS (SELECT AQ.vec_id, i, sum(AQ.aq * Q.q[i]) AS r FROM AQ JOIN Q USING (j), (SELECT unnest(range(1, 65)) AS i)
        GROUP BY AQ.vec_id, i),
res AS (SELECT sum((A.a[rec.i] - rec.r) * (A.a[rec.i] - rec.r)) AS e2 FROM rec JOIN A USING (vec_id)),
nrm AS (SELECT sum(list_sum(list_transform(a, lambda x: x * x))) AS n2 FROM A)
SELECT round(sqrt(e2), 6) AS abs_error, round(sqrt(e2) / sqrt(n2), 6) AS rel_error FROM res, nrm
""")
def v4_reconstruction_error(spark, sf_dir):
    e = V.reconstruction_error(_A(spark, sf_dir), "a", _Q(spark, sf_dir))
    return e.select(F.round("abs_error", 6).alias("abs_error"), F.round("rel_error", 6).alias("rel_error"))


@register("v5_project", f"""
WITH {SQL_A},
p AS (SELECT AQ.vec_id, i, sum(AQ.aq * Q.q[i]) AS v FROM AQ JOIN Q USING (j), (SELECT unnest(range(1, 65)) AS i)
      WHERE AQ.j < 2 GROUP BY AQ.vec_id, i)
SELECT vec_id, list(round(v, 6) + 0.0 ORDER BY i) AS projected FROM p GROUP BY vec_id
""")
def v5_project(spark, sf_dir):
    P = _Q(spark, sf_dir)
    a = _A(spark, sf_dir)
    made = V.project(a.select("vec_id", "a"), "a", P, 2)
    return made.select("vec_id", F.transform("projected", lambda x: F.round(x, 6) + 0.0).alias("projected"))


@register("v6_lanczos")
def v6_lanczos(spark, sf_dir):
    T = V.lanczos(_A(spark, sf_dir), "a", iters=16, seed=0)
    rows = [(i, float(T[i, i]), float(T[i, i + 1]) if i + 1 < T.shape[0] else None) for i in range(T.shape[0])]
    return spark.createDataFrame(rows, "i int, alpha double, beta double")


@register("v7_gram_matrix", """
SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j,
       round(avg(CAST(embedding[i] AS DOUBLE) * CAST(embedding[j] AS DOUBLE)), 6) AS value
FROM embeddings, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) GROUP BY i, j
""")
def v7_gram_matrix(spark, sf_dir):
    g = V.gram_matrix(_A(spark, sf_dir), "a")
    return g.withColumn("value", F.round("value", 6))


@register("v7_exact_spectrum")
def v7_exact_spectrum(spark, sf_dir):
    ev = V.exact_spectrum(_A(spark, sf_dir), "a")
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(ev)], "k int, eigenvalue double")


def _tridiags(spark, sf_dir, draws=4, iters=12):
    rows = []
    for d in range(draws):
        T = V.lanczos(_A(spark, sf_dir), "a", iters=iters, seed=d)
        rows.append((d, np.diag(T).tolist(), np.diag(T, 1).tolist()))
    return spark.createDataFrame(rows, "draw long, alphas array<double>, betas array<double>")


@register("v8_quadrature")
def v8_quadrature(spark, sf_dir):
    return V.quadrature(_tridiags(spark, sf_dir))


SQL_EIGS = """
eigs AS (SELECT label AS draw, i AS k, avg(CAST(embedding[i] AS DOUBLE)) AS eig, 1.0 / 8 AS weight
         FROM embeddings, (SELECT unnest(range(1, 9)) AS i) GROUP BY label, i)"""


@register("v9_spectral_density", f"""
WITH {SQL_EIGS},
b AS (SELECT avg(mx) + 0.01 AS hi, avg(mn) - 0.01 AS lo, count(*) AS nd
      FROM (SELECT draw, max(eig) AS mx, min(eig) AS mn FROM eigs GROUP BY draw)),
p AS (SELECT hi, lo, nd, (hi - lo) / 1999 AS step, 1e-3 * greatest(1.0, hi - lo) AS var FROM b),
g AS (SELECT g AS grid_idx, CASE WHEN g = 1999 THEN hi ELSE lo + g * step END AS x, step, var, nd
      FROM p, (SELECT unnest(range(0, 2000)) AS g)),
d AS (SELECT grid_idx, x, step, sum(weight * exp(-((eig - x) * (eig - x)) / (2 * var)) / sqrt(2 * pi() * var)) / any_value(nd) AS raw
      FROM g, eigs GROUP BY grid_idx, x, step)
SELECT grid_idx, round(x, 6) AS x, round(raw / (sum(raw) OVER () * step), 6) AS density FROM d
""")
def v9_spectral_density(spark, sf_dir):
    """Draws = labels; eigenvalues = the first 8 coordinates of each label's mean embedding."""
    e = read(spark, sf_dir, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 8)).alias("k", "v"))
    eigs = e.groupBy(F.col("label").alias("draw"), "k").agg(F.avg("v").alias("eig")).withColumn("weight", F.lit(1.0 / 8))
    d = V.spectral_density(eigs, grid_len=2000, sigma_squared=1e-3)
    return d.select("grid_idx", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))
