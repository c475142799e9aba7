"""Registered queries of dense vectors and spherical k-means, over all embeddings."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import clustering, dense
from ..runtime import table
from ..sources import sinks

K = 10
TOLERANCES = (0.0, 0.05, 0.2, 0.5, 2.0)


def points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")


def unit_points(spark, d):
    return clustering.normalize(points(spark, d))


def _flat(df, key, col):
    return df.select(key, F.posexplode(col).alias("j", "x")).select(key, F.col("j").cast("bigint").alias("j"), F.round("x", 6).alias("x"))


def _matrix(spark, m: np.ndarray):
    return _flat(clustering.as_centroids(spark, m), "cluster", "centroid")


def l2_normalize(spark, d):
    return _flat(unit_points(spark, d), "row_id", "embedding")


def _with_next(spark, d):
    a = unit_points(spark, d)
    return a.join(a.select((F.col("row_id") - 1).alias("row_id"), F.col("embedding").alias("b")), "row_id")


def vec_dot(spark, d):
    return _with_next(spark, d).select("row_id", F.round(vectors.dot(F.col("embedding"), F.col("b")), 6).alias("dot"))


def vec_distance(spark, d):
    return _with_next(spark, d).select("row_id", F.round(vectors.distance(F.col("embedding"), F.col("b")), 6).alias("distance"))


def argmax(spark, d):
    return points(spark, d).select("row_id", vectors.arg_max(F.col("embedding")).alias("at"))


def step_sample(spark, d):
    return _flat(clustering.step_sample(unit_points(spark, d), K), "cluster", "centroid")


def _after(spark, d, steps):
    p = points(spark, d)
    m = clustering.as_matrix(clustering.step_sample(p, K), unit=True)
    for _ in range(steps):
        m = clustering.step(p, m, unit=True)
    return p, m


def kmeans_assign(spark, d):
    return clustering.assign(*_after(spark, d, 0), unit=True)


def _steps(n, spark, d):
    return _matrix(spark, _after(spark, d, n)[1])


def kmeans_shift_stats(spark, d):
    p, m = _after(spark, d, 0)
    s = clustering.shift_stats(m, clustering.step(p, m, unit=True))
    return spark.createDataFrame([tuple(round(s[k], 6) for k in ("max", "mean", "stddev"))], "max double, mean double, stddev double")


def kmeans_tolerance(spark, d):
    """Whether the centroids have come to rest after one step, for several tolerances."""
    p, m = _after(spark, d, 0)
    new = clustering.step(p, m, unit=True)
    return spark.createDataFrame([(e, clustering.converged(m, new, e)) for e in TOLERANCES], "epsilon double, converged boolean")


def kmeans_run(spark, d):
    """The whole loop, with a tolerance that the first step meets and one that stops at the largest number of steps."""
    p = points(spark, d)
    runs = [(e, clustering.kmeans(p, K, e, 2, unit=True)) for e in (2.0, 0.0)]
    rows = [_flat(clustering.as_centroids(spark, r.centroids), "cluster", "centroid").select(F.lit(e).alias("epsilon"), F.lit(r.steps).cast("bigint").alias("steps"), "cluster", "j", "x") for e, r in runs]
    return rows[0].unionAll(rows[1])


def word_cluster_lines(spark, d):
    """The lines of the clustering program after at most two steps; a vector's name stands for its word."""
    p = points(spark, d)
    found = clustering.assign(p, clustering.kmeans(p, K, 0.0, 2, unit=True).centroids, unit=True)
    return sinks.cluster_lines(found.select(F.concat(F.lit("w"), F.col("row_id").cast("string")).alias("word"), "cluster"))


def word_cluster(spark, d):
    return clustering.word_clusters(points(spark, d))


def _dense(spark, d):
    t = table(spark, d, "titles").filter("idx IS NOT NULL AND title IS NOT NULL")
    return t.groupBy(F.col("idx").alias("i")).agg(F.max(F.length("title")).cast("bigint").alias("e"))


def dense_vec_ops(spark, d):
    """Title lengths by document: insert, update with a default at the documents, change all, remove the even places."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("i")).distinct()
    vec = dense.insert(_dense(spark, d), docs.filter("i % 10 = 0").select("i", F.lit(7).cast("bigint").alias("e")))
    vec = dense.update(vec, docs, lambda e: e + 1, 100)
    return dense.remove(dense.update_all(vec, lambda e: e * 2), docs.filter("i % 2 = 0"))


def dense_get(spark, d):
    """What is at the place of each document, null at a hole."""
    return dense.get(_dense(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("i")).distinct())


def dense_length(spark, d):
    return dense.length(_dense(spark, d))


def sparse_dim(spark, d):
    return dense.sparse_dim(_dense(spark, d))


QUERIES = {
    **{q.__name__: q for q in (l2_normalize, vec_dot, vec_distance, argmax, step_sample, kmeans_assign, kmeans_shift_stats, kmeans_tolerance, kmeans_run, word_cluster, word_cluster_lines, dense_vec_ops, dense_get, dense_length, sparse_dim)},
    "kmeans_step": partial(_steps, 1),
    "kmeans_three_steps": partial(_steps, 3),
}

# ---------------------------------------------------------------- SQL

_P = f"""
raw AS (SELECT vec_id AS row_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
len AS (SELECT *, sqrt(list_inner_product(v, v)) AS l FROM raw),
p AS (SELECT row_id, list_transform(v, lambda x: x / CASE WHEN l = 0 THEN 1 ELSE l END) AS v FROM len),
num AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS i, (SELECT count(*) FROM p) // {K} AS s FROM p),
c0 AS (SELECT CAST(i // s AS BIGINT) AS cluster, v FROM num WHERE i % s = 0 AND i // s < {K})"""


def _step_sql(i):
    return f"""
a{i} AS (SELECT row_id, p.v, cluster, row_number() OVER (PARTITION BY row_id ORDER BY list_inner_product(p.v, c.v) DESC, cluster) AS rn FROM p, c{i} c),
s{i} AS (SELECT cluster, j, sum(x) AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i} WHERE rn = 1) GROUP BY ALL),
n{i} AS (SELECT cluster, list(x ORDER BY j) AS v FROM s{i} GROUP BY cluster),
c{i + 1} AS (SELECT c.cluster, CASE WHEN n.v IS NULL THEN list_transform(c.v, lambda x: 0.0::DOUBLE) ELSE list_transform(n.v, lambda x: x / sqrt(list_inner_product(n.v, n.v))) END AS v FROM c{i} c LEFT JOIN n{i} n USING (cluster))"""


def _flat_sql(source, key):
    return f"SELECT {key}, unnest(range(len(v))) AS j, round(unnest(v), 6) AS x FROM {source}"


def _loop_sql(steps, epsilon):
    """All steps of the loop; once it has converged, centroids stay as they are."""
    k = "(SELECT floor(sqrt(count(*)))::BIGINT FROM p)"
    out = [_P.replace(f"// {K}", f"// {k}").replace(f"< {K}", f"< {k}"), "k0 AS MATERIALIZED (SELECT *, false AS done FROM c0)"]
    for i in range(steps):
        out.append(f"""a{i} AS MATERIALIZED (SELECT row_id, p.v, cluster, row_number() OVER (PARTITION BY row_id ORDER BY list_inner_product(p.v, c.v) DESC, cluster) AS rn FROM p, k{i} c),
s{i} AS (SELECT cluster, j, sum(x) AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i} WHERE rn = 1) GROUP BY ALL),
n{i} AS (SELECT cluster, list(x ORDER BY j) AS v FROM s{i} GROUP BY cluster),
m{i} AS MATERIALIZED (SELECT c.cluster, c.v AS old, done, CASE WHEN n.v IS NULL THEN list_transform(c.v, lambda x: 0.0::DOUBLE) ELSE list_transform(n.v, lambda x: x / sqrt(list_inner_product(n.v, n.v))) END AS new
  FROM k{i} c LEFT JOIN n{i} n USING (cluster)),
k{i + 1} AS MATERIALIZED (SELECT cluster, CASE WHEN done THEN old ELSE new END AS v,
  done OR (SELECT max(list_max(list_transform(list_zip(old, new), lambda z: abs(z[1] - z[2])))) FROM m{i}) <= {epsilon} AS done FROM m{i})""")
    out.append(f"z AS (SELECT row_id, cluster, row_number() OVER (PARTITION BY row_id ORDER BY list_inner_product(p.v, c.v) DESC, cluster) AS rn FROM p, k{steps} c)")
    return f"WITH {', '.join(out)} SELECT row_id, cluster FROM z WHERE rn = 1"


_NEXT = f"WITH {_P}, n AS (SELECT a.row_id, a.v, b.v AS w FROM p a JOIN p b ON b.row_id = a.row_id + 1)"
_DENSE = "d0 AS (SELECT idx AS i, max(length(title)) AS e FROM titles WHERE idx IS NOT NULL AND title IS NOT NULL GROUP BY idx)"
ORACLES = {
    "l2_normalize": f"WITH {_P} {_flat_sql('p', 'row_id')}",
    "vec_dot": f"{_NEXT} SELECT row_id, round(list_inner_product(v, w), 6) AS dot FROM n",
    "vec_distance": f"{_NEXT} SELECT row_id, round(list_distance(v, w), 6) AS distance FROM n",
    "argmax": f"WITH {_P} SELECT row_id, list_position(v, list_max(v))::BIGINT - 1 AS at FROM raw",
    "step_sample": f"WITH {_P} {_flat_sql('c0', 'cluster')}",
    "kmeans_assign": f"WITH {_P}, {_step_sql(0)} SELECT row_id, cluster FROM a0 WHERE rn = 1",
    "kmeans_step": f"WITH {_P}, {_step_sql(0)} {_flat_sql('c1', 'cluster')}",
    "kmeans_three_steps": f"WITH {_P}, {_step_sql(0)}, {_step_sql(1)}, {_step_sql(2)} {_flat_sql('c3', 'cluster')}",
    "kmeans_shift_stats": f"""WITH {_P}, {_step_sql(0)}, m AS (SELECT list_distance(c0.v, c1.v) AS x FROM c0 JOIN c1 USING (cluster))
      SELECT round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS stddev FROM m""",
    "kmeans_tolerance": f"""WITH {_P}, {_step_sql(0)}, m AS (SELECT list_max(list_transform(list_zip(c0.v, c1.v), lambda z: abs(z[1] - z[2]))) AS x FROM c0 JOIN c1 USING (cluster))
      SELECT e::DOUBLE AS epsilon, (SELECT max(x) FROM m) <= e AS converged FROM (VALUES {", ".join(f"({e}::DOUBLE)" for e in TOLERANCES)}) t(e)""",
    "kmeans_run": f"""WITH {_P}, {_step_sql(0)}, {_step_sql(1)}, r AS (SELECT 2.0::DOUBLE AS epsilon, 1::BIGINT AS steps, * FROM c1 UNION ALL SELECT 0.0::DOUBLE, 2::BIGINT, * FROM c2)
      {_flat_sql('r', 'epsilon, steps, cluster')}""",
    "word_cluster_lines": f"WITH {_P}, {_step_sql(0)}, {_step_sql(1)}, {_step_sql(2)} SELECT 'w' || row_id || chr(9) || cluster AS value FROM a2 WHERE rn = 1",
    "word_cluster": _loop_sql(25, 0.05),
    "dense_get": f"WITH {_DENSE} SELECT i, e FROM (SELECT DISTINCT doc_id AS i FROM documents) LEFT JOIN d0 USING (i)",
    "dense_vec_ops": f"""WITH {_DENSE}, docs AS (SELECT DISTINCT doc_id AS i FROM documents),
      d1 AS (SELECT coalesce(d0.i, n.i) AS i, CASE WHEN n.i IS NOT NULL THEN 7 ELSE e END AS e FROM d0 FULL JOIN (SELECT i FROM docs WHERE i % 10 = 0) n ON d0.i = n.i),
      d2 AS (SELECT coalesce(d1.i, docs.i) AS i, CASE WHEN docs.i IS NULL THEN e WHEN d1.i IS NULL THEN 100 ELSE e + 1 END AS e FROM d1 FULL JOIN docs ON d1.i = docs.i)
      SELECT i, e * 2 AS e FROM d2 WHERE NOT (i % 2 = 0 AND i IN (SELECT i FROM docs))""",
    "dense_length": f"WITH {_DENSE} SELECT count(*) AS len, coalesce(max(i) + 1, 0) AS dim FROM d0",
    "sparse_dim": f"WITH {_DENSE} SELECT coalesce(max(i), 0) AS dim FROM d0",
}
