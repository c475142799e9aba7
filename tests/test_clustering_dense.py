import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions import vectors
from lexweave.operators import clustering, dense

P = [(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, [-1.0, 0.0])]


def points(spark, rows=P):
    return spark.createDataFrame(rows, "row_id bigint, embedding array<double>")


def labels(df):
    return [r[1] for r in sorted(map(tuple, df.collect()))]


def test_steps(spark):
    p = points(spark)
    m0 = clustering.as_matrix(clustering.step_sample(p, 2))
    assert m0.tolist() == [[1, 0], [0, 1]] and labels(clustering.assign(p, m0)) == [0, 0, 1, 1, 1]
    m1 = clustering.step(p, m0)
    assert np.allclose(m1, [[0.948683, 0.316228], [-0.216930, 0.976187]], atol=1e-6)
    m2 = clustering.step(p.repartition(4), m1)
    assert np.allclose(m2, [[0.863779, 0.503871], [-0.707107, 0.707107]], atol=1e-6)
    assert not clustering.converged(m1, m2, 0.05)
    done = clustering.kmeans(p, 2)
    assert done.steps == 3 and np.allclose(done.centroids, m2) and labels(clustering.assign(p, done.centroids)) == [0, 0, 1, 0, 1]
    assert clustering.kmeans(p, 2, max_iter=0).centroids.tolist() == m0.tolist()
    assert clustering.default_k(p) == 2
    assert labels(clustering.word_clusters(p)) == [0, 0, 1, 0, 1]


def test_ties_empty_clusters_and_bad_k(spark):
    p = points(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0])])
    same = np.array([[1.0, 0.0], [1.0, 0.0]])
    assert labels(clustering.assign(p, same)) == [0, 0]
    assert clustering.step(p, same).tolist() == [[1, 0], [0, 0]]
    for k in (0, 3):
        with pytest.raises(ValueError):
            clustering.step_sample(p, k)
    assert clustering.step_sample(p, 3, strict=False).count() == 3
    s = clustering.shift_stats(np.zeros((2, 2)), np.array([[3.0, 4.0], [0.0, 0.0]]))
    assert s["max"] == 5 and s["mean"] == 2.5 and round(s["stddev"], 6) == 3.535534


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([float("nan"), 2.0], [1.0, 5.0]), ([], [])], "a array<double>, b array<double>")
    got = df.select(vectors.dot(F.col("a"), F.col("b")), vectors.distance(F.col("a"), F.col("b")), vectors.arg_max(F.col("a")), vectors.unit(F.col("b"))).collect()
    assert tuple(got[0]) == (0.0, 5.0, 1, [0.0, 0.0]) and got[1][2] == 1 and tuple(got[2]) == (0.0, 0.0, 0, [])


def test_vectors_with_holes(spark):
    vec = lambda rows: spark.createDataFrame(rows, "i bigint, e bigint")
    places = lambda *i: spark.createDataFrame([(x,) for x in i], "i bigint")
    as_dict = lambda df: {r.i: r.e for r in df.collect()}
    v = dense.insert(vec([]), vec([(1, 1), (4, 4), (3, 3)]))
    assert tuple(dense.length(v).first()) == (3, 5)
    assert as_dict(dense.get(v, places(0, 1, 2))) == {0: None, 1: 1, 2: None}
    v = dense.update(v, places(0), lambda e: e + 1, 0)
    assert tuple(dense.length(v).first()) == (4, 5) and as_dict(v)[0] == 0
    assert as_dict(dense.update_all(v, lambda e: e + 1)) == {0: 1, 1: 2, 3: 4, 4: 5}
    assert as_dict(dense.insert(v, vec([(1, 9)])))[1] == 9 and 4 not in as_dict(dense.remove(v, places(4)))
    assert dense.sparse_dim(vec([(1, 1), (4, 1)])).first()[0] == 4 and dense.sparse_dim(vec([])).first()[0] == 0


def test_cosine(spark):
    nan = float("nan")
    rows = [([1.0, 0.0], [2.0, 0.0]), ([1.0, 1.0], [-1.0, -1.0]), ([0.0, 0.0], [1.0, 0.0]), ([nan, 1.0], [1.0, 1.0]), ([None, 1.0], [1.0, 1.0]), (None, [1.0, 1.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1 and round(got[1], 12) == -1 and got[2:] == [None] * 4


def test_blocks_of_centroids_and_unusable_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, m = rng.standard_normal((300, 4)), rng.standard_normal((37, 4))
    want = (x @ m.T).argmax(axis=1)
    monkeypatch.setattr(clustering, "BLOCK", 10)
    monkeypatch.setattr(clustering, "PRODUCTS", 50)
    assert (clustering._labels(x, m) == want).all()
    assert (clustering._labels(x, np.full((30, 4), np.nan)) == 0).all()
    p = points(spark, [(0, [3.0, 0.0]), (1, None), (2, [1.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0])])
    m0 = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert {r.row_id: r.cluster for r in clustering.assign(p, m0, unit=True).collect()} == {0: 0, 3: 1, 4: 0}
    assert clustering.step(p, m0, unit=True).tolist() == [[1, 0], [0, 1]]
    with pytest.raises(ValueError):
        clustering.assign(p, np.zeros((clustering.MAX_CENTROIDS // 2 + 1, 2)))
