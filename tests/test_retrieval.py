from lexweave.operators import boolean, index, ranking
from lexweave.plans.retrieval import queries_of
from lexweave.runtime import Pinned

CONLL = [("cat", "7"), ("sleep", "7"), (None, "7"), ("cat", "7"), ("dog", "3"), ("dog", "abc"), ("dog", "-1"), ("dog", "4294967296"), ("cat", "3"), ("dog", None)]


def rows(df):
    return [tuple(r) for r in df.collect()]


def bool_index(spark):
    return index.build_bool_index(index.conllx_lemmas(spark.createDataFrame(CONLL, "lemma string, feats string")))


def test_bool_index(spark):
    assert sorted(rows(bool_index(spark))) == [("cat", [3, 7]), ("dog", [3]), ("sleep", [7])]


def test_bool_and(spark):
    q = queries_of(spark, [(1, "cat"), (2, "cat dog"), (3, "dog cat cat"), (4, "dog sleep"), (5, "cat zzz"), (6, " \t"), (7, "Cat"), (8, None)])
    titles = spark.createDataFrame([(7, "Seven\tB")], "doc bigint, title string")
    got = rows(boolean.bool_and(bool_index(spark), q, titles))
    assert sorted(got) == [(1, 3, ""), (1, 7, "Seven\tB"), (2, 3, ""), (3, 3, "")]
    status = dict(rows(boolean.bool_status(bool_index(spark), q)))
    assert status == {1: "ok", 2: "ok", 3: "ok", 4: "ok", 5: "no_match", 6: "empty", 7: "no_match", 8: "empty"}


def tf_index(spark, titles=(0, 1, 2), extra=()):
    data = [("cat", [(0, 2), (1, 1)]), ("dog", [(1, 3), (2, 1)]), ("the", [(0, 1), (1, 1), (2, 1)]), *extra]
    postings = spark.createDataFrame(data, "term string, postings array<struct<doc:bigint,tf:bigint>>")
    return index.index_of_rows(postings, spark.createDataFrame([(t, f"t{t}") for t in titles], "doc bigint, title string"))


def test_norms(spark):
    want = {"identity": [0.810930, 1.282193, 0.405465], "binary": [0.405465, 0.573414, 0.405465], "sublinear": [0.686512, 0.942580, 0.405465]}
    for tf, w in want.items():
        got = dict(rows(tf_index(spark).norms(tf)))
        assert [round(got[i], 6) for i in range(3)] == w


def test_rank(spark):
    q = queries_of(spark, [(1, "cat dog"), (2, "cat"), (3, "Cat cat dog"), (4, "cat zzz"), (5, "the"), (6, "zzz")])
    want = {
        "identity": {1: [(1, 0.894427), (2, 0.707107), (0, 0.707107)], 2: [(0, 1.0), (1, 0.316228)], 3: [(0, 0.894427), (1, 0.707107), (2, 0.447214)]},
        "binary": {1: [(1, 1.0), (2, 0.707107), (0, 0.707107)], 2: [(0, 1.0), (1, 0.707107)], 3: [(1, 1.0), (2, 0.707107), (0, 0.707107)]},
        "sublinear": {1: [(1, 0.942514), (2, 0.707107), (0, 0.707107)], 2: [(0, 1.0), (1, 0.430165)], 3: [(0, 0.861037), (1, 0.829475), (2, 0.508542)]},
    }
    for tf, by in want.items():
        got = {}
        for i, _, d, s in sorted(rows(ranking.rank(tf_index(spark), q, tf, digits=6))):
            got.setdefault(i, []).append((d, s))
        assert got == by | {4: by[2], 5: [(2, 0.0), (1, 0.0), (0, 0.0)]}


def test_two_document_counts(spark):
    q = queries_of(spark, [(1, "cat dog")])
    for titles, want in (((0, 1), [(1, 2.828427), (0, 1.414214), (2, 0.707107)]), ((0, 1, 2, 3), [(1, 0.518757), (0, 0.405002), (2, 0.382034)]), ((), [(2, 0.0), (1, 0.0), (0, 0.0)])):
        got = rows(ranking.rank(tf_index(spark, titles), q, digits=6).orderBy("rank"))
        assert [(d, s) for _, _, d, s in got] == want


def test_term_without_documents(spark):
    q = queries_of(spark, [(1, "cat hollow"), (2, "hollow")])
    built = tf_index(spark, extra=[("hollow", [])])
    assert [(r[0], r[2], r[3]) for r in rows(ranking.rank(built, q).orderBy("rank"))] == [(1, 1, 0.0), (1, 0, 0.0)]
    assert {r[2]: r[3] for r in rows(ranking.query_idf(built, q))}["hollow"] == float("inf")


def test_row_order_does_not_matter(spark):
    t = spark.createDataFrame([(d, w) for d in range(30) for w in "abc"[: d % 3 + 1]], "doc bigint, term string")
    q = queries_of(spark, [(1, "b c")])
    runs = {tuple(map(tuple, rows(ranking.rank(index.build_tf_index(x), q, digits=6).orderBy("rank")))) for x in (t, t.repartition(7), t.orderBy("term"))}
    assert len(runs) == 1


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc bigint, term string")
    q = queries_of(spark, [(1, "a")])
    assert rows(ranking.rank(index.build_tf_index(none), q)) == [] and rows(boolean.bool_and(none, q)) == []


def test_stored_index(spark, tmp_path):
    built = tf_index(spark, (0, 1), extra=[("void", [])])
    index.save_tf_index(built, str(tmp_path / "i"), ("identity", "sublinear"), shards=4)
    stored = index.load_tf_index(spark, str(tmp_path / "i"))
    q = queries_of(spark, [(1, "cat dog"), (2, "the"), (3, "zzz"), (4, "void cat")])
    for tf in ("identity", "binary", "sublinear"):
        assert sorted(rows(ranking.rank(stored, q, tf, digits=6))) == sorted(rows(ranking.rank(built, q, tf, digits=6)))
    assert sorted(rows(ranking.query_idf(stored, q))) == sorted(rows(ranking.query_idf(built, q)))
    postings, _ = stored.of(Pinned(spark.createDataFrame([("cat",)], "term string"), True))
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan.replace("\n", " ") or "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_places_in_order(spark):
    found = spark.createDataFrame([(1, 9), (1, 3), (2, 5)], "query_id bigint, doc bigint")
    assert sorted(rows(boolean.in_order(found).select("query_id", "pos", "doc"))) == [(1, 1, 3), (1, 2, 9), (2, 1, 5)]


def test_large_sides_are_salted(spark):
    from lexweave.runtime import lookup_join

    big = spark.createDataFrame([(i % 3, i) for i in range(200)] + [(None, 1), (7, 7)], "k int, v int").repartition(5)
    small = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(rows(lookup_join(big, small, ["k"], how, rows=1, salts=4)), key=str) == sorted(rows(big.join(small, ["k"], how)), key=str)
