from lexweave.plans import programs
from lexweave.plans.retrieval import queries_of
from lexweave.sources.word2vec import write_word2vec


def lines(spark, path):
    return sorted(r.value for r in spark.read.text(str(path)).collect())


def test_bool_program(spark, tmp_path):
    (tmp_path / "c.conll").write_text("1\tCats\tcat\tN\tNNS\t7\n2\tx\t_\tN\tNN\t7\n\n1\tdog\tdog\tN\tNN\t3\n2\tdog\tdog\tN\tNN\tabc\n\n1\tcat\tcat\tN\tNN\t3\n")
    programs.create_bool_index(spark, str(tmp_path / "c.conll"), str(tmp_path / "i"))
    assert lines(spark, tmp_path / "i") == ["cat\t3 7", "dog\t3"]
    (tmp_path / "t").write_text("7\tSeven\n")
    found, status = programs.query_bool_index(spark, str(tmp_path / "i"), queries_of(spark, [(1, "cat"), (2, "no")]), str(tmp_path / "t"))
    assert sorted(map(tuple, found.collect())) == [(1, 3, ""), (1, 7, "Seven")] and dict(map(tuple, status.collect())) == {1: "ok", 2: "no_match"}


def test_ranked_program(spark, tmp_path):
    (tmp_path / "i").write_text("cat\t0 2 1 1\ndog\t1 3 2 1\nthe\t0 1 1 1 2 1\n")
    (tmp_path / "t").write_text("0\tzero\n1\tone\n2\ttwo\n")
    best, idf = programs.query_tf_index(spark, str(tmp_path / "i"), str(tmp_path / "t"), queries_of(spark, [(1, "Cats dog")]), "porter", k=1)
    assert [(r.doc, r.title, round(r.sim, 6)) for r in best.collect()] == [(1, "one", 0.894427)]
    assert [(r.term, round(r.idf, 6)) for r in idf.orderBy("pos").collect()] == [("cat", 0.405465), ("dog", 0.405465)]


def test_word_program(spark, tmp_path):
    (tmp_path / "w").write_text("ab\nabba\nzebra\n")
    found, status = programs.query_words(spark, str(tmp_path / "w"), spark.createDataFrame([(1, "ab*"), (2, "*")], "query_id bigint, pattern string"))
    assert sorted(r.word for r in found.collect()) == ["ab", "abba"] and dict(map(tuple, status.collect())) == {1: "ok", 2: "refused"}


def test_feature_program(spark, tmp_path):
    for label, name, text in (("x", "1", "1\ta\ta\tN\tNN\n2\tthe\tthe\tD\tDT\n\n1\tb\tb\tN\tNN\n"), ("y", "2", "1\tb\tb\tN\tNN\n"), ("y", "3", "1\tthe\tthe\tD\tDT\n")):
        (tmp_path / "c" / label).mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / label / name).write_text(text)
    programs.write_features(spark, str(tmp_path / "c"), str(tmp_path / "o"), n1=1 << 20, n2=1 << 20, feature="binary")
    got = lines(spark, tmp_path / "o")
    assert len(got) == 2 and got[0].startswith("0 ") and len(got[0].split()) == 4 and got[1].startswith("1 ") and len(got[1].split()) == 2


def test_cluster_program(spark, tmp_path):
    write_word2vec([("a", [1.0, 0.0]), ("b", [2.0, 0.1]), ("c", [0.0, 1.0]), ("d", [0.1, 1.0])], str(tmp_path / "v"))
    programs.write_word_clusters(spark, str(tmp_path / "v"), str(tmp_path / "o"), verbose=False)
    assert lines(spark, tmp_path / "o") == ["a\t0", "b\t0", "c\t1", "d\t1"]
