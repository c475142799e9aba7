import pytest

from lexweave.operators import boolean, features
from lexweave.sources import readers, sinks, word2vec
from lexweave.streaming import query_stream

INDEX = "cat\t7 3  7\ndog\t3\nempty\t\nno tab\nbad\t1 x\ncat\t9 +8\r\nbig\t4294967296\n"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bool_index_files(spark, tmp_path):
    (tmp_path / "i.txt").write_bytes(INDEX.encode())
    path = str(tmp_path)
    index = readers.read_bool_index(spark, path)
    assert rows(index) == [("cat", [8, 9]), ("dog", [3]), ("empty", [])]
    assert sorted(r.value for r in readers.rejected(readers.read_lines(spark, path), "bool_index").collect()) == ["bad\t1 x", "big\t4294967296", "no tab"]
    with pytest.raises(Exception, match="bad line"):
        readers.read_bool_index(spark, path, "failfast").collect()
    with pytest.raises(ValueError):
        readers.read_bool_index(spark, path, "lenient")
    sinks.write_bool_index(index, str(tmp_path / "out"))
    assert rows(readers.read_bool_index(spark, str(tmp_path / "out"), "failfast")) == rows(index)


def test_tf_index_files(spark, tmp_path):
    (tmp_path / "i.txt").write_text("cat\t0 2 1\ndog\t1 3 2 1\nx\t\n")
    index = readers.read_tf_index(spark, str(tmp_path))
    assert [(t, [tuple(x) for x in p]) for t, p in rows(index)] == [("cat", [(0, 2)]), ("dog", [(1, 3), (2, 1)]), ("x", [])]
    sinks.write_tf_index(index, str(tmp_path / "out"))
    assert rows(readers.read_tf_index(spark, str(tmp_path / "out"))) == rows(index)
    (tmp_path / "i.txt").write_text("cat\t0 two\n")
    with pytest.raises(Exception, match="bad line"):
        readers.read_tf_index(spark, str(tmp_path / "i.txt")).collect()


def test_titles_and_words(spark, tmp_path):
    (tmp_path / "t.txt").write_text("7\tSeven\tB\n7\tlast\n3\t\nx\tno\n")
    assert rows(readers.read_titles(spark, str(tmp_path / "t.txt"))) == [(3, ""), (7, "last")]
    (tmp_path / "w.txt").write_bytes("añb\n ab \nañb\n".encode() + b"\xff\n")
    assert rows(readers.read_words(spark, str(tmp_path / "w.txt"))) == [(" ab ", " ba "), ("añb", "bña")]


def test_conllx(spark, tmp_path):
    (tmp_path / "lab el").mkdir()
    (tmp_path / "lab el" / "a.conll").write_bytes("1\tCats\tcat\tN\tNNS\t7\r\n2\tsleep\t_\r\n\r\n\r\n\r\n1\tx\tx\tN\tNN\t3\n".encode())
    got = readers.read_conllx(spark, str(tmp_path)).orderBy("sent_no", "tok_no").collect()
    assert [(r.label, r.sent_no, r.tok_no, r.form, r.lemma, r.pos, r.feats) for r in got] == [
        ("lab el", 0, 0, "Cats", "cat", "NNS", "7"),
        ("lab el", 0, 1, "sleep", None, None, None),
        ("lab el", 1, 0, "x", "x", "NN", "3"),
    ]
    (tmp_path / "lab el" / "a.conll").write_text("1\ta\n\n1\tb\n2\tc\n")
    assert rows(readers.read_conllx(spark, str(tmp_path), whole_files=False).select("tok_no", "form")) == [(0, "a"), (0, "b"), (1, "c")]


def test_word2vec(spark, tmp_path):
    data = [("wörd", [1.0, -2.5]), ("b", [0.0, 3.0]), ("c", [0.5, 0.25])]
    word2vec.write_word2vec(data, str(tmp_path / "v.bin"))
    assert rows(word2vec.read_word2vec(spark, str(tmp_path / "v.bin"))) == [(i, w, v) for i, (w, v) in enumerate(data)]
    (tmp_path / "v.bin").write_bytes(b"2 2\nx ")
    with pytest.raises(Exception, match="ends in row"):
        word2vec.read_word2vec(spark, str(tmp_path / "v.bin")).collect()


def test_libsvm_and_clusters(spark, tmp_path):
    f = spark.createDataFrame([(0, 1, 5, 0.5), (0, 1, 2, 0.25), (1, 0, 1, 1.0)], "doc bigint, label_id bigint, dim bigint, value double")
    sinks.write_libsvm(f, str(tmp_path / "svm"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "svm")).collect()) == ["0 1:1.0", "1 2:0.25 5:0.5"]
    assert sorted(r.line for r in features.libsvm_lines(f, 2).collect()) == ["0 1:1.00", "1 2:0.25 5:0.50"]
    sinks.write_clusters(spark.createDataFrame([("a b", 3)], "word string, cluster bigint"), str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["a b\t3"]


def test_query_stream(spark, tmp_path):
    postings = spark.createDataFrame([("cat", 1), ("cat", 2), ("dog", 2)], "term string, doc bigint")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.txt").write_text("cat dog\ncat\n\n")
    got = {}
    stream = query_stream.query_lines(spark, str(tmp_path / "in"))
    run = query_stream.answer(stream, lambda q: boolean.bool_and(postings, q), lambda df, i: got.update({i: [r.doc for r in df.collect()]}), str(tmp_path / "ck"))
    run.awaitTermination(60)
    assert sorted(x for v in got.values() for x in v) == [1, 2, 2]


def test_repeated_lines_are_queries_of_their_own(spark, tmp_path):
    postings = spark.createDataFrame([("cat", 1), ("cat", 2), ("dog", 2), ("dog", 2)], "term string, doc bigint")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.txt").write_text("cat dog\ncat dog\n\ndog")
    (tmp_path / "in" / "r.txt").write_text("cat dog\n")
    got = []
    stream = query_stream.query_lines(spark, str(tmp_path / "in"))
    run = query_stream.answer(stream, lambda q: boolean.bool_and(postings, q), lambda df, i: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "ck"))
    run.awaitTermination(60)
    assert [d for _, d in got] == [2] * 4 and len({q for q, _ in got}) == 4


def test_rows_of_one_query_id_are_one_query(spark):
    postings = spark.createDataFrame([("cat", 1), ("cat", 2), ("dog", 2)], "term string, doc bigint")
    q = spark.createDataFrame([(1, "cat"), (1, "cat dog"), (2, "cat"), (2, "cat")], "query_id bigint, query string")
    assert rows(boolean.bool_and(postings, q)) == [(1, 2), (2, 1), (2, 2)]
    assert rows(boolean.bool_status(postings, q)) == [(1, "ok"), (2, "ok")]


def test_word2vec_directories(spark, tmp_path):
    df = spark.createDataFrame([(f"w {i}", [float(i), -1.5]) for i in range(50)] + [(None, [0.0, 0.0]), ("x", None)], "word string, embedding array<float>").repartition(4)
    assert word2vec.save_word2vec(df, str(tmp_path / "v")) == 50
    got = word2vec.read_word2vec(spark, str(tmp_path / "v"))
    assert sorted((r.word, r.embedding) for r in got.collect()) == sorted((f"w_{i}", [float(i), -1.5]) for i in range(50))
    assert got.rdd.getNumPartitions() == 4 and got.select("row_id").distinct().count() == 50
    assert rows(word2vec.read_word2vec(spark, (tmp_path / "v").as_uri())) == rows(got)


def test_conllx_without_a_label(spark):
    files = spark.createDataFrame([("a.conll", "1\ta\ta"), ("/a.conll", "1\tb"), (None, "1\tc"), ("x/y%20z/a", None), ("x/y%20z/b", "1\td\n\n \n1\te")], "path string, value string")
    got = {(r.form, r.label, r.sent_no) for r in readers.parse_conllx(files).collect()}
    assert got == {("a", None, 0), ("b", None, 0), ("c", None, 0), ("d", "y z", 0), ("e", "y z", 1)}


def test_titles_set_apart_by_the_bound_of_the_parser(spark):
    lines = spark.createDataFrame([("4294967295\tlargest", 1), ("4294967296\tlarger", 2), ("+7\tlucky", 3), ("x\tno", 4), (None, 5)], "value string, at bigint")
    assert rows(readers.parse_titles(readers.accepted(lines, "titles"), "failfast")) == rows(readers.parse_titles(lines)) == [(7, "lucky"), (4294967295, "largest")]
    assert sorted(r.at for r in readers.rejected(lines, "titles").collect()) == [2, 4, 5]
    wide = readers.parse_titles(readers.accepted(lines, "titles", readers.MAX_LONG), "failfast", readers.MAX_LONG)
    assert rows(wide) == [(7, "lucky"), (4294967295, "largest"), (4294967296, "larger")]
