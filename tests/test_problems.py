from collections import Counter, defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from lexweave.operators import bad_rows, hot_keys

T = datetime(2024, 1, 1)
INDEX = "line_id bigint, shard string, term string, idxs array<bigint>, written_at timestamp, loaded_at timestamp, extra string"


def index(spark, rows):
    return spark.createDataFrame([(i, "s", t, x, T, T, "e") for i, t, x in rows], INDEX)


def hot_rows():
    rows = [(i, "hot" if i % 3 else f"t{i}", [i % 50, i % 50, -1, 4294967296, None]) for i in range(600)]
    rows += [(0, "t0", [0, 0, -1, 4294967296, None]), (700, None, [1, 2]), (701, "", [3]), (702, "none", None), (703, "none", []), (704, "big", list(range(60_000))), (None, "x", [5]), (None, "x", [5]), (None, "x", [6])]
    return rows


def test_hot_terms_against_counting(spark):
    rows = hot_rows()
    once = {}
    for i, t, x in rows:
        once[(i, t) if i is not None else (t, str(x))] = (t, [v for v in x or [] if v is not None and 0 <= v <= 4294967295])
    n, e = Counter(t for t, _ in once.values()), Counter()
    for t, x in once.values():
        e[t] += len(x)
    want = {(t, "rows") for t in n if t and n[t] * 50 >= sum(n.values())} | {(t, "entries") for t in e if t and e[t] and e[t] * 50 >= sum(e.values())}
    df = index(spark, rows).repartition(5)
    for fan_in in (2, 8):
        assert {(r.term, r.kind) for r in hot_keys.hot_terms(df, fan_in=fan_in).collect()} == want
    assert {r.term: (r.n_rows, r.n_entries) for r in hot_keys.term_loads(df).collect()} == {t: (n[t], e[t]) for t in n}
    docs = defaultdict(set)
    for _, t, x in rows:
        if t:
            docs[t] |= {v for v in x or [] if v is not None and 0 <= v <= 4294967295}
    got = defaultdict(list)
    for r in hot_keys.term_documents(df, block_bits=10).orderBy("block").collect():
        assert len(r.docs) <= 1024 and r.docs == sorted(r.docs)
        got[r.term] += r.docs
    assert {t: sorted(v) for t, v in docs.items()} == got


def test_hot_terms_of_nothing(spark):
    assert hot_keys.hot_terms(index(spark, [])).count() == 0 and hot_keys.term_documents(index(spark, [])).count() == 0


def test_tree_merges_in_rounds(spark):
    df = spark.range(0, 1000, 1, 16).select((F.col("id") % 3).alias("k"), "id")
    tree = hot_keys.tree_aggregate(df, ["k"], {"s": F.sum("id")}, {"s": F.sum}, fan_in=2, chunks=16)
    assert {r.k: r.s for r in tree.collect()} == {k: sum(range(k, 1000, 3)) for k in range(3)}
    assert tree._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") >= 4


def test_rounds_follow_the_tasks_of_the_input(spark):
    df = spark.range(0, 4000, 1, 70).select((F.col("id") % 3).alias("k"), "id")  # far more tasks than the shuffle is wide
    tree = hot_keys.tree_aggregate(df, ["k"], {"s": F.sum("id")}, {"s": F.sum})
    assert {r.k: r.s for r in tree.collect()} == {k: sum(range(k, 4000, 3)) for k in range(3)}
    assert tree._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning(k") == 4  # 70 -> 18 -> 5 -> 2 -> 1
    # no reducer meets more than fan_in states of a key
    slots = df.select(F.spark_partition_id().alias("p")).distinct().groupBy(F.floor(F.col("p") / 4)).count()
    assert slots.agg(F.max("count")).first()[0] == 4 and slots.count() == 18


def test_no_exchange_of_lists_by_term_alone(spark):
    docs = hot_keys.term_documents(index(spark, hot_rows()))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and all("docs" not in x or "block" in x for x in plan.split("\n") if "Exchange" in x)


LINES = {
    ("index", "a\t1 2"): None, ("index", "a\t"): None, ("index", "a\t +7  "): None, ("index", '"q\t1'): None, ("index", "a\t4294967295"): None, ("index", "a\t000000000000001"): None,
    ("index", None): "columns", ("index", "a"): "columns", ("index", ""): "columns", ("index", "a\t1\t"): "columns", ("index", "\t1\t2"): "columns",
    ("index", "\t1"): "value", ("index", "a\t1 x"): "value", ("index", "a\t-1"): "value", ("index", "a\t4294967296"): "value", ("index", "a\t1 2"): "value", ("index", "a\t1\n"): "value", ("index", "a\t++1"): "value", ("index", "a\t+"): "value", ("index", "a\t５"): "value", ("index", "a\t99999999999999999999999"): "value",
    ("titles", "1\tx"): None, ("titles", "1\t"): None, ("titles", '1\t""'): None, ("titles", '1\t"a\tb"'): None, ("titles", '1\ta "b" c'): None, ("titles", '1\t"a ""b"""'): None, ("titles", '+1\t"x"'): None,
    ("titles", "1\ta\tb"): "columns", ("titles", '1\t"a"\tb'): "columns", ("titles", "1"): "columns",
    ("titles", '1\t"a'): "quoting", ("titles", '1\t"a""'): "quoting", ("titles", '1\t"a"b'): "quoting", ("titles", '1\t"'): "quoting", ("titles", '1\t""a""'): "quoting",
    ("titles", "x\ta"): "value", ("titles", "\ta"): "value", ("titles", " 1\ta"): "value", ("titles", "1e3\ta"): "value",
    ("other", "1\ta"): "columns", (None, "1\ta"): "columns",
}


def test_bad_lines(spark):
    rows = [(i, f, x, T) for i, (f, x) in enumerate(LINES)]
    df = spark.createDataFrame(rows + rows[:9] + [(None, "index", "bad", T), (None, "index", "a\t1", T)], "line_id bigint, file string, line string, loaded_at timestamp")
    got = [tuple(r) for r in bad_rows.bad_lines(df).collect()]
    assert sorted(x for x in got if x[0] is not None) == [(i, r) for i, r in enumerate(LINES.values()) if r]
    assert [x for x in got if x[0] is None] == [(None, "columns")]
    ok = bad_rows.loaded_lines(df).collect()
    assert len(ok) == sum(r is None for r in LINES.values()) + 1
    by = {r.line_id: r for r in ok if r.line_id is not None}
    place = {k: i for i, k in enumerate(LINES)}
    assert by[place["index", "a\t +7  "]].ids == [7] and by[place["index", "a\t"]].ids == []
    assert by[place["titles", '1\t"a ""b"""']].title == 'a "b"' and by[place["titles", '1\t"a\tb"']].title == "a\tb" and by[place["titles", '1\t""']].title == ""


def test_very_long_lines(spark):
    long = "1\t" + '"' + "x" * 2_000_000 + '""' * 1000 + '"'
    df = spark.createDataFrame([(1, "titles", long, T), (2, "index", "a\t" + "7 " * 200_000, T)], "line_id bigint, file string, line string, loaded_at timestamp")
    assert bad_rows.bad_lines(df).count() == 0
