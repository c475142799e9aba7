import math
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lexweave.llm import burst_trie, residual_idf

T = datetime(2024, 1, 1)
RUNS = "index_id bigint, term bigint, inv_idx array<struct<doc:bigint,tf:bigint>>, doc_count bigint, built_at timestamp, loaded_at timestamp, norm double"


def runs(spark, rows):
    return spark.createDataFrame([(i, t, p, n, T + timedelta(hours=b), T + timedelta(hours=b), 9.9) for i, t, p, n, b in rows], RUNS)


def test_weights_by_hand(spark):
    rows = [
        (1, 10, [(0, 5), (1, 1)], 4, 0),
        (1, 10, [(0, 9), (1, 9), (2, 9)], 40, -5),  # an earlier build, whose doc_count is the run's largest
        (1, 11, [(0, 1), (0, 2), (3, 0), (None, 4), (3, None), (2, -1)], None, 0),
        (1, 12, [(0, 1), (1, 1), (2, 1), (3, 1)], 4, 0),
        (1, 13, [], 4, 0),
        (1, 14, None, 4, 0),
        (2, 10, [(0, 1)], None, 0),
        (None, 10, [(0, 1)], 5, 0),
        (1, None, [(0, 1)], 5, 0),
    ]
    got = {(r.index_id, r.doc, r.term): r for r in residual_idf.weights(runs(spark, rows + rows[:1])).collect()}
    assert set(got) == {(1, 0, 10), (1, 1, 10), (1, 0, 11), *((1, d, 12) for d in range(4)), (2, 0, 10)}
    a, b, c = got[1, 0, 10], got[1, 0, 11], got[1, 0, 12]
    assert (b.tf, b.df, b.cf) == (2, 1, 2) and a.n_docs == 40
    assert math.isclose(a.weight, 5 * math.log(20)) and math.isclose(b.weight, 2 * math.log(40)) and math.isclose(c.weight, math.log(10))
    assert math.isclose(a.norm, math.hypot(a.weight, b.weight, c.weight)) and math.isclose(a.share, a.weight / a.norm)
    assert math.isclose(a.residual, math.log(20) + math.log(1 - math.exp(-6 / 40))) and math.isclose(a.score, 5 * a.residual)
    assert got[2, 0, 10].weight is None and got[2, 0, 10].share is None
    assert {(r.index_id, r.doc, r.term) for r in residual_idf.dominant_terms(runs(spark, rows)).collect()} == {k for k, r in got.items() if (r.share or 0) >= 0.8}


def test_a_burst_of_a_term_has_a_larger_residual_than_a_spread(spark):
    rows = [(1, 1, [(0, 10)], 1000, 0), (1, 2, [(d, 1) for d in range(10)], 1000, 0), (1, 3, [(d, 1) for d in range(50)], 1000, 0)]
    score = {r.term: r.residual for r in residual_idf.weights(runs(spark, rows)).collect()}
    assert score[1] > 2 and abs(score[2]) < 0.1 and abs(score[3]) < 0.1


def test_distinctive_terms(spark):
    spread = [(1, 2, [(d, 1) for d in range(10)], 1000, 0)]
    rows = [(1, 1, [(0, 10)], 1000, 0), *spread, (2, 1, [(0, 1)], None, 0), (3, 1, [(0, 1)], 1, 0)]
    got = {(r.index_id, r.doc, r.term): r.part for r in residual_idf.distinctive_terms(runs(spark, rows)).collect()}
    assert (1, 0, 1) in got and (1, 0, 2) not in got and not [k for k in got if k[0] == 2] and residual_idf.distinctive_terms(runs(spark, [])).count() == 0


def test_norm_status(spark):
    index = runs(spark, [(1, 1, [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1)], 10, 0)])
    right = math.log(2)
    norms = spark.createDataFrame([(1, 0, right, T), (1, 0, 5.0, T - timedelta(days=1)), (1, 1, float("nan"), T), (1, 2, None, T), (1, 3, 0.0, T), (9, 9, 1.0, T)], "index_id bigint, doc bigint, doc_norms double, computed_at timestamp")
    assert {r.doc: r.status for r in residual_idf.document_norms(index, norms).collect()} == {0: "ok", 1: "wrong", 2: "missing", 3: "wrong", 4: "missing"}


def test_long_list_is_linear(spark):
    n = 30_000
    rows = [(1, 1, [(d % (n - 5), 1 + d // (n - 5)) for d in range(n)], n, 0)]
    w = residual_idf.postings(runs(spark, rows))
    assert w.count() == n - 5 and {r.tf for r in w.filter("doc < 5").collect()} == {2}


def test_empty_runs(spark):
    assert residual_idf.weights(runs(spark, [])).count() == 0


WORDS = st.lists(st.tuples(st.text("abß\U0001f600", max_size=6), st.sets(st.integers(0, 9), max_size=4)), max_size=60)


@settings(max_examples=60, deadline=None)
@given(WORDS, WORDS, st.integers(1, 8))
def test_tries_count_and_merge(one, two, limit):
    tries = []
    for rows in (one, two):
        t = burst_trie.BurstTrie(limit)
        for term, docs in rows:
            t.merge([term], np.array([len(term)]), np.array([len(docs)]), np.array(sorted(docs), np.uint32))
        tries.append(t)
    for pack in tries[1].packs(terms=3, docs=5):
        assert pack[0] == sorted(pack[0]) and pack[2].sum() == len(pack[3])
        tries[0].merge(*pack)
    n = tries[0].documents()
    got = {t: (int(tries[0].occurrences[s]), int(n[s])) for t, s in tries[0].walk()}
    docs, occ = defaultdict(set), defaultdict(int)
    for term, d in one + two:
        docs[term] |= d
        occ[term] += len(term)
    assert got == {t: (occ[t], len(docs[t])) for t in docs} and [t for t, _ in tries[0].walk()] == sorted(docs)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("ab", max_size=6)), st.text("abc", max_size=9))
def test_route_is_the_longest_prefix_and_one_more(burst, term):
    route, own = burst_trie.Routes(frozenset(burst | {""})).of(term)
    longest = max((p for p in burst | {""} if term.startswith(p)), key=len)
    assert own == (longest == term) and route == term[: len(longest) + 1]


def test_long_shared_prefixes():
    trie = burst_trie.BurstTrie(limit=2)
    terms = ["x" * 3000 + str(i) for i in range(20)]
    for t in terms:
        trie.slot(t)
    assert [m for m, _ in trie.walk()] == sorted(terms)


INDEX = "line_id bigint, shard string, term string, idxs array<bigint>, written_at timestamp, documents string"


def test_frequencies_against_counting(spark):
    rows = [(i, "s", ["alpha", "alp", "Alpha", "é", "é", "b"][i % 6] if i % 2 else "the", [i % 7, i, i, -1, 2**32, None], T, "x") for i in range(400)]
    rows += rows[:50] + [(900, "s", None, [9000], T, "x"), (901, "s", "", [9001], T, "x"), (902, "s", "void", None, T, "x"), (903, "s", "void", [], T, "x"), (None, "s", "n", [1], T, "x"), (None, "s", "n", [1], T, "x"), (None, "t", "n", [1], T, "x")]
    once, occ, docs, every = {}, defaultdict(int), defaultdict(set), set()
    for i, s, t, x, *_ in rows:
        ok = [v for v in x or [] if v is not None and 0 <= v < 2**32]
        every.update(ok)
        if t:
            once[(i, t) if i is not None else (s, t, str(x))] = (t, len(ok))
            docs[t].update(ok)
    for t, n in once.values():
        occ[t] += n
    df = spark.createDataFrame(rows, INDEX).repartition(6)
    for options in ({}, {"routes": 4, "block_bits": 4, "flush": 50, "hold": 20}, {"routes": 100, "block_bits": 2, "flush": 20, "hold": 5, "heavy_route": 1}):
        got = {r.term: r for r in burst_trie.term_frequencies(df, **options).collect()}
        assert {t: (r.occurrences, r.documents) for t, r in got.items()} == {t: (occ[t], len(docs[t])) for t in docs}
        assert all(r.rare == (len(docs[t]) < 3) and r.common == (0 < len(docs[t]) >= len(every) / 4) for t, r in got.items())
    assert burst_trie.term_frequencies(df.limit(0)).count() == 0


def test_a_line_of_a_third_of_the_rows(spark):
    rows = [(1, "s", "hot", [1, 2, 2, None], T, "x")] * 3000 + [(None, "s", "hot", [7], T, "x")] * 3000 + [(10 + i, "s", f"t{i % 50}", [i], T, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, INDEX).repartition(7)
    got = {r.term: (r.occurrences, r.documents) for r in burst_trie.term_frequencies(df).collect()}
    assert got == {"hot": (4, 3), **{f"t{i}": (60, 60) for i in range(50)}}
    plan = df.select("term", F.xxhash64("idxs").alias("k")).dropDuplicates(["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Aggregate") >= 2  # copies are merged before the shuffle too


def test_long_hot_terms_and_a_common_prefix(spark):
    url = "https://an.example/common/prefix/"
    hot = {n: chr(97 + n % 26) * n for n in (20, 40, 200, 5000)}
    rows = [(i, "s", hot[(20, 40, 200, 5000)[i % 4]], [i, i + 1], T, "x") for i in range(400)]
    rows += [(1000 + i, "s", f"{url}{i % 60}", [i], T, "x") for i in range(600)]
    df = spark.createDataFrame(rows, INDEX).repartition(5)
    packs = spark.createDataFrame([([t], b"", [100], b"") for t in hot.values()] + [([f"{url}{i}" for i in range(60)], b"", [10] * 60, b"")], burst_trie.PACKS)
    burst, _ = burst_trie.skeleton(packs, routes=64)
    assert set(hot.values()) <= burst and url in burst and url + "1" in burst and url + "11" not in burst
    routes = burst_trie.Routes(burst)
    assert all(routes.of(t) == (t, True) for t in hot.values()) and routes.of(url + "17") == (url + "17", False)
    got = {r.term: (r.occurrences, r.documents) for r in burst_trie.term_frequencies(df, routes=64, block_bits=4).collect()}
    want = defaultdict(list)
    for _, _, t, x, *_ in rows:
        want[t] += x
    assert got == {t: (len(x), len(set(x))) for t, x in want.items()}
