import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import leakage
from lexweave.llm.fm_index import FMIndex, suffix_array

WORDS = "Suppose that the Éphra index counts thirty two postings of café and none for the older mirror today".split()
ITEM = " ".join(WORDS)
ZH = "如果沅琉汀出现在三百篇文档里而檀珞榆只出现一次那么琉汀棠的新闻组应当改写"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=5), max_size=6))
def test_fm_index_finds_what_is_there(text, patterns):
    x = np.array(text)
    assert suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: text[i:])
    index = FMIndex(x, 4)
    lo, hi = index.ranges([np.array(p) for p in patterns])
    for p, a, b in zip(patterns, lo, hi):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]
        assert sorted(index.positions(np.arange(a, b)).tolist()) == want


def test_suffix_array_of_repeats():
    x = np.array([1, 2] * 3000 + [1])
    assert suffix_array(x)[:3].tolist() == [6000, 5998, 5996]


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "e") for i, t in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string, lang string")
    return sorted(tuple(r) for r in leakage.find_leaks(d, i, **options).collect())


def test_leaks(spark):
    twelve = " ".join(WORDS[3:15])
    docs = [
        (1, "x. " + ITEM + " y"),
        (2, " ".join(WORDS[:11])),
        (3, twelve),
        (4, ("SUPPOSE   that,\n> the éphra (index) counts: thirty​ two *postings* of café and none; for the older!")),
        (5, "Suppose that the wrong " + " ".join(WORDS[3:11])),
        (6, None),
        (7, ""),
        (8, ZH[2:26]),
        (9, ZH[2:25]),
        (10, "，".join(ZH)),
        (11, "z " * 100_000 + ITEM),
        (None, ITEM),
        (1, "the same id, " + ITEM),
    ]
    items = [(100, ITEM, "en"), (101, ZH, "zh"), (102, None, "en"), (103, "too short", "en"), (None, ITEM, "en"), (104, "? ! ? ! ? ! ? ! ? ! ? !", "en")]
    want = {(1, 100), (3, 100), (4, 100), (8, 101), (10, 101), (11, 100)}
    for options in ({}, {"shard": 10, "slice_size": 2}, {"broadcast_chars": 400}):
        got = found(spark, docs, items, **options)
        assert {r[:2] for r in got} == want
        text = dict(docs[:-1])
        for i, item, a, b in got:
            if i != 1:
                assert leakage.reduce(text[i][a:b]) in leakage.reduce(ITEM if item == 100 else ZH)
        assert [r for r in got if r[0] == 3] == [(3, 100, 0, len(twelve))]
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_a_passage_of_two_items_is_searched_once(spark):
    items = spark.createDataFrame([(1, ITEM, "en"), (2, "Well: " + ITEM, "en"), (3, None, None), (1, ITEM, "en")], "item_id bigint, text string, lang string")
    rows = leakage.passage_table(items).collect()
    assert len(rows) == len(WORDS) - 11 + 1 and sorted(len(r["items"]) for r in rows) == [1] + [2] * (len(WORDS) - 11)
    spans = [found(spark, [(1, "x " + ITEM)], [(1, ITEM, "en"), (2, "Well: " + ITEM, "en")], **o) for o in ({}, {"broadcast_chars": 100})]
    assert spans[0] == spans[1] == [(1, 1, 2, 2 + len(ITEM)), (1, 2, 2, 2 + len(ITEM))]


def test_reduce():
    assert leakage.reduce("Ａ１ ｶﾞ ½ ﬁ Straße") == leakage.reduce("a1ガ12FISTRASSE")
    assert leakage.reduce("e\u200b\u0301\ufe0f\u034f") == leakage.reduce("É")


def test_against_plain_search(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/eval_items.parquet").select("item_id", "text", "lang").collect()]
    plain = [(i, leakage.reduce(t)) for i, t in docs if t]
    want = {(d, i) for i, t, lang in items for p in leakage.passages(t, lang) for d, x in plain if p in x}
    assert want and {r[:2] for r in found(spark, docs, items)} == want
