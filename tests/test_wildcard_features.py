import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexweave.functions.stemming import porter, porter2
from lexweave.operators import features, wildcard
from lexweave.plans import features as plans

WORDS = ["ab", "aba", "abab", "abba", "zebra", "zebras", "a%b", "über", "ab", None]
WANT = {"ab*": ["ab", "aba", "abab", "abba"], "*ba": ["aba", "abba"], "ab*ba": ["abba"], "a*b": ["a%b", "ab", "abab"], "zebra*": ["zebra", "zebras"], "zebras*": ["zebras"], "a%*": ["a%b"], "ü*": ["über"], "x*": []}


def words(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "word string")


def test_wildcards(spark):
    pats = [*WANT, "zebra", "a*b*", "*", "", None]
    p = spark.createDataFrame(list(enumerate(pats)), "query_id bigint, pattern string")
    got = {}
    for i, w in wildcard.wildcard(words(spark), p).collect():
        got.setdefault(pats[i], []).append(w)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in WANT.items() if v}
    status = {pats[r[0]]: r[1] for r in wildcard.wildcard_status(p).collect()}
    assert [status[x] for x in ("ab*", "zebra", "a*b*", "*", "", None)] == ["ok", "unsupported", "unsupported", "refused", "empty", "empty"]
    for k, v in WANT.items():
        assert sorted(r[0] for r in wildcard.lookup(words(spark), k).collect()) == v
    for bad in ("zebra", "*", "a*b*"):
        with pytest.raises(ValueError):
            wildcard.lookup(words(spark), bad)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abé%_\\", max_size=5), max_size=12), st.lists(st.tuples(st.text("abé%_", max_size=3), st.text("abé%_", max_size=3)), min_size=1, max_size=4))
def test_wildcards_like_regex(spark, some, parts):
    pats = [f"{a}*{b}" for a, b in parts if a or b] or ["a*"]
    w = spark.createDataFrame([(x,) for x in some], "word string")
    p = spark.createDataFrame(list(enumerate(pats)), "query_id bigint, pattern string")
    want = {(i, x) for i, q in enumerate(pats) for x in some if re.fullmatch(".*".join(map(re.escape, q.split("*"))), x, re.S)}
    assert {tuple(r) for r in wildcard.wildcard(w, p).collect()} == want


def test_recognize(spark):
    got = wildcard.recognize(words(spark), spark.createDataFrame([("ab",), ("AB",), ("",), (None,)], "word string"))
    assert {r[0]: r[1] for r in got.collect()} == {"ab": True, "AB": False, "": False, None: False}


DOCS = {0: "aba", 1: "bc", 2: "ccd"}


def term_ids(spark, docs=DOCS):
    return spark.createDataFrame([(d, ord(c)) for d, t in docs.items() for c in t], "doc bigint, term_id bigint")


def labels(spark):
    return spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, "z"), (4, None)], "doc bigint, label string")


def test_features(spark):
    want = {
        "binary": {0: {1: 0.707107, 2: 0.707107}, 1: {2: 0.707107, 3: 0.707107}, 2: {3: 0.707107, 4: 0.707107}},
        "tfidf": {0: {1: 0.983396, 2: 0.181471}, 1: {2: 0.707107, 3: 0.707107}, 2: {3: 0.593876, 4: 0.804557}},
        "btfidf": {0: {1: 0.938145, 2: 0.346242}, 1: {2: 0.707107, 3: 0.707107}, 2: {3: 0.346242, 4: 0.938145}},
        "stfidf": {0: {1: 0.977057, 2: 0.212978}, 1: {2: 0.707107, 3: 0.707107}, 2: {3: 0.529932, 4: 0.848040}},
    }
    for kind, by in want.items():
        got = {}
        for r in features.doc_features(term_ids(spark), labels(spark), kind).collect():
            got.setdefault(r.doc, {})[r.dim] = round(r.value, 6)
            assert r.label_id == {0: 0, 1: 1, 2: 0}[r.doc]
        assert got == by
        cut = {}
        for r in features.doc_features(term_ids(spark), labels(spark), kind, min_df=2).collect():
            cut.setdefault(r.doc, {})[r.dim] = round(r.value, 6)
        assert cut == {0: {1: 1.0}, 1: {1: 0.707107, 2: 0.707107}, 2: {2: 1.0}}


def test_feature_row_of_zeros(spark):
    same = features.doc_features(term_ids(spark, {0: "a", 1: "a"}), labels(spark), "tfidf")
    assert [r.value for r in same.collect()] == [0.0, 0.0]


def test_ngrams(spark):
    t = spark.createDataFrame([(0, 0, "a"), (0, 5, "b"), (0, 7, "a"), (1, 0, "x")], "doc bigint, tok_no int, form string")
    assert [r.gram for r in features.ngrams(t, 2).orderBy("tok_no").collect()] == ["a b", "b a"]
    assert [r.gram for r in features.ngrams(t, 3).collect()] == ["a b a"]
    ids = [r.term_id for r in features.hashed_ngrams(t, 10, 100, 1000).collect()]
    assert len(ids) == 7 and sum(i < 10 for i in ids) == 4 and sum(10 <= i < 110 for i in ids) == 2 and sum(110 <= i < 1110 for i in ids) == 1
    assert features.hashed_ngrams(t, 10).count() == 4
    with pytest.raises(ValueError):
        features.hashed_ngrams(t, 0, 0, 0)


def test_stopwords(spark):
    kept = [("NNS", "cat"), ("CD", "3"), ("FW", "x"), ("JJR", "bigger"), ("NP", "Rome"), ("RB", "very"), ("VBZ", "run"), ("VBZ", "Be")]
    out = [("DT", "the"), ("IN", "of"), ("CDX", "x"), ("VBZ", "be"), ("VBD", "have"), (None, "a"), ("NN", None)]
    t = spark.createDataFrame([("f", *x) for x in kept + out] + [(None, "NN", "cat")], "form string, pos string, lemma string")
    assert sorted((r.pos, r.lemma) for r in features.content_tokens(t).collect()) == sorted(kept)


def test_numbers_without_one_task(spark):
    ids = spark.range(1000).selectExpr("id * 37 % 1009 as term_id").unionAll(spark.createDataFrame([(None,)], "term_id bigint"))
    got = sorted((r.term_id, r.dim) for r in features.number_ids(ids, "term_id", 8).collect())
    assert [d for _, d in got] == list(range(1, 1001)) and [t for t, _ in got] == sorted(t for t, _ in got)


PORTER = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc hesitanci:hesit digitizer:digit conformabli:conform radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll"
PORTER2 = "consign:consign consigned:consign consigning:consign consignment:consign consist:consist consistency:consist consistent:consist consistently:consist consisting:consist consolation:consol consolatory:consolatori consolidate:consolid consolidating:consolid console:consol constant:constant constitution:constitut constitutional:constitut knack:knack knackeries:knackeri knavish:knavish kneaded:knead kneeling:kneel knew:knew knightly:knight knitting:knit knots:knot knotted:knot skies:sky dying:die generously:generous news:news proceed:proceed exceeding:exceed by:by say:say cry:cri gas:gas this:this gaps:gap kiwis:kiwi hoped:hope hopping:hop"


@pytest.mark.parametrize("rule, pairs", [(porter, PORTER), (porter2, PORTER2)])
def test_stemmers(rule, pairs):
    wrong = {w: (rule(w), s) for w, s in (x.split(":") for x in pairs.split()) if rule(w) != s}
    assert not wrong


def test_stems_of_all_forms(spark, tmp_path):
    spark.createDataFrame([(1, "X-rays cafés 2nd connected,"), (2, "hopping 東京 2nd don't")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same = {w: w for w in ("2nd", "connected,", "東京", "don't")} | {"cafés": "café", "hopping": "hop"}
    for name, more in (("stem_porter", {"x-rays": "x-rai"}), ("stem_snowball", {"x-rays": "x-ray"})):
        got = [(r.form, r.stem) for r in plans.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted((same | more).items())


def test_verbs_of_the_dictionary(spark):
    w = lambda *x: spark.createDataFrame([(i,) for i in x], "word string")
    assert sorted(r.word for r in wildcard.learn(w("a", "b", None), w("b", "ü")).collect()) == ["a", "b", "ü"]
    assert tuple(wildcard.size_report(w("ü", "ab", "ab", None)).first()) == (2, 3, 4) and tuple(wildcard.size_report(w()).first()) == (0, 0, 0)
    for layout in wildcard.LAYOUTS:
        assert wildcard.dictionary(w("a"), layout).count() == 1
    with pytest.raises(ValueError):
        wildcard.dictionary(w("a"), "list")
    found = spark.createDataFrame([(1, "ab"), (1, "ba"), (2, "x")], "query_id bigint, word string")
    assert [(r.word, r.pos) for r in wildcard.ordered(found, "reversed").collect()] == [("ba", 1), ("ab", 2), ("x", 1)]


def test_appended_documents_are_numbered_on(spark):
    none = spark.createDataFrame([], "doc bigint, term_id bigint, tf bigint")
    t = lambda rows: spark.createDataFrame(rows, "doc bigint, term_id bigint")
    one = features.append_documents(none, t([(5, 1), (5, 1), (9, 2)]), -1)
    two = features.append_documents(one, t([(2, 1), (4, 3)]), 1)
    assert sorted(tuple(r) for r in two.collect()) == [(0, 1, 2), (1, 2, 1), (2, 1, 1), (3, 3, 1)]
    assert tuple(features.total_dims(t([(1, 1), (2, 1), (2, 5)]), 2).first()) == (2, 1, 2)


def test_numbers_of_many_ranges(spark):
    ids = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)] + [(None,), (5,)], "x bigint")
    got = {r.x: r.dim for r in features.number_ids(ids, "x", 13).collect()}
    assert got == {i: i + 1 for i in range(1000)} and features.number_ids(ids.limit(0), "x").count() == 0
