import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import sentences

# each list: the units of a text, in order; a unit that starts with ~ follows without a space, with ¶ after a blank line, with ↵ after a line break
CASES = [
    ["Dr. Smith met Prof. A. Jones on Jan. 2, 1977.", "It cost approx. $3.50 vs. $3 before.", "Why?", "Yes!"],
    ["He left at 10.35 p.m. and slept.", "The shop closes at 8 p.m.", "445 rows were counted.", "It holds lists, tries, etc.", "trie2vec was built."],
    ["Alva asked: \"Who counted it? And when?\"", "\"Is it sorted?\" asked Alva.", "“The index,” said Alva, “was hashed. It always is.”", "Next."],
    ["It says “n/a” for one and \"...\" for two.", "The sorter was ... well, ignored.", "Nobody knew why...", "Then it ended."],
    ["It was sorted (it had failed. Twice!) by hand.", "(At that time it was new.)", "Read http://a.example/b.html?q=1&v=2.0 first.", "Its weight is .157, its norm 1.157e-5.", "Names like \"Oh!\" confuse it."],
    ["It was copied quietly.", "~The next one follows.", "The rights went to Acme Inc.", "~Lt. Col. Orr left."],
    ["No. 385 is old, cf. Orr et al. 2008, for more.", "The index by Orr & Co. Ltd. was rebuilt.", "It was merged in the U.S. and Peru.", "Never trust it!!!", "Was it split?!"],
    ["1. Method", "¶First line", "¶From: Al <a@b.example>\nLines: 23\nSubject: v2.1", "¶--\nAl\nArchive"],
    ["> One line goes on\n> over the break.", "↵> Two is here."],
    ["„Wurde der Index geprüft?“, fragte Alva.", "„Der Baum wurde sortiert!“", "Am 8. März wurde der Titel von Dr. Orr gezählt.", "Im 15. Jahrhundert entstand er um 119 v. Chr. bei Rom.", "Etwa 2,6 Prozent, z. B. Artikel, sind i. d. R. alt.", "Geöffnet bis 17.10 Uhr … meistens.", "Er umfasst Listen usw.", "Siehe Abs. 3, bzw. S. 786 ff. im Text."],
    ["« A-t-on relu le mot ? » demanda Alva.", "Alva écrit : « Le mot est relu. Personne ne lit. »", "M. Orr a lu, p. ex. à la page 164.", "Il coûte 4,29 euros… au moins.", "Quel titre !", "Le Dr Orr et J.-P. Roy lisent (cf. Orr).", "Il reste env. 7,4 %."],
    ["什么？！", "~“分片重建了吗？”编辑问道。", "~他说：“索引已经删除了。没有人看。”", "~词表……其实早就检查了。", "~《词表！目录？》是一篇文档。", "~词干.txt的第76.4节（见附录。很短）介绍了它。", "~准确率是20.5%。"],
    ["本当に数えたのですか！？", "~「閾値は？」と誰かが聞いた。", "~『重み。記事！』という記事がある。", "~版は7.3.4、ファイルはa.tabである。", "~文書（第7.6節。短い）は古い。"],
    ["संपादक ने कहा: “सूची खाली है। कोई नहीं पढ़ता।”", "“संग्रह कहाँ है?” उन्होंने पूछा।", "डॉ. लेख ने सटीकता 87.97 देखी।", "क्या लेख पढ़ी गई?"],
    ["هل المقال فارغ؟", "«هل المقال فارغ؟» سأل المحرر.", "قال: «الفهرس فارغ. لا أحد يقرأ.»", "انظر ص. 43 من المقال.", "نسخ د. سالم الجدول."],
    ["ไฟล์ a.txt มีตาราง", "“ตารางว่างไหม”ถาม", "เรานับ 19.73 จุด", "ทำไม"],
]


def build(case):
    text, spans = "", []
    for u in case:
        glue = {"~": "", "¶": "\n\n", "↵": "\n"}.get(u[0])
        text += ("" if not text else " ") if glue is None else glue
        u = u if glue is None else u[1:]
        spans.append((len(text), len(text) + len(u)))
        text += u
    return text, spans


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0][:20])
def test_units(case):
    text, spans = build(case)
    got = sentences.units([text])[0]
    assert [text[a:b] for a, b in got] == [text[a:b] for a, b in spans]


def test_a_blank_line_after_a_space_in_thai():
    assert sentences.units(['" \n\nก', "“ก \n\nข” ค"]) == [[(0, 1), (4, 5)], [(0, 2), (5, 7), (8, 9)]]


def test_one_stream_for_all_texts():
    texts = [build(c)[0] for c in CASES] * 3 + [None, "", "  \n", "x", "“unclosed. Quote"]
    random.Random(1).shuffle(texts)
    assert sentences.units(texts) == [sentences.units([t])[0] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text("Aa1 .!?\n>\"“”()«»…。「」ก日x:,", max_size=80))
def test_every_visible_character_once(text):
    cover = np.zeros(len(text), int)
    last = 0
    for a, b in sentences.units([text])[0]:
        assert last <= a < b and not text[a].isspace() and not text[b - 1].isspace()
        cover[a:b] += 1
        last = b
    assert all(cover[i] == 1 for i, c in enumerate(text) if not c.isspace())
    assert not any(re.search(r"\n\s*\n", text[a:b]) for a, b in sentences.units([text])[0])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, sentences.NOTHING), max_size=300), st.sampled_from([1, 3, 64]))
def test_prefix_scan_equals_a_plain_run(events, chunk):
    state, want = (False, 0, None, None), []
    for e in events:
        state, out = sentences._step(state, e)
        want.append(out)
    assert sentences.transduce(np.array(events, np.uint8), chunk).tolist() == want


def test_many_open_marks_are_linear():
    text = "(" * 200_000 + "]" * 200_000 + " End. Next."
    assert len(sentences.units([text])[0]) == 2


def test_table(spark):
    long = "One is here. " * 40_000
    rows = [(1, "Aa bb. Cc dd.", 0), (2, None, 0), (3, "", 0), (4, " \n\n ", 0), (5, long, 0), (None, "Alone.", 0), (1, "Again.", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sent_start int")
    got = [tuple(r) for r in sentences.split_sentences(df, window=100).collect()]
    assert sorted(x for x in got if x[0] == 1) == [(1, 0, 6), (1, 0, 6), (1, 7, 13)]
    assert sum(x[0] == 5 for x in got) == 40_000 and (None, 0, 6) in got and len(got) == 40_004
    assert sentences.split_sentences(df.limit(0)).count() == 0


@pytest.mark.parametrize("levels", [3, 4, 5, 6, 9])
def test_deep_nesting(levels):
    inner = "(" * levels + "It was new" + ") and so on. It went on" * (levels - 1) + ")"
    text = f"It was sorted {inner} by hand. Then it ended."
    assert [a for a, _ in sentences.units([text])[0]] == [0, text.index("Then")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, sentences.RULES[0].shape[0] - 1), max_size=200), st.sampled_from([1, 7, 64]))
def test_minimised_rules_equal_the_rules(symbols, chunk):
    state, want = (None, False, False, True), []
    for x in symbols:
        state, out = sentences._rule_step(state, x)
        want.append(out)
    assert sentences.transduce(np.array(symbols, np.uint8), chunk, sentences.RULES, sentences.KEEP).tolist() == want


def test_tables_are_finite_and_small():
    assert sentences.NEXT.shape[1] < 64 and sentences.RULES[0].shape[1] < 256 and sentences.RULES[0].shape[0] < 256


@settings(max_examples=200, deadline=None)
@given(st.text("Aa1 .!?\n\n\n>\"“”()«»…。「」ก日x:,", max_size=120), st.integers(1, 30))
def test_pieces_have_the_units_of_the_text(text, size):
    parts = list(sentences.pieces(text, size))
    assert "".join(p for _, p in parts) == text
    found = [(a + o, b + o) for o, p in parts for a, b in sentences.units([p])[0]]
    assert found == sentences.units([text])[0]


def test_a_long_text_is_spread(spark):
    text = "One is here. Two (of it. All) follow.\n\n" * 250_000  # about 10 MB
    df = spark.createDataFrame([(1, text), (2, "Short. One."), (None, None)], "doc_id bigint, text string")
    got = sentences.split_sentences(df)
    assert got.filter("doc_id = 1").count() == 500_000 and got.filter("doc_id = 2").count() == 2
    assert got.filter("doc_id = 1").agg({"sent_end": "max"}).first()[0] == len(text) - 2
    assert len(list(sentences.pieces(text, 1_000_000))) == 10
