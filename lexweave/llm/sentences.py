"""Sentence units of texts in many languages and scripts, by two finite transducers that are compiled from their rules.

A text becomes a stream of symbols. ``lex`` only classifies: it looks up what stands before a final punctuation mark (an
abbreviation, an initial, a number, a word), which marks close after it, and what begins next.

* The first transducer holds the boundary rules. It reads each final mark with its left class, the closing marks after it, and the
  class of the next beginning, and tells whether a sentence ends there. Its states are minimised.
* The second one holds what depends on the rest of the paragraph: whether a quote or bracket is open, how the outermost one began,
  and what is pending. It reads blank lines, openers, closers, Thai spaces, beginnings, and the final marks that the first one passed.

The symbols of all texts of a batch form one stream, in which a reset begins each text. It is cut into chunks of fixed length; for
each chunk the function from entry state to exit state is computed, all chunks at once; a parallel prefix scan composes the
functions; with the entry states known, all chunks write their outputs at once. A text of any length is split over chunks like
many short ones. A very long text is lexed in pieces, each in a task of its own: cut at blank lines, where every unit ends and both
transducers are in their start states.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import strings

# ---------------------------------------------------------------- the transducer of the paragraph

RESET, BLANK, VISIBLE, QUOTE, TOLD_QUOTE, BRACKET, TITLE, CLOSE, FINAL, FINAL_OR_REPORT, THAI_SPACE, NOTHING = range(12)
OPENERS = (QUOTE, TOLD_QUOTE, BRACKET, TITLE)
DEPTH = 4
#: What the outermost open pair is: a quote, one announced by a colon, a bracket that began its unit, one inside a unit, a title.
OUTER = ("quote", "told", "whole", "inside", "title")


def _step(state: tuple, event: int) -> tuple[tuple, bool]:
    """(next state, whether a unit starts here). A state: text seen in this unit, depth, outermost pair, pending final."""
    text, depth, outer, pending = state
    if event in (RESET, BLANK):
        return (False, 0, None, None), False
    if event == VISIBLE or event in OPENERS:
        starts = not text or (depth == 0 and pending is not None)
        if event == VISIBLE:
            return (True, depth, outer, None), starts
        if depth == 0:
            outer = {QUOTE: "quote", TOLD_QUOTE: "told", TITLE: "title", BRACKET: "whole" if starts else "inside"}[event]
        return (True, min(depth + 1, DEPTH), outer, None), starts
    if event == CLOSE and depth:
        if depth > 1:
            return (True, depth - 1, outer, pending), False
        kept = {"quote": pending if pending == "final" else None, "told": pending and "final", "whole": pending and "final"}
        return (True, 0, None, kept.get(outer)), False
    if event in (FINAL, FINAL_OR_REPORT):
        return (True, depth, outer, "final" if event == FINAL or not depth else "report"), False
    if event == THAI_SPACE and depth == 0 and text:
        return (text, depth, outer, "final"), False
    return state, False


def compiled(step: Callable, start: Hashable, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables [symbol, state] of the next state and of the output of ``step(state, symbol)``, over the reachable states (the start is 0).

    States that no input tells apart are one: groups of equal outputs are split until the groups they lead to agree.
    """
    place = {start: 0}
    queue = [start]
    for s in queue:
        for e in range(symbols):
            t, _ = step(s, e)
            if t not in place:
                place[t] = len(place)
                queue.append(t)
    nxt, out = np.zeros((symbols, len(place)), np.int64), np.zeros((symbols, len(place)), np.uint8)
    for s, e in product(queue, range(symbols)):
        t, o = step(s, e)
        nxt[e, place[s]], out[e, place[s]] = place[t], o
    group = np.unique(out, axis=1, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.vstack([group, group[nxt]]), axis=1, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    _, first, group = np.unique(group, return_index=True, return_inverse=True)
    order = np.argsort(first)  # the group of the start comes first
    rank = np.argsort(order)
    return rank[group][nxt[:, first[order]]].astype(np.uint8), out[:, first[order]]


NEXT, OUTPUT = compiled(_step, (False, 0, None, None), NOTHING + 1)


def transduce(events: np.ndarray, chunk: int = 64, tables: tuple[np.ndarray, np.ndarray] = (NEXT, OUTPUT), nothing: int = NOTHING) -> np.ndarray:
    """The output at each symbol, by composing the chunks' state functions in a parallel prefix scan. ``nothing``: a symbol that changes nothing."""
    nxt, output = tables
    n = len(events)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, nothing, events.dtype)
    grid[:n] = events
    grid = grid.reshape(rows, chunk)
    function = np.tile(np.arange(nxt.shape[1], dtype=np.uint8), (rows, 1))
    for t in range(chunk):
        function = nxt[grid[:, t, None], function]
    step = 1
    while step < rows:
        after = function.copy()
        after[step:] = np.take_along_axis(function[step:], function[:-step].astype(np.intp), 1)
        function, step = after, step * 2
    state = np.concatenate([np.zeros(1, np.uint8), function[:-1, 0]]) if rows else np.zeros(0, np.uint8)
    out = np.zeros(grid.shape, output.dtype)
    for t in range(chunk):
        out[:, t] = output[grid[:, t], state]
        state = nxt[grid[:, t], state]
    return out.reshape(-1)[:n]


# ---------------------------------------------------------------- the transducer of the boundary rules

#: What a final mark is: one of a script that uses it for nothing else, ! or ?, an ellipsis or several dots (touching Chinese or Japanese or not), one dot.
NATIVE, MARK, RUN, RUN_CJK, DOT = range(5)
#: What stands before a dot: a word or anything else, an initial, an abbreviation that ends no unit, one that is such only before a number,
#: a month, an abbreviation that may end a unit, "al", and one or two digits: where a unit began, where one began if the final mark
#: before them ended one, and elsewhere.
WORD, INITIAL, NEVER_ENDS, BEFORE_NUMBER, MONTH, MAY_END, ET_AL, FIRST_NUMBER, PERHAPS_FIRST_NUMBER, NUMBER = range(10)
#: Whether a unit can follow a dot without a space: not in an address, not before a capital after a short word, else yes.
IN_ADDRESS, SHORT, OPEN = range(3)
#: What begins next: a capital letter, one behind other marks, lower case, lower case with digits, a digit, a letter without case, none of
#: these, what can't begin a unit, nothing.
UP, UP_MARKED, LOW, MIXED, DIGIT, CASELESS, SYMBOL, CONTINUES, END = range(9)
#: What it is, where that matters: a company's form, a word that an ordinal belongs to, a particle after a quotation, a clause that reports it.
PLAIN, COMPANY, ORDINAL, JOINING, REPORTING = range(5)
FINALS = [(k, WORD, OPEN) for k in (NATIVE, MARK, RUN, RUN_CJK)] + list(product((DOT,), range(10), range(3)))
BEGINNINGS = list(product(range(9), range(5), (False, True), (False, True)))  # class, what it is, after a space, an opener
FINAL_SYMBOL = {x: i for i, x in enumerate(FINALS)}
CLOSE_QUOTE, CLOSE_BRACKET, START, KEEP = range(len(FINALS), len(FINALS) + 4)
BEGIN_SYMBOL = {x: i for i, x in enumerate(BEGINNINGS, KEEP + 1)}
NO_END, ENDS, ENDS_OR_REPORT = range(3)


def _ends(final: tuple, closed: bool, quoted: bool, begin: tuple, before: bool) -> int:
    """Whether a unit ends at a final mark; ``before``: whether one ended at the final mark before."""
    (kind, left, join), (after, what, spaced, opener) = final, begin
    if after in (END, CONTINUES) or (closed and after == LOW):
        return NO_END
    if kind == MARK:
        if not spaced and not opener and after in (LOW, DIGIT, SYMBOL, MIXED):
            return NO_END
    elif kind in (RUN, RUN_CJK):
        if kind == RUN_CJK or after == LOW or not (spaced or opener or after in (UP, UP_MARKED)):
            return NO_END
    elif kind == DOT:
        if left in (INITIAL, NEVER_ENDS) or (left in (BEFORE_NUMBER, MONTH, ET_AL) and after == DIGIT):
            return NO_END
        if left in (FIRST_NUMBER, PERHAPS_FIRST_NUMBER, NUMBER):
            if left == FIRST_NUMBER or (left == PERHAPS_FIRST_NUMBER and before) or after == LOW or (what == ORDINAL and not closed):
                return NO_END
        if not spaced:
            if join == IN_ADDRESS or not (opener or after in (UP, CASELESS)) or (join == SHORT and after in (UP, UP_MARKED)):
                return NO_END
        if left in (MONTH, MAY_END, ET_AL) and (after in (LOW, SYMBOL) or what == COMPANY):
            return NO_END
    if quoted and what == JOINING:
        return NO_END
    return ENDS_OR_REPORT if quoted and what == REPORTING else ENDS


def _rule_step(state: tuple, symbol: int) -> tuple[tuple, int]:
    """(next state, output). A state: the final mark read, whether something closed since, whether a quote did, whether the mark before ended a unit."""
    final, closed, quoted, before = state
    if symbol == START:
        return (None, False, False, True), NO_END
    if symbol == KEEP:
        return state, NO_END
    if symbol < CLOSE_QUOTE:
        return (FINALS[symbol], False, False, before), NO_END
    if symbol in (CLOSE_QUOTE, CLOSE_BRACKET):
        return (final, True, quoted or symbol == CLOSE_QUOTE, before), NO_END
    if final is None:
        return state, NO_END
    ends = _ends(final, closed, quoted, BEGINNINGS[symbol - KEEP - 1], before)
    return (None, False, False, ends != NO_END), ends


RULES = compiled(_rule_step, (None, False, False, True), KEEP + 1 + len(BEGINNINGS))


# ---------------------------------------------------------------- the classes

# Abbreviations that never end a unit, that end one only before what looks like a beginning, and that are
# abbreviations only before a number.
NEVER = frozenset(
    "dr prof mr mrs ms st mt lt col gen sgt capt rev hon vs cf fig figs vol vols pp ch sec eq approx dept vgl bzw ca geb gest evtl ggf sog inkl abb hrsg "
    "kap bd env éd ed eds ex chap mm mlle str bes zzgl nrn resp डॉ पृ श्री प्रो सं i.e e.g d.h z.b u.a i.d.r p.ex v.a".split()
)
MAYBE = frozenset("etc usw inc ltd co corp jr sr ff al chr bros ret est p.m a.m u.s u.k u.n u.s.a ph.d b.c a.d n.chr v.chr bspw".split())
NUMBERED = frozenset("no nr art abs op tab nos".split())
MONTHS = frozenset("jan feb mar apr jun jul aug sep sept oct okt nov dec dez janv févr juil déc".split())
_ORDINAL = regex.compile(
    r"\s+(?:>+\s*)?(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Jahrtausend|Jh|Jhd|Kapitel|Auflage|Band|Klasse|Mal|Tag|Woche|Monat|Jahr|Platz)"
)
_MARKS = r"\"“”„‟«»()\[\]{}「」『』（）［］【】〔〕《》〈〉"
_TOKEN = regex.compile(rf"(?P<blank>\n\s*\n)|(?P<mark>[{_MARKS}])|(?P<final>[.!?…‥。．！？।॥؟]+)")
_TOKEN_THAI = regex.compile(rf"(?P<blank>\n\s*\n)|(?P<mark>[{_MARKS}])|(?P<final>[.!?…‥。．！？।॥؟]+)|(?P<thai>(?<=[\p{{Thai}}\"“”„«»])(?!\s*\n\s*\n)\s+(?:>+[ \t]*)*(?=[\p{{Thai}}\"“”„«»]))")
_THAI = regex.compile(r"\p{Thai}")
_QUOTES = "\"“”„‟«»「」『』"
_PAIRS = {"(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "［": "］", "【": "】", "〔": "〕", "《": "》", "〈": "〉", "«": "»", "“": "”", "„": "“"}
_CLOSING = set(_PAIRS.values()) | {'"'}
_SPACE = regex.compile(r"\s*")
_AFTER = regex.compile(r"\s*(?:(?<=\n[ \t]*)>+[ \t]*)*")
_BLANK = regex.compile(r"\n\s*\n")
_BEGIN = regex.compile(r"[^\p{L}\p{N}\n]{0,6}(?P<c>[\p{L}\p{N}])(?P<mixed>\p{Ll}*\d)?")
_WORD = regex.compile(r"(?:[\p{L}\p{M}]+\.)*[\p{L}\p{M}]+$")
_DIGITS = regex.compile(r"(?<![\d.,\p{L}])\d{1,2}$")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_NATIVE = frozenset("。．！？।॥؟")
_CONTINUES = frozenset(",;:،؛、；：，)]}»”）」』》〉】.!?…。！？।؟·/%")
_JOINS = regex.compile(r"と|って|的|という")
_REPORT = regex.compile(
    r"\p{Han}{1,10}?(?:问道|说道|答道|写道|喊道|问|说|道|答)[。，！？]"
    r"|[^।!?\n“”\"]{1,60}?(?:पूछा|कहा|बोला|बोली|लिखा|बताया)\s*।"
    r"|(?:سأل|سألت|قال|قالت|أجاب|أجابت|كتب|كتبت|أضاف)\b(?!\s*:)"
    r"|\p{Lu}[\p{L}\p{M}’'-]*(?:\s\p{Lu}[\p{L}\p{M}’'-]*)?\s(?:asked|said|wrote|replied|answered|fragte|sagte|schrieb|antwortete|demanda|dit|répondit|écrivit)\b(?!\s*:)"
)
_ADDRESS = regex.compile(r"[/@\\]|:\S")
_COMPANY = ("Ltd", "Inc", "KG")


def _pairs(text: str, marks: list[int]) -> tuple[dict[int, int], set[int]]:
    """(opener place -> event, closer places) of the quotes and brackets of a paragraph that have a partner in it."""
    stack: list[tuple[int, str]] = []
    waiting: Counter[str] = Counter()  # closers that the stack holds an opener for: it is only searched where one is
    found: list[tuple[int, int]] = []

    def push(p: int, closer: str) -> None:
        stack.append((p, closer))
        waiting[closer] += 1

    for p in marks:
        c = text[p]
        closer = c if c in _CLOSING and waiting[c] else "“" if c == "”" and waiting["“"] else None  # ” also closes what „ opened
        if closer:
            while True:
                at, expected = stack.pop()
                waiting[expected] -= 1
                if expected == closer:
                    break
            found.append((at, p))
        elif c == '"':
            before, after = text[p - 1 : p], text[p + 1 : p + 2]
            if after and not after.isspace() and not (before.isalnum() and not _CJK.match(before)):
                push(p, '"')
        elif c in _PAIRS:
            push(p, _PAIRS[c])
        elif c == "»" and text[p + 1 : p + 2].isalnum():
            push(p, "«")
    opens: dict[int, int] = {}
    closes: set[int] = set()
    for a, b in found:
        c = text[a]
        if c in "《〈":
            opens[a] = TITLE
        elif c in _QUOTES:
            opens[a] = TOLD_QUOTE if text[max(0, a - 40) : a].rstrip()[-1:] in (":", "：") else QUOTE
        else:
            opens[a] = BRACKET
        closes.add(b)
    return opens, closes


def _skip(text: str, p: int) -> int:
    """Where what follows ``p`` and white space begins."""
    c = text[p : p + 2]
    if c[:1] == " " and len(c) == 2 and not c[1].isspace():
        return p + 1
    return p if c and not c[0].isspace() else _SPACE.match(text, p).end()


def _left(text: str, s: int, prev: int, prev_ends: bool) -> int:
    """The class of what stands before a dot at ``s``; ``prev``: where the last final mark (or blank line: ``prev_ends``) before it ends."""
    near = text[max(0, s - 24) : s].split()
    m = _WORD.search(near[-1]) if near and not text[s - 1].isspace() else None
    if m is None:
        if not _DIGITS.search(text, max(0, s - 4), s):
            return WORD
        alone = text[max(prev, s - 8) : s].strip(" \t\n>").isdigit()
        return NUMBER if not alone else FIRST_NUMBER if prev <= s - 8 or prev_ends else PERHAPS_FIRST_NUMBER
    word = m.group().lower()
    if len(word) == 1:
        return WORD if _CJK.match(word) else INITIAL
    for known, left in ((NEVER, NEVER_ENDS), (NUMBERED, BEFORE_NUMBER), (MONTHS, MONTH), (MAYBE, ET_AL if word == "al" else MAY_END)):
        if word in known:
            return left
    if "." in word:  # other dotted abbreviations, or a missing space after a longer word
        parts = word.split(".")
        if all(len(p) == 1 for p in parts):
            return MAY_END
        if len(parts[-1]) == 1 or parts[-1] in NEVER:
            return NEVER_ENDS
        if parts[-1] in MAYBE:
            return MAY_END
    return WORD


def _join(text: str, s: int) -> int:
    near = max(0, s - 200)  # an address is not longer
    if _ADDRESS.search(text, max(text.rfind(" ", near, s), text.rfind("\n", near, s), near - 1) + 1, s):
        return IN_ADDRESS
    before = text[s - 1 : s]
    if not before.isalpha():
        return OPEN
    m = _WORD.search(text, max(0, s - 24), s)
    return OPEN if m and len(m.group()) >= 3 and before.islower() else SHORT


def _beginning(text: str, r: int, opens: dict[int, int]) -> int:
    if text[r] in _CONTINUES and r not in opens:
        return CONTINUES
    m = _BEGIN.match(text, r)
    if m is None:
        return SYMBOL
    c = m["c"]
    if c.isdigit() or c.isnumeric() and not c.isalpha():
        return DIGIT
    if c.isupper() or c.istitle():
        return UP if text[r].isalpha() else UP_MARKED
    if c.islower():
        return MIXED if m["mixed"] else LOW
    return CASELESS


def _final_symbols(text: str, s: int, e: int, opens: dict[int, int], closes: set[int], prev: int, prev_ends: bool) -> list[int]:
    """The symbols of the final punctuation text[s:e]: the mark with its left class, what closes after it, what begins next."""
    n, p, closing, quoted = len(text), e, [], False
    while True:
        r = _skip(text, p)
        if r < n and r in closes and (r == p or text[r] in "»«”\""):
            quoted = quoted or text[r] in _QUOTES
            closing.append(CLOSE_QUOTE if text[r] in _QUOTES else CLOSE_BRACKET)
            p = r + 1
        else:
            break
    if r < n and text[r] == ">":
        r = _AFTER.match(text, p).end()
    over = r >= n or (r - p > 1 and _BLANK.search(text, p, r) is not None)
    after, spaced, opener, what = END if over else _beginning(text, r, opens), r != e, r in opens, PLAIN
    run, final = text[s:e], (NATIVE, WORD, OPEN)
    if not _NATIVE.isdisjoint(run) or after in (END, CONTINUES):
        pass  # where nothing can begin, the mark's class doesn't matter
    elif "!" in run or "?" in run:
        final = (MARK, WORD, OPEN)
    elif "…" in run or "‥" in run or len(run) > 1:
        final = (RUN_CJK if _CJK.match(text[s - 1 : s] or " ") or _CJK.match(text[e : e + 1] or " ") else RUN, WORD, OPEN)
    else:
        may_follow = not spaced and (opener or after in (UP, UP_MARKED, CASELESS))
        final = (DOT, _left(text, s, prev, prev_ends), _join(text, s) if may_follow else OPEN)
    left = final[1]
    if quoted and not over and (_JOINS.match(text, r) or _REPORT.match(text, r)):
        what = JOINING if _JOINS.match(text, r) else REPORTING
    elif left >= FIRST_NUMBER and _ORDINAL.match(text, s + 1):
        what = ORDINAL
    elif left in (MONTH, MAY_END, ET_AL) and text.startswith(_COMPANY, r):
        what = COMPANY
    return [FINAL_SYMBOL[final], *closing, BEGIN_SYMBOL[after, what, spaced, opener]]


def lex(text: str) -> tuple[list[int], list[int], list[int], list[int]]:
    """(places, events, finals, symbols) of a text: the events of the paragraph in order, the first RESET; for each event the number of
    the final mark that it stands or falls with, or -1; and the symbols of the boundary rules, the first START."""
    thai = _THAI.search(text) is not None
    tokens = [(m.lastgroup, m.start(), m.end()) for m in (_TOKEN_THAI if thai else _TOKEN).finditer(text)]
    opens: dict[int, int] = {}
    closes: set[int] = set()
    marks: list[int] = []
    for kind, s, _ in [*tokens, ("blank", 0, 0)]:
        if kind == "mark":
            marks.append(s)
        elif kind == "blank" and marks:
            o, c = _pairs(text, marks)
            opens |= o
            closes |= c
            marks = []
    found: list[tuple[int, int, int, int]] = []  # place, order at a place, event, final mark
    symbols = [START]
    n, prev, prev_ends, depth, finals = len(text), 0, True, 0, 0

    def visible(p: int, final: int = -1) -> None:
        r = _skip(text, p)
        if r < n and r not in opens and r not in closes:
            found.append((r, 1, VISIBLE, final))

    visible(0)
    for kind, s, e in tokens:
        if kind == "blank":
            found.append((s, 0, BLANK, -1))
            visible(e)
            prev, prev_ends = e, True
        elif kind == "mark":
            if s in opens:
                depth += 1
                found.append((s, 2, opens[s] if depth <= DEPTH else VISIBLE, -1))
            elif s in closes:
                if depth <= DEPTH:  # a pair deeper than the states count ends as it began, without an event
                    found.append((s, 2, CLOSE, -1))
                depth -= 1
                visible(e)
        elif kind == "final":
            symbols += _final_symbols(text, s, e, opens, closes, prev, prev_ends)
            found.append((e - 1, 3, FINAL, finals))
            visible(e, finals)
            finals += 1
            prev, prev_ends = e, False
        else:
            left, right = text[s - 1], text[e]
            if (_THAI.match(left) or (s > 1 and _THAI.match(text[s - 2]))) and (_THAI.match(right) or (e + 1 < n and _THAI.match(text[e + 1]))):
                found.append((s, 0, THAI_SPACE, -1))
                visible(s)
    found.sort()
    return [0, *[x[0] for x in found]], [RESET, *[x[2] for x in found]], [-1, *[x[3] for x in found]], symbols


def starts(events: np.ndarray, finals: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """For each event whether a unit starts there; the arguments as from ``lex``, of one text or of many one after another."""
    ends = transduce(symbols, tables=RULES, nothing=KEEP)[symbols > KEEP]  # one for each final mark
    events = events.copy()
    own = np.flatnonzero(finals >= 0)
    decided = ends[finals[own]]
    mark = events[own] == FINAL
    events[own[decided == NO_END]] = NOTHING
    events[own[mark & (decided == ENDS_OR_REPORT)]] = FINAL_OR_REPORT
    return transduce(events) > 0


def units(texts: list[str | None]) -> list[list[tuple[int, int]]]:
    """The sentence units of each text: code points [start, end) of their first and last visible character."""
    places: list[int] = []
    events: list[int] = []
    finals: list[int] = []
    symbols: list[int] = []
    owner: list[int] = []
    n = 0
    for i, t in enumerate(texts):
        if t and not t.isspace():
            p, e, f, s = lex(t)
            places += p
            events += e
            finals += [k + n if k >= 0 else -1 for k in f]
            n += max(f) + 1
            symbols += s
            owner += [i] * len(p)
    found = starts(np.array(events, np.uint8), np.array(finals, np.int64), np.array(symbols, np.uint8))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    begins: list[list[int]] = [[] for _ in texts]
    for k in np.flatnonzero(found).tolist():
        begins[owner[k]].append(places[k])
    for i, b in enumerate(begins):
        t = texts[i]
        for a, z in zip(b, [*b[1:], len(t or "")]):
            out[i].append((a, a + len(t[a:z].rstrip())))
    return out


def pieces(text: str, size: int) -> Iterator[tuple[int, str]]:
    """(offset, piece) of a text, cut at blank lines after at least ``size`` characters; not where a colon stands before one, as it
    tells how a quote after it began."""
    begin = 0
    for m in _BLANK.finditer(text):
        if m.end() - begin >= size and text[max(0, m.start() - 40) : m.start()].rstrip()[-1:] not in (":", "："):
            yield begin, text[begin : m.end()]
            begin = m.end()
    yield begin, text[begin:]


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2_000_000, long_text: int = 1_000_000) -> DataFrame:
    """``<id_col>, sent_start, sent_end``: a row for each sentence unit of each text, in code points from 0, end exclusive.

    Every visible character lies in exactly one unit. Null, empty and blank texts have no unit. Rows with a null or repeated id
    are split like any other. ``window``: characters whose symbols share one stream; ``long_text``: texts of more characters are cut
    at blank lines into pieces of about so many, which are spread over the cluster. Both bound memory and time, not results; a
    paragraph of any length stays in one task.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: pa.Array, offsets: np.ndarray, texts: list[str | None]) -> pa.RecordBatch:
            found = units(texts)
            rows = np.repeat(np.arange(len(texts)), [len(u) for u in found])
            flat = np.array([x for u in found for x in u], np.int64).reshape(-1, 2) + offsets[rows, None]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=[id_col, "sent_start", "sent_end"])

        for b in batches:
            texts, size, start = [], 0, 0
            offsets = b.column(2).to_numpy()
            for t in strings(b.column(1)):
                texts.append(t)
                size += len(t or "")
                if size > window:
                    yield flush(b.column(0).slice(start, len(texts)), offsets[start : start + len(texts)], texts)
                    start, texts, size = start + len(texts), [], 0
            if texts:
                yield flush(b.column(0).slice(start, len(texts)), offsets[start:], texts)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(strings(b.column(1))):
                for offset, piece in pieces(t, long_text):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([piece]), pa.array([offset])], names=[id_col, text_col, "_at"])

    is_long = F.coalesce(F.length(text_col) > long_text, F.lit(False))
    out = f"`{id_col}` {kind}, sent_start bigint, sent_end bigint"
    rows = docs.select(id_col, text_col)
    short = rows.filter(~is_long).withColumn("_at", F.lit(0).cast("bigint")).mapInArrow(run, out)
    # only very long texts are shuffled
    spread = rows.filter(is_long).mapInArrow(cut_up, f"`{id_col}` {kind}, `{text_col}` string, _at bigint").repartition(F.xxhash64(text_col, "_at"))
    return short.unionAll(spread.mapInArrow(run, out))
