"""Problem 10: pages of repeated keywords, link lists and product tags.

A page's suffix automaton over its words gives, for every word, whether it
lies in a maximal repeated run of words: one of two words or more that occurs
twice, or a word by itself that occurs three times. A stretch of text counts as stuffing
when it has no clause structure (almost no function words of any supported
language) and such stretches are mostly covered by repeats, or when a sentence
names a keyword of the page (a word that makes up a good part of it) several times and is mostly covered by words that occur three times
(keywords strung into sentences that say nothing else), or when neighbouring
lines that end no sentence and hold no function words but prepositions,
articles and conjunctions (keyword phrases with glue) repeat words among them
and are mostly covered by repeats; links with their
labels and hashtags count by themselves. A page is a case when more than half
of its characters (white space aside) count.

The automaton is built only where it can still add to the share: a word in a
repeated run occurs at least twice by itself, so stretches without enough such words
are out beforehand; which of the others count, the runs alone decide. Where only the cases are asked for (``full`` is false) it is
also left out when links, hashtags and all stretches that could count stay at
or below half together, or links and hashtags are more than half alone; the
share is then only on the right side of a half. Neither bound loses a case.

Defined cases: null, empty and blank texts have share 0; texts are judged
whole, however long; repeated rows are judged alike; prose that repeats whole
sentences keeps its clause structure and does not count.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Function words that carry clause structure (Spanish, Catalan, Galician,
# Portuguese, French, Italian, English, German). Words that keyword phrases use as glue
# (de, del, en, sin, cerca, mí, me, near, best) are left out on purpose.
CLAUSE_WORDS = frozenset(
    """
    el la los las un una unos unas lo al y e o u que qué quien quienes cuando donde porque pues si no ni se le les nos su sus mi
    es son fue fueron era eran está están será ha han hay he ya muy más pero como con para por desde hasta entre sobre según tras
    cada esta este esto todo todos también todavía durante
    els hi ha amb fins és perquè i va més dia
    os as em um uma dos das no na nos nas ao à às há não foi até durante chegou
    le du des au aux et est il elle ne pas plus mais dans sur pour jusqu une qui où
    il gli dei della di è sono che per non alla nel
    the an and is are was were be to of at that this it its we you they from on by for with if or not will has have which but
    der die das und ist sind nicht ein eine mit auf für von zu den dem
    a
    """.split()
)
# Those of them that join nouns and can stand in a phrase without a verb.
GLUE = CLAUSE_WORDS & frozenset(
    """
    el la los las un una unos unas lo al y e o u su sus mi con para por desde hasta entre sobre según tras els amb fins i
    os as um uma dos das nas nos ao à às em le du des au aux et dans sur pour une il gli dei della di per alla nel
    the an and of to at on by for with from or der die das und ein eine mit auf für von zu den dem a
    """.split()
)
SENTENCE_END = re.compile(r"[.!?…][\s\"'»”’)\]]*$")
YEAR = re.compile(r"(?:19|20)\d\d")
# Parts of links. No part runs over the start of another, so a page of unclosed ones is still read in one pass.
LINK_PART = re.compile(
    r"""(?P<a><a\b[^<>]*>)|(?P<a_>\</a\s*>(?:\s*<br\s*/?>)?)|(?P<u>\[url[^\[\]]*\])|(?P<u_>\[/url\])"""
    r"""|!?\[[^\[\]\n]*\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*\)|(?:https?:)?//[^\s<>"')\]]+|\bwww\.[^\s<>"')\]]+""",
    re.IGNORECASE,
)
HASHTAG = re.compile(r"(?<!\w)#\w+")
INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]")
WORD = re.compile(r"[^\W_]+")
STRETCH = re.compile(r"[^\n\r.!?…]+(?:[.!?…]+(?=\S)[^\n\r.!?…]+)*[.!?…]*|[.!?…]+")
LEAST_CLAUSE = 0.06
LEAST_COVER = 0.35
LEAST_REPEATS = 3  # of a word by itself
RUN_REPEATS = 2  # of a run of words
LEAST_KEYWORD, LEAST_KEYWORD_SHARE = 4, 0.06
MANGLED = re.compile(r"[\u00c2\u00c3][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2122]")


class SuffixAutomaton:
    """Suffix automaton over a sequence, with the number of occurrences of each state's strings."""

    def __init__(self, seq: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        last = 0
        for c in seq:
            last = self._extend(last, c)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def _state(self, length: int, count: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.count.append(count)
        self.link.append(link)
        return len(self.link) - 1

    def _extend(self, last: int, c: int) -> int:
        cur, p = self._state(self.length[last] + 1, 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[q] != self.length[p] + 1:
                copy = self._state(self.length[p] + 1, 0, self.link[q], dict(self.next[q]))
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = copy
                    p = self.link[p]
                self.link[q] = copy
                q = copy
            self.link[cur] = q
        return cur

    def occurrences(self, seq: list[int]) -> int:
        """How often a sequence occurs."""
        s = 0
        for c in seq:
            if (s := self.next[s].get(c, -1)) < 0:
                return 0
        return self.count[s]

    def covered(self, seq: list[int], least: int, alone: int = 0) -> list[bool]:
        """Which positions lie in a maximal substring that occurs at least ``least`` times, or ``alone`` times if it is of one element."""
        out, s, n = [False] * len(seq), 0, 0
        reach = []
        for c in seq:
            while s and (c not in self.next[s] or self.count[self.next[s][c]] < least):
                s = self.link[s]
                n = self.length[s]
            t = self.next[s].get(c)
            if t is not None and self.count[t] >= least:
                s, n = t, n + 1
            else:
                s, n = 0, 0
            reach.append(n if n != 1 or self.count[s] >= alone else 0)
        left = 0
        for i in range(len(seq) - 1, -1, -1):
            left = max(left, reach[i])
            out[i] = left > 0
            left -= 1
        return out


def links(text: str) -> list[tuple[int, int]]:
    """(start, end) of every link with its label: from an opening tag to the next closing one of its kind, markdown links, bare addresses."""
    if "//" not in text and "[" not in text and "<" not in text and "www." not in text.lower():
        return []
    parts = list(LINK_PART.finditer(text))
    last = {m.lastgroup: i for i, m in enumerate(parts)}
    out, at = [], 0
    closing = {"a": "a_", "u": "u_"}
    pending: tuple[int, str] | None = None
    for i, m in enumerate(parts):
        kind = m.lastgroup
        if pending:
            if kind == pending[1]:
                out.append((pending[0], m.end()))
                pending, at = None, m.end()
        elif kind in closing:
            if last.get(closing[kind], -1) > i:
                pending = (m.start(), closing[kind])
        elif kind is None and m.start() >= at:
            out.append((m.start(), m.end()))
    return out


def _size(s: str) -> int:
    return len("".join(s.split()))


def _repeated(words: list[str]) -> set[str]:
    """Content words that a stretch holds more than once."""
    seen: set[str] = set()
    twice: set[str] = set()
    long = [w for w in words if len(w) >= 4]
    if len(set(long)) == len(long):
        return twice
    for w in long:
        if w not in CLAUSE_WORDS and not w.isdigit():
            (twice if w in seen else seen).add(w)
    return twice


def _phrase(stretch: str, words: list[str]) -> bool:
    """Whether a stretch may be a keyword phrase with glue: no sentence end, no clause word but glue, no figures but years (as in programmes and readings)."""
    if SENTENCE_END.search(stretch) or any(w in CLAUSE_WORDS and w not in GLUE for w in words):
        return False
    return not any(c.isdigit() for w in words if not YEAR.fullmatch(w) for c in w)


def _repair(m: re.Match) -> str:
    """Two characters that were one before UTF-8 was read as Windows-1252."""
    try:
        return m.group().encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return m.group().encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m.group()


def share(text: str | None, full: bool = True) -> float:
    """Share of the characters of a page, white space aside, that are stuffing; 0 to 1.

    Without ``full`` only whether it is more than a half is right, not the value.

    Accents are composed, entities decoded, broken accents repaired and invisible signs
    dropped first, so that words are words.
    """
    if text:
        text = unicodedata.normalize("NFC", text)
    if text and INVISIBLE.search(text):
        text = INVISIBLE.sub("", text)
    if text and "&" in text:
        text = html.unescape(text)
    if text and ("\u00c3" in text or "\u00c2" in text):
        text = MANGLED.sub(_repair, text)
    if not text or not (total := _size(text)):
        return 0.0
    counted = 0
    bare, strung = [], []  # (size, letters, words): without clause structure; (.., group): sentences that repeat a word, phrases with glue
    groups: list[list[str]] = [[]]  # words of neighbouring phrases
    rest = []
    at = 0
    for start, end in links(text):
        rest += [text[at:start], "\u0001"]
        counted += _size(text[start:end])
        at = end
    plain = "".join([*rest, text[at:]]) if at else text
    possible = counted
    for m in STRETCH.finditer(plain):
        s = m.group()
        tagged = "#" in s
        words = WORD.findall((HASHTAG.sub(" ", s) if tagged else s).lower())
        tags = sum(len(h) for h in HASHTAG.findall(s)) if tagged else 0
        counted += tags
        possible += tags
        letters = sum(map(len, words))
        if not words:
            if "\u0001" in s or tags:
                d = _size(s) - s.count("\u0001") - tags
                counted += d
                possible += d
            continue
        clause = sum(map(CLAUSE_WORDS.__contains__, words)) / len(words)
        whole = _size(s)
        if letters < 0.5 * whole or letters - sum(map(len, filter(str.isdigit, words))) < 0.5 * whole:
            continue
        size = whole - s.count("\u0001") - tags
        phrase = clause >= LEAST_CLAUSE and _phrase(s, words)
        if clause < LEAST_CLAUSE:
            possible += size
            if "\u0001" in s:
                counted += size  # the label of a link
            else:
                bare.append((size, letters, words))
        elif phrase:
            groups[-1].extend(words)
            strung.append((size, letters, words, len(groups) - 1))
        elif _repeated(words):
            strung.append((size, letters, words, -1))
        if clause >= LEAST_CLAUSE and not phrase and groups[-1]:
            groups.append([])
    again = [bool(_repeated(g)) for g in groups]
    strung = [x for x in strung if x[3] < 0 or again[x[3]]]
    possible += sum(x[0] for x in strung)
    if not full and (possible <= total / 2 or counted > total / 2) or not (bare or strung):
        return counted / total
    every = WORD.findall(plain.lower())
    count = Counter(every)
    often = lambda words, least: sum(len(w) for w in words if count[w] >= least)
    content = [[w for w in g if w not in CLAUSE_WORDS] for g in groups]
    again = [a and often(g, RUN_REPEATS) >= LEAST_COVER * sum(map(len, g)) for a, g in zip(again, content)]
    if bare and sum(often(w, RUN_REPEATS) for _, _, w in bare) < LEAST_COVER * sum(n for _, n, _ in bare):
        bare = []
    keyword = max(LEAST_KEYWORD, LEAST_KEYWORD_SHARE * len(every))

    def names_keyword(letters: int, words: list[str]) -> bool:
        return often(words, LEAST_REPEATS) >= LEAST_COVER * letters and any(count[w] >= keyword for w in _repeated(words))

    named = [names_keyword(n, w) for _, n, w, _ in strung]
    if bare or any(again):
        codes: dict[str, int] = {}
        automaton = SuffixAutomaton([codes.setdefault(w, len(codes)) for w in every])

    def hits(words: list[str]) -> list[bool]:
        return automaton.covered([codes.get(w, -1) for w in words], RUN_REPEATS, LEAST_REPEATS)

    def cover(words: list[str]) -> int:
        return sum(len(w) for w, h in zip(words, hits(words)) if h)

    def group_covered(words: list[str]) -> bool:
        content = [(len(w), h) for w, h in zip(words, hits(words)) if w not in CLAUSE_WORDS]
        return sum(n for n, h in content if h) >= LEAST_COVER * sum(n for n, _ in content)

    if bare and sum(cover(w) for _, _, w in bare) >= LEAST_COVER * sum(n for _, n, _ in bare):
        counted += sum(size for size, _, _ in bare)
    stuffed = [a and group_covered(g) for a, g in zip(again, groups)]
    for (size, _, _, group), keyed in zip(strung, named):
        if keyed or (group >= 0 and stuffed[group]):
            counted += size
    return counted / total


@F.arrow_udf(T.DoubleType())
def _share(text: pa.Array) -> pa.Array:
    return pa.array([share(t.as_py()) for t in text], pa.float64())


@F.arrow_udf(T.BooleanType())
def _stuffed(text: pa.Array) -> pa.Array:
    return pa.array([share(t.as_py(), full=False) > 0.5 for t in text], pa.bool_())


def stuffing_share(text: Column) -> Column:
    """See share; as a Column function."""
    return _share(text)


def is_stuffed(text: Column) -> Column:
    """Whether more than half of a page is stuffing; as a Column function."""
    return _stuffed(text)
