"""Problem 6: the same real event in two agendas that share no key.

Titles and venues are reduced to words. How telling a word is comes from the
two agendas themselves: its number of titles (or venues), where a misspelt word
counts as often as the word it was meant to be, so no list of common words is
needed. Candidates share the start date and one of the ``KEYS`` most telling
words of both titles, but for the slips that ``same_word`` allows; words within
slips of each other are found over the whole vocabulary by what is left of both
after as many deletions. On each candidate heuristic matching functions vote
+1, -1 or 0 on title and venue, or have nothing to vote on; equal vote patterns are counted by partial
aggregation, and a generative label model is fitted to the pattern counts (at
most 4 to the number of functions, whatever the number of candidates):
expectation maximisation learns from ``PRIORS`` how often each function is right
on matches and on others, and how far functions repeat one another, and
repeated evidence is weighted down. A pair's confidence is the posterior of its
pattern, and the posterior alone decides.

Defined cases: records without readable date or without any word in the title match
nothing; a missing venue abstains, so show and date decide; repeated captures
of an event give one pair; null titles match nothing; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mobilake.functions import instants as I

KEYS = 2  # most telling words of a title that candidates are found by
BLOCK = 2_000  # records of one date and word that one task pairs
KEPT = 20_000  # results that each cached function keeps, so that a worker does not grow with its rows
# Functions with the chances of voting +1, 0, -1 on matches and on other candidates that the model starts from.
PRIORS = {
    "telling": ((0.96, 0.035, 0.005), (0.15, 0.10, 0.75)),
    "share": ((0.90, 0.09, 0.01), (0.15, 0.25, 0.60)),
    "grams": ((0.85, 0.13, 0.02), (0.15, 0.35, 0.50)),
    "initial": ((0.95, 0.01, 0.04), (0.50, 0.01, 0.49)),
    "venue": ((0.94, 0.05, 0.01), (0.15, 0.10, 0.75)),
    "venue_grams": ((0.85, 0.13, 0.02), (0.15, 0.20, 0.65)),
}
NONE = 9  # a function that has nothing to vote on
FUNCTIONS = tuple(PRIORS)


_MARKS, _WORD = re.compile(r"[\u0300-\u036f]"), re.compile(r"([^\W_]+)(\.?)")


def plain(text: str | None) -> str:
    """Lower case without accents."""
    t = (text or "").lower()
    return t if t.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", t))


def words_of(text: str | None) -> tuple[str, ...]:
    """Distinct words, sorted; a single letter before a full stop keeps it, as it stands for a longer word."""
    return tuple(sorted({w if len(w) > 1 or end != "." else f"{w}." for w, end in _WORD.findall(plain(text))}))


@lru_cache(maxsize=KEPT)
def distance(a: str, b: str, most: int) -> int:
    """Edits, a swap of neighbours counting once, up to ``most`` (then most + 1)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before2, row_ = row, before, [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row_[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before2[j - 2] + 1)
            row_.append(v)
        before, row = last, row_
        if min(row) > most:
            return most + 1
    return row[-1]


@lru_cache(maxsize=KEPT)
def _letters(word: str) -> int:
    """Which letters a word holds, as bits."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) % 61)
    return bits


def same_word(a: str, b: str, long: int = 6) -> bool:
    """Equal but for one slip of the pen, or two in words of at least ``long`` letters."""
    if a == b:
        return True
    short = min(len(a), len(b))
    most = 2 if short >= long else 1 if short >= 4 else 0
    if not most or abs(len(a) - len(b)) > most or (_letters(a) ^ _letters(b)).bit_count() > 2 * most:
        return False  # a slip changes at most two letters
    return distance(*sorted((a, b)), most) <= most


def shortened(a: str, b: str) -> bool:
    """Whether one word is a short form of the other: its first letter and others of it, in order, at most four."""
    a, b = sorted((a.rstrip("."), b.rstrip(".")), key=len)
    if not a or len(a) > 4 or len(a) == len(b) or a[0] != b[0]:
        return False
    rest = iter(b)
    return all(c in rest for c in a)


# Words longer than DELETED are found by runs of RUN letters instead: two slips touch at most
# four letters in two places, which leaves a run of RUN untouched in every word from DELETED - 3 on.
DELETED, RUN = 26, 7


def slips(word: str) -> tuple[int, ...]:
    """Hashed keys of a word: any two words that ``same_word`` takes for one share a key."""
    out: set[str] = set()
    if len(word) >= DELETED - 3:
        out |= {f"~{word[i : i + RUN]}" for i in range(len(word) - RUN + 1)}
    if len(word) <= DELETED:
        level = {word}
        out |= level
        for _ in range(2 if len(word) >= 6 else 1 if len(word) >= 4 else 0):
            level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
            out |= level
    return tuple({crc32(k.encode()) for k in out})


Words = tuple[tuple[str, float], ...]  # words with their weight, most telling first


@lru_cache(maxsize=KEPT)
def read_words(text: str) -> Words:
    """Words as the plan carries them: "word=weight" joined by spaces."""
    return tuple((w, float(n)) for w, _, n in (x.rpartition("=") for x in text.split()))


@lru_cache(maxsize=KEPT)
def matched(a: Words, b: Words, short: bool = False) -> tuple[bool, ...]:
    """For each word of a whether b has it, but for slips (and short forms); no word of b serves twice."""
    left = [w for w, _ in b]
    out = []
    for x, _ in a:
        hit = x if x in left else next((y for y in left if same_word(x, y) or (short and shortened(x, y))), None)
        if hit is not None:
            left.remove(hit)
        out.append(hit is not None)
    return tuple(out)


def _share(a: Words, b: Words, short: bool = False) -> float:
    """Weight of the words in common, of the title or venue that has less of it."""
    def part(x: Words, y: Words) -> float:
        return sum(w for (_, w), h in zip(x, matched(x, y, short)) if h) / max(1e-9, sum(w for _, w in x))

    return max(part(a, b), part(b, a))


@lru_cache(maxsize=KEPT)
def _grams(words: Words) -> dict[str, float]:
    out: dict[str, float] = {}
    for w, weight in words:
        for i in range(max(1, len(w) - 2)):
            out[w[i : i + 3]] = max(out.get(w[i : i + 3], 0.0), weight)
    return out


def _gram_vote(a: Words, b: Words, high: float, low: float) -> int:
    x, y = _grams(a), _grams(b)
    both = sum(min(w, y[g]) for g, w in x.items() if g in y)
    j = both / max(1e-9, min(sum(x.values()), sum(y.values())))
    return 1 if j >= high else -1 if j <= low else 0


@lru_cache(maxsize=KEPT)
def title_votes(left: str, right: str) -> tuple[int, ...]:
    """Votes of telling, share, grams and initial, the last where a title has one."""
    a, b = read_words(left), read_words(right)
    x, y = matched(a, b), matched(b, a)
    ways = sum(all(h[:2]) for h in (x, y))  # sides whose most telling words the other has
    share = _share(a, b)
    initial = NONE
    for mine, other, own, hits in ((a, b, x, y), (b, a, y, x)):
        letters = {w[0] for w, _ in mine if len(w) == 2 and w.endswith(".")}
        full = [h for (w, _), h in zip(mine, own) if not w.endswith(".")]
        if letters and full and full[0]:
            rest = [w for (w, _), h in zip(other, hits) if not h]
            initial = 1 if any(w[0] in letters for w in rest[:2]) else -1
    if initial == 1:
        ways, share = 2, max(share, 0.8)
    return ways - 1, 1 if share >= 0.8 else -1 if share <= 0.6 else 0, _gram_vote(a, b, 0.65, 0.45), initial


@lru_cache(maxsize=KEPT)
def venue_votes(left: str | None, right: str | None) -> tuple[int, ...]:
    """Votes of venue and venue_grams; none where either is missing."""
    if not left or not right:
        return NONE, NONE
    a, b = read_words(left), read_words(right)
    share = _share(a, b, True)
    return 1 if share >= 0.8 else -1 if share <= 0.6 else 0, _gram_vote(a, b, 0.7, 0.5)


def fit(patterns: Mapping[tuple[int, ...], int], rounds: int = 60, priors: Mapping[str, tuple] = PRIORS, held: float = 0.5) -> dict[tuple[int, ...], float]:
    """Posterior of a match for each vote pattern: latent class model by expectation maximisation.

    Parameters start from ``priors`` and keep them as pseudo-counts (``held``
    of the candidates, and two hundred more). After some rounds the class-conditional
    correlations of the functions give each a weight below one, so that
    functions that repeat one another do not count as independent evidence.
    A function with nothing to vote on counts neither way.
    """
    if not patterns:
        return {}
    p = np.array(list(patterns), dtype=int)
    n = np.array([patterns[tuple(x)] for x in p.tolist()], dtype=float)
    onehot = np.stack([p == v for v in (1, 0, -1)], axis=2).astype(float)
    strength = held * n.sum() + 200
    base = np.array([[list(x[c]) for x in priors.values()] for c in (0, 1)])
    theta, share, weight = base.copy(), 0.3, np.full(p.shape[1], 0.6)
    for i in range(rounds):
        ll = np.einsum("pkv,ckv,k->pc", onehot, np.log(theta), weight) + np.log([share, 1 - share])
        q = 1 / (1 + np.exp(np.clip(ll[:, 1] - ll[:, 0], -500, 500)))
        share = float((q @ n + 0.3 * strength) / (n.sum() + strength))
        for c, w in enumerate((q * n, (1 - q) * n)):
            counts = np.einsum("p,pkv->kv", w, onehot) + strength * base[c]
            theta[c] = counts / counts.sum(axis=1, keepdims=True)
        if i >= 5:
            weight = 1 / (1 + _overlap(np.where(p == NONE, 0, p), n, q))
    return {tuple(x): float(v) for x, v in zip(p.tolist(), q)}


def _overlap(p: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum of squared class-conditional correlations of each function with the others."""
    out = np.zeros(p.shape[1])
    for w in (q * n, (1 - q) * n):
        if w.sum() <= 1:
            continue
        m = (w @ p) / w.sum()
        d = p - m
        cov = (d * w[:, None]).T @ d / w.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        out = np.maximum(out, ((cov / np.outer(sd, sd)) ** 2).sum(axis=1) - 1)
    return np.clip(out, 0, None)


@F.arrow_udf(T.StringType())
def _words(text: pa.Array) -> pa.Array:
    """The words of a text, sorted and joined by spaces; empty for none."""
    enc = text.combine_chunks().dictionary_encode() if isinstance(text, pa.ChunkedArray) else text.dictionary_encode()
    memo = pa.array([" ".join(words_of(t)) for t in enc.dictionary.to_pylist()] + [""], pa.string())
    return memo.take(pc.fill_null(enc.indices, len(memo) - 1))


@F.arrow_udf(T.StructType().add("keys", T.ArrayType(T.LongType())).add("letters", T.LongType()))
def _slips(word: pa.Array) -> pa.Array:
    words = word.to_pylist()
    return pa.StructArray.from_arrays([pa.array([slips(w) for w in words], pa.list_(pa.int64())), pa.array([_letters(w) for w in words], pa.int64())], names=["keys", "letters"])


@F.arrow_udf(T.BooleanType())
def _same_word(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([same_word(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


@F.arrow_udf(T.ArrayType(T.ByteType()))
def _votes(lt: pa.Array, rt: pa.Array, lv: pa.Array, rv: pa.Array) -> pa.Array:
    rows = zip(lt.to_pylist(), rt.to_pylist(), lv.to_pylist(), rv.to_pylist())
    return pa.array([title_votes(a, b) + venue_votes(c, d) for a, b, c, d in rows], pa.list_(pa.int8()))


def madrid_date(df: DataFrame, text: str, to: str, zone: str = "Europe/Madrid") -> DataFrame:
    """df plus the local date a text denotes; skipped and repeated times keep the date they were written with."""

    @F.arrow_udf(T.DateType())
    def date(texts: pa.Array) -> pa.Array:
        enc = texts.combine_chunks().dictionary_encode() if isinstance(texts, pa.ChunkedArray) else texts.dictionary_encode()
        days = []
        zoned = I.zone_of(zone)
        for t in enc.dictionary.to_pylist():
            form, wall, offset, region = I.parse_text(t)
            status, us, day = form, None, None
            if form in ("clock", "epoch"):
                status, us = ("ok", wall - offset * 60_000_000) if offset is not None else I.resolve_wall(wall, region or zone)
            try:
                if us is not None:
                    day = I.aware(us).astimezone(zoned).date()
                elif status in ("skipped", "repeated"):
                    day = I.aware(wall).date()
            except OverflowError:
                day = None
            days.append(day)
        return pa.array([days[i] if i is not None else None for i in enc.indices.to_pylist()], pa.date32())

    return df.withColumn(to, date(F.col(text).cast("string")))


def records(df: DataFrame, key: str, title: Column, venue: Column, date: Column) -> DataFrame:
    """(key, date, title, venue) of the records that can match, once each; title and venue as their words joined by spaces."""
    d = df.select(F.col(key).alias("key"), date.alias("date"), _words(title).alias("title"), _words(venue).alias("venue"))
    return d.where(F.col("key").isNotNull() & F.col("date").isNotNull() & (F.col("title") != "")).distinct()


def _near_words(vocabulary: DataFrame) -> DataFrame:
    """(w, u): words of the vocabulary (word, n) that are one but for slips, each with itself as well."""
    k = vocabulary.select("word", _slips(F.col("word")).alias("s")).select("word", "s.letters", F.explode("s.keys").alias("k"))
    a, b = (k.select(F.col("word").alias(x), F.col("letters").alias(f"{x}l"), "k") for x in ("w", "u"))
    # two slips change at most four letters and two in length
    alike = (F.bit_count(F.col("wl").bitwiseXOR(F.col("ul"))) <= 4) & (F.abs(F.length("w") - F.length("u")) <= 2)
    apart = a.join(b.hint("merge"), "k").where("w < u").where(alike).select("w", "u").distinct().where(_same_word(F.col("w"), F.col("u")))
    return apart.unionByName(apart.select(F.col("u").alias("w"), F.col("w").alias("u"))).unionByName(vocabulary.select(F.col("word").alias("w"), F.col("word").alias("u")))


def _weighed(lists: DataFrame, vocabulary: DataFrame, near: DataFrame, total: int) -> DataFrame:
    """(words, weighed): each distinct text with its words and weights, most telling first.

    A word's weight is the square of the logarithm of how rare it is; a
    misspelt word is as common as the commonest word it may stand for.
    """
    common = near.join(vocabulary.select(F.col("word").alias("u"), "n").hint("merge"), "u").groupBy("w").agg(F.max("n").alias("n"))
    e = lists.select("words", F.explode(F.split("words", " ")).alias("w")).join(common.hint("merge"), "w")
    weight = F.pow(F.log(F.lit(float(total) + 1.0) / F.col("n")) + 0.1, 2)
    by = e.groupBy("words").agg(F.sort_array(F.collect_list(F.struct((-weight).alias("o"), F.col("w")))).alias("x"))
    return by.select("words", F.array_join(F.transform("x", lambda x: F.concat(x["w"], F.lit("="), F.format_string("%.4f", -x["o"]))), " ").alias("weighed"), F.slice(F.transform("x", lambda x: x["w"]), 1, KEYS).alias("keys"))


def link(left: DataFrame, right: DataFrame, store=lambda df, name: df, least: float = 0.5, block: int = BLOCK) -> DataFrame:  # noqa: ANN001
    """(left_key, right_key, confidence) of all pairs with a confidence of at least ``least``.

    left, right: see ``records``. ``store`` keeps tables that are read more
    than once. Titles, venues and classes of equal records are handled once
    each, however many records bear them. Sides that grow with the records are
    merged, never broadcast: Spark takes a stored table for as large as its
    compressed file, also after its lists are exploded.
    """
    left, right = store(left, "left"), store(right, "right")
    both = left.select("title", "venue").unionByName(right.select("title", "venue"))

    def weighed(c: str, name: str) -> tuple[DataFrame, DataFrame]:
        lists = store(both.select(F.col(c).alias("words")).where("words <> ''").distinct(), f"{name}-lists")
        v = store(lists.select(F.explode(F.split("words", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), f"{name}-words")
        near = store(_near_words(v), f"{name}-near")
        return store(_weighed(lists, v, near, lists.count()), name), near

    (titles, near), (venues, _) = weighed("title", "titles"), weighed("venue", "venues")

    def classes(d: DataFrame, x: str) -> DataFrame:
        c = d.select("date", "title", "venue").distinct()
        return c.join(titles.select(F.col("words").alias("title"), "keys").hint("merge"), "title").select("date", F.col("title").alias(f"{x}t"), F.col("venue").alias(f"{x}v"), F.explode("keys").alias("k"))

    a, b = store(classes(left, "l"), "l-keys"), store(classes(right, "r"), "r-keys")
    # which words of a date meet is settled before any title is carried along
    meet = a.select("date", F.col("k").alias("w")).distinct().join(near.hint("merge"), "w").join(b.select("date", F.col("k").alias("u")).distinct().hint("merge"), ["date", "u"])
    b = meet.join(b.withColumnRenamed("k", "u").hint("merge"), ["date", "u"]).select("date", F.col("w").alias("k"), "rt", "rv").distinct()
    # a date and word with many records is split: one side spread over parts, the other copied to each
    hot = a.groupBy("date", "k").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block).select("date", "k", F.ceil(F.col("m") / block).cast("int").alias("parts"))
    part = lambda d: d.join(hot, ["date", "k"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = part(a).withColumn("part", F.pmod(F.xxhash64("lt", "lv"), F.col("parts")).cast("int")).drop("parts")
    b = part(b).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    cand = a.join(b.hint("merge"), ["date", "k", "part"]).select("date", "lt", "lv", "rt", "rv").distinct()
    word = lambda t, c, to: t.select(F.col("words").alias(c), F.col("weighed").alias(to)).hint("merge")
    cand = cand.join(word(titles, "lt", "a"), "lt").join(word(titles, "rt", "b"), "rt").join(word(venues, "lv", "c"), "lv", "left").join(word(venues, "rv", "d"), "rv", "left")
    cand = store(cand.select("date", "lt", "lv", "rt", "rv", _votes("a", "b", "c", "d").alias("vote")), "candidates")
    counts = {tuple(r["vote"]): r["n"] for r in cand.groupBy("vote").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior = fit(counts)
    table = [x for k, v in posterior.items() if v >= least for x in (F.lit(",".join(map(str, k))), F.lit(v))]
    score = F.try_element_at(F.create_map(*table), F.array_join(F.col("vote").cast("array<string>"), ",")) if table else F.lit(None).cast("double")
    hits = cand.select("date", "lt", "lv", "rt", "rv", score.alias("confidence")).where(F.col("confidence").isNotNull())
    keyed = lambda d, x: d.select("date", F.col("title").alias(f"{x}t"), F.col("venue").alias(f"{x}v"), F.col("key").alias(f"{x}k")).hint("merge")
    out = hits.join(keyed(left, "l"), ["date", "lt", "lv"]).join(keyed(right, "r"), ["date", "rt", "rv"])
    return out.groupBy(F.col("lk").alias("left_key"), F.col("rk").alias("right_key")).agg(F.max("confidence").alias("confidence"))
