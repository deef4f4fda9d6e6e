"""Abusive, hateful or sexual content, by a counterfactually regularised classifier.

Documents are read as passages (sentences and lines) in plain spelling: digits read as letters
where a passage mixes them, letters set apart joined, repeated letters reduced, starred words
filled in from the vocabulary. A linear model over words and word pairs scores each passage, a
document has the score of its worst one.

The model is fitted on a bounded sample of the labelled documents. Labels name documents, not
passages, and some are wrong, so it is fitted in rounds: the worst passage of a positive document
stands for it, documents that contradict the last round clearly are left out of the next. In the
passages that mention a group of people, the mention is swapped for other groups and for a neutral
word, and differences of the score are penalised: a mention as such must not count. Groups that the
sample names beside the known ones are found by the form of their names.

Then the whole corpus adds words that the sample does not know: Spark counts, over all documents,
in how many of the abusive ones a word stands in an abusive passage, and in how many documents at
all. Words that are much oftener in the former get a weight by that proportion.

Scoring runs in Spark over all documents, in Arrow batches, with the model sent to the tasks; its
size is bounded by the sample and by the share of abusive documents that an added word needs.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import checkpointed, ship_package, spread

#: Labelled documents that are used at most; of more, those with the least hash of their id.
MAX_LABELLED = 20_000
#: Documents of the sample of which the words are found at once.
_READ_AT_ONCE = 500
#: Documents of the sample that a word has to occur in, and passages that a pair has to, at any size
#: of the sample; features as rare as that are damped by ``rare_ridge``.
LEAST = 2

#: Names of groups of people, as sequences of words, that must not count as such. Those
#: that a sample has besides are found by ``group_names``.
IDENTITIES = (
    "women", "men", "girls", "boys", "jews", "muslims", "christians", "hindus", "buddhists", "atheists", "catholics",
    "gays", "lesbians", "blacks", "whites", "asians", "africans", "arabs", "americans", "germans", "frauen", "juden",
    "muslime", "mujeres", "judios", "musulmanes", "femmes", "juifs", "musulmans", "immigrants", "refugees",
)
#: How a group is named in running text: a name in capitals with a noun for many people
#: behind it, or in the plural behind a word for all of them.
_COLLECTIVE = "people|peoples|folk|clan|clans|tribe|tribes|speakers|believers|followers|worshippers|community"
_GROUP_NAME = re.compile(
    rf"\b([A-Z][a-z]+(?: [a-z]+)? (?:{_COLLECTIVE}))\b|"
    r"(?<=[a-z,] )(?:(?:all|those|these|the|many|some|alle|die|todos los|los|tous les|les) )([A-Z][a-z]+(?: [A-Z][a-z]+)?(?:ians|ans|ites|ers|ish|ari|ese|ians))\b"
)
#: Share of the abusive documents that an added word has to be in, how much oftener than elsewhere it
#: has to be there (as a logarithm), and the part of that which becomes its weight.
ADDED_SHARE, ADDED_ODDS, ADDED_WEIGHT = 0.0005, 3.0, 0.3
#: What stands for a group where no group is meant.
NEUTRAL = "authors"

#: Digits and signs read as letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a"})
_MIXED = re.compile(r"[a-z][013457$]+[a-z]")
_APART = re.compile(r"(?<![^\W_])[^\W\d_]([ .\-_])[^\W\d_](?:\1[^\W\d_])+(?![^\W_])")
_MAY_BE_APART = re.compile(r"[ .\-_][a-zß-ÿ][ .\-_][a-zß-ÿ](?![a-zß-ÿ])")
_REPEATED = re.compile(r"([^\W\d_])\1\1+")
_MAY_BE_REPEATED = re.compile(r"([a-z])\1\1")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
#: Words, and what ends a passage; the second form also takes words with stars in them.
_TOKEN = re.compile(r"[^\W\d_]+|[.!?:;\n]")
_STARRED = re.compile(r"(?:\*(?=[^\W\d_]))?[^\W\d_](?:[^\W\d_]|\*)*|[.!?:;\n]")
_BREAKS = frozenset(".!?\n:;")
_END = 0  # number of what ends a passage
_OTHER = 1  # number of words that the model does not know


def _lower(text: str) -> str:
    """A text in lower case, without invisible characters."""
    t = text.lower()
    return t if t.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", t))


def _spelled(t: str) -> str:
    """A text in lower case in plain spelling."""
    if _MIXED.search(t):
        t = "".join(p.translate(_LEET) if _MIXED.search(p) else p for p in re.split(r"((?<=[.!?:])\s+|\n)", t))
    if _MAY_BE_APART.search(t):
        t = _APART.sub(lambda m: m[0].replace(m[1], ""), t)
    if _MAY_BE_REPEATED.search(t):
        t = _REPEATED.sub(r"\1", t)
    return t


def _plain(text: str) -> str:
    """A text in lower case and plain spelling."""
    return _spelled(_lower(text))


#: Classes of characters in the three expressions that ``_spelled`` searches for, which name none beyond Latin-1.
_A_Z, _LETTER, _BLANK, _DIGIT = 1, 2, 4, 8
_FORMS = {_A_Z: "[a-z]", _LETTER: "[a-zß-ÿ]", _BLANK: r"[ .\-_]", _DIGIT: "[013457$]"}
_CLASSES = np.array([sum(c for c, form in _FORMS.items() if re.match(form, chr(k))) for k in range(256)], dtype=np.uint8)
#: Characters, about, that are looked at together.
_LOOK_AT = 1 << 18


def _not_plain(lower: list[str]) -> set[int]:
    """Which of some texts in lower case ``_spelled`` may change: those in which any of its three
    expressions is found, looked for in many texts at once."""
    out: set[int] = set()
    begin = 0
    while begin < len(lower):
        end, size = begin, 0
        while end < len(lower) and size < _LOOK_AT:
            size += len(lower[end]) + 1
            end += 1
        # A line end, which is in no class, stands before and behind each text; what Latin-1 has not is a question mark.
        b = np.frombuffer("\n".join(["", *lower[begin:end], "\n\n\n"]).encode("latin-1", "replace"), dtype=np.uint8)
        c = _CLASSES[b]
        x = c & _LETTER != 0
        blank = c & _BLANK != 0
        digit = c & _DIGIT != 0
        same = b[:-1] == b[1:]
        edges = np.flatnonzero(digit[1:] != digit[:-1])  # before the first and at the last of each run
        first, last = edges[::2], edges[1::2]
        found = [
            np.flatnonzero(same[:-1] & same[1:] & (c[:-2] & _A_Z != 0)),
            np.flatnonzero(blank[:-4] & x[1:-3] & blank[2:-2] & x[3:-1] & ~x[4:]),
            first[c[first] & c[last + 1] & _A_Z != 0],
        ]
        starts = np.cumsum([1, *(len(t) + 1 for t in lower[begin : end - 1])])
        out.update((begin + np.searchsorted(starts, np.unique(np.concatenate(found)), "right") - 1).tolist())
        begin = end
    return out


#: ASCII letters stay, what ends a passage becomes a stop, all else a blank; in texts with stars these stay too.
_ASCII = {k: chr(k) if chr(k).isalpha() else "." if chr(k) in _BREAKS else " " for k in range(128)}
_ASCII_STARRED = _ASCII | {ord("*"): "*"}


def _tokens(plain: str, starred: bool) -> list[str]:
    """The words of a text in plain spelling; ``starred``: the text as it was has stars."""
    if not plain.isascii():
        return (_STARRED if starred else _TOKEN).findall(plain)
    # The same words as by the expressions, found faster.
    out = plain.translate(_ASCII_STARRED if starred else _ASCII).replace(".", " . ").split()
    if starred and "*" in plain:
        return [w for x in out for w in (_STARRED.findall(x) if "*" in x else (x,))]
    return out


def tokens_of(text: str) -> list[str]:
    """The words of a text in plain spelling, with marks between them that end passages."""
    return _tokens(_plain(text), "*" in text)


def tokens_of_all(texts: list[str | None]) -> list[list[str]]:
    """``tokens_of`` each text; a null text has none."""
    lower = [_lower(t) if t else "" for t in texts]
    change = _not_plain(lower)
    return [_tokens(_spelled(x) if k in change else x, "*" in t) if t else [] for k, (t, x) in enumerate(zip(texts, lower))]


def _filled(word: str, words: dict[str, int], stars: dict[str, int]) -> int:
    """The number of a word with stars: as a shape of a known word, or without stars around it."""
    return stars.get(word) or words.get(word.strip("*"), _OTHER)


def _shapes(word: str) -> set[str]:
    """How a word looks with stars: without its vowels, or with its ends only."""
    ends = {word[0] + "*" * (len(word) - 2) + word[-1], word[0] + "*" * (len(word) - 1)}
    return ends | {re.sub("[aeiouyäöüáéíóúàèâêîôûœ]", "*", word), re.sub("(?<=.)[aeiouyäöüáéíóúàèâêîôûœ](?=.)", "*", word)}


@dataclass
class Model:
    """Numbers of words, numbers of word pairs, and their weights."""

    words: dict[str, int]  # also the marks that end passages, as 0
    stars: dict[str, int]
    pairs: np.ndarray  # sorted keys of the pairs
    word_weights: np.ndarray
    pair_weights: np.ndarray
    bias: float
    threshold: float

    def numbers(self, text: str, tokens: list[str]) -> list[int]:
        out = list(map(self.words.get, tokens, repeat(_OTHER)))
        if "*" in text:
            out = [_filled(x, self.words, self.stars) if n == _OTHER and "*" in x else n for x, n in zip(tokens, out)]
        return out

    def unknown_words(self, tokens: list[str]) -> list[str]:
        """The words of the abusive passages of a text that the model does not know, each once."""
        out, now = set(), []
        for word in [*tokens, "."]:
            if word not in _BREAKS:
                now.append(word)
                continue
            new = {w for w in now if w not in self.words and "*" not in w}
            if new and self.scores([" ".join(now)])[0] >= self.threshold:
                out |= new
            now = []
        return sorted(out)

    def with_words(self, weights: dict[str, float]) -> Model:
        """The model with further words, which pairs do not know."""
        words, stars = dict(self.words), dict(self.stars)
        for k, word in enumerate(sorted(weights)):
            words[word] = len(self.word_weights) + k
            for s in _shapes(word) if len(word) > 2 else ():
                stars.setdefault(s, words[word])
        more = np.array([weights[w] for w in sorted(weights)])
        return Model(words, stars, self.pairs, np.concatenate([self.word_weights, more]), self.pair_weights, self.bias, self.threshold)

    def scores(self, texts: list[str | None], tokens: list[list[str]] | None = None) -> np.ndarray:
        """The score of each text, between 0 and 1: that of its worst passage. ``tokens`` are the words of
        the texts where the caller has them."""
        parts, sizes = [], []
        for t, own in zip(texts, tokens_of_all(texts) if tokens is None else tokens):
            ids = self.numbers(t, own) if t else []
            ids.append(_END)
            parts.extend(ids)
            sizes.append(len(ids))
        if not sizes:
            return np.zeros(0)
        ids = np.array(parts, dtype=np.int64)
        value = self.word_weights[ids]
        key = (ids[:-1] << 32) | ids[1:]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            value[1:] += np.where(self.pairs[at] == key, self.pair_weights[at], 0.0)
        total = np.cumsum(value)
        ends = np.flatnonzero(ids == _END)
        passage = np.diff(total[ends], prepend=0.0)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        worst = np.maximum.reduceat(passage, np.searchsorted(ends, first))
        return 1.0 / (1.0 + np.exp(-np.clip(worst + self.bias, -40, 40)))


def _bags(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Passages of documents as (document, its numbers) without the marks; each passage once a document."""
    docs, out = [], []
    for d, ids in enumerate(lists):
        seen, now = set(), []
        for n in [*ids, _END]:
            if n != _END:
                now.append(n)
            elif now:
                seen.add(tuple(now))
                now = []
        docs.extend([d] * len(seen))
        out.extend(seen)
    return np.array(docs, dtype=np.int64), out


class _Features:
    """Words and pairs of passages as one sparse 0/1 matrix (row and column numbers)."""

    def __init__(self, passages: list[tuple[int, ...]], n_words: int, least: int, pairs: np.ndarray | None = None):
        rows = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
        ids = np.fromiter((n for p in passages for n in p), dtype=np.int64, count=len(rows))
        same = rows[:-1] == rows[1:]
        keys = ((ids[:-1] << 32) | ids[1:])[same]
        known = (ids[:-1][same] != _OTHER) & (ids[1:][same] != _OTHER)
        keys, of = keys[known], rows[1:][same][known]
        if pairs is None:
            pairs, n = np.unique(keys, return_counts=True)
            pairs = pairs[n >= least]
        at = np.searchsorted(pairs, keys)
        hit = at < len(pairs)
        hit[hit] = pairs[at[hit]] == keys[hit]
        self.pairs, self.n = pairs, n_words + len(pairs)
        self.rows = np.concatenate([rows, of[hit]])
        self.cols = np.concatenate([ids, n_words + at[hit]])
        self.size = len(passages)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], minlength=self.size)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, v[self.rows], minlength=self.n)


def _swaps(passages: list[tuple[int, ...]], groups: list[tuple[int, ...]], neutral: int, rng) -> tuple[list, list]:
    """Passages that mention a group, and the same with another group or the neutral word instead."""
    starts: dict[int, list[tuple[int, ...]]] = {}
    for g in groups:
        starts.setdefault(g[0], []).append(g)
    a, b = [], []
    for p in passages:
        for i, n in enumerate(p):
            for g in starts.get(n, ()):
                if p[i : i + len(g)] == g:
                    others = [groups[k] for k in rng.choice(len(groups), size=min(3, len(groups)), replace=False)]
                    for other in [*others, (neutral,)]:
                        a.append(p)
                        b.append(p[:i] + other + p[i + len(g) :])
    return a, b


@dataclass
class Sample:
    """Labelled documents as passages over the words and pairs that are features."""

    words: dict[str, int]
    stars: dict[str, int]
    n_words: int
    toxic: np.ndarray
    docs: np.ndarray  # document of each passage
    bags: list[tuple[int, ...]]
    features: _Features

    def empty_model(self) -> Model:
        """The model that scores every text as 0."""
        return Model(self.words, self.stars, np.zeros(0, dtype=np.int64), np.zeros(self.n_words), np.zeros(0), -9.0, 0.5)


def prepare(texts: list[str], toxic: list[int], identities: tuple[str, ...] = IDENTITIES) -> Sample:
    """Read labelled documents; every word of two documents and pair of two passages is a feature."""
    # Equal words are one object, so that the sample's words take a few times less memory.
    one: dict[str, str] = {}
    tokens = [[one.setdefault(w, w) for w in x] for k in range(0, len(texts), _READ_AT_ONCE) for x in tokens_of_all(texts[k : k + _READ_AT_ONCE])]
    words: dict[str, int] = {}
    for w, n in sorted(Counter(w for x in tokens for w in set(x)).items()):
        if n >= LEAST and w not in _BREAKS and "*" not in w:
            words.setdefault(w, len(words) + 2)
    for g in (*identities, NEUTRAL):
        for w in g.split():
            words.setdefault(w, len(words) + 2)
    stars: dict[str, int] = {}
    for w, n in words.items():
        if len(w) > 2:
            for s in _shapes(w):
                stars.setdefault(s, n)
    n_words = len(words) + 2
    words |= dict.fromkeys(_BREAKS, _END)
    docs, bags = _bags([[_filled(w, words, stars) if "*" in w else words.get(w, _OTHER) for w in x] for x in tokens])
    return Sample(words, stars, n_words, np.array(toxic, dtype=float), docs, bags, _Features(bags, n_words, LEAST))


def fit(
    sample: Sample,
    identities: tuple[str, ...] = IDENTITIES,
    rounds: int = 4,
    steps: int = 60,
    ridge: float = 0.02,
    rare_ridge: float = 5.0,
    fairness: float = 1.0,
    seed: int = 7,
) -> Model:
    """Fit the model on a sample; ``fairness`` weighs the penalty on swapped mentions.

    Without positive or without negative documents the model scores every text as 0.
    """
    rng = np.random.default_rng(seed)
    y, docs, x, words = sample.toxic, sample.docs, sample.features, sample.words
    n_words = sample.n_words
    if not 0 < y.sum() < len(y) or not (y == 0)[docs].any():  # no negative document has words
        return sample.empty_model()
    groups = [g for g in (tuple(words[w] for w in name.split()) for name in identities)]
    before, after = _swaps(sample.bags, groups, words[NEUTRAL], rng)
    left, right = _Features(before, n_words, LEAST, x.pairs), _Features(after, n_words, LEAST, x.pairs)

    # Weights of features that few passages have are held near zero.
    shrink = ridge / 100 * (1 + rare_ridge / np.maximum(1.0, x.back(np.ones(x.size))))

    # The first guess: how much oftener a feature is in passages of positive documents.
    pos = y[docs] > 0
    here, there = x.back(pos.astype(float)) + 0.5, x.back((~pos).astype(float)) + 0.5
    w = np.log(here / (pos.sum() + 1)) - np.log(there / ((~pos).sum() + 1))
    w = np.where(here + there < 3, 0.0, w) / 4
    w[_OTHER] = 0
    bias = -2.0
    calm = y == 0
    for r in range(rounds):
        score = x.dot(w)
        worst = np.full(len(y), -np.inf)
        np.maximum.at(worst, docs, score)
        # What a positive document has to exceed to be believed: nearly all documents labelled as negative.
        bar = np.quantile(worst[calm & np.isfinite(worst)], (0.95, 0.97, 0.98, 0.985)[min(r, 3)])
        if r:  # and the score above which positive labels prevail
            order = np.argsort(-worst, kind="stable")
            lead = np.cumsum(np.where(y[order] > 0, 1, -1))
            bar = max(bar, worst[order][int(np.argmax(lead))] - 1e-9)
        believed = (y > 0) & (worst > bar)
        witness = pos & believed[docs] & (score >= np.minimum(worst[docs], bar + 0.7 * (worst[docs] - bar)) - 1e-9)
        use = witness | ~pos
        if not witness.any():
            break
        trust = np.ones(len(docs))
        if r:  # passages of negative documents that look abusive weigh more
            trust *= 0.05 + 1 / (1 + np.exp(-np.clip(score + bias, -30, 30)))
        weight = np.where(witness, 0.5 / witness.sum(), np.where(use, 0.5 * trust / max(1.0, trust[use & ~witness].sum()), 0.0))
        target = witness.astype(float)
        w, bias = np.zeros(x.n), -1.0
        m1, m2, b1, b2 = np.zeros(x.n), np.zeros(x.n), 0.0, 0.0
        norm = weight.sum()
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -30, 30)))
            e = weight * (p - target) / norm
            g = x.back(e) + shrink * w
            if left.size:
                gap = (left.dot(w) - right.dot(w)) / left.size
                g += 2 * fairness * (left.back(gap) - right.back(gap))
            g[_OTHER] = 0
            gb = e.sum()
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
            rate = 0.25 * (1 - t / (steps + 1))
            w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
            bias -= rate * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-8)
    score = x.dot(w)
    worst = np.full(len(y), -np.inf)
    np.maximum.at(worst, docs, score)
    p = 1 / (1 + np.exp(-np.clip(worst + bias, -30, 30)))
    return Model(words, sample.stars, x.pairs, w[:n_words], w[n_words:], float(bias), _best_threshold(p, y))


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """A threshold at which nearly as many labels are met as at the best one (some labels are wrong,
    so that the very best is no better founded), nearer to the highest such threshold than to the lowest."""
    cuts = np.linspace(0.05, 0.95, 91)
    met = np.array([((p >= c) == (y > 0)).sum() for c in cuts])
    good = cuts[met >= met.max() - max(0.5, 0.001 * len(y))]
    return float(0.3 * good.min() + 0.7 * good.max())


def labelled_sample(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """``text, toxic`` of labelled documents: null labels are left out, several labels of one
    document count by their majority, ties are left out. Of more than ``max_rows`` documents those
    with the least hash of their id are taken, the same ones at every run. The ids are broadcast, so
    that no text is shuffled; there are ``max_rows`` of them at most."""
    votes = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.avg(F.col("toxic").cast("double")).alias("share"))
        .where("share != 0.5")
        .select("doc_id", (F.col("share") > 0.5).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    return documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(votes), "doc_id").select("doc_id", "text", "toxic")


def group_names(texts: list[str], least: int = LEAST) -> tuple[str, ...]:
    """Names of groups of people, by their form, in lower case, that ``least`` of the texts have."""
    found = Counter(name for t in texts for name in {(m[1] or m[2]).lower() for m in _GROUP_NAME.finditer(t or "")})
    return tuple(sorted(name for name, n in found.items() if n >= least))


def added_words(documents: DataFrame, model: Model) -> dict[str, float]:
    """Weights of words that the model does not know, from counts over all documents.

    Tasks count their unknown words, those of abusive passages apart, so what is shuffled are the
    words of each task. A word needs a share of all abusive documents, so there are as many words at
    most as passages have, divided by it.
    """
    spark = documents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        here, there = Counter(), Counter()  # documents with a word, and with it in an abusive passage
        n_all = n_abusive = 0
        for batch in batches:
            texts = batch["text"].tolist()
            tokens = tokens_of_all(texts)
            for x, score in zip(tokens, model.scores(texts, tokens)):
                here.update(set(x).difference(model.words))
                if score >= model.threshold:
                    n_abusive += 1
                    there.update(model.unknown_words(x))
            n_all += len(texts)
        # "" stands for the documents themselves.
        yield pd.DataFrame({"word": [*here, ""], "k": [*(there[w] for w in here), n_abusive], "n": [*here.values(), n_all]})

    counted = spread(documents.select("text")).mapInPandas(count, "word string, k bigint, n bigint").groupBy("word").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    counted = checkpointed(counted.where("k > 0 OR word = ''"))
    whole = counted.where("word = ''").first()
    n_abusive, n_documents = (whole["k"], whole["n"]) if whole else (0, 0)
    out = {}
    for r in counted.where((F.col("word") != "") & (F.col("k") >= max(LEAST, ADDED_SHARE * n_abusive))).collect():
        odds = np.log((r["k"] + 0.5) / (n_abusive + 1)) - np.log((r["n"] - r["k"] + 0.5) / (n_documents - n_abusive + 1))
        if odds >= ADDED_ODDS:
            out[r["word"]] = ADDED_WEIGHT * float(odds)
    return out


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED, **options) -> Model:
    """Fit the model on at most ``max_rows`` labelled documents, and add words of all documents."""
    rows = sorted(labelled_sample(documents, labels, max_rows).collect())
    texts, toxic = [r["text"] for r in rows], [r["toxic"] for r in rows]
    identities = (*IDENTITIES, *(n for n in group_names(texts) if n not in IDENTITIES))
    sample = prepare(texts, toxic, identities)
    model = fit(sample, identities, **options)
    return model.with_words(added_words(documents, model)) if model.bias > -9 else model


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, source, score, abusive`` of every row of ``documents``; null and empty texts have
    the score of a passage without words. Copies and repeated rows have the same score."""
    ship_package(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()))

    scored = spread(documents.select("doc_id", "source", "text")).select("doc_id", "source", F.pandas_udf(score, "double")("text").alias("score"))
    return scored.withColumn("abusive", F.col("score") >= F.lit(model.threshold))


def abuse_rates(scored: DataFrame) -> DataFrame:
    """Documents, abusive documents and their share by source; a null source is a source of its own."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum(F.col("abusive").cast("bigint")).alias("n_abusive"),
        F.avg(F.col("abusive").cast("double")).alias("rate"),
    )
