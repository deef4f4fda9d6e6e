"""Evaluation texts that leaked into training text, by greedy string tiling.

Both sides become words: text is unescaped, stripped of marks and invisible characters, and read
in lower case, so spelling, markup, quoting and line breaks do not matter. Evaluation items are
indexed by their seeds, Karp-Rabin hashes of three neighbouring words. The index goes to all tasks;
its size is bounded, and a larger benchmark is taken in blocks, each a pass over the documents. A
document's seeds are looked up in it; for every item of which the found seeds cover as many words
as a leak needs, the longest common runs are marked one after another without overlap (the seeds
that lie on one diagonal are one run), what an earlier mark leaves of a run is tried again, and
runs that follow each other in both texts with small gaps are chained. Words of an item that appear
in another order give no chain. An item leaked if its best chain covers a third of its own words;
the opening that several items share is not its own. Which openings are shared and which words are
rare is counted by Spark over all items.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import checkpointed, ship_package, spread

#: Words of all items of one block, about, that go to the tasks at once.
BLOCK_WORDS = 2_000_000
#: Words of a seed, the shortest run that counts.
SEED = 3
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Words that may differ, be missing or be added between two runs of a chain.
GAP = 4
#: Share of the words between the ends of a chain that must be in its runs.
MATCHED = 0.6
#: A word is rare if so many items have it at most.
RARE_ITEMS = 2
#: An opening counts as shared if so many items have it, of so many words at least; more of it does
#: if that share of them goes on with it.
SHARED_ITEMS, SHARED_WORDS, SHARED_SHARE = 3, 8, 0.6

_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})|\\([nrt\"'/\\])")
_TAG = re.compile(r"</?(?:b|i|u|em|strong|code|pre|p|br|span|div|li|ul|ol|td|tr|th|table|a|h[1-6]|mark|sub|sup)\b[^<>]{0,200}>", re.I)
_QUOTES = "'’‘`´"
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """The words of a text as they are compared."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1], 16)) if m[1] else " " if m[2] in "nrt" else m[2], text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    for mark in _QUOTES:
        if mark in text:
            text = text.replace(mark, "")
    return _WORDS.findall(text.lower())


@dataclass
class SeedIndex:
    """Own words of the items of one block as numbers, and where each seed occurs."""

    vocabulary: dict[str, int]
    items: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted hashes of SEED words
    owner: np.ndarray  # item of each seed, by position in ``items``
    place: np.ndarray  # first word of each seed in its item
    rare: list[np.ndarray]  # for each item, which of its words at most RARE_ITEMS items have


def _hashes(words: np.ndarray) -> np.ndarray:
    """The Karp-Rabin hash of every SEED neighbouring words, from running hashes of the whole text:
    h(i+1) = h(i) * BASE + word, and a window is h(i+SEED) - h(i) * BASE^SEED, all modulo 2^64."""
    n = max(0, len(words) - SEED + 1)
    out = np.zeros(n, dtype=np.uint64)
    x = (words.astype(np.uint64) + np.uint64(1)) * _SPREAD
    for k in range(SEED):  # the same sums, a word of all windows at a time
        out = out * _BASE + x[k : k + n]
    return out


def index_block(items: list[tuple[int, list[str], list[bool]]]) -> SeedIndex:
    """The index of items given as (id, own words, which of them are rare)."""
    vocabulary: dict[str, int] = {}
    ids, words, rare, seeds, owner, place = [], [], [], [], [], []
    for item_id, own, is_rare in items:
        w = np.array([vocabulary.setdefault(x, len(vocabulary)) for x in own], dtype=np.int64)
        seeds.append(_hashes(w))
        owner.append(np.full(len(seeds[-1]), len(ids)))
        place.append(np.arange(len(seeds[-1])))
        ids.append(item_id)
        words.append(w)
        rare.append(np.array(is_rare, dtype=bool))
    flat = np.concatenate(seeds) if seeds else np.zeros(0, dtype=np.uint64)
    order = np.argsort(flat, kind="stable")
    whole = lambda x: np.concatenate(x)[order] if x else np.zeros(0, dtype=np.int64)
    return SeedIndex(vocabulary, ids, words, flat[order], whole(owner), whole(place), rare)


def _tiles(at: list[int], place: list[int], n_words: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document position, item position, length) of the common runs, the longest
    marked first. A run of which an earlier tile holds words goes back into the queue in the parts
    that are left. No word of either side is in two tiles."""
    seeds = sorted(zip([d - i for d, i in zip(at, place)], at))
    queue = []
    begin = last = seeds[0]
    for seed in [*seeds[1:], (None, 0)]:
        if seed[0] != last[0] or seed[1] != last[1] + 1:
            queue.append((begin[1] - last[1] - SEED, begin[1], begin[1] - begin[0]))
            begin = seed
        last = seed
    heapq.heapify(queue)
    first = min(at)
    marked, marked_at = bytearray(n_words), bytearray(max(at) - first + SEED)
    tiles = []
    while queue:
        n, d, i = heapq.heappop(queue)
        n, x = -n, d - first
        if 1 not in marked[i : i + n] and 1 not in marked_at[x : x + n]:
            marked[i : i + n] = marked_at[x : x + n] = b"\1" * n
            tiles.append((d, i, n))
            continue
        free = 0
        for k in range(n + 1):
            if k < n and not marked[i + k] and not marked_at[x + k]:
                free += 1
            else:
                if free >= SEED:
                    heapq.heappush(queue, (-free, d + k - free, i + k - free))
                free = 0
    return sorted(tiles)


def _chain(tiles: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The chain of tiles with the most words that follow each other in both texts with gaps of GAP
    words at most. Tiles do not overlap, so at most one ends at a word: it is looked up there."""
    ends: dict[int, int] = {}
    best: list[tuple[int, int]] = []  # words of the best chain that ends here, tile before
    for k, (d, i, n) in enumerate(tiles):
        own = (n, -1)
        for x in range(d - GAP, d + 1):
            j = ends.get(x)
            if j is not None and best[j][0] + n > own[0] and 0 <= i - tiles[j][1] - tiles[j][2] <= GAP:
                own = (best[j][0] + n, j)
        best.append(own)
        ends[d + n] = k
    k = max(range(len(tiles)), key=lambda t: best[t][0])
    out = []
    while k >= 0:
        out.append(tiles[k])
        k = best[k][1]
    return out[::-1]


def _candidates(found: np.ndarray, index: SeedIndex, share: float) -> list[tuple[int, np.ndarray]]:
    """Items, each with its places among the found ones of the index, whose words within found seeds
    are as many as the shortest leak has; no chain has more."""
    key = index.owner[found] << 32 | index.place[found]
    order = np.argsort(key)
    key, found = key[order], found[order]
    # Words that a seed adds to those of the seed before it in the same item: SEED, or fewer if they overlap.
    adds = np.minimum(np.diff(key, prepend=key[0] - SEED), SEED)
    begins = np.flatnonzero(np.diff(key >> 32, prepend=-1))
    adds[begins] = SEED
    covered = np.add.reduceat(adds, begins)
    out = []
    for begin, end, n in zip(begins.tolist(), [*begins[1:].tolist(), len(key)], covered.tolist()):
        item = int(key[begin] >> 32)
        if n >= MATCHED * share * len(index.words[item]) - 1e-9:
            out.append((item, found[begin:end]))
    return out


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... lo + n - 1 for each lo and n, one after another."""
    return np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def leaks_of(text: str, index: SeedIndex, share: float) -> list[tuple[int, int, int, int]]:
    """(item, matched words, own words, word of the document at which it begins) of each item of
    which at least ``share`` leaked into a text.

    A chain counts only if it has half of the rare words of the part of the item that it spans:
    items made from one pattern share long runs, but not their names.
    """
    words = words_of(text)
    if len(words) < SEED:
        return []
    w = np.array([index.vocabulary.get(x, -1) for x in words], dtype=np.int64)
    known = w >= 0
    whole = known[: len(w) - SEED + 1].copy()
    for k in range(1, SEED):
        whole &= known[k : len(w) - SEED + 1 + k]
    start = np.flatnonzero(whole)
    hashes = _hashes(w)[start]
    near = np.minimum(np.searchsorted(index.seeds, hashes), max(0, len(index.seeds) - 1))
    hit = index.seeds[near] == hashes if len(index.seeds) else np.zeros(len(start), dtype=bool)
    if not hit.any():
        return []
    start = start[hit]
    seeds, of = np.unique(hashes[hit], return_inverse=True)
    lo, hi = np.searchsorted(index.seeds, seeds, "left"), np.searchsorted(index.seeds, seeds, "right")
    # Each place of the index at most once, however often its seed stands in the document.
    found = _spread(lo, hi - lo)
    out, order = [], np.argsort(of, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(of))])  # of the starts of each seed, in this order
    for item, mine in _candidates(found, index, share):
        own = index.words[item]
        number = np.searchsorted(seeds, index.seeds[mine])
        first, n = begins[number], begins[number + 1] - begins[number]
        at = start[order[_spread(first, n)]]
        place = np.repeat(index.place[mine], n)
        same = np.ones(len(at), dtype=bool)
        for k in range(SEED):  # equal hashes, equal words
            same &= w[at + k] == own[place + k]
        chain = _chain(_tiles(at[same].tolist(), place[same].tolist(), len(own))) if same.any() else []
        if not chain:
            continue
        begin, end = chain[0][1], chain[-1][1] + chain[-1][2]
        matched = sum(k for _, _, k in chain)
        rare = index.rare[item]
        there, kept = rare[begin:end].sum(), sum(rare[i : i + k].sum() for _, i, k in chain)
        if end - begin >= share * len(own) and matched >= MATCHED * (end - begin) and kept >= 0.5 * there:
            out.append((index.items[item], int(matched), len(own), int(chain[0][0])))
    return out


def own_words(benchmark: DataFrame) -> DataFrame:
    """``item_id, words, rare`` of each different text of the benchmark: its words behind an opening
    that several items share, and which of them at most RARE_ITEMS items have.

    Both are counted over the whole benchmark: an opening is shared up to its k-th word if
    SHARED_ITEMS items begin with the same k words, SHARED_WORDS or more, and most of those that
    begin alike go on like that. Null ids and texts are left out.
    """
    ship_package(benchmark.sparkSession)

    def split(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lists = [words_of(t) for t in texts]
            yield pd.DataFrame({"words": lists, "openings": [_openings(x) for x in lists]})

    texts = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    read = F.pandas_udf(split, "struct<words:array<string>,openings:array<bigint>>")
    items = texts.select("item_id", F.xxhash64("text").alias("version"), read("text").alias("r")).select("item_id", "version", "r.*")
    opening = items.select("item_id", "version", F.posexplode("openings").alias("k", "opening"))
    counted = opening.groupBy("k", "opening").agg(F.countDistinct("item_id").alias("n"))
    first = opening.where("k = 0").join(counted.where("k = 0"), ["k", "opening"]).select("item_id", "version", F.col("n").alias("alike"))
    cut = (
        opening.join(counted.where(F.col("n") >= SHARED_ITEMS), ["k", "opening"])
        .join(first, ["item_id", "version"])
        .where((F.col("k") == 0) | (F.col("n") > SHARED_SHARE * F.col("alike")))
        .groupBy("item_id", "version")
        .agg((F.max("k") + SHARED_WORDS).alias("cut"))
    )
    own = items.join(cut, ["item_id", "version"], "left").select(
        "item_id", "version", F.expr("slice(words, 1 + coalesce(cut, 0), greatest(0, size(words) - coalesce(cut, 0)))").alias("words")
    )
    word = own.select("item_id", "version", F.posexplode("words").alias("k", "word"))
    rare = word.groupBy("word").agg(F.countDistinct("item_id").alias("n")).select("word", (F.col("n") <= RARE_ITEMS).alias("rare"))
    kept = word.join(rare, "word").groupBy("item_id", "version").agg(F.sort_array(F.collect_list(F.struct("k", "word", "rare"))).alias("w"))
    return kept.select("item_id", F.col("w.word").alias("words"), F.col("w.rare").alias("rare"))


def _openings(words: list[str]) -> list[int]:
    """Hashes of the first SHARED_WORDS words, and of one more each, while a word is left behind them."""
    out, running = [], xxhash.xxh64()
    for k, word in enumerate(words[:-1]):
        running.update(word + " ")
        if k + 1 >= SHARED_WORDS:
            out.append(running.intdigest() - (1 << 63))
    return out


def find_leaks(documents: DataFrame, benchmark: DataFrame, share: float = 1 / 3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every document with the items that leaked into it: ``doc_id, item_id, matched_words,
    own_words, at_word``.

    A leak is a chain of common runs that spans at least ``share`` of the item's own words, with
    no more than GAP words changed, missing or added between two runs. Copies of a document each
    have their own rows. Null texts and ids give no rows, nor do items of less than SEED words.
    An item listed more than once counts once for each different text. A benchmark of more than
    ``block_words`` words is taken in blocks, each a pass over the documents; the result does not
    depend on them.
    """
    spark = documents.sparkSession
    ship_package(spark)
    schema = "doc_id bigint, item_id bigint, matched_words int, own_words int, at_word int"
    items = own_words(benchmark)
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    n_blocks = -(-total // block_words)
    if n_blocks > 1:
        items = checkpointed(items)
    result = spark.createDataFrame([], schema)
    for block in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n_blocks)) == block)
        rows = sorted((r["item_id"], r["words"], r["rare"]) for r in mine.collect())
        shared = spark.sparkContext.broadcast(index_block(rows))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [
                    (doc, *leak)
                    for doc, text in zip(batch["doc_id"], batch["text"])
                    if text
                    for leak in leaks_of(text, shared.value, share)
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "matched_words", "own_words", "at_word"])

        part = spread(documents.select("doc_id", "text")).where("doc_id IS NOT NULL").mapInPandas(search, schema)
        result = part if block == 0 else result.unionByName(part)
    return result
