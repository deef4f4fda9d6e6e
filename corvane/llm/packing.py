"""Filling containers of fixed capacity with items, by exact-complement hashing.

Items are documents, sized in tokens. They are spread over shards by a hash of their id; a shard
is one group of narrow rows (id, part, size) of about SHARD_ITEMS items, so no group holds all
items however many there are, and each profile of each shard leaves at most one container half
empty. Within a shard the items are counts by size. An index holds for every sum up to the capacity
a pair and a triple of sizes that make it; since items are only ever taken, a sum that has none
never gets one again, and one whose sizes ran out is looked up anew. The largest item left opens a
container, and a gap is closed by a single size, a pair or a triple that fits exactly, else made
smaller by the largest size that fits. What no combination closes is placed best-fit at the end.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import rows_at_most, ship_package, spread

#: Items of one shard on average, before they are split by profile.
SHARD_ITEMS = 20_000
#: Folder of the vocabulary files of public tokenizers, and the one that is taken.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"

_ENCODERS: dict[str, object] = {}


def _encoder(name: str):
    """The tokenizer of a rank file that was sent along, once a worker."""
    if name not in _ENCODERS:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        _ENCODERS[name] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def token_counts(documents: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """``doc_id, n_tokens`` of every row; null texts have null tokens, empty ones 0. ``path`` is read
    on the driver's machine only and sent to the tasks."""
    name = os.path.basename(path)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(name).encode_ordinary
        for texts in batches:
            yield pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    ship_package(documents.sparkSession)
    documents.sparkSession.sparkContext.addFile(path)
    return spread(documents.select("doc_id", "text")).select("doc_id", F.pandas_udf(count, "bigint")("text").alias("n_tokens"))


class _Stock:
    """How many items of each size are left, and an index of the sums of two and of three sizes."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.left = np.bincount(sizes, minlength=capacity + 1)
        self.have = self.left > 0
        self.capacity = capacity
        own = np.flatnonzero(self.have)
        #: For each sum the largest size of a pair or triple that makes it, 0 if there is none.
        self.pair_of = np.zeros(capacity + 1, dtype=np.int64)
        self.triple_of = np.zeros(capacity + 1, dtype=np.int64)
        for a in own:
            other = own[own <= min(a, capacity - a)]
            self.pair_of[a + (other if self.left[a] > 1 else other[other < a])] = a
        sums = np.flatnonzero(self.pair_of)
        for a in own:
            self.triple_of[a + sums[sums <= capacity - a]] = a

    def take(self, size: int) -> int:
        self.left[size] -= 1
        self.have[size] = self.left[size] > 0
        return size

    def give(self, size: int) -> None:
        self.left[size] += 1
        self.have[size] = True

    def largest(self, limit: int) -> int:
        """The largest size up to ``limit`` that is left, or 0."""
        if limit <= 0:
            return 0
        size = limit - int(np.argmax(self.have[limit:0:-1]))
        return size if self.have[size] else 0

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two sizes left with this sum, as unequal as possible."""
        a = int(self.pair_of[total])
        if not a:
            return None
        b = total - a
        if self.have[a] and self.have[b] and (a != b or self.left[a] > 1):
            return a, b
        half = total // 2
        hit = self.have[1 : half + 1] & self.have[total - 1 : total - half - 1 : -1]
        if total % 2 == 0 and self.left[half] < 2:
            hit[half - 1] = False
        at = int(np.argmax(hit))
        if not hit[at]:
            self.pair_of[total] = 0
            return None
        self.pair_of[total] = total - at - 1
        return total - at - 1, at + 1

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """Three sizes left with this sum, the largest of them as large as possible."""
        size = int(self.triple_of[total])
        while size:
            size = self.largest(size)
            if size * 3 < total:
                break
            self.take(size)
            # The index must not forget a pair that is only out of reach while one item is held.
            before = self.pair_of[total - size]
            rest = self.pair(total - size)
            self.pair_of[total - size] = self.pair_of[total - size] or before
            self.give(size)
            if rest:
                self.triple_of[total] = size
                return (size, *rest)
            size -= 1
        self.triple_of[total] = 0
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three sizes left that fill a gap exactly."""
        return (gap,) if self.have[gap] else self.pair(gap) or self.triple(gap)


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of sizes, none above ``capacity``; every size from 1 to it is used once."""
    stock = _Stock(np.array(sizes, dtype=np.int64), capacity)
    full, open_ = [], []
    while size := stock.largest(capacity):
        held, gap = [stock.take(size)], capacity - size
        while gap:
            exact = stock.complement(gap)
            if exact:
                held += [stock.take(s) for s in exact]
                gap = 0
            elif size := stock.largest(gap):
                held.append(stock.take(size))
                gap -= size
            else:
                break
        (open_ if gap else full).append(held)
    return full + _best_fit([s for held in open_ for s in held], capacity)


def _best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Each size, the largest first, into the container with the least gap that it fits into."""
    containers: list[list[int]] = []
    gaps: list[tuple[int, int]] = []  # in order
    for size in sorted(sizes, reverse=True):
        at = bisect_left(gaps, (size, -1))
        if at < len(gaps):
            gap, k = gaps.pop(at)
        else:
            gap, k = capacity, len(containers)
            containers.append([])
        containers[k].append(size)
        if gap > size:
            insort(gaps, (gap - size, k))
    return containers


def _pack_group(group: pd.DataFrame) -> pd.DataFrame:
    """Assign the items of one shard and profile to containers."""
    capacity = int(group["capacity_tokens"].iloc[0])
    order = group.sort_values(["n_tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable")
    waiting: dict[int, list[int]] = {}
    for row, size in enumerate(order["n_tokens"].tolist()):
        waiting.setdefault(size, []).append(row)
    for rows in waiting.values():
        rows.reverse()
    of = np.zeros(len(order), dtype=np.int64)
    for k, held in enumerate(pack_sizes(order["n_tokens"].tolist(), capacity)):
        for size in held:
            of[waiting[size].pop()] = k
    return order.assign(container=of)[["profile", "capacity_tokens", "shard", "container", "doc_id", "part", "n_tokens"]]


def pack(counts: DataFrame, budgets: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Containers for every profile: ``profile, capacity_tokens, shard, container, doc_id, part,
    n_tokens``; a container is named by profile, shard and number.

    ``counts`` has ``doc_id, n_tokens``, ``budgets`` has ``profile, capacity_tokens`` (at most 1,000
    rows; null or non-positive capacities are left out). A document within the capacity is one item,
    a larger one is split into full parts and a rest. Documents without tokens need no container and
    are left out, as are null sizes. A repeated row is a further item.
    """
    ship_package(counts.sparkSession)
    profiles = sorted(
        {(r["profile"], r["capacity_tokens"]) for r in rows_at_most(budgets.select("profile", "capacity_tokens"), 1000, "the budgets") if (r["capacity_tokens"] or 0) > 0},
        key=str,
    )
    schema = "profile string, capacity_tokens int, shard int, container bigint, doc_id bigint, part int, n_tokens bigint"
    if not profiles:
        return counts.sparkSession.createDataFrame([], schema)
    shards = max(1, round(counts.count() / shard_items))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).alias("capacity_tokens")) for p, c in profiles]))
    # Repeated rows are told apart by a number of their own, which does not hang on where a row lies.
    copies = counts.where("n_tokens > 0").groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    items = (
        copies.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"))
        .select("doc_id", "n_tokens", "copy", each.alias("b"))
        .select("doc_id", "n_tokens", "b.profile", "b.capacity_tokens", F.pmod(F.xxhash64("doc_id", "n_tokens", "copy"), F.lit(shards)).cast("int").alias("shard"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).cast("int") - 1)))
        .withColumn("n_tokens", F.least(F.col("n_tokens") - F.col("part").cast("bigint") * F.col("capacity_tokens"), F.col("capacity_tokens").cast("bigint")))
    )
    return items.groupBy("profile", "shard").applyInPandas(_pack_group, schema)


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, items, tokens and the share of used space by profile."""
    by = packed.groupBy("profile", "capacity_tokens").agg(
        F.countDistinct("shard", "container").alias("n_containers"), F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens")
    )
    return by.withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
