"""Best-fit packing of documents into training sequences of `capacity` words.

Method: best-two-fit. A bin is filled greedily, always with the longest piece that fits the gap. If a gap stays, the bin's
smallest document is taken out again and the two unpacked documents that fill the expanded gap most tightly take its
place, provided that they fill it better than it did.

Bins are made inside shards of about `shard_rows` documents, chosen by a hash of the id (and of the row's place, where an id is
null or repeats), so packing runs in parallel and a shard's memory is bounded; each shard leaves at most one loosely filled bin. Only ids and lengths are shuffled, never texts.

A document longer than the capacity is cut into pieces of full capacity (bins of their own) and a rest, which is packed.
Ties are settled by length, then id, nulls last. Every word of every document is in exactly one piece.

Defined results: null and empty texts have no pieces; null ids are packed like any other (doc_id is null); repeated rows
are packed each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import Words, chunks, strings, tidy, tidy_group
from .common import table

CAPACITY = 2048
SHARD_ROWS = 16384
PIECES = "shard int, bin int, slot int, doc_id long, start_word int, n_words int"


def best_two_fit(lengths: list[int] | np.ndarray, capacity: int) -> list[list[int]]:
    """Bins, as lists of indexes, of documents of 1 to `capacity` words, in order of preference within a length."""
    lengths = np.asarray(lengths, np.int64)
    stock = np.bincount(lengths, minlength=capacity + 1)
    order = np.argsort(lengths, kind="stable")
    next_of = np.searchsorted(lengths[order], np.arange(capacity + 1))
    scale = np.arange(capacity + 1)
    longest = np.maximum.accumulate(np.where(stock > 0, scale, 0))
    bins = []

    def take(size: int) -> int:
        nonlocal longest
        at = order[next_of[size]]
        next_of[size] += 1
        stock[size] -= 1
        if not stock[size]:
            longest = np.maximum.accumulate(np.where(stock > 0, scale, 0))
        return int(at)

    left = len(lengths)
    while left:
        gap, content = capacity, []
        while gap and longest[gap]:
            size = int(longest[gap])
            content.append(take(size))
            gap -= size
        left -= len(content)
        if gap and left > 1:
            least = int(lengths[content[-1]])
            room = gap + least
            first = np.flatnonzero(stock[: room] > 0)
            if len(first):
                limit = np.minimum(room - first, first)
                second = longest[limit]
                alone = (second == first) & (stock[first] < 2)
                second = np.where(alone, longest[np.maximum(first - 1, 0)], second)
                total = np.where(second > 0, first + second, 0)
                best = len(total) - 1 - int(np.argmax(total[::-1]))  # of equal sums the one with the longest document
                if total[best] > least:
                    back = content.pop()
                    content += [take(int(first[best])), take(int(second[best]))]
                    left -= 1
                    next_of[least] -= 1  # the document is the next of its length again
                    order[next_of[least]] = back
                    stock[least] += 1
                    longest = np.maximum.accumulate(np.where(stock > 0, scale, 0))
        bins.append(content)
    return bins


def _again(ids: pa.Array) -> np.ndarray:
    """For each row how often its id came before in the batch."""
    key = pc.fill_null(ids, -1).to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    own = key[order]
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
    out = np.empty(len(own), np.int64)
    out[order] = np.arange(len(own)) - np.repeat(at, np.diff(np.append(at, len(own))))
    return out


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each row, and a salt that spreads rows without an id or with one that repeats."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    for k, batch in enumerate(batches):
        off, data = strings(batch.column("text"))
        n = [Words(off, data, i, j).count for i, j in chunks(off)]
        n = np.concatenate(n) if n else np.zeros(0, np.int64)
        ids = batch.column("doc_id")
        again = _again(ids)
        salt = np.where(again > 0, again + (part << 40) + (k << 20), 0)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(salt, pa.int64())], ["doc_id", "n", "salt"])


def _packed(capacity: int):
    def run(key, part):
        part = part.sort_by([("n", "ascending"), ("doc_id", "ascending")])
        n = part.column("n").to_numpy()
        full, rest = n // capacity, n % capacity
        whole = np.repeat(np.arange(len(n)), full)
        start = (np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)) * capacity
        pool = np.flatnonzero(rest)
        bins = best_two_fit(rest[pool], capacity)
        size = np.array([len(b) for b in bins], np.int64)
        row = pool[np.array([x for b in bins for x in b], np.int64)]
        slot = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        ids = part.column("doc_id").take(pa.array(np.concatenate([whole, row])))
        numbers = [
            np.full(len(ids), key[0].as_py()),
            np.concatenate([np.arange(len(whole)), len(whole) + np.repeat(np.arange(len(bins)), size)]),
            np.concatenate([np.zeros(len(whole), np.int64), slot]),
            np.concatenate([start, full[row] * capacity]),
            np.concatenate([np.full(len(whole), capacity), rest[row]]),
        ]
        shard, bin_, slot, start, words = (pa.array(x, pa.int32()) for x in numbers)
        return pa.table({"shard": shard, "bin": bin_, "slot": slot, "doc_id": ids, "start_word": start, "n_words": words})

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pieces of documents with their bin: (shard, bin, slot, doc_id, start_word, n_words)."""
    shards = max(1, round(docs.count() / shard_rows))
    sized = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_lengths), "doc_id long, n long, salt long").where("n > 0")
    shard = F.pmod(F.xxhash64("doc_id", "salt"), F.lit(shards)).cast("int")
    return sized.withColumn("shard", shard).drop("salt").groupBy("shard").applyInArrow(tidy_group(_packed(capacity)), PIECES)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
