"""Toxic documents by an induced lexicon.

Method (random walks from seeds over a word graph):
1. Seed terms come from labelled documents, at most `labelled_rows` of them (those of the least hash of the id), near copies
   of which count once (those that share one of two least hashes of their word pairs): words whose odds to be in a toxic one
   are LIFT times those of all, significantly so (positive seeds, all of them), and frequent words of the clean ones without
   such a tendency (negative seeds).
2. Over all documents: how many have each word, and how many have it with a positive seed in the same document. Nodes of
   the graph are the seeds and all words of at least LEAST documents whose odds to occur with seeds are LIFT times those of
   all documents, significantly so, unless the labelled documents speak against them. Significance is the likelihood
   ratio, a bound of the tail for rare and for frequent words and at any rate of documents with seeds.
3. Over all documents: in how many each two nodes occur together. Edges are the positive pointwise mutual information,
   shifted by log(LIFT), or by half of the most that words so frequent can have where that is less: what two words of one
   language share by that alone is no tie. Two words need TOGETHER documents for an edge; seeds of opposite kind have none.
   The edges are a stored table; up to EDGES_AT_ONCE of them are walked on the driver, more of them by a job over the table
   for each step, with the same result. Driver and workers hold a few numbers for each node.
4. Two random walks with restart, from the positive and from the negative seeds, give each node two probabilities; a walk
   that comes to a seed of the other kind starts anew. The logarithm of the ratio, where positive, is the polarity weight.
5. A document's score is the sum of the weights of its distinct words; the least score called toxic is the one with the best
   F1 on the labelled documents of step 1.

Defined results: (doc_id, score) of toxic documents; null ids, null texts and texts without words are never toxic; rows that
repeat an id and text give one row; without labelled documents of both kinds, or without significant words, nothing is
toxic; labels with nulls are ignored, as are other columns. Words are runs of letters, digits and non-ASCII characters of
the lower-cased text; texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import ALNUM, U64, Words, chunks, mix, spans, strings, tidy
from .common import checkpointed, stored, table

LABELLED_ROWS = 20_000
NEGATIVE = 100
LEAST = 5
TOGETHER = 3
LEAST_Z = 6.0
LIFT = 4.0
RESTART = 0.15
ROUNDS = 60
EDGES_AT_ONCE = 2_000_000
PAIRS_AT_ONCE = 1_000_000
ANY = 0  #: stands for every document in word counts


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, and row and word of each distinct word in it, in order of row."""
    off, data = strings(batch.column("text"), lower=True)
    for i, j in chunks(off):
        words = Words(off, data, i, j, ALNUM)
        h, row = words.hashes(), words.row()
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield i, j, row[fresh], h[fresh]


def _counted(word: np.ndarray, *weights: np.ndarray) -> list[np.ndarray]:
    name, at = np.unique(word, return_inverse=True)
    return [name, *(np.bincount(at, w, len(name)).astype(np.int64) for w in weights)]


def _batch(names: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names.split())


def _by_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for i, _, row, word in _sets(batch):
            t = toxic[i + row]
            yield _batch("word toxic clean", _counted(word, t, 1 - t))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two least hashes of each document's pairs of successive words; of documents without a pair, of their only word."""
    for batch in batches:
        ids, label = batch.column("doc_id").to_numpy(), batch.column("toxic").to_numpy()
        off, data = strings(batch.column("text"), lower=True)
        for i, j in chunks(off):
            words = Words(off, data, i, j, ALNUM)
            h, row = words.hashes(), words.row()
            last = np.ones(len(h), bool)
            last[:-1] = row[1:] != row[:-1]
            alone = last & (words.count[row] == 1)
            pair = np.concatenate([spans(h, 2), np.zeros(min(len(h), 1), U64)])
            pair[alone] = h[alone]
            use = ~last | alone
            pair, row = pair[use], row[use]
            at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
            if len(at):
                low = [np.minimum.reduceat(mix(pair, seed), at) for seed in (41, 42)]
                yield _batch("doc_id toxic a b", [ids[i + row[at]], label[i + row[at]], *low])


def _within(names: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in the sorted names, and whether it is there."""
    at = np.minimum(np.searchsorted(names, word), len(names) - 1)
    return at, names[at] == word


def _near_seeds(positive: np.ndarray):
    """Documents with each word, and those of them with a positive seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, hits = [], []
        for batch in batches:
            for i, j, row, word in _sets(batch):
                has = np.zeros(j - i, bool)
                has[row[_within(positive, word)[1]]] = True
                rows += [word, np.full(j - i, ANY, U64)]
                hits += [has[row], has]
            if sum(map(len, rows)) > 2_000_000:
                yield _batch("word n near", _counted(np.concatenate(rows), np.ones(sum(map(len, rows))), np.concatenate(hits)))
                rows, hits = [], []
        if rows:
            yield _batch("word n near", _counted(np.concatenate(rows), np.ones(sum(map(len, rows))), np.concatenate(hits)))

    return run


def _together(nodes: np.ndarray):
    """Documents in which each two nodes occur: a * V + b with a < b; with a = b those of one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(nodes)
        for batch in batches:
            for _, _, row, word in _sets(batch):
                at, ok = _within(nodes, word)
                row, at = row[ok], at[ok]
                start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
                n = np.diff(np.append(start, len(row)))
                inner = np.arange(len(row)) - np.repeat(start, n) + 1  # with itself and all before it
                first = np.repeat(start, n)
                done = np.cumsum(inner)
                cuts = np.unique(np.searchsorted(done, np.arange(0, done[-1] if len(done) else 0, PAIRS_AT_ONCE), "right"))
                for lo, hi in zip(cuts, [*cuts[1:], len(row)]):
                    own = inner[lo:hi]
                    left = np.repeat(first[lo:hi], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
                    pair, count = np.unique(at[left] * size + np.repeat(at[lo:hi], own), return_counts=True)
                    yield _batch("pair n", [pair, count])

    return run


def ties(n: np.ndarray, a: np.ndarray, b: np.ndarray, total: int) -> np.ndarray:
    """Shifted information of words in a and b of `total` documents, n of them shared."""
    return np.log(n * total / (a * b)) - np.minimum(np.log(LIFT), np.log(total / np.maximum(a, b)) / 2)


def _edges(alone: np.ndarray, kind: np.ndarray, total: int):
    """Edges of pairs of nodes, each in one direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(alone)
        for batch in batches:
            pair, n = batch.column("pair").to_numpy(), batch.column("n").to_numpy().astype(float)
            a, b = pair // size, pair % size
            weight = ties(n, alone[a], alone[b], total)
            use = (a != b) & (weight > 0) & (kind[a] * kind[b] >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (a, b, weight)], ["a", "b", "weight"])

    return run


def walk(edges: np.ndarray, weight: np.ndarray, size: int, seeds: np.ndarray, restart: float = RESTART, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of a random walk with restart; edges are given in both directions."""
    start = np.zeros(size)
    start[seeds] = 1 / max(len(seeds), 1)
    total = np.bincount(edges[:, 0], weight, size)
    step = weight / total[edges[:, 0]]
    p = start
    for _ in range(rounds):
        moved = np.bincount(edges[:, 1], p[edges[:, 0]] * step, size)
        p = (1 - restart) * (moved + p[total == 0].sum() * start) + restart * start
    return p


def _arriving(given: np.ndarray):
    """What comes to each node over its edges, for each row of `given`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros_like(given)
        for batch in batches:
            a, b, weight = (batch.column(c).to_numpy() for c in ("a", "b", "weight"))
            for x, y in ((a, b), (b, a)):
                for k in range(len(given)):
                    out[k] += np.bincount(y, weight * given[k][x], given.shape[1])
        node = np.flatnonzero(out.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(node), *(pa.array(x[node]) for x in out)], ["node", "plus", "minus"])

    return run


def walks(edges: DataFrame, kind: np.ndarray, at_once: int = EDGES_AT_ONCE, restart: float = RESTART, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the walks from the positive and the negative seeds; neither goes on from a seed of the other kind."""
    size, goes = len(kind), np.stack([kind >= 0, kind <= 0])
    if edges.count() <= at_once:
        a, b, weight = (c.to_numpy() for c in edges.orderBy("a", "b").toArrow().columns)
        both, weight = np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), np.concatenate([weight, weight])
        return tuple(walk(both[g[both[:, 0]]], weight[g[both[:, 0]]], size, np.flatnonzero(kind == sign), restart, rounds) for g, sign in zip(goes, (1, -1)))

    def over(given: np.ndarray) -> np.ndarray:
        sums = edges.mapInArrow(tidy(_arriving(given)), "node long, plus double, minus double").groupBy("node").agg(F.sum("plus"), F.sum("minus")).toArrow()
        node, *values = (c.to_numpy() for c in sums.columns)
        out = np.zeros_like(given)
        out[:, node] = values
        return out

    total = np.where(goes, over(np.ones((2, size))), 0)
    start = np.stack([(kind == sign) / max(int((kind == sign).sum()), 1) for sign in (1, -1)])
    p = start
    for _ in range(rounds):
        moved = over(np.divide(p, total, out=np.zeros_like(p), where=total > 0))
        p = (1 - restart) * (moved + np.where(total == 0, p, 0).sum(1)[:, None] * start) + restart * start
    return p[0], p[1]


def _scores(names: np.ndarray, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(len(batch))
            for i, j, row, word in _sets(batch):
                at, ok = _within(names, word)
                score[i:j] = np.bincount(row[ok], weights[at[ok]], j - i)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(np.round(score, 6))], [*(c for c in batch.schema.names if c != "text"), "score"])

    return run


def threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    """The least score called toxic: of best F1, in the middle of the gap below it."""
    order = np.argsort(-score, kind="stable")
    s, t = score[order], toxic[order]
    hits = np.cumsum(t)
    f1 = np.where(s > 0, 2 * hits / (np.arange(len(s)) + 1 + t.sum()), 0)
    f1[:-1][s[:-1] == s[1:]] = 0  # equal scores are called alike
    best = int(np.argmax(f1))
    below = s[best + 1] if best + 1 < len(s) else 0.0
    return float((s[best] + below) / 2)


class Lexicon:
    """Sorted word hashes, their weights, and the least score called toxic."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, limit: float):
        self.words, self.weights, self.limit = words, weights, limit


def _tends(near: Column, n: Column, rate: float) -> Column:
    """Whether words in n documents, `near` of them with seeds (or toxic), have odds LIFT times those of `rate`, significantly so."""
    part = lambda x, expected: F.when(x > 0, x * F.log(x / (n * F.lit(expected)))).otherwise(0.0)
    if not 0 < rate < 1:
        return F.lit(False)
    return (near * (1 - rate) >= LIFT * rate * (n - near)) & (2 * (part(near, rate) + part(n - near, 1 - rate)) >= LEAST_Z**2)


def induced(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Lexicon | None:
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    some = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("long")).dropna().where("toxic IN (0, 1)")
    some = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)
    known = checkpointed(docs.join(F.broadcast(some), "doc_id"))
    one = known.mapInArrow(tidy(_sketched), "doc_id long, toxic long, a long, b long")
    for side in "ab":
        one = one.groupBy("toxic", side).agg(F.min(F.struct("doc_id", "b")).alias("m")).select("toxic", "m.*")
    unique = checkpointed(known.join(F.broadcast(one.select("doc_id").distinct()), "doc_id", "left_semi").select("text", "toxic"))
    sizes = {r["toxic"]: r["count"] for r in unique.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    seen = unique.mapInArrow(tidy(_by_label), "word long, toxic long, clean long")
    seen = seen.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    both, (clean_n, toxic_n) = F.col("toxic") + F.col("clean"), (sizes[0], sizes[1])
    pooled = both / (clean_n + toxic_n)
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / clean_n + 1 / toxic_n))
    seen = checkpointed(seen.withColumn("z", (F.col("toxic") / toxic_n - F.col("clean") / clean_n) / error))
    unsigned = lambda rows: np.sort(np.array([r["word"] for r in rows], np.int64).astype(U64))
    positive = unsigned(seen.where(_tends(F.col("toxic"), both, toxic_n / (clean_n + toxic_n))).select("word").toLocalIterator())
    negative = unsigned(seen.where(F.col("z") < LEAST_Z / 3).orderBy(F.desc("clean"), "word").limit(NEGATIVE).collect())
    if not len(positive) or not len(negative):
        return None
    text = docs.select("text")
    counts = text.mapInArrow(tidy(_near_seeds(positive)), "word long, n long, near long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("near").alias("near"))
    total = docs.count()
    counts = checkpointed(counts.where(F.col("n") >= LEAST))
    bearing = counts.where(F.col("word") == ANY).agg(F.sum("near")).first()[0] or 0
    rate = bearing / max(total, 1)
    against = seen.where((F.col("z") < LEAST_Z / 2)).select("word")
    drawn = counts.where(_tends(F.col("near"), F.col("n"), rate) & (F.col("word") != ANY)).join(against, "word", "left_anti")
    nodes = np.unique(np.concatenate([positive, negative, unsigned(drawn.select("word").toLocalIterator())]))
    v = len(nodes)
    pairs = checkpointed(text.mapInArrow(tidy(_together(nodes)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(f"n >= {TOGETHER} OR pair div {v} = pair % {v}"))
    own, n = (c.to_numpy() for c in pairs.where(f"pair div {v} = pair % {v}").toArrow().columns)
    alone = np.ones(v)
    alone[own % v] = n
    kind = np.isin(nodes, positive).astype(int) - np.isin(nodes, negative)
    edges = stored(pairs.mapInArrow(tidy(_edges(alone, kind, total)), "a long, b long, weight double"), "edges")
    plus, minus = walks(edges, kind)
    tiny = 1e-3 / v
    polarity = np.log((plus + tiny) / (minus + tiny))
    good = polarity > 0
    words, weights = nodes[good], polarity[good]
    if not len(words):
        return None
    rows = known.select("toxic", "text").mapInArrow(tidy(_scores(words, weights)), "toxic long, score double").collect()
    limit = threshold(np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows]))
    return Lexicon(words, weights, limit)


def toxic(docs: DataFrame, lexicon: Lexicon | None) -> DataFrame:
    """(doc_id, score) of the documents with at least the lexicon's least score."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    if lexicon is None:
        return docs.select("doc_id", F.lit(0.0).alias("score")).where("false")
    scored = docs.mapInArrow(tidy(_scores(lexicon.words, lexicon.weights)), "doc_id long, score double")
    return scored.where(F.col("score") >= lexicon.limit).distinct()


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic(docs, induced(docs, table(spark, sf_dir, "labels")))
