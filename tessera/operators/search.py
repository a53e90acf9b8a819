"""Keyword and vector search of many queries at once, and fusion of their ranked lists.

Queries arrive as rows; documents are never crossed with queries. Keyword search reads each text once: what it has of the
queries' words goes to a stored table of postings, from which all statistics and scores follow by joins. Vector search is
one pass over the vectors in blocks against the broadcast queries, and leaves a partition as its best k rows for each query.
What is broadcast is checked: more words, passages or queries than the bounds below are taken another way.

Null texts count as empty ones; a vector that is null, empty, zero or of another length than the query has the cosine 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokens
from ..session import stored

K1, B = 1.2, 0.75
#: vectors of queries, or passages, up to this number are broadcast; more are searched in slices of this size
QUERIES_AT_ONCE = 20_000
#: distinct words of queries up to this number are looked for while texts are read; with more, all postings are stored
TERMS_AT_ONCE = 500_000
ROWS_AT_ONCE = 100_000
#: texts and term lists of a batch are taken as rows of so many bytes together, scores so many at once: a batch of 10,000 rows can hold hundreds of MB
BYTES_AT_ONCE = 1 << 20
SCORES_AT_ONCE = 1_000_000
_WORD = re.compile(r"\w+")


def ranges(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Rows i..j of about `most` bytes (or list items) together; a longer one is a range of its own."""
    size = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    return summed_ranges(pc.fill_null(size, 0).to_numpy(), most or BYTES_AT_ONCE)


def summed_ranges(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    upto, i = np.cumsum(size, dtype=np.int64), 0
    while i < len(upto):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


def _counted(id_: pa.DataType, held, stats: bool):
    """Words of each text with their numbers; with stats a row without words: number and length of all texts."""

    def rows(ids, terms, tf, size, dl) -> pa.RecordBatch:
        at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(at, pa.array(terms, pa.string())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int64())), pa.array(dl, pa.int64())], LISTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, n, total = held.value if held else None, 0, 0
        for batch in batches:
            first, terms, tf, size, dl = 0, [], [], [], []
            texts = (t for i, j in ranges(batch.column("text")) for t in batch.column("text").slice(i, j - i).to_pylist())
            for i, t in enumerate(texts):
                words = _WORD.findall((t or "").lower())
                n, total = n + 1, total + len(words)
                own = Counter(words if wanted is None else filter(wanted.__contains__, words))
                terms += own.keys()
                tf += own.values()
                size.append(len(own))
                dl.append(len(words))
                if len(terms) > ROWS_AT_ONCE:
                    yield rows(batch.column("id").slice(first, i + 1 - first), terms, tf, size, dl)
                    first, terms, tf, size, dl = i + 1, [], [], [], []
            if size:
                yield rows(batch.column("id").slice(first), terms, tf, size, dl)
        if stats and n:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_), pa.nulls(1, pa.list_(pa.string())), pa.array([[n]], pa.list_(pa.int64())), pa.array([total], pa.int64())], LISTS)

    return run


LISTS = ["id", "terms", "tfs", "dl"]


def term_lists(docs: DataFrame, id_: str = "doc_id", text: str = "text", only: list[str] | None = None, stats: bool = False) -> DataFrame:
    """(id, terms, tfs, dl): the words of each text, how often each occurs, and the length of the text in words. Nothing is shuffled.

    only: just these words; stats: rows with null terms give tfs[0] texts of dl words together.
    """
    context, kind = docs.sparkSession.sparkContext, docs.schema[id_].dataType
    held = None if only is None else context.broadcast(frozenset(only))
    own = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    return own.mapInArrow(_counted(to_arrow_type(kind), held, stats), f"id {kind.simpleString()}, terms array<string>, tfs array<long>, dl long")


def flat_postings(lists: DataFrame) -> DataFrame:
    """Term lists as rows (id, term, tf, dl)."""
    return lists.where("terms IS NOT NULL").select("id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("id", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"), "dl")


def postings(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, term, tf, dl): how often each word occurs in each text, and the length of the text in words."""
    return flat_postings(term_lists(docs, id_, text))


def term_stats(posted: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def top(df: DataFrame, k: int, by: list[str], score: str = "score", id_: str = "id") -> DataFrame:
    """The k best rows of each group, with rank from 1: score descending, then id."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(id_))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Best:
    """The k best ids for each query, as scores come in; an id that occurs again counts with its best score."""

    def __init__(self, k: int | None):
        self.k, self.parts, self.held = k, [], 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: rows are ids, columns queries; -inf: not a hit."""
        cut = np.full(scores.shape[1], -np.inf)
        if self.k and len(scores) > self.k and len(np.unique(ids)) == len(ids):  # ids that repeat are joined first
            cut = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
        r, q = np.nonzero((scores >= cut) & np.isfinite(scores))
        self.parts.append((q, scores[r, q], ids[r]))
        self.held += len(q)
        if self.held > SCORES_AT_ONCE // 4:
            self.parts = [self.result()]
            self.held = 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        q, s, i = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((-s, i, q))
        q, s, i = q[order], s[order], i[order]
        first = np.ones(len(q), bool)
        first[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
        q, s, i = q[first], s[first], i[first]
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        at = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])[: len(q)])
        place = np.arange(len(q)) - np.repeat(at, np.diff(np.append(at, len(q))))
        use = place < self.k if self.k else np.ones(len(q), bool)
        return q[use], s[use], i[use]

    def batch(self, names: list, kinds: list[pa.DataType]) -> pa.RecordBatch:
        q, s, i = self.result()
        return pa.RecordBatch.from_arrays([pa.array([names[x] for x in q], kinds[0]), pa.array(i.tolist(), kinds[1]), pa.array(s)], ["query_id", "id", "score"])


def _ranked(held, k: int, kinds: list[pa.DataType]):
    """The k best texts of a partition for each query, from their term lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, idf, start, many, asked, average = held.value
        terms, best, step = pa.array(terms, pa.string()), _Best(k), max(1, SCORES_AT_ONCE // max(len(names), 1))

        def blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
            """Rows with the sizes of their lists and the places of their terms: as many as have SCORES_AT_ONCE pairs with queries, and parts of scores."""
            for i, j in ranges(batch.column("terms"), ROWS_AT_ONCE):
                own = batch.slice(i, j - i)
                size = pc.fill_null(pc.list_value_length(own.column("terms")), 0).to_numpy()
                at = pc.index_in(own.column("terms").flatten(), value_set=terms)
                upto = np.concatenate([[0], np.cumsum(size)])
                worth = np.concatenate([[0], np.cumsum(np.where(pc.is_valid(at).to_numpy(zero_copy_only=False), many[pc.fill_null(at, 0).to_numpy()], 0) if len(many) else np.zeros(len(at), np.int64))])
                for lo, hi in summed_ranges(np.diff(worth[upto]), SCORES_AT_ONCE):
                    for at_ in range(lo, hi, step):
                        end = min(hi, at_ + step)
                        yield own.slice(at_, end - at_), size[at_:end], at.slice(upto[at_], upto[end] - upto[at_])

        for batch in batches:
            for own, size, at in blocks(batch):
                known = pc.is_valid(at).to_numpy(zero_copy_only=False)
                at = pc.fill_null(at, 0).to_numpy()[known]
                doc = np.repeat(np.arange(len(own)), size)[known]
                tf, dl = own.column("tfs").filter(pc.is_valid(own.column("terms"))).flatten().to_numpy()[known], own.column("dl").to_numpy()[doc]
                part = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))
                n = many[at]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                key = np.repeat(doc, n) * len(names) + asked[np.repeat(start[at], n) + inner]
                score = np.bincount(key, np.repeat(part, n), len(own) * len(names)).reshape(len(own), len(names))
                hit = score > 0
                hit[~pc.is_valid(own.column("id")).to_numpy(zero_copy_only=False)] = False
                rows = np.flatnonzero(hit.any(1))
                if len(rows):
                    best.add(np.where(hit, np.round(score, 6), -np.inf)[rows], np.array(own.column("id").take(pa.array(rows)).to_pylist()))
        yield best.batch(names, kinds)

    return run


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 5, id_: str = "doc_id") -> DataFrame:
    """(query_id, id, score, rank) of each query's k best texts; queries: (query_id, text).

    Texts are read once, into a stored table of term lists; the words' frequencies are counted in it, and a second pass over it scores in blocks and
    leaves each partition's k best; an id of several rows counts with its best. More than TERMS_AT_ONCE words, or QUERIES_AT_ONCE queries, are joined with the table instead.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    bound = TERMS_AT_ONCE + QUERIES_AT_ONCE
    rows = asked.limit(bound + 1).collect()
    terms = sorted({r["term"] for r in rows})
    names = sorted({r["query_id"] for r in rows})
    if len(rows) > bound or len(names) > QUERIES_AT_ONCE:
        index = stored(term_lists(docs, id_, stats=True), "postings")
        return top(scored_postings(index, asked), k, ["query_id"])
    index = stored(term_lists(docs, id_, only=terms, stats=True), "postings")
    sizes = index.where("terms IS NULL").agg(F.sum(F.get("tfs", F.lit(0))).alias("n"), F.sum("dl").alias("dl")).first()
    found = {r["term"]: r["count"] for r in index.where("terms IS NOT NULL").select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    n, df = sizes["n"] or 0, np.array([found.get(t, 0) for t in terms])
    place, number = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(names)}
    pairs = np.array(sorted((place[r["term"]], number[r["query_id"]]) for r in rows), np.int64).reshape(-1, 2)
    many = np.bincount(pairs[:, 0], minlength=len(terms))
    kinds = [queries.schema["query_id"].dataType, docs.schema[id_].dataType]
    held = docs.sparkSession.sparkContext.broadcast((names, terms, np.log(1 + (n - df + 0.5) / (df + 0.5)), np.cumsum(many) - many, many, pairs[:, 1], (sizes["dl"] or 0) / n if n else 1.0))
    schema = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score double"
    found = index.mapInArrow(_ranked(held, k, [to_arrow_type(x) for x in kinds]), schema)
    return top(found.groupBy("query_id", "id").agg(F.max("score").alias("score")), k, ["query_id"])


def scored_postings(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, score) of all pairs with a common word, from stored term lists with statistics; asked: (query_id, term), distinct."""
    sizes = index.where("terms IS NULL").agg(F.sum(F.get("tfs", F.lit(0))).alias("n"), (F.sum("dl") / F.sum(F.get("tfs", F.lit(0)))).alias("avgdl"))
    posted = flat_postings(index.where("id IS NOT NULL")).join(asked.select("term").distinct(), "term", "left_semi")
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = posted.join(df, "term").crossJoin(F.broadcast(sizes)).select("id", "term", (idf * tf).alias("part"))
    return hits.join(asked, "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def _containing(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, passages, anchors = held.value
        for batch in batches:
            rows, hits = [], []
            for i, t in enumerate(batch.column("text")):
                t = t.as_py() or ""
                for w in anchors.keys() & set(_WORD.findall(t.lower())):
                    for p in anchors[w]:
                        if passages[p] in t:
                            rows.append(i)
                            hits.append(names[p])
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int64()), batch.column("id").take(pa.array(rows, pa.int64()))], ["query_id", "id"])

    return run


def containing(docs: DataFrame, passages: DataFrame, id_: str = "doc_id") -> DataFrame:
    """(query_id, id) of all texts that have a passage word for word; passages: (query_id, text). Candidates share its longest whole word.

    Null and blank passages, and those without a whole word between two others, are in none.
    """
    kind, parts = docs.schema[id_].dataType.simpleString(), []
    own = docs.select(F.col(id_).alias("id"), "text")
    for part in _slices(passages.where("text IS NOT NULL AND query_id IS NOT NULL")):
        rows = part.select(F.col("query_id").cast("long"), "text").collect()
        anchors: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            words = _WORD.findall(r["text"].lower())[1:-1]  # the first and last may be parts of longer words
            if words:
                anchors.setdefault(max(words, key=lambda w: (len(w), w)), []).append(i)
        held = docs.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], [r["text"] for r in rows], anchors))
        parts.append(own.mapInArrow(_containing(held), f"query_id long, id {kind}"))
    return reduce(DataFrame.unionByName, parts)


def _slices(queries: DataFrame) -> list[DataFrame]:
    """Parts of at most about QUERIES_AT_ONCE rows."""
    n = -(-queries.count() // QUERIES_AT_ONCE)
    return [queries] if n <= 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == s) for s in range(n)]


def _unit(rows) -> np.ndarray:
    m = np.asarray(rows, np.float64)
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _nearest(held, k: int | None, floor: bool, tagged: str | None, kinds: list[pa.DataType]):
    """The k best ids for each query, of a partition; an id that occurs again counts with its best score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, by_size, tags = held.value
        best = _Best(k)
        for batch in batches:
            ids = np.array(batch.column("id").to_pylist())
            vectors = batch.column("vec").to_pylist()
            mine = np.array(batch.column("tag").to_pylist()) if tagged else None
            step = max(1, SCORES_AT_ONCE // max(len(names), 1))
            for lo in range(0, len(ids), step):
                own = vectors[lo : lo + step]
                size = np.array([len(v) if v and None not in v else 0 for v in own])
                s = np.zeros((len(own), len(names)))
                for d, (at, m) in by_size.items():
                    rows = np.flatnonzero(size == d)
                    if d and len(rows):
                        s[np.ix_(rows, at)] = _unit([own[r] for r in rows]) @ m.T
                s = np.round(np.maximum(s, 0) if floor else s, 6)
                if tagged:
                    same = mine[lo : lo + step, None] == tags[None]
                    s[same if tagged == "other" else ~same] = -np.inf
                best.add(s, ids[lo : lo + step])
        if best.parts:
            yield best.batch(names, kinds)

    return run


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int | None = 10, floor: bool = True, tagged: str | None = None) -> DataFrame:
    """(query_id, id, score, rank) by cosine; vectors: (id, vec), queries: (query_id, qvec); floor: negative scores are 0.

    Exact. An id that several rows have counts with its best score. k: None for all. tagged: both have a column `tag`; a query
    sees the vectors of the "same" or of an "other" tag only: the filter runs before the search.
    """
    context, parts = vectors.sparkSession.sparkContext, []
    kinds = [queries.schema["query_id"].dataType, vectors.schema["id"].dataType]
    schema, kinds = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score double", [to_arrow_type(x) for x in kinds]
    for part in _slices(queries):
        rows = part.collect()
        by_size: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            by_size.setdefault(len(r["qvec"]) if r["qvec"] and None not in r["qvec"] else 0, []).append(i)
        units = {d: (np.array(at), _unit([rows[i]["qvec"] for i in at]) if d else None) for d, at in by_size.items()}
        held = context.broadcast(([r["query_id"] for r in rows], units, np.array([r["tag"] for r in rows]) if tagged else None))
        found = vectors.select("id", "vec", *["tag"] * bool(tagged)).where("id IS NOT NULL").mapInArrow(_nearest(held, k, floor, tagged, kinds), schema)
        parts.append(found.groupBy("query_id", "id").agg(F.max("score").alias("score")))
    found = reduce(DataFrame.unionByName, parts)
    return top(found, k, ["query_id"]) if k else found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def best_per_chunk(hits: DataFrame) -> DataFrame:
    """Question hits (query_id, chunk_id, score) as chunk hits: the best score of each chunk."""
    return hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def normalized_bm25(score: Column, query: str = "query_id") -> Column:
    """Min-max within a query's list; where all are equal, score / max."""
    w = Window.partitionBy(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.when(high > 0, score / high).otherwise(0.0))


def fused(lists: dict[str, DataFrame], weights: dict[str, float | Column], k: int = 60) -> DataFrame:
    """(query_id, id, score): sum of weight * raw / (k + rank) over ranked lists, divided by the query's best.

    Lists: (query_id, id, score, rank), rank from 1. A list without the row adds nothing. "bm25" is normalised first.
    """
    parts = []
    for name, df in lists.items():
        raw = normalized_bm25(F.col("score")) if name == "bm25" else F.greatest(F.col("score"), F.lit(0.0))
        weight = weights[name] if isinstance(weights[name], Column) else F.lit(weights[name])
        parts.append(df.select("query_id", "id", (weight * raw / (k + F.col("rank"))).alias("part")))
    total = reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.sum("part").alias("s"))
    best = F.max("s").over(Window.partitionBy("query_id"))
    return total.select("query_id", "id", F.round(F.when(best > 0, F.col("s") / best).otherwise(F.col("s")), 6).alias("score"))


def coherence_boost(hits: DataFrame, within: int | None = None, step: float = 0.05, most: int = 4) -> DataFrame:
    """Hits (query_id, id, doc, score) times 1 + step * min(siblings, most); siblings are rows of the same document.

    within: only the best so many rows of a query count, and are boosted.
    """
    counted = F.lit(True)
    if within is not None:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
        hits = hits.withColumn("place", F.row_number().over(order))
        counted = F.col("place") <= within
    n = F.sum(F.when(counted, 1).otherwise(0)).over(Window.partitionBy("query_id", "doc"))
    factor = F.when(counted, 1 + step * F.least(n - 1, F.lit(most))).otherwise(1.0)
    return hits.withColumn("score", F.round(F.col("score") * factor, 8)).drop("place")


def sibling_expansion(seeds: DataFrame, chunks: DataFrame, reach: int = 2, share: float = 0.75) -> DataFrame:
    """Chunks of the seeds' documents at most `reach` places away, at `share` of the best such seed's score.

    seeds: (query_id, chunk_id, score); chunks: (chunk_id, doc_id, chunk_index). Seeds themselves stay as they are.
    """
    placed = seeds.join(chunks.select("chunk_id", "doc_id", "chunk_index"), "chunk_id")
    other = chunks.select(F.col("chunk_id").alias("near_id"), "doc_id", F.col("chunk_index").alias("near_index"))
    near = placed.join(other, "doc_id").where(F.abs(F.col("near_index") - F.col("chunk_index")).between(1, reach))
    added = near.groupBy("query_id", F.col("near_id").alias("chunk_id")).agg(F.round(F.max("score") * share, 8).alias("score"))
    added = added.join(seeds.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return seeds.select("query_id", "chunk_id", "score", F.lit(False).alias("expanded")).unionByName(added.withColumn("expanded", F.lit(True)))


def fetch_depth(top_k: int, n: int) -> int:
    """How many hits each list should give before fusion."""
    return int(top_k * 3 * (min(n / 200, 2.0) if n > 200 else 1.0))


def signal_boost(score: Column, information: Column, density: Column, kind: Column) -> Column:
    """For questions about terms: tables * 1.15, other text with many numbers * 1.10."""
    return F.when(kind == "term_specific", F.when(information == "tabular", score * 1.15).when(density > 0.3, score * 1.10).otherwise(score)).otherwise(score)


def merged_lists(lists: list[DataFrame]) -> DataFrame:
    """Union of (query_id, id, score) lists: each id once per query, with its best score."""
    return reduce(DataFrame.unionByName, lists).groupBy("query_id", "id").agg(F.max("score").alias("score"))
