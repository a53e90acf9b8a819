"""Language identification with language-bitmask n-gram filters.

Method: one Bloom filter for all languages, bit-sliced: a slot holds a mask with one bit for each language, an n-gram's
`hashes` slots are joined by AND, and what remains are all languages whose training texts have that n-gram. A document's
score for a language is the popcount of its bit over the document's n-grams, corrected for the false positives that the
fill of that language's slice makes likely: (hits - n p) / (1 - p), p = fill ** hashes. The largest corrected share
decides; of equal shares the first language by name.

n-grams are four bytes of the lower-cased text in which every run of ASCII characters that are not letters counts as a
blank. The filter is fitted on a bounded sample of labelled rows, at most `per_language` documents of each language (those
of the least hash of the id), with whole texts; a language has the n-grams that occur at least `least` times in its sample.
The masks of any 64 languages are a plane of their own; there are as many planes as the languages need. The filter's size
follows from the sample's bound and the number of languages, so what is broadcast doesn't grow with the rows.

Defined results: a text without letters, an empty or null text, or one with a best share under `share` has the language
"und"; so have all texts where no row is labelled, for then nothing is known. Every row has a result, null ids included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buffers import U64, mix, pieces, strings, tidy  # noqa: F401
from .common import power_of_two, table

PER_LANGUAGE = 300
LEAST = 3
SHARE = 0.3
HASHES = 3
PLANE = 64  #: languages of a plane
_FOLD = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def grams(off: np.ndarray, data: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """4-byte n-grams of the texts in rows i..j and the index of each text's first one (j - i + 1 of them)."""
    d = _FOLD[data[off[i] : off[j]]]
    at = off[i : j + 1] - off[i]
    if len(d) < 4:
        return np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
    w = d.astype(np.uint32)
    g = w[:-3] | w[1:-2] << np.uint32(8) | w[2:-1] << np.uint32(16) | w[3:] << np.uint32(24)
    blank = d == 32
    ok = ~(blank[:-3] & blank[1:-2] | blank[1:-2] & blank[2:-1] | blank[2:-1] & blank[3:])
    for k in range(1, 4):  # no n-gram reaches over the end of a text
        x = at[1:-1] - k
        ok[x[(x >= 0) & (x < len(ok))]] = False
    seen = np.concatenate([[0], np.cumsum(ok)])
    return g[ok], seen[np.minimum(at, len(ok))]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of texts by language, and how often each occurs."""
    for batch in batches:
        names = batch.column("lang").dictionary_encode()
        lang = names.indices.to_numpy()
        for i, j, off, data in pieces(batch.column("text"), lower=True):
            g, first = grams(off, data, 0, j - i)
            key, n = np.unique(np.repeat(lang[i:j].astype(np.uint64), np.diff(first)) << U64(32) | g, return_counts=True)
            rows = [names.dictionary.take(pa.array((key >> U64(32)).astype(np.int64))), pa.array((key & U64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(rows, ["lang", "gram", "n"])


class LanguageFilter:
    """The bit-sliced filter; picklable."""

    def __init__(self, found: dict[str, np.ndarray], hashes: int = HASHES):
        """found: the n-grams of each language."""
        self.names, self.hashes = sorted(found), hashes
        sets = [found[name] for name in self.names]
        self.size = power_of_two(16 * max([256, *map(len, sets)]))
        self.planes = []
        fill = []
        for low in range(0, max(len(sets), 1), PLANE):
            own = sets[low : low + PLANE]
            kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(k).bits >= len(own))
            plane = np.zeros(self.size, kind)
            for bit, g in enumerate(own):
                for at in self._places(g):
                    plane[at] |= kind(1 << bit)
            fill += [np.mean(plane >> kind(b) & kind(1)) for b in range(len(own))]
            self.planes.append(plane)
        self.slots = self.planes[0]
        fill = np.array(fill)
        self.false = fill**hashes

    def _places(self, g: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(g.astype(U64), 17)
        for k in range(self.hashes):
            yield (h >> U64(20 * k) & U64(self.size - 1)).astype(np.int64)

    def decide(self, column: pa.Array, share: float = SHARE) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, corrected share and number of n-grams of each text."""
        names = np.array([*self.names, "und"])
        best, score, total = [], [], []
        for i, j, off, data in pieces(column, lower=True):
            g, first = grams(off, data, 0, j - i)
            n = np.diff(first)
            shares = np.zeros((len(self.names) + 1, j - i))
            for k, plane in enumerate(self.planes):
                mask = np.full(len(g), np.iinfo(plane.dtype).max, plane.dtype)
                for at in self._places(g):
                    mask &= plane[at]
                for b, p in enumerate(self.false[k * PLANE : (k + 1) * PLANE]):
                    hits = np.concatenate([[0], np.cumsum(mask >> mask.dtype.type(b) & mask.dtype.type(1), dtype=np.int64)])
                    hits = hits[first[1:]] - hits[first[:-1]]
                    shares[k * PLANE + b] = np.maximum(hits - n * p, 0) / (1 - p + 1e-12) / np.maximum(n, 1)
            shares[-1] = 0
            top = np.argmax(shares, axis=0)
            value = shares[top, np.arange(j - i)]
            top[(value < share) | (n == 0)] = len(self.names)
            best.append(names[top])
            score.append(value)
            total.append(n)
        if not best:
            return [], np.zeros(0), np.zeros(0, np.int64)
        return np.concatenate(best).tolist(), np.concatenate(score), np.concatenate(total)


def fitted(docs: DataFrame, per_language: int = PER_LANGUAGE, least: int = LEAST) -> LanguageFilter:
    """A filter from at most `per_language` labelled rows of each language; their texts stay on the executors."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("doc_id", "lang").distinct()
    sample = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    seen = sample.select("lang", "text").mapInArrow(tidy(counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept = seen.groupBy("lang").agg(F.collect_list(F.when(F.col("n") >= least, F.col("gram"))).alias("grams"))  # 4 bytes each: at most some MB
    return LanguageFilter({r["lang"]: np.sort(np.array(r["grams"], np.int64).astype(np.uint32)) for r in kept.toLocalIterator()})


def _labels(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, share, n = model.value.decide(batch.column("text"))
            out = [batch.column("doc_id"), pa.array(name, pa.string()), pa.array(np.round(share, 6)), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "language", "share", "n_grams"])

    return run


def languages(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """(doc_id, language, share, n_grams) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_labels(held)), "doc_id long, language string, share double, n_grams int")


def _known(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, *_ in pieces(batch.column("text")):  # sent in small batches: a whole one would be held twice
                part = batch.slice(i, j - i)
                name, _, _ = model.value.decide(part.column("text"))
                yield part.filter(pa.array([x != "und" for x in name], pa.bool_()))

    return run


def identified(docs: DataFrame, model: LanguageFilter | None = None) -> DataFrame:
    """The rows whose text is in one of the known languages; all rows where no row is labelled."""
    model = model or fitted(docs)
    if not model.names:
        return docs
    return docs.mapInArrow(tidy(_known(docs.sparkSession.sparkContext.broadcast(model))), docs.schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages(docs, fitted(docs))
