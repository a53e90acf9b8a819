"""Rule-based quality filter as a short-circuit cascade.

Method: on a bounded sample of rows (about `sample_rows`, whole texts) each rule's cost (seconds for a byte) and
selectivity (share of rows it rejects) are measured on the executors; rules then run in the order of rejection per cost,
each on only the rows that all before it passed. A document is kept if no rule rejects it, so the order changes what is
computed but never the result.

The rules (a row is rejected if the measure is above the limit):
- empty: no word at all
- symbols: share of # $ % & * among the characters above 0.1
- pipes: share of | among the characters above 0.015
- shouting: share of capitals among the ASCII letters above 0.4
- stutter: share of words equal to the word before above 0.3
- repeated_lines: share of lines, blank ones left out, that repeat an earlier line of the text above 0.5
- repeated_phrases: share of runs of PHRASE words that repeat an earlier run of the text above 0.5
- wordless: share of words without a letter (any non-ASCII character counts as one) above 0.5

Defined results: null and empty texts are rejected; every row has a result, null ids included; an empty table gives an
empty result; other columns are ignored. Words are runs of bytes above the blank; texts are read whole.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import U64, Words, chunks, mix, spans, strings, tidy
from .common import table

SAMPLE_ROWS = 2000
PHRASE = 5
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*"))
_PIPE = np.arange(256) == ord("|")
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_LETTER = _UPPER | np.array([97 <= c <= 122 for c in range(256)])
_WORDY = _LETTER | (np.arange(256) >= 128)
_CHARACTER = (np.arange(256) & 0xC0) != 0x80
_LINE = np.arange(256) != 10
_INK = np.arange(256) > 32


def _sums(hit: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _of_characters(table_: np.ndarray):
    def measure(off, data):
        return _share(_sums(table_[data], off), _sums(_CHARACTER[data], off))

    return measure


def _empty(off, data):
    return (_sums(_INK[data], off) == 0).astype(float)


def _shouting(off, data):
    return _share(_sums(_UPPER[data], off), _sums(_LETTER[data], off))


def _stutter(off, data):
    w = Words(off, data, 0, len(off) - 1)
    h = w.hashes()
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[w.first[:-1][w.count > 0]] = False
    return _share(_sums(same, w.first), w.count)


def _repeated_lines(off, data):
    w = Words(off, data, 0, len(off) - 1, _LINE)
    ink = np.concatenate([[0], np.cumsum(_INK[data])])
    full = ink[w.end] > ink[w.start]
    row, h = w.row()[full], w.hashes(1)[full]
    n = np.bincount(row, minlength=len(off) - 1)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    same = np.zeros(len(h), bool)
    same[1:] = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
    return _share(np.bincount(row[same], minlength=len(off) - 1), n)


def _repeated_phrases(off, data):
    w = Words(off, data, 0, len(off) - 1)
    if len(w.start) < PHRASE:
        return np.zeros(len(off) - 1)
    row = w.row()[: len(w.start) - PHRASE + 1]
    inside = w.stop()[: len(row)] - np.arange(len(row)) >= PHRASE
    row = row[inside]
    key = mix(spans(w.hashes(), PHRASE, 4)[inside] ^ mix(row.astype(U64), 6))  # equal in one row only
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    return _share(np.bincount(row[order][1:][same], minlength=len(off) - 1), np.maximum(w.count - PHRASE + 1, 0))


def _wordless(off, data):
    w = Words(off, data, 0, len(off) - 1)
    seen = np.concatenate([[0], np.cumsum(_WORDY[data])])
    return _share(_sums(seen[w.end] == seen[w.start], w.first), w.count)


#: name -> (measure of each row from offsets and bytes, limit)
RULES = {
    "empty": (_empty, 0.5),
    "symbols": (_of_characters(_SYMBOL), 0.1),
    "pipes": (_of_characters(_PIPE), 0.015),
    "shouting": (_shouting, 0.4),
    "stutter": (_stutter, 0.3),
    "repeated_lines": (_repeated_lines, 0.5),
    "repeated_phrases": (_repeated_phrases, 0.5),
    "wordless": (_wordless, 0.5),
}


def _rejected(rule: str, off: np.ndarray, data: np.ndarray) -> np.ndarray:
    measure, limit = RULES[rule]
    return measure(off, data) > limit


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        off, data = strings(batch.column("text"))
        for i, j in chunks(off):
            own, piece = off[i : j + 1] - off[i], data[off[i] : off[j]]
            for rule in RULES:
                began = time.thread_time()
                out = int(_rejected(rule, own, piece).sum())
                spent = time.thread_time() - began
                yield pa.RecordBatch.from_pylist([{"rule": rule, "seconds": spent, "bytes": len(piece), "n": j - i, "rejected": out}])


def cascade(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules in the order of rejection per cost on a sample of about `sample_rows` rows."""
    rows = docs.count()
    sample = docs.select("text").sample(min(1.0, sample_rows / max(rows, 1)), seed=7)
    seen = sample.mapInArrow(tidy(_probe), "rule string, seconds double, bytes long, n long, rejected long")
    found = {r["rule"]: r for r in seen.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("seconds", "bytes", "n", "rejected"))).collect()}

    def worth(rule: str) -> float:
        r = found.get(rule)
        return 0.0 if r is None else (r["rejected"] / max(r["n"], 1)) / max(r["seconds"] / max(r["bytes"], 1), 1e-12)

    return sorted(RULES, key=lambda r: (-worth(r), r))


def kept(column: pa.Array, order: list[str]) -> np.ndarray:
    """Which texts no rule rejects; a rule sees only what passed those before it."""
    good = np.ones(len(column), bool)
    off, data = strings(column)
    for i, j in chunks(off):
        alive = np.arange(j - i)
        own, piece = off[i : j + 1] - off[i], data[off[i] : off[j]]
        for rule in order:
            bad = _rejected(rule, own, piece)
            if bad.any():
                good[i + alive[bad]] = False
                alive, size = alive[~bad], np.diff(own)
                piece = piece[np.repeat(~bad, size)]
                own = np.concatenate([[0], np.cumsum(size[~bad])])
            if not len(alive):
                break
    return good


def _verdicts(order: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept(batch.column("text"), order))], ["doc_id", "keep"])

    return run


def verdicts(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(doc_id, keep) of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_verdicts(order or cascade(docs))), "doc_id long, keep boolean")


def _passing(order: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(kept(batch.column("text"), order)))

    return run


def passing(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows that no rule rejects, unchanged."""
    return docs.mapInArrow(tidy(_passing(order or cascade(docs))), docs.schema)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT doc_id, t, length(t) AS n, list_filter(string_split_regex(t, '[\x00-\x20]+'), lambda x: x <> '') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x00-\x20]')) AS l FROM base),
measured AS (SELECT doc_id, len(w) AS words,
    (n - length(regexp_replace(t, '[#$%&*]', '', 'g'))) / greatest(n, 1) AS symbols,
    (n - length(replace(t, '|', ''))) / greatest(n, 1) AS pipes,
    (n - length(regexp_replace(t, '[A-Z]', '', 'g'))) / greatest(n - length(regexp_replace(t, '[A-Za-z]', '', 'g')), 1) AS shouting,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) / greatest(len(w), 1) AS stutter,
    (len(l) - len(list_distinct(l))) / greatest(len(l), 1) AS repeated,
    (greatest(len(w) - 4, 0) - len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))))) / greatest(len(w) - 4, 1) AS phrases,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) / greatest(len(w), 1) AS wordless FROM parts)
SELECT doc_id, words > 0 AND symbols <= 0.1 AND pipes <= 0.015 AND shouting <= 0.4 AND stutter <= 0.3 AND repeated <= 0.5 AND phrases <= 0.5 AND wordless <= 0.5 AS keep
FROM measured
"""
