"""Substring deduplication: every run of `window` words that occurs more than once in the corpus.

Method: a count-min sketch as prefilter, then an exact second pass.

1. Each partition counts, in a sparse count-min sketch of two rows, the anchors of its windows. A window's anchor is the
   smallest hash among the shorter `anchor`-word grams inside it: equal windows have equal anchors at equal offsets, so an
   anchor is counted at least as often as any of its windows and the sketch can only overestimate. There are about
   thirteen times fewer anchors than windows, which keeps the sketch small.
2. The partition sketches are merged by block of cells (a shuffle of sparse cells, no driver work); of the merged counts
   only "two or more" matters, so a block leaves its reducer as a bit map. The maps are broadcast: their size is at most
   `max_cells` bits for each row whatever the corpus. A corpus too large for that gets a fuller sketch, hence more false
   candidates, never a lost window.
3. A second pass computes 128-bit hashes of only those windows whose anchor is estimated at two or more, and groups them
   exactly. A partition sends one row per distinct window (its other occurrences are already proven repeats), so a passage
   that occurs a billion times costs a reducer as many rows as there are partitions.

The occurrence with the smallest (doc_id, position) is kept, all others are to be removed.

Defined results: words are runs of bytes above the blank (ASCII control characters and blanks separate words). Null or
empty texts, texts of fewer than `window` words and null ids give no rows. Rows that repeat both id and text count once.
Other columns are ignored. An empty table gives an empty result. Texts are never cut, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buffers import U64, Words, by_group, chunks, mix, pack, sliding, spans, strings, tidy, tidy_group, unpack_all
from .common import free_name, power_of_two, table, text_bytes

WINDOW = 50
MAX_CELLS = 1 << 29
BLOCK = 1 << 20
WINDOWS_A_GROUP = 2_000_000


def _cell(anchor: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(anchor, row + 1) & U64(cells - 1)).astype(np.int64)


def _anchored(words: Words, window: int, anchor: int):
    """Word hashes, which windows lie inside one text, anchor of each window, gram hashes."""
    h = words.hashes()
    if len(h) < window:
        return h, np.zeros(0, bool), np.zeros(0, U64), np.zeros(0, U64)
    grams = spans(h, anchor, 1)
    least = sliding(np.minimum, grams, window - anchor + 1)
    whole = words.stop()[: len(least)] - np.arange(len(least)) >= window
    return h, whole, least, grams


def _sketch(window: int, anchor: int, cells: int):
    """Arrow function: a partition's sparse sketch, one row per (row of the sketch, block of cells)."""
    block, width = min(BLOCK, cells), window - anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            off, data = strings(batch.column("text"))
            for i, j in chunks(off):
                _, whole, least, grams = _anchored(Words(off, data, i, j), window, anchor)
                if whole.any():
                    edge = np.zeros(width - 1, U64)
                    most = sliding(np.maximum, np.concatenate([edge, np.where(whole, least, U64(0)), edge]), width)
                    found.append(grams[(most == grams) & (most > 0)])
        anchors = np.concatenate(found) if found else np.zeros(0, U64)
        out: dict[str, list] = {"row": [], "block": [], "once": [], "more": []}
        for row in range(2):
            cell, count = np.unique(_cell(anchors, row, cells), return_counts=True)
            for b, at in by_group(cell // block):
                low, n = (cell[at] % block).astype(np.uint32), count[at]
                for k, v in (("row", row), ("block", b), ("once", low[n == 1].tobytes()), ("more", low[n > 1].tobytes())):
                    out[k].append(v)
        schema = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
        yield pa.RecordBatch.from_pydict(out, schema)

    return run


def _merge(block: int):
    """Arrow function: merges one block of all partitions' sketches; the cells with a count of two or more as bits."""

    def run(key, part):
        total = np.zeros(block, np.int64)
        for name, n in (("once", 1), ("more", 2)):
            for x in part.column(name).to_pylist():
                total[np.frombuffer(x, np.uint32)] += n
        bits = np.packbits(total >= 2, bitorder="little").tobytes()
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "bits": pa.array([bits], pa.binary())})

    return run


def _runs(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of successive positions of one document; both are in order."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)])
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(doc))).astype(np.int32)


def _grouped(wa, wb, doc, pos):
    """Order by (window, document, position), without repeated rows; where each window begins; its group number."""
    order = np.lexsort((pos, doc, wb, wa))
    wa, wb, doc, pos = wa[order], wb[order], doc[order], pos[order]
    same = (wa[1:] == wa[:-1]) & (wb[1:] == wb[:-1])
    fresh = np.concatenate([[True], ~(same & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1]))])[: len(order)]
    first = np.concatenate([[True], ~same])[: len(order)][fresh]
    return order[fresh], first


def _candidates(window: int, anchor: int, groups: int, cells: int, maps):
    """Arrow function: windows whose anchor may be repeated, by group of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(x, np.uint8) for x in maps.value]
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            off, data = strings(batch.column("text"))
            parts = []
            for i, j in chunks(off):
                words = Words(off, data, i, j)
                h, whole, least, _ = _anchored(words, window, anchor)
                at = np.flatnonzero(whole)
                for row, b in enumerate(bits):  # the estimate is the least of the rows
                    cell = _cell(least[at], row, cells)
                    at = at[(b[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0]
                if len(at):
                    row = words.row()[at]
                    parts.append((spans(h, window, 2)[at], spans(h, window, 3)[at], ids[i + row], (at - words.first[row]).astype(np.int32), (mix(least[at], 9) % U64(groups)).astype(np.int32)))
            if not parts:
                continue
            wa, wb, doc, pos, group = (np.concatenate(x) for x in zip(*parts))
            order, first = _grouped(wa, wb, doc, pos)
            start = np.flatnonzero(first)
            more = np.diff(np.append(start, len(order))) > 1
            keep, rest = order[start], order[~first]
            rest = rest[np.lexsort((pos[rest], doc[rest]))]
            at, length = _runs(doc[rest], pos[rest])
            tail = by_group(np.arange(len(at)) % groups)
            gone = {g: (doc[rest][at[x]], pos[rest][at[x]], length[x]) for g, x in tail}
            out = {"group": [], "blob": []}
            seat = np.lexsort((pos[keep], doc[keep]))
            keep, more = keep[seat], more[seat]
            kept = dict(by_group(group[keep]))
            none = (np.zeros(0, ids.dtype), np.zeros(0, np.int32), np.zeros(0, np.int32))
            for g in sorted(kept.keys() | gone.keys()):
                x = kept.get(g, np.zeros(0, np.int64))
                k = keep[x]
                at, length = _runs(doc[k], pos[k])
                out["group"].append(g)
                out["blob"].append(pack(wa[k], wb[k], more[x], doc[k][at], pos[k][at], length, *gone.get(g, none)))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("group", pa.int32()), ("blob", pa.binary())]))

    return run


def _exact(key, part):
    """Groups windows exactly; runs of first occurrences (kept) and of further ones (removed)."""
    wa, wb, more, doc, pos, length, *gone = unpack_all(part.column("blob").to_pylist())
    inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    doc, pos = np.repeat(doc, length), np.repeat(pos, length) + inner
    order, first = _grouped(wa, wb, doc, pos)
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(order)))
    many = np.logical_or.reduceat(more[order], start) | (size > 1) if len(start) else np.zeros(0, bool)
    out = []
    for removed, x in ((False, order[start[many]]), (True, order[~first])):
        x = x[np.lexsort((pos[x], doc[x]))]
        at, n = _runs(doc[x], pos[x])
        out.append((doc[x][at], pos[x][at], n, np.full(len(at), removed)))
    out.append((*gone, np.ones(len(gone[0]), bool)))
    d, p, n, r = (np.concatenate(x) for x in zip(*out))
    return pa.table({"doc_id": pa.array(d, pa.int64()), "start": pa.array(p, pa.int32()), "n": pa.array(n, pa.int32()), "removed": pa.array(r)})


def repeated_spans(docs: DataFrame, window: int = WINDOW, max_cells: int = MAX_CELLS) -> DataFrame:
    """Word ranges [start_word, end_word) of each document that repeat: (doc_id, start_word, end_word, removed).

    removed tells ranges made of later occurrences from ranges made of first ones. See the module for the rest.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    size, anchor = text_bytes(docs), window // 2
    cells = min(max(power_of_two(size / 20), 1 << 16), max_cells)
    groups = max(8, size // 6 // WINDOWS_A_GROUP)
    sketch = docs.select("text").mapInArrow(tidy(_sketch(window, anchor, cells)), "row int, block int, once binary, more binary")
    merged = sketch.groupBy("row", "block").applyInArrow(tidy_group(_merge(min(BLOCK, cells))), "row int, block int, bits binary")
    maps = [bytearray(cells // 8) for _ in range(2)]
    for x in merged.toLocalIterator():
        at = x["block"] * min(BLOCK, cells) // 8
        maps[x["row"]][at : at + len(x["bits"])] = x["bits"]
    held = docs.sparkSession.sparkContext.broadcast([bytes(x) for x in maps])
    found = docs.mapInArrow(tidy(_candidates(window, anchor, groups, cells, held)), "group int, blob binary")
    runs = found.groupBy("group").applyInArrow(tidy_group(_exact), "doc_id long, start int, n int, removed boolean")
    runs = runs.select("doc_id", "removed", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1 + window).alias("hi"))
    order = Window.partitionBy("doc_id", "removed").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("lo") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        runs.withColumn("reach", reach)
        .withColumn("island", island)
        .groupBy("doc_id", "removed", "island")
        .agg(F.min("lo").alias("start_word"), F.max("hi").alias("end_word"))
        .select("doc_id", "start_word", "end_word", "removed")
    )


def _cut(column: str):
    """Arrow function: cuts the ranges of words in `column` out of the text, and drops that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column("text").to_pylist(), batch.column(column).to_pylist()
            for r, spots in enumerate(cuts):
                if spots and texts[r] is not None:
                    raw = texts[r].encode()
                    off = np.array([0, len(raw)])
                    words = Words(off, np.frombuffer(raw, np.uint8), 0, 1)
                    begin = np.append(words.start, len(raw))
                    keep, last = [], 0
                    for s in sorted(spots, key=lambda x: x["start_word"]):
                        keep.append(raw[last : begin[s["start_word"]]])
                        last = begin[min(s["end_word"], len(begin) - 1)]
                    texts[r] = b"".join([*keep, raw[last:]]).decode()
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type)).drop_columns([column])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without the later occurrences of repeated windows; columns as before, n_chars counted anew.

    A document of which no word is left goes. Null ids and texts stay as they are.
    """
    cuts = repeated_spans(docs, window).where("removed").groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("__cuts"))
    doc, spots = free_name(docs, "doc"), free_name(docs, "cuts")
    cuts = cuts.select(F.col("doc_id").alias(doc), F.col("__cuts").alias(spots))
    joined = docs.join(cuts, docs["doc_id"].cast("long") == cuts[doc], "left").drop(doc)
    whole = joined.where(F.col(spots).isNull()).drop(spots)
    out = joined.where(F.col(spots).isNotNull()).mapInArrow(tidy(_cut(spots)), docs.schema).where(F.col("text").rlike("[^\\x00-\\x20]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(out)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
words AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x00-\x20]+'), lambda x: x <> '') AS w FROM docs),
windows AS (SELECT doc_id, w, unnest(range(0, len(w) - {WINDOW - 1})) AS pos FROM words WHERE len(w) >= {WINDOW}),
keyed AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + {WINDOW}], ' ') AS content FROM windows),
ranked AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY content) AS n,
                  row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS r FROM keyed),
hits AS (SELECT doc_id, pos AS lo, pos + {WINDOW} AS hi, r > 1 AS removed FROM ranked WHERE n > 1),
reached AS (SELECT *, max(hi) OVER (PARTITION BY doc_id, removed ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits),
islands AS (SELECT *, sum(CASE WHEN lo <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, removed ORDER BY lo ROWS UNBOUNDED PRECEDING) AS island FROM reached)
SELECT doc_id, CAST(min(lo) AS INTEGER) AS start_word, CAST(max(hi) AS INTEGER) AS end_word, removed
FROM islands GROUP BY doc_id, removed, island
"""
