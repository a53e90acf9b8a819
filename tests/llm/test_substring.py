from collections import defaultdict

from tests.conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from tessera.llm import queries, substring
from tessera.llm.buffers import Words, chunks, range_hashes, spans, strings

import numpy as np
import pyarrow as pa


def split(text):
    return [w for w in bytes(c if c > 32 else 32 for c in text.encode()).split(b" ") if w]


def brute(rows, window):
    """Ranges as the module defines them, from all windows of all texts."""
    seen = defaultdict(list)
    for doc, text in {(d, t) for d, t in rows if d is not None and t is not None}:
        w = split(text)
        for p in range(len(w) - window + 1):
            seen[tuple(w[p : p + window])].append((doc, p))
    marks = {False: defaultdict(set), True: defaultdict(set)}
    for places in seen.values():
        if len(set(places)) > 1:
            first, *rest = sorted(set(places))
            marks[False][first[0]].add(first[1])
            for d, p in rest:
                marks[True][d].add(p)
    out = set()
    for removed, docs in marks.items():
        for d, starts in docs.items():
            lo = hi = None
            for p in sorted(starts):
                if lo is None or p > hi:
                    if lo is not None:
                        out.add((d, lo, hi, removed))
                    lo = p
                hi = p + window
            out.add((d, lo, hi, removed))
    return out


def found(df, window):
    return {tuple(r) for r in substring.repeated_spans(df, window).select("doc_id", "start_word", "end_word", "removed").collect()}


def test_messy_rows_as_brute_force(messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    for window in (3, 50):
        assert found(messy, window) == brute(rows, window)


def test_small_texts_as_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(rng.choice(list("abc"), rng.integers(0, 25)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for window in (4, 7):
        assert found(df, window) == brute(rows, window)


def test_full_sketch_loses_nothing(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), " ".join(map(str, rng.integers(0, 60, 90)))) for i in range(60)] + [(100, "p q r s t u v w"), (101, "z p q r s t u v w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in substring.repeated_spans(df, 4, max_cells=64).select("doc_id", "start_word", "end_word", "removed").collect()} == brute(rows, 4)


def test_sql(same):
    assert same(queries.QUERIES["op1_substring_dedup"], queries.SQL["op1_substring_dedup"], DATA / "sf0.001") > 0


def test_removal_keeps_one_of_each_and_all_else(messy):
    rows = messy.collect()
    out = substring.remove_repeats(messy, 50)
    assert out.columns == messy.columns
    left = out.collect()
    assert not {s for s in found(out, 50) if s[3]}
    text = {r["doc_id"]: r["text"] for r in left if r["doc_id"] not in (None, 5)}
    assert text[7].split() == ["before", "it", "and", "after", "it", "some", "more"]
    assert 6 not in text
    assert text[13] == next(r["text"] for r in rows if r["doc_id"] == 13)
    assert text[0] is None and text[1] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in left if r["doc_id"] in (7, 8, 14))


def test_empty_table(empty):
    assert substring.repeated_spans(empty).count() == 0
    assert substring.remove_repeats(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aé \n漢", max_size=12), max_size=6))
def test_words_and_hashes(texts):
    off, data = strings(pa.array(texts, pa.string()))
    for i, j in chunks(off, 16):
        w = Words(off, data, i, j)
        own = [split(t) for t in texts[i:j]]
        assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)] == [x for o in own for x in o]
        assert w.count.tolist() == [len(o) for o in own]
        h = w.hashes()
        names = [x for o in own for x in o]
        assert all((h[a] == h[b]) == (names[a] == names[b]) for a in range(len(h)) for b in range(a))
        s = spans(h, 2)
        assert all((s[a] == s[b]) == (names[a : a + 2] == names[b : b + 2]) for a in range(len(s)) for b in range(a))
    assert len(range_hashes(data, np.zeros(0, int), np.zeros(0, int))) == 0
