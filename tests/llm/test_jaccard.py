import re
import tracemalloc
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA
from tessera.llm import jaccard, queries
from tessera.llm.buffers import ALNUM, U64, Words, mix, pack, strings
from tessera.llm.common import small_batches, stored


def grams(text, n):
    w = [x for x in re.split(r"[\x00-/:-@\[-`{-\x7f]+", text.lower()) if x]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def sets_of(rows, n):
    """Ids of each distinct set, in order; ids of documents without one."""
    sets, bare = {}, set()
    for d, t in {(d, t) for d, t in rows if d is not None}:
        if g := grams(t or "", n):
            sets.setdefault(g, set()).add(d)
        else:
            bare.add(d)
    return {g: sorted(ids) for g, ids in sets.items()}, bare


def brute(rows, n, threshold):
    """Pairs of different sets, each by the lowest id that has it."""
    out = set()
    for (g, a), (h, b) in combinations([(g, ids[0]) for g, ids in sets_of(rows, n)[0].items()], 2):
        both = len(g & h)
        if both / len(g | h) >= threshold:
            out.add((min(a, b), max(a, b), both, round(both / len(g | h), 9)))
    return out


def brute_classes(rows, n, threshold):
    """(doc_id, class_id, links) from every two documents, sets that are equal included."""
    sets, bare = sets_of(rows, n)
    docs = [(d, g) for g, ids in sets.items() for d in ids]
    near = {(g, h): len(g & h) / len(g | h) >= threshold for g in sets for h in sets}
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(docs)), 2):
        if near[docs[i][1], docs[j][1]]:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    lowest = {}
    for i, (d, _) in enumerate(docs):
        lowest[top(i)] = min(d, lowest.get(top(i), d))
    out = [(d, lowest[top(i)], sum(near[g, h] for _, h in docs) - 1) for i, (d, g) in enumerate(docs)]
    return sorted(out + [(d, d, 0) for d in bare])


def found(df, n, threshold, **kw):
    return {(r["doc_a"], r["doc_b"], r["overlap"], round(r["jaccard"], 9)) for r in jaccard.similar_pairs(df, n, threshold, **kw).collect()}


def found_classes(df, n, threshold, **kw):
    return sorted(tuple(r) for r in jaccard.classes(df, n, threshold, **kw).select("doc_id", "class_id", "links").collect())


def groups(pairs):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b, *_ in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {x: top(x) for x in root}


@pytest.mark.parametrize("n,threshold", [(1, 0.5), (2, 0.3), (2, 0.8)])
def test_small_texts_as_brute_force(spark, n, threshold):
    rng = np.random.default_rng(n)
    rows = [(int(i), " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 14)))) for i in range(150)]
    # frequent n-grams outside the prefix, and groups of copies
    common = " ".join(f"c{i}" for i in range(12))
    rows += [(1000 + i, common + " " + " ".join(f"u{i}v{j}" for j in range(i % 20))) for i in range(60)]
    rows += [(2000 + i, "many copies of this text") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(df, n, threshold) == brute(rows, n, threshold)
    assert found_classes(df, n, threshold) == brute_classes(rows, n, threshold)
    if threshold < 0.5:  # n-grams of so many documents take the way of hot ones; fragments are parted in two steps
        assert found(df, n, threshold, hot=8) == brute(rows, n, threshold)
        assert found(df, n, threshold, hot=8, keys=2) == brute(rows, n, threshold)


def test_a_third_of_all_rows_are_copies_and_a_third_shares_a_passage(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, "the same text again and again and again") for i in range(300)]
    rows += [(1000 + i, passage + " " + " ".join(f"x{i}y{j}" for j in range(8 + i % 60))) for i in range(120)]
    rows += [(3000 + i, " ".join(f"q{i}r{j}" for j in range(20))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (jaccard.HOT, 50):
        assert found_classes(df, 5, 0.5, hot=hot) == brute_classes(rows, 5, 0.5)


def test_many_short_texts_in_a_chunk():
    """10,000 rows with n-grams of 60 bits: rows and n-grams don't fit 64 bits together."""
    texts = [f"a{i} b{i % 7}" for i in range(10_000)]
    off, data = strings(pa.array(texts))
    for bits in (60, 64, 50):
        row, g = jaccard.gram_sets(Words(off, data, 0, len(texts), ALNUM), 1, bits)
        assert np.bincount(row, minlength=len(texts)).tolist() == [2] * len(texts)
        assert len(np.unique(g)) == 10_007 and (np.diff(row) >= 0).all()
    high, low = np.array([5, 1, 5, 1 << 33]), np.array([3, 2, 3, 1 << 29], np.uint64)
    for bits in (30, 31):  # together they fit 64 bits, or don't
        a, b = jaccard._distinct(high, low, bits, 1 << 34)
        assert list(zip(a.tolist(), b.tolist())) == [(1, 2), (5, 3), (1 << 33, 1 << 29)]


def blobs_of(blobs):
    """Batches of ten blobs, as a group of fragment 0 gets them."""
    return [pa.RecordBatch.from_pydict({"key": [0] * len(b), "blob": b}, jaccard.BLOBS) for b in (blobs[i : i + 10] for i in range(0, len(blobs), 10))]


def test_a_fragment_in_which_all_n_grams_repeat_is_sent_in_parts():
    """2 million postings, each n-gram in two entities: no part of the result holds them all, nor do all stand in memory as words of 64 bits."""
    many, docs = 500, 100
    g = mix(np.arange(1_000_000, dtype=U64)) & jaccard.LOW
    blobs = []
    for b in range(40):
        own = np.concatenate([np.sort(x) for x in g.reshape(-1, many)[b % 20 * docs : b % 20 * docs + docs]])
        sig = mix(np.arange(docs, dtype=U64) + U64(b * docs + 7))
        blobs.append(pack(*jaccard._split(own), np.full(docs, many, np.uint32), sig, sig[:5], np.full(5, many, np.int32)))
    batches = blobs_of(blobs)
    tracemalloc.start()
    seen, own, most = [], 0, 0
    for out in jaccard._repeated(8)((pa.scalar(0),), iter(batches)):
        parts = [jaccard.unpack(x.as_buffer()) for x in out.column("blob")]
        most = max(most, sum(len(x[1]) for x in parts))
        seen.append(np.concatenate([jaccard._joined(x[1], x[2]) for x in parts]))
        assert all((x[5] == 2).all() for x in parts)
        own += sum(len(x[6]) for x in parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    seen = np.sort(np.concatenate(seen))
    assert np.array_equal(seen, np.repeat(np.unique(g), 2)) and own == 200
    assert most < 700_000 and peak < 2_000_000 * 34  # 16 MB of them are what this test collects


def test_partial_sums_of_a_fragment_add_up(monkeypatch):
    rng = np.random.default_rng(3)
    pool = mix(np.arange(60, dtype=U64)) & jaccard.LOW
    sets = [np.sort(rng.choice(pool, 30, replace=False)) for _ in range(40)] + [np.sort(pool)] * 300  # the last make groups of over 256
    sig = np.sort(mix(np.arange(len(sets), dtype=U64)))
    size = np.array([len(x) for x in sets], np.int32)
    blobs = [pack(*jaccard._split(np.concatenate(sets)), size.astype(np.uint32), np.packbits(np.ones(size.sum(), bool)), sig, size)]

    def overlaps():
        out, rows = {}, 0
        for batch in jaccard._overlaps(8, 0.1, 0)((pa.scalar(0),), iter(blobs_of(blobs))):
            for r in batch.to_pylist():
                if r["n"]:
                    rows += 1
                    out[r["a"], r["b"]] = out.get((r["a"], r["b"]), 0) + r["n"]
        return out, rows

    whole, rows = overlaps()
    assert rows == len(whole)
    name = sig.view(np.int64).tolist()
    assert whole == {(name[i], name[j]): n for i, j in combinations(range(len(sets)), 2) if (n := len(np.intersect1d(sets[i], sets[j])))}
    monkeypatch.setattr(jaccard, "PAIRS_HELD", 5000)
    parts, rows = overlaps()
    assert parts == whole and rows > len(whole)


def test_partial_overlaps_are_sent_in_batches_of_bounded_size():
    """245,000 pairs and as many as 400,000 n-grams to be looked up: before, batches of all of them."""
    sets = 700
    sig = np.sort(mix(np.arange(sets, dtype=U64)))
    g = np.sort(mix(np.arange(20, dtype=U64)) & jaccard.LOW)
    blobs = [pack(*jaccard._split(np.tile(g, sets)), np.full(sets, 20, np.uint8), np.packbits(np.ones(20 * sets, bool)), sig, np.full(sets, 20, np.int32))]
    out = list(jaccard._overlaps(8, 0.5, 0)((pa.scalar(0),), iter(blobs_of(blobs))))
    assert max(x.num_rows for x in out) <= 200_000
    rows = pa.Table.from_batches(out)
    name = sig.view(np.int64)
    assert sorted(zip(rows["a"].to_pylist(), rows["b"].to_pylist())) == sorted((int(name[i]), int(name[j])) for i, j in combinations(range(sets), 2))
    assert set(rows["n"].to_pylist()) == {20}

    g = np.sort(mix(np.arange(400_000, dtype=U64)) & jaccard.LOW & ~U64(31 << 32))  # all of them in one part; hot ones, so all are looked up
    blobs = [pack(*jaccard._split(g), np.full(1, len(g), np.uint32), np.packbits(np.zeros(len(g), bool)), sig[:1], np.full(1, len(g), np.int32))]
    out = list(jaccard._overlaps(8, 0.5, 5)((pa.scalar(8),), iter(blobs_of(blobs))))
    assert max(x.num_rows for x in out) <= 200_000 and sum(x.num_rows for x in out) == len(g)


def test_groups_go_to_python_in_small_batches(spark, monkeypatch):
    """A group of 40 MB came as one batch; both steps with Python run with small ones, and the session's setting is as before after them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes for b in batches]})

    blobs = spark.range(40).select(F.lit(1).alias("key"), F.expr("CAST(repeat(chr(65 + id), 1000000) AS BINARY) AS blob"))
    with small_batches(spark):
        seen = [r["bytes"] for r in blobs.groupBy("key").applyInArrow(sizes, "bytes long").collect()]
    assert sum(seen) >= 40_000_000 and max(seen) < 10_000_000

    held = []
    monkeypatch.setattr(jaccard, "stored", lambda df, *how: held.append(spark.conf.get(name, None)) or stored(df, *how))
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c d")], "doc_id long, text string")
    for before in (None, "123456789"):
        if before:
            spark.conf.set(name, before)
        assert found(docs, 1, 0.5) == {(1, 2, 3, 0.75)} and spark.conf.get(name, None) == before
    spark.conf.unset(name)
    assert held == [str(8 << 20)] * 4


def test_a_stored_file_has_a_bounded_number_of_rows(spark):
    df = stored(spark.range(25_000).coalesce(1), "many", 10_000)
    assert df.count() == 25_000 and sorted(pq.ParquetFile(f.removeprefix("file://")).metadata.num_rows for f in df.inputFiles()) == [5_000, 10_000, 10_000]


def test_sums_of_pairs_in_one_word_or_two():
    for most in (50, 1 << 40, 1 << 62):
        pair, count = np.array([7, 3, 7, most - 1, 3]), np.array([1, 2, 3, 4, 70_000], np.uint32)
        got = jaccard._summed([(pair[:2], count[:2]), (pair[2:], count[2:])], most)
        assert [x.tolist() for x in got] == [[3, 7, most - 1], [70_002, 4, 4]]


def test_messy_rows_as_brute_force(messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert found(messy, 5, 0.5) == brute(rows, 5, 0.5)
    assert found_classes(messy, 5, 0.5) == brute_classes(rows, 5, 0.5)


def test_sql(same):
    assert same(queries.QUERIES["op2_ngram_jaccard"], queries.SQL["op2_ngram_jaccard"], DATA / "sf0.001") > 0


def test_components_of_a_long_chain_and_a_star(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "doc_a long, doc_b long")
    got = {r["doc_id"]: r["root"] for r in jaccard.components(df).collect()}
    assert got == {k: v for k, v in groups(edges).items() if k != v}
    assert jaccard.components(df.limit(0)).count() == 0


def test_one_document_of_each_group_stays(messy):
    rows = messy.collect()
    out = jaccard.without_copies(messy, 5, 0.5)
    assert out.columns == messy.columns
    kept = [r["doc_id"] for r in out.collect()]
    gone = {d for d, c, _ in brute_classes([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] != 5], 5, 0.5) if d != c}
    assert {6, 14} >= gone - {7, 8} and 13 in kept and 14 not in kept
    assert len([x for x in kept if x is not None]) == len({x for x in kept if x is not None})
    assert kept.count(None) == 2 and {0, 1, 2} <= set(kept)


def test_empty_table(empty):
    assert jaccard.similar_pairs(empty).count() == 0 and jaccard.classes(empty).count() == 0
    assert jaccard.without_copies(empty).count() == 0


def near_copies(groups, many, words=60, seed=5):
    """Texts of which those of a group differ in a few words; some are copies."""
    rng, rows = np.random.default_rng(seed), []
    for k in range(groups):
        base = [f"g{k}w{j}" for j in range(words)]
        for i in range(many):
            own = list(base)
            for j in rng.integers(0, words, rng.integers(0, 5)):
                own[j] = f"e{rng.integers(0, 10**6)}"
            rows.append((k * 10_000 + i, " ".join(own)))
    return rows


def test_near_copies_are_decided_where_they_meet(spark, monkeypatch):
    """Of 80 near copies each pair was sent from every fragment that they share: 15,000 rows for 8 fragments, and more with each further one."""
    rows = near_copies(2, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sent = []
    keep = lambda out, name: (sent.append(out.where("n > 0").count()) if name == "overlaps" else None, out)[1]
    monkeypatch.setattr(jaccard, "stored", lambda df, name, *how: keep(stored(df, name, *how), name))
    assert found_classes(df, 5, 0.5) == brute_classes(rows, 5, 0.5)
    assert sent[0] < 300
    monkeypatch.setattr(jaccard, "POSTINGS_A_FRAGMENT", 50)
    assert found_classes(df, 5, 0.5) == brute_classes(rows, 5, 0.5)
    assert sent[1] < 300
    monkeypatch.setattr(jaccard, "SPREAD", 8)  # n-grams of a group are counted in many fragments
    assert found_classes(df, 5, 0.5) == brute_classes(rows, 5, 0.5)
    assert found_classes(df, 5, 0.5, hot=40) == brute_classes(rows, 5, 0.5)
    assert found(df, 5, 0.5) == brute(rows, 5, 0.5)


def test_pairs_are_counted_whole(monkeypatch):
    rng = np.random.default_rng(0)
    for n, many, low, high, at_once, cells in [(50, 200, 2, 20, 300_000, 1 << 22), (300, 200, 150, 290, 20, 1 << 22), (300, 200, 150, 290, 20, 1000), (400, 300, 2, 300, 50, 1 << 22)]:
        monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", at_once)
        monkeypatch.setattr(jaccard, "CELLS_OF_GRID", cells)
        groups = [np.sort(rng.choice(n, rng.integers(low, high), replace=False)) for _ in range(many)]
        size = np.array([len(g) for g in groups])
        grid = np.zeros((n, many), np.int64)
        grid[np.concatenate(groups), np.repeat(np.arange(many), size)] = 1
        got = np.zeros((n, n), np.int64)
        for a, b, times in jaccard._whole(np.concatenate(groups).astype(np.int32), np.cumsum(size) - size, size, n):
            assert not got[a, b].any() and (a < b).all()
            got[a, b] = times
        assert np.array_equal(got, np.triu(grid @ grid.T, 1))


def test_pairs_that_join_groups():
    rng = np.random.default_rng(1)
    root, links, pairs = np.arange(300), [], rng.integers(0, 300, (2, 260))
    for part in np.array_split(pairs, 9, axis=1):
        links += jaccard._hooked(root, *part)
    links = np.concatenate(links, axis=1)
    own, few = groups(pairs.T.tolist()), groups(links.T.tolist())
    assert all(own[x] == root[x] == few.get(x, x) for x in own) and links.shape[1] == len(own) - len(set(own.values()))


def test_awkward_texts_with_decided_pairs(spark):
    """Frequent n-grams outside prefixes, sizes far apart, copies and near copies."""
    rng = np.random.default_rng(8)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = near_copies(3, 25, 30, 2) + [(100_000 + i, passage + " " + " ".join(f"x{i}y{j}" for j in range(5 + i % 70))) for i in range(90)]
    rows += [(200_000 + i, " ".join(rng.choice([f"v{j}" for j in range(12)], rng.integers(1, 40)))) for i in range(120)]
    rows += [(300_000 + i, t) for i, (_, t) in enumerate(rows[::7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n, threshold in ((5, 0.5), (1, 0.5), (2, 0.4), (2, 0.9)):
        assert found_classes(df, n, threshold) == brute_classes(rows, n, threshold)
