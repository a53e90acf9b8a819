import numpy as np
from tests.conftest import DATA
from pyspark.sql import functions as F
from tessera.llm import toxicity as T

BAD = ["vileword", "hateful", "scumbag", "filth"]


def corpus(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, rng.integers(20, 60)))
        toxic = i % 8 == 0
        if toxic:
            for _ in range(4):
                text.insert(int(rng.integers(0, len(text))), str(rng.choice(BAD)))
        rows.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_planted_documents(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(None, rows[0][1]), (5000, None), (5001, ""), (0, rows[0][1])], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("toxic", "word", "n", "score", "z")})
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (9, 1, None), (10, 1, 7)], "doc_id long, quality int, toxic int").withColumns({"text": F.lit("x"), "word": F.lit(2)})
    got = [r["doc_id"] for r in T.toxic(docs, T.induced(docs, lab)).collect()]
    want = {i for i, _ in rows if i % 8 == 0}
    assert len(got) == len(set(got))
    assert len(want & set(got)) / len(want) > 0.97 and len(set(got) - want) <= 0.01 * len(rows)


def test_held_out_documents(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    labels = spark.read.parquet(str(DATA / "sf0.01/labels.parquet"))
    model = T.induced(docs, labels.where("doc_id % 3 <> 0"))
    got = {r["doc_id"] for r in T.toxic(docs, model).collect()}
    held = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id % 3 = 0").collect()}
    toxic = {d for d, t in held.items() if t}
    tp = len(got & toxic)
    assert tp / len(toxic) > 0.6 and len((got & held.keys()) - toxic) <= 0.05 * len(held)


def test_walk_as_matrix_power():
    rng = np.random.default_rng(1)
    n = 12
    a = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.4), 1)
    a = a + a.T
    i, j = np.nonzero(a)
    seeds = np.array([0, 3])
    got = T.walk(np.stack([i, j], 1), a[i, j], n, seeds)
    start = np.zeros(n)
    start[seeds] = 0.5
    m = np.where(a.sum(1)[:, None] > 0, a / np.maximum(a.sum(1), 1e-12)[:, None], start[None])
    p = start
    for _ in range(60):
        p = (1 - T.RESTART) * p @ m + T.RESTART * start
    assert np.allclose(got, p)


def test_scores_as_brute_force(spark):
    rows, _ = corpus(200, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = np.array([0], np.uint64)
    import pyarrow as pa

    off, data = T.strings(pa.array(["vileword filth w3"]))
    words = T.Words(off, data, 0, 1, T.ALNUM).hashes()
    order = np.argsort(words)
    weight = np.array([2.0, 1.5, 0.25])
    names, values = words[order], weight[order]
    got = {r["doc_id"]: r["score"] for r in T.toxic(docs, T.Lexicon(names, values, -1.0)).collect()}
    for i, t in rows:
        own = set(t.split())
        assert abs(got[i] - sum(w for x, w in zip(["vileword", "filth", "w3"], weight) if x in own)) < 1e-6


def test_nothing_known(spark, messy, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int")
    for docs in (messy, empty):
        for labels in (none, one):
            assert T.toxic(docs, T.induced(docs, labels)).count() == 0
    both = spark.createDataFrame([(5, 1, 1), (3, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    assert T.toxic(messy, T.induced(messy, both)).count() == 0


def test_threshold():
    assert T.threshold(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0, 0, 1, 1])) == 1.5
    assert T.threshold(np.array([1.0, 1.0, 2.0]), np.array([0, 1, 1])) in (0.5, 1.5)


def hashes(*words):
    import pyarrow as pa

    off, data = T.strings(pa.array(list(words)), lower=True)
    return T.Words(off, data, 0, len(words), T.ALNUM).hashes()


def weighed(model, *words):
    return np.isin(hashes(*words), model.words).tolist()


def test_rare_words_and_many_seeds(spark):
    """A word of 8 in 12,000 documents that no labelled one has, and 120 words that are seeds."""
    rng = np.random.default_rng(4)
    words, slurs = [f"w{i}" for i in range(3000)], [f"slur{i}" for i in range(120)]
    rows, labels = [], []
    for i in range(12_000):
        text = list(rng.choice(words, 12))
        if i % 10 == 0:
            text += list(rng.choice(slurs, 4, replace=False)) + ["rarely", *slurs[:3]] * (i % 1500 == 0)
        rows.append((i, " ".join(text)))
        if i % 1500:
            labels.append((i, 1, int(i % 10 == 0)))
    model = T.induced(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert weighed(model, "rarely", "w1") == [True, False]
    assert all(weighed(model, *slurs))


def test_words_where_most_documents_have_seeds(spark):
    """Words that occur with seeds alone, where half of the documents have a seed."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1600):
        text = list(rng.choice(words, 25))
        if i % 2:
            text += list(rng.choice(BAD, 4)) + ["hidden"] * (i % 32 == 1)
        rows.append((i, " ".join(text)))
        if i % 32 != 1:
            labels.append((i, 1, i % 2))
    model = T.induced(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert weighed(model, "hidden", "w1", *BAD) == [True, False] + [True] * len(BAD)


def test_walks_over_a_stored_table(spark):
    rng = np.random.default_rng(6)
    a, b = np.triu_indices(30, 1)
    use = rng.random(len(a)) < 0.2
    kind = rng.integers(-1, 2, 30)
    edges = spark.createDataFrame([(int(x), int(y), float(w)) for x, y, w in zip(a[use], b[use], rng.random(use.sum()))], "a long, b long, weight double").repartition(3)
    here, apart = T.walks(edges, kind, rounds=8), T.walks(edges, kind, at_once=0, rounds=8)
    assert np.allclose(here, apart) and np.allclose(np.sum(here, 1), 1)


def test_pairs_in_slices(monkeypatch):
    import pyarrow as pa

    texts = ["a b c d e f g", "b d f", "x", "c a"]
    nodes = np.sort(hashes(*"abcdefg"))
    want = {}
    for t in texts:
        at = np.flatnonzero(np.isin(nodes, hashes(*t.split()))).tolist()
        for x in at:
            for y in at:
                if x <= y:
                    want[x * 7 + y] = want.get(x * 7 + y, 0) + 1
    for most in (1, 3, 1000):
        monkeypatch.setattr(T, "PAIRS_AT_ONCE", most)
        got = {}
        for batch in T._together(nodes)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])):
            for k, n in zip(batch.column("pair").to_pylist(), batch.column("n").to_pylist()):
                got[k] = got.get(k, 0) + n
        assert got == want
