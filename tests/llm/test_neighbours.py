import numpy as np
import pytest
from tests.conftest import DATA
from pyspark.sql import functions as F
from tessera.llm import neighbours as N


def brute(rows, k):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and len(v):
            best[i] = min(best.get(i, v), v)
    sizes = [len(v) for v in best.values()]
    dim = min(set(sizes), key=lambda d: (-sizes.count(d), d), default=0)
    ids = sorted(i for i, v in best.items() if len(v) == dim)
    m = np.array([best[i] for i in ids], float).reshape(len(ids), -1)
    out = {}
    for a, i in enumerate(ids):
        d = np.round(np.sqrt(((m - m[a]) ** 2).sum(1)), 9)
        out[i] = sorted((x, j) for x, j in zip(d, ids) if j != i)[:k]
    return out


def found(df, **kw):
    out = {}
    for r in N.neighbours(df, **kw).orderBy("vec_id", "rank").collect():
        own = out.setdefault(r["vec_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["distance"], r["neighbour"]))
    return out


@pytest.mark.parametrize("cell_rows", [N.CELL_ROWS, 64])
def test_recall(spark, cell_rows):
    df = spark.read.parquet(str(DATA / "sf0.01/embeddings.parquet"))
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 10)
    got = found(df, k=10, cell_rows=cell_rows, every=1)
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    hits = sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want)
    assert hits / (10 * len(want)) >= 0.9
    true = {i: {j: d for d, j in own} for i, own in brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 10**6).items()}
    assert all(abs(true[i][j] - d) < 1e-6 for i, own in got.items() for d, j in own)


def test_awkward_rows(spark):
    v = [1.0, 0.0, 0.0]
    rows = [(1, v), (2, v), (3, [0.0, 1.0, 0.0]), (4, None), (None, v), (5, [1.0, None, 0.0]), (6, [float("nan"), 0.0, 0.0]), (7, [1.0, 2.0]), (8, []), (1, v), (9, [0.0, 0.0, 2.0]), (9, [5.0, 5.0, 5.0]), (10, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "vec", "cell", "label", "box", "names")})
    assert found(df, k=10, every=1) == brute(rows, 10)
    assert N.neighbours(df.limit(0)).count() == 0


def test_registered_queries(spark):
    """Rows whose id is divisible by 100 ask, against all rows."""
    df = spark.read.parquet(str(DATA / "sf0.1/embeddings.parquet"))
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 10)
    got = found(df, cell_rows=128)
    assert got.keys() == {i for i in want if i % 100 == 0} and all(len(x) == 10 for x in got.values())
    assert sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in got) >= 0.9 * 10 * len(got)


def test_hot_cell_and_constant_and_long_vectors(spark):
    """Two thirds are one and the same vector; cells of many blocks, most cells bounded."""
    rng = np.random.default_rng(4)
    rows = [(i, [1.0] * 300) for i in range(200)] + [(200 + i, rng.standard_normal(300).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for most in (N.CELLS, 2):
        got = found(df, k=3, every=10, cell_rows=16, most_cells=most)
        assert got.keys() == {i for i, _ in rows if i % 10 == 0}
        for i, own in got.items():
            assert len({j for _, j in own}) == 3 and i not in {j for _, j in own}
            assert i >= 200 or [d for d, _ in own] == [0.0] * 3


def test_chi_square():
    assert abs(N.chi_square(N.chi_square_bound(0.95, 8), 8) - 0.95) < 1e-9
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((200_000, 8)) ** 2).sum(1)
    assert abs((x < N.chi_square_bound(0.9, 8)).mean() - 0.9) < 0.01
