"""k nearest neighbours of every vector (Euclidean), by stable projections, a kd-tree and a chi-square stopping test.

Method: vectors are projected on `m` Gaussian directions (a 2-stable projection: the squared projected distance of two
vectors is their squared distance times a chi-square variable of m degrees). A kd-tree indexes the low-dimensional points.
A query takes projected neighbours in increasing order, leaf by leaf, verifies them with true distances, and stops when the
chi-square test holds: once the next projected distance r has chi2(r^2 / d_k^2) >= `confidence`, where d_k is the k-th
best true distance so far, a missed neighbour at a distance of at most d_k has a probability of at most 1 - confidence.

The tree's upper levels are the cells: their splits are medians of a sample of projected points (SAMPLE_PER_CELL for each of
at most CELLS cells; they steer only the balance). All rows are counted by cell, and a cell of more than `cell_rows` rows,
as a hot one is, consists of several blocks by a hash of the id. First each query searches its own block, which bounds its
d_k and so its search radius in the projection; then it goes down the tree to just the blocks whose cells' boxes lie inside
that radius, and the lists are merged. Blocks and queries come to a task in order, so it holds one block and one batch of
queries whatever their numbers. All rows are indexed; the queries are the rows whose id is divisible by `every` (1: all rows).
How many cells a query must see depends on the data: on vectors without any structure the test can hold only late and the
search nears an exhaustive one.

Defined results: (vec_id, rank, neighbour, distance) with ranks from 1; equal distances are ranked by id; a vector is not
its own neighbour, but an equal vector of another id is, at distance 0. Null ids, null vectors, vectors with null, NaN or
infinite entries and those whose dimension is not the most frequent one (of equally frequent the lower) neither ask nor
answer. Rows that repeat an id count once (that of the least vector). With fewer than k others all are given. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buffers import mix, tidy
from .common import checkpointed, table

K = 10
DIRECTIONS = 8
CONFIDENCE = 0.95
CELL_ROWS = 8192
LEAF_ROWS = 256
CELLS = 1 << 16  #: cells at most; beyond, cells have more blocks
SAMPLE_PER_CELL = 16
EVERY = 100
ROWS_AT_ONCE = 16_384


def chi_square(x: float, m: int) -> float:
    """Distribution function of the chi-square law, for an even number of degrees."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def chi_square_bound(confidence: float, m: int) -> float:
    """The x with chi_square(x, m) = confidence."""
    lo, hi = 0.0, 1.0
    while chi_square(hi, m) < confidence:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, m) < confidence else (lo, mid)
    return hi


def directions(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng(20140901).standard_normal((dim, m))


def _halves(points: np.ndarray, rows: int) -> list[np.ndarray]:
    """Leaves of a kd-tree, as indexes: halved at the median of the widest direction until they have at most `rows`."""
    todo, out = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= rows:
            out.append(at)
            continue
        own = points[at]
        order = np.argsort(own[:, np.argmax(own.max(0) - own.min(0))], kind="stable")
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def splits(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """A complete binary tree of `cells` (a power of two) cells in heap order: direction and border of each inner node."""
    tree: list[tuple[int, float]] = [(0, 0.0)] * (cells - 1)
    content = {0: points}
    for node in range(cells - 1):
        own = content.pop(node)
        if len(own):
            d = int(np.argmax(own.max(0) - own.min(0)))
            border = float(np.median(own[:, d]))
            tree[node] = (d, border)
        d, border = tree[node]
        left = own[:, d] < border
        content[2 * node + 1], content[2 * node + 2] = own[left], own[~left]
    return tree


def _cell(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    d, border = np.array([x[0] for x in tree], np.int64), np.array([x[1] for x in tree])
    while len(tree) and (node < len(tree)).any():
        node = 2 * node + 1 + (points[np.arange(len(points)), d[node]] >= border[node])
    return (node - len(tree)).astype(np.int32)


def _box_gap(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distance of each point (rows) to each box (columns)."""
    gap = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0)
    return (gap * gap).sum(-1)


class Tree:
    """Vectors of one cell, indexed by their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, vectors, points = ids[order], vectors[order], points[order]
        parts = [np.sort(x) for x in _halves(points, LEAF_ROWS)] if len(ids) else []
        self.leaves = [(ids[x], vectors[x]) for x in parts]
        self.low = np.array([points[x].min(0) for x in parts]).reshape(len(parts), points.shape[1])
        self.high = np.array([points[x].max(0) for x in parts]).reshape(len(parts), points.shape[1])

    def search(self, ids, vectors, points, k: int, bound: float, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest (ids, squared distances) of each query; start: a squared distance from which none is of use."""
        best = np.full((len(ids), k), np.inf)
        name = np.full((len(ids), k), -1, np.int64)
        limit = np.full(len(ids), np.inf) if start is None else start.copy()
        for group in _halves(points, LEAF_ROWS) if len(ids) else []:
            gap = _box_gap(self.low, self.high, points[group])
            for leaf in np.argsort(gap.min(0), kind="stable"):
                go = gap[:, leaf] <= limit[group] * bound
                if not go.any():
                    continue
                q = group[go]
                theirs, v = self.leaves[leaf]
                d = ((vectors[q] ** 2).sum(1)[:, None] + (v**2).sum(1)[None]) - 2 * vectors[q] @ v.T
                close = d < limit[q][:, None] * (1 + 1e-9) + 1e-9
                close &= ids[q][:, None] != theirs[None]
                some = close.any(1)
                if not some.any():
                    continue
                q, d, close = q[some], np.where(close, d, np.inf)[some], close[some]
                if d.shape[1] > k:
                    near = np.argpartition(d, k - 1, axis=1)
                    cut = np.take_along_axis(d, near[:, k - 1 : k], 1)
                    if (np.isfinite(cut) & ((d <= cut).sum(1)[:, None] > k)).any():  # ties at the border: by id
                        near = np.argsort(d, axis=1, kind="stable")
                    near = near[:, :k]
                else:
                    near = np.broadcast_to(np.arange(d.shape[1]), d.shape)
                d = np.take_along_axis(d, near, 1)
                alld = np.concatenate([best[q], np.maximum(d, 0)], 1)
                alln = np.concatenate([name[q], np.where(np.isfinite(d), theirs[near], -1)], 1)
                order = np.lexsort((alln, alld))[:, :k]
                best[q], name[q] = np.take_along_axis(alld, order, 1), np.take_along_axis(alln, order, 1)
                limit[q] = np.minimum(limit[q], best[q, k - 1])
        return name, best


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _list(values: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), kind))


def _projected(m: int):
    """Points of a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                v = _matrix(batch.column("vec"))
                yield pa.RecordBatch.from_arrays([_list(v @ directions(v.shape[1], m), pa.float64())], ["point"])

    return run


def _measured(m: int, tree: list[tuple[int, float]]):
    """Rows and box of each cell, as far as a partition has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = len(tree) + 1
        many, low, high = np.zeros(cells, np.int64), np.full((cells, m), np.inf), np.full((cells, m), -np.inf)
        for batch in batches:
            if len(batch):
                v = _matrix(batch.column("vec"))
                p = v @ directions(v.shape[1], m)
                cell = _cell(p, tree)
                order = np.argsort(cell, kind="stable")
                own = cell[order]
                at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                name = own[at]
                many[name] += np.diff(np.append(at, len(own)))
                low[name] = np.minimum(low[name], np.minimum.reduceat(p[order], at))
                high[name] = np.maximum(high[name], np.maximum.reduceat(p[order], at))
        used = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(many[used]), *(pa.array(low[used, d]) for d in range(m)), *(pa.array(high[used, d]) for d in range(m))],
            ["cell", "n", *(f"low{d}" for d in range(m)), *(f"high{d}" for d in range(m))],
        )

    return run


def _hash(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64), 23)


def _placed(m: int, tree: list[tuple[int, float]], blocks: np.ndarray, every: int):
    """All rows by block, those that ask twice: kind 0 is indexed, kind 1 asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                v, ids = _matrix(batch.column("vec")), batch.column("id").to_numpy()
                cell = _cell(v @ directions(v.shape[1], m), tree)
                block = (_hash(ids) % np.maximum(blocks[cell], 1).astype(np.uint64)).astype(np.int32)
                for kind, at in ((0, np.arange(len(ids))), (1, np.flatnonzero(ids % every == 0))):
                    rows = batch.take(pa.array(at))
                    start = pa.array(np.full(len(at), np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[at]), pa.array(block[at]), pa.array(np.full(len(at), kind, np.int32)), rows.column("id"), rows.column("vec"), start], PLACED)

    return run


def _searched(m: int, k: int, bound: float):
    """Queries against the blocks they come with: rows are in order of block, and in a block what is indexed comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, tree = None, [], None
        for batch in batches:
            cell, block, kind = (batch.column(c).to_numpy() for c in PLACED[:3])
            edge = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(batch)]):
                if lo == hi:
                    continue
                own, name = batch.slice(lo, hi - lo), (int(cell[lo]), int(block[lo]))
                if name != held:
                    held, parts, tree = name, [], None
                if kind[lo] == 0:
                    parts.append((own.column("id").to_numpy(), _matrix(own.column("vec"))))
                    continue
                if tree is None:
                    ids, v = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros((0, _matrix(own.column("vec")).shape[1])))
                    tree, parts = Tree(ids, v, v @ directions(v.shape[1], m)), []
                q = _matrix(own.column("vec"))
                names, far = tree.search(own.column("id").to_numpy(), q, q @ directions(q.shape[1], m), k, bound, own.column("start").to_numpy())
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("cell"), own.column("block"), own.column("vec"), _list(names, pa.int64()), _list(far, pa.float64())], ["id", "cell", "block", "vec", "names", "far"])

    return run


def _routed(m: int, bound: float, held):
    """A query goes to the blocks of all cells whose box lies within its radius, but for its own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, blocks = held.value
        inner = len(blocks) - 1
        for batch in batches:
            if not len(batch):
                continue
            v, cell, block = _matrix(batch.column("vec")), batch.column("cell").to_numpy(), batch.column("block").to_numpy()
            limit = _matrix(batch.column("far"))[:, -1]
            points = v @ directions(v.shape[1], m)
            for lo in range(0, len(v), 256):
                q = np.arange(lo, min(lo + 256, len(v)))
                node = np.zeros(len(q), np.int64)
                while len(q):
                    p = points[q]
                    gap = np.maximum(np.maximum(low[node] - p, p - high[node]), 0)
                    go = (gap * gap).sum(1) <= limit[q] * bound
                    q, node = q[go], node[go]
                    if not len(q) or node[0] >= inner:
                        break
                    q, node = np.repeat(q, 2), np.repeat(2 * node + 1, 2) + np.tile([0, 1], len(node))
                many = blocks[node - inner]
                to = np.repeat(node - inner, many)
                at = np.arange(len(to)) - np.repeat(np.cumsum(many) - many, many)
                q = np.repeat(q, many)
                other = (to != cell[q]) | (at != block[q])
                q, to, at = q[other], to[other].astype(np.int32), at[other].astype(np.int32)
                for i in range(0, len(q), ROWS_AT_ONCE):
                    x = slice(i, i + ROWS_AT_ONCE)
                    rows = batch.take(pa.array(q[x]))
                    yield pa.RecordBatch.from_arrays([pa.array(to[x]), pa.array(at[x]), pa.array(np.ones(len(rows), np.int32)), rows.column("id"), rows.column("vec"), pa.array(limit[q[x]])], PLACED)

    return run


PLACED = ["cell", "block", "kind", "id", "vec", "start"]


def neighbours(vectors: DataFrame, k: int = K, m: int = DIRECTIONS, confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS, every: int = EVERY, most_cells: int = CELLS) -> DataFrame:
    """(vec_id, rank, neighbour, distance) of the k nearest others of each row that asks; see the module."""
    number = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(f"array<{number}>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    rows = rows.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size("vec") > 0))
    dims = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = dims["d"] if dims else 1
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = checkpointed(rows.groupBy("id").agg(F.min("vec").alias("vec")))
        dims = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = dims["d"]
    rows, total = rows.where(F.size("vec") == dim), dims["count"] if dims else 0
    cells = 1
    while cells * cell_rows < total and cells < most_cells:
        cells *= 2
    tree: list[tuple[int, float]] = []
    if cells > 1:
        sample = rows.select("vec").sample(min(1.0, SAMPLE_PER_CELL * cells / total), seed=3).mapInArrow(tidy(_projected(m)), "point array<double>")
        tree = splits(np.array([r["point"] for r in sample.toLocalIterator()]).reshape(-1, m), cells)
    edges = [f"low{d}" for d in range(m)], [f"high{d}" for d in range(m)]
    measured = rows.select("vec").mapInArrow(tidy(_measured(m, tree)), ", ".join(["cell long", "n long", *(f"{c} double" for side in edges for c in side)]))
    measured = measured.groupBy("cell").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in edges[0]), *(F.max(c).alias(c) for c in edges[1]))
    blocks = np.zeros(cells, np.int64)
    low, high = np.full((2 * cells - 1, m), np.inf), np.full((2 * cells - 1, m), -np.inf)
    for r in measured.toLocalIterator():
        blocks[r["cell"]] = -(-r["n"] // cell_rows)
        low[cells - 1 + r["cell"]], high[cells - 1 + r["cell"]] = ([r[c] for c in side] for side in edges)
    for node in range(cells - 2, -1, -1):
        low[node], high[node] = np.minimum(low[2 * node + 1], low[2 * node + 2]), np.maximum(high[2 * node + 1], high[2 * node + 2])
    bound = chi_square_bound(confidence, m)
    placed = f"cell int, block int, kind int, id long, vec array<{number}>, start double"
    found = f"id long, cell int, block int, vec array<{number}>, names array<long>, far array<double>"

    def by_block(df: DataFrame) -> DataFrame:
        return df.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind").mapInArrow(tidy(_searched(m, k, bound)), found)

    first = checkpointed(by_block(rows.mapInArrow(tidy(_placed(m, tree, blocks, every)), placed)))
    lists = first.select("id", "names", "far")
    if blocks.sum() > 1:
        held = vectors.sparkSession.sparkContext.broadcast((low, high, blocks))
        asked = first.mapInArrow(tidy(_routed(m, bound, held)), placed)
        there = rows.mapInArrow(tidy(_placed(m, tree, blocks, every)), placed).where("kind = 0")
        lists = lists.unionByName(by_block(there.unionByName(asked)).select("id", "names", "far"))
    flat = lists.select("id", F.explode(F.arrays_zip("names", "far")).alias("x")).select("id", F.col("x.names").alias("neighbour"), F.col("x.far").alias("far")).where("far < double('Infinity')")
    flat = flat.withColumn("far", F.round(F.sqrt("far"), 9))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("far", "neighbour"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias("vec_id"), F.col("rank").cast("int").alias("rank"), "neighbour", F.col("far").alias("distance"))


def op8_approximate_neighbours(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
