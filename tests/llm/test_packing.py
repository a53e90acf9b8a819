from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import packing


def reference(lengths, capacity):
    """Best-two-fit by looking at every unpacked document and every pair of them; bins as lists of lengths."""
    stock, bins = sorted(lengths), []
    while stock:
        gap, content = capacity, []
        while fits := [x for x in stock if x <= gap]:
            content.append(fits[-1])
            stock.remove(fits[-1])
            gap -= fits[-1]
        if gap and stock:
            least = content[-1]
            room, best = gap + least, (least, 0)
            for i, a in enumerate(stock):
                for b in stock[:i]:
                    if a + b <= room and (a + b, a) > best and a + b > least:
                        best = (a + b, a)
            if best[1]:
                content.pop()
                for x in (best[1], best[0] - best[1]):
                    stock.remove(x)
                    content.append(x)
                stock = sorted([*stock, least])
        bins.append(sorted(content))
    return bins


@pytest.mark.parametrize("capacity,seed", [(10, 0), (17, 1), (50, 2), (100, 3), (7, 4)])
def test_bins_as_by_trying_everything(capacity, seed):
    rng = np.random.default_rng(seed)
    for _ in range(30):
        lengths = rng.integers(1, capacity + 1, rng.integers(0, 40))
        bins = packing.best_two_fit(lengths, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert [sorted(int(lengths[i]) for i in b) for b in bins] == reference(lengths.tolist(), capacity)


def check(df, capacity, shard_rows=packing.SHARD_ROWS):
    rows = [(r["doc_id"], len("".join(c if ord(c) > 32 else " " for c in r["text"] or "").split(" ")) if r["text"] else 0, r["text"]) for r in df.collect()]
    rows = [(d, len([w for w in "".join(c if ord(c) > 32 else " " for c in t or "").split(" ") if w])) for d, _, t in rows]
    got = packing.packed(df, capacity, shard_rows).collect()
    bins, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        bins[r["shard"], r["bin"]] += r["n_words"]
        pieces[r["doc_id"]].append((r["start_word"], r["n_words"]))
    assert all(0 < n <= capacity for n in bins.values())
    want = defaultdict(list)
    for d, n in rows:
        want[d] += [(s, min(capacity, n - s)) for s in range(0, n, capacity)]
    assert {d: sorted(x) for d, x in pieces.items()} == {d: sorted(x) for d, x in want.items() if x}
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"], r["bin"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return got


def test_messy_rows(messy):
    check(messy, 2048)
    got = check(messy, 16, shard_rows=4)
    assert len({r["shard"] for r in got}) > 1


def test_same_bins_again(messy):
    a, b = (sorted(map(tuple, packing.packed(messy.repartition(k), 64).collect()), key=repr) for k in (1, 5))
    assert a == b


def test_empty_table(empty):
    assert packing.packed(empty).count() == 0


def test_rows_without_an_id_are_spread(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    got = packing.packed(df, capacity=10, shard_rows=400).groupBy("shard").count().collect()
    assert sum(r["count"] for r in got) == 4000 and len(got) == 10 and max(r["count"] for r in got) < 600
