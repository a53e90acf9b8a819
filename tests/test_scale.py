"""What a task holds and how work is spread: nothing of it may grow with the table."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import answers, chunks, facts, graph, search
from tessera.plans import moresql, questionsql, tables, tablesql
from tests.conftest import DATA

SF = str(DATA / "sf0.001")


def exchanges(df, what=""):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning(" + what in x]


def test_tables_by_key_have_parts_of_bounded_size(spark, monkeypatch):
    """Orders were in as many parts as there are cores, of whatever size, and lines met them in the session's number of parts."""
    monkeypatch.setattr(tables, "PART_BYTES", 4_000)
    (lines, orders), parts = tables.read_keyed(spark, SF, {"lineitem": "l_orderkey", "orders": "o_orderkey"})
    assert parts > 30 and lines.rdd.getNumPartitions() == orders.rdd.getNumPartitions() == parts
    edges = tablesql.entity_edges(spark, SF)
    assert all(f", {parts})" in x for x in exchanges(edges))
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, graph.entity_edges(lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr("l_partkey AS entity", "l_orderkey AS chunk_id", "o_custkey AS doc_id")).collect()))


def test_look_ups_move_orders_once(spark, monkeypatch):
    """Keys were moved to criteria, pairs of query and order to their group, and these to the queries: 12 of them, so 12 groups of any size."""
    found = tablesql.entity_lookup_combined(spark, SF)
    assert not exchanges(found, "key") and len(exchanges(found, "query_id")) <= 1  # that of the least bits of each query
    whole = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(facts, "CRITERIA_AT_ONCE", 3)
    assert sorted(map(tuple, tablesql.entity_lookup_combined(spark, SF).collect())) == whole and whole


def test_keys_of_an_order_stay_with_it(spark, monkeypatch):
    monkeypatch.setattr(tables, "PART_BYTES", 4_000)
    own = tablesql.order_facts(spark, SF)
    index = facts.entity_index(own)
    assert own.rdd.getNumPartitions() >= 9 and len(exchanges(index)) == 1 and "o_orderkey" in exchanges(index)[0]


def test_questions_and_answers_are_spread_over_cores(spark):
    """A table of one row group is one task otherwise."""
    cores = spark.sparkContext.defaultParallelism
    assert questionsql.asked(spark, SF).rdd.getNumPartitions() == moresql.told(spark, SF).rdd.getNumPartitions() == cores


def test_questions_are_decomposed_once(spark):
    plan = questionsql.query_decomposition(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x.strip(" +-:").startswith("Filter") for x in plan.splitlines())


def peak(run) -> int:
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


class Held:
    def __init__(self, value):
        self.value = value


def texts_of(rows, words):
    rng = np.random.default_rng(4)
    return [" ".join(f"w{x}" for x in rng.integers(0, 300, words)) + "." for _ in range(rows)]


def test_keyword_search_holds_a_part_of_a_batch():
    """3,000 texts with all of 300 words that each of 60 queries asks for: 54 million pairs at once before, over 1 GB."""
    texts, terms, queries = texts_of(3000, 300), [f"w{i}" for i in range(300)], 60
    batch = pa.RecordBatch.from_pydict({"id": list(range(3000)), "text": texts})
    lists = list(search._counted(pa.int64(), Held(frozenset(terms)), False)(iter([batch])))
    index = pa.Table.from_batches(lists).combine_chunks().to_batches()[0]
    many = np.full(300, queries)
    held = Held((list(range(queries)), terms, np.ones(300), np.cumsum(many) - many, many, np.tile(np.arange(queries), 300), 300.0))
    out = []
    most = peak(lambda: out.extend(search._ranked(held, 5, [pa.int64(), pa.int64()])(iter([index]))))
    assert most < 200 << 20 and out[0].num_rows == 5 * queries
    parts = pa.Table.from_batches(search._ranked(held, 5, [pa.int64(), pa.int64()])(iter([index.slice(i, 100) for i in range(0, 3000, 100)])))
    assert sorted(out[0].to_pylist(), key=repr) == sorted(parts.to_pylist(), key=repr)


def test_texts_of_a_batch_are_read_in_parts():
    texts = texts_of(3000, 3000)
    batch = pa.RecordBatch.from_pydict({"id": list(range(3000)), "text": texts})
    assert peak(lambda: [None for _ in search._counted(pa.int64(), Held(frozenset()), True)(iter([batch]))]) < 10 << 20  # the texts are 42 MB


def test_chunks_and_compressed_texts_leave_in_parts(spark, monkeypatch):
    """A batch's chunks came as one."""
    text = ("word " * 30 + ". ") * 60
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).coalesce(1)
    held = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a, **k: held.append(f) or self)
    chunks.folded(docs, "fixed")
    answers.compressed(docs.withColumn("query", F.lit("word")))
    for f, extra in zip(held, ({}, {"query": ["word"] * 400})):
        out = list(f(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "text": [text] * 400} | extra)])))
        assert len(out) > 3 and max(b.nbytes for b in out) < 3 << 20 and len({x for b in out for x in b.column("doc_id").to_pylist()}) == 400


def test_siblings_come_from_documents_with_seeds(spark):
    """Chunks were made of all documents three times."""
    plan = tablesql.sibling_expansion(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(sequence") == plan.count("LeftSemi") > 0
