"""Chunk graph: edges as rows in both directions, and walks of at most two steps as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", "weight"))


def sibling_edges(chunks: DataFrame, doc: str = "doc_id", index: str = "chunk_index", id_: str = "chunk_id") -> DataFrame:
    """Successive chunks of a document (.9) and those two apart (.6), one direction."""
    w = Window.partitionBy(doc).orderBy(index)
    out = [
        chunks.select(F.col(id_).alias("src"), F.lead(id_, step).over(w).alias("dst"), F.lit("sibling").alias("edge_type"), F.lit(weight).alias("weight")).where("dst IS NOT NULL")
        for step, weight in ((1, 0.9), (2, 0.6))
    ]
    return out[0].unionByName(out[1])


def parent_edges(chunks: DataFrame, most: int = 50) -> DataFrame:
    """Chunks of different documents under one breadcrumb parent (.7); chunks: (chunk_id, doc_id, parent).

    A parent of more than `most` chunks says nothing about them and makes no edges: that bounds the self-join.
    """
    rows = chunks.where("parent IS NOT NULL").select("chunk_id", "doc_id", "parent")
    common = rows.groupBy("parent").count().where(F.col("count") > most).select("parent")
    rows = rows.join(common, "parent", "left_anti")
    a = rows.select(F.col("chunk_id").alias("src"), F.col("doc_id").alias("da"), "parent")
    b = rows.select(F.col("chunk_id").alias("dst"), F.col("doc_id").alias("db"), "parent")
    found = a.join(b, "parent").where("da <> db AND src < dst")
    return found.select("src", "dst", F.lit("parent").alias("edge_type"), F.lit(0.7).alias("weight"))


def entity_edges(mentions: DataFrame, least: int = 2, most: int = 20, parts: int | None = None) -> DataFrame:
    """Chunks of different documents that share an entity which `least` to `most` chunks have: .6 for at most 5 chunks, else .4.

    mentions: (entity, chunk_id, doc_id). Entities beyond the limits make no edges at all: that is the rule, and it bounds the
    self-join. parts: partitions by entity, for tables so large that what the session's number leaves a task is too much.
    """
    rows = mentions.select("entity", "chunk_id", "doc_id").distinct()
    rows = rows.repartition(parts, "entity") if parts else rows
    # counted by an aggregate, which combines before the shuffle: a window would bring all rows of a hot entity to one task
    few = rows.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    rows = rows.join(few, "entity")
    a = rows.select("entity", "n", F.col("chunk_id").alias("src"), F.col("doc_id").alias("da"))
    b = rows.select("entity", F.col("chunk_id").alias("dst"), F.col("doc_id").alias("db"))
    found = a.join(b, "entity").where("da <> db AND src < dst")
    return found.select("src", "dst", F.lit("entity").alias("edge_type"), F.when(F.col("n") <= 5, 0.6).otherwise(0.4).alias("weight"))


def two_hops(seeds: DataFrame, edges: DataFrame, least: float = 0.1, hops: int = 2) -> DataFrame:
    """(query_id, chunk_id, weight, hop) of chunks within `hops` steps: best product of weights; what a hop reaches stays.

    seeds: (query_id, chunk_id); seeds have weight 1 and hop 0. Products under `least` are dropped.
    """
    reached = seeds.select("query_id", "chunk_id", F.lit(1.0).alias("weight"), F.lit(0).alias("hop")).distinct()
    front, parts = reached, [reached]
    for hop in range(1, hops + 1):
        step = front.join(edges.select(F.col("src").alias("chunk_id"), "dst", F.col("weight").alias("w")), "chunk_id")
        step = step.groupBy("query_id", F.col("dst").alias("chunk_id")).agg(F.round(F.max(F.col("weight") * F.col("w")), 6).alias("weight")).where(F.col("weight") >= least)
        seen = reduce(DataFrame.unionByName, parts).select("query_id", "chunk_id")
        front = step.join(seen, ["query_id", "chunk_id"], "left_anti").withColumn("hop", F.lit(hop))
        parts.append(front)
    return reduce(DataFrame.unionByName, parts)


def neighbours(edges: DataFrame, of: DataFrame, types: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """(chunk_id, dst, edge_type, weight) of the edges that leave given chunks (chunk_id), of certain types and weights."""
    out = edges.where(F.col("weight") >= least)
    if types is not None:
        out = out.where(F.col("edge_type").isin(*types))
    return out.withColumnRenamed("src", "chunk_id").join(of.select("chunk_id").distinct(), "chunk_id", "left_semi")


def constellation(reached: DataFrame, best: DataFrame, top_k: int, domains: DataFrame | None = None, lift: float = 1.3) -> DataFrame:
    """(query_id, chunk_id, score, rank) of what a walk reached beyond its seeds: best seed score * weight, times `lift` where the chunk has a domain
    of the query; the top_k + 5 best. best: (query_id, best); domains: (query_id, chunk_id) pairs that meet."""
    rows = reached.where("hop > 0").join(best, "query_id").withColumn("score", F.col("best") * F.col("weight"))
    if domains is not None:
        rows = rows.join(domains.select("query_id", "chunk_id").distinct().withColumn("met", F.lit(True)), ["query_id", "chunk_id"], "left")
        rows = rows.withColumn("score", F.when(F.col("met"), F.col("score") * lift).otherwise(F.col("score")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    rows = rows.withColumn("score", F.round("score", 8)).withColumn("rank", F.row_number().over(w))
    return rows.where(F.col("rank") <= top_k + 5).select("query_id", "chunk_id", "score", "rank")


def degrees(edges: DataFrame) -> DataFrame:
    """(chunk_id, degree), parallel edges counted each."""
    return edges.groupBy(F.col("src").alias("chunk_id")).agg(F.count("*").alias("degree"))
