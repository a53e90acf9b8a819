"""Queries over many rows: search, fusion, graph, facts, stores, metrics, streams. Each has the SQL of the same result beside it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import answers, chunks, facts, graph, metrics, search, store
from ..session import shared_folder, stored
from ..streaming import ingest
from .tables import read, read_keyed, read_texts
from .texts import CHUNKS_SQL, filtered, query, windows, words

_W = words("text")
_POSTED = f"(SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id AS id, unnest({_W}) AS term, len({_W}) AS dl FROM documents) GROUP BY id, term)"


@query("tokenize_term_stats", f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM {_POSTED} GROUP BY term")
def tokenize_term_stats(spark, sf_dir):
    return search.term_stats(search.postings(read_texts(spark, sf_dir, "documents")))


def bm25_sql(docs: str, queries: str) -> str:
    """Scores of docs (id, text) for queries (query_id, text)."""
    return f"""(WITH d AS MATERIALIZED (SELECT id, {_W} AS w FROM {docs}), p AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, unnest(w) AS term, len(w) AS dl FROM d) GROUP BY id, term),
        s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY term), a AS (SELECT query_id, unnest(list_distinct({_W})) AS term FROM {queries})
        SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * dl / avgdl))), 6) AS score
        FROM p JOIN f USING (term) JOIN a USING (term) CROSS JOIN s GROUP BY query_id, id)"""


_DOCS, _ITEMS = "(SELECT doc_id AS id, text FROM documents)", "(SELECT item_id AS query_id, text FROM benchmark)"
_BM25 = bm25_sql(_DOCS, _ITEMS)


def topk_sql(scores: str, k: int) -> str:
    return f"(SELECT query_id, id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM {scores}) WHERE r <= {k})"


def asked(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("bm25_topk", f"SELECT * FROM {topk_sql(_BM25, 5)}")
def bm25_topk(spark, sf_dir):
    return search.bm25_topk(read_texts(spark, sf_dir, "documents"), asked(spark, sf_dir), 5)


_PAIRS = f"(SELECT item_id, doc_id, n / (x.n_x + y.n_y - n) AS overlap FROM (SELECT item_id, doc_id, count(*) AS n FROM (SELECT item_id, unnest(list_distinct({_W})) AS term FROM benchmark) JOIN (SELECT doc_id, unnest(list_distinct({_W})) AS term FROM documents) USING (term) GROUP BY ALL) JOIN (SELECT item_id, len(list_distinct({_W})) AS n_x FROM benchmark) x USING (item_id) JOIN (SELECT doc_id, len(list_distinct({_W})) AS n_y FROM documents) y USING (doc_id))"


@query("vocab_overlap_pairs", f"SELECT item_id, doc_id, round(overlap, 6) AS overlap FROM {_PAIRS} WHERE overlap >= 0.25")
def vocab_overlap_pairs(spark, sf_dir):
    own = lambda name, key, n: read(spark, sf_dir, name).select(key, text.token_set(F.col("text")).alias("w")).select(key, F.size("w").alias(n), F.explode("w").alias("term"))
    both = own("documents", "doc_id", "ny").join(own("benchmark", "item_id", "nx"), "term")
    both = both.groupBy("item_id", "doc_id", "nx", "ny").agg(F.count("*").alias("n")).withColumn("overlap", F.col("n") / (F.col("nx") + F.col("ny") - F.col("n")))
    return both.where("overlap >= 0.25").select("item_id", "doc_id", F.round("overlap", 6).alias("overlap"))


_CENTRES = "(SELECT label AS query_id, list(m ORDER BY p) AS qvec FROM (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY label, p) GROUP BY label)"
_COSINE = "round(greatest(list_cosine_similarity(embedding::DOUBLE[], qvec), 0), 6)"
_VECTORS = f"(SELECT query_id, vec_id AS id, label, {_COSINE} AS score FROM embeddings CROSS JOIN {_CENTRES})"


def centres(spark, sf_dir):
    """Mean vector of each label, as queries."""
    flat = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    mean = flat.groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("qvec"))


def vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@query("vector_topk", f"SELECT * FROM {topk_sql(_VECTORS, 10)}")
def vector_topk(spark, sf_dir):
    return search.vector_topk(vectors(spark, sf_dir), centres(spark, sf_dir), 10)


@query("vector_topk_filtered", f"SELECT * FROM {topk_sql(f'(SELECT * FROM {_VECTORS} WHERE label <> query_id)', 10)}")
def vector_topk_filtered(spark, sf_dir):
    """The filter runs before the search: k hits come back where there are so many."""
    return search.vector_topk(vectors(spark, sf_dir).withColumn("tag", F.col("label")), centres(spark, sf_dir).withColumn("tag", F.col("query_id")), 10, tagged="other")


@query("hype_best_per_chunk", f"SELECT query_id, label AS chunk_id, max(score) AS score FROM {_VECTORS} GROUP BY ALL")
def hype_best_per_chunk(spark, sf_dir):
    hits = search.vector_topk(vectors(spark, sf_dir).select(F.col("label").alias("id"), "vec"), centres(spark, sf_dir), None)
    return search.best_per_chunk(hits.select("query_id", F.col("id").alias("chunk_id"), "score"))


@query("vector_topk_signed", f"SELECT * FROM {topk_sql(_VECTORS.replace('greatest(list_cosine_similarity(embedding::DOUBLE[], qvec), 0)', 'list_cosine_similarity(embedding::DOUBLE[], qvec)'), 400)}")
def vector_topk_signed(spark, sf_dir):
    """Cosine without a floor: far vectors have negative scores."""
    return search.vector_topk(vectors(spark, sf_dir), centres(spark, sf_dir), 400, floor=False)


DEPTH, WEIGHTS = 15, {"original": 0.35, "hype": 0.15, "bm25": 0.5}
_ASKVEC = "(SELECT item_id AS query_id, embedding AS qvec FROM benchmark JOIN embeddings ON vec_id = item_id)"
_ORIGINAL = f"(SELECT query_id, vec_id AS id, round(greatest(list_cosine_similarity(embedding::DOUBLE[], qvec::DOUBLE[]), 0), 6) AS score FROM embeddings CROSS JOIN {_ASKVEC})"
_HYPE = f"(SELECT query_id, id // 2 AS id, max(score) AS score FROM {_ORIGINAL} GROUP BY query_id, id // 2)"
_FUSED = f"""(SELECT query_id, id, round(CASE WHEN max(s) OVER (PARTITION BY query_id) > 0 THEN s / max(s) OVER (PARTITION BY query_id) ELSE s END, 6) AS score FROM (SELECT query_id, id, sum(part) AS s FROM (
    SELECT query_id, id, 0.35 * score / (60 + rank) AS part FROM {topk_sql(_ORIGINAL, DEPTH)} UNION ALL SELECT query_id, id, 0.15 * score / (60 + rank) FROM {topk_sql(_HYPE, DEPTH)} UNION ALL
    SELECT query_id, id, 0.5 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN hi > 0 THEN score / hi ELSE 0 END / (60 + rank) FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {topk_sql(_BM25, DEPTH)})) GROUP BY query_id, id))"""


def fusion_lists(spark, sf_dir):
    """Vectors of documents and queries are those of the same number; vectors 2n and 2n + 1 are questions of document n."""
    vecs = vectors(spark, sf_dir)
    ask = read(spark, sf_dir, "benchmark").join(vecs, F.col("item_id") == F.col("id")).select(F.col("item_id").alias("query_id"), F.col("vec").alias("qvec"))
    return {
        "original": search.vector_topk(vecs.select("id", "vec"), ask, DEPTH),
        "hype": search.vector_topk(vecs.select(F.floor(F.col("id") / 2).alias("id"), "vec"), ask, DEPTH),
        "bm25": search.bm25_topk(read_texts(spark, sf_dir, "documents"), asked(spark, sf_dir), DEPTH),
    }


def fused(spark, sf_dir):
    return search.fused(fusion_lists(spark, sf_dir), WEIGHTS)


@query("triple_fusion_topk", f"SELECT * FROM {topk_sql(_FUSED, 5)}")
def triple_fusion_topk(spark, sf_dir):
    return search.top(fused(spark, sf_dir), 5, ["query_id"])


_CHUNK_HITS = topk_sql(bm25_sql(f"(SELECT chunk_id AS id, text FROM {CHUNKS_SQL})", _ITEMS), 20)


def chunk_hits(spark, sf_dir, k=20):
    """The best chunks of each benchmark passage."""
    return search.bm25_topk(windows(spark, sf_dir), asked(spark, sf_dir), k, "chunk_id")


@query(
    "doc_coherence_boost",
    f"SELECT query_id, id, doc, round(score * CASE WHEN rank <= 12 THEN 1 + 0.05 * least(sum(CASE WHEN rank <= 12 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, doc) - 1, 4) ELSE 1 END, 8) AS score FROM (SELECT *, CAST(split_part(id, '-', 1) AS BIGINT) AS doc FROM {_CHUNK_HITS})",
)
def doc_coherence_boost(spark, sf_dir):
    hits = chunk_hits(spark, sf_dir).select("query_id", "id", F.substring_index("id", "-", 1).cast("long").alias("doc"), "score")
    return search.coherence_boost(hits, within=12)


_SEEDS = f"(SELECT query_id, id AS chunk_id, score FROM {_CHUNK_HITS} WHERE rank <= 3)"


@query(
    "sibling_expansion",
    f"""WITH s AS {_SEEDS}, c AS (SELECT chunk_id, doc_id, chunk_index FROM {CHUNKS_SQL}) SELECT *, false AS expanded FROM s UNION ALL SELECT query_id, n.chunk_id, round(max(score) * 0.75, 8), true FROM s JOIN c USING (chunk_id) JOIN c n ON n.doc_id = c.doc_id AND abs(n.chunk_index - c.chunk_index) BETWEEN 1 AND 2
        WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.query_id = s.query_id AND t.chunk_id = n.chunk_id) GROUP BY query_id, n.chunk_id""",
)
def sibling_expansion(spark, sf_dir):
    """Only documents that have a seed are cut into chunks again."""
    seeds = stored(chunk_hits(spark, sf_dir, 3).select("query_id", F.col("id").alias("chunk_id"), "score"), "seeds")
    seeded = seeds.select(F.substring_index("chunk_id", "-", 1).cast("long").alias("doc_id")).distinct()
    return search.sibling_expansion(seeds, windows(spark, sf_dir, seeded))


_TURNS = "(SELECT conv_id * 1000 + turn AS id, conv_id, turn, text FROM conversations)"
_SIBLINGS = f"(SELECT id AS src, dst, 'sibling' AS edge_type, w AS weight FROM (SELECT id, unnest([lead(id, 1) OVER o, lead(id, 2) OVER o]) AS dst, unnest([0.9, 0.6]) AS w FROM {_TURNS} WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) WHERE dst IS NOT NULL)"
_EDGES = f"(SELECT * FROM {_SIBLINGS} UNION ALL SELECT dst, src, edge_type, weight FROM {_SIBLINGS})"


def turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text")


@query("chunk_graph_edges", f"SELECT src, dst, edge_type, CAST(weight AS DOUBLE) AS weight FROM {_EDGES}")
def chunk_graph_edges(spark, sf_dir):
    return graph.both_ways(graph.sibling_edges(turns(spark, sf_dir)))


@query(
    "entity_edges",
    """WITH m AS MATERIALIZED (SELECT DISTINCT l_partkey AS e, l_orderkey AS c, o_custkey AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey), k AS MATERIALIZED (SELECT m.*, n FROM m JOIN (SELECT e, count(*) AS n FROM m GROUP BY e HAVING count(*) BETWEEN 2 AND 20) USING (e))
        SELECT a.c AS src, b.c AS dst, 'entity' AS edge_type, CAST(CASE WHEN a.n <= 5 THEN 0.6 ELSE 0.4 END AS DOUBLE) AS weight FROM k a JOIN k b USING (e) WHERE a.d <> b.d AND a.c < b.c""",
)
def entity_edges(spark, sf_dir):
    (lines, orders), parts = read_keyed(spark, sf_dir, {"lineitem": "l_orderkey", "orders": "o_orderkey"})
    lines = lines.select("l_orderkey", "l_partkey").join(orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return graph.entity_edges(lines.select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id")), parts=parts)


@query(
    "graph_two_hop",
    f"""WITH e AS {_EDGES}, s AS (SELECT conv_id AS query_id, min(id) AS chunk_id FROM {_TURNS} GROUP BY conv_id), h1 AS (SELECT query_id, dst AS chunk_id, round(max(weight), 6) AS weight FROM s JOIN e ON src = chunk_id WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.query_id = s.query_id AND z.chunk_id = dst) GROUP BY query_id, dst),
        h2 AS (SELECT query_id, dst AS chunk_id, round(max(h1.weight * e.weight), 6) AS weight FROM h1 JOIN e ON src = chunk_id WHERE NOT EXISTS (SELECT 1 FROM (SELECT query_id, chunk_id FROM s UNION ALL SELECT query_id, chunk_id FROM h1) z WHERE z.query_id = h1.query_id AND z.chunk_id = dst) GROUP BY query_id, dst HAVING max(h1.weight * e.weight) >= 0.1)
        SELECT query_id, chunk_id, CAST(1 AS DOUBLE) AS weight, 0 AS hop FROM s UNION ALL SELECT query_id, chunk_id, CAST(weight AS DOUBLE), 1 FROM h1 UNION ALL SELECT query_id, chunk_id, CAST(weight AS DOUBLE), 2 FROM h2""",
)
def graph_two_hop(spark, sf_dir):
    own = turns(spark, sf_dir)
    seeds = own.groupBy(F.col("doc_id").alias("query_id")).agg(F.min("chunk_id").alias("chunk_id"))
    return graph.two_hops(seeds, graph.both_ways(graph.sibling_edges(own)))


_FACTS = "(SELECT o_orderkey AS chunk_id, 'security' AS type, 'CUST-' || o_custkey AS entity, CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS severity, lower(o_orderstatus) AS status FROM orders)"
_INDEX = f"""(SELECT DISTINCT unnest([upper(entity), 'type:' || type, 'severity:' || severity, 'status:' || status] || list_transform(list_filter(['Critical', 'High', 'Medium', 'Low'], lambda x, i: i >= list_position(['Critical', 'High', 'Medium', 'Low'], severity)), lambda x: 'severity_gte:' || x)) AS key, chunk_id FROM {_FACTS})"""
_CRITERIA = f"(SELECT DISTINCT severity || '/' || status AS query_id, unnest(['severity_gte:' || severity, 'status:' || status, 'type:none']) AS key FROM {_FACTS})"


def order_facts(spark, sf_dir):
    """Orders as facts: priority is severity, customer the entity."""
    level = F.col("o_orderpriority")
    severity = F.when(level == "1-URGENT", "Critical").when(level == "2-HIGH", "High").when(level == "3-MEDIUM", "Medium").otherwise("Low")
    (orders,), _ = read_keyed(spark, sf_dir, {"orders": "o_orderkey"})
    return orders.select(
        F.col("o_orderkey").alias("chunk_id"), F.lit("security").alias("type"), F.concat(F.lit("CUST-"), F.col("o_custkey")).alias("entity"), severity.alias("severity"), F.lower("o_orderstatus").alias("status")
    )


@query("entity_reverse_index", f"SELECT key, count(*) AS n, min(chunk_id) AS first FROM {_INDEX} GROUP BY key")
def entity_reverse_index(spark, sf_dir):
    return facts.entity_index(order_facts(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"))


@query(
    "entity_lookup_combined",
    f"""WITH h AS (SELECT * FROM {_CRITERIA} JOIN {_INDEX} USING (key)), a AS (SELECT query_id, count(DISTINCT key) AS asked FROM h GROUP BY query_id)
        SELECT query_id, chunk_id FROM (SELECT query_id, chunk_id, count(DISTINCT key) AS n FROM h GROUP BY ALL) JOIN a USING (query_id) WHERE n = asked""",
)
def entity_lookup_combined(spark, sf_dir):
    own = order_facts(spark, sf_dir)
    name = F.concat_ws("/", "severity", "status")
    keys = F.array(F.concat(F.lit("severity_gte:"), F.col("severity")), F.concat(F.lit("status:"), F.col("status")), F.lit("type:none"))
    criteria = own.select(name.alias("query_id"), F.explode(keys).alias("key")).distinct()
    return facts.combined_lookup(facts.entity_keys(own), criteria)


@query(
    "fact_query_equality",
    "SELECT c_mktsegment, count(*) AS n, round(max(o_totalprice), 2) AS most, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY c_mktsegment",
)
def fact_query_equality(spark, sf_dir):
    own = read(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return own.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("most"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ", ").alias("priorities"))


@query(
    "derived_temporal_terms",
    "SELECT o_orderkey, concat_ws(' ', y, y || CASE WHEN m <= 6 THEN '-H1' ELSE '-H2' END, y || '-Q' || quarter(o_orderdate), strftime(o_orderdate, '%Y-%m')) AS terms FROM (SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS y, month(o_orderdate) AS m FROM orders)",
)
def derived_temporal_terms(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(facts.derived_date_terms(F.col("o_orderdate")), " ").alias("terms"))


_AFTER = "(SELECT doc_id, CASE WHEN source = 'src1' THEN text || ' edited' ELSE text END AS text FROM documents WHERE lang <> 'es')"


def two_versions(spark, sf_dir):
    """Documents before (all but French) and after (all but Spanish, one source edited)."""
    docs = read_texts(spark, sf_dir, "documents")
    after = docs.where("lang <> 'es'").select("doc_id", F.when(F.col("source") == "src1", F.concat("text", F.lit(" edited"))).otherwise(F.col("text")).alias("text"))
    return docs.where("lang <> 'fr'").select("doc_id", "text"), after


@query("incremental_changes", f"SELECT doc_id, CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM (SELECT doc_id, text FROM documents WHERE lang <> 'fr') a FULL JOIN {_AFTER} b USING (doc_id) WHERE a.text IS DISTINCT FROM b.text")
def incremental_changes(spark, sf_dir):
    return store.change_set(*two_versions(spark, sf_dir))


@query("incremental_apply", f"SELECT doc_id, md5(text) AS content FROM {_AFTER}")
def incremental_apply(spark, sf_dir):
    before, after = two_versions(spark, sf_dir)
    return store.applied(before, after, store.change_set(before, after)).select("doc_id", F.md5("text").alias("content"))


@query("upsert_latest_wins", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice + 1, 2) ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert_latest_wins(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = old.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.round(F.col("o_totalprice") + 1, 2))
    return store.upserted(old, new, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query(
    "cascade_delete",
    "SELECT 'lineitem' AS name, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderstatus <> 'P'",
)
def cascade_delete(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "key")
    tables = {"orders": orders, "lineitem": read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "key")}
    left = store.cascade_delete(tables, orders.where("o_orderstatus = 'P'"), "key")
    return left["orders"].select(F.lit("orders").alias("name")).unionByName(left["lineitem"].select(F.lit("lineitem").alias("name"))).groupBy("name").agg(F.count("*").alias("n"))


@query("document_listing_page", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def document_listing_page(spark, sf_dir):
    return store.listed(read_texts(spark, sf_dir, "documents"), {"lang": "en"}, [F.desc("n_chars"), "doc_id"], 20, 20).select("doc_id", "n_chars")


@query("acl_filter", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE' OR c_nationkey IN (3, 7)")
def acl_filter(spark, sf_dir):
    none = F.array().cast("array<string>")
    rows = read(spark, sf_dir, "customer").select("c_custkey", none.alias("acl_users"), F.when(F.col("c_mktsegment") == "AUTOMOBILE", none).otherwise(F.array(F.col("c_nationkey").cast("string"))).alias("acl_roles"))
    return store.visible(rows, None, ["3", "7"]).select("c_custkey")


@query("json_metadata_filter", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 50")
def json_metadata_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k > 50")


@query(
    "semantic_cache_lookup",
    f"""WITH x AS (SELECT vec_id AS query_id, min(query_id) AS e FROM embeddings JOIN {_CENTRES} ON label = query_id AND label = 0 GROUP BY vec_id), n AS (SELECT id AS query_id, query_id AS e, score FROM {_VECTORS} WHERE id NOT IN (SELECT query_id FROM x) AND score >= 0.5)
        SELECT query_id, e AS entry_id, 'exact' AS kind FROM x UNION ALL SELECT query_id, e, 'semantic' FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, e) AS r FROM n) WHERE r = 1""",
)
def semantic_cache_lookup(spark, sf_dir):
    cache = centres(spark, sf_dir).select(F.col("query_id").alias("entry_id"), F.concat(F.lit("label "), F.col("query_id")).alias("text"), F.col("qvec").alias("vec"))
    asked_ = vectors(spark, sf_dir).select(F.col("id").alias("query_id"), F.when(F.col("label") == 0, F.concat(F.lit(" LABEL "), F.col("label"))).otherwise("other").alias("text"), "vec")
    return metrics.cache_lookup(asked_, cache, 0.5)


@query("recall_at_k", f"SELECT i.query_id, round(coalesce(r, 1), 6) AS recall FROM (SELECT DISTINCT query_id FROM {_BM25}) i LEFT JOIN (SELECT query_id, count(h.id) / count(*) AS r FROM (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) g LEFT JOIN {topk_sql(_BM25, 5)} h USING (query_id, id) GROUP BY query_id) USING (query_id)")
def recall_at_k(spark, sf_dir):
    hits = bm25_topk(spark, sf_dir)
    relevant = search.containing(read_texts(spark, sf_dir, "documents"), asked(spark, sf_dir))
    return metrics.recall_at_k(hits, relevant, 5)


_PAIR = "(SELECT * FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER o AS next_role, lead(text) OVER o AS answer FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"
_FQ, _FA = filtered("question"), filtered("answer")


def answered(spark, sf_dir):
    """User turns with the assistant's next one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    return rows.where("role = 'user' AND next_role = 'assistant'")


@query(
    "answer_metrics",
    f"""SELECT conv_id, turn, CAST(CASE WHEN nq = 0 OR na = 0 OR nb = 0 THEN 0 ELSE round(2 * nb / (nq + na), 4) END AS DOUBLE) AS f1, CAST(CASE WHEN nq = 0 OR na = 0 THEN 0 ELSE round(least(nb / nq + CASE WHEN words >= 20 THEN 0.2 ELSE 0 END, 1), 4) END AS DOUBLE) AS relevancy
        FROM (SELECT conv_id, turn, len(list_intersect({_FQ}, {_FA})) AS nb, len({_FQ}) AS nq, len({_FA}) AS na, len(string_split_regex(answer, '\\s+')) AS words FROM {_PAIR})""",
)
def answer_metrics(spark, sf_dir):
    a, q_ = F.col("answer"), F.col("question")
    return answered(spark, sf_dir).select("conv_id", "turn", metrics.token_f1(a, q_).alias("f1"), metrics.answer_relevancy(q_, a).alias("relevancy"))


@query("context_precision", f"SELECT conv_id AS query_id, round(avg(CASE WHEN len(list_intersect(q, c)) / greatest(len(q), 1) >= 0.2 THEN 1 ELSE 0 END), 6) AS precision FROM (SELECT conv_id, list_distinct({words('question')}) AS q, list_distinct({words('answer')}) AS c FROM {_PAIR}) GROUP BY conv_id")
def context_precision(spark, sf_dir):
    return metrics.context_precision(answered(spark, sf_dir).select(F.col("conv_id").alias("query_id"), "question", F.col("answer").alias("context")))


@query("latency_percentiles", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS average, max(value) AS most, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return metrics.latency_stats(read(spark, sf_dir, "events"), "value", ["event_type"])


@query(
    "budget_daily_monthly",
    "SELECT strftime(day, '%Y-%m-%d') AS day, round(spent, 4) AS spent_day, round(m, 4) AS spent_month, round(spent, 4) <= 20000 AND round(m, 4) <= 200000 AS allowed FROM (SELECT *, sum(spent) OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS m FROM (SELECT date_trunc('day', ts) AS day, sum(value) AS spent FROM events GROUP BY 1))",
)
def budget_daily_monthly(spark, sf_dir):
    return metrics.budget(read(spark, sf_dir, "events"), "ts", "value", 20000, 200000)


@query("checklist_score", "SELECT event_type, round(0.6 * least(CASE WHEN a <= 0 THEN 1 ELSE 40 / a END, 1), 6) AS fast, round(0.4 * least(n / 500, 1), 6) AS covered FROM (SELECT event_type, avg(value) AS a, count(*) AS n FROM events GROUP BY event_type)")
def checklist_score(spark, sf_dir):
    own = read(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("a"), F.count("*").alias("n"))
    return own.select("event_type", metrics.checklist(F.col("a"), 40, 0.6, True).alias("fast"), metrics.checklist(F.col("n"), 500, 0.4, False).alias("covered"))


@query("metrics_rollup", "SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS chars, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)")
def metrics_rollup(spark, sf_dir):
    both = read_texts(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return both.rollup("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("chars"), F.sum("toxic").alias("toxic"))


@query(
    "active_topic_window",
    r"SELECT conv_id, turn, last_value(topic IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS topic FROM (SELECT *, nullif(regexp_extract(text, '(\p{Lu}\p{Ll}{5,})', 1), '') AS topic FROM conversations)",
)
def active_topic_window(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, -1)
    topic = F.nullif(F.regexp_extract("text", r"(\p{Lu}\p{Ll}{5,})", 1), F.lit(""))
    return read(spark, sf_dir, "conversations").withColumn("t", topic).select("conv_id", "turn", F.last("t", ignorenulls=True).over(w).alias("topic"))


_MARKED = "(SELECT conv_id, turn, text || CASE WHEN role = 'user' THEN ' strongly_supported [2]' WHEN turn > 3 THEN ' [1] [Source 3] [9] [3]' ELSE '' END AS answer, CAST(turn + 1 AS INTEGER) AS n, turn / 8 AS top FROM conversations)"


@query(
    "citation_mapping",
    rf"""SELECT conv_id, turn, array_to_string(CASE WHEN len(c) > 0 THEN c ELSE range(1, n + 1) END, ',') AS cited, CASE WHEN contains(lower(answer), 'strongly_supported') THEN 'strongly_supported' WHEN contains(lower(answer), 'insufficient_evidence') THEN 'insufficient_evidence' WHEN contains(lower(answer), 'partially_supported') THEN 'partially_supported'
        WHEN top > 0.8 THEN 'strongly_supported' WHEN top > 0.5 THEN 'partially_supported' ELSE 'insufficient_evidence' END AS confidence
        FROM (SELECT *, list_filter(list_transform(regexp_extract_all(answer, '\[(?:[Ss]ource\s+)?(\d{{1,6}})\]', 1), lambda x: CAST(x AS INTEGER)), lambda x, i: x BETWEEN 1 AND n AND list_position(list_transform(regexp_extract_all(answer, '\[(?:[Ss]ource\s+)?(\d{{1,6}})\]', 1), lambda y: CAST(y AS INTEGER)), x) = i) AS c FROM {_MARKED})""",
)
def citation_mapping(spark, sf_dir):
    role, turn = F.col("role"), F.col("turn")
    mark = F.when(role == "user", " strongly_supported [2]").when(turn > 3, " [1] [Source 3] [9] [3]").otherwise("")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", mark).alias("answer"), (turn + 1).cast("int").alias("n"), (turn / 8).alias("top"))
    return rows.select("conv_id", "turn", F.array_join(answers.citations(F.col("answer"), F.col("n")).cast("array<string>"), ",").alias("cited"), answers.confidence(F.col("answer"), F.col("top")).alias("confidence"))


@query("context_budget", "SELECT source, doc_id, used FROM (SELECT source, doc_id, CAST(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents) WHERE used <= 16000")
def context_budget(spark, sf_dir):
    return answers.within_budget(read_texts(spark, sf_dir, "documents"), "source", ["doc_id"], "text", 16000).select("source", "doc_id", "used")


@query("dedup_exact", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedup_exact(spark, sf_dir):
    return read_texts(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


_WIN = "event_type, count(*) AS n, round(sum(value), 4) AS total"


@query("event_tumbling", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, {_WIN} FROM events GROUP BY 1, 2")
def event_tumbling(spark, sf_dir):
    return ingest.windowed(read(spark, sf_dir, "events"), "1 hour")


@query("event_sliding", f"SELECT start, {_WIN} FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1, 2")
def event_sliding(spark, sf_dir):
    return ingest.windowed(read(spark, sf_dir, "events"), "1 hour", "30 minutes")


@query(
    "event_session",
    """WITH g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
        SELECT user_id, min(ts) AS start, count(*) AS n, arg_max(event_type, {'a': ts, 'b': event_id}) AS last_type FROM g GROUP BY user_id, s""",
)
def event_session(spark, sf_dir):
    return ingest.sessions(read(spark, sf_dir, "events"), "6 hours")


@query("stream_incremental_ingest", "SELECT event_id, user_id, event_type, value FROM events")
def stream_incremental_ingest(spark, sf_dir):
    """The table that a stream of all files of `events` leaves; batches are upserts by event_id."""
    folder = f"{shared_folder(spark)}/stream-{spark.sparkContext.applicationId}-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    stream = ingest.read_table_stream(spark, f"{sf_dir}/events.parquet*", read(spark, sf_dir, "events").schema)
    ingest.ingest(stream, f"{folder}/table", f"{folder}/state", ["event_id"], ["ts"], lambda df: df.select("event_id", "ts", "user_id", "event_type", "value")).awaitTermination()
    return store.KeyedTable(spark, f"{folder}/table", ["event_id"]).read().select("event_id", "user_id", "event_type", "value")


def _hits(spark, sf_dir):
    return search.bm25_topk(read_texts(spark, sf_dir, "documents"), asked(spark, sf_dir), 20).join(read_texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")


@query("mmr_diversity")
def mmr_diversity(spark, sf_dir):
    return answers.diversified(_hits(spark, sf_dir), 5)


@query("dedup_near")
def dedup_near(spark, sf_dir):
    return answers.without_near_copies(_hits(spark, sf_dir))


@query("extractive_compression")
def extractive_compression(spark, sf_dir):
    rows = _hits(spark, sf_dir).join(asked(spark, sf_dir).withColumnRenamed("text", "query"), "query_id")
    return answers.compressed(rows.select("query_id", "id", "query", "text")).select("query_id", "id", "text")


@query("packed_sentence_chunks")
def packed_sentence_chunks(spark, sf_dir):
    return chunks.folded(read_texts(spark, sf_dir, "documents"), "fixed")


@query("semantic_chunks")
def semantic_chunks(spark, sf_dir):
    return chunks.folded(read_texts(spark, sf_dir, "documents"), "semantic")


@query("structural_chunks")
def structural_chunks(spark, sf_dir):
    return chunks.folded(read_texts(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), "structural")


@query("coherence_gate")
def coherence_gate(spark, sf_dir):
    return chunks.coherence_gate(turns(spark, sf_dir))
