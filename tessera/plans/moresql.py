"""Queries on stores, graph, answers, dialogue and metrics that follow further rules; each has the SQL of the same result beside it where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.html import html_text
from ..functions.text import array_jaccard, token_set
from ..operators import answers, chunks, dialogue, facts, graph, metrics, search, store
from ..sources import files
from ..streaming import ingest
from . import factsql, tablesql
from .tables import read, read_texts
from .tablesql import _BM25, _DOCS, _HYPE, _ITEMS, _ORIGINAL, _PAIR, DEPTH, answered, asked, bm25_sql, topk_sql, turns, vectors
from .texts import CHUNKS_SQL, SQL, filtered, q, query, windows, words

# ---- stores


@query("documents_by_ids", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def documents_by_ids(spark, sf_dir):
    ids = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return store.by_ids(read_texts(spark, sf_dir, "documents").select("doc_id", "n_chars"), ids)


@query("documents_updated", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def documents_updated(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = rows.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("closed").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    return store.updated(rows, changes, "o_orderkey")


@query("chunks_in_order", f"SELECT chunk_id, n_words FROM {CHUNKS_SQL} ORDER BY doc_id, chunk_index LIMIT 1000")
def chunks_in_order(spark, sf_dir):
    return store.ordered_chunks(windows(spark, sf_dir)).select("chunk_id", "n_words")


@query("store_status", f"SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM {CHUNKS_SQL}) AS chunks, (SELECT bool_or(source = 'src1') FROM documents) AS has_source")
def store_status(spark, sf_dir):
    return store.status(read_texts(spark, sf_dir, "documents"), windows(spark, sf_dir), "src1")


@query("vector_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 10 = 0")
def vector_upsert(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("id", "label")
    new = rows.where("id % 2 = 0").withColumn("label", F.col("label") + 100)
    both = store.vectors_added(rows, new)
    return store.vectors_added(both, rows.where("id % 10 = 0").withColumn("id", F.col("id") + 1000000), upsert=False)


@query("snapshot_diff", "SELECT o_orderkey AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 5 = 1 THEN 'deleted' ELSE 'modified' END AS change FROM orders WHERE o_orderkey % 5 < 3")
def snapshot_diff(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("modified"))
    after = rows.where("path % 5 <> 1").withColumn("modified", F.when(F.col("path") % 5 == 2, F.expr("modified + INTERVAL 1 DAY")).otherwise(F.col("modified")))
    return ingest.snapshot_diff(rows.where("path % 5 <> 0"), after)


@query(
    "debounced_changes",
    """WITH c AS (SELECT user_id AS path, ts, CASE WHEN event_id % 9 = 0 THEN 'deleted' WHEN event_id % 2 = 0 THEN 'modified' ELSE 'added' END AS change FROM events),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, change ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY path ORDER BY ts, change) + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM c))
        SELECT path, min(ts) AS start, CASE WHEN bool_or(change = 'deleted') THEN 'deleted' ELSE arg_max(change, {'a': ts, 'b': change}) END AS change FROM g GROUP BY path, s""",
)
def debounced_changes(spark, sf_dir):
    e = F.col("event_id")
    change = F.when(e % 9 == 0, "deleted").when(e % 2 == 0, "modified").otherwise("added")
    return ingest.debounced(read(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts", change.alias("change")), "3 hours")


# ---- graph


@query("parent_edges", "WITH c AS (SELECT c_custkey AS id, c_nationkey AS doc, concat(c_mktsegment, '-', c_custkey % 37) AS parent FROM customer), f AS (SELECT parent FROM c GROUP BY parent HAVING count(*) <= 50) SELECT a.id AS src, b.id AS dst, 'parent' AS edge_type, CAST(0.7 AS DOUBLE) AS weight FROM c a JOIN c b USING (parent) WHERE a.doc <> b.doc AND a.id < b.id AND parent IN (SELECT parent FROM f)")
def parent_edges(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"), F.col("c_nationkey").alias("doc_id"), F.concat_ws("-", "c_mktsegment", F.col("c_custkey") % 37).alias("parent"))
    return graph.parent_edges(rows)


@query("edge_neighbours", f"SELECT src AS chunk_id, dst, edge_type, CAST(weight AS DOUBLE) AS weight FROM {tablesql._EDGES} WHERE weight >= 0.7 AND edge_type IN ('sibling') AND src IN (SELECT id FROM {tablesql._TURNS} WHERE turn % 2 = 0)")
def edge_neighbours(spark, sf_dir):
    edges = graph.both_ways(graph.sibling_edges(turns(spark, sf_dir)))
    return graph.neighbours(edges, turns(spark, sf_dir).where("chunk_index % 2 = 0"), ["sibling"], 0.7)


@query(
    "constellation_topk",
    f"SELECT query_id, chunk_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM (SELECT query_id, chunk_id, round((0.5 + query_id % 5 / 10) * weight * CASE WHEN chunk_id % 3 = 0 THEN 1.3 ELSE 1 END, 8) AS score FROM ({SQL['graph_two_hop']}) WHERE hop > 0)) WHERE r <= 7",
)
def constellation_topk(spark, sf_dir):
    reached = tablesql.graph_two_hop(spark, sf_dir)
    best = reached.select("query_id").distinct().withColumn("best", 0.5 + F.col("query_id") % 5 / 10)
    return graph.constellation(reached, best, 2, reached.where("chunk_id % 3 = 0"))


# ---- chunks

_SECTIONS = f"(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1 AS chunk_index, concat('part ', chunk_id % 2) AS section FROM {factsql.BRIEFS})"
_HEAD = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:2], ' ')"
_CUT = lambda x, n: f"CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n}) || '...' ELSE {x} END"
_SUMMED = f"""(SELECT doc_id, section, count(*) AS n, min(chunk_index) AS first, string_agg('- ' || {_CUT("head", chunks.HEAD_CHARS)}, chr(10) ORDER BY chunk_index) AS heads FROM (SELECT *, {_HEAD} AS head FROM {_SECTIONS}) GROUP BY doc_id, section HAVING count(*) >= 3)"""


def sectioned(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id")) - 1
    return factsql.briefs(spark, sf_dir).withColumn("chunk_index", place).withColumn("section", F.concat(F.lit("part "), (F.col("chunk_id") % 2).cast("string")))


@query(
    "multi_resolution_summaries",
    f"""SELECT doc_id, -1 AS chunk_index, section, {_CUT("('[섹션 요약: ' || section || ']' || chr(10) || heads)", chunks.SECTION_CHARS)} AS text, 'section' AS resolution FROM {_SUMMED}
        UNION ALL SELECT d.doc_id, -2, NULL, {_CUT("('[문서 요약: ' || d.doc_id || ']' || coalesce(chr(10) || chr(10) || '[구성 섹션]' || chr(10) || listing, ''))", chunks.DOCUMENT_CHARS)}, 'document' FROM (SELECT DISTINCT doc_id FROM {_SECTIONS}) d LEFT JOIN (SELECT doc_id, string_agg('- ' || section || ' (' || n || '개 항목)', chr(10) ORDER BY first) AS listing FROM {_SUMMED} GROUP BY doc_id) USING (doc_id)""",
)
def multi_resolution_summaries(spark, sf_dir):
    return chunks.multi_resolution(sectioned(spark, sf_dir)).where("resolution <> 'chunk'")


@query("contextual_index_text", f"SELECT chunk_id, concat_ws(chr(10), 'Document: ' || doc_id, text, nullif(terms, ''), nullif(said, '')) AS text FROM {factsql.BRIEFS} JOIN (SELECT chunk_id, '' AS terms, '' AS said FROM {factsql.BRIEFS} WHERE NOT regexp_matches(text, '[0-9]\\.[0-9]|20[0-9][0-9]|SEC|PAT|억|만|매출|은행')) USING (chunk_id)")
def contextual_index_text(spark, sf_dir):
    """Of notes that nothing follows from: prefix and text. Derived terms and facts have queries of their own."""
    rows = factsql.briefs(spark, sf_dir).where(~F.col("text").rlike(r"[0-9]\.[0-9]|20[0-9][0-9]|SEC|PAT|억|만|매출|은행"))
    return rows.select("chunk_id", facts.contextual_text(F.concat(F.lit("Document: "), F.col("doc_id").cast("string")), F.col("text")).alias("text"))


@query("text_blocks")
def text_blocks(spark, sf_dir):
    return chunks.folded(read_texts(spark, sf_dir, "documents"), "blocks")


# ---- answers

_TOLD = (
    "",
    "짧다",
    "이 문서에는 충분한 정보가 없습니다.",
    "The documents do not have enough data about this, so the result is insufficient for an answer of any use to you.",
    "매출 규모는 언급되지 않았지만 나머지 항목은 모두 문서에서 확인되었고 자세한 내용은 표에 정리되어 있으니 참고하시기 바랍니다. 추가 자료도 함께 확인해 주세요.",
    "서비스 가용성에 대한 수치가 없어 답하지 못합니다",
    "문서에서 \"갱신 주기\"에 대한 설명을 확인하지 못했으나 계약 기간은 일 년입니다.",
    "The contract runs for one year and ends in March, as the second source says.\nConfidence: STRONGLY_SUPPORTED",
)
_ANSWERS = f"(SELECT c_custkey AS query_id, 'plan ' || c_custkey AS question, CASE c_custkey % {len(_TOLD)} " + " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(_TOLD)) + " END AS answer FROM customer)"


def told(spark, sf_dir):
    k = F.col("c_custkey")
    answer = F.element_at(F.array(*map(F.lit, _TOLD)), (k % len(_TOLD) + 1).cast("int"))
    return read_texts(spark, sf_dir, "customer").select(k.alias("query_id"), F.concat(F.lit("plan "), k.cast("string")).alias("question"), answer.alias("answer"))


_MARKS = " + ".join(f"CASE WHEN regexp_matches(answer, {q('(?i)' + p)}) THEN 1 ELSE 0 END" for p in answers.INSUFFICIENT)
_NAMED = " || ".join(f"regexp_extract(answer, {q(answers.NAMED_GAP)}, {i})" for i in (1, 2, 3))
_TOPIC = f"trim(regexp_extract(answer, {q(answers.TOPIC_GAP)}, 1))"


@query(
    "insufficient_answers",
    f"""SELECT query_id, length(answer) < 20 OR {_MARKS} >= 2 OR ({_MARKS} = 1 AND length(answer) < 100) AS insufficient, CASE WHEN regexp_matches(answer, {q(answers.GAP)}) THEN question WHEN {_NAMED} <> '' THEN {_NAMED} || ' ' || question
        WHEN regexp_matches(answer, {q(answers.TOPIC_GAP)}) THEN CASE WHEN {_TOPIC} <> '' AND NOT contains(question, {_TOPIC}) THEN question || ' ' || {_TOPIC} ELSE question END END AS again, trim(regexp_replace(trim(answer), {q(answers.SIGNAL)}, '')) AS cleaned FROM {_ANSWERS}""",
)
def insufficient_answers(spark, sf_dir):
    a = F.col("answer")
    return told(spark, sf_dir).select("query_id", answers.looks_insufficient(a).alias("insufficient"), answers.missing_focus(F.col("question"), a).alias("again"), answers.cleaned(a).alias("cleaned"))


def document_hits(spark, sf_dir, k=20):
    docs = read_texts(spark, sf_dir, "documents")
    return search.bm25_topk(docs, asked(spark, sf_dir), k).join(docs.select(F.col("doc_id").alias("id"), "text", "lang"), "id")


BUDGET = 4000
_OWN = f"(SELECT h.*, d.text, d.lang FROM {topk_sql(_BM25, 20)} h JOIN documents d ON d.doc_id = h.id)"
_TRUNC = r"""CASE WHEN length(body) <= left_ THEN body ELSE rtrim(CASE WHEN length(sentence) > left_ * 0.3 THEN sentence WHEN length(word) > left_ * 0.3 THEN word ELSE head END, chr(32) || chr(9) || chr(10) || chr(13)) || '...' END"""


@query(
    "context_assembly",
    rf"""WITH r AS (SELECT *, row_number() OVER w AS i, max(score) OVER (PARTITION BY query_id) AS best FROM {_OWN} WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id)),
        p AS (SELECT *, header || chr(10) || body AS part FROM (SELECT *, '[Source ' || i || '] ' || lang AS header, CASE WHEN CASE WHEN best > 0 THEN score / best ELSE 0.5 END < 0.5 AND length(text) > 300 THEN substring(text, 1, 300) || '...' ELSE text END AS body FROM r)),
        b AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY query_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
        o AS (SELECT *, i > 1 AND before + length(part) > {BUDGET} AS over_, CAST({BUDGET} - before - length(header) - 10 AS INTEGER) AS left_ FROM b),
        l AS (SELECT * FROM (SELECT *, coalesce(lag(over_) OVER (PARTITION BY query_id ORDER BY i), false) AS after FROM o) WHERE NOT after AND (NOT over_ OR left_ > 100)),
        c AS (SELECT *, regexp_extract(head, '(?s)^(.*(?:[.!?。]\s|[다요음임니까]\.\s|[다요음임니까]\s))', 1) AS sentence, regexp_extract(head, '(?s)^(.*) ', 1) AS word FROM (SELECT *, substring(body, 1, left_) AS head FROM l))
        SELECT query_id, count(*) AS n_sources, string_agg(CASE WHEN over_ THEN header || chr(10) || {_TRUNC} ELSE part END, chr(10) || chr(10) ORDER BY i) AS context FROM c GROUP BY query_id""",
)
def context_assembly(spark, sf_dir):
    return answers.assembled(document_hits(spark, sf_dir).withColumnRenamed("lang", "title"), BUDGET)


_LEXICAL = f"(SELECT h.*, coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0) AS model FROM (SELECT h.*, list_distinct({words('i.text')}) AS a, list_distinct({words('d.text')}) AS b FROM {topk_sql(_BM25, 20)} h JOIN documents d ON d.doc_id = h.id JOIN benchmark i ON i.item_id = h.query_id) h)"


@query("rerank_blend", f"SELECT query_id, id, round(0.7 * model + 0.3 * score, 8) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY model DESC, score DESC, id) AS r FROM {_LEXICAL}) WHERE r <= 5")
def rerank_blend(spark, sf_dir):
    """The share of words that question and text have in common stands in for a model."""
    hits = document_hits(spark, sf_dir).join(asked(spark, sf_dir).withColumnRenamed("text", "question"), "query_id")
    return answers.reranked(hits, array_jaccard(token_set(F.col("question")), token_set(F.col("text")))).select("query_id", "id", "score", "rank")


@query("fact_verification")
def fact_verification(spark, sf_dir):
    """Answers that name a customer and a sum, against the facts of the note that each is from."""
    notes = factsql.briefs(spark, sf_dir)
    k = F.col("chunk_id")
    said = F.concat(F.lit("고객 "), F.when(k % 4 == 3, "미래증권").otherwise("한빛은행"), F.lit("은 Enterprise 등급이고 카카오도 고객사입니다. 매출은 "), (k % 100).cast("string"), F.lit("억원"))
    own = factsql.extracted(spark, sf_dir).withColumnRenamed("chunk_id", "query_id")
    return answers.verified(notes.select(k.alias("query_id"), said.alias("answer")), own, notes.select(k.alias("query_id"), "text")).select("query_id", F.array_join("unfounded", ", ").alias("unfounded"), "valid")


# ---- dialogue

KNOWN = ("pavi", "zung", "chkeit", "ouelle", "mente")
_NAMES = "CASE " + " ".join(f"WHEN contains(text, '{n}') THEN '{n}'" for n in KNOWN) + " END"


def _has(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


@query(
    "topic_continuity",
    rf"""SELECT conv_id, turn, topic, concat_ws(' ', topic, text) AS augmented FROM (SELECT *, CASE WHEN role = 'user' AND place > 2 AND named IS NULL AND (regexp_matches(text, '다시\s+[\p{{L}}\p{{N}}_]+\s*(?:얘기|이야기|관련|건)') OR NOT {_has("text", dialogue.CHANGES)}) AND NOT {_has("text", dialogue.GENERAL)} AND length(text) <= 80
        THEN last_value(named IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END AS topic FROM (SELECT *, {_NAMES} AS named, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations))""",
)
def topic_continuity(spark, sf_dir):
    return dialogue.continued_topics(read(spark, sf_dir, "conversations"), list(KNOWN)).select("conv_id", "turn", "topic", "augmented")


@query("pronoun_rewrite")
def pronoun_rewrite(spark, sf_dir):
    """Each third question is "what is its ...", each answer begins with a bold name."""
    rows = read(spark, sf_dir, "conversations")
    first = F.regexp_extract("text", r"([\p{L}]{3,20})", 1)
    text = F.when(F.col("role") == "assistant", F.concat(F.lit("**"), first, F.lit("** "), F.col("text"))).when(F.col("turn") % 3 == 2, F.concat(F.lit("what is its "), first)).otherwise(F.col("text"))
    return dialogue.rewritten(rows.withColumn("text", text), {n: "concept" for n in KNOWN}).where("role = 'user'").select("conv_id", "turn", "standalone")


# ---- metrics

_SENTENCES = r"list_filter(string_split(regexp_replace(trim({}, chr(32) || chr(9) || chr(10) || chr(13)), '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"
_LISTS = "(" + " OR ".join(f"contains(lower(question), '{w}')" for w in metrics.ENUMERATING) + ")"
_COMPLETE = f"""(SELECT conv_id, turn, CAST(CASE WHEN answer = '' OR context = '' THEN 0 WHEN len(u) = 0 THEN 1 WHEN NOT lists AND len(a) = 0 THEN 0 ELSE round(len(list_filter(u, lambda s: len(s) = 0 OR len(list_intersect(s, a)) / len(s) >= 0.3)) / len(u), 4) END AS DOUBLE) AS completeness
    FROM (SELECT *, list_filter(sets, lambda s: NOT lists OR len(s) > 0) AS u FROM (SELECT conv_id, turn, answer, context, {_LISTS} AS lists, {filtered("answer")} AS a, list_transform({_SENTENCES.format("context")}, lambda s: {filtered("s")}) AS sets FROM (SELECT *, question AS context FROM {_PAIR}))))"""


def pairs(spark, sf_dir):
    return answered(spark, sf_dir).select(F.struct("conv_id", "turn").alias("query_id"), "question", "answer", F.col("question").alias("context"))


@query("answer_completeness", f"SELECT * FROM {_COMPLETE}")
def answer_completeness(spark, sf_dir):
    return metrics.completeness(pairs(spark, sf_dir)).select("query_id.*", "completeness")


def scores(spark, sf_dir, where="true"):
    """(metric, value) of the pairs of conversations, and of the events as latencies."""
    own = answered(spark, sf_dir).where(where)
    a, b = F.col("answer"), F.col("question")
    each = own.select(F.explode(F.map_from_arrays(F.array(F.lit("token_f1"), F.lit("answer_relevancy")), F.array(metrics.token_f1(a, b), metrics.answer_relevancy(b, a)))).alias("metric", "value"))
    full = metrics.completeness(pairs(spark, sf_dir)).where(where.replace("turn", "query_id.turn")).select(F.lit("completeness").alias("metric"), F.col("completeness").alias("value"))
    late = read(spark, sf_dir, "events").where(where.replace("turn", "event_id")).select(F.lit("latency_p95").alias("metric"), (F.col("value") / 50).alias("value"))
    return each.unionByName(full).unionByName(late)


def _scores_sql(where: str) -> str:
    m = f"(SELECT * FROM ({SQL['answer_metrics']}) WHERE {where})"
    return f"(SELECT 'token_f1' AS metric, f1 AS value FROM {m} UNION ALL SELECT 'answer_relevancy', relevancy FROM {m} UNION ALL SELECT 'completeness', completeness FROM {_COMPLETE} WHERE {where} UNION ALL SELECT 'latency_p95', value / 50 FROM events WHERE {where.replace('turn', 'event_id')})"


def _evaluation_sql(where: str) -> str:
    target = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in metrics.TARGETS.items()) + " END"
    advice = "CASE metric " + " ".join(f"WHEN '{k}' THEN {q(v[2])}" for k, v in metrics.TARGETS.items()) + " END"
    return f"(SELECT metric, score, samples, CAST({target} AS DOUBLE) AS target, CASE WHEN metric = 'latency_p95' THEN score <= {target} ELSE score >= {target} END AS passed, CASE WHEN NOT CASE WHEN metric = 'latency_p95' THEN score <= {target} ELSE score >= {target} END THEN {advice} END AS advice FROM (SELECT metric, count(*) AS samples, round(CASE WHEN metric = 'latency_p95' THEN quantile_cont(value, 0.95) ELSE avg(value) END, 4) AS score FROM {_scores_sql(where)} GROUP BY metric))"


@query("evaluation_run", f"SELECT * FROM {_evaluation_sql('true')}")
def evaluation_run(spark, sf_dir):
    return metrics.evaluation(scores(spark, sf_dir))


@query(
    "evaluation_ab",
    f"SELECT *, CASE WHEN s > 0 THEN 'config_b' WHEN s < 0 THEN 'config_a' ELSE 'tie' END AS winner FROM (SELECT metric, config_a, config_b, delta FROM (SELECT metric, coalesce(a.score, 0) AS config_a, coalesce(b.score, 0) AS config_b, round(coalesce(b.score, 0) - coalesce(a.score, 0), 4) AS delta FROM {_evaluation_sql('turn % 4 < 2')} a FULL JOIN {_evaluation_sql('turn % 4 >= 2')} b USING (metric))) CROSS JOIN (SELECT sum(sign(round(coalesce(b.score, 0) - coalesce(a.score, 0), 4))) AS s FROM {_evaluation_sql('turn % 4 < 2')} a FULL JOIN {_evaluation_sql('turn % 4 >= 2')} b USING (metric))".replace(
        "SELECT *, CASE", "SELECT metric, config_a, config_b, delta, CASE", 1
    ),
)
def evaluation_ab(spark, sf_dir):
    return metrics.compared(metrics.evaluation(scores(spark, sf_dir, "turn % 4 < 2")), metrics.evaluation(scores(spark, sf_dir, "turn % 4 >= 2")))


_TOP6 = r"array_to_string(list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')[1:6], ' ')"
_LONG = f"list_filter({_SENTENCES.format('text')}, lambda s: length(s) > 20)"


@query(
    "synthetic_questions",
    f"""WITH c AS (SELECT doc_id AS source, {_LONG} AS l FROM documents WHERE length(trim(text)) > 0 ORDER BY length(text) DESC, doc_id LIMIT 60), s AS (SELECT source, l[1] AS a, list_filter(l, lambda x: regexp_matches(x, '[0-9]'))[1] AS b FROM c),
        u AS (SELECT source, 'What does the document say about: ' || {_TOP6.format("a")} || '?' AS question, a AS expected_answer, 'topic_question' AS strategy FROM s WHERE a IS NOT NULL UNION ALL SELECT source, 'What are the key figures regarding: ' || {_TOP6.format("b")} || '?', b, 'factual_question' FROM s WHERE b IS NOT NULL)
        SELECT * FROM u ORDER BY md5(CAST(source AS VARCHAR) || strategy), source LIMIT 30""",
)
def synthetic_questions(spark, sf_dir):
    return metrics.synthetic_questions(read_texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), 30)


GRID = [{"original": a / 4, "hype": b / 4, "bm25": (4 - a - b) / 4} for a in range(5) for b in range(5 - a)]
_GRID = "(" + " UNION ALL ".join(f"SELECT {i} AS setting, {g['original']} AS original, {g['hype']} AS hype, {g['bm25']} AS bm25" for i, g in enumerate(GRID)) + ")"


@query(
    "weights_autotune",
    f"""WITH l AS (SELECT 'original' AS name, query_id, id, score / (60 + rank) AS part FROM {topk_sql(_ORIGINAL, DEPTH)} UNION ALL SELECT 'hype', query_id, id, score / (60 + rank) FROM {topk_sql(_HYPE, DEPTH)} UNION ALL
            SELECT 'bm25', query_id, id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN hi > 0 THEN score / hi ELSE 0 END / (60 + rank) FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {topk_sql(_BM25, DEPTH)})),
        t AS (SELECT setting, query_id, id, round(sum(part * CASE name WHEN 'original' THEN original WHEN 'hype' THEN hype ELSE bm25 END), 10) AS s FROM l CROSS JOIN {_GRID} GROUP BY ALL),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY setting, query_id ORDER BY s DESC, id) AS r FROM t) WHERE r <= 5),
        g AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
        SELECT setting, round(avg(recall), 6) AS recall FROM (SELECT setting, query_id, count(r) / count(*) AS recall FROM (SELECT setting, g.* FROM g CROSS JOIN {_GRID}) LEFT JOIN b USING (setting, query_id, id) GROUP BY ALL) GROUP BY setting""",
)
def weights_autotune(spark, sf_dir):
    return metrics.tuned(tablesql.fusion_lists(spark, sf_dir), search.containing(read_texts(spark, sf_dir, "documents"), asked(spark, sf_dir)), GRID)


_CASES = "(SELECT text AS answer, CASE turn % 3 WHEN 0 THEN ['DIE', 'zzz'] WHEN 1 THEN ['zzz'] ELSE [] END AS keywords, CASE WHEN conv_id % 2 = 0 THEN 'all' ELSE 'any' END AS match_mode, turn % 7 = 6 AS expect_insufficient, CASE WHEN conv_id % 4 = 0 THEN 'insufficient_evidence' ELSE 'x' END AS confidence, CASE WHEN conv_id % 3 = 0 THEN 'hard' ELSE 'easy' END AS difficulty, turn * 1.5 + conv_id % 10 AS latency FROM conversations)"
_OK = "CASE WHEN expect_insufficient THEN (contains(lower(answer), '부족') OR contains(lower(answer), '없습니다') OR contains(lower(answer), '없음') OR contains(lower(answer), '확인되지')) OR confidence = 'insufficient_evidence' WHEN len(keywords) = 0 THEN length(answer) > 10 WHEN match_mode = 'all' THEN len(list_filter(keywords, lambda k: NOT contains(lower(answer), lower(k)))) = 0 ELSE len(list_filter(keywords, lambda k: contains(lower(answer), lower(k)))) > 0 END"


@query(
    "scenario_scores",
    f"SELECT count(*) AS total, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS passed, round(sum(CASE WHEN ok THEN 1 ELSE 0 END) / count(*), 6) AS pass_rate, round(sum(CASE WHEN ok AND difficulty = 'hard' THEN 1 ELSE 0 END) / sum(CASE WHEN difficulty = 'hard' THEN 1 ELSE 0 END), 6) AS hard_pass_rate, CAST(round(quantile_cont(CAST(latency AS DOUBLE), 0.5), 6) AS DOUBLE) AS latency_median, CAST(list_sort(list(latency))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS BIGINT) + 1] AS DOUBLE) AS latency_p95 FROM (SELECT *, {_OK} AS ok FROM {_CASES})",
)
def scenario_scores(spark, sf_dir):
    t, c = F.col("turn"), F.col("conv_id")
    none = F.array().cast("array<string>")
    keywords = F.when(t % 3 == 0, F.array(F.lit("DIE"), F.lit("zzz"))).when(t % 3 == 1, F.array(F.lit("zzz"))).otherwise(none)
    rows = read(spark, sf_dir, "conversations").select(F.col("text").alias("answer"), keywords.alias("keywords"), F.when(c % 2 == 0, "all").otherwise("any").alias("match_mode"), (t % 7 == 6).alias("expect_insufficient"), F.when(c % 4 == 0, "insufficient_evidence").otherwise("x").alias("confidence"), F.when(c % 3 == 0, "hard").otherwise("easy").alias("difficulty"), (t * 1.5 + c % 10).cast("double").alias("latency"))
    return metrics.scenarios(rows)


@query("trace_stats_since", "SELECT count(*) AS n, round(avg(value), 6) AS average, max(value) AS most, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, CAST(sum(user_id) AS BIGINT) AS tokens_in, CAST(sum(event_id) AS BIGINT) AS tokens_out, round(sum(value / 100), 6) AS cost FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'")
def trace_stats_since(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), F.col("value").alias("latency"), F.col("user_id").alias("tokens_in"), F.col("event_id").alias("tokens_out"), (F.col("value") / 100).alias("cost"))
    return metrics.trace_stats(rows, "2024-01-10 00:00:00")


@query("batch_summary", "SELECT count(*) AS total, count(*) FILTER (event_id % 7 <> 0) AS succeeded, count(*) FILTER (event_id % 7 = 0) AS failed, round(avg(value) FILTER (event_id % 7 <> 0), 6) AS average_latency, round(count(*) FILTER (event_id % 7 = 0) / count(*), 6) AS error_rate FROM events")
def batch_summary(spark, sf_dir):
    return metrics.batch_summary(read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, "failed").alias("error"), F.col("value").alias("latency")))


@query("cache_eviction", "SELECT entry_id FROM (SELECT o_orderkey AS entry_id, o_custkey % 5 AS hit_count, epoch(o_orderdate) AS created_at FROM orders) WHERE epoch(TIMESTAMP '1998-08-02 00:00:00') - created_at <= 86400 * 900 ORDER BY hit_count DESC, created_at, entry_id LIMIT 100")
def cache_eviction(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), (F.col("o_custkey") % 5).alias("hit_count"), F.col("o_orderdate").cast("timestamp").cast("double").alias("created_at"), F.lit(86400.0 * 900).alias("ttl_seconds"))
    return metrics.evicted(metrics.live(rows, F.lit("1998-08-02 00:00:00").cast("timestamp").cast("double")), 100).select("entry_id")


@query("rate_limit_replay")
def rate_limit_replay(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("ts"), F.col("event_id").alias("id"))
    return metrics.limited(rows, 1 / 3600, 3).select("id", "allowed")


@query("perturbed_corpus")
def perturbed_corpus(spark, sf_dir):
    return factsql.briefs(spark, sf_dir).select("chunk_id", F.md5(metrics.perturbed(F.col("text"), 7)).alias("content"))


# ---- sources


@query("url_filter", r"SELECT page_id, host <> '' AND NOT regexp_matches(host, '^(?:localhost|.*\.local|.*\.internal|0\..*|10\..*|127\..*|169\.254\..*|192\.168\..*|172\.(?:1[6-9]|2\d|3[01])\..*|\[.*\])$') AS allowed FROM (SELECT page_id, regexp_extract(lower(CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, 'https://', 'ftp://') WHEN 2 THEN 'http://10.0.0.' || page_id ELSE 'http://u@example.local/' || page_id END), '^https?://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]+)', 1) AS host FROM pages)")
def url_filter(spark, sf_dir):
    k = F.col("page_id")
    url = F.when(k % 4 == 0, F.col("url")).when(k % 4 == 1, F.replace("url", F.lit("https://"), F.lit("ftp://"))).when(k % 4 == 2, F.concat(F.lit("http://10.0.0."), k.cast("string"))).otherwise(F.concat(F.lit("http://u@example.local/"), k.cast("string")))
    return read_texts(spark, sf_dir, "pages").select("page_id", files.allowed_url(url).alias("allowed"))


@query("sync_count", "SELECT count(*) AS added FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01 00:00:00'")
def sync_count(spark, sf_dir):
    return files.synced_since(read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("modified_at")), "1997-01-01 00:00:00")


_KINDS = tuple(files.MIME)
_FILE = f"CASE c_custkey % {len(_KINDS) + 1} " + " ".join(f"WHEN {i} THEN '/data/part.{i}/File ' || c_custkey || '.{k.upper() if i % 2 else k}'" for i, k in enumerate(_KINDS)) + " ELSE '/data/x.y/none' || c_custkey END"


@query("file_kinds", rf"SELECT c_custkey, CASE lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in files.MIME.items())} ELSE 'application/octet-stream' END AS mime, regexp_extract(path, '([^/]+?)(?:\.[^./]*)?$', 1) AS title FROM (SELECT c_custkey, {_FILE} AS path FROM customer)")
def file_kinds(spark, sf_dir):
    k = F.col("c_custkey")
    path = F.concat(F.lit("/data/x.y/none"), k.cast("string"))
    for i, ext in enumerate(_KINDS):
        path = F.when(k % (len(_KINDS) + 1) == i, F.concat(F.lit(f"/data/part.{i}/File "), k.cast("string"), F.lit(f".{ext.upper() if i % 2 else ext}"))).otherwise(path)
    rows = read(spark, sf_dir, "customer").select("c_custkey", path.alias("path"))
    return rows.select("c_custkey", files.mime_type(F.col("path")).alias("mime"), files.file_stem(F.col("path")).alias("title"))


@query(
    "parser_comparison",
    f"SELECT source_id, parser, CAST(n AS INTEGER) AS text_length, CAST(w AS INTEGER) AS word_count, CAST(CASE WHEN max(n) OVER s > 0 THEN round((max(n) OVER s - min(n) OVER s) / max(n) OVER s, 6) ELSE 0 END AS DOUBLE) AS text_diff_ratio FROM (SELECT page_id AS source_id, 'blocks' AS parser, length(text) AS n, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM ({SQL['html_to_text']}) UNION ALL SELECT page_id, 'tags', length(t), len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages)) WINDOW s AS (PARTITION BY source_id)",
)
def parser_comparison(spark, sf_dir):
    """Two ways to read a page: text by blocks, and what is left without tags."""
    pages = read_texts(spark, sf_dir, "pages").select(F.col("page_id").alias("source_id"), "html")
    both = pages.select("source_id", F.lit("blocks").alias("parser"), html_text(F.col("html")).alias("text")).unionByName(pages.select("source_id", F.lit("tags").alias("parser"), F.regexp_replace("html", "<[^>]+>", "").alias("text")))
    return files.compared_parsers(both)


_BLOCKS = ("paragraph", "heading_1", "heading_2", "heading_3", "bulleted_list_item", "numbered_list_item", "to_do", "quote", "code", "divider", "image")
_LINES = ("text", "'# ' || text", "'## ' || text", "'### ' || text", "'- ' || text", "'1. ' || text", "CASE WHEN turn % 2 = 0 THEN '- [x] ' ELSE '- [ ] ' END || text", "'> ' || text", "'```' || role || chr(10) || text || chr(10) || '```'", "'---'", "NULL")


@query("block_lines", f"SELECT conv_id, turn, md5(CASE (conv_id + turn) % {len(_BLOCKS)} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_LINES))} END) AS line FROM conversations")
def block_lines(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _BLOCKS)), ((F.col("conv_id") + F.col("turn")) % len(_BLOCKS) + 1).cast("int"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(files.block_line(kind, F.col("text"), F.col("turn") % 2 == 0, F.col("role"))).alias("line"))
