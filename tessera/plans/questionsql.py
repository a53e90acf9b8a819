"""Queries on questions: several parts, everyday words, decomposition. Questions are templates filled with customer keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import questions as Q
from .tables import read_texts
from .texts import q, query

TEMPLATES = (
    "고객 #의 계약 3건의 금액을 알려줘",
    "회의록#의 채용 계획과 로드맵의 채용 계획이 일치하나요?",
    "삼성#와 현대의 매출이 같은가요?",
    "알파# 대비 베타의 기술적 장점은?",
    "A# vs B의 가격은?",
    "팀 #의 팀장은 김하나이고, 그 팀의 예산은 모두 얼마인가요?",
    "제품 #의 기능을 설명해줘 그리고 가격과 배포 방식도 알려줘",
    "투자 #가 실패하면 현재 런웨이로 언제까지 운영 가능한가요?",
    "투자 #이 성공하면 총 누적 투자액은 얼마인가요?",
    "계약 #건이 모두 성사되면 매출에 어떤 영향이 있나요?",
    "매출과 비용 및 이익#을 알려줘",
    "각각 설명해줘 #",
    "모든 고객 # 목록",
    "돈 얼마야? #",
    "#",
    "What's the total of plan # when it is done?",
)
_CASE = " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(TEMPLATES))
ASKED = f"(SELECT c_custkey AS query_id, replace(CASE c_custkey % {len(TEMPLATES)} {_CASE} END, '#', CAST(c_custkey AS VARCHAR)) AS text FROM customer)"


def asked(spark, sf_dir):
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, TEMPLATES)), (k % len(TEMPLATES) + 1).cast("int"))
    return read_texts(spark, sf_dir, "customer").select(k.alias("query_id"), F.replace(kind, F.lit("#"), k.cast("string")).alias("text"))


def _m(p: str) -> str:
    return f"regexp_matches(text, {q(p)})"


def _g(p: str, i: int) -> str:
    return f"regexp_extract(text, {q(p)}, {i})"


def _t(p: str, i: int) -> str:
    return f"trim({_g(p, i)})"


def _ask(x: str) -> str:
    return f"CASE WHEN ends_with({x}, '?') THEN {x} ELSE {x} || '?' END"


_BARE = "regexp_replace({}, '[와의]+$', '')"
_AGAINST = " ".join(
    f"WHEN {_m(p)} THEN [{_BARE.format(_t(p, 1))} || '의 ' || rtrim({_t(p, 3)}, '?') || '은?', {_BARE.format(_t(p, 2))} || '의 ' || rtrim({_t(p, 3)}, '?') || '과 차별화 요소는?', text]" for p in Q.AGAINST
)
_REST = _t(Q.IF_ALL, 2)
_TARGET = "CASE " + " ".join(f"WHEN contains({_REST}, '{x}') THEN split_part({_REST}, '{x}', 1)" for x in ("에", "은", "는", "이", "가")) + f" ELSE {_REST} END"
_ONE = _t(Q.COMPOUND, 1)
_PARTS = f"""CASE WHEN {_m(Q.BOTH_SOURCES)} THEN [{_g(Q.BOTH_SOURCES, 1)} || '의 ' || {_g(Q.BOTH_SOURCES, 2)} || '은?', {_g(Q.BOTH_SOURCES, 3)} || '의 ' || {_g(Q.BOTH_SOURCES, 4)} || '은?', text]
    WHEN {_m(Q.ONE_TOPIC)} THEN [{_g(Q.ONE_TOPIC, 1)} || '의 ' || {_g(Q.ONE_TOPIC, 3)} || '은?', {_g(Q.ONE_TOPIC, 2)} || '의 ' || {_g(Q.ONE_TOPIC, 3)} || '은?', text] {_AGAINST}
    WHEN {_m(Q.COMPOUND)} THEN CASE WHEN length({_t(Q.COMPOUND, 2)}) < 10 THEN [text] ELSE [CASE WHEN ends_with({_ONE}, '?') THEN {_ONE} ELSE regexp_replace({_ONE}, '(?:이고|이며|이고요)$', '인가요?') END, {_ask(_t(Q.COMPOUND, 2))}] END
    WHEN {_m(Q.JOINED)} AND length({_ask(_t(Q.JOINED, 1))}) > 10 AND length({_ask(_t(Q.JOINED, 2))}) > 10 THEN [{_ask(_t(Q.JOINED, 1))}, {_ask(_t(Q.JOINED, 2))}]
    WHEN {_m(Q.IF_FAILS)} THEN ['현재 ' || {_t(Q.IF_FAILS, 2)} || '는 얼마인가요?', {_t(Q.IF_FAILS, 1)} || ' 준비 상황은?', text]
    WHEN {_m(Q.IF_WORKS)} THEN ['현재 ' || {_t(Q.IF_WORKS, 2)} || '은 얼마인가요?', {_t(Q.IF_WORKS, 1)} || '의 금액은 얼마인가요?', text]
    WHEN {_m(Q.IF_ALL)} THEN ['현재 ' || {_TARGET} || '은 얼마인가요?', {_t(Q.IF_ALL, 1)} || '의 각각의 세부 규모는?', text] ELSE [text] END"""


@query("query_decomposition", f"SELECT query_id, CAST(unnest(range(0, len(p))) AS INTEGER) AS part, unnest(p) AS question FROM (SELECT query_id, {_PARTS} AS p FROM {ASKED})")
def query_decomposition(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", F.posexplode_outer(Q.decomposed(F.col("text"))).alias("part", "question"))  # never empty; without "outer" a filter on its size does all of it twice


_ITEMS = f"list_filter(list_transform(string_split_regex({_g(Q.LISTED, 1)}, {q(Q.JOINT)}), lambda x: trim(x)), lambda x: x <> '')"
_PAIR = lambda p: f"[{_g(p, 1)}, {_g(p, 2)}]"
_EXPECTED = f"""(SELECT query_id, text, kind, CAST(CASE kind WHEN 'count' THEN CAST(n AS INTEGER) WHEN 'comparison' THEN 2 WHEN 'enumeration' THEN len(listed) END AS INTEGER) AS n, CASE WHEN kind = 'comparison' AND {_m(Q.VERSUS)} THEN {_PAIR(Q.VERSUS)} WHEN kind = 'comparison' THEN {_PAIR(Q.BETWEEN)} WHEN kind = 'enumeration' THEN listed ELSE [] END AS items
    FROM (SELECT *, CASE WHEN length(text) < 3 THEN NULL WHEN TRY_CAST(n AS INTEGER) >= 2 THEN 'count' WHEN {_m(Q.VERSUS)} OR {_m(Q.BETWEEN)} THEN 'comparison' WHEN len(listed) >= 2 THEN 'enumeration' WHEN {_m(Q.EACH)} OR {_m(Q.ALL)} THEN 'collection' END AS kind
    FROM (SELECT query_id, text, {_g(Q.COUNTED, 1)} AS n, {_ITEMS} AS listed FROM {ASKED})))"""


@query("expected_parts", f"SELECT query_id, kind, n, array_to_string(items, '|') AS items FROM {_EXPECTED} WHERE kind IS NOT NULL")
def expected_parts(spark, sf_dir):
    own = asked(spark, sf_dir).withColumn("p", Q.expected_parts(F.col("text"))).where("p IS NOT NULL")
    return own.select("query_id", "p.kind", "p.n", F.array_join("p.items", "|").alias("items"))


_ANSWER = "CASE query_id % 5 WHEN 0 THEN '' WHEN 1 THEN '1. 매출' || chr(10) || '2. B의 값' || chr(10) || '3) x' WHEN 2 THEN '- 비용' || chr(10) || '- 이익' || query_id || '을' WHEN 3 THEN '**매출**: 1 **비용**: 2' ELSE 'one' || chr(10) || 'two' || chr(10) || 'three a' || query_id END"
_COUNTED = r"""CASE WHEN len(list_distinct(regexp_extract_all(answer, '(?:^|\n)\s*([0-9]+)[.)]\s', 1))) >= 2 THEN len(list_distinct(regexp_extract_all(answer, '(?:^|\n)\s*([0-9]+)[.)]\s', 1))) WHEN len(regexp_extract_all(answer, '(?:^|\n)\s*[-*•]\s+')) >= 2 THEN len(regexp_extract_all(answer, '(?:^|\n)\s*[-*•]\s+'))
    WHEN len(regexp_extract_all(answer, '\*\*[^*]+\*\*\s*[:：]')) >= 2 THEN len(regexp_extract_all(answer, '\*\*[^*]+\*\*\s*[:：]')) WHEN len(list_filter(string_split(answer, chr(10)), lambda x: trim(x) <> '')) >= 3 AND len(list_filter(string_split(answer, chr(10)), lambda x: length(trim(x)) >= 200)) = 0 THEN len(list_filter(string_split(answer, chr(10)), lambda x: trim(x) <> '')) ELSE 1 END"""


@query(
    "answer_completeness_check",
    f"""SELECT query_id, CASE WHEN answer = '' THEN false WHEN len(items) > 0 THEN len(gone) = 0 WHEN n IS NULL THEN true ELSE n <= c END AS complete,
        CASE WHEN answer = '' THEN array_to_string(items, '|') WHEN len(items) > 0 THEN array_to_string(gone, '|') WHEN n IS NULL OR n <= c THEN '' ELSE '(' || (n - c) || ' items missing)' END AS missing,
        CASE WHEN answer = '' THEN text WHEN len(items) > 0 THEN CASE WHEN len(gone) > 0 THEN array_to_string(gone, ', ') || ' ' || text END WHEN n IS NULL OR n <= c THEN NULL ELSE text || ' (나머지 ' || (n - c) || '건 추가로 알려주세요)' END AS again
        FROM (SELECT *, {_COUNTED} AS c, list_filter(items, lambda x: NOT contains(lower(answer), lower(x))) AS gone FROM (SELECT *, {_ANSWER} AS answer FROM {_EXPECTED} WHERE kind IS NOT NULL))""",
)
def answer_completeness_check(spark, sf_dir):
    k = F.col("query_id")
    s = k.cast("string")
    answer = F.when(k % 5 == 0, "").when(k % 5 == 1, "1. 매출\n2. B의 값\n3) x").when(k % 5 == 2, F.concat(F.lit("- 비용\n- 이익"), s, F.lit("을"))).when(k % 5 == 3, "**매출**: 1 **비용**: 2").otherwise(F.concat(F.lit("one\ntwo\nthree a"), s))
    own = asked(spark, sf_dir).withColumn("p", Q.expected_parts(F.col("text"))).where("p IS NOT NULL").withColumn("answer", answer)
    checked = own.withColumn("c", Q.completeness_check(F.col("text"), F.col("answer"), F.col("p")))
    return checked.select("query_id", "c.complete", F.array_join("c.missing", "|").alias("missing"), F.col("c.query").alias("again"))


def _has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


_MORE = "list_concat(" + ", ".join(f"CASE WHEN contains(text, '{w}') THEN list_filter([{', '.join(map(q, m.split()))}], lambda t: NOT contains(lower(text), t)) ELSE [] END" for w, m in Q.PLAIN_WORDS.items()) + ")"
_LOOSE = f"({_has('text', Q.INFORMAL)} OR {_has('lower(text)', Q.INFORMAL_EN)})"


@query("colloquial_expansion", f"SELECT query_id, {_LOOSE} AS colloquial, CASE WHEN {_LOOSE} AND len({_MORE}) > 0 THEN text || ' ' || array_to_string({_MORE}, ' ') ELSE text END AS expanded FROM {ASKED}")
def colloquial_expansion(spark, sf_dir):
    t = F.col("text")
    return asked(spark, sf_dir).select("query_id", Q.is_colloquial(t).alias("colloquial"), Q.expanded(t).alias("expanded"))


_DOMAIN = "CASE query_id % 4 WHEN 0 THEN 'legal' WHEN 1 THEN 'financial' WHEN 2 THEN 'support' ELSE 'general' END"
_LEVEL = "CASE query_id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'complex' END"
_TYPE = "CASE query_id % 5 WHEN 0 THEN 'aggregation' WHEN 1 THEN 'comparative' WHEN 2 THEN 'procedural' ELSE 'factual' END"
_SIGNALS = f"""(SELECT *, CASE intent WHEN 'comparative' THEN 'table' WHEN 'procedural' THEN 'step_by_step' WHEN 'aggregation' THEN 'list' ELSE 'prose' END AS output_format, CAST(CASE WHEN intent = 'aggregation' THEN 2.5 WHEN intent = 'comparative' THEN 2.0 WHEN intent IN ('temporal', 'verification') THEN 1.5 ELSE 1.0 END AS DOUBLE) AS top_k_multiplier,
    intent = 'aggregation' AS force_map_reduce, intent = 'comparative' AS force_sibling_expansion, domain = 'legal' AS prefer_bm25, domain = 'legal' OR level = 'simple' AS skip_compression, level = 'simple' AS skip_rerank,
    CAST(CASE domain WHEN 'legal' THEN 0.2 WHEN 'financial' THEN 0.3 WHEN 'support' THEN 0.2 END AS DOUBLE) AS w_original, CAST(CASE domain WHEN 'legal' THEN 0.2 WHEN 'financial' THEN 0.3 WHEN 'support' THEN 0.6 END AS DOUBLE) AS w_hype, CAST(CASE domain WHEN 'legal' THEN 0.6 WHEN 'financial' THEN 0.4 WHEN 'support' THEN 0.2 END AS DOUBLE) AS w_bm25
    FROM (SELECT query_id, {_DOMAIN} AS domain, {_LEVEL} AS level, CASE WHEN {_m(Q.VERIFYING)} THEN 'verification' WHEN {_m(Q.WHEN_ASKED)} THEN 'temporal' ELSE {_TYPE} END AS intent, {_m(Q.CALCULATING)} AS requires_calculation FROM {ASKED}))"""


def signals(spark, sf_dir):
    k, t = F.col("query_id"), F.col("text")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    own = asked(spark, sf_dir).select("query_id", pick(4, "legal", "financial", "support", "general").alias("domain"), pick(3, "simple", "medium", "complex").alias("level"), Q.intent(pick(5, "aggregation", "comparative", "procedural", "factual", "factual"), t).alias("intent"), Q.requires_calculation(t).alias("requires_calculation"))
    return own.withColumns({"output_format": Q.output_format(F.col("intent"))} | Q.hints(F.col("intent"), F.col("domain"), F.col("level")))


@query("query_signals", f"SELECT * FROM {_SIGNALS}")
def query_signals(spark, sf_dir):
    return signals(spark, sf_dir)


_FOLD = lambda c, w: f"round(coalesce(CASE WHEN len({c}) > 0 THEN list_reduce({c}, lambda a, x: (a + x) / 2) END, {w}), 6) AS {c}"


@query(
    "hint_merge",
    f"""SELECT session, top_k_multiplier, force_map_reduce, force_sibling_expansion, prefer_bm25, skip_compression, skip_rerank, {_FOLD("w_original", 0.4)}, {_FOLD("w_hype", 0.35)}, {_FOLD("w_bm25", 0.25)}
        FROM (SELECT query_id // 7 AS session, max(top_k_multiplier) AS top_k_multiplier, {", ".join(f"bool_or({c}) AS {c}" for c in Q.FLAGS)}, {", ".join(f"list({c} ORDER BY query_id) FILTER ({c} IS NOT NULL) AS {c}" for c in ("w_original", "w_hype", "w_bm25"))} FROM {_SIGNALS} GROUP BY 1)""",
)
def hint_merge(spark, sf_dir):
    return Q.merged_hints(signals(spark, sf_dir).withColumn("session", F.floor(F.col("query_id") / 7)), "session", "query_id")
