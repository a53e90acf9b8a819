"""Queries on facts: briefs made of orders (invented notes in two languages) are what facts are extracted from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import facts
from .tables import read
from .texts import q, query

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_SEVERITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN '높음' WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'low' ELSE '낮음' END"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN '완료' WHEN 'O' THEN '미조치' ELSE '진행 중' END"
BRIEFS = f"""(SELECT o_orderkey AS chunk_id, o_custkey AS doc_id, concat_ws(chr(10),
    CASE WHEN o_orderkey % 2 = 0 THEN '[SEC-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '] ' || {_SEVERITY} || ' 취약점, 조치 상태: ' || CASE WHEN o_orderkey % 4 = 0 THEN {_DAY} || ' ' ELSE '' END || {_STATUS} END,
    CASE WHEN o_orderkey % 3 = 0 THEN '매출: ' || CAST(o_custkey % 90 + 10 AS VARCHAR) || '억원, 비용 약 ' || CAST(o_orderkey % 9 + 1 AS VARCHAR) || '.5만' END,
    CASE WHEN o_orderkey % 5 = 0 THEN '자금 용도' || chr(10) || '- 인프라 확충: ' || CAST(o_custkey % 50 + 1 AS VARCHAR) || '억원' || chr(10) || '- 채용: 3.5억' END,
    CASE WHEN o_orderkey % 7 = 0 THEN '개발팀 인원: ' || CAST(o_custkey % 20 + 2 AS VARCHAR) || '명, 개발팀 팀장: 김하나' END,
    CASE WHEN o_orderkey % 4 = 1 THEN 'v' || CAST(o_custkey % 4 AS VARCHAR) || '.' || CAST(o_orderkey % 10 AS VARCHAR) || ' (' || {_DAY} || ') 릴리스' END,
    CASE WHEN o_orderkey % 11 = 0 THEN '[PAT-' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '] 발명자: 김하나, 이둘' || chr(10) || '출원 완료' END,
    CASE WHEN o_orderkey % 6 = 1 THEN '한빛은행 계약 ' || CASE WHEN o_custkey % 2 = 0 THEN 'Enterprise' ELSE 'Pro' END || ' 등급, 온프레미스' END,
    'order ' || CAST(o_orderkey AS VARCHAR)) AS text FROM orders)"""


def briefs(spark, sf_dir):
    """(chunk_id, doc_id, text): a note on each order."""
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "Critical").when(p == "2-HIGH", "높음").when(p == "3-MEDIUM", "Medium").when(p == "5-LOW", "low").otherwise("낮음")
    status = F.when(F.col("o_orderstatus") == "F", "완료").when(F.col("o_orderstatus") == "O", "미조치").otherwise("진행 중")
    text = F.concat_ws(
        "\n",
        F.when(k % 2 == 0, say("[SEC-", F.lpad((k % 1000).cast("string"), 3, "0"), "] ", severity, " 취약점, 조치 상태: ", F.when(k % 4 == 0, F.concat(day, F.lit(" "))).otherwise(""), status)),
        F.when(k % 3 == 0, say("매출: ", c % 90 + 10, "억원, 비용 약 ", k % 9 + 1, ".5만")),
        F.when(k % 5 == 0, say("자금 용도\n- 인프라 확충: ", c % 50 + 1, "억원\n- 채용: 3.5억")),
        F.when(k % 7 == 0, say("개발팀 인원: ", c % 20 + 2, "명, 개발팀 팀장: 김하나")),
        F.when(k % 4 == 1, say("v", c % 4, ".", k % 10, " (", day, ") 릴리스")),
        F.when(k % 11 == 0, say("[PAT-", F.lpad((c % 1000).cast("string"), 3, "0"), "] 발명자: 김하나, 이둘\n출원 완료")),
        F.when(k % 6 == 1, say("한빛은행 계약 ", F.when(c % 2 == 0, "Enterprise").otherwise("Pro"), " 등급, 온프레미스")),
        say("order ", k),
    )
    return read(spark, sf_dir, "orders").select(k.alias("chunk_id"), c.alias("doc_id"), text.alias("text"))


def _all(pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all(text, {q(pattern)}, {group})"


def _first(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(text, {q(pattern)}, {group}), '')"


def _level(x: str) -> str:
    return f"CASE lower({x}) " + " ".join(f"WHEN '{w}' THEN '{level}'" for w, level in rules.SEVERITY.items()) + " END"


def _in(domain: str) -> str:
    return f"regexp_matches(text, {q(rules.FACT_DOMAINS[domain])})"


_LEVELS = f"list_transform({_all(rules.SEVERITY_WORD)}, lambda x: {_level('x')})"
_OPEN = f"replace({_first(rules.STATUS_STATED, 2)}, ' ', '')"
_PEOPLE = f"array_to_string(list_filter(list_transform(string_split({_first(facts.INVENTORS)}, ','), lambda x: trim(x)), lambda x: x <> ''), ', ')"
#: type, entity or name, and what else there is of a fact
FACTS_SQL = f"""(
    SELECT chunk_id, 'security_issue' AS type, unnest({_all("(SEC-[0-9]{3})")}) AS name, concat_ws('|', {_LEVELS}[1], {_OPEN}, {_first(rules.STATUS_STATED, 1)}) AS detail FROM {BRIEFS} WHERE {_in("security")}
    UNION ALL SELECT chunk_id, 'security_summary', NULL, array_to_string(list_distinct({_LEVELS}), ', ') FROM {BRIEFS} WHERE {_in("security")} AND len({_all("(SEC-[0-9]{3})")}) = 0 AND len({_LEVELS}) > 0
    UNION ALL SELECT chunk_id, 'finance_metric', NULL, concat_ws('|', unnest({_all(facts.METRIC, 1)}), unnest({_all(facts.METRIC, 2)}) || unnest({_all(facts.METRIC, 3)})) FROM {BRIEFS} WHERE {_in("finance")}
    UNION ALL SELECT chunk_id, 'fund_allocation', NULL, concat_ws('|', trim(unnest({_all(facts.FUND_ITEM, 1)})), unnest({_all(facts.FUND_ITEM, 2)}) || unnest({_all(facts.FUND_ITEM, 3)})) FROM {BRIEFS} WHERE {_in("finance")} AND regexp_matches(text, {q(facts.FUND_SECTION)})
    UNION ALL SELECT chunk_id, 'team_info', unnest({_all(facts.TEAM, 1)}), unnest({_all(facts.TEAM, 2)}) FROM {BRIEFS} WHERE {_in("hr")}
    UNION ALL SELECT chunk_id, 'team_leader', unnest({_all(facts.LEADER, 1)}), unnest({_all(facts.LEADER, 2)}) FROM {BRIEFS} WHERE {_in("hr")}
    UNION ALL SELECT chunk_id, 'product_version', NULL, concat_ws('|', 'v' || unnest({_all(facts.RELEASE, 1)}), unnest({_all(facts.RELEASE, 2)})) FROM {BRIEFS} WHERE {_in("product")}
    UNION ALL SELECT chunk_id, 'patent', unnest({_all("(PAT-[0-9]{3})")}), concat_ws('|', replace({_first(facts.PATENT_STATUS)}, ' ', ''), {_PEOPLE}) FROM {BRIEFS} WHERE {_in("patent")}
    UNION ALL SELECT chunk_id, 'customer_contract', unnest({_all(facts.CUSTOMER, 1)}), concat_ws('|', unnest({_all(facts.CUSTOMER, 2)}), nullif(unnest({_all(facts.CUSTOMER, 3)}), '')) FROM {BRIEFS} WHERE {_in("contract")})"""


def extracted(spark, sf_dir):
    return facts.extracted_facts(briefs(spark, sf_dir))


@query("fact_extraction", f"SELECT * FROM {FACTS_SQL}")
def fact_extraction(spark, sf_dir):
    f = extracted(spark, sf_dir)
    detail = F.concat_ws("|", "severity", "status", "action_date", "tier", "deployment", "metric", "item", "value", "headcount", "leader", "version", "release_date", F.nullif(F.array_join("inventors", ", "), F.lit("")), F.nullif(F.array_join("severities", ", "), F.lit("")))
    return f.select("chunk_id", "type", facts.fact_name(f).alias("name"), detail.alias("detail"))


@query("fact_domains", f"SELECT chunk_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {_in(d)} THEN {q(d)} END' for d in rules.FACT_DOMAINS)}], lambda x: x IS NOT NULL), ' ') AS domains FROM {BRIEFS}")
def fact_domains(spark, sf_dir):
    return briefs(spark, sf_dir).select("chunk_id", F.array_join(facts.text_domains(F.col("text")), " ").alias("domains"))


@query(
    "fact_search_terms",
    f"""SELECT chunk_id, type, name, CASE type WHEN 'security_issue' THEN concat_ws(', ', name || ' 보안 이슈', a || ' 보안 이슈', a || ' 등급 보안', b || ' 보안 이슈', '조치 ' || b) WHEN 'patent' THEN concat_ws(', ', name || ' 특허', a || ' 특허', '김하나 발명 특허', '이둘 발명 특허')
        WHEN 'customer_contract' THEN concat_ws(', ', name || ' ' || a || ' 고객', b || ' 배포 고객') WHEN 'product_version' THEN a || ' 릴리스' WHEN 'fund_allocation' THEN concat_ws(', ', a || ' ' || b || '원', '투자금 사용 용도 ' || a, '자금 용도 ' || a) ELSE '' END AS terms
        FROM (SELECT chunk_id, type, name, nullif(split_part(detail, '|', 1), '') AS a, nullif(split_part(detail, '|', 2), '') AS b FROM {FACTS_SQL})""",
)
def fact_search_terms(spark, sf_dir):
    f = extracted(spark, sf_dir)
    return f.select("chunk_id", "type", facts.fact_name(f).alias("name"), F.array_join(facts.fact_terms(f), ", ").alias("terms"))


_MONTHS = f"list_distinct(list_concat(list_zip({_all(facts.DATE, 1)}, {_all(facts.DATE, 2)}), list_zip({_all(facts.MONTH, 1)}, {_all(facts.MONTH, 2)})))"
_DERIVED = f"""list_sort(list_distinct(list_concat(
    flatten(list_transform(list_distinct({_LEVELS}), lambda l: CASE l {" ".join(f"WHEN '{level}' THEN [{', '.join(f'{q(w + t)}' for n in rules.LEVELS[i + 1 :] for w in (rules.LEVELS_KO[n], n) for t in (' 이상', ' 등급 이상'))}]" for i, level in enumerate(rules.LEVELS))} END)),
    flatten(list_transform({_MONTHS}, lambda m: [m[1] || '년 ' || CASE WHEN CAST(m[2] AS INT) <= 6 THEN '상반기' ELSE '하반기' END, 'Q' || (CAST(m[2] AS INT) + 2) // 3 || ' ' || m[1], m[1] || '년 Q' || (CAST(m[2] AS INT) + 2) // 3, CAST(CAST(m[2] AS INT) AS VARCHAR) || '월'])),
    flatten(list_transform(list_zip({_all(facts.AMOUNT, 1)}, {_all(facts.AMOUNT, 2)}), lambda a: CASE WHEN a[2] = '억' THEN ['약 ' || CAST(round_even(CAST(a[1] AS DOUBLE), 0) AS BIGINT) || '억', '억 단위', CAST(round_even(CAST(a[1] AS DOUBLE), 0) AS BIGINT) || '억원대'] ELSE [a[2] || '원 단위'] END)),
    flatten(list_transform({_all(rules.STATUS_STATED, 2)}, lambda t: CASE t {" ".join(f"WHEN '{k}' THEN [{', '.join(map(q, v))}]" for k, v in rules.STATUS_SYNONYMS.items())} ELSE [] END)),
    flatten(list_transform(list_zip({_all(facts.VERSION, 1)}, {_all(facts.VERSION, 2)}), lambda v: ['v' || v[1] || '.' || v[2], v[1] || '.' || v[2] || ' 버전'])))))"""


@query("derived_terms", f"SELECT chunk_id, array_to_string({_DERIVED}, ', ') AS terms FROM {BRIEFS}")
def derived_terms(spark, sf_dir):
    return briefs(spark, sf_dir).select("chunk_id", F.array_join(F.sort_array(facts.derived_terms(F.col("text"))), ", ").alias("terms"))


@query(
    "fact_entity_index",
    f"""SELECT key, count(DISTINCT chunk_id) AS n FROM (SELECT chunk_id, unnest(list_filter(CASE type
        WHEN 'security_issue' THEN [name, 'type:' || type, 'severity:' || a, 'status:' || b] || list_transform(list_filter(['Critical', 'High', 'Medium', 'Low'], lambda x, i: i >= list_position(['Critical', 'High', 'Medium', 'Low'], a)), lambda x: 'severity_gte:' || x)
        WHEN 'patent' THEN [name, 'type:' || type, 'status:' || a, 'person:김하나', 'person:이둘'] WHEN 'customer_contract' THEN ['customer:' || name, 'tier:' || a, 'deployment:' || b] WHEN 'fund_allocation' THEN ['type:' || type, 'fund_item:' || a] ELSE [] END, lambda x: x IS NOT NULL)) AS key
        FROM (SELECT chunk_id, type, name, nullif(split_part(detail, '|', 1), '') AS a, nullif(split_part(detail, '|', 2), '') AS b FROM {FACTS_SQL})) GROUP BY key""",
)
def fact_entity_index(spark, sf_dir):
    return facts.entity_index(extracted(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("n"))


@query("fact_query_attributes", f"SELECT chunk_id, name, detail FROM {FACTS_SQL} WHERE type = 'customer_contract' AND split_part(detail, '|', 1) = 'Enterprise'")
def fact_query_attributes(spark, sf_dir):
    found = facts.fact_query(extracted(spark, sf_dir), "customer_contract", tier="Enterprise")
    return found.select("chunk_id", F.col("customer").alias("name"), F.concat_ws("|", "tier", "deployment").alias("detail"))


_LINE = """CASE type WHEN 'customer_contract' THEN '  | 고객: ' || name || ' | 등급: ' || a || coalesce(' | 배포: ' || b, '') WHEN 'security_issue' THEN '  | ' || name || ': 심각도=' || a || ', 상태=' || b
    WHEN 'team_info' THEN '  | ' || name || ': ' || a || '명' WHEN 'team_leader' THEN '  | ' || name || ' 팀장: ' || a END"""


@query(
    "fact_context_block",
    f"""SELECT domain, label || chr(10) || string_agg(line, chr(10) ORDER BY kind, chunk_id) AS text FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY kind, chunk_id) AS r FROM (
        SELECT chunk_id, {_LINE} AS line, CASE type WHEN 'customer_contract' THEN 'contract' WHEN 'security_issue' THEN 'security' ELSE 'hr' END AS domain, CASE type WHEN 'team_leader' THEN 2 ELSE 1 END AS kind,
        CASE type WHEN 'customer_contract' THEN '[검증된 고객 데이터 (전체 목록)]' WHEN 'security_issue' THEN '[검증된 보안 이슈 데이터]' ELSE '[검증된 조직 데이터]' END AS label
        FROM (SELECT chunk_id, type, name, nullif(split_part(detail, '|', 1), '') AS a, nullif(split_part(detail, '|', 2), '') AS b FROM {FACTS_SQL}) WHERE type IN ('customer_contract', 'security_issue', 'team_info', 'team_leader'))) WHERE r <= {facts.LINES} GROUP BY domain, label""",
)
def fact_context_block(spark, sf_dir):
    return facts.fact_blocks(extracted(spark, sf_dir)).where("domain <> 'finance'")


_QUESTIONS = "(SELECT o_orderkey, concat('v1.', o_orderkey % 10, ' ', CASE WHEN o_orderkey % 3 = 0 THEN 'sec-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ' ' ELSE '' END, CASE WHEN o_orderkey % 2 = 0 THEN '높음 등급 이상 ' ELSE '' END, CASE WHEN o_orderstatus = 'F' THEN '조치 완료된 보안 이슈는?' WHEN o_orderkey % 5 = 0 THEN '투자금 사용 용도는?' ELSE '미해결 특허 출원' END) AS text FROM orders)"


@query(
    "asked_entities",
    rf"""SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(text, '(?i)(PAT-[0-9]{{3}}|SEC-[0-9]{{3}}|v[0-9]+\.[0-9]+)', 1), lambda x: upper(x)),
        list_filter([CASE WHEN contains(text, '높음 등급 이상') THEN 'severity_gte:High' END, CASE WHEN contains(text, '조치 완료') THEN 'status:완료' WHEN contains(text, '미해결') THEN 'status:미조치' END, CASE WHEN contains(text, '투자금 사용') THEN 'type:fund_allocation' END], lambda x: x IS NOT NULL)))), ' ') AS keys,
        CASE WHEN contains(text, '보안 이슈') OR contains(text, 'sec-') THEN 'security' WHEN contains(text, '특허') THEN 'patent' ELSE 'product' END AS domain FROM {_QUESTIONS}""",
)
def asked_entities(spark, sf_dir):
    k = F.col("o_orderkey")
    part = lambda test, x: F.when(test, x).otherwise("")
    tail = F.when(F.col("o_orderstatus") == "F", "조치 완료된 보안 이슈는?").when(k % 5 == 0, "투자금 사용 용도는?").otherwise("미해결 특허 출원")
    text = F.concat(F.lit("v1."), (k % 10).cast("string"), F.lit(" "), part(k % 3 == 0, F.concat(F.lit("sec-"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" "))), part(k % 2 == 0, F.lit("높음 등급 이상 ")), tail)
    asked = read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return asked.select("o_orderkey", F.array_join(F.sort_array(facts.asked_entities(F.col("text"))), " ").alias("keys"), facts.asked_domain(F.col("text")).alias("domain"))
