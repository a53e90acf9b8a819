"""Facts in text: extraction by rules, search terms, entity index, look-ups, and facts as context of an answer.

A fact is a struct of FIELDS; what its kind does not have is null. Null texts have no facts. The severity and the status of a
text are the first ones named, and go with all ids in it. Numbers have 18 digits and names 40 letters at most, which keeps patterns linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

FIELDS = "type entity severity status action_date customer tier deployment metric item value team headcount leader version release_date".split()
FACT = ", ".join(f"{c}: string" for c in FIELDS) + ", inventors: array<string>, severities: array<string>"
FACTS = f"array<struct<{FACT}>>"
METRIC = r"(매출|ARR|비용|예산|투자|런웨이|소진율|현금|파이프라인|인건비|인프라|마케팅)\s*[:：]?\s*(?:약\s*)?([0-9]{1,18}(?:\.[0-9]{1,18})?)\s*(억|천만|백만|만|개월)?\s*(?:원)?"
FUND_SECTION = r"(?:자금|투자금?|예산)\s*(?:용도|사용|배분|활용|계획)"
FUND_ITEM = r"[-·•]\s*([^\n]{2,20}?)\s*[:：]\s*([0-9]{1,18}(?:\.[0-9]{1,18})?)\s*(억|천만|백만|만)\s*(?:원)?"
TEAM = r"([\p{L}\p{N}_]{1,40}팀)\s*[:：|]?\s*(?:[^\n]*?인원\s*[:：]?\s*)?([0-9]{1,18})\s*명"
LEADER = r"([\p{L}\p{N}_]{1,40}팀)\s*[^\n]*?팀장\s*[:：]?\s*([\p{L}\p{N}_]{2,4})"
RELEASE = r"v?([0-9]{1,18}\.[0-9]{1,18}(?:\.[0-9]{1,18})?)\s*\(([0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2})\)"
INVENTORS = r"발명자\s*[:：]?\s*([\p{L}\p{N}_, \t]+?)(?:\n|$)"
PATENT_STATUS = r"(등록\s*완료|출원\s*완료|출원\s*중|PCT\s*완료|심사\s*중)"
CUSTOMER = r"([\p{L}\p{N}_]{1,40}(?:전자|은행|클라우드|자동차|법무법인\s*[\p{L}\p{N}_]{1,40}|대학교?))\s*[^\n]*?(Enterprise|Pro|Basic|Free)\s*[^\n]*?(온프레미스|클라우드|하이브리드)?"
#: words without which a pattern that begins with a run of letters is not tried
_CUSTOMERS = "전자|은행|클라우드|자동차|법무법인|대학"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _fact(type_: str, **own: Column) -> Column:
    fields = [(F.lit(type_) if c == "type" else own[c].cast("string") if c in own else F.lit(None).cast("string")).alias(c) for c in FIELDS]
    fields += [(own[c] if c in own else F.lit(None)).cast("array<string>").alias(c) for c in ("inventors", "severities")]
    return F.struct(*fields)


def _each(text: Column, pattern: str, groups: int, make) -> Column:
    """A fact of each match; make gets its groups, null where empty."""
    parts = F.arrays_zip(*(_all(text, pattern, g).alias(f"g{g}") for g in range(1, groups + 1)))
    return F.transform(parts, lambda x: make(*(F.nullif(x[f"g{g}"], F.lit("")) for g in range(1, groups + 1))))


def severity_of(word: Column) -> Column:
    """A level of rules.LEVELS for a word in either language."""
    out = F.lit(None).cast("string")
    for w, level in rules.SEVERITY.items():
        out = F.when(F.lower(word) == w, level).otherwise(out)
    return out


def text_domains(text: Column) -> Column:
    """Kinds of facts a text can hold, in a fixed order; it can be several."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in rules.FACT_DOMAINS.items())), lambda x: x.isNotNull())


def facts_of(text: Column) -> Column:
    """All facts of a text, kind after kind."""
    none = F.array().cast(FACTS)
    severities = F.array_distinct(F.transform(_all(text, rules.SEVERITY_WORD), severity_of))
    issues = _all(text, "(SEC-[0-9]{3})")
    status, day = _first(text, rules.STATUS_STATED, 2), _first(text, rules.STATUS_STATED, 1)
    issue = lambda i: _fact("security_issue", entity=i, severity=F.get(severities, F.lit(0)), status=F.regexp_replace(status, " ", ""), action_date=day)
    summary = F.when(F.size(severities) > 0, F.array(_fact("security_summary", severities=severities))).otherwise(none)
    names = F.filter(F.transform(F.split(_first(text, INVENTORS), ","), lambda x: F.trim(x)), lambda x: x != "")
    found = {
        "security": F.when(F.size(issues) > 0, F.transform(issues, issue)).otherwise(summary),
        "finance": F.concat(
            _each(text, METRIC, 3, lambda m, v, u: _fact("finance_metric", metric=m, value=F.concat(v, F.coalesce(u, F.lit(""))))),
            F.when(text.rlike(FUND_SECTION), _each(text, FUND_ITEM, 3, lambda i, v, u: _fact("fund_allocation", item=F.trim(i), value=F.concat(v, u)))).otherwise(none),
        ),
        "hr": F.when(
            text.contains("팀"),
            F.concat(_each(text, TEAM, 2, lambda t, n: _fact("team_info", team=t, headcount=n.cast("int"))), _each(text, LEADER, 2, lambda t, x: _fact("team_leader", team=t, leader=x))),
        ).otherwise(none),
        "product": _each(text, RELEASE, 2, lambda v, d: _fact("product_version", version=F.concat(F.lit("v"), v), release_date=d)),
        "patent": F.transform(_all(text, "(PAT-[0-9]{3})"), lambda i: _fact("patent", entity=i, inventors=names, status=F.regexp_replace(_first(text, PATENT_STATUS), " ", ""))),
        "contract": F.when(text.rlike(_CUSTOMERS), _each(text, CUSTOMER, 3, lambda c, t, d: _fact("customer_contract", customer=c, tier=t, deployment=d))).otherwise(none),
    }
    parts = [F.when(text.rlike(rules.FACT_DOMAINS[d]), x.cast(FACTS)).otherwise(none) for d, x in found.items()]
    return F.concat(*parts)


def extracted_facts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, position, and FIELDS, inventors, severities): a row for each fact; position is that in its text."""
    return chunks.select("chunk_id", F.posexplode(facts_of(F.col("text"))).alias("position", "fact")).select("chunk_id", "position", "fact.*")


def fact_name(fact) -> Column:
    """What a fact is about: entity, else customer, else team; null for the others."""
    return F.coalesce(fact["entity"], fact["customer"], fact["team"])


def fact_terms(fact) -> Column:
    """Phrases that a fact adds to the keyword index, as an array; fact: a struct, or a row's columns by name."""
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    f = {c: fact[c] for c in (*FIELDS, "inventors")}
    of = {
        "security_issue": [say(f["entity"], " 보안 이슈"), say(f["severity"], " 보안 이슈"), say(f["severity"], " 등급 보안"), say(f["status"], " 보안 이슈"), say("조치 ", f["status"])],
        "patent": [say(f["entity"], " 특허"), say(f["status"], " 특허")],
        "customer_contract": [say(f["customer"], " ", f["tier"], " 고객"), say(f["deployment"], " 배포 고객")],
        "product_version": [say(f["version"], " 릴리스")],
        "fund_allocation": [say(f["item"], " ", f["value"], "원"), say("투자금 사용 용도 ", f["item"]), say("자금 용도 ", f["item"])],
    }
    out = F.array().cast("array<string>")
    for kind, parts in of.items():
        out = F.when(f["type"] == kind, F.array_compact(F.array(*parts))).otherwise(out)
    people = F.transform(F.coalesce(f["inventors"], F.array().cast("array<string>")), lambda x: say(x, " 발명 특허"))
    return F.when(f["type"] == "patent", F.concat(out, people)).otherwise(out)


def derived_date_terms(day: Column) -> Column:
    """Terms by which a date is searched: year, half, quarter, month."""
    y, m = F.year(day).cast("string"), F.month(day)
    return F.array(y, F.concat(y, F.when(m <= 6, "-H1").otherwise("-H2")), F.concat(y, F.lit("-Q"), F.quarter(day).cast("string")), F.date_format(day, "yyyy-MM"))


DATE = r"([0-9]{4})[.-/]([0-9]{1,2})[.-/]([0-9]{1,2})".replace("[.-/]", "[./-]")
MONTH = r"([0-9]{4})년\s*([0-9]{1,2})월"
AMOUNT = r"([0-9]{1,18}(?:\.[0-9]{1,18})?)\s*(억|천만|백만|만)\s*(?:원|달러|엔)?"
VERSION = r"v?([0-9]{1,18})\.([0-9]{1,18})(?:\.([0-9]{1,18}))?"


def severity_terms(text: Column) -> Column:
    """For each level named: that it is among all lower ones "or above"."""
    found = F.array_distinct(F.transform(_all(text, rules.SEVERITY_WORD), severity_of))
    out = []
    for i, level in enumerate(rules.LEVELS):
        lower = [f"{word} {tail}" for name in reversed(rules.LEVELS[i + 1 :]) for word in (rules.LEVELS_KO[name], name) for tail in ("이상", "등급 이상")]
        out.append(F.when(F.array_contains(found, level), F.array(*map(F.lit, lower))).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*reversed(out)))


def date_terms(text: Column) -> Column:
    """For each month named: half, quarter (in two forms) and month."""
    pair = lambda p: F.transform(F.arrays_zip(_all(text, p, 1).alias("y"), _all(text, p, 2).alias("m")), lambda x: F.struct(x["y"].cast("int").alias("y"), x["m"].cast("int").alias("m")))
    months = F.array_distinct(F.concat(pair(DATE), pair(MONTH)))

    def terms(x):
        y, m = x["y"].cast("string"), x["m"]
        quarter = F.concat(F.lit("Q"), (F.floor((m - 1) / 3) + 1).cast("string"))
        half = F.when(m <= 6, "상반기").otherwise("하반기")
        return F.array(F.concat(y, F.lit("년 "), half), F.concat(quarter, F.lit(" "), y), F.concat(y, F.lit("년 "), quarter), F.concat(m.cast("string"), F.lit("월")))

    return F.flatten(F.transform(months, terms))


def amount_terms(text: Column) -> Column:
    """For each amount: about how many hundred millions, or its unit."""
    found = F.arrays_zip(_all(text, AMOUNT, 1).alias("v"), _all(text, AMOUNT, 2).alias("u"))

    def terms(x):
        about = F.bround(x["v"].cast("double"), 0).cast("long").cast("string")
        return F.when(x["u"] == "억", F.array(F.concat(F.lit("약 "), about, F.lit("억")), F.lit("억 단위"), F.concat(about, F.lit("억원대")))).otherwise(F.array(F.concat(x["u"], F.lit("원 단위"))))

    return F.flatten(F.transform(found, terms))


def status_terms(text: Column) -> Column:
    """Synonyms of each status stated."""
    synonyms = F.create_map(*(x for k, v in rules.STATUS_SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(_all(text, rules.STATUS_STATED, 2), lambda s: F.coalesce(F.try_element_at(synonyms, s), none)))


def version_terms(text: Column) -> Column:
    """Major and minor of each version in two forms."""
    found = F.array_distinct(F.transform(F.arrays_zip(_all(text, VERSION, 1).alias("a"), _all(text, VERSION, 2).alias("b")), lambda x: F.concat(x["a"], F.lit("."), x["b"])))
    return F.flatten(F.transform(found, lambda v: F.array(F.concat(F.lit("v"), v), F.concat(v, F.lit(" 버전")))))


def derived_terms(text: Column) -> Column:
    """All terms by which what a text says can be asked for, each once, in order."""
    return F.array_distinct(F.concat(severity_terms(text), date_terms(text), amount_terms(text), status_terms(text), version_terms(text)))


def contextual_text(prefix: Column, text: Column) -> Column:
    """What the keyword index reads of a chunk: prefix, text, derived terms, phrases of its facts; parts that are empty are left out."""
    said = F.flatten(F.transform(facts_of(text), fact_terms))
    parts = [prefix, text, F.array_join(derived_terms(text), " "), F.array_join(said, " ")]
    return F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts))


def entity_index(facts: DataFrame) -> DataFrame:
    """(key, chunk_id), distinct; see `entity_keys`."""
    return entity_keys(facts).distinct()


def entity_keys(facts: DataFrame) -> DataFrame:
    """(key, chunk_id), a row for each key of each fact: ids in capitals, type:, severity:, status:, tier:, deployment: (without blanks), person:, customer:,
    fund_item:, and severity_gte: for the fact's level and all below. facts: chunk_id and any of a fact's columns."""
    has = lambda c: F.col(c) if c in facts.columns else F.lit(None).cast("string")
    tag = lambda name, c: F.concat(F.lit(f"{name}:"), c)
    tight = lambda c: F.regexp_replace(has(c), " ", "")
    levels = F.array(*map(F.lit, rules.LEVELS))
    level = F.array_position(F.transform(levels, F.lower), F.lower(has("severity")))
    at_least = F.transform(F.filter(levels, lambda x, i: (level > 0) & (i + 1 >= level)), lambda x: tag("severity_gte", x))
    typed = F.when(has("entity").isNotNull() | (has("type") == "fund_allocation"), tag("type", has("type")))
    keys = [F.upper(has("entity")), typed, *(tag(c, tight(c)) for c in ("severity", "status", "tier", "deployment")), tag("customer", has("customer")), tag("fund_item", has("item")), tag("resolution", has("resolution"))]
    people = F.transform(F.col("inventors"), lambda x: tag("person", x)) if "inventors" in facts.columns else F.lit(None)
    none = F.array().cast("array<string>")
    both = F.concat(F.array_compact(F.array(*keys)), F.coalesce(at_least, none), F.coalesce(people.cast("array<string>"), none))
    return facts.select(F.explode(F.array_distinct(both)).alias("key"), "chunk_id")


ASKED_STATUS = r"(?:조치\s*)?(완료|미조치|미해결|진행\s*중|보류)"
ASKED_LEVEL = r"((?i:Critical|High|Low|Medium)|낮음|높음|심각|중간)\s*(?:등급\s*)?이상"
ASKED_FUNDS = r"(?:투자금?|자금|예산)\s*[^\n]{0,10}(?:용도|사용|배분|활용)"
ASKED_DOMAIN = {
    "security": r"(?i)보안\s*(?:감사|사항|이슈|취약점)|SEC-",
    "patent": "(?i)PAT-|발명|출원|특허",
    "product": "(?i)v[0-9]{1,18}|릴리스|변경|버전",
    "contract": "(?i)Enterprise|PoC|계약|고객",
}


def asked_entities(text: Column) -> Column:
    """Index keys that a question names: ids and versions, a least severity, a status, the use of funds."""
    ids = F.transform(_all(text, r"(?i)(PAT-[0-9]{3}|SEC-[0-9]{3}|v[0-9]{1,18}\.[0-9]{1,18})"), F.upper)
    status = F.regexp_replace(_first(text, ASKED_STATUS), r"\s", "")
    status = F.when(status == "미해결", "미조치").otherwise(status)
    extra = F.array(
        F.concat(F.lit("severity_gte:"), severity_of(F.regexp_extract(text, ASKED_LEVEL, 1))),
        F.concat(F.lit("status:"), status),
        F.when(text.rlike(ASKED_FUNDS), "type:fund_allocation"),
    )
    return F.array_distinct(F.concat(ids, F.array_compact(extra)))


def asked_domain(text: Column) -> Column:
    """The first domain of facts that a question points to; null if none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(ASKED_DOMAIN.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


CRITERIA_AT_ONCE = 20_000


def combined_lookup(index: DataFrame, criteria: DataFrame, union: bool = False) -> DataFrame:
    """(query_id, chunk_id) of chunks that meet all criteria (query_id, key) of a query; criteria without any match are left out.

    union: one criterion is enough. A query has 63 criteria at most (checked by the sum of bits: more raise an overflow).
    A criterion is a bit, so that hot keys are combined before the shuffle. Up to CRITERIA_AT_ONCE criteria are broadcast: the index is not moved to meet
    them then, and one that comes in partitions by chunk_id (an alias or hash of it) is not moved at all.
    """
    distinct = criteria.distinct()
    numbered = distinct.groupBy("query_id").agg(F.sort_array(F.collect_list("key")).alias("keys")).select("query_id", F.posexplode("keys").alias("bit", "key"))
    numbered = numbered.withColumn("mask", F.when(F.col("bit") < 63, F.expr("shiftleft(1L, bit)")).otherwise(F.raise_error(F.lit("more than 63 criteria"))))
    rows = numbered.limit(CRITERIA_AT_ONCE + 1).collect()
    few = len(rows) <= CRITERIA_AT_ONCE
    small = F.broadcast if few else lambda df: df
    if few:
        numbered = index.sparkSession.createDataFrame(rows, numbered.schema)
    found = index.join(small(numbered), "key").groupBy("query_id", "chunk_id").agg(F.bit_or("mask").alias("met"))
    if union:
        return found.select("query_id", "chunk_id")
    asked = found.groupBy("query_id").agg(F.bit_or("met").alias("asked"))
    return found.join(small(asked), "query_id").where("met = asked").select("query_id", "chunk_id")


def injected(hits: DataFrame, found: DataFrame, score: float = 0.8) -> DataFrame:
    """Hits (query_id, chunk_id, score) with looked-up chunks: new ones at `score`, present ones at that at least."""
    both = hits.join(found.withColumn("hit", F.lit(True)), ["query_id", "chunk_id"], "full_outer")
    raised = F.when(F.col("hit"), F.greatest(F.coalesce("score", F.lit(score)), F.lit(score))).otherwise(F.col("score"))
    return both.select("query_id", "chunk_id", raised.alias("score"))


def fact_query(facts: DataFrame, type_: str, **equal: str) -> DataFrame:
    """Facts of a kind whose columns have the given values."""
    out = facts.where(F.col("type") == type_)
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out


def fact_line(fact, inline: bool = False) -> Column:
    """A fact as a line of context; inline: in the form that stands beside a chunk's text."""
    f = {c: fact[c] for c in (*FIELDS, "inventors", "severities")}
    na = lambda c: F.coalesce(c, F.lit("N/A"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    deployed = F.when(f["deployment"].isNotNull(), say(" | 배포: ", f["deployment"])).otherwise("")
    inventors = F.coalesce(F.nullif(F.array_join(f["inventors"], ", "), F.lit("")), F.lit("N/A"))
    lines = {
        "customer_contract": say("고객: ", na(f["customer"]), " | 등급: ", na(f["tier"]), deployed),
        "finance_metric": say(na(f["metric"]), ": ", na(f["value"])),
        "fund_allocation": say(na(f["item"]), ": ", na(f["value"]), "원 (자금 용도)" if inline else "원"),
        "security_issue": say(na(f["entity"]), ": 심각도=", na(f["severity"]), ", 상태=", na(f["status"])),
        "team_info": say(na(f["team"]), ": ", na(f["headcount"]), "명"),
        "team_leader": say(na(f["team"]), " 팀장: ", na(f["leader"])),
        "patent": say(na(f["entity"]), ": 상태=", na(f["status"]), *((", 발명자=", inventors) if inline else ())),
        "product_version": say(na(f["version"]), " (", na(f["release_date"]), ")"),
        "security_summary": say("보안 심각도: ", F.array_join(f["severities"], ", ")),
    }
    out = F.lit(None).cast("string")
    for kind, line in lines.items():
        out = F.when(f["type"] == kind, line).otherwise(out)
    return F.concat(F.lit("  - " if inline else "  | "), out)


#: the first of these domains that a question belongs to gives its block of facts: kinds and label
BLOCKS = {
    "contract": (("customer_contract",), "검증된 고객 데이터 (전체 목록)"),
    "finance": (("finance_metric", "fund_allocation"), "검증된 재무 데이터"),
    "security": (("security_issue",), "검증된 보안 이슈 데이터"),
    "hr": (("team_info", "team_leader"), "검증된 조직 데이터"),
}


LINES = 1000


def fact_blocks(facts: DataFrame, lines: int = LINES) -> DataFrame:
    """(domain, text): facts of each domain as one block, by kind, chunk and position; `lines` of them at most, for it goes into one prompt."""
    rows = []
    for domain, (kinds, label) in BLOCKS.items():
        kind = F.array_position(F.array(*map(F.lit, kinds)), F.col("type"))
        rows.append(facts.where(F.col("type").isin(*kinds)).select(F.lit(domain).alias("domain"), F.lit(f"[{label}]").alias("label"), kind.alias("kind"), "chunk_id", "position", fact_line(facts).alias("line")).orderBy("kind", "chunk_id", "position").limit(lines))
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    text = F.transform(F.sort_array(F.collect_list(F.struct("kind", "chunk_id", "position", "line"))), lambda x: x["line"])
    return both.groupBy("domain", "label").agg(text.alias("lines")).select("domain", F.concat_ws("\n", "label", F.array_join("lines", "\n")).alias("text"))


def with_fact_block(hits: DataFrame, queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Hits (query_id, chunk_id, text, score) with the block of the query's first domain in front, at 1.1 times the best score.

    queries: (query_id, text); chunk_id of a block is "facts". Queries without hits, or without a domain that has facts, get none.
    """
    domains = text_domains(F.col("text"))
    order = F.array(*map(F.lit, BLOCKS))
    first = F.get(F.filter(order, lambda d: F.array_contains(domains, d)), F.lit(0))
    asked = queries.select("query_id", first.alias("domain")).join(blocks.withColumnRenamed("text", "block"), "domain")
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    added = asked.join(best, "query_id").select("query_id", F.lit("facts").alias("chunk_id"), F.col("block").alias("text"), F.round(F.col("best") * 1.1, 8).alias("score"))
    return hits.select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), "text", "score").unionByName(added)
