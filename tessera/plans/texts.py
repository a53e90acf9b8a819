"""Queries over single texts: words, quality, profile, questions, HTML. Each has the SQL of the same result beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, profile, quality, questions, rules, text
from ..operators import chunks
from .tables import read, read_texts

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def q(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def words(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def blank_words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def hits(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def rlike(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


CODE_SQL = r"```|(?m)^\s{4,}(?:class |def |for |from |if |import )"
STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


def filtered(x: str) -> str:
    return f"list_distinct(list_filter({words(x)}, lambda w: NOT list_contains({STOP}, w) AND length(w) > 1))"


def starts_mid(x: str) -> str:
    return rf"({rlike(strip(x), chr(94) + chr(92) + 'p{Ll}')} OR {rlike(strip(x), text.CONJUNCTION)})"


def ends_well(x: str) -> str:
    return rlike(x, text.TERMINATOR)


def completeness_sql(x: str) -> str:
    n = f"len({blank_words(x)})"
    return f"""CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(0.1, round(1.0 - CASE WHEN {starts_mid(x)} THEN 0.3 ELSE 0.0 END - CASE WHEN {ends_well(x)} THEN 0.0 ELSE 0.15 END
        - CASE WHEN {n} < 20 THEN 0.2 WHEN {n} < 50 THEN 0.1 ELSE 0.0 END, 2)) END"""


@query(
    "filtered_token_sets",
    f"SELECT doc_id, CAST(len({filtered('text')}) AS INTEGER) AS n_tokens, array_to_string(list_sort({filtered('text')}), ' ') AS tokens FROM documents",
)
def filtered_token_sets(spark, sf_dir):
    own = text.filtered_tokens(F.col("text"))
    return read_texts(spark, sf_dir, "documents").select("doc_id", F.size(own).alias("n_tokens"), F.array_join(F.sort_array(own), " ").alias("tokens"))


@query(
    "text_measures",
    rf"""SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE round_even(len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) / len(w), 3) END AS numeric_density,
        CAST(len(w) + floor({hits("text", text.HANGUL)} * 0.7) AS INTEGER) AS token_estimate, length(text) > 0 AND {hits("text", text.HANGUL)} > 0.2 * length(text) AS korean,
        {rlike("text", text.TABLE)} AS has_table, {rlike("text", CODE_SQL)} AS has_code, {rlike("text", text.LIST_ITEM)} AS has_list, {rlike("text", text.LEGAL)} AS has_legal,
        {ends_well("text")} AS ends_well, {starts_mid("text")} AS starts_mid
        FROM (SELECT doc_id, text, {blank_words("text")} AS w FROM documents)""",
)
def text_measures(spark, sf_dir):
    t = F.col("text")
    return read_texts(spark, sf_dir, "documents").select(
        "doc_id",
        text.numeric_density(t).alias("numeric_density"),
        text.token_estimate(t).alias("token_estimate"),
        text.is_korean(t).alias("korean"),
        text.has_table(t).alias("has_table"),
        text.has_code(t).alias("has_code"),
        text.has_list(t).alias("has_list"),
        text.has_legal_structure(t).alias("has_legal"),
        text.ends_with_terminator(t).alias("ends_well"),
        text.starts_mid_sentence(t).alias("starts_mid"),
    )


_BIGRAMS = r"(SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w, list_distinct(list_transform(range(1, length(f)), lambda i: substring(f, i, 2))) AS b FROM (SELECT item_id, text, lower(regexp_replace(text, '\s+', '', 'g')) AS f FROM benchmark))"
_JACCARD = "coalesce(len(list_intersect(x.{0}, y.{0})) / nullif(len(list_distinct(list_concat(x.{0}, y.{0}))), 0), 0)"


@query(
    "char_bigram_similarity",
    f"SELECT x.item_id AS item_a, y.item_id AS item_b, round(greatest({_JACCARD.format('w')}, {_JACCARD.format('b')}), 6) AS similarity FROM {_BIGRAMS} x JOIN {_BIGRAMS} y ON x.item_id < y.item_id",
)
def char_bigram_similarity(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select("item_id", text.token_set(F.col("text")).alias("w"), text.char_bigrams(F.col("text")).alias("b"))
    pairs = items.alias("x").join(items.alias("y"), F.col("x.item_id") < F.col("y.item_id"))
    similar = F.greatest(text.array_jaccard(F.col("x.w"), F.col("y.w")), text.array_jaccard(F.col("x.b"), F.col("y.b")))
    return pairs.select(F.col("x.item_id").alias("item_a"), F.col("y.item_id").alias("item_b"), F.round(similar, 6).alias("similarity"))


@query(
    "language_mix",
    f"""SELECT doc_id, round(ko / greatest(ko + zh + en, 1), 2) AS ko, round(zh / greatest(ko + zh + en, 1), 2) AS zh, round(en / greatest(ko + zh + en, 1), 2) AS en,
        CASE WHEN ko + zh + en = 0 THEN 'unknown' WHEN ko >= zh AND ko >= en THEN 'ko' WHEN zh >= en THEN 'zh' ELSE 'en' END AS main FROM
        (SELECT doc_id, {hits("h", text.HANGUL)} AS ko, {hits("h", chr(91) + chr(92) + "x{4E00}-" + chr(92) + "x{9FFF}]")} AS zh, {hits("h", "[a-zA-Z]")} AS en FROM (SELECT doc_id, text AS h FROM documents))""",
)
def language_mix(spark, sf_dir):
    counted = read_texts(spark, sf_dir, "documents").select("doc_id", *(c.alias(k) for k, c in profile.language_counts(F.col("text")).items()))
    n = {k: F.col(k) for k in ("ko", "zh", "en")}
    return counted.select("doc_id", *(c.alias(k) for k, c in profile.language_shares(n).items()), profile.primary_language(n).alias("main"))


_QUALITY = rf"""(SELECT doc_id, CASE WHEN size = 0 THEN 0.0 ELSE round(0.3 * CASE WHEN size < 10 THEN 0.3 WHEN size < 100 THEN 0.7 ELSE 1.0 END
    + 0.3 * CASE WHEN broken = 0 THEN 1.0 WHEN broken > 0.1 THEN 0.1 WHEN broken > 0.05 THEN 0.3 WHEN broken > 0.01 THEN 0.6 ELSE 0.8 END
    + 0.2 * CASE WHEN ink < 0.1 THEN 0.2 WHEN ink < 0.3 THEN 0.5 WHEN ink > 0.95 THEN 0.7 ELSE 1.0 END
    + 0.2 * CASE WHEN n < 100 THEN 1.0 WHEN len(l) = 0 THEN 0.5 WHEN u < 0.3 THEN 0.2 WHEN u < 0.5 THEN 0.5 ELSE 1.0 END, 3) END AS score
    FROM (SELECT doc_id, length(text) AS n, length({strip("text")}) AS size, {hits("text", quality.BROKEN)} / greatest(length(text), 1) AS broken, l,
          length(regexp_replace(text, '[ \n\t]', '', 'g')) / greatest(length(text), 1) AS ink, len(list_distinct(l)) / greatest(len(l), 1) AS u
          FROM (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda x: {strip("x")}), lambda x: x <> '') AS l FROM documents)))"""


@query("document_quality", f"SELECT doc_id, CAST(score AS DOUBLE) AS score FROM {_QUALITY}")
def document_quality(spark, sf_dir):
    return read_texts(spark, sf_dir, "documents").select("doc_id", quality.document_quality(F.col("text")).alias("score"))


@query("quality_vs_labels", f"SELECT l.quality, count(*) AS n, round(avg(score), 6) AS average, CAST(min(score) AS DOUBLE) AS least FROM labels l JOIN {_QUALITY} USING (doc_id) GROUP BY l.quality")
def quality_vs_labels(spark, sf_dir):
    scored = document_quality(spark, sf_dir)
    both = read(spark, sf_dir, "labels").select("doc_id", "quality").join(scored, "doc_id")
    return both.groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("average"), F.min("score").alias("least"))


def _denoise_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '!\[[^\]]*\]\([^)]*\)|\[(?:image|이미지|그림)[^\]]*\]', '', 'g')"
    x = rf"array_to_string(list_filter(string_split({x}, chr(10)), lambda s, i: NOT regexp_matches(s, '^\s*\d{{1,4}}\s*$') OR coalesce(contains(string_split({x}, chr(10))[i - 1], '|'), false) OR coalesce(contains(string_split({x}, chr(10))[i + 1], '|'), false)), chr(10))"
    x = rf"regexp_replace({x}, '\[\^?\d{{1,3}}\]', '', 'g')"
    x = rf"regexp_replace({x}, '[\x{{200B}}-\x{{200D}}\x{{FEFF}}\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"
    x = rf"regexp_replace({x}, '(?m)^[ \t]*[-=_*~#.]{{3,}}[ \t]*$', '', 'g')"
    return rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"


@query("denoise_text", f"SELECT doc_id, md5({_denoise_sql('text')}) AS content FROM documents")
def denoise_text(spark, sf_dir):
    return read_texts(spark, sf_dir, "documents").select("doc_id", F.md5(quality.denoised(F.col("text"))).alias("content"))


def _html_sql() -> str:
    x = "regexp_replace(html, '(?is)<(?:script|style)[^<>]*>.*?</(?:script|style)>|<!--.*?-->', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<title[^<>]*>.*?</title>', '', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, {q(html._BLOCK)}, chr(10), 'g'), '<[^>]+>', '', 'g')"
    for name, char in html.ENTITIES:
        x = f"replace({x}, {q(name)}, {q(char)})"
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda s: {strip('s')}), lambda s: s <> ''), chr(10))"


def _title_sql() -> str:
    x = "regexp_extract(html, '(?is)<title[^<>]*>(.*?)</title *>', 1)"
    for name, char in html.ENTITIES:
        x = f"replace({x}, {q(name)}, {q(char)})"
    return f"nullif({strip(x)}, '')"


@query("html_to_text", f"SELECT page_id, {_html_sql()} AS text FROM pages")
def html_to_text(spark, sf_dir):
    return read_texts(spark, sf_dir, "pages").select("page_id", html.html_text(F.col("html")).alias("text"))


@query("html_title", rf"SELECT page_id, {_title_sql()} AS title, CAST(len(regexp_extract_all(html, '(?i)<h[1-6][\s>]')) AS INTEGER) AS headings FROM pages")
def html_title(spark, sf_dir):
    return read_texts(spark, sf_dir, "pages").select("page_id", html.html_title(F.col("html")).alias("title"), html.heading_count(F.col("html")).alias("headings"))


_TAB = f"({hits('text', profile.TABLES[0])} + {hits('text', profile.TABLES[1])} + {hits('text', profile.TABLES[2])})"
_LST = r"(len(regexp_extract_all(text, '(?m)^[ \t]*[-*•]\s+')) + len(regexp_extract_all(text, '(?m)^[ \t]*\d+[.)]\s+')))"
_COD = rf"CAST(len(regexp_extract_all(text, '```')) // 2 + len(regexp_extract_all(text, '(?m)^\s{{4,}}\S')) // 3 AS INTEGER)"
_PAR = r"(len(regexp_extract_all(text, '\n\s*\n')) + 1)"
_STRUCTURE = f"""CASE WHEN {rlike("text", text.LEGAL)} THEN 'legal_hierarchical' WHEN {rlike("text", profile.HEADINGS)} THEN 'hierarchical' WHEN {_TAB} > 0 THEN 'tabular'
    WHEN (length(text) - length(replace(text, chr(10) || chr(10), ''))) // 2 >= 3 THEN 'paragraphed' ELSE 'flat' END"""
_PROFILE = f"""(SELECT doc_id, text, structure, tables, lists, code, paragraphs, CASE WHEN k[1].s = 0 THEN 'narrative' WHEN k[2].s > 0 AND k[2].s > k[1].s * 0.5 THEN 'mixed' ELSE k[1].n END AS information FROM (
    SELECT *, list_reverse_sort([{{'s': CASE WHEN paragraphs >= 3 AND tables = 0 AND code = 0 THEN 2.0 ELSE 0.0 END, 't': 0, 'n': 'narrative'}},
        {{'s': CASE WHEN tables >= 3 THEN 3.0 WHEN tables >= 1 THEN 1.5 ELSE 0.0 END, 't': -1, 'n': 'tabular'}}, {{'s': CASE WHEN code >= 2 THEN 3.0 WHEN code >= 1 THEN 1.5 ELSE 0.0 END, 't': -2, 'n': 'code'}},
        {{'s': CASE WHEN lists >= 5 THEN 2.0 WHEN lists >= 2 THEN 1.0 ELSE 0.0 END, 't': -3, 'n': 'enumeration'}}, {{'s': CASE WHEN structure = 'legal_hierarchical' THEN 3.0 ELSE 0.0 END, 't': -4, 'n': 'legal'}}]) AS k
    FROM (SELECT doc_id, text, {_STRUCTURE} AS structure, {_TAB} AS tables, {_LST} AS lists, {_COD} AS code, {_PAR} AS paragraphs FROM documents)))"""


def profiled(spark, sf_dir):
    """Each pattern is counted once; what follows from the counts is computed from them."""
    t = F.col("text")
    counted = read_texts(spark, sf_dir, "documents").select("doc_id", "text", profile._tables(t).alias("tables"), profile._lists(t).alias("lists"), profile._code(t).alias("code"), profile.paragraphs(t).alias("paragraphs"))
    counted = counted.withColumn("structure", profile.structure(t, F.col("tables")))
    legal = F.col("structure") == "legal_hierarchical"
    return counted.withColumn("information", profile.information_type(F.col("tables"), F.col("code"), F.col("lists"), F.col("paragraphs"), legal))


_DEPTH = r"coalesce(list_max(list_transform(regexp_extract_all(text, '(?m)^(#{1,6})\s+', 1), lambda x: length(x))), CAST(list_max(regexp_extract_all(text, '(?i)<h([1-6])', 1)) AS INTEGER), 0)"


@query(
    "document_profile",
    f"""SELECT doc_id, structure, CAST(tables AS INTEGER) AS tables, CAST(lists AS INTEGER) AS lists, code, CAST(paragraphs AS INTEGER) AS paragraphs, information,
        round(len(list_distinct({words("text")})) / greatest(len({words("text")}), 1), 6) AS richness, round(length(regexp_replace(text, '[ \\n\\t]', '', 'g')) / greatest(length(text), 1), 3) AS density, {_DEPTH} AS depth FROM {_PROFILE}""",
)
def document_profile(spark, sf_dir):
    t = F.col("text")
    return profiled(spark, sf_dir).withColumns({"richness": F.round(profile.vocabulary_richness(t), 6), "density": profile.information_density(t), "depth": profile.heading_depth(t)}).drop("text")


def _domain_sql() -> str:
    names, found, scores = list(rules.DOMAIN_TERMS), [], []
    for d, terms in rules.DOMAIN_TERMS.items():
        own = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
        found.append(f"list_sort(list_distinct(list_concat(list_intersect(w, {own}), list_filter({own}, lambda t: length(t) > 3 AND contains(lower(text), t))))) AS {d}_terms")
        bonus = {"legal": "CASE WHEN structure = 'legal_hierarchical' THEN 5 ELSE 0 END", "financial": "CASE WHEN nd > 0.15 THEN 2 ELSE 0 END + CASE WHEN tables >= 3 THEN 1 ELSE 0 END"}.get(d, "0")
        scores.append(f"CAST(len({d}_terms) + {bonus} AS INTEGER) AS {d}")
    best = f"greatest({', '.join(names)})"
    weight = lambda i: "CAST(CASE domain " + " ".join(f"WHEN '{d}' THEN {w[i]}" for d, w in rules.DOMAIN_WEIGHTS.items()) + f" ELSE {rules.PLAIN_WEIGHTS[i]} END AS DOUBLE)"
    return f"""SELECT *, {weight(2)} AS bm25_weight FROM (SELECT doc_id, {", ".join(names)}, CASE WHEN {best} = 0 THEN 'general' {" ".join(f"WHEN {n} = {best} THEN '{n}'" for n in names)} END AS domain,
        CAST(CASE WHEN o[1] = 0 THEN 0 WHEN o[2] = 0 THEN least(1.0, o[1] / 5) ELSE floor(o[1] / (o[1] + o[2]) * least(1.0, o[1] / 3) * 100 + 0.5) / 100 END AS DOUBLE) AS confidence,
        array_to_string(CASE WHEN {best} = 0 THEN [] {" ".join(f"WHEN {n} = {best} THEN {n}_terms[1:10]" for n in names)} END, ' ') AS terms
        FROM (SELECT *, list_reverse_sort([{", ".join(names)}]) AS o FROM (SELECT *, {", ".join(scores)} FROM (SELECT *, {", ".join(found)} FROM (SELECT *, {words("text")} AS w, CASE WHEN len(b) = 0 THEN 0.0 ELSE round_even(len(list_filter(b, lambda x: regexp_matches(x, '[0-9]'))) / len(b), 3) END AS nd
        FROM (SELECT *, {blank_words("text")} AS b FROM {_PROFILE}))))))"""


@query("domain_detection", _domain_sql())
def domain_detection(spark, sf_dir):
    t = F.col("text")
    own = profiled(spark, sf_dir).withColumns({"words": text.token_set(t), "lower": F.lower(t), "numeric": text.numeric_density(t)})
    found = own.withColumns({f"{d}_terms": c for d, c in profile.domain_terms(F.col("words"), F.col("lower")).items()})
    terms = {d: F.col(f"{d}_terms") for d in rules.DOMAIN_TERMS}
    scored = found.withColumns(profile.domain_scores(terms, F.col("structure") == "legal_hierarchical", F.col("numeric"), F.col("tables")))
    scores = {d: F.col(d) for d in terms}
    none = F.array().cast("array<string>")
    named = scored.withColumns({"domain": profile.domain(scores), "confidence": profile.domain_confidence(scores)})
    top = F.when(F.col("domain") == "general", none)
    for d, x in terms.items():
        top = top.when(F.col("domain") == d, F.slice(x, 1, 10))
    return named.select("doc_id", *terms, "domain", "confidence", F.array_join(top, " ").alias("terms"), profile.domain_weight(F.col("domain"), 2).alias("bm25_weight"))


@query(
    "auto_chunk_strategy",
    f"""SELECT doc_id, structure, CASE WHEN structure IN ('hierarchical', 'legal_hierarchical') OR information = 'tabular' THEN 'structural' WHEN paragraphs >= 3 THEN 'semantic' ELSE 'fixed' END AS strategy FROM {_PROFILE}""",
)
def auto_chunk_strategy(spark, sf_dir):
    p = profiled(spark, sf_dir)
    return p.select("doc_id", "structure", profile.recommended_strategy(F.col("structure"), F.col("information"), F.col("paragraphs")).alias("strategy"))


SIZE, OVERLAP = 128, 16
CHUNKS_SQL = f"""(SELECT doc_id, CAST(pos // {SIZE - OVERLAP} AS INTEGER) AS chunk_index, concat(doc_id, '-', pos // {SIZE - OVERLAP}) AS chunk_id, array_to_string(w[pos + 1 : pos + {SIZE}], ' ') AS text, CAST(len(w[pos + 1 : pos + {SIZE}]) AS INTEGER) AS n_words
    FROM (SELECT doc_id, w, unnest(range(0, len(w), {SIZE - OVERLAP})) AS pos FROM (SELECT doc_id, {blank_words("text")} AS w FROM documents)))"""


def windows(spark, sf_dir, of=None):
    """of: (doc_id), of these documents only."""
    docs = read_texts(spark, sf_dir, "documents")
    return chunks.word_windows(docs if of is None else docs.join(of, "doc_id", "left_semi"), SIZE, OVERLAP)


@query("fixed_word_chunks", f"SELECT * FROM {CHUNKS_SQL}")
def fixed_word_chunks(spark, sf_dir):
    return windows(spark, sf_dir)


_PLATE = rf"(len(list_filter(l, lambda x: {rlike('x', quality.BOILERPLATE)})) / greatest(len(l), 1))"


@query(
    "chunk_quality_filter",
    rf"""SELECT chunk_id, CAST(score AS DOUBLE) AS score FROM (SELECT chunk_id, CASE WHEN n < 15 THEN 0.1 WHEN {_PLATE} > 0.7 THEN 0.2 WHEN n < 30 AND NOT {ends_well("text")} THEN 0.4 ELSE 1.0 END AS score
        FROM (SELECT chunk_id, text, len({blank_words("text")}) AS n, list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda x: {strip("x")}), lambda x: x <> '') AS l FROM {CHUNKS_SQL})) WHERE score >= 0.3""",
)
def chunk_quality_filter(spark, sf_dir):
    return windows(spark, sf_dir).select("chunk_id", quality.chunk_quality(F.col("text")).alias("score")).where("score >= 0.3")


def _goes_on(a: str, b: str) -> str:
    item = q(text.LIST_ITEM)
    return f"coalesce({strip(a)} <> '' AND {strip(b)} <> '' AND (NOT {ends_well(a)} AND {starts_mid(b)} OR regexp_matches(string_split({strip(a)}, chr(10))[-1], {item}) AND regexp_matches({strip(b)}, {item})), false)"


@query(
    "chunk_signals_neighbours",
    f"""SELECT conv_id, turn, continues_previous, continues_next, CAST(CASE WHEN continues_previous THEN least(c, 0.6) ELSE c END AS DOUBLE) AS completeness FROM (
        SELECT conv_id, turn, {_goes_on("before", "text")} AS continues_previous, {_goes_on("text", "after")} AS continues_next, {completeness_sql("text")} AS c
        FROM (SELECT *, lag(text) OVER w AS before, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)))""",
)
def chunk_signals_neighbours(spark, sf_dir):
    out = chunks.neighbour_signals(read(spark, sf_dir, "conversations"), "conv_id", "turn")
    return out.select("conv_id", "turn", "continues_previous", "continues_next", "completeness")


def _has(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def _one(x: str) -> str:
    return f"CASE WHEN {x} THEN 1 ELSE 0 END"


_KIND = f"""CASE WHEN {rlike("text", questions.CODE_LIKE)} THEN 'conceptual' WHEN len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: {rlike("x", questions.MIXED_CASE)} OR {rlike("x", questions.ACRONYM)} AND NOT list_contains([{", ".join(f"'{g}'" for g in questions.GENERIC)}], x))) > 0
    OR {rlike("text", questions.QUOTED)} OR {rlike("text", questions.VALUE)} THEN 'term_specific' WHEN regexp_matches(lower(text), 'vs|장단점|대비|다른|비교|차이') THEN 'comparative' ELSE 'conceptual' END"""


@query(
    "adaptive_weights",
    f"""SELECT conv_id, turn, CASE WHEN hard > 0 THEN 'complex' WHEN soft > 0 THEN 'medium' ELSE 'simple' END AS complexity,
        CAST(CASE WHEN hard > 0 THEN least(round(0.6 + 0.15 * hard, 2), 1.0) WHEN soft > 0 THEN least(round(0.6 + 0.15 * soft, 2), 1.0) WHEN length(text) > 10 THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence, kind,
        CAST(CASE kind WHEN 'term_specific' THEN 0.65 WHEN 'comparative' THEN 0.2 ELSE 0.25 END AS DOUBLE) AS bm25_weight, NOT regexp_matches(low, '^(?:hello|hey|hi|감사|안녕)|^(?:what time|몇 시)|^\\d+\\s*[*/+-]\\s*\\d+') AS needs_retrieval,
        CASE WHEN {_has("low", ("vs", "compare", "대비", "difference", "차이", "비교"))} THEN 'comparative' WHEN {rlike("low", questions.CONDITIONAL)} THEN 'conditional' WHEN {_has("low", ("process", "how to", "과정", "steps", "방법", "어떻게"))} THEN 'procedural'
        WHEN {_has("low", ("all", "list", "목록", "나열", "모든"))} OR {rlike("low", rules.TEMPORAL)} OR regexp_matches(low, '가장\\s*(?:많|큰|높|낮|적)|몇\\s*(?:건|개|명|회)|총\\s*(?:합계|규모|금액|인원)') THEN 'aggregation' WHEN {_has("low", ("reason", "why", "이유", "왜"))} THEN 'analytical' ELSE 'factual' END AS query_type
        FROM (SELECT conv_id, turn, text, lower(text) AS low, {_KIND} AS kind, {_one(_has("lower(text)", questions.COMPLEX))} + {_one("length(text) - length(translate(text, '?？', '')) >= 2")} + {_one(rlike("lower(text)", questions.CONDITIONAL))} AS hard,
        {_one(_has("lower(text)", questions.MEDIUM))} + {_one("length(text) > 100")} + {_one(rlike("lower(text)", rules.TEMPORAL))} AS soft FROM conversations WHERE role = 'user')""",
)
def adaptive_weights(spark, sf_dir):
    t = F.col("text")
    asked = read(spark, sf_dir, "conversations").where("role = 'user'").withColumn("kind", questions.retrieval_type(t))
    return asked.select(
        "conv_id", "turn", questions.complexity(t).alias("complexity"), questions.complexity_confidence(t).alias("confidence"), "kind", questions.preset(F.col("kind"), 2).alias("bm25_weight"), questions.needs_retrieval(t).alias("needs_retrieval"), questions.query_type(t).alias("query_type")
    )


@query("malicious_input_filter", f"SELECT doc_id, {rlike('text', questions.MALICIOUS)} AS malicious FROM documents")
def malicious_input_filter(spark, sf_dir):
    return read_texts(spark, sf_dir, "documents").select("doc_id", questions.is_malicious(F.col("text")).alias("malicious"))


@query("needs_aggregation", f"SELECT conv_id, turn, NOT {rlike('text', questions.SINGLE_FACT)} AND {rlike('text', questions.AGGREGATE)} AS aggregates FROM conversations")
def needs_aggregation(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", questions.needs_aggregation(F.col("text")).alias("aggregates"))
