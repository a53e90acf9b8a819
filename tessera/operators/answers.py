"""What surrounds the language model: evidence, context, citations, confidence, compression, diversity. The model itself
is a function that the caller gives."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import STATUS_HEADINGS
from ..functions.text import stripped
from .chunks import _alike, _keys
from .search import ranges

#: each of these, however often, is one mark of an answer that lacks something
INSUFFICIENT = (
    r"충분한?\s*정보가?\s*(?:없|부족)",
    r"확인할?\s*수\s*없",
    r"명시되어?\s*있지\s*않",
    r"찾(?:을|지)\s*못",
    r"컨텍스트에[서는]*\s*(?:없|포함되어 있지 않)",
    "insufficient",
    r"(?:don'?t|do not)\s*have\s*(?:enough|sufficient)",
    r"정보가?\s*부족",
    "없습니다",
    r"종합하기\s*어렵",
    r"에\s*대해서는\s*확인이?\s*어렵",
    r"관련\s*내용이?\s*없",
    r"언급되지\s*않",
    r"데이터가?\s*없",
)
GAP = r"(?:에\s*대한|대한|관련)\s*(?:정보|수치|데이터|내용|자료)가?\s*(?:없|부족|포함)"
NAMED_GAP = r"(?:\"([^\"]+)\"|'([^']+)'|「([^」]+)」)\s*(?:에\s*대한|관련|정보)"
TOPIC_GAP = r"([가-힣A-Za-z0-9 \t\n]{2,20})(?:에\s*대해서는\s*확인이?\s*어렵|관련\s*내용이?\s*없|(?:은|는)\s*언급되지\s*않|데이터가?\s*없)"
SIGNAL = r"(?i)\n*(?:Confidence|신뢰도):\s*(?:STRONGLY_SUPPORTED|PARTIALLY_SUPPORTED|INSUFFICIENT_EVIDENCE)\s*$"


def has_evidence(n_chunks: Column, top_score: Column, least: float = 0.18) -> Column:
    return (n_chunks > 0) & (F.coalesce(top_score, F.lit(0.0)) >= least)


def confidence(answer: Column, top_score: Column) -> Column:
    """The word in the answer, in this order; without one the top score decides."""
    low = F.lower(answer)
    return (
        F.when(low.contains("strongly_supported"), "strongly_supported")
        .when(low.contains("insufficient_evidence"), "insufficient_evidence")
        .when(low.contains("partially_supported"), "partially_supported")
        .when(top_score > 0.8, "strongly_supported")
        .when(top_score > 0.5, "partially_supported")
        .otherwise("insufficient_evidence")
    )


def citations(answer: Column, n_sources: Column) -> Column:
    """Numbers cited as [n] or [Source n], in order, once each, in range; all sources where there is none."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(?:[Ss]ource\s+)?(\d{1,6})\]"), F.lit(1)), lambda x: x.cast("int"))
    valid = F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n_sources)))
    return F.when(F.size(valid) > 0, valid).when(n_sources > 0, F.sequence(F.lit(1), n_sources)).otherwise(F.array().cast("array<int>"))


def cleaned(answer: Column) -> Column:
    """Without the line that states the confidence, at the end."""
    return stripped(F.regexp_replace(stripped(answer), SIGNAL, ""))


def looks_insufficient(answer: Column) -> Column:
    """Under 20 characters, two marks of insufficiency, or one in under 100 characters; null counts as empty."""
    n = sum((F.when(answer.rlike(f"(?i){p}"), 1).otherwise(0) for p in INSUFFICIENT), F.lit(0))
    size = F.coalesce(F.length(answer), F.lit(0))
    return (size < 20) | (n >= 2) | ((n == 1) & (size < 100))


def missing_focus(question: Column, answer: Column) -> Column:
    """A question for what the answer says it lacks: the same again, with the name or topic it could not find; null if it names nothing."""
    name = F.concat(*(F.regexp_extract(answer, NAMED_GAP, i) for i in (1, 2, 3)))
    topic = F.trim(F.regexp_extract(answer, TOPIC_GAP, 1))
    return (
        F.when(answer.rlike(GAP), question)
        .when(name != "", F.concat_ws(" ", name, question))
        .when(answer.rlike(TOPIC_GAP), F.when((topic != "") & ~question.contains(topic), F.concat_ws(" ", question, topic)).otherwise(question))
    )


def flattened(text: str) -> str:
    """Headings that state a status ("### confirmed (2)") become labels at the end of the list items below them."""
    lines = text.split("\n")
    heads = [_STATUS_HEAD.match(x.strip()) for x in lines]
    status = [next((k for k in STATUS_HEADINGS if k in h[1]), "") if h else None for h in heads]
    if not any(status):
        return text
    out, now = [], ""
    for line, found in zip(lines, status):
        if found is not None:
            now = found
            if now:
                continue
        out.append(f"{line} [{now}]" if now and _ITEM.match(line.strip()) else line)
    return "\n".join(out)


_STATUS_HEAD = re.compile(r"#{1,4}\s+(.+?)(?:\s*\(\d+건?\))?\s*$")
_ITEM = re.compile(r"(?:\d+\.|[-*•])\s+")


def flattened_statuses(text: Column) -> Column:
    """The same of a column, in Arrow batches."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else flattened(t)), "string")(text)


def truncated(text: Column, most: Column) -> Column:
    """At most so many characters, up to the last end of a sentence, else the last blank, in the latter seven tenths; else cut; marked by dots."""
    head = F.substr(text, F.lit(1), most)
    sentence = F.regexp_extract(head, r"(?s)^(.*(?:[.!?。]\s|[다요음임니까]\.\s|[다요음임니까]\s))", 1)
    word = F.regexp_extract(head, "(?s)^(.*) ", 1)
    far = lambda x: F.length(x) > most * 0.3
    cut = F.rtrim(F.when(far(sentence), sentence).when(far(word), word).otherwise(head), F.lit(" \t\n\r"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")))


def assembled(hits: DataFrame, budget: int = 16_000) -> DataFrame:
    """(query_id, n_sources, context): a query's hits as one numbered text, best first, within a budget of characters.

    hits: (query_id, id, score, text) and, where there are, title, section, page and facts (lines). A hit of less than half the best score
    gives 300 characters; the first that overflows the budget is cut at the end of a sentence if 100 characters are left, and ends
    the context. A query has a bounded number of hits (the k of its search).
    """
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in hits.columns else F.lit("")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    rows = hits.withColumn("i", F.row_number().over(order)).withColumn("best", F.max("score").over(Window.partitionBy("query_id")))
    named = lambda c, before, after="": F.when(has(c) != "", F.concat(F.lit(before), has(c), F.lit(after))).otherwise("")
    header = F.concat(F.lit("[Source "), F.col("i").cast("string"), F.lit("]"), named("title", " "), named("section", " — "), named("page", " (p.", ")"))
    share = F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.5)
    own = F.coalesce("text", F.lit(""))
    rows = rows.withColumn("header", header).withColumn("body", F.when((share < 0.5) & (F.length(own) > 300), F.concat(F.substring(own, 1, 300), F.lit("..."))).otherwise(own))
    rows = rows.withColumn("part", F.concat_ws("\n", "header", F.nullif(has("facts"), F.lit("")), "body"))
    before = F.coalesce(F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("over", (F.col("i") > 1) & (F.col("before") + F.length("part") > budget))
    rows = rows.withColumn("after", F.coalesce(F.lag("over").over(order), F.lit(False))).where(~F.col("after"))
    left = (F.lit(budget) - F.col("before") - F.length("header") - 10).cast("int")
    rows = rows.where(~F.col("over") | (left > 100)).withColumn("part", F.when(F.col("over"), F.concat_ws("\n", "header", truncated(F.col("body"), left))).otherwise(F.col("part")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("i", "part"))), lambda x: x["part"])
    return rows.groupBy("query_id").agg(F.count("*").alias("n_sources"), F.array_join(parts, "\n\n").alias("context"))


COMPANY = re.compile(
    r"([\w가-힣]{2,40}(?:건설|물산|바이오|생명|소프트|에너지|은행|자동차|전자|제약|중공업|증권|카드|캐피탈|클라우드|텔레콤|화재|화학))|((?:회계법인|법무법인)\s*[\w가-힣]+)|(김앤장|네이버|당근|배달의민족|세종|율촌|카카오|쿠팡|토스)"
)
AS_CUSTOMER = re.compile(r"Basic|Enterprise|PoC|Pro|계약|고객(?:사)?|도입|등급|배포\s*방식|사용|온프레미스|월\s*매출|클라우드|하이브리드")
AMOUNT = re.compile(r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:만\s*)?(?:USD|달러|원)")


def unfounded(answer: str, customers: list[str], metrics: dict[str, str], texts: list[str]) -> list[str]:
    """What an answer says that its sources do not: companies called customers (within 100 characters) that neither the facts nor the
    texts have, and metrics with another amount than the facts'."""
    out, said = [], " ".join(texts).lower()
    for m in COMPANY.finditer(answer) if customers else ():
        name = m[1] or m[2] or m[3]
        at = answer.find(name)
        near = answer[max(0, at - 100) : at + len(name) + 100]
        if name not in out and AS_CUSTOMER.search(near) and not any(name in k or k in name for k in customers) and name.lower() not in said:
            out.append(name)
    for metric, value in metrics.items():
        at = answer.find(metric)
        if at >= 0:
            here, there = AMOUNT.findall(answer[max(0, at - 50) : at + len(metric) + 100]), AMOUNT.findall(value)
            if here and there and here[0].replace(",", "") != there[0].replace(",", ""):
                out.append(metric)
    return out


def verified(answers: DataFrame, facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds `unfounded` (array) and `valid` (fewer than two) to answers (query_id, answer).

    facts: (query_id, type, customer, metric, value) of the query's sources, a later metric replacing an earlier one of the same value order;
    sources: (query_id, text). Both are bounded by the query's hits. Answers without facts are valid.
    """
    own = facts.groupBy("query_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("type") == "customer_contract", F.col("customer")))).alias("customers"),
        F.sort_array(F.collect_set(F.when((F.col("type") == "finance_metric") & F.col("value").isNotNull(), F.struct("metric", "value")))).alias("metrics"),
    )
    said = sources.groupBy("query_id").agg(F.collect_list("text").alias("texts"))

    @F.pandas_udf("array<string>")
    def check(answer: pd.Series, customers: pd.Series, metrics: pd.Series, texts: pd.Series) -> pd.Series:
        some = lambda x: [] if x is None else list(x)
        return pd.Series([unfounded(a or "", some(c), {x["metric"]: x["value"] for x in some(m)}, some(t)) for a, c, m, t in zip(answer, customers, metrics, texts)])

    rows = answers.join(own, "query_id", "left").join(said, "query_id", "left")
    return rows.withColumn("unfounded", check("answer", "customers", "metrics", "texts")).drop("customers", "metrics", "texts").withColumn("valid", F.size("unfounded") < 2)


def reranked(hits: DataFrame, model_score: Column | None = None, k: int = 5, share: float = 0.7) -> DataFrame:
    """Hits in order of a model's score, with share * model + (1 - share) * fusion as score; without a model the k best as they are."""
    if model_score is None:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    rows = hits.withColumn("model", model_score)
    w = Window.partitionBy("query_id").orderBy(F.desc("model"), F.desc("score"), F.asc("id"))
    ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("score", F.round(share * F.col("model") + (1 - share) * F.col("score"), 8)).drop("model")


def map_reduced(hits: DataFrame, model: Callable[[list[str]], list[str]], chunks: int = 10, fallback: int = 500) -> DataFrame:
    """(query_id, answer): the model reads each of a query's best `chunks` hits, then all it noted; hits: (query_id, id, score, question, text).

    Where the model gives nothing for a hit, the first `fallback` characters of its text stand in.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    best = hits.withColumn("i", F.row_number().over(w)).where(F.col("i") <= chunks)
    noted = generated(best.withColumn("prompt", F.concat_ws("\n", "question", "text")), model)
    note = F.coalesce(F.nullif(F.trim("answer"), F.lit("")), F.substring("text", 1, fallback))
    notes = noted.groupBy("query_id", "question").agg(F.sort_array(F.collect_list(F.struct("i", note.alias("note")))).alias("notes"))
    prompts = notes.select("query_id", F.concat_ws("\n", "question", F.array_join(F.transform("notes", lambda x: F.concat(F.lit("["), x["i"].cast("string"), F.lit("] "), x["note"])), "\n")).alias("prompt"))
    return generated(prompts, model).select("query_id", "answer")


def corrected(answers: DataFrame, steps: list[tuple[str, Callable[[Column], Column], Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """A chain of corrections: each step (name, test of a column, again) redoes just the answers that its test fails.

    answers: (query_id, question, answer); again: rows -> (query_id, answer), null where it could not. `tried` lists the steps that a row went
    through; an answer is replaced only by a new one that passes the test.
    """
    answers = answers.withColumn("tried", F.array().cast("array<string>"))
    for name, fails, again in steps:
        bad = answers.where(F.coalesce(fails(F.col("answer")), F.lit(True)))
        new = again(bad.select("query_id", "question", "answer")).select("query_id", F.col("answer").alias("new"), F.lit(True).alias("redone"))
        rows = answers.join(new, "query_id", "left")
        better = F.col("new").isNotNull() & ~F.coalesce(fails(F.col("new")), F.lit(True))
        answers = rows.select("query_id", "question", F.when(better, F.col("new")).otherwise(F.col("answer")).alias("answer"), F.when(F.col("redone"), F.array_append("tried", F.lit(name))).otherwise(F.col("tried")).alias("tried"))
    return answers


def within_budget(rows: DataFrame, by: str, order: list, text: str, limit: int) -> DataFrame:
    """Rows in order while the sum of their lengths stays in the budget; the first that overflows ends the list."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.length(text)).over(w)).where(F.col("used") <= limit)


def merged_neighbours(hits: DataFrame) -> DataFrame:
    """Runs of successive chunks of one document as one row with the best score; hits: (query_id, doc_id, chunk_index, text, score)."""
    w = Window.partitionBy("query_id", "doc_id").orderBy("chunk_index")
    island = F.col("chunk_index") - F.row_number().over(w)
    part = F.struct("chunk_index", "text")
    out = hits.withColumn("island", island).groupBy("query_id", "doc_id", "island").agg(F.min("chunk_index").alias("chunk_index"), F.count("*").alias("n_merged"), F.max("score").alias("score"), F.sort_array(F.collect_list(part)).alias("parts"))
    return out.select("query_id", "doc_id", "chunk_index", "n_merged", "score", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def compress(query: str, text: str, ratio: float = 0.5) -> str:
    """First, last and the inner sentences that share most words with the query, in their order."""
    own = [s for s in re.split(r"(?<=[!.?。])\s+", text.strip()) if s]
    if len(own) <= 2:
        return text
    asked = set(re.findall(r"\w+", query.lower()))
    worth = lambda s: len(asked & set(re.findall(r"\w+", s.lower()))) + bool(re.search(r"\d", s)) + bool(re.search(r"(?<!^)\b[A-Z]\w+", s))
    inner = sorted(range(1, len(own) - 1), key=lambda i: (-worth(own[i]), i))[: max(0, max(1, int(len(own) * ratio)) - 2)]
    return " ".join(own[i] for i in sorted({0, len(own) - 1, *inner}))


def compressed(rows: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Rows (query, text) with the text compressed; a batch's texts are taken about a megabyte at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ranges(batch.column("text")):
                own = batch.slice(lo, hi - lo)
                short = [None if t is None else compress(q or "", t, ratio) for q, t in zip(own.column("query").to_pylist(), own.column("text").to_pylist())]
                yield own.set_column(own.schema.get_field_index("text"), "text", pa.array(short, pa.string()))

    return rows.mapInArrow(run, rows.schema)


def mmr_order(scores: list[float], texts: list[str], k: int, balance: float = 0.7) -> list[int]:
    """Greedy choice by balance * relevance - (1 - balance) * similarity to what is chosen; of equals the first."""
    low, high = min(scores), max(scores)
    gain = np.array([(s - low) / (high - low) if high > low else 1.0 for s in scores])
    keys = [_keys(t) for t in texts]
    chosen: list[int] = []
    close, free = np.zeros(len(texts)), np.ones(len(texts), bool)
    while len(chosen) < min(k, len(texts)):
        best = int(np.argmax(np.where(free, balance * gain - (1 - balance) * close, -np.inf)))
        chosen.append(best)
        free[best] = False
        close = np.array([max(c, _alike(x, keys[best])) if f else c for c, x, f in zip(close, keys, free)])
    return chosen


def diversified(hits: DataFrame, k: int, balance: float = 0.7) -> DataFrame:
    """(query_id, id, score, rank): the candidates of each query by maximal marginal relevance; hits also have text."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        order = mmr_order(part["score"].tolist(), part["text"].fillna("").tolist(), k, balance)
        out = part.iloc[order][["query_id", "id", "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return hits.select("query_id", "id", "score", "text").groupBy("query_id").applyInPandas(run, "query_id long, id long, score double, rank int")


def without_near_copies(hits: DataFrame, most: float = 0.85) -> DataFrame:
    """Each query's candidates in order of score, without those more than `most` similar to one that was kept."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        part = part.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        keys = [_keys(t) for t in part["text"].fillna("")]
        for i, x in enumerate(keys):
            if all(_alike(x, keys[j]) <= most for j in kept):
                kept.append(i)
        return part.iloc[kept][["query_id", "id", "score"]]

    return hits.select("query_id", "id", "score", "text").groupBy("query_id").applyInPandas(run, "query_id long, id long, score double")


def generated(prompts: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Adds `answer` to rows with a `prompt`; the model gets whole batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["answer"] = model(batch["prompt"].tolist())
            yield batch

    return prompts.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema) + ", answer string")
