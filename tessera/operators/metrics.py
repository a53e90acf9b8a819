"""Metrics of retrieval and answers, operational statistics, semantic cache."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filtered_tokens, query_hash, sentences, token_set
from .search import normalized_bm25, vector_topk


def recall_at_k(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of a query's relevant ids among its first k hits; 1 for a query without relevant ids.

    hits: (query_id, id, rank) with every query at least once; relevant: (query_id, id).
    """
    asked = hits.select("query_id").distinct()
    good = relevant.distinct()
    found = good.join(hits.where(F.col("rank") <= k).select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    found = found.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
    return asked.join(found, "query_id", "left").select("query_id", F.round(F.coalesce("recall", F.lit(1.0)), 6).alias("recall"))


def token_f1(prediction: Column, reference: Column) -> Column:
    p, r = filtered_tokens(prediction), filtered_tokens(reference)
    both, total = F.size(F.array_intersect(p, r)), F.size(p) + F.size(r)
    return F.when((F.size(p) == 0) | (F.size(r) == 0) | (both == 0), 0.0).otherwise(F.round(2 * both / F.greatest(total, F.lit(1)), 4))


def answer_relevancy(question: Column, answer: Column) -> Column:
    """Share of the question's words in the answer, plus .2 for an answer of at least 20 words; 1 at most."""
    q, a = filtered_tokens(question), filtered_tokens(answer)
    share = F.size(F.array_intersect(q, a)) / F.greatest(F.size(q), F.lit(1))
    bonus = F.when(F.size(F.split(answer, r"\s+")) >= 20, 0.2).otherwise(0.0)
    return F.when((F.size(q) == 0) | (F.size(a) == 0), 0.0).otherwise(F.round(F.least(share + bonus, F.lit(1.0)), 4))


def overlap_share(a: Column, b: Column) -> Column:
    """Share of the words of a that b has."""
    x = token_set(a)
    return F.size(F.array_intersect(x, token_set(b))) / F.greatest(F.size(x), F.lit(1))


def context_precision(rows: DataFrame, least: float = 0.2) -> DataFrame:
    """(query_id, precision): share of a question's contexts that have at least `least` of its words; rows: (query_id, question, context)."""
    good = F.when(overlap_share(F.col("question"), F.col("context")) >= least, 1.0).otherwise(0.0)
    return rows.groupBy("query_id").agg(F.round(F.avg(good), 6).alias("precision"))


def faithfulness(rows: DataFrame, least: float = 0.3) -> DataFrame:
    """(query_id, faithfulness): share of an answer's sentences with at least `least` of their words in the context; rows:
    (query_id, answer, context). An answer without sentences has 0."""
    each = rows.select("query_id", "context", F.explode_outer(sentences(F.col("answer"))).alias("sentence"))
    good = F.when(overlap_share(F.col("sentence"), F.col("context")) >= least, 1.0).otherwise(0.0)
    return each.groupBy("query_id").agg(F.round(F.avg(good), 4).alias("faithfulness"))


ENUMERATING = ("모두", "모든", "전부", "나열", "list", "all")


def completeness(rows: DataFrame, least: float = 0.3) -> DataFrame:
    """(query_id, completeness): share of the context's sentences of which the answer has `least` of the words; rows: (query_id, question, answer, context).

    A question for a list counts only sentences with words; for others those without count as covered. An empty answer or context has 0, a
    context without sentences 1, an answer without words 0.
    """
    question, answer = F.lower("question"), F.col("answer")
    lists = F.lit(False)
    for w in ENUMERATING:
        lists = lists | question.contains(w)
    each = rows.select("query_id", "answer", "context", lists.alias("lists"), filtered_tokens(answer).alias("a"), F.explode_outer(sentences(F.col("context"))).alias("sentence"))
    own = filtered_tokens(F.col("sentence"))
    each = each.withColumn("n", F.size(own)).withColumn("covered", F.when(F.size(own) == 0, ~F.col("lists")).otherwise(F.size(F.array_intersect(own, "a")) / F.size(own) >= least))
    counted = F.col("sentence").isNotNull() & ((F.col("n") > 0) | ~F.col("lists"))
    sums = each.groupBy("query_id", "lists").agg(F.count(F.when(counted, 1)).alias("all"), F.count(F.when(counted & F.col("covered"), 1)).alias("met"), F.max(F.size("a")).alias("words"), F.max(F.coalesce("answer", F.lit(""))).alias("answer"), F.max(F.coalesce("context", F.lit(""))).alias("context"))
    share = F.when((F.col("answer") == "") | (F.col("context") == ""), 0.0).when(F.col("all") == 0, 1.0).when(~F.col("lists") & (F.col("words") == 0), 0.0).otherwise(F.round(F.col("met") / F.col("all"), 4))
    return sums.select("query_id", share.alias("completeness"))


#: metric -> target, whether less is better, and what to do about it
TARGETS = {
    "retrieval_recall": (0.8, False, "more overlap of chunks, questions of chunks, other fusion weights"),
    "faithfulness": (0.7, False, "lower temperature, more context, a stronger model"),
    "answer_relevancy": (0.6, False, "better classification and rewriting of questions"),
    "completeness": (0.6, False, "more context, better coverage by chunks"),
    "context_precision": (0.7, False, "fewer hits, better ranking"),
    "token_f1": (0.5, False, "better chunks and retrieval"),
    "latency_p95": (5.0, True, "smaller models, caching, fewer chunks"),
}


def evaluation(scores: DataFrame) -> DataFrame:
    """(metric, score, samples, target, passed, advice) of scores (metric, value), a row for each question and metric; null values do not count.

    latency_p95 is the 95th percentile of its values, the others are averages.
    """
    t = {c: F.create_map(*(x for k, v in TARGETS.items() for x in (F.lit(k), F.lit(v[i])))) for i, c in enumerate(("target", "less", "advice"))}
    out = scores.where("value IS NOT NULL").groupBy("metric").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.95)).alias("p95"), F.count("*").alias("samples"))
    out = out.withColumn("score", F.round(F.when(F.col("metric") == "latency_p95", F.col("p95")).otherwise(F.col("mean")), 4)).withColumn("target", F.try_element_at(t["target"], F.col("metric")))
    passed = F.when(F.try_element_at(t["less"], F.col("metric")), F.col("score") <= F.col("target")).otherwise(F.col("score") >= F.col("target"))
    return out.select("metric", "score", "samples", "target", passed.alias("passed"), F.when(~passed, F.try_element_at(t["advice"], F.col("metric"))).alias("advice"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, config_a, config_b, delta, winner) of two evaluations: a missing metric counts as 0; the winner, on every row, has more metrics that are higher."""
    both = a.select("metric", F.col("score").alias("config_a")).join(b.select("metric", F.col("score").alias("config_b")), "metric", "full_outer").fillna(0.0, ["config_a", "config_b"])
    both = both.withColumn("delta", F.round(F.col("config_b") - F.col("config_a"), 4))
    lead = F.sum(F.signum("delta")).over(Window.partitionBy(F.lit(0)))  # as many rows as there are metrics
    return both.withColumn("winner", F.when(lead > 0, "config_b").when(lead < 0, "config_a").otherwise("tie"))


def synthetic_questions(chunks: DataFrame, n: int) -> DataFrame:
    """(question, expected_answer, source, strategy), at most n, from the 2n longest chunks (chunk_id, text): what the first long sentence says, and what
    numbers the first long sentence with a number gives. The order is that of a hash, so that sources mix and runs agree."""
    longest = chunks.where(F.length(F.trim("text")) > 0).orderBy(F.desc(F.length("text")), "chunk_id").limit(2 * n)
    long = F.filter(sentences(F.col("text")), lambda s: F.length(s) > 20)
    first, number = F.get(long, F.lit(0)), F.get(F.filter(long, lambda s: s.rlike(r"[0-9]")), F.lit(0))
    topic = lambda s: F.array_join(F.slice(F.filter(F.split(s, r"\s+"), lambda w: w != ""), 1, 6), " ")
    ask = lambda s, head, kind: F.when(s.isNotNull(), F.struct(F.concat(F.lit(head), topic(s), F.lit("?")).alias("question"), s.alias("expected_answer"), F.lit(kind).alias("strategy")))
    made = F.array_compact(F.array(ask(first, "What does the document say about: ", "topic_question"), ask(number, "What are the key figures regarding: ", "factual_question")))
    rows = longest.select(F.col("chunk_id").alias("source"), F.explode(made).alias("q")).select("q.*", "source")
    return rows.orderBy(F.md5(F.concat(F.col("source").cast("string"), "strategy")), "source").limit(n)


def tuned(lists: dict[str, DataFrame], relevant: DataFrame, grid: list[dict[str, float]], k: int = 5, depth: int = 60) -> DataFrame:
    """(setting, recall) of each setting of fusion weights (normalised to a sum of 1), all scored in one job: the best comes first.

    lists: (query_id, id, score, rank) as for fusion; relevant: (query_id, id). Settings are rows: a list is read once whatever their number.
    """
    spark, names = relevant.sparkSession, list(lists)
    rows = [(i, *(float(w.get(n, 0.0)) / (sum(w.values()) or 1.0) for n in names)) for i, w in enumerate(grid)]
    settings = spark.createDataFrame(rows, "setting int, " + ", ".join(f"{n} double" for n in names))
    parts = []
    for n, df in lists.items():
        raw = normalized_bm25(F.col("score")) if n == "bm25" else F.greatest(F.col("score"), F.lit(0.0))
        parts.append(df.select("query_id", "id", (raw / (depth + F.col("rank"))).alias("part")).crossJoin(F.broadcast(settings.select("setting", F.col(n).alias("w")))).select("setting", "query_id", "id", (F.col("w") * F.col("part")).alias("part")))
    total = reduce(DataFrame.unionByName, parts).groupBy("setting", "query_id", "id").agg(F.round(F.sum("part"), 10).alias("s"))
    w = Window.partitionBy("setting", "query_id").orderBy(F.desc("s"), "id")
    best = total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    asked = relevant.distinct().crossJoin(F.broadcast(settings.select("setting")))
    met = asked.join(best.select("setting", "query_id", "id", F.lit(1).alias("hit")), ["setting", "query_id", "id"], "left")
    each = met.groupBy("setting", "query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
    return each.groupBy("setting").agg(F.round(F.avg("recall"), 6).alias("recall")).orderBy(F.desc("recall"), "setting")


def scenarios(rows: DataFrame) -> DataFrame:
    """(total, passed, pass_rate, hard_pass_rate, latency_median, latency_p95) of rows (answer, keywords, match_mode, expect_insufficient, confidence, difficulty, latency).

    latency_p95 is the value at place int(.95 n) of the ordered ones, the last at most.
    """
    low = F.lower("answer")
    has = lambda k: F.contains(low, F.lower(k))
    lacks = F.lit(False)
    for w in ("부족", "없습니다", "없음", "확인되지"):
        lacks = lacks | low.contains(w)
    met = F.when(F.col("match_mode") == "all", F.forall("keywords", has)).otherwise(F.exists("keywords", has))
    passed = F.when(F.col("expect_insufficient"), lacks | (F.col("confidence") == "insufficient_evidence")).when(F.size("keywords") <= 0, F.length("answer") > 10).otherwise(met)
    rows = rows.withColumn("ok", F.coalesce(passed, F.lit(False))).withColumn("hard", F.col("difficulty") == "hard")
    n = F.count("latency")
    # an exact percentile at (place) / (n - 1) is the value at that place
    place = F.least(F.floor(n * 0.95), n - 1)
    out = rows.agg(F.count("*").alias("total"), F.sum(F.col("ok").cast("long")).alias("passed"), F.sum((F.col("ok") & F.col("hard")).cast("long")).alias("hp"), F.sum(F.col("hard").cast("long")).alias("h"), F.percentile("latency", F.lit(0.5)).alias("latency_median"), F.max(F.lit(0)).alias("z"), place.alias("place"), n.alias("n"))
    ordered = rows.where("latency IS NOT NULL").groupBy("latency").agg(F.count("*").alias("c"))
    below = F.sum("c").over(Window.orderBy("latency").rowsBetween(Window.unboundedPreceding, 0))
    at = ordered.withColumn("upto", below).crossJoin(F.broadcast(out.select("place"))).where("upto > place").agg(F.min("latency").alias("latency_p95"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    return out.crossJoin(F.broadcast(at)).select("total", "passed", rate("passed", "total").alias("pass_rate"), rate("hp", "h").alias("hard_pass_rate"), F.round("latency_median", 6).alias("latency_median"), "latency_p95")


def trace_stats(traces: DataFrame, since=None) -> DataFrame:
    """One row over traces (timestamp, latency, tokens_in, tokens_out, cost): count, latencies and sums; since: none earlier."""
    if since is not None:
        traces = traces.where(F.col("timestamp") >= F.lit(since))
    p = lambda q: F.round(F.percentile("latency", F.lit(q)), 6)
    return traces.agg(F.count("*").alias("n"), F.round(F.avg("latency"), 6).alias("average"), F.max("latency").alias("most"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 6).alias("cost"))


def batch_summary(results: DataFrame) -> DataFrame:
    """(total, succeeded, failed, average_latency, error_rate) of a batch of queries (error, latency); latency of those that succeeded."""
    ok = F.col("error").isNull()
    out = results.agg(F.count("*").alias("total"), F.count(F.when(ok, 1)).alias("succeeded"), F.count(F.when(~ok, 1)).alias("failed"), F.round(F.avg(F.when(ok, F.col("latency"))), 6).alias("average_latency"))
    return out.withColumn("error_rate", F.when(F.col("total") > 0, F.round(F.col("failed") / F.col("total"), 6)).otherwise(0.0))


def live(cache: DataFrame, now: Column) -> DataFrame:
    """Entries (created_at, ttl_seconds, both in seconds) that are not expired."""
    return cache.where(now - F.col("created_at") <= F.col("ttl_seconds"))


def evicted(cache: DataFrame, most: int) -> DataFrame:
    """At most `most` entries: those of the fewest hits go first, of equal ones the newest, then the higher id."""
    return cache.orderBy(F.desc("hit_count"), F.asc("created_at"), F.asc("entry_id")).limit(most)


def limited(events: DataFrame, rate: float, burst: float) -> DataFrame:
    """Events (key, ts in seconds, id) with `allowed`, by a token bucket of each key: `rate` tokens a second, `burst` at most, one for each event allowed.

    A key's events come to one task in order and are replayed as a stream: it holds one bucket, however many events a key has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tokens, last = None, burst, 0.0
        for batch in batches:
            out = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("ts").to_pylist()):
                if k != key:
                    key, tokens, last = k, burst, t
                tokens, last = min(burst, tokens + (t - last) * rate), t
                out.append(tokens >= 1)
                tokens -= out[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, "allowed"])

    kind = events.schema["key"].dataType.simpleString()
    rows = events.select("key", F.col("ts").cast("double").alias("ts"), F.col("id").cast("long").alias("id")).where("key IS NOT NULL AND ts IS NOT NULL")
    return rows.repartition("key").sortWithinPartitions("key", "ts", "id").mapInArrow(run, f"key {kind}, ts double, id long, allowed boolean")


SWAPS = (("Q1", "Q3"), ("Q2", "Q4"), ("상반기", "하반기"), ("1분기", "3분기"), ("2분기", "4분기"))


def perturbed(text: Column, seed: int, swaps: tuple[tuple[str, str], ...] = SWAPS) -> Column:
    """A confusing variant of a text, the same for the same seed: years from 2020 to 2039 moved by one to three, the digit before the last of other
    numbers of two digits or more changed, quarters and halves exchanged."""
    move = 1 + seed % 3
    words = F.split(text, r"(?<=[^0-9])(?=[0-9])|(?<=[0-9])(?=[^0-9])")
    turned = lambda w: F.concat(F.substr(w, F.lit(1), F.length(w) - 2), ((F.substr(w, F.length(w) - 1, F.lit(1)).cast("int") + 1 + seed % 9) % 10).cast("string"), F.substr(w, F.length(w), F.lit(1)))
    new = lambda w: F.when(w.rlike("^20[23][0-9]$"), (w.cast("int") + move).cast("string")).when(w.rlike("^[0-9]{2,}$"), turned(w)).otherwise(w)
    out = F.array_join(F.transform(words, new), "")
    for i, (a, b) in enumerate(swaps):
        out = F.replace(F.replace(F.replace(out, F.lit(a), F.lit(f"\x01{i}")), F.lit(b), F.lit(a)), F.lit(f"\x01{i}"), F.lit(b))
    return out


def latency_stats(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, average, maximum and linearly interpolated percentiles."""
    p = lambda q: F.round(F.percentile(value, F.lit(q)), 6)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("average"), F.max(value).alias("most"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def budget(rows: DataFrame, ts: str, cost: str, daily: float, monthly: float) -> DataFrame:
    """(day, spent_day, spent_month, allowed): UTC sums of each day and, so far, of its month."""
    days = rows.groupBy(F.date_trunc("DAY", ts).alias("day")).agg(F.sum(cost).alias("spent"))
    w = Window.partitionBy(F.date_trunc("MONTH", "day")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("so_far", F.round(F.sum("spent").over(w), 4)).withColumn("spent", F.round("spent", 4))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("spent").alias("spent_day"), F.col("so_far").alias("spent_month"), ((F.col("spent") <= daily) & (F.col("so_far") <= monthly)).alias("allowed"))


def checklist(value: Column, target: float, weight: float, minimise: bool) -> Column:
    """weight * min(ratio, 1), where the ratio says how nearly the target is met."""
    ratio = F.when(value <= 0, F.lit(1.0)).otherwise(target / value) if minimise else value / F.lit(target)
    return F.round(weight * F.least(ratio, F.lit(1.0)), 6)


def cache_used(cache: DataFrame, found: DataFrame) -> DataFrame:
    """The cache with hit_count raised by the look-ups (entry_id) that it served."""
    served = found.groupBy("entry_id").agg(F.count("*").alias("served"))
    return cache.join(served, "entry_id", "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("served", F.lit(0))).drop("served")


def cache_lookup(queries: DataFrame, cache: DataFrame, least: float = 0.95) -> DataFrame:
    """(query_id, entry_id, kind): the entry with the same hash, else the nearest by cosine of at least `least`.

    queries: (query_id, text, vec); cache: (entry_id, text, vec).
    """
    keyed = cache.select("entry_id", query_hash(F.col("text")).alias("h"))
    exact = queries.select("query_id", query_hash(F.col("text")).alias("h")).join(keyed, "h").groupBy("query_id").agg(F.min("entry_id").alias("entry_id"))
    rest = queries.join(exact, "query_id", "left_anti").select("query_id", "vec")
    near = vector_topk(cache.select(F.col("entry_id").alias("id"), "vec"), rest.withColumnRenamed("vec", "qvec"), 1).where(F.col("score") >= least)
    near = near.withColumnRenamed("id", "entry_id")
    return exact.select("query_id", "entry_id", F.lit("exact").alias("kind")).unionByName(near.select("query_id", "entry_id", F.lit("semantic").alias("kind")))


def keyword_score(answer: Column, keywords: Column, mode: str = "any") -> Column:
    """Whether an answer has any, or all, of the keywords, letter case aside."""
    has = lambda k: F.contains(F.lower(answer), F.lower(k))
    return F.exists(keywords, has) if mode == "any" else F.forall(keywords, has)
