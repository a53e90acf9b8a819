import itertools

import pyarrow as pa
import pyarrow.parquet as pq
from tests.conftest import DATA
from tessera.llm import quality, queries


def brute(text):
    t = text or ""
    words = [w for w in "".join(c if ord(c) > 32 else " " for c in t).split(" ") if w]
    n, letters = max(len(t), 1), [c for c in t if c.isascii() and c.isalpha()]
    lines = [x for x in t.split("\n") if any(ord(c) > 32 for c in x)]
    runs = [tuple(words[i : i + quality.PHRASE]) for i in range(len(words) - quality.PHRASE + 1)]
    rules = [
        not words,
        sum(c in "#$%&*" for c in t) / n > 0.1,
        t.count("|") / n > 0.015,
        sum(c.isupper() for c in letters) / max(len(letters), 1) > 0.4,
        sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1) > 0.3,
        (len(lines) - len(set(lines))) / max(len(lines), 1) > 0.5,
        len(runs) - len(set(runs)) > 0.5 * len(runs),
        sum(not any(ord(c) > 127 or c.isalpha() for c in w) for w in words) / max(len(words), 1) > 0.5,
    ]
    return not any(rules)


def test_rows_as_brute_force(spark, messy):
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet"))
    for df in (messy, docs):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = sorted(map(tuple, quality.verdicts(df).collect()), key=repr)
        assert got == sorted(((d, brute(t)) for d, t in rows), key=repr)
        kept = quality.passing(df)
        assert kept.columns == df.columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((d for d, t in rows if brute(t)), key=repr)


def test_order_never_changes_the_result():
    texts = pa.array(["", None, "A B C", "x x x x x", "a|b|c", "l\nl\nl\nl", "fine text here", "$$$ %%% a", "ÄÖÜ é", "buy cheap pills now " * 50, "1 22 333 a", "... --- 1", "a b c d", "a b c d e", "漢字 1"] + pq.read_table(DATA / "sf0.001/documents.parquet")["text"].to_pylist()[:50])
    want = [brute(t) for t in texts.to_pylist()]
    for order in itertools.islice(itertools.permutations(quality.RULES), 0, None, 101):
        assert quality.kept(texts, list(order)).tolist() == want


def test_order_by_rejection_per_cost(spark):
    df = spark.createDataFrame([(i, "a | b | c | d") for i in range(300)], "doc_id long, text string")
    assert quality.cascade(df)[0] == "pipes"
    assert sorted(quality.cascade(df.limit(0))) == sorted(quality.RULES)


def test_sql(same, empty):
    assert same(queries.QUERIES["op7_quality_rules"], queries.SQL["op7_quality_rules"], DATA / "sf0.001") == 200
    assert quality.verdicts(empty).count() == 0 and quality.passing(empty).count() == 0
