"""The pipeline against a version of each stage by brute force, on whole tables."""

from collections import defaultdict

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tessera.llm import langid, packing
from tests.conftest import DATA
from tests.llm import test_jaccard, test_quality, test_substring

CUT = 50


def without_repeats(rows):
    marks = defaultdict(list)
    for d, lo, hi, removed in test_substring.brute([(r["doc_id"], r["text"]) for r in rows], CUT):
        if removed:
            marks[d].append((lo, hi))
    out = []
    for r in rows:
        if spots := marks.get(r["doc_id"]):
            raw = r["text"].encode()
            starts = [i for i, c in enumerate(raw) if c > 32 and (i == 0 or raw[i - 1] <= 32)] + [len(raw)]
            text, last = b"", 0
            for lo, hi in sorted(spots):
                text += raw[last : starts[lo]]
                last = starts[min(hi, len(starts) - 1)]
            text = (text + raw[last:]).decode()
            if not test_substring.split(text):
                continue
            r = {**r, "text": text, "n_chars": len(text)}
        out.append(r)
    return out


def brute(docs):
    """Rows after each stage but the last."""
    rows = [r.asDict() for r in docs.collect()]
    model = langid.fitted(docs)
    names, _, _ = model.decide(pa.array([r["text"] for r in rows], pa.string()))
    if model.names:
        rows = [r for r, n in zip(rows, names) if n != "und"]
    yield rows
    rows = [r for r in rows if test_quality.brute(r["text"])]
    yield rows
    root = {d: c for d, c, _ in test_jaccard.brute_classes([(r["doc_id"], r["text"]) for r in rows], 5, 0.5)}
    rows = [r for r in rows if root.get(r["doc_id"], r["doc_id"]) == r["doc_id"]]
    yield rows
    yield without_repeats(rows)


def key(rows):
    return sorted((tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows), key=repr)


@pytest.mark.parametrize("which", ["sf0.001", "messy"])
def test_stages_as_brute_force(spark, messy, which, tmp_path):
    if which == "messy":
        docs = messy.where("doc_id IS NULL OR doc_id <> 5").unionByName(messy.where("doc_id = 5").limit(1))
    else:
        docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet"))
    docs = docs.cache()
    columns, wanted = docs.columns, brute(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, "")
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert key(r.asDict() for r in docs.collect()) == key(next(wanted)), name
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    words = defaultdict(int)
    for r in docs.collect():
        words[r["doc_id"]] += len(test_substring.split(r["text"] or ""))
    packed = defaultdict(int)
    for r in got:
        packed[r["doc_id"]] += r["n_words"]
        assert 0 < r["n_words"] <= packing.CAPACITY
    assert {d: n for d, n in words.items() if n} == dict(packed)


def test_run_on_a_folder(spark):
    out = corpus_pipeline.run(spark, str(DATA / "sf0.001"))
    assert out.columns == ["shard", "bin", "slot", "doc_id", "start_word", "n_words"] and out.count() > 0


def test_empty_table(spark, empty, tmp_path):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_clean_documents_stay(spark):
    """Of ordinary documents without copies none is lost before packing."""
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    labels = spark.read.parquet(str(DATA / "sf0.01/labels.parquet")).where("quality = 1")
    clean = docs.join(labels.select("doc_id"), "doc_id", "left_semi").where("n_chars > 100")
    n = clean.count()
    kept = corpus_pipeline.language_id(spark, docs, "").join(clean.select("doc_id"), "doc_id", "left_semi").count()
    assert kept >= 0.99 * n
    junk = spark.read.parquet(str(DATA / "sf0.01/labels.parquet")).where("quality = 0").select("doc_id")
    passed = corpus_pipeline.quality_rules(spark, docs, "").select("doc_id", F.lit(1).alias("ok"))
    assert passed.join(junk, "doc_id").count() <= 0.1 * junk.count()
    assert clean.join(passed, "doc_id").count() >= 0.9 * n
