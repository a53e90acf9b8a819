from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from tests.conftest import DATA
from tessera.llm import langid


def filter_of(texts, least=langid.LEAST):
    """A filter from texts of each language, n-grams counted by hand."""
    found = {}
    for name, own in texts.items():
        n = Counter()
        for t in own:
            raw = bytes(langid._FOLD[list(t.lower().encode())])
            n.update(int.from_bytes(raw[k : k + 4], "little") for k in range(len(raw) - 3) if b"  " not in raw[k : k + 4])
        found[name] = np.array(sorted(g for g, c in n.items() if c >= least), np.uint32)
    return langid.LanguageFilter(found)


def test_fitted_as_counted_by_hand(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("Hello there, hello.", "en"), ("bonjour à tous", "fr"), ("bonjour bonjour", "fr"), ("", "de"), ("hello", "en")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model, want = langid.fitted(df, least=2), filter_of({"en": [rows[0][1], rows[4][1]], "fr": [rows[1][1], rows[2][1]]}, 2)
    assert model.names == want.names and all((a == b).all() for a, b in zip(model.planes, want.planes))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    model = langid.fitted(docs.where("doc_id % 2 = 0"), 100)
    rows = docs.where("doc_id % 2 = 1 AND n_chars > 60").select("doc_id", "lang").collect()
    got = {r["doc_id"]: r["language"] for r in langid.languages(docs.where("doc_id % 2 = 1"), model).collect()}
    assert sum(got[r["doc_id"]] == r["lang"] for r in rows) / len(rows) > 0.95


def test_shares_as_by_single_lookups():
    texts = {"x": ["hello there hello there world"] * 4, "y": ["bonjour à tous le monde"] * 4}
    model = filter_of(texts, 1)
    column = pa.array(["hello world", "le monde à vous", "", None, "zzzzqqq", "12345 !!"])
    name, share, total = model.decide(column)
    for i, text in enumerate(column.to_pylist()):
        raw = bytes(langid._FOLD[list((text or "").lower().encode())]) if text else b""
        grams = [raw[k : k + 4] for k in range(len(raw) - 3) if b"  " not in raw[k : k + 4]]
        assert total[i] == len(grams)
        best = {}
        for b, lang in enumerate(model.names):
            hits = 0
            for g in grams:
                value = np.array([int.from_bytes(g, "little")], np.uint32)
                hits += all(int(model.slots[p][0]) >> b & 1 for p in model._places(value))
            best[lang] = max(hits - len(grams) * model.false[b], 0) / (1 - model.false[b]) / max(len(grams), 1)
        top = max(sorted(best), key=best.get)
        assert abs(share[i] - best[top]) < 1e-9
        assert name[i] == (top if grams and best[top] >= langid.SHARE else "und")


def test_no_ngram_of_the_training_texts_is_lost():
    texts = pq.read_table(DATA / "sf0.001/documents.parquet").to_pydict()
    model = filter_of({"en": [t for t, x in zip(texts["text"], texts["lang"]) if x == "en"]}, 1)
    off, data = langid.strings(pa.array([t for t, x in zip(texts["text"], texts["lang"]) if x == "en"]), lower=True)
    g, _ = langid.grams(off, data, 0, len(off) - 1)
    assert all((model.slots[p] & 1).all() for p in model._places(np.unique(g)))


def test_rows(messy, empty):
    out = langid.languages(messy, langid.fitted(messy)).collect()
    assert len(out) == messy.count() and all(r["language"] for r in out)
    assert all(r["language"] == "und" for r in out if r["doc_id"] in (0, 1, 2))
    kept = langid.identified(messy)
    assert kept.columns == messy.columns
    want = sorted((r["doc_id"] for r in out if r["language"] != "und"), key=repr)
    assert sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=repr) == want
    assert langid.identified(empty).count() == 0
    unlabelled = messy.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert langid.identified(unlabelled).count() == messy.count()
    assert {r["language"] for r in langid.languages(unlabelled, langid.fitted(unlabelled)).collect()} == {"und"}


def test_more_languages_than_bits(spark, monkeypatch):
    """150 labels; the same shares where planes are of another width."""
    texts = {f"l{i:03}": [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}{chr(97 + i % 7)}xq" for j in range(20))] * 4 for i in range(150)}
    column = pa.array([t[0] for t in texts.values()])
    model = filter_of(texts)
    name, share, _ = model.decide(column)
    assert name == sorted(texts) and len(model.planes) == 3
    monkeypatch.setattr(langid, "PLANE", 8)
    again = filter_of(texts).decide(column)
    assert again[0] == name and (again[1] == share).all()
    monkeypatch.undo()
    df = spark.createDataFrame([(i, t[0], x) for i, (x, t) in enumerate(texts.items())] * 4, "doc_id long, text string, lang string")
    fit = langid.fitted(df)
    assert {r["doc_id"]: r["language"] for r in langid.languages(df, fit).collect()} == dict(enumerate(texts))
    assert langid.identified(df, fit).count() == 600


ENGLISH = "these words were written to be read by those who like plain words "


def test_a_batch_of_long_texts_is_sent_in_parts():
    """6 MB in one batch: before, its kept rows came back as one batch and its lowered texts stood beside it."""
    model = SimpleNamespace(value=langid.LanguageFilter({"en": np.unique(langid.grams(*langid.strings(pa.array([ENGLISH])), 0, 1)[0])}))
    texts = [ENGLISH.upper() * 400, None, "漢字 " * 200, ENGLISH * 400] * (6_000_000 // (800 * len(ENGLISH)))
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})
    out = list(langid._known(model)([batch]))
    assert [x for part in out for x in part.column("doc_id").to_pylist()] == [i for i in range(len(texts)) if i % 4 in (0, 3)]
    assert max(sum(len(t) for t in part.column("text").to_pylist()) for part in out) <= 1 << 20
