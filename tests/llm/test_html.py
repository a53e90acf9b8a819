import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from tests.conftest import DATA
from pyspark.sql import functions as F
from tessera.llm import html as H


@pytest.fixture(scope="module")
def model(spark):
    return H.trained(spark.read.parquet(str(DATA / "sf0.01/pages.parquet")).where("page_id < 120"), 100, 120)


def test_held_out_accuracy(model):
    pages = pq.read_table(DATA / "sf0.01/pages.parquet").to_pydict()["html"][120:]
    rng = np.random.default_rng(77)
    for plain in (False, True):
        right = total = 0
        for page in pages:
            _, found = H.leaves(page)
            score = model.scores(H.features(found, plain), np.array([len(found)]))
            right += ((score >= 0.5) == [p.label == 1 for p, _ in found]).sum()
            total += len(found)
        assert right / total > 0.97
    right = total = 0
    for page, labels in (H.made_page(rng) for _ in range(60)):
        (_, own), = H.labelled([page], model)
        right += sum((s >= 0.5) == bool(y) for (_, s), y in zip(own, labels))
        total += len(labels)
    assert right / total > 0.9


def test_batches_as_single_steps(model):
    """The batched network against one cell at a time."""
    pages = pq.read_table(DATA / "sf0.01/pages.parquet").to_pydict()["html"][:20]
    sig = lambda z: 1 / (1 + np.exp(-z))
    for page, (_, own) in zip(pages, H.labelled(pages, model)):
        _, found = H.leaves(page)
        x = H.features(found).astype(float)
        logit, n = np.full(len(x), float(model.p["b"][0])), model.hidden
        for k, side in enumerate("ab"):
            h, c = np.zeros(n), np.zeros(n)
            for t in range(len(x)) if side == "a" else reversed(range(len(x))):
                z = x[t] @ model.p[f"x{side}"] + model.p[f"c{side}"] + h @ model.p[f"w{side}"]
                i, f, o, g = sig(z[:n]), sig(z[n : 2 * n]), sig(z[2 * n : 3 * n]), np.tanh(z[3 * n :])
                c = f * c + i * g
                h = o * np.tanh(c)
                logit[t] += h @ model.p["v"][k * n : (k + 1) * n]
        assert np.allclose(sig(logit), [s for _, s in own], atol=1e-4)


def test_gradients():
    rng = np.random.default_rng(0)
    m = H.Labeller(4)
    x = rng.standard_normal((9, H.PATH + H.WORDS)).astype(np.float32)
    args = x, np.array([4, 5]), np.array([0, 1, 1, 0, -1, 1, 0, 1, 1], np.float32)
    _, grad = m.gradients(*args)
    for k, g in grad.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        m.p[k][at] += 1e-2
        up, _ = m.gradients(*args)
        m.p[k][at] -= 2e-2
        down, _ = m.gradients(*args)
        m.p[k][at] += 1e-2
        assert abs((up - down) / 2e-2 - g[at]) < 1e-3


def test_leaves():
    title, found = H.leaves('<TITLE> a &amp; b </TITLE><p>one<p>two <b>bold</b> end<br>next<ul><li>x<li class="y z">q</ul><script>"</p>"</script><!-- <p>no --><div id=m>t</div></p>tail &lt;')
    assert title == "a & b"
    assert [t for _, t in found] == ["one", "two bold end", "next", "x", "q", "t", "tail <"]
    assert found[4][0].path() == ("ul", "li", "li.y", "li.z") and found[5][0].path()[-2:] == ("div", "div.m")
    for broken in ("", "<", "<p", "a<b>c", "</p></p>", '<a href="x>y', "<!--", "<script>x", "<p <p>z", "&#x110000;", "plain text"):
        H.leaves(broken)
    assert [t for _, t in H.leaves("plain text")[1]] == ["plain text"]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert [t for _, t in H.leaves(deep)[1]] == ["x"]


def test_paths_and_labels_of_deep_leaves():
    """What decides lies more than a thousand elements above."""
    _, found = H.leaves("<article>" + "<div>" * 2000 + "inner" + "</div>" * 2000 + "</article><nav class=x>" + "<div>" * 1500 + "outer")
    assert [(t, p.label) for p, t in found] == [("inner", 1), ("outer", 0)]
    for plain in (False, True):
        for place, _ in found:
            want = np.zeros(H.PATH)
            for t in (("div" if x in H._SEMANTIC else x for x in place.path() if "." not in x) if plain else place.path()):
                want[H._bucket(t)] += 1
            assert (place.counts(plain) == want).all()
    assert [p.label for p, _ in H.leaves('<div class="side-nav">a</div><main><p>b<div id="ad_1">c</div></main>d')[1]] == [0, 1, 0, -1]


@pytest.mark.parametrize(
    "page",
    [
        "<div class='" * 100_000,
        "<div class='" * 100_001 + ">",
        "<b>" * 100_000 + "</i>" * 100_000,
        "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000,
        "<h1>" * 100_000 + "<li></li>" * 100_000,
        "<script " * 100_000,
        "<script>" * 100_000,
        "<div>x" * 100_000,
        "<a \"<b '>\" " * 50_000,
        "<!" * 100_000,
        "</script " * 100_000 + ">",
        "<title>" * 50_000,
    ],
    ids=range(12),
)
def test_time_is_linear(page):
    began = time.process_time()
    _, found = H.leaves(page)
    H.features(found)
    assert time.process_time() - began < 4


def test_rows(spark, model):
    page = pq.read_table(DATA / "sf0.01/pages.parquet").to_pydict()["html"][130]
    rows = [(1, page), (1, page), (2, None), (3, ""), (None, page), (4, "   "), (5, "<p>" + "word " * 200_000 + "</p>"), (6, "<p>x</p>" * 3000), (7, "no tags")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({c: F.lit("c") for c in ("text", "title", "n_blocks", "url")})
    got = H.extracted(df, model).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[2]["text"] == "" and by[2]["n_blocks"] == 0 and by[2]["title"] is None and by[3]["n_blocks"] == 0
    want = [t for p, t in H.leaves(page)[1] if "article" in p.path()]
    assert by[1]["text"].split("\n") == want and by[1] == by[1] and by[None]["text"] == by[1]["text"]
    assert by[6]["n_blocks"] == 3000
    assert H.extracted(df.limit(0)).count() == 0
