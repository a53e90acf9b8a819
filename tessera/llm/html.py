"""Main text of web pages by a recurrent block labeller.

Method: a page is read as the sequence of its leaves: runs of text between the borders of block elements (inline elements
do not cut a run; comments, scripts and styles are no text). A leaf's input is the vector of its tag path (each open
element's name, and name with each of its classes and id, hashed into PATH buckets; however deep it lies, for an element adds its
own to what its parent has) beside the vector of its words (hashed into WORDS buckets, divided by the root of their number). A bidirectional LSTM in numpy reads the whole sequence in both
directions, so every leaf is classified in the context of the whole document. Pages of one batch run together, ordered by
length, and no page is cut, however many leaves it has.

The network is trained on the driver with Adam and full back-propagation through time on a bounded sample: at most
`train_pages` pages (those of the least hash of the id, of at most `train_chars` characters each) and `made_pages` invented
ones with layouts of many kinds. The labels of sampled leaves come from the page's own markup (article and main against
nav, footer, aside, header, form and classes such as ad or menu; leaves without such a hint don't count); each sampled page
is also shown with those hints taken away, so that words, remaining tags and context must do. What is broadcast is the
network: its size is fixed.

Defined results, one row for each row: (page_id, title, text, n_blocks, n_content). text joins the content leaves by line
feeds; white space inside a leaf counts as one blank; null or empty html, or html without text, has the empty text and no
blocks; without a title element title is null. Null ids are kept, repeated rows are extracted each; other columns are
ignored; an empty table gives an empty result (the network is then trained on invented pages alone). Unclosed elements end
where a new block of their kind begins, or with the page; end tags without a start are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import U64, Words, chunks, strings, tidy
from .common import table

TRAIN_PAGES = 300
MADE_PAGES = 200
TRAIN_CHARS = 60_000
PATH, WORDS, HIDDEN = 64, 64, 24
EPOCHS = 14
PAGES_AT_ONCE = 512
LIMIT = 0.5
QUOTED_SCANS = 8  #: so often a page is read to its end for the end of a tag whose quotes don't match; later ones end at the next >

_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)")
_QUOTED = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_RAW = {x: re.compile(rf"</{x}\s*+>", re.IGNORECASE) for x in ("script", "style", "noscript", "template", "svg", "iframe", "title")}
_MARKS = re.compile(r"\b(class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i img ins kbd mark q s samp small span strong sub sup time tt u var wbr del label".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that a start of the same group ends
_ENDS = {x: frozenset(g.split()) for g in ("li", "dt dd", "option", "tr", "td th", "thead tbody tfoot") for x in g.split()}
_FENCE = frozenset("table ul ol dl select body html article section div main".split())
_SEMANTIC = frozenset("article main nav footer aside header form".split())
_AGAINST = frozenset("nav footer aside header form button select".split())
_HINTS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs cookie copyright footer menu nav navbar navigation promo related share sidebar social widget".split())


@lru_cache(maxsize=65536)
def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % PATH


def _read(name: str, attributes: str) -> tuple[tuple[str, ...], bool]:
    """Tokens of an element, and whether its classes or id say that it is no content."""
    out, hinted = [name], False
    for _, value in _MARKS.findall(attributes):
        for x in value.strip("\"'").lower().split():
            out.append(f"{name}.{x}")
            hinted |= not _HINTS.isdisjoint(re.split(r"[-_.]", x))
    return tuple(out), hinted


_read_short = lru_cache(maxsize=4096)(_read)


class Element:
    """An open element; what it has with all it lies in is counted once, on demand."""

    __slots__ = ("parent", "name", "tokens", "label", "_counts", "_plain")

    def __init__(self, parent: Element | None, name: str, attributes: str):
        self.parent, self.name, self._counts, self._plain = parent, name, None, None
        if parent is None:
            self.tokens, self.label = (), -1
            self._counts = self._plain = np.zeros(PATH, np.float32)
            return
        self.tokens, hinted = (_read_short if len(attributes) < 200 else _read)(name, attributes)
        #: 1 content, 0 not, -1 unknown, from the markup alone
        self.label = 0 if not parent.label or hinted or name in _AGAINST else 1 if parent.label == 1 or name in ("article", "main") else -1

    def counts(self, plain: bool = False) -> np.ndarray:
        """Tokens of the path by bucket; plain: without what labels are made from."""
        slot, chain, at = "_plain" if plain else "_counts", [], self
        while getattr(at, slot) is None:
            chain.append(at)
            at = at.parent
        sums = getattr(at, slot)
        for e in reversed(chain):
            sums = sums.copy()
            for t in ("div" if e.name in _SEMANTIC else e.name,) if plain else e.tokens:
                sums[_bucket(t)] += 1
            setattr(e, slot, sums)
        return sums

    def path(self) -> tuple[str, ...]:
        """All tokens, outermost element first."""
        chain, at = [], self
        while at is not None:
            chain.append(at.tokens)
            at = at.parent
        return tuple(t for own in reversed(chain) for t in own)


class _Open:
    """The open elements, with how many of each name there are: at all, in the innermost run of inline elements, and behind
    the innermost fence. So an end tag that ends nothing costs nothing, however many elements are open."""

    def __init__(self):
        self.stack = [Element(None, "", "")]
        self.all: dict[str, int] = {}
        self.runs: list[dict[str, int]] = [{}]
        self.fences: list[dict[str, int]] = [{}]

    def push(self, name: str, attributes: str) -> None:
        self.stack.append(Element(self.stack[-1], name, attributes))
        self.all[name] = self.all.get(name, 0) + 1
        if name in _INLINE:
            self.runs[-1][name] = self.runs[-1].get(name, 0) + 1
        else:
            self.runs.append({})
        if name in _FENCE:
            self.fences.append({})
        else:
            self.fences[-1][name] = self.fences[-1].get(name, 0) + 1

    def pop(self) -> str:
        name = self.stack.pop().name
        self.all[name] -= 1
        if name in _INLINE:
            self.runs[-1][name] -= 1
        else:
            self.runs.pop()
        if name in _FENCE:
            self.fences.pop()
        else:
            self.fences[-1][name] -= 1
        return name

    def end(self, name: str) -> None:
        """Closes the innermost element of this name; an inline one is sought among the inline ones behind the last block."""
        if (self.runs[-1] if name in _INLINE else self.all).get(name):
            while self.pop() != name:
                pass

    def begin(self, name: str) -> None:
        """Closes what the start of a block ends."""
        while len(self.stack) > 1 and (self.stack[-1].name in _INLINE or self.stack[-1].name == "p"):
            self.pop()
        group = _ENDS.get(name, ())
        if any(self.fences[-1].get(x) for x in group):
            while self.pop() not in group:
                pass


def leaves(html: str) -> tuple[str | None, list[tuple[Element, str]]]:
    """Title, and (innermost element, text) of each leaf; one pass, linear in the length of the page."""
    opened = _Open()
    out: list[tuple[Element, str]] = []
    held: list[str] = []
    place = opened.stack[0]
    title, at, seek, last, scans = None, 0, 0, html.rfind(">"), QUOTED_SCANS

    def cut() -> None:
        if held:
            text = "".join(held)
            text = " ".join((unescape(text) if "&" in text else text).split())
            held.clear()
            if text:
                out.append((place, text))

    while (begin := html.find("<", seek)) >= 0:
        seek = begin + 1
        name = attributes = ""
        closing = False
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            end = len(html) if end < 0 else end + 3
        elif begin > last:
            if html.find("<!--", begin) < 0:
                break
            continue
        elif html.startswith(("<!", "<?"), begin):
            end = html.find(">", begin) + 1
        elif m := _NAME.match(html, begin):
            name, closing = m[1].lower(), html[begin + 1] == "/"
            raw = not closing and name in _RAW
            quoted = None if raw or not scans else _QUOTED.match(html, m.end())
            if quoted:
                attributes, end = quoted[1], quoted.end()
            else:
                scans -= not raw and scans > 0
                end = html.find(">", begin) + 1
                attributes = html[m.end() : end - 1]
        else:
            continue
        if begin > at:
            piece = html[at:begin]
            if held:
                held.append(piece)
            elif not piece.isspace():
                place = opened.stack[-1]
                held.append(piece)
        at = seek = end
        if not name:
            continue
        if not closing and name in _RAW:
            stop = _RAW[name].search(html, end)
            if title is None and name == "title" and len(opened.stack) <= 3:
                title = " ".join(unescape(html[end : stop.start() if stop else len(html)]).split())
            at = seek = stop.end() if stop else len(html)
            continue
        inline = name in _INLINE
        if not inline:
            cut()
        if closing:
            opened.end(name)
            continue
        if name in _VOID:
            continue
        if not inline:
            opened.begin(name)
        if not attributes.endswith("/"):
            opened.push(name, attributes)
    if at < len(html):
        if not held:
            place = opened.stack[-1]
        held.append(html[at:])
    cut()
    return title, out


def features(found: list[tuple[Element, str]], plain: bool = False) -> np.ndarray:
    """One row of PATH + WORDS numbers for each leaf."""
    n = len(found)
    out = np.zeros((n, PATH + WORDS), np.float32)
    if not n:
        return out
    for k, (place, _) in enumerate(found):
        out[k, :PATH] = place.counts(plain)
    off, data = strings(pa.array([t for _, t in found], pa.large_string()))
    for i, j in chunks(off):
        words = Words(off, data, i, j)
        where = words.row() * WORDS + (words.hashes(11) % U64(WORDS)).astype(np.int64)
        counts = np.bincount(where, minlength=(j - i) * WORDS).reshape(j - i, WORDS)
        out[i:j, PATH:] = counts / np.sqrt(np.maximum(words.count, 1))[:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def steps(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of time, forwards and backwards, for sequences of these sizes; how many go on at each step."""
    order = np.argsort(-size, kind="stable")
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    seat = np.empty(len(size), np.int64)
    seat[order] = np.arange(len(size))
    who = np.repeat(seat, size)
    ahead = np.lexsort((who, place))
    back = np.lexsort((who, np.repeat(size, size) - 1 - place))
    return ahead, back, np.bincount(place)


def _lstm(x: np.ndarray, live: np.ndarray, w: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Outputs, in order of time, for inputs x (already times their weights)."""
    size = w.shape[0]
    out = np.empty((len(x), size), np.float32)
    h, c, at = np.zeros((live[0], size), np.float32), np.zeros((live[0], size), np.float32), 0
    for k in live:
        z = x[at : at + k] + h[:k] @ w
        gate, g = _sigmoid(z[:, : 3 * size]), np.tanh(z[:, 3 * size :])
        before = c[:k]
        c = gate[:, size : 2 * size] * before + gate[:, :size] * g
        t = np.tanh(c)
        last, h = h[:k], gate[:, 2 * size :] * t
        out[at : at + k] = h
        if keep is not None:
            keep.append((gate, g, before, t, last))
        at += k
    return out


def _lstm_back(d_out: np.ndarray, live: np.ndarray, w: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of w."""
    size, at = w.shape[0], len(d_out)
    dx, dw = np.empty((at, 4 * size), np.float32), np.zeros_like(w)
    dh, dc = np.zeros((0, size), np.float32), np.zeros((0, size), np.float32)
    for k, (gate, g, before, t, last) in zip(live[::-1], kept[::-1]):
        at -= k
        d = d_out[at : at + k].copy()
        d[: len(dh)] += dh
        i, f, o = gate[:, :size], gate[:, size : 2 * size], gate[:, 2 * size :]
        dcell = d * o * (1 - t * t)
        dcell[: len(dc)] += dc
        z = np.concatenate([dcell * g * i * (1 - i), dcell * before * f * (1 - f), d * t * o * (1 - o), dcell * i * (1 - g * g)], 1)
        dx[at : at + k] = z
        dw += last.T @ z
        dh, dc = z @ w.T, dcell * f
    return dx, dw


class Labeller:
    """The network; picklable."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {"v": make(2 * hidden), "b": np.zeros(1, np.float32)}
        for side in "ab":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.p |= {f"x{side}": make(PATH + WORDS, 4 * hidden), f"w{side}": make(hidden, 4 * hidden), f"c{side}": bias}

    def scores(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Probability of being content of each leaf; size: leaves of each page."""
        if not len(x):
            return np.zeros(0, np.float32)
        out = np.full(len(x), self.p["b"][0], np.float32)
        *orders, live = steps(size)
        for n, (side, order) in enumerate(zip("ab", orders)):
            h = _lstm(x[order] @ self.p[f"x{side}"] + self.p[f"c{side}"], live, self.p[f"w{side}"])
            out[order] += h @ self.p["v"][n * self.hidden : (n + 1) * self.hidden]
        return _sigmoid(out)

    def gradients(self, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss over leaves with a label (y of 0 or 1, others count for nothing), and its gradients."""
        *orders, live = steps(size)
        logit, runs = np.full(len(x), self.p["b"][0], np.float32), []
        for n, (side, order) in enumerate(zip("ab", orders)):
            kept: list = []
            h = _lstm(x[order] @ self.p[f"x{side}"] + self.p[f"c{side}"], live, self.p[f"w{side}"], kept)
            logit[order] += h @ self.p["v"][n * self.hidden : (n + 1) * self.hidden]
            runs.append((side, order, h, kept))
        known = y >= 0
        n = max(1, int(known.sum()))
        loss = float((np.logaddexp(0, logit) - y * logit)[known].sum()) / n
        d = (np.where(known, _sigmoid(logit) - y, 0) / n).astype(np.float32)
        grad = {"b": np.array([d.sum()], np.float32)}
        parts = []
        for n, (side, order, h, kept) in enumerate(runs):
            v = self.p["v"][n * self.hidden : (n + 1) * self.hidden]
            parts.append(h.T @ d[order])
            dx, grad[f"w{side}"] = _lstm_back(d[order][:, None] * v, live, self.p[f"w{side}"], kept)
            grad[f"x{side}"], grad[f"c{side}"] = x[order].T @ dx, dx.sum(0)
        grad["v"] = np.concatenate(parts)
        return loss, grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 9) -> Labeller:
        """Adam on (features, labels) of pages, in batches of pages of like length."""
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        batches = [pages[i : i + 32] for i in range(0, len(pages), 32)]
        batches = [(np.concatenate([p[0] for p in b]), np.array([len(p[0]) for p in b]), np.concatenate([p[1] for p in b])) for b in batches]
        rng, step = np.random.default_rng(seed), 0
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                step += 1
                _, grad = self.gradients(*batches[b])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5 / (norm + 1e-12))
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return self


def made_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """An invented page and the labels of its leaves."""
    syllables = "ka lo mi ter en ung tion er an the qu es ar vel dro pas li no".split()

    def words(low: int, high: int) -> str:
        picks = rng.integers(0, len(syllables), (rng.integers(low, high + 1), 3)).tolist()
        return " ".join("".join(syllables[s] for s in word[: 1 + word[0] % 3]) for word in picks)

    parts, labels = [], []

    def add(html: str, *own: int) -> None:
        parts.append(html)
        labels.extend(own)

    def links(n: int, outer: str, inner: str) -> None:
        add(f"<{outer}>" + "".join(f'<{inner}><a href="/x">{words(1, 3)}</a></{inner}>' for _ in range(n)) + f"</{outer.split()[0]}>", *[0] * n)

    semantic = rng.random() < 0.5
    name = lambda tag, cls: (tag, tag) if semantic else (f'div class="{cls}"' if rng.random() < 0.5 else "div", "div")
    if rng.random() < 0.6:
        o, c = name("header", "top")
        add(f"<{o}><h2>{words(1, 4)}</h2></{c}>", 0)
    if rng.random() < 0.9:
        o, c = name("nav", "menu")
        add(f"<{o}>")
        links(int(rng.integers(2, 9)), "ul", "li")
        add(f"</{c}>")
    if rng.random() < 0.5:
        add(f'<div class="ad">{words(2, 12)}</div>', 0)
    o, c = name("article", "content")
    add(f"<{o}>")
    if rng.random() < 0.9:
        add(f"<h1>{words(2, 12)}</h1>", 1)
    for _ in range(int(rng.integers(1, 12))):
        kind = rng.random()
        if kind < 0.75:
            add(f"<p>{words(8, 80)}. {words(3, 40)}.</p>", 1)
        elif kind < 0.82:
            add(f"<h2>{words(2, 6)}</h2>", 1)
        elif kind < 0.9:
            n = int(rng.integers(2, 5))
            add("<ul>" + "".join(f"<li>{words(5, 20)}</li>" for _ in range(n)) + "</ul>", *[1] * n)
        else:
            add(f"<blockquote>{words(8, 40)}</blockquote>", 1)
    add(f"</{c}>")
    if rng.random() < 0.4:
        o, c = name("aside", "sidebar")
        add(f"<{o}>")
        links(int(rng.integers(2, 7)), "div", "div")
        add(f"</{c}>")
    if rng.random() < 0.8:
        o, c = name("footer", "footer")
        add(f"<{o}>&copy; {words(2, 16)}</{c}>", 0)
    return f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(parts)}</body></html>", labels


def trained(pages: DataFrame | None, train_pages: int = TRAIN_PAGES, made_pages: int = MADE_PAGES, train_chars: int = TRAIN_CHARS) -> Labeller:
    """A network fitted on at most `train_pages` pages, each of at most `train_chars` characters, and `made_pages` invented ones."""
    data = []
    rng = np.random.default_rng(3)
    for _ in range(made_pages):
        html, labels = made_page(rng)
        _, found = leaves(html)
        data.append((features(found), np.array(labels, np.float32)))
    if pages is not None:
        usable = pages.where("page_id IS NOT NULL AND html IS NOT NULL").where(F.length("html") <= train_chars)
        ids = [r[0] for r in usable.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages).collect()]
        chosen = usable.where(F.col("page_id").isin(ids)).dropDuplicates(["page_id"]).select("html") if ids else usable.limit(0)
        for row in chosen.collect():
            _, found = leaves(row["html"])
            y = np.array([place.label for place, _ in found], np.float32)
            data += [(features(found), y), (features(found, plain=True), y)]
    return Labeller().fit(data)


def labelled(htmls: list[str | None], model: Labeller) -> list[tuple[str | None, list[tuple[str, float]]]]:
    """Title, and (text, probability) of each leaf, of each page."""
    out = []
    for k in range(0, len(htmls), PAGES_AT_ONCE):
        found = [leaves(h or "") for h in htmls[k : k + PAGES_AT_ONCE]]
        flat = [x for _, own in found for x in own]
        size = np.array([len(own) for _, own in found], np.int64)
        score = model.scores(features(flat), size[size > 0]).tolist()
        at = 0
        for title, own in found:
            out.append((title, list(zip((t for _, t in own), score[at : at + len(own)]))))
            at += len(own)
    return out


def _extract(held, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, _ = strings(batch.column("html"))
            for i, j in chunks(off):
                rows = labelled(batch.column("html").slice(i, j - i).to_pylist(), held.value)
                kept = [[t for t, s in own if s >= limit] for _, own in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id").slice(i, j - i),
                        pa.array([t for t, _ in rows], pa.string()),
                        pa.array(["\n".join(x) for x in kept], pa.string()),
                        pa.array([len(own) for _, own in rows], pa.int32()),
                        pa.array([len(x) for x in kept], pa.int32()),
                    ],
                    ["page_id", "title", "text", "n_blocks", "n_content"],
                )

    return run


def extracted(pages: DataFrame, model: Labeller | None = None, limit: float = LIMIT) -> DataFrame:
    """(page_id, title, text, n_blocks, n_content) of every row."""
    held = pages.sparkSession.sparkContext.broadcast(model or trained(pages))
    schema = "page_id long, title string, text string, n_blocks int, n_content int"
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(tidy(_extract(held, limit)), schema)


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
