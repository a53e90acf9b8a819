"""SentencePiece models run by the `tokenizers` library.

Method: the model file (a protobuf) is parsed here, without generated code; normaliser, metaspace marker, scores and byte
fallback are rebuilt from it. A unigram model becomes a Unigram with its scores, a BPE model a BPE whose merges are the
ways to join two pieces into a third, ordered by the third's score. Texts are encoded in batches with as many threads as
`threads` says (the cores of a task, two at least). `verify` compares with what the file's own library gives.

Where no piece has a marker after another character (checked), no piece can reach over the end of a word: texts are then
cut there, and each distinct word of a batch is encoded once. The result is the same.

Defined results: a null text has null ids, the empty text none; null ids and repeated rows are encoded like others; an
empty table gives an empty result; other columns are ignored. Decoding gives the text back, but for the marker itself,
which becomes a blank, and what a model's normaliser changes.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from .buffers import chunks, range_hashes, strings, tidy
from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
HIDDEN = "\U0010fffd"
THREADS = 2  #: threads of a task at least
BATCH_BYTES = 1 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; values of four and eight bytes are left as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, raw[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    unk: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(raw: bytes) -> Model:
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            if kind == UNKNOWN:
                model.unk = len(model.pieces)
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.squeeze = bool(v)
                elif n == 5:
                    model.escape = bool(v)
    if model.kind not in (1, 2):
        raise ValueError("only unigram and BPE models")
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    usable = {p: (s, i) for i, (p, s, k) in enumerate(model.pieces) if k in (NORMAL, USER)}
    out = []
    for piece, (score, i) in usable.items():
        ways = [(piece[:c], piece[c:]) for c in range(1, len(piece)) if piece[:c] in usable and piece[c:] in usable]
        out += [(-score, i, usable[a][1], usable[b][1], a, b) for a, b in ways]
    return [(a, b) for *_, a, b in sorted(out)]


def separable(model: Model) -> bool:
    """Whether no piece has a marker after another character."""
    return all(MARK not in p.lstrip(MARK) for p, _, k in model.pieces if k in (NORMAL, USER))


def build(model: Model) -> Tokenizer:
    """A tokenizer equal to the model."""
    unk = model.pieces[model.unk][0]
    if model.kind == 1:
        # pieces that no text may match get a name of their own
        named = [(p if k in (NORMAL, USER, BYTE) else f"{HIDDEN}{i}{HIDDEN}", s) for i, (p, s, k) in enumerate(model.pieces)]
        core = models.Unigram(named, unk_id=model.unk, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, _merges(model), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    if model.kind == 2 and separable(model):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    back = [decoders.Replace(MARK, " ")]
    if model.byte_fallback:
        back.append(decoders.ByteFallback())
    back.append(decoders.Fuse())
    if model.kind == 1:
        back += [decoders.Replace(f"{HIDDEN}{model.unk}{HIDDEN}", " ⁇ "), decoders.Replace(Regex(f"{HIDDEN}[0-9]+{HIDDEN}"), "")]
    if model.dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    out.decoder = decoders.Sequence(back)
    return out


def raw_model(path: str = MODEL) -> bytes:
    """The file's bytes, read on the driver: executors get them by broadcast."""
    with open(path, "rb") as f:
        return f.read()


def verify(texts: list[str], path: str = MODEL) -> list[int]:
    """Indexes of texts whose ids differ from those of the file's own library."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)
    size, flat = Encoder(raw_model(path)).encode(pa.array(texts, pa.string()))
    ours = [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])]
    return [i for i, (a, b) in enumerate(zip(theirs, ours)) if a != b]


class Encoder:
    """Encodes columns of texts.

    Where no piece reaches over the marker, a text's ids are those of its units (blanks and what follows up to the next
    blank) one after the other: each distinct unit is encoded once and kept, at most `room` of them, then forgotten all.
    Other models encode whole texts.
    """

    def __init__(self, raw: bytes, threads: int = THREADS, room: int = 1 << 20):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        self.model = parse(raw)
        self.tool, self.room = build(self.model), room
        plain = not self.model.charsmap and not self.model.squeeze and self.model.dummy_prefix and self.model.escape
        self.by_unit = plain and separable(self.model)
        self.unit_tool = build(self.model)
        self.unit_tool.normalizer = normalizers.Replace(" ", MARK)
        self.unit_tool.pre_tokenizer = None
        self._forget()

    def _forget(self) -> None:
        self.seat: dict[bytes, int] = {}
        self.at, self.size, self.pool, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1024, np.int32), 0

    def _learn(self, units: list[bytes]) -> None:
        ids = [x.ids for x in self.unit_tool.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
        self.pool[self.used : self.used + len(flat)] = flat
        for u in units:
            self.seat[u] = len(self.seat)
        self.at = np.concatenate([self.at, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used += len(flat)

    def _by_unit(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(off)
        full = n > 0
        start = off[:-1][full] + np.arange(full.sum())  # a blank goes before each text that isn't empty
        wide = np.full(len(data) + len(start), 32, np.uint8)
        inside = np.ones(len(wide), bool)
        inside[start] = False
        wide[inside] = data
        blank = wide == 32
        edge = blank.copy()
        edge[1:] &= ~blank[:-1]
        edge[start] = True
        edge = np.flatnonzero(edge)
        end = np.append(edge[1:], len(wide))
        _, first, unit = np.unique(range_hashes(wide, edge, end), return_index=True, return_inverse=True)
        raw = wide.tobytes()
        units = [raw[a:b] for a, b in zip(edge[first].tolist(), end[first].tolist())]
        if len(self.seat) + len(units) > self.room:
            self._forget()
        new = [u for u in units if u not in self.seat]
        if new:
            self._learn(new)
        seat = np.fromiter((self.seat[u] for u in units), np.int64, len(units))[unit]
        size, at = self.size[seat], self.at[seat]
        flat = self.pool[np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())]
        total = np.concatenate([[0], np.cumsum(size)])
        border = np.searchsorted(edge, np.append(start, len(wide)))
        count = np.zeros(len(n), np.int64)
        count[full] = np.diff(total[border])
        return count, flat

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids; null counts as the empty text."""
        if not self.by_unit:
            ids = [x.ids for x in self.tool.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.int32)
        off, data = strings(column)
        return self._by_unit(off, data)


def _encoded(held, threads: int, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Encoder(held.value, threads)
        for batch in batches:
            off, _ = strings(batch.column("text"))
            for i, j in chunks(off, BATCH_BYTES):
                text = batch.column("text").slice(i, j - i)
                size, flat = tool.encode(text)
                null = text.is_null() if text.null_count else None
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat), mask=null)
                out, names = [batch.column("doc_id").slice(i, j - i), pa.array(size, pa.int32()), values], ["doc_id", "n_tokens", "ids"]
                if check:
                    back = tool.tool.decode_batch(np.split(flat, np.cumsum(size)[:-1]), skip_special_tokens=False)
                    out.append(pc.equal(pa.array(back, pa.string()), pc.fill_null(text, "")))
                    names.append("restored")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def encoded(docs: DataFrame, path: str = MODEL, threads: int | None = None, check: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; with check also `restored`: whether decoding gives the text back."""
    if threads is None:
        threads = max(THREADS, int(docs.sparkSession.conf.get("spark.task.cpus", "1")))
    held = docs.sparkSession.sparkContext.broadcast(raw_model(path))
    schema = "doc_id long, n_tokens int, ids array<int>" + ", restored boolean" * check
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_encoded(held, threads, check)), schema)


def _decoded(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = build(parse(held.value))
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            text = tool.decode_batch([x or [] for x in ids], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if x is None else t for x, t in zip(ids, text)], pa.string())], ["doc_id", "text"])

    return run


def decoded(ids: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids)."""
    held = ids.sparkSession.sparkContext.broadcast(raw_model(path))
    return ids.select("doc_id", "ids").mapInArrow(tidy(_decoded(held)), "doc_id long, text string")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), check=True)
