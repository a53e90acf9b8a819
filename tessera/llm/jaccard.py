"""Near duplicates: documents whose sets of word n-grams have a Jaccard similarity of at least `threshold`.

Method: vertical partitioning. The global order of n-grams is cut into fragments; each fragment holds, of every set,
the segment of its n-grams that falls there; overlaps are counted inside each fragment on its own and summed per pair.

1. Map: a document's n-grams as a sorted set of hashes, and the set's signature of 64 bits. Documents with one and the same
   set are a single entity from here on: (doc_id, signature) is written as a narrow table, and of each signature a batch
   sends one set only, so a group of copies of any size costs a fragment as many sets as there are batches, and is counted
   by Spark's own aggregation (combined before the shuffle). Packed segments go to the fragment of their hash range.
2. Fragment: the exact number of entities of each n-gram. Those of one entity only cannot add to any overlap and end here
   (on most corpora the bulk); the rest go back to their entity with their frequency (255 at most: it only orders).
3. Entity: in the order (frequency, hash) of all n-grams, two sets that reach the threshold share one of their first
   |x| - ceil(t|x|) + 1. The unique ones fill these places first; where they fill them all, the entity has no partner
   and ends here. The others send their segments out again, places inside that prefix being marked.
4. Fragment: partial overlaps of all pairs that have an n-gram in both prefixes, and of all others where that costs little
   more (rare n-grams, and those that are in a quarter of their entities' prefixes). What is left are frequent n-grams
   outside the prefix (boilerplate inside long documents): to pair them would cost the square of their frequency, so they
   are looked up only for pairs that the others found. Pairs of too different sizes are dropped.
5. The partial overlaps are summed per pair, what was looked up is added where it can decide, and the sum is compared with
   the threshold.

Near copies are as many pairs as the square of their number, so their pairs are not sent where only classes are asked for: an n-gram meets
in the fragment that the most frequent label of its entities names (a hash of an entity's least n-gram, which near copies share), there a pair's
overlap is counted whole, and where it decides, only numbers of links and a spanning forest go on.

N-grams of more than HOT documents (a sample of documents names them; it steers only the way they take, never the result)
do not go to the fragment of their hash, which they alone could overfill: they count as of the highest frequency, their
postings are spread by entity, and only those inside a prefix meet.

`classes` gives one row for each document: the lowest id of its connected group, and with how many other documents it is
linked. Copies are not expanded into pairs. No step has a cap.

Defined results: words are runs of letters, digits and non-ASCII characters of the lower-cased text; a text of fewer than
`n` words has one n-gram of all its words; rows that repeat an id and a set count once, rows that repeat an id with
another set are documents of their own; null ids give no rows; null texts and texts without words are classes of their own
without links; an empty table gives an empty result; other columns are ignored. n-grams are compared by hashes of 40 bits
within a fragment of about 16 million, sets by signatures of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buffers import ALNUM, U64, Words, by_group, mix, pack, pieces, spans, tidy, tidy_group, tidy_groups, unpack
from .common import checkpointed, power_of_two, small_batches, stored, table

GRAM = 5
THRESHOLD = 0.5
POSTINGS_A_FRAGMENT = 16_000_000
PASSES = 32  #: a fragment's postings are grouped in so many parts by their hashes, one after the other
HOMES = 8  #: groups of entities for each fragment
RARE = 8
PAIRS_AT_ONCE = 300_000
PAIRS_HELD = 1_500_000  #: pairs of a fragment that are summed there; beyond, partial sums are sent on
POSTINGS_HELD = 500_000  #: the same for postings that go back to their entity
ROWS_AT_ONCE = 200_000  #: rows of a batch of partial overlaps
ROWS_A_FILE = 1_000_000  #: partial overlaps of a stored file: what a task sums before the shuffle
GRAMS_AT_ONCE = 1_000_000
BROADCAST_IDS = 2_000_000
KEYS = 4096  #: groups that a batch sends to at most; more fragments are parted in a second step
REGROUP_BYTES = 64 << 20
HOT = 4_000_000  #: documents of an n-gram from which its postings are spread by entity
HOT_SAMPLE = 50_000  #: documents that are looked at to find such n-grams
SPREAD = 16_384  #: entities of an n-gram for which near copies are counted in one fragment; twice as many in two, and so on
ROWS_OF_GRID = 128  #: entities of a block of a group of near copies, and cells of what it is multiplied with
CELLS_OF_GRID = 1 << 22
SIGNED = U64((1 << 48) - 1)
LOW = U64((1 << 40) - 1)
BLOBS = pa.schema([("key", pa.int32()), ("blob", pa.binary())])


def _split(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (g & U64(0xFFFFFFFF)).astype(np.uint32), ((g >> U64(32)) & U64(0xFF)).astype(np.uint8)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(U64) | high.astype(U64) << U64(32)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array in order, and how often each occurs: shorter to send than a value for each n-gram."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])
    many = np.diff(np.append(at, len(x)))
    return x[at], many.astype(np.uint8 if not len(many) or many.max() < 256 else np.uint32)


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where a value of sorted arrays differs from the one before."""
    n = len(keys[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _distinct(high: np.ndarray, low: np.ndarray, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order; low has `bits` bits, high is less than `most`. One key of 64 bits where both fit."""
    if bits + max(most - 1, 1).bit_length() <= 64:
        key = np.sort(high.astype(U64) << U64(bits) | low) if bits < 64 else np.sort(low)
        key = key[_new(key)]
        return (key >> U64(bits) if bits < 64 else np.zeros(len(key), U64)).astype(np.int64), key & U64((1 << bits) - 1)
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    fresh = _new(high, low)
    return high[fresh].astype(np.int64), low[fresh]


def gram_sets(words: Words, n: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Row and n-gram hash, distinct, in order of both."""
    h, row = words.hashes(), words.row()
    rows, grams = [], []
    if len(h) >= n:
        inside = words.stop()[: len(h) - n + 1] - np.arange(len(h) - n + 1) >= n
        rows.append(row[: len(inside)][inside])
        grams.append(spans(h, n, n)[inside])
    for c in range(1, n):
        at = words.first[:-1][words.count == c]
        if len(at):
            rows.append(row[at])
            grams.append(spans(h, c, c)[at])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return _distinct(np.concatenate(rows), np.concatenate(grams) >> U64(64 - bits), bits, len(words.count))


def _labelled(sig: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Signatures whose upper 16 bits are a label: a hash of the set's least n-gram, which near copies mostly share."""
    return mix(least, 8) & ~SIGNED | sig & SIGNED


def _entities(batch: pa.RecordBatch, n: int, bits: int):
    """Of each range of rows: row and n-gram of its sets; row, first index, size and signature of each set."""
    for i, j, off, data in pieces(batch.column("text"), lower=True):
        row, g = gram_sets(Words(off, data, 0, j - i, ALNUM), n, bits)
        at = np.flatnonzero(_new(row))
        size = np.diff(np.append(at, len(row)))
        sig = _labelled(mix(np.add.reduceat(mix(g, 5), at) + size.astype(U64), 6), np.minimum.reduceat(mix(g, 7), at)) if len(at) else np.zeros(0, U64)
        yield i, j, g, i + row[at], at, size, sig


def _signatures(n: int, bits: int):
    """(doc_id, sig) of every row; null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, row, _, _, sig in _entities(batch, n, bits):
                own, none = np.zeros(j - i, U64), np.ones(j - i, bool)
                own[row - i], none[row - i] = sig, False
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(own.view(np.int64), mask=none)], ["doc_id", "sig"])

    return run


def _sampled(n: int, bits: int):
    """n-grams of a sample, and in how many of its documents each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, g, *_ in _entities(batch, n, bits):
                name, count = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(count)], ["gram", "n"])

    return run


def hot_grams(docs: DataFrame, rows: int, n: int, bits: int, hot: int = HOT, sample: int = HOT_SAMPLE) -> np.ndarray:
    """n-grams of about `hot` documents or more: 2 rows / hot of a document's size at most."""
    if rows < hot:
        return np.zeros(0, U64)
    part = min(1.0, sample / rows)
    seen = docs.select("text").sample(part, seed=11).mapInArrow(tidy(_sampled(n, bits)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    seen = seen.where(F.col("n") >= max(hot * part, min(hot, 16)))
    return np.sort(np.array([r["gram"] for r in seen.select("gram").toLocalIterator()], np.int64).view(U64))


def _joint(blobs: list[tuple[int, bytes]], width: int) -> pa.RecordBatch:
    """Blobs of `width` successive keys as one row."""
    out: dict[int, list[tuple[int, bytes]]] = {}
    for f, blob in blobs:
        out.setdefault(f // width, []).append((f, blob))
    rows = [pack(np.array([f for f, _ in own], np.int64), np.array([len(b) for _, b in own], np.int64), np.frombuffer(b"".join(b for _, b in own), np.uint8)) for own in out.values()]
    return pa.RecordBatch.from_pydict({"key": list(out), "blob": rows}, BLOBS)


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joint rows, those of a key one after the other, as blobs of single fragments, each made of many batches' parts."""
    held: dict[int, list[bytes]] = {}
    size, last = 0, None

    def merged() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": list(held), "blob": [pack(*(np.concatenate(x) for x in zip(*map(unpack, parts)))) for parts in held.values()]}, BLOBS)

    for batch in batches:
        for key, blob in zip(batch.column("key").to_pylist(), batch.column("blob").to_pylist()):
            if held and (key != last or size > REGROUP_BYTES):
                yield merged()
                held, size = {}, 0
            last, size = key, size + len(blob)
            fragment, length, raw = unpack(blob)
            end = np.cumsum(length).tolist()
            for f, lo, hi in zip(fragment.tolist(), [0, *end], end):
                held.setdefault(f, []).append(raw[lo:hi].tobytes())
    if held:
        yield merged()


def _segments(n: int, fragments: int, hot: np.ndarray, width: int):
    """Segments by fragment; postings of hot n-grams, with their number in place of the hash, by entity behind the fragments.

    width: so many successive keys are sent as one row.
    """
    bits = 40 + fragments.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, parts = 0, []
            for _, _, g, _, at, size, sig in _entities(batch, n, bits):
                if held > GRAMS_AT_ONCE:
                    yield sent(parts)
                    held, parts = 0, []
                held += len(g)
                parts.append((g, size, sig))
            if held:
                yield sent(parts)

    def sent(parts) -> pa.RecordBatch:
        g, size, sig = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        once = np.zeros(len(sig), bool)
        once[np.unique(sig, return_index=True)[1]] = True  # copies are sent once
        g, size, sig = g[np.repeat(once, size)], size[once], sig[once]
        row = np.repeat(np.arange(len(sig), dtype=np.int32), size)
        key = (g >> U64(40)).astype(np.int32)
        if len(hot):
            place = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
            is_hot = hot[place] == g
            key = np.where(is_hot, fragments + (sig[row] & U64(fragments - 1)).astype(np.int32), key)
            g = np.where(is_hot, place.astype(U64), g)
        none, out = np.zeros(0, np.int64), {"key": [], "blob": []}
        own, segment = dict(by_group((sig & U64(fragments - 1)).astype(np.int64))), dict(by_group(key))
        for f in sorted(own.keys() | segment.keys()):
            at, mine = segment.get(f, none), own.get(f, none)
            there, many = _runs(row[at])
            out["key"].append(f)
            out["blob"].append(pack(*_split(g[at]), many, sig[there], sig[mine], size[mine].astype(np.int32)))
        return pa.RecordBatch.from_pydict(out, BLOBS) if width == 1 else _joint(list(zip(out["key"], out["blob"])), width)

    return run


def _of_part(blob: list[np.ndarray], k: int, high: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of a blob's part k of PASSES, their places in the blob, and which of its entities each belongs to."""
    at = np.flatnonzero(blob[high] % PASSES == k)
    return _joined(blob[0][at], blob[1][at]), at, np.searchsorted(np.cumsum(blob[2], dtype=np.int64), at, side="right")


def _meeting(g: np.ndarray, name: np.ndarray, df: np.ndarray, f: int, fragments: int) -> np.ndarray:
    """The fragment in which each n-gram's entities meet; g is in order, with its entities in theirs.

    It is that of their most frequent label (of equals the least), so that what near copies share is counted in one place. N-grams of many entities
    that have no label in common stay where they are: they would bring all of a frequent passage to one fragment.
    """
    at = np.flatnonzero(_new(g, name >> U64(48)))
    first = _new(g[at])
    group = np.cumsum(first) - 1
    run = np.diff(np.append(at, len(g)))
    best = np.lexsort((-run, group))[np.flatnonzero(first)]
    n, many = run[best], df[at[best]]
    pieces = 1 << np.ceil(np.log2(np.maximum(many / SPREAD, 1))).astype(np.int64)
    label = mix(name[at[best]] >> U64(48), 9) + (g[at[best]] & (pieces - 1).astype(U64))
    to = np.where((many <= 255) | (4 * n >= many), (label & U64(fragments - 1)).astype(np.int64), f)
    return to.astype(np.min_scalar_type(fragments - 1))[group].repeat(run)


def _repeated(fragments: int):
    """n-grams of more than one entity go to their entity; so does what identifies it."""
    homes = fragments * HOMES

    def run(key, batches):
        f = min(key[0].as_py(), fragments)
        blobs = [unpack(blob.as_buffer()) for batch in batches for blob in batch.column("blob")]
        own = [np.concatenate(x) for x in zip(*(blob[4:] for blob in blobs))]
        at = np.unique(own[0], return_index=True)[1]
        own = [x[at] for x in own]
        found, held = [], 0
        for k in range(PASSES):
            g, sig = [], []
            for blob in blobs:
                own_g, _, whose = _of_part(blob, k, False)
                g.append(own_g)
                sig.append(blob[3][whose])
            names, index = np.unique(np.concatenate(sig), return_inverse=True)
            g, index = _distinct(np.concatenate(g), index.astype(U64), max(len(names), 1).bit_length(), 1 << 40)
            at = np.flatnonzero(_new(g))
            df = np.diff(np.append(at, len(g)))
            df = np.repeat(df, df) if f < fragments else np.full(len(g), 255)
            more = df > 1
            g, name = g[more].astype(U64), names[index[more].astype(np.int64)]
            to = _meeting(g, name, df[more], f, fragments) if f < fragments else np.zeros(len(g), np.uint8)
            found.append((g, name, np.minimum(df[more], 255).astype(np.uint8), to))
            held += len(found[-1][0])
            if held > POSTINGS_HELD:
                yield sent(f, found, own)
                found, held, own = [], 0, [x[:0] for x in own]
        if held or len(own[0]):
            yield sent(f, found, own)

    def sent(f: int, found, own) -> pa.RecordBatch:
        g, name, df, to = (np.concatenate(x) for x in zip(*found))
        none, keys, blobs = np.zeros(0, np.int64), [], []
        posted, named = dict(by_group(_home(name, homes))), dict(by_group(_home(own[0], homes)))
        for b in sorted(posted.keys() | named.keys()):
            at, mine = posted.get(b, none), named.get(b, none)
            at = at[np.argsort(name[at], kind="stable")]
            there, many = _runs(name[at])
            keys.append(b)
            blobs.append(pack(np.array([f], np.int32), *_split(g[at]), many, there, df[at], *(x[mine] for x in own), to[at]))
        return pa.RecordBatch.from_pydict({"key": keys, "blob": blobs}, BLOBS)

    return run


def _home(sig: np.ndarray, homes: int) -> np.ndarray:
    return (sig >> U64(20) & U64(homes - 1)).astype(np.int32)


def _survivors(fragments: int, threshold: float):
    """Entities that can have a partner send their segments out, with the places inside their prefix marked."""

    def run(key, part):
        g, sig, df, own, met, twice = [], [], [], [], [], []
        for blob in part.column("blob"):
            f, *rest = unpack(blob.as_buffer())
            if len(rest) == 1:
                twice.append((f, *rest))
                continue
            low, high, many, there, freq, *mine, to = rest
            g.append(_joined(low, high) | U64(int(f[0])) << U64(40))
            sig.append(np.repeat(there, many))
            df.append(freq)
            own.append(mine)
            met.append(to)
        if not own:
            return pa.table({"key": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        name, size = (np.concatenate(x) for x in zip(*own))
        names, at = np.unique(name, return_index=True)
        size, copies = size[at].astype(np.int64), np.ones(len(names), np.int32)
        for copied, n in twice:
            copies[np.searchsorted(names, copied)] = n
        g, sig, df, met = np.concatenate(g), np.concatenate(sig), np.concatenate(df), np.concatenate(met)
        who = np.searchsorted(names, sig)
        total = np.bincount(who, minlength=len(names))
        room = total - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
        live = room[who] > 0
        g, who, df, met = g[live], who[live], df[live], met[live]
        order = np.lexsort((g, df, who))
        g, who, met = g[order], who[order], met[order]
        at = np.flatnonzero(_new(who))
        place = np.arange(len(who)) - np.repeat(at, np.diff(np.append(at, len(who))))
        inside = (place < room[who]).astype(np.uint8)
        to = met.astype(np.int64)
        hot = g >> U64(40) == fragments  # inside the prefix to a group of the n-gram, else to one of the entity
        number = (g & LOW).astype(np.int64)
        to = np.where(hot, np.where(inside > 0, 2 * fragments + number, fragments + (names[who] & U64(fragments - 1)).astype(np.int64)), to)
        keys, blobs = [], []
        for f, at in by_group(to):
            there, many = _runs(who[at])
            keys.append(f)
            blobs.append(pack(*_split(g[at]), many, np.packbits(inside[at]), names[there], *(x[there].astype(np.int32) for x in (size, total, copies))))
        return pa.table({"key": pa.array(keys, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _count(sizes: np.ndarray, starts: np.ndarray, who: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (lower * n + higher) of the members of each group, and in how many groups they meet; a pair can come more than once."""
    cost = np.cumsum(sizes * (sizes - 1) // 2)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
        s, z = starts[lo:hi], sizes[lo:hi]
        inner = np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z)
        right = np.repeat(s, z) + inner
        left = np.repeat(np.repeat(s, z), inner) + np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner)
        yield np.unique(who[left] * n + who[np.repeat(right, inner)], return_counts=True)
        lo = hi


def _count_dense(sizes: np.ndarray, starts: np.ndarray, who: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for few large groups that share most members: a product of their incidence matrix."""
    at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    members, index = np.unique(who[at], return_inverse=True)
    column = np.repeat(np.arange(len(sizes)), sizes)
    width, rows = (max(1, (1 << bits) // len(members)) for bits in (22, 20))
    for c in range(0, len(sizes), width):
        grid = np.zeros((len(members), min(width, len(sizes) - c)), np.float32)
        x = (column >= c) & (column < c + width)
        grid[index[x], column[x] - c] = 1
        for r in range(0, len(members), rows):
            both = grid[r : r + rows] @ grid[r:].T
            i, j = np.nonzero(np.triu(both, 1))
            yield members[r + i] * n + members[r + j], both[i, j].astype(np.int64)


def _shared(g: np.ndarray, who: np.ndarray, mark: np.ndarray, n: int, spread: bool):
    """Pairs of entities and counts of what they share, as _count gives them; (entity, n-gram, mark) to be looked up.

    spread: others with these n-grams are elsewhere, so all that are here are looked up too.
    """
    order = np.lexsort((who, g))
    g, who, mark = g[order], who[order], mark[order]
    _, start, many = np.unique(g, return_index=True, return_counts=True)
    marked = np.add.reduceat(mark.astype(np.int64), start) if len(start) else many
    full = (marked > 0) & ((many <= RARE) | (4 * marked >= many)) & (not spread)
    some = ~full & (marked > 1)
    late = np.repeat(~full & ((many > 1) | spread), many)
    late = who[late], g[late], mark[late]
    mark = mark & np.repeat(some, many)
    use = np.repeat(full & (many > 1), many) | mark
    _, start, many = np.unique(g[use], return_index=True, return_counts=True)
    member, large = who[use], many > 256
    found = [_count(many[~large], start[~large], member, n)]
    if large.any():
        found.append(_count_dense(many[large], start[large], member, n))
    return chain(*found), late


def _summed(found: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once with the sum of its counts (at most 2^32 - 1); pairs are less than `most`. Empties the list, for memory's sake."""
    bits = 64 - max(most - 1, 1).bit_length()
    small = max((int(x[1].max()) for x in found if len(x[1])), default=0) < 1 << max(bits, 0)
    if small:  # both in one word, which is sorted in place
        key = np.empty(sum(len(x[0]) for x in found), U64)
        at = 0
        while found:
            pair, count = found.pop()
            key[at : at + len(pair)] = pair.astype(U64) << U64(bits) | count.astype(U64)
            at += len(pair)
        key.sort()
        count = (key & U64((1 << bits) - 1)).astype(np.uint32)
        key >>= U64(bits)
    else:
        key, count = (np.concatenate(x) for x in zip(*found))
        found.clear()
        order = np.argsort(key)
        key, count = key[order], count[order]
    start = np.flatnonzero(_new(key))
    return key[start].astype(np.int64), np.add.reduceat(count, start) if len(start) else count


def _overlaps(fragments: int, threshold: float, hot: int):
    """Partial overlaps of a fragment, and the n-grams that are only to be looked up: twice their number, odd inside the prefix."""

    def run(key, batches):
        f = key[0].as_py()
        blobs = [unpack(blob.as_buffer()) for batch in batches for blob in batch.column("blob")]
        name, size = (np.concatenate(x) for x in zip(*(blob[4:6] for blob in blobs)))
        names, at = np.unique(name, return_index=True)
        size, n = size[at].astype(np.int64), len(names)
        del name, at
        blobs = [[*blob[:4], np.searchsorted(names, blob[4]).astype(np.int32)] for blob in blobs]

        def part(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            found = []
            for blob in blobs:
                g, at, whose = _of_part(blob, k, True)
                found.append((g, blob[4][whose], np.unpackbits(blob[3], count=len(blob[0]))[at]))
            g, who, mark = (np.concatenate(x) for x in zip(*found))
            return g, who.astype(np.int64), mark.astype(bool)

        def ranges(rows: int) -> Iterator[slice]:
            return (slice(lo, lo + ROWS_AT_ONCE) for lo in range(0, rows, ROWS_AT_ONCE))

        def sent(a: np.ndarray, b: np.ndarray | None, n: np.ndarray | int, gram: np.ndarray | int) -> pa.RecordBatch:
            full = lambda x: np.broadcast_to(np.asarray(x, np.int64), len(a)).copy()
            other = (0, 0) if b is None else (names.view(np.int64)[b], size[b])
            rows = [names.view(np.int64)[a], full(other[0]), size[a], full(other[1]), full(n), full(gram)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["a", "b", "size_a", "size_b", "n", "gram"])

        def paired(pair: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
            for x in ranges(len(pair)):
                yield sent(pair[x] // n, pair[x] % n, total[x], 0)

        found, held, last = [], 0, 0
        for k in range(PASSES):
            g, who, mark = part(k)
            if not len(g):
                continue
            if f >= fragments:  # hot: only the marked ones meet, all are looked up
                pairs = _shared(g, who, mark, n, True)[0] if f >= 2 * fragments else []
                late, number = (who, g, mark), (g & LOW).astype(np.int64) * fragments
            else:
                pairs, late = _shared(g, who, mark, n, False)
                seat = np.unique(late[1], return_inverse=True)[1]
                number = (hot + last + seat) * fragments + f  # numbered within the fragment: short to send
                last += int(seat.max()) + 1 if len(seat) else 0
            for x in ranges(len(number)):
                yield sent(late[0][x], None, 0, number[x] * 2 + late[2][x])
            for pair, count in pairs:
                a, b = size[pair // n], size[pair % n]
                near = np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
                found.append((pair[near], count[near].astype(np.uint32)))
                held += len(found[-1][0])
                if held > PAIRS_HELD:
                    found = [_summed(found, n * n)]
                    held = len(found[0][0])
                    if held > PAIRS_HELD // 2:
                        yield from paired(*found[0])
                        found, held = [], 0
        if held:
            yield from paired(*_summed(found, n * n))

    return run


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of so many each, one range after the other."""
    return np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())


def _whole(who: np.ndarray, start: np.ndarray, many: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each pair (lower, higher) of the members of groups once, and in how many groups they meet; who: of the n entities, those of each group in order.

    Entities are taken together by the largest group that each is in; of those that share most groups, as near copies do, a block is a product of incidence matrices.
    """
    group = np.repeat(np.arange(len(start), dtype=np.int32), many)
    stop = np.repeat(start + many, many)
    own = np.argsort(who, kind="stable")
    count = np.bincount(who, minlength=n)
    first = np.cumsum(count) - count
    cost = np.bincount(who, stop - np.arange(len(who)) - 1, n).astype(np.int64)
    there = np.flatnonzero(count)
    if not len(there):
        return
    leader = np.maximum.reduceat(many[group[own]] << 32 | group[own], first[there])
    order = np.argsort(leader, kind="stable")
    there, leader = there[order], leader[order]
    cost, last = np.cumsum(cost[there]), np.searchsorted(leader, leader, side="right")

    def postings(rows: np.ndarray) -> np.ndarray:
        return own[_ranges(first[rows], count[rows])]

    def product(rows: np.ndarray, worth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
        groups = np.unique(group[postings(rows)])
        seen, at = np.zeros(n, bool), np.cumsum(many[groups])
        cuts = [0, *np.searchsorted(at, np.arange(CELLS_OF_GRID, at[-1], CELLS_OF_GRID)).tolist(), len(groups)]
        for lo, hi in zip(cuts, cuts[1:]):
            seen[who[_ranges(start[groups[lo:hi]], many[groups[lo:hi]])]] = True
        members = np.flatnonzero(seen)
        if len(rows) * len(members) * len(groups) > 150 * worth:  # a cell of a product costs so much less than a pair that is counted by itself
            return None
        seat = np.zeros(n, np.int32)
        seat[members] = np.arange(len(members))
        out, width = np.zeros((len(rows), len(members)), np.float32), max(1, CELLS_OF_GRID // len(members))
        for lo in range(0, len(groups), width):
            g = groups[lo : lo + width]
            grid = np.zeros((len(members), len(g)), np.float32)
            grid[seat[who[_ranges(start[g], many[g])]], np.repeat(np.arange(len(g)), many[g])] = 1
            out += grid[seat[rows]] @ grid.T
        out[members[None] <= rows[:, None]] = 0
        i, j = np.nonzero(out)
        return iter([(rows[i], members[j], out[i, j].astype(np.int64))])

    def alone(a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out, at = np.zeros(n, np.int64), postings(np.array([a]))
        upto = np.cumsum(stop[at] - at - 1)
        cuts = [0, *np.searchsorted(upto, np.arange(CELLS_OF_GRID, upto[-1], CELLS_OF_GRID)).tolist(), len(at)]
        for lo, hi in zip(cuts, cuts[1:]):
            out += np.bincount(who[_ranges(at[lo:hi] + 1, (stop[at] - at - 1)[lo:hi])], minlength=n)
        b = np.flatnonzero(out)
        return np.full(len(b), a), b, out[b]

    lo = 0
    while lo < len(there):
        before = int(cost[lo - 1]) if lo else 0
        hi = min(lo + ROWS_OF_GRID, int(last[lo]))
        worth = int(cost[hi - 1]) - before
        if worth > 4 * PAIRS_AT_ONCE:
            yield from product(there[lo:hi], worth) or map(alone, there[lo:hi].tolist())
        else:
            hi = max(lo + 1, int(np.searchsorted(cost, before + PAIRS_AT_ONCE, side="right")))
            rows = there[lo:hi]
            at = postings(rows)
            more = stop[at] - at - 1
            pair, times = np.unique(np.repeat(np.repeat(np.arange(len(rows)), count[rows]), more) * n + who[_ranges(at + 1, more)], return_counts=True)
            yield rows[pair // n], pair % n, times
        lo = hi


def _hooked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Joins the groups of root, changed in place, by pairs; arrays of two rows with pairs that join the same ones: less than there are entities, over all calls."""
    out = []
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return out
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        high = np.maximum(x, y)
        np.minimum.at(root, high, np.minimum(x, y))
        high = np.unique(high)
        out.append(np.stack([root[high], high]))
        while (root[root] != root).any():
            root[:] = root[root]


LINKS, EDGE = -1, -2  #: in place of an overlap: how many documents an entity is linked with by decided pairs, and a pair that joins two groups of them


def _decided(fragments: int, threshold: float, hot: int):
    """What _overlaps gives, but of each pair the whole of what it shares in this fragment, and that just where it is neither enough to be similar nor, with all that
    is counted elsewhere, too little. Similar pairs end here as numbers of links and as pairs that join groups: they are as many as the square of a group of near copies.

    For thresholds over 1/3: what two sets share reaches the threshold at most once then, so what other fragments have of a decided pair is not enough for another.
    """
    partial = _overlaps(fragments, threshold, hot)

    def run(key, batches):
        f, batches = key[0].as_py(), list(batches)
        blobs = [unpack(blob.as_buffer()) for batch in batches for blob in batch.column("blob")]
        name, *rest = (np.concatenate(x) for x in zip(*(blob[4:] for blob in blobs)))
        names, at = np.unique(name, return_index=True)
        size, total, copies = (x[at].astype(np.int64) for x in rest)
        n, bits = len(names), max(len(names) - 1, 1).bit_length()
        if f >= fragments or bits > 23:
            yield from partial(key, iter(batches))
            return
        posted, at = np.empty(sum(len(blob[0]) for blob in blobs), U64), 0  # n-gram, entity and mark in one word, which is sorted in place
        for low, high, many, mark, there, *_ in blobs:
            own = posted[at : at + len(low)]
            own[:] = np.repeat(np.searchsorted(names, there).astype(U64), many)
            own <<= U64(1)
            own |= np.unpackbits(mark, count=len(low))
            own |= _joined(low, high) << U64(bits + 1)
            at += len(low)
        del blobs, batches, name, rest
        posted.sort()
        mark, who = (posted & U64(1)).astype(bool), (posted >> U64(1) & U64((1 << bits) - 1)).astype(np.int32)
        posted >>= U64(bits + 1)
        start = np.flatnonzero(_new(posted))
        del posted
        many = np.diff(np.append(start, len(who)))
        marked = np.add.reduceat(mark, start, dtype=np.int64)
        same = (names >> U64(48)).astype(np.uint16)[who]  # names are in order of their labels
        fresh = _new(same)
        fresh[start] = True
        at = np.flatnonzero(fresh)
        alike = np.maximum.reduceat(np.diff(np.append(at, len(who))), np.searchsorted(at, start))
        del same, fresh, at
        full = (marked > 0) & ((many <= RARE) | (4 * marked >= many)) | (4 * alike >= many)
        late = ~full & (many > 1)
        number = (hot + np.cumsum(late) - 1) * fragments + f
        place = np.flatnonzero(np.repeat(late, many))
        left = total - np.bincount(who, minlength=n) + np.bincount(who[place], minlength=n)  # what is not in the counts of this fragment

        def sent(a: np.ndarray, b: np.ndarray | None, n: np.ndarray | int, gram: np.ndarray | int) -> Iterator[pa.RecordBatch]:
            wide = lambda x, rows: np.broadcast_to(np.asarray(x, np.int64), len(a))[rows].copy()
            for lo in range(0, len(a), ROWS_AT_ONCE):
                x = slice(lo, lo + ROWS_AT_ONCE)
                other = (0, 0) if b is None else (names.view(np.int64)[b[x]], size[b[x]])
                rows = [names.view(np.int64)[a[x]], *(np.broadcast_to(np.asarray(o, np.int64), len(a[x])).copy() for o in other), wide(n, x), wide(gram, x)]
                rows.insert(2, size[a[x]])
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["a", "b", "size_a", "size_b", "n", "gram"])

        yield from sent(who[place], None, 0, np.repeat(number[late], many[late]) * 2 + mark[place])
        use = np.repeat(full & (many > 1), many) | mark & np.repeat(~full & (marked > 1), many)
        group = np.repeat(np.arange(len(start), dtype=np.int32), many)[use]
        who = who[use]
        del mark, place, use
        start = np.flatnonzero(_new(group))
        many = np.diff(np.append(start, len(group)))
        del group
        root, linked, joined = np.arange(n), np.zeros(n), [np.zeros((2, 0), np.int64)]
        for a, b, both in _whole(who, start, many, n):
            near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
            a, b, both = a[near], b[near], both[near]
            sizes = size[a] + size[b]
            similar = both / (sizes - both) >= threshold
            x, y = a[similar], b[similar]
            linked += np.bincount(x, copies[y], n) + np.bincount(y, copies[x], n)
            joined += _hooked(root, x, y)
            most = both + np.minimum(left[a], left[b])
            still = ~similar & (most / (sizes - most) >= threshold)
            yield from sent(a[still], b[still], both[still], 0)
        some = np.flatnonzero(linked)
        yield from sent(some, None, LINKS, linked[some].astype(np.int64))
        yield from sent(*np.concatenate(joined, axis=1), EDGE, 0)

    return run


def _copied(homes: int):
    """How many documents have a set goes to its entity's group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, n = batch.column("sig").to_numpy().view(U64), batch.column("copies").to_numpy().astype(np.int32)
            own = list(by_group(_home(sig, homes)))
            yield pa.RecordBatch.from_pydict({"key": [k for k, _ in own], "blob": [pack(sig[at], n[at]) for _, at in own]}, BLOBS)

    return run


def _similar_sets(docs: DataFrame, n: int, threshold: float, hot: int, keys: int = KEYS, decide: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Distinct (doc_id, sig); (a, b, overlap, jaccard) of signatures of different sets that reach the threshold.

    decide: without those that a fragment decides, for which there are (sig, linked), documents that they link it with, in parts, and pairs (a, b) that join the same groups.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    total = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    fragments = power_of_two(max(8, (total["bytes"] or 0) / 6 / POSTINGS_A_FRAGMENT))
    bits = 40 + fragments.bit_length() - 1
    with small_batches(docs.sparkSession):
        signed = stored(docs.mapInArrow(tidy(_signatures(n, bits)), "doc_id long, sig long").distinct(), "signatures")
        frequent = hot_grams(docs, total["rows"], n, bits, hot)
    blobs = "key int, blob binary"
    width = max(1, fragments // keys)
    parts = docs.mapInArrow(tidy(_segments(n, fragments, frequent, width)), blobs)
    if width > 1:
        parts = parts.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_refined), blobs)
    parts = parts.groupBy("key").applyInArrow(tidy_groups(_repeated(fragments)), blobs)
    step = _overlaps
    if decide and 3 * threshold > 1:
        step, homes = _decided, fragments * HOMES
        copied = signed.where("sig IS NOT NULL").groupBy("sig").agg(F.count("*").alias("copies")).where("copies > 1")
        parts = parts.unionByName(copied.mapInArrow(tidy(_copied(homes)), blobs))
    parts = parts.groupBy("key").applyInArrow(tidy_group(_survivors(fragments, threshold)), blobs)
    counted = "a long, b long, size_a long, size_b long, n long, gram long"
    with small_batches(docs.sparkSession):
        counted = stored(parts.groupBy("key").applyInArrow(tidy_groups(step(fragments, threshold, len(frequent))), counted), "overlaps", ROWS_A_FILE)
    pairs = counted.where("n > 0").groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("overlap"))
    late = counted.where("n = 0").select(F.col("a").alias("id"), F.col("size_a").alias("size"), "gram")
    short = (late.agg(F.max("gram")).first()[0] or 0) < 2**31
    late = late.withColumn("gram", F.col("gram").cast("int" if short else "long")).groupBy("id", "size")

    def beside(pairs: DataFrame, of: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(of.withColumnsRenamed({c: side if c == "id" else f"{c}_{side}" for c in of.columns}), [side, f"size_{side}"], "left")
        return pairs

    def jaccard(overlap) -> F.Column:
        return overlap / (F.col("size_a") + F.col("size_b") - overlap)

    # first how much the looked-up n-grams could add at most, then, where that decides, what they add
    pairs = beside(pairs, late.agg(F.count("*").alias("late"))).withColumn("most", F.least(F.coalesce("late_a", F.lit(0)), F.coalesce("late_b", F.lit(0))))
    pairs = pairs.where(jaccard(F.col("overlap") + F.col("most")) >= threshold).select("a", "b", "size_a", "size_b", "overlap", "most")
    open_ = beside(pairs.where("most > 0"), late.agg(F.collect_list("gram").alias("grams")))
    grams = lambda side: F.transform(f"grams_{side}", lambda x: F.shiftright(x, 1))
    marked = lambda side: F.transform(F.filter(f"grams_{side}", lambda x: x % 2 == 1), lambda x: F.shiftright(x, 1))
    more = F.size(F.array_intersect(grams("a"), grams("b"))) - F.size(F.array_intersect(marked("a"), marked("b")))
    both = pairs.where("most = 0").unionByName(open_.withColumn("overlap", F.col("overlap") + more).select(*pairs.columns))
    both = both.select("a", "b", "overlap", jaccard(F.col("overlap")).alias("jaccard")).where(F.col("jaccard") >= threshold)
    return signed, both, counted.where(F.col("n") == LINKS).select(F.col("a").alias("sig"), F.col("gram").alias("linked")), counted.where(F.col("n") == EDGE).select("a", "b")


def similar_pairs(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, hot: int = HOT, keys: int = KEYS) -> DataFrame:
    """(doc_a, doc_b, overlap, jaccard), doc_a < doc_b: pairs of different sets, each by the lowest id that has it."""
    signed, pairs, *_ = _similar_sets(docs, n, threshold, hot, keys)
    lowest = signed.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("doc"))
    for side in "ab":
        pairs = pairs.join(lowest.select(F.col("sig").alias(side), F.col("doc").alias(f"doc_{side}")), side)
    return pairs.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "overlap", "jaccard")


def classes(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(doc_id, class_id, links) of each document: the lowest id of its connected group, and how many others it is linked with."""
    signed, pairs, links, joined = _similar_sets(docs, n, threshold, hot, decide=True)
    pairs = checkpointed(pairs.select("a", "b"))
    sets = signed.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("copies"))
    roots = components(pairs.unionByName(joined).toDF("doc_a", "doc_b")).withColumnRenamed("doc_id", "sig")
    roots = roots.unionByName(roots.select(F.col("root").alias("sig"), "root").distinct())
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copied = sets.where("copies > 1").select(F.col("sig").alias("b"), "copies")
    linked = both.join(copied, "b", "left").select(F.col("a").alias("sig"), F.coalesce("copies", F.lit(1)).cast("long").alias("linked"))
    linked = linked.unionByName(links).groupBy("sig").agg(F.sum("linked").alias("linked"))
    known = sets.join(roots, "sig", "left").join(linked, "sig", "left").where("root IS NOT NULL OR copies > 1")
    lowest = known.where("root IS NOT NULL").groupBy("root").agg(F.min("lowest").alias("first"))
    known = known.join(lowest, "root", "left").select("sig", F.coalesce("first", "lowest").alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return signed.join(known, "sig", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def components(pairs: DataFrame) -> DataFrame:
    """(doc_id, root) of every document but the roots: the lowest id of its connected component.

    Alternates large-star and small-star steps until nothing changes: the number of rounds grows with the logarithm of
    the component size, and a hub's neighbours are never held in memory.
    """
    edges = checkpointed(pairs.select(F.col("doc_b").alias("u"), F.col("doc_a").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        w = Window.partitionBy("u")
        large = both.withColumn("m", F.least(F.min("v").over(w), "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(w))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = checkpointed(small)
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
        before = tuple(state)


def without_copies(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """One document, that of the lowest id, of each group connected by similar pairs; columns as before.

    Null ids, null texts and texts without words stay. Of rows that repeat an id one stays.
    """
    twice = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.isEmpty():
        single = docs.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        docs = checkpointed(docs.join(twice, "doc_id", "left_anti").unionByName(single))
    gone = checkpointed(classes(docs, n, threshold).where("doc_id <> class_id").select("doc_id"))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


PAIRS_SQL = rf"""
docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x00-/:-@\[-`{{-\x7f]+'), lambda x: x <> '') AS w FROM docs),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {GRAM} THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - {GRAM - 2}), lambda i: array_to_string(w[i : i + {GRAM - 1}], ' ')) END)) AS grams
         FROM words WHERE len(w) > 0),
reps AS (SELECT grams, min(doc_id) AS doc_id, len(grams) AS size FROM sets GROUP BY grams),
posts AS (SELECT doc_id, size, unnest(grams) AS gram FROM reps),
counted AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, any_value(a.size) AS sa, any_value(b.size) AS sb, count(*) AS n
            FROM posts a JOIN posts b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT doc_a, doc_b FROM counted WHERE n / (sa + sb - n) >= {THRESHOLD}),
members AS (SELECT s.doc_id, r.doc_id AS rep, count(*) OVER (PARTITION BY r.doc_id) AS copies FROM sets s JOIN reps r ON s.grams = r.grams),
links AS (SELECT doc_a AS u, doc_b AS v FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
reach AS (SELECT doc_id AS u, doc_id AS v FROM reps UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
roots AS (SELECT u, min(v) AS root FROM reach GROUP BY u),
linked AS (SELECT u, sum(copies) AS n FROM links JOIN (SELECT DISTINCT rep, copies FROM members) ON v = rep GROUP BY u)
"""
SQL = f"""WITH RECURSIVE {PAIRS_SQL} SELECT d.doc_id, coalesce(root, d.doc_id) AS class_id, CAST(coalesce(copies - 1 + coalesce(n, 0), 0) AS BIGINT) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN members m USING (doc_id) LEFT JOIN roots ON roots.u = rep LEFT JOIN linked ON linked.u = rep"""
