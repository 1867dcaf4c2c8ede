"""Suffix-array dedup: exact repeats of ``length`` bytes by a distributed merge sort of suffixes.

Which suffixes are sorted. A window of ``length`` bytes is represented by its anchor, the position of its smallest
hashed ``gram``-byte string (the leftmost among equals). Equal windows have equal anchors at equal places, so the
suffixes at anchors, about one in 35 positions, with the bytes before them stand for all windows. A first exchange (see
``exchange``) counts anchor strings; suffixes whose anchor string is alone in the corpus cannot repeat and stay home.

How they are sorted. Every chunk sorts its suffixes into runs, one per key range, and sends them front-coded: the length
of the prefix shared with the suffix before, then the rest. The leading key is the anchor's hash, which deals
frequent prefixes evenly to ranges; the suffix follows. A range combines its runs with a loser tree whose nodes keep
the length of the prefix shared with the last output: different lengths decide a match without looking at bytes,
equal ones continue behind the known prefix, so no prefix is compared twice. The merge yields the sorted suffixes
with their common prefix lengths.

What follows. For each distance from window start to anchor, suffixes with a long enough common prefix and equal bytes
before the anchor are one class, and all but its earliest member start a repeated window. Equal suffixes of one
chunk travel once, as their earliest occurrence. A range answers one bit per suffix and distance.

Defined results: a null text counts as empty; texts shorter than ``length`` keep all bytes. Rows with a null id are left
out. Rows that repeat an id are told apart by nothing else, so their order is undefined and equal rows lose
nothing to each other at equal starts. Empty tables give empty results. Bytes are compared, so a
removed stretch may end inside a character.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, exchange

U64 = np.uint64
MADE = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                           ("kept_sha256", pa.string()), ("kept", pa.binary())])


@dataclass(frozen=True)
class SuffixRepeats:
    length: int = 100
    gram: int = 32
    with_bytes: bool = False           # also return the remaining bytes

    @property
    def reach(self) -> int:
        """Places of an anchor in a window."""
        return self.length - self.gram + 1


def anchors(data: np.ndarray, off: np.ndarray, p: SuffixRepeats):
    """Anchor positions with their string's key, document, and the nearest and farthest window start they stand for.

    Anchors have small hashes by choice; the key is a second hash, spread evenly over all values."""
    pre = common.byte_prefix(data)
    n = len(data)
    if n < p.length:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, U64), none, none, none, pre
    at = np.arange(n - p.gram + 1)
    keys = common.span(pre, at, at + p.gram)
    place = U64(max(20, n.bit_length()))
    least = (keys >> place << place) | at.astype(U64)
    width = 1
    while 2 * width <= p.reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < p.reach:
        least = np.minimum(least[: -(p.reach - width)], least[p.reach - width:])
    start, doc = common.windows(np.diff(off), p.length)
    anchor = (least[start] & ((U64(1) << place) - U64(1))).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(anchor)) - 1 if len(first) else first
    a = anchor[first]
    return a, common.mix(keys[a]), doc[first], a - start[last], a - start[first], pre


def _count_payload(chunk: int, keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """Distinct truncated anchor keys per bucket, and whether the chunk holds one twice."""
    keys, count = np.unique(keys >> U64(32 - bits), return_counts=True)
    cut = exchange.cuts(keys << U64(32 - bits), bits)
    low, twice = (keys & U64(0xFFFFFFFF)).astype(np.uint32), count > 1
    full = np.flatnonzero(np.diff(cut))
    data = [np.int64(cut[b + 1] - cut[b]).tobytes() + low[cut[b]: cut[b + 1]].tobytes() + np.packbits(twice[cut[b]: cut[b + 1]]).tobytes() for b in full]
    return common.arrays(exchange.PAYLOAD_SCHEMA, full, np.full(len(full), chunk), data)


def _solve_counts(payloads: list[bytes]) -> list[np.ndarray]:
    sizes = [int(np.frombuffer(x, np.int64, 1)[0]) for x in payloads]
    keys = np.concatenate([np.frombuffer(x, np.uint32, n, 8) for x, n in zip(payloads, sizes)])
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=8 + 4 * n), count=n) for x, n in zip(payloads, sizes)]).astype(bool)
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    return np.split(twice | (count > 1)[which], np.cumsum(sizes)[:-1])


class _Suffixes:
    """The suffixes of a chunk that may repeat: distinct ones in sorted order, and all their occurrences."""

    def __init__(self, row: dict, p: SuffixRepeats, bits: int, bits2: int, counts: exchange.Answers):
        self.ids, self.data, self.off = exchange.unpacked(row)
        at, key, doc, near, far, pre = anchors(self.data, self.off, p)
        distinct, which = np.unique(key >> U64(32 - bits), return_inverse=True)
        again = counts.bits(row["chunk"], exchange.cuts(distinct << U64(32 - bits), bits))[which]
        self.at, key, self.doc, self.near, self.far = at[again], key[again], doc[again], near[again], far[again]
        same = common.mix(common.span(pre, self.at - self.far, self.at + p.length - self.near) ^ (self.near * 256 + self.far).astype(U64))
        order = np.lexsort((self.at - self.off[self.doc], self.ids[self.doc], same, key))
        first = np.flatnonzero(np.append(True, (same[order][1:] != same[order][:-1]) | (key[order][1:] != key[order][:-1]))) if len(order) else order
        self.lead = order[first]                                           # the earliest occurrence of each
        raw = self.data.tobytes()
        self.texts = [k + raw[a:e] for k, a, e in zip(_big_endian(key[self.lead]), self.at[self.lead].tolist(), (self.at + p.length - self.near)[self.lead].tolist())]
        rank = sorted(range(len(self.texts)), key=self.texts.__getitem__)
        self.texts = [self.texts[i] for i in rank]
        back = np.empty(len(rank), np.int64)
        back[rank] = np.arange(len(rank))
        group = np.zeros(len(order), np.int64)
        group[first[1:]] = 1
        self.member = np.empty(len(order), np.int64)
        self.member[order] = back[np.cumsum(group)] if len(order) else 0     # the sorted place of every occurrence
        self.lead = self.lead[rank] if len(rank) else self.lead
        self.befores = [raw[a:e] for a, e in zip((self.at - self.far)[self.lead].tolist(), self.at[self.lead].tolist())]
        self.cut = exchange.cuts(key[self.lead], bits2)
        self.spread = (self.far - self.near + 1)[self.lead]
        self.bit_at = np.concatenate([[0], np.cumsum(self.spread)])

    def run(self, s: int, e: int) -> bytes:
        """The suffixes s .. e as one front-coded run."""
        shared, rests = np.zeros(e - s, np.uint8), []
        for i in range(s, e):
            if i > s:
                shared[i - s] = common_prefix(self.texts[i - 1], self.texts[i], 0)
            rests.append(self.texts[i][shared[i - s]:])
        lead = self.lead[s:e]
        sizes = np.array([len(r) for r in rests], np.uint8)
        head = np.array([e - s, sizes.sum(), self.far[lead].sum()], np.int64)
        body = b"".join([head.tobytes(), shared.tobytes(), sizes.tobytes(), self.near[lead].astype(np.uint8).tobytes(), self.far[lead].astype(np.uint8).tobytes(),
                         self.ids[self.doc[lead]].tobytes(), (self.at - self.off[self.doc])[lead].astype(np.int64).tobytes(), *rests, *self.befores[s:e]])
        return np.int64(len(body)).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _big_endian(keys: np.ndarray) -> list[bytes]:
    raw = keys.astype(">u8").tobytes()
    return [raw[i: i + 8] for i in range(0, len(raw), 8)]


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which ``known`` bytes need no second look."""
    end = min(len(a), len(b))
    while known < end:
        x, y = a[known: known + 16], b[known: known + 16]
        if x != y:
            size = min(len(x), len(y))
            differ = int.from_bytes(x[:size]) ^ int.from_bytes(y[:size])
            return known + size - (differ.bit_length() + 7) // 8
        known += 16
    return end


class Run:
    """A front-coded run and a cursor on it."""

    def __init__(self, payload: bytes):
        raw = pa.decompress(payload[8:], int(np.frombuffer(payload, np.int64, 1)[0]), codec="zstd", asbytes=True)
        n, rest_size, _ = np.frombuffer(raw, np.int64, 3).tolist()
        take = lambda kind, at, m: np.frombuffer(raw, kind, m, at)
        self.n = n
        self.shared, sizes = take(np.uint8, 24, n).tolist(), take(np.uint8, 24 + n, n).astype(np.int64)
        self.near, self.far = take(np.uint8, 24 + 2 * n, n), take(np.uint8, 24 + 3 * n, n)
        self.doc, self.place = take(np.int64, 24 + 4 * n, n), take(np.int64, 24 + 12 * n, n)
        base = 24 + 20 * n
        self.raw, self.ends = raw, (base + np.cumsum(sizes)).tolist()
        self.starts = (base + np.cumsum(sizes) - sizes).tolist()
        before_end = base + rest_size + np.cumsum(self.far.astype(np.int64))
        self.befores = [raw[s:e] for s, e in zip((before_end - self.far).tolist(), before_end.tolist())]
        self.i, self.text = -1, b""

    def step(self) -> bool:
        """Move to the next suffix; its prefix shared with the one before is ``shared[i]``."""
        self.i += 1
        if self.i >= self.n:
            return False
        self.text = self.text[: self.shared[self.i]] + self.raw[self.starts[self.i]: self.ends[self.i]]
        return True


def merged(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, place in the run and common prefix with the suffix before, for all suffixes in sorted order.

    A loser tree. ``lcp[r]`` is the prefix that the head of run r shares with the last suffix that went out;
    among heads the one that shares more is smaller, and only equal ones are compared, behind that prefix."""
    k = len(runs)
    alive = [r.step() for r in runs]
    lcp, loser = [0] * k, [-1] * k

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two heads; the loser's lcp becomes the prefix shared with the winner."""
        if not alive[a] or not alive[b]:
            return (a, b) if alive[a] else (b, a)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y = runs[a].text, runs[b].text
        h = common_prefix(x, y, lcp[a])
        if (x[h:h + 1], a) <= (y[h:h + 1], b):
            lcp[b] = h
            return a, b
        lcp[a] = h
        return b, a

    winners = list(range(k, 2 * k))                    # leaves k .. 2 k - 1 of an implicit tree, played bottom-up
    up = [-1] * k + [i - k for i in winners]
    for node in range(k - 1, 0, -1):
        up[node], loser[node] = match(up[2 * node], up[2 * node + 1])
    best = up[1] if k > 1 else 0
    which, where, shared = [], [], []
    while alive[best]:
        run = runs[best]
        which.append(best)
        where.append(run.i)
        shared.append(lcp[best])
        alive[best] = run.step()
        if alive[best]:
            lcp[best] = run.shared[run.i]
        node = (best + k) >> 1
        while node:
            best, loser[node] = match(best, loser[node])
            node >>= 1
    return np.array(which, np.int64), np.array(where, np.int64), np.array(shared, np.int64)


def _solve_range(payloads: list[bytes], p: SuffixRepeats) -> list[np.ndarray]:
    """For every suffix and distance: does an equal window start earlier elsewhere?"""
    runs = [Run(x) for x in payloads]
    which, where, shared = merged(runs)
    base = np.cumsum([0] + [r.n for r in runs])
    entry = base[which] + where
    near, far, doc, place = (np.concatenate([getattr(r, f) for r in runs])[entry].astype(np.int64) for f in ("near", "far", "doc", "place"))
    n = len(entry)
    befores = [b for r in runs for b in r.befores]
    # bytes before the anchor, read backwards, in sorted order with their common lengths
    width = int(far.max())
    table = np.zeros((n, max(width, 1)), np.uint8)
    flipped = [befores[i][::-1] for i in entry.tolist()]
    if far.sum():
        flat = np.frombuffer(b"".join(flipped), np.uint8)
        table[np.repeat(np.arange(n), far), np.arange(len(flat)) - np.repeat(np.cumsum(far) - far, far)] = flat
    by_left = np.array(sorted(range(n), key=flipped.__getitem__), np.int64)
    left = np.zeros(n, np.int64)
    if n > 1:
        differ = table[by_left[1:]] != table[by_left[:-1]]
        left[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), width), np.minimum(far[by_left[1:]], far[by_left[:-1]]))
    age = np.empty(n, np.int64)
    age[np.lexsort((place, doc))] = np.arange(n)
    tie = np.lexsort((place, doc))
    equal = np.append(False, (doc[tie][1:] == doc[tie][:-1]) & (place[tie][1:] == place[tie][:-1]))
    age[tie] -= np.cumsum(equal)
    bit_base = np.concatenate([[0], np.cumsum(np.concatenate([r.far.astype(np.int64) - r.near + 1 for r in runs]))])
    out = np.zeros(int(bit_base[-1]), bool)
    left_class = np.empty(n, np.int64)
    for d in range(int(near.min()), width + 1):
        use = np.flatnonzero((near <= d) & (d <= far))
        if len(use) < 2:
            continue
        left_class[by_left] = np.cumsum(left < d)
        key = np.cumsum(shared < 8 + p.length - d)[use] * (n + 1) + left_class[use]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        least = np.repeat(np.minimum.reduceat(age[use][order], first), np.diff(np.append(first, len(order))))
        hit = use[order][least < age[use][order]]
        out[bit_base[entry[hit]] + d - near[hit]] = True
    return np.split(out, bit_base[base[1:-1]])


def remove_repeats(docs: DataFrame, p: SuffixRepeats = SuffixRepeats(), text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (if asked for) per document."""
    chunks = exchange.pack(docs, text)
    total = chunks.agg(F.sum("size")).first()[0] or 0
    bits, bits2 = exchange.bucket_bits(total / 30), exchange.bucket_bits(total / 7)

    def count(batches):
        for row in exchange.rows_of(batches):
            _, data, off = exchange.unpacked(row)
            yield _count_payload(row["chunk"], anchors(data, off, p)[1], bits)

    counts = exchange.answer_table(chunks.mapInArrow(count, exchange.PAYLOAD), _solve_counts)

    def send(batches):
        counted = exchange.Answers(counts)
        for row in exchange.rows_of(batches):
            c = _Suffixes(row, p, bits, bits2, counted)
            full = np.flatnonzero(np.diff(c.cut))
            yield common.arrays(exchange.PAYLOAD_SCHEMA, full, np.full(len(full), row["chunk"]), [c.run(c.cut[b], c.cut[b + 1]) for b in full])

    repeats = exchange.answer_table(chunks.mapInArrow(send, exchange.PAYLOAD), lambda payloads: _solve_range(payloads, p))

    def finish(batches):
        counted, repeated = exchange.Answers(counts), exchange.Answers(repeats)
        for row in exchange.rows_of(batches):
            c = _Suffixes(row, p, bits, bits2, counted)
            earlier = repeated.bits(row["chunk"], c.bit_at[c.cut])
            spread = c.far - c.near + 1
            d = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)          # distance above the nearest
            is_lead = np.zeros(len(c.at), bool)
            is_lead[c.lead] = True
            again = ~np.repeat(is_lead, spread) | earlier[np.repeat(c.bit_at[c.member], spread) + d]
            starts = np.repeat(c.at - c.near, spread) - d
            gone = common.covered(starts[again], p.length, len(c.data))
            opens = gone.copy()
            opens[1:] &= ~gone[:-1] | np.isin(np.arange(1, len(gone)), c.off)
            raw, n_removed = c.data[~gone].tobytes(), common.per_row(gone, c.off)
            at = c.off - np.concatenate([[0], np.cumsum(n_removed)])
            kept = [raw[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            yield common.arrays(RESULT_SCHEMA, c.ids, np.diff(c.off), n_removed, common.per_row(opens, c.off), [hashlib.sha256(k).hexdigest() for k in kept],
                                kept if p.with_bytes else [None] * len(kept))

    return chunks.mapInArrow(finish, RESULT)
