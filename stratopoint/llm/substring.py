"""Repeated passages by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of words; every rolling window of the block's
length probes the index of blocks. A passage of ``window`` words that occurs in two documents contains a
whole block of one of them, so it is always hit. Hits are then extended: all passages around a hit block
are looked up by their own key for the smallest document that holds them, and neighbouring repeated
passages run together into maximal exact repeats. Words of a repeat are removed wherever the passage
also starts in a document with a smaller id.

Two exchanges (see ``exchange``): truncated block keys find the candidates (a false hit costs work, not
correctness), then full keys of more than 64 bits decide. The texts themselves are never shuffled.
A key's group is reduced by counts and minima only; nothing is paired.

Defined results: a null text counts as empty; empty and short texts keep all their words. Rows with a null id
are left out; rows that repeat an id never remove each other's words. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, exchange

MADE = ["n_words", "n_removed", "kept_sha256", "kept_text"]
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, text_md5 string"
RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                           ("kept_text", pa.string()), ("text_md5", pa.string())])


@dataclass(frozen=True)
class Repeats:
    window: int = 13
    with_text: bool = False          # also return the kept words, joined by one space

    @property
    def block(self) -> int:
        """The longest block of which any window holds a whole one."""
        return (self.window + 1) // 2


def _words(data: np.ndarray, off: np.ndarray):
    start, end, w_off = common.words(data, off)
    return start, end, w_off, common.word_hashes(data, start, end)


def _block_keys(hashes: np.ndarray, w_off: np.ndarray, size: int):
    """Keys of all rolling windows, their positions, documents, and whether they are reference blocks."""
    at, row = common.windows(np.diff(w_off), size)
    pre = common.prefix(hashes, 1)
    return common.span(pre, at, at + size, 1), at, row, (at - w_off[row]) % size == 0


def _first_payload(chunk: int, keys: np.ndarray, row: np.ndarray, block: np.ndarray, bits: int) -> pa.RecordBatch:
    """Distinct truncated keys per bucket, with two marks: found as a block, found in two documents."""
    order = np.argsort(keys)
    keys, row, block = keys[order], row[order], block[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    keys = keys[first]
    if len(first):
        is_block = np.logical_or.reduceat(block, first)
        several = np.maximum.reduceat(row, first) > np.minimum.reduceat(row, first)
    cut = exchange.cuts(keys << np.uint64(32 - bits), bits)
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    full = np.flatnonzero(np.diff(cut))
    data = [low[cut[b]: cut[b + 1]].tobytes() + np.packbits(is_block[cut[b]: cut[b + 1]]).tobytes() + np.packbits(several[cut[b]: cut[b + 1]]).tobytes()
            for b in full]
    return common.arrays(exchange.PAYLOAD_SCHEMA, full, np.full(len(full), chunk), data)


def _solve_blocks(payloads: list[bytes]) -> list[np.ndarray]:
    """Keys that are a block somewhere and occur in two documents."""
    sizes = [_count(len(p)) for p in payloads]
    keys = np.concatenate([np.frombuffer(p, np.uint32, n) for p, n in zip(payloads, sizes)])
    marks = [np.unpackbits(np.frombuffer(p, np.uint8, offset=4 * n).reshape(2, -1), axis=1, count=n) for p, n in zip(payloads, sizes)]
    marks = np.concatenate(marks, axis=1).astype(bool)
    order = np.argsort(keys)
    same = keys[order]
    first = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
    many = np.diff(np.append(first, len(keys)))
    good = np.logical_or.reduceat(marks[0][order], first) & ((many > 1) | np.logical_or.reduceat(marks[1][order], first))
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(good, many)
    return np.split(out, np.cumsum(sizes)[:-1])


def _count(size: int) -> int:
    """The number n of keys in a payload of ``size`` = 4 n + 2 ceil(n / 8) bytes."""
    n = size // 4
    while 4 * n + 2 * (-(-n // 8)) > size:
        n -= 1
    return n


def _window_payload(key: np.ndarray, low: np.ndarray) -> bytes:
    """Two counts, the keys, the documents, and for every key the place of its smallest document among them."""
    docs, place = np.unique(low, return_inverse=True)
    return np.array([len(key), len(docs)], np.int64).tobytes() + key.tobytes() + docs.tobytes() + place.astype(_place_type(len(docs))).tobytes()


def _place_type(n: int) -> type:
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32


def _solve_windows(payloads: list[bytes]) -> list[np.ndarray]:
    """Keys that a smaller document of another chunk holds too."""
    sizes, keys, low = [], [], []
    for p in payloads:
        n, m = np.frombuffer(p, np.int64, 2).tolist()
        sizes.append(n)
        keys.append(np.frombuffer(p, np.uint64, n, 16))
        low.append(np.frombuffer(p, np.int64, m, 16 + 8 * n)[np.frombuffer(p, _place_type(m), n, 16 + 8 * (n + m))])
    keys, low = np.concatenate(keys), np.concatenate(low)
    order = np.argsort(keys)
    same = keys[order]
    first = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
    least = np.repeat(np.minimum.reduceat(low[order], first), np.diff(np.append(first, len(keys))))
    out = np.zeros(len(keys), bool)
    out[order] = least < low[order]
    return np.split(out, np.cumsum(sizes)[:-1])


def _window_table(hashes: np.ndarray, at: np.ndarray, doc: np.ndarray, ids: np.ndarray, size: int):
    """Distinct keys of the given windows in bucket order with the smallest document of each."""
    route = common.span(common.prefix(hashes, 1), at, at + size, 1)
    key = common.span(common.prefix(hashes, 2), at, at + size, 2)
    order = np.lexsort((key, route))
    r, k = route[order], key[order]
    first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]))) if len(r) else np.zeros(0, np.int64)
    group = np.zeros(len(r), np.int64)
    group[first[1:]] = 1
    place = np.empty(len(r), np.int64)
    place[order] = np.cumsum(group)
    low = np.minimum.reduceat(ids[doc][order], first) if len(r) else np.zeros(0, np.int64)
    return r[first], k[first], low, place


_ONE_SPACE = bytes(32 if i in b" \t\n\v\f\r" else i for i in range(256))


def _finished(ids, data, off, start, end, w_off, gone: np.ndarray, with_text: bool) -> list:
    """The result columns; ``gone`` marks removed words."""
    removed = common.per_row(gone, w_off)
    tight = np.diff(off) == common.per_row(end - start, w_off) + np.diff(w_off) - 1     # one white-space byte between words, none around
    raw = data.tobytes()
    sums, texts, marks = [], [], []
    for d in range(len(ids)):
        if not removed[d] and tight[d]:
            kept = raw[off[d]: off[d + 1]].translate(_ONE_SPACE)
        else:
            here = slice(w_off[d], w_off[d + 1])
            stay = ~gone[here]
            kept = b" ".join([raw[s:e] for s, e in zip(start[here][stay].tolist(), end[here][stay].tolist())])
        sums.append(hashlib.sha256(kept).hexdigest())
        texts.append(kept.decode("utf-8", "replace") if with_text and removed[d] else None)
        marks.append(hashlib.md5(raw[off[d]: off[d + 1]]).hexdigest() if with_text and removed[d] else None)
    return [ids, np.diff(w_off), removed, sums, texts, marks]


class _Chunk:
    """A chunk's words and the windows that hold a hit block."""

    def __init__(self, row: dict, p: Repeats, bits: int, hits: exchange.Answers):
        self.ids, self.data, self.off = exchange.unpacked(row)
        self.start, self.end, self.w_off, hashes = _words(self.data, self.off)
        keys, at, _, _ = _block_keys(hashes, self.w_off, p.block)
        distinct, which = np.unique(keys >> np.uint64(32 - bits), return_inverse=True)
        hit = hits.bits(row["chunk"], exchange.cuts(distinct << np.uint64(32 - bits), bits))
        before = np.zeros(len(self.start) + 1, np.int64)
        before[at[hit[which]] + 1] = 1
        before = np.cumsum(before)
        at, doc = common.windows(np.diff(self.w_off), p.window)
        marks = before[at + p.window - p.block + 1] > before[at]
        self.at, self.doc = at[marks], doc[marks]
        self.route, self.key, self.low, self.place = _window_table(hashes, self.at, self.doc, self.ids, p.window)


def remove_repeats(docs: DataFrame, p: Repeats = Repeats(), text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (if asked for, of documents that lose words)."""
    return _removed(docs, p, text).drop("text_md5")


def _removed(docs: DataFrame, p: Repeats, text: str) -> DataFrame:
    """The result of ``remove_repeats`` with the digest of the text before, beside every kept_text."""
    chunks = exchange.pack(docs, text)
    total = chunks.agg(F.sum("size")).first()[0] or 0
    bits, bits2 = exchange.bucket_bits(total / 6), exchange.bucket_bits(total / 12)

    def probe(batches):
        for row in exchange.rows_of(batches):
            _, data, off = exchange.unpacked(row)
            _, _, w_off, hashes = _words(data, off)
            keys, _, doc, block = _block_keys(hashes, w_off, p.block)
            yield _first_payload(row["chunk"], keys >> np.uint64(32 - bits), doc, block, bits)

    hits = exchange.answer_table(chunks.mapInArrow(probe, exchange.PAYLOAD), _solve_blocks)

    def extend(batches):
        hit = exchange.Answers(hits)
        for row in exchange.rows_of(batches):
            c = _Chunk(row, p, bits, hit)
            cut = exchange.cuts(c.route, bits2)
            full = np.flatnonzero(np.diff(cut))
            load = [_window_payload(c.key[cut[b]: cut[b + 1]], c.low[cut[b]: cut[b + 1]]) for b in full]
            yield common.arrays(exchange.PAYLOAD_SCHEMA, full, np.full(len(full), row["chunk"]), load)

    repeats = exchange.answer_table(chunks.mapInArrow(extend, exchange.PAYLOAD), _solve_windows)

    def finish(batches):
        hit, repeated = exchange.Answers(hits), exchange.Answers(repeats)
        for row in exchange.rows_of(batches):
            c = _Chunk(row, p, bits, hit)
            earlier = repeated.bits(row["chunk"], exchange.cuts(c.route, bits2))
            again = earlier[c.place] | (c.low[c.place] < c.ids[c.doc])
            gone = common.covered(c.at[again], p.window, len(c.start))
            yield common.arrays(RESULT_SCHEMA, *_finished(c.ids, c.data, c.off, c.start, c.end, c.w_off, gone, p.with_text))

    return chunks.mapInArrow(finish, RESULT)


def without_repeats(docs: DataFrame, p: Repeats = Repeats(with_text=True), text: str = "text") -> DataFrame:
    """The documents with their repeated passages cut out; a text that loses nothing stays as it is.

    What a row loses depends on its id and text only, so rows that repeat an id find their result by both."""
    cut = _removed(docs, p, text).filter("n_removed > 0").select(F.col("doc_id").alias("cut_id"), "text_md5", F.col("kept_text").alias("cut_text")) \
        .dropDuplicates(["cut_id", "text_md5"])
    own = docs.select(F.struct(*docs.columns).alias("row"), F.md5(F.col(text).cast("binary")).alias("own_md5"))
    found = own.join(cut, (F.col("row.doc_id") == F.col("cut_id")) & (F.col("own_md5") == F.col("text_md5")), "left")
    return found.select(*(F.coalesce("cut_text", f"row.{c}").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
