"""Document fingerprints by locally consistent parsing.

A text is parsed into a hierarchy of phrases. On every level runs of equal symbols become one symbol; deterministic coin
tossing then labels each symbol from a few of its left neighbours: the lowest bit in which it differs from the symbol
before, and that bit's value, repeated until the labels are 0 to 5. Local maxima of the labels begin a new phrase, so phrases
hold two symbols or more, and where they begin depends on a bounded neighbourhood only: equal substrings get equal
phrases inside, whatever stands around them. A phrase's name is the hash of its symbols; names are the symbols of
the next level, until one is left, the root.

The fingerprint is the root's name and a bottom-k sketch of the names of all phrases on the second level and above (about
ten characters and more) and the root. The likeness of two fingerprints is the share of phrases they have in common,
twice the common ones by all of both, estimated from the sketches.

Scale: one pass over blocks of documents, no pairs. ``with_next`` needs every text beside the next one: documents are
dealt by ranges of ids whose first ids are documents themselves, and the first document of a range is also sent to the
range before it, so one shuffle of the texts does, and nothing is collected but one id per range.

Defined results: null and empty texts have the empty fingerprint, alike (1) to each other and unlike (0) to all others.
Rows with a null id are left out. Rows that repeat an id follow each other in the order of their texts; behind a range,
the first of them is the next document. With one document, it is its own next. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

U64 = np.uint64
MADE = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SKETCH = 64
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                           ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest differing bit's place, plus that bit; the first symbol of a text differs in bit 0 from its own inverse."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[first] = symbols[first] ^ symbols.dtype.type(1)
    differ = symbols ^ before
    low = differ & (~differ + symbols.dtype.type(1))
    place = np.bitwise_count(low - symbols.dtype.type(1))
    return (2 * place + ((symbols & low) != 0)).astype(np.uint8)


def _parse_level(symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the next level and their offsets; every text has at least two symbols."""
    n = len(symbols)
    start = np.zeros(n, bool)
    start[off[:-1]] = True
    lead = start.copy()
    lead[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(lead)
    length = np.diff(np.append(at, n))
    run = symbols[at]
    many = length > 1
    run[many] = common.mix(run[many] ^ (length[many].astype(U64) << U64(32)))
    off = np.searchsorted(at, off)
    first = off[:-1]
    label = _toss(run, first)
    for _ in range(3):
        label = _toss(label, first)
    m = len(run)
    peak = np.zeros(m, bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    peak[off[1:] - 1] = False
    peak[first] = True
    second = first + 1
    peak[second[second < off[1:]]] = False                       # a phrase at the start of a text has two symbols
    at = np.flatnonzero(peak)
    pre = common.prefix(run)
    return common.span(pre, at, np.append(at[1:], m)), np.searchsorted(at, off)


def fingerprints(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Root names (0 for empty texts) and sorted sketches of 32-bit values."""
    n = len(texts)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64) + U64(1)
    root = np.zeros(n, U64)
    doc = np.arange(n)
    names, owners, level = [], [], 0
    while True:
        size = np.diff(off)
        if level >= 2:
            names.append(symbols)
            owners.append(np.repeat(doc, size))
        done = size == 1
        if level < 2:
            names.append(common.mix(symbols[off[:-1][done]]))
            owners.append(doc[done])
        root[doc[done]] = common.mix(symbols[off[:-1][done]])
        more = size > 1
        if not more.any():
            break
        stay = np.repeat(more, size)
        symbols, doc = symbols[stay], doc[more]
        symbols, off = _parse_level(symbols, np.concatenate([[0], np.cumsum(size[more])]))
        level += 1
    owner = np.concatenate(owners)
    value = (common.mix(np.concatenate(names) ^ U64(0x2545F4914F6CDD1D)) >> U64(32)).astype(np.int64) | owner << 32
    value.sort()
    value = value[np.append(True, value[1:] != value[:-1])] if len(value) else value
    owner = value >> 32
    edge = np.searchsorted(owner, np.arange(n + 1))
    value = (value & 0xFFFFFFFF).astype(np.uint32)
    return root, [value[s: min(e, s + SKETCH)] for s, e in zip(edge[:-1].tolist(), edge[1:].tolist())]


def written(root: int, sketch: np.ndarray) -> str:
    """The fingerprint as text: 16 hex digits of the root, then 8 for each value of the sketch."""
    return f"{root:016x}" + sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of common phrases: 2 |A and B| / (|A| + |B|), from bottom-k sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.concatenate([a, b])
    union.sort()
    twice = union[1:] == union[:-1]
    distinct = np.append(True, ~twice)
    k = SKETCH if len(a) == SKETCH or len(b) == SKETCH else int(distinct.sum())
    rank = np.cumsum(distinct)
    both = int((twice & (rank[:-1] <= k)).sum())
    jaccard = both / min(k, int(distinct.sum()))
    return 2 * jaccard / (1 + jaccard)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` without the text, with the fingerprint."""
    passed = [c for c in common.carried(docs, ["fingerprint"]) if c != text]

    def run(batches):
        for block in common.blocks(batches, text):
            root, sketches = fingerprints([t or "" for t in block.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in passed), pa.array([written(r, s) for r, s in zip(root.tolist(), sketches)])],
                                             names=[*passed, "fingerprint"])

    return docs.select(*passed, text).mapInArrow(run, docs.select(*passed).schema.add("fingerprint", "string"))


def with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows in ascending order of ids, each range in one partition, followed by the first row of the next range:
    columns doc_id, text, range and ahead (true for the row that only serves the one before it)."""
    docs = common.non_null_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    width = common.shuffle_width(docs)
    near = docs.approxQuantile("doc_id", [i / width for i in range(1, width)], 1 / (4 * width)) if width > 1 else []
    near = sorted({min(int(e), (1 << 63) - 1) for e in near})       # doubles: beyond 2 ** 53 often no id at all
    part = F.size(F.filter(F.array(*map(F.lit, near)), lambda e: e <= F.col("doc_id"))) if near else F.lit(0)
    firsts = sorted(r.first for r in docs.groupBy(part.alias("part")).agg(F.min("doc_id").alias("first")).collect())
    if not firsts:
        return docs.withColumns({"range": F.lit(0), "ahead": F.lit(False)})
    low, edges = firsts[0], firsts[1:]
    last = len(edges)
    lead = F.when(F.col("doc_id") == low, F.lit(last)).when(F.col("doc_id").isin(edges), F.col("range") - 1) if edges else F.when(F.col("doc_id") == low, F.lit(0))
    number = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("doc_id"))) if edges else F.lit(0)
    own = docs.withColumn("range", number).withColumn("lead", lead)
    both = own.withColumn("to", F.explode(F.when(F.col("lead").isNull(), F.array(F.struct(F.col("range").alias("r"), F.lit(False).alias("a"))))
                                          .otherwise(F.array(F.struct(F.col("range").alias("r"), F.lit(False).alias("a")), F.struct(F.col("lead").alias("r"), F.lit(True).alias("a"))))))
    dealt = both.select("doc_id", "text", F.col("to.r").alias("range"), F.col("to.a").alias("ahead"))
    return dealt.repartitionById(last + 1, "range").sortWithinPartitions("range", "ahead", "doc_id", "text")


def edited_halves(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text, whose last half is the beginning of the next one."""

    def run(batches):
        waiting: list[tuple[int, str]] = []           # rows of one range; the last of them waits for its next
        size = 0

        def solve(rows):
            own = [t for _, t in rows]
            edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(own, own[1:])]
            root, sketch = fingerprints(own + edited)
            n = len(edited)
            marks = [written(r, s) for r, s in zip(root.tolist(), sketch)]
            near = [1.0 if marks[i] == marks[len(own) + i] else likeness(sketch[i], sketch[len(own) + i]) for i in range(n)]
            after = [1.0 if marks[i] == marks[i + 1] else likeness(sketch[i], sketch[i + 1]) for i in range(n)]
            return common.arrays(RESULT_SCHEMA, [d for d, _ in rows[:-1]], [len(t) for t in own[:-1]], [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                                 marks[:n], marks[len(own):], near, after)

        for block in common.blocks(batches, "text"):
            for doc, content, ahead in zip(*(block.column(c).to_pylist() for c in ("doc_id", "text", "ahead"))):
                if ahead and not waiting:
                    continue                          # a further row with the id of the first of the next range
                waiting.append((doc, content))
                size += len(content)
                if ahead or size > common.BLOCK_BYTES and len(waiting) > 1:
                    yield solve(waiting)
                    waiting = [] if ahead else waiting[-1:]
                    size = sum(len(t) for _, t in waiting)
        if waiting:
            raise RuntimeError(f"document {waiting[-1][0]} has no next one in its range")

    return with_next(docs, text).select("doc_id", "text", "ahead").mapInArrow(run, RESULT)
