"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A letter n-gram is one vector: the letters'
vectors, each permuted (rotated) by its distance from the end, multiplied. A text's profile bundles (adds) the
vectors of all its n-grams; a language's prototype bundles those of its documents. A text is compared with
the prototypes by cosine. Words are runs of letters, lower-cased; one boundary sign stands between them and around a text.

Scale: a task counts the n-grams of a block of documents and multiplies the counts with the vectors of the n-grams that
occur, once for the whole block. Training sums one profile per language and task, then adds the tasks up; the model is
``languages x dimensions`` numbers. Predicting is one more pass without a shuffle.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text when no document could
be learned from. Null languages are not learned from. Rows with a null id belong to the training part.
Among equal cosines the first language in code point order wins. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MADE = ["held_out", "lang_pred", "score"]
UNKNOWN = "und"
GRAMS_KEPT = 20_000                      # n-gram vectors a task keeps, about 20 MB


@dataclass(frozen=True)
class Profiles:
    """Prototypes: one row of ``sums`` per language, in the languages' order."""

    languages: tuple[str, ...]
    sums: np.ndarray
    dimensions: int = 1024


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts, one 0 between words and around each text, and the texts' offsets."""
    texts = [" " + (t or "").lower() + " " for t in column.to_pylist()]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    signs = np.where(_is_letter()[signs], signs, 0)
    keep = np.ones(len(signs), bool)
    keep[1:] = (signs[1:] != 0) | (signs[:-1] != 0)
    keep[off[:-1]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return signs[keep], kept[off]


def grams(signs: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all three-sign grams that hold a letter, and their document."""
    at, row = common.windows(np.diff(off), 3)
    wide = signs.astype(np.int64)
    keys = (wide[at] << 42) | (wide[at + 1] << 21) | wide[at + 2]
    full = (keys & ~(0x1FFFFF << 42) & ~0x1FFFFF) > 0
    full |= (wide[at] > 0) | (wide[at + 2] > 0)
    return keys[full], row[full]


class Space:
    """The vectors of letters and n-grams, drawn when they are first met."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.letter: dict[int, np.ndarray] = {}
        self._reset()

    def _reset(self) -> None:
        self.keys, self.place, self.vectors = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, self.dimensions), np.int8)

    def _letter(self, sign: int) -> np.ndarray:
        if sign not in self.letter:
            bits = common.mix(np.arange(self.dimensions, dtype=np.uint64) + np.uint64(sign) * np.uint64(1 << 32) + np.uint64(0x51ED270B)) >> np.uint64(63)
            self.letter[sign] = (2 * bits.astype(np.int8) - 1).astype(np.int8)
        return self.letter[sign]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of distinct ascending keys."""
        if len(self.keys) > GRAMS_KEPT:
            self._reset()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = keys[~known]
        if len(new):
            made = np.empty((len(new), self.dimensions), np.int8)
            for i, k in enumerate(new.tolist()):
                made[i] = np.roll(self._letter(k >> 42), 2) * np.roll(self._letter(k >> 21 & 0x1FFFFF), 1) * self._letter(k & 0x1FFFFF)
            self.place = np.insert(self.place, at[~known], np.arange(len(self.vectors), len(self.vectors) + len(new)))
            self.keys = np.insert(self.keys, at[~known], new)
            self.vectors = np.concatenate([self.vectors, made])
        return self.vectors[self.place[np.searchsorted(self.keys, keys)]]


@lru_cache(maxsize=2)
def _space(dimensions: int) -> Space:
    return Space(dimensions)


def _counted(keys: np.ndarray, row: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Distinct keys and the (documents x keys) counts, in groups of documents that bound the table."""
    distinct, which = np.unique(keys, return_inverse=True)
    step = max(1, (1 << 22) // max(1, len(distinct)))
    edges = np.searchsorted(row, np.arange(0, rows + step, step))
    for g, (s, e) in enumerate(zip(edges[:-1], edges[1:])):
        n = min(step, rows - g * step)
        if n > 0:
            yield distinct, np.bincount((row[s:e] - g * step) * len(distinct) + which[s:e], minlength=n * len(distinct)).reshape(n, -1), g * step


def train(docs: DataFrame, dimensions: int = 1024, text: str = "text", lang: str = "lang") -> Profiles:
    """Prototypes from all rows of ``docs`` whose language is not null."""
    schema = pa.schema([("lang", pa.string()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        space, sums = _space(dimensions), {}
        for block in common.blocks(batches, text):
            names = block.column(lang).to_pylist()
            keys, row = grams(*letters(block.column(text)))
            distinct, which = np.unique(keys, return_inverse=True)
            if not len(distinct):
                continue
            vectors = space.of(distinct).astype(np.float32)
            label = {name: i for i, name in enumerate(dict.fromkeys(names))}
            code = np.array([label[x] for x in names])[row]
            counts = np.bincount(code * len(distinct) + which, minlength=len(label) * len(distinct)).reshape(len(label), -1)
            for name, total in zip(label, counts.astype(np.float64) @ vectors):
                sums[name] = sums.get(name, 0) + np.rint(total).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "sums": [s.tolist() for s in sums.values()]}, schema=schema)

    parts = docs.filter(F.col(lang).isNotNull()).select(F.col(text).alias(text), F.col(lang).alias(lang)).mapInArrow(run, "lang string, sums array<long>")
    rows = parts.select("lang", F.posexplode("sums").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")) \
        .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("sums")).collect()
    rows = sorted(rows, key=lambda r: r["lang"])
    return Profiles(tuple(r["lang"] for r in rows), np.array([r["sums"] for r in rows], np.float64).reshape(-1, dimensions), dimensions)


def predict(docs: DataFrame, model: Profiles, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with lang_pred and score."""
    passed = [c for c in common.carried(docs, MADE[1:]) if c != text]
    norm = np.linalg.norm(model.sums, axis=1, keepdims=True)
    prototypes = (model.sums / np.where(norm > 0, norm, 1)).astype(np.float32)
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches):
        space = _space(model.dimensions)
        for block in common.blocks(batches, text):
            keys, row = grams(*letters(block.column(text)))
            pred, score = np.full(len(block), len(names) - 1), np.zeros(len(block))
            if len(keys) and len(prototypes):
                for distinct, counts, first in _counted(keys, row, len(block)):
                    bundle = counts.astype(np.float32) @ space.of(distinct).astype(np.float32)
                    size = np.linalg.norm(bundle, axis=1)
                    cosine = bundle @ prototypes.T / np.where(size > 0, size, 1)[:, None]
                    some = counts.any(1)
                    pred[first: first + len(counts)][some] = cosine.argmax(1)[some]
                    score[first: first + len(counts)][some] = np.clip(cosine.max(1)[some], 0, 1)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in passed), pa.array(names[pred].tolist(), pa.string()), pa.array(score)],
                                             names=[*passed, "lang_pred", "score"])

    schema = docs.select(*passed).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*passed, text).mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """The quarter of the documents that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
