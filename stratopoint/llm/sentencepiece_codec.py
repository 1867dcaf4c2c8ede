"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds all pieces. It reads a text once; at every position it follows its output links, which
lists all pieces that end there, longest first, and each of them relaxes the best score of the position.
The segmentation maximises the sum of the model's piece scores; among equals the longest last piece wins.
A character without a piece is encoded as its UTF-8 bytes. Spaces become U+2581 and a text gets one in front,
as the model's normaliser has it; decoding undoes both, so a text comes back exactly, except that U+2581 in
a text comes back as a space.

The given model was trained with merges; here its pieces and scores drive the best-score segmentation, so
ids may differ from those of the merge rule, while the decoded text may not.

No piece crosses from another character into U+2581 (checked when a model is loaded), so the best
segmentation of a text is that of its space-led units one after another; a task keeps the units it has
already solved. One pass where the documents are read, no shuffle; memory is bounded by a block of
text, the longest document and the bounded unit cache.

Defined results: null and empty texts have no pieces and decode to an empty text. Empty tables give
empty results. Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

MADE = ["n_pieces", "pieces"]
SPACE_MARK = "▁"


@dataclass(frozen=True)
class Pieces:
    """A model's vocabulary: texts, scores and kinds ('n' piece, 'b' byte, 'c' control), by id."""

    texts: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str

    @staticmethod
    def load(path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        kinds = "".join("b" if m.is_byte(i) else "c" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "n" for i in range(n))
        out = Pieces(tuple(m.id_to_piece(i) for i in range(n)), tuple(m.get_score(i) for i in range(n)), kinds)
        if any(SPACE_MARK in t.lstrip(SPACE_MARK) for t, k in zip(out.texts, kinds) if k == "n"):
            raise ValueError("a piece crosses into a space, units cannot be encoded one by one")
        if kinds.count("b") != 256:
            raise ValueError("the model has no piece for every byte")
        return out


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Automaton, unit cache and byte table of one task."""

    def __init__(self, pieces: Pieces):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.single, self.byte_id = set(), [0] * 256
        surfaces = []
        for i, (text, score, kind) in enumerate(zip(pieces.texts, pieces.scores, pieces.kinds)):
            if kind == "n":
                self.automaton.add_word(text, (len(text), score, i))
                if len(text) == 1:
                    self.single.add(text)
            elif kind == "b":
                self.byte_id[int(text[3:5], 16)] = i
            surfaces.append(text.replace(SPACE_MARK, " ").encode() if kind == "n" else bytes([int(text[3:5], 16)]) if kind == "b" else b"")
        self.automaton.make_automaton()
        self.unknown = min(s for s, k in zip(pieces.scores, pieces.kinds) if k == "n") - 10
        self.surface_size = np.array([len(s) for s in surfaces], np.int64)
        self.surface_at = np.concatenate([[0], np.cumsum(self.surface_size)])
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.units = common.UnitCache()

    def segment(self, unit: str) -> list[int]:
        """The best-scoring pieces of one unit, whose spaces are already U+2581."""
        n = len(unit)
        best, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        unknown = [] if self.single.issuperset(unit) else [i for i, c in enumerate(unit) if c not in self.single]
        at = 0
        for last, (size, score, piece) in self.automaton.iter(unit):
            while at < len(unknown) and unknown[at] <= last:
                self._skip(best, back, unknown[at])      # a start of this or a later piece may lie behind it
                at += 1
            total = best[last + 1 - size] + score
            if total > best[last + 1]:
                best[last + 1], back[last + 1] = total, (size, piece)
        for i in unknown[at:]:
            self._skip(best, back, i)
        out = []
        while n:
            size, piece = back[n]
            if piece is None:
                out += [self.byte_id[b] for b in reversed(unit[n - 1].encode())]
            else:
                out.append(piece)
            n -= size
        return out[::-1]

    def _skip(self, best: list, back: list, i: int) -> None:
        if best[i] + self.unknown > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + self.unknown, (1, None)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, and where each document's ids begin."""
        data, off = _marks_as_spaces(data, off)
        full = np.diff(off) > 0
        data = np.insert(data, off[:-1][full], 32)
        off = off + np.concatenate([[0], np.cumsum(full)])
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        space, line = data == 32, data == 10
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        cut[1:n] |= space[1:] & ~space[:-1]
        cut[:n] |= line
        cut[1:] |= line
        starts = np.flatnonzero(cut[:n])
        ids, unit_off = self.units.encode(data, starts, np.append(starts[1:], n),
                                          lambda new: [self.segment(u.replace(" ", SPACE_MARK)) for u in new])
        return ids, unit_off[np.searchsorted(starts, off)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents one after another, without the leading space, and their offsets."""
        data, at = common.gather(self.surface, self.surface_at[ids], self.surface_size[ids])
        off = at[off]
        full = np.diff(off) > 0
        keep = np.ones(len(data), bool)
        keep[off[:-1][full]] = False
        return data[keep], off - np.concatenate([[0], np.cumsum(full)])


def _marks_as_spaces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's own U+2581 counts as a space, as it does for the model."""
    at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
    if not len(at):
        return data, off
    keep = np.ones(len(data), bool)
    keep[at + 1] = keep[at + 2] = False
    data = data.copy()
    data[at] = 32
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[off]


@lru_cache(maxsize=2)
def _codec(pieces: Pieces) -> Codec:
    return Codec(pieces)


def encode(docs: DataFrame, model: str | None = None, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` with n_pieces and pieces (array of ids) in place of the text."""
    pieces = Pieces.load(model or default_model())
    passed = [c for c in common.carried(docs, MADE) if c != text]
    fields = [docs.schema[c] for c in passed] + [T.StructField("n_pieces", T.LongType()), T.StructField("pieces", T.ArrayType(T.IntegerType()))]

    def run(batches):
        codec = _codec(pieces)
        for block in common.blocks(batches, text):
            ids, off = codec.encode(*common.flat(block.column(text)))
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in passed), pa.array(np.diff(off)), lists], names=[f.name for f in fields])

    return docs.select(*passed, text).mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, model: str | None = None, pieces_column: str = "pieces", text: str = "text") -> DataFrame:
    """The other columns of ``encoded`` with the decoded text in place of the ids."""
    pieces = Pieces.load(model or default_model())
    passed = [c for c in encoded.columns if c not in (pieces_column, text)]
    fields = [encoded.schema[c] for c in passed] + [T.StructField(text, T.StringType())]

    def run(batches):
        codec = _codec(pieces)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                lists = part.column(pieces_column)
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                data, off = codec.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(size)]))
                texts = pa.Array.from_buffers(pa.large_utf8(), len(part), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), texts.cast(pa.utf8())], names=[f.name for f in fields])

    return encoded.select(*passed, pieces_column).mapInArrow(run, T.StructType(fields))


def round_trip(docs: DataFrame, model: str | None = None, text: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_pieces, pieces_crc32, decoded_sha256 and whether the text came back."""
    pieces = Pieces.load(model or default_model())
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("pieces_crc32", pa.int64()), ("decoded_sha256", pa.string()),
                        ("same", pa.bool_())])
    mark = SPACE_MARK.encode()

    def run(batches):
        codec = _codec(pieces)
        for block in common.blocks(batches, text):
            data, off = common.flat(block.column(text))
            ids, at = codec.encode(data, off)
            back, back_off = codec.decode(ids, at)
            raw, got, words = data.tobytes(), back.tobytes(), ids.astype("<u4")
            crc, digest, same = [], [], []
            for i in range(len(block)):
                decoded = got[back_off[i]: back_off[i + 1]]
                crc.append(zlib.crc32(words[at[i]: at[i + 1]].tobytes()))
                digest.append(hashlib.sha256(decoded).hexdigest())
                same.append(decoded == raw[off[i]: off[i + 1]].replace(mark, b" "))
            yield common.arrays(schema, block.column("doc_id").cast(pa.int64()), np.diff(at), crc, digest, same)

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_pieces long, pieces_crc32 long, decoded_sha256 string, same boolean")
