"""Quality rules: line-first cleaning.

Every line is judged by itself, and a line that breaks a rule is removed: punctuation (neither closed nor
punctuated inside, or too many symbols), navigation (menu separators) and boilerplate (stock phrases, words
said over and over).
A document is then rejected when it is too short, repeats itself too much, or has lost too many of
its words. Lines without words are layout and stay.

Defined results: a null text counts as an empty text (0 words, rejected). Empty tables give empty
results. Columns of the input named like a result column are replaced by it, all others are kept.
Repeated rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SYMBOLS = "#*$%&|<>"
CLOSING = ".!?:;\"')]"
INNER = ".!?:;,"
CLOSING_WIDE = ("’", "”", "…", "。", "！", "？", "»", "›")
PHRASES = (
    "lorem ipsum", "javascript", "cookie policy", "use of cookies", "uses cookies", "privacy policy", "terms of use",
    "terms of service", "terms and conditions", "all rights reserved", "click here", "read more", "sign up", "log in",
    "share this", "subscribe to", "skip to content", "back to top", "powered by",
)
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MADE = [*FIGURES, "n_lost_words", "base_failed", "kept"]


@dataclass(frozen=True)
class QualityRules:
    """Thresholds; percentages are compared in whole numbers, without rounding."""

    min_words: int = 20
    window: int = 8                     # words of a repeated window
    max_repeat_percent: int = 30
    symbol_percent: int = 10            # of a line's characters in words
    inner_percent: int = 4              # of a line's words end in a mark: then it need not close with one
    stutter_percent: int = 30           # of a line's words repeat the word before
    menu_separators: int = 3            # separators that make a line a menu ...
    menu_percent: int = 20              # ... when they are so many of its words
    phrase_words: int = 25              # a longer line is prose that mentions a phrase
    max_lost_percent: int = 50


def _line_table(data: np.ndarray, off: np.ndarray):
    """Starts, ends and documents of all ``\\n``-split lines; every document has one at least."""
    breaks = np.flatnonzero(data == 10)
    rows = np.searchsorted(off, breaks, "right") - 1
    per_doc = np.bincount(rows, minlength=len(off) - 1) + 1
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    doc = np.repeat(np.arange(len(off) - 1), per_doc)
    last = np.cumsum(per_doc) - 1
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[last] = off[1:]
    return starts, ends, doc


def _repeated(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks for keys found twice or more in a row's list: every one, and all but the first."""
    order = np.lexsort((keys, rows))
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = (keys[order][1:] == keys[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    every, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    every[order] = same[1:] | same[:-1]
    later[order] = same[:-1]           # the sort is stable, so the first of equals is the earliest
    return every, later


def _bad_lines(data, starts, ends, line_words, words_of, pre_symbol, rules: QualityRules) -> np.ndarray:
    word_start, word_end, word_hash = words_of
    has = line_words > 0
    last_word = np.cumsum(line_words) - 1
    end = np.where(has, word_end[np.maximum(last_word, 0)] if len(word_end) else 0, 1)
    padded = np.concatenate([np.zeros(2, np.uint8), data])
    closed = np.isin(padded[end + 1], np.frombuffer(CLOSING.encode(), np.uint8))
    for mark in CLOSING_WIDE:
        code = mark.encode()
        hit = np.ones(len(end), bool)
        for i, byte in enumerate(reversed(code)):
            hit &= padded[np.maximum(end + 1 - i, 0)] == byte
        closed |= hit
    chars = pre_symbol[0][ends] - pre_symbol[0][starts]
    symbols = pre_symbol[1][ends] - pre_symbol[1][starts]
    single = (word_end - word_start == 1) & np.isin(data[word_start], np.frombuffer(b"|>", np.uint8)) if len(word_start) else np.zeros(0, bool)
    first_word = last_word - line_words + 1

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[last_word + 1] - total[first_word]

    menu = per_line(single)
    inner = per_line(np.isin(data[word_end - 1], np.frombuffer(INNER.encode(), np.uint8)) if len(word_end) else single)
    again = np.zeros(len(word_start), bool)
    again[1:] = word_hash[1:] == word_hash[:-1]
    again[first_word[has]] = False
    stutter = per_line(again)
    lines = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)])
    phrase = pc.match_substring_regex(lines, "|".join(PHRASES), ignore_case=True).to_numpy(zero_copy_only=False)
    return has & ((~closed & (100 * inner < rules.inner_percent * line_words)) | (100 * symbols > rules.symbol_percent * chars)
                  | (100 * stutter >= rules.stutter_percent * line_words)
                  | ((menu >= rules.menu_separators) & (100 * menu >= rules.menu_percent * line_words))
                  | (phrase & (line_words <= rules.phrase_words)))


def judge(column: pa.Array, rules: QualityRules, with_text: bool) -> list:
    """Figures, verdicts and (if asked for) cleaned texts of one block of documents."""
    data, off = common.flat(column)
    n_docs = len(off) - 1
    w_start, w_end, w_off = common.words(data, off)
    n_words = np.diff(w_off)
    gap = common.SPACE[data]
    symbol = np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8))
    letter = ~gap & ((data & 0xC0) != 0x80)
    pre_letter, pre_sym = (np.concatenate([[0], np.cumsum(x)]) for x in (letter, symbol))
    pre = common.byte_prefix(data)
    start, end, doc = _line_table(data, off)
    line_of = np.searchsorted(start, w_start, "right") - 1
    line_words = np.bincount(line_of, minlength=len(start))
    full = np.flatnonzero(line_words)
    later = _repeated(common.span(pre, start[full], end[full]), doc[full])[1]
    dup_lines = np.bincount(doc[full][later], minlength=n_docs)
    word_hash = common.span(pre, w_start, w_end)
    at, row = common.windows(n_words, rules.window)
    repeat = np.zeros(n_docs, np.int64)
    if len(at):
        pre_word = common.prefix(word_hash, 1)
        twice = _repeated(common.span(pre_word, at, at + rules.window, 1), row)[0]
        repeat = common.per_row(common.covered(at[twice], rules.window, len(w_start)), w_off)
    bad = _bad_lines(data, start, end, line_words, (w_start, w_end, word_hash), (pre_letter, pre_sym), rules)
    lost = np.bincount(doc, weights=line_words * bad, minlength=n_docs).astype(np.int64)
    failed = (n_words < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n_words)
    kept = ~failed & (100 * lost <= rules.max_lost_percent * n_words)
    out = [n_words, pre_letter[off[1:]] - pre_letter[off[:-1]], pre_sym[off[1:]] - pre_sym[off[:-1]], dup_lines, repeat, lost, failed, kept]
    if with_text:
        out.append(_without(data, off, start, end, doc, bad))
    return out


def _without(data, off, start, end, doc, bad) -> pa.Array:
    """The texts without their bad lines; a removed line takes its line break along."""
    drop = np.zeros(len(data) + 1, np.int32)
    last = np.append(doc[1:] != doc[:-1], True)
    np.add.at(drop, start[bad], 1)
    np.add.at(drop, np.minimum(end + ~last, len(data))[bad], -1)
    keep = np.cumsum(drop)[: len(data)] <= 0
    kept = np.concatenate([[0], np.cumsum(keep)])
    return pa.Array.from_buffers(pa.large_utf8(), len(off) - 1, [None, pa.py_buffer(kept[off].astype(np.int64)), pa.py_buffer(data[keep])]).cast(pa.utf8())


def line_quality(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", with_text: bool = True) -> DataFrame:
    """Figures and verdict per document; with ``with_text`` the text column holds the cleaned text.

    One pass over the documents where they are read: no shuffle, memory bounded by a block of text
    and the longest document."""
    passed = [c for c in common.carried(docs, MADE) if c != text]
    fields = [docs.schema[c] for c in passed] + [T.StructField(c, T.LongType()) for c in [*FIGURES, "n_lost_words"]]
    fields += [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")] + [T.StructField(text, T.StringType())] * with_text

    def run(batches):
        for block in common.blocks(batches, text):
            cols = judge(block.column(text), rules, with_text)
            cols = [pa.array(c, pa.bool_() if c.dtype == bool else pa.int64()) if isinstance(c, np.ndarray) else c for c in cols]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in passed), *cols], names=[f.name for f in fields])

    return docs.select(*passed, text).mapInArrow(run, T.StructType(fields))


def accepted(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """The documents that pass, with cleaned texts, in the columns of the input."""
    return line_quality(docs, rules, text).filter(F.col("kept")).select(*docs.columns)
