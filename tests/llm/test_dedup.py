"""Near-duplicates and repeated passages against brute force, on awkward texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from stratopoint.llm import common, minhash, substring, suffix_dedup

from . import brute

SCHEMA = "doc_id long, text string, kept string, n_words string, label string"


def table(spark, texts, parts=3):
    rows = [(i, t, "k", "w", "l") for i, t in texts.items()]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.mark.parametrize("size,percent,blocks", [(3, 85, (2, 5)), (5, 80, (500, 2000))])
def test_components(spark, size, percent, blocks):
    texts = brute.awkward()
    p = minhash.NearDup(shingle_words=size, percent=percent, left_block=blocks[0], right_block=blocks[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.components(table(spark, texts), p).collect()}
    assert got == brute.components(texts, size, percent)


def test_survivors_keep_the_columns(spark):
    texts = brute.awkward()
    out = minhash.survivors(table(spark, texts))
    assert out.columns == ["doc_id", "text", "kept", "n_words", "label"]
    want = brute.components(texts, 5, 80)
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.components(rows).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False)]
    none = rows.filter("false")
    assert minhash.components(none).count() == 0
    assert substring.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert sorted(r.n_removed for r in substring.remove_repeats(rows, substring.Repeats(window=4)).collect()) == [0, 0, 6]


def test_survivors_hold_repeated_rows_once(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "p"), (1, text, "p"), (1, text + " ", "p"), (2, text, "q"), (3, "other", "r"), (3, "other", "r"), (3, "other", "r"), (4, "alone", "s"), (5, None, "t"), (5, None, "t")]
    out = minhash.survivors(spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3)).collect()
    assert sorted(map(tuple, out), key=lambda r: r[0]) == [(1, text, "p"), (3, "other", "r"), (4, "alone", "s"), (5, None, "t")]


def test_repeated_rows_lose_passages_one_by_one(spark):
    passage = "a b c d e f g h"
    rows = [(1, passage, "p"), (2, "x " + passage, "q"), (2, "x " + passage, "q"), (2, passage + " y z", "r"), (2, "whole", "s"), (2, None, "t")]
    out = substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, text_md5 string").repartition(3), substring.Repeats(8, with_text=True)).collect()
    assert sorted(map(tuple, out), key=lambda r: r[2]) == [(1, passage, "p"), (2, "x", "q"), (2, "x", "q"), (2, "y z", "r"), (2, "whole", "s"), (2, None, "t")]


def test_connected_follows_long_chains(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n) if i % 100 != 99] + [(5, 5)], "a long, b long")
    got = {r.node: r.label for r in common.connected(edges, "a", "b").collect()}
    assert all(got[i] == i // 100 * 100 for i in range(n))


def test_bands_follow_the_threshold():
    assert minhash.NearDup(percent=85).bands == 28 and minhash.NearDup().bands == 41 and minhash.NearDup(percent=100).bands == 1
    for percent in (50, 70, 80, 85, 95):
        p = minhash.NearDup(percent=percent)
        assert (1 - (percent / 100) ** p.rows) ** p.bands < 1e-7


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    both, a, b = (rng.integers(1, 1 << 62, k).astype(np.uint64) for k in (800, 100, 100))
    sets = [np.sort(np.concatenate([both, x])) for x in (a, b)]
    sig = minhash.signatures(np.concatenate(sets), np.array([900, 900]), 2000)
    assert abs((sig[:, 0] == sig[:, 1]).mean() - 0.8) < 0.04


@pytest.mark.parametrize("window", [4, 13, 50])
def test_word_repeats(spark, window):
    texts = brute.awkward()
    got = {r.doc_id: r for r in substring.remove_repeats(table(spark, texts), substring.Repeats(window, with_text=True)).collect()}
    for i, (n, removed, kept) in brute.without_word_repeats(texts, window).items():
        assert (got[i].n_words, got[i].n_removed) == (n, removed), i
        assert got[i].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest(), i
        assert not removed or got[i].kept_text == " ".join(kept)


def test_texts_that_lose_nothing_stay(spark):
    texts = brute.awkward()
    out = substring.without_repeats(table(spark, texts), substring.Repeats(50, with_text=True))
    assert out.columns == ["doc_id", "text", "kept", "n_words", "label"]
    got, want = {r.doc_id: r.text for r in out.collect()}, brute.without_word_repeats(texts, 50)
    assert got.keys() == texts.keys()
    assert all(got[i] == (texts[i] if not want[i][1] else " ".join(want[i][2])) for i in texts)


@pytest.mark.parametrize("length,gram", [(100, 32), (20, 8)])
def test_byte_repeats(spark, length, gram):
    texts = {i: t for i, t in brute.awkward().items() if i not in (6, 7)} | {6: brute.prose(random.Random(9), 3000)}
    p = suffix_dedup.SuffixRepeats(length, gram, with_bytes=True)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, texts), p).collect()}
    for i, want in brute.without_byte_repeats(texts, length).items():
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i
        assert hashlib.sha256(got[i].kept).hexdigest() == want[3]


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(4)

    class Run:
        def __init__(self, texts):
            self.texts, self.i, self.n = sorted(texts), -1, len(texts)
            self.shared = [0] + [suffix_dedup.common_prefix(a, b, 0) for a, b in zip(self.texts, self.texts[1:])]

        def step(self):
            self.i += 1
            self.text = self.texts[self.i] if self.i < self.n else b""
            return self.i < self.n

    for k in (1, 2, 3, 7, 16):
        runs = [Run([bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 30))]) for _ in range(k)]
        which, where, shared = suffix_dedup.merged(runs)
        out = [runs[r].texts[i] for r, i in zip(which, where)]
        assert out == sorted(t for r in runs for t in r.texts)
        assert all(shared[i] == suffix_dedup.common_prefix(out[i - 1], out[i], 0) for i in range(1, len(out)))


def test_common_prefix():
    for a, b in ((b"", b""), (b"a" * 50, b"a" * 49 + b"b"), (b"abc", b"abcd"), (b"\x00", b"\x01"), (b"x" * 16 + b"q", b"x" * 16 + b"z")):
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert suffix_dedup.common_prefix(a, b, 0) == want == suffix_dedup.common_prefix(a, b, min(want, 1))


def test_hash_helpers_over_document_borders():
    column = pa.array(["ab cd", None, "", "cd ab cd"])
    data, off = common.flat(column)
    start, end, w_off = common.words(data, off)
    assert [bytes(data[s:e]).decode() for s, e in zip(start, end)] == ["ab", "cd", "cd", "ab", "cd"] and w_off.tolist() == [0, 2, 2, 2, 5]
    h = common.word_hashes(data, start, end)
    assert h[0] == h[3] and h[1] == h[2] == h[4] and h[0] != h[1]
