"""Mixing, token shards, WARC files and the pipeline."""

import hashlib
import io
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stratopoint.llm import common, minhash, mixing, queries, quality, sentencepiece_codec, substring, token_store, warc

from . import brute

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def sourced(spark, n=600):
    rng = random.Random(8)
    rows = [(i, rng.choice(["big"] * 8 + ["mid", "mid", "small", None]), brute.prose(rng, rng.randint(0, 40)) if i % 50 else None, "b") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, block string")


def test_mixture_shows_everything_within_the_limits(spark):
    p = mixing.MixTarget(entropy=1.0, max_repeats=2.0, block_tokens=500, bucket_tokens=300)
    rows = mixing.mix(sourced(spark), p).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    assert {r.doc_id for r in rows} == set(range(600))
    size = {s: sum(r.n_tokens for r in x if r.epoch == 0) for s, x in by.items()}
    shown = {s: sum(r.n_tokens for r in x) / size[s] for s, x in by.items()}
    assert min(shown.values()) >= 1 and max(shown.values()) < 2.1 and shown["big"] < 1.1 and shown["small"] > 1.8
    for x in by.values():                       # streams without gaps, every document once an epoch
        x.sort(key=lambda r: r.first_token)
        assert all(a.first_token + a.n_tokens == b.first_token for a, b in zip(x, x[1:]))
        assert len({(r.doc_id, r.epoch) for r in x}) == len(x)
    blocks = {}
    for r in rows:
        blocks.setdefault(r.block, []).append(r)
    assert all(sorted(r.place for r in x) == list(range(1, len(x) + 1)) for x in blocks.values())
    assert max(sum(r.n_tokens for r in x) for x in blocks.values()) < 500 + 5 * 40


def test_entropy_target_is_met(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, total long")
    for target in (0.6, 0.8, 0.95):
        a = mixing.exponent(sources, mixing.MixTarget(entropy=target, max_repeats=None))
        p = np.array([1000.0, 100, 10]) ** a
        p /= p.sum()
        assert abs(-(p * np.log(p)).sum() / np.log(3) - target) < 1e-6
    assert mixing.exponent(sources, mixing.MixTarget(entropy=0.1, max_repeats=None)) == 1.0
    a = mixing.exponent(sources, mixing.MixTarget(entropy=1.0, max_repeats=5.0))
    assert abs(100 ** (1 - a) - 5) < 1e-6


def test_mixing_edges(spark):
    empty = sourced(spark).filter("false")
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    out = mixing.mixed(sourced(spark), mixing.MixTarget(block_tokens=500))
    assert out.columns == ["doc_id", "source", "text", "block"] and out.select("doc_id").distinct().count() == 600
    twice = spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (None, "a", "z")], "doc_id long, source string, text string")
    assert sorted(r.first_token for r in mixing.mix(twice).collect()) == [0, 2]


def test_tiny_sources_stay_within_the_limit(spark):
    sources = spark.createDataFrame([*((f"s{i}", 200_000_000) for i in range(20)), ("small", 400), ("tiny", 100)], "source string, total long")
    shown = {r.source: r.quota / r.total for r in mixing.weights(sources, mixing.MixTarget(max_repeats=2.0)).collect()}
    assert min(shown.values()) >= 1 and max(shown.values()) < 2.01 and shown["tiny"] > 1.9


def test_repeated_rows_are_mixed_as_rows(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (1, "a", "z w"), (1, "b", "q"), (2, "a", "u v"), (3, "b", None), (3, "b", None), (None, "a", "gone")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    p = mixing.MixTarget(entropy=None, max_repeats=None)
    assert mixing.mix(docs, p).count() == 7
    key = lambda r: tuple(map(str, r))
    assert sorted(mixing.mixed(docs, p).collect(), key=key) == sorted(rows[:-1], key=key)


def test_minimal_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        raw = token_store.shard_bytes(keys, np.arange(len(keys) + 1), np.arange(len(keys)) % 60_000, 2, 2.0)
        shard = token_store.Shard(raw)
        assert (shard.find(keys) == np.arange(len(keys))).all()
        others = np.setdiff1d(rng.integers(-(1 << 62), 1 << 62, 5000), keys)
        assert (shard.find(others) >= 0).mean() < 0.01


def test_token_store(spark, tmp_path):
    texts = brute.awkward() | {300: "a <|endoftext|> b", 301: "x<|endoftext|>"}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, start int").repartition(3)
    folder = token_store.write(docs, token_store.StoreFormat(TOKENIZER, shard_tokens=3000), str(tmp_path / "store"))
    library, start = Tokenizer.from_file(TOKENIZER), 0
    got = {r.doc_id: r for r in token_store.scan(spark, folder).collect()}
    for i in sorted(texts):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    keys = spark.createDataFrame([(3,), (60,), (999,), (None,), (60,), (-5,)], "doc_id long")
    found = {r.doc_id: r.ids for r in token_store.lookup(keys, folder).collect()}
    assert found == {i: [*library.encode(texts[i], add_special_tokens=False).ids, 2] for i in (3, 60)}


def test_token_store_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (1, "b c"), (None, "d"), (2, None)], "doc_id long, text string")
    rows = token_store.scan(spark, token_store.write(docs, token_store.StoreFormat(TOKENIZER), str(tmp_path / "a"))).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == [(1, 2), (1, 3), (2, 1)] and {r.start for r in rows} in ({0, 2, 5}, {0, 3, 5})
    none = token_store.write(docs.filter("false"), token_store.StoreFormat(TOKENIZER), str(tmp_path / "b"))
    assert token_store.scan(spark, none).count() == 0 and token_store.lookup(docs.select("doc_id"), none).count() == 0


def test_units_encode_like_whole_texts():
    encode, library = token_store.Encoder(open(TOKENIZER, encoding="utf-8").read()), Tokenizer.from_file(TOKENIZER)
    rng = random.Random(5)
    signs = ["a", "B", "é", "ß", "日", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "'ll", "1", "23", ".", "<|endoftext|>", "<|", "　", "\x85", "the", " of", "—", "😀", "\x1c", "²"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        data = np.frombuffer(text.encode(), np.uint8)
        assert encode(data, np.array([0, len(data)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_warc_round_trip(spark, tmp_path):
    long_page = "<p>" + "q" * 3_000_000
    rows = [(5, "http://a/ö b", "x" * 200, 1), (3, None, "x" * 200, 1), (9, "http://c", "x" * 99, 1), (8, "http://c", "x" * 99, 1), (1, "http://d\r\nX: y", None, 1),
            (2, "", "", 1), (7, "http://e", long_page, 1), (6, "u", "é" * 60, 1), (None, "u", "gone", 1), (11, "u", "é" * 60, 1), (12, "u", "a\r\n\r\nb\x00", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int")
    folder = warc.write(pages, str(tmp_path / "w"), warc.Archive(file_bytes=2000))
    got = {int(r.record_id.rpartition(":")[2]): r for r in warc.read(spark, folder).collect()}
    assert sorted(got) == sorted(r[0] for r in rows if r[0] is not None)
    for page, _, html, _ in rows:
        if page is not None:
            raw = (html or "").encode()
            r = got[page]
            assert (r.payload_length, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
            assert bytes(r.payload) == (b"" if r.record_type == "revisit" else raw)
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: "urn:page:3", 11: "urn:page:6"}
    empty = warc.write(pages.filter("false"), str(tmp_path / "e"))
    assert warc.read(spark, empty).count() == 0


def test_warc_of_repeated_ids_and_lost_attempts(spark, tmp_path):
    a, b = "A" * 150, "B" * 150
    rows = [(1, "u", a), (5, "u", a), (5, "u", b), (7, "u", b), (7, "u", b), (7, "u", "short"), (1, "v", a)]
    folder = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    (tmp_path / "w" / "records" / "0000099-00000.warc.gz").write_bytes(b"what a lost attempt left")
    got = sorted((r.record_id, r.record_type, r.refers_to or "", bytes(r.payload or b"").decode()) for r in warc.read(spark, folder).collect())
    name = warc.record_id
    assert got == sorted([(name(1), "response", "", a), (name(1), "response", "", a), (name(5), "revisit", name(1), ""), (name(5), "response", "", b),
                          (name(7), "revisit", name(5), ""), (name(7), "revisit", name(5), ""), (name(7), "response", "", "short")])


def test_warc_reader_refuses_damage():
    a = warc.Archive()
    body = b"hello" * 30
    raw = warc.record("response", 1, "http://a", body, hashlib.sha256(body).hexdigest(), None, a)
    member = warc._member(raw, 6)
    assert [r[1] for r in warc.records(io.BytesIO(member * 3), "f")] == [0, len(member), 2 * len(member)]
    assert len(list(warc.records(io.BytesIO(raw * 3), "f"))) == 3
    for broken in (warc._member(raw.replace(b"hellohello", b"hellojello", 1), 6), member[:-20], warc._member(raw + b"more", 6), warc._member(raw[:-4], 6)):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(io.BytesIO(broken), "f"))


def test_pipeline_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {i for i, k in con.execute(f"SELECT doc_id, kept FROM ({queries.QUALITY_SQL})").fetchall() if k}
    good = common.stage(corpus_pipeline.quality_rules(spark, docs, sf), "q")
    texts = {r.doc_id: r.text for r in good.collect()}
    assert set(texts) == want and good.columns == docs.columns
    near = common.stage(corpus_pipeline.near_duplicates(spark, good, sf), "n")
    alone = {i: texts[i] for i, (_, c) in brute.components(texts, 5, 80).items() if c == i}
    assert {r.doc_id: r.text for r in near.collect()} == alone
    cut = common.stage(corpus_pipeline.repeated_passages(spark, near, sf), "r")
    plain = brute.without_word_repeats(alone, 50)
    left = {i: t if not plain[i][1] else " ".join(plain[i][2]) for i, t in alone.items()}
    assert {r.doc_id: r.text for r in cut.collect()} == left
    mix = common.stage(corpus_pipeline.source_mixture(spark, cut, sf), "m")
    assert mix.columns == docs.columns and {r.doc_id: r.text for r in mix.collect()} == left
    shown = sorted((r.doc_id, r.epoch) for r in mixing.mix(cut).collect())
    assert sorted(r.doc_id for r in mix.collect()) == [i for i, _ in shown]
    last = corpus_pipeline.run(spark, sf)
    back = sentencepiece_codec.decode(last).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("text").alias("a"), F.max("text").alias("b")).collect()
    assert {r.doc_id: r.a for r in back} == left and all(r.a == r.b for r in back)
    assert sum(r.n for r in back) == len(shown)


def test_parameters_of_the_pipeline():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "minhash near-dedup", "substring dedup", "mixing sources", "sentencepiece"]
    assert minhash.NearDup() == minhash.NearDup(5, 80) and quality.QualityRules().max_lost_percent == 50 and substring.Repeats(50).block == 25
