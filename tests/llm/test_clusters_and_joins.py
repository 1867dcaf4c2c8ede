"""Centroid clusters, the bitmap join and token alignment against brute force, on awkward rows."""

import hashlib
import random

import numpy as np
import pytest

from stratopoint.llm import bitmap_join, centroids, common, token_align

from . import brute


# ---- centroid clustering --------------------------------------------------------------------------------------

def vectors_of(seed, n, dims, blobs):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (blobs, dims))
    return {i: (middle[rng.integers(blobs)] + rng.normal(0, 0.2, dims)).astype(np.float32).tolist() for i in range(n)}


def check_clusters(got, vectors, p):
    want, inertia, final = brute.clusters(vectors, p.clusters, p.rounds, p.scale, p.seed)
    assert {r.vec_id: (r.cluster, r.distance) for r in got} == want
    for r in got:
        assert r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, final[r.cluster])).encode()).hexdigest()


@pytest.mark.parametrize("k,rounds,block,dims,scale", [(16, 3, 8192, 8, 64), (5, 12, 7, 3, 8), (1, 2, 50, 4, 64), (40, 4, 11, 2, 2)])
def test_clusters(spark, k, rounds, block, dims, scale):
    vectors = vectors_of(k, 400, dims, 6)
    vectors |= {1000 + i: vectors[0] for i in range(150)}                    # many copies of one vector
    rows = [(i, v, "a", 1) for i, v in vectors.items()]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, inertia int").repartition(3)
    p = centroids.Clustering(dims, k, rounds, scale, block)
    check_clusters(centroids.cluster(df, p).collect(), vectors, p)


def test_clusters_of_rows_that_are_left_out(spark):
    good = {1: [0.5, 1.0], 2: [0.5, 1.0], 3: [-2.0, 0.25], -7: [1e5, 0.0]}
    bad = [(10, None), (11, []), (12, [1.0]), (13, [1.0, None]), (14, [float("nan"), 0.0]), (15, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([*good.items(), *bad], "vec_id long, embedding array<double>")
    p = centroids.Clustering(2, 16, 3)
    check_clusters(centroids.cluster(df, p).collect(), good, p)              # fewer vectors than clusters
    none = centroids.cluster(df.filter("vec_id > 9"), p)
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    again = centroids.cluster(df.filter("vec_id < 4").union(df.filter("vec_id = 3")), p).collect()
    assert sorted(r.vec_id for r in again) == [-7, 1, 2, 3, 3] and len({r.cluster for r in again if r.vec_id == 3}) == 1
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), p).collect()


def test_only_vectors_with_expired_gaps_are_rescanned():
    vectors = np.array(list(vectors_of(3, 2000, 8, 5).values()))
    x = np.floor(64 * vectors).astype(np.int32)
    block = centroids.Bounds(np.arange(len(x)), x, 5)
    middle, offsets, scans = x[:5].astype(np.int64), np.zeros(5), []
    for _ in range(15):
        rows = block.expired(offsets)
        scans.append(len(rows))
        block.rescan(rows, middle, offsets)
        assert (block.cluster == centroids.squared(x.astype(np.int64), middle).argmin(1)).all()
        assert sorted(r for heap in block.heaps for _, r in heap) == list(range(len(x)))
        block = centroids.Bounds.unpacked(block.packed().to_pylist()[0], 5)
        new = np.array([x[block.cluster == c].sum(0) // max(1, (block.cluster == c).sum()) if (block.cluster == c).any() else middle[c] for c in range(5)], np.int64)
        offsets, middle = centroids.drifted(offsets, middle, new), new
    assert scans[0] == len(x) and scans[-1] == 0 and sum(scans[1:]) < 5 * len(x)


# ---- bitmap join ----------------------------------------------------------------------------------------------

def table(spark, texts, parts=3):
    rows = [(i, t, "k", 1, "l") for i, t in texts.items()]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, bitmap string, n int, label string").repartition(parts)


def close_copies(seed, n=90):
    """Texts of 15 to 600 words on either side of a threshold from each other."""
    rng = random.Random(seed)
    texts = {}
    for size in (15, 33, 60, 200, 600):
        base = brute.prose(rng, size).split()
        for _ in range(n // 5):
            ws = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                at = rng.randrange(len(ws))
                ws[at:at + rng.randint(0, 1)] = [f"w{rng.randrange(50)}"]
            texts[1000 + len(texts)] = " ".join(ws)
    return texts


@pytest.mark.parametrize("size,percent,tile", [(3, 90, 1024), (3, 90, 3), (5, 80, 4), (2, 75, 5)])
def test_jaccard_components(spark, size, percent, tile):
    texts = brute.awkward() | close_copies(size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in bitmap_join.components(table(spark, texts), bitmap_join.JaccardJoin(size, percent, tile)).collect()}
    assert got == brute.components(texts, size, percent)


def test_jaccard_repeated_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, "x y z u v"), (3, "p q r s t"), (4, "p q r s t")],
                                 "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in bitmap_join.components(rows).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3), (3, 1, 3), (4, 1, 3)]
    assert bitmap_join.components(rows.filter("false")).count() == 0


@pytest.mark.parametrize("percent", [75, 80, 90, 95, 100])
def test_linked_sets_always_share_a_tile_key(percent):
    rng, p = np.random.default_rng(percent), bitmap_join.JaccardJoin(percent=percent)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        most = 2 * n * (100 - percent) // (100 + percent)
        swap = int(rng.integers(0, most // 2 + 1))
        a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[swap:], rng.integers(1, 1 << 62, swap).astype(np.uint64)]))
        if bitmap_join.linked(a, b, percent):
            keys, have = bitmap_join.tile_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), p)
            assert set(keys[: have[0]].tolist()) & set(keys[have[0]:].tolist())


def test_bitmaps_bound_the_overlap_from_above():
    rng = np.random.default_rng(5)
    for _ in range(200):
        both = rng.integers(1, 1 << 62, int(rng.integers(1, 300))).astype(np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(1, 1 << 62, int(rng.integers(0, 300))).astype(np.uint64)])) for _ in range(2))
        x, y = (np.frombuffer(bitmap_join.bitmap(s), np.uint8) for s in (a, b))
        n = min(len(x), len(y))
        x, y = bitmap_join.folded(x, n), bitmap_join.folded(y, n)
        most = min(len(a) - int(np.bitwise_count(x & ~y).sum()), len(b) - int(np.bitwise_count(y & ~x).sum()))
        assert most >= len(np.intersect1d(a, b))


def test_a_large_group_is_cut_into_tiles(spark):
    """Four hundred texts that all share parts, half of them not linked: no tile holds more than its sides."""
    rng = random.Random(11)
    base = brute.prose(rng, 120).split()
    texts = {}
    for i in range(400):
        ws = list(base)
        for _ in range(rng.choice([1, 1, 4, 6])):
            ws[rng.randrange(len(ws))] = f"v{rng.randrange(10 ** 6)}"
        texts[i] = " ".join(ws)
    p, seen = bitmap_join.JaccardJoin(3, 90, tile=25), []
    make = bitmap_join.links

    def watched(tiles, *rest):
        seen.append(max((r["count"] for r in tiles.groupBy("tile").count().collect()), default=0))
        return make(tiles, *rest)

    bitmap_join.links = watched
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in bitmap_join.components(table(spark, texts), p).collect()}
    finally:
        bitmap_join.links = make
    assert got == brute.components(texts, 3, 90)
    assert seen and max(seen) < 4 * p.tile


# ---- token alignment ------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def pair():
    import public_tokenizers

    return token_align.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def plain_tokens(pair):
    """Both tokenizers called text by text, with the bytes of every token."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(pair.a)
    a.encode_special_tokens = True
    names = {i: t for t, i in a.get_vocab().items()}
    stands = {}
    extra = 256
    for byte in range(256):                                   # the byte-level alphabet, from its definition
        if 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or byte >= 0xAE:
            stands[chr(byte)] = byte
        else:
            stands[chr(extra)] = byte
            extra += 1
    b = SentencePieceProcessor(model_file=pair.b)
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return (lambda t: [(i, bytes(stands[c] for c in names[i])) for i in a.encode(" " + t, add_special_tokens=False).ids],
            lambda t: [(i, piece(i)) for i in b.encode(t)])


@pytest.mark.parametrize("lane_links", [1 << 24, 3000])
def test_alignment(spark, pair, sf, monkeypatch, lane_links):
    monkeypatch.setattr(token_align, "LANE_LINKS", lane_links)
    texts = [(i, t) for i, t in brute.awkward().items() if i not in (6, 7)]
    texts += [(200, "a <|endoftext|> b</s><s> <0x41>"), (201, "mark ▁ inside"), (202, " leading  and   trailing  "), (203, "don't we'LL 12345 x_y"), (204, "naïve 😀 é\r\n\ttab"),
              (205, "\x00\x01 odd"), (206, "x" * 3000), (207, "   "), (208, "<unk>")]
    texts += [(1000 + i, "one text that many documents hold") for i in range(300)]
    texts += [(r.doc_id + 10_000, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 4000").collect()]
    rows = [(i, t, 1) for i, t in texts]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int").repartition(5)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in token_align.alignment(df, pair).collect()}
    want = brute.alignment(texts, *plain_tokens(pair))
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == want[i], i
    assert want[201][0] == 0 and want[200][0] > 0


def test_alignment_of_repeated_rows_null_ids_and_empty_tables(spark, pair):
    rows = spark.createDataFrame([(1, "two words"), (1, "two words"), (None, "two words"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(map(tuple, token_align.alignment(rows, pair).collect()))
    assert [r[0] for r in got] == [1, 1, 2, 3] and got[0] == got[1] and got[0][6] == 2 * got[0][4] and got[2][1:] == (0,) * 6 + ("",)
    assert token_align.alignment(rows.filter("false"), pair).count() == 0


def test_a_text_in_a_third_of_all_documents_is_one_row(spark, pair):
    rows = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot text', concat('text ', id)) as text")
    got = {r.doc_id: r for r in token_align.alignment(rows, pair).collect()}
    assert len(got) == 3000 and len({(got[i].count_sum, got[i].groups_sha256) for i in range(0, 3000, 3)}) == 1
    assert got[0].count_sum >= 1000 * got[0].n_links


def test_gather_of_strings():
    s = token_align.Strings([b"a", b"", b"xyz"])
    data, off = s.joined(np.array([2, 1, 0, 2]))
    assert data.tobytes() == b"xyzaxyz" and off.tolist() == [0, 3, 3, 4, 7]
    assert common.per_row(np.array([1, 1, 1]), np.array([0, 1, 3])).tolist() == [1, 2]
