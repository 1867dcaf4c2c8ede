"""Quality rules, fingerprints, language profiles and pieces."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from stratopoint.llm import common, fingerprints, language_id, quality, queries, sentencepiece_codec

from . import brute

SCHEMA = "doc_id long, text string, kept boolean, pieces string, score double"


def table(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, None, "p", 0.5) for i, t in texts.items()], SCHEMA).repartition(parts)


def figures(text):
    ws = brute.words(text)
    wins = [tuple(ws[i:i + 8]) for i in range(len(ws) - 7)]
    again = {w for w in set(wins) if wins.count(w) > 1} if len(wins) < 3000 else _repeated(wins)
    marked = {i + k for i, w in enumerate(wins) if w in again for k in range(8)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if brute.words(line):
            dups += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(marked)


def _repeated(wins):
    seen, again = set(), set()
    for w in wins:
        (again if w in seen else seen).add(w)
    return again


def test_quality_figures(spark):
    texts = brute.awkward() | {200: "A line.\nA line.\n\nA line. \nB | C | D | E\n", 201: "\n\n", 202: "x\r\ny\r\nx\r\n"}
    got = {r.doc_id: r for r in quality.line_quality(table(spark, texts)).collect()}
    for i, t in texts.items():
        want = figures(t)
        assert tuple(got[i][c] for c in quality.FIGURES) == want, i
        assert got[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[i].base_failed and got[i].kept)


def test_bad_lines_go_and_clean_documents_stay(spark):
    rng = random.Random(2)
    clean = "\n".join(brute.prose(rng, 12) + "." for _ in range(8))
    texts = {1: clean, 2: clean + "\nHome | About | Contact | Help", 3: "Please enable JavaScript.\n" + clean, 4: clean.replace(" ", "### "),
             5: "\n".join(brute.prose(rng, 12) for _ in range(8)), 6: clean.replace("\n", "\n\n") + "\n“Quoted.”"}
    got = {r.doc_id: r for r in quality.line_quality(table(spark, texts)).collect()}
    assert {i for i in got if got[i].kept} == {1, 2, 3, 6}
    assert got[1].text == clean and got[6].text == texts[6]
    assert got[2].text == clean + "\n" and got[3].text == clean
    out = quality.accepted(table(spark, texts))
    assert out.columns == ["doc_id", "text", "kept", "pieces", "score"] and out.count() == 4
    assert quality.accepted(table(spark, texts).filter("false")).count() == 0


def test_fingerprints(spark):
    texts = brute.awkward()
    rows = {r.doc_id: r for r in fingerprints.edited_halves(table(spark, texts, 4)).collect()}
    ids, seen = sorted(texts), {}
    assert sorted(rows) == ids
    for a, b in zip(ids, ids[1:] + ids[:1]):
        x, y = texts[a] or "", texts[b] or ""
        half = len(x) // 2
        edited = x[: len(x) - half] + y[:half]
        assert (rows[a].n_chars, rows[a].edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        for t, f in ((x, rows[a].fingerprint), (edited, rows[a].edited_fingerprint)):
            assert seen.setdefault(t, f) == f
        if x == y:
            assert rows[a].near_next == 1
        assert 0 <= rows[a].near_edited <= 1 and 0 <= rows[a].near_next <= 1
    assert len(set(seen.values())) == len(seen)


def test_fingerprint_edge_tables(spark):
    one = spark.createDataFrame([(4, "alone here"), (None, "x")], "doc_id long, text string")
    (row,) = fingerprints.edited_halves(one).collect()
    assert row.near_next == 1 and row.n_chars == 10
    assert fingerprints.edited_halves(one.filter("false")).count() == 0
    twice = spark.createDataFrame([(i, "same id") for i in (1, 1, 2, 2, 3)], "doc_id long, text string")
    assert [r.near_next for r in fingerprints.edited_halves(twice).collect()] == [1.0] * 5
    extra = spark.createDataFrame([(1, None, "f"), (2, "", "g")], "doc_id long, text string, fingerprint string")
    assert {r.fingerprint for r in fingerprints.fingerprint(extra).collect()} == {"0" * 16}


def test_no_document_of_large_ids_is_lost(spark):
    ids = [(1 << 62) + 3 * i + 1 for i in range(200)] + [-(1 << 62) - 3 * i for i in range(200)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r for r in fingerprints.edited_halves(docs).collect()}
    assert sorted(rows) == sorted(ids)
    for a, b in zip(sorted(ids), sorted(ids)[1:] + [min(ids)]):
        x, y = f"text {a}", f"text {b}"
        assert rows[a].edited_sha256 == hashlib.sha256((x[: len(x) - len(x) // 2] + y[: len(x) // 2]).encode()).hexdigest()


def test_equal_substrings_share_inner_phrases():
    rng = random.Random(1)
    inner = brute.prose(rng, 400)
    sketch = fingerprints.fingerprints([brute.prose(rng, 3) + inner, brute.prose(rng, 7) + inner, brute.prose(rng, 400)])[1]
    assert fingerprints.likeness(sketch[0], sketch[1]) > 0.85 > 0.1 > fingerprints.likeness(sketch[0], sketch[2])


def test_languages_are_told_apart(spark):
    rows = queries.QUERIES["op5_language_id"](spark, "/root/testdata/sf0.001").collect()
    lang = {r.doc_id: (r.lang, r.text) for r in common.documents(spark, "/root/testdata/sf0.001", "doc_id", "lang", "text").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r.held_out and len(lang[r.doc_id][1]) > 100]
    assert len(tested) > 20 and np.mean([r.lang_pred == lang[r.doc_id][0] for r in tested]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    train = spark.createDataFrame([("hello there", "aa"), ("olá você", "bb"), ("nothing", None), (None, "cc"), ("12", "dd")], "text string, lang string")
    model = language_id.train(train)
    docs = spark.createDataFrame([(1, None, "x"), (2, "12 ., 3", "x"), (3, "HELLO there", "x"), (4, "", "x"), (5, "você", "x"), (6, "hello " * 50_000, "x"), (7, "there", "x")],
                                 "doc_id long, text string, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["und", "und", "aa", "und", "bb", "aa", "aa"] and got[1][1] == 0
    nothing = language_id.train(train.filter("false"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_codec.Pieces.load(sentencepiece_codec.default_model())


def test_pieces_have_the_best_score_and_come_back(spark, pieces):
    codec = sentencepiece_codec.Codec(pieces)
    scores = {t: s for t, s, k in zip(pieces.texts, pieces.scores, pieces.kinds) if k == "n"}
    rng = random.Random(6)
    alphabet = list("abcdeiounrst") + [" ", "  ", "\n", "é", "日", "①", "😀", "\t", "▁", ". ", "The ", "ing"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        data = np.frombuffer(text.encode(), np.uint8)
        ids, off = codec.encode(data, np.array([0, len(data)]))
        back, _ = codec.decode(ids, off)
        assert back.tobytes().decode() == text.replace("▁", " ")
        if text:
            full = "▁" + text.replace(" ", "▁")
            unknown = sum(c not in scores for c in full)
            got = sum(pieces.scores[i] for i in ids if pieces.kinds[i] == "n") + unknown * codec.unknown
            assert abs(got - brute.best_pieces(full, scores, codec.unknown)) < 1e-3, text


def test_encode_and_decode_tables(spark):
    texts = brute.awkward()
    encoded = sentencepiece_codec.encode(table(spark, texts))
    assert encoded.columns == ["doc_id", "kept", "score", "n_pieces", "pieces"]
    assert all(r.n_pieces == len(r.pieces) for r in encoded.collect())
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(encoded).collect()}
    assert back == {i: t or "" for i, t in texts.items()}
    assert all(r.same for r in sentencepiece_codec.round_trip(table(spark, texts)).collect())
    assert sentencepiece_codec.encode(table(spark, texts).filter("false")).count() == 0


def test_languages_equal_the_plain_version(spark, sf):
    """Every vector, bundle and cosine in plain Python, on short texts, copies, repeated rows and texts without letters."""
    docs = [(r.doc_id, r.text[:400], r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) > 50").orderBy("doc_id").limit(60).collect()]
    docs += [(9001, "", "en"), (9002, None, "de"), (9003, "12 .. !", "fr"), (9004, "Ünïcödé ÇA Straße", "de"), (9005, "a", None), (9006, "日本語 テキスト", "ja")]
    dims, space = 64, language_id.Space(64)
    texts, langs = {i: t for i, t, _ in docs}, {i: x for i, _, x in docs if x is not None and i % 4 != 2}
    want = brute.languages(texts, langs, lambda sign: space._letter(sign).tolist(), dims)
    df = spark.createDataFrame([*docs, docs[0], docs[0]], "doc_id long, text string, lang string").repartition(3)
    model = language_id.train(df.dropDuplicates(["doc_id"]).filter("doc_id % 4 <> 2"), dims)
    rows = language_id.predict(df, model).collect()
    assert len(rows) == len(docs) + 2
    close = 0
    for r in rows:
        lang, score = want[r.doc_id]
        assert abs(r.score - score) < 1e-4, r.doc_id
        close += r.lang_pred != lang
    assert close == 0
