"""One query per operator, over whole tables with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from . import bitmap_join, centroids, common, fingerprints, language_id, minhash, mixing, quality, sentencepiece_codec, substring, suffix_dedup, token_align, token_store, warc
from .registry import ORACLES, QUERIES, query  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"

_RULES = quality.QualityRules()
QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS word,
             generate_subscripts(regexp_extract_all(text, '{WORD}'), 1) AS i FROM d),
wc AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY 1),
win AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {_RULES.window - 1} FOLLOWING) AS ws FROM w),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws) AS c FROM win WHERE len(ws) = {_RULES.window}) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM twice, range({_RULES.window}) r(k) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS li FROM d),
lw AS (SELECT *, regexp_extract_all(line, '{WORD}') AS ws, row_number() OVER (PARTITION BY doc_id, line ORDER BY li) AS nth FROM l),
lf AS (SELECT doc_id, nth, len(ws) AS n,
              (NOT regexp_matches(ws[-1], '[.!?:;"'')\]’”…。！？»›]$')
               AND 100 * len(list_filter(ws, lambda x: regexp_matches(x, '[.!?:;,]$'))) < {_RULES.inner_percent} * len(ws))
              OR 100 * len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) >= {_RULES.stutter_percent} * len(ws)
              OR 100 * len(regexp_extract_all(line, '[#*$%&|<>]')) > {_RULES.symbol_percent} * length(list_aggregate(ws, 'string_agg', ''))
              OR (len(list_filter(ws, lambda x: x IN ('|', '>'))) >= {_RULES.menu_separators}
                  AND 100 * len(list_filter(ws, lambda x: x IN ('|', '>'))) >= {_RULES.menu_percent} * len(ws))
              OR (regexp_matches(line, '(?i){"|".join(quality.PHRASES)}') AND len(ws) <= {_RULES.phrase_words}) AS bad
       FROM lw WHERE len(ws) > 0),
lc AS (SELECT doc_id, sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) AS n_dup, sum(CASE WHEN bad THEN n ELSE 0 END) AS lost FROM lf GROUP BY 1),
f AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
             coalesce(n_repeat, 0) AS n_repeat_words, coalesce(lost, 0) AS n_lost_words
      FROM d LEFT JOIN wc USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lc USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, n_lost_words::BIGINT AS n_lost_words,
       n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS base_failed,
       NOT (n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words)
       AND 100 * n_lost_words <= {_RULES.max_lost_percent} * n_words AS kept
FROM f
"""


@query("op8_line_quality", QUALITY_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    return quality.line_quality(docs, _RULES, with_text=False)


MINHASH_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
      FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [list_aggregate(ws, 'string_agg', ' ')]
                                 ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM d),
u AS (SELECT DISTINCT doc_id, g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY 1),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
sym AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.x = doc_id
"""


@query("op7_near_duplicates", MINHASH_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    return minhash.components(docs, minhash.NearDup(shingle_words=3, percent=85))


SUBSTRING_SQL = rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS word,
                  generate_subscripts(regexp_extract_all(coalesce(text, ''), '{WORD}'), 1) AS i FROM documents),
win AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS ws FROM w),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY ws) AS low FROM win WHERE len(ws) = 13) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, range(13) r(k)),
k AS (SELECT w.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY w.i) AS kept
      FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""


@query("op9_substring_dedup", SUBSTRING_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    return substring.remove_repeats(docs, substring.Repeats(window=13)).drop("kept_text")


_MIX = mixing.MixTarget()
MIXING_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source,
                            greatest(len(regexp_extract_all(coalesce(text, ''), '{WORD}')), 1)::BIGINT AS n_tokens FROM documents),
t AS (SELECT source, sum(n_tokens)::BIGINT AS total FROM d GROUP BY 1),
x AS (SELECT list(ln(total) ORDER BY source) AS x FROM t),
ent AS (SELECT 0 AS step, 0e0 AS lo, 1e0 AS hi, 1e0 AS a, x FROM x
        UNION ALL
        SELECT step + 1, CASE WHEN ok THEN a ELSE lo END, CASE WHEN ok AND step > 0 THEN hi WHEN ok THEN 1e0 ELSE a END,
               CASE WHEN ok AND step = 0 THEN 1e0 WHEN ok THEN (a + hi) / 2 ELSE (lo + a) / 2 END, x
        FROM (SELECT *, ln(list_sum(list_transform(x, lambda v: exp(v * a))))
                        - list_sum(list_transform(x, lambda v: v * a * exp(v * a))) / list_sum(list_transform(x, lambda v: exp(v * a)))
                        >= {_MIX.entropy} * ln(len(x)) AS ok FROM ent) WHERE step < 41),
rep AS (SELECT greatest(0e0, CASE WHEN list_max(x) > list_min(x) THEN 1 - ln({_MIX.max_repeats}) / (list_max(x) - list_min(x)) ELSE 0 END) AS a FROM x),
alpha AS (SELECT greatest((SELECT lo FROM ent ORDER BY step DESC LIMIT 1), (SELECT a FROM rep)) AS a),
fine AS (SELECT (10 ** greatest(6, ceil(4 - log10(min(exp(ln(total) * a)) / sum(exp(ln(total) * a))))))::HUGEINT AS fine FROM t, alpha),
w AS (SELECT source, total, fine, round(exp(ln(total) * a) / (sum(exp(ln(total) * a)) OVER ()) * fine)::HUGEINT AS parts FROM t, alpha, fine),
b AS (SELECT *, max((total::HUGEINT * fine + parts - 1) // parts) OVER () AS budget FROM w),
q AS (SELECT source, total, (budget * parts // fine)::BIGINT AS quota FROM b),
n AS (SELECT ((sum(quota) + {_MIX.block_tokens} - 1) // {_MIX.block_tokens})::BIGINT AS blocks FROM q),
e AS (SELECT doc_id, source, n_tokens, total, quota, unnest(range(quota // total + 1)) AS epoch FROM d JOIN q USING (source)),
h AS (SELECT *, ('0x' || substr(md5('{_MIX.seed}order/' || doc_id || '/' || epoch), 1, 8))::BIGINT AS draw,
             ('0x' || substr(md5('{_MIX.seed}place/' || doc_id || '/' || epoch), 1, 8))::BIGINT AS draw2 FROM e),
p AS (SELECT *, epoch * total + sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY draw, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS first_token FROM h),
k AS (SELECT *, (first_token::HUGEINT * blocks // quota)::BIGINT AS block FROM p, n WHERE first_token < quota)
SELECT doc_id, source, n_tokens, epoch::BIGINT AS epoch, first_token::BIGINT AS first_token, block,
       row_number() OVER (PARTITION BY block ORDER BY draw2, doc_id, epoch, first_token)::BIGINT AS place
FROM k
"""


@query("op1_mix_sources", MIXING_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.documents(spark, sf_dir, "doc_id", "source", "text"), _MIX)


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(common.documents(spark, sf_dir, "doc_id", "text"))


@query("op10_token_store")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    fmt = token_store.StoreFormat(public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.scan(spark, token_store.write(common.documents(spark, sf_dir, "doc_id", "text"), fmt))


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(common.documents(spark, sf_dir, "doc_id", "text")).drop("kept")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.filter(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model)


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND low < page_id THEN low END AS refers_to
FROM f
"""


@query("op6_warc", WARC_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).cast("long")
    return warc.read(spark, folder, with_payload=False).select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"))


@query("op4_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_halves(common.documents(spark, sf_dir, "doc_id", "text"))


_CLUSTERS = centroids.Clustering()


def _centroid_sql(p: centroids.Clustering) -> str:
    """The rounds written out; a distance and its cluster are ordered as one number, so ties go to the smaller cluster."""
    k = p.clusters
    assign = lambda c: f"""SELECT vec_id, any_value(v.x) AS x, min(list_sum(list_transform(list_zip(v.x, m), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::HUGEINT * {k} + c) AS dc
        FROM v, c{c} GROUP BY vec_id"""  # noqa: E731
    parts = [f"""v AS (SELECT vec_id, list_transform(embedding, lambda e: floor({p.scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) = {p.dimensions} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {p.dimensions})""",
             f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('{p.seed}:' || vec_id)) - 1 AS c, x AS m FROM v ORDER BY sha256('{p.seed}:' || vec_id) LIMIT {k})"""]
    for r in range(p.rounds):
        parts += [f"a{r} AS ({assign(r)})",
                  f"""s{r} AS (SELECT c, i, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT dc % {k} AS c, unnest(x) AS e, unnest(range({p.dimensions})) AS i FROM a{r}) GROUP BY 1, 2)""",
                  f"m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS m FROM s{r} GROUP BY 1)",
                  f"c{r + 1} AS (SELECT c, coalesce(m{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN m{r} USING (c))"]
    return f"""WITH {', '.join(parts)}, f AS ({assign(p.rounds)}), o AS (SELECT vec_id, (dc % {k})::INTEGER AS cluster, (dc // {k})::BIGINT AS distance FROM f)
        SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(m, ',')) AS centroid_sha256 FROM o JOIN c{p.rounds} ON c = cluster"""


@query("op11_centroid_clusters", _centroid_sql(_CLUSTERS))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), _CLUSTERS)


JACCARD_SQL = MINHASH_SQL.replace("85 * (p.n + q.n - i)", "90 * (p.n + q.n - i)").replace(", doc_id = component_id AS kept", "")


@query("op13_jaccard_join", JACCARD_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    return bitmap_join.components(docs, bitmap_join.JaccardJoin(shingle_words=3, percent=90))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pair = token_align.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return token_align.alignment(common.documents(spark, sf_dir, "doc_id", "text"), pair)
