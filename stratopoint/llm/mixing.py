"""Mixing sources to target weights: temperature mixing, native DataFrame operations only.

The token shares of the sources are raised to an exponent between 0 (uniform) and 1 (proportional). The
exponent is bisected: the largest one that meets a target entropy, raised further until no source repeats
more than a limit. The normalised weights are then realised as *budgeted block permutations*: the budget is
the smallest that shows every document once (or a given one); every source gets its share of the budget
as whole epochs plus a part of one, each epoch in an order of its own; the stream is cut into blocks of equal
budget that hold all sources in proportion, and every block is permuted.

Scale: a bisection job aggregates the sources for 31 midpoints (five halvings) and returns 31 rows. Running
token counts are never taken over a whole source: documents fall into buckets of about ``bucket_tokens`` by
their place in the epoch's order, buckets are summed before the shuffle, and running counts inside a bucket
add to those of the buckets before it. So a source with a third of all rows is as many tasks as its tokens ask for.

Defined results: a document costs its number of words, one at least (so null and empty texts cost one). A null
source is a source of its own, named ''. Rows with a null id are left out; repeated rows are rows of their own.
Empty tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common

MADE = ["n_tokens", "epoch", "block", "place", "first_token"]


@dataclass(frozen=True)
class MixTarget:
    entropy: float | None = 0.999         # share of the entropy of equal weights
    max_repeats: float | None = 2.0       # of the source shown most often, when the one shown least is shown once
    budget: int | None = None             # tokens in all; None: the smallest that shows every document once
    block_tokens: int = 1 << 18
    bucket_tokens: int = 1 << 20
    halvings: int = 8                     # jobs of five bisection steps each
    seed: str = "mix"


def tokens(text: str) -> Column:
    return F.greatest(F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("long")


def _bisected(shares: DataFrame, met: Column, steps: int) -> float:
    """The largest exponent in [0, 1] for which ``met`` holds, an aggregate that fails beyond some exponent.

    ``shares``: (x = log tokens); ``met`` may use x and a, the exponent."""
    lo, hi = 0.0, 1.0
    for step in range(steps + 1):
        tried = [1.0] if step == 0 else [lo + (hi - lo) * k / 32 for k in range(1, 32)]
        got = shares.select("x", F.explode(F.array(*map(F.lit, tried))).alias("a")).groupBy("a").agg(met.alias("met")).filter("met").agg(F.max("a")).first()[0]
        if step == 0:
            if got is not None:
                return 1.0
            continue
        width = (hi - lo) / 32
        lo = lo if got is None else got
        hi = lo + width
    return lo


def exponent(sources: DataFrame, p: MixTarget) -> float:
    """The mixing exponent for (source, total) rows."""
    shares = sources.select(F.log("total").alias("x"))
    norm = F.sum(F.exp(F.col("x") * F.col("a")))
    entropy = F.log(norm) - F.sum(F.col("x") * F.col("a") * F.exp(F.col("x") * F.col("a"))) / norm
    out = 1.0 if p.entropy is None else _bisected(shares, entropy >= F.lit(p.entropy) * F.log(F.count("*")), p.halvings)
    if p.max_repeats is not None:
        spread = (F.max("x") - F.min("x")) * F.col("a")            # a is one minus the exponent here
        out = max(out, 1 - _bisected(shares, F.exp(spread) <= p.max_repeats, p.halvings))
    return out


def weights(sources: DataFrame, p: MixTarget) -> DataFrame:
    """source, total, parts (its weight, in whole parts) and quota (its tokens in the budget).

    The parts are millionths, or smaller ones where the least weight would else be under 10,000 parts."""
    power = F.exp(F.log("total") * F.lit(exponent(sources, p)))
    norm, least = sources.agg(F.sum(power), F.min(power)).first()
    norm, least = norm or 1.0, least or 1.0
    fine = 10 ** max(6, math.ceil(4 - math.log10(least / norm)))
    out = sources.select("source", "total", F.round(power / norm * float(fine)).cast("decimal(20,0)").alias("parts"))
    whole = lambda number: F.lit(number).cast("decimal(20,0)")
    wanted = out.select((F.col("total").cast("decimal(20,0)") * whole(str(fine)) + F.col("parts") - 1).alias("t"), "parts")
    budget = p.budget if p.budget is not None else wanted.agg(F.max(F.expr("t div parts"))).first()[0] or 0
    return out.withColumn("all", whole(str(int(budget))) * F.col("parts")).withColumn("fine", whole(str(fine))) \
        .withColumn("quota", F.expr("`all` div fine")).drop("all", "fine")


def _draw(p: MixTarget, what: str) -> Column:
    """A 32-bit number for a document and an epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(p.seed + what), "doc_id", "epoch")), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, p: MixTarget = MixTarget(), text: str = "text") -> DataFrame:
    """One row per shown document: doc_id, source, n_tokens, epoch, first_token (of the source's stream), block, place."""
    rows = common.non_null_id(docs).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), tokens(text).alias("n_tokens"))
    rows = common.stage(rows, "tokens")
    sources = common.stage(rows.groupBy("source").agg(F.sum("n_tokens").alias("total")), "sources")
    share = common.stage(weights(sources, p), "weights")
    blocks = -(-int(share.agg(F.sum("quota")).first()[0] or 0) // p.block_tokens)

    shown = rows.join(share.select("source", "total", "quota"), "source") \
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("quota div total")))) \
        .withColumn("draw", _draw(p, "order")) \
        .withColumn("bucket", F.expr(f"draw * (1 + total div {p.bucket_tokens}) div 4294967296"))
    key = ["source", "epoch", "bucket"]
    before = shown.groupBy(*key).agg(F.sum("n_tokens").alias("held"))
    before = before.withColumn("before", F.sum("held").over(Window.partitionBy("source", "epoch").orderBy("bucket")) - F.col("held")).drop("held")
    inside = Window.partitionBy(*key).orderBy("draw", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = shown.join(before, key) \
        .withColumn("first_token", F.col("epoch") * F.col("total") + F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")) \
        .filter("first_token < quota") \
        .withColumn("block", F.floor(F.col("first_token").cast("decimal(20,0)") * blocks / F.col("quota")).cast("long"))
    place = F.row_number().over(Window.partitionBy("block").orderBy(_draw(p, "place"), "doc_id", "epoch", "first_token"))
    return placed.withColumn("place", place.cast("long")).select("doc_id", "source", "n_tokens", "epoch", "first_token", "block", "place")


def mixed(docs: DataFrame, p: MixTarget = MixTarget(), text: str = "text") -> DataFrame:
    """The documents as the mixture shows them, in the columns of the input: files hold whole blocks in order.

    Rows that repeat an id, a source and a length are interchangeable in the mixture and take its rows by number."""
    shown = common.stage(mix(docs, p, text), "shown")
    again = common.stage(common.non_null_id(docs).groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.coalesce("source", F.lit("")).alias("source"), tokens(text).alias("n_tokens"))
    once = rows.join(again, "doc_id", "left_anti").select("row", "doc_id").join(shown.select("doc_id", "block", "place"), "doc_id")
    alike = ["doc_id", "source", "n_tokens"]
    many = rows.join(again, "doc_id", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy(*alike).orderBy(F.col(f"row.`{text}`"))))
    places = shown.join(again, "doc_id", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy(*alike, "epoch").orderBy("first_token")))
    both = once.select("row", "block", "place").union(many.join(places, [*alike, "nth"]).select("row", "block", "place"))
    return both.repartition("block").sortWithinPartitions("block", "place").select("row.*")
