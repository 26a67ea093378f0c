"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of times each of its documents is to appear, so that the source has its target
share of all words of the mix. Every document draws its number of copies from a Poisson distribution with that mean:
a hash of seed and id is a number in [0, 1), and the count is the number of cumulative probabilities that do not
exceed it. A large mean is drawn as the sum of several independent draws with an equal part of it each, which has the
same distribution. Documents are exploded by their count and dealt out by another hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import unit_hash
from plumbline.session import settle

SEED = "mix-1"
#: Target weight of a source without one of its own: its number of characters to this power. Powers below 1
#: raise small sources above their share.
POWER = 0.5
#: Largest rate of one draw: the cumulative probabilities are computed by a product that starts at exp(-rate). Higher
#: rates are split over several draws.
LARGEST_RATE = 500.0
#: Copies of a document that are listed at once.
COPIES = 10_000


def steps(rate: float) -> int:
    """So many counts that the probability of more is below the resolution of the hash."""
    return math.ceil(rate + 10 * math.sqrt(rate) + 30)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, scale: float = 1.0) -> DataFrame:
    """(source, rate): mean copies per document. Weights are relative; the mix has about *scale* times the
    characters of the input. Sources not in *weights* have their characters to *power* as weight. Documents
    without text have no characters; a source of such documents has rate 0."""
    size = F.coalesce(F.length("text"), F.lit(0))
    sized = docs.groupBy("source").agg(F.sum(size).cast("double").alias("chars"))
    weight = F.pow("chars", F.lit(power))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    sized = settle(sized.withColumn("weight", weight))
    sums = sized.filter("chars > 0").agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.lit(float(scale)) * F.col("all_chars") * F.col("weight") / F.col("all_weight") / F.col("chars")
    return settle(sized.join(sums, F.lit(True), "left").select(
        "source", F.when(F.col("chars") > 0, rate).otherwise(0.0).alias("rate")))


def poisson(rate: Column, draw: Column) -> Column:
    """Number of cumulative Poisson probabilities at or below *draw*."""
    many = F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.lit(0).alias("n"))
    end = F.aggregate(
        F.sequence(F.lit(1), many), start,
        lambda s, k: F.struct((s["p"] * rate / k).alias("p"), (s["sum"] + s["p"] * rate / k).alias("sum"),
                              (s["n"] + F.when(s["sum"] <= draw, 1).otherwise(0)).alias("n")))
    return end["n"].cast("long")


def copies_of(rate: Column, seed: str, key: Column) -> Column:
    """A Poisson number with mean *rate*: the sum of as few draws as have at most LARGEST_RATE each. The first is
    drawn by seed and key, the others by seed, their number and key."""
    draws = F.greatest(F.ceil(rate / LARGEST_RATE).cast("long"), F.lit(1).cast("long"))
    part = rate / draws
    others = F.when(draws > 1, F.sequence(F.lit(2).cast("long"), draws)).otherwise(F.expr("CAST(array() AS array<bigint>)"))
    return F.aggregate(others, poisson(part, unit_hash(F.lit(seed), key)), lambda n, j: n + poisson(
        part, unit_hash(F.lit(seed), F.lit("draw"), j.cast("string"), key)))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, scale: float = 1.0,
        seed: str = SEED) -> DataFrame:
    """*docs* with ``copy_no`` (from 1) and ``mix_order``, in random order over all files.

    A row appears as often as its draw says, by seed and doc_id; rows that repeat an id, or have none, share
    their draw. A null source is a source of its own. ``mix_order`` is a hash of seed, id and copy in
    [0, 1): rows are dealt to partitions by it and sorted within, so the reading order is a random one. Columns
    of *docs* by the names copy_no and mix_order are replaced. An empty table gives an empty mix.
    """
    found = rates(docs, weights, power, scale)
    kept = docs.drop("copy_no", "mix_order")
    names = kept.columns
    at = {name: f"c{i}" for i, name in enumerate(names)}  # whatever the columns are called
    key = F.coalesce(F.col(at["doc_id"]).cast("string"), F.lit(""))
    # One row per source: Spark broadcasts it while it is below its limit, and splits hot sources beyond it.
    counted = kept.toDF(*at.values()).join(found, F.col(at["source"]).eqNullSafe(F.col("source")))
    counted = counted.withColumn("n", copies_of(F.col("rate"), seed, key)).filter("n > 0")
    # In blocks, so that a document of many copies needs no list of all their numbers.
    blocks = counted.select(*at.values(), "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(COPIES).cast("long"))).alias("low"))
    copies = blocks.select(*at.values(), F.explode(F.sequence(F.col("low"), F.least("n", F.col("low") + (COPIES - 1)))).alias("copy_no"))
    order = unit_hash(F.lit(seed), F.lit("order"), key, F.col("copy_no").cast("string"))
    dealt = copies.withColumn("mix_order", order).repartition(F.col("mix_order")).sortWithinPartitions("mix_order")
    return dealt.toDF(*names, "copy_no", "mix_order")


def op4_mix(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "source", "copy_no", "mix_order", F.md5("text").alias("text_md5"))


OP4_SQL = f"""
WITH sized AS (
    SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM documents GROUP BY source),
sums AS (SELECT sum(chars) AS all_chars, sum(pow(chars, {POWER})) AS all_weight FROM sized WHERE chars > 0),
rates AS (
    SELECT source, CASE WHEN chars > 0
        THEN all_chars * pow(chars, {POWER}) / all_weight / chars ELSE 0.0 END AS rate
    FROM sized CROSS JOIN sums),
parts AS (
    SELECT source, CAST(greatest(1, ceil(rate / {LARGEST_RATE})) AS BIGINT) AS draws, rate / greatest(1, ceil(rate / {LARGEST_RATE})) AS part FROM rates),
cumulative AS (
    SELECT source, k, sum(exp(k * ln(part) - part - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
    FROM parts, range(0, 2000) AS t(k) WHERE part > 0 AND k < ceil(part + 10 * sqrt(part) + 30)),
listed AS (
    SELECT row_number() OVER () AS doc_row, d.doc_id, d.source, d.text, r.draws
    FROM documents d JOIN parts r ON r.source IS NOT DISTINCT FROM d.source),
draws AS (
    SELECT doc_row, source, CAST('0x' || substr(md5('{SEED}:' || CASE WHEN j > 1 THEN 'draw:' || CAST(j AS VARCHAR) || ':' ELSE '' END
        || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
    FROM (SELECT *, unnest(range(1, draws + 1)) AS j FROM listed)),
times AS (
    SELECT doc_row, CAST(sum((SELECT count(*) FROM cumulative c WHERE c.source IS NOT DISTINCT FROM d.source AND c.p <= d.u)) AS BIGINT) AS n
    FROM draws d GROUP BY doc_row),
counted AS (SELECT doc_id, source, text, n FROM listed JOIN times USING (doc_row))
SELECT doc_id, source, copy_no,
    CAST('0x' || substr(md5('{SEED}:order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy_no AS VARCHAR)), 1, 13) AS BIGINT)
        / 4503599627370496.0 AS mix_order,
    md5(text) AS text_md5
FROM (SELECT doc_id, source, text, unnest(range(1, n + 1)) AS copy_no FROM counted)
"""
