"""Similar incidents by shared words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import tokens
from plumbline.session import settle, spread

# Limits and thresholds of the incident search.
CANDIDATES = 100
MIN_SCORE = 0.3
HIGH_SCORE = 0.6
TOP = 5
KEYWORDS = 5
HIGH_NOTE = "High semantic overlap in terminology."
MODERATE_NOTE = "Moderate conceptual similarities found."
SAME_RULE_NOTE = " Triggered by the exact same rule."


def incident_text(severity: Column, summary: Column) -> Column:
    return F.concat(F.lit("Severity "), severity, F.lit(". "), summary)


def measured(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, norm, counts array<struct<term, n>>), computed inside the row: nothing is shuffled.

    In the sorted word list a term's count is the distance between the ends of neighbouring runs.
    Each step is a column of its own, so that it is computed once per text. Unnest ``counts``
    with ``inline_outer``: a plain ``inline`` implies a filter on its size, which Spark would push
    down through all steps and so undo that.
    """
    df = df.select(key, F.array_sort(tokens(F.col(text))).alias("_w"))
    indexed = F.transform("_w", lambda word, i: F.struct(word.alias("term"), i.alias("i")))
    last = F.size("_w") - 1
    runs = F.filter(indexed, lambda item: (item["i"] == last) | (
        item["term"] != F.get(F.col("_w"), item["i"] + 1)
    ))
    df = df.withColumn("_runs", runs)
    before = lambda j: F.coalesce(F.get(F.col("_runs"), j - 1)["i"], F.lit(-1))
    counts = F.transform("_runs", lambda item, j: F.struct(
        item["term"].alias("term"), (item["i"] - before(j)).cast("long").alias("n")
    ))
    df = df.select(key, counts.alias("counts"))
    squares = F.aggregate("counts", F.lit(0).cast("long"), lambda total, c: total + c["n"] * c["n"])
    return df.select(key, F.sqrt(squares.cast("double")).alias("norm"), "counts")


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n)."""
    counted = measured(df, key, text).select(key, F.inline_outer("counts"))
    return counted.filter(F.col("term").isNotNull())


def term_vectors(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, embedding map<term, count>)."""
    return measured(df, key, text).select(key, F.map_from_entries("counts").alias("embedding"))


def cosine(dot: Column, left_norm: Column, right_norm: Column) -> Column:
    return F.when((left_norm == 0) | (right_norm == 0), 0.0).otherwise(dot / (left_norm * right_norm))


def similar(
    targets: DataFrame,
    history: DataFrame,
    key: str = "incident_id",
    text: str = "incident_text",
    created: str = "created_at",
    threshold: float = MIN_SCORE,
    k: int = TOP,
    candidates: int = CANDIDATES,
    rule: str | None = None,
) -> DataFrame:
    """For every target its *k* most similar incidents among the newest *candidates* others.

    Whatever the number of targets, only the newest ``candidates + 1`` incidents can be looked at
    (one of them may be the target itself), so a term meets at most that many counterparts and
    there is no all-pairs step. The words of those few incidents are settled once and joined by
    term; Spark broadcasts them while they are below its limit. Returns (key, match_id, rank, similarity_score in
    percent, matched_keywords, rationale).
    """
    # which incidents are newest is found without their texts; theirs are then read alone
    stamped = history.select(
        F.col(key).alias("match_id"), F.col(created).alias("_at"),
        (F.col(rule) if rule else F.lit(None).cast("string")).alias("_match_rule"),
    )
    newest = stamped.orderBy(F.desc("_at"), F.desc("match_id")).limit(candidates + 1)
    rows = newest.collect()
    aged = history.sparkSession.createDataFrame(
        [(r["match_id"], r["_match_rule"], age) for age, r in enumerate(rows, 1)],
        T.StructType([stamped.schema["match_id"], stamped.schema["_match_rule"], T.StructField("_age", T.IntegerType())]),
    )
    recent = history
    if rows and rows[-1]["_at"] is not None:
        recent = history.filter(F.col(created) >= F.lit(rows[-1]["_at"]))
    pool = settle(
        recent.select(F.col(key).alias("match_id"), F.col(text).alias("_text")).join(F.broadcast(aged), "match_id")
    )
    sized = settle(measured(pool, "match_id", "_text"))
    facts = pool.drop("_text").join(
        sized.select("match_id", F.col("norm").alias("_match_norm")), "match_id"
    )
    pairs = sized.select("match_id", F.inline_outer("counts"))
    per_term = pairs.groupBy("term").agg(
        F.collect_list(F.struct("match_id", F.col("n").alias("m"))).alias("_matches")
    )

    targets = spread(targets)
    read = measured(targets, key, text).select(key, "norm", F.inline_outer("counts"))
    met = read.join(per_term, "term").select(key, "norm", "n", F.inline("_matches"))
    dots = met.filter(F.col(key) != F.col("match_id")).groupBy(key, "match_id").agg(
        F.sum(F.col("n") * F.col("m")).alias("_dot"), F.max("norm").alias("norm")
    )
    own = pool.select(F.col("match_id").alias(key), F.col("_age").alias("_own_age"))
    reach = F.when(F.col("_own_age").isNull(), candidates).otherwise(candidates + 1)
    best = Window.partitionBy(key).orderBy(F.desc("similarity_score"), "_age")
    top = (
        dots.join(F.broadcast(facts), "match_id")
        .join(F.broadcast(own), key, "left")
        .filter(F.col("_age") <= reach)
        .withColumn("score", cosine(F.col("_dot"), F.col("norm"), F.col("_match_norm")))
        .filter(F.col("score") >= threshold)
        .withColumn("similarity_score", F.round(F.col("score") * 100, 1))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
    )

    # keywords only for the pairs kept: at most k per target go back to the target's text
    kept = top.groupBy(key).agg(F.collect_list("match_id").alias("_kept"))
    again = measured(targets, key, text).join(kept, key)
    counted = again.select(key, "_kept", F.inline_outer("counts"))
    shared = F.filter("_matches", lambda item: F.array_contains(F.col("_kept"), item["match_id"]))
    ranked = F.array_sort(F.collect_list(F.struct((-(F.col("n") + F.col("m"))).alias("w"), "term")))
    keywords = (
        counted.join(per_term, "term")
        .select(key, "term", "n", F.inline(shared))
        .groupBy(key, "match_id")
        .agg(F.slice(ranked, 1, KEYWORDS).alias("_top"))
        .select(key, "match_id", F.transform("_top", lambda item: item["term"]).alias("matched_keywords"))
    )
    note = F.when(F.col("score") > HIGH_SCORE, HIGH_NOTE).otherwise(MODERATE_NOTE)
    if rule:
        top = top.join(targets.select(key, F.col(rule).alias("_own_rule")), key)
        same = F.col("_own_rule") == F.col("_match_rule")
        note = F.when(same, F.concat(note, F.lit(SAME_RULE_NOTE))).otherwise(note)
    return top.join(keywords, [key, "match_id"]).select(
        key, "match_id", "rank", "similarity_score", "matched_keywords", note.alias("rationale")
    )


def with_resolution(matches: DataFrame, batches: DataFrame, feedback: DataFrame) -> DataFrame:
    """Add the matched batch's status, time of creation and newest human-edited text.

    *batches* has (match_id, status, created_at); *feedback* has (match_id, feedback_type, edited_summary,
    created_at, id). The newest row per batch is taken first, so a match never repeats.
    """
    edits = (
        feedback.filter(F.col("feedback_type").isin("edit", "accept"))
        .groupBy("match_id")
        .agg(F.max_by("edited_summary", F.struct("created_at", "id")).alias("human_validated_interpretation"))
    )
    return matches.join(
        batches.select("match_id", F.col("status").alias("historical_resolution"), F.col("created_at").alias("historical_created_at")),
        "match_id", "left",
    ).join(edits, "match_id", "left")
