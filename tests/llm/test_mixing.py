"""Rates beyond what one draw takes."""

from pyspark.sql import functions as F

from plumbline.llm import mixing


def test_small_source_reaches_its_target_beyond_the_largest_draw(spark):
    rows = [(i, "w" * 25, "small") for i in range(4)] + [(10 + i, "w" * 50_000, "big") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = {r.source: r.rate for r in mixing.rates(docs, {"small": 1.0, "big": 1.0}).collect()}
    assert abs(rates["small"] - 1000.5) < 0.01 and abs(rates["big"] - 0.5005) < 0.001
    mixed = mixing.mix(docs, {"small": 1.0, "big": 1.0}).filter("source = 'small'")
    got = {r.doc_id: (r.n, r.top) for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy_no").alias("top")).collect()}
    assert set(got) == set(range(4)) and all(n == top and abs(n - 1001) < 6 * 32 for n, top in got.values())
    assert len(set(got.values())) > 1
    assert mixed.select("doc_id", "copy_no").distinct().count() == mixed.count()


def test_split_draws_are_poisson_and_small_rates_are_drawn_as_before(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    large = mixing.copies_of(F.lit(1700.0), mixing.SEED, F.col("key"))
    small = mixing.copies_of(F.lit(3.5), mixing.SEED, F.col("key"))
    before = mixing.poisson(F.lit(3.5), mixing.unit_hash(F.lit(mixing.SEED), F.col("key")))
    row = keys.select(large.alias("n"), (small == before).alias("same")).agg(
        F.avg("n").alias("mean"), F.variance("n").alias("spread"), F.min("same").alias("same")).first()
    assert abs(row.mean - 1700) < 5 and abs(row.spread / 1700 - 1) < 0.2 and row.same


def test_copies_beyond_one_block_are_numbered_once(spark):
    docs = spark.createDataFrame([(1, "w", "small"), (2, "w" * 50_000, "big")], "doc_id long, text string, source string")
    row = mixing.mix(docs, {"small": 1.0, "big": 1.0}).filter("doc_id = 1").agg(
        F.count("*").alias("n"), F.countDistinct("copy_no").alias("all"), F.max("copy_no").alias("top")).first()
    assert row.n == row["all"] == row.top and abs(row.n - 25_000) < 1000
