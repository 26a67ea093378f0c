"""Substring duplicates by content-defined chunking with a gear rolling hash.

A gear hash over the last ``WINDOW`` bytes is taken at the end of every word, and a chunk ends where the
hash is smaller than at the ``REACH`` words before and after. Boundaries depend on bytes nearby only, so
an insertion shifts no later boundary. A digest found in two documents marks a repeated chunk; a run of
adjacent repeated chunks of ``min_words`` words or more is a repeated passage, cut where chunks that this document
has first meet chunks that another has first. Chunks that a document has again are counted apart.

A shared passage loses the chunk in which it begins and the one in which it ends, about 17 words together,
so ``min_words`` lies below the length of the passages that are wanted: 20 finds those of 50 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from plumbline.llm.common import batch_of, mix, slices, texts_of
from plumbline.session import settle

#: Bytes that the rolling hash covers; a power of two.
WINDOW = 16
#: Words on either side among which a boundary has the smallest hash; chunks have more words than this.
REACH = 3
MIN_WORDS = 20
GEAR = mix(np.arange(1, 257, dtype=np.uint64))


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - k]] << k for k below WINDOW, by doubling the window."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint64(width)
        h, width = wider, 2 * width
    return h


def chunks(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Ends of the chunks, as numbers of words, and the chunks. Together they are all words."""
    if not words:
        return np.empty(0, np.int64), []
    data = b" ".join(words)
    word_ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    at_end = mix(gear(np.frombuffer(data, np.uint8))[word_ends - 1])
    cut = np.ones(len(words), bool)
    for away in range(1, min(REACH, len(words) - 1) + 1):
        cut[away:] &= at_end[away:] < at_end[:-away]
        cut[:-away] &= at_end[:-away] < at_end[away:]
    cut[-1] = True
    ends = np.flatnonzero(cut) + 1
    stops = word_ends[ends - 1].tolist()
    starts = [0, *(x + 1 for x in stops[:-1])]
    return ends, [data[a:b] for a, b in zip(starts, stops)]


def _chunked(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("n_words", pa.int64()),
                        ("ends", pa.list_(pa.int32())), ("digests", pa.list_(pa.int64())),
                        ("again", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            n, all_ends, digests, again = [], [], [], []
            for text in texts_of(batch, "_text"):
                words = text.lower().split() if text else []
                ends, parts = chunks(words)
                n.append(len(words))
                all_ends.append(ends.astype(np.int32))
                digests.append(np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts)).view(np.int64))
                _, first, which = np.unique(digests[-1], return_index=True, return_inverse=True)
                again.append(first[which] != np.arange(len(parts)))
            yield batch_of(schema, [batch.column("key"), n, all_ends, digests, again])

    return docs.mapInArrow(run, "key long, n_words long, ends array<int>, digests array<long>, again array<boolean>")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """(key, n_words, n_chunks, n_repeated, n_later, n_within, passages): one row per row of *docs*.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case. ``passages`` lists, by their
    place, structs (start, end, first_key): words from start to before end occur in other documents too;
    ``first_key`` is the smallest id that has one of their chunks. A run of repeated chunks is cut in several
    where chunks whose first document is this one meet others. Parts that others have first count as long as the run;
    parts that this document has first, often the chunk in which a passage ends, must have *min_words* themselves.
    ``n_repeated`` counts the words in passages, ``n_later`` those in passages whose ``first_key`` is another
    document, which deduplication removes: the first document of every chunk keeps it. ``n_within`` counts the
    words in runs of *min_words* or more of chunks that the document has had before, whether or not
    others have them. Rows of one id are one document, in any order; rows with a null id are one that comes
    first. A null or empty text has no words and no passages. Other columns of *docs* are not read.
    """
    thin = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_text"))
    table = settle(_chunked(thin).withColumn("row", F.monotonically_increasing_id()), "chunks")
    owner = F.coalesce("key", F.lit(-2 ** 63))
    places = table.select("row", owner.alias("owner"), F.explode(F.arrays_zip(
        F.col("digests").alias("digest"), F.col("ends").alias("end"), F.col("again").alias("again"),
        F.expr("transform(ends, (e, i) -> struct(i AS i, coalesce(get(ends, i - 1), 0) AS start))").alias("at"),
    )).alias("c")).select("row", "owner", F.col("c.digest").alias("digest"), F.col("c.at.i").alias("i"),
                          F.col("c.at.start").alias("start"), F.col("c.end").alias("end"), F.col("c.again").alias("again"))
    shared = settle(places.groupBy("digest").agg(
        F.min("owner").alias("first_key"), F.max("owner").alias("last"), F.min("row").alias("r"), F.max("row").alias("s"))
        .filter("r < s").select("digest", "first_key", F.expr("first_key < last").alias("across")), "shared")
    found = places.join(shared, "digest")

    order = Window.partitionBy("row").orderBy("i")
    apart = F.coalesce(F.col("i") != F.lag("i").over(order) + 1, F.lit(True))
    turned = apart | (F.col("later") != F.lag("later").over(order))
    sides = found.filter("across").withColumn("later", F.col("first_key") != F.col("owner")).withColumns(
        {"apart": apart.cast("int"), "turned": turned.cast("int")}).withColumns(
        {"run": F.sum("apart").over(order), "part": F.sum("turned").over(order)}).groupBy("row", "run", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_key").alias("first_key"), F.max("later").alias("later"))
    long = F.col("end") - F.col("start") >= min_words
    runs = sides.groupBy("row", "run").agg(
        (F.max("end") - F.min("start")).alias("n"), F.collect_list(
            F.when(F.col("later") | long, F.struct("start", "end", "first_key"))).alias("parts")
    ).filter(F.col("n") >= min_words)
    lists = settle(runs.groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("parts"))).alias("passages")), "passages")

    within = places.filter("again").select("row", "i", "start", "end")
    several = settle(table.groupBy(owner.alias("owner")).count().filter("count > 1").select("owner"), "several")
    if not several.isEmpty():  # documents of several rows: chunks that an earlier row of theirs has
        own = found.filter("NOT again").join(several, "owner", "left_semi")
        first = own.groupBy("digest", "owner").agg(F.min("row").alias("first_row"))
        within = within.unionByName(own.join(first, ["digest", "owner"]).filter("first_row < row").select("row", "i", "start", "end"))
    again = settle(within.withColumn("run", F.col("i") - F.row_number().over(order)).groupBy("row", "run").agg(
        (F.max("end") - F.min("start")).alias("n")).filter(F.col("n") >= min_words)
        .groupBy("row").agg(F.sum("n").cast("long").alias("n_within")), "within")
    length = "aggregate({}, 0L, (n, p) -> n + p.end - p.start)"
    return table.select("row", "key", "n_words", F.size("digests").cast("long").alias("n_chunks")).join(
        lists, "row", "left").join(again, "row", "left").select(
        "key", "n_words", "n_chunks",
        F.coalesce(F.expr(length.format("passages")), F.lit(0)).cast("long").alias("n_repeated"),
        F.coalesce(F.expr(length.format("filter(passages, p -> NOT p.first_key <=> coalesce(key, -9223372036854775808L))")),
                   F.lit(0)).cast("long").alias("n_later"),
        F.coalesce("n_within", F.lit(0).cast("long")).alias("n_within"),
        F.coalesce("passages", F.expr("CAST(array() AS array<struct<start:int,end:int,first_key:bigint>>)"))
        .alias("passages"))


def op10_chunk_dedup(docs: DataFrame) -> DataFrame:
    """Every document with its repeated passages as ``start:end`` in words, and the documents that
    have them first."""
    found = repeated_passages(docs)
    return found.select(
        F.col("key").alias("doc_id"), "n_words", "n_chunks", F.size("passages").cast("long").alias("n_passages"),
        "n_repeated", "n_later", "n_within",
        F.expr("array_join(transform(passages, p -> concat(p.start, ':', p.end)), ',')").alias("passages"),
        F.expr("array_sort(array_distinct(transform(passages, p -> p.first_key)))").alias("first_docs"),
        (F.col("n_repeated") > 0).alias("has_repeats"))
