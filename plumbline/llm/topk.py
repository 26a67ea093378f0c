"""Exact top-k by inner product over vectors in order of descending length.

Vectors are turned by the singular vectors of the whole table, so their first components carry most of their
length. They are sorted by length and packed in blocks. Queries come in blocks too, each with the k-th best score
that the longest vectors give it. A block of vectors is worth a look for a query only if the product of lengths
reaches that score (Cauchy-Schwarz). Within it, partial sums grow over the leading components in steps; after each step
a vector stays only if its partial sum plus the product of the remaining lengths reaches the score. What is left
after the last step is scored exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import batch_of, threshold_join
from plumbline.session import settle

#: Vectors in a block and queries in a block.
VECTORS, QUERIES = 4096, 512
#: The longest vectors, from which every query takes its first k-th best score.
LONGEST = 2048


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-number float vectors: by floats where those are exact, else by
    Python's integers."""
    if queries.size == 0 or vectors.size == 0:
        return np.zeros((len(queries), len(vectors)), np.int64)
    if np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1] < 2.0 ** 53:
        return (queries @ vectors.T).astype(np.int64)
    big = np.array([[int(x) for x in row] for row in queries], object) @ np.array(
        [[int(x) for x in row] for row in vectors], object).T
    return np.clip(big, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


def _stacked(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, :len(x)] = x
    return out


def _gram(table: DataFrame, width: int) -> np.ndarray:
    """Sum of v v' over all vectors, each brought to length 1 or less: width * width numbers a task."""
    schema = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            v = _stacked(batch.column("v").to_pandas(), width)
            v /= np.maximum(1.0, np.abs(v).max(initial=1.0))
            total += v.T @ v
        yield batch_of(schema, [np.arange(width), list(total)])

    sums = table.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    out = np.zeros((width, width))
    for i, j, x in sums.groupBy("i", "j").agg(F.sum("x")).collect():
        out[i, j] = x
    return out


def top_inner_products(table: DataFrame, every: int = 50, k: int = 5, scale: int = 256, key: str = "vec_id",
                       vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row whose id is divisible by *every*.

    Components are floor(scale * x). Vectors that are null or empty, hold a null or a non-finite component, or
    have a null id take no part. Shorter vectors count as filled up with zeros. A query's own id is never
    among its results; rows that repeat an id are candidates each, and one query if their vectors are equal (of
    unequal ones the smallest is the query). Ties go to the smaller id. Products beyond 64 bits are clipped.
    Other columns are not read.
    """
    x = F.col(vector)
    good = F.col(key).isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    quantized = table.filter(good).select(F.col(key).cast("long").alias("id"), F.transform(
        x, lambda e: F.floor(e.cast("double") * scale).cast("double")).alias("v"))
    quantized = settle(quantized.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))))
    width = quantized.agg(F.max(F.size("v"))).first()[0] or 1
    turn = np.linalg.svd(_gram(quantized, width))[0]

    n = quantized.count()
    parts = max(1, -(-n // VECTORS))
    longest = quantized.orderBy(F.desc("norm"), "id").limit(LONGEST).collect()
    seed_ids = np.array([r["id"] for r in longest], np.int64)
    seeds = np.zeros((len(longest), width))
    for i, r in enumerate(longest):
        seeds[i, :len(r["v"])] = r["v"]

    asked = quantized.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    n_asked = asked.count()
    query_parts = max(1, -(-n_asked // QUERIES))

    def packed(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries of a part as blocks, with the k-th best score among the longest vectors."""
        for pdf in rows:
            for start in range(0, len(pdf), QUERIES):
                ids = pdf["id"].to_numpy()[start:start + QUERIES]
                v = _stacked(pdf["v"].iloc[start:start + QUERIES], width)
                scores = exact_scores(v, seeds)
                scores = np.where(seed_ids[None, :] == ids[:, None], np.iinfo(np.int64).min, scores)
                floor = np.full(len(ids), -np.inf)
                if scores.shape[1] >= k + 1:
                    kth = np.partition(scores, -k, axis=1)[:, -k]
                    floor = kth.astype(float)
                yield pd.DataFrame({"ids": [ids], "vectors": [v.ravel()], "floors": [floor]})

    queries = settle(asked.repartition(query_parts, "id").mapInPandas(
        packed, "ids array<long>, vectors array<double>, floors array<double>"))

    ranged = quantized.repartitionByRange(parts, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")

    def blocks(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for start in range(0, len(pdf), VECTORS):
                part = pdf.iloc[start:start + VECTORS]
                yield pd.DataFrame({"ids": [part["id"].to_numpy()], "vectors": [_stacked(part["v"], width).ravel()],
                                    "norms": [part["norm"].to_numpy()]})

    packs = settle(ranged.mapInPandas(blocks, "ids array<long>, vectors array<double>, norms array<double>")
                   .withColumn("block", F.monotonically_increasing_id()))
    # Every block of queries meets every block of vectors that can hold a result of one of its queries.
    most = packs.select("block", F.element_at("norms", 1).alias("most"))
    longest_query = F.expr("""array_max(transform(sequence(0, size(ids) - 1), i -> sqrt(aggregate(
        slice(vectors, i * {w} + 1, {w}), 0.0D, (s, e) -> s + e * e)) ))""".format(w=width))
    bounded = queries.withColumn("query_block", F.monotonically_increasing_id()).withColumn("q_norm", longest_query) \
        .withColumn("q_floor", F.array_min("floors"))
    pairs = bounded.select("query_block", "q_norm", "q_floor").join(
        most, F.col("q_norm") * F.col("most") * 1.000001 >= F.col("q_floor")).select("query_block", "block")
    meets = settle(pairs)
    cells = meets.join(bounded.select("query_block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"),
                                      "floors"), "query_block").join(packs, "block")

    def search(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for cell in pdf.itertuples():
                q_ids, ids, norms = np.asarray(cell.q_ids), np.asarray(cell.ids), np.asarray(cell.norms)
                q = np.asarray(cell.q_vectors).reshape(len(q_ids), width)
                v = np.asarray(cell.vectors).reshape(len(ids), width)
                floor = np.asarray(cell.floors)
                q_norm = np.sqrt((q * q).sum(axis=1))
                slack = 1e-6 * (q_norm * norms.max() + 1)  # for the rounding of rotated sums
                open_ = q_norm * norms.max() + slack >= floor
                if not open_.any():
                    continue
                found_q, found_v, found_s = [], [], []
                places = np.flatnonzero(open_)
                # The slack is for the rounding of rotated sums.
                for row, near in threshold_join(q[open_] @ turn, floor[open_] - slack[open_], v @ turn):
                    place = places[row]
                    near = near[ids[near] != q_ids[place]]
                    if not len(near):
                        continue
                    score = exact_scores(q[place][None, :], v[near])[0]
                    best = np.lexsort((ids[near], -score))[:k]
                    found_q += [q_ids[place]] * len(best)
                    found_v += ids[near][best].tolist()
                    found_s += score[best].tolist()
                if found_q:
                    yield pd.DataFrame({"query_id": found_q, "vec_id": found_v, "score": found_s})

    found = cells.repartition(F.col("query_block"), F.col("block")).mapInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_top_k(embeddings: DataFrame) -> DataFrame:
    return top_inner_products(embeddings)


OP7_SQL = """
WITH rows AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
