"""Hard negatives by threshold joins over partly indexed vectors.

An anchor's positives are its best rows of the same label; its hard negatives lie in a window below each positive's
score. Both come from one join of blocks of anchors with blocks of vectors, in the manner of L2AP. Dimensions stand in
order of falling energy. The index of a block leaves out, for each vector, the last dimensions whose norm no
anchor's threshold relative to its length exceeds: what has only those in common with an anchor stays below the
threshold. Partial scores are accumulated segment by segment over the indexed dimensions; a pair is dropped once its
partial score plus the product of the remaining norms cannot reach the anchor's threshold. Pairs that are left are
scored exactly, in whole numbers. For positives the threshold is the k-th best score in one block of the label. For
negatives it starts near the top of the windows and is lowered, for the anchors whose windows are not full, until all
are full or the bottom is reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import batch_of, threshold_join
from plumbline.llm.topk import exact_scores
from plumbline.session import settle

#: Vectors in a block and anchors in a block.
VECTORS, ANCHORS = 4096, 1024
#: Cells (a block of anchors, a block of vectors) in a task, and so in its Arrow batch, in expectation.
CELLS = 4
#: How far below a window's top the threshold of each turn is, as a share of the window.
TURNS = (0.1, 0.4, 1.0)
#: Stands for no floor.
LEAST_LONG = -2 ** 63
FOUND = "anchor_id long, window int, vec_id long, score long"


def _packed(vectors: DataFrame, order: np.ndarray, rows: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, label, v, ...), sorted, as blocks: ids, labels, vectors as bytes with their dimensions in *order*, the
    largest norm and the smallest and largest label."""
    width = len(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), rows):
                part = pdf.iloc[start:start + rows]
                v = np.zeros((len(part), width))
                for i, x in enumerate(part["v"]):
                    v[i, :len(x)] = x
                yield pd.DataFrame({
                    "ids": [part["id"].to_numpy()], "labels": [part["label"].to_numpy()], "vectors": [v[:, order].tobytes()],
                    "most": [np.sqrt((v * v).sum(axis=1)).max()], "low_label": [part["label"].min()],
                    "high_label": [part["label"].max()], **{c: [part[c].to_list()] for c in extra}})

    kinds = dict(vectors.dtypes)
    more = "".join(f", {c} array<{kinds[c]}>" for c in extra)
    return vectors.mapInPandas(run, "ids array<long>, labels array<long>, vectors binary, most double, low_label long, "
                               f"high_label long{more}").withColumn("block", F.monotonically_increasing_id())


def _join(cells: DataFrame, n_cells: int, k: int, width: int, same: bool) -> DataFrame:
    """The best *k* of each window and cell, of rows with the anchor's label or (*same* false) without it: FOUND. Cells
    have q_ids, q_labels, q_vectors, windows (per anchor a list of (window, floor, top)), ids, labels, vectors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell in pdf.itertuples():
                q_ids, ids = np.asarray(cell.q_ids), np.asarray(cell.ids)
                q_labels, labels = np.asarray(cell.q_labels), np.asarray(cell.labels)
                q = np.frombuffer(cell.q_vectors).reshape(len(q_ids), width)
                v = np.frombuffer(cell.vectors).reshape(len(ids), width)
                windows = [[tuple(map(int, w)) for w in mine] for mine in cell.windows]
                floor = np.array([min(w[1] for w in mine) for mine in windows], float)
                floor[floor <= LEAST_LONG] = -np.inf
                out = [[], [], [], []]
                for row, near in threshold_join(q, floor, v):
                    near = near[(ids[near] != q_ids[row]) & ((labels[near] == q_labels[row]) == same)]
                    score = exact_scores(q[row][None, :], v[near])[0]
                    for window, low, top in windows[row]:
                        good = np.flatnonzero((score >= low) & (score <= top))
                        good = good[np.lexsort((ids[near[good]], -score[good]))[:k]]
                        for column, x in zip(out, ([q_ids[row]] * len(good), [window] * len(good), ids[near[good]], score[good])):
                            column.extend(x)
                if out[0]:
                    yield pd.DataFrame(dict(zip(("anchor_id", "window", "vec_id", "score"), out)))

    return cells.repartition(max(1, -(-n_cells // CELLS)), "q_block", "block").mapInPandas(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _energy(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum of squares of every dimension over all vectors, each brought to length 1: a row a task is added up."""
    schema = pa.schema([("total", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            column = batch.column("v")
            size = column.value_lengths().to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            norm = np.repeat(np.maximum(batch.column("norm").to_numpy(zero_copy_only=False), 1e-300), size)
            total += np.bincount(place, weights=(flat / norm) ** 2, minlength=width)
        yield batch_of(schema, [[total]])

    sums = vectors.mapInArrow(run, "total array<double>").select(F.posexplode("total").alias("i", "x"))
    out = np.zeros(width)
    for i, x in sums.groupBy("i").agg(F.sum("x")).collect():
        out[i] = x
    return out


def hard_negatives(table: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, lowest: int = 50, highest: int = 95,
                   flipped: int = 7, labels: int = 10, scale: int = 256, key: str = "vec_id", vector: str = "embedding",
                   label: str = "label", turns: tuple[float, ...] = TURNS, rows: int = VECTORS, anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by *every*; where an id is divisible by *flipped*, the label is
    moved on by one modulo *labels*. A row's score is its inner product with the anchor, of components
    floor(scale * x). An anchor's positives are its best *positives* rows of the same label. For each, the best
    *negatives* rows of other labels are returned among those with a score from *lowest* to *highest* percent of
    the positive's. Ties go to the smaller id; a negative positive score has no such rows.

    Rows with a null id, a null label, or a vector that is null, empty or holds a null or non-finite component take no
    part. Shorter vectors count as filled up with zeros. A row with the anchor's id is never its positive or
    negative; of anchors that repeat an id the one with the smallest vector and label is taken, other rows that repeat
    an id are candidates each. Products beyond 64 bits are clipped. Other columns are not read.
    """
    spark = table.sparkSession
    x = F.col(vector)
    good = F.col(key).isNotNull() & F.col(label).isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    ident, kind = F.col(key).cast("long"), F.col(label).cast("long")
    usable = table.filter(good).select(
        ident.alias("id"), F.when(ident % flipped == 0, (kind + 1) % labels).otherwise(kind).alias("label"),
        F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double")).alias("v"))
    usable = settle(usable.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))), "vectors")
    n, width = usable.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    order = np.argsort(-_energy(usable, width), kind="stable")
    ranged = usable.repartitionByRange(max(1, -(-n // rows)), "label", F.desc("norm"), "id").sortWithinPartitions(
        "label", F.desc("norm"), "id")
    blocks = settle(_packed(ranged, order, rows), "blocks")
    asked = usable.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("v", "label")).alias("a")).select(
        "id", "a.v", "a.label")

    def packed_anchors(told: DataFrame, n_told: int) -> DataFrame:
        """Blocks of anchors (id, label, v, windows); ``least`` is the lowest floor of a block."""
        parts = max(1, -(-n_told // anchors))
        dealt = told.repartitionByRange(parts, "label", "id").sortWithinPartitions("label", "id").coalesce(parts)
        least_floor = F.array_min(F.transform(F.flatten("windows"), lambda w: w[1]))
        return settle(_packed(dealt, order, anchors, ("windows",)).withColumn("least", least_floor).select(
            *(F.col(c).alias(f"q_{c}") for c in ("block", "ids", "labels", "vectors", "most", "low_label", "high_label")),
            "windows", "least"), "anchors")

    def searched(queries: DataFrame, met: DataFrame, k: int, same: bool) -> DataFrame:
        """Best *k* of each window over the pairs of blocks *met*."""
        met = settle(met, "cells")
        cells = met.join(queries.select("q_block", "q_ids", "q_labels", "q_vectors", "windows"), "q_block").join(
            blocks.select("block", "ids", "labels", "vectors"), "block")
        return _best(_join(cells, met.count(), k, width, same), k)

    # Only labels and lengths of blocks meet here; a pair goes on if its longest rows can reach the lowest floor.
    heads = blocks.select("block", "most", "low_label", "high_label")
    reach = F.col("q_most") * F.col("most") * 1.000001 + 1 >= F.col("least")
    overlap = (F.col("q_low_label") <= F.col("high_label")) & (F.col("low_label") <= F.col("q_high_label"))
    one_label = (F.col("low_label") == F.col("q_high_label")) & (F.col("high_label") == F.col("q_low_label"))

    # The block with the longest rows of each label gives its anchors their first floors.
    leading = blocks.select("block", "most", F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(
        F.max_by("block", F.struct("most", "block")).alias("block"))
    n_asked = asked.count()
    least, most = F.lit(LEAST_LONG).cast("long"), F.lit(2 ** 63 - 1).cast("long")
    every_score = F.array(F.lit(0).cast("long"), least, most)
    queries = packed_anchors(asked.withColumn("windows", F.array(every_score)), n_asked)
    met = queries.select("q_block", F.explode(F.array_distinct("q_labels")).alias("label")).join(leading, "label").select(
        "q_block", "block").distinct()
    first = searched(queries, met, positives, True)
    floors = first.groupBy("anchor_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floor = F.when(F.col("n") >= positives, F.col("least")).otherwise(least)
    floored = settle(asked.join(floors, F.col("anchor_id") == F.col("id"), "left").withColumn(
        "windows", F.array(F.array(F.lit(0).cast("long"), floor, most))).select("id", "label", "v", "windows"), "floored")
    queries = packed_anchors(floored, n_asked)
    found = settle(searched(queries, queries.join(heads, overlap & reach).select("q_block", "block"), positives, True), "positives")

    # Whole numbers of the window: 100 s >= lowest p and 100 s <= highest p.
    wanted = found.select("anchor_id", F.col("place").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("p")).withColumns(
        {"low": F.expr(f"-((-{lowest} * CAST(p AS DECIMAL(38, 0))) - pmod(-{lowest} * CAST(p AS DECIMAL(38, 0)), 100)) / 100").cast("long"),
         "top": F.expr(f"({highest} * CAST(p AS DECIMAL(38, 0)) - pmod({highest} * CAST(p AS DECIMAL(38, 0)), 100)) / 100").cast("long")})
    wanted = settle(wanted, "windows")
    state = wanted.filter("low <= top").select("anchor_id", "window", "low", F.col("top").alias("upper"), F.col("top").alias("top"), F.lit(0).alias("n"))
    taken = None
    for share in turns:
        # What is new since the turn before lies from this turn's floor up to just below the last one's.
        floor = F.greatest("low", F.floor(F.col("upper") - (F.col("upper") - F.col("low")) * share).cast("long"))
        turn = settle(state.withColumn("floor", floor), "turn")
        told = turn.groupBy("anchor_id").agg(F.collect_list(F.array(F.col("window").cast("long"), "floor", "top")).alias("windows"))
        told = settle(told.join(asked, F.col("anchor_id") == F.col("id")).select("id", "label", "v", "windows"), "told")
        n_told = told.count()
        if not n_told:
            break
        queries = packed_anchors(told, n_told)
        new = settle(searched(queries, queries.join(heads, ~one_label & reach).select("q_block", "block"), negatives, False).drop("place"), "negatives")
        taken = new if taken is None else taken.unionByName(new)
        got = new.groupBy("anchor_id", "window").count()
        state = turn.join(got, ["anchor_id", "window"], "left").withColumn("n", F.col("n") + F.coalesce("count", F.lit(0))).filter(
            (F.col("n") < negatives) & (F.col("floor") > F.col("low"))).select(
                "anchor_id", "window", "low", "upper", (F.col("floor") - 1).alias("top"), "n")
    if taken is None:
        taken = spark.createDataFrame([], FOUND)
    return _best(taken, negatives).join(wanted, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(embeddings: DataFrame) -> DataFrame:
    return hard_negatives(embeddings)


OP13_SQL = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
    FROM usable a JOIN usable c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
