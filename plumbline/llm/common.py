"""What several of the operators share: reading whole texts in tasks, splits by id, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import settle

#: ASCII letters and digits and every byte of a non-ASCII character, on lower-cased UTF-8 bytes.
WORD_BYTES = rb"[0-9a-z\x80-\xff]+"


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The texts of a batch as UTF-8 bytes. ``bytes.lower`` changes A-Z only, ``bytes.split`` cuts at
    space and 0x09-0x0D only."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type)
              for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def ship(spark: SparkSession, model: object) -> Broadcast:
    """A broadcast model that workers can read without a copy of this package: a broadcast pickles classes by name, so the
    model travels as bytes that hold its class too. Read it with ``shipped``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def shipped(sent: Broadcast) -> object:
    """The model of a broadcast made by ``ship``, unpickled once a worker."""
    if getattr(sent, "_model", None) is None:
        sent._model = cloudpickle.loads(sent.value)
    return sent._model


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id, so that such a row is in no part that is
    defined by a remainder."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(-1))


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5, the same in every SQL engine."""
    digest = F.md5(F.concat_ws(":", *columns).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words, so that all bits of the input reach all bits of the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most *size* rows, so that a task's memory does not follow Arrow's batch size."""
    for batch in rows:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


#: Where segments of the dimensions end, as shares of all.
SEGMENTS = (0.25, 0.5, 0.625, 0.75, 0.8125, 0.875, 0.9375, 1.0)
#: Below this share of open pairs the accumulation ends and they are scored.
FEW = 0.02


def threshold_join(q: np.ndarray, floor: np.ndarray, v: np.ndarray, count: dict | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of *q* with any, its place and the rows of *v* whose inner product with it may reach its *floor*: all
    that do are among them."""
    width = q.shape[1]
    if not len(v) or not len(q):
        return
    cuts = sorted({max(1, round(width * s)) for s in SEGMENTS})
    begin = [0, *cuts]

    def rests(x: np.ndarray) -> np.ndarray:
        """Norms of the dimensions from each cut on: (rows, cuts + 1)."""
        squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
        return np.sqrt(np.concatenate([squares[:, begin[:-1]], np.zeros((len(x), 1))], axis=1))

    rest_q, rest_v = rests(q), rests(v)
    norm = rest_q[:, 0]
    slack = 1e-9 * (norm * rest_v[:, 0].max() + 1)
    # A vector's dimensions from the first cut on whose norm stays below every relative threshold are not indexed.
    reach = np.min(np.where(norm > 0, (floor - slack) / np.maximum(norm, 1e-300), np.where(floor > 0, np.inf, -np.inf)))
    indexed = (rest_v >= reach).sum(axis=1) if reach > 0 else np.full(len(v), len(cuts))
    indexed = np.minimum(indexed, len(cuts))
    kept = np.flatnonzero(indexed > 0)  # the others are below the threshold with all their dimensions
    total = np.zeros((len(q), len(kept)))
    open_ = np.ones((len(q), len(kept)), bool)
    for k, end in enumerate(cuts):
        deep = np.flatnonzero(indexed[kept] > k)
        if not len(deep):
            break
        part = slice(begin[k], end)
        total[:, deep] += q[:, part] @ v[kept[deep], part].T
        bound = total[:, deep] + rest_q[:, k + 1][:, None] * rest_v[kept[deep], k + 1][None, :]
        open_[:, deep] &= bound + slack[:, None] >= floor[:, None]
        if end == width or open_.mean() <= FEW:
            break
        some = open_.any(axis=0)
        if some.mean() < 0.7:
            kept, total, open_ = kept[some], total[:, some], open_[:, some]
            if not len(kept):
                return
    if count is not None:
        count["pairs"] = count.get("pairs", 0) + len(q) * len(v)
        count["scored"] = count.get("scored", 0) + int(open_.sum())
    for row in range(len(q)):
        near = kept[np.flatnonzero(open_[row])]
        if len(near):
            yield row, near


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b) between long ids; the component is the
    smallest id of the connected nodes.

    Each round hooks every node to its smallest neighbour, follows the pointers twice and contracts the
    links, until none is left. The tables of a round are written to the shared folder; only the number
    of remaining links reaches the driver.
    """
    def contracted(pairs: DataFrame) -> DataFrame:
        kept = pairs.filter("a <> b")
        return settle(kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    links = contracted(links)
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = settle(nodes.select("node", F.col("node").alias("component")))
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("v"), F.least("a", "b").alias("p"))
        hook = settle(hook)
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("p2"))
        hook = settle(hook.join(up, "p").select("v", F.col("p2").alias("p")))
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("p2"))
        hook = settle(hook.join(up, "p").select("v", F.col("p2").alias("p")))
        labels = settle(
            labels.join(hook, labels["component"] == hook["v"], "left")
            .select("node", F.coalesce("p", "component").alias("component")))
        left = hook.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        links = contracted(links.join(left, "a").join(right, "b")
                           .select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    # Every hook goes to a smaller id, so the one label that a class ends with is its smallest id.
    return labels
