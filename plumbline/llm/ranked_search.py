"""Exact ranked search with geometric blocks in every posting list.

Documents are cut into words once; the words that some item asks for are written as a table of (document, words,
counts) with the statistics taken over all documents. Each task then indexes its documents in chunks. A word's posting
list in a chunk is clustered by document similarity (random projections of the weighted word vectors): similar
documents stand in one block, and the block keeps the largest value of every coordinate among them. An item visits
its words from the largest possible contribution down. It stops at the words that together cannot reach its k-th best
score so far, and skips each block whose summary of the word and those after it cannot reach it (a document that also
holds an earlier word has been met there); documents of the other blocks are scored exactly.
Bounds and scores are whole numbers, so no result is lost to rounding. First floors come from a sample of the
documents, which are results like any others, so floors are always reached by k documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD_BYTES, batch_of, slices, texts_of
from plumbline.session import settle

#: Documents in a block of a posting list, and the width of the projection that clusters them.
BLOCK, SKETCH = 32, 32
#: Numbers in the dense table of a chunk's documents, and documents in a chunk at most.
CELLS, ROWS = 4 << 20, 2048
#: Bytes of block summaries a chunk keeps; beyond that they are built again when needed.
SUMMARIES = 128 << 20
#: (item, word) pairs that a task searches for together, and pairs that one pass over the documents looks up.
GROUP, PASS = 20_000, 1_000_000
#: Documents in the sample for the first floors, in expectation.
FIRST = 4096


class Items:
    """Items of a group: for each its columns of the group's words and their weights, repeats included."""

    def __init__(self, pairs: list[tuple[int, int, int]]) -> None:
        """*pairs* (item, word, weight) in order of item."""
        item, word, weight = (np.array(x, np.int64) for x in zip(*pairs))
        self.words, column = np.unique(word, return_inverse=True)
        self.ids, start = np.unique(item, return_index=True)
        self.columns = np.split(column, start[1:])
        self.weights = np.split(weight, start[1:])
        self.mean = np.bincount(column, weights=weight) / np.bincount(column)


class Chunk:
    """Blocked posting lists of some documents over the words of a group."""

    def __init__(self, values: np.ndarray, importance: np.ndarray) -> None:
        """*values* (documents x words): a word's part of the score, 0 where it is absent."""
        self.values = values
        rows, columns = np.nonzero(values)
        order = np.argsort(columns, kind="stable")
        self.lists = np.split(rows[order], np.searchsorted(columns[order], np.arange(1, values.shape[1])))
        self.most = values.max(axis=0, initial=0).astype(np.int64)
        weighted = values * importance[None, :].astype(np.float32)
        weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)
        turn = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (values.shape[1], SKETCH))
        self.sketch = weighted @ turn
        self.blocked: dict[int, tuple[list[np.ndarray], np.ndarray]] = {}
        self.kept = 0

    def blocks(self, word: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The blocks of a word's list and their summaries (blocks x words)."""
        if word not in self.blocked:
            rows = self.lists[word]
            heads = rows[np.linspace(0, len(rows) - 1, -(-len(rows) // BLOCK)).astype(int)]
            nearest = (self.sketch[rows] @ self.sketch[heads].T).argmax(axis=1)
            order = np.argsort(nearest, kind="stable")
            cut = np.flatnonzero(np.diff(nearest[order])) + 1
            summary = np.maximum.reduceat(self.values[rows[order]], np.concatenate([[0], cut]), axis=0)
            if self.kept + summary.nbytes > SUMMARIES:
                self.blocked.clear()
                self.kept = 0
            self.kept += summary.nbytes
            self.blocked[word] = np.split(rows[order], cut), summary
        return self.blocked[word]

    def find(self, columns: np.ndarray, weights: np.ndarray, floor: int, best: np.ndarray, k: int,
             count: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of all documents of the chunk that can be among the k best of an item whose best scores so
        far are *best*: every one of at least the floor, which rises with what is found."""
        present = self.most[columns] > 0
        columns, weights = columns[present], weights[present]
        order = np.argsort(-self.most[columns] * weights, kind="stable")
        columns, weights = columns[order], weights[order]
        rest = np.cumsum((self.most[columns] * weights)[::-1])[::-1]
        seen = np.zeros(len(self.values), bool)
        found_rows, found_scores = [], []
        for turn, (word, most) in enumerate(zip(columns, rest)):
            if most < floor:
                break
            # Whatever holds an earlier word was met in that word's list, so only the words from here on count.
            rows = self.lists[word]
            if len(rows) > BLOCK:
                blocks, summary = self.blocks(word)
                reach = np.flatnonzero(summary[:, columns[turn:]].astype(np.int64) @ weights[turn:] >= floor)
                count["blocks"] += len(blocks)
                count["skipped"] += len(blocks) - len(reach)
                if not len(reach):
                    continue
                rows = np.concatenate([blocks[b] for b in reach])
            rows = rows[~seen[rows]]
            if not len(rows):
                continue
            seen[rows] = True
            count["scored"] += len(rows)
            scores = self.values[np.ix_(rows, columns)].astype(np.int64) @ weights
            good = scores >= floor
            if good.any():
                found_rows.append(rows[good])
                found_scores.append(scores[good])
                best = np.sort(np.concatenate([best, scores[good]]))[-k:]
                if len(best) == k:
                    floor = max(floor, int(best[0]))
        if not found_rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_rows), np.concatenate(found_scores)


def word_counts(text: bytes | None) -> Counter:
    return Counter(re.findall(WORD_BYTES, (text or b"").lower()))


def _item_words(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, word, times) of every item that has an id and a word; of rows with one id the smallest text."""
    one = items.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(key).cast("long").alias("item")).agg(
        F.min(text).alias("text"))
    schema = pa.schema([("item", pa.int64()), ("word", pa.binary()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            rows = [(i, w, n) for i, t in zip(batch.column("item").to_pylist(), texts_of(batch)) for w, n in word_counts(t).items()]
            yield batch_of(schema, [list(c) for c in zip(*rows)] if rows else [[]] * 3)

    return one.mapInArrow(run, "item long, word binary, times long")


def _forward(docs: DataFrame, words: list[bytes], key: str, text: str) -> DataFrame:
    """(key, length, words, counts) of every document with a word: its number of words with repeats, and of the listed
    words, by their places in the list, those it holds and how often."""
    number = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    schema = pa.schema([("key", pa.int64()), ("length", pa.int64()), ("words", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = number.value
        for batch in slices(batches, 500):
            out = [], [], [], []
            for i, t in zip(batch.column("key").to_pylist(), texts_of(batch, "_text")):
                counts = word_counts(t)
                if counts:
                    held = sorted((place[w], n) for w, n in counts.items() if w in place)
                    for column, x in zip(out, (i, sum(counts.values()), [w for w, _ in held], [n for _, n in held])):
                        column.append(x)
            yield batch_of(schema, list(out))

    thin = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("_text"))
    return thin.mapInArrow(run, "key long, length long, words array<int>, counts array<int>")


def _search(forward: DataFrame, groups: list[list[tuple[int, int, int]]], floors: dict[int, int], n: int, total: int, k: int) -> DataFrame:
    """(item, key, score) of every task's best documents: at least the k best of all are among them."""
    sent = forward.sparkSession.sparkContext.broadcast((groups, floors))
    schema = pa.schema([("item", pa.int64()), ("key", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, floor = sent.value
        items = [Items(p) for p in pairs]
        rows = max(64, min(ROWS, CELLS // max((len(g.words) for g in items), default=1)))
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in slices(batches, rows):
            ids = batch.column("key").to_numpy(zero_copy_only=False)
            length = batch.column("length").to_numpy(zero_copy_only=False)
            size = batch.column("words").value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(ids)), size)
            word = batch.column("words").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            times = batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            long = 75 + 25 * length * n // total
            part = 1_000_000_000 * times // (1000 * times + 12 * long[row])
            for group in items:
                at = np.minimum(np.searchsorted(group.words, word), len(group.words) - 1)
                mine = group.words[at] == word
                if not mine.any():
                    continue
                values = np.zeros((len(ids), len(group.words)), np.int32)
                values[row[mine], at[mine]] = part[mine]
                chunk = Chunk(values, group.mean)
                for item, columns, weights in zip(group.ids, group.columns, group.weights):
                    old_ids, old = best.get(item, none)
                    least = max(floor.get(item, 1), int(old[-1]) if len(old) == k else 1)
                    found, score = chunk.find(columns, weights, least, old, k, Counter())
                    if len(found):
                        every, scores = np.concatenate([old_ids, ids[found]]), np.concatenate([old, score])
                        order = np.lexsort((every, -scores))[:k]
                        best[item] = every[order], scores[order]
        if best:
            yield batch_of(schema, [np.repeat(list(best), [len(x) for x, _ in best.values()]),
                                    np.concatenate([x for x, _ in best.values()]), np.concatenate([s for _, s in best.values()])])

    return forward.mapInArrow(run, "item long, key long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, doc_key: str = "doc_id", item_key: str = "item_id",
                   text: str = "text", passed: int = PASS, grouped: int = GROUP, first: int = FIRST) -> DataFrame:
    """(item, rank, key, score): the k best documents of every item, those with a score above 0.

    Words, weights and scores are those of the contract of op11; N, L and df count all documents, whatever their id. Null
    and empty texts have no words. Documents with a null id count in the statistics and are no results; rows that
    repeat an id are results each. Items with a null id or text, or without a word, give nothing; of items that share an
    id the smallest text is searched for. Equal scores come by ascending id. Other columns are not read.

    Items go to the tasks in groups; beyond *passed* (item, word) pairs the documents are read once more for each
    such number, so no table of items is sent whole. Statistics do not depend on that.
    """
    asked = settle(_item_words(items, item_key, text))
    passes = max(1, math.ceil(asked.count() / passed))
    out = None
    for turn in range(passes):
        mine = asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == turn) if passes > 1 else asked
        rows = sorted((r["item"], bytes(r["word"]), r["times"]) for r in mine.collect())
        words = sorted({w for _, w, _ in rows})
        forward = settle(_forward(docs, words, doc_key, text), "forward")
        n, total = forward.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        holding = forward.select(F.explode("words").alias("word")).groupBy("word").count().collect()  # of the pass's words
        df = {r[0]: r[1] for r in holding}
        number = {w: i for i, w in enumerate(words)}
        groups: list[list[tuple[int, int, int]]] = [[]]
        for item, word, times in rows:
            place = number[word]
            weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[place] + 1))) if place in df else 0
            if weight > 0:  # other words add nothing
                if len(groups[-1]) >= grouped and groups[-1][-1][0] != item:
                    groups.append([])
                groups[-1].append((item, place, times * weight))
        groups = [g for g in groups if g]
        known = forward.filter("key IS NOT NULL")
        chance = F.pmod(F.xxhash64("key", "length", "words", "counts"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        floors = {}
        if n > 2 * first:
            sample = _ranked(_search(known.filter(chance < first / n), groups, {}, n, total, k), k)
            floors = {r["item"]: r["score"] for r in sample.filter(F.col("rank") == k).collect()}  # one number an item
        found = _search(known, groups, floors, n, total, k)
        out = found if out is None else out.unionByName(found)
    return _ranked(out, k).select(F.col("item"), F.col("rank").cast("int").alias("rank"), F.col("key"), "score")


def op11_ranked_search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return rank_documents(docs, benchmark).withColumnsRenamed({"item": "item_id", "key": "doc_id"})


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH lists AS (SELECT row_number() OVER () AS doc_row, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc_row, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM lists WHERE len(terms) > 0),
totals AS (SELECT count(*) AS all_docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS all_terms FROM docs),
tf AS (SELECT doc_row, term, count(*) AS tf FROM (SELECT doc_row, unnest(terms) AS term FROM docs) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(all_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, totals GROUP BY term),
items AS (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY item_id),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM items) GROUP BY ALL),
scored AS (
    SELECT item_id, doc_id, doc_row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * all_docs) // all_terms)))) AS BIGINT) AS score
    FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN docs USING (doc_row), totals
    WHERE doc_id IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
