"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

Test items are cut into units of at most ``UNIT`` words, indexed with BM25 impacts divided by the unit's score
against itself, so one threshold fits units of every length. Every passage of a document is a query: windows of
2 * UNIT words, UNIT apart, so each unit that a document has lies whole in one window. Passages whose upper bound
over rare terms cannot reach the threshold are set aside by one vectorised sum per document; for all others
block-max WAND retrieves every unit at or above the threshold. Items of retrieved units are verified on the whole
document: of the n-grams of question and answer together enough must be in it, or nearly all of the longer one's.

The index is built per shard of ``SHARD`` distinct items, which bounds what is sent to the executors; a larger benchmark
takes more shards, each of which reads the documents again. Unit frequencies and the mean length are counted over all
items first, so scores and results are those of one index.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD_BYTES, batch_of, ship, shipped, slices, texts_of
from plumbline.session import settle

FIND_WORDS = re.compile(WORD_BYTES)
#: Words of a unit, at most; passages have twice as many.
UNIT = 50
#: Share of a unit's own score that a passage must reach.
THRESHOLD = 0.5
#: Share of an item's word n-grams, of question and answer together, that the document must have.
OVERLAP = 0.6
#: Or the share of those of the longer side, if that has LONG or more.
WHOLE = 0.9
LONG = 8
GRAM = 3
SHARD = 5000
SHARD_BYTES = 16 << 20
K1, B = 1.2, 0.75
#: Share of a unit's score that may come from terms outside the first bound.
COMMON = 0.15
#: Cells of units and stretches up to which sums are kept in a plain array.
DENSE = 1_000_000
#: Postings in a block, each with its own largest impact.
BLOCK = 32


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The words before the last sentence or line, and those of it; halves if there is one sentence or
    the last is shorter than a gram."""
    parts = [FIND_WORDS.findall(x) for x in re.split(rb"[.?!\n]+", text.lower())]
    parts = [p for p in parts if p]
    words = [w for p in parts for w in p]
    if len(parts) > 1 and len(parts[-1]) >= GRAM and len(words) - len(parts[-1]) >= GRAM:
        return words[:-len(parts[-1])], parts[-1]
    return words[:len(words) // 2], words[len(words) // 2:]


def grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(GRAM, len(words))
    return set(zip(*(words[i:] for i in range(n)))) if n else set()


def units_of(text: bytes) -> list[list[bytes]]:
    """The words of an item in parts of at most UNIT, of about equal length."""
    question, answer = question_and_answer(text)
    words = question + answer
    parts = max(1, math.ceil(len(words) / UNIT))
    cut = [words[len(words) * k // parts:len(words) * (k + 1) // parts] for k in range(parts)]
    return [part for part in cut if part]


@dataclass
class Statistics:
    """Of the units of all items, whatever the shard: their number and mean length, and the number with each term."""

    units: int
    mean: float
    frequency: dict[bytes, int]

    @classmethod
    def of(cls, texts: list[bytes]) -> Statistics:
        units = [unit for text in texts for unit in units_of(text)]
        return cls(len(units), sum(map(len, units)) / max(1, len(units)), Counter(t for unit in units for t in set(unit)))


class Index:
    """Impacts of terms in units, in order of units, with the largest impact of each block."""

    def __init__(self, items: list[tuple[int, bytes]], known: Statistics | None = None):
        known = known or Statistics.of([text for _, text in items])
        self.items = [i for i, _ in items]
        self.sides = []
        self.unit_item: list[int] = []
        units: list[list[bytes]] = []
        for place, (_, text) in enumerate(items):
            question, answer = question_and_answer(text)
            self.sides.append((grams(question), grams(answer)))
            for part in units_of(text):
                units.append(part)
                self.unit_item.append(place)
        n, mean, frequency = known.units, known.mean, known.frequency
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for u, unit in enumerate(units):
            weights = {}
            for term in set(unit):
                idf = math.log(1 + (n - frequency[term] + 0.5) / (frequency[term] + 0.5))
                tf = unit.count(term)
                weights[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(unit) / mean))
            own = sum(weights.values())
            for term, weight in weights.items():
                postings.setdefault(term, []).append((u, weight / own))
        self.terms = {term: i for i, term in enumerate(sorted(postings))}
        ordered = [postings[t] for t in self.terms]
        self.units = [np.array([u for u, _ in p]) for p in ordered]
        self.impacts = [np.array([w for _, w in p]) for p in ordered]
        self.posted = [p.tolist() for p in self.units]
        self.impact = [p.tolist() for p in self.impacts]
        self.block_max = [[max(p[i:i + BLOCK]) for i in range(0, len(p), BLOCK)] for p in self.impact]
        self.best = [max(p) for p in self.impact]
        # Frequent terms are left out of the first bound, as long as no unit gets more than COMMON of its score
        # from them; the bound of a unit has that share as a constant.
        length = np.array([len(p) for p in self.units]) if ordered else np.zeros(0, int)
        self.essential = np.ones(len(ordered), bool)
        self.common = np.zeros(len(units))
        for term in np.argsort(-length, kind="stable").tolist():
            share = self.common[self.units[term]] + self.impacts[term]
            if length[term] > 1 and share.max() <= COMMON:
                self.essential[term] = False
                self.common[self.units[term]] = share
        # Flat postings of the essential terms.
        self.start = np.concatenate(([0], np.cumsum(np.where(self.essential, length, 0)))).astype(np.int64)
        keep = [i for i in range(len(ordered)) if self.essential[i]]
        self.flat_unit = np.concatenate([self.units[i] for i in keep]) if keep else np.zeros(0, np.int64)
        self.flat_impact = np.concatenate([self.impacts[i] for i in keep]) if keep else np.zeros(0)
        self.essential_terms = {t: i for t, i in self.terms.items() if self.essential[i]}

    def passages(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Passages (from, to) that may reach the threshold for some unit, by a bound: what a unit's essential terms in them
        give, and all of its other terms. Which units do is found by ``wand``."""
        ids = np.fromiter(map(self.essential_terms.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        term = ids[at]
        n = self.start[term + 1] - self.start[term]
        which = np.repeat(np.arange(len(at)), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        posting = self.start[term][which] + inside
        # Sum of impacts per unit and stretch of UNIT words; a passage is two stretches.
        stretch = at[which] // UNIT
        many = int(len(words) // UNIT) + 2
        cells = self.flat_unit[posting] * many + stretch
        if len(self.common) * many <= DENSE:
            score = np.bincount(cells, self.flat_impact[posting], minlength=len(self.common) * many)
            pair = score[:-1] + score[1:]  # the last stretch of a unit is empty
            units, stretches = np.divmod(np.flatnonzero(pair >= self._high(many)[:-1]), many)
        else:
            key, place = np.unique(cells, return_inverse=True)
            score = np.bincount(place, self.flat_impact[posting])
            adjacent = np.diff(key) == 1
            follow = np.append(np.where(adjacent, score[1:], 0.0), 0.0)
            before = np.insert(np.where(adjacent, score[:-1], 0.0), 0, 0.0)
            high = THRESHOLD - self.common[key // many] - 1e-9
            good = np.unique(np.concatenate((key[score + follow >= high], key[score + before >= high] - 1)))
            units, stretches = np.divmod(good, many)
        return [(place * UNIT, (place + 2) * UNIT) for place in np.unique(stretches).tolist()]

    def _high(self, many: int) -> np.ndarray:
        return np.repeat(THRESHOLD - self.common - 1e-9, many)

    def wand(self, words: set[bytes]) -> list[tuple[int, float]]:
        """All units that score at least THRESHOLD against a query, by block-max WAND."""
        lists = [i for i in map(self.terms.get, words) if i is not None]
        least = THRESHOLD - 1e-9
        at = dict.fromkeys(lists, 0)
        out = []
        while True:
            lists = [t for t in lists if at[t] < len(self.posted[t])]
            lists.sort(key=lambda t: self.posted[t][at[t]])
            bound, pivot = 0.0, None
            for t in lists:
                bound += self.best[t]
                if bound >= least:
                    pivot = self.posted[t][at[t]]
                    break
            if pivot is None:
                return out
            blocks, score, after = 0.0, 0.0, []
            upto = [t for t in lists if self.posted[t][at[t]] <= pivot]
            for t in upto:  # the block of each list that would hold the pivot
                units = self.posted[t]
                spot = bisect_left(units, pivot, at[t])
                if spot < len(units):
                    blocks += self.block_max[t][spot // BLOCK]
                    after.append(units[min(len(units), (spot // BLOCK + 1) * BLOCK) - 1] + 1)
                    if units[spot] == pivot:
                        score += self.impact[t][spot]
            goal = pivot + 1
            if blocks < least:  # no unit before the first of these blocks ends can reach it
                if len(upto) < len(lists):
                    after.append(self.posted[lists[len(upto)]][at[lists[len(upto)]]])
                goal = max(goal, min(after))
            elif score >= least:
                out.append((pivot, score))
            for t in upto:
                at[t] = bisect_left(self.posted[t], goal, at[t])

    def find(self, text: bytes) -> list[tuple[int, float, float, float]]:
        """(place of the item, best score, question overlap, answer overlap) of the verified items."""
        words = FIND_WORDS.findall(text.lower())
        best: dict[int, float] = {}
        for low, high in self.passages(words):
            for unit, score in self.wand(set(words[low:high])):
                item = self.unit_item[unit]
                best[item] = max(best.get(item, 0.0), score)
        if not best:
            return []
        pool: dict[int, set[tuple[bytes, ...]]] = {}
        out = []
        for item, score in sorted(best.items()):
            sides, shares, hits = self.sides[item], [], 0
            for side in sides:
                n = len(next(iter(side), ()))
                if n and n not in pool:
                    pool[n] = set(zip(*(words[i:] for i in range(n))))
                own = sum(g in pool[n] for g in side)
                hits += own
                shares.append(own / len(side) if side else 1.0)
            many = sum(map(len, sides))
            if hits >= OVERLAP * many or any(
                    share >= WHOLE and len(side) >= max(LONG, many / 2) for side, share in zip(sides, shares)):
                out.append((item, round(score, 9), *shares))
        return out


def _unit_counts(items: DataFrame) -> DataFrame:
    """(term, n): units with a term; with a null term, the units and (m) all their words."""
    schema = pa.schema([("term", pa.binary()), ("n", pa.int64()), ("m", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            found = Statistics.of(batch.column("text").to_pylist())
            terms = list(found.frequency)
            yield batch_of(schema, [[None, *terms], [found.units, *(found.frequency[t] for t in terms)],
                                    [round(found.units * found.mean), *[0] * len(terms)]])

    return items.mapInArrow(run, "term binary, n long, m long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _indexes(benchmark: DataFrame, shard: int) -> Iterator[tuple[Index, list[int]]]:
    """Indexes of the distinct items (item_id, text), of about *shard* items and SHARD_BYTES of text at most, one at a time on
    the driver, and how often each item is repeated. Scores do not depend on the shards: statistics are of all items."""
    items = settle(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).filter(
        "text IS NOT NULL").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times")), "items")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(1, math.ceil(n / shard), math.ceil(size / SHARD_BYTES))
    counts = settle(_unit_counts(items), "units")
    total = counts.filter("term IS NULL").first() or {"n": 0, "m": 0}
    for k in range(shards):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        own = _unit_counts(part).select("term").filter("term IS NOT NULL")
        frequency = {bytes(r["term"]): r["n"] for r in counts.join(own, "term").select("term", "n").collect()}
        rows = part.orderBy("item_id", "text").collect()
        known = Statistics(total["n"], total["m"] / max(1, total["n"]), frequency)
        yield Index([(r["item_id"], bytes(r["text"])) for r in rows], known), [r["times"] for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                 shard: int = SHARD) -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap): one row per row of *docs* and test item in it.

    Items and documents without a word, or with a null text, match nothing; items with a null id are kept with
    it. Items or documents that are repeated give a row for each. Other columns are not read. *docs* may hold
    columns of any name: only *key* and *text* are used.
    """
    schema = pa.schema([("key", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                        ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    kinds = "key long, item_id long, score double, question_overlap double, answer_overlap double"
    thin = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_text"))
    out = None
    for built, times in _indexes(benchmark, shard):
        index = ship(docs.sparkSession, built)

        def run(batches: Iterator[pa.RecordBatch], index=index, times=times) -> Iterator[pa.RecordBatch]:
            test = shipped(index)
            for batch in slices(batches, 500):
                rows = [(i, test.items[place], *told) for i, t in zip(batch.column("key").to_pylist(), texts_of(batch, "_text"))
                        if t for place, *told in test.find(t) for _ in range(times[place])]
                yield batch_of(schema, [list(c) for c in zip(*rows)] if rows else [[]] * 5)

        found = thin.mapInArrow(run, kinds)
        out = found if out is None else out.unionByName(found)
    return out


def op3_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark).withColumnRenamed("key", "doc_id")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, shard: int = SHARD) -> DataFrame:
    """The rows of *docs* without a test item in their text; null and empty texts hold none and stay, rows that repeat are
    judged each, an empty benchmark keeps all. Every shard of the index filters what the one
    before it kept, in one pass and without a shuffle."""
    kept = docs.select(F.struct("*").alias("doc"))
    for built, _ in _indexes(benchmark, shard):
        index = ship(docs.sparkSession, built)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            test = shipped(index)
            for batch in slices(batches, 500):
                texts = batch.column("doc").field("text").cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([not (t and test.find(t)) for t in texts], pa.bool_()))

        kept = kept.mapInArrow(run, kept.schema)
    return kept.select("doc.*")
