"""Toxicity by weak supervision.

Many voters say toxic (1), clean (-1) or nothing (0) about a document: lexicons of known words, lexicons mined from labelled
documents (one for each kind of entry, a word or a beginning of 4 to 7 bytes, and each of three grades of how telling it
is), and patterns of spelling. A generative label model estimates from the votes alone how accurate every voter is on
either class, by expectation-maximisation; labels set the share of the classes and hold a fifth of the rows, its anchors,
in place. As voters are not independent, a voter's evidence is divided by one plus its squared correlations with the other
voters within the classes. The posterior labels, not the given ones, train a linear classifier on the voters' strengths, which
scores whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD_BYTES, batch_of, remainder, ship, shipped, slices, texts_of, unit_hash
from plumbline.session import settle

#: Labelled training documents per class, in expectation; chosen by a hash of the id. A model parameter.
SAMPLE = 8000
#: Lengths of word beginnings that are mined; whole words are mined too.
STEMS = (4, 5, 6, 7)
#: Most mined entries that the model keeps, the strongest first. A model parameter.
ENTRIES = 5000
#: A mined entry is in so many toxic documents, and this many times as frequent among them, at every size of sample.
SUPPORT, RATIO = 4, 20.0
#: Share of the rows whose posterior is their label, and how often such a row counts: its class is known.
ANCHORS, KNOWN = 0.2, 20.0
GRADES = 3
LEXICONS = tuple(frozenset(words.split()) for words in (
    b"idiot idiots moron morons stupid loser losers pathetic clown clowns dumb dumbass retard",
    b"bastard bitch asshole shit fuck fucking cunt whore slut",
    b"scum trash worthless disgusting subhuman vermin",
))
FIND_WORDS = re.compile(WORD_BYTES)
KINDS = ("word", *(f"stem{n}" for n in STEMS))
VOTERS = (*(f"list{i}" for i in range(len(LEXICONS))), *(f"{kind}-{grade}" for kind in KINDS for grade in range(GRADES)),
          "dense", "shout", "marks")
PATTERNS = 3


def kind_of(stem: bytes) -> int:
    return 0 if stem.endswith(b"\0") else 1 + STEMS.index(len(stem))


def stems(words: set[bytes]) -> set[bytes]:
    """Words as ``word`` and zero, beginnings by their bytes."""
    out = {w + b"\0" for w in words if len(w) <= 24}
    for n in STEMS:
        out.update(w[:n] for w in words if len(w) > n)
    return out


@dataclass
class Model:
    """*entries* are (voter, log ratio) of the mined words and beginnings."""

    entries: dict[bytes, tuple[int, float]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(VOTERS) + 1))

    @classmethod
    def of(cls, mined: dict[bytes, float]) -> Model:
        """Entries of each kind in three grades of equal number, the most telling first."""
        entries = {}
        for kind in range(len(KINDS)):
            mine = sorted((s for s in mined if kind_of(s) == kind), key=lambda s: (-mined[s], s))
            for place, stem in enumerate(mine):
                entries[stem] = len(LEXICONS) + kind * GRADES + place * GRADES // len(mine), mined[stem]
        return cls(entries)

    def strengths(self, text: bytes | None) -> np.ndarray:
        """What each voter finds, as a number of 0 or more."""
        text = text or b""
        words = FIND_WORDS.findall(text.lower())
        found = set(words)
        out = np.zeros(len(VOTERS))
        bad = 0
        for place, lexicon in enumerate(LEXICONS):
            hits = found & lexicon
            out[place] = math.log1p(sum(words.count(w) for w in hits)) if hits else 0.0
            bad += len(hits)
        for stem in self.entries.keys() & stems(found):
            voter, weight = self.entries[stem]
            out[voter] += weight
            bad += 1
        out[len(LEXICONS):-PATTERNS] = np.log1p(out[len(LEXICONS):-PATTERNS])
        out[-3] = min(1.0, 10.0 * bad / (len(words) + 10))
        letters = sum(map(text.count, (b"e", b"a", b"n", b"t"))) + 1
        out[-2] = sum(map(text.count, (b"E", b"A", b"N", b"T"))) / letters > 1.0
        out[-1] = text.count(b"!") > 0.02 * len(text)
        return out

    def score(self, strengths: np.ndarray) -> float:
        z = float(self.weights[0] + strengths @ self.weights[1:])
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, z))))


def votes(strengths: np.ndarray) -> np.ndarray:
    """Votes of the voters for rows of strengths. The lists vote clean where they find nothing, the
    patterns of spelling abstain."""
    found = strengths > 0
    out = np.where(found, 1, -1)
    out[:, 1 - PATTERNS:] = np.where(found[:, 1 - PATTERNS:], 1, 0)
    return out


def label_model(vote: np.ndarray, share: float, anchors: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior P(toxic) of every row of votes, by expectation-maximisation. *share* is the share of toxic rows; *anchors* is
    1 or 0 for the rows that are held, NaN for all others, whose posterior comes from their votes alone."""
    held = ~np.isnan(anchors)
    for_toxic = (vote == 1).sum(axis=1)
    cut = np.quantile(for_toxic, 1 - share)  # rows with the most votes, as many as there are toxic ones
    posterior = np.where(for_toxic > max(cut, 0), 0.9, 0.1)
    told = math.log(share) - math.log1p(-share)
    states = np.stack([vote == s for s in (-1, 0, 1)], axis=2).astype(float)  # rows, voters, states
    counts = np.where(held, KNOWN, 1.0)
    for _ in range(rounds):
        posterior = np.where(held, anchors, posterior)
        residual = np.zeros((vote.shape[1], vote.shape[1]))
        rates = []
        for weight in (counts * posterior, counts * (1 - posterior)):
            mass = weight.sum() + 1e-9
            rates.append((np.tensordot(weight, states, axes=(0, 0)) + 0.1) / (mass + 0.3))
            mean = weight @ vote / mass
            centred = (vote - mean) * np.sqrt(weight / mass)[:, None]
            residual += centred.T @ centred / 2
        spread = np.sqrt(np.maximum(np.diag(residual), 1e-9))
        correlation = (residual / np.outer(spread, spread)) ** 2
        np.fill_diagonal(correlation, 0.0)
        correlation[spread < 1e-3] = 0.0
        correlation[:, spread < 1e-3] = 0.0
        part = 1.0 / (1.0 + correlation.sum(axis=1))
        ratio = np.log(rates[0]) - np.log(rates[1])  # voters, states
        evidence = np.einsum("rvs,vs,v->r", states, ratio, part) + told
        posterior = 1 / (1 + np.exp(-np.clip(evidence, -50, 50)))
    return np.where(held, anchors, posterior)


def linear(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights (constant first) of a logistic regression on soft labels, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (y - p) / len(x) - decay * w
        curve = (x.T * np.maximum(p * (1 - p), 1e-6)) @ x / len(x) + decay * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(curve, gradient), -2, 2)
    return w


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic, mine, anchor) of about *sample* training documents per class, each text once. ``mine``
    halves them: entries mined from one half are weighed on the other, so that chance finds get no weight."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & (remainder("doc_id", 3) != 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    chosen = usable.filter(unit_hash(F.lit("toxicity"), F.col("doc_id").cast("string")) < share)
    # About 2 * sample ids: a bound that does not grow with the table.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text IS NOT NULL")
    return settle(rows.groupBy(F.md5("text").alias("digest")).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic")).select(
        "text", "toxic", (F.substring("digest", 1, 1) < "8").alias("mine"),
        (unit_hash(F.lit("anchor"), F.col("digest")) < ANCHORS).alias("anchor")), "labelled")


def _mined(sample: DataFrame, entries: int) -> dict[bytes, float]:
    schema = pa.schema([("stem", pa.binary()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices(batches, 500):
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist()):
                counts[toxic].update(stems(set(FIND_WORDS.findall(text.lower()))))
        keys = list(counts[0].keys() | counts[1].keys())
        yield batch_of(schema, [keys, [counts[1][k] for k in keys], [counts[0][k] for k in keys]])

    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return {}
    found = sample.mapInArrow(run, "stem binary, toxic long, clean long").groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1))
    strong = found.filter((F.col("toxic") >= SUPPORT) & (ratio >= RATIO))
    rows = strong.select("stem", F.log(ratio).alias("w"), "toxic").orderBy(
        F.desc(F.col("w") * F.col("toxic")), "stem").limit(entries).collect()
    return {bytes(r["stem"]): r["w"] for r in rows}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """Fit on about *sample* labelled training documents per class. Without documents of both classes the
    model knows its fixed list only."""
    rows = _labelled(docs, labels, sample)
    model = Model()
    model.weights[:] = [-3.0, *[4.0] * len(LEXICONS), *[0.0] * (len(VOTERS) - len(LEXICONS))]
    if rows is None:
        return model
    schema = pa.schema([("toxic", pa.int32()), ("anchor", pa.bool_()), ("x", pa.list_(pa.float64()))])
    data = []
    for half in ("mine", "NOT mine"):  # entries of one half find their weights in the other
        sent = ship(docs.sparkSession, Model.of(_mined(rows.filter(half), entries)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            other = shipped(sent)
            for batch in slices(batches, 500):
                yield batch_of(schema, [batch.column("toxic").cast(pa.int32()), batch.column("anchor"),
                                        [other.strengths(t) for t in texts_of(batch)]])

        data += rows.filter(f"NOT ({half})").mapInArrow(run, "toxic int, anchor boolean, x array<double>").collect()  # sample rows
    model = Model.of(_mined(rows, entries))
    if not data:
        return model
    x, y = np.array([r["x"] for r in data]), np.array([r["toxic"] for r in data], float)
    anchors = np.where([r["anchor"] for r in data], y, np.nan)
    posterior = label_model(votes(x), min(max(y.mean(), 1e-3), 1 - 1e-3), anchors)
    model.weights = linear(x, posterior)
    return model


def score_toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): one row per row of *docs*; a null or empty text gets the score of no findings. Other
    columns are not read."""
    sent = ship(docs.sparkSession, model)
    schema = pa.schema([("key", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shipped(sent)
        for batch in slices(batches, 500):
            yield batch_of(schema, [batch.column("key"), [fitted.score(fitted.strengths(t)) for t in texts_of(batch, "_text")]])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_text")).mapInArrow(
        run, "key long, score double")


def op8_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs, train(docs, labels)).withColumnRenamed("key", "doc_id")
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))
