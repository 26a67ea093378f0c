"""Language-model scores: add-0.1 word unigrams, and the likelihood of a text over all its subword
segmentations.

The lattice model takes the pieces of an existing vocabulary. A text is a stream of pieces and one end; a
piece that begins a word begins with a space. Pieces never run across words, so the probability of a text is
the product of its words' probabilities, each the sum over all segmentations of the word. Every distinct word
is therefore scored once, by a forward recursion over its bytes, and all counting goes through one table of
distinct words.

Piece weights start from the vocabulary's own scores and are then re-estimated once: expected counts of the
pieces over all training words (forward and backward recursion), with additive smoothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import batch_of, remainder, slices, texts_of
from plumbline.session import settle

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct words a task counts before it passes them on.
FLUSH = 300_000
#: The words with most training tokens, which are looked up in the task; all others are joined.
FREQUENT = 100_000
#: Weight that each piece has besides its expected count.
SMOOTH = 0.1
END = b""


def read_pieces(path: str = VOCABULARY) -> dict[bytes, float]:
    """Pieces as bytes with weights that add up to 1. Byte fallbacks are pieces of one byte.

    The scores of this kind of vocabulary are ranks (0, -1, -2, ...); by Zipf's law the weight of a piece is
    taken as 1 / (rank + 1). A vocabulary with log-probabilities for scores would be taken as they are.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    scores = [model.get_score(i) for i in range(n)]
    ranks = min(scores) < -1000
    weights: dict[bytes, float] = {}
    for i in range(n):
        if model.is_control(i) or model.is_unknown(i):
            continue
        if model.is_byte(i):
            piece, weight = bytes([int(model.id_to_piece(i)[3:5], 16)]), 1.0 / n
        else:
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            weight = 1.0 / (1.0 - scores[i]) if ranks else math.exp(scores[i])
        if piece and b" " not in piece[1:]:
            weights[piece] = weights.get(piece, 0.0) + weight
    for byte in range(256):  # every text has a segmentation
        weights.setdefault(bytes([byte]), 1.0 / n)
    weights[END] = 1.0 / 100
    total = sum(weights.values())
    return {piece: w / total for piece, w in weights.items()}


class Lattice:
    """Sums over all segmentations of a word under fixed piece weights."""

    def __init__(self, weights: dict[bytes, float]):
        self.weights = weights
        pieces = sorted(weights)
        self.ids = {piece: i for i, piece in enumerate(pieces)}
        self.begins = {piece[:k] for piece in pieces for k in range(1, len(piece) + 1)}
        self.longest = max(map(len, pieces))

    def forward(self, word: bytes) -> tuple[list[float], list[float], list[tuple[int, int, bytes]]]:
        """Sums of all segmentations up to each byte, divided by exp of the second list, and the arcs."""
        text = b" " + word
        n, weights, begins = len(text), self.weights, self.begins
        sums, logs = [0.0] * (n + 1), [0.0] * (n + 1)
        sums[0] = 1.0
        arcs: list[tuple[int, int, bytes]] = []
        into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            if i:
                found = into[i]
                base = logs[i - 1]
                total = 0.0
                for start, weight in found:
                    total += sums[start] * weight * (math.exp(logs[start] - base) if logs[start] != base else 1.0)
                if total < 1e-120:  # carry the scale as a logarithm
                    base += math.log(total) if total > 0.0 else -700.0
                    total = 1.0 if total > 0.0 else 0.0
                sums[i], logs[i] = total, base
            for j in range(i + 1, min(n, i + self.longest) + 1):
                piece = text[i:j]
                if piece not in begins:
                    break
                weight = weights.get(piece)
                if weight is not None:
                    into[j].append((i, weight))
                    arcs.append((i, j, piece))
        base = logs[n - 1]
        total = sum(sums[s] * w * (math.exp(logs[s] - base) if logs[s] != base else 1.0) for s, w in into[n])
        sums[n], logs[n] = total, base
        return sums, logs, arcs

    def log10(self, word: bytes) -> float:
        sums, logs, _ = self.forward(word)
        return (math.log(sums[-1]) + logs[-1]) / math.log(10)

    def expect(self, word: bytes, times: float, into: dict[bytes, float]) -> None:
        """Add the expected counts of the word's pieces."""
        sums, logs, arcs = self.forward(word)
        n = len(sums) - 1
        if sums[n] <= 0.0:
            return
        back, shift = [0.0] * (n + 1), [-math.inf] * (n + 1)
        back[n], shift[n] = 1.0, 0.0
        for i, j, piece in reversed(arcs):  # arcs are in order of their start
            term, scale = back[j] * self.weights[piece], shift[j]
            if shift[i] == -math.inf:
                back[i], shift[i] = term, scale
            elif scale == shift[i]:
                back[i] += term
            else:
                back[i] += term * math.exp(scale - shift[i])
            if 0.0 < back[i] < 1e-120:
                shift[i] += math.log(back[i])
                back[i] = 1.0
        log_total = math.log(sums[n]) + logs[n]
        for i, j, piece in arcs:
            share = sums[i] * self.weights[piece] * back[j]
            if share > 0.0:
                share = math.exp(math.log(share) + logs[i] + shift[j] - log_total)
                into[piece] = into.get(piece, 0.0) + times * share


def _words(docs: DataFrame) -> DataFrame:
    """(word, c): every distinct word of *docs* (_text, learn) with its number of training tokens."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in slices(batches, 500):
            for text, learn in zip(texts_of(batch, "_text"), batch.column("learn").to_pylist()):
                words = text.lower().split() if text else []
                if learn:
                    counts.update(words)
                else:
                    for word in words:
                        counts.setdefault(word, 0)
            if len(counts) >= FLUSH:
                yield batch_of(schema, [list(counts), list(counts.values())])
                counts = Counter()
        yield batch_of(schema, [list(counts), list(counts.values())])

    tasks = docs.mapInArrow(run, "word binary, c long")
    return tasks.groupBy("word").agg(F.sum("c").alias("c"))


def _expected(words: DataFrame, weights: dict[bytes, float]) -> dict[bytes, float]:
    """Expected counts of the pieces over the training words; at most one value per piece reaches the
    driver."""
    schema = pa.schema([("piece", pa.binary()), ("n", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, into = Lattice(weights), {}
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                lattice.expect(word, c, into)
        yield batch_of(schema, [list(into), list(into.values())])

    rows = words.filter("c > 0").mapInArrow(run, "piece binary, n double").groupBy("piece").agg(F.sum("n")).collect()
    return {bytes(piece): n for piece, n in rows}


def _with_lattice(words: DataFrame, weights: dict[bytes, float]) -> DataFrame:
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("lattice", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(weights)
        for batch in batches:
            yield batch_of(schema, [batch.column("word"), batch.column("c"),
                                    [lattice.log10(w) for w in batch.column("word").to_pylist()]])

    return words.mapInArrow(run, "word binary, c long, lattice double")


def _looked_up(docs: DataFrame, frequent: dict[bytes, tuple[float, float]]) -> DataFrame:
    """One row per document with the sums over its frequent words and a list of its other words."""
    schema = pa.schema([("key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base", pa.float64()), ("lattice", pa.float64()),
                        ("rest", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))])
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # FREQUENT words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in slices(batches, 500):
            tokens, known, base, lattice, rest = [], [], [], [], []
            for text in texts_of(batch, "_text"):
                words = text.lower().split() if text else []
                k, b, s, others = 0, 0.0, 0.0, []
                for word, n in Counter(words).items():
                    hit = table.get(word)
                    if hit is None:
                        others.append({"word": word, "n": n})
                    else:
                        k += n
                        b += n * hit[0]
                        s += n * hit[1]
                tokens.append(len(words) + 1)
                known.append(k)
                base.append(b)
                lattice.append(s)
                rest.append(others)
            yield batch_of(schema, [batch.column("key"), batch.column("held_out"), tokens, known, base, lattice, rest])

    return docs.mapInArrow(run, "key long, held_out boolean, n_tokens long, n_known long, base double, "
                                "lattice double, rest array<struct<word:binary,n:long>>")


def score_texts(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of *docs*.

    Rows whose crc32 of the id modulo 10 is 0 are held out; a null id is not held out. A null text is an
    empty one: one end token. With no training rows every count is 0, the base score of a token is
    log10(0.1 / 0.1) = 0, and the lattice keeps the vocabulary's weights. Repeated rows count as often as they
    are there. Other columns of *docs* are not read.
    """
    thin = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_text"),
                       (remainder(key, 10) == 0).alias("held_out")).withColumn("learn", ~F.col("held_out"))
    words = settle(_words(thin.select("_text", "learn")), "words")
    ends = thin.filter("learn").count()
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = total + ends, distinct + (ends > 0)
    below = math.log10(total + 0.1 * (distinct + 1)) if total else math.log10(0.1)

    weights = read_pieces(vocabulary)
    if total:
        counts = _expected(words, weights) | {END: float(ends)}
        all_counts = sum(counts.values()) + SMOOTH * len(weights)
        weights = {piece: (counts.get(piece, 0.0) + SMOOTH) / all_counts for piece in weights}
    scored = settle(_with_lattice(words, weights), "scored-words")

    top = scored.filter("c > 0").orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    frequent = {bytes(w): (math.log10(c + 0.1), s) for w, c, s in top}
    looked = settle(_looked_up(thin.drop("learn"), frequent).withColumn("row", F.monotonically_increasing_id()), "texts")
    others = looked.select("row", F.explode("rest").alias("w")).select("row", "w.word", "w.n").join(scored, "word")
    n = F.col("n")
    sums = others.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, n).otherwise(0)).alias("known2"),
        F.sum(n * F.log10(F.col("c") + 0.1)).alias("base2"), F.sum(n * F.col("lattice")).alias("lattice2"))
    zero = F.lit(0.0)
    end_base, end_lattice = math.log10(ends + 0.1), math.log10(weights[END])
    return looked.drop("rest").join(sums, "row", "left").select(
        "key", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known2", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero) + F.lit(end_base) - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (F.col("lattice") + F.coalesce("lattice2", zero) + F.lit(end_lattice)).alias("score"))


def op9_lm_score(docs: DataFrame) -> DataFrame:
    return score_texts(docs).withColumnRenamed("key", "doc_id")
