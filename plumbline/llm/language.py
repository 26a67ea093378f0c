"""Language identification by prediction by partial matching (PPM).

Per language a tree of byte contexts of up to ``ORDER`` bytes predicts the next byte; a byte not seen in a
context costs an escape and is predicted from the next shorter one, down to a uniform code. Statistics are
frozen after training, so the code length of a text is a sum of table entries, exact for every byte, and the
language with the shortest code wins.

The trees of all languages share one set of nodes (strings of up to ORDER + 1 bytes). A node has, per
language, the full cost of its last byte after the bytes before it, escapes included, and the cost of escaping
from it as a context. Evaluating a byte is then one look-up per order for all languages together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import batch_of, remainder, ship, shipped, slices, texts_of, unit_hash

ORDER = 3
#: Training documents per language, in expectation; chosen by a hash of the id. A model parameter.
SAMPLE = 3000
#: Strings seen less often in the sample, over all languages, are left out of the tree (single bytes stay).
LEAST = 3
#: Every byte that is neither an ASCII letter nor part of a non-ASCII character is this separator.
SEPARATOR = 0x20
ASCII_LETTER = re.compile(rb"[A-Za-z]")
CLASS = np.full(256, SEPARATOR, np.uint8)
CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
CLASS[0x80:] = np.arange(0x80, 256)


def letters(text: bytes) -> np.ndarray:
    """Byte classes of a text that begins with a separator; runs of separators are one."""
    data = CLASS[np.frombuffer(b" " + text, np.uint8)]
    keep = data != SEPARATOR
    keep[1:] |= keep[:-1]
    keep[0] = True
    return data[keep]


def _has_letter(text: bytes) -> bool:
    return ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text.decode("utf-8", "replace")))


class Trees:
    """Frozen context trees. Built from rows (language, length, string, count)."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        self.languages = sorted({r[0] for r in rows})
        n_lang = len(self.languages)
        place = {x: i for i, x in enumerate(self.languages)}
        counts: list[dict[int, np.ndarray]] = [{} for _ in range(ORDER + 2)]
        for language, length, string, n in rows:
            level = counts[length]
            if string not in level:
                level[string] = np.zeros(n_lang)
            level[string][place[language]] += n
        for length in range(2, ORDER + 2):  # a string stays only if the strings it extends stay
            counts[length] = {s: c for s, c in counts[length].items()
                              if c.sum() >= LEAST and s >> 8 in counts[length - 1]
                              and s & (256 ** (length - 1) - 1) in counts[length - 1]}
        bytes_seen = sorted(counts[1])
        self.n_symbols = len(bytes_seen) + 1  # 0: a byte not seen in training
        self.symbol = np.zeros(256, np.uint8 if self.n_symbols < 256 else np.uint16)
        self.symbol[bytes_seen] = np.arange(1, len(bytes_seen) + 1)

        node = [{0: 1}] + [{s: i + 1 for i, s in enumerate(sorted(c))} for c in counts[1:]]
        total = [np.zeros((len(x) + 1, n_lang)) for x in node]
        kinds = [np.zeros((len(x) + 1, n_lang)) for x in node]
        for length in range(1, ORDER + 2):
            for s, c in counts[length].items():
                above = node[length - 1][s >> 8 if length > 1 else 0]
                total[length - 1][above] += c
                kinds[length - 1][above] += c > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            self.escape = [np.where(t > 0, -np.log2(k / (t + k)), 0.0).astype(np.float32)
                           for t, k in zip(total[:-1], kinds[:-1])]
        uniform = math.log2(self.n_symbols)
        self.child, costs, self.offset = [], [(self.escape[0][1] + uniform)[None, :]], [0]
        shorter = {}
        for length in range(1, ORDER + 2):
            table = np.zeros((len(node[length - 1]) + 1, self.n_symbols), np.int32)
            cost = np.zeros((len(node[length]) + 1, n_lang), np.float32)
            for s, i in node[length].items():
                above = node[length - 1][s >> 8 if length > 1 else 0]
                c = counts[length][s]
                back = uniform if length == 1 else shorter[s & (256 ** (length - 1) - 1)]
                seen = total[length - 1][above] + kinds[length - 1][above]
                with np.errstate(divide="ignore"):
                    cost[i] = np.where(c > 0, -np.log2(c / np.maximum(seen, 1)), self.escape[length - 1][above] + back)
                table[above, self.symbol[s & 255]] = i
            shorter = {s: cost[i] for s, i in node[length].items()}
            self.child.append(table)
            self.offset.append(sum(len(x) for x in costs))
            costs.append(cost)
        self.cost = np.concatenate(costs)

    def told(self, text: bytes | None) -> tuple[str, float, float | None]:
        """Predicted language, its posterior probability, and bits per byte."""
        bits, n = self.bits(text) if text and _has_letter(text) else (np.zeros(0), 0)
        if n == 0:
            return "und", 0.0, None
        best = int(np.argmin(bits))
        return (self.languages[best], float(1.0 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum()),
                float(bits[best] / n))

    def bits(self, text: bytes) -> tuple[np.ndarray, int]:
        """Code length of the text in bits per language, and its number of coded bytes."""
        data = self.symbol[letters(text)]
        n = len(data) - 1
        if n <= 0 or not self.languages:
            return np.zeros(len(self.languages)), 0
        total = np.zeros(len(self.languages))
        for start in range(1, n + 1, 1 << 18):
            stop = min(n + 1, start + (1 << 18))
            low = max(0, start - ORDER)
            total += self._bits(data[low:stop], start - low)
        return total, n

    def _bits(self, data: np.ndarray, first: int) -> np.ndarray:
        """Bits of data[first:], with what lies before as context."""
        n = len(data)
        # at[k][i]: the node of the string of k bytes that begins at i, 0 if there is none.
        at = [np.ones(n, np.int32)]
        for k in range(1, ORDER + 2):
            if n - k + 1 <= 0:
                break
            at.append(self.child[k - 1][at[k - 1][:n - k + 1], data[k - 1:]])
        where = np.arange(first, n)
        row = np.zeros(len(where), np.int64)
        total = np.zeros(self.cost.shape[1])
        open_ = np.ones(len(where), bool)
        for k in range(len(at) - 1, 0, -1):  # the longest string that ends here
            begin = where - (k - 1)
            inside = begin >= 0
            found = np.where(inside, at[k][np.maximum(begin, 0)], 0)
            hit = open_ & (found > 0)
            row[hit] = self.offset[k] + found[hit]
            open_ &= ~hit
            missed = np.flatnonzero(open_ & inside)
            if len(missed) and k > 1:  # escape from the context of k - 1 bytes; row 0 costs nothing
                total += self.escape[k - 1][at[k - 1][begin[missed]]].sum(axis=0, dtype=np.float64)
        return total + self.cost[row].sum(axis=0, dtype=np.float64)


def _strings(sample: DataFrame) -> DataFrame:
    """(lang, length, string, n): counts of all strings of up to ORDER + 1 bytes."""
    schema = pa.schema([("lang", pa.string()), ("length", pa.int32()), ("string", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            grouped: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(texts_of(batch), batch.column("lang").to_pylist()):
                grouped.setdefault(lang, []).append(letters(text))
            for lang, parts in grouped.items():
                for k in range(1, ORDER + 2):
                    keys = []
                    for data in parts:
                        key = np.zeros(max(0, len(data) - k + 1), np.int64)
                        for i in range(k if len(key) else 0):
                            key = key << 8 | data[i:len(data) - k + 1 + i]
                        keys.append(key)
                    found, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield batch_of(schema, [[lang] * len(found), [k] * len(found), found, n])

    counted = sample.mapInArrow(run, "lang string, length int, string long, n long")
    return counted.groupBy("lang", "length", "string").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Trees:
    """Trees of the languages in rows (doc_id, text, lang) for which *learn* holds.

    Per language about *sample* documents are read, by a hash of their id. What reaches the driver is
    bounded by that sample: the strings of up to ORDER + 1 bytes that it holds LEAST times or more.
    """
    usable = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return Trees([])
    share = F.create_map(*[F.lit(x) for pair in ((k, min(1.0, sample / n)) for k, n in sizes.items()) for x in pair])
    chosen = usable.filter(unit_hash(F.lit("language"), F.col("doc_id").cast("string")) < share[F.col("lang")])
    strings = _strings(chosen.select("text", "lang")).groupBy("length", "string").agg(
        F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by")).filter(f"length = 1 OR all >= {LEAST}")
    return Trees([(lang, r["length"], r["string"], n) for r in strings.collect() for lang, n in r["by"]])


def identify(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """*docs* with lang_pred, score and bits (per byte) in place of columns of those names.

    ``score`` is the posterior probability of the predicted language under a uniform prior. A null text, a
    text without a letter, and any text where no language was learned give ``und``, score 0 and null
    bits. Ties go to the first language in order of name.
    """
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64())])
    rest = docs.drop(*schema.names)
    sent = ship(docs.sparkSession, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped(sent)
        for batch in slices(batches, 500):
            found = list(zip(*map(model.told, texts_of(batch, text)))) or [[], [], []]
            out = [*batch.columns, *(pa.array(x, type=f.type) for x, f in zip(found, schema))]
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names + schema.names)

    kinds = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()),
                          T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])
    return rest.mapInArrow(run, kinds)


def op5_language_id(docs: DataFrame) -> DataFrame:
    held_out = remainder("doc_id", 3) == 1
    trees = train(docs, ~held_out)
    return identify(docs.select("doc_id", "text"), trees).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language was told: not ``und``, and with a code shorter than the uniform one over
    the bytes of the training texts, which text of none of the languages exceeds. Null and empty texts, and those without a
    letter, go; rows that repeat are judged each; an empty table stays empty."""
    held_out = remainder("doc_id", 3) == 1
    trees = train(docs, ~held_out)
    most = math.log2(trees.n_symbols)
    kept = docs.select(F.struct("*").alias("doc"))
    sent = ship(docs.sparkSession, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped(sent)
        for batch in slices(batches, 500):
            told = map(model.told, batch.column("doc").field("text").cast(pa.binary()).to_pylist())
            yield batch.filter(pa.array([lang != "und" and bits < most for lang, _, bits in told], pa.bool_()))

    return kept.mapInArrow(run, kept.schema).select("doc.*")
