"""URL filter: path rules first, then the ratio of two character language models.

A URL that a rule fits gets the rule's verdict. All others are judged by two byte-level Markov models of variable order,
one of accepted and one of rejected URLs. Accepted are the distinct URLs that a rule allows; rejected are those that a
rule blocks and those without a rule whose host holds a seed word. A byte's probability mixes all orders up to
``ORDER`` (Witten and Bell): a context gives its counts the more weight the oftener it was seen and the fewer bytes
followed it, and contexts that were never seen count nothing. The difference of the two log-likelihoods over the number
of symbols is compared with a threshold, calibrated on URLs that were kept out of the counts.

Every distinct URL with a verdict takes part, in the counts or in the calibration. The counts of all strings stay a table:
URLs are dealt out in blocks, and a block's strings are joined with it, so that no task and not the driver holds all of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batch_of, slices, texts_of
from plumbline.session import settle

#: (host, path, verdict) of the registered query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words in a host that mark a URL without a rule as an example of a rejected one.
SEEDS = ("adult", "ads", "bets", "casino", "gambl", "lottery", "pills", "poker", "porn", "track", "viagra", "xxx")
#: Bytes of context.
ORDER = 5
#: Bytes of URLs that are scored together, in expectation.
BLOCK_BYTES = 1 << 19
#: Strings of more than 3 symbols count when seen so often.
LEAST = 2
#: Every so many-th learning URL is kept out of the counts for the calibration; bins of a score's unit.
FOLDS, BINS = 5, 256
#: Scores are in nats a symbol; the calibration counts those beyond this in the last bin.
WIDEST = 16

END, START, SYMBOL_BITS = 257, 0, 9


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty for null and for a URL without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_verdict(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null without one; of equally long ones the first in order
    of text. A rule fits its host and every subdomain of it, for paths that start with its own."""
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    best = None
    for name, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1], r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        told = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, told) if best is None else best.when(fits, told)
    return best


def symbols(urls: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All URLs as one array of symbols, each with ``ORDER`` starts before and an end after it, and the number of
    symbols to be predicted (bytes and end) of each."""
    parts, sizes = [], []
    for url in urls:
        data = np.frombuffer(url or b"", np.uint8).astype(np.int64) + 1
        parts += [np.zeros(ORDER, np.int64), data, np.array([END])]
        sizes.append(len(data) + 1)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.array(sizes, np.int64)


def keys(stream: np.ndarray) -> list[np.ndarray]:
    """For each length from 1 to ORDER + 1 the string of symbols that ends at each place, as a number. Places before a
    URL's first byte are starts; what reaches back over them into the URL before is masked by callers."""
    out, key = [], np.zeros(len(stream), np.int64)
    for k in range(ORDER + 1):
        back = np.zeros(len(stream), np.int64)
        back[k:] = stream[:len(stream) - k] if k else stream
        key = key + (back << (SYMBOL_BITS * k))
        out.append(key)
    return out


def predicted(sizes: np.ndarray) -> np.ndarray:
    """Places of the symbols to be predicted in the array of all symbols."""
    ends = np.cumsum(sizes + ORDER)
    starts = ends - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def occurring(stream: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length the strings that end at a symbol to be predicted, and the places of their URLs. Up to ORDER also the
    starts before the first byte, which are contexts."""
    places, url = predicted(sizes), np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    for length, key in enumerate(keys(stream), start=1):
        if length <= ORDER:
            yield length, np.concatenate([key[places], key[places[first] - 1]]), np.concatenate([url, url[first]])
        else:
            yield length, key[places], url


def pack(counted: dict[str, np.ndarray], root: tuple[float, ...] | None = None) -> list[tuple[np.ndarray, ...]]:
    """The model as plain arrays, one entry a length of string: the strings in order, and for each class how often the
    string was seen, how often anything followed it, and how many different symbols did. Entry 0 is the empty string.

    What followed is summed from the strings, which are then all of a model. With *root*, the four numbers of the empty
    string, they may be some of them and bring those numbers along, as ``_model`` gives them."""
    out = [(np.zeros(1, np.int64), np.zeros((1, 2)), np.zeros((1, 2)), np.zeros((1, 2)))]
    if root is not None:
        out[0][2][0], out[0][3][0] = root[:2], root[2:]
    for length in range(1, ORDER + 2):
        here = np.flatnonzero(counted["length"] == length)
        here = here[np.argsort(counted["string"][here], kind="stable")]
        pair = lambda a, b: np.stack([counted[a][here], counted[b][here]], axis=1).astype(float)
        n = pair("accepted", "rejected")
        total, kinds = (np.zeros_like(n), np.zeros_like(n)) if root is None else (pair(*FOLLOWED[:2]), pair(*FOLLOWED[2:]))
        out.append((counted["string"][here], n, total, kinds))
    if root is not None:
        return out
    for length in range(1, ORDER + 2):
        string, n, _, _ = out[length]
        shorter, _, total, kinds = out[length - 1]
        context = string >> SYMBOL_BITS
        at = np.minimum(np.searchsorted(shorter, context), max(0, len(shorter) - 1))
        if len(shorter) and len(string):
            known = (shorter[at] == context) & (string > 0)  # 0: starts alone, which are never predicted
            np.add.at(total, at[known], n[known])
            np.add.at(kinds, at[known], (n > 0)[known])
    return out


def ratios(model: list[tuple[np.ndarray, ...]], urls: list[bytes | None]) -> np.ndarray:
    """Log-likelihood of each URL when accepted less that when rejected, over its number of symbols. Null counts as
    empty: its only symbol is the end."""
    stream, sizes = symbols(urls)
    if not len(sizes):
        return np.zeros(0)
    places = predicted(sizes)
    p = np.full((len(places), 2), 1.0 / END)
    context = None
    for length, key in enumerate(keys(stream), start=1):
        # The string's row at every place: as the predicted string here, as the context for the next length.
        string, n, total, kinds = model[length]
        if context is None:
            in_context = np.repeat(model[0][2], len(places), axis=0), np.repeat(model[0][3], len(places), axis=0)
        else:
            in_context = context
        seen, back = np.unique(key, return_inverse=True)
        if len(string):
            at = np.minimum(np.searchsorted(string, seen), len(string) - 1)
            known = (string[at] == seen)[:, None]
            n, total, kinds = (np.where(known, x[at], 0.0) for x in (n, total, kinds))
        else:
            n = total = kinds = np.zeros((len(seen), 2))
        weight = in_context[0] + in_context[1]
        p = np.where(weight > 0, (n[back[places]] + in_context[1] * p) / np.maximum(weight, 1e-300), p)
        before = back[places - 1]
        context = total[before], kinds[before]
    log = np.log(p[:, 0]) - np.log(p[:, 1])
    return np.add.reduceat(log, np.cumsum(sizes) - sizes) / sizes


def _strings(urls: DataFrame) -> DataFrame:
    """(length, string, accepted, rejected): how often the strings of up to ORDER + 1 symbols end at a symbol of the
    URLs (url, verdict). Strings of starts alone are contexts only and count as often as URLs begin."""
    schema = pa.schema([("length", pa.int32()), ("string", pa.int64()), ("accepted", pa.int64()), ("rejected", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5000):
            stream, sizes = symbols(texts_of(batch, "url"))
            if not len(sizes):
                continue
            allowed = np.array([x == "allow" for x in batch.column("verdict").to_pylist()])
            for length, found, url in occurring(stream, sizes):
                string, at = np.unique(found, return_inverse=True)
                n = np.bincount(at, minlength=len(string))
                good = np.bincount(at, weights=allowed[url], minlength=len(string)).astype(np.int64)
                yield batch_of(schema, [np.full(len(string), length, np.int32), string, good, n - good])

    counted = urls.mapInArrow(run, "length int, string long, accepted long, rejected long")
    return counted.groupBy("length", "string").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


#: What follows a string: how often anything did and how many different symbols, among accepted and rejected URLs.
FOLLOWED = ("follow_accepted", "follow_rejected", "kinds_accepted", "kinds_rejected")


def _model(strings: DataFrame) -> tuple[DataFrame, tuple[float, ...]]:
    """The *strings* of ``_strings`` with what followed each of them, and the same four numbers of the empty string."""
    counts = [F.sum("accepted"), F.sum("rejected"), F.count_if(F.col("accepted") > 0), F.count_if(F.col("rejected") > 0)]
    follow = [F.coalesce(n, F.lit(0)).alias(name) for n, name in zip(counts, FOLLOWED)]
    ends = strings.filter("string > 0")  # 0: starts alone, which are never predicted
    context = ends.groupBy((F.col("length") - 1).alias("length"), F.shiftright("string", SYMBOL_BITS).alias("string"))
    known = strings.join(context.agg(*follow), ["length", "string"], "left").fillna(0, list(FOLLOWED))
    return known, tuple(ends.filter("length = 1").agg(*follow).first())


def _scored(urls: DataFrame, model: DataFrame, root: tuple[float, ...], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(url, verdict, ratio) of distinct *urls*, which are dealt out in blocks by their hash. A block's distinct strings are
    joined with the model, and what is known of them comes back to the block."""
    size = urls.agg(F.coalesce(F.sum(F.octet_length("url") + 1), F.lit(0))).first()[0]
    blocks = max(urls.sparkSession.sparkContext.defaultParallelism, -(-size // block_bytes))
    dealt = urls.withColumn("block", F.pmod(F.xxhash64("url"), F.lit(blocks)).cast("int"))
    asked = pa.schema([("block", pa.int32()), ("length", pa.int32()), ("string", pa.int64())])
    scored = pa.schema([("url", pa.string()), ("verdict", pa.string()), ("ratio", pa.float64())])

    def strings(rows: pa.Table) -> pa.Table:
        found = [np.unique(x) for _, x, _ in occurring(*symbols(texts_of(rows, "url")))]
        length = np.repeat(np.arange(1, len(found) + 1, dtype=np.int32), [len(x) for x in found])
        return pa.table([np.full(len(length), rows["block"][0].as_py(), np.int32), length, np.concatenate(found)], schema=asked)

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        own = pack({c: known[c].to_numpy() for c in known.column_names}, root)
        found = [ratios(own, texts_of(part, "url")) for part in slices([rows], 5000)]
        return pa.table([rows["url"], rows["verdict"], np.concatenate([np.zeros(0), *found])], schema=scored)

    needed = dealt.groupBy("block").applyInArrow(strings, "block int, length int, string long")
    known = needed.join(model, ["length", "string"])
    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, "url string, verdict string, ratio double")


def calibrate(bins: list[tuple[str, int, int]]) -> float:
    """The threshold with the least sum of the two error rates on (verdict, bin, n): URLs at or above it are accepted.
    Of equally good ones the middle of the longest stretch; 0 if either class has no URL."""
    n = np.zeros((2, 2 * WIDEST * BINS))
    for verdict, place, count in bins:
        n[int(verdict == "block"), min(max(place + WIDEST * BINS, 0), n.shape[1] - 1)] += count
    if not n.sum(axis=1).all():
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(n, axis=1)], axis=1) / n.sum(axis=1, keepdims=True)
    loss = np.round(below[0] + 1 - below[1], 12)
    best = np.flatnonzero(loss == loss.min())
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    longest = max(runs, key=len)
    return float((longest[0] + longest[-1]) // 2 - WIDEST * BINS) / BINS


def train(urls: DataFrame) -> tuple[DataFrame, tuple[float, ...]] | None:
    """The model of ``_model`` from all distinct *urls* (url, verdict) but those of the fold that is kept for the
    calibration; rows without a verdict take no part. None without both classes."""
    usable = urls.filter("verdict IS NOT NULL")
    if {r[0] for r in usable.select("verdict").distinct().collect()} != {"allow", "block"}:
        return None
    counted = _strings(usable.filter(_fold() > 0)).filter(f"length <= 3 OR string = 0 OR accepted + rejected >= {LEAST}")
    return _model(settle(counted, "strings"))


def _fold() -> Column:
    return F.crc32(F.col("url").cast("binary")) % FOLDS


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, seeds: Sequence[str] = SEEDS, key: str = "page_id",
          url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, score): one row per row of *pages*.

    ``verdict`` is the rule's, else ``allow`` if ``score`` reaches the calibrated threshold and ``block`` if not. ``score``
    is the length-normalised difference of log-likelihoods, given for URLs with a rule too. A null URL counts as an
    empty one: its host and path are empty and no rule fits. Rows that repeat are judged each. If rules and
    seeds give no example of one class, all URLs without a rule are allowed. Other columns are not read.

    Models and threshold come from all distinct URLs; each is scored once, and the scores are joined to the rows.
    """
    host, path = host_and_path(F.col("url"))
    thin = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")).withColumns({"host": host, "path": path})
    ruled = thin.withColumn("told", rule_verdict(F.col("host"), F.col("path"), rules))
    seeded = F.lit(False)
    for word in seeds:
        seeded = seeded | F.contains("host", F.lit(word))
    learned = F.coalesce("told.verdict", F.when(seeded, F.lit("block")))
    urls = settle(ruled.groupBy(F.coalesce("url", F.lit("")).alias("url")).agg(
        F.max(F.when(F.col("url").isNotNull(), learned)).alias("verdict")), "urls")
    trained, threshold = train(urls), 0.0
    if trained is None:
        found = urls.withColumn("ratio", F.lit(0.0))
    else:
        found = settle(_scored(urls, *trained), "scores")
        held = found.filter(F.col("verdict").isNotNull() & (_fold() == 0))
        threshold = calibrate([tuple(r) for r in held.groupBy("verdict", F.floor(F.col("ratio") * BINS).cast("int")).count().collect()])
    told = ruled.select("key", F.coalesce("url", F.lit("")).alias("url"), "host", "path", F.col("told.rule").alias("rule"),
                        F.col("told.verdict").alias("told"))
    own = F.when(F.col("ratio") >= threshold, "allow").otherwise("block")
    return told.join(found.select("url", "ratio"), "url").select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("told", own).alias("verdict"), F.col("ratio").alias("score"))


def op12_url_filter(pages: DataFrame) -> DataFrame:
    return judge(pages)
