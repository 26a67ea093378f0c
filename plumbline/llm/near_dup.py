"""Near-duplicates by MinHash with tensored banding.

Two small collections of half keys (``side`` each, of ``rows`` minhashes) are computed per document. The
table key (i, j) combines half key i of the first with half key j of the second: side * side tables of
2 * rows hashes cost only 2 * side * rows minhashes. Two documents of similarity s share a table with
probability (1 - (1 - s**rows)**side)**2; at the defaults and s = 0.85 that is 0.9998.

Candidates are confirmed on their full sets of shingles:

1. Documents of equal sets are one *set* from here on. Sets that share a table key, directly or through others,
   form a family.
2. In every family each set is compared with the first one (the centre), and the confirmed links are joined to
   components. One large group of copies costs one comparison a set.
3. What is left are families of several components. There, members outside the family's largest component are
   compared with all members of other components, in blocks of bounded size, so no link within a family is
   lost. Pairs within a component need no comparison and are never looked at.

Documents that share boilerplate make large families without links, in which step 3 alone would be quadratic. A family
of more than a few blocks is therefore cut by its rare shingles first: two sets that are similar enough must share one of
the first |x| - least overlap + 1 of their shingles, rarest first (the prefix filter, which loses no pair). Members then meet
by such a shingle. Documents that have as many shingles of their own meet nobody. Of both ways the one that moves less is
taken for each family.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from plumbline.llm.common import batch_of, components, mix, slices, texts_of
from plumbline.session import settle

SIDE, ROWS = 10, 3
#: Bits of the bitmaps that keep texts out of shuffles: so many a row, within these bounds; multiples of Spark's 32768.
SLOTS_A_ROW, FEWEST_SLOTS, MOST_SLOTS = 16, 2 ** 20, 2 ** 28
#: Elements of shingle sets that one block of step 3 holds about; a longer set is a block of its own.
BLOCK = 100_000
#: Sets whose table keys a task lists, and tasks for that at most.
SETS, MOST_PARTS = 8000, 20_000
#: Pairs of blocks up to which a family is not cut by shingles.
FEW_PAIRS = 8


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The set of word n-grams as sorted distinct 64-bit digests; fewer words are one shingle."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(found))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i])
    return np.unique(out)


def half_keys(found: np.ndarray, side: int, rows: int) -> np.ndarray:
    """2 * side half keys of *rows* minhashes each."""
    odd = mix(np.arange(1, 2 * side * rows + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 8192):
        part = found[start:start + 8192, None] * odd
        least = np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0))
    keys = np.zeros(2 * side, np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[r::rows])
    return keys


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signatures(docs: DataFrame, words: int, side: int, rows: int) -> DataFrame:
    """(key, row, n_shingles, digest, halves): one row per document."""
    schema = pa.schema([("key", pa.int64()), ("row", pa.binary()), ("n_shingles", pa.int64()),
                        ("digest", pa.binary()), ("halves", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            n, digests, halves = [], [], []
            for text in texts_of(batch, "_text"):
                found = shingles(text, words)
                n.append(len(found))
                digests.append(blake2b(found.tobytes(), digest_size=16).digest())
                halves.append(half_keys(found, side, rows).view(np.int64) if len(found) else [])
            yield batch_of(schema, [batch.column("key"), batch.column("row"), n, digests, halves])

    return docs.mapInArrow(run, "key long, row binary, n_shingles long, digest binary, halves array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, found) for texts (node, _text): the sorted set of every candidate."""
    schema = pa.schema([("node", pa.int64()), ("found", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            yield batch_of(schema, [batch.column("node"),
                                    [shingles(t, words).view(np.int64) for t in texts_of(batch, "_text")]])

    return texts.mapInArrow(run, "node long, found array<long>")


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """Views into the values of a list column, without a copy."""
    values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(np.asarray(column.value_lengths().fill_null(0)))
    return np.split(values, ends[:-1]) if len(ends) else []


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, left, right) whose sets are similar, as (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            left, right = _arrays(batch.column("left")), _arrays(batch.column("right"))
            good = pa.array([similar(x, y, percent) for x, y in zip(left, right)], pa.bool_())
            yield batch_of(schema, [batch.column("a"), batch.column("b")]).filter(good)

    return pairs.mapInArrow(run, "a long, b long")


def _plans(members: DataFrame) -> DataFrame:
    """(family, main, n_rest, n_main, pairs, moved) of families with several components: the largest component, the number of
    blocks of the others and of it, the pairs of blocks, and the shingles that they move."""
    sums = members.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    families = sums.groupBy("family").agg(
        F.max(F.struct("n", "component", "size")).alias("main"), F.sum("size").alias("all"), F.count("*").alias("classes"))
    rest = F.col("all") - F.col("main.size")
    counted = families.filter("classes > 1").select(
        "family", F.col("main.component").alias("main"), rest.alias("rest_size"), F.col("main.size").alias("main_size"),
        F.ceil(rest / BLOCK).cast("int").alias("n_rest"), F.ceil(F.col("main.size") / BLOCK).cast("int").alias("n_main"))
    blocks = F.col("n_rest") + F.col("n_main")
    return counted.select("family", "main", "n_rest", "n_main", (F.col("n_rest").cast("long") * blocks).alias("pairs"),
                          (F.col("rest_size") * blocks + F.col("main_size") * F.col("n_rest")).alias("moved"))


def _by_rare_shingles(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, family, component, size, whole) with a family for each old one and rare shingle: all pairs of an old family
    (``whole``) whose sets are similar enough are in a new one together."""
    held = members.join(sets, "node").select("node", F.explode("found").alias("token"))
    counts = held.groupBy("token").count().filter("count > 1")  # a shingle of one member brings nobody together
    shared = settle(held.join(counts, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("shared")))
    # The first shingles in order of (count, token); those that only this member has come before all shared ones.
    first = F.col("size") - F.expr(f"(size * {percent} + 99) DIV 100") + 1 - (F.col("size") - F.size("shared"))
    met = members.join(shared, "node").withColumn("first", first.cast("int")).filter("first > 0").select(
        "node", "component", "size", F.col("family").alias("whole"), F.explode(F.slice("shared", F.lit(1), F.col("first"))).alias("s"))
    return met.select("node", F.xxhash64("whole", "s.token").alias("family"), "component", "size", "whole")


def _meetings(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members (node, family, component, size) and plans of the families in which step 3 compares: those of few pairs of
    blocks as they are, larger ones cut by rare shingles where that moves less."""
    plans = settle(_plans(members), "plans")
    large = plans.filter(F.col("pairs") > FEW_PAIRS)
    if large.isEmpty():
        return members, plans
    cut = settle(_by_rare_shingles(members.join(large.select("family"), "family", "left_semi"), sets, percent), "cut")
    parts = settle(_plans(cut.drop("whole")), "plans")
    wholes = cut.select("family", "whole").distinct()
    moved = parts.join(wholes, "family").groupBy("whole").agg(F.sum("moved").alias("cut_moved"))
    chosen = settle(large.join(moved, F.col("family") == F.col("whole"), "left").filter(
        F.coalesce("cut_moved", F.lit(0)) < F.col("moved")).select("family"), "chosen")
    into = parts.join(wholes.join(chosen.withColumnRenamed("family", "whole"), "whole", "left_semi").select("family"), "family", "left_semi")
    kept = plans.join(chosen, "family", "left_anti")
    return members.unionByName(cut.drop("whole")), settle(kept.unionByName(into), "plans")


def _blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Deal out the members (node, family, component, size) of families with several components: rows
    (family, p, q, side, node, component, found), such that every pair of nodes of two components, of
    which at least one is outside the family's largest, meets in one block pair (p, q)."""
    members, families = _meetings(members, sets, percent)
    dealt = members.join(families.drop("pairs", "moved"), "family")
    spot = F.xxhash64("node", F.lit(17))
    own = F.pmod(spot, F.col("n_rest")).cast("int")
    # Blocks below n_rest hold the rest, those from n_rest on the largest component. A member of the
    # rest meets every block, one of the largest component the blocks of the rest only.
    rest = dealt.filter("component <> main").select(
        "family", "node", "component", own.alias("own"), F.explode(F.expr("sequence(0, n_rest + n_main - 1)")).alias("other")
    ).select("family", "node", "component", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
             F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    main = dealt.filter("component = main").select(
        "family", "node", "component", F.explode(F.expr("sequence(0, n_rest - 1)")).alias("p"),
        (F.col("n_rest") + F.pmod(spot, F.col("n_main"))).cast("int").alias("q"), F.lit(1).alias("side"))
    return rest.unionByName(main).join(sets, "node")


def _between(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components inside the blocks. Links that join what the block has joined
    already are left out, so a block gives fewer links than it has members."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["side", "node"], kind="stable").reset_index(drop=True)
        found = [np.asarray(x).view(np.uint64) for x in rows["found"]]
        size = np.array([len(x) for x in found])
        node, side = rows["node"].to_numpy(), rows["side"].to_numpy()
        label = rows["component"].to_numpy().copy()
        first = np.flatnonzero(side == 0)
        second = np.flatnonzero(side == 1)
        second = second if len(second) else first
        # An exact upper bound of common shingles from counts in 256 bins spares most comparisons.
        bins = np.stack([np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=256) for x in found])
        bins = bins.astype(np.int32)
        out = []
        for i in first:
            close = second[(label[second] != label[i]) & (100 * np.minimum(size[second], size[i])
                                                         >= percent * np.maximum(size[second], size[i]))]
            if not len(close):
                continue
            most = np.minimum(bins[close], bins[i]).sum(axis=1)
            for j in close[100 * most >= percent * (size[close] + size[i] - most)]:
                if label[i] != label[j] and similar(found[i], found[j], percent):
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
                    label[label == label[j]] = label[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return blocks.groupBy("family", "p", "q").applyInPandas(run, "a long, b long")


def row_digest(key: Column, text: Column) -> Column:
    """16 bytes that find a row by its key and text; a null differs from all values."""
    return F.unhex(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(
        F.concat(F.lit("t"), text), F.lit(""))).cast("binary")))


def _once(rows: DataFrame) -> DataFrame:
    """One row of each ``row`` digest; keeps the partitioning of a join on it."""
    order = Window.partitionBy("row").orderBy(F.lit(0))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def _slot(row: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(slots)) + 1


def _bitmap(rows: DataFrame) -> np.ndarray:
    """Which hash values the ``row`` digests have, of about SLOTS_A_ROW for each row: 32 megabytes at most. Beyond that more
    texts pass, and the join that follows drops them."""
    slots = min(MOST_SLOTS, max(FEWEST_SLOTS, 1 << (SLOTS_A_ROW * rows.count()).bit_length()))
    slot = _slot(F.col("row"), slots)
    parts = rows.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(slots, bool)
    for k, bits in parts:
        whole = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        out[(k - 1) * len(whole):k * len(whole)] = whole
    return out


def _by_bitmap(docs: DataFrame, bitmap: np.ndarray, inside: bool) -> DataFrame:
    """Rows of *docs* (with ``row``) whose slot is in the bitmap, or those whose slot is not. Rows outside are in
    no set that the bitmap was made of; for rows inside a join must tell. Keeps whole texts out of the shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value).astype(bool)
        for batch in slices(batches, 1000):
            slots = batch.column("_slot").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(bits[slots - 1] == inside))

    slotted = docs.withColumn("_slot", _slot(F.col("row"), len(bitmap)))
    return slotted.mapInArrow(run, slotted.schema).drop("_slot")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, side: int = SIDE,
                    rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, n_shingles, component, first_row): one row per row of *docs*.

    ``row`` is a digest of key and text that finds the row again. ``component`` is the smallest key of
    the linked documents, ``first_row`` the ``row`` of one document that has it. A null, empty or blank
    text has no shingles and is linked with nothing. Rows with a null key take part; they come last when
    the smallest key is chosen, so a component of such rows only has a null id. Repeated rows are equal
    sets. Other columns of *docs* are not read. An empty table gives an empty result.
    """
    thin = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_text")).withColumn(
        "row", row_digest(F.col("key"), F.col("_text")))
    signed = settle(_signatures(thin, words, side, rows), "signatures")
    full = signed.filter("n_shingles > 0")
    firsts = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("first")
    sets = settle(full.groupBy("digest").agg(firsts, F.first("halves").alias("halves"))
                  .withColumn("node", F.monotonically_increasing_id()), "sets")
    table = F.expr(f"""flatten(transform(slice(halves, 1, {side}), (x, i) ->
        transform(slice(halves, {side} + 1, {side}), (y, j) -> xxhash64(x, y, i, j))))""")
    # Every set has a row for each of the tables, so tasks start with few sets.
    parts = min(MOST_PARTS, max(1, -(-sets.count() // SETS)))
    keyed = sets.select("node", "halves").repartition(parts).select("node", F.explode(table).alias("table"))
    # A group of copies has all its keys in common: counted before the shuffle, and joined back, so that it can be split.
    centres = keyed.groupBy("table").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    members = settle(keyed.join(centres, "table").filter("node <> centre").select(
        F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "members")
    families = components(members).withColumnRenamed("component", "family")

    wanted = settle(families.join(sets.select("node", "first.row"), "node"))
    possible = _by_bitmap(thin.select("row", "_text"), _bitmap(wanted), inside=True)
    texts = _once(possible.join(wanted.select("row", "node"), "row")).select("node", "_text")
    found = settle(_sets(texts, words), "shingles")

    inside = wanted.filter("node <> family").select("node", "family")
    pairs = inside.join(found, "node").select(F.col("family").alias("a"), F.col("node").alias("b"), F.col("found").alias("right"))
    centres = inside.select(F.col("family").alias("node")).distinct().join(found, "node")
    pairs = pairs.join(settle(centres.select(F.col("node").alias("a"), F.col("found").alias("left"))), "a")
    links = settle(_confirmed(pairs, percent), "links")

    labels = components(links)
    sized = wanted.select("node", "family").join(found.select("node", F.size("found").alias("size")), "node")
    labelled = sized.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = settle(_between(_blocks(settle(labelled), found, percent), percent), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    placed = settle(sets.select("node", "digest", "first").join(labels, "node", "left").select(
        "digest", "first", F.coalesce("component", "node").alias("component")))
    least = settle(placed.groupBy("component").agg(F.min("first").alias("least")))
    named = settle(placed.join(least, "component").select("digest", "least"))
    alone = signed.filter("n_shingles = 0").select(
        "key", "row", "n_shingles", F.col("key").alias("component"), F.col("row").alias("first_row"))
    return full.select("key", "row", "n_shingles", "digest").join(named, "digest").select(
        "key", "row", "n_shingles", F.col("least.key").alias("component"),
        F.col("least.row").alias("first_row")).unionByName(alone)


def op6_near_duplicates(docs: DataFrame) -> DataFrame:
    """Three-word shingles, similarity of 85 % or more."""
    found = near_duplicates(docs, words=3, percent=85)
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
                        F.col("key").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are near-duplicates of a kept one: of each group the row with the
    smallest id stays, once. Documents without words are no duplicates, but repeated rows of them stay
    once as well."""
    found = near_duplicates(docs, words, percent)
    found = settle(found.select("row", (F.col("key").eqNullSafe(F.col("component")) & (F.col("row") == F.col("first_row")))
                                .alias("first")))
    once = found.groupBy("row").agg(F.first("first").alias("first"), F.count("*").alias("n"))
    doubtful = settle(once.filter("n > 1 OR NOT first"))  # rows that go, and rows that repeat
    bitmap = _bitmap(doubtful)
    rows = docs.select(F.struct("*").alias("doc"), row_digest(F.col("doc_id").cast("long"), F.col("text")).alias("row"))
    judged = _by_bitmap(rows, bitmap, inside=True).join(doubtful, "row", "left")
    kept = _once(judged.filter("coalesce(first, true)"))
    return _by_bitmap(rows, bitmap, inside=False).select("doc.*").unionByName(kept.select("doc.*"))
