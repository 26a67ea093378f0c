"""Near and truncated copies of test items."""

import random

from plumbline.llm import decontaminate


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def test_changed_and_missing_last_sentences_are_found(spark):
    rng = random.Random(29)
    parts = [(words(rng, 20), words(rng, 3)), (words(rng, 20), words(rng, 5)), (words(rng, 14), words(rng, 13)), (words(rng, 16), words(rng, 6))]
    items = [(i, " ".join(q) + ". " + " ".join(a) + ".") for i, (q, a) in enumerate(parts)]
    body = lambda: " ".join(words(rng, 60))
    copies = []
    for q, a in parts:
        middle = len(a) // 2
        copies.append(" ".join(q) + ". " + " ".join(a[:middle] + ["other"] + a[middle + 1:]) + ".")
        copies.append(" ".join(q) + ".")
    texts = [f"{body()} {c} {body()}" for c in copies]
    texts += [body(), f"{body()} {' '.join(parts[0][0][:6])} {body()} {' '.join(parts[3][1])}",
              f"{body()} {' '.join(rng.sample(parts[1][0] + parts[1][1], 25))} {body()}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.key, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(i, i // 2) for i in range(8)}
    assert {r.doc_id for r in decontaminate.keep_uncontaminated(docs, bench).collect()} == {8, 9, 10}


def test_half_of_a_short_item_is_no_copy(spark):
    docs = spark.createDataFrame([(0, "x y alpha beta z"), (1, "x alpha beta gamma delta z")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "alpha beta gamma delta")], "item_id long, text string")
    assert [r.key for r in decontaminate.contaminated(docs, bench).collect()] == [1]
