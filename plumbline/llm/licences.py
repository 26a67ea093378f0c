"""Licence detection with a positional index of rare words.

Licence notices are templates. Their words weigh by rarity (inverse document frequency over all documents, never
below a floor, so that a notice that many documents have keeps its weight). A template's rarest words are entries
of the index: as many as it takes for the others to hold less than ``COVERED`` of the weight, so every place that
reaches it has an entry. An entry found in a file proposes relative positions of its templates; these are verified:
the template's key phrases must stand where the position says, and all its words are weighed there.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD_BYTES, batch_of, slices, texts_of

FIND_WORDS = re.compile(WORD_BYTES)
#: Least rarity of a word, as a share of that of a word in no document.
LEAST = 0.25
#: Share of a template's rarity that must be found at one relative position.
COVERED = 0.5
#: Words by which a part of a template may be displaced.
SLACK = 2


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


#: Phrases that a label is given for wherever their words stand consecutively. Fixed values.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Wording of well-known public licence notices. Fixed values.
TEMPLATES = (
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files (the Software), to deal in the Software without restriction",
             ("permission is hereby granted", "without restriction")),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License "
             "is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", ("as is basis", "conditions of any kind")),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", ("general public license",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "General Public License as published by the Free Software Foundation", ("free software", "general public license")),
    Template("lgpl", "GNU Lesser General Public License", ("lesser general public license",)),
    Template("agpl", "GNU Affero General Public License", ("affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
             "that the following conditions are met", ("redistribution and use", "source and binary forms")),
    Template("bsd", "Licensed under the BSD 3 Clause License", ("bsd 3 clause",)),
    Template("bsd", "Licensed under the BSD 2 Clause License", ("bsd 2 clause",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted", ("permission to use copy modify", "hereby granted")),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
             ("mozilla public license",)),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
             ("creative commons attribution 4",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
             "to this work. CC0 1.0 Universal", ("waived all copyright",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
    Template("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited",
             ("strictly prohibited",)),
)


def words_of(text: bytes | str) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text
    return FIND_WORDS.findall(data.lower())


class Index:
    """Templates by their rare words. *seen*: documents that have a word, of *n* documents."""

    def __init__(self, seen: dict[bytes, int], n: int, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        self.words = [words_of(t.text) for t in templates]
        most = math.log((n + 1) / 0.5)
        self.rarity = {w: max(LEAST * most, math.log((n + 1) / (seen.get(w, 0) + 0.5))) for ws in self.words for w in ws}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.total = []
        for t, ws in enumerate(self.words):
            self.total.append(sum(self.rarity[w] for w in ws))
            left = self.total[t]
            for word in sorted(set(ws), key=lambda w: (-self.rarity[w], w)):
                if left < COVERED * self.total[t] * (1 - 1e-9):
                    break
                places = [p for p, w in enumerate(ws) if w == word]
                left -= self.rarity[word] * len(places)
                self.postings.setdefault(word, []).extend((t, p) for p in places)
        self.keys = []  # per template: (position, words) of each key phrase
        for t, template in enumerate(templates):
            found = []
            for phrase in template.keys:
                key = words_of(phrase)
                at = next((i for i in range(len(self.words[t])) if self.words[t][i:i + len(key)] == key), None)
                if at is None:
                    raise ValueError(f"key phrase not in its template: {phrase}")
                found.append((at, key))
            self.keys.append(found)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, place of its first word, share of its rarity found), best place first per template.
        Places of one template that lie within SLACK of a better one are the same finding."""
        present = self.postings.keys() & set(words)
        if not present:
            return []
        places = {(t, i - p + shift) for i, word in enumerate(words) if word in present
                  for t, p in self.postings[word] for shift in range(-SLACK, SLACK + 1)}
        found = []
        for t, place in places:
            if not self._verified(words, t, place):
                continue
            share = sum(self.rarity[w] for p, w in enumerate(self.words[t])
                        if w in words[max(0, place + p - SLACK):max(0, place + p + SLACK + 1)]) / self.total[t]
            if share >= COVERED:
                exact = sum(1 for p, w in enumerate(self.words[t]) if 0 <= place + p < len(words) and words[place + p] == w)
                found.append((t, place, share, exact))
        found.sort(key=lambda x: (x[0], -x[2], -x[3], x[1]))
        out: list[tuple[int, int, float]] = []
        taken: dict[int, set[int]] = {}
        for t, place, share, _ in found:
            near = taken.setdefault(t, set())
            if not any(x in near for x in range(place - 2 * SLACK, place + 2 * SLACK + 1)):
                near.add(place)
                out.append((t, place, share))
        return out

    def _verified(self, words: list[bytes], t: int, place: int) -> bool:
        return all(any(words[max(0, place + at + s):max(0, place + at + s) + len(key)] == key
                       for s in range(-SLACK, SLACK + 1)) for at, key in self.keys[t])


def _seen(docs: DataFrame, templates: tuple[Template, ...]) -> tuple[dict[bytes, int], int]:
    """Numbers of documents that have each word of the templates, over all documents."""
    wanted = {w for t in templates for w in words_of(t.text)}
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in slices(batches, 500):
            for text in texts_of(batch, "_text"):
                counts[b""] += 1  # documents
                counts.update(wanted.intersection(words_of(text or b"")))
        yield batch_of(schema, [list(counts), list(counts.values())])

    rows = docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n")).collect()  # as many as `wanted`
    seen = {bytes(word): n for word, n in rows}
    return seen, seen.pop(b"", 0)


def scan_licences(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """(key, n_words, places, matches): one row per row of *docs*.

    ``places`` are structs (label, start, n) of the BASE phrases by start, ``matches`` structs (label, start,
    end, score) of verified templates, in words from 0. A null or empty text has no words and no findings.
    Other columns of *docs* are not read.
    """
    thin = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_text"))
    index = Index(*_seen(thin, templates), templates)
    base = [(words_of(phrase), label) for phrase, label in BASE]
    lasts = {key[-1] for key, _ in base}
    place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("n", pa.int64())])
    match = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(place)), ("matches", pa.list_(match))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            n, places, matches = [], [], []
            for text in texts_of(batch, "_text"):
                words = words_of(text or b"")
                n.append(len(words))
                found = []
                if not lasts.isdisjoint(words):
                    for i, word in enumerate(words):
                        if word in lasts:
                            for phrase, label in base:
                                start = i + 1 - len(phrase)
                                if start >= 0 and words[start:i + 1] == phrase:
                                    found.append({"label": label, "start": start, "n": len(phrase)})
                places.append(sorted(found, key=lambda x: (x["start"], x["label"])))
                matches.append([{"label": index.templates[t].label, "start": max(at, 0),
                                 "end": min(at + len(index.words[t]), len(words)), "score": share}
                                for t, at, share in index.matches(words)])
            yield batch_of(schema, [batch.column("key"), n, places, matches])

    return thin.mapInArrow(run, "key long, n_words long, places array<struct<label:string,start:long,n:long>>, "
                                "matches array<struct<label:string,start:long,end:long,score:double>>")


def op1_licences(docs: DataFrame) -> DataFrame:
    """``score`` is the best match's share of rarity; a base phrase alone counts as COVERED."""
    found = scan_licences(docs)
    joined = "array_join(array_sort(array_distinct({})), ',')"
    return found.select(
        F.col("key").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
        F.expr("array_min(transform(places, p -> p.start))").alias("first_word"),
        F.expr("array_max(transform(places, p -> p.start))").alias("last_word"),
        F.expr(joined.format("transform(places, p -> p.label)")).alias("base_labels"),
        F.expr(joined.format("concat(transform(places, p -> p.label), transform(matches, m -> m.label))")).alias("labels"),
        F.expr(f"""least(1.0D, greatest(coalesce(array_max(transform(matches, m -> m.score)), 0.0D),
                   IF(size(places) > 0, {COVERED}D, 0.0D)))""").alias("score"))
