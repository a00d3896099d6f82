"""License scans by a positional index of rare words.

Licence notices (templates) are posted under their rarest words, with the places
where each stands; rarity is the inverse document frequency over all documents.
Of every file the highest-IDF words that a template is posted under are looked
up, and postings are intersected by relative position: a place in the file minus
the place in the template that several of the words agree on is an alignment.
Around an alignment the template's mandatory key phrases must stand; the template
words that stand at its alignments are its share.  Short names of licences
("mit license") are counted wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._shared import as_bytes, chunks, cut, record, schemas, slim, table

# Phrases whose places are counted, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Label, notice, mandatory key phrases.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ("apache license", "except in compliance with the license"),
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        ("gnu general public license", "version 3"),
    ),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version.",
        ("gnu general public license", "version 2"),
    ),
    (
        "lgpl-3.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 3 of the License, or (at your option) any later version.",
        ("gnu lesser general public license", "version 3"),
    ),
    ("mit", "Released under the MIT License", ("mit license",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
        ("permission is hereby granted free of charge", "shall be included in all copies"),
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("endorse or promote products",),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
        ("with or without fee is hereby granted",),
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        ("mozilla public license",),
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software",),
    ),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related",)),
)

#: Words a template is posted under, and of them those looked up for a file.
POSTED, LOOKED_UP = 12, 4
#: Looked-up words that must agree on an alignment; places by which a key phrase may be shifted from it.
AGREE, SLACK = 2, 8
#: The score of a file that only names a licence.
NAMED = 0.5
#: Licence words that are worked on at once.
HELD = 1 << 15

#: Letters in lower case; what is no word character becomes a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_PLAIN).split()


@dataclass(frozen=True)
class Licences:
    """Templates and phrases as numbers of licence words."""

    labels: tuple[str, ...]
    texts: tuple[np.ndarray, ...]
    keys: tuple[tuple[tuple[int, np.ndarray], ...], ...]  # place in the template and words of each key phrase
    phrases: tuple[tuple[np.ndarray, str], ...]
    vocabulary: dict[bytes, int]


def licences(templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> Licences:
    vocabulary: dict[bytes, int] = {}
    numbers = lambda text: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text.encode())], np.int32)
    texts = tuple(numbers(text) for _, text, _ in templates)
    keys = []
    for (label, _, key_phrases), words in zip(templates, texts, strict=True):
        found = []
        for phrase in key_phrases:
            key = numbers(phrase)
            places = [i for i in range(len(words) - len(key) + 1) if (words[i : i + len(key)] == key).all()]
            if not places:
                raise ValueError(f"{label}: its notice does not hold the phrase {phrase!r}")
            found.append((places[0], key))
        keys.append(tuple(found))
    named = tuple((numbers(phrase), label) for phrase, label in phrases)
    return Licences(tuple(label for label, _, _ in templates), texts, tuple(keys), named, vocabulary)


@dataclass(frozen=True)
class Postings:
    """Template and place of each posting, by word; ``order`` is the word's rank, the rarest first."""

    first: np.ndarray
    template: np.ndarray
    place: np.ndarray
    order: np.ndarray


def postings(known: Licences, frequency: dict[int, int], documents: int) -> Postings:
    """Each template under its POSTED rarest words; words of no document need no posting."""
    n = len(known.vocabulary)
    idf = [log((documents + 1) / (frequency.get(w, 0) + 1)) for w in range(n)]
    order = np.argsort(np.argsort([-x for x in idf], kind="stable"), kind="stable")
    rows = []
    for t, words in enumerate(known.texts):
        rare = set(sorted((w for w in set(words.tolist()) if frequency.get(w)), key=order.__getitem__)[:POSTED])
        rows += [(w, t, i) for i, w in enumerate(words.tolist()) if w in rare]
    rows = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return Postings(np.searchsorted(rows[:, 0], np.arange(n + 1)), rows[:, 1], rows[:, 2], order)


def standing(phrase: np.ndarray, word: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where in the list of licence words the phrase begins; its words stand next to each other in one document."""
    n, k = len(word), len(phrase)
    if n < k:
        return np.zeros(0, np.int64)
    fits = (at[k - 1 :] - at[: n - k + 1] == k - 1) & (doc[k - 1 :] == doc[: n - k + 1])
    for j, w in enumerate(phrase):
        fits &= word[j : n - k + 1 + j] == w
    return np.flatnonzero(fits)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a group begins in columns that are sorted together."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def alignments(index: Postings, word: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, templates and offsets on which AGREE of the looked-up words agree; sorted."""
    n = index.first[word + 1] - index.first[word]
    hit = np.repeat(np.arange(len(word)), n)
    post = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + index.first[word[hit]]
    docs, template, order = doc[hit], index.template[post], index.order[word[hit]]
    by = np.lexsort((order, template, docs))
    docs, template, order, hit, post = docs[by], template[by], order[by], hit[by], post[by]
    group, new = _changes(docs, template), _changes(docs, template, order)
    upto = np.cumsum(new)
    rank = upto - np.repeat(upto[group], np.diff(np.append(np.flatnonzero(group), len(group))))
    looked = rank < LOOKED_UP
    docs, template, order = docs[looked], template[looked], order[looked]
    offset = at[hit[looked]] - index.place[post[looked]]
    by = np.lexsort((order, offset, template, docs))
    docs, template, offset, order = docs[by], template[by], offset[by], order[by]
    words = _changes(docs, template, offset, order)
    begin = np.flatnonzero(_changes(docs, template, offset))
    agree = np.add.reduceat(words.astype(np.int64), begin) >= AGREE if len(begin) else np.zeros(0, bool)
    begin = begin[agree]
    return docs[begin], template[begin], offset[begin]


def verified(known: Licences, template: int, offsets: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[int, int, float] | None:
    """First and last place, and share of the template's words at its alignments; None if a key phrase is missing."""
    doc = np.zeros(len(word), np.int8)
    for place, key in known.keys[template]:
        begins = at[standing(key, word, at, doc)]
        near = np.searchsorted(offsets, begins - place)
        gaps = [np.abs(offsets[np.clip(near + d, 0, len(offsets) - 1)] - (begins - place)) for d in (-1, 0)]
        if not (np.minimum(*gaps) <= SLACK).any():
            return None
    text = known.texts[template]
    spots = offsets[:, None] + np.arange(len(text))
    found = np.searchsorted(at, spots).clip(max=len(at) - 1)
    equal = (at[found] == spots) & (word[found] == text)
    return int(spots[equal].min()), int(spots[equal].max()), float(equal.any(0).mean())


def _hits(batches: Iterator[pa.RecordBatch], schema: pa.Schema, vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Number of words, and number and place of each licence word, of each text."""
    for batch in batches:
        for a, b in chunks(batch, "text"):
            counts, words, places = [], [], []
            for scalar in batch.column(1).slice(a, b - a):
                said = words_of(scalar.as_py())
                at = [i for i, w in enumerate(said) if w in vocabulary]
                counts.append(len(said))
                words.append([vocabulary[said[i]] for i in at])
                places.append(at)
            yield record(schema, [batch.column(0).slice(a, b - a), counts, words, places])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Licence words, their places and the rows they are in."""
    word, at = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
    lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
    return word, at, np.repeat(np.arange(batch.num_rows), lengths)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with at most HELD licence words together (a row with more is alone)."""
    lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
    upto, start = np.cumsum(lengths), 0
    while start < batch.num_rows:
        before = int(upto[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + HELD, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _frequencies(batches: Iterator[pa.RecordBatch], schema: pa.Schema, n: int) -> Iterator[pa.RecordBatch]:
    """Documents of each licence word, one list a task; the last number counts all documents."""
    total = np.zeros(n + 1, np.int64)
    for batch in batches:
        word, _, doc = _flat(batch)
        total[:n] += np.bincount(np.unique(doc * n + word) % n, minlength=n)
        total[n] += batch.num_rows
    some = np.flatnonzero(total)
    yield record(schema, [some, total[some]])


def _places(batch: pa.RecordBatch, known: Licences, index: Postings) -> list[list[dict]]:
    word, at, doc = _flat(batch)
    n = batch.num_rows
    found: list[list[dict]] = [[] for _ in range(n)]
    for phrase, label in known.phrases:
        for i in standing(phrase, word, at, doc).tolist():
            found[doc[i]].append({"label": label, "first": at[i], "last": at[i] + len(phrase) - 1, "share": None})
    starts = np.searchsorted(doc, np.arange(n + 1))
    docs, templates, offsets = alignments(index, word, at, doc)
    bounds = np.append(np.flatnonzero(_changes(docs, templates)), len(docs)) if len(docs) else np.zeros(1, np.int64)
    for a, b in zip(bounds, bounds[1:], strict=False):
        row, template = int(docs[a]), int(templates[a])
        here = slice(starts[row], starts[row + 1])
        if hit := verified(known, template, offsets[a:b], word[here], at[here]):
            found[row].append(dict(zip(("label", "first", "last", "share"), (known.labels[template], *hit), strict=True)))
    return found


def _scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema, known: Licences, index: Postings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch):
            yield record(schema, [part.column(0), part.column(1), _places(part, known, index)])


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """``key``, ``n_words`` and ``places`` of each row: label, first and last word, share.

    A place with a null share is a phrase, each where it stands; one with a share
    is a template at all its alignments, its first to its last word there, and the
    part of its words found.  A null text is empty; a null key is kept; repeated
    rows are documents each, in the document frequencies too; texts of any length
    are read whole; no rows give no rows; other columns are ignored.  What the
    driver gets is one number for each licence word.
    """
    known = licences(templates, phrases)
    source = docs.select(F.col(f"`{key}`").alias("key"), as_bytes(f"`{text}`").alias("text"))
    schema, arrow = schemas(source.schema.fields[:1], "n_words long, word array<int>, at array<int>")
    hits = cut(source.mapInArrow(slim(lambda it: _hits(it, arrow, known.vocabulary)), schema), "licence-words")
    n = len(known.vocabulary)
    counted, counted_arrow = schemas([], "word long, n long")
    frequency = dict(hits.mapInArrow(lambda it: _frequencies(it, counted_arrow, n), counted).groupBy("word").agg(F.sum("n")).collect())
    index = postings(known, frequency, frequency.pop(n, 0))
    out, out_arrow = schemas([hits.schema.fields[0], hits.schema.fields[1]], "places array<struct<label: string, first: bigint, last: bigint, share: double>>")
    return hits.mapInArrow(slim(lambda it: _scan(it, out_arrow, known, index)), out).withColumnRenamed("key", key)


def license_labels(places: DataFrame) -> DataFrame:
    """Counts, labels and a score from the places of :func:`scan_licenses`.

    ``score`` is the largest share of a template, NAMED at least where a phrase stands, else 0.
    """
    base = F.filter("places", lambda p: p["share"].isNull())
    labels = lambda some: F.array_join(F.array_sort(F.array_distinct(some["label"])), ",")
    named = F.when(F.size(base) > 0, NAMED).otherwise(0.0)
    columns = [c for c in places.columns if c != "places"]
    return places.select(
        *[F.col(f"`{c}`") for c in columns],
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["first"]).alias("first_word"),
        F.array_max(base["first"]).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.greatest(named, F.coalesce(F.array_max(F.col("places")["share"]), F.lit(0.0))).alias("score"),
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(scan_licenses(table(spark, sf_dir, "documents")))


QUERIES = {"op13_license_scan": op13_license_scan}
ORACLE: dict[str, str] = {}
