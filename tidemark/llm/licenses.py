"""License scans by a positional rare-token index.

Each phrase of the base and each template's mandatory key phrase is posted under its rarest word, by
inverse document frequency over all documents, with that word's position; phrases are verified around
this word and found at every place. Each template is posted under its rarest words too, with their
positions: as many as together weigh more than what an accepted alignment may lack, so each such
alignment has one of them in its place, whatever else the text holds. A text's occurrences of these
words give the starts at which a template may stand; a start counts if the key phrase is inside and
the template's words at their relative positions cover enough of its weight.

Edge cases: a null or empty text has no word and no label, score 0; texts are read whole; repeated
rows are scanned each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, slices

# The phrases of the base.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices of widespread licences, each with its label and mandatory key phrase.
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "bsd license", "released under the bsd license"),
    ("gpl-2", "general public license version 2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3", "general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "lesser general public license", "licensed under the gnu lesser general public license"),
    ("agpl", "affero general public license", "licensed under the gnu affero general public license"),
    ("mpl-2", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by", "creative commons attribution", "licensed under the creative commons attribution 4 0 international license"),
    ("cc0", "cc0", "dedicated to the public domain under cc0 1 0"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "merge publish distribute sublicense", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "this permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "used to endorse or promote products derived from this software", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2", "you may not use this file except in compliance with the license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl", "gnu affero general public license as published by the free software foundation", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2", "mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("zlib", "in no event will the authors be held liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1", "boost software license", "distributed under the boost software license version 1 0"),
    ("epl-2", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc0", "dedicated the work to the public domain", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("unlicense", "either in source code form or as a compiled binary", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]
#: Share of a template's weight that an alignment must cover.
COVERED = 0.6

_table = bytes((b | 0x20 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """ASCII digits and letters, A-Z as a-z, and everything beyond ASCII make words."""
    return (text or b"").translate(_table).split()


class Index:
    """Positional postings of key and base phrases, with document frequencies."""

    def __init__(self, templates: list[tuple[str, str, str]], base: dict[str, str], frequency: dict[bytes, int], documents: int) -> None:
        self.templates = [(label, phrase.encode().split(), text.encode().split()) for label, phrase, text in templates]
        self.base = [(phrase.encode().split(), label) for phrase, label in base.items()]
        vocabulary = {w for _, phrase, text in self.templates for w in phrase + text} | {w for phrase, _ in self.base for w in phrase}
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 0.5)) + 1e-3 for w in vocabulary}
        rarest = lambda phrase: max(range(len(phrase)), key=lambda i: (self.idf[phrase[i]], -i))
        self.postings: dict[bytes, list[tuple[tuple[bytes, ...], int]]] = {}
        for phrase in dict.fromkeys(tuple(p) for p in (*(p for p, _ in self.base), *(p for _, p, _ in self.templates))):
            self.postings.setdefault(phrase[rarest(phrase)], []).append((phrase, rarest(phrase)))
        self.weights = [sum(self.idf[w] for w in text) for _, _, text in self.templates]
        #: word -> (template, position), the rarest words of each template
        self.rare: dict[bytes, list[tuple[int, int]]] = {}
        for number, ((_, _, text), weight) in enumerate(zip(self.templates, self.weights, strict=True)):
            spare = (1 - COVERED) * weight
            for position in sorted(range(len(text)), key=lambda i: (-self.idf[text[i]], i)):
                self.rare.setdefault(text[position], []).append((number, position))
                spare -= self.idf[text[position]]
                if spare < -1e-9 * weight:
                    break

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[str, int, float]]]:
        """(start, label) of every base phrase; (label, start, covered share) of every accepted alignment."""
        present = self.postings.keys() & set(words)
        if not present:
            return [], []
        spots: dict[tuple[bytes, ...], list[int]] = {}
        for at, w in enumerate(words):
            if w in present:
                for phrase, i in self.postings[w]:
                    if at >= i and tuple(words[at - i : at - i + len(phrase)]) == phrase:
                        spots.setdefault(phrase, []).append(at - i)
        found = [(at, label) for phrase, label in self.base for at in spots.get(tuple(phrase), ())]
        held = {number for number, (_, phrase, _) in enumerate(self.templates) if tuple(phrase) in spots}
        starts: set[tuple[int, int]] = set()
        if held:
            rare = self.rare.keys() & set(words)
            starts = {(number, at - position) for at, w in enumerate(words) if w in rare for number, position in self.rare[w] if number in held}
        accepted = []
        for number, start in starts:
            label, phrase, text = self.templates[number]
            places = spots[tuple(phrase)]
            i = bisect_left(places, max(0, start))
            if i < len(places) and places[i] + len(phrase) <= start + len(text):
                covered = sum(self.idf[w] for p, w in enumerate(text) if 0 <= start + p < len(words) and words[start + p] == w) / self.weights[number]
                if covered >= COVERED:
                    accepted.append((label, max(0, start), covered))
        return sorted(found), sorted(accepted)


def frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many of all documents each licence word stands, and the number of documents."""
    ordered = sorted(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, wanted, n = Counter(), frozenset(ordered), 0
        for batch in batches:
            for part in slices(batch):
                n += part.num_rows
                for text in part.column(0).to_pylist():
                    counts.update(wanted.intersection(words_of(text)))
        yield pa.RecordBatch.from_pydict({"w": pa.array([b"", *counts], pa.binary()), "n": pa.array([n, *counts.values()], pa.int64())})

    counted = docs.select(F.col("text").cast("binary")).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    rows = {bytes(w): n for w, n in counted.collect()}  # a row for each word of the templates
    return rows, rows.pop(b"", 0)


def scan(docs: DataFrame, *, templates: list[tuple[str, str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """doc_id, n_words, base places [(start, label)], alignments [(label, start, covered)] of every whole text."""
    bare = Index(templates, base, {}, 0)
    sent = docs.sparkSession.sparkContext.broadcast(Index(templates, base, *frequencies(docs, set(bare.idf))))

    def start() -> Callable:
        index = sent.value

        def each(doc_id: int, text: bytes | None) -> tuple:
            words = words_of(text)
            places, alignments = index.scan(words)
            return doc_id, len(words), [{"start": s, "label": x} for s, x in places], [{"label": x, "start": s, "covered": c} for x, s, c in alignments]

        return lambda ids, texts: [each(*row) for row in zip(ids, texts, strict=True)]

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_rows(rows, "doc_id long, n_words long, places array<struct<start: long, label: string>>, alignments array<struct<label: string, start: long, covered: double>>", start, "doc_id", "text")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, labels and score of each document from its places and alignments."""
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    base, own = F.col("places.label"), F.col("alignments.label")
    best = F.when(F.size("alignments") > 0, F.least(F.array_max("alignments.covered"), F.lit(1.0))).otherwise(0.0)
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )
