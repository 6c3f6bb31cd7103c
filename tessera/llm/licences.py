"""License scans (op 10): a positional rare-token index over licence templates.

Words are runs of ASCII letters and digits and of all other characters, ASCII letters lower-cased. Every template is
indexed by its rarest words, rarity being measured by the number of documents of the whole corpus that hold a word
(one pass that counts template words only). In a document, each place of an indexed word proposes a template at an
offset (place in the document minus place in the template); offsets that enough rare words agree on, give or take
``SLACK`` words, are hits, scored by the share of the template's words that stand at that offset. A hit counts when
the score reaches ``MIN_SCORE`` and all of the template's key phrases stand where it was hit. Templates are few and
given, so the index is bounded and is shipped with the function; the corpus counts are one row per template word. Of
templates of one wording (a text and its longer sibling) each that reaches the score gives its label.

The base labels are those of documents where a base phrase stands word for word.

Defined results: null text is empty; no words give counts 0, null places, empty labels and score 0; repeated rows each
give a row; extra columns are ignored; an empty table gives an empty result. Whole texts are read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import licence_texts as texts

#: Fixed phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Label, key phrases and text: short notices, then whole licences and standard notices.
TEMPLATES = (
    ("mit", ("permission is hereby granted free of charge",), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", ("mit license",), "released under the mit license"),
    ("isc", ("permission to use copy modify",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2", ("apache license", "version 2"), "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", ("redistribution and use in source and binary forms",), "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice"),
    ("gpl-3", ("gnu general public license version 3",), "licensed under the gnu general public license version 3"),
    ("gpl", ("gnu general public license",), "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", ("gnu lesser general public license",), "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", ("mozilla public license",), "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by-nc", ("cc by nc",), "licensed under cc by nc 4 0"),
    ("cc-by", ("creative commons attribution",), "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", ("released into the public domain",), "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("mit", ("permission is hereby granted free of charge", "provided as is"), texts.MIT),
    ("isc", ("permission to use copy modify", "provided as is"), texts.ISC),
    ("bsd-2", ("with the distribution this software is provided", "contributors as is"), texts.BSD_2),
    ("bsd-3", ("neither the name of", "contributors as is"), texts.BSD_3),
    ("zlib", ("must not be misrepresented", "altered source versions"), texts.ZLIB),
    ("boost", ("machine executable object code",), texts.BOOST),
    ("unlicense", ("released into the public domain", "relinquishment in perpetuity"), texts.UNLICENSE),
    ("apache-2", ("apache license", "version 2"), texts.APACHE_2_NOTICE),
    ("gpl-2", ("gnu general public license", "either version 2"), texts.GPL_2_NOTICE),
    ("gpl-3", ("gnu general public license", "either version 3"), texts.GPL_3_NOTICE),
    ("agpl-3", ("gnu affero general public license", "either version 3"), texts.AGPL_3_NOTICE),
)

MIN_SCORE = 0.6
RARE_WORDS = 8
MIN_RARE_HITS = 0.5
SLACK = 3

_WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
OUT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").encode().lower().decode())  # bytes.lower() touches A-Z only


@dataclass(frozen=True)
class Template:
    """A licence text in words, and its key phrases, each between blanks."""

    label: str
    keys: tuple[str, ...]
    words: tuple[str, ...]


def prepared(templates: Iterable[tuple[str, tuple[str, ...], str]]) -> list[Template]:
    between = lambda t: f" {' '.join(words_of(t))} "
    return [Template(label, tuple(map(between, keys)), tuple(words_of(t))) for label, keys, t in templates]


def corpus_counts(docs: DataFrame, templates: list[Template], text: str = "text") -> DataFrame:
    """(word, df) of the template words over all documents, summed within each task before the shuffle."""
    vocabulary = {w for t in templates for w in t.words}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: dict[str, int] = defaultdict(int)
        n = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n += 1
                for w in vocabulary.intersection(words_of(t)):
                    df[w] += 1
        names = ["", *df]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([n, *df.values()], pa.int64())], ["word", "df"])

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))


def rare_index(df: dict[str, int], templates: list[Template]) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, place), for the RARE_WORDS words of highest IDF of each template."""
    n = df.get("", 0)
    idf = lambda w: math.log(1 + (n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5))
    index: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for k, t in enumerate(templates):
        rare = set(sorted(set(t.words), key=lambda w: (-idf(w), w))[:RARE_WORDS])
        for p, w in enumerate(t.words):
            if w in rare:
                index[w].append((k, p))
    return dict(index)


def _base_places(words: list[str]) -> tuple[list[int], set[str]]:
    places, labels = [], set()
    text = f" {' '.join(words)} "
    for phrase, label in BASE.items():
        before, word = 0, 0  # blanks are counted on from the place before, so the time is that of one pass
        at = text.find(f" {phrase} ")
        while at >= 0:
            word += text.count(" ", before, at)
            before = at
            places.append(word)
            labels.add(label)
            at = text.find(f" {phrase} ", at + 1)
    return places, labels


def _template_hits(words: list[str], index: dict[str, list[tuple[int, int]]], rare: list[int], templates: list[Template]) -> tuple[set[str], float]:
    votes: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        if w in index:
            for k, p in index[w]:
                votes[k].append(i - p)
    labels, best = set(), 0.0
    for k, offsets in votes.items():
        need = MIN_RARE_HITS * rare[k]
        if len(offsets) < need:
            continue
        t = templates[k]
        offsets.sort()
        lo, tried = 0, set()
        for hi in range(len(offsets)):
            while offsets[hi] - offsets[lo] > SLACK:
                lo += 1
            o = offsets[lo]
            if hi - lo + 1 < need or o in tried:
                continue
            tried.add(o)
            span = words[max(0, o) : o + len(t.words) + SLACK]
            shift = min(o, 0)
            score = sum(w in span[max(0, p + shift) : max(0, p + shift + SLACK + 1)] for p, w in enumerate(t.words)) / len(t.words)
            if score >= MIN_SCORE:
                there = f" {' '.join(span)} "
                if all(key in there for key in t.keys):
                    labels.add(t.label)
                    best = max(best, score)
    return labels, best


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: Iterable[tuple[str, tuple[str, ...], str]] = TEMPLATES) -> DataFrame:
    """One row per document, with base places, labels and the best score; ``templates`` may be any licence texts."""
    known = prepared(templates)
    counts = {r["word"]: r["df"] for r in corpus_counts(docs, known, text).collect()}  # a row per template word: bounded
    index = rare_index(counts, known)
    rare = [0] * len(known)
    for places in index.values():
        for k, _ in places:
            rare[k] += 1

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(t)
                places, base = _base_places(words) if words else ([], set())
                more, score = _template_hits(words, index, rare, known)
                rows.append((d, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else score))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _TYPES, strict=True)], _NAMES)

    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).cast("string").alias("t")).mapInArrow(label, OUT)


_TYPES = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]
_NAMES = [x.split()[0] for x in OUT.split(", ")]
