"""License scan: an exact set-similarity join of templates against all text blocks.

A template is a notice with a label, and words that it can't do without (those that tell it from similar notices). Templates are put into classes by length (powers of
two). For a class of up to n words, the words of each whole text, across line ends, are cut into blocks of 2 n words that overlap by half: any
stretch of n words stands whole in a block. A block matches a template when it holds at least
the share ``threshold`` of the template's distinct words: the join tells all such pairs of block and template. The words of all templates are ordered globally by the
number of documents that hold them, rarest first. The filters lose no match:

* prefix: with n words of which ceil(threshold * n) must be shared, one of the first n - ceil(...) + 1 must be;
* length: a block with fewer distinct words than must be shared is out;
* position: when the first shared prefix word stands at place i of the template, n - i words can be shared at most.

What passes is verified word by word. Labels are decided after the join: a match gives its template's label if the block holds the words that the template can't do without, and, as a short template's words may meet
by chance, if of a template of SHORT words at most as many as must be shared stand in its order. Besides, phrases are searched as they stand (places where all words of a
phrase stand consecutively); they give the base labels, to which those of the templates are added.

Words are the runs of ASCII letters and digits and of bytes above 0x7F, A-Z lowered. Null and empty texts
have no words and no labels; ties between templates keep all labels; repeated rows are scanned each for itself;
an empty table gives no rows; columns beside the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.base import bound_batches
from weft.llm.hashing import FOLD

THRESHOLD = 0.8
#: Words up to which a template's order counts.
SHORT = 16
#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Public license notices, their labels, and the words that they can't do without.
TEMPLATES = (
    ("mit", "Released under the MIT License", "mit license"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "permission sublicense",
    ),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission person obtaining associated"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "permission fee"),
    ("apache", "Licensed under the Apache License, Version 2.0", "apache"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", "applicable"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "gnu general public"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu general public"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License", "gnu lesser"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "gnu lesser"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "gnu affero"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary forms"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", "eclipse"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "warranty liable"),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "permission organization accompanying"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
)


def tokens(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def frequencies(docs: DataFrame, text: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """The number of documents that hold each word of the vocabulary, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = dict.fromkeys(sorted(vocabulary), 0)
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    for w in vocabulary.intersection(memoryview(x.as_buffer()).tobytes().translate(FOLD).split()):
                        count[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["w", "n"])

    found = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()  # the templates' words only
    return dict.fromkeys(vocabulary, 0) | {bytes(r.w): r.n for r in found}


class Index:
    """The templates' words in global order, and the inverted index of their prefixes."""

    def __init__(self, templates: tuple[tuple[str, str, str], ...], frequency: dict[bytes, int], threshold: float):
        self.sets, self.labels, self.must, self.need, self.size, self.words, self.prefix = [], [], [], [], [], [], {}
        for i, (label, text, must) in enumerate(templates):
            words = tokens(text.encode())
            ordered = sorted(set(words), key=lambda w: (frequency[w], w))
            need = ceil(threshold * len(ordered) - 1e-9)
            self.sets.append(frozenset(ordered))
            self.labels.append(label)
            self.must.append(frozenset(tokens(must.encode())))
            self.need.append(need)
            self.size.append(1 << (len(words) - 1).bit_length())
            self.words.append(words)
            for at, w in enumerate(ordered[: len(ordered) - need + 1]):
                self.prefix.setdefault(w, []).append((i, len(ordered) - at))
        self.first = frozenset(self.prefix)

    def possible(self, held: frozenset[bytes] | set[bytes]) -> dict[int, set[int]]:
        """By class, the templates that a text of these words may match."""
        out: dict[int, set[int]] = {}
        for i in {i for w in self.first & held for i, _ in self.prefix[w]}:
            if len(self.sets[i] & held) >= self.need[i]:
                out.setdefault(self.size[i], set()).add(i)
        return out

    def match(self, block: frozenset[bytes], of: set[int] | None = None) -> dict[int, float]:
        """Containment of each template (of those given) that the block matches."""
        out: dict[int, float] = {}
        at_most: dict[int, int] = {}
        for w in self.first & block:
            for i, rest in self.prefix[w]:
                if of is None or i in of:
                    at_most[i] = max(rest, at_most.get(i, 0))
        for i, most in at_most.items():
            if len(block) >= self.need[i] and most >= self.need[i] and (shared := len(self.sets[i] & block)) >= self.need[i]:
                out[i] = shared / len(self.sets[i])
        return out


    def decides(self, i: int, block: list[bytes]) -> bool:
        """Whether a block that matches template i has its label."""
        if not self.must[i].issubset(block):
            return False
        if len(self.words[i]) > SHORT:
            return True
        best = [0] * (len(self.words[i]) + 1)  # the most words in common order, by how much of the template is looked at
        for w in block:
            before = 0
            for at, x in enumerate(self.words[i], 1):
                before, best[at] = best[at], before + 1 if x == w else max(best[at], best[at - 1])
        return best[-1] >= self.need[i]


def cut(own: list[bytes], size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Blocks of 2 * size words that overlap by half, with the place of their first word."""
    for i in range(0, max(1, len(own) - size), size):
        yield i, own[i : i + 2 * size]


def places(own: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand consecutively."""
    out, at, n = [], -1, len(phrase)
    try:
        while True:
            at = own.index(phrase[0], at + 1)
            if own[at : at + n] == phrase:
                out.append(at)
    except ValueError:
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best containment of a match that gives its label, 1 for a phrase), templates (the places in
    ``templates`` of those) and matches (template, the first word of the block, and share of each pair of the join)."""
    docs = bound_batches(docs)
    frequency = frequencies(docs, text, {w for _, t, _ in templates for w in tokens(t.encode())})
    index = Index(templates, frequency, threshold)
    searched = [(tokens(p.encode()), label) for p, label in phrases]
    rare = {min(p, key=lambda w: (frequency.get(w, 0) == 0, frequency.get(w, 0), w)) for p, _ in searched}
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for x in batch.column("__text"):
                raw = memoryview(x.as_buffer()).tobytes() if x.is_valid else b""
                own = tokens(raw)
                held = set(own)
                base, starts, hits, pairs = set(), [], {}, []
                if held & rare:
                    for phrase, label in searched:
                        if found := places(own, phrase):
                            base.add(label)
                            starts += found
                for size, of in index.possible(held).items():
                    for place, block in cut(own, size):
                        for i, share in index.match(frozenset(block), of).items():
                            pairs.append({"template": i, "block": place, "share": share})
                            if index.decides(i, block):
                                hits[i] = max(share, hits.get(i, 0.0))
                for column, value in zip(out, (len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {index.labels[i] for i in hits})), 1.0 if base else max(hits.values(), default=0.0), sorted(hits), pairs), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.int32()), pa.list_(pa.struct([("template", pa.int32()), ("block", pa.int64()), ("share", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(id_col)] + [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates", "matches"])

    return docs.select(id_col, F.col(text).cast("binary").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, templates array<int>, matches array<struct<template:int,block:bigint,share:double>>")
