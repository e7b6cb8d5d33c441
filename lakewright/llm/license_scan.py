"""License scans by an exact set-similarity join of text blocks with license templates.

Words are numbered in one global order, the rarest in the corpus first (counted over all documents). A
template of m distinct words is held by a block when the block has at least a given percentage of them,
``need`` words. Of m words in global order the first m - need + 1 are the template's prefix; a block that
holds the template has one of them. Blocks look up their words in an index of prefixes and pass three
filters before words are counted: length (a block needs ``need`` template words), prefix (on the block's
side, too, the first shared word stands early enough) and position (what is left behind the first shared
word, on either side, can still reach ``need``).

Blocks are windows of 2 S words at every S-th word; S is the least power of two from 16 on that is no less
than the template's length, so a passage as long as a template lies whole in at least one block. Phrases
are templates of which all words are needed; their places are then looked for, word by word, in the blocks
that hold them. Templates are a checked parameter and go to every task; documents never move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.text import slices, texts_of, word_hashes, word_spans

#: Bytes in lower case, bytes outside words as spaces: words are of digits, letters and all beyond ASCII.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20
LEAST_STRIDE = 16
#: The most words of all templates together: they are broadcast.
MOST_WORDS = 1 << 16
#: The percentage of a template's words that a block must hold.
PERCENT = 80


def words_of(text: str) -> list[str]:
    """The words of a text, by the rule that documents follow."""
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass(frozen=True)
class Template:
    """``phrase``: all words are needed, and stand one behind the other."""

    label: str
    text: str
    phrase: bool = False


# Phrases that name a license, and the notices that public licenses ask for.
PHRASES = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
)
TEMPLATES = PHRASES + NOTICES


class Index:
    """Templates over words numbered in global order, with prefixes by word, for each stride."""

    def __init__(self, templates: tuple[Template, ...], percent: int, frequency: dict[str, int]):
        lists = [words_of(t.text) for t in templates]
        if not all(lists):
            raise ValueError("a template has no words")
        if sum(map(len, lists)) > MOST_WORDS:
            raise ValueError(f"templates have over {MOST_WORDS} words")
        self.templates, self.order = templates, sorted({w for x in lists for w in x}, key=lambda w: (frequency.get(w, 0), w))
        number = {w: k for k, w in enumerate(self.order)}
        self.sequence = [np.array([number[w] for w in x]) for x in lists]
        self.sets = [np.unique(x) for x in self.sequence]
        self.size = np.array([len(x) for x in self.sets])
        self.need = np.array([len(s) if t.phrase else -(-percent * len(s) // 100) for t, s in zip(templates, self.sets, strict=True)])
        self.holds = np.zeros((len(templates), len(self.order)), bool)
        for k, s in enumerate(self.sets):
            self.holds[k, s] = True
        stride = [max(LEAST_STRIDE, 1 << (len(x) - 1).bit_length()) for x in lists]
        self.levels = {s: self._prefixes([k for k, x in enumerate(stride) if x == s]) for s in sorted(set(stride))}
        data = [w.encode() for w in self.order]
        buf, at, _ = texts_of(pa.array(self.order, pa.string()))
        hashes = word_hashes(buf, at[:-1], at[1:])
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.length = np.array([len(d) for d in data])
        self.bytes = np.zeros((len(data), max(map(len, data))), np.uint8)
        for k, d in enumerate(data):
            self.bytes[k, : len(d)] = np.frombuffer(d, np.uint8)

    def _prefixes(self, members: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets by word, templates, places in them) of the prefix words of some templates."""
        rows = sorted((int(w), k, i) for k in members for i, w in enumerate(self.sets[k][: self.size[k] - self.need[k] + 1]))
        word, template, place = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        return np.searchsorted(word, np.arange(len(self.order) + 1)), template, place

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among the given words, numbers) of the words that templates have; equal byte by byte."""
        hashed = word_hashes(buf, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        place = np.flatnonzero(self.hashes[at] == hashed)
        number = self.by_hash[at[place]]
        same = (ends[place] - starts[place]) == self.length[number]
        for k in range(self.bytes.shape[1]):
            long = np.flatnonzero(same & (self.length[number] > k))
            same[long] = buf[starts[place[long]] + k] == self.bytes[number[long], k]
        return place[same], number[same]


def _blocks(words: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of each document, offsets of documents' blocks) for documents of so many words."""
    per = np.maximum(-(-words // stride) - 1, 1)
    return per, np.concatenate([[0], np.cumsum(per)])


def join_blocks(index: Index, stride: int, place: np.ndarray, number: np.ndarray, doc: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, template, shared words) of all pairs at one stride where the block holds the template.

    ``place``, ``number``, ``doc``: template words found, as word places, word numbers and documents;
    ``word_at``: the documents' word offsets.
    """
    offsets, by_template, by_place = index.levels[stride]
    per, block_at = _blocks(np.diff(word_at), stride)
    own = (place - word_at[doc]) // stride
    blocks = [np.where(ok, block_at[doc] + own - d, -1) for d, ok in ((0, own < per[doc]), (1, own > 0))]
    many = len(index.order)
    # distinct words of each block, in global order
    key = np.unique(np.concatenate([b[b >= 0] * many + number[b >= 0] for b in blocks]))
    block, word = key // many, key % many
    first = np.flatnonzero(np.diff(block, prepend=-1))
    size = np.diff(np.append(first, len(block)))
    group = np.repeat(np.arange(len(first)), size)
    j = np.arange(len(block)) - first[group]
    # meet prefixes
    hits = offsets[word + 1] - offsets[word]
    row = np.repeat(np.arange(len(word)), hits)
    entry = np.arange(len(row)) - np.repeat(np.cumsum(hits) - hits, hits) + offsets[word[row]]
    t, i, g, j = by_template[entry], by_place[entry], group[row], j[row]
    need = index.need[t]
    pass_ = (size[g] >= need) & (j <= size[g] - need)
    t, i, g, j = t[pass_], i[pass_], g[pass_], j[pass_]
    # the first shared word of each pair bounds what they can share
    _, lead = np.unique(g * len(index.templates) + t, return_index=True)
    t, i, g, j = t[lead], i[lead], g[lead], j[lead]
    could = 1 + np.minimum(index.size[t] - i - 1, size[g] - j - 1) >= index.need[t]
    t, g = t[could], g[could]
    # count
    row = np.repeat(np.arange(len(g)), size[g])
    entry = np.arange(len(row)) - np.repeat(np.cumsum(size[g]) - size[g], size[g]) + first[g[row]]
    shared = np.bincount(row, index.holds[t[row], word[entry]], len(g)).astype(np.int64)
    held = shared >= index.need[t]
    return block[first[g[held]]], t[held], shared[held]


def phrase_places(index: Index, template: int, blocks: np.ndarray, stride: int, place: np.ndarray, number: np.ndarray, doc: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """Word places where a phrase's words stand consecutively and that one of the given blocks owns: a block
    owns the places of its first half, a document's last block all of its places."""
    first, *rest = index.sequence[template]
    at = np.flatnonzero(number == first)
    for k, w in enumerate(rest, 1):
        at = at[at + k < len(number)]
        at = at[(number[at + k] == w) & (place[at + k] == place[at] + k) & (doc[at + k] == doc[at])]
    per, block_at = _blocks(np.diff(word_at), stride)
    owner = block_at[doc[at]] + np.minimum((place[at] - word_at[doc[at]]) // stride, per[doc[at]] - 1)
    return place[at[np.isin(owner, blocks)]]


def _vocabulary_words(index: Index, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word places, word numbers, documents, documents' word offsets) of template words in texts."""
    folded = FOLD[buf]
    starts, ends, word_at = word_spans(folded, at)
    place, number = index.find(folded, starts, ends) if len(starts) else (np.zeros(0, np.int64),) * 2
    return place, number, np.searchsorted(word_at, place, "right") - 1, word_at


def word_frequencies(docs: DataFrame, templates: tuple[Template, ...], *, text_col: str = "text") -> dict[str, int]:
    """In how many documents each template word stands, over all documents; not more numbers than templates have words."""
    index = Index(templates, PERCENT, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(index.order), np.int64)
        for batch in batches:
            buf, at, _ = texts_of(batch.column(0))
            for i, j in slices(at):
                _, number, doc, _ = _vocabulary_words(index, buf[at[i] : at[j]], at[i : j + 1] - at[i])
                held += np.bincount(np.unique(doc * len(held) + number) % len(held), minlength=len(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), pa.array(held)], names=["number", "held"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "number long, held long").groupBy("number").agg(F.sum("held").alias("held"))
    return {index.order[r.number]: r.held for r in counted.collect()}


SCANNED = "doc_id long, n_words long, phrases array<struct<label: string, start: long>>, blocks array<struct<label: string, template: int, start: long, words: long, containment: double>>"


def _lists(doc: np.ndarray, n: int, **fields) -> pa.Array:
    """Rows, sorted by document, as one list of structs a document."""
    rows = pa.StructArray.from_arrays([pa.array(x) if not isinstance(x, pa.Array) else x for x in fields.values()], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), rows)


def scan_licenses(docs: DataFrame, *, templates: tuple[Template, ...] = TEMPLATES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, phrases, blocks) of every whole text, a row for each row.

    ``phrases``: places of phrases, with labels, in the order of their starts (words from 0). ``blocks``:
    every block and template that is no phrase where the block holds at least ``percent`` of the
    template's distinct words, with the block's first word and length and the share that it holds. Null,
    empty and wordless texts have 0 words and empty lists; null ids stay; repeated rows are each scanned;
    an empty table gives none; other columns are not read. A text is scanned whole in one task. Two
    passes over the texts: one counts words, the other joins; only the counts are shuffled.
    """
    index = Index(templates, percent, word_frequencies(docs, templates, text_col=text_col))
    labels = np.array([t.label for t in templates], object)
    is_phrase = np.array([t.phrase for t in templates])

    def scanned(ids: pa.Array, buf: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        place, number, doc, word_at = _vocabulary_words(index, buf, at)
        n, words = len(at) - 1, np.diff(word_at)
        spots, found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], [tuple(np.zeros(0, np.int64) for _ in range(5))]
        for stride in index.levels if len(place) else ():
            block, t, shared = join_blocks(index, stride, place, number, doc, word_at)
            _, block_at = _blocks(words, stride)
            for k in np.unique(t[is_phrase[t]]).tolist():
                p = phrase_places(index, k, block[t == k], stride, place, number, doc, word_at)
                spots.append((p, np.full(len(p), k)))
            whole = ~is_phrase[t]
            b, t, shared = block[whole], t[whole], shared[whole]
            d = np.searchsorted(block_at, b, "right") - 1
            start = (b - block_at[d]) * stride
            found.append((d, t, start, np.minimum(words[d] - start, 2 * stride), shared))
        p, k = (np.concatenate(x) for x in zip(*spots, strict=True))
        by = np.lexsort((k, p))
        p, k = p[by], k[by]
        d = np.searchsorted(word_at, p, "right") - 1
        phrases = _lists(d, n, label=pa.array(labels[k], pa.string()), start=pa.array(p - word_at[d], pa.int64()))
        d, t, start, size, shared = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((t, start, d))
        d, t, start, size, shared = (x[by] for x in (d, t, start, size, shared))
        blocks = _lists(d, n, label=pa.array(labels[t], pa.string()), template=pa.array(t, pa.int32()), start=pa.array(start, pa.int64()), words=pa.array(size, pa.int64()), containment=pa.array(shared / index.size[t], pa.float64()))
        return pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64()), phrases, blocks], names=["doc_id", "n_words", "phrases", "blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at, _ = texts_of(batch.column(1))
            for i, j in slices(at):
                yield scanned(batch.column(0).slice(i, j - i), buf[at[i] : at[j]], at[i : j + 1] - at[i])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCANNED)
