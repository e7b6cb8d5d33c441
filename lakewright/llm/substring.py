"""Exact removal of repeated word windows by difference-cover anchors.

A difference cover D of period v has, for any two positions, a shift below v that brings both into D.
So two equal windows of L words share an anchor: L - v + 1 words that begin, in both documents, at
positions of D modulo v and at the same shift. Only anchors are hashed and exchanged at first; those that
several documents hold extend to the windows around them, and only those windows' hashes are
exchanged in full, with the least document that holds each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.exchange import CHUNKS, answer, chunks_of, join_blobs, meet, pack_array, packed_rows, range_count, ranges, send, split_blobs, stage, unpack_array
from lakewright.llm.session import cut, release
from lakewright.llm.text import ngram_hashes, ngram_starts, texts_of, word_hashes, word_spans

#: Perfect difference sets: every residue is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
#: Bits of an anchor's key; a chance collision only makes more windows candidates.
ANCHOR_BITS = 40


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period of at most two thirds of the window, and its cover."""
    period = max(v for v in COVERS if v == 1 or 3 * v <= 2 * window)
    return period, COVERS[period]


class Words:
    """Words of a chunk: byte spans, offsets by document, hashes."""

    def __init__(self, docs: pa.RecordBatch, text_at: int):
        self.buf, offsets, _ = texts_of(docs.column(text_at))
        self.starts, self.ends, self.at = word_spans(self.buf, offsets)
        self.hashes = word_hashes(self.buf, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word positions of anchors, their keys) in documents of at least a window."""
    period, cover = cover_for(window)
    n = window - period + 1
    starts, _ = ngram_starts(words.at, n)
    long = np.diff(words.at) >= window
    doc = words.doc[starts]
    member = np.zeros(period, bool)
    member[list(cover)] = True
    starts = starts[long[doc] & member[(starts - words.at[doc]) % period]]
    keys = ngram_hashes(words.hashes, n)[starts] >> np.uint64(64 - ANCHOR_BITS) if len(starts) else np.zeros(0, np.uint64)
    return starts, keys


def windows_at(words: Words, window: int, anchor_starts: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold one of the anchors."""
    period, _ = cover_for(window)
    count = np.zeros(len(words.hashes) + 1, np.int64)
    doc = words.doc[anchor_starts]
    low = np.maximum(anchor_starts - period + 1, words.at[doc])
    high = np.minimum(anchor_starts, words.at[doc + 1] - window)
    ok = high >= low
    np.add.at(count, low[ok], 1)
    np.add.at(count, high[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(count)[:-1] > 0)


class Candidates:
    """A chunk's candidate windows: starts, distinct keys in order, and the least document of each key."""

    def __init__(self, words: Words, ids: np.ndarray, window: int, shared: np.ndarray):
        starts, keys = anchors(words, window)
        distinct, back = np.unique(keys, return_inverse=True)
        self.starts = windows_at(words, window, starts[shared.astype(bool)[back]]) if len(distinct) else starts
        hashes = ngram_hashes(words.hashes, window)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)
        self.keys, self.back = np.unique(hashes, return_inverse=True)
        self.owner = ids[words.doc[self.starts]]
        self.least = np.full(len(self.keys), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.back, self.owner)


def _ids(docs: pa.RecordBatch) -> np.ndarray:
    """Document ids; a null id counts as larger than all."""
    return np.asarray(docs.column(0).fill_null(np.iinfo(np.int64).max))


def _send_anchors(window: int, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, docs, _ in chunks_of(batches):
            words, ids = Words(docs, 1), _ids(docs)
            starts, keys = anchors(words, window)
            owner = ids[words.doc[starts]]
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(keys)) - 1
            several = (owner[first] != owner[last]).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)
            yield packed_rows([(chunk, p, b) for p, b in send(keys[first], lambda s, m=several: pack_array(m[s]), bounds)])

    return run


def _shared(keys: list[np.ndarray], extras: list[bytes]) -> list[np.ndarray]:
    """Whether several documents hold each key: in one chunk or in more."""
    flat = np.concatenate(keys)
    several = np.concatenate([unpack_array(e) for e in extras]).astype(bool)
    distinct, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    known = count > 1
    known[back[several]] = True
    return np.split(known[back].astype(np.uint8), np.cumsum([len(k) for k in keys])[:-1])


def _send_windows(window: int, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, docs, answers in chunks_of(batches):
            if answers:
                c = Candidates(Words(docs, 1), _ids(docs), window, answers[0])
                low = int(c.least.min()) if len(c.least) else 0

                def extra(s: slice, least: np.ndarray = c.least, low: int = low) -> bytes:
                    rel = (least[s] - low).astype(np.uint64)
                    kind = np.uint32 if int(rel.max()) < 2**32 else np.uint64
                    return join_blobs(struct.pack("<q", low), pack_array(rel.astype(kind)))

                yield packed_rows([(chunk, p, b) for p, b in send(c.keys, extra, bounds)])

    return run


def _held_before(keys: list[np.ndarray], extras: list[bytes]) -> list[np.ndarray]:
    """Whether a smaller document than the chunk's least one holds each key."""
    flat = np.concatenate(keys)
    least = np.concatenate([unpack_array(rel).astype(np.int64) + struct.unpack("<q", low)[0] for low, rel in map(split_blobs, extras)])
    distinct, back = np.unique(flat, return_inverse=True)
    best = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(best, back, least)
    return np.split((best[back] < least).astype(np.uint8), np.cumsum([len(k) for k in keys])[:-1])


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs, answers in chunks_of(batches):
            words = Words(docs, 1)
            n = len(words.hashes)
            gone = np.zeros(n, bool)
            if len(answers) > 1:
                c = Candidates(words, _ids(docs), window, answers[0])
                hit = c.starts[answers[1].astype(bool)[c.back] | (c.owner > c.least[c.back])]
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
            kept, spans, removed = [], [], []
            whole = words.buf.tobytes()
            for d in range(docs.num_rows):
                a, b = int(words.at[d]), int(words.at[d + 1])
                some = gone[a:b]
                removed.append(int(some.sum()))
                if removed[-1]:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], some.view(np.int8), [0]])))
                    spans.append([{"from": int(x), "to": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                    keep = np.flatnonzero(~some) + a
                    kept.append(b" ".join([whole[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)]))
                else:
                    spans.append([])
                    kept.append(b" ".join(whole[words.starts[a] : words.ends[b - 1]].split()) if b > a else b"")
            counts = np.diff(words.at)
            cols = [docs.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(cols + [docs.column(k) for k in range(1, docs.num_columns)], names=[f"c{k}" for k in range(len(cols) + docs.num_columns - 1)])

    return run


def remove_repeats(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, spans (removed word ranges), original text and ``keep_columns``.

    A word goes if a window of ``window`` words that covers it, in its document, also starts in a
    document of smaller id. Windows are judged on the input. kept_text has the kept words joined by one
    space. Null and empty texts have no words; texts shorter than a window keep all; documents of a
    repeated id don't remove each other's words, a null id counts as larger than all others; an empty
    table gives none; columns not named are not read. Window keys are 64-bit hashes of the words.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    extras = [F.col(c).alias(f"x{k}") for k, c in enumerate(keep_columns)]
    staged = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *extras), 1)
    parts = range_count(staged)
    first = cut(answer(staged.mapInArrow(_send_anchors(window, ranges(parts, ANCHOR_BITS)), CHUNKS), parts, _shared))
    release(spark)
    second = cut(answer(meet(staged, first).mapInArrow(_send_windows(window, ranges(parts, 64)), CHUNKS), parts, _held_before))
    release(spark)
    kinds = dict(docs.select(text.alias("text"), *extras).dtypes)
    schema = "c0 long, c1 long, c2 long, c3 string, c4 array<struct<from:int,to:int>>, " + ", ".join(f"c{5 + k} {t}" for k, t in enumerate(kinds.values()))
    out = meet(staged, first, second).mapInArrow(_remove(window), schema)
    names = ["doc_id", "n_words", "n_removed", "kept_text", "spans", text_col, *keep_columns]
    return out.toDF(*names)
