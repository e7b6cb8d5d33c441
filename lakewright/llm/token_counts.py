"""Token counts by section: whole documents are encoded once and token spans joined to section spans.

A document's tokens tile its bytes, so a token's span comes from a running sum of token lengths. The
spans of sections tile the text too. The interval join of both is a binary search of token starts (and
ends) among section boundaries; tokens that cross a boundary are allocated by a stated rule:

- ``start``: to the section that holds the token's first character;
- ``majority``: to the section that holds most of its bytes, the earlier one in a tie;
- ``split``: to each section in proportion to its bytes (counts are then fractions).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "majority", "split")
SECTIONS = "doc_id long, section int, start long, end long, n_tokens double, n_crossing long"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to ids from a file of base64 lines."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def line_bounds(data: bytes) -> np.ndarray:
    """Byte boundaries of lines: a line feed ends the section that it belongs to."""
    at = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    cuts = np.concatenate([[0], at, [len(data)]])
    return np.unique(cuts) if len(data) else np.array([0, 0])


def attribute(token_ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens per section, boundary-crossing tokens that begin in each section).

    ``bounds``: section k spans bounds[k] to bounds[k+1]; ``token_ends``: ends of tokens that tile the text.
    """
    sections = len(bounds) - 1
    if not len(token_ends):
        return np.zeros(sections), np.zeros(sections, np.int64)
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, token_ends, "left") - 1
    crossing = first != last
    counts = np.bincount(first[~crossing], minlength=sections).astype(float)
    odd = np.flatnonzero(crossing)
    if rule == "start":
        counts += np.bincount(first[odd], minlength=sections)
    else:
        for t in odd:
            k = np.arange(first[t], last[t] + 1)
            part = np.minimum(bounds[k + 1], token_ends[t]) - np.maximum(bounds[k], starts[t])
            if rule == "majority":
                counts[k[np.argmax(part)]] += 1
            else:
                counts[k] += part / (token_ends[t] - starts[t])
    return counts, np.bincount(first[odd], minlength=sections)


def count_tokens(docs: DataFrame, ranks: bytes, pattern: str, *, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every line of every whole text: doc_id, section, start, end, n_tokens, n_crossing.

    ``ranks``, ``pattern``: the contents of a rank file and its pre-split pattern. start and end count
    code points. Sections are in text order from 0. A null or empty text gives section 0 with no tokens;
    a null id stays; repeated rows are each counted; an empty table gives none; other columns are not
    read. No shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        enc = None
        for batch in batches:
            if enc is None:
                table = parse_ranks(shared.value[0])
                enc = tiktoken.Encoding("own", pat_str=shared.value[1], mergeable_ranks=table, special_tokens={})
                length = np.zeros(max(table.values()) + 1, np.int64)
                for token, i in table.items():
                    length[i] = len(token)
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(texts), 256):
                out: list[list[np.ndarray]] = [[], [], [], [], [], []]
                for k, text in enumerate(texts.slice(lo, 256).to_pylist()):
                    data = (text or "").encode()
                    bounds = line_bounds(data)
                    ends = np.cumsum(length[enc.encode_ordinary(text)]) if data else np.zeros(0, np.int64)
                    counts, crossing = attribute(ends, bounds, rule)
                    if len(data) != len(text or ""):
                        heads = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                        bounds = heads[bounds]
                    n = len(counts)
                    for to, x in zip(out, (np.full(n, lo + k), np.arange(n), bounds[:-1], bounds[1:], counts, crossing), strict=True):
                        to.append(x)
                if out[0]:
                    flat = [np.concatenate(x) for x in out]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(flat[0], pa.int64())), pa.array(flat[1], pa.int32()), pa.array(flat[2], pa.int64()), pa.array(flat[3], pa.int64()), pa.array(flat[4], pa.float64()), pa.array(flat[5], pa.int64())],
                        names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
                    )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SECTIONS)
