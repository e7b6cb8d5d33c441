"""Language identification by prediction by partial matching.

One model per language over one tree of byte contexts of order 0 to 4: a context is in the tree if some
language's training texts have it often enough, so contexts are as long as the texts bear out. Escape
probabilities are those of method C (distinct symbols over total plus distinct) with exclusion, down to a
uniform order -1. The tree has a budget of bytes over all languages: where contexts would go beyond it,
the rarest of their order are left out. The statistics are frozen after training, so every tree node has the exact code length
of every symbol under every language; a text's code length is a sum over its bytes, each looked up at the
deepest node that its context reaches, walking back from it. The language of the shortest code wins; the
score is its posterior probability under equal priors.

How long codes usually are, in bits a byte, is measured on texts that were not trained on; a text whose
best code is much longer than that is in none of the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.session import cut
from lakewright.llm.text import BLOCK, slices, texts_of

UNKNOWN = "und"
#: The longest context, and how often some language must have a context of more than two bytes.
ORDER, LEAST = 4, 16
#: The most languages that are told apart; a row for each is broadcast while training texts are chosen.
MOST_LANGUAGES = 10_000
#: The most bytes of a model's tables, whatever the languages and their alphabet: it is broadcast to every worker.
MODEL_BYTES = 64 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class Model:
    """``symbols``: byte to symbol. ``child``: by node and symbol, the node of the context that is one symbol
    longer; nodes from ``nodes`` on are those of walks that have ended, and lead to themselves. ``bits``: by
    node and symbol, the code length under each language. ``typical``: median bits a byte of each language."""

    languages: list[str]
    symbols: np.ndarray
    child: np.ndarray
    bits: np.ndarray
    typical: np.ndarray

    @property
    def alphabet(self) -> int:
        return int(self.symbols.max()) + 1


def _code(data: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    return symbols[_FOLD[data]]


def _ppm(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Symbol probabilities in contexts from counts [..., symbol] and the next lower order's probabilities."""
    seen = counts > 0
    n, distinct = counts.sum(-1, keepdims=True), seen.sum(-1, keepdims=True)
    excluded = np.where(seen, lower, 0.0).sum(-1, keepdims=True)
    rest = np.maximum(1.0 - excluded, 1e-12)
    alone = distinct == counts.shape[-1]  # nothing to escape to
    total = np.where(alone, n, n + distinct)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = counts / total
        escape = np.where(n > 0, distinct / total, 1.0)
    return np.where(n > 0, np.where(seen, own, escape * lower / rest), np.broadcast_to(lower, counts.shape))


def train(samples: dict[str, list[bytes]], fresh: dict[str, list[bytes]] | None = None) -> Model | None:
    """Models of the languages given with texts; None without any. ``fresh``: texts of the languages that are
    not trained on, to measure usual code lengths by; a language without any is measured on its own. Tables
    hold at most ``MODEL_BYTES``: of an order's contexts the most frequent are kept, none of equal frequency
    where only some would fit (order 0 always is)."""
    languages = sorted(x for x, texts in samples.items() if any(texts))
    if not languages:
        return None
    gap = np.full(ORDER, 32, np.uint8)
    joined = [np.concatenate([p for t in samples[x] if t for p in (gap, _FOLD[np.frombuffer(t, np.uint8)])]) for x in languages]
    used = np.flatnonzero(np.bincount(np.concatenate([np.unique(t) for t in joined]), minlength=256))
    symbols = np.full(256, len(used), np.uint8)
    symbols[used] = np.arange(len(used))
    a = len(used) + 1  # the last symbol: any byte never seen
    # symbols of each language's texts, which positions are text, and the node of each (-1 where its walk has ended)
    text = [symbols[t] for t in joined]
    real = []
    for x in languages:
        sizes = np.array([len(t) for t in samples[x] if t])
        real.append((np.arange(sizes.sum()) + np.repeat(ORDER * np.arange(1, len(sizes) + 1), sizes)).astype(np.int32))
    at = [np.zeros(len(r), np.int32) for r in real]
    del joined
    counts: list[list[np.ndarray]] = []
    links: list[np.ndarray] = []
    width = 1
    # a node has a number of bits for each symbol and language, and two links for each symbol
    room = MODEL_BYTES // (a * (4 * len(languages) + 8)) - 1
    for order in range(ORDER + 1):
        counts.append([np.bincount(node[node >= 0].astype(np.int64) * a + s[r[node >= 0]], minlength=width * a).astype(np.int32) for s, r, node in zip(text, real, at, strict=True)])
        if order == ORDER or not width:
            break
        # contexts one symbol longer, by node of this order and the symbol before
        often = np.zeros(width * a, np.int64)
        for s, r, node in zip(text, real, at, strict=True):
            on = node >= 0
            often = np.maximum(often, np.bincount(node[on].astype(np.int64) * a + s[r[on] - order - 1], minlength=width * a))
        found = np.flatnonzero(often >= (1 if order < 2 else LEAST))
        if len(found) > room:
            most = np.sort(often[found])[::-1][max(0, room)]
            found = found[often[found] > most]
        room -= len(found)
        number = np.full(width * a, -1, np.int32)
        number[found] = np.arange(len(found))
        for s, r, node in zip(text, real, at, strict=True):
            on = np.flatnonzero(node >= 0)
            node[on] = number[node[on].astype(np.int64) * a + s[r[on] - order - 1]]
        links.append(found)
        width = len(found)
    del text, real, at
    widths = [1, *map(len, links)]
    first = np.concatenate([[0], np.cumsum(widths)])
    nodes = int(first[-1])
    child = np.repeat(np.arange(2 * nodes, dtype=np.int32)[:, None], a, 1)
    child[:nodes] += nodes  # a walk ends where there is no longer context
    for order, found in enumerate(links):
        child[first[order] + found // a, found % a] = first[order + 1] + np.arange(len(found))
    bits = np.empty((nodes, a, len(languages)), np.float32)
    for k in range(len(languages)):
        before, parent = np.full((1, a), 1.0 / a), np.zeros(1, np.int64)
        for order, n in enumerate(widths):
            p = np.empty((n, a))
            for lo in range(0, n, 1 << 12):
                some = slice(lo, min(lo + (1 << 12), n))
                p[some] = _ppm(counts[order][k][lo * a : some.stop * a].reshape(-1, a).astype(float), before[parent[some]])
            bits[first[order] : first[order + 1], :, k] = -np.log2(np.maximum(p, 1e-30))
            before, parent = p, links[order] // a if order < len(links) else parent
    model = Model(languages, symbols, child.reshape(-1), bits.reshape(nodes * a, len(languages)), np.zeros(len(languages)))
    for k, x in enumerate(languages):
        texts = [t for t in (fresh or {}).get(x, []) if t] or [t for t in samples[x] if t]
        per = []
        for t in texts:
            per.append(code_lengths(model, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0, k] / len(t))
        model.typical[k] = np.median(per)
    return model


def code_lengths(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each document under each language: [document, language]."""
    a, nodes, n = model.alphabet, len(model.child) // (2 * model.alphabet), len(offsets) - 1
    out = np.zeros((n, len(model.languages)))
    lengths = np.diff(offsets)
    full = np.flatnonzero(lengths > 0)
    if not len(full):
        return out
    # spaces come before each text
    at = np.concatenate([[0], np.cumsum(lengths[full] + ORDER)])
    data = np.full(int(at[-1]), 32, np.uint8)
    data[np.arange(len(buf)) + np.repeat(ORDER * np.arange(1, len(full) + 1), lengths[full])] = buf
    for lo in range(0, len(data), BLOCK):
        part = _code(data[max(0, lo - ORDER) : lo + BLOCK], model.symbols).astype(np.int64)
        m = len(part) - ORDER
        if m <= 0:
            continue
        first = max(0, lo - ORDER) + ORDER  # position of the first byte that is coded
        node = np.zeros(m, np.int64)
        for back in range(1, ORDER + 1):
            node = model.child[node * a + part[ORDER - back : ORDER - back + m]]
        bits = model.bits[np.where(node >= nodes, node - nodes, node) * a + part[ORDER:]]
        k0, k1 = int(np.searchsorted(at, first, "right")) - 1, int(np.searchsorted(at, first + m, "left"))
        doc_from = np.clip(at[k0:k1] + ORDER - first, 0, m)
        doc_to = np.clip(at[k0 + 1 : k1 + 1] - first, 0, m)
        some = np.flatnonzero(doc_to > doc_from)
        if len(some):
            # sums from each text's first byte to its last; what lies between texts is summed and left out
            edges = np.stack([doc_from[some], doc_to[some]], 1).reshape(-1)
            sums = np.add.reduceat(np.concatenate([bits, np.zeros((1, bits.shape[1]), np.float32)]), edges, axis=0, dtype=np.float64)[::2]
            out[full[k0 + some]] += sums
    return out


def has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each document holds a letter of any script."""
    ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    found = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        data = buf[offsets[i] : offsets[i + 1]]
        if (data > 127).any():
            found[i] = any(c.isalpha() for c in bytes(data).decode("utf-8", "ignore"))
    return found


def predict_batch(model: Model | None, buf: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, excess) of each document; excess: bits a byte of the best code over the language's usual."""
    n = len(offsets) - 1
    if model is None:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
    bits = code_lengths(model, buf, offsets)
    best = bits.argmin(1)
    score = 1.0 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000.0)).sum(1)
    letter = has_letter(buf, offsets)
    excess = bits[np.arange(n), best] / np.maximum(np.diff(offsets), 1) / np.maximum(model.typical[best], 1e-9)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)], np.where(letter, score, 0.0), excess


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, *, per_language: int = 300, fresh: int = 100, piece: int = 1 << 16, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Train on at most ``per_language`` documents of each language, those of the smallest id hashes, and measure
    usual code lengths on at most ``fresh`` more. Of a text longer than ``piece`` characters a piece of so many
    is taken, from a place that the id's hash says.

    Documents with null text, lang or id and those of the held-out fold are never used. The bounds hold
    what comes to the driver: ``per_language + fresh`` texts of at most ``piece`` characters of each language.
    More than ``MOST_LANGUAGES`` languages are an error.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).filter((fold("i") != held_out) & F.col("t").isNotNull() & F.col("l").isNotNull())
    # hashes that a language's row count says are too large go before the window
    both = per_language + fresh
    counts = cut(rows.groupBy(F.col("l").alias("m")).agg(F.least(F.lit(1.0), 4.0 * both / F.count("*")).alias("share")))
    if counts.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = rows.withColumn("at", F.pmod(F.xxhash64("i", F.lit("piece")), F.greatest(F.lit(1), F.length("t") - piece + 1)))
    few = rows.select("i", "l").join(F.broadcast(counts), F.col("l") == F.col("m")).filter(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) <= F.col("share") * (1 << 30)).select("i", "l")
    order = Window.partitionBy("l").orderBy(F.pmod(F.xxhash64("i"), F.lit(1 << 30)), "i")
    ids = few.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= both)
    ids = ids.groupBy(F.col("i").alias("j")).agg(F.min("k").alias("k"))
    chosen = rows.join(F.broadcast(ids), F.col("i") == F.col("j"))
    trained: dict[str, list[bytes]] = {}
    measured: dict[str, list[bytes]] = {}
    text = F.substring("t", F.col("at").cast("int") + 1, F.lit(piece)).alias("t")
    for r in chosen.select("l", text, "k").toLocalIterator():
        (trained if r.k <= per_language else measured).setdefault(r.l, []).append(r.t.encode())
    return train(trained, measured)


PREDICTED = "doc_id long, lang_pred string, score double"


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row in, from its whole text alone.

    Null, empty and letterless texts are ``und`` with score 0; equal code lengths go to the language
    first by code point; null ids stay, repeated rows are each predicted, an empty table gives none and
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at, _ = texts_of(batch.column(1))
            langs, scores = [], []
            for i, j in slices(at):
                x, s, _ = predict_batch(shared.value, buf[at[i] : at[j]], at[i : j + 1] - at[i])
                langs += x
                scores.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PREDICTED)


def keep_identified(docs: DataFrame, model: Model | None, *, least_score: float = 0.3, most_excess: float = 2.0, slack_bits: float = 64.0, text_col: str = "text") -> DataFrame:
    """Rows in an identified language, all columns unchanged.

    Rows go where ``predict`` would say ``und``, where the posterior is below ``least_score`` and where
    the best code is longer than ``most_excess`` times the language's usual bits a byte and ``slack_bits``
    more, so that a few odd bytes don't take a short text away. No shuffle: rows are filtered as they pass.
    """
    shared, at_text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at, _ = texts_of(batch.column(at_text))
            keep = []
            for i, j in slices(at):
                langs, scores, excess = predict_batch(shared.value, buf[at[i] : at[j]], at[i : j + 1] - at[i])
                size = np.diff(at[i : j + 1])
                usual = np.array([0.0 if x == UNKNOWN else shared.value.typical[shared.value.languages.index(x)] for x in langs])
                long = excess * usual * size > most_excess * usual * size + slack_bits
                keep += [x != UNKNOWN and s >= least_score and not bad for x, s, bad in zip(langs, scores, long, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
