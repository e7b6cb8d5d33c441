"""Exact Jaccard join of word n-gram sets by token-combination prefixes.

Shingles ("tokens") are ordered by document frequency, rare ones first; the frequency is counted over
all documents. In a set x that must share at least t tokens with a partner, take the shortest prefix of
weight |x| - t + 1, where a rare token weighs 1 and the frequent tokens of one token group weigh one
less than their number. Then two sets that are similar share, in their prefixes, a rare token or two
frequent tokens of one group: had they none of these in common, the prefix of the set whose prefix
ends first could share no more tokens than its length less its weight, which is too few. So rare
tokens are indexed by themselves and frequent ones by pairs within a group, which keeps the index
selective where tokens are common. The number of groups follows the size class of the larger set.

Sizes are cut in narrow bands. A set stands under its own band ("home") and is looked for there by
larger sets ("seek"), which know how many tokens a partner of that band must share. Of its tokens a set
knows which others hold at all, and that bounds the partners' sizes: bands outside are not sought, and a
set that can have no partner as large as itself is not at home anywhere.

Equal sets are one class and only classes are indexed. Classes that meet under index keys, directly or
by way of others, are a family; the family's sets meet in tiles of bounded size. In a tile only pairs
whose sizes lie within each other's bounds are compared, and all links are found by exact intersection
sizes. A tile writes sums and one root per class, so no link is lost and what is written is in
proportion to the sets, not to their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.exchange import CHUNKS, answer, chunks_of, join_blobs, meet, pack_array, packed_rows, range_count, ranges, send, split_blobs, stage, unpack_array
from lakewright.llm.graph import connected_components, local_roots
from lakewright.llm.session import cut, join_counted, release
from lakewright.llm.text import mix64, ngram_hashes, ngram_starts, slices, texts_of, word_hashes, word_spans

#: Bits of a token's key while frequencies are counted; a chance collision only makes a token look less rare.
KEY_BITS = 40
#: log2 of the document frequency from which on a token is frequent.
FREQUENT = 3
#: Bytes of sets on a side of a tile.
TILE_BYTES = 8 << 20
#: A family of more classes than this is dealt over several sides, up to ``SIDES``, so that tasks share it;
#: beyond that bytes alone tell their number.
SIDE, SIDES = 100, 16
#: Token groups per token of a size class.
GROUPS = 0.05
#: Ratio of the sizes at the ends of a band.
BAND = 1.1


def token_sets(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct tokens of each document, offsets). Fewer than n words make one token."""
    starts, ends, at = word_spans(buf, offsets)
    hashes = word_hashes(buf, starts, ends, lower=True)
    grams = ngram_hashes(hashes, n)
    first, counts = ngram_starts(at, n)
    flat = grams[first] if len(first) else np.zeros(0, np.uint64)
    out = []
    for d in range(len(at) - 1):
        a, b = int(at[d]), int(at[d + 1])
        if b - a >= n:
            out.append(np.unique(flat[counts[d] : counts[d + 1]]))
        elif b > a:
            out.append(ngram_hashes(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return np.concatenate(out) if out else flat, np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def _chunk_sets(docs: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    buf, at, _ = texts_of(docs.column(1))
    tokens, offsets, base = [], [np.zeros(1, np.int64)], 0
    for i, j in slices(at):
        t, o = token_sets(buf[at[i] : at[j]], at[i : j + 1] - at[i], n)
        tokens.append(t)
        offsets.append(o[1:] + base)
        base += len(t)
    return np.concatenate(tokens) if tokens else np.zeros(0, np.uint64), np.concatenate(offsets)


def _send_tokens(n: int, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, docs, _ in chunks_of(batches):
            tokens, _ = _chunk_sets(docs, n)
            keys, counts = np.unique(tokens >> np.uint64(64 - KEY_BITS), return_counts=True)
            counts = np.minimum(counts, 65535).astype(np.uint16)
            yield packed_rows([(chunk, p, b) for p, b in send(keys, lambda s, c=counts: pack_array(c[s]), bounds)])

    return run


def _frequency_codes(keys: list[np.ndarray], extras: list[bytes]) -> list[np.ndarray]:
    """floor(log2(document frequency)) of each key."""
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate([unpack_array(e) for e in extras]).astype(float), minlength=len(distinct))
    code = np.floor(np.log2(np.maximum(total, 1))).astype(np.uint8)
    return np.split(code[back], np.cumsum([len(k) for k in keys])[:-1])


PROFILES = "doc_id long, n long, digest binary, body binary"


def _profile(n: int, num: int, den: int):
    """Per document: set size, class, and the tokens that other documents have (by code, then value) where the
    set can have a partner at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs, answers in chunks_of(batches):
            tokens, at = _chunk_sets(docs, n)
            keys = np.unique(tokens >> np.uint64(64 - KEY_BITS))
            code = answers[0][np.searchsorted(keys, tokens >> np.uint64(64 - KEY_BITS))] if answers else np.zeros(len(tokens), np.uint8)
            size, digest, body = np.diff(at), [], []
            for d in range(docs.num_rows):
                t, c, k = tokens[at[d] : at[d + 1]], code[at[d] : at[d + 1]], int(size[d])
                digest.append(hashlib.blake2b(t.tobytes(), digest_size=16).digest() if k else None)
                shared = np.flatnonzero(c > 0)
                # others hold too few of the tokens, or the nearest different set is too far
                if k - needed(k, num, den) + 1 - (k - len(shared)) <= 0 or den * k < num * (k + 1):
                    body.append(None)
                else:
                    order = shared[np.lexsort((t[shared], c[shared]))]
                    body.append(join_blobs(t[order].tobytes(), c[order].tobytes()))
            yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(body, pa.binary())], names=["doc_id", "n", "digest", "body"])

    return run


def needed(n: int, num: int, den: int) -> int:
    """Tokens that a set of n shares at least with any similar set: ceil(num * n / den)."""
    return -(-num * n // den)


def together(n: int, m: int, num: int, den: int) -> int:
    """Tokens that similar sets of n and m share at least: ceil(num * (n + m) / (num + den))."""
    return -(-num * (n + m) // (num + den))


def partner_sizes(n: int, held: int, num: int, den: int) -> tuple[int, int]:
    """(least, largest) size of a set similar to one of n tokens of which others hold ``held``."""
    return needed(n, num, den), min(den * n // num, held * (num + den) // num - n)


def band_of(n: int) -> int:
    return int(np.searchsorted(_band_starts, n, "right"))


def band_start(band: int) -> int:
    return int(_band_starts[band - 1])


def _starts() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out)


_band_starts = _starts()


def signatures(n: int, tokens: np.ndarray, codes: np.ndarray, share: int, classes: range) -> np.ndarray:
    """Index keys of a set of n tokens for partners that share at least ``share`` of them, the larger set of a
    pair being of one of the size ``classes``; ``tokens`` are those that others hold, rare ones first."""
    weight = n - share + 1 - (n - len(tokens))
    if weight <= 0:
        return np.zeros(0, np.uint64)
    rare, out, longest = codes < FREQUENT, [], 0
    frequent = np.flatnonzero(~rare)
    for b in classes:
        groups = max(1, int(GROUPS * 2**b))
        group = tokens % np.uint64(groups)
        weighs = rare.astype(np.int64)
        by_group = frequent[np.argsort(group[frequent], kind="stable")]
        g = group[by_group]
        weighs[by_group[1:]] = g[1:] == g[:-1]
        end = int(np.searchsorted(np.cumsum(weighs), weight)) + 1
        longest = max(longest, end)
        t = tokens[frequent[frequent < end]]
        order = np.lexsort((t, t % np.uint64(groups)))
        t = t[order]
        g = t % np.uint64(groups)
        step = 1
        while step < len(t):
            same = g[step:] == g[:-step]
            if not same.any():
                break
            out.append(mix64(t[:-step][same] * np.uint64(0x9E3779B97F4A7C15) + mix64(t[step:][same] + np.uint64(b + 1))))
            step += 1
    out.append(tokens[:longest][rare[:longest]])
    return np.unique(np.concatenate(out))


HOME, SEEK = 1, 2


def index_keys(n: int, tokens: np.ndarray, codes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, roles) under which a set stands at home or seeks smaller or equal ones."""
    least, largest = partner_sizes(n, len(tokens), num, den)
    keys, roles, own = [], [], n.bit_length() - 1

    def under(band: int, role: int, share: int, classes: range) -> None:
        got = signatures(n, tokens, codes, share, classes)
        keys.append(mix64(got + np.uint64(band * 0x9E3779B97F4A7C15 % 2**64)))
        roles.append(np.full(len(got), role, np.int8))

    if largest >= n:
        under(band_of(n), HOME, together(n, n, num, den), range(own, largest.bit_length()))
    if min(n, largest) >= least:
        for band in range(band_of(least), band_of(min(n, largest)) + 1):
            under(band, SEEK, together(n, max(least, band_start(band)), num, den), range(own, own + 1))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8)
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    role = np.zeros(len(distinct), np.int8)
    np.bitwise_or.at(role, back, np.concatenate(roles))
    return distinct, role


SIGNED = "sig long, cid long, role byte"


def _sign(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, count = [], 0
            for cid, n, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                t, c = split_blobs(body)
                sig, role = index_keys(n, np.frombuffer(t, np.uint64), np.frombuffer(c, np.uint8), num, den)
                if len(sig):
                    held.append((sig.view(np.int64), cid, role))
                    count += len(sig)
                if count > 100_000:
                    yield _signed(held)
                    held, count = [], 0
            if held:
                yield _signed(held)

    return run


def _signed(held: list[tuple[np.ndarray, int, np.ndarray]]) -> pa.RecordBatch:
    sig, cid, role = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig)), pa.array(np.repeat(np.array(cid, np.int64), [len(x) for x in sig])), pa.array(np.concatenate(role))], names=["sig", "cid", "role"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted sets left[i] and right[j].

    By binary search pair by pair, or by products of 0/1 matrices over blocks of tokens, whichever costs
    less arithmetic.
    """
    vocabulary, back = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    if len(i) * 30e-6 <= 1e-3 + 1e-10 * len(left) * len(right) * len(vocabulary):
        out = np.empty(len(i), np.int64)
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            x, y = (left[a], right[b]) if len(left[a]) > len(right[b]) else (right[b], left[a])
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            out[k] = (x[at] == y).sum()
        return out
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(back, kind="stable")
    back, owner = back[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(vocabulary), 2048):
        a, b = np.searchsorted(back, [lo, lo + 2048])
        block = np.zeros((len(left) + len(right), 2048), np.float32)
        block[owner[a:b], back[a:b] - lo] = 1
        both += block[: len(left)] @ block[len(left) :].T
    return both[i, j].astype(np.int64)


def size_pairs(n: np.ndarray, held: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions, the larger set first (equal sizes by position), whose sizes lie within each other's
    bounds, in blocks. Only sizes in range are walked, not all pairs."""
    order = np.argsort(n, kind="stable")
    size = n[order]
    least = -(-num * size // den)
    largest = np.minimum(den * size // num, held[order] * (num + den) // num - size)
    first = np.searchsorted(size, least, "left")
    last = np.minimum(np.searchsorted(size, largest, "right"), np.arange(len(size)))
    count = np.maximum(last - first, 0)
    at = 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(count[at:]), 1 << 18, "right")) + at)
        c = count[at:upto]
        i = np.repeat(np.arange(at, upto), c)
        j = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[at:upto], c)
        ok = largest[j] >= size[i]
        if ok.any():
            yield order[i[ok]], order[j[ok]]
        at = upto


def tile_links(n: np.ndarray, sets: list[np.ndarray], cut_at: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, int]:
    """All links (i, j) between the first ``cut_at`` sets and the others, or among all where it is 0, and the
    number of pairs compared."""
    held = np.array([len(x) for x in sets])
    left, right, compared = [], [], 0
    for i, j in size_pairs(n, held, num, den):
        if cut_at:
            across = (i < cut_at) != (j < cut_at)
            i, j = i[across], j[across]
        least = -(-num * (n[i] + n[j]) // (num + den))
        maybe = np.minimum(held[i], held[j]) >= least
        i, j, least = i[maybe], j[maybe], least[maybe]
        if not len(i):
            continue
        compared += len(i)
        rows, a = np.unique(i, return_inverse=True)
        columns, b = np.unique(j, return_inverse=True)
        for lo in range(0, len(rows), 256):
            of = np.flatnonzero((a >= lo) & (a < lo + 256))
            hit = of[overlaps([sets[k] for k in rows[lo : lo + 256]], [sets[k] for k in columns], a[of] - lo, b[of]) >= least[of]]
            left.append(i[hit])
            right.append(j[hit])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right), compared) if left else (none, none, compared)


FOUND = "cid long, first long, links long, root_first long, root long"


def _search(num: int, den: int):
    """Links of a tile as sums: per class the copies that it links to and the least class it reaches here."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "first", "cid"], kind="stable").reset_index(drop=True)
        cid, first, copies = group.cid.to_numpy(), group["first"].to_numpy(), group.copies.to_numpy()
        cut_at = 0 if group.ti.iloc[0] == group.tj.iloc[0] else int((group.side == group.ti).sum())
        links, root = np.zeros(len(cid), np.int64), np.arange(len(cid))
        if group.ti.iloc[0] == group.tj.iloc[0] or cut_at not in (0, len(group)):
            sets = [np.sort(np.frombuffer(split_blobs(b)[0], np.uint64)) for b in group.body]
            i, j, _ = tile_links(group.n.to_numpy(), sets, cut_at, num, den)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            order = np.lexsort((cid, first))
            rank = np.empty(len(cid), np.int64)
            rank[order] = np.arange(len(cid))
            root = order[local_roots(len(cid), rank[i], rank[j])][rank]
        on = links > 0
        return pd.DataFrame({"cid": cid[on], "first": first[on], "links": links[on], "root_first": first[root[on]], "root": cid[root[on]]})

    return run


def ngram_jaccard_join(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Jaccard join at num / den over sets of lower-cased n-word shingles, one row for each row in.

    doc_id, n_shingles, n_links (other documents linked directly), class_id (equal sets share one) and
    component_id (the smallest doc_id that links reach, the document's own included).

    Only A-Z is folded; a document of fewer than n words has one shingle, all of it; without words, or
    null, it has none and links with nothing. A null id never is a component's id but its row takes part;
    repeated rows and ids are rows of their own; an empty table gives none; other columns are not read.
    Tokens are compared by 64-bit hashes, equal sets by 128-bit digests of them.
    """
    spark = docs.sparkSession
    staged = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), 1)
    parts = range_count(staged)
    codes = cut(answer(staged.mapInArrow(_send_tokens(n, ranges(parts, KEY_BITS)), CHUNKS), parts, _frequency_codes))
    release(spark)
    profiles = cut(meet(staged, codes).mapInArrow(_profile(n, num, den), PROFILES))
    del staged, codes
    release(spark)
    # classes, numbered; ids come before null ones in their order
    sets = profiles.filter("body is not null").groupBy("digest").agg(F.count("*").alias("copies"), F.coalesce(F.min("doc_id"), F.lit((1 << 63) - 1)).alias("first"), F.first("n").alias("n"), F.first("body").alias("body"))
    sets = cut(sets.withColumn("cid", F.monotonically_increasing_id()))
    signed = cut(sets.select("cid", "n", "body").mapInArrow(_sign(num, den), SIGNED))
    # classes that meet under index keys are a family; a star from each key's least class says so without pairs
    buckets = cut(signed.groupBy("sig").agg(F.min("cid").alias("a"), F.count("*").alias("m"), F.bit_or("role").alias("roles")).filter(f"m > 1 and roles = {HOME | SEEK}"))
    met = join_counted(signed, buckets, "sig", "m", "cid", "a").filter("a is not null and a <> cid")
    family = cut(connected_components(met.select("a", F.col("cid").alias("b"))))
    release(spark)
    members = family.select(F.col("node").alias("cid"), F.col("component").alias("family")).join(sets, "cid").select("family", "cid", "first", "n", "copies", "body")
    members = cut(members)
    sides = cut(members.groupBy("family").agg(F.greatest(F.ceil(F.sum(F.octet_length("body")) / F.lit(TILE_BYTES)), F.least(F.ceil(F.count("*") / F.lit(SIDE)), F.lit(SIDES).cast("long"))).alias("g"), F.count("*").alias("m")))
    placed = join_counted(members, sides, "family", "m", "cid", "g").withColumn("side", F.pmod(F.xxhash64("cid"), F.col("g")))
    tiled = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    tiled = tiled.select("family", F.least("side", "k").alias("ti"), F.greatest("side", "k").alias("tj"), "side", "cid", "first", "n", "copies", "body")
    found = cut(tiled.groupBy("family", "ti", "tj").applyInPandas(_search(num, den), FOUND))
    del members, signed, buckets
    release(spark)
    # nodes are (first id, class), so that the least node of a component has its id
    links = found.select(F.struct("first", "cid").alias("a"), F.struct(F.col("root_first").alias("first"), F.col("root").alias("cid")).alias("b"))
    component = connected_components(links).select(F.col("node.cid").alias("cid"), F.col("component.first").alias("c"))
    linked = found.groupBy("cid").agg(F.sum("links").alias("links")).join(component, "cid", "left").join(sets.select("cid", "digest"), "cid").select("digest", "links", "c")
    # classes are few beside documents that share one: ids and counts are gathered class by class first
    classes = profiles.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    classes = classes.join(linked, "digest", "left")
    least = F.nullif(F.coalesce("c", F.col("first")), F.lit((1 << 63) - 1))
    per = cut(classes.select("digest", "copies", F.struct(least.alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")).alias("found")))
    out = join_counted(profiles.select("doc_id", "n", "digest"), per, "digest", "copies", "doc_id", "found")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("found.n_links", F.lit(0)).cast("long").alias("n_links"), F.hex("digest").alias("class_id"), F.coalesce("found.component_id", "doc_id").alias("component_id"))
