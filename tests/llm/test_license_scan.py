import random
import re

import numpy as np
import pytest

from lakewright.llm import license_scan as L
from lakewright.llm import queries

SCHEMA = "doc_id long, text string, n_words int, phrases string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA)


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def expected(t, templates, percent):
    """Phrase places and blocks by looking at every place and every block."""
    w = words(t)
    phrases, blocks = [], []
    for k, x in enumerate(templates):
        y = words(x.text)
        if x.phrase:
            phrases += [(i, k, x.label) for i in range(len(w)) if w[i : i + len(y)] == y]
            continue
        s = 16
        while s < len(y):
            s *= 2
        i = 0
        while i == 0 or i + s < len(w):
            held = len(set(w[i : i + 2 * s]) & set(y))
            if 100 * held >= percent * len(set(y)):
                blocks.append((i, k, x.label, len(w[i : i + 2 * s]), held / len(set(y))))
            i += s
    return len(w), [(p, x) for p, _, x in sorted(phrases)], [(x, k, i, n, c) for i, k, x, n, c in sorted(blocks)]


def texts(seed=0):
    rng = random.Random(seed)
    pool = [w for t in L.TEMPLATES for w in words(t.text)]
    filler = ["the", "of", "wörd", "日本", "x1", "MIT", "License", "public", "general"]
    out = [None, "", " .,;", "MIT LICENSE", "mit-license; mit\nlicense", "the MIT\tLicense.The Apache   License", "General Public License " * 40, "mit", "license mit", "mit license" * 3, "Mİt license mıt license K license"]
    for t in L.TEMPLATES:
        w = t.text.split()
        for gone in (0, 1, len(w) // 5, len(w) // 3):
            kept = list(w)
            for _ in range(gone):
                kept.pop(rng.randrange(len(kept)))
            for lead in (0, 7, 15, 16, 31, 130):
                out.append(" ".join([*rng.choices(filler, k=lead), *kept, *rng.choices(filler, k=rng.randint(0, 40))]))
    out += [" ".join(rng.choices(pool, k=rng.randint(1, 400))) for _ in range(60)]
    return out


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_every_block_and_place_is_found(spark, percent):
    rows = [(i, t) for i, t in enumerate(texts(percent))] + [(None, "null id, MIT license"), (5, "an id twice: apache license"), (5, "an id twice: apache license")]
    got = L.scan_licenses(frame(spark, rows).repartition(3), percent=percent).collect()
    want = sorted(str((i, *expected(t, L.TEMPLATES, percent))) for i, t in rows)
    assert sorted(str((r.doc_id, r.n_words, [(p.start, p.label) for p in r.phrases], [tuple(b) for b in r.blocks])) for r in got) == want
    assert sum(len(r.blocks) for r in got) > 50


def test_filters_leave_little_to_count(monkeypatch):
    """Words are counted for far fewer pairs than blocks and templates that share a word."""
    rng = random.Random(1)
    pool = words(" ".join(t.text for t in L.NOTICES))
    text = " ".join(rng.choices([f"w{k}" for k in range(500)], k=20_000) + rng.choices(pool, k=500))
    frequency = {w: pool.count(w) for w in pool}
    index = L.Index(L.NOTICES, 80, frequency)
    buf = np.frombuffer(text.encode(), np.uint8)
    place, number, doc, word_at = L._vocabulary_words(index, buf, np.array([0, len(buf)]))
    sharing = counted = 0
    bincount = np.bincount

    def watched(x, weights, minlength):
        nonlocal counted
        counted += minlength
        return bincount(x, weights, minlength)

    monkeypatch.setattr(L.np, "bincount", watched)
    for stride in index.levels:
        L.join_blocks(index, stride, place, number, doc, word_at)
        block = set((place // stride).tolist())
        sharing += len(block) * sum(len(words(t.text)) <= stride for t in L.NOTICES)
    assert 0 < counted < sharing / 3


def test_words_whose_hashes_collide_are_told_apart(spark, monkeypatch):
    plain = L.word_hashes
    monkeypatch.setattr(L, "word_hashes", lambda *a: plain(*a) % np.uint64(64))
    index = L.Index((L.Template("x", "red green blue", True),), 80, {})
    buf = np.frombuffer(" ".join(f"w{k}" for k in range(500)).encode() + b" red green blue gree greenx", np.uint8)
    place, number, _, _ = L._vocabulary_words(index, buf, np.array([0, len(buf)]))
    assert sorted(index.order[k] for k in number) <= ["blue", "green", "red"] and set(place.tolist()) <= {500, 501, 502}


def test_order_is_global_and_counts_all_documents(spark):
    rows = [(k, "License") for k in range(5)] + [(9, "mit license mit"), (10, None)]
    held = L.word_frequencies(frame(spark, rows).repartition(4), L.TEMPLATES)
    assert held["license"] == 6 and held["mit"] == 1 and held["apache"] == 0
    order = L.Index(L.TEMPLATES, 80, held).order
    assert order[-1] == "license" and order[-2] == "mit"


def test_digest_and_empty_table(spark, tmp_path):
    rows = [(1, "Released under the MIT License. Licensed under CC BY-NC 4.0."), (2, None), (3, "MIT license, Apache License, mit license")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_license_scan(spark, str(tmp_path)).collect()}
    assert got == {1: (12, 1, 3, 3, "mit", "cc-by-nc,mit", 1.0), 2: (0, 0, None, None, "", "", 0.0), 3: (6, 3, 0, 4, "apache,mit", "apache,mit", 1.0)}
    assert L.scan_licenses(frame(spark, [])).collect() == []


def test_bad_templates(spark):
    with pytest.raises(ValueError):
        L.Index((L.Template("x", "--"),), 80, {})
    with pytest.raises(ValueError):
        L.Index((L.Template("x", "a " * (L.MOST_WORDS + 1)),), 80, {})
