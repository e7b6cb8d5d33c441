import random

import numpy as np
import pytest

import lakewright.llm.ngram_join as nj
from lakewright.llm.ngram_join import HOME, SEEK, index_keys, needed, ngram_jaccard_join


def shingles(text, n=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(docs, num=80, den=100):
    sets = [shingles(t) for _, t in docs]
    comp, links = list(range(len(docs))), [0] * len(docs)

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: (len(sets[i]), links[i], least[root(i)]) for i, (d, _) in enumerate(docs)}


def corpus(rng, families, vocabulary=400):
    docs = []
    line = [f"b{k}" for k in range(12)]
    for _ in range(families):
        base = [f"w{rng.randint(0, vocabulary)}" for _ in range(rng.choice([1, 3, 6, 8, 30, 80, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = [f"w{rng.randint(0, vocabulary)}"]
                w = w or ["z"]
            if rng.random() < 0.2:
                w += line
            docs.append(" ".join(x.upper() if rng.random() < 0.05 else x for x in w))
    rng.shuffle(docs)
    return [(3 * i, t) for i, t in enumerate(docs)] + [(1_000_000, None), (1_000_001, ""), (1_000_002, " \n")]


@pytest.mark.parametrize(("seed", "frequent"), [(1, 6), (2, 0), (3, 1)])
def test_like_brute_force(spark, seed, frequent, monkeypatch):
    docs = corpus(random.Random(seed), 60)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(nj, "FREQUENT", frequent)
    rows = ngram_jaccard_join(df)
    assert {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in rows.collect()} == brute(docs)


@pytest.mark.parametrize("frequent", [0, 2, 6])
def test_similar_sets_share_a_signature(frequent, monkeypatch):
    monkeypatch.setattr(nj, "FREQUENT", frequent)
    rng = np.random.default_rng(frequent)
    for _ in range(400):
        n = int(rng.choice([4, 5, 9, 20, 64, 130, 300]))
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        code = {int(t): int(rng.integers(1, 9)) for t in base}
        x, y = set(map(int, base)), set(map(int, base))
        for _ in range(int(rng.integers(0, n // 9 + 2))):
            (x if rng.random() < 0.5 else y).discard(int(rng.choice(base)))
        own = int(rng.integers(0, n // 9 + 1))
        nx, ny, both = len(x) + own, len(y), len(x & y)
        if 100 * both < 80 * (nx + ny - both):
            continue

        def keys(s, size, role):
            t = np.array(sorted(s, key=lambda v: (code[v], v)), np.uint64)
            key, roles = index_keys(size, t, np.array([code[int(v)] for v in t], np.uint8), 80, 100)
            return set(key[(roles & role) > 0].tolist())

        if x != y or own:
            (small, m), (large, k) = sorted(((x, nx), (y, ny)), key=lambda s: s[1])
            assert keys(small, m, HOME) & keys(large, k, SEEK), (n, nx, ny, both)


@pytest.mark.parametrize("cost", [1, 200])
def test_tile_links(cost):
    rng = np.random.default_rng(cost)
    for cut_at in (0, 9):
        sets = [np.unique(rng.integers(0, 60 * cost, 40 * cost, dtype=np.uint64) * np.uint64(7)) if rng.random() < 0.3 else np.unique(rng.choice(np.arange(50, dtype=np.uint64), 45, replace=False)) for _ in range(30)]
        i, j, _ = nj.tile_links(np.array([len(x) for x in sets]), sets, cut_at, 80, 100)
        want = {(a, b) for b in range(30) for a in range(b) if (cut_at == 0 or a < cut_at <= b) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
        pairs = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        assert pairs == want and len(pairs) == len(i)


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(nj, "TILE_BYTES", 4000)
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    docs = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 2, 3])):
            w[rng.randrange(60)] = f"x{rng.randint(0, 10**6)}"
        docs.append((i, " ".join(w)))
    rows = ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in rows.collect()} == brute(docs)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "A b c d e f"), (4, "A b c d e f"), (2, "x")], "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS cid")
    rows = ngram_jaccard_join(df)
    assert sorted((str(r.doc_id), r.n_shingles, r.n_links, r.component_id) for r in rows.collect()) == [("2", 1, 0, 2), ("4", 2, 2, 4), ("4", 2, 2, 4), ("None", 2, 2, 4)]
    assert ngram_jaccard_join(df.limit(0)).count() == 0


def test_needed():
    assert [needed(n, 80, 100) for n in (1, 4, 5, 10)] == [1, 4, 4, 8]


def test_templates_without_links_are_not_compared(spark):
    """Pages of one template with words of their own: no two link, and next to none are compared."""
    rng = random.Random(5)
    template = [f"t{k}" for k in range(200)]
    docs = [(i, " ".join(template + [f"o{i}x{k}" for k in range(33)])) for i in range(600)]
    docs += [(1000 + i, docs[i][1].replace("t7 ", "u7 ")) for i in rng.sample(range(600), 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = ngram_jaccard_join(df)
    assert {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in rows.collect()} == brute(docs)
    n = np.full(600, 229)
    assert nj.tile_links(n, [np.arange(192, dtype=np.uint64)] * 600, 0, 80, 100)[2] == 0
    t = np.arange(1, 193, dtype=np.uint64)
    _, roles = index_keys(229, t, np.full(192, 9, np.uint8), 80, 100)
    assert not (roles & HOME).any()


def test_hot_keys_are_spread(spark):
    """One text and one near text in very many copies beside a few others."""
    base = " ".join(f"w{k}" for k in range(60))
    docs = [(i, base if i % 2 else base + " z") for i in range(700)] + [(5000 + i, f"other {i} " + base[: 40 + i]) for i in range(40)]
    rows = ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in rows.collect()} == brute(docs)
