import base64
import math
import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakewright.llm import bpe, language, mixing, text, token_counts

public = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_tokens int, size int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS)


def test_words_like_split():
    rng = random.Random(0)
    texts = [None, "", " ", "é x \x0b y\x1cz"] + ["".join(rng.choice("ab \t\né ") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    buf, at, null = text.texts_of(pa.array(texts))
    s, e, w = text.word_spans(buf, at)
    assert [bytes(buf[a:b]) for a, b in zip(s, e, strict=True)] == [x for t in texts for x in (t or "").encode().split()]
    assert null.sum() == 1 and (np.diff(w) == [len((t or "").encode().split()) for t in texts]).all()


def test_long_texts_hash_alike(monkeypatch):
    t = " ".join(f"w{k % 97}" for k in range(5000))
    buf, at, _ = text.texts_of(pa.array([t]))
    s, e, _ = text.word_spans(buf, at)
    whole = text.word_hashes(buf, s, e)
    monkeypatch.setattr(text, "BLOCK", 64)
    assert (text.word_hashes(buf, s, e) == whole).all()


@pytest.fixture(scope="module")
def spec():
    return bpe.load_spec(public.path("word_bpe_49k.json"))


def test_bpe_like_the_library(spark, spec):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rng = random.Random(3)
    alphabet = "aabbcdeé ßΣσςİIı'sтест日本語0٣½ \t\n\u0085​　!?.…☃😀͸"
    words = [w.replace("</w>", "") for w in spec["model"]["vocab"]]
    rows = [None, "", "<|endoftext|>", "x<|startoftext|><|ENDOFTEXT|>y", "ha" * 300, "a" * 2000]
    rows += ["".join(rng.choices(alphabet, k=rng.randint(0, 20))) for _ in range(300)] + ["".join(rng.choices(words, k=4)) for _ in range(300)]
    df = docs(spark, [(i, t, None, None) for i, t in enumerate(rows)] + [(None, "null id", None, None)])
    got = {r.doc_id: r for r in bpe.encode(df, spec).collect()}
    for i, t in enumerate(rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == " ".join(map(str, ids)) and got[i].n_tokens == len(ids)
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False)
    assert got[None].n_tokens == 2
    assert bpe.encode(df.limit(0), spec).count() == 0


def test_word_patterns_agree(spec):
    tok, rng = bpe.WordTokenizer(spec), random.Random(4)
    alphabet = [chr(c) for c in range(128)] + list("éßñçØÿŁжαΣςİ日ªº½٣́ 　")
    for _ in range(4000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 12)))
        if all(unicodedata.category(c) != "Cn" for c in t):
            low = unicodedata.normalize("NFC", t).replace("Σ", "σ").lower()
            assert tok.words(t) == tok.word.findall(low)


def test_automaton_by_hand():
    a = bpe.Automaton({"a": 0, "b": 1, "aa": 2, "ab": 3, "aab": 4}, [("a", "a"), ("a", "b"), ("aa", "b")])
    assert a.path(list("aaab")) == ["aa", "ab"] and a.path(list("aab")) == ["aab"] and a.path(list("aaa")) == ["aa", "a"]
    with pytest.raises(ValueError):
        a.path(["c"])


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 10, 50, 400])), None, rng.choice(["s0", "s0", "s0", "a", "b", None])) for i in range(900)]
    rows += [(None, None, None, "tiny"), (5000, "one", None, "tiny"), (5000, "one", None, "tiny")]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = [s for s in sorted(k for k in sizes if k is not None)] + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        full |= more
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        assert r.target == pytest.approx(3 * sizes[r.source] if r.source in full else level * weight[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for r in got:
        assert abs(taken[r.source] - r.target) <= 400
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 5)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    got = mixing.mix(docs(spark, [(i, "w " * (i % 7 + 1), None, "ab"[i % 2]) for i in range(200)])).collect()
    for s in "ab":
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 7


def test_mixing_repeated_rows_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 50)
    monkeypatch.setattr(mixing, "REPEATS", 7)
    rows = [(None, "a b c", None, "hot")] * 1000 + [(i, "w " * (1 + i % 5), None, f"s{i % 40:03d}") for i in range(400)]
    df = docs(spark, rows).repartition(6)
    apart = mixing._told_apart(mixing.sizes(df))
    assert apart.filter("source = 'hot'").select("copy").distinct().count() == 1000 and apart.count() == len(rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(2)).collect()))
    hot = [r for r in got if r.source == "hot"]
    assert len(hot) == 1000 and abs(sum(r.taken for r in hot) - hot[0].target) <= 3
    level = {s: r.target for r in got for s in [r.source]}
    free = [s for s in sorted(level) if level[s] < 3 * next(r.source_size for r in got if r.source == s) - 1e-9]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(level))}
    assert len({round(level[s] / weight[s], 6) for s in free}) == 1


def test_pivot_keeps_expectations():
    rng, size = np.random.default_rng(0), np.sort(np.random.default_rng(1).integers(1, 900, 25))[::-1].astype(float)
    p0, total, runs = rng.random(25), np.zeros(25), 4000
    for _ in range(runs):
        p = p0.copy()
        out, held = mixing.pivot_round(p, size, rng.random(25))
        assert (out[np.arange(25) != held] >= 0).all()
        whole = np.where(out < 0, p, out)
        assert (whole * size).sum() == pytest.approx((p0 * size).sum())
        total += np.where(out < 0, rng.random(25) < p, out)
    assert np.abs(total / runs - p0).max() < 0.05


def test_language(spark):
    rng = random.Random(2)
    kinds = {"x": "abcde ", "y": "cdefg ", "z": "éàùab "}
    rows = [(i, "".join(rng.choices(kinds[k], k=rng.randint(30, 300))), k, None) for i in range(600) for k in [rng.choice("xyz")]]
    rows += [(1000, None, "x", None), (1001, "", "x", None), (1002, "123 !?", "x", None), (1003, "Жuk", None, None), (None, "abc", "x", None)]
    df = docs(spark, rows)
    model = language.fit(df, per_language=60)
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    held = [r for r in rows[:600] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == k for i, _, k, _ in held]) > 0.98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and got[1003].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(df, language.fit(df.limit(0))).filter("lang_pred <> 'und'").count() == 0
    assert df.select(language.fold("doc_id").alias("f"), "doc_id").filter(F.col("doc_id").isNotNull() & (F.col("f") == 2)).count() >= len(held)


def by_definition(samples, tested, order, least):
    """Code lengths in bits by the definition: method C with exclusion over string counts, one symbol at a time."""
    fold = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t)
    texts = {x: [b" " * order + fold(t) for t in ts if t] for x, ts in samples.items()}
    alphabet = sorted({b for ts in texts.values() for t in ts for b in t}) + [None]
    counts = {x: {} for x in texts}
    for x, ts in texts.items():
        for t in ts:
            for i in range(order, len(t)):
                for k in range(order + 1):
                    at = counts[x].setdefault(t[i - k : i], {})
                    at[t[i]] = at.get(t[i], 0) + 1

    def known(context):
        return len(context) < 3 or known(context[1:]) and max(sum(c.get(context, {}).values()) for c in counts.values()) >= least

    def probability(x, symbol, context):
        seen = counts[x].get(context, {})
        lower = (lambda s: probability(x, s, context[1:])) if context else (lambda s: 1 / len(alphabet))
        if not seen:
            return lower(symbol)
        n, d = sum(seen.values()), len(seen)
        if d == len(alphabet):
            return seen[symbol] / n
        if symbol in seen:
            return seen[symbol] / (n + d)
        return d / (n + d) * lower(symbol) / (1 - sum(lower(s) for s in seen))

    out = []
    for t in tested:
        t, bits = b" " * order + fold(t), {x: 0.0 for x in texts}
        for i in range(order, len(t)):
            # a byte never seen is the last symbol, in contexts too, where it has no counts
            context = next(t[i - k : i] for k in range(order, -1, -1) if known(t[i - k : i]) and all(any(t[i - m : i] in c for c in counts.values()) for m in range(1, k + 1)))
            symbol = t[i] if t[i] in alphabet else None
            for x in bits:
                bits[x] -= math.log2(probability(x, symbol, context))
        out.append([bits[x] for x in sorted(bits)])
    return np.array(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_code_lengths_are_exact(monkeypatch, seed):
    rng = random.Random(seed)
    say = lambda letters, n: "".join(rng.choice(letters) for _ in range(n)).encode()
    samples = {"a": [b"Abracadabra " * 4, say("abcr ", 60), b""], "b": [b"banana bandana " * 3, say("abn d", 60)], "c": [b"aab"]}
    tested = [b"abra banana", b"", b"qq abra", b"BANANA" * 5, b"x", say("abcdnr q", 50), "é a".encode()]
    monkeypatch.setattr(language, "LEAST", 3)
    model = language.train(samples)
    buf, at, _ = text.texts_of(pa.array([t.decode() for t in tested]))
    whole = language.code_lengths(model, buf, at)
    assert np.allclose(whole, by_definition(samples, tested, 4, 3), atol=1e-3)
    p = np.exp2(-model.bits.astype(float)).reshape(-1, model.alphabet, 3).sum(1)
    assert np.allclose(p, 1, atol=1e-4)
    for block in (5, 7, 64):
        monkeypatch.setattr(language, "BLOCK", block)
        assert np.allclose(language.code_lengths(model, buf, at), whole)


def test_models_of_many_languages_fit_their_budget(monkeypatch):
    rng = random.Random(3)
    alphabet = [chr(c) for c in [*range(97, 123), *range(0xE0, 0x100), *range(0x430, 0x450)]]
    vocabulary = {f"l{k:02d}": ["".join(rng.choices(rng.sample(alphabet, 30), k=rng.randint(2, 9))) for _ in range(300)] for k in range(32)}
    say = lambda x, n: " ".join(rng.choices(vocabulary[x], k=n)).encode()
    samples = {x: [say(x, 60) for _ in range(25)] for x in vocabulary}
    monkeypatch.setattr(language, "MODEL_BYTES", 8 << 20)
    model = language.train(samples)
    assert 4 << 20 < model.bits.nbytes + model.child.nbytes <= 8 << 20
    tested = [(x, say(x, 30)) for x in vocabulary for _ in range(3)]
    buf, at, _ = text.texts_of(pa.array([t.decode() for _, t in tested]))
    assert language.predict_batch(model, buf, at)[0] == [x for x, _ in tested]
    p = np.exp2(-model.bits.astype(float)).reshape(-1, model.alphabet, 32).sum(1)
    assert np.allclose(p, 1, atol=1e-4)
    # the least budget leaves order 0
    monkeypatch.setattr(language, "MODEL_BYTES", 1)
    assert language.train(samples).bits.shape[0] == language.train(samples).alphabet


def test_long_training_texts_come_in_pieces(spark):
    rows = [(i, f"{'abc ' * 50}{i}" + " xyz" * 3000, "x", None) for i in range(40)] + [(100 + i, "klm nop " * 20, "y", None) for i in range(40)]
    seen = {}
    plain = language.train
    try:
        language.train = lambda samples, fresh=None: seen.update(samples) or plain(samples, fresh)
        model = language.fit(docs(spark, rows), per_language=10, fresh=5, piece=100)
    finally:
        language.train = plain
    assert all(len(t) <= 100 for texts in seen.values() for t in texts) and len(seen["x"]) <= 10 and any(t.startswith(b"xyz") or b" xyz" in t for t in seen["x"])
    assert model.languages == ["x", "y"]


def test_noise_is_in_no_language(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 60))), "x", None) for i in range(400)]
    noise = [(1000 + i, "".join(rng.choice("klmnopqrstuvwxyz0123456789+/=") for _ in range(300)), None, None) for i in range(20)]
    odd = [(2000, rows[1][1] + " +49 123", None, None), (2001, "abc", None, None), (2002, "", None, None), (2003, None, None, None)]
    df = docs(spark, rows + noise + odd)
    kept = {r.doc_id for r in language.keep_identified(df, language.fit(df, per_language=100)).collect()}
    assert kept == set(range(400)) | {2000, 2001}


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    rows = [None, "", "one line", "a\n\n\nb\n", "naïve 日本\r\n\n  x\ty\n", "\n \n"]
    df = docs(spark, [(i, t, None, None) for i, t in enumerate(rows)] + [(None, "x", None, None)])
    got = token_counts.count_tokens(df, ranks, public.PATTERN, rule=rule).collect()
    for i, t in enumerate(rows):
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
        assert [(r.start, r.end) for r in mine] == spans(t or "")
        assert sum(r.n_tokens for r in mine) == pytest.approx(len(enc.encode_ordinary(t or "")))
        if rule == "start" and t:
            firsts = enc.decode_with_offsets(enc.encode_ordinary(t))[1]
            assert [r.n_tokens for r in mine] == [sum(a <= f < b for f in firsts) for a, b in spans(t)]
    assert token_counts.count_tokens(df.limit(0), ranks, public.PATTERN).count() == 0


def test_token_counts_of_long_and_repeated_texts(spark):
    """More rows and lines than one step takes, and one text of very many lines."""
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    long = "".join(f"line {k} é\n" for k in range(30_000))
    rows = [(7, "twice\nthe same", None, None)] * 600 + [(8, long, None, None)]
    got = token_counts.count_tokens(docs(spark, rows).repartition(1), ranks, public.PATTERN).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("lines")).collect()
    assert {r.doc_id: (r.n, r.lines) for r in got} == {7: (600 * len(enc.encode_ordinary("twice\nthe same")), 1200), 8: (len(enc.encode_ordinary(long)), 30_000)}


def test_long_texts_of_many_words_encode_like_the_library(spark, spec):
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(public.path("word_bpe_49k.json")), random.Random(8)
    long = " ".join("".join(rng.choices("abcdefghijé'", k=rng.randint(1, 9))) for _ in range(40_000))
    got = bpe.encode(docs(spark, [(1, long, None, None)]), spec).first()
    ids = lib.encode(long, add_special_tokens=False).ids
    assert got.n_tokens == len(ids) and got.ids == " ".join(map(str, ids)) and got.decoded == lib.decode(ids, skip_special_tokens=False)


def test_equal_code_lengths_and_repeated_rows(spark):
    """Languages with the same texts: the first by code point, with an even score; every row has its own prediction."""
    both = [b"one two three four " * 3] * 4
    model = language.train({"b": both, "a": both, "Z": both})
    rows = [(1, "two three", None, None)] * 5 + [(None, "four four", None, None), (2, "one two " * 300_000, None, None)]
    got = language.predict(docs(spark, rows), model).collect()
    assert [r.lang_pred for r in got] == ["Z"] * 7 and all(r.score == pytest.approx(1 / 3) for r in got)


def spans(t):
    out, at = [], 0
    for line in t.split("\n")[:-1]:
        out.append((at, at + len(line) + 1))
        at += len(line) + 1
    return out + [(at, len(t))] if at < len(t) or not out else out


def test_attribution_rules():
    ends, bounds = np.array([4, 10]), np.array([0, 3, 8, 10])
    assert token_counts.attribute(ends, bounds, "start")[0].tolist() == [1, 1, 0]
    assert token_counts.attribute(ends, bounds, "majority")[0].tolist() == [1, 1, 0]
    assert token_counts.attribute(ends, bounds, "split")[0] == pytest.approx([0.75, 0.25 + 4 / 6, 2 / 6])
    assert [token_counts.attribute(ends, bounds, r)[0].sum() for r in token_counts.RULES] == pytest.approx([2] * len(token_counts.RULES))
