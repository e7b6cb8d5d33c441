import base64
import hashlib
import json
import random
import struct

import pytest

from lakewright.llm import chat, warc

ROWS = "conv_id long, turn long, role string, text string, n int"


def test_escape_is_reversible():
    rng = random.Random(0)
    bits = [*chat.CONTROL, chat.ESCAPE, "<", "s>", "[", "/INST]", "x", " ", "é"]
    for _ in range(5000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


def test_conversations(spark):
    rng = random.Random(1)
    bits = [*chat.CONTROL, chat.ESCAPE, "hello", " ", "\n", "😀"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "<s>", None]), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 6)))]), 1) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, 1, "user", "no id", 1), (None, 0, "assistant", "first", 1), (7, None, "user", "null turn", 1), (7, 1, "user", "tie b", 1), (7, 1, "user", "tie a", 1), (7, 1, "user", "tie a", 1)]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    pieces = chat.format_conversations(df.unionByName(chat.probe(spark).selectExpr("*", "1 AS n")))
    got = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]", 1), (-7, 1, "assistant", "</s>[INST] ok [/INST]", 1)]
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for c, rs in by.items():
        rs.sort(key=lambda r: [(x is not None, x) for x in r[1:4]])
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rs)
        loss = "".join(r[3] or "" for r in rs if r[2] == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(rs), hashlib.sha256(turns.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {}
    for r in sorted(pieces.collect(), key=lambda r: r.n):
        assert r.start == len(whole.get(r.conv_id, ""))
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.piece
    assert all(got[c].formatted_chars == len(t) for c, t in whole.items())
    assert {r.conv_id: r.text for r in chat.conversations(pieces).collect()} == whole
    with pytest.raises(ValueError):
        chat.conversations(pieces, most_chars=10)
    mixed = chat.read_back(pieces.repartition(3, "role").sortWithinPartitions("n")).collect()
    assert {r.conv_id: r for r in mixed} == got
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_typed_parts(spark):
    content = json.dumps([{"type": "text", "text": "see <image> "}, {"type": "image", "ref": "i1", "size": [1024, 600]}, {"type": "audio", "ref": "a1", "size": [2.5]}, {"type": "document", "ref": "d1", "size": [3]}, {"type": "text", "text": "?"}])
    df = spark.createDataFrame([(1, 0, "user", content, 1), (1, 1, "assistant", '[{"type": "text", "text": "ok"}]', 1)], ROWS)
    first, second = chat.format_conversations(df, parts_json=True).orderBy("n").collect()
    assert first.piece == "<s>[INST] see <␛image> <image><audio><document>? [/INST]"
    assert [(a.ref, a.kind, a.tokens) for a in first.attachments] == [("i1", "image", 256), ("a1", "audio", 75), ("d1", "document", 768)]
    assert [first.piece[a["at"] :].startswith(chat.PLACEHOLDERS[a.kind]) for a in first.attachments] == [True] * 3
    assert (first.piece + second.piece)[second.loss_from : second.loss_to] == "ok"
    one = chat.conversations(chat.format_conversations(df, parts_json=True)).first()
    assert one.text == first.piece + second.piece and [one.text[x["from"] : x["to"]] for x in one.loss_spans] == ["ok"] and [x.ref for x in one.attachments] == ["i1", "a1", "d1"]
    with pytest.raises(ValueError):
        chat.parts_of([{"type": "video"}])


PAGES = "page_id long, url string, html string, digest string, best int"


def test_archives(spark, tmp_path):
    rng = random.Random(4)
    htmls = [None, "", "<p>é</p>", *("<html>" + "word " * rng.randint(1, 900) + str(k) for k in range(40))]
    rows = [(i, rng.choice([None, f"http://x/{i}", "http://a\r\nb"]), rng.choice(htmls), "d", 1) for i in range(300)]
    rows += [(None, None, "<p>é</p>", "d", 1), (299, rows[299][1], rows[299][2], "d", 1)]
    df = spark.createDataFrame(rows, PAGES).repartition(4)
    archives = warc.write_archives(df, volume_bytes=20_000)
    got = warc.read_archives(archives).collect()
    best = {}
    for i, _, h, *_ in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, *_ in rows:
        data, top = (h or "").encode(), best[h or ""]
        new = i == top
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if new else "revisit", None if new else top))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    paths = warc.export_archives(archives, f"file://{tmp_path}/out")
    files = sorted((tmp_path / "out").glob("*.warc.zst"))
    assert len(paths) == len(files) > 1
    assert sum(1 for f in files for _ in warc.read_archive(f.read_bytes())) == len(rows)
    assert sorted(map(str, map(tuple, warc.read_archives(warc.load_archives(spark, f"file://{tmp_path}/out")).collect()))) == sorted(map(str, want))
    warc.save_archives(warc.write_archives(df.limit(0)), f"file://{tmp_path}/none")
    assert warc.read_archives(warc.load_archives(spark, f"file://{tmp_path}/none")).count() == 0


def test_archives_where_the_cluster_compresses_output(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"<p>{i % 3}</p>" * 50, "d", 1) for i in range(20)], PAGES)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.output.fileoutputformat.compress", "true")
    try:
        warc.save_archives(warc.write_archives(df), f"file://{tmp_path}/out")
        assert warc.read_archives(warc.load_archives(spark, f"file://{tmp_path}/out")).count() == 20
    finally:
        conf.unset("mapreduce.output.fileoutputformat.compress")


def test_a_record_larger_than_a_volume(spark):
    html = "".join(f"<p>{k * 7919 % 1_000_003}</p>" for k in range(1_400_000))
    df = spark.createDataFrame([(1, "u", html, "d", 1), (2, "v", "small", "d", 1)], PAGES)
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(df)).collect()}
    assert len(html) > 16 << 20 and got[1].payload_bytes == len(html) and got[2].payload_bytes == 5
    assert got[1].payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()


def test_few_and_long_records_have_a_dictionary(spark):
    df = spark.createDataFrame([(1, "u", "x" * 100, "d", 1), (2, None, "".join(f"<p>{k}</p>" for k in range(40_000)), "d", 1)], PAGES)
    samples = warc.sample_records(df)
    assert len(samples) == 5 and max(map(len, samples)) < 9000 and any(b"<p>39999</p>" in x for x in samples)
    assert warc.train_dictionary(samples[:2]) and warc.train_dictionary([]) == b""
    contents = [bytes(r.content) for r in warc.write_archives(df).collect()]
    assert all(struct.unpack_from("<II", c)[1] > 0 for c in contents) and sum(len(list(warc.read_archive(c))) for c in contents) == 2


def test_dictionary_helps():
    records = [b"<html><head><title>page %d</title></head><body>%s</body></html>" % (k, bytes(f"{k * 7919}", "ascii") * 30) for k in range(200)]
    known = warc.train_dictionary(records)
    assert known and sum(len(warc.Writer(known).frame(r)) for r in records) < sum(len(warc.Writer(b"").frame(r)) for r in records)
    data = warc.dictionary_frame(known) + b"".join(warc.Writer(known).frame(r) for r in records)
    assert list(warc.read_archive(data)) == records
    with pytest.raises(ValueError):
        list(warc.read_archive(b"\0" * 20))
