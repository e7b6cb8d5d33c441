"""DuckDB SQL of the operators that SQL can express, over the whole tables."""

from __future__ import annotations

from lakewright.llm.chat import BOS, CONTROL, ESCAPE, FRAMES
from lakewright.llm.license_scan import LEAST_STRIDE, PERCENT, TEMPLATES, words_of

_WORD = r"[^\x20\x09-\x0D]+"

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

#: Equal vectors are compared like all others here.
OP2 = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, vec_id) AS component_id, coalesce(c.c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""

OP5 = f"""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 10"""

#: Shingles are texts of five words; the join counts shared ones pair by pair.
OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY 1), k AS (SELECT a, count(*) AS k FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.k, 0)::BIGINT AS n_links, coalesce(c.c, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.a = d.doc_id LEFT JOIN c ON c.a = d.doc_id"""

OP6 = f"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
s AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS least FROM s GROUP BY 1), hit AS (SELECT s.doc_id, s.i FROM s JOIN m ON s.h = m.h WHERE least < s.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM hit), g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
t AS (SELECT w.doc_id, unnest(w.w) AS word, unnest(range(1, len(w.w) + 1)) AS k FROM w JOIN g USING (doc_id)),
kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.k) FILTER (gone.k IS NULL) AS kept FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.k = t.k GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(CASE WHEN g.n IS NULL THEN coalesce(array_to_string(w.w, ' '), '') ELSE coalesce(kept.kept, '') END) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _extra(text: str) -> str:
    """Characters that escaping adds to a text: one for each control string or escape character, found from left to right."""
    pattern = "|".join("".join("\\" + c if c in "[]()|.*+?^$\\{}" else c for c in x) for x in sorted((*CONTROL, ESCAPE), key=len, reverse=True))
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _frame_length(role: str) -> str:
    known = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in FRAMES.items())
    return f"CASE {role} {known} END"


#: Roles other than the three framed ones do not occur in the table.
OP7 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, ({len(BOS)} + sum(len(text) + {_extra("text")} + {_frame_length("role")}))::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""

#: Base 32 from the hexadecimal digest: four bits a digit, five bits a letter.
_BASE32 = """array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: (((instr('0123456789abcdef', substr(h, ((5 * k + j) // 4 + 1)::BIGINT, 1)) - 1) >> (3 - (5 * k + j) % 4)::INTEGER) & 1) << (4 - j)::INTEGER))::BIGINT, 1)), '')"""

OP8 = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM p"""

OP11 = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS a, ('0x' || h[9:16])::BIGINT AS b, ('0x' || h[17:24])::BIGINT AS c, ('0x' || h[25:32])::BIGINT AS e FROM h),
k AS (SELECT *, least(a % (n + 1), b % (n + 1)) AS lo, greatest(a % (n + 1), b % (n + 1)) AS hi, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c % 100 >= 90 THEN 'plain' WHEN e % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _values(rows: list[tuple]) -> str:
    """Rows of strings, numbers and lists of words as SQL values."""

    def one(x) -> str:
        return "[" + ", ".join(map(one, x)) + "]" if isinstance(x, list) else "'" + x + "'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_PHRASES = _values([(t.label, words_of(t.text)) for t in TEMPLATES if t.phrase])
_NOTICES = _values([(t.label, sorted(set(words_of(t.text))), max(LEAST_STRIDE, 1 << (len(words_of(t.text)) - 1).bit_length())) for t in TEMPLATES if not t.phrase])

#: Every block against every template, by the words that both have.
OP12 = f"""WITH w AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
p(label, words) AS (VALUES {_PHRASES}), t(label, words, s) AS (VALUES {_NOTICES}),
x AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT k, label, i - 1 AS place FROM x JOIN p ON w[i] = words[1] AND w[i:i + len(words) - 1] = words),
a AS (SELECT k, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS labels FROM f GROUP BY k),
b AS (SELECT k, s, i * s AS start, w[i * s + 1:(i + 2) * s] AS b FROM (SELECT k, w, s, unnest(range(greatest((len(w) + s - 1) // s - 1, 1))) AS i FROM w, (SELECT DISTINCT s FROM t))),
c AS (SELECT k, label, len(list_intersect(words, b)) / len(words) AS share FROM b JOIN t USING (s) WHERE 100 * len(list_intersect(words, b)) >= {PERCENT} * len(words)),
m AS (SELECT k, list(DISTINCT label) AS labels, max(share) AS share FROM c GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(a.n, 0)::BIGINT AS n_base, a.lo AS first_word, a.hi AS last_word, coalesce(array_to_string(list_sort(a.labels), ','), '') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(coalesce(a.labels, []), coalesce(m.labels, [])))), ',') AS labels, greatest(CASE WHEN a.n > 0 THEN 1 ELSE 0 END, coalesce(m.share, 0))::DOUBLE AS score FROM w LEFT JOIN a USING (k) LEFT JOIN m USING (k)"""

#: crc32 byte by byte. Words replaced at a place share what is left without it; an inserted character leaves the shorter word.
OP13 = """WITH RECURSIVE z AS (SELECT list_transform(range(256), lambda k: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k)) AS z),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL),
c AS (SELECT run, n, length(run) AS l, xor(4294967295, list_reduce(flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + (ord(x) >> 6)::BIGINT, 128 + (ord(x) & 63)::BIGINT] END)), lambda c, b: xor(c >> 8, z[(xor(c, b) & 255) + 1]), 4294967295)) AS h FROM r, z),
w AS (SELECT word, sum(n)::BIGINT AS n, length(word) AS l FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % l) || substr(run, h % l + 2) ELSE run END AS word, n FROM c) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, l + 1)) AS i FROM w)),
e AS (SELECT DISTINCT d.word AS long, d.n AS long_n, w.word AS short, w.n AS short_n FROM d JOIN w ON w.word = d.rest),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION ALL SELECT long, long_n, short, short_n FROM e UNION ALL SELECT short, short_n, long, long_n FROM e),
f AS (SELECT word, n, count(*) AS n_near, max(m) AS m FROM p GROUP BY 1, 2),
g AS (SELECT f.word, f.n_near, min(p.other) FILTER (p.m = f.m AND p.m >= 2 * p.n) AS form, min(p.m) FILTER (p.m = f.m AND p.m >= 2 * p.n) AS form_n FROM f JOIN p ON p.word = f.word GROUP BY 1, 2),
s AS (SELECT word, word AS root, 0 AS step FROM w UNION ALL SELECT s.word, g.form, s.step + 1 FROM s JOIN g ON g.word = s.root WHERE g.form IS NOT NULL),
o AS (SELECT word, arg_max(root, step) AS root FROM s GROUP BY word)
SELECT w.word, g.form, o.root, w.n, coalesce(g.n_near, 0)::BIGINT AS n_near, g.form_n FROM w JOIN o ON o.word = w.word LEFT JOIN g ON g.word = w.word"""

ORACLE_SQL = {"op1_ngram_jaccard": OP1, "op2_embedding_neardup": OP2, "op5_topk": OP5, "op6_substring_dedup": OP6, "op7_chat": OP7, "op8_warc": OP8, "op11_fill_in_middle": OP11, "op12_license_scan": OP12, "op13_spelling_groups": OP13}
