"""DuckDB SQL for those queries of this subpackage that SQL expresses: plain, quadratic where need be."""

from __future__ import annotations

import math

from tessera.llm import licenses

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

NGRAM_JACCARD = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS s FROM w, unnest(range(1, greatest(len(words) - 2, 2))) AS r(i) WHERE len(words) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN ways l ON l.a = r.seen)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id FROM reach r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""

_TERMS = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"

LEXICAL_SEARCH = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {_TERMS.format(_LOW)} AS terms FROM documents),
l AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
tf AS MATERIALIZED (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(terms) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, l GROUP BY t, n),
q AS (SELECT item, item_id, unnest(list_distinct({_TERMS.format(_LOW)})) AS t FROM (SELECT row_number() OVER () AS item, * FROM benchmark)),
s AS (SELECT item, item_id, d.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(terms) * n) // l)))) AS BIGINT) AS score
 FROM q JOIN w USING (t) JOIN tf USING (t) JOIN d USING (id), l GROUP BY item, item_id, id, d.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""


def _license_scan() -> str:
    split = lambda t: f"list_filter(regexp_split_to_array({t}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    starts = []
    for phrase, label in licenses.PHRASES.items():
        p = licenses.words_of(phrase)
        same = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(p))
        starts.append((label, f"list_filter(range(1, len(words) - {len(p)} + 2), lambda i: {same})"))
    base = ", ".join(f"{s} AS at_{label}" for label, s in starts)
    every = " || ".join(f"at_{label}" for label, _ in starts)
    held = "list_filter([" + ", ".join(f"CASE WHEN len(at_{label}) > 0 THEN '{label}' END" for label, _ in starts) + "], lambda x: x IS NOT NULL)"
    rows = []
    for label, texts in licenses.TEMPLATES.items():
        for t in texts:
            every_word = licenses.words_of(t)
            words = sorted(set(every_word))
            rows.append(f"('{label}', {licenses.step_of(every_word)}, {words!r}, {math.ceil(licenses.CONTAINMENT * len(words) - 1e-9)})")
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {_LOW} AS low FROM documents),
b AS MATERIALIZED (SELECT id, doc_id, words, {base} FROM (SELECT id, doc_id, {split('low')} AS words FROM d)),
t(label, step, terms, need) AS (VALUES {', '.join(rows)}),
blocks AS (SELECT id, step, list_distinct(words[i * step + 1:(i + 2) * step]) AS block FROM b, (SELECT DISTINCT step FROM t), unnest(range(0, (len(words) + step - 1) // step)) AS r(i)),
hits AS (SELECT id, label, len(list_intersect(block, terms)) AS k, need, len(terms) AS n FROM blocks JOIN t USING (step)),
m AS (SELECT id, list(DISTINCT label) AS quoted, max(k / n::DOUBLE) AS share FROM hits WHERE k >= need GROUP BY id),
f AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, {every} AS every, {held} AS held, coalesce(quoted, []) AS quoted, share FROM b LEFT JOIN m USING (id))
SELECT doc_id, n_words, CAST(len(every) AS BIGINT) AS n_base, list_min(every) - 1 AS first_word, list_max(every) - 1 AS last_word, array_to_string(list_sort(held), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(held || quoted)), ',') AS labels, CASE WHEN len(every) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score FROM f
"""


LICENSE_SCAN = _license_scan()


def _merkle_manifest() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda n: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    step = "i"
    for _ in range(8):
        step = f"xor(({step}) >> 1, 3988292384 * (({step}) & 1))"
    return f"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, {step} AS v FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS id, doc_id, lang, {leaf('n_chars')} AS leaf, {leaf('(CAST(n_chars AS HUGEINT) + 1)')} AS other,
 xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))) % 7 = 0 AS hit FROM documents, t),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
low(lvl, lang, pos, n, h) AS (SELECT 0, lang, pos, n, leaf FROM p UNION ALL SELECT lvl + 1, lang, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lvl, lang, pos // 2, n),
subs AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
top(lvl, pos, n, h) AS (SELECT 0, pos, n, subroot FROM subs UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n),
rt AS (SELECT h AS root FROM top WHERE n = 1),
hs AS (SELECT lang, max(lvl) AS height FROM low GROUP BY lang),
up AS MATERIALIZED (SELECT p.id, s.lvl, s.h, s.pos < (p.pos >> s.lvl) AS before FROM p JOIN low s ON s.lang IS NOT DISTINCT FROM p.lang AND s.n > 1 AND s.pos = xor(p.pos >> s.lvl, 1)
 UNION ALL SELECT p.id, hs.height + s.lvl, s.h, s.pos < (u.pos >> s.lvl) FROM p JOIN hs ON hs.lang IS NOT DISTINCT FROM p.lang JOIN subs u ON u.lang IS NOT DISTINCT FROM p.lang JOIN top s ON s.n > 1 AND s.pos = xor(u.pos >> s.lvl, 1)),
ht AS (SELECT max(lvl) AS height FROM top),
fold(id, lvl, stop, h) AS (SELECT p.id, 0, hs.height + ht.height, CASE WHEN hit AND other IS NOT NULL THEN other ELSE leaf END FROM p JOIN hs ON hs.lang IS NOT DISTINCT FROM p.lang, ht
 UNION ALL SELECT f.id, f.lvl + 1, f.stop, sha256(CASE WHEN u.before THEN u.h ELSE '' END || f.h || CASE WHEN NOT u.before THEN u.h ELSE '' END) FROM fold f LEFT JOIN up u ON u.id = f.id AND u.lvl = f.lvl WHERE f.lvl < f.stop),
proofs AS (SELECT id, string_agg(h, '' ORDER BY lvl) AS path FROM up GROUP BY id)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(path, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM p JOIN fold f ON f.id = p.id AND f.lvl = f.stop JOIN subs s ON s.lang IS NOT DISTINCT FROM p.lang LEFT JOIN proofs q ON q.id = p.id, rt
"""


MERKLE_MANIFEST = _merkle_manifest()
