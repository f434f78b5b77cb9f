"""DuckDB SQL for the queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: kind, expression, group whose length counts, and that length.
_SECRETS = [
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1),
]
_FOUND = " UNION ALL ".join(
    f"SELECT r, {i} AS rank, '{kind}' AS kind, {least} AS least, regexp_extract_all(x, '{rx}', 0) AS m, regexp_extract_all(x, '{rx}', {group}) AS c, string_split_regex(x, '{rx}') AS g FROM t"
    for i, (kind, rx, group, least) in enumerate(_SECRETS)
)

OP2 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
f AS ({_FOUND}),
p AS (SELECT r, rank, kind, least, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(c) AS c, unnest(g[1 : len(m)]) AS g FROM f WHERE len(m) > 0),
q AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY r, rank ORDER BY i) AS z FROM p),
s AS (SELECT r, kind, z - length(m) AS a, rank, concat_ws(':', kind, CAST(z - length(m) AS BIGINT), CAST(z AS BIGINT)) AS span FROM q WHERE length(c) >= least),
w AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY a, rank) FILTER (kind <> 'pem') AS base, string_agg(span, ',' ORDER BY a, rank) AS spans
  FROM s GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN w USING (r)
"""

OP6 = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), grams AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS gram
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM grams),
windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, lengths WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, h.n, item FROM windows h JOIN grams g ON g.gram = h.gram AND g.n = h.n),
marked AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN marked USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p WHERE strlen(body) >= 100 GROUP BY body)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (body)
"""

_SPANS = """
m AS (SELECT s, min(doc_id) AS f FROM w GROUP BY s),
h AS (SELECT doc_id, i, i > 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM w JOIN m USING (s) WHERE doc_id > f),
g AS (SELECT doc_id, i, count(*) FILTER (gap) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM h),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY doc_id, k),
cuts AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans)
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents),
w AS (SELECT doc_id, i, array_to_string(x[i + 1 : i + 50], ' ') AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) - 49)) AS i FROM d WHERE len(x) >= 50)),
{_SPANS},
k AS (
  SELECT doc_id, sum(z - a) AS n_removed, flatten(list(x[p + 1 : a] ORDER BY a)) || any_value(x)[max(z) + 1 :] AS kept
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(coalesce(kept, x), ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, x[2 * i + 1 : 2 * i + 100] AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
{_SPANS},
k AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans,
         string_agg(x[2 * p + 1 : 2 * a], '' ORDER BY a) || any_value(x)[2 * max(z) + 1 :] AS kept
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_WHOLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_WHOLE_NUMBERS = "list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"


def _op11(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assignment and means, written out one after the other."""
    steps = [
        f"""
v AS (SELECT vec_id, label, {_WHOLE_NUMBERS.format(scale=4096)} AS e FROM embeddings WHERE {_WHOLE}),
p AS (SELECT vec_id, part, e[part * (len(e) // {parts}) + 1 : (part + 1) * (len(e) // {parts})] AS x FROM v, range({parts}) AS r(part)),
c0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS y
  FROM p WHERE vec_id IN (SELECT DISTINCT vec_id FROM v ORDER BY vec_id LIMIT {entries})
)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (
  SELECT vec_id, part, any_value(x) AS x, min(struct_pack(d := d, entry := entry)) AS m
  FROM (SELECT vec_id, part, x, entry, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{r} USING (part))
  GROUP BY vec_id, part
)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS (
  SELECT part, entry, coalesce(z, y) AS y FROM c{r} LEFT JOIN (
    SELECT part, entry, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS z FROM (
      SELECT part, entry, i, sum(c) AS s, count(*) AS n
      FROM (SELECT part, m.entry AS entry, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY part, entry, i
    ) GROUP BY part, entry
  ) USING (part, entry)
)""")
    return f"""
WITH {",".join(steps)},
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error
  FROM a{rounds} JOIN v USING (vec_id) GROUP BY vec_id
),
books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
"""


#: For pages whose article is one element without boilerplate, scripts or nested blocks inside: such are the test pages.
OP12 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, unnest(string_split_regex(body, '</?(?:h1|p)>')) AS line, generate_subscripts(string_split_regex(body, '</?(?:h1|p)>'), 1) AS i FROM a),
c AS (
  SELECT page_id, i, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(line, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&quot;', '"', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS line
  FROM (SELECT page_id, i, regexp_replace(line, '&amp(;|\b)', '&amp;', 'g') AS line FROM b)
), t AS (SELECT page_id, string_agg(line, chr(10) ORDER BY i) AS text FROM c WHERE line <> '' GROUP BY page_id)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM a LEFT JOIN t USING (page_id)
"""

OP13 = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, {_WHOLE_NUMBERS.format(scale=256)} AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_WHOLE}
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), pos AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLES = {
    "op2_secret_scan": OP2,
    "op4_substring_dedup": OP4,
    "op9_suffix_array_dedup": OP9,
    "op7_warc": OP7,
    "op6_decontamination": OP6,
    "op11_vector_codes": _op11(),
    "op12_html_text": OP12,
    "op13_hard_negatives": OP13,
}
