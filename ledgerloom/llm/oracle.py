"""DuckDB SQL of the queries that SQL can express (the others are tested against brute force in tests/llm)."""

from __future__ import annotations

from .queries import CONFLICT
from .url_filter import SUFFIX_RULES

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - least(3, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS sh FROM p),
n AS (SELECT w.doc_id, count(s.sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY ALL),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b USING (sh) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.v), n.doc_id)) AS component_id
FROM n LEFT JOIN reach r ON r.u = n.doc_id GROUP BY n.doc_id, n.n
"""

OP4 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONFLICT}' UNION ALL SELECT -1, 1, 'assistant', '{CONFLICT}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|(im_start|im_end)\|>', '<\\\1|\2|>', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

def _op5(z: float = 1.64, low: int = 1, high: int = 1000) -> str:
    """Sites and suffixes by joining the suffix rules, then one shrinkage a level; verdicts by rule, else by bound."""
    rules = ", ".join(f"('{r}')" for r in SUFFIX_RULES)
    levels = []
    for name, keys, keep, join, mean in (("s", "suffix", "suffix", "", "(SELECT a / (a + b) FROM world)"),
                                         ("d", "domain, suffix", "domain, suffix", "JOIN ps USING (suffix)", "a / (a + b)"),
                                         ("h", "host, domain", "host", "JOIN (SELECT domain, a, b FROM pd) USING (domain)", "a / (a + b)")):
        levels.append(f"""
n{name} AS (SELECT g.*, {mean} AS m FROM (SELECT {keys}, sum(n) AS n, sum(bad) AS bad FROM c GROUP BY ALL) g {join}),
r{name} AS (SELECT CASE WHEN sum(n - 1) > 0 AND sum((n - 1) * m * (1 - m)) > 0
  THEN sum(n * power(bad / n - m, 2) - m * (1 - m)) / sum((n - 1) * m * (1 - m)) END AS rho FROM n{name}),
k{name} AS (SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, {low}), {high}) ELSE {high} END AS k FROM r{name}),
p{name} AS (SELECT {keep}, k * m + bad AS a, k * (1 - m) + n - bad AS b FROM n{name}, k{name})""")
    return rf"""
WITH u AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hosts AS (SELECT DISTINCT host, rtrim(regexp_replace(string_split(host, '@')[-1], ':[0-9]*$', ''), '.') AS site FROM u),
rules(r) AS (VALUES {rules}),
fit AS (SELECT host, max(CASE WHEN r[1] = '!' THEN len(string_split(r, '.')) - 1 END) AS exception, max(CASE WHEN r[1] <> '!' THEN len(string_split(r, '.')) END) AS plain
  FROM hosts JOIN rules ON CASE WHEN r[1:2] = '*.' THEN ends_with(site, r[2:]) AND len(string_split(site, '.')) >= len(string_split(r, '.'))
    ELSE site = ltrim(r, '!') OR ends_with(site, '.' || ltrim(r, '!')) END GROUP BY host),
parts AS (SELECT host, site, string_split(site, '.') AS l, coalesce(exception, plain, 1) AS k FROM hosts LEFT JOIN fit USING (host)),
sites AS (SELECT host,
  CASE WHEN regexp_full_match(site, '\[.*\]|[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}') THEN site ELSE array_to_string(l[greatest(len(l) - k + 1, 1):], '.') END AS suffix,
  CASE WHEN regexp_full_match(site, '\[.*\]|[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}') THEN site ELSE array_to_string(l[greatest(len(l) - k, 1):], '.') END AS domain FROM parts),
c AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, CAST(count(*) AS DOUBLE) AS n,
  CAST(sum(CAST(toxic = 1 OR quality = 0 AS INTEGER)) AS DOUBLE) AS bad
  FROM u JOIN labels ON doc_id = page_id JOIN sites USING (host) WHERE (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY host),
world AS (SELECT coalesce(sum(bad), 0) + 1 AS a, coalesce(sum(n - bad), 0) + 1 AS b FROM c),{",".join(levels)},
post AS (SELECT host, coalesce(ph.a, pd.a, ps.a, (SELECT a FROM world)) AS a, coalesce(ph.b, pd.b, ps.b, (SELECT b FROM world)) AS b
  FROM sites LEFT JOIN ph USING (host) LEFT JOIN pd USING (domain) LEFT JOIN ps ON ps.suffix = sites.suffix),
bound AS (SELECT host, a / (a + b) AS mean, a / (a + b) - {z} * sqrt(a * b / (power(a + b, 2) * (a + b + 1))) AS low FROM post),
v AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, v.host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(mean, 6) AS bad_rate, round(low, 6) AS bad_bound
FROM v JOIN bound USING (host)
"""


OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP7 = rf"""
WITH word AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS p),
b AS (SELECT item_id, regexp_extract_all(coalesce({_LOWER}, ''), p) AS ws FROM benchmark, word),
d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), p) AS ws FROM documents, word),
bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

OP10 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"


def _op12(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Each round is an assignment (a) and a new codebook (c)."""
    steps = [f"""
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rn, vec_id, label,
  list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE {_WHOLE}),
x AS MATERIALIZED (SELECT rn, p, e[p * (len(e) // {parts}) + 1:(p + 1) * (len(e) // {parts})] AS s FROM v, (SELECT unnest(range({parts})) AS p)),
c0 AS MATERIALIZED (SELECT p, rn - 1 AS j, s AS c FROM x WHERE rn <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT rn, p, any_value(s) AS s, CAST(min(d * {entries} + j) AS BIGINT) // {entries} AS d, CAST(min(d * {entries} + j) AS BIGINT) % {entries} AS j
  FROM (SELECT rn, x.p, s, j, list_sum(list_transform(range(1, len(s) + 1), lambda i: (s[i] - c[i]) * (s[i] - c[i]))) AS d FROM x JOIN c{k} c ON c.p = x.p) GROUP BY rn, p)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (SELECT p, j, list(m ORDER BY i) AS c FROM (
  SELECT p, j, i, CAST(floor(CAST(sum(s[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT p, j, s, unnest(range(1, len(s) + 1)) AS i FROM a{k}) GROUP BY p, j, i) GROUP BY p, j),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.j, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.j = c.j)""")
    return "WITH " + ",".join(steps) + f""",
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS digest FROM c{rounds}),
r AS (SELECT rn, string_agg(printf('%02x', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rn)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM v JOIN r ON r.rn = v.rn, b
"""


OP13 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]', 0, 's') AS us,
  list_transform(range(4), lambda i: CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT)) AS h FROM t),
k AS (SELECT *, len(us) AS n, least(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS a, greatest(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
  WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:n], '') AS suf FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f
"""

ORACLE_SQL = {"op2_ngram_jaccard": OP2, "op4_chat_format": OP4, "op5_url_filter": _op5(), "op6_topk_search": OP6, "op7_decontaminate": OP7, "op10_warc": OP10, "op12_vector_codes": _op12(),
              "op13_fill_middle": OP13}
