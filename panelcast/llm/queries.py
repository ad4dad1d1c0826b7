"""Registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from panelcast.llm.binary import op1_token_binary
from panelcast.llm.decontaminate import op5_decontamination
from panelcast.llm.lexical import op13_lexical_scan
from panelcast.llm.minhash import op8_chosen_path
from panelcast.llm.packing import op10_best_fit_packing
from panelcast.llm.pii import op9_pii_surrogates
from panelcast.llm.pivots import op7_pivot_permutation
from panelcast.llm.quality import op3_quality_discriminant
from panelcast.llm.rules import STOP_WORDS, op12_quality_rules
from panelcast.llm.substrings import op4_superkmer_dedup
from panelcast.llm.toxicity import op6_subsequence_svm
from panelcast.llm.tries import op11_burst_trie
from panelcast.llm.warc import op2_warc_transactions

QUERIES = {
    "op1_token_binary": op1_token_binary,
    "op2_warc_transactions": op2_warc_transactions,
    "op3_quality_discriminant": op3_quality_discriminant,
    "op4_superkmer_dedup": op4_superkmer_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_subsequence_svm": op6_subsequence_svm,
    "op7_pivot_permutation": op7_pivot_permutation,
    "op8_chosen_path": op8_chosen_path,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_burst_trie": op11_burst_trie,
    "op12_quality_rules": op12_quality_rules,
    "op13_lexical_scan": op13_lexical_scan,
}

_BLANK_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)

SQL = {
    "op2_warc_transactions": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
q AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS low FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN low <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN low <> page_id THEN low END AS refers_to,
  '<urn:request:' || page_id || '>' AS request_id, '<urn:metadata:' || page_id || '>' AS metadata_id
FROM q""",
    "op4_superkmer_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK_WORDS}) AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d)),
low AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM win JOIN low USING (s) WHERE low < doc_id),
pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS k, count(*) AS n
  FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
win AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM pat))),
hit AS (SELECT doc_id, i, win.m, item_id FROM win JOIN pat ON win.m = pat.m AND win.s = pat.s),
words AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hit),
n AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_pivot_permutation": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)""",
    "op8_chosen_path": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_BLANK_WORDS}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)""",
    "op11_burst_trie": """
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, 0 AS i, 4294967295 AS crc FROM ids
  UNION ALL
  SELECT conv_id, i + 1, list_reduce([xor(crc, ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
  FROM crc WHERE i < length(conv_id::VARCHAR)),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(crc, 4294967295) % 6 AS h FROM crc WHERE i = length(conv_id::VARCHAR)),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
joined AS (
  SELECT h.conv_id, 0 AS own, p, role, text FROM h JOIN t ON t.conv_id = h.base AND p < h
  UNION ALL SELECT h.conv_id, 1, p, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND p >= h),
r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS d, length(text) AS chars,
    length(role) || ':' || length(text) || ':' || role || text AS s FROM joined),
step AS (
  SELECT conv_id, d, chars, sha256(string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k,
    coalesce(sha256(string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '') AS up
  FROM r
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM ids),
long AS (SELECT conv_id, max(d) AS len FROM step GROUP BY conv_id),
node AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, any_value(up) AS up,
    sha256(coalesce(string_agg(CASE WHEN d = len THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM step JOIN long USING (conv_id) GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY up),
under(top, k, d) AS (SELECT k, k, d FROM node UNION ALL SELECT under.top, node.k, node.d FROM under JOIN node ON node.up = under.k AND node.d = under.d + 1),
sums AS (
  SELECT top, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
  FROM under JOIN node USING (k) LEFT JOIN kids USING (k) GROUP BY top)
SELECT a.conv_id, a.d::BIGINT AS depth, b.conv_id AS parent_conv_id, a.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
  n_leaves, saved_tokens, a.ends_sha256
FROM node a LEFT JOIN node b ON b.k = a.up LEFT JOIN kids ON kids.k = a.k JOIN sums ON sums.top = a.k""",
    "op12_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_BLANK_WORDS}) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
rep AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE times > 1) GROUP BY doc_id),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({_STOP_LIST}))) AS stop, len(lines) AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•‣]'))) AS bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses
  FROM d LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * word_chars BETWEEN 300 * n_words AND 1000 * n_words AND 100 * n_symbols <= 10 * n_words
    AND 100 * stop >= 3 * n_words AND 100 * n_dup_lines <= 40 * n_lines AND 100 * bullets <= 90 * n_lines
    AND 100 * ellipses <= 30 * n_lines AS kept
FROM v""",
    "op13_lexical_scan": f"""
WITH d AS (
  SELECT doc_id, {_TERMS} AS w FROM documents),
b AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest({_TERMS}) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
c AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM b) GROUP BY ALL),
wt AS (
  SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))))::BIGINT AS score
  FROM tf JOIN wt USING (term) JOIN b USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10""",
}
