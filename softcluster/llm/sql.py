"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

#: Op 3: windows of ten item words found among the documents' words.
DECONTAMINATE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(generate_series(1, len(w) - least(len(w), 10) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g FROM iw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, unnest(generate_series(1, len(w) - n + 1)) AS i, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM dw, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, item_id, i, dg.n FROM dg JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Op 5: the digests; the template's 21 characters a turn, and an escape sign in each control string.
CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
c AS (SELECT *, len(regexp_extract_all(text, '<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|<\\*\|(im_start|im_end|endoftext|turn|body|end)\|>')) AS extra FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text) + length(role) + extra + 24) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

#: Op 11: every anchor's score with every row.
HARD_NEGATIVES = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

#: Op 12: keys that ten documents or more hold lose their lines.
LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT r, doc_id, i, x[i] AS line, trim(translate(x[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
      FROM (SELECT *, unnest(generate_series(1, len(x))) AS i FROM d)),
gone AS (SELECT k FROM (SELECT DISTINCT r, k FROM l) WHERE length(k) >= 1 GROUP BY k HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone USING (k) GROUP BY r, doc_id
"""

#: Op 13: CRC-32 byte by byte, by a table made from its polynomial (a fixed value).
RESAMPLE = r"""
WITH crc AS (SELECT list(list_reduce([b::BIGINT] || generate_series(1, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) x(b)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(w) AS f FROM d) GROUP BY ALL),
bw AS (SELECT f, count(*) AS n FROM (SELECT unnest(w) AS f FROM b) GROUP BY f),
words AS (SELECT f, hex(encode(f)) AS x, (SELECT t FROM crc) AS t FROM (SELECT f FROM dw UNION SELECT f FROM bw)),
bucket AS (SELECT f, xor(list_reduce([4294967295] || list_transform(generate_series(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS k FROM words),
s AS (SELECT k, sum(n) AS s FROM dw JOIN bucket USING (f) GROUP BY k),
t AS (SELECT k, sum(n) AS t FROM bw JOIN bucket USING (f) GROUP BY k),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t_all),
gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000)))) AS g FROM s LEFT JOIN t USING (k), totals),
weighed AS (SELECT r, sum(n * g)::BIGINT AS weight FROM dw JOIN bucket USING (f) JOIN gain USING (k) GROUP BY r),
scored AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weighed USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""

_SPANS = """
{name}_m AS (SELECT doc_id, regexp_extract_all(t, {pattern}) AS m, regexp_extract_all(t, {pattern}, {group}) AS v, string_split_regex(t, {split}) AS g FROM d),
{name}_i AS (SELECT doc_id, m, v, g, unnest(generate_series(1, len(m))) AS i FROM {name}_m WHERE len(m) > 0),
{name} AS (SELECT doc_id, {number} AS kind, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n, m[i] AS m FROM {name}_i WHERE length(v[i]) >= {least})"""


def _spans(name: str, number: int, pattern: str, group: int, least: int) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return _SPANS.format(name=name, number=number, pattern=quoted, group=group, split=quoted, least=least)


def secrets_sql(kinds, candidate, classes, allowed, plain: str, separator: str) -> str:
    """Op 8, with the operator's patterns."""
    parts = [_spans(k.name, i, k.pattern, k.group, k.least) for i, k in enumerate((*kinds, candidate))]
    allow = " AND ".join(f"NOT regexp_matches(m, '{p}')" for p in allowed)
    least = "CASE " + " ".join(f"WHEN regexp_matches(m, '{p}') THEN {bits}" for _, p, bits in classes) + " END"
    names = "[" + ", ".join(f"'{k.name}'" for k in (*kinds, candidate)) + "]"
    union = " UNION ALL ".join(f"SELECT doc_id, kind, s, s + n AS e FROM {k.name}" for k in kinds)
    entropy = ("list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: "
               "-(length(w) - length(replace(w, c, ''))) / length(w)::DOUBLE * log2((length(w) - length(replace(w, c, ''))) / length(w)::DOUBLE)))")
    counted = ", ".join(f"CAST(count(*) FILTER (kind = {i}) AS BIGINT) AS n_{k.name}" for i, k in enumerate(kinds))
    label = f"({names})[kind + 1] || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{",".join(parts)},
fixed AS ({union}),
runs AS (SELECT doc_id, s, s + n AS e, m FROM entropy),
edges AS (SELECT doc_id, s AS place, 1 AS c, 0 AS f, s AS run FROM runs UNION ALL SELECT doc_id, e, -1, 0, NULL FROM runs
  UNION ALL SELECT doc_id, s, 0, 1, NULL FROM fixed UNION ALL SELECT doc_id, e, 0, -1, NULL FROM fixed),
points AS (SELECT doc_id, place, sum(c) AS c, sum(f) AS f, max(run) AS run FROM edges GROUP BY doc_id, place),
free AS (SELECT doc_id, place, sum(c) OVER w AS c, sum(f) OVER w AS f, max(run) OVER w AS run, lead(place) OVER w - place AS size
  FROM points WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
parts AS (SELECT free.doc_id, place, substr(m, place - run + 1, size) AS m FROM free JOIN runs ON free.doc_id = runs.doc_id AND run = s
  WHERE c > 0 AND f = 0 AND size >= {candidate.least}),
cut AS (SELECT *, list_transform(g, lambda x: regexp_matches(x, '{plain}')) AS plain FROM (SELECT *, string_split_regex(m, '{separator}') AS g FROM parts)),
ends AS (SELECT *, list_position(plain, false) AS a, list_position(list_reverse(plain), false) AS b FROM cut),
trimmed AS (SELECT doc_id, place + head AS s, place + length(m) - tail AS e, substr(m, head + 1, length(m) - head - tail) AS m FROM (
  SELECT *, CAST(coalesce(list_sum(list_transform(g[1:a - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS head,
         CAST(coalesce(list_sum(list_transform(list_reverse(g)[1:b - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS tail FROM ends WHERE coalesce(a, 0) > 0)),
likely AS (SELECT doc_id, {len(kinds)} AS kind, s, e, m, {least} AS least FROM trimmed
  WHERE e - s >= {candidate.least} AND len(list_distinct(string_split(m, ''))) > 1 AND {allow}),
windows AS (SELECT doc_id, kind, s, e, least, unnest(list_transform(generate_series(1, greatest(length(m) - 19, 1)), lambda i: substr(m, i, 20))) AS w FROM likely),
added AS (SELECT doc_id, kind, s, e FROM windows GROUP BY doc_id, kind, s, e, least HAVING max({entropy}) >= least),
every AS (SELECT * FROM fixed UNION ALL SELECT * FROM added),
per AS (SELECT doc_id, {counted}, string_agg({label}, ',' ORDER BY s, kind, e) FILTER (kind < {len(kinds)}) AS base, string_agg({label}, ',' ORDER BY s, kind, e) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""


def licenses_sql(templates, threshold: float = 0.8) -> str:
    """Op 9: windows between any two bigrams of a template, the best first."""
    words = ("regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
    values = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(templates))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
n AS (SELECT r, x, unnest(generate_series(1, len(x))) AS i FROM d),
l AS (SELECT r, i - 1 AS line, {words.format("x[i]")} AS w FROM n),
e AS (SELECT r, line, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM l),
p AS (SELECT r, line, word, row_number() OVER (PARTITION BY r ORDER BY line, k) - 1 AS i FROM e),
g AS (SELECT r, i, word || ' ' || lead(word) OVER (PARTITION BY r ORDER BY i) AS g FROM p),
t AS (SELECT tid, license, {words.format("text")} AS w FROM (VALUES {values}) v(tid, license, text)),
tg AS (SELECT tid, license, len(w) - 1 AS b, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM t),
tc AS (SELECT tid, license, b, g, count(*) AS c FROM tg GROUP BY ALL),
h AS (SELECT r, tid, license, b, i, g, c, row_number() OVER (PARTITION BY r, tid ORDER BY i) AS k FROM g JOIN tc USING (g)),
s AS (SELECT x.r, x.tid, x.license, x.b, x.i, y.i - x.i + 1 AS n FROM h x JOIN h y ON x.r = y.r AND x.tid = y.tid AND y.k >= x.k
      AND (y.i - x.i + 1) * {threshold} <= x.b * (2 - {threshold}) + 1e-9 AND 2 * (y.k - x.k + 1) >= {threshold} * (y.i - x.i + 1 + x.b) - 1e-9),
m AS (SELECT s.r, s.tid, s.license, s.b, s.i, s.n, least(count(*), h.c) AS c FROM s JOIN h ON h.r = s.r AND h.tid = s.tid AND h.i BETWEEN s.i AND s.i + s.n - 1
      GROUP BY s.r, s.tid, s.license, s.b, s.i, s.n, h.g, h.c),
w AS (SELECT r, license, i, n, sum(c) AS c, 2 * sum(c) / (n + b)::DOUBLE AS dice FROM m GROUP BY r, tid, license, b, i, n HAVING 2 * sum(c) >= {threshold} * (n + b) - 1e-9),
best AS (SELECT r, i, n, max(c) AS c, dice, string_agg(DISTINCT license, '|' ORDER BY license) AS license
         FROM (SELECT * FROM w QUALIFY dice = max(dice) OVER (PARTITION BY r, i, n)) GROUP BY r, i, n, dice),
kept AS (SELECT r, unnest(list_reduce(list([struct_pack(i, n, dice, license)] ORDER BY dice DESC, c DESC, i, n),
         lambda a, x: CASE WHEN len(list_filter(a, lambda k: k.i <= x[1].i + x[1].n AND x[1].i <= k.i + k.n)) = 0 THEN a || x ELSE a END)) AS x FROM best GROUP BY r)
SELECT doc_id, x.i AS first_word, x.n + 1 AS n_words, CAST(a.line AS BIGINT) AS first_line, CAST(z.line - a.line + 1 AS BIGINT) AS n_lines, x.license AS license, x.dice AS dice
FROM kept k JOIN (SELECT r, doc_id FROM d) USING (r) JOIN p a ON a.r = k.r AND a.i = x.i JOIN p z ON z.r = k.r AND z.i = x.i + x.n
"""
