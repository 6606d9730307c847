"""DuckDB SQL for the operators that SQL can express; written from the operators' definitions, not from their plans."""

from __future__ import annotations

from logweave.llm.decontamination import FUNCTION_WORDS, UNITS
from logweave.llm.quality_rules import RULES
from logweave.llm.queries import URL_RULES
from logweave.llm.url_filters import Pattern


def _strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[END]")
_ESCAPES = " + ".join(f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in ("\\", *_CONTROL))

OP5 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + {_ESCAPES.format('text')} + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 18 + length(role) + {_ESCAPES.format('role')} END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def _pattern_sql(pattern: str) -> str:
    body = pattern.removeprefix("||").replace(".", "[.]").replace("*", ".*")
    return f"regexp_matches(host || path, '(?is)^([^/]*[.])?{body}')"


_PATTERNS = " ".join(f"WHEN {_pattern_sql(p.text)} THEN '{p.text}'" for p in sorted(
    (r for r in URL_RULES if isinstance(r, Pattern)), key=lambda r: (len(r.text), r.text), reverse=True))

OP7 = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule,
    CASE {_PATTERNS} END AS fits
  FROM h)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR fits IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN fits END AS pattern
FROM r
"""

OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
"""

_TOKEN = r"[\p{L}\p{M}0-9]+"


def _windows(source: str, key: str) -> str:
    """One row per window of five typed tokens: its place, its tokens and their types."""
    return f"""
  SELECT {key}, i - 1 AS place, raw[i:i + 4] AS raw, types[i:i + 4] AS types FROM (
    SELECT *, unnest(range(1, greatest(len(raw) - 4, 1) + 1)) AS i FROM (
      SELECT {key}, raw, list_transform(raw, lambda w, k: CASE
          WHEN w[1] BETWEEN '0' AND '9' THEN '<num>'
          WHEN list_contains([{_strings(UNITS)}], lower(w)) AND k > 1 AND raw[k - 1][1] BETWEEN '0' AND '9' THEN '<unit>'
          WHEN regexp_matches(w, '^\\p{{Lu}}') AND NOT list_contains([{_strings(FUNCTION_WORDS)}], lower(w)) THEN '<name>'
          ELSE lower(w) END) AS types
      FROM (SELECT {key}, regexp_extract_all(text, '{_TOKEN}') AS raw FROM {source}) WHERE len(raw) > 0))"""


OP8 = f"""
WITH d AS (SELECT DISTINCT doc_id, text, text AS body FROM documents),
b AS (SELECT DISTINCT item_id, text, text AS question FROM benchmark),
dw AS ({_windows('d', 'doc_id, body')}),
bw AS (SELECT *, len(list_filter(types, lambda t: t NOT IN ('<num>', '<unit>', '<name>'))) AS literals FROM ({_windows('b', 'item_id, question')})),
n AS (SELECT item_id, question, count(*) AS every, count(*) FILTER (WHERE literals >= 2) AS plain FROM bw GROUP BY ALL),
w AS (SELECT bw.*, plain = 0 AS strict, CASE WHEN plain = 0 THEN every ELSE plain END AS windows
      FROM bw JOIN n USING (item_id, question) WHERE plain = 0 OR literals >= 2),
m AS (
  SELECT doc_id, body, item_id, question, windows, strict, w.place AS place, dw.place - w.place AS shift,
    list_filter(list_transform(range(1, len(w.types) + 1), lambda k: {{'t': w.types[k], 'a': lower(w.raw[k]), 'b': lower(dw.raw[k])}}),
                lambda s: s.t IN ('<num>', '<unit>', '<name>')) AS slots
  FROM dw JOIN w USING (types)),
ok AS (SELECT * FROM m WHERE NOT strict OR len(list_filter(slots, lambda s: s.a <> s.b)) = 0),
sl AS (SELECT doc_id, body, item_id, question, shift, count(*) AS n, count(DISTINCT (s.t, s.a)) AS na, count(DISTINCT (s.t, s.b)) AS nb
       FROM (SELECT DISTINCT doc_id, body, item_id, question, shift, unnest(slots) AS s FROM ok) GROUP BY ALL),
bad AS (SELECT doc_id, body, item_id, question, shift FROM sl WHERE n <> na OR n <> nb),
c AS (SELECT doc_id, body, item_id, question, windows, count(DISTINCT place) AS matched
      FROM ok ANTI JOIN bad USING (doc_id, body, item_id, question, shift) GROUP BY ALL)
SELECT doc_id, item_id, matched::BIGINT AS matched, windows::BIGINT AS windows, matched / windows AS share FROM c WHERE matched / windows >= 0.8
"""

OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (
  SELECT r, doc_id, k, lower(trim(regexp_replace(translate(x, chr(9) || chr(13), '  '), ' +', ' ', 'g'))) AS norm
  FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d)),
w AS (SELECT r, doc_id, k, norm, string_split(norm, ' ') AS words FROM l WHERE norm <> '' AND norm LIKE '% %'),
f AS (SELECT norm, any_value(words) AS words, min((doc_id, r, k)) AS first FROM w GROUP BY norm),
v AS (
  SELECT norm, first, words, i, array_to_string(list_concat(words[1:i - 1], words[i + 1:]), ' ') AS rest
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM f WHERE len(words) >= 8)),
near AS (
  SELECT DISTINCT a.norm FROM v a JOIN v b ON a.rest = b.rest AND a.i = b.i WHERE b.first < a.first
  UNION SELECT a.norm FROM v a JOIN f b ON a.rest = b.norm WHERE b.first < a.first AND len(b.words) >= 8
  UNION SELECT b.norm FROM v a JOIN f b ON a.rest = b.norm WHERE a.first < b.first AND len(b.words) >= 8),
gone AS (
  SELECT w.r, w.k FROM w JOIN f USING (norm) WHERE (w.doc_id, w.r, w.k) <> f.first
  UNION SELECT r, k FROM w JOIN near USING (norm)),
g AS (SELECT r, list(k) AS ks FROM gone GROUP BY r)
SELECT d.doc_id, CASE WHEN ks IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(ks, i)), chr(10)) END AS text,
  coalesce(len(ks), 0)::INTEGER AS removed_lines
FROM d LEFT JOIN g USING (r)
"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH t AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS crcs FROM range(256) t(n)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS words FROM documents),
dw AS (SELECT r, unnest(words) AS f FROM d),
bw AS (SELECT unnest({_WORDS}) AS f FROM benchmark),
x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM dw UNION SELECT f FROM bw)),
u AS (
  SELECT f, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)]))) % 10000 AS bucket
  FROM x CROSS JOIN t),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN u USING (f) GROUP BY bucket),
b AS (SELECT bucket, count(*) AS t FROM bw JOIN u USING (f) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)
                                 / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)))) AS gain
  FROM s LEFT JOIN b USING (bucket)),
w AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight FROM dw JOIN u USING (f) JOIN g USING (bucket) GROUP BY r),
sc AS (
  SELECT doc_id, len(words) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w USING (r)),
k AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n >= 20) OVER () AS every FROM sc)
SELECT doc_id, n::BIGINT AS n_features, weight, score, CASE WHEN n >= 20 AND place <= every * 10 // 100 THEN place END AS rank FROM k
"""


def _assigned(name: str, books: str) -> str:
    """Of every part: 64 times its squared distance to the nearest entry plus that entry's index."""
    return f"""{name} AS (
  SELECT r, p, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT * 64 + i) AS m
  FROM pts JOIN {books} USING (p) GROUP BY r, p)"""


def _moved(name: str, books: str, assigned: str) -> str:
    return f"""{name} AS (
  SELECT p, i, coalesce(mean, c) AS c FROM {books} LEFT JOIN (
    SELECT p, i, list(floor(total / n) ORDER BY j) AS mean FROM (
      SELECT p, m % 64 AS i, j, sum(x[j]) AS total, count(*) AS n
      FROM (SELECT *, unnest(range(1, len(x) + 1)) AS j FROM {assigned} JOIN pts USING (r, p)) GROUP BY ALL) GROUP BY p, i) USING (p, i))"""


OP12 = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, e) AS r, vec_id, label, e, len(e) // 16 AS width FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)),
pts AS (SELECT r, p, e[p * width + 1:(p + 1) * width] AS x FROM v, range(16) t(p)),
b0 AS (SELECT p, r - 1 AS i, x AS c FROM pts WHERE r <= 64),
{_assigned('a1', 'b0')}, {_moved('b1', 'b0', 'a1')}, {_assigned('a2', 'b1')}, {_moved('b2', 'b1', 'a2')}, {_assigned('a3', 'b2')},
f AS (SELECT r, lower(string_agg(printf('%02x', (m % 64)::INTEGER), '' ORDER BY p)) AS code, sum(m // 64)::BIGINT AS error FROM a3 GROUP BY r),
h AS (SELECT sha256(string_agg(c[j]::BIGINT::VARCHAR, ',' ORDER BY p, i, j)) AS digest FROM (SELECT *, unnest(range(1, len(c) + 1)) AS j FROM b2))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM f JOIN v USING (r) CROSS JOIN h
"""

_RISK, _ERROR = .02 / len(RULES), .05 / len(RULES)
_GRID = ", ".join(f"('{r.name}', {c})" for r in RULES for c in r.cutoffs)
_RATIOS = ", ".join(f"({r.part}::DOUBLE / nullif({r.whole}, 0)) AS {r.name}" for r in RULES)
_RATIO_OF = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN {r.name}" for r in RULES) + " END"

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, lang, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, regexp_replace(text, '[^#*$%&|<>]', '', 'g') AS symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
n AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM (SELECT *, unnest(range(1, len(words) - 1)) AS i FROM w)),
m AS (SELECT r, i FROM n QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
o AS (SELECT r, count(DISTINCT i + o) AS n FROM m, range(3) t(o) GROUP BY r),
s AS (
  SELECT doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(symbols)::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(o.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN o USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_RATIOS} FROM s),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
h AS (SELECT * FROM f SEMI JOIN good USING (doc_id) WHERE NOT base_failed),
g(rule, cutoff) AS (VALUES {_GRID}),
c AS (SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE {_RATIO_OF} > cutoff) AS k FROM h CROSS JOIN g GROUP BY ALL),
p AS (
  SELECT lang, rule, min(cutoff) AS cutoff FROM c
  WHERE list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
                                                            + i * ln({_RISK}) + (n - i) * ln(1 - {_RISK})))) <= {_ERROR} / (SELECT count(DISTINCT coalesce('=' || lang, '')) FROM h)
  GROUP BY lang, rule),
z AS (SELECT lang, {', '.join(f"min(cutoff) FILTER (WHERE rule = '{r.name}') AS c_{r.name}" for r in RULES)} FROM p GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(f"coalesce({r.name} > c_{r.name}, false)" for r in RULES)}) AS kept
FROM f LEFT JOIN z ON f.lang IS NOT DISTINCT FROM z.lang
"""

ORACLES: dict[str, str] = {
    "op5_chat_format": OP5, "op7_url_filters": OP7, "op8_decontamination": OP8, "op9_topk_search": OP9, "op10_line_dedup": OP10,
    "op11_importance_sampling": OP11, "op12_ball_codes": OP12, "op13_quality_rules": OP13,
}
