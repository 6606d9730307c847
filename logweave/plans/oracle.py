"""Independent DuckDB oracles: every expectation is computed from table
columns in closed form (never by parsing rendered text).

``r1``/``r2`` below are one row per event with the entry fields the
renderer's rules imply (line number by a running sum, level by CASE, ...).
"""

from __future__ import annotations

from logweave.plans import catalog as C

EV = """ev AS (
  SELECT event_id AS n, user_id AS u, event_type AS et, ts,
         strftime(ts, '%Y-%m-%d %H:%M:%S,%g') AS T,
         ['economy','large','medium','promo','small','standard'][CAST(event_id % 6 AS INTEGER) + 1] AS y,
         CAST(event_id % 61 AS VARCHAR) AS P,
         CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'FATAL'
              WHEN event_type = 'error' THEN 'ERROR'
              WHEN event_type = 'purchase' THEN 'WARN'
              WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
         CASE event_type WHEN 'error' THEN 7 WHEN 'purchase' THEN 2 ELSE 1 END AS w
  FROM events),
e AS (
  SELECT *, 'user-' || u || '.log' AS file_path,
         CAST(2 + COALESCE(SUM(w) OVER (PARTITION BY u ORDER BY n
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_number,
         'org.example.' || y || '.P' || P AS logger,
         et || ' event ' || n || ' user ' || u AS msg,
         epoch_ms(date_trunc('millisecond', ts)) AS timestamp_ms
  FROM ev)"""

R1 = EV + """,
r1 AS (
  SELECT file_path, line_number, n, u, et, y, P, w, T AS timestamp, timestamp_ms, level, logger,
         'P' || P AS logger_short,
         CASE WHEN u % 3 = 0 THEN 'TID: [' || CASE WHEN u % 5 = 0 THEN '' ELSE CAST(u % 5 AS VARCHAR) END
                                  || '] [' || et || '] [' || T || ']  ' || level || ' {' || logger || '} - ' || msg
              WHEN u % 3 = 1 THEN '[' || T || ']  ' || level || ' {' || logger || '} - ' || msg
              ELSE T || ' ' || level || ' [' || logger || '] - ' || msg END AS raw,
         CASE et WHEN 'error' THEN msg || chr(10) || 'com.example.ServiceException: event ' || n || ' failed'
                 WHEN 'purchase' THEN msg || chr(10) || '  items=' || (n % 4)
                 ELSE msg END AS message,
         CASE WHEN u % 3 = 0 AND u % 5 <> 0 THEN CAST(u % 5 AS VARCHAR) END AS tid,
         CASE WHEN u % 3 = 0 THEN et END AS app_name,
         et = 'error' AS has_stack_trace,
         CAST(CASE WHEN et = 'error' THEN 4 ELSE 0 END AS BIGINT) AS stack_len,
         CASE WHEN et = 'error' THEN
              chr(9) || 'at org.example.' || y || '.P' || P || CASE WHEN n % 2 = 1 THEN '$Nested' ELSE '' END
              || '.handle(P' || P || '.java:' || (n % 8 + 1) || ')' || chr(10)
              || 'Caused by: java.lang.IllegalStateException: code ' || (n % 5) || chr(10)
              || chr(9) || 'at net.other.lib.Util$Inner.call(Util.java:' || (n % 30 + 1) || ')' || chr(10)
              || chr(9) || '... ' || (n % 9) || ' more'
              ELSE '' END AS stack_text,
         CASE et WHEN 'error' THEN
              length('com.example.ServiceException: event ' || n || ' failed')
              + length(chr(9) || 'at org.example.' || y || '.P' || P || CASE WHEN n % 2 = 1 THEN '$Nested' ELSE '' END
                       || '.handle(P' || P || '.java:' || (n % 8 + 1) || ')')
              + length('Caused by: java.lang.IllegalStateException: code ' || (n % 5))
              + length(chr(9) || 'at net.other.lib.Util$Inner.call(Util.java:' || (n % 30 + 1) || ')')
              + length(chr(9) || '... ' || (n % 9) || ' more')
              WHEN 'purchase' THEN length('  items=' || (n % 4))
              ELSE 0 END AS extra_len
  FROM e)"""

R2 = EV + """,
r2 AS (
  SELECT file_path, line_number, n, u, T AS timestamp, timestamp_ms, level, logger, 'P' || P AS logger_short,
         CASE et WHEN 'error' THEN msg || chr(10) || 'com.example.ServiceException: event ' || n || ' failed'
                 WHEN 'purchase' THEN msg || chr(10) || '  items=' || (n % 4)
                 ELSE msg END AS message,
         'exec-' || (n % 8) AS thread,
         'c' || (n % 97) AS correlation_id,
         CASE WHEN u % 5 = 0 THEN NULL ELSE 't' || (u % 5) || '.com' END AS tenant_domain,
         et = 'error' AS has_stack_trace,
         CAST(CASE WHEN et = 'error' THEN 4 ELSE 0 END AS BIGINT) AS stack_len
  FROM e)"""


def _with(cte: str, body: str) -> str:
    return f"WITH {cte}\n{body}"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ENTRY_OUT = "file_path, line_number, timestamp, level, logger, message"


def _contains_ci(q: str, cols=("message", "raw")) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {_lit(q.lower())})" for c in cols) + ")"


def _regex_ci(p: str, cols=("message", "raw")) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {_lit('(?i)' + p)})" for c in cols) + ")"


def _time_pred(t_from=None, t_to=None) -> str:
    parts = []
    if t_from:
        parts.append(f"timestamp >= {_lit(t_from)}")
    if t_to:
        parts.append(f"timestamp <= {_lit(t_to)}")
    return f"(timestamp IS NULL OR timestamp = '' OR ({' AND '.join(parts)}))"


def _groups_sql(cte: str, src: str, key: str) -> str:
    return _with(cte, f"""
SELECT file_path, {key} AS key, count(*) AS count,
       arg_min(timestamp, line_number) AS first_seen, arg_max(timestamp, line_number) AS last_seen,
       count(*) FILTER (WHERE level IN ('ERROR', 'FATAL')) AS error_count,
       min(line_number) AS first_at
FROM {src} GROUP BY ALL""")


def _group_all_sql() -> str:
    keys = [("level", "level"),
            ("component", "coalesce(nullif(logger_short, ''), nullif(logger, ''), 'unknown')"),
            ("logger", "coalesce(nullif(logger, ''), 'unknown')"),
            ("tenant", "coalesce(nullif(tenant_domain, ''), 'unknown')"),
            ("correlationId", "coalesce(nullif(correlation_id, ''), 'unknown')")]
    parts = [f"""SELECT file_path, '{by}' AS group_by, {k} AS key, count(*) AS count,
       arg_min(timestamp, line_number) AS first_seen, arg_max(timestamp, line_number) AS last_seen,
       count(*) FILTER (WHERE level IN ('ERROR', 'FATAL')) AS error_count, min(line_number) AS first_at
FROM r2 GROUP BY ALL""" for by, k in keys]
    return _with(R2, "\nUNION ALL\n".join(parts))


def _format_report_sql() -> str:
    ids = ["builtin-tid", "builtin-apim-audit", "builtin-apim-api-log", "builtin-apim-trace",
           "builtin-apim-gov-audit", "builtin-bracket", "builtin-correlation", "builtin-error-diag",
           "builtin-basic"]
    return _with(R1, f"""
, f AS (SELECT file_path, any_value(u) AS u, count(*) AS events, CAST(1 + sum(w) AS BIGINT) AS lines_tested,
        arg_min(logger, n) AS logger FROM r1 GROUP BY file_path),
fx AS (SELECT file_path, u, events, lines_tested, logger, unnest({"[" + ", ".join(_lit(i) for i in ids) + "]"}) AS format_id
       FROM f)
SELECT file_path, format_id, lines_tested, CAST(NULL AS VARCHAR) AS error,
       CASE WHEN (format_id = 'builtin-tid' AND u % 3 = 0)
              OR (format_id IN ('builtin-bracket', 'builtin-apim-api-log') AND u % 3 = 1)
              OR (format_id = 'builtin-basic' AND u % 3 = 2) THEN events / lines_tested ELSE 0.0 END AS match_ratio,
       CASE WHEN (format_id = 'builtin-tid' AND u % 3 = 0)
              OR (format_id IN ('builtin-bracket', 'builtin-apim-api-log') AND u % 3 = 1)
              OR (format_id = 'builtin-basic' AND u % 3 = 2) THEN logger END AS captured_logger,
       CAST(CASE WHEN (format_id = 'builtin-tid' AND u % 3 = 0)
                   OR (format_id IN ('builtin-bracket', 'builtin-apim-api-log') AND u % 3 = 1)
                   OR (format_id = 'builtin-basic' AND u % 3 = 2) THEN events ELSE 0 END AS BIGINT) AS lines_matched,
       CAST(CASE WHEN (format_id = 'builtin-tid' AND u % 3 = 0)
                   OR (format_id IN ('builtin-bracket', 'builtin-apim-api-log') AND u % 3 = 1)
                   OR (format_id = 'builtin-basic' AND u % 3 = 2) THEN 2 END AS BIGINT) AS first_matched_line
FROM fx""")


ORACLES = {
    "entries_auto": _with(R1, """
SELECT file_path, line_number, raw, timestamp, timestamp_ms, level, logger, logger_short, message, tid,
       app_name, has_stack_trace, stack_len, stack_text FROM r1"""),
    "entries_layout": _with(R2, """
SELECT file_path, line_number, timestamp, timestamp_ms, level, logger, logger_short, message, thread,
       correlation_id, tenant_domain, has_stack_trace, stack_len FROM r2"""),
    "detect_format": _with(R1, """
SELECT DISTINCT file_path, CASE u % 3 WHEN 0 THEN 'tid' WHEN 1 THEN 'bracket' ELSE 'basic' END AS format
FROM r1"""),
    "format_report": _format_report_sql(),
    "file_metadata": _with(R1, """
SELECT file_path, file_path AS filename, 'generic' AS file_type,
       CAST(sum(length(raw) + 1 + extra_len + w - 1)
            + any_value(length('*** log of user ' || u || ' ***') + 1) AS BIGINT) AS size_bytes,
       CAST(1 + sum(w) AS BIGINT) AS line_count,
       substr(arg_min(timestamp, n), 1, 19) AS first_timestamp,
       substr(arg_max(timestamp, n), 1, 19) AS last_timestamp
FROM r1 GROUP BY file_path"""),
    "filter_levels": _with(R1, f"SELECT {ENTRY_OUT} FROM r1 WHERE level IN {_in([x.upper() for x in C.LEVELS])}"),
    "filter_component": _with(R1, f"""
SELECT {ENTRY_OUT} FROM r1 WHERE logger_short IN {_in(C.COMPONENTS)} OR logger IN {_in(C.COMPONENTS)}"""),
    "filter_correlation": _with(R2, f"""
SELECT {ENTRY_OUT}, correlation_id, tenant_domain, thread FROM r2 WHERE correlation_id = {_lit(C.CORRELATION)}"""),
    "filter_stack": _with(R1, f"SELECT {ENTRY_OUT} FROM r1 WHERE has_stack_trace"),
    "filter_time": _with(R1, f"SELECT {ENTRY_OUT} FROM r1 WHERE {_time_pred(C.TIME_FROM, C.TIME_TO)}"),
    "filter_text": _with(R1, f"SELECT {ENTRY_OUT} FROM r1 WHERE {_contains_ci(C.TEXT)}"),
    "filter_regex": _with(R1, f"SELECT {ENTRY_OUT} FROM r1 WHERE {_regex_ci(C.REGEX)}"),
    "filter_combined": _with(R1, f"""
SELECT {ENTRY_OUT} FROM r1
WHERE level IN {_in([x.upper() for x in C.COMBINED['levels']])} AND has_stack_trace
  AND {_time_pred(C.COMBINED['time_from'])} AND {_contains_ci(C.COMBINED['search'])}"""),
    "errors_only": _with(R1, f"SELECT {ENTRY_OUT} FROM r1 WHERE level IN ('ERROR', 'FATAL')"),
    "page_entries": _with(R1, f"""
SELECT {ENTRY_OUT} FROM r1 ORDER BY file_path, line_number LIMIT {C.PAGE_LIMIT} OFFSET {C.PAGE_OFFSET}"""),
    "filter_page": _with(R1, f"""
SELECT {ENTRY_OUT} FROM r1
WHERE level IN {_in([x.upper() for x in C.FILTER_PAGE['levels']])} AND {_contains_ci(C.FILTER_PAGE['search'])}
ORDER BY file_path, line_number LIMIT {C.FILTER_PAGE_LIMIT}"""),
    "summary": _with(R1, """
, lc AS (SELECT file_path, level, count(*) AS c FROM r1 GROUP BY ALL),
lt AS (SELECT file_path, string_agg(level || '=' || c, ',' ORDER BY level) AS level_counts FROM lc GROUP BY ALL)
SELECT r1.file_path, count(*) AS total_entries,
       arg_min(timestamp, line_number) AS first_timestamp, arg_max(timestamp, line_number) AS last_timestamp,
       count(*) FILTER (WHERE has_stack_trace) AS has_stack_traces, any_value(lt.level_counts) AS level_counts
FROM r1 JOIN lt USING (file_path) GROUP BY r1.file_path"""),
    "level_counts": _with(R1, "SELECT file_path, level, count(*) AS count FROM r1 GROUP BY ALL"),
    "top_components": _with(R1, f"""
, cc AS (SELECT file_path, logger_short AS component, count(*) AS count, min(line_number) AS first_at
         FROM r1 WHERE logger_short <> '' GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY count DESC, first_at) AS rank FROM cc)
SELECT file_path, component, count, rank FROM rk WHERE rank <= 20"""),
    "group_level": _groups_sql(R1, "r1", "level"),
    "group_component": _groups_sql(R1, "r1", "coalesce(nullif(logger_short, ''), nullif(logger, ''), 'unknown')"),
    "group_logger": _groups_sql(R1, "r1", "coalesce(nullif(logger, ''), 'unknown')"),
    "group_tenant": _groups_sql(R2, "r2", "coalesce(nullif(tenant_domain, ''), 'unknown')"),
    "group_correlation": _groups_sql(R2, "r2", "coalesce(nullif(correlation_id, ''), 'unknown')"),
    "group_all": _group_all_sql(),
    "search_files": _with(R1, f"""
SELECT {ENTRY_OUT} FROM r1 WHERE level IN {_in(C.SEARCH_LEVELS)} AND {_contains_ci(C.SEARCH_QUERY)}
ORDER BY file_path, line_number LIMIT {C.SEARCH_LIMIT}"""),
    "search_documents": f"""
SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), {_lit(C.DOC_TEXT.lower())})""",
    "search_documents_regex": f"""
SELECT doc_id, lang, n_chars FROM documents WHERE regexp_matches(text, {_lit('(?i)' + C.DOC_REGEX)})""",
}


# ----------------------------------------------------------------- frames / code index

def _values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) t({', '.join(cols)}))"


from logweave.sources import render as _R  # noqa: E402

PM = _values(_R.R3_PACKAGE_MAP, ["prefix", "repo"])

FRAMES = R1 + """,
fr AS (
  SELECT file_path, line_number AS entry_line, CAST(0 AS BIGINT) AS frame_pos, 'org.example.' || y AS package,
         'P' || P || CASE WHEN n % 2 = 1 THEN '$Nested' ELSE '' END AS class_name, 'handle' AS method,
         'P' || P || '.java' AS file_name, CAST(n % 8 + 1 AS BIGINT) AS line_no,
         'at org.example.' || y || '.P' || P || CASE WHEN n % 2 = 1 THEN '$Nested' ELSE '' END
           || '.handle(P' || P || '.java:' || (n % 8 + 1) || ')' AS raw
  FROM r1 WHERE et = 'error'
  UNION ALL
  SELECT file_path, line_number, CAST(1 AS BIGINT), 'net.other.lib', 'Util$Inner', 'call', 'Util.java',
         CAST(n % 30 + 1 AS BIGINT), 'at net.other.lib.Util$Inner.call(Util.java:' || (n % 30 + 1) || ')'
  FROM r1 WHERE et = 'error')"""

FRAME_OUT = "file_path, entry_line, frame_pos, package, class_name, method, file_name, line_no, raw"

CLASSES = """src AS (
  SELECT p_partkey AS k, 'repo-' || ((p_partkey // 50) % 2) AS repo_label,
         CAST((p_partkey // 50) % 2 AS BIGINT) AS repo_order,
         'repo-' || ((p_partkey // 50) % 2) || '/m' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '/'
           || CASE WHEN (p_partkey // 50) % 5 = 4 THEN 'target/' ELSE '' END
           || 'src/P' || (p_partkey % 50) || '.java' AS source_path,
         'org.example.' || lower(p_type) || '.P' || (p_partkey % 50) AS fqcn,
         lower(p_type) AS ptype,
         (p_partkey // 50) % 5 = 4 AS excluded
  FROM part),
ci AS (
  SELECT repo_label, repo_order, fqcn, min(source_path) AS source_path, arg_min(k, source_path) AS k,
         arg_min(ptype, source_path) AS ptype, CAST(8 AS BIGINT) AS line_count
  FROM src WHERE NOT excluded GROUP BY repo_label, repo_order, fqcn)"""

RESOLVED = FRAMES + ",\n" + CLASSES + f""",
pm AS {PM},
rp AS (
  SELECT f.package, arg_max(pm.repo, length(pm.prefix)) AS repo
  FROM (SELECT DISTINCT package FROM fr) f JOIN pm ON starts_with(f.package, pm.prefix) GROUP BY f.package),
cand AS (
  SELECT f.file_path, f.entry_line, f.frame_pos, ci.repo_label, ci.source_path, ci.k, ci.ptype,
         row_number() OVER (PARTITION BY f.file_path, f.entry_line, f.frame_pos
                            ORDER BY ci.repo_order,
                                     CASE WHEN ci.fqcn = f.package || '.' || f.class_name THEN 0 ELSE 1 END) AS r
  FROM fr f JOIN ci ON ci.fqcn = f.package || '.' || f.class_name
                    OR ci.fqcn = f.package || '.' || split_part(f.class_name, '$', 1)),
best AS (SELECT * FROM cand WHERE r = 1),
res AS (
  SELECT fr.*,
         (fr.package = 'org.example' OR starts_with(fr.package, 'org.example.')) AS vendor,
         rp.repo AS mapped, best.source_path AS hit_path, best.repo_label AS hit_label, best.k, best.ptype
  FROM fr LEFT JOIN rp USING (package)
          LEFT JOIN best USING (file_path, entry_line, frame_pos)),
rf AS (
  SELECT file_path, entry_line, frame_pos, package, class_name, line_no, k, ptype,
         vendor AND mapped IS NOT NULL AND hit_path IS NOT NULL AS resolved,
         CASE WHEN NOT vendor THEN 'non_wso2_frame' WHEN mapped IS NULL THEN 'no_repo_mapping'
              WHEN hit_path IS NULL THEN 'class_not_found_in_registered_repos' END AS reason,
         CASE WHEN vendor THEN mapped END AS repo,
         CASE WHEN vendor AND mapped IS NOT NULL THEN hit_path END AS source_path,
         CASE WHEN vendor AND mapped IS NOT NULL THEN hit_label END AS repo_label
  FROM res),
rl AS (
  SELECT rf.*, ['package org.example.' || ptype || ';', '',
                '// part ' || k || ' line 3', '// part ' || k || ' line 4', '// part ' || k || ' line 5',
                '// part ' || k || ' line 6', '// part ' || k || ' line 7', '// part ' || k || ' line 8'] AS lines
  FROM rf WHERE resolved)"""

JARS = """jars AS (
  SELECT p_partkey AS k, replace(p_name, ' ', '-') AS name,
         CASE WHEN p_partkey % 3 = 0 THEN 'org-a' ELSE 'org-b' END AS org,
         'lib/' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '/' || replace(p_name, ' ', '-')
           || CASE p_partkey % 4 WHEN 0 THEN '-' || p_size || '.' || (p_partkey % 10) || '.0.jar'
                                 WHEN 1 THEN '_' || p_size || '.0.0.jar'
                                 WHEN 2 THEN '_' || p_size || '.0.0.rc' || (p_partkey % 9) || '_' || (p_partkey % 3 + 1) || '.jar'
                                 ELSE '.jar' END AS path,
         CASE p_partkey % 4 WHEN 0 THEN p_size || '.' || (p_partkey % 10) || '.0'
                            WHEN 1 THEN p_size || '.0.0'
                            WHEN 2 THEN p_size || '.0.0.rc' || (p_partkey % 9) || '.' || (p_partkey % 3 + 1) END AS version
  FROM part),
av AS (SELECT name AS artifact_id, arg_min(version, path) AS version, min(path) AS path
       FROM jars WHERE version IS NOT NULL GROUP BY name)"""

ORACLES.update({
    "frames": _with(FRAMES, f"SELECT {FRAME_OUT} FROM fr"),
    "vendor_frames": _with(FRAMES, f"""
SELECT {FRAME_OUT}, (package = 'org.example' OR starts_with(package, 'org.example.')) AS is_vendor FROM fr"""),
    "class_index": _with(CLASSES, "SELECT repo_label, repo_order, fqcn, source_path, line_count FROM ci"),
    "repo_stats": _with(CLASSES, """
SELECT repo_label, repo_order, count(*) AS file_count, count(DISTINCT fqcn) AS class_count
FROM src WHERE NOT excluded GROUP BY ALL"""),
    "resolve_packages": f"""
WITH pk AS (SELECT DISTINCT 'org.example.' || lower(p_type) || '.' || lower(split_part(p_name, ' ', 1)) AS package
            FROM part),
pm AS {PM},
best AS (SELECT pk.package, arg_max(pm.repo, length(pm.prefix)) AS repo, arg_max(pm.prefix, length(pm.prefix)) AS mp
         FROM pk JOIN pm ON starts_with(pk.package, pm.prefix) GROUP BY pk.package)
SELECT pk.package, best.repo, best.mp AS matched_prefix FROM pk LEFT JOIN best USING (package)""",
    "resolve_frames": _with(RESOLVED, """
SELECT file_path, entry_line, frame_pos, package, class_name, line_no, resolved, reason, repo, source_path,
       repo_label FROM rf"""),
    "resolution_counts": _with(RESOLVED, """
SELECT file_path, entry_line, count(*) FILTER (WHERE resolved) AS resolved_count, count(*) AS total_count
FROM rf GROUP BY ALL"""),
    "frame_snippets": _with(RESOLVED, """
SELECT file_path, entry_line, frame_pos, source_path, line_no,
       array_to_string(list_slice(lines, greatest(1, line_no - 5), least(8, line_no + 5)), chr(10)) || chr(10)
         AS snippet
FROM rl"""),
    "source_window": _with(RESOLVED, """
SELECT DISTINCT source_path, line_no AS target_line, CAST(8 AS BIGINT) AS total_lines,
       CAST(greatest(0, line_no - 11) + 1 AS BIGINT) AS start_line, CAST(least(8, line_no + 10) AS BIGINT) AS end_line,
       array_to_string(list_slice(lines, greatest(0, line_no - 11) + 1, least(8, line_no + 10)), chr(10)) AS content
FROM rl"""),
    "artifact_versions": _with(JARS, "SELECT artifact_id, version, path FROM av"),
    "package_versions": _with(JARS, f""",
pk AS (SELECT DISTINCT 'org.example.' || lower(p_type) || '.' || replace(p_name, ' ', '-') AS package FROM part),
ov AS {_values(_R.R4_OVERRIDES, ["prefix", "artifact_id"])},
s2 AS (SELECT pk.package, arg_max(ov.artifact_id, length(ov.prefix)) AS a
       FROM pk JOIN ov ON starts_with(pk.package, ov.prefix) GROUP BY pk.package),
s2j AS (SELECT s2.package, s2.a AS a2, av.version AS v2 FROM s2 JOIN av ON av.artifact_id = s2.a),
s3r AS (SELECT pk.package, av.artifact_id, av.version,
               row_number() OVER (PARTITION BY pk.package ORDER BY length(av.artifact_id) DESC, av.artifact_id) AS r
        FROM pk JOIN av ON contains(lower(pk.package), lower(av.artifact_id))),
s3 AS (SELECT package, artifact_id AS a3, version AS v3 FROM s3r WHERE r = 1)
SELECT package, coalesce(a2, a3) AS artifact_id, coalesce(v2, v3) AS version,
       CASE WHEN a2 IS NOT NULL THEN 'override' WHEN a3 IS NOT NULL THEN 'fuzzy' END AS rule
FROM pk LEFT JOIN s2j USING (package) LEFT JOIN s3 USING (package)"""),
    "release_tags": _with(JARS, """,
tg AS (SELECT org, name AS repo, CASE WHEN k % 2 = 0 THEN 'v' || version ELSE version END AS tag
       FROM jars WHERE version IS NOT NULL),
cand AS (SELECT artifact_id AS repo, version, 'v' || version AS tag, 0 AS pos FROM av
         UNION ALL SELECT artifact_id, version, version, 1 FROM av),
hits AS (SELECT c.repo, c.version, t.org, t.tag,
                row_number() OVER (PARTITION BY c.repo, c.version
                                   ORDER BY CASE t.org WHEN 'org-a' THEN 1 ELSE 2 END, c.pos) AS r
         FROM cand c JOIN tg t ON t.repo = c.repo AND t.tag = c.tag)
SELECT av.artifact_id AS repo, av.version, h.org, h.tag
FROM av LEFT JOIN (SELECT * FROM hits WHERE r = 1) h ON h.repo = av.artifact_id AND h.version = av.version"""),
    "github_urls": _with(JARS, """
SELECT path, 'https://github.com/' || org || '/' || name || '/blob/'
             || CASE WHEN k % 2 = 0 THEN 'v' || version ELSE 'v' || version END
             || '/src/main/java/P' || (k % 50) || '.java'
             || CASE WHEN k % 5 = 0 THEN '' ELSE '#L' || (k % 5) END AS url
FROM jars WHERE version IS NOT NULL"""),
    "packages_of_repo": f"""
WITH pk AS (SELECT DISTINCT 'org.example.' || lower(p_type) AS package FROM part),
pm AS {PM},
rp AS (SELECT DISTINCT arg_max(pm.repo, length(pm.prefix)) AS repo
       FROM pk JOIN pm ON starts_with(pk.package, pm.prefix) GROUP BY pk.package)
SELECT pm.repo, pm.prefix FROM pm JOIN rp USING (repo)""",
    "feature_repos": f"""
WITH f AS (SELECT * FROM (VALUES {", ".join("(" + _lit(k) + ", [" + ", ".join(_lit(r) for r in v) + "])" for k, v in _R.FEATURES)}) t(keyword, repos)),
kw AS (SELECT DISTINCT lower(p_type) AS keyword FROM part)
SELECT f.keyword, CAST(u.pos - 1 AS BIGINT) AS repo_pos, u.repo
FROM f JOIN kw USING (keyword),
     LATERAL (SELECT unnest(f.repos) AS repo, unnest(range(1, len(f.repos) + 1)) AS pos) u""",
    "skip_registered": """
SELECT DISTINCT 'user-' || user_id || '.log' AS file_path FROM events
EXCEPT
SELECT DISTINCT 'user-' || user_id || '.log' FROM events
WHERE event_type = 'signup' AND value > """ + str(C.REGISTERED_MIN_VALUE),
})

# Real files hold what the tables of lines hold.
ORACLES |= {
    "files_entries": ORACLES["entries_auto"],
    "best_formats": _with(R1, """
SELECT DISTINCT file_path, CASE u % 3 WHEN 0 THEN 'builtin-tid' WHEN 1 THEN 'builtin-apim-api-log' ELSE 'builtin-basic' END
       AS best_format_id FROM r1"""),
    "files_catalogue": _with(R1, """
SELECT file_path, CAST(sum(length(raw) + 1 + extra_len + w - 1)
                       + any_value(length('*** log of user ' || u || ' ***') + 1) AS BIGINT) AS size_bytes,
       CAST(1 + sum(w) AS BIGINT) AS line_count, substr(arg_min(timestamp, n), 1, 19) AS first_timestamp,
       substr(arg_max(timestamp, n), 1, 19) AS last_timestamp,
       CASE WHEN any_value(u) % 2 = 0 THEN 'builtin-bracket' ELSE 'builtin-tid' END AS format_id
FROM r1 GROUP BY file_path"""),
    "files_formats": _with(R1, """
SELECT file_path, count(*) AS entries, min(line_number) AS first_line FROM r1 WHERE u % 2 <> 0 OR u % 3 = 1 GROUP BY file_path"""),
    "stored_entries": _with(R1, f"SELECT {ENTRY_OUT}, substr(timestamp, 1, 10) AS log_date FROM r1"),
    "file_types": """
WITH t AS (SELECT DISTINCT user_id AS u FROM events)
SELECT ['wso2carbon', 'AUDIT', 'http_access_', 'Correlation', 'other'][u % 5 + 1] || '-' || u || '.log' AS filename,
       ['wso2carbon', 'audit', 'http_access', 'correlation', 'generic'][u % 5 + 1] AS file_type FROM t""",
    "page_after": _with(R1, f"""
SELECT {ENTRY_OUT} FROM r1 WHERE file_path > {_lit(C.PAGE_AFTER[0])} OR file_path = {_lit(C.PAGE_AFTER[0])} AND line_number > {C.PAGE_AFTER[1]}
ORDER BY file_path, line_number LIMIT {C.PAGE_LIMIT}"""),
    "ordered_groups": _with(R1, """
, g AS (SELECT file_path, logger_short AS key, count(*) AS count, min(line_number) AS first_at FROM r1 GROUP BY ALL)
SELECT file_path, key, count, row_number() OVER (PARTITION BY file_path ORDER BY count DESC, first_at) AS place FROM g"""),
    "pasted_frames": ORACLES["frames"],
    "callpath": _with(RESOLVED, """
SELECT file_path, entry_line, row_number() OVER (PARTITION BY file_path, entry_line ORDER BY frame_pos) AS step, class_name, resolved
FROM rf"""),
    "dims_from_json": """
SELECT DISTINCT 'org.example.' || lower(p_type) || '.' || lower(split_part(p_name, ' ', 1)) AS prefix,
       'r-' || lower(split_part(p_name, ' ', 1)) AS repo FROM part""",
}

_VERSION = "p_size || '.' || (p_partkey % 10) || '{}wso2v' || (p_partkey % 7)"

ORACLES |= {
    "features_from_json": """
WITH b AS (SELECT DISTINCT lower(p_type) AS keyword, p_brand AS repo FROM part)
SELECT keyword, CAST(row_number() OVER (PARTITION BY keyword ORDER BY repo) - 1 AS BIGINT) AS repo_pos, repo FROM b""",
    "files_class_index": ORACLES["class_index"],
    "stored_index": _with(RESOLVED, """,
asked AS (SELECT DISTINCT package, class_name FROM fr),
look AS (
  SELECT a.package, a.class_name, ci.repo_label, ci.source_path, ci.fqcn AS indexed_fqcn,
         row_number() OVER (PARTITION BY a.package, a.class_name
                            ORDER BY ci.repo_order, CASE WHEN ci.fqcn = a.package || '.' || a.class_name THEN 0 ELSE 1 END) AS r
  FROM asked a JOIN ci ON ci.fqcn = a.package || '.' || a.class_name OR ci.fqcn = a.package || '.' || split_part(a.class_name, '$', 1))
SELECT package, class_name, repo_label, source_path, indexed_fqcn FROM look WHERE r = 1"""),
    "page_deep": _with(R1, f""",
p AS (SELECT *, row_number() OVER (ORDER BY file_path, line_number) - 1 AS place, count(*) OVER () * 2 // 3 AS deep FROM r1)
SELECT {ENTRY_OUT} FROM p WHERE place >= deep AND place < deep + {C.PAGE_LIMIT}"""),
    "search_indexed": _with(R1, f"SELECT {ENTRY_OUT} FROM r1 WHERE {_contains_ci(C.INDEXED_TEXT)}"),
    "files_formats_detected": ORACLES["detect_format"],
    "files_times": f"""
SELECT file_path, 'generic' AS file_type, size_bytes, first_timestamp, last_timestamp FROM ({ORACLES["files_catalogue"]})""",
    "source_windows": """
WITH s AS (
  SELECT 'repo-' || ((p_partkey // 50) % 2) || '/m' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '/'
           || CASE WHEN (p_partkey // 50) % 5 = 4 THEN 'target/' ELSE '' END || 'src/P' || (p_partkey % 50) || '.java' AS source_path,
         CAST([1, 3, 20, 38, 40, 60, NULL][CAST(p_partkey % 7 + 1 AS INTEGER)] AS BIGINT) AS line,
         list_concat(['package org.example.' || lower(p_type) || ';', ''],
                     list_transform(range(3, 41), lambda i: '// part ' || p_partkey || ' line ' || i)) AS lines
  FROM part)
SELECT source_path, line AS target_line, CAST(40 AS BIGINT) AS total_lines,
       CASE WHEN line IS NOT NULL THEN greatest(0, line - 11) + 1 END AS start_line,
       CASE WHEN line IS NOT NULL THEN least(40, line + 10) END AS end_line,
       CASE WHEN line IS NULL THEN array_to_string(lines, chr(10)) || chr(10)
            ELSE array_to_string(lines[greatest(0, line - 11) + 1:least(40, line + 10)], chr(10)) END AS content
FROM s""",
    "release_tags_normalised": f"""
WITH v AS (
  SELECT CASE p_partkey % 3 WHEN 0 THEN 'org-a' WHEN 1 THEN 'org-b' ELSE 'org-c' END AS org, split_part(p_name, ' ', 1) AS repo,
         {_VERSION.format('.')} AS base, {_VERSION.format('-')} AS dashed, p_partkey AS k FROM part),
asked AS (SELECT DISTINCT repo, CASE WHEN k % 2 = 0 THEN 'v' || base ELSE base END AS version, base, dashed FROM v),
tags AS (SELECT DISTINCT org, repo, CASE k % 5 WHEN 0 THEN 'v' || base WHEN 1 THEN base WHEN 2 THEN 'v' || dashed WHEN 3 THEN dashed END AS tag FROM v),
hits AS (
  SELECT a.repo, a.version, t.org, t.tag, row_number() OVER (PARTITION BY a.repo, a.version ORDER BY t.org,
         CASE t.tag WHEN 'v' || base THEN 0 WHEN base THEN 1 WHEN 'v' || dashed THEN 2 ELSE 3 END) AS r
  FROM asked a JOIN tags t ON t.repo = a.repo AND t.tag IN ('v' || base, base, 'v' || dashed, dashed) WHERE t.org IN ('org-a', 'org-b'))
SELECT a.repo, a.version, h.org, h.tag,
       'https://github.com/' || h.org || '/' || a.repo || '/blob/' || CASE WHEN starts_with(h.tag, 'v') THEN '' ELSE 'v' END || h.tag || '/pom.xml' AS url
FROM asked a LEFT JOIN (SELECT * FROM hits WHERE r = 1) h USING (repo, version)""",
}
