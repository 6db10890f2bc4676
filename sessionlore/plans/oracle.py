"""The queries in SQL for another engine, over the same tables."""

from __future__ import annotations

from .queries import NOW_MS, SESSION
from .transcript_queries import ORACLE as TRANSCRIPTS

COUNTERS = "input_tokens, output_tokens, cache_write_tokens, cache_read_tokens"
SUMS = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in COUNTERS.split(", "))
MODEL = "CASE l_returnflag WHEN 'A' THEN 'claude-opus-4' WHEN 'R' THEN 'claude-haiku-4' ELSE 'claude-sonnet-4' END"
COST = "(CASE model WHEN 'claude-opus-4' THEN 1500 * input_tokens + 7500 * output_tokens + 1875 * cache_write_tokens + 150 * cache_read_tokens WHEN 'claude-haiku-4' THEN 80 * input_tokens + 400 * output_tokens + 100 * cache_write_tokens + 8 * cache_read_tokens ELSE 300 * input_tokens + 1500 * output_tokens + 375 * cache_write_tokens + 30 * cache_read_tokens END)::BIGINT"
FAMILY = "CASE WHEN model LIKE '%opus%' THEN 'Opus' WHEN model LIKE '%haiku%' THEN 'Haiku' ELSE 'Sonnet' END"
WEEK = NOW_MS - NOW_MS % 86_400_000 - 2 * 86_400_000
DAY = NOW_MS - NOW_MS % 86_400_000

FACTS = f"""WITH per_order AS (
    SELECT l_orderkey, max((epoch_us(l_shipdate) // 1000)) AS last_ms, count(*) AS message_count,
        CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min({MODEL}) ELSE 'mixed' END AS model
    FROM lineitem GROUP BY 1
), sessions AS (
    SELECT o_orderkey AS session_key, n_name AS project, '/' || c_mktsegment || '/' || o_orderkey || '.jsonl' AS path, o_orderkey::VARCHAR AS session_id,
        (epoch_us(o_orderdate) // 1000) AS first_ms, last_ms, greatest(0, coalesce(last_ms - (epoch_us(o_orderdate) // 1000), 0))::BIGINT AS duration_ms, coalesce(message_count, 0)::BIGINT AS message_count, model
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN per_order ON l_orderkey = o_orderkey
), tokens AS (
    SELECT l_orderkey AS session_key, {MODEL} AS model, sum(round(l_quantity)::BIGINT)::BIGINT AS input_tokens, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS output_tokens,
        sum(round(l_discount * 100)::BIGINT)::BIGINT AS cache_write_tokens, sum(round(l_tax * 100)::BIGINT)::BIGINT AS cache_read_tokens,
        list_sort(list(DISTINCT 'geo' || (l_suppkey % 3))) AS geos, list_sort(list(DISTINCT l_linestatus)) AS tiers, avg(round(l_quantity)) AS speed, sum(l_linenumber)::BIGINT AS iterations
    FROM lineitem GROUP BY 1, 2
), token_usage AS (SELECT *, {COST} AS cost_units FROM tokens
), tool_calls AS (SELECT user_id AS session_key, event_type AS tool, count(*) AS calls FROM events GROUP BY 1, 2
), turn_durations AS (SELECT user_id AS session_key, round(value * 1000)::BIGINT AS duration_ms FROM events
), pr_links AS (SELECT l_orderkey AS session_key, l_suppkey AS pr_number, '/pull/' || l_suppkey AS pr_url, 'repo' AS pr_repository, strftime(l_shipdate, '%Y-%m-%d') AS "at" FROM lineitem
), file_modifications AS (
    SELECT l_orderkey AS session_key, p_type || '/' || p_name || '/' || p_partkey AS file_path FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey
), thinking_usage AS (SELECT l_orderkey AS session_key, count(*) AS thinking_blocks FROM lineitem WHERE l_linenumber > 5 GROUP BY 1
), stop_reasons AS (SELECT o_orderkey AS session_key, o_orderstatus AS reason, 1::BIGINT AS times FROM orders
), messages AS (SELECT conv_id AS session_key, turn AS line_no, role, text AS content FROM conversations
)
"""
DATE = "strftime(make_timestamp(first_ms * 1000), '%Y-%m-%dT%H:%M:%S+00:00')"
EVERY = " WHERE session_key IN (SELECT session_key FROM sessions)"
RANK = "quantile_disc(duration_ms, 0.5)::DOUBLE AS p50_ms, quantile_disc(duration_ms, 0.95)::DOUBLE AS p95_ms, max(duration_ms) AS max_ms"
BY_PROJECT = f"SELECT project, count(DISTINCT session_key) AS sessions, {SUMS}, coalesce(sum(cost_units), 0)::BIGINT AS units, coalesce(string_agg(DISTINCT {FAMILY.replace('model', 't.model')}, ',' ORDER BY {FAMILY.replace('model', 't.model')}), '') AS models FROM sessions LEFT JOIN token_usage t USING (session_key) GROUP BY project"
TOOL_LIST = "string_agg(tool || '=' || calls, ',' ORDER BY tool || '=' || calls) AS tools"

# Unaccented lower-case terms, as both engines read them.
WORDS = "list_filter(string_split_regex(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
BM25 = "round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS score"
#: A ranked search where ``tf`` counts hits in the words r of the role and c of the text.
FORM = FACTS.replace("{", "{{").replace("}", "}}") + f""", t AS (SELECT session_key, line_no, role, {WORDS.replace('text', 'role').replace('{', '{{').replace('}', '}}')} AS r, {WORDS.replace('text', 'content').replace('{', '{{').replace('}', '}}')} AS c FROM messages),
        h AS (SELECT * EXCLUDE (r, c), ({{tf}})::DOUBLE AS tf, (len(r) + len(c))::DOUBLE AS size FROM t), g AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (tf > 0) AS df FROM h),
        s AS (SELECT session_key, line_no, role, {BM25} FROM h, g WHERE tf > 0) SELECT project, session_id, role, -score AS rank FROM s JOIN sessions USING (session_key) ORDER BY score DESC, path, line_no, role LIMIT 100"""
LITERAL = """, lines AS (
    SELECT session_key, line_no, role, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS sub_line, unnest(string_split(content, chr(10))) AS line FROM messages
), hits AS (
    SELECT l.*, project, session_id, path, first_ms, strpos({line}, '{word}') AS found FROM lines l JOIN sessions USING (session_key) WHERE contains({line}, '{word}')
    ORDER BY path, line_no, role, sub_line LIMIT 100
), cut AS (SELECT *, greatest(1, found - 80) AS a, least(length(line), found + 82) AS b FROM hits)
SELECT project, session_id, line_no, sub_line::INTEGER AS sub_line, role, {date} AS date,
    CASE WHEN a > 1 THEN '...' ELSE '' END || substring(line, a, b - a + 1) || CASE WHEN b < length(line) THEN '...' ELSE '' END AS snippet FROM cut"""
# Words with the stem of "things".
STEMMED = "['thing', 'things', 'thinge', 'thinges', 'thinged', 'thinging']"
MARKED = f"len(list_intersect({WORDS.replace('text', 'p')}, {STEMMED})) > 0"
ROLLOUT = """WITH items AS (
    SELECT 'conv-' || conv_id AS path, conv_id % 3 = 0 AS archived, 'message' AS kind, role, NULL AS name, NULL AS ms, turn AS line_no FROM conversations
    UNION ALL SELECT 'conv-' || user_id, user_id % 3 = 0, ['function_call', 'exec_command_end', 'reasoning', 'turn_aborted', 'web_search_call', 'patch_apply_end'][event_id % 6 + 1], NULL, event_type, (epoch_us(ts) // 1000), event_id + 1000 FROM events
), files AS (
    SELECT path, archived, split_part(path, '-', 2) AS id, arg_min(ms, line_no) FILTER (ms IS NOT NULL) AS ms,
        count(*) FILTER (kind = 'message' AND role = 'user') AS user_messages, count(*) FILTER (kind = 'message' AND role = 'assistant') AS agent_messages,
        count(*) FILTER (kind = 'reasoning') AS reasoning_items, count(*) FILTER (kind IN ('function_call', 'web_search_call')) AS tool_calls,
        count(*) FILTER (kind IN ('exec_command_end', 'patch_apply_end')) AS tool_results, count(*) FILTER (kind = 'turn_aborted') AS aborted_turns,
        0::BIGINT AS compacted_events, 0::BIGINT AS review_events
    FROM items GROUP BY 1, 2
) """
COST_TEXT = """CASE WHEN abs(usd) > 0 AND abs(usd) < 0.005 THEN sign || '0.' || lpad(floor(abs(usd) * 10000 + 0.5)::BIGINT::VARCHAR, 4, '0')
    ELSE sign || format('{:,}', (floor(abs(usd) * 100 + 0.5)::BIGINT // 100)) || '.' || lpad((floor(abs(usd) * 100 + 0.5)::BIGINT % 100)::VARCHAR, 2, '0') END"""

ORACLE = {
    "sessions_recent": FACTS + f"SELECT project, session_id, path, first_ms, {DATE} AS date, message_count, duration_ms, model FROM sessions WHERE project ILIKE '%nation_1%' OR path ILIKE '%nation_1%' ORDER BY first_ms DESC NULLS LAST, path LIMIT 20",
    "sessions_by_file": FACTS + f"SELECT project, session_id, path, first_ms, {DATE} AS date, message_count, duration_ms, model FROM sessions s WHERE EXISTS (SELECT 1 FROM file_modifications f WHERE f.session_key = s.session_key AND f.file_path ILIKE '%10%') ORDER BY first_ms DESC NULLS LAST, path LIMIT 50",
    "cost_by_project": FACTS + f"SELECT project, sessions, {COUNTERS}, round(units / 1e8 / sessions, 6) AS avg_cost_per_session_usd, units / 1e8 AS cost_usd, models FROM ({BY_PROJECT}) ORDER BY units DESC, project LIMIT 20",
    "cost_by_project_total": FACTS + f", r AS (SELECT project, sessions, {COUNTERS} FROM ({BY_PROJECT}) ORDER BY units DESC, project LIMIT 5) SELECT project, sessions, {COUNTERS}, 0 AS is_total FROM r UNION ALL SELECT 'TOTAL', sum(sessions)::BIGINT, {', '.join(f'sum({c})::BIGINT' for c in COUNTERS.split(', '))}, 1 FROM r",
    "cost_per_session": FACTS + f"SELECT project, session_id, first_ms, CASE WHEN count(DISTINCT t.model) = 1 THEN min(t.model) END AS model, string_agg(DISTINCT t.model, ',' ORDER BY t.model) AS models, {SUMS}, sum(cost_units)::BIGINT / 1e8 AS cost_usd FROM sessions JOIN token_usage t USING (session_key) GROUP BY session_key, project, session_id, path, first_ms ORDER BY sum(cost_units) DESC, path LIMIT 100",
    "tools_aggregate": FACTS + "SELECT tool, sum(calls)::BIGINT AS calls FROM tool_calls JOIN sessions USING (session_key) GROUP BY tool ORDER BY calls DESC, tool LIMIT 20",
    "tools_per_session": FACTS + f"SELECT project, session_id, first_ms, {TOOL_LIST} FROM tool_calls JOIN sessions USING (session_key) GROUP BY session_key, project, session_id, first_ms, path ORDER BY first_ms DESC, path LIMIT 100",
    "tools_top3_per_session": FACTS + f"SELECT project, session_id, first_ms, {TOOL_LIST} FROM (SELECT * FROM tool_calls QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY calls DESC, tool) <= 3) JOIN sessions USING (session_key) GROUP BY session_key, project, session_id, first_ms, path ORDER BY first_ms DESC, path LIMIT 100",
    "turn_stats": FACTS + f"SELECT project, count(*) AS turn_count, round(avg(duration_ms), 6) AS avg_ms, {RANK} FROM turn_durations JOIN (SELECT session_key, project FROM sessions) USING (session_key) GROUP BY project ORDER BY avg(duration_ms) DESC, project LIMIT 20",
    "pr_latest": FACTS + "SELECT project, session_id, pr_number, pr_url, pr_repository, \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY pr_url ORDER BY \"at\" DESC, path DESC, pr_number DESC) AS k FROM pr_links JOIN sessions USING (session_key)) WHERE k = 1 ORDER BY \"at\" DESC, pr_url LIMIT 100",
    "model_usage": FACTS + f"""SELECT t.model, {FAMILY.replace('model', 't.model')} AS model_family, count(DISTINCT session_key) AS session_count, {SUMS},
        round(sum(cost_units)::BIGINT / 1e8 / count(DISTINCT session_key), 6) AS avg_cost_per_session_usd,
        round((sum(input_tokens) + sum(output_tokens) + sum(cache_write_tokens) + sum(cache_read_tokens))::DOUBLE / count(DISTINCT session_key), 6) AS avg_tokens_per_session,
        array_to_string(list_sort(list_distinct(flatten(list(tiers)))), ',') AS service_tiers, array_to_string(list_sort(list_distinct(flatten(list(geos)))), ',') AS inference_geos,
        round(avg(speed), 6) AS avg_speed, sum(iterations)::BIGINT AS total_iterations, sum(cost_units)::BIGINT / 1e8 AS cost_usd
        FROM token_usage t JOIN sessions USING (session_key) GROUP BY t.model""",
    "file_mods": FACTS + """, f AS (SELECT file_path, session_key, project, last_ms FROM file_modifications JOIN sessions USING (session_key) WHERE file_path ILIKE '%a%'
        ), best AS (SELECT file_path, project FROM (SELECT file_path, project, row_number() OVER (PARTITION BY file_path ORDER BY count(*) DESC, project) AS k FROM f GROUP BY 1, 2) WHERE k = 1)
        SELECT file_path, count(*) AS modification_count, count(DISTINCT session_key) AS session_count, max(last_ms) AS last_touched_ms, any_value(best.project) AS top_project
        FROM f LEFT JOIN best USING (file_path) GROUP BY file_path ORDER BY 2 DESC, 1 LIMIT 200""",
    "session_detail_tools": FACTS + f"SELECT session_key, tool, calls FROM tool_calls{EVERY}",
    "session_detail_models": FACTS + f"SELECT session_key, model, {COUNTERS}, cost_units / 1e8 AS cost_usd FROM token_usage{EVERY}",
    "session_detail_files": FACTS + f"SELECT DISTINCT session_key, file_path FROM file_modifications{EVERY}",
    "session_detail_stop_reasons": FACTS + f"SELECT session_key, reason, times FROM stop_reasons{EVERY}",
    "session_detail_pull_requests": FACTS + f"SELECT * FROM pr_links{EVERY}",
    "session_detail_attachments": FACTS + "SELECT o_orderkey AS session_key, o_orderpriority AS filename, 'text/plain' AS mime_type FROM orders WHERE o_orderkey IN (SELECT session_key FROM sessions) AND o_orderpriority LIKE '1%'",
    "session_detail_permission_changes": FACTS + "SELECT o_orderkey AS session_key, o_orderpriority AS mode, strftime(o_orderdate, '%Y-%m-%d') AS \"at\" FROM orders WHERE o_orderkey IN (SELECT session_key FROM sessions) AND o_orderstatus = 'P'",
    "session_detail_turns": FACTS + f"SELECT session_key, count(*) AS turn_count, round(avg(duration_ms), 6) AS avg_ms, {RANK} FROM turn_durations{EVERY} GROUP BY session_key",
    "all_sessions_tools": FACTS + f"SELECT session_key, tool, calls FROM tool_calls{EVERY}",
    "all_sessions_models": FACTS + f"SELECT session_key, model, {COUNTERS}, cost_units / 1e8 AS cost_usd FROM token_usage{EVERY}",
    "all_sessions_files": FACTS + f"SELECT DISTINCT session_key, file_path FROM file_modifications{EVERY}",
    "all_sessions_stop_reasons": FACTS + f"SELECT session_key, reason, times FROM stop_reasons{EVERY}",
    "all_sessions_pull_requests": FACTS + f"SELECT * FROM pr_links{EVERY}",
    "all_sessions_attachments": FACTS + "SELECT o_orderkey AS session_key, o_orderpriority AS filename, 'text/plain' AS mime_type FROM orders WHERE o_orderkey IN (SELECT session_key FROM sessions) AND o_orderpriority LIKE '1%'",
    "all_sessions_permission_changes": FACTS + "SELECT o_orderkey AS session_key, o_orderpriority AS mode, strftime(o_orderdate, '%Y-%m-%d') AS \"at\" FROM orders WHERE o_orderkey IN (SELECT session_key FROM sessions) AND o_orderstatus = 'P'",
    "all_sessions_turns": FACTS + f"SELECT session_key, count(*) AS turn_count, round(avg(duration_ms), 6) AS avg_ms, {RANK} FROM turn_durations{EVERY} GROUP BY session_key",
    "session_detail": FACTS + f"""SELECT project, session_id, path, message_count, s.model, {SUMS}, sum(cost_units)::BIGINT / 1e8 AS cost_usd,
        (SELECT count(*) FROM tool_calls c WHERE c.session_key = any_value(s.session_key)) AS n_tools, (SELECT count(*) FROM file_modifications m WHERE m.session_key = any_value(s.session_key)) AS n_files,
        string_agg(t.model, ',' ORDER BY cost_units DESC, t.model) AS models
        FROM sessions s JOIN token_usage t USING (session_key) WHERE session_id = '{SESSION}' GROUP BY project, session_id, path, message_count, s.model""",
    "session_selector": FACTS + "SELECT session_id, path FROM sessions WHERE session_id LIKE '12%'",
    "session_selector_project": FACTS + "SELECT session_id, project FROM sessions WHERE contains(lower(project), 'nation_2')",
    "summary_totals": FACTS + f"""SELECT (SELECT count(*) FROM sessions) AS total_sessions, (SELECT count(*) FROM sessions WHERE first_ms >= {DAY}) AS sessions_today, (SELECT count(*) FROM sessions WHERE first_ms >= {WEEK}) AS sessions_this_week,
        {SUMS}, (SELECT sum(thinking_blocks)::BIGINT FROM thinking_usage) AS thinking_blocks, (SELECT round(avg(duration_ms), 6) FROM turn_durations) AS avg_turn_ms,
        (SELECT count(DISTINCT pr_url) FROM pr_links) AS pr_count, (SELECT count(DISTINCT file_path) FROM file_modifications) AS files_modified,
        sum(cost_units)::BIGINT / 1e8 AS cost_usd, coalesce(sum(cost_units) FILTER (first_ms >= {WEEK}), 0)::BIGINT / 1e8 AS week_cost_usd FROM sessions JOIN token_usage USING (session_key)""",
    "summary_top_projects": FACTS + "SELECT project, count(*) AS sessions FROM sessions GROUP BY project ORDER BY sessions DESC, project LIMIT 5",
    "summary_top_tools": FACTS + "SELECT tool, sum(calls)::BIGINT AS calls FROM tool_calls GROUP BY tool ORDER BY calls DESC, tool LIMIT 5",
    "summary_stop_reasons": FACTS + "SELECT reason, sum(times)::BIGINT AS times FROM stop_reasons GROUP BY reason ORDER BY times DESC, reason LIMIT 5",
    "summary_model_dist": FACTS + f"SELECT {FAMILY} AS family, count(DISTINCT session_key) AS sessions, sum(cost_units)::BIGINT / 1e8 AS cost_usd FROM token_usage GROUP BY 1 ORDER BY cost_usd DESC, family LIMIT 5",
    "summary_most_recent": FACTS + "SELECT project, session_id, first_ms, model, message_count FROM sessions WHERE first_ms IS NOT NULL ORDER BY first_ms DESC, path LIMIT 1",
    "summary": FACTS + f"""SELECT (SELECT count(*) FROM sessions) AS total_sessions, (SELECT count(*) FROM sessions WHERE first_ms >= {DAY}) AS sessions_today, (SELECT count(*) FROM sessions WHERE first_ms >= {WEEK}) AS sessions_this_week,
        sum(cost_units)::BIGINT / 1e8 AS cost_usd, coalesce(sum(cost_units) FILTER (first_ms >= {WEEK}), 0)::BIGINT / 1e8 AS week_cost_usd,
        (SELECT string_agg(project, ',' ORDER BY n DESC, project) FROM (SELECT project, count(*) AS n FROM sessions GROUP BY project ORDER BY n DESC, project LIMIT 5)) AS projects,
        (SELECT string_agg(family, ',' ORDER BY c DESC, family) FROM (SELECT {FAMILY} AS family, sum(cost_units) AS c FROM token_usage GROUP BY 1)) AS families,
        (SELECT session_id FROM sessions ORDER BY first_ms DESC, path LIMIT 1) AS most_recent FROM sessions JOIN token_usage USING (session_key)""",
    "search_bm25": f"""WITH t AS (SELECT doc_id, {WORDS} AS terms FROM documents), h AS (SELECT doc_id, len(list_filter(terms, lambda x: x = 'the'))::DOUBLE AS tf, len(terms)::DOUBLE AS size FROM t),
        g AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (tf > 0) AS df FROM h) SELECT doc_id, {BM25} FROM h, g WHERE tf > 0 ORDER BY round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)), 9) DESC, doc_id LIMIT 50""",
    "search_messages": FACTS + f""", t AS (SELECT session_key, line_no, role, list_concat({WORDS.replace('text', 'role')}, {WORDS.replace('text', 'content')}) AS terms FROM messages),
        h AS (SELECT * EXCLUDE (terms), len(list_filter(terms, lambda x: x = 'assistant'))::DOUBLE AS tf, len(terms)::DOUBLE AS size FROM t), g AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (tf > 0) AS df FROM h),
        s AS (SELECT session_key, line_no, role, {BM25} FROM h, g WHERE tf > 0) SELECT project, session_id, role, -score AS rank FROM s JOIN sessions USING (session_key) ORDER BY score DESC, path, line_no, role LIMIT 30""",
    "search_stemmed": FACTS + f""", t AS (SELECT session_key, line_no, role, content, list_concat({WORDS.replace('text', 'role')}, {WORDS.replace('text', 'content')}) AS terms FROM messages),
        h AS (SELECT * EXCLUDE (terms), len(list_filter(terms, lambda x: list_contains({STEMMED}, x)))::DOUBLE AS tf, len(terms)::DOUBLE AS size FROM t),
        g AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (tf > 0) AS df FROM h),
        s AS (SELECT session_key, line_no, role, content, {BM25} FROM h, g WHERE tf > 0),
        b AS (SELECT project, session_id, role, -score AS rank, string_split_regex(content, '\\s+') AS parts FROM s JOIN sessions USING (session_key) ORDER BY score DESC, path, line_no, role LIMIT 100),
        a AS (SELECT *, greatest(1, coalesce(list_position(list_transform(parts, lambda p: {MARKED}), true), 0) - 10) AS first FROM b)
        SELECT project, session_id, role, rank, CASE WHEN first > 1 THEN '...' ELSE '' END
            || array_to_string(list_transform(parts[first:first + 19], lambda p: CASE WHEN {MARKED} THEN '[[' || p || ']]' ELSE p END), ' ')
            || CASE WHEN first + 20 <= len(parts) THEN '...' ELSE '' END AS snippet FROM a""",
    "search_prefix": FORM.format(tf="len(list_filter(list_concat(r, c), lambda x: starts_with(x, 'th')))"),
    "search_column": FORM.format(tf="len(list_filter(r, lambda x: x = 'assistant'))"),
    # Words with the stem "than".
    "search_first": FORM.format(tf="CASE WHEN c[1] IN ('than', 'thans', 'thanful', 'thanness', 'thanfulness') THEN 1 ELSE 0 END"),
    "search_phrase": f"""WITH t AS (SELECT doc_id, {WORDS} AS terms FROM documents), h AS (SELECT doc_id, len(list_filter(range(1, len(terms)), lambda i: terms[i] = 'of' AND terms[i + 1] = 'the'))::DOUBLE AS tf, len(terms)::DOUBLE AS size FROM t),
        g AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (tf > 0) AS df FROM h) SELECT doc_id, {BM25} FROM h, g WHERE tf > 0""",
    "search_lines_cs": FACTS + LITERAL.format(line="line", word="The", date=DATE),
    "search_lines_ci": FACTS + LITERAL.format(line="lower(line)", word="the", date=DATE),
    "export_markdown": FACTS + f"""SELECT path, '# Session: ' || left(session_id, 8) || chr(10) || chr(10) || '**Project:** ' || project || chr(10) || '**Date:** ' || strftime(make_timestamp(first_ms * 1000), '%Y-%m-%d %H:%M UTC') || chr(10)
        || CASE WHEN model IS NULL THEN '' ELSE '**Model:** ' || replace(model, 'claude-', '') || chr(10) END || chr(10) || '---' || chr(10) || chr(10) || coalesce(parts, '') AS document
        FROM sessions LEFT JOIN (SELECT session_key, string_agg('## ' || upper(left(role, 1)) || substring(role, 2) || chr(10) || content || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY line_no) AS parts FROM messages GROUP BY 1) USING (session_key)""",
    "export_json": "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS document, count(*) AS messages FROM conversations GROUP BY conv_id",
    "codex_counters": ROLLOUT + f"""SELECT count(*) AS total_sessions, count(*) FILTER (NOT archived) AS active_session_files, count(*) FILTER (archived) AS archived_sessions,
        count(*) FILTER (ms >= {DAY} AND ms < {DAY + 86_400_000}) AS sessions_today, count(*) FILTER (ms >= {WEEK}) AS sessions_this_week,
        {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('user_messages', 'agent_messages', 'reasoning_items', 'tool_calls', 'tool_results', 'aborted_turns', 'compacted_events', 'review_events'))} FROM files""",
    "codex_files": ROLLOUT + "SELECT * FROM files",
    "codex_dedupe": "SELECT id, archived, path FROM (SELECT o_custkey::VARCHAR AS id, o_orderstatus = 'F' AS archived, '/' || lpad(o_orderkey::VARCHAR, 10, '0') AS path FROM orders) QUALIFY row_number() OVER (PARTITION BY id ORDER BY archived DESC, path) = 1",
    "codex_top": ROLLOUT + "SELECT CASE kind WHEN 'function_call' THEN name WHEN 'exec_command_end' THEN 'exec' WHEN 'patch_apply_end' THEN 'apply_patch' ELSE 'web_search' END AS name, count(*) AS count FROM items WHERE kind IN ('function_call', 'exec_command_end', 'patch_apply_end', 'web_search_call') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "sync_plan": """WITH o AS (SELECT o_orderkey AS k, '/' || o_orderkey AS path, round(o_totalprice)::BIGINT AS size, o_orderdate FROM orders), a AS (SELECT * FROM o WHERE k % 5 <> 0), b AS (SELECT k, path, size + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS size, o_orderdate FROM o WHERE k % 7 <> 0)
        SELECT path, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' WHEN a.size = b.size AND a.o_orderdate = b.o_orderdate THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (path)""",
    "fn_decode_path": """WITH p AS (SELECT p_partkey, '/home/.x/' || replace(replace(replace(p_name, ' ', '-'), '--', '/.'), '-', '/') AS path FROM part) SELECT p_partkey, path, path AS canonical, split_part(path, '/', -1) || ' (worktree)' AS display FROM p""",
    "fn_short_name": """WITH p AS (SELECT p_partkey, '/srv/projects/' || p_type || '/' || p_brand || '/' || p_name || '/' || p_partkey || '/' || p_type AS path FROM part), t AS (SELECT *, right(path, 52) AS tail FROM p)
        SELECT p_partkey, CASE WHEN strlen(path) <= 55 THEN path WHEN contains(tail, '/') THEN '…' || substring(tail, strpos(tail, '/')) ELSE '…' || tail END AS short_name FROM t""",
    "fn_format_duration": """WITH d AS (SELECT l_orderkey, l_linenumber, (l_orderkey * l_linenumber * 977)::BIGINT AS ms, (l_orderkey * l_linenumber * 977)::BIGINT // 1000 AS s FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN ms = 0 THEN '-' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || (s % 60) || 's' ELSE (s // 3600) || 'h' || (s % 3600 // 60) || 'm' END AS duration FROM d""",
    "fn_fmt_cost": f"""WITH c AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders), u AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN -cents / 1000.0::DOUBLE ELSE cents / 8.0::DOUBLE END AS usd FROM c), s AS (SELECT *, CASE WHEN usd < 0 THEN '-$' ELSE '$' END AS sign FROM u)
        SELECT o_orderkey, {COST_TEXT} AS cost, format('{{:,}}', cents) AS count FROM s""",
    "fn_timestamps": """WITH t AS (SELECT event_id, ts, (epoch_us(ts) // 1000) % 1000 AS f FROM events) SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN f = 0 THEN '' ELSE '.' || lpad(f::VARCHAR, 3, '0') END || '+00:00' AS text, strftime(ts, '%H:%M:%S') AS short FROM t""",
    "fn_coerce_json": """WITH e AS (SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, event_id % 7 AS m FROM events) SELECT event_id, CASE WHEN m = 0 THEN k WHEN m = 2 AND k = 0 THEN 0 ELSE 0 END::BIGINT AS count, CASE WHEN m = 3 THEN k::VARCHAR END AS text,
        CASE m WHEN 0 THEN k::DOUBLE WHEN 1 THEN k + 0.5 WHEN 2 THEN (-k)::DOUBLE END::DOUBLE AS number, CASE WHEN m = 6 THEN 1 ELSE 0 END::BIGINT AS items FROM e""",
    "fn_split_values": "SELECT c_custkey, c_mktsegment || '|' || c_name AS parts FROM customer",
    "tail_format": """WITH e AS (SELECT event_id, event_type, event_id % 3 AS k, ['error', 'WARN', 'info', 'trace'][event_id % 4 + 1] AS level FROM events)
        SELECT event_id, CASE k WHEN 0 THEN '03:04:05 [' || level || '] ' || event_type WHEN 1 THEN '03:04:05 [system]' || CASE WHEN event_id % 3 > 0 THEN ' ' || (event_id % 3) || 'ms' ELSE '' END ELSE 'a Warning of ' || event_type END AS line,
        CASE k WHEN 0 THEN CASE lower(level) WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warn' WHEN 'trace' THEN 'debug' ELSE 'plain' END WHEN 1 THEN 'record' ELSE CASE WHEN contains(event_type, 'error') THEN 'error' ELSE 'warn' END END AS class FROM e""",
} | TRANSCRIPTS
