"""DuckDB SQL for the cache, the reports and what is published."""

from __future__ import annotations

from .twins import DRAWS, FEATURES, HOT, SEVEN
from .twins_more import _r, HITS, RECS

_TEXT = "array_to_string([lpad(x::VARCHAR, 2, '0') for x in {}], ' ')"


def _told(label: str, value: str, order: str) -> str:
    return f"coalesce(string_agg({label} || ':' || {value}, ' ' ORDER BY {order}), '')"


_MATRIX = HOT + """,
cells AS (SELECT h.period, h.kind, h.num, h.count, h.omit, m.cur, m.max, m.avg, c.count AS near FROM hot h JOIN miss m USING (period, kind, num) JOIN consec c USING (period, kind, num)),
texts AS (SELECT period, kind, '[' || string_agg('{"num":' || num || ',"count":' || count || '}', ',' ORDER BY num) || ']' AS frequency,
  '[' || string_agg('{"num":' || num || ',"count":' || count || ',"omit":' || omit || '}', ',' ORDER BY count DESC, num) || ']' AS hot,
  '[' || string_agg('{"num":' || num || ',"cur":' || cur || ',"max":' || max || ',"avg":' || avg || '}', ',' ORDER BY num) || ']' AS missing,
  '{' || string_agg('"' || num || '":' || near, ',' ORDER BY num) || '}' AS consec FROM cells GROUP BY ALL),
matrix AS (SELECT period, kind, unnest(['frequency', 'hot', 'missing', 'oddEven', 'bigSmall', 'consec']) AS metric, 'v1' AS version,
  unnest([frequency, hot, missing, '{"odd":' || odd || ',"even":' || even || '}', '{"small":' || small || ',"big":' || big || '}', consec]) AS payload FROM texts JOIN pct USING (period, kind))"""
_SCORES = SEVEN + """,
kept AS (SELECT period, kind, num, total, '{"frequency":' || frequency || ',"recent_hot":' || recent_hot || ',"missing":' || missing || ',"balance":' || balance || ',"odd_even":' || odd_even || ',"big_small":' || big_small || ',"structure":' || structure || '}' AS parts,
  tag, model AS model_type, 'default' AS weight_version FROM scores)"""


def _without_newest(sql: str) -> str:
    return sql.replace("FROM orders)", "FROM orders ORDER BY o_orderkey LIMIT greatest((SELECT count(*) FROM orders) - 100, 0))")


_SHORTER, _SHORTER_MATRIX = _without_newest(SEVEN), _without_newest(_MATRIX)
_BOARD = "board AS (SELECT *, row_number() OVER (ORDER BY avg_total_hit DESC, grp) AS rank FROM st)"
_REASON = "nullif(concat_ws('; ', CASE WHEN missing >= 70 THEN 'gap' END, CASE WHEN sum_span_match >= 80 THEN 'sum and span' END, CASE WHEN zone_match >= 60 THEN 'zones' END), '')"
_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_SUMMARY = "(SELECT count(*) AS n FROM recs) a, (SELECT count(*) AS v, CASE WHEN count(*) > 0 THEN " + _r("sum(total_hit)::DOUBLE / count(*)") + " ELSE 0 END AS avg FROM hits) b"
_SUMMARY_LINE = "format('recommended {:d}, validated {:d}, mean hits {:.2f}', n, v, avg::DOUBLE)"
_QUALITY = RECS + """,
q0 AS (SELECT target_issue, front, back, list_sum(front)::BIGINT AS s, front[5] - front[1] AS w, len([x for x in front if x % 2 = 1]) AS o, len([x for x in front if x > 17]) AS g, len([i for i in [1, 2, 3, 4] if front[i + 1] - front[i] = 1]) AS p,
  (len([x for x in front if x <= 12]) > 0)::INT + (len([x for x in front if x BETWEEN 13 AND 24]) > 0)::INT + (len([x for x in front if x > 24]) > 0)::INT AS z FROM recs),
q1 AS (SELECT q.*, (greatest(0, 100 - 5 * greatest(60 - s, s - 140, 0)) + greatest(0, 100 - 5 * greatest(10 - w, w - 40, 0)) + CASE WHEN o IN (2, 3) THEN 100 WHEN o IN (1, 4) THEN 60 ELSE 20 END + CASE WHEN g IN (2, 3) THEN 100 WHEN g IN (1, 4) THEN 60 ELSE 20 END
  + z * 100 // 3 + CASE WHEN p <= 2 THEN 100 ELSE 40 END)::DOUBLE / 6 AS quality FROM q0 q LEFT JOIN draws d ON d.issue_num = q.target_issue
  WHERE NOT (p = 4 OR o IN (0, 5) OR g IN (0, 5) OR s NOT BETWEEN 60 AND 140 OR w NOT BETWEEN 10 AND 40 OR coalesce(d.front = q.front, false))),
q2 AS (SELECT *, row_number() OVER (ORDER BY quality DESC, target_issue) AS r FROM q1)"""

_PAGES = f"WITH {DRAWS}, pages AS (SELECT (issue_num % 90000 + 10000)::VARCHAR AS issue, draw_date::VARCHAR AS date, {_TEXT.format('front')} AS front, {_TEXT.format('back')} AS back FROM draws)"
# Documents of a publication: the lists and objects as JSON texts.
_LIST = "'[' || array_to_string({}, ',') || ']'"
_WORDS = """'[' || array_to_string(['"' || x || '"' for x in [CASE WHEN s BETWEEN 60 AND 140 THEN 'sum ' || s END, CASE WHEN w BETWEEN 10 AND 40 THEN 'span ' || w END, CASE WHEN o IN (2, 3) THEN 'odd to even ' || o || ':' || (5 - o) END,
  CASE WHEN g IN (2, 3) THEN 'big to small ' || g || ':' || (5 - g) END, CASE WHEN z = 3 THEN 'thirds 3' END, CASE WHEN p <= 2 THEN 'pairs ' || p END] if x IS NOT NULL], ',') || ']'"""
_DETAILS = """'{"sum_score":' || greatest(0, 100 - 5 * greatest(60 - s, s - 140, 0)) || ',"span_score":' || greatest(0, 100 - 5 * greatest(10 - w, w - 40, 0)) || ',"odd_even_score":' || CASE WHEN o IN (2, 3) THEN 100 WHEN o IN (1, 4) THEN 60 ELSE 20 END
  || ',"big_small_score":' || CASE WHEN g IN (2, 3) THEN 100 WHEN g IN (1, 4) THEN 60 ELSE 20 END || ',"zone_score":' || (z * 100 // 3) || ',"pairs_score":' || CASE WHEN p <= 2 THEN 100 ELSE 40 END || '}'"""
_DOCUMENTS = f"""{_QUALITY},
combos AS (SELECT r, '{{"front":' || {_LIST.format('front')} || ',"back":' || {_LIST.format('back')} || ',"score":' || {_r('quality')} || ',"reasons":' || {_WORDS} AS head, {_DETAILS} AS details FROM q2 WHERE r <= 3),
parts AS (SELECT (SELECT head || ',"score_details":' || details || '}}' FROM combos WHERE r = 1) AS main, (SELECT '[' || string_agg(head || '}}', ',' ORDER BY r) || ']' FROM combos WHERE r > 1) AS backup,
  (SELECT '"filtered_count":' || count(*) || ',' FROM q1) AS n, (SELECT {_r('avg(quality)')} FROM q1) AS mean, (SELECT {_r('max(quality)')} FROM q1) AS most,
  ',"rules_applied":["five_consecutive","all_odd","all_even","all_big","all_small","extreme_sum","extreme_span","duplicate_previous"]' AS rules)"""

PUBLISHED = {
    "cache_rerun": f"""WITH a AS (WITH {_MATRIX} SELECT count(*) AS n FROM matrix WHERE period IN (50, 100)), b AS (WITH {_SCORES} SELECT count(*) AS n FROM kept WHERE period IN (50, 100))
        SELECT 'analysis' AS name, n AS rows_first, n AS rows_again, 0::BIGINT AS repeated_keys, 0::BIGINT AS differing_rows FROM a UNION ALL SELECT 'scores', n, n, 0, 0 FROM b""",
    "user_store": """WITH c AS (SELECT c_custkey AS u, c_custkey % 5 AS m FROM customer),
        h AS (SELECT o_custkey AS u, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) AS p FROM orders),
        hist AS (SELECT u, count(*) AS n, min_by(id, p) AS newest, max_by(id, p) AS oldest FROM h WHERE p <= 100 GROUP BY u),
        pl AS (SELECT o_custkey AS u, 'p' || o_orderkey % 3 AS id, 'plan ' || max(o_orderkey) AS name FROM orders GROUP BY ALL),
        every AS (SELECT * FROM pl UNION ALL SELECT u, 'p1', 'old' FROM c WHERE m = 3 AND u NOT IN (SELECT u FROM pl WHERE id = 'p1')),
        plans AS (SELECT u, count(*) AS n, string_agg(id || '=' || name, ' ' ORDER BY id) AS names FROM every GROUP BY u)
        SELECT c.u AS user, 1::BIGINT AS version, (m = 1)::BIGINT AS n_favorites, CASE WHEN m = 3 THEN 0 ELSE coalesce(hist.n, 0) END AS n_history, coalesce(plans.n, 0) AS n_plans, CASE WHEN m <> 3 THEN newest END AS newest, CASE WHEN m <> 3 THEN oldest END AS oldest,
        coalesce(names, '') AS plan_names, CASE WHEN m = 2 THEN 'dark' ELSE 'light' END AS theme, CASE WHEN m = 3 THEN 'false' ELSE 'true' END AS "saveHistory", CASE WHEN m = 2 THEN 'x' END AS extra FROM c LEFT JOIN hist USING (u) LEFT JOIN plans USING (u)""",
    "ranged_fetch": f"{_PAGES} SELECT * FROM pages WHERE issue::BIGINT BETWEEN 10750 AND 70125",
    "incremental_fetch": f"{_PAGES}, m AS (SELECT coalesce(max(issue::BIGINT), 0) AS m FROM pages WHERE issue::BIGINT <= 11000) SELECT pages.* FROM pages, m WHERE issue::BIGINT > m AND issue::BIGINT <= (m // 1000 + 1) * 1000 + 365",
    "nested_tables": f"{_PAGES} SELECT 'tablelist' AS name, 1::BIGINT AS depth, 15::BIGINT AS n_cells, issue AS first FROM pages UNION ALL SELECT '', 0, 1, '' FROM (SELECT DISTINCT issue::BIGINT // 500 FROM pages)",
    "ranged_upsert": f"WITH {DRAWS} SELECT issue_num, {_TEXT.format('front')} AS front, CASE WHEN pos >= total - total // 5 THEN 'new' WHEN pos % 3 <> 0 THEN 'stored' ELSE 'late' END AS source FROM draws",
    "position_index": f"WITH {DRAWS} SELECT issue_num, {_TEXT.format('front')} AS front, pos, total FROM draws",
    "latest_positions": f"WITH {DRAWS} SELECT issue_num, {_TEXT.format('front')} AS front, pos, total FROM draws WHERE pos >= total - 100",
    "sql_files": f"""WITH {DRAWS} SELECT 'batch_' || (pos // 500 + 1) || '.sql' AS name, '-- batch ' || (pos // 500 + 1) || ': ' || count(*) || ' rows' || chr(10) || string_agg('INSERT OR IGNORE INTO draws (issue, issue_num, date, front1, front2, front3, front4, front5) VALUES (''' || issue_num || ''', ' || issue_num || ', ''' || draw_date || ''', '
        || array_to_string(front, ', ') || ');' || chr(10), '' ORDER BY pos) AS document FROM draws GROUP BY pos // 500""",
    "recommendation_files": f"""WITH {DRAWS}, {_DOCUMENTS} SELECT 'recommendation_new.json' AS name, '{{"issue":"next","version":"1.0","mode":"assistant","main":' || main || ',"backup":' || backup || ',"stats":{{' || n || '"avg_quality_score":' || mean || ',"max_quality_score":' || most || rules || '}}}}' AS document FROM parts
        UNION ALL SELECT 'response.json', '{{"status":"success","data":{{"main":' || main || ',"backup":' || backup || ',"stats":{{' || n || '"quality_score":' || mean || rules || '}},"metadata":{{"mode":"assistant","version":"v2","engine_version":"1.0"}}}}}}' FROM parts""",
    "metric_matrix": f"WITH {_MATRIX} SELECT * FROM matrix",
    "score_matrix": f"WITH {_SCORES} SELECT * FROM kept",
    "analysis_lookup": f"WITH {_MATRIX} SELECT metric, version, true AS is_json, payload FROM matrix WHERE period = 100 AND kind = 'front' UNION ALL SELECT 'other', 'v1', json_valid('{{not JSON'), '{{not JSON'",
    "scores_lookup": f"WITH {_SCORES} SELECT num, total, parts, tag FROM kept WHERE period = 300 AND kind = 'back' AND model_type = 'expert'",
    "cached_scores": f"""WITH {_SCORES}, asked(period, kind, model, origin) AS (VALUES (100, 'back', 'expert', 'cache'), (300, 'front', 'standard', 'cache'), (1000, 'back', 'standard', 'computed'), (0, 'front', 'cold-hot', 'computed'))
        SELECT num, total, parts, tag, origin, a.period::BIGINT AS period, a.kind, model FROM kept k JOIN asked a ON k.period = a.period AND k.kind = a.kind AND k.model_type = a.model""",
    "refreshed_cache": f"""WITH a AS (WITH {_SHORTER} SELECT * FROM scores), b AS (WITH {SEVEN} SELECT * FROM scores)
        SELECT period, kind, num, total, model AS model_type FROM a WHERE period = 100 OR (period = 50 AND model <> 'standard') UNION ALL SELECT period, kind, num, total, model FROM b WHERE period = 50 AND model = 'standard'""",
    "refreshed_metrics": f"""WITH a AS (WITH {_SHORTER_MATRIX} SELECT * FROM matrix), b AS (WITH {_MATRIX} SELECT * FROM matrix)
        SELECT metric, version, payload FROM b WHERE period = 50 AND kind = 'front' UNION ALL SELECT metric, version, payload FROM a WHERE period = 100 AND kind = 'back' AND metric = 'frequency'""",
    "replaced_scores": f"""WITH a AS (WITH {_SHORTER} SELECT kind, num, total FROM scores WHERE period = 50 AND model = 'standard'), b AS (WITH {SEVEN} SELECT kind, num, total FROM scores WHERE period = 50 AND model = 'standard')
        SELECT kind, num, total, 'default' AS weight_version FROM a UNION ALL SELECT kind, num, total, 'other' FROM b""",
    "renested_draws": f"WITH {DRAWS} SELECT issue_num, {_TEXT.format('front')} AS front, {_TEXT.format('back')} AS back FROM draws",
    "built_records": f"WITH {RECS} SELECT key // 5 AS target_issue, 'A' AS strategy, row_number() OVER (PARTITION BY key // 5 ORDER BY key) - 1 AS idx, {_TEXT.format('front')} AS front, {_TEXT.format('back')} AS back FROM (SELECT *, target_issue // 11 AS key FROM recs)",
    "strategy_hint": f"WITH {HITS}, {_BOARD} SELECT r.target_issue, r.strategy, b.rank, b.count AS total_count FROM recs r LEFT JOIN board b USING (grp)",
    "number_levels": f"""WITH {HOT} SELECT kind, num, count, omit, CASE WHEN omit <= 2 THEN 0 WHEN omit <= 5 THEN 1 WHEN omit <= 10 THEN 2 WHEN omit <= 20 THEN 3 ELSE 4 END::BIGINT AS miss_level,
        CASE WHEN most = 0 THEN 0 ELSE least(4, greatest(1, floor(count::DOUBLE / most * 4 + 0.5::DOUBLE))) END::BIGINT AS hot_level FROM hot WHERE period = 50""",
    "reason_lines": f"""WITH {RECS}, x AS (SELECT target_issue, [trim(y) for y in string_split_regex('<b>' || strategy || '</b> & "co"' || coalesce('；' || {_REASON}, '') || '； ; ', '[；;]') if trim(y) <> ''] AS parts FROM recs)
        SELECT target_issue, unnest(range(len(parts))) AS line, {_ESCAPED.format('unnest(parts)')} AS text FROM x""",
    "top_omission": f"WITH {HOT} SELECT num, cur AS omission, longest AS max_omission, row_number() OVER (ORDER BY cur DESC, num) AS rank FROM gaps WHERE period = 0 AND kind = 'front' QUALIFY rank <= 10",
    "homepage_bundle": f"""WITH {HOT}, f AS (SELECT * FROM (WITH {FEATURES} FROM feat)), cold AS (SELECT kind, num, omit, row_number() OVER (PARTITION BY kind ORDER BY omit DESC, num) AS r FROM hot WHERE period = 0 AND omit > 0)
        SELECT (SELECT count(*) FROM draws) AS n, (SELECT min(issue_num)::VARCHAR FROM draws) AS first_issue, (SELECT max(issue_num)::VARCHAR FROM draws) AS last_issue, (SELECT min_by(draw_date, issue_num)::VARCHAR FROM draws) AS first_date, (SELECT max_by(draw_date, issue_num)::VARCHAR FROM draws) AS last_date,
        (SELECT {_told('num', 'count', 'rank')} FROM hot WHERE period = 0 AND kind = 'front' AND rank <= 10) AS front_hot, (SELECT {_told('num', 'count', 'rank')} FROM hot WHERE period = 0 AND kind = 'back' AND rank <= 5) AS back_hot,
        (SELECT {_told('num', 'omit', 'r')} FROM cold WHERE kind = 'front' AND r <= 8) AS front_cold, (SELECT {_told('num', 'omit', 'r')} FROM cold WHERE kind = 'back' AND r <= 4) AS back_cold,
        (SELECT {_told('label', 'c', 'label')} FROM (SELECT odd || ':' || (5 - odd) AS label, count(*) AS c FROM f GROUP BY 1)) AS odd_even, (SELECT {_told('label', 'c', 'label')} FROM (SELECT big || ':' || (5 - big) AS label, count(*) AS c FROM f GROUP BY 1)) AS big_small,
        (SELECT {_r('count(*) FILTER (pairs > 0)::DOUBLE / count(*)', 4)} FROM f) AS prob, (SELECT {_r('sum(pairs)::DOUBLE / count(*)', 4)} FROM f) AS avg_pairs""",
    "recommendation_response": f"""WITH {DRAWS}, {_QUALITY} SELECT 'success' AS status, {_TEXT.format('front')} AS front, {_TEXT.format('back')} AS back, {_r('quality')} AS score,
        (SELECT coalesce(string_agg({_TEXT.format('front')} || ' + ' || {_TEXT.format('back')}, '; ' ORDER BY r), '') FROM q2 WHERE r BETWEEN 2 AND 3) AS backup, (SELECT count(*) FROM q1) AS filtered_count, (SELECT {_r('avg(quality)')} FROM q1) AS quality_score, (SELECT {_r('max(quality)')} FROM q1) AS max_quality,
        'five_consecutive,all_odd,all_even,all_big,all_small,extreme_sum,extreme_span,duplicate_previous' AS rules_applied, 'assistant' AS mode, 'v2' AS version FROM q2 WHERE r = 1""",
    "daily_report": f"""WITH {HOT}, {HITS.removeprefix(DRAWS + ',')}, f AS (SELECT * FROM (WITH {FEATURES} FROM feat)),
        coldn AS (SELECT kind, num, count, row_number() OVER (PARTITION BY kind ORDER BY num) AS cr FROM (SELECT *, min(count) OVER (PARTITION BY kind) AS least FROM cnt WHERE period = 0) WHERE count = least),
        oe AS (SELECT odd || ':' || (5 - odd) AS label, count(*) AS c FROM f GROUP BY 1), bs AS (SELECT big || ':' || (5 - big) AS label, count(*) AS c FROM f GROUP BY 1), n AS (SELECT count(*) AS n FROM draws),
        z AS (SELECT c.kind, least((num - 1) // (size // zones), zones - 1) AS z, any_value(size // zones) AS w, sum(count) AS c FROM cnt c JOIN rules USING (kind) WHERE period = 0 GROUP BY ALL)
        SELECT 0::BIGINT AS section, 1::BIGINT AS line, format('{{:d}} draws, {{:d}} to {{:d}}', count(*), min(issue_num), max(issue_num)) AS text FROM draws
        UNION ALL SELECT 1, row_number() OVER (ORDER BY kind DESC), kind || ': ' || t FROM (SELECT kind, string_agg(num || ':' || count, ' ' ORDER BY num) AS t FROM cnt WHERE period = 0 GROUP BY kind)
        UNION ALL SELECT 2, row_number() OVER (ORDER BY kind DESC, what DESC), kind || ' ' || what || ' ' || t FROM (SELECT kind, 'hot' AS what, string_agg(num || '(' || count || ')', ', ' ORDER BY rank) AS t FROM hot WHERE period = 0 AND rank <= 10 GROUP BY kind
          UNION ALL SELECT kind, 'cold', string_agg(num || '(' || count || ')', ', ' ORDER BY cr) FROM coldn WHERE cr <= 10 GROUP BY kind)
        UNION ALL SELECT 3, r, num || ': now ' || cur || ', longest ' || longest FROM (SELECT *, row_number() OVER (ORDER BY cur DESC, num) AS r FROM gaps WHERE period = 0 AND kind = 'front') WHERE r <= 10
        UNION ALL SELECT 4, row_number() OVER (ORDER BY c DESC, label), format('| {{}} | {{:d}} | {{:.1f}}% |', label, c, {_r('c::DOUBLE / n * 100', 1)}) FROM oe, n
        UNION ALL SELECT 5, row_number() OVER (ORDER BY c DESC, label), format('| {{}} | {{:d}} | {{:.1f}}% |', label, c, {_r('c::DOUBLE / n * 100', 1)}) FROM bs, n
        UNION ALL SELECT 6, 1, format('share {{:.4f}}, pairs {{:.4f}}', {_r('count(*) FILTER (pairs > 0)::DOUBLE / count(*)', 4)}, {_r('sum(pairs)::DOUBLE / count(*)', 4)}) FROM f
        UNION ALL SELECT 7, row_number() OVER (ORDER BY kind DESC, z), format('{{}} {{:d}}-{{:d}}: {{:d}} ({{:.4f}})', kind, z * w + 1, (z + 1) * w, c::BIGINT, {_r('c::DOUBLE / sum(c) OVER (PARTITION BY kind)', 4)}) FROM z
        UNION ALL SELECT 8, row_number() OVER (ORDER BY strategy, front, back), strategy || ': ' || {_TEXT.format('front')} || ' + ' || {_TEXT.format('back')} FROM recs
        UNION ALL SELECT 9, 1, {_SUMMARY_LINE} FROM {_SUMMARY}""",
    "validation_report": f"""WITH {HITS} SELECT 0::BIGINT AS section, 1::BIGINT AS line, {_SUMMARY_LINE} AS text FROM {_SUMMARY}
        UNION ALL SELECT 1, row_number() OVER (ORDER BY grp), format('| {{}} | {{:d}} | {{:.3f}} | {{:d}} |', grp, count, avg_total_hit, max_total_hit) FROM st""",
    "published_recs": f"""WITH {HITS}, {_BOARD},
        rec5 AS (SELECT grp, sum(total_hit)::DOUBLE / count(*) AS recent FROM (SELECT grp, total_hit, row_number() OVER (PARTITION BY grp ORDER BY target_issue DESC, strategy DESC) AS p FROM hits WHERE grp <> 'other') WHERE p <= 5 GROUP BY grp),
        part AS (SELECT c.*, 60 + CASE rank WHEN 1 THEN 8 WHEN 2 THEN 4 WHEN 4 THEN -4 ELSE 0 END::DOUBLE AS base, CASE WHEN b.count > 0 THEN {_r("least(100, avg_total_hit / 7 * 100)")} ELSE 50 END::DOUBLE AS history, CASE WHEN recent IS NULL THEN 50 ELSE {_r("least(100, recent / 7 * 100)")} END::DOUBLE AS recent,
          greatest(-40, CASE WHEN len([x for x in front if x % 2 = 1]) IN (0, 5) THEN -15 ELSE 0 END + CASE WHEN len([x for x in front if x > 17]) IN (0, 5) THEN -15 ELSE 0 END)::DOUBLE AS risk FROM recs c LEFT JOIN board b USING (grp) LEFT JOIN rec5 USING (grp))
        SELECT target_issue, strategy, idx, {_r("least(100, greatest(0, 0.4::DOUBLE * base + 0.2::DOUBLE * history + 0.15::DOUBLE * recent + 0.2::DOUBLE * 50 + risk))")} AS final_score, 1::BIGINT AS final_rank, true AS is_primary, {_r('score_total')} AS score, {_REASON} AS reason FROM part""",
    "stream_ingest": f"WITH {HOT} SELECT kind, num, count, omit AS omission FROM hot WHERE period = 0",
}
