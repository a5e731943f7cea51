"""DuckDB SQL for storing, scoring, evaluation and candidate queries."""

from __future__ import annotations

from .twins import APP, DRAWS, GAPS, HOT, OVERLAP

RECS = """
rr AS (SELECT c_custkey AS key, round(c_acctbal * 100)::BIGINT + 100000000 AS c FROM customer),
recs AS (SELECT key * 11 AS target_issue, ['A-balanced', 'B-hot and cold', 'C-random', 'D-scored', 'misc'][key % 5 + 1] AS strategy, ['A', 'B', 'C', 'D', 'other'][key % 5 + 1] AS grp, 0::BIGINT AS idx,
  list_sort([1 + ((key * 31 + c) % 35 + j * (1 + (c // 35 + key) % 34)) % 35 for j in [0, 1, 2, 3, 4]]) AS front,
  list_sort([1 + ((key * 17 + c // 7) % 12 + j * (1 + (c // 12 + key) % 11)) % 12 for j in [0, 1]]) AS back,
  CASE WHEN key % 5 = 3 THEN (key * 7 % 6000)::DOUBLE / 100 + 20 END AS score_total, CASE WHEN key % 5 = 3 THEN (key * 13 % 101)::DOUBLE END AS heat, CASE WHEN key % 5 = 3 THEN (key * 17 % 97)::DOUBLE END AS missing,
  CASE WHEN key % 5 = 3 THEN (key * 19 % 89)::DOUBLE END AS trend, CASE WHEN key % 5 = 3 THEN (key * 23 % 83)::DOUBLE END AS inherit, CASE WHEN key % 5 = 3 THEN (key * 29 % 101)::DOUBLE END AS zone_match, CASE WHEN key % 5 = 3 THEN (key * 31 % 101)::DOUBLE END AS sum_span_match FROM rr)"""
HITS = DRAWS + "," + RECS + """,
hit0 AS (SELECT r.*, d.front AS real_front, d.back AS real_back, len(list_intersect(r.front, d.front)) AS front_hit, len(list_intersect(r.back, d.back)) AS back_hit FROM recs r JOIN draws d ON r.target_issue = d.issue_num),
hits AS (SELECT *, front_hit + back_hit AS total_hit, [0, 1, 1, 2, 2, 3, 3, 4][front_hit + back_hit + 1]::BIGINT AS level, 7 - front_hit - back_hit AS distance FROM hit0),
st AS (SELECT g AS grp, count(h.grp) AS count, coalesce(floor(sum(front_hit)::DOUBLE / count(h.grp) * 1000 + 0.5::DOUBLE) / 1000, 0)::DOUBLE AS avg_front_hit, coalesce(floor(sum(back_hit)::DOUBLE / count(h.grp) * 1000 + 0.5::DOUBLE) / 1000, 0)::DOUBLE AS avg_back_hit,
  coalesce(floor(sum(total_hit)::DOUBLE / count(h.grp) * 1000 + 0.5::DOUBLE) / 1000, 0)::DOUBLE AS avg_total_hit, coalesce(max(total_hit), 0) AS max_total_hit, coalesce(floor(sum(distance)::DOUBLE / count(h.grp) * 100 + 0.5::DOUBLE) / 100, 0)::DOUBLE AS avg_distance
  FROM (SELECT unnest(['A', 'B', 'C', 'D']) AS g) LEFT JOIN hits h ON h.grp = g GROUP BY g),
fv AS (SELECT target_issue, total_hit, distance, unnest(['inherit', 'heat', 'missing', 'trend', 'structure']) AS factor, unnest([inherit, heat, missing, trend, (zone_match + sum_span_match) / 2]) AS value FROM hits WHERE grp = 'D'),
med AS (SELECT factor, list_sort(list(value))[count(*) // 2 + 1] AS median FROM fv GROUP BY factor),
review AS (SELECT target_issue, factor, value, median, CASE WHEN value < median THEN 'negative' WHEN total_hit > 0 THEN 'positive' ELSE 'neutral' END AS status FROM fv JOIN med USING (factor)),
perf AS (SELECT factor, count(*) AS times, count(*) FILTER (status = 'positive') AS positive, count(*) FILTER (status = 'neutral') AS neutral, count(*) FILTER (status = 'negative') AS negative FROM review GROUP BY factor),
perf2 AS (SELECT *, floor(positive::DOUBLE / times * 1000 + 0.5::DOUBLE) / 1000 AS score FROM perf)"""

#: Draws with planted faults, as documents would bring them: (pos, issue, date, front, back).
RAW = DRAWS + """,
raw AS (SELECT pos, CASE WHEN pos % 17 = 3 THEN 'x' || issue_num WHEN pos % 19 = 5 THEN '10001' ELSE lpad((issue_num % 90000 + 10000)::VARCHAR, 5, '0') END AS issue,
  CASE WHEN pos % 23 = 7 THEN 'no date' WHEN pos % 41 = 5 THEN year(draw_date)::VARCHAR WHEN pos % 43 = 6 THEN year(draw_date) || '-1-2' WHEN pos % 47 = 8 THEN draw_date || 'T10' WHEN pos % 53 = 9 THEN year(draw_date) || '-02-30' ELSE draw_date::VARCHAR END AS date,
  CASE WHEN pos % 29 = 11 THEN list_append(front[1:4], 36) WHEN pos % 31 = 2 THEN list_append(front[1:4], front[1]) WHEN pos % 59 = 10 THEN front[1:4] ELSE front END AS front,
  CASE WHEN pos % 37 = 4 THEN back[1:1] ELSE back END AS back FROM draws)"""


def _r(x: str, places: int = 2) -> str:
    scale = 10**places
    return f"floor(({x}) * {scale} + 0.5::DOUBLE) / {scale}"


def _norm(x: str) -> str:
    return _r(f"least(100::DOUBLE, greatest(0::DOUBLE, ({x}) / 100 * 100))")


def _stats(ts: str) -> str:
    """CTEs of all statistics as of the positions in `ts`."""
    return APP + f""",
ts AS ({ts}),
past AS (SELECT ts.t, a.kind, a.num, a.pos FROM ts JOIN app a ON a.pos < ts.t),
ends AS (SELECT * FROM past UNION ALL SELECT t, kind, num, t FROM ts, uni),
runs AS (SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY t, kind, num ORDER BY pos), -1) - 1 AS run FROM ends),
nums AS (SELECT t, kind, num, count(*) FILTER (pos >= t - 30 AND pos < t) AS b, count(*) FILTER (pos >= t - 100 AND pos < t) AS c, max(run) FILTER (pos = t) AS cur, max(run) AS longest,
  CASE WHEN count(*) FILTER (run > 0) > 0 THEN {_r("sum(run)::DOUBLE / count(*) FILTER (run > 0)")} ELSE 0 END::DOUBLE AS avg FROM runs GROUP BY ALL),
ov AS (SELECT a.pos, len(list_intersect(a.front, b.front)) AS kf, len(list_intersect(a.back, b.back)) AS kb FROM draws a JOIN draws b ON a.pos = b.pos + 1),
pk AS (SELECT ts.t, [{_r("count(*) FILTER (kf = 0)::DOUBLE / greatest(ts.t - 1, 1)", 6)}, {", ".join(_r(f"count(*) FILTER (kf = {k})::DOUBLE / greatest(ts.t - 1, 1)", 6) for k in range(1, 6))}] AS pf,
  [{", ".join(_r(f"count(*) FILTER (kb = {k})::DOUBLE / greatest(ts.t - 1, 1)", 6) for k in range(3))}] AS pb FROM ts JOIN ov ON ov.pos < ts.t GROUP BY ts.t),
sh AS (SELECT ts.t, [{", ".join(f"count(*) FILTER (len([x for x in front if x % 2 = 1]) = {k})::DOUBLE / ts.t" for k in range(6))}] AS po, [{", ".join(f"count(*) FILTER (len([x for x in front if x > 17]) = {k})::DOUBLE / ts.t" for k in range(6))}] AS pg,
  [{", ".join(_r(f"sum(len([x for x in front if least((x - 1) // 7, 4) = {z}]))::DOUBLE / (ts.t * 5)", 4) for z in range(5))}] AS pz,
  list_sort(list(list_sum(front)::BIGINT)) AS sums, max_by(front, d.pos) AS prev_front, max_by(back, d.pos) AS prev_back FROM ts JOIN draws d ON d.pos < ts.t GROUP BY ts.t),
fac AS (SELECT n.t, kind, num, {_norm("c::DOUBLE")} AS heat, CASE WHEN cur = 0 THEN 40 WHEN avg = 0 OR cur <= avg THEN 55 WHEN cur < longest THEN 80 ELSE 88 END::DOUBLE AS missing,
  {_norm("(least(1::DOUBLE, greatest(-1::DOUBLE, " + _r("b::DOUBLE / least(30, n.t) - c::DOUBLE / least(100, n.t)", 4) + ")) + 1) / 2 * 100")} AS trend, CASE WHEN cur = 0 THEN {_norm("(pf[2] + pf[3]) * 100")} ELSE 0 END::DOUBLE AS inherit FROM nums n JOIN pk USING (t))"""


def _scored(w: tuple[float, float, float, float]) -> str:
    return _norm(" + ".join(f"{v!r}::DOUBLE * {k}" for v, k in zip(w, ("heat", "missing", "trend", "inherit"))))


def _search(cfg: str, w: tuple[float, float, float, float], tf: int, tb: int, single: float, combo: float, sum_span: bool) -> str:
    """CTEs of the best combination for each t."""
    span = (
        "CASE WHEN s BETWEEN p25 AND p75 THEN 100 ELSE " + _norm("greatest(0::DOUBLE, 100 - least(abs(s - p25), abs(s - p75))::DOUBLE / greatest(1, p75 - p25) * 100)") + " END::DOUBLE" if sum_span else "50::DOUBLE"
    )
    return f""",
num{cfg} AS (SELECT *, {_scored(w)} AS score FROM fac),
pool{cfg} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, kind ORDER BY score DESC, num) AS r FROM num{cfg}) WHERE r <= CASE kind WHEN 'front' THEN {tf} ELSE {tb} END),
f{cfg} AS (SELECT a.t, [a.num, b.num, c.num, d.num, e.num] AS front, a.score + b.score + c.score + d.score + e.score AS points FROM (SELECT * FROM pool{cfg} WHERE kind = 'front') a
  JOIN pool{cfg} b ON b.kind = 'front' AND b.t = a.t AND b.r > a.r JOIN pool{cfg} c ON c.kind = 'front' AND c.t = a.t AND c.r > b.r JOIN pool{cfg} d ON d.kind = 'front' AND d.t = a.t AND d.r > c.r JOIN pool{cfg} e ON e.kind = 'front' AND e.t = a.t AND e.r > d.r),
b{cfg} AS (SELECT a.t, [a.num, b.num] AS back, a.score + b.score AS points FROM pool{cfg} a JOIN pool{cfg} b ON a.kind = 'back' AND b.kind = 'back' AND a.t = b.t AND a.r < b.r),
g{cfg} AS (SELECT f.*, list_sum(front)::BIGINT AS s, sums[least(f.t * 25 // 100, f.t - 1) + 1] AS p25, sums[least(f.t * 75 // 100, f.t - 1) + 1] AS p75, len(list_intersect(front, prev_front)) AS kf, {_norm("po[len([x for x in front if x % 2 = 1]) + 1] * 100")} AS odd_even_match,
  {_norm("pg[len([x for x in front if x > 17]) + 1] * 100")} AS big_small_match, {_norm("(pz[least((front[1] - 1) // 7, 4) + 1] + pz[least((front[2] - 1) // 7, 4) + 1] + pz[least((front[3] - 1) // 7, 4) + 1] + pz[least((front[4] - 1) // 7, 4) + 1] + pz[least((front[5] - 1) // 7, 4) + 1]) / 5 * 100")} AS zone_match, pf, pb, prev_back
  FROM f{cfg} f JOIN sh USING (t) JOIN pk USING (t)),
c{cfg} AS (SELECT g.t, front, back, g.points AS fp, b.points AS bp, {_norm("(pf[kf + 1] + pb[len(list_intersect(back, prev_back)) + 1]) / 2 * 100")} AS inherit_match, odd_even_match, big_small_match, zone_match, {span} AS sum_span_match FROM g{cfg} g JOIN b{cfg} b USING (t)),
d{cfg} AS (SELECT *, {_norm(f"{single!r}::DOUBLE * ((fp + bp) / 7) + {combo!r}::DOUBLE * " + _norm("0.2::DOUBLE * inherit_match + 0.2::DOUBLE * odd_even_match + 0.2::DOUBLE * big_small_match + 0.2::DOUBLE * zone_match + 0.2::DOUBLE * sum_span_match"))} AS total FROM c{cfg}),
best{cfg} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY total DESC, front, back) AS place FROM d{cfg}) WHERE place = 1)"""


_W = (0.3, 0.3, 0.25, 0.15)
_TEXT = "array_to_string([lpad(x::VARCHAR, 2, '0') for x in {}], ' ')"
_NEXT = "SELECT count(*) AS t FROM draws"


def _last(n: int) -> str:
    return f"SELECT pos AS t FROM draws WHERE pos >= total - {n}"


def _walk(cfg: str) -> str:
    return f"""SELECT '{cfg}' AS config, b.t, d.issue_num, len(list_intersect(b.front, d.front)) AS front_hit, len(list_intersect(b.back, d.back)) AS back_hit, b.total FROM best{cfg} b JOIN draws d ON d.pos = b.t"""


_GRID = _stats(_last(2)) + _search("G0", _W, 15, 8, 0.7, 0.3, False) + _search("G4", (0.25, 0.45, 0.2, 0.1), 15, 8, 0.7, 0.3, False) + _search("G6", _W, 15, 8, 0.5, 0.5, False) + _search("G7", _W, 12, 6, 0.7, 0.3, False)
_FUSED = f"""WITH {HITS}, board AS (SELECT *, row_number() OVER (ORDER BY avg_total_hit DESC, grp) AS rank FROM st),
rec5 AS (SELECT grp, sum(total_hit)::DOUBLE / count(*) AS recent FROM (SELECT grp, total_hit, row_number() OVER (PARTITION BY grp ORDER BY target_issue DESC, strategy DESC) AS p FROM hits WHERE grp <> 'other') WHERE p <= 5 GROUP BY grp),
cur AS (SELECT key // 5 AS target_issue, key % 5 AS pos, strategy, grp, front, back FROM (SELECT *, target_issue // 11 AS key FROM recs)),
part AS (SELECT c.*, 60 + CASE rank WHEN 1 THEN 8 WHEN 2 THEN 4 WHEN 4 THEN -4 ELSE 0 END::DOUBLE AS base, CASE WHEN b.count > 0 THEN {_r("least(100, avg_total_hit / 7 * 100)")} ELSE 50 END::DOUBLE AS history, CASE WHEN recent IS NULL THEN 50 ELSE {_r("least(100, recent / 7 * 100)")} END::DOUBLE AS recent,
  greatest(-40, CASE WHEN len([x for x in front if x % 2 = 1]) IN (0, 5) THEN -15 ELSE 0 END + CASE WHEN len([x for x in front if x > 17]) IN (0, 5) THEN -15 ELSE 0 END)::DOUBLE AS risk FROM cur c LEFT JOIN board b USING (grp) LEFT JOIN rec5 USING (grp)),
fin AS (SELECT *, {_r("least(100, greatest(0, 0.4::DOUBLE * base + 0.2::DOUBLE * history + 0.15::DOUBLE * recent + 0.2::DOUBLE * 50 + risk))")} AS final_score FROM part),
fused AS (SELECT *, row_number() OVER (PARTITION BY target_issue ORDER BY final_score DESC, pos) AS final_rank FROM fin)"""

MORE = {
    "latest_n_draws": f"WITH {DRAWS} SELECT issue_num, draw_date::VARCHAR AS draw_date, {_TEXT.format('front')} AS front, {_TEXT.format('back')} AS back FROM draws ORDER BY issue_num DESC LIMIT 50",
    "draw_summary": f"WITH {DRAWS} SELECT count(*) AS draws, min(issue_num) AS first_issue, min_by(draw_date, issue_num)::VARCHAR AS first_date, max(issue_num) AS last_issue, max_by(draw_date, issue_num)::VARCHAR AS last_date, max(draw_date)::VARCHAR AS updated FROM draws",
    "latest_group": f"WITH {RECS} SELECT target_issue, strategy, idx, {_TEXT.format('front')} AS front, {_TEXT.format('back')} AS back FROM recs WHERE target_issue = (SELECT max(target_issue) FROM recs)",
    "high_water_filter": f"WITH {DRAWS} SELECT issue_num FROM draws WHERE issue_num > (SELECT max(issue_num) FROM draws WHERE pos < total // 2)",
    "dup_key_check": f"WITH {RAW} SELECT issue, count(*) AS count FROM raw GROUP BY issue HAVING count(*) > 1",
    "validate_draws": f"""WITH {RAW}, f AS (SELECT *, min(pos) OVER (PARTITION BY issue) AS first FROM raw)
        SELECT pos, issue, concat_ws(',', CASE WHEN NOT regexp_full_match(issue, '\\d{{5}}') THEN 'issue' END, CASE WHEN NOT regexp_full_match(date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') OR try_cast(date AS DATE) IS NULL THEN 'date' END, CASE WHEN len(front) <> 5 OR list_min(front) < 1 OR list_max(front) > 35 THEN 'front' END,
        CASE WHEN len(back) <> 2 OR list_min(back) < 1 OR list_max(back) > 12 THEN 'back' END, CASE WHEN len(list_distinct(front)) <> 5 OR len(list_distinct(back)) <> 2 THEN 'repeat' END, CASE WHEN pos > first THEN 'duplicate' END) AS errors FROM f""",
    "validate_recs": f"""WITH {RECS}, x AS (SELECT key AS pos, CASE WHEN key % 13 = 1 THEN NULL ELSE target_issue END AS target_issue, CASE WHEN key % 17 = 2 THEN ' ' ELSE strategy END AS strategy, CASE WHEN key % 19 = 3 THEN -1 ELSE idx END AS idx,
        CASE WHEN key % 23 = 4 THEN front[1:4] ELSE front END AS front, CASE WHEN key % 29 = 5 THEN [back[1], back[1]] ELSE back END AS back FROM (SELECT *, target_issue // 11 AS key FROM recs))
        SELECT pos, target_issue, CASE WHEN target_issue IS NULL OR target_issue <= 0 THEN 'target' WHEN trim(strategy) = '' THEN 'strategy' WHEN idx < 0 THEN 'index' WHEN len(list_distinct(front)) <> 5 THEN 'front' WHEN len(list_distinct(back)) <> 2 THEN 'back' END AS reason FROM x""",
    "upsert_draws_cap": f"""WITH {DRAWS}, w AS (SELECT *, 0 AS new, 'stored' AS source FROM draws WHERE pos % 3 <> 0 UNION ALL SELECT *, 1, 'new' FROM draws WHERE pos % 2 = 0 OR pos % 3 = 0)
        SELECT issue_num, source, {_TEXT.format('front')} AS front FROM (SELECT *, row_number() OVER (PARTITION BY issue_num ORDER BY new DESC) AS r FROM w) WHERE r = 1 ORDER BY issue_num DESC LIMIT 1000""",
    "insert_ignore_draws": f"""WITH {DRAWS}, w AS (SELECT *, 0 AS new, 'stored' AS source FROM draws WHERE pos % 3 <> 0 UNION ALL SELECT *, 1, 'new' FROM draws WHERE pos % 2 = 0 OR pos % 3 = 0)
        SELECT issue_num, source FROM (SELECT *, row_number() OVER (PARTITION BY issue_num ORDER BY new) AS r FROM w) WHERE r = 1""",
    "upsert_recs": f"""WITH {RECS}, w AS (SELECT target_issue % 700 AS target_issue, grp AS strategy, idx, target_issue AS pos FROM recs) SELECT target_issue, strategy, idx, max_by(pos, place) AS pos, max_by(source, place) AS source
        FROM (SELECT *, pos AS place, 'stored' AS source FROM w WHERE pos % 3 <> 0 UNION ALL SELECT *, pos + 1000000000000, 'new' FROM w WHERE pos % 2 = 0 OR pos % 3 = 0) GROUP BY ALL""",
    "sql_batches": f"""WITH {DRAWS} SELECT pos // 500 AS batch, pos, '(' || issue_num || ', ''' || draw_date || ''')' AS row_values FROM draws""",
    "export_check_full": f"""WITH {RECS} SELECT target_issue::VARCHAR AS target_issue, count(*) AS n, array_to_string(list_sort(list(DISTINCT grp)), ',') AS found, 0::BIGINT AS bad_keys, count(*) FILTER (idx IS NULL) AS bad_idx, count(*) FILTER (len(front) <> 5) AS bad_front, count(*) FILTER (len(back) <> 2) AS bad_back,
        count(*) FILTER (NOT regexp_full_match(target_issue::VARCHAR, '[0-9]{{5}}')) AS bad_target, count(*) FILTER (grp = 'other') AS bad_strategy, (SELECT count(DISTINCT target_issue) FROM recs) = 1 AS one_target, array_to_string(list_sort(list(DISTINCT grp)), ',') = 'A,B,C,D' AS all_strategies FROM recs GROUP BY target_issue""",
    "export_check": f"WITH {RECS} SELECT count(DISTINCT target_issue) AS targets, array_to_string(list_sort(list(DISTINCT grp)), ',') AS found, count(DISTINCT target_issue) = 1 AS one_target, array_to_string(list_sort(list(DISTINCT grp)), ',') = 'A,B,C,D' AS all_strategies FROM recs",
    "favourites_once": f"WITH {RECS} SELECT {_TEXT.format('front')} AS front, {_TEXT.format('back')} AS back, min(target_issue) AS pos FROM recs GROUP BY 1, 2",
    "next_issues": f"WITH {DRAWS}, i AS (SELECT issue_num, (20 + issue_num % 7) * 1000 + issue_num % 353 + 1 AS issue FROM draws) SELECT issue_num, CASE WHEN issue % 1000 >= 353 THEN (issue // 1000 + 1) * 1000 + 1 ELSE issue + 1 END AS next FROM i",
    "number_score_front": f"WITH {_stats(_NEXT)}, s AS (SELECT *, {_scored(_W)} AS score FROM fac) SELECT num, heat, missing, trend, inherit, score FROM s WHERE kind = 'front'",
    "number_score_back": f"WITH {_stats(_NEXT)}, s AS (SELECT *, {_scored(_W)} AS score FROM fac) SELECT num, heat, missing, trend, inherit, score FROM s WHERE kind = 'back'",
    "d_search_top1": f"WITH {_stats(_NEXT)}{_search('', _W, 15, 8, 0.7, 0.3, True)} SELECT t, {_TEXT.format('front')} AS front, {_TEXT.format('back')} AS back, total, inherit_match, odd_even_match, big_small_match, zone_match, sum_span_match FROM best",
    "combo_score": f"""WITH {_stats(_NEXT)}, {RECS}, g AS (SELECT target_issue, list_sum(front)::BIGINT AS s, sums[least(t * 25 // 100, t - 1) + 1] AS p25, sums[least(t * 75 // 100, t - 1) + 1] AS p75, {_norm("(pf[len(list_intersect(front, prev_front)) + 1] + pb[len(list_intersect(back, prev_back)) + 1]) / 2 * 100")} AS inherit_match,
        {_norm("po[len([x for x in front if x % 2 = 1]) + 1] * 100")} AS odd_even_match, {_norm("pg[len([x for x in front if x > 17]) + 1] * 100")} AS big_small_match, {_norm("(pz[least((front[1] - 1) // 7, 4) + 1] + pz[least((front[2] - 1) // 7, 4) + 1] + pz[least((front[3] - 1) // 7, 4) + 1] + pz[least((front[4] - 1) // 7, 4) + 1] + pz[least((front[5] - 1) // 7, 4) + 1]) / 5 * 100")} AS zone_match
        FROM recs, sh JOIN pk USING (t)), h AS (SELECT *, CASE WHEN s BETWEEN p25 AND p75 THEN 100 ELSE {_norm("greatest(0::DOUBLE, 100 - least(abs(s - p25), abs(s - p75))::DOUBLE / greatest(1, p75 - p25) * 100)")} END::DOUBLE AS sum_span_match FROM g)
        SELECT target_issue, inherit_match, odd_even_match, big_small_match, zone_match, sum_span_match, {_norm("0.2::DOUBLE * inherit_match + 0.2::DOUBLE * odd_even_match + 0.2::DOUBLE * big_small_match + 0.2::DOUBLE * zone_match + 0.2::DOUBLE * sum_span_match")} AS score FROM h""",
    "walkforward_last": f"WITH {_stats(_last(3))}{_search('G0', _W, 15, 8, 0.7, 0.3, False)} {_walk('G0')}",
    "walkforward_last_grid": f"""WITH {_GRID}, w AS ({_walk("G0")} UNION ALL {_walk("G4")} UNION ALL {_walk("G6")} UNION ALL {_walk("G7")})
        SELECT config, count(*) AS n, {_r("sum(front_hit)::DOUBLE / count(*)", 4)} AS avg_front_hit, {_r("sum(back_hit)::DOUBLE / count(*)", 4)} AS avg_back_hit, {_r("sum(front_hit + back_hit)::DOUBLE / count(*)", 4)} AS avg_total_hit,
        {_r("sum(7 - front_hit - back_hit)::DOUBLE / count(*)", 2)} AS avg_distance, 0.1429::DOUBLE AS random_front_number, 0.7143::DOUBLE AS random_front_hits FROM w GROUP BY config""",
    "train_valid_last": f"""WITH {_stats(_last(4))}{_search('G0', _W, 15, 8, 0.7, 0.3, False)}, w AS (SELECT *, t >= (SELECT count(*) FROM draws) - 2 AS valid FROM ({_walk("G0")})),
        m AS (SELECT config, count(*) FILTER (NOT valid) AS n_train, count(*) FILTER (valid) AS n_valid, {_r("sum(front_hit + back_hit) FILTER (NOT valid)::DOUBLE / count(*) FILTER (NOT valid)", 4)} AS train, {_r("sum(front_hit + back_hit) FILTER (valid)::DOUBLE / count(*) FILTER (valid)", 4)} AS validation FROM w GROUP BY config)
        SELECT *, {_r("validation - train", 4)} AS delta, {_r("sqrt(validation / n_valid)", 4)} AS poisson_se FROM m""",
    "rec_hits": f"WITH {HITS} SELECT target_issue, strategy, front_hit, back_hit, total_hit, level, distance, 5 - front_hit + greatest(0, 1 - back_hit) AS distance2, 5 - front_hit AS distance3 FROM hits",
    "rec_pending_anti": f"WITH {HITS} SELECT target_issue, strategy FROM recs WHERE target_issue NOT IN (SELECT issue_num FROM draws)",
    "rec_validated_semi": f"WITH {HITS} SELECT target_issue, strategy FROM recs WHERE target_issue IN (SELECT issue_num FROM draws)",
    "validation_summary": f"WITH {HITS} SELECT (SELECT count(*) FROM recs) AS recommended, count(*) AS validated, {_r('sum(total_hit)::DOUBLE / count(*)')} AS avg_hit FROM hits",
    "hit_stats_by_strategy": f"WITH {HITS} SELECT * FROM st",
    "hit_level_hist": f"WITH {HITS} SELECT grp, measure, value, count(*) AS count FROM (SELECT grp, unnest(['level', 'front', 'back']) AS measure, unnest([level, front_hit, back_hit]) AS value FROM hits) GROUP BY ALL",
    "backtest_quality": f"WITH {HITS} SELECT count(*) AS records, count(DISTINCT target_issue) AS periods, {_r('sum(front_hit)::DOUBLE / count(*)', 3)} AS avg_front_hit, {_r('sum(back_hit)::DOUBLE / count(*)', 3)} AS avg_back_hit, {_r('sum(total_hit)::DOUBLE / count(*)', 3)} AS avg_total_hit FROM hits",
    "backtest_best": f"WITH {HITS} SELECT target_issue, strategy, total_hit, distance FROM hits ORDER BY total_hit DESC, distance, target_issue LIMIT 1",
    "factor_median_split": f"""WITH {HITS}, d AS (SELECT *, (SELECT list_sort(list(score_total))[count(*) // 2 + 1] FROM hits WHERE grp = 'D') AS median FROM hits WHERE grp = 'D')
        SELECT CASE WHEN score_total >= median THEN 'high' ELSE 'low' END AS half, median, count(*) AS count, {_r('sum(front_hit)::DOUBLE / count(*)', 3)} AS avg_front_hit, {_r('sum(back_hit)::DOUBLE / count(*)', 3)} AS avg_back_hit, {_r('sum(total_hit)::DOUBLE / count(*)', 3)} AS avg_total_hit FROM d GROUP BY 1, 2""",
    "factor_tristate": f"WITH {HITS} SELECT * FROM review",
    "factor_performance": f"WITH {HITS} SELECT *, CASE WHEN times < 3 THEN 'insufficient' WHEN score >= 0.3::DOUBLE THEN 'ok' WHEN score >= 0.15::DOUBLE THEN 'weak' ELSE 'poor' END AS verdict FROM perf2",
    "strategy_rank": f"""WITH {HITS}, f AS (SELECT {_r("sum(floor(score * 1000 + 0.5::DOUBLE)) / 5 / 1000", 3)} AS m FROM perf2)
        SELECT s.grp, avg_total_hit AS avg_hit, max_total_hit AS best_hit, coalesce((SELECT sum(distance)::BIGINT FROM hits h WHERE h.grp = s.grp), 0) AS total_distance, CASE WHEN count > 0 THEN m ELSE 0 END AS factor_score FROM st s, f""",
    "review_latest": f"""WITH {HITS} SELECT target_issue, strategy, front_hit, back_hit, total_hit, level, distance, abs(list_sum(front)::BIGINT - list_sum(real_front)::BIGINT) AS sum_diff FROM hits ORDER BY target_issue DESC, grp = 'D' DESC, strategy DESC LIMIT 1""",
    "adjustments": f"""WITH {HITS}, l AS (SELECT max(target_issue) AS t FROM hits WHERE grp = 'D')
        SELECT factor AS topic, CASE status WHEN 'negative' THEN 'reduce' ELSE 'keep' END AS advice FROM review, l WHERE target_issue = t AND status <> 'neutral' AND factor <> 'inherit'
        UNION ALL SELECT 'sum', CASE WHEN x > 25 THEN 'reduce' ELSE 'keep' END FROM (SELECT abs(list_sum(front)::BIGINT - list_sum(real_front)::BIGINT) AS x FROM hits, l WHERE target_issue = t) WHERE x > 25 OR x <= 10""",
    "strategy_board": f"WITH {HITS} SELECT grp AS strategy, count AS total_count, {_r('avg_total_hit / 7', 3)} AS hit_rate, avg_total_hit AS recent_score, row_number() OVER (ORDER BY avg_total_hit DESC, grp) AS rank FROM st",
    "recent5_hits": f"""WITH {HITS}, p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY target_issue DESC, strategy DESC) AS p FROM hits WHERE grp <> 'other') SELECT grp, string_agg(total_hit::VARCHAR, ' ' ORDER BY p DESC) AS hits, sum(total_hit)::BIGINT AS hit_sum, count(*) AS n FROM p WHERE p <= 5 GROUP BY grp""",
    "final_scores": f"{_FUSED} SELECT target_issue, pos, strategy, base, history, recent, risk, final_score, final_rank, final_rank = 1 AS is_primary FROM fused",
    "primary_selection": f"""WITH {RECS}, x AS (SELECT key // 5 AS target_issue, key % 5 AS pos, strategy, grp, score_total AS score, CASE WHEN key % 11 = 0 THEN (key % 50)::DOUBLE END AS final, key % 7 = 0 AS is_primary FROM (SELECT *, target_issue // 11 AS key FROM recs))
        SELECT target_issue, strategy, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY target_issue ORDER BY final IS NOT NULL DESC, final DESC, is_primary DESC, coalesce(score, -1) DESC, grp = 'D' DESC, pos) AS r FROM x) WHERE r = 1""",
    "risk_penalty": f"""WITH {HITS}, p AS (SELECT r.target_issue, r.front, d.front AS prev, list_sum(r.front)::BIGINT AS s FROM recs r LEFT JOIN draws d ON d.issue_num = r.target_issue)
        SELECT target_issue, greatest(-40, CASE WHEN len(list_intersect(front, prev)) >= 4 THEN -30 ELSE 0 END + CASE WHEN len([x for x in front if x % 2 = 1]) IN (0, 5) THEN -15 ELSE 0 END + CASE WHEN len([x for x in front if x > 17]) IN (0, 5) THEN -15 ELSE 0 END + CASE WHEN s < 60 OR s > 120 THEN -10 ELSE 0 END)::DOUBLE AS risk FROM p""",
    "reason_rules": f"WITH {RECS} SELECT target_issue, strategy, nullif(concat_ws('; ', CASE WHEN missing >= 70 THEN 'gap' END, CASE WHEN sum_span_match >= 80 THEN 'sum and span' END, CASE WHEN zone_match >= 60 THEN 'zones' END), '') AS reason FROM recs",
    "enriched_recs": f"""WITH {RECS}, n AS (SELECT *, nullif(concat_ws('; ', CASE WHEN missing >= 70 THEN 'gap' END, CASE WHEN sum_span_match >= 80 THEN 'sum and span' END, CASE WHEN zone_match >= 60 THEN 'zones' END), '') AS reason FROM recs)
        SELECT target_issue, CASE WHEN target_issue // 11 % 3 = 0 THEN grp || '-renamed' ELSE strategy END AS strategy, idx, {_r("score_total")} AS score, reason, grp = 'D' AS is_primary FROM n""",
    "combo_constraint_filter": f"""WITH {RECS} SELECT target_issue, {_TEXT.format('front')} AS front FROM recs WHERE len([x for x in front if x % 2 = 1]) IN (2, 3) AND len([x for x in front if x <= 17]) IN (2, 3) AND front[1] <= 12 AND len([x for x in front if x BETWEEN 13 AND 24]) > 0 AND front[5] >= 25
        AND len([i for i in [1, 2, 3, 4] if front[i + 1] - front[i] = 1]) <= 1""",
    "rejection_rules": f"""WITH {HITS}, x AS (SELECT r.front, d.front AS prev, list_sum(r.front)::BIGINT AS s, r.front[5] - r.front[1] AS w, len([x for x in r.front if x % 2 = 1]) AS o, len([x for x in r.front if x > 17]) AS g, len([i for i in [1, 2, 3, 4] if r.front[i + 1] - r.front[i] = 1]) AS p FROM recs r LEFT JOIN draws d ON d.issue_num = r.target_issue),
        y AS (SELECT p = 4 AS a, o = 5 AS b, o = 0 AS c, g = 5 AS d, g = 0 AS e, s NOT BETWEEN 60 AND 140 AS f, w NOT BETWEEN 10 AND 40 AS h, coalesce(len(list_intersect(front, prev)) = 5, false) AS i FROM x)
        SELECT count(*) AS n_candidates, count(*) FILTER (a OR b OR c OR d OR e OR f OR h OR i) AS n_rejected, count(*) FILTER (a) AS five_consecutive, count(*) FILTER (b) AS all_odd, count(*) FILTER (c) AS all_even, count(*) FILTER (d) AS all_big, count(*) FILTER (e) AS all_small, count(*) FILTER (f) AS extreme_sum, count(*) FILTER (h) AS extreme_span, count(*) FILTER (i) AS duplicate_previous FROM y""",
    "quality_metrics": f"""WITH {RECS}, x AS (SELECT target_issue, front, list_sum(front)::BIGINT AS s, front[5] - front[1] AS w, len([x for x in front if x % 2 = 1]) AS o, len([x for x in front if x > 17]) AS g, len([i for i in [1, 2, 3, 4] if front[i + 1] - front[i] = 1]) AS p FROM recs),
        y AS (SELECT target_issue, greatest(0, 100 - 5 * greatest(60 - s, s - 140, 0)) AS sum_score, greatest(0, 100 - 5 * greatest(10 - w, w - 40, 0)) AS span_score, CASE WHEN o IN (2, 3) THEN 100 WHEN o IN (1, 4) THEN 60 ELSE 20 END::BIGINT AS odd_even_score, CASE WHEN g IN (2, 3) THEN 100 WHEN g IN (1, 4) THEN 60 ELSE 20 END::BIGINT AS big_small_score,
        (((front[1] <= 12)::INT + (len([x for x in front if x BETWEEN 13 AND 24]) > 0)::INT + (front[5] >= 25)::INT) * 100 // 3)::BIGINT AS zone_score, CASE WHEN p <= 2 THEN 100 ELSE 40 END::BIGINT AS pairs_score FROM x)
        SELECT *, (sum_score + span_score + odd_even_score + big_small_score + zone_score + pairs_score)::DOUBLE / 6 AS quality FROM y""",
    "analyze_pick": f"""WITH {HOT}, {RECS}, n AS (SELECT target_issue, 'front' AS kind, unnest(front) AS num FROM recs UNION ALL SELECT target_issue, 'back', unnest(back) FROM recs) SELECT n.target_issue, n.kind, n.num, t.count, t.omit, t.tag FROM n JOIN tier t ON t.kind = n.kind AND t.num = n.num AND t.period = 100""",
    "parse_numbers": f"""WITH {RECS}, x AS (SELECT target_issue, (front[1] || ', ' || front[2] || ' ' || front[3] || CASE WHEN target_issue % 3 = 0 THEN ',99 x1' ELSE '' END || ',' || front[4] || CASE WHEN target_issue % 2 = 0 THEN ' ' || front[5] ELSE ' ' || front[1] END) AS input FROM recs),
        t AS (SELECT *, [s for s in regexp_split_to_array(trim(input), '[\\s,]+') if s <> ''] AS tok FROM x),
        v AS (SELECT target_issue, list_distinct([s::BIGINT for s in tok if regexp_full_match(s, '\\d{{1,9}}') AND try_cast(s AS BIGINT) BETWEEN 1 AND 35]) AS good, [s for s in tok if NOT (regexp_full_match(s, '\\d{{1,9}}') AND coalesce(try_cast(s AS BIGINT), 0) BETWEEN 1 AND 35)] AS wrong FROM t)
        SELECT target_issue, array_to_string(list_sort(good), ' ') AS valid, array_to_string(wrong, ' ') AS invalid, CASE WHEN len(wrong) > 0 THEN 'invalid' WHEN len(good) < 5 THEN 'too few' WHEN len(good) > 5 THEN 'too many' END AS error FROM v""",
    "basket_freq": "SELECT num, count(*) AS count FROM (SELECT DISTINCT l_orderkey, l_partkey % 35 + 1 AS num FROM lineitem) GROUP BY num",
    "events_omission": "WITH e AS (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) AS p, count(*) OVER () AS n FROM events) SELECT event_type, count(*) AS count, any_value(n) - max(p) AS omission FROM e GROUP BY event_type",
    "html_scan": f"WITH {DRAWS} SELECT (issue_num % 90000 + 10000)::VARCHAR AS issue, draw_date::VARCHAR AS date, {_TEXT.format('front')} AS front, {_TEXT.format('back')} AS back FROM draws",
    "gap_invariant": f"WITH {GAPS} SELECT period, kind, sum(absent)::BIGINT AS absent, sum(n)::BIGINT AS n FROM gaps GROUP BY ALL",
    "overlap_pairs": f"WITH {OVERLAP} SELECT kind, count(*) AS pairs, sum(k)::BIGINT AS shared FROM ov GROUP BY kind",
}
