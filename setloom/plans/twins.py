"""DuckDB SQL for the queries, written on its own over the same tables."""

from __future__ import annotations

DRAWS = """
o AS (SELECT o_orderkey AS issue_num, o_orderdate::DATE AS draw_date, o_custkey AS k, round(o_totalprice * 100)::BIGINT AS c FROM orders),
draws AS (SELECT issue_num, draw_date, row_number() OVER (ORDER BY issue_num) - 1 AS pos, count(*) OVER () AS total,
  list_sort([1 + ((k * 31 + c) % 35 + j * (1 + (c // 35 + k) % 34)) % 35 for j in [0, 1, 2, 3, 4]]) AS front,
  list_sort([1 + ((k * 17 + c // 7) % 12 + j * (1 + (c // 12 + k) % 11)) % 12 for j in [0, 1]]) AS back FROM o)"""
APP = DRAWS + """,
app AS (SELECT pos, total, issue_num, 'front' AS kind, unnest(front) AS num FROM draws UNION ALL SELECT pos, total, issue_num, 'back', unnest(back) FROM draws),
uni AS (SELECT 'front' AS kind, unnest(range(1, 36)) AS num UNION ALL SELECT 'back', unnest(range(1, 13))),
rules AS (SELECT * FROM (VALUES ('front', 35, 5, 17, 5), ('back', 12, 2, 6, 2)) t(kind, size, picks, small_to, zones)),
wins AS (SELECT p AS period, CASE WHEN p = 0 THEN t.total ELSE least(p, t.total) END AS n, t.total
  FROM (SELECT unnest([50, 100, 300, 1000, 0])::BIGINT AS p), (SELECT count(*) AS total FROM draws) t),
cnt AS (SELECT w.period, w.n, u.kind, u.num, count(a.pos) AS count, max(a.pos) AS last, any_value(w.total) AS total
  FROM wins w CROSS JOIN uni u LEFT JOIN app a ON a.kind = u.kind AND a.num = u.num AND a.pos >= w.total - w.n GROUP BY ALL)"""
GAPS = APP + """,
marks AS (SELECT w.period, w.n, w.total, u.kind, u.num, a.pos FROM wins w CROSS JOIN uni u JOIN app a ON a.kind = u.kind AND a.num = u.num AND a.pos >= w.total - w.n
  UNION ALL SELECT w.period, w.n, w.total, u.kind, u.num, w.total FROM wins w CROSS JOIN uni u),
runs AS (SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY period, kind, num ORDER BY pos), total - n - 1) - 1 AS run FROM marks),
gaps AS (SELECT period, kind, num, any_value(n) AS n, max(run) FILTER (pos = total) AS cur, max(run) AS longest, sum(run)::BIGINT AS absent, count(*) FILTER (run > 0) AS runs FROM runs GROUP BY ALL)"""
HOT = GAPS + """,
hot AS (SELECT period, n, kind, num, count, CASE WHEN last IS NULL THEN n ELSE total - 1 - last END AS omit,
  row_number() OVER (PARTITION BY period, kind ORDER BY count DESC, num) AS rank, count(*) OVER (PARTITION BY period, kind) AS size, max(count) OVER (PARTITION BY period, kind) AS most FROM cnt),
tier AS (SELECT *, CASE WHEN (rank - 1)::DOUBLE / (size - 1) < 1 / 3 THEN 'hot' WHEN (rank - 1)::DOUBLE / (size - 1) > 2 / 3 THEN 'cold' ELSE 'balanced' END AS tag FROM hot),
miss AS (SELECT period, kind, num, cur, longest AS max, CASE WHEN runs > 0 THEN floor(absent::DOUBLE / runs * 10 + 0.5::DOUBLE) / 10 ELSE 0 END::DOUBLE AS avg FROM gaps),
pct AS (SELECT c.period, c.kind, floor(sum(count) FILTER (num % 2 = 1)::DOUBLE / sum(count) * 100 * 10 + 0.5::DOUBLE) / 10 AS odd, floor(coalesce(sum(count) FILTER (num % 2 = 0), 0)::DOUBLE / sum(count) * 100 * 10 + 0.5::DOUBLE) / 10 AS even,
  floor(sum(count) FILTER (num <= small_to)::DOUBLE / sum(count) * 100 * 10 + 0.5::DOUBLE) / 10 AS small, floor(sum(count) FILTER (num > small_to)::DOUBLE / sum(count) * 100 * 10 + 0.5::DOUBLE) / 10 AS big
  FROM cnt c JOIN rules USING (kind) GROUP BY ALL),
consec AS (SELECT w.period, w.n, u.kind, u.num, count(DISTINCT a.pos) AS count FROM wins w CROSS JOIN uni u
  LEFT JOIN (SELECT a.* FROM app a SEMI JOIN app b ON a.pos = b.pos AND a.kind = b.kind AND abs(a.num - b.num) = 1) a ON a.kind = u.kind AND a.num = u.num AND a.pos >= w.total - w.n GROUP BY ALL)"""
SEVEN = HOT + """,
dims AS (SELECT t.period, t.kind, t.num, t.tag,
  least(100, greatest(0, floor(t.count::DOUBLE / (t.n * (r.picks::DOUBLE / r.size)) * 50 + 0.5::DOUBLE))) AS frequency,
  floor(t.count::DOUBLE / t.most * 100 + 0.5::DOUBLE) AS recent_hot,
  CASE WHEN m.avg <= 0 THEN 50 WHEN m.cur <= m.avg THEN floor(80::DOUBLE * m.cur / m.avg + 0.5::DOUBLE) WHEN m.cur <= 2 * m.avg THEN floor(80 + 20::DOUBLE * (m.cur - m.avg) / m.avg + 0.5::DOUBLE)
    ELSE greatest(0, floor(100 - 30::DOUBLE * (m.cur - 2 * m.avg) / m.avg + 0.5::DOUBLE)) END AS missing,
  floor(CASE t.tag WHEN 'hot' THEN 72 WHEN 'cold' THEN 42 ELSE 60 END + least(8, greatest(-8, floor(t.count::DOUBLE / t.most * 100 - 50 + 0.5::DOUBLE) / 100 * 16)) + 0.5::DOUBLE) AS balance0,
  floor(CASE WHEN t.num % 2 = 1 THEN odd ELSE even END + 0.5::DOUBLE) AS odd_even, floor(CASE WHEN t.num <= r.small_to THEN small ELSE big END + 0.5::DOUBLE) AS big_small,
  least(100, floor(c.count::DOUBLE / t.n * 150 + 0.5::DOUBLE)) AS structure
  FROM tier t JOIN rules r USING (kind) JOIN miss m USING (period, kind, num) JOIN pct p USING (period, kind) JOIN consec c USING (period, kind, num)),
models AS (SELECT * FROM (VALUES ('standard', .25, .20, .15, .15, .10, .10, .05), ('cold-hot', .20, .25, .15, .20, .10, .05, .05), ('expert', .20, .20, .15, .10, .10, .10, .15)) t(model, a, b, c, d, e, f, g)),
seven AS (SELECT period, kind, model, num, tag, floor(a::DOUBLE * frequency + 0.5::DOUBLE)::BIGINT AS frequency, floor(b::DOUBLE * recent_hot + 0.5::DOUBLE)::BIGINT AS recent_hot, floor(c::DOUBLE * missing + 0.5::DOUBLE)::BIGINT AS missing,
  floor(d::DOUBLE * least(95, greatest(20, balance0)) + 0.5::DOUBLE)::BIGINT AS balance, floor(e::DOUBLE * odd_even + 0.5::DOUBLE)::BIGINT AS odd_even, floor(f::DOUBLE * big_small + 0.5::DOUBLE)::BIGINT AS big_small, floor(g::DOUBLE * structure + 0.5::DOUBLE)::BIGINT AS structure FROM dims, models),
scores AS (SELECT *, frequency + recent_hot + missing + balance + odd_even + big_small + structure AS total FROM seven)"""
FEATURES = DRAWS + """,
feat AS (SELECT issue_num, pos, total, front, back, len([x for x in front if x % 2 = 1]) AS odd, len([x for x in front if x > 17]) AS big,
  len([i for i in [1, 2, 3, 4] if front[i + 1] - front[i] = 1]) AS pairs, list_sum(front)::BIGINT AS sum, front[5] - front[1] AS span, back[2] - back[1] AS back_span,
  array_to_string([len([x for x in front if least((x - 1) // 7, 4) = z]) for z in [0, 1, 2, 3, 4]], '-') AS zones FROM draws)"""
OVERLAP = DRAWS + """,
ov AS (SELECT 'front' AS kind, len(list_intersect(a.front, b.front)) AS k FROM draws a JOIN draws b ON a.pos = b.pos + 1 UNION ALL SELECT 'back', len(list_intersect(a.back, b.back)) FROM draws a JOIN draws b ON a.pos = b.pos + 1),
ovd AS (SELECT d.kind, d.k, count(o.k) AS count, greatest(1, sum(count(o.k)) OVER (PARTITION BY d.kind))::BIGINT AS n FROM
  (SELECT 'front' AS kind, unnest(range(0, 6)) AS k UNION ALL SELECT 'back', unnest(range(0, 3))) d LEFT JOIN ov o ON o.kind = d.kind AND o.k = d.k GROUP BY d.kind, d.k)"""

DESCRIPTIVE = {
    "freq_overall": f"WITH {APP} SELECT kind, num, count FROM cnt WHERE period = 0",
    "freq_recent": f"WITH {APP} SELECT kind, num, count FROM cnt WHERE period = 50",
    "freq_multi_window": f"WITH {APP} SELECT period, kind, num, count FROM cnt",
    "hot_top10": f"WITH {HOT} SELECT kind, rank, num, count FROM hot WHERE period = 0 AND rank <= 10",
    "cold_ties": f"""WITH {APP}, m AS (SELECT kind, num, count, row_number() OVER (PARTITION BY kind ORDER BY num) AS rank FROM
        (SELECT *, min(count) OVER (PARTITION BY kind) AS least FROM cnt WHERE period = 0) WHERE count = least) SELECT * FROM m WHERE rank <= 10""",
    "cold_by_omission": f"""WITH {HOT} SELECT kind, rank, num, omission FROM (SELECT kind, num, omit AS omission, row_number() OVER (PARTITION BY kind ORDER BY omit DESC, num) AS rank FROM hot WHERE period = 0 AND omit > 0)
        WHERE rank <= CASE kind WHEN 'front' THEN 8 ELSE 4 END""",
    "omission_current": f"WITH {GAPS} SELECT kind, num, cur AS omission FROM gaps WHERE period = 0",
    "omission_max": f"WITH {GAPS} SELECT kind, num, longest AS max_omission FROM gaps WHERE period = 0",
    "missing_cycle": f"""WITH {GAPS}, a AS (SELECT *, CASE WHEN runs > 0 THEN floor(absent::DOUBLE / runs * 100 + 0.5::DOUBLE) / 100 ELSE 0 END::DOUBLE AS avg FROM gaps WHERE period = 0)
        SELECT kind, num, cur AS current, avg, longest AS max, CASE WHEN cur = 0 THEN 'just_hit' WHEN avg = 0 OR cur <= avg THEN 'within_cycle' WHEN cur < longest THEN 'over_avg' ELSE 'at_max' END AS status FROM a""",
    "missing_multi_window": f"WITH {HOT} SELECT period, kind, num, cur, max, avg FROM miss",
    "hot_with_omit": f"WITH {HOT} SELECT period, kind, rank, num, count, omit FROM hot",
    "tier_tags": f"WITH {HOT} SELECT period, kind, rank, num, tag FROM tier",
    "odd_even_hist": f"""WITH {FEATURES}, h AS (SELECT odd || ':' || (5 - odd) AS label, count(*) AS count, any_value(total) AS t FROM feat GROUP BY 1)
        SELECT label, count, floor(count / t * 100::DOUBLE * 10 + 0.5::DOUBLE) / 10 AS pct, row_number() OVER (ORDER BY count DESC, label) AS rank FROM h""",
    "big_small_hist": f"""WITH {FEATURES}, h AS (SELECT big || ':' || (5 - big) AS label, count(*) AS count, any_value(total) AS t FROM feat GROUP BY 1)
        SELECT label, count, floor(count / t * 100::DOUBLE * 10 + 0.5::DOUBLE) / 10 AS pct, row_number() OVER (ORDER BY count DESC, label) AS rank FROM h""",
    "consec_summary": f"""WITH {FEATURES} SELECT count(*) AS draws, count(*) FILTER (pairs > 0) AS with_pair, sum(pairs)::BIGINT AS pairs,
        floor(count(*) FILTER (pairs > 0)::DOUBLE / count(*) * 10000 + 0.5::DOUBLE) / 10000 AS prob, floor(sum(pairs)::DOUBLE / count(*) * 10000 + 0.5::DOUBLE) / 10000 AS avg_pairs FROM feat""",
    "consec_participation": f"WITH {HOT} SELECT period, n, kind, num, count FROM consec",
    "zone_hist": f"""WITH {APP}, z AS (SELECT c.kind, least((num - 1) // (size // zones), zones - 1) AS zone, sum(count)::BIGINT AS count, any_value(size // zones) AS w FROM cnt c JOIN rules USING (kind) WHERE period = 0 GROUP BY ALL)
        SELECT kind, zone, (1 + zone * w) || '-' || ((zone + 1) * w) AS label, count, floor(count::DOUBLE / sum(count) OVER (PARTITION BY kind) * 10000 + 0.5::DOUBLE) / 10000 AS pct FROM z""",
    "odd_even_pct": f"WITH {HOT} SELECT period, kind, odd, even FROM pct",
    "big_small_pct": f"WITH {HOT} SELECT period, kind, small, big FROM pct",
    "ratio_multi_window": f"WITH {HOT} SELECT period, kind, odd, even, small, big FROM pct WHERE period > 0",
    "overlap_dist": f"WITH {OVERLAP} SELECT kind, k, count, floor(count::DOUBLE / n * 1000000 + 0.5::DOUBLE) / 1000000 AS p FROM ovd",
    "overlap_expectation": f"WITH {OVERLAP} SELECT kind, floor(sum(k * count)::DOUBLE / any_value(n) * 10000 + 0.5::DOUBLE) / 10000 AS expectation FROM ovd GROUP BY kind",
    "temperature_trend": f"""WITH {APP}, t AS (SELECT u.kind, u.num, count(a.pos) AS total_count, count(*) FILTER (a.pos >= a.total - 30) AS recent_30, count(*) FILTER (a.pos >= a.total - 100) AS recent_100
        FROM uni u LEFT JOIN app a USING (kind, num) GROUP BY ALL)
        SELECT *, floor((recent_30::DOUBLE / least(30, (SELECT count(*) FROM draws)) - recent_100::DOUBLE / least(100, (SELECT count(*) FROM draws))) * 10000 + 0.5::DOUBLE) / 10000 AS trend FROM t""",
    "sum_span_percentiles": f"""WITH {FEATURES}, v AS (SELECT 'front_sum' AS measure, sum AS v FROM feat UNION ALL SELECT 'front_span', span FROM feat UNION ALL SELECT 'back_span', back_span FROM feat),
        l AS (SELECT measure, list_sort(list(v)) AS l, sum(v)::BIGINT AS s, count(*) AS n FROM v GROUP BY 1)
        SELECT measure, l[least(n * 25 // 100, n - 1) + 1] AS p25, l[least(n * 75 // 100, n - 1) + 1] AS p75, floor(s::DOUBLE / n * 100 + 0.5::DOUBLE) / 100 AS mean FROM l""",
    "per_draw_features": f"WITH {FEATURES} SELECT issue_num, odd, big, pairs, sum, span, back_span, zones FROM feat",
    "latest_digest": f"WITH {FEATURES} SELECT issue_num, odd, big, pairs, sum, span, back_span, zones FROM feat WHERE pos = total - 1",
    "score7_standard": f"WITH {SEVEN} SELECT kind, num, tag, frequency, recent_hot, missing, balance, odd_even, big_small, structure, total FROM scores WHERE model = 'standard' AND period = 100",
    "score7_all_models": f"WITH {SEVEN} SELECT * FROM scores",
    "score_top10": f"WITH {SEVEN} SELECT * FROM (SELECT kind, model, num, total, row_number() OVER (PARTITION BY kind, model ORDER BY total DESC, num) AS rank FROM scores WHERE period = 300) WHERE rank <= 10",
    "heatmap": f"""WITH {HOT}, near AS (SELECT kind, num, count FROM app_near)
        SELECT h.kind, h.num, h.count AS appears, h.omit AS omission, CASE WHEN h.count = 0 THEN 99 ELSE h.rank END AS freq_rank,
        CASE WHEN h.count > n.count * 1.1::DOUBLE THEN 'up' WHEN h.count < n.count * 0.9::DOUBLE THEN 'down' ELSE 'flat' END AS trend,
        CASE WHEN r >= 1.5::DOUBLE THEN 5 WHEN r >= 1.2::DOUBLE THEN 4 WHEN r >= 0.9::DOUBLE THEN 3 WHEN r >= 0.7::DOUBLE THEN 2 WHEN r >= 0.5::DOUBLE THEN 1 ELSE 0 END::BIGINT AS level
        FROM (SELECT h.*, count / (n * (picks::DOUBLE / x.size)) AS r FROM hot h JOIN rules x USING (kind) WHERE period = 100) h JOIN near n USING (kind, num)""".replace(
        "near AS (SELECT kind, num, count FROM app_near)", "near AS (SELECT u.kind, u.num, count(a.pos) AS count FROM uni u LEFT JOIN app a ON a.kind = u.kind AND a.num = u.num AND a.pos >= a.total - 75 GROUP BY ALL)"
    ),
    "omission_profile": f"""WITH {HOT} SELECT kind, num, m.cur, m.max, m.avg, c.count, d.issue_num AS last_issue, CASE WHEN m.cur > m.avg * 1.15::DOUBLE THEN 'high' WHEN m.cur < m.avg * 0.85::DOUBLE THEN 'low' ELSE 'normal' END AS trend
        FROM miss m JOIN cnt c USING (period, kind, num) LEFT JOIN draws d ON d.pos = c.last WHERE period = 100""",
    "omission_summary": f"""WITH {HOT}, m AS (SELECT * FROM miss WHERE period = 100), t AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY max DESC, num) AS r FROM m)
        SELECT kind, floor(sum(floor(avg * 10 + 0.5::DOUBLE)) / count(*) / 10 * 10 + 0.5::DOUBLE) / 10 AS mean_avg, coalesce(string_agg(lpad(num::VARCHAR, 2, '0'), ' ' ORDER BY num) FILTER (cur > avg), '') AS over_average,
        string_agg(num || ':' || max, ' ' ORDER BY r) FILTER (r <= 5) AS longest FROM t GROUP BY kind""",
    "omission_rankings": f"""WITH {HOT}, m AS (SELECT kind, num, cur, floor((cur - avg) * 10 + 0.5::DOUBLE) / 10 AS deviation FROM miss WHERE period = 100)
        SELECT kind, num, cur, row_number() OVER (PARTITION BY kind ORDER BY cur DESC, num) AS by_current, deviation, row_number() OVER (PARTITION BY kind ORDER BY deviation DESC, num) AS by_deviation,
        greatest(6, floor(abs(deviation) / greatest(1, max(abs(deviation)) OVER (PARTITION BY kind)) * 100 + 0.5::DOUBLE))::BIGINT AS bar FROM m""",
    "occurrence_cells": f"""WITH {APP}, c AS (SELECT d.pos, d.total, d.issue_num, u.kind, u.num, CASE u.kind WHEN 'front' THEN list_contains(d.front, u.num) ELSE list_contains(d.back, u.num) END AS appeared FROM draws d CROSS JOIN uni u WHERE d.pos >= d.total - 50)
        SELECT issue_num, kind, num, appeared, pos - coalesce(max(CASE WHEN appeared THEN pos END) OVER (PARTITION BY kind, num ORDER BY pos), total - 51) AS absent FROM c""",
    "occurrence_counts": f"WITH {HOT} SELECT kind, num, count, omit FROM hot WHERE period = 50",
}
