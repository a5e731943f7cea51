"""DuckDB SQL for the samplers and what is told of combinations."""

from __future__ import annotations

from .twins import HOT
from .twins_more import _NEXT, _W, RECS, _search, _stats

_TEXT = "array_to_string([lpad(x::VARCHAR, 2, '0') for x in {}], ' ')"


def _u(*parts: str) -> str:
    """The seeded uniform of the samplers."""
    return f"((('0x' || substr(md5(concat_ws(':', '20260816', {', '.join(parts)})), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496)"


_LISTS = HOT + """,
coldn AS (SELECT kind, num, row_number() OVER (PARTITION BY kind ORDER BY num) AS cr FROM (SELECT *, min(count) OVER (PARTITION BY kind) AS least FROM cnt WHERE period = 0) WHERE count = least),
lists AS (SELECT a.kind, a.num, 0.5::DOUBLE * (a.count::DOUBLE / greatest(sum(a.count) OVER (PARTITION BY a.kind), 1)) + 0.5::DOUBLE * (b.count::DOUBLE / greatest(sum(b.count) OVER (PARTITION BY a.kind), 1)) AS weight,
  a.kind = 'front' AND h.rank <= 10 AS hot, a.kind = 'front' AND coalesce(c.cr <= 10, false) AS cold
  FROM (SELECT * FROM cnt WHERE period = 0) a JOIN (SELECT * FROM cnt WHERE period = 50) b USING (kind, num) JOIN (SELECT kind, num, rank FROM hot WHERE period = 0) h USING (kind, num) LEFT JOIN coldn c USING (kind, num))"""


def _temperature(name: str, n_hot: int, n_cold: int, balanced: bool) -> str:
    fill = "-ln(u) / greatest(weight, 1e-9::DOUBLE)"
    fill = fill if balanced else f"CASE kind WHEN 'back' THEN {fill} ELSE u END"
    return f""",
{name}0 AS (SELECT l.*, attempt, try, {_u("attempt", "try", "kind", "num")} AS u FROM lists l, (SELECT unnest(range(5)) AS attempt), (SELECT unnest(range({30 if balanced else 1})) AS try)),
{name}1 AS (SELECT *, row_number() OVER (PARTITION BY attempt, try, kind, hot ORDER BY {_u("'hot'", "attempt", "try", "num")}, num) AS rh, row_number() OVER (PARTITION BY attempt, try, kind, cold ORDER BY {_u("'cold'", "attempt", "try", "num")}, num) AS rc FROM {name}0),
{name}2 AS (SELECT *, row_number() OVER (PARTITION BY attempt, try, kind ORDER BY NOT ((hot AND rh <= {n_hot}) OR (cold AND rc <= {n_cold})), {fill}, num) AS r FROM {name}1),
{name}3 AS (SELECT attempt, try, list_sort(list(num) FILTER (kind = 'front' AND r <= 5)) AS front, list_sort(list(num) FILTER (kind = 'back' AND r <= 2)) AS back FROM {name}2 GROUP BY ALL),
{name} AS (SELECT attempt, min_by(front, try + CASE WHEN len([x for x in front if x % 2 = 1]) IN (2, 3) AND len([x for x in front if x > 17]) IN (2, 3) THEN 0 ELSE 100 END) AS front, min_by(back, try) AS back FROM {name}3 GROUP BY attempt)"""


def _random(name: str, attempts: str) -> str:
    return f""",
{name}0 AS (SELECT attempt, kind, num, row_number() OVER (PARTITION BY attempt, kind ORDER BY {_u("attempt", "0", "kind", "num")}, num) AS r FROM uni, ({attempts})),
{name} AS (SELECT attempt, list_sort(list(num) FILTER (kind = 'front' AND r <= 5)) AS front, list_sort(list(num) FILTER (kind = 'back' AND r <= 2)) AS back FROM {name}0 GROUP BY attempt)"""


_SMART = HOT + f""",
s0 AS (SELECT kind, num, tag, attempt, try, {_u("attempt", "try", "kind", "num")} AS u FROM tier, (SELECT unnest(range(5)) AS attempt), (SELECT unnest(range(21)) AS try) WHERE period = 100),
s1 AS (SELECT *, row_number() OVER (PARTITION BY attempt, try, kind, tag ORDER BY u, num) AS p, row_number() OVER (PARTITION BY attempt, try, kind, num % 2 ORDER BY u, num) AS q FROM s0),
f1 AS (SELECT *, row_number() OVER (PARTITION BY attempt, try ORDER BY p > CASE WHEN tag = 'hot' THEN 2 WHEN try = 20 THEN 0 WHEN tag = 'cold' THEN 1 ELSE 2 END, u, num) AS r FROM s1 WHERE kind = 'front'),
f2 AS (SELECT attempt, try, list_sort(list(num)) AS front FROM f1 WHERE r <= 5 GROUP BY ALL),
f3 AS (SELECT attempt, min_by(front, try) AS front FROM f2 WHERE try = 20 OR (len([x for x in front if x % 2 = 1]) IN (2, 3) AND len([x for x in front if x <= 17]) IN (2, 3)
  AND len([x for x in front if x <= 12]) > 0 AND len([x for x in front if x BETWEEN 13 AND 24]) > 0 AND len([x for x in front if x > 24]) > 0 AND len([i for i in [1, 2, 3, 4] if front[i + 1] - front[i] = 1]) <= 1) GROUP BY attempt),
b1 AS (SELECT *, row_number() OVER (PARTITION BY attempt, try ORDER BY q > 1 AND try <> 20, u, num) AS r FROM s1 WHERE kind = 'back'),
b2 AS (SELECT attempt, try, list_sort(list(num)) AS back FROM b1 WHERE r <= 2 GROUP BY ALL),
b3 AS (SELECT attempt, min_by(back, try) AS back FROM b2 WHERE try = 20 OR len([x for x in back if x <= 6]) = 1 GROUP BY attempt)"""

_SETS = f"attempt, {_TEXT.format('front')} AS front, {_TEXT.format('back')} AS back"

_OF_FRONT = RECS + """,
fs AS (SELECT target_issue, front, list_sum(front)::BIGINT AS s, front[5] - front[1] AS w, len([x for x in front if x % 2 = 1]) AS o, len([x for x in front if x > 17]) AS g, len([i for i in [1, 2, 3, 4] if front[i + 1] - front[i] = 1]) AS p,
  len([x for x in front if x <= 12]) AS z1, len([x for x in front if x BETWEEN 13 AND 24]) AS z2, len([x for x in front if x > 24]) AS z3 FROM recs)"""

PICKS = {
    "random_pick": f"WITH {HOT}{_random('c', 'SELECT c_custkey AS attempt FROM customer')} SELECT {_SETS} FROM c",
    "balanced_pick": f"WITH {_LISTS}{_temperature('a', 2, 2, True)} SELECT {_SETS} FROM a",
    "hotcold_pick": f"WITH {_LISTS}{_temperature('b', 3, 2, False)} SELECT {_SETS} FROM b",
    "smart_pick": f"WITH {_SMART} SELECT {_SETS} FROM f3 JOIN b3 USING (attempt)",
    "strategy_picks": f"""WITH a AS (WITH {_LISTS}{_temperature('a', 2, 2, True)} FROM a), b AS (WITH {_LISTS}{_temperature('b', 3, 2, False)} FROM b), c AS (WITH {HOT}{_random('c', 'SELECT 0 AS attempt')} FROM c),
        d AS (WITH {_stats(_NEXT)}{_search('G0', _W, 15, 8, 0.7, 0.3, True)} SELECT front, back, total FROM bestG0)
        SELECT strategy, score_total, {_SETS} FROM (SELECT 'A' AS strategy, attempt, front, back, NULL::DOUBLE AS score_total FROM a WHERE attempt = 0 UNION ALL SELECT 'B', attempt, front, back, NULL FROM b WHERE attempt = 0
        UNION ALL SELECT 'C', attempt, front, back, NULL FROM c UNION ALL SELECT 'D', 0, front, back, total FROM d)""",
    "complete_pick": f"""WITH {RECS}, uni AS (SELECT 'front' AS kind, unnest(range(1, 36)) AS num UNION ALL SELECT 'back', unnest(range(1, 13))),
        x AS (SELECT target_issue AS attempt, kind, num, row_number() OVER (PARTITION BY target_issue, kind ORDER BY NOT CASE kind WHEN 'front' THEN list_contains(front[1:2], num) ELSE list_contains(back[1:1], num) END, {_u("target_issue", "kind", "num")}, num) AS r FROM recs, uni),
        y AS (SELECT attempt, list_sort(list(num) FILTER (kind = 'front' AND r <= 5)) AS front, list_sort(list(num) FILTER (kind = 'back' AND r <= 2)) AS back FROM x GROUP BY attempt) SELECT {_SETS} FROM y""",
    "combo_metrics": f"""WITH {_OF_FRONT} SELECT target_issue, unnest(['sum', 'span', 'odd_even', 'big_small', 'thirds', 'pairs']) AS metric, unnest([s::VARCHAR, w::VARCHAR, o || ':' || (5 - o), g || ':' || (5 - g), z1 || ':' || z2 || ':' || z3, p::VARCHAR]) AS value,
        unnest([CASE WHEN s BETWEEN 60 AND 140 THEN 'normal' ELSE 'unusual' END, CASE WHEN w BETWEEN 10 AND 40 THEN 'normal' ELSE 'unusual' END, CASE WHEN o IN (2, 3) THEN 'balanced' ELSE 'skewed' END, CASE WHEN g IN (2, 3) THEN 'balanced' ELSE 'skewed' END,
        CASE WHEN least(z1, z2, z3) > 0 THEN 'covered' ELSE 'gaps' END, CASE WHEN p <= 2 THEN 'usual' ELSE 'many' END]) AS status FROM fs""",
    "combo_profile": f"WITH {_OF_FRONT} SELECT target_issue, o AS odd, 5 - o AS even, g AS big, 5 - g AS small, z1, z2, z3, s AS sum, p AS pairs FROM fs",
}
