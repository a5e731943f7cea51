"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import FRONT, HIT_LEVELS, GroupRule


def half_up(x: Column, places: int = 0) -> Column:
    """floor(x * 10^n + 0.5) / 10^n on doubles: the same in any engine."""
    scale = float(10**places)
    whole = F.floor(x.cast("double") * F.lit(scale) + F.lit(0.5))
    return whole.cast("double") / F.lit(scale) if places else whole


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def percent(part: Column, whole: Column, empty: float) -> Column:
    """Percent to one place; `empty` where there is nothing."""
    return F.when(whole > 0, half_up(part.cast("double") / whole * 100.0, 1)).otherwise(F.lit(empty))


def normalised(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Scale low..high to 0..100, two places; 50 where the value is missing."""
    scaled = clamp((x - F.lit(low)) / F.lit(high - low) * 100.0, 0.0, 100.0) if high > low else F.lit(0.0)
    return F.when(x.isNull(), F.lit(50.0)).otherwise(half_up(scaled, 2))


def miss_score(current: Column, average: Column) -> Column:
    """80 at the average gap, 100 at twice, falling beyond."""
    beyond = half_up(100.0 - 30.0 * (current - 2.0 * average) / average)
    up = half_up(80.0 + 20.0 * (current - average) / average)
    score = F.when(current <= average, half_up(80.0 * current / average)).when(current <= 2.0 * average, up).otherwise(beyond)
    return F.when(average <= 0, F.lit(50).cast("long")).otherwise(clamp(score, 0, 100).cast("long"))


def odd_count(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x % 2 == 1)).cast("long")


def big_count(a: Column, rule: GroupRule = FRONT) -> Column:
    return F.size(F.filter(a, lambda x: x > rule.small_to)).cast("long")


def adjacent_pairs(a: Column) -> Column:
    """Neighbours in the sorted set that differ by one."""
    s = F.array_sort(a)
    steps = F.zip_with(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda x, y: x - y)
    return F.size(F.filter(steps, lambda d: d == 1)).cast("long")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def span(a: Column) -> Column:
    return F.array_max(a) - F.array_min(a)


def zone(x: Column, rule: GroupRule) -> Column:
    """The zone of a number, from 0; the last zone takes what is left."""
    return F.least(F.floor((x - rule.low) / (rule.size // rule.zones)), F.lit(rule.zones - 1)).cast("long")


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def hit_level(hits: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in HIT_LEVELS]), hits.cast("int") + 1)


def strategy_group(strategy: Column) -> Column:
    """The letter before the first dash, or `other`."""
    head = F.upper(F.trim(F.split_part(strategy, F.lit("-"), F.lit(1))))
    return F.when(head.isin("A", "B", "C", "D"), head).otherwise(F.lit("other"))


def next_issue(issue: Column) -> Column:
    """YYNNN: the one after, in the next year behind number 353."""
    return F.when(issue % 1000 >= 353, (F.floor(issue / 1000) + 1) * 1000 + 1).otherwise(issue + 1).cast("long")


def two_digits(a: Column) -> Column:
    """Numbers as a space-separated text of two digits each."""
    return F.array_join(F.transform(a, lambda x: F.lpad(x.cast("string"), 2, "0")), " ")


def colour_level(count: Column, window: Column, rule_share: Column) -> Column:
    """0 (coldest) to 5 by the count over its expectation."""
    ratio = count / F.nullif(window * rule_share, F.lit(0.0))
    level = F.when(ratio >= 1.5, 5).when(ratio >= 1.2, 4).when(ratio >= 0.9, 3).when(ratio >= 0.7, 2).when(ratio >= 0.5, 1).otherwise(0)
    return level.cast("long")


def miss_level(absent: Column) -> Column:
    """0 (up to 2 draws) to 4 (over 20) by how long a number is absent."""
    return F.when(absent <= 2, 0).when(absent <= 5, 1).when(absent <= 10, 2).when(absent <= 20, 3).otherwise(4).cast("long")


def hot_level(count: Column, most: Column) -> Column:
    """1 to 4 by the count over the largest one; 0 where nothing is counted."""
    level = F.least(F.lit(4), F.greatest(F.lit(1), half_up(count.cast("double") / most * 4.0)))
    return F.when(F.coalesce(most, F.lit(0)) == 0, 0).otherwise(level).cast("long")
