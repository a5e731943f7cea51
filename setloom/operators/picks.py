"""Candidate sets: constraints, quality, seeded samplers and number parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import adjacent_pairs, big_count, odd_count, shared, span, total
from ..model import BACK, FRONT, RULES, GroupRule
from .frames import dealt

#: Ranges in which a front set counts as usual (fixed values).
SUM_RANGE, SPAN_RANGE, THIRDS = (60, 140), (10, 40), (12, 24, 35)


def thirds(a: Column) -> Column:
    """How many of the three ranges of front numbers a set touches."""
    hit = [F.exists(a, _between(lo, hi)).cast("long") for lo, hi in zip((1, *(x + 1 for x in THIRDS[:-1])), THIRDS)]
    return reduce(lambda x, y: x + y, hit)


def _between(lo: int, hi: int):
    return lambda x: x.between(lo, hi)


def meets_constraints(a: Column) -> Column:
    """Two or three odd, two or three small, all thirds touched, at most one pair of neighbours."""
    small = F.size(a) - big_count(a)
    return odd_count(a).isin(2, 3) & small.isin(2, 3) & (thirds(a) == 3) & (adjacent_pairs(a) <= 1)


def rejections(front: Column, prev_front: Column) -> dict[str, Column]:
    """Eight reasons to reject a front set."""
    n, odd, big, s = F.size(front), odd_count(front), big_count(front), total(front)
    return {
        "five_consecutive": adjacent_pairs(front) == 4,
        "all_odd": odd == n,
        "all_even": odd == 0,
        "all_big": big == n,
        "all_small": big == 0,
        "extreme_sum": ~s.between(*SUM_RANGE),
        "extreme_span": ~span(front).between(*SPAN_RANGE),
        "duplicate_previous": F.coalesce(shared(front, prev_front) == n, F.lit(False)),
    }


def rejection_counts(candidates: DataFrame, prev_col: str = "prev_front") -> DataFrame:
    """Candidates by rule that rejects them, and how many any rule rejects."""
    rules = rejections(F.col("front"), F.col(prev_col))
    any_rule = reduce(lambda a, b: a | b, rules.values())
    return candidates.agg(F.count("*").alias("n_candidates"), F.count_if(any_rule).alias("n_rejected"), *[F.count_if(c).alias(k) for k, c in rules.items()])


def combination_metrics(candidates: DataFrame) -> DataFrame:
    """Rows (target_issue, metric, value, status): sum, span, odd to even, big to small, the thirds and pairs of neighbours of a front set."""
    f = F.col("front")
    odd, big, n, pairs = odd_count(f), big_count(f), F.size(f), adjacent_pairs(f)
    in_thirds = [F.size(F.filter(f, _between(lo, hi))) for lo, hi in zip((1, *(x + 1 for x in THIRDS[:-1])), THIRDS)]

    def text(x: Column) -> Column:
        return x.cast("string")

    rows = [
        ("sum", text(total(f)), F.when(total(f).between(*SUM_RANGE), "normal").otherwise("unusual")),
        ("span", text(span(f)), F.when(span(f).between(*SPAN_RANGE), "normal").otherwise("unusual")),
        ("odd_even", F.concat_ws(":", text(odd), text(n - odd)), F.when(odd.isin(2, 3), "balanced").otherwise("skewed")),
        ("big_small", F.concat_ws(":", text(big), text(n - big)), F.when(big.isin(2, 3), "balanced").otherwise("skewed")),
        ("thirds", F.concat_ws(":", *map(text, in_thirds)), F.when(thirds(f) == len(THIRDS), "covered").otherwise("gaps")),
        ("pairs", text(pairs), F.when(pairs <= 2, "usual").otherwise("many")),
    ]
    each = F.array(*[F.struct(F.lit(name).alias("metric"), value.alias("value"), status.alias("status")) for name, value, status in rows])
    return candidates.select("target_issue", F.explode(each).alias("m")).select("target_issue", "m.*")


def profile_texts(front: Column) -> list[tuple[str, Column, Column]]:
    """Name, value as text and whether it is usual, of six properties of a front set."""
    odd, big, n, pairs = odd_count(front), big_count(front), F.size(front), adjacent_pairs(front)
    return [
        ("sum", total(front).cast("string"), total(front).between(*SUM_RANGE)),
        ("span", span(front).cast("string"), span(front).between(*SPAN_RANGE)),
        ("odd to even", F.concat_ws(":", odd.cast("string"), (n - odd).cast("string")), odd.isin(2, 3)),
        ("big to small", F.concat_ws(":", big.cast("string"), (n - big).cast("string")), big.isin(2, 3)),
        ("thirds", thirds(front).cast("string"), thirds(front) == len(THIRDS)),
        ("pairs", pairs.cast("string"), pairs <= 2),
    ]


def combination_profile(recs: DataFrame) -> DataFrame:
    """The combination part of an analysed pick: parity, size, thirds, sum and pairs of neighbours."""
    f = F.col("front")
    odd, big = odd_count(f), big_count(f)
    parts = [F.size(F.filter(f, _between(lo, hi))).cast("long").alias(f"z{k}") for k, (lo, hi) in enumerate(zip((1, *(x + 1 for x in THIRDS[:-1])), THIRDS), 1)]
    return recs.select("target_issue", odd.alias("odd"), (F.size(f) - odd).cast("long").alias("even"), big.alias("big"), (F.size(f) - big).cast("long").alias("small"), *parts, total(f).alias("sum"), adjacent_pairs(f).alias("pairs"))


def quality(candidates: DataFrame) -> DataFrame:
    """Six checks of a front set (100 or less each) and their mean; the weights are this library's own."""
    f = F.col("front")
    s, w, odd, big = total(f), span(f), odd_count(f), big_count(f)

    def inside(x: Column, lo: int, hi: int) -> Column:
        off = F.greatest(F.lit(lo) - x, x - F.lit(hi), F.lit(0))
        return F.greatest(F.lit(0), 100 - 5 * off).cast("long")

    parts = {
        "sum_score": inside(s, *SUM_RANGE),
        "span_score": inside(w, *SPAN_RANGE),
        "odd_even_score": F.when(odd.isin(2, 3), 100).when(odd.isin(1, 4), 60).otherwise(20).cast("long"),
        "big_small_score": F.when(big.isin(2, 3), 100).when(big.isin(1, 4), 60).otherwise(20).cast("long"),
        "zone_score": F.floor(thirds(f) * 100 / 3).cast("long"),
        "pairs_score": F.when(adjacent_pairs(f) <= 2, 100).otherwise(40).cast("long"),
    }
    rows = candidates.select("target_issue", *[c.alias(k) for k, c in parts.items()])
    return rows.withColumn("quality", reduce(lambda a, b: a + b, [F.col(k) for k in parts]).cast("double") / 6.0)


def parse_numbers(rows: DataFrame, rule: GroupRule = FRONT, column: str = "input") -> DataFrame:
    """Numbers in free text (blanks or commas between): valid ones in order, once each, the rest, and an error."""
    tokens = F.filter(F.split(F.trim(F.translate(column, "，", ",")), r"[\s,]+"), lambda t: t != "")
    number = F.transform("tokens", lambda t: F.when(t.rlike(r"^\d{1,9}$"), t.try_cast("long")))
    good = F.array_distinct(F.filter("numbers", lambda x: x.isNotNull() & x.between(rule.low, rule.high)))
    wrong = F.filter("tokens", lambda t: ~F.coalesce(F.when(t.rlike(r"^\d{1,9}$"), t.try_cast("long")).between(rule.low, rule.high), F.lit(False)))
    rows = rows.withColumn("tokens", tokens).withColumn("numbers", number).withColumn("valid", good).withColumn("invalid", wrong)
    error = F.when(F.size("invalid") > 0, "invalid").when(F.size("valid") < rule.picks, "too few").when(F.size("valid") > rule.picks, "too many")
    return rows.drop("tokens", "numbers").withColumn("error", error)


#: Tries of a constrained sampler, and of one that repairs (fixed values).
RETRIES, REPAIRS = 20, 30


def uniform(seed: int, *parts: Column) -> Column:
    """A number above 0 and up to 1 by md5 of the seed and the parts as text: the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 1).cast("double") / float(16**13)


def _tries(numbers: DataFrame, n: int, retries: int, seed: int) -> DataFrame:
    """Numbers once for each pick (`attempt`) and try, with a seeded uniform `u`."""
    spark = numbers.sparkSession
    each = numbers.crossJoin(F.broadcast(spark.range(n).toDF("attempt"))).crossJoin(F.broadcast(spark.range(retries).toDF("try")))
    return each.withColumn("u", uniform(seed, F.col("attempt"), F.col("try"), F.col("kind"), F.col("num")))


def _chosen(rows: DataFrame, order: Column) -> DataFrame:
    """Rows (attempt, try, front, back): the first numbers of each set by an order."""
    place = F.row_number().over(Window.partitionBy("attempt", "try", "kind").orderBy(order, "num"))
    need = F.when(F.col("kind") == "front", FRONT.picks).otherwise(BACK.picks)
    kept = rows.withColumn("__r", place).filter(F.col("__r") <= need)
    return kept.groupBy("attempt", "try").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == x.kind, F.col("num")))).alias(x.kind) for x in RULES])


def _first(tries: DataFrame, kind: str, fits: Column) -> DataFrame:
    """The set of the first try that fits; of all tries the first where none does."""
    return tries.groupBy("attempt").agg(F.min_by(kind, F.struct((~fits).alias("not_fit"), "try")).alias(kind))


def random_picks(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Uniform sets: the numbers with the smallest hashes."""
    from .frames import universe

    return _chosen(_tries(universe(spark), n, 1, seed), F.col("u")).drop("try")


def random_for(attempts: DataFrame, seed: int) -> DataFrame:
    """A random combination for each row's `attempt`: the numbers with the least seeded uniforms, chosen inside the row."""

    def chosen(rule: GroupRule) -> Column:
        def cell(x: Column) -> Column:
            return F.struct(uniform(seed, F.col("attempt"), F.lit(0), F.lit(rule.kind), x).alias("u"), x.alias("num"))

        ordered = F.sort_array(F.transform(F.sequence(F.lit(rule.low).cast("long"), F.lit(rule.high).cast("long")), cell))
        return F.sort_array(F.transform(F.slice(ordered, 1, rule.picks), lambda x: x["num"])).alias(rule.kind)

    # A row takes 47 hashes.
    return dealt(attempts).select("attempt", *[chosen(r) for r in RULES])


def _by_weight() -> Column:
    """Without replacement by weight: the largest u^(1/w), that is the smallest -ln(u)/w."""
    return -F.ln("u") / F.greatest(F.col("weight"), F.lit(1e-9))


def weighted_picks(weights: DataFrame, n: int, seed: int) -> DataFrame:
    return _chosen(_tries(weights, n, 1, seed), _by_weight()).drop("try")


def balanced_weights(overall: DataFrame, recent: DataFrame) -> DataFrame:
    """Half the share of all appearances and half that of the recent ones."""
    by = Window.partitionBy("kind")
    rows = overall.join(recent.withColumnRenamed("count", "near"), ["kind", "num"])
    share = [F.col(c).cast("double") / F.greatest(F.sum(c).over(by), F.lit(1)) for c in ("count", "near")]
    return rows.select("kind", "num", (0.5 * share[0] + 0.5 * share[1]).alias("weight"))


def temperature_picks(weights: DataFrame, hot: DataFrame, cold: DataFrame, n: int, seed: int, n_hot: int, n_cold: int, balanced: bool) -> DataFrame:
    """Front sets of `n_hot` of the hot and `n_cold` of the cold numbers, filled up; back sets by weight.

    `balanced` fills by weight and takes the first of 30 tries with two or three odd and two or three big numbers
    (or the first); else others fill up uniformly. A number that is both hot and cold counts once.
    """
    lists = {name: rows.filter("kind = 'front'").select("kind", "num", F.lit(True).alias(name)) for name, rows in (("hot", hot), ("cold", cold))}
    numbers = weights.join(lists["hot"], ["kind", "num"], "left").join(lists["cold"], ["kind", "num"], "left").fillna(False, ["hot", "cold"])
    rows = _tries(numbers, n, REPAIRS if balanced else 1, seed)
    keys = ("attempt", "try", "kind")
    picked = F.lit(False)
    for name, most in (("hot", n_hot), ("cold", n_cold)):
        rows = rows.withColumn(f"__{name}", F.row_number().over(Window.partitionBy(*keys, name).orderBy(uniform(seed, F.lit(name), F.col("attempt"), F.col("try"), F.col("num")), "num")))
        picked = picked | (F.col(name) & (F.col(f"__{name}") <= most))
    fill = F.when((F.col("kind") == "back") | F.lit(balanced), _by_weight()).otherwise(F.col("u"))
    tries = _chosen(rows.withColumn("__fill", fill).withColumn("__open", ~picked), F.struct("__open", "__fill"))
    fits = odd_count(F.col("front")).isin(2, 3) & big_count(F.col("front")).isin(2, 3)
    return _first(tries, "front", fits).join(_first(tries, "back", F.lit(True)), "attempt")


def tiered_picks(tiers: DataFrame, n: int, seed: int, hot: int = 2, cold: int = 1) -> DataFrame:
    """Front sets of `hot` hot, `cold` cold and otherwise balanced numbers that meet the constraints, by 20 tries.

    Where none does, the hot ones of one more try and any others. Back sets of one odd and one even number of
    which one is small, by 20 tries, or any two.
    """
    rows = _tries(tiers, n, RETRIES + 1, seed)
    place = F.row_number().over(Window.partitionBy("attempt", "try", "kind", "tag").orderBy("u", "num"))
    last = F.col("try") == RETRIES
    quota = F.when(F.col("tag") == "hot", hot).when(last, 0).when(F.col("tag") == "cold", cold).otherwise(FRONT.picks - hot - cold)
    front = _chosen(rows.filter("kind = 'front'").withColumn("__open", place > quota), F.struct("__open", "u"))
    front = _first(front, "front", meets_constraints(F.col("front")) | last)
    by_parity = F.row_number().over(Window.partitionBy("attempt", "try", F.col("num") % 2).orderBy("u", "num"))
    back = _chosen(rows.filter("kind = 'back'").withColumn("__open", (by_parity > 1) & ~last), F.struct("__open", "u"))
    small = F.size("back") - big_count(F.col("back"), BACK)
    return front.join(_first(back, "back", (small == 1) | last), "attempt")


def completed(partial: DataFrame, numbers: DataFrame, seed: int) -> DataFrame:
    """Given numbers (attempt, front, back), filled up with others by a seeded order."""
    rows = numbers.crossJoin(partial.select("attempt", F.col("front").alias("f"), F.col("back").alias("b")))
    given = F.when(F.col("kind") == "front", F.array_contains("f", F.col("num"))).otherwise(F.array_contains("b", F.col("num")))
    rows = rows.withColumn("__open", ~given).withColumn("u", uniform(seed, F.col("attempt"), F.col("kind"), F.col("num"))).withColumn("try", F.lit(0))
    return _chosen(rows, F.struct("__open", "u")).drop("try")


def all_strategies(**picks: DataFrame) -> DataFrame:
    """The picks of several strategies as one table with `strategy`; columns that only some have are null elsewhere."""
    named = [rows.withColumn("strategy", F.lit(name)) for name, rows in picks.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def analyse(recs: DataFrame, hot: DataFrame, tiers: DataFrame) -> DataFrame:
    """Each recommended number with its frequency, omission and tier."""
    nums = recs.select("target_issue", F.explode(F.concat(*[F.transform(r.kind, _kinded(r.kind)) for r in RULES])).alias("x")).select("target_issue", "x.*")
    known = hot.join(tiers.select("kind", "num", "tag"), ["kind", "num"]).select("kind", "num", "count", "omit", "tag")
    return nums.join(F.broadcast(known), ["kind", "num"]).select("target_issue", "kind", "num", "count", "omit", "tag")


def _kinded(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("num"))
