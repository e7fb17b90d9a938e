"""Financial statements: ratios, peer groups and deviations, digit tests with levels, roll-up of accounts, checks of a row."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import chi2_tail, chi2_tail_8, clamp, last_two, safe_div
from .forensics import MAD_SCALE, deviation_score

# The parts of the totals, and the ratios with their numerator and denominator.
REVENUES = ("revenue_tuition", "revenue_subsidy", "revenue_other")
EXPENSES = ("expense_personnel", "expense_teaching", "expense_meal", "expense_facility", "expense_rent", "expense_admin", "expense_other")
RATIOS = {
    "personnel_ratio": ("expense_personnel", "total_expense"),
    "teaching_ratio": ("expense_teaching", "total_expense"),
    "meal_ratio": ("expense_meal", "total_expense"),
    "admin_ratio": ("expense_admin", "total_expense"),
    "facility_ratio": ("expense_facility", "total_expense"),
    "surplus_ratio": ("surplus", "total_revenue"),
    "subsidy_dependency": ("revenue_subsidy", "total_revenue"),
    "cost_per_student": ("total_expense", "students"),
    "revenue_per_student": ("total_revenue", "students"),
    "personnel_per_student": ("expense_personnel", "students"),
    "teaching_per_student": ("expense_teaching", "students"),
}
# On which side of its peers a watched ratio is suspicious.
SIDES = {
    "personnel_ratio": "both",
    "cost_per_student": "both",
    "revenue_per_student": "both",
    "personnel_per_student": "both",
    "teaching_per_student": "both",
    "admin_ratio": "high",
    "surplus_ratio": "high",
    "facility_ratio": "high",
    "teaching_ratio": "low",
    "meal_ratio": "low",
}
# The upper capacities of the size classes.
SIZES = ((60, "小型"), (120, "中型"), (200, "大型"))
LARGEST, UNKNOWN_TYPE = "特大型", "未分類"


def _or_null(x: Column) -> Column:
    return F.when(x != 0, x)


def _part(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def financial_ratios(statements: DataFrame) -> DataFrame:
    """Adds the eleven ratios; a total that is missing or zero comes from its parts, a missing surplus from the totals.

    A ratio is null where its denominator is missing or zero.
    """
    total = lambda names: _or_null(sum((F.coalesce(_part(statements, n), F.lit(0.0)) for n in names), F.lit(0.0)))
    revenue = F.coalesce(_or_null(_part(statements, "total_revenue")), total(REVENUES))
    expense = F.coalesce(_or_null(_part(statements, "total_expense")), total(EXPENSES))
    filled = statements.withColumns({"total_revenue": revenue, "total_expense": expense, "surplus": F.coalesce(_part(statements, "surplus"), revenue - expense)})
    value = lambda n: _or_null(_part(statements, "students_avg")) if n == "students" else _part(filled, n)
    return filled.withColumns({name: safe_div(value(a), value(b)) for name, (a, b) in RATIOS.items()})


def peer_key(org_type: Column, capacity: Column) -> Column:
    """Type and size class; without a capacity the smallest class."""
    size = F.lit(LARGEST)
    for most, name in reversed(SIZES):
        size = F.when(F.coalesce(capacity, F.lit(0)) < most, name).otherwise(size)
    return F.concat_ws("|", F.coalesce(F.nullif(org_type, F.lit("")), F.lit(UNKNOWN_TYPE)), size)


def peer_deviations(df: DataFrame, key: str, peer: str, sides: dict[str, str], least: int = 8) -> DataFrame:
    """``key`` with ``dev_`` scores of the ratios in ``sides``, their maximum and mean.

    A ratio is held against its peers' median and scaled MAD (the standard
    deviation where that is 0), or all rows' where under ``least`` peers have
    it.  Without a value the score is 0.  Only aggregates are joined.
    """
    long = df.select(key, peer, F.explode(F.map_from_arrays(F.array(*map(F.lit, sides)), F.array(*(F.col(r).cast("double") for r in sides)))).alias("ratio", "value"))
    there = long.where("value is not null")

    def spread(rows: DataFrame, keys: list[str], names: tuple[str, str, str]) -> DataFrame:
        middle = rows.groupBy(*keys).agg(F.percentile("value", 0.5).alias("m"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
        away = rows.join(middle, keys).groupBy(*keys).agg((F.percentile(F.abs(F.col("value") - F.col("m")), 0.5) * MAD_SCALE).alias("mad"))
        scale = F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("sd"))
        return middle.join(away, keys).select(*keys, F.col("m").alias(names[0]), scale.alias(names[1]), F.col("n").alias(names[2]))

    own, all_ = spread(there, [peer, "ratio"], ("m_own", "s_own", "n_own")), spread(there, ["ratio"], ("m_all", "s_all", "n_all"))
    near = long.join(own, [peer, "ratio"], "left").join(F.broadcast(all_), "ratio", "left")  # one row a ratio
    enough = F.coalesce(F.col("n_own"), F.lit(0)) >= least
    pick = lambda x: F.when(enough, F.col(f"{x}_own")).otherwise(F.col(f"{x}_all"))
    z = F.when((pick("s") > 0) & (pick("n") >= 5), (F.col("value") - pick("m")) / pick("s")).otherwise(0.0)
    score = F.lit(None).cast("double")
    for ratio, side in sides.items():
        score = F.when(F.col("ratio") == ratio, deviation_score(z, side)).otherwise(score)
    scored = near.withColumn("dev", F.when(F.col("value").isNull(), 0.0).otherwise(score))
    return scored.groupBy(key).agg(*(F.max(F.when(F.col("ratio") == r, F.col("dev"))).alias(f"dev_{r}") for r in sides), F.max("dev").alias("dev_max"), F.avg("dev").alias("dev_mean"))


def last_two_score(amounts: DataFrame, key: str, value: str, least: int = 60, top: int = 5) -> DataFrame:
    """Uniformity of the last two digits: n, chi2, p_value (99 degrees of freedom), max_share, score, level and the ``top`` endings with their counts."""
    ends = amounts.select(key, last_two(F.round(F.col(value))).alias("ending")).where("ending is not null").groupBy(key, "ending").agg(F.count("*").alias("c"))
    per = ends.groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max("c").alias("most"), F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "ending"))).alias("ends"))
    n = F.col("n")
    out = per.where(n >= least).withColumn("chi2", 100 * F.col("squares") / n - n).withColumn("max_share", F.col("most") / n).withColumn("p_value", chi2_tail(F.col("chi2"), 99))
    strength = F.least(F.lit(1.0), F.greatest(F.lit(0.0), -F.log10(F.greatest(F.col("p_value"), F.lit(1e-12))) / 6)) * 100
    score = 0.6 * strength + 0.4 * clamp((F.col("max_share") - 0.02) / 0.13 * 100)
    level = F.when(F.col("score") < 20, "均勻（正常）").when(F.col("score") < 50, "輕微群聚").when(F.col("score") < 75, "明顯群聚").otherwise("高度群聚")
    endings = F.array_join(F.transform(F.slice("ends", 1, top), lambda e: F.concat(F.lpad(e["ending"].cast("string"), 2, "0"), F.lit(":"), (-e["c"]).cast("string"))), ",")
    return out.withColumn("score", score).select(key, "n", "chi2", "p_value", "max_share", "score", level.alias("level"), endings.alias("top_endings"))


def conformity(counts: DataFrame, key: str, group: str, least: int = 25, pool_least: int = 2000) -> DataFrame:
    """First digits of each key against its group's others, calibrated by the population.

    ``counts`` has key, group, n and c1..c9.  Returns n, mad, p_value, raw level
    and score, and after division by the median of all MADs the adjusted ratio,
    level and score.
    """
    names = ["n", *(f"c{d}" for d in range(1, 10))]
    per, all_ = counts.groupBy(group).agg(*(F.sum(c).alias(f"g_{c}") for c in names)), counts.agg(*(F.sum(c).alias(f"t_{c}") for c in names))
    joined = counts.where(F.col("n") >= least).join(per, group).join(F.broadcast(all_))
    near = F.col("g_n") - F.col("n") >= pool_least
    pool = {c: F.when(near, F.col(f"g_{c}") - F.col(c)).otherwise(F.col(f"t_{c}") - F.col(c)) for c in names}
    theory = [math.log10(1 + 1 / d) for d in range(1, 10)]
    share = [F.when(pool["n"] > 0, pool[f"c{d}"] / pool["n"]).otherwise(theory[d - 1]) for d in range(1, 10)]
    held = joined.select(key, "n", *(F.col(f"c{d}") for d in range(1, 10)), *(s.alias(f"s{d}") for d, s in enumerate(share, 1)))
    n, digits = F.col("n"), range(1, 10)
    chi2 = sum((F.when(F.col(f"s{d}") > 0, (F.col(f"c{d}") - n * F.col(f"s{d}")) ** 2 / (n * F.col(f"s{d}"))).otherwise(0.0) for d in digits), F.lit(0.0))
    mad = sum(F.abs(F.col(f"c{d}") / n - F.col(f"s{d}")) for d in digits) / 9
    base = sum(F.sqrt(2 * F.col(f"s{d}") * (1 - F.col(f"s{d}")) / (math.pi * n)) for d in digits) / 9
    raw = held.select(key, "n", mad.alias("mad"), F.coalesce(safe_div(mad, base), F.lit(0.0)).alias("ratio"), chi2_tail_8(chi2).alias("p_value"))
    strength = F.least(F.lit(1.0), F.greatest(F.lit(0.0), -F.log10(F.greatest(F.col("p_value"), F.lit(1e-12))) / 5)) * 100
    raw = raw.withColumns({"raw_score": 0.6 * strength + 0.4 * clamp((F.col("ratio") - 1.1) / 1.5 * 100), "raw_level": _level(F.col("ratio"), (1.2, 1.6, 2.2))})
    middle = raw.agg(F.percentile("mad", 0.5).alias("middle"))  # of one number a key
    adjusted = F.col("mad") / F.col("middle")
    out = raw.join(F.broadcast(middle)).withColumn("adjusted", F.when(F.col("middle") > 0, adjusted))
    return out.withColumns({"level": _level(F.col("adjusted"), (1.25, 1.6, 2.0)), "score": F.coalesce(clamp((F.col("adjusted") - 1.2) * 100), F.lit(0.0))}).drop("middle")


def _level(x: Column, marks: tuple[float, float, float]) -> Column:
    return F.when(x < marks[0], "符合").when(x < marks[1], "輕微偏離").when(x < marks[2], "明顯偏離").when(x.isNotNull(), "高度偏離")


def account_rollup(ledger: DataFrame, keys: list[str], account: str, amount: str, groups: dict[str, Iterable[str]]) -> DataFrame:
    """Sum of the amounts of each group's accounts, one column a group; null where none of its accounts occurs."""
    return ledger.groupBy(*keys).agg(*(F.sum(F.when(F.col(account).isin(*names), F.col(amount))).alias(column) for column, names in groups.items()))


# The reasons for which a statement is put aside, in the order of their tests.
REJECTIONS = ("no total", "total not positive", "totals too small", "personnel above expense", "parts differ from expense", "negative remainder", "surplus differs")
_DETAIL = ("expense_personnel", "expense_teaching", "expense_facility", "expense_admin")


def reject_reason(df: DataFrame) -> Column:
    """The first reason to put a statement aside; null where it is sound."""
    revenue, expense, personnel, surplus = (_part(df, n) for n in ("total_revenue", "total_expense", "expense_personnel", "surplus"))
    other = F.coalesce(_part(df, "expense_other"), F.lit(0.0))
    known = sum((F.coalesce(_part(df, n), F.lit(0.0)) for n in _DETAIL), F.lit(0.0))
    detailed = F.coalesce(*(_part(df, n) for n in _DETAIL)).isNotNull()
    tests = (
        revenue.isNull() | expense.isNull(),
        (revenue <= 0) | (expense <= 0),
        (revenue < 1_000_000) | (expense < 1_000_000),
        personnel > expense,
        detailed & (F.abs(expense - known - other) > 0.05 * expense),
        detailed & (other < 0) & (-other > 0.15 * expense),
        F.abs(surplus - (revenue - expense)) > 0.05 * revenue,
    )
    return F.coalesce(*(F.when(t, F.lit(r)) for t, r in zip(tests, REJECTIONS)))


def plausible_totals(revenue: Column, expense: Column, least: float = 500_000, most: float = 3.0) -> Column:
    """Whether both totals reach ``least`` and neither exceeds the other ``most`` times; a missing one is not plausible."""
    fits = (revenue >= least) & (expense >= least) & (F.greatest(revenue, expense) <= most * F.least(revenue, expense))
    return F.coalesce(revenue.isNotNull() & expense.isNotNull() & fits, F.lit(False))
