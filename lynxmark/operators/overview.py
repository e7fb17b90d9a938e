"""Explanations, actions, rescoring and the summary of a scored population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rounded
from .ranking import with_midrank, whole_quantiles
from .scoring import WEIGHTS, dimension_score, final_score, ranked, reasons, rule_score

PRIORITY = ("critical", "high")


def _at_least(x: Column, mark: float) -> Column:
    return F.coalesce(x, F.lit(0.0)) >= mark


def reason_rules(f: dict[str, Column]) -> list[tuple[Column, str, Column]]:
    """The conditions of the twelve explanations with their level and title, in their order; features that are missing meet none.

    ``f`` maps features to columns: counts of penalties, scores of deviations and
    digit tests, ``eval_level`` and ``eval_followed`` of the last evaluation,
    score and burst of the posts, and ``dev_first``, ``dev_second``,
    ``label_first`` and ``label_second``, the two ratios farthest off.
    """
    x = lambda n: f.get(n, F.lit(None)).cast("double")
    yes = lambda n: F.coalesce(f.get(n, F.lit(None)).cast("boolean"), F.lit(False))
    graded = lambda n, low, high, below, above, title: [
        (_at_least(x(n), low) & ~_at_least(x(n), high), below, titled(title)), (_at_least(x(n), high), above, titled(title))
    ]
    # The two ratios farthest off are named by their labels.
    label = lambda n: f.get(f"label_{n}", F.lit(n))
    titled = lambda t: F.concat(label(t[1 : t.index("}")]), F.lit(t[t.index("}") + 1 :])) if t.startswith("{") else F.lit(t)
    failed = F.coalesce(f.get("eval_level", F.lit(None)) == "fail", F.lit(False))
    return [
        (_at_least(x("pen_count_1y"), 1), "high", F.lit("近一年內有裁罰紀錄")),
        (_at_least(x("pen_repeat"), 1), "high", F.lit("同一法條重複違規")),
        (_at_least(x("pen_severe"), 1), "critical", F.lit("涉及重大違規類別")),
        *graded("dev_first", 35, 60, "medium", "high", "{first}顯著偏離同儕"),
        *graded("dev_second", 35, 60, "medium", "high", "{second}顯著偏離同儕"),
        *graded("last2_score", 30, 60, "medium", "high", "決算金額末兩位數出現異常群聚"),
        (_at_least(x("round_score"), 30), "medium", F.lit("金額整數偏誤偏高")),
        (_at_least(x("first_digit_score"), 40), "low", F.lit("首位數分布偏離同儕（參考指標）")),
        (_at_least(x("yoy_expense_score"), 40), "medium", F.lit("年度支出出現異常跳動")),
        (failed, "high", F.lit("最近一次基礎評鑑未全數通過")),
        (~failed & yes("eval_followed"), "low", F.lit("曾接受追蹤評鑑")),
        *graded("senti_score", 40, 60, "medium", "high", "社群輿情負面聲量偏高"),
        (yes("burst"), "critical", F.lit("輿情出現爆量預警")),
    ]


def explain(df: DataFrame, f: dict[str, Column]) -> DataFrame:
    """Adds ``reasons`` (level and title, most serious first), ``top_reasons`` (three titles) and ``critical_flags``."""
    out = df.withColumn("reasons", reasons(reason_rules(f)))
    titles = F.transform("reasons", lambda r: r["title"])
    return out.withColumns({"top_reasons": F.slice(titles, 1, 3), "critical_flags": F.transform(F.filter("reasons", lambda r: r["level"] == "critical"), lambda r: r["title"])})


# Urgency in days and kind of visit by band (days 0: in the usual course).
ACTIONS = {
    "critical": (7, "立即專案稽查（含社政協同）"),
    "high": (14, "優先實地稽查"),
    "medium": (30, "書面查核加抽訪"),
    "low": (0, "常態抽查"),
    "minimal": (0, "免額外查核"),
}


def actions(df: DataFrame, band: Column, dims: dict[str, Column]) -> DataFrame:
    """Adds ``urgency_days``, ``mode`` and ``focus``, the dimension of the highest score, the first of equals."""
    days, mode = F.lit(ACTIONS["low"][0]), F.lit(ACTIONS["low"][1])
    for name, (d, m) in ACTIONS.items():
        days, mode = F.when(band == name, d).otherwise(days), F.when(band == name, m).otherwise(mode)
    best = F.array_max(F.array(*(F.struct(score.alias("s"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, score) in enumerate(dims.items()))))
    return df.withColumns({"urgency_days": days, "mode": mode, "focus": best["name"]})


def contributions(dims: dict[str, Column], available: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> dict[str, Column]:
    """Points that each dimension adds to the rule score: its score by its part of the available weights; 0 where it is not available."""
    whole = sum((F.when(available.get(d, F.lit(True)), w).otherwise(0.0) for d, w in weights.items()), F.lit(0.0))
    return {d: F.when(available.get(d, F.lit(True)) & (whole > 0), rounded(dims[d] * w / whole, 2)).otherwise(0.0) for d, w in weights.items()}


def rescore(features: DataFrame, key: str, probability: str, weights: dict[str, float] = WEIGHTS, blend: float = 0.25, available: dict[str, Column] | None = None) -> DataFrame:
    """Dimension, rule and final score, rank, percentile and band from features that are there, none computed anew.

    The model's score is its probability's mid-rank among all.  Half-way cases
    are rounded by their decimal value: noise beyond the eighth place goes first.
    """
    places = lambda c: F.round(F.round(c, 8), 2)
    scored = with_midrank(features, probability)
    dims = {d: dimension_score(d, {c: F.col(c) for c in features.columns}) for d in weights}
    scored = scored.select(key, *(c.alias(d) for d, c in dims.items()), places(F.col("midrank") * 100).alias("model_score"), *(n for n in features.columns if n not in (key, *dims)))
    rule = places(rule_score({d: F.col(d) for d in weights}, available, weights))
    scored = scored.withColumn("rule_score", rule)
    return ranked(scored.withColumn("score", places(final_score(F.col("rule_score"), F.col("model_score"), blend))), "score", key)


def summary(rows: DataFrame, score: str = "score", band: str = "band", penalised: str = "pen_count_4y", burst: str = "burst") -> DataFrame:
    """One row: size, high risks and their part, mean and median score, penalised, bursting and unpenalised priority rows, lowest priority score; zeros for an empty table."""
    priority = F.col(band).isin(*PRIORITY)
    clean = F.coalesce(F.col(penalised), F.lit(0)) == 0
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n = F.count("*")
    out = rows.agg(
        n.alias("n_institutions"), F.count_if(priority).alias("n_high_risk"), zero(rounded(F.try_divide(F.count_if(priority) * 100, n), 1)).alias("high_risk_pct"), F.count_if(F.col(band) == "critical").alias("n_critical"),
        zero(rounded(F.avg(score), 2)).alias("avg_score"), F.count_if(~clean).alias("n_penalized_4y"), F.count_if(F.col(burst)).alias("n_burst"), F.count_if(priority & clean).alias("n_priority_no_penalty"),
        zero(rounded(F.min(F.when(priority, F.col(score))), 2)).alias("priority_cut_score"),
    )
    middle = whole_quantiles(rows, score, (0.5,)).select(zero(rounded("q0", 2)).alias("median_score"))
    return out.join(F.broadcast(middle), F.lit(True), "left").withColumn("median_score", zero(F.col("median_score")))


def dimension_overview(rows: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Mean, median and 90th percentile of each dimension over the whole table."""
    out = None
    for d in dims:
        q = whole_quantiles(rows, d, (0.5, 0.9)).select(F.lit(d).alias("dimension"), rounded("q0", 4).alias("median"), rounded("q1", 4).alias("p90"))
        one = rows.agg(rounded(F.avg(d), 4).alias("mean")).join(F.broadcast(q)).select("dimension", "mean", "median", "p90")
        out = one if out is None else out.union(one)
    return out


def importance(coefficients: DataFrame, name: str = "feature", coef: str = "coef") -> DataFrame:
    """Coefficients by size with their odds ratios, exponents kept within 20."""
    c = F.col(coef)
    return coefficients.select(name, rounded(c, 4).alias("coef"), F.abs(c).alias("abs"), rounded(F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), c))), 3).alias("odds_ratio")).orderBy(F.desc("abs"), name)
