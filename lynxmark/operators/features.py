"""Features of institutions as of a date, from penalties, statements, evaluations and posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp

# Days of the three windows, the decay's time constant, and the severity of an unknown category.
WINDOWS = {"pen_count_1y": 365, "pen_count_2y": 730, "pen_count_4y": 1460}
DECAY_DAYS, UNKNOWN_SEVERITY, SEVERE = 540.0, 1.2, 2.5
# Severity of the categories of penalties and of their dispositions, and points of an evaluation's level.
CATEGORIES = {
    "兒少保護事件": 3.0,
    "不當管理行為": 2.7,
    "師生比不足": 2.0,
    "超收幼生": 1.9,
    "人員資格不符": 1.8,
    "設施安全缺失": 1.7,
    "餐飲衛生違規": 1.6,
    "收退費違規": 1.5,
    "未依法通報": 1.4,
    "行政管理缺失": 1.0,
}
DEFAULT_CATEGORY = "行政管理缺失"
DISPOSITIONS = {"停止招生": 3.0, "減招": 2.6, "公布姓名及名稱": 2.2, "罰鍰並限期改善": 1.8, "罰鍰": 1.4, "限期改善": 1.1}
LEVEL_POINTS = {"pass": 0.0, "fail": 100.0}


def fiscal_cut(as_of: Column) -> Column:
    """The last fiscal year that a date may know of: the year before in its first half, else its own."""
    return F.year(as_of) - F.when(F.month(as_of) <= 6, 1).otherwise(0)


def _mapped(column: Column, values: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for name, value in values.items():
        out = F.when(column == name, float(value)).otherwise(out)
    return out


def penalty_features(penalties: DataFrame, key: str, as_of: str, severity: dict[str, float] = CATEGORIES, dispositions: dict[str, float] = DISPOSITIONS, default: str = DEFAULT_CATEGORY, windows: dict[str, int] = WINDOWS, decay_days: float = DECAY_DAYS) -> DataFrame:
    """Counts, decayed severity, fines, severe cases, repeats of an article, worst disposition and recency by key.

    ``penalties`` has penalty_date, category, law_article, disposition and
    fine_amount.  An undated penalty is known, as of any date, but has no age and
    adds to nothing; one after ``as_of`` is not known.  A missing article counts
    as its category, a missing category as ``default``.
    """
    day = F.to_date(F.lit(as_of))
    longest = float(max(windows.values()))
    known = penalties.where(F.col("penalty_date").isNotNull() & (F.col("penalty_date") <= day))
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(default))
    rows = known.select(
        key, F.datediff(day, "penalty_date").alias("age"), _mapped(category, severity, UNKNOWN_SEVERITY).alias("sev"), F.coalesce(F.nullif(F.col("law_article"), F.lit("")), category).alias("article"),
        F.coalesce(F.col("fine_amount").cast("double"), F.lit(0.0)).alias("fine"), _mapped(F.col("disposition"), dispositions, 1.0).alias("disposition"),
    )
    # By article first, so that a key with very many penalties is aggregated before it moves.
    per = rows.groupBy(key, "article").agg(
        F.count("*").alias("n"), *(F.count_if(F.col("age") <= d).alias(name) for name, d in windows.items()), F.sum(F.col("sev") * F.exp(-F.col("age") / decay_days)).alias("decay"), F.sum("fine").alias("fines"),
        F.max("fine").alias("fine"), F.count_if(F.col("sev") >= SEVERE).alias("severe"), F.max("disposition").alias("disposition"), F.min("age").alias("age"),
    )
    return per.groupBy(key).agg(
        *(F.sum(name).alias(name) for name in windows), F.round(F.sum("decay"), 4).alias("pen_decay"), F.log10(1 + F.sum("fines")).alias("pen_fine_total_log"), F.log10(1 + F.max("fine")).alias("pen_fine_max_log"),
        F.sum("severe").alias("pen_severe"), (F.max("n") - 1).alias("pen_repeat"), F.max("disposition").alias("pen_disp_sev"), F.greatest(F.lit(0.0), 1 - F.least(F.min("age"), F.lit(longest)) / longest).alias("pen_recency"),
    )


def evaluation_features(evaluations: DataFrame, key: str, year: int, level: Column, tie: str, points: dict[str, float] = LEVEL_POINTS) -> DataFrame:
    """The last evaluation's points, open items, follow-up and score, and the number of failed ones, up to a year."""
    known = evaluations.where(F.coalesce("eval_year", F.lit(0)) <= year).withColumn("level", level)
    last = lambda c: F.max_by(c, F.struct(F.coalesce("eval_year", F.lit(0)), F.col(tie)))
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    out = known.groupBy(key).agg(
        last(F.col("level")).alias("eval_level"), last(value("items_failed")).alias("eval_items_failed"), last(value("followup_required")).alias("eval_followup"), last(value("score")).alias("_s"),
        F.count_if(F.col("level") == "fail").cast("double").alias("eval_fail_history"),
    )
    told = F.coalesce(*(F.when(F.col("eval_level") == name, float(p)) for name, p in points.items()))
    return out.withColumns({"eval_penalty": told, "eval_score": F.when(F.col("_s") != 0, F.col("_s"))}).drop("_s")


def yearly_features(statements: DataFrame, key: str, columns: dict[str, str], cut: Column) -> DataFrame:
    """Jump scores of yearly series (``columns`` maps a score's name to its column) up to the fiscal year ``cut``, and ``fin_available``.

    A change is from one year with a value other than zero to the next such
    year.  Years of one key are few.
    """
    known = statements.where(F.coalesce("fiscal_year", F.lit(0)) <= cut)

    def score(column: str) -> Column:
        series = F.sort_array(F.collect_list(F.when(F.coalesce(F.col(column), F.lit(0)) != 0, F.struct("fiscal_year", F.col(column).cast("double").alias("v")))))
        steps = lambda s: F.transform(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda x, i: F.abs((x["v"] - s[i]["v"]) / F.abs(s[i]["v"])))
        return F.coalesce(clamp((F.array_max(F.transform(F.array(series), steps)[0]) - 0.15) / 0.65 * 100), F.lit(0.0))

    return known.groupBy(key).agg(*(F.round(score(c), 2).alias(name) for name, c in columns.items()), F.lit(1.0).alias("fin_available"))


def institution_features(institutions: DataFrame, key: str, parts: list[DataFrame], zero: tuple[str, ...], as_of: str) -> DataFrame:
    """One row per institution with its capacity, age and the features of ``parts``; those in ``zero`` are 0 where there is no fact."""
    out = institutions.select(key, F.coalesce("approved_capacity", F.lit(0)).alias("capacity"), F.greatest(F.lit(0), F.year(F.to_date(F.lit(as_of))) - F.coalesce("found_year", F.year(F.to_date(F.lit(as_of))))).alias("inst_age"))
    for part in parts:
        out = out.join(part, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(out.schema[c].dataType)) for c in zero})
