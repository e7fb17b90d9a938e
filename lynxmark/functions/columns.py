"""Scalar building blocks as Column expressions; all stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or null where it is null, NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_div(a: Column, b: Column) -> Column:
    """a / b; null on a null or zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """x within [low, high]; null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def rounded(x: Column | str, places: int) -> Column:
    """x to so many places as the SQL rounds it: the scaled double's halves go away from zero.

    ``F.round`` rounds the shortest decimal that stands for x, which is on the
    other side where a half-way case lies a little off in binary.
    """
    x = (F.col(x) if isinstance(x, str) else x).cast("double")  # named once: long scores would multiply the code
    return F.round(x * float(10**places), 0) / float(10**places)


def weighted_mean(pairs: Iterable[tuple[Column, float]]) -> Column:
    """Mean of the values that are there, by weight; 0 where none is."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for value, w in pairs:
        there = value.isNotNull()
        total = total + F.when(there, value * w).otherwise(0.0)
        weight = weight + F.when(there, F.lit(w)).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(0.0)


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(z, -60, 60)))


def first_digit(x: Column) -> Column:
    """First significant digit of |x| >= 1, from the whole part's first character; else null."""
    whole = F.floor(F.abs(x)).cast("long")
    return F.when(whole >= 1, F.substring(whole.cast("string"), 1, 1).cast("int"))


def last_two(x: Column) -> Column:
    """Last two digits of |x| >= 100; else null."""
    whole = F.floor(F.abs(x)).cast("long")
    return F.when(whole >= 100, (whole % 100).cast("int"))


def benford_share(digit: Column) -> Column:
    return F.log10(1 + 1 / digit)


def sampling_mad(expected: Iterable[float], n: Column) -> Column:
    """Mean absolute deviation that a sample of n shows by chance alone."""
    expected = list(expected)
    return sum(math.sqrt(2 * p * (1 - p) / math.pi) for p in expected) / len(expected) / F.sqrt(n)


def chi2_tail_8(x: Column) -> Column:
    """Right tail of chi-square with 8 degrees of freedom, in closed form."""
    h = x / 2
    return F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)


def chi2_tail(x: Column, freedom: int, most: float = 600.0) -> Column:
    """Right tail of chi-square with any degrees of freedom: 1 less the series of the lower incomplete gamma function; 0 beyond ``most``.

    The terms' log-gammas are constants, so that each is one exponential.
    """
    a, h = freedom / 2, x / 2
    terms = F.array(*(F.lit(math.lgamma(a + n + 1)) for n in range(int(most))))
    log_h = F.log(F.greatest(h, F.lit(1e-300)))
    lower = F.aggregate(F.transform(terms, lambda g, n: F.exp((a + n) * log_h - h - g)), F.lit(0.0), lambda s, t: s + t)
    return F.when(x.isNull(), None).when(x <= 0, 1.0).when(x > most, 0.0).otherwise(clamp(1 - lower, 0, 1))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, by its series of odd powers within 8 standard deviations."""
    half = F.least(F.lit(8.0), F.greatest(F.lit(-8.0), x))
    step = lambda a, n: F.struct((a["t"] * half * half / (2 * n + 1)).alias("t"), (a["s"] + a["t"]).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(half.cast("double").alias("t"), F.lit(0.0).alias("s")), step)["s"]
    return clamp(0.5 + series * F.exp(-half * half / 2) / math.sqrt(2 * math.pi), 0, 1)


def poisson_tail(k: Column, rate: Column) -> Column:
    """P(X >= k), terms accumulated so that no factorial overflows."""
    term = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(0), (k - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.struct(F.exp(-rate).alias("t"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct((a["t"] * rate / (i + 1)).alias("t"), (a["s"] + a["t"]).alias("s")),
    )
    return F.greatest(F.lit(0.0), 1 - term["s"])


def roc_year(x: Column) -> Column:
    """Whole years; below 200 counted from 1911."""
    n = F.bround(number(x), 0).cast("int")
    return F.when(n < 200, n + 1911).otherwise(n)


def number(text: Column) -> Column:
    """First number in a text without separators and currency; negative in parentheses; null where there is none."""
    t = F.regexp_replace(F.trim(text.cast("string")), r"[,\s$，＄]|NT|元", "")
    found = F.regexp_extract(t, r"-?\d+(?:\.\d+)?", 0)
    value = F.when(found != "", found.try_cast("double"))
    return F.when(t.rlike(r"^[(（].*[)）]$"), -F.abs(value)).otherwise(value)


def whole(text: Column) -> Column:
    return F.bround(number(text), 0).cast("long")


def flexible_date(text: Column) -> Column:
    """ISO, slashed, dotted, compact and CJK dates; years below 200 count from 1911; null where none fits."""
    t = F.trim(F.regexp_replace(text, r"[年月/.\-]", " "))
    t = F.trim(F.regexp_replace(t, r"日.*$|T.*$", ""))
    y, m, d = (F.regexp_extract(t, r"^(\d{1,4})\s+(\d{1,2})\s+(\d{1,2})", k) for k in (1, 2, 3))
    compact = F.regexp_extract(t, r"^(\d{3,4})(\d{2})(\d{2})$", 0) != ""
    y, m, d = (F.when(compact, F.regexp_extract(t, r"^(\d{3,4})(\d{2})(\d{2})$", k)).otherwise(v) for k, v in ((1, y), (2, m), (3, d)))
    year = y.try_cast("int")
    year = F.when(year < 200, year + 1911).otherwise(year)
    return F.when(y != "", F.format_string("%04d-%s-%s", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date"))


def strip_html(html: Column) -> Column:
    """Text of a page: scripts and styles out, tags to spaces, the common entities back, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def occurrences(text: Column, word: str) -> Column:
    """Times that ``word`` stands in ``text``, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def stable_id(city: Column, name: Column) -> Column:
    """K and ten hexadecimal digits of the SHA-1 of city and name."""
    return F.concat(F.lit("K"), F.upper(F.substring(F.sha1(F.concat(city, F.lit("|"), name).cast("binary")), 1, 10)))


def band(rank: Column, total: Column) -> Column:
    """Risk band from a rank: top 2, 8, 25, 60 and 100 percent, in whole numbers; each band holds its lower edge."""
    place = (rank - 1) * 100
    return (
        F.when(place < total * 2, "critical").when(place < total * 8, "high").when(place < total * 25, "medium").when(place < total * 60, "low").otherwise("minimal")
    )
