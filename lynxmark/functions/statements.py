"""Column expressions over scanned statements and registers: amounts, plausibility, classes by keyword."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that belong to an amount, as scans render them.
SEPARATORS = "，﹒、‧,.·﹐﹑"
BRACKETS = "(（﹙︵﹝)）﹚︶﹞"
CURRENCY = "$￥﹩¥＄%﹪％"


def _inside(chars: str) -> str:
    return "".join("\\" + c if ord(c) < 128 else c for c in chars)


def line_amounts(line: Column) -> Column:
    """All amounts of a line: each run of digits and their marks is one whole number, negative with a bracket in it."""
    runs = F.regexp_extract_all(line, F.lit(f"([0-9{_inside(SEPARATORS + BRACKETS + CURRENCY)}]+)"), 1)
    value = lambda r: F.regexp_replace(r, "[^0-9]", "").cast("double")
    return F.transform(F.filter(runs, lambda r: r.rlike("[0-9]")), lambda r: F.when(r.rlike(f"[{_inside(BRACKETS)}]"), -value(r)).otherwise(value(r)))


def without_stray_slashes(line: Column) -> Column:
    """Slashes between digits are noise of the scan."""
    return F.regexp_replace(line, r"(?<=\d)/(?=\d)", "")


def settled_amount(amounts: Column) -> Column:
    """The settled figure of a row of budget, settled, difference, rate: the second of three or more; of two the first, or the one that ends in the other's digits; null for none."""
    first, second = F.try_element_at(amounts, F.lit(1)), F.try_element_at(amounts, F.lit(2))
    digits = lambda x: F.abs(x).cast("decimal(38,0)").cast("string")
    longer = (F.length(digits(second)) > F.length(digits(first))) & F.endswith(digits(second), digits(first))
    return F.when(F.size(amounts) >= 3, second).when((F.size(amounts) == 2) & longer, second).otherwise(first)


def plausible_amount(value: Column, total: Column | None = None, low: float = 0.0005, high: float = 1.5, least: float = 1000.0) -> Column:
    """The amount, or null where it is below ``least`` or its share of a known total lies outside ``low`` to ``high``; zero stays."""
    size = F.abs(value)
    good = (size == 0) | (size >= least)
    if total is not None:
        whole = F.abs(total)
        good = good & ((size == 0) | F.coalesce(whole == 0, F.lit(True)) | F.coalesce(size.between(whole * low, whole * high), F.lit(True)))
    return F.when(good & ~F.isnan(value), value)


def plausible_headcount(value: Column, capacity: Column | None = None, low: int = 1, high: int = 2000, share: float = 0.15) -> Column:
    """Whole headcount, or null outside ``low`` to ``high`` or under ``share`` of a known capacity."""
    n = F.bround(value, 0).cast("int")
    good = n.between(low, high)
    if capacity is not None:
        cap = F.bround(capacity, 0)
        good = good & F.coalesce((cap <= 0) | (n >= cap * share), F.lit(True))
    return F.when(good, n)


def consistent_surplus(after_tax: Column, before_tax: Column, revenue: Column, expense: Column) -> Column:
    """Of two stated surpluses the one nearer to revenue less expense (ties and unknown totals: after tax)."""
    away = lambda x: F.abs(x - (revenue - expense))
    return F.when(after_tax.isNull() | (away(before_tax) < away(after_tax)), before_tax).otherwise(after_tax)


def _closed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def first_class(text: Column, rules: dict[str, tuple[str, ...]], default: str) -> Column:
    """Name of the first rule with a keyword in the text, white space ignored."""
    t, out = _closed(text), None
    for name, words in rules.items():
        hit = _holds(t, tuple(w.replace(" ", "") for w in words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


# Phrases of the register's evaluation results and institution names.
PASSED = ("全數指標通過", "全部通過")
FAILED = ("部分", "未通過", "不通過", "待改善", "限期改善")
FLAGGED = ("部分", "未通過", "不通過", "待改善")
CHILDCARE = ("幼兒園", "幼稚園", "托兒所")
PRIMARY = ("國民小學", "實驗小學", "國民中小學")
UPPER = ("高級中", "高中", "職業學校", "專科", "大學", "特殊教育學校")
# Violation classes and their keywords, the first that fits counts.
VIOLATIONS = {
    "兒少保護事件": ("身心虐待", "兒童及少年福利與權益保障法", "性騷擾", "性侵", "妨害幼兒身心", "傷害幼兒", "兒少保護", "第30條"),
    "不當管理行為": ("不當管教", "不當對待", "體罰", "教保服務人員條例", "妨害人格發展", "言語脅迫", "處罰幼兒"),
    "師生比不足": ("師生比", "教保服務人員配置", "第16條", "編班", "年齡規定", "未依規定配置"),
    "超收幼生": ("超收", "招收人數超過", "逾核定人數", "超過核定"),
    "人員資格不符": ("資格不符", "未具教保服務人員資格", "不得擔任", "消極資格", "未依規定進用", "教職員資料", "第15條"),
    "設施安全缺失": ("建築物", "消防", "公共安全", "設施設備", "空間不符", "使用執照", "逃生"),
    "餐飲衛生違規": ("食品", "餐飲", "衛生", "膳食", "食安", "廚房"),
    "收退費違規": ("收退費", "收費", "退費", "超收費用", "未依公告收費", "代辦費", "第38條"),
    "未依法通報": ("未通報", "通報義務", "未依規定通報", "知悉未報"),
}
OTHER_VIOLATION = "行政管理缺失"


def violation(text: Column) -> Column:
    return first_class(text, VIOLATIONS, OTHER_VIOLATION)


def evaluation_level(result: Column) -> Column:
    """pass, fail or unknown; a partly passed evaluation is a fail."""
    t = _closed(result)
    return F.when(_holds(t, PASSED), "pass").when(_holds(t, FAILED), "fail").otherwise("unknown")


def evaluation_flags(result: Column) -> Column:
    """``(failed, followup)`` as 0 or 1; a failed evaluation is always followed up."""
    t = _closed(result)
    failed = ~F.contains(t, F.lit(PASSED[0])) & _holds(t, FLAGGED)
    return F.struct(failed.cast("int").alias("failed"), (failed | F.contains(t, F.lit("追蹤評鑑"))).cast("int").alias("followup"))


def institution_kind(name: Column) -> Column:
    """Kind of a childcare institution by its cleaned name."""
    n = F.coalesce(name, F.lit(""))
    return (
        F.when(F.contains(n, F.lit("職場互助教保服務中心")), "職場互助教保服務中心").when(F.contains(n, F.lit("互助教保服務中心")), "社區部落互助教保服務中心")
        .when(~_holds(n, CHILDCARE), "非教保機構").when(~F.contains(n, F.lit("附設")), "獨立幼兒園").when(_holds(n, PRIMARY), "國小附設幼兒園")
        .when(F.contains(n, F.lit("國民中學")), "國中附設幼兒園").when(_holds(n, UPPER), "高中職大專附設幼兒園").otherwise("法人公司附設幼兒園")
    )


def event_day(text: Column) -> Column:
    """First date in a free text, years before 1911 counted from there; null without one or for a day that is none."""
    y, m, d = (F.regexp_extract(text, r"(\d{2,4})[./年-](\d{1,2})[./月-](\d{1,2})", k) for k in (1, 2, 3))
    year = y.try_cast("int")
    return F.when(y != "", F.concat_ws("-", F.lpad((F.when(year < 1911, year + 1911).otherwise(year)).cast("string"), 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date"))


# How a unit's line names a kindergarten and a school, in scans without spaces.
UNIT_KINDERGARTEN = r"(136\d{2})\D{0,4}(新北市[\u4e00-\u9fff]{1,12}?幼兒園)"
UNIT_SCHOOL = (
    r"(1[3-6]\d{3})\D{0,4}(新北市[\u4e00-\u9fff]{1,20}?(?:高級中等學校|高級商工職業學校|高級工業職業學校|高級中學|特殊教育學校|實驗國民中學|國民中學|實驗小學|國民中小學|國民小學))"
)


def unit_row(line: Column) -> Column:
    """``kind, name, revenue, expense`` of a line of a table of units, the unit's own code taken off its amounts; null without a unit or two amounts."""
    closed = F.replace(line, F.lit(" "), F.lit(""))
    code = lambda pattern: F.regexp_extract(closed, pattern, 1)
    garden = code(UNIT_KINDERGARTEN) != ""
    number = F.when(garden, code(UNIT_KINDERGARTEN)).otherwise(code(UNIT_SCHOOL))
    name = F.when(garden, F.regexp_extract(closed, UNIT_KINDERGARTEN, 2)).otherwise(F.regexp_extract(closed, UNIT_SCHOOL, 2))
    found = line_amounts(without_stray_slashes(line))
    leads = F.coalesce(F.try_element_at(found, F.lit(1)) == number.try_cast("double"), F.lit(False))
    at = lambda k: F.try_element_at(found, F.when(leads, k + 1).otherwise(k))
    made = F.struct(F.when(garden, "kindergarten").otherwise("school").alias("kind"), name.alias("name"), at(1).alias("revenue"), at(2).alias("expense"))
    return F.when((number != "") & at(2).isNotNull(), made)


def _window(text: Column, start: Column, ends: tuple[str, ...], most: int) -> Column:
    """The ``most`` characters from ``start`` (from 1), or up to the first of ``ends`` among them."""
    part = F.substring(text, start, F.lit(most))
    for end in ends:
        part = F.substring_index(part, end, 1)
    return part


def headcounts(page: Column) -> Column:
    """``capacity, enrolled, staff, teachers`` that a page's notes state, each from the window behind its keyword; implausible ones are null."""
    text = _closed(page)
    place = lambda word: F.instr(text, word)
    numbers = lambda part, most: F.filter(line_amounts(part), lambda x: x.between(1, most))
    first, second = place("核定"), place("招收")
    near = (first > 0) & (second > 0) & (second - first).between(0, 6)
    seats = F.when(near, numbers(_window(text, first, ("。", "七﹚", "七)", "七］", "七】"), 40), 2000))
    staff = F.when(place("員工人數") > 0, numbers(_window(text, place("員工人數"), ("。",), 40), 500))
    at = lambda x, k: F.try_element_at(x, F.lit(k))
    capacity, enrolled = at(seats, 1), F.coalesce(at(seats, 2), at(seats, 1))
    whole = lambda x: x.cast("int")
    return F.struct(plausible_headcount(capacity).alias("capacity"), plausible_headcount(enrolled, capacity).alias("enrolled"), whole(at(staff, 1)).alias("staff"), whole(at(staff, 2)).alias("teachers"))
