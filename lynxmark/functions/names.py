"""Names, addresses and districts as scanned or published, cleaned and made comparable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.texts import nfkc

# The districts of the city, and misreadings of them that were seen.
DISTRICTS = (
    "板橋區", "三重區", "中和區", "永和區", "新莊區", "新店區", "樹林區", "鶯歌區", "三峽區", "淡水區", "汐止區", "瑞芳區", "土城區", "蘆洲區", "五股區",
    "泰山區", "林口區", "深坑區", "石碇區", "坪林區", "三芝區", "石門區", "八里區", "平溪區", "雙溪區", "貢寮區", "金山區", "萬里區", "烏來區",
)
MISREAD = {
    "新苗區": "新莊區",
    "新菜區": "新莊區",
    "鷺歌區": "鶯歌區",
    "驚歌區": "鶯歌區",
    "蘆州區": "蘆洲區",
    "汐上區": "汐止區",
    "士城區": "土城區",
    "五穀區": "五股區",
    "泰川區": "泰山區",
    "淡小區": "淡水區",
    "永合區": "永和區",
    "中合區": "中和區",
    "板檐區": "板橋區",
    "三崚區": "三峽區",
    "萬裡區": "萬里區",
}
# Marks that scanning leaves at the ends, before and after normalisation.
NOISE = "﹒﹕﹔﹑﹐﹏﹍﹎︱︰＀‧·˙､。︵︶╰╭╲╱｀`¨ˇˋ"
PLAIN_START, PLAIN_END = r"_\-~`^'\".,;:·・", r"_\-~`^'\""
# What a name carries besides the institution's own.
KINDS = ("非營利", "私立", "市立", "縣立", "公立", "準公共")
ENTITIES = ("幼兒園", "幼稚園", "托兒所", "教保服務中心")
CITIES = "新北|臺北|台北|桃園|基隆|新竹|苗栗|臺中|台中"
ATTACHED = "附設"
DELEGATED = r"[（(][^（()）]*(?:委託|受託|辦理)[^（()）]*[）)]"


def _ends(text: Column, first: str, last: str) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"^[\s{first}]+", ""), rf"[\s{last}]+$", "")


def clean_text(text: Column) -> Column:
    """A scanned text without marks at its ends, NFKC, single spaces; null is empty."""
    t = _ends(F.coalesce(text.cast("string"), F.lit("")), NOISE, NOISE)
    t = _ends(_ends(nfkc(t), NOISE, NOISE), PLAIN_START, PLAIN_END)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clean_address(text: Column) -> Column:
    """A cleaned address without the postal code in brackets, plain hyphens, misread districts put right."""
    t = F.trim(F.regexp_replace(clean_text(text), r"^\[\d{3,5}\]", ""))
    t = F.translate(t, "－−﹣", "---")
    for bad, good in MISREAD.items():
        t = F.replace(t, F.lit(bad), F.lit(good))
    return F.trim(t)


def district_of_address(address: Column) -> Column:
    """The first district of the list, then of the misreadings, that an address holds; empty without one."""
    a = clean_text(address)
    found = [F.when(a.contains(d), F.lit(d)) for d in DISTRICTS] + [F.when(a.contains(bad), F.lit(good)) for bad, good in MISREAD.items()]
    return F.coalesce(*found, F.lit(""))


def district(text: Column, address: Column) -> Column:
    """The legal district: as written, by the misreadings, by the address, or the only one at one edit; else empty."""
    t = clean_text(text)
    t = F.when(t.endswith("區"), t).otherwise(F.concat(t, F.lit("區")))
    fixed = F.coalesce(*(F.when(t == bad, F.lit(good)) for bad, good in MISREAD.items()))
    near = F.array_compact(F.array(*(F.when(F.levenshtein(t, F.lit(d)) == 1, F.lit(d)) for d in DISTRICTS)))
    by_address = district_of_address(address)
    guess = F.when(F.size(near) == 1, F.get(near, F.lit(0))).otherwise("")
    return F.when(clean_text(text) == "", by_address).when(t.isin(*DISTRICTS), t).otherwise(F.coalesce(fixed, F.when(by_address != "", by_address), guess))


def core_name(text: Column) -> Column:
    """A name without city, district, kind and entity words and without anything but letters, digits and CJK characters."""
    t = F.regexp_replace(text, rf"^({CITIES})(市|縣)?(立)?", "")
    t = F.regexp_replace(t, r"^[一-鿿]{2,3}區", "")
    for word in (*KINDS, *ENTITIES):
        t = F.replace(t, F.lit(word), F.lit(""))
    return F.regexp_replace(t, r"[^0-9A-Za-z一-鿿]+", "")


def canonical_name(name: Column) -> Column:
    """What identifies an institution in any source.

    A note of delegation goes.  Of a name with "attached" the part behind it
    counts, as with companies; where nothing is left of that, as with schools,
    the part before it.
    """
    t = F.trim(F.regexp_replace(clean_text(name), DELEGATED, ""))
    at = F.locate(ATTACHED, t)
    tail, head = F.substring(t, at + len(ATTACHED), F.length(t)), F.substring(t, F.lit(1), at - 1)
    return F.when(at > 0, F.when(core_name(tail) != "", core_name(tail)).otherwise(core_name(head))).otherwise(core_name(t))


def stable_id(city: Column, name: Column) -> Column:
    """K and ten hexadecimal digits of the SHA-1 of the city and the cleaned whole name."""
    return F.concat(F.lit("K"), F.upper(F.substring(F.sha1(F.concat(city, F.lit("|"), clean_text(name)).cast("binary")), 1, 10)))


def section_of(line: Column) -> Column:
    """``revenue`` or ``expense`` for a line that says just that, whatever marks stand beside; null for others."""
    t = F.regexp_replace(line, r"\s+", "")
    cjk = F.regexp_replace(t, r"[^一-鿿]", "")
    return F.when(t.rlike(r"\d"), None).when(cjk == "收入", "revenue").when(cjk == "支出", "expense")


def label_of(line: Column) -> Column:
    """The account's name at the beginning of a line: CJK characters before a number, a sign of money or a note."""
    t = F.regexp_replace(line, r"\s+", "")
    t = F.regexp_replace(t, r"(?s)[0-9$￥﹩(（].*$", "")
    t = F.regexp_replace(t, r"(?s)[、﹒·．,，].*$", "")
    return F.regexp_replace(t, r"[^一-鿿]", "")


def ratio_text(name: str, value: Column) -> Column:
    """A ratio as shown: whole currency a student, else a percentage with one decimal; a dash for null."""
    money = F.concat(F.format_number(F.round(value, 0), 0), F.lit(" 元"))
    return F.coalesce(money if name.endswith("_per_student") else F.concat(F.format_string("%.1f", value * 100), F.lit("%")), F.lit("-"))


def without_name(text: Column, name: Column, instead: str = "該園") -> Column:
    """A text in which an institution's own name doesn't count."""
    return F.when(F.coalesce(name, F.lit("")) != "", F.replace(text, name, F.lit(instead))).otherwise(text)


def cleaned_master(rows: DataFrame) -> DataFrame:
    """Name, address and district of a master table cleaned, and its ``canonical`` name beside them."""
    return rows.withColumns(
        {"name": clean_text(F.col("name")), "address": clean_address(F.col("address")), "district": district(F.col("district"), F.col("address")), "canonical": canonical_name(F.col("name"))}
    )

# How the names of schools end.
SCHOOLS = (
    "國民小學", "國民中學", "國民中小學", "實驗小學", "實驗國民中學", "高級中學", "高級中等學校", "高級商工職業學校", "高級工業職業學校", "特殊教育學校", "專科學校", "科技大學", "大學",
)
#: Those whose attached kindergartens share the school's row in public accounts.
ACCOUNTED = tuple(s for s in SCHOOLS if s not in ("專科學校", "科技大學", "大學"))
CITY = "新北市"


def is_childcare(name: Column) -> Column:
    """Whether a name is of childcare: it says so, or it does not end as a school; an empty name is not."""
    n = clean_text(name)
    says, school = F.lit(False), F.lit(False)
    for word in ENTITIES:
        says = says | n.contains(word)
    for word in SCHOOLS:
        school = school | n.endswith(word)
    return (n != "") & (says | ~school)


def school_core(name: Column) -> Column:
    """A school's name without city, district, "established" and what is attached, alike for both ways of writing it."""
    n = F.regexp_replace(F.regexp_replace(name, CITY, ""), r"^[一-鿿]{2,3}區", "")
    return F.regexp_replace(F.regexp_replace(n, r"^立", ""), rf"(?s){ATTACHED}.*$", "")


def school_lookup(institutions: DataFrame, key: str = "inst_id", name: str = "name") -> DataFrame:
    """``core`` and ``key`` of the kindergartens attached to schools, by the school's core name; of several the last id."""
    core = school_core(F.col(name))
    ends = F.lit(False)
    for word in ACCOUNTED:
        ends = ends | core.endswith(word)
    return institutions.where(F.col(name).contains(ATTACHED) & ends).groupBy(core.alias("core")).agg(F.max(key).alias(key))


def search_name(name: Column) -> Column:
    """What people call a kindergarten: its name without city, founder and "kindergarten"."""
    bare = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"^(新北市|臺北市|台北市)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"^(私立|市立|縣立|公立|非營利)", ""), r"(非營利幼兒園|附設幼兒園|幼兒園|幼稚園)$", ""))


def search_queries(name: Column, place: Column, elsewhere: str = "新北") -> Column:
    """Search texts of an institution: its whole name, and its short name with its place where that has two characters or more."""
    short = search_name(name)
    near = F.when(F.coalesce(place, F.lit("")) != "", place).otherwise(elsewhere)
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    second = F.when(F.length(short) >= 2, F.concat(quoted(F.concat(short, F.lit("幼兒園"))), F.lit(" "), near))
    return F.array_compact(F.array(quoted(name), second))
