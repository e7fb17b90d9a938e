"""Column expressions over HTML and RSS: lines, forms, tables, feed items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities that occur in the pages, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def page_lines(html: Column) -> Column:
    """Non-empty text lines of a page, every tag a line break; null for null."""
    body = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    lines = F.split(unescaped(F.regexp_replace(body, "<[^>]+>", "\n")), "\n")
    return F.filter(F.transform(lines, _flat), lambda x: x != "")


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf'(?is)\s{name}="([^"]*)"', 1)


def hidden_fields(html: Column) -> Column:
    """Map of the named hidden inputs of a form to their values, whatever the order of the attributes; the first of a name counts."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<input\b[^>]*>)"), 1), lambda x: (F.lower(_attribute(x, "type")) == "hidden") & (_attribute(x, "name") != ""))
    pairs = F.transform(tags, lambda x: F.struct(_attribute(x, "name").alias("key"), unescaped(_attribute(x, "value")).alias("value")))
    names = F.transform(pairs, lambda p: p["key"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(names, p["key"]) == i + 1))


def has_postback(html: Column, target: str) -> Column:
    """Whether a page can post back to ``target`` (there is a next page)."""
    return F.contains(html, F.lit(f"__doPostBack('{target}'")) | F.contains(html, F.lit(f"__doPostBack(&#39;{target}&#39;"))


def select_options(html: Column, name: str) -> Column:
    """``(value, label)`` of the options of the first selection list of that name; an empty array without one."""
    body = F.regexp_extract(html, rf'(?is)<select\b[^>]*\sname="\Q{name}\E"[^>]*>(.*?)</select>', 1)
    options = F.regexp_extract_all(body, F.lit(r"(?is)(<option\b[^>]*>.*?</option>)"), 1)
    return F.transform(options, lambda o: F.struct(_attribute(o, "value").alias("value"), _flat(unescaped(F.regexp_replace(o, "<[^>]+>", ""))).alias("label")))


def table_rows(html: Column) -> Column:
    """Cells of each table row of a page, as an array of arrays of texts; rows without cells are left out."""
    cells = lambda row: F.transform(
        F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1), lambda c: _flat(unescaped(F.regexp_replace(c, "<[^>]+>", " ")))
    )
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1), cells), lambda r: F.size(r) > 0)


def table_records(html: Column) -> Column:
    """Rows below the first as maps from the first row's cells; a repeated header keeps its first column, cells beyond the header go."""
    rows = table_rows(html)
    head = F.try_element_at(rows, F.lit(1))
    keep = F.filter(F.sequence(F.lit(1), F.size(head)), lambda i: F.array_position(head, F.element_at(head, i)) == i)
    record = lambda row: F.map_from_entries(F.transform(keep, lambda i: F.struct(F.element_at(head, i).alias("key"), F.try_element_at(row, i).alias("value"))))
    return F.when(F.size(rows) > 1, F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1))), record)).otherwise(F.array().cast("array<map<string,string>>"))


def tag_text(block: Column, name: str) -> Column:
    """Text of the first element of that name, CDATA unwrapped; empty without one."""
    inner = F.trim(F.regexp_extract(block, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1))
    data = F.regexp_extract(inner, r"(?s)^<!\[CDATA\[(.*?)\]\]>", 1)
    return F.trim(unescaped(F.when(F.startswith(inner, F.lit("<![CDATA[")), data).otherwise(inner)))


def feed_date(text: Column) -> Column:
    """UTC date of an RFC 822 time; the date alone where the time or zone cannot be read; null without one."""
    plain = F.regexp_replace(F.trim(text), r"^\w{3},\s*", "")
    zoned = F.regexp_replace(plain, r"\s(GMT|UTC|Z)$", " +0000")
    day = F.regexp_extract(text, r"(\d{1,2}\s+\w{3}\s+\d{4})", 1)
    return F.coalesce(
        F.to_date(F.to_utc_timestamp(F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")), F.current_timezone())), F.to_date(F.try_to_timestamp(F.regexp_replace(day, r"\s+", " "), F.lit("d MMM yyyy")))
    )


def feed_items(feed: Column, limit: int = 60) -> Column:
    """The first ``limit`` items of an RSS feed: title, link, source, published."""
    item = lambda x: F.struct(*(tag_text(x, n).alias(n) for n in ("title", "link", "source")), feed_date(tag_text(x, "pubDate")).alias("published"))
    return F.transform(F.slice(F.regexp_extract_all(feed, F.lit(r"(?s)<item>(.*?)</item>"), 1), 1, limit), item)


def forum_rows(html: Column, this_year: int, base: str = "") -> Column:
    """Rows of a forum's result page: title, link, engagement, day.  Deleted and untitled ones are left out.

    A page gives month and day only; the year is that of the time in the link,
    else ``this_year``.  "爆" stands for 100 answers; other marks for none.
    """
    text = lambda x: _flat(unescaped(F.regexp_replace(x, "<[^>]+>", "")))

    def row(block: Column) -> Column:
        title = F.regexp_extract(block, r'(?s)<div class="title">(.*?)</div>', 1)
        link = F.regexp_extract(title, r'<a href="([^"]+)"', 1)
        marks = text(F.regexp_extract(block, r'(?s)<div class="nrec">(.*?)</div>', 1))
        day = text(F.regexp_extract(block, r'(?s)<div class="date">(.*?)</div>', 1))
        sent = F.regexp_extract(link, r"/M\.(\d{9,11})\.", 1)
        year = F.coalesce(F.year(F.timestamp_seconds(sent.try_cast("long"))), F.lit(this_year))
        month, date = F.regexp_extract(day, r"^(\d{1,2})/(\d{1,2})", 1), F.regexp_extract(day, r"^(\d{1,2})/(\d{1,2})", 2)
        made = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(date, 2, "0")).try_cast("date")
        engagement = F.when(marks == "爆", 100).otherwise(F.when(marks.rlike(r"^[0-9]+$"), marks).try_cast("int"))
        return F.struct(text(title).alias("title"), F.when(link != "", F.concat(F.lit(base), link)).otherwise("").alias("link"), engagement.alias("engagement"), made.alias("day"))

    blocks = F.split(html, '<div class="r-ent">')
    rows = F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(1))), row)
    return F.filter(rows, lambda r: (r["title"] != "") & ~r["title"].contains("本文已被刪除"))
