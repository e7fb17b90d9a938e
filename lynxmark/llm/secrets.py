"""Secret scans over an incremental blob ledger.

Every text is content-addressed (SHA-256).  The ledger remembers which blobs
were scanned under which rule versions, and what was found; a scan reads only
unseen pairs of blob and rule version and joins all findings back to every path
(document) that holds the blob.  All of it is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import free_name, heavy, once_if_heavy, parts_for, shared_path, stage, utf8_size


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    guard: str  # a pattern or text without which nothing matches; cheap to look for
    least: int  # code points of the match, or of group 2 where the rule has one
    group: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Base rules first, in the order of their kinds, then those that this operator adds.
RULES = (
    Rule("assign", 1, rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "", 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", "AKIA", 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", "", 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN ", 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ", 1),
)
BASE = ("assign", "access", "hex")
#: A private key from its BEGIN to the next END line; without an END before the next BEGIN, header lines and what follows in base64.
_KEY_BLOCK = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:(?:\s|\\[nr])*+[A-Za-z][A-Za-z-]*+: [^\n]*+)*+(?:(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)++(?:(?:\s|\\[nr])++[A-Za-z0-9+/=]++)?+)?+)"
)
#: What is redacted: as RULES, whose ``pem`` marks the first line only (so does op10's SQL), but with the key's whole block.
REDACTED = tuple(Rule("pem", 2, _KEY_BLOCK, "-----BEGIN ", 1) if r.kind == "pem" else r for r in RULES)
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: As the ledger holds them: with the rule and its version instead of a rank, which is the asking scan's.
KEPT = "array<struct<start:int,end:int,rule:string>>"
#: Values of one step of a running sum, code points of one piece of a text.
STEP, PIECE = 64, 4096


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _fold(xs: Column, join) -> Column:
    return F.aggregate(xs, F.lit(0), join)


def _running(xs: Column, join) -> Column:
    """For each place of ``xs``, and the place behind the last, the join (sum or maximum) of all values before it.

    Steps of 64 values, of 64 steps and of all of those bound the work at each
    place, so that it grows with the number of values only.
    """

    def steps(ys: Column) -> Column:
        n = F.ceil(F.size(ys) / STEP).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: _fold(F.slice(ys, k * STEP + 1, F.lit(STEP)), join))

    def at(s: Column, i: Column) -> Column:
        near = _fold(F.slice(s["xs"], i - i % STEP + 1, i % STEP), join)
        k = F.floor(i / STEP).cast("int")
        wide = F.floor(i / (STEP * STEP)).cast("int")
        return join(join(near, _fold(F.slice(s["one"], k - k % STEP + 1, k % STEP), join)), _fold(F.slice(s["two"], F.lit(1), wide), join))

    levels = _let(xs, lambda v: _let(steps(v), lambda one: F.struct(v.alias("xs"), one.alias("one"), steps(one).alias("two"))))
    return _let(levels, lambda s: F.transform(F.sequence(F.lit(0), F.size(s["xs"])), lambda i: at(s, i)))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _greater(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _found(text: Column, rule: Rule, wanted: Column) -> Column:
    """Spans of one rule in ``text``: leftmost, non-overlapping, those too short dropped.

    The pieces between matches and the matches themselves, in turn, give each
    match's place in code points.
    """
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = lambda xs: F.transform(xs, lambda x: F.length(x))
    gaps = sizes(F.split(text, rule.pattern, -1))
    own = sizes(F.regexp_extract_all(text, pattern, F.lit(rule.group))) if rule.group else F.lit(None).cast("array<int>")

    def spans(s: Column) -> Column:
        # Before match i lie its gap and, for each earlier match, that one's gap and length.
        before = _running(F.zip_with(s["gaps"], s["lens"], lambda g, n: g + F.coalesce(n, F.lit(0))), _plus)
        long = s["own"] if rule.group else s["lens"]
        each = lambda b: F.transform(
            s["lens"],
            lambda n, i: F.when(
                long[i] >= rule.least, F.struct((b[i] + s["gaps"][i]).alias("start"), (b[i] + s["gaps"][i] + n).alias("end"), F.lit(rule.name).alias("rule"))
            ),
        )
        return F.filter(_let(before, each), lambda x: x.isNotNull())

    places = _let(F.struct(gaps.alias("gaps"), sizes(hits).alias("lens"), own.alias("own")), spans)
    there = text.contains(rule.guard) if rule.guard else text.rlike(rule.pattern)
    return F.when(wanted & there, places).otherwise(F.array().cast(KEPT))


def scan_text(text: Column, pending: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of the ``pending`` rules (array of rule names), as the ledger keeps them."""
    return F.concat(*(_found(text, r, F.array_contains(pending, r.name)) for r in rules))


def _row(key: Column, text: Column) -> Column:
    """Names a row by id and text; never null, so that a join on it needs no null-safe form."""
    return F.xxhash64(key, text)


def scan_secrets(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, blob, spans`` for every document; the ledger at path ``ledger`` grows by what was scanned.

    ``spans`` has start, rank, end (code points, end exclusive) and kind, sorted
    by start and then by the rule's place in ``rules``.  Only pairs of a blob
    and a rule version that the ledger does not hold are scanned, and only
    findings of the versions in ``rules`` are returned: what an older version of
    a rule found stays in the ledger, but does not count.  Null text counts as
    empty.  Equal texts are one blob, scanned once, and all their documents get
    its findings.  An empty table scans nothing.
    """
    spark = docs.sparkSession
    body = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blob = F.unhex(F.sha2(F.col("text"), 256))
    row = _row(F.col("doc_id"), F.col("text"))
    paths = stage(body.select("doc_id", blob.alias("blob"), row.alias("row"), utf8_size().alias("size")), "secret-paths")
    # One row of a blob stands for it.  Many rows that repeat both id and text share a name; they are made one before they move.
    reps = paths.groupBy("blob").agg(F.min("row").alias("rep"))
    names = F.array(*(F.lit(r.name) for r in rules))
    seen = read_ledger(spark, ledger)
    if seen is not None:
        known = seen.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("known"))
        reps = reps.join(known, "blob", "left").withColumn("pending", F.array_except(names, F.coalesce("known", F.array().cast("array<string>"))))
    else:
        reps = reps.withColumn("pending", names)
    reps = reps.where(F.size("pending") > 0).select("rep", F.col("blob").alias("wanted"), "pending")
    parts = parts_for(spark, paths.agg(F.sum("size")).first()[0])
    texts = once_if_heavy(body.select(row.alias("row"), "text"), "row", heavy(paths, "row")).repartition(parts, "row").join(reps.repartition(parts, "rep").hint("shuffle_hash"), F.col("row") == F.col("rep"))
    texts = texts.where(blob == F.col("wanted"))
    fresh = texts.select(F.col("wanted").alias("blob"), F.col("pending").alias("rules"), scan_text(F.col("text"), F.col("pending"), rules).alias("spans"))
    fresh = fresh.dropDuplicates(["blob"])  # a row that occurs twice is its own representative twice
    fresh.write.mode("append").parquet(ledger)
    named = lambda s, out, value: F.when(s["rule"] == out.name, F.lit(value))
    rank = lambda s: F.coalesce(*(named(s, r, k) for k, r in enumerate(rules)))
    kind = lambda s: F.coalesce(*(named(s, r, r.kind) for r in rules))
    current = F.filter("spans", lambda s: s["rule"].isin([r.name for r in rules]))
    ranked = F.transform(current, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), kind(s).alias("kind")))
    rows = read_ledger(spark, ledger).select("blob", ranked.alias("spans")).where(F.size("spans") > 0)
    # Two scans at one time may both have written a finding; comparing neighbours stays linear, array_distinct does not.
    once = lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x != xs[F.greatest(i - 1, F.lit(0))]))
    found = rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).select("blob", _let(F.col("spans"), once).alias("spans"))
    return paths.join(found, "blob", "left").select(F.col("doc_id").alias(key), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's table ``(blob, rules, spans)``, one row for each scan of a blob; None where nothing was written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"blob binary, rules array<string>, spans {KEPT}").parquet(ledger)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_path(spark, "secret-ledger"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _cut(pieces: Column, start: Column, size: Column) -> Column:
    """``size`` code points from ``start`` (from 0) of the text that ``pieces`` make up."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((start + size - 1) / PIECE).cast("int")
    return F.when(size > 0, F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start % PIECE + 1, size)).otherwise("")


def redacted(body: Column, spans: Column, mark: str) -> Column:
    """``body`` with its ``spans``, sorted by start, replaced by ``mark``; spans that overlap one before go with it."""
    pieces = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    parts = F.struct(pieces.alias("pieces"), spans.alias("spans"), _running(F.transform(spans, lambda s: s["end"]), _greater).alias("done"))

    def joined(x: Column) -> Column:
        done = x["done"]
        each = F.transform(x["spans"], lambda s, i: F.when(s["start"] >= done[i], F.concat(_cut(x["pieces"], done[i], s["start"] - done[i]), F.lit(mark))).otherwise(""))
        tail = _cut(x["pieces"], done[F.size(x["spans"])], F.length(body) - done[F.size(x["spans"])])
        return F.concat(F.array_join(each, ""), tail)

    return _let(parts, joined)


def redact(docs: DataFrame, ledger: str, mark: str = "[REDACTED]", key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = REDACTED) -> DataFrame:
    """The documents with every secret's span replaced by ``mark``; columns as they came, ``n_chars`` renewed where there is one."""
    of, named, spans = (free_name(docs, n) for n in ("_of", "_blob", "_spans"))
    found = scan_secrets(docs, ledger, rules, key, text).where(F.size("spans") > 0).select(F.col("blob").alias(named), F.col("spans").alias(spans)).dropDuplicates([named])
    joined = docs.withColumn(of, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))).join(found, F.col(of) == F.col(named), "left")
    body = F.col(text)
    out = joined.withColumn(text, F.when(F.col(spans).isNotNull(), redacted(body, F.col(spans), mark)).otherwise(body))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def oracle() -> str:
    """DuckDB SQL for op10's rows, from the same rules."""
    parts, names = [], []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"(SELECT doc_id, list_transform(regexp_extract_all(text, '{p}', 0), lambda x: length(x)) AS lens, list_transform(regexp_extract_all(text, '{p}', {r.group}), lambda x: length(x)) AS own, "
            f"list_transform(string_split_regex(text, '{p}'), lambda x: length(x)) AS gaps FROM d WHERE regexp_matches(text, '{p}'))"
        )
        names.append(
            f"SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i-1]), 0) AS s, list_sum(gaps[1:i]) + list_sum(lens[1:i]) AS e "
            f"FROM (SELECT *, unnest(range(1, len(lens) + 1)) AS i FROM {parts[-1]}) WHERE own[i] >= {r.least}"
        )
    base = ", ".join(f"'{b}'" for b in BASE)
    one = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(names)}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{b}') AS n_{b}" for b in BASE)},
    string_agg({one}, ',' ORDER BY s, rank) FILTER (kind IN ({base})) AS base, string_agg({one}, ',' ORDER BY s, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{b}, 0) AS n_{b}" for b in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
