"""Register of institutions: lists, links by name, ordinals, upserts, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def institution_list(
    rows: DataFrame, equal: dict[str, str | None] | None = None, between: tuple[str, float, float] | None = None, search: str = "", inside: tuple[str, ...] = (), fold: bool = False,
    sort: str = "score", descending: bool = True, limit: int = 0, tie: str = "inst_id",
) -> DataFrame:
    """Rows by filters, sorted and cut, with ``total``, the number before the cut.

    ``equal`` maps columns to wanted values, of which empty ones count for
    nothing; ``search`` must occur in one of the columns ``inside`` (case
    ignored with ``fold``).  A missing sort value is the largest of numbers and
    the empty string of texts.  ``limit`` 0 or less cuts nothing.
    """
    kept = rows
    for column, value in (equal or {}).items():
        if value:
            kept = kept.where(F.col(column) == value)
    if between:
        kept = kept.where(F.col(between[0]).between(between[1], between[2]))
    if search.strip():
        word = search.strip().lower() if fold else search.strip()
        text = lambda c: F.lower(F.col(c).cast("string")) if fold else F.col(c).cast("string")
        found = F.lit(False)
        for c in inside:
            found = found | F.coalesce(text(c).contains(word), F.lit(False))
        kept = kept.where(found)
    of = F.coalesce(F.col(sort), F.lit("")) if dict(rows.dtypes)[sort] == "string" else F.col(sort)
    order = (of.desc_nulls_first() if descending else of.asc_nulls_last(), F.col(tie))
    total = kept.agg(F.count("*").alias("total"))
    page = kept.orderBy(*order).limit(limit) if limit > 0 else kept.orderBy(*order)
    return page.join(F.broadcast(total))


def relink(facts: DataFrame, master: DataFrame, name: str, key: str, new_id: Column, keep_unnamed: bool = False) -> DataFrame:
    """Facts with ``key`` found anew by name: the master's, else ``new_id`` of the name; unnamed rows go, or stay with an empty key."""
    index = master.groupBy(F.col(name).alias("_name")).agg(F.min(key).alias("_key"))
    named = F.coalesce(F.col(name), F.lit("")) != ""
    linked = facts.drop(key).join(index, F.col(name) == F.col("_name"), "left").withColumn(key, F.coalesce("_key", F.when(named, new_id), F.lit("")))
    return (linked if keep_unnamed else linked.where(F.col(key) != "")).drop("_name", "_key")


def unambiguous(master: DataFrame, canonical: Column, key: str) -> DataFrame:
    """``canonical`` and ``key`` for the canonical names that stand for one key only."""
    named = master.select(canonical.alias("canonical"), F.col(key)).where("canonical <> ''")
    return named.groupBy("canonical").agg(F.min(key).alias(key), F.max(key).alias("_last")).where(F.col(key) == F.col("_last")).drop("_last")


def remap(facts: DataFrame, mapping: DataFrame, key: str, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Facts under their new ids, and the number of those without one."""
    joined = facts.join(mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new")), F.col(key) == F.col("_old"), "left")
    return joined.where("_new is not null").withColumn(key, F.col("_new")).drop("_old", "_new"), joined.where("_new is null").agg(F.count("*").alias("dropped"))


def upsert(master: DataFrame, updates: DataFrame, key: str, replace: tuple[str, ...], fill: tuple[str, ...], source: tuple[str, str, str] = ("source", "both", "new")) -> DataFrame:
    """Master rows with the non-empty ``replace`` fields of their update and with ``fill`` fields where they have none, and the updates that no row has.

    ``source`` names a column and what it says of updated and of new rows.
    """
    column, both, new = source
    some = lambda c: F.when(c.cast("string") != "", c)
    u = updates.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in (*replace, *fill)))
    joined = master.join(u, F.col(key) == F.col("_key"), "full")
    told = {c: F.coalesce(some(F.col(f"_{c}")), F.col(c)) for c in replace} | {c: F.coalesce(some(F.col(c)), F.col(f"_{c}")) for c in fill}
    told[column] = F.when(F.col(key).isNull(), new).when(F.col("_key").isNotNull(), both).otherwise(F.col(column))
    return joined.withColumns(told).withColumn(key, F.coalesce(key, "_key")).select(*master.columns)


def with_ordinals(df: DataFrame, by: list[str], prefix: str, digits: int, name: str) -> DataFrame:
    """Ids of one prefix and a running number by the order of ``by``, which must be unique.

    Rows are numbered in ranges of the order, so that no task sees them all.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    laid = df.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id())
    sums = laid.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges
    bases = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    at = F.col("_base") + F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return laid.join(F.broadcast(bases), "_part").withColumn(name, F.concat(F.lit(prefix), F.lpad(at.cast("string"), digits, "0"))).drop("_part", "_base")


def frequent(df: DataFrame, label: str, least: int = 2) -> DataFrame:
    """Labels that occur at least ``least`` times, with their counts."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def completeness(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows, distinct keys and missing keys of each table; an absent table of the list has none."""
    made = [df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.count_if(F.col(key).isNull()).alias("missing")).select(F.lit(name).alias("name"), "rows", "keys", "missing") for name, df in tables.items()]
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    return out


def missing_tables(tables: dict[str, DataFrame], required: tuple[str, ...]) -> list[str]:
    """Required tables that are absent or empty."""
    return [name for name in required if name not in tables or tables[name].isEmpty()]


def newest(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key in the given order, with their place; cut before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= most)


def nearest(df: DataFrame, keys: list[str], value: Column, aim: Column, tie: str) -> DataFrame:
    """For each key the row whose value lies nearest to its aim, ties by ``tie``."""
    best = F.min_by(F.struct(*df.columns), F.struct(F.abs(value - aim), F.col(tie)))
    return df.where(value.isNotNull() & aim.isNotNull()).groupBy(*keys).agg(best.alias("_b")).select("_b.*")


def first_name_in(texts_: DataFrame, masters: DataFrame, text: str, name: str, key: str, order: str, gram: int = 4) -> DataFrame:
    """Texts with the ``key`` of the first name, by ``order``, that they contain; null without one.

    A text meets only names whose first ``gram`` characters it holds: an
    equi-join on character grams of both, no product of the tables.
    """
    tagged = texts_.withColumn("_row", F.xxhash64(F.col(text)))
    bodies = tagged.select("_row", F.col(text).alias("_text")).dropDuplicates(["_row"])
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_text") - gram + 1))
    grams = bodies.select("_row", "_text", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col("_text"), i, F.lit(gram))))).alias("_gram"))
    wanted = masters.where(F.length(name) >= gram).select(F.substring(name, 1, gram).alias("_gram"), F.col(name).alias("_name"), F.struct(F.col(order).alias("o"), F.col(key).alias("k")).alias("_key"))
    found = grams.join(wanted, "_gram").where(F.contains("_text", "_name")).groupBy("_row").agg(F.min("_key").alias("_first"))
    return tagged.join(found, "_row", "left").withColumn(key, F.col("_first.k")).drop("_row", "_first")


def known_or_all(masters: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Masters that occur in the facts; all of them where none does."""
    hits = masters.join(facts.select(key).distinct(), key, "left_semi")
    return masters if hits.isEmpty() else hits


def settings_of(given: dict, defaults: dict) -> dict:
    """The defaults with the given values of their own names; names that the defaults don't have are left out, inner dictionaries are merged likewise."""
    out = {}
    for name, value in defaults.items():
        mine = given.get(name, value)
        out[name] = {**value, **{k: v for k, v in mine.items() if k in value}} if isinstance(value, dict) and isinstance(mine, dict) else mine
    return out


def legacy_merge(master: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The master with those rows whose key it doesn't have; nothing is updated."""
    return master.unionByName(rows.join(master.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, n``: how often each value of each column occurs; a missing one is shown as an empty text."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns)))
    return df.select(pairs.alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def boards(df: DataFrame, key: str, most: dict[str, int]) -> DataFrame:
    """``board, place, key, score``: for each score column its ``most`` highest rows, ties by key; rows without the score take no part."""
    out = None
    for column, n in most.items():
        top = df.where(F.col(column).isNotNull()).select(F.lit(column).alias("board"), F.col(key), F.col(column).cast("double").alias("score")).orderBy(F.desc("score"), key).limit(n)
        out = top if out is None else out.union(top)
    place = F.row_number().over(Window.partitionBy("board").orderBy(F.desc("score"), key))  # of the rows shown
    return out.withColumn("place", place)
