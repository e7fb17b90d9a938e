"""Sharding by minimax contiguous partition.

Atomic groups (equal texts) are ordered by the 64-bit hash of their text.  The
smallest shard capacity for which a greedy walk over the ordered group sizes
needs no more than the wanted number of shards is found by binary search, and
the walk with that capacity gives the cuts.

The driver never holds the groups: it holds segments of the hash range, each
with its bytes and group count.  A segment is either one group or splittable.
Treating splittable segments as atoms bounds the capacity from above, treating
them as divisible bounds it from below; only segments that a cut may fall into
are refined, by ``FAN`` each, until both bounds and all cuts agree.  Held at
once: ``FIRST`` segments plus about ``shards**2 * FAN``.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .runtime import stage, utf8_size

#: Segments of the first look at the hash range, and parts of a segment when it is refined.
FIRST_BITS, FAN_BITS = 13, 6
#: Rows that share a (segment, salt) cell when slots are numbered, as a part of all rows.
CELLS = 4096


@dataclass(frozen=True)
class Segment:
    low: int  # first hash of the range, unsigned
    bits: int  # bits of hash that are left below the range's prefix
    size: int
    groups: int
    largest: int

    @property
    def whole(self) -> bool:
        return self.groups == 1 or self.bits == 0


def _prefix(bits: int) -> Column:
    """The hash's range of ``2**bits`` values, as an unsigned shift of the signed long."""
    return F.shiftrightunsigned("h", bits) if bits else F.col("h")


def _segments(groups: DataFrame, bits: int) -> list[Segment]:
    found = groups.groupBy(_prefix(bits).alias("p")).agg(F.sum("bytes"), F.count("*"), F.max("bytes")).collect()
    return sorted((Segment((p % (1 << 64)) << bits, bits, s, n, m) for p, s, n, m in found), key=lambda x: x.low)


def _walk(ends: list[int], starts: list[int], splittable: list[bool], capacity: int, shards: int, divide: bool) -> list[int] | None:
    """Bytes before each cut of the greedy walk; None if ``shards`` are too few."""
    total, at, cuts = ends[-1], 0, []
    while total - at > capacity:
        limit = at + capacity
        k = bisect_right(ends, limit)
        to = ends[k - 1] if k else 0
        if divide and splittable[k]:
            to = limit
        if to <= at or len(cuts) == shards - 1:
            return None
        at = to
        cuts.append(at)
    return cuts


def _least(ends, starts, splittable, low: int, shards: int, divide: bool) -> int:
    high = ends[-1]
    while low < high:
        mid = (low + high) // 2
        if _walk(ends, starts, splittable, mid, shards, divide) is None:
            low = mid + 1
        else:
            high = mid
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int], list[Segment]]:
    """Smallest capacity, the first hash of shards 1.. (unsigned), and the segments looked at.

    ``groups`` has one row per atomic group: ``h`` long (signed, ordered as unsigned) and ``bytes`` long.
    """
    bits = 64 - FIRST_BITS
    segments = _segments(groups, bits)
    if not segments:
        return 0, [], []
    while True:
        ends = np.cumsum([s.size for s in segments]).tolist()
        starts = [e - s.size for e, s in zip(ends, segments)]
        loose = [not s.whole for s in segments]
        floor = max(s.largest for s in segments)
        low = _least(ends, starts, loose, max(floor, -(-ends[-1] // shards)), shards, True)
        high = _least(ends, starts, loose, max(s.size for s in segments), shards, False)
        early = _walk(ends, starts, loose, low, shards * 2, False) or []
        late = _walk(ends, starts, loose, high, shards, True) or []
        # Segments above the lower bound go first: there are at most as many as shards.
        unsure: set[int] = {i for i, s in enumerate(segments) if loose[i] and s.size > low}
        for k in [] if unsure else range(max(len(late), min(len(early), shards - 1))):
            a = early[k] if k < len(early) else ends[-1]
            b = late[k] if k < len(late) else ends[-1]
            a, b = min(a, b), max(a, b)
            first = max(0, bisect_right(ends, a) - 1)
            unsure.update(i for i in range(first, min(len(segments), bisect_right(ends, b) + 1)) if loose[i] and starts[i] <= b and ends[i] >= a)
        if not unsure:
            cuts = _walk(ends, starts, loose, high, shards, False)
            where = {s: seg.low for s, seg in zip(starts, segments)}
            return high, [where[c] for c in cuts], segments
        by_bits: dict[int, list[int]] = {}
        for i in unsure:
            by_bits.setdefault(segments[i].bits, []).append(segments[i].low >> segments[i].bits)
        finer: list[Segment] = []
        for b, prefixes in by_bits.items():
            signed = [p - (1 << 64) if b == 0 and p >> 63 else p for p in prefixes]
            finer += _segments(groups.where(_prefix(b).isin(signed)), max(0, b - FAN_BITS))
        segments = sorted([s for i, s in enumerate(segments) if i not in unsure] + finer, key=lambda x: x.low)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put documents into ``shards`` shards of near equal bytes; equal texts stay together.

    Returns ``key``, ``size`` (UTF-8 bytes plus 1; null text: 1), ``text_crc32``
    (null text: that of the empty text), ``law`` 'bytes', ``shard`` from 0,
    ``slot`` gapless from 0 in each shard, ``grown_shard`` null, and
    ``capacity``, the smallest feasible shard size.  An empty table gives an
    empty result; fewer groups than shards leave the last shards empty; null
    texts form one group of their own beside the empty texts.
    """
    spark = docs.sparkSession
    body = F.col(text).cast("binary")
    rows = stage(
        docs.select(
            F.col(key).alias("doc_id"),
            (utf8_size(text) + 1).alias("size"),
            F.crc32(F.coalesce(body, F.lit(b""))).cast("long").alias("text_crc32"),
            F.xxhash64(F.col(text)).alias("h"),
        ),
        "shard-rows",
    )
    groups = stage(rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    capacity, cuts, _ = minimax_cuts(groups, shards)
    order = F.col("h").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))  # unsigned order as signed order
    shard = sum((F.when(order >= F.lit(_signed(c ^ (1 << 63))), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = rows.withColumn("shard", shard).withColumn("part", F.shiftrightunsigned("h", 64 - 12).cast("int"))
    # Slots: cells of about total/CELLS rows; a heavy part (a hot text) is salted over several.
    per = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    total = max(1, rows.count())
    target = max(1, -(-total // CELLS))
    salts = {(r.shard, r.part): -(-r.n // target) for r in per.where(F.col("n") > 2 * target).collect()}  # CELLS / 2 rows at most
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("salts", T.LongType())])
    spread = spark.createDataFrame([(s, p, n) for (s, p), n in salts.items()], schema)
    celled = placed.join(F.broadcast(spread), ["shard", "part"], "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("salts")), F.lit(0).cast("long"))
    )
    cells = celled.groupBy("shard", "part", "salt").agg(F.count("*").alias("n"))
    # At most 2**12 parts, shards cuts and 2 * CELLS salts: a table of bounded size.
    before = Window.partitionBy("shard").orderBy("part", "salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("shard", "part", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "part", "salt").orderBy("doc_id", "h")
    numbered = celled.select("doc_id", "size", "text_crc32", "shard", "part", "salt", F.row_number().over(inside).alias("rn"))
    return numbered.join(F.broadcast(bases), ["shard", "part", "salt"]).select(
        F.col("doc_id").alias(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("rn") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.lit(capacity).cast("long").alias("capacity"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
