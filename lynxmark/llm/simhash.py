"""SimHash fingerprints and near-duplicate classes by pigeonring filtering.

A fingerprint of 64 bits is a ring of four segments of 16 bits.  If two differ
in at most 3 bits, some segment starts a chain whose first l segments differ in
at most ``floor(3 * l / 4)`` bits for each l = 1..4: budgets 0, 1, 2 and 3.
The first two links of the chain are the join key: segment i as it is, and
segment i+1 with at most one bit changed (17 variants on one side, one on the
other), so that a key holds 32 bits and the number of candidates grows with
N**2 / 2**32 only.  The join's rows then pass the third link's budget and the
full Hamming check.  Equal fingerprints are one node from the start, and a key
that very many fingerprints hold is collapsed to its smallest before its
holders meet one another (``links``).

``keep_one_similar`` asks for more than 3 bits hold: pairs whose sets of
shingles have a Jaccard similarity of 0.8 or more lie up to about 20 bits apart.
Chains find all that are within 3 bits of one another; min-wise keys over the
same shingle hashes add candidates up to 24 bits, too far for chains.  The texts
of all candidates are compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected
from .runtime import free_name, slices, stage, tidy

BITS, SEGMENTS, WIDTH, RADIUS, SEED = 64, 4, 16, 3, 42
#: Budget of a chain of 1, 2, 3 and 4 segments.
BUDGET = [RADIUS * length // SEGMENTS for length in range(1, SEGMENTS + 1)]

#: Classes by similarity: words of a shingle, least Jaccard similarity, most bits between the fingerprints of a candidate.
WORDS, SIMILARITY, WIDE = 5, 0.8, 24
#: Min-wise keys of a text, and the minima that each holds: a pair shares none with probability (1 - 0.8**4)**16 at 0.8.
KEYS, MINIMA = 16, 4
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, KEYS * MINIMA, 1), dtype=np.uint64)
_MIX[1] |= np.uint64(1)


def fingerprint(text: bytes, words: int = 3) -> int:
    """Unsigned fingerprint of one text: bit set where over half of the shingles' hashes set it."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(joined, SEED)
    lens = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lens + 1) - 1
    first, last = (ends - lens)[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(first), 1 << 16):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed long.  A null text counts as empty: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [fingerprint(t.encode() if t else b"") for t in batch.column(1).to_pylist()]
            fps = np.array(made, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(0xFFFF)


def links(fps: DataFrame, check: Callable[[DataFrame], DataFrame] | None = None, more: DataFrame | None = None) -> DataFrame:
    """Pairs ``(u, v)`` of distinct fingerprints within ``RADIUS`` bits, enough of them to reach all that such pairs reach.

    ``fps`` has distinct longs in ``fp``.  Fingerprints that share a key may be
    many (texts that differ by a number).  They first meet the key's smallest
    only; those that are thereby in its class are not compared with one another
    again, the others meet every holder of the key.

    With a column ``node`` of distinct longs, ``u`` and ``v`` are nodes, whose
    fingerprints may be equal.  ``check`` keeps those pairs that are links;
    since it is asked before classes are made, none of the links that it would
    keep is lost.  ``more`` has further pairs to check.
    """
    named = "node" in fps.columns
    name, fu, fv = ("node", "fu", "fv") if named else ("fp", "u", "v")
    flips = F.array(F.lit(0), *(F.lit(1 << b) for b in range(WIDTH)))
    apart = F.col(fu).bitwiseXOR(F.col(fv))
    # The ring turned so that the chain starts at bit 0.
    ring = F.expr(f"shiftrightunsigned({fu} ^ {fv}, 16 * cast(shiftright(k, 32) as int)) | shiftleft({fu} ^ {fv}, (64 - 16 * cast(shiftright(k, 32) as int)) % 64)")
    chain3 = F.bit_count(ring.bitwiseAND(F.lit((1 << (3 * WIDTH)) - 1)))
    near = (F.col("u") != F.col("v")) & (chain3 <= BUDGET[2]) & (F.bit_count(apart) <= BUDGET[3])

    def keyed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Each node under its own keys (u), and under those with one bit of the second link changed (v); with its class, if known."""
        fp, also = F.col("fp"), [n for n in nodes.columns if n != "fp"]
        own = F.array(*(F.struct(F.lit(i).alias("i"), _segment(fp, i).alias("a"), _segment(fp, i + 1).alias("b")) for i in range(SEGMENTS)))
        rows = nodes.select(fp, *also, F.explode(own).alias("x")).select("fp", *also, "x.*")
        also = [n for n in also if n != "node"]
        packed = F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("a").cast("long"), 16))
        us, vs = ([F.col(name).alias(x), *([fp.alias(f)] if named else [])] for x, f in (("u", fu), ("v", fv)))
        left = rows.select(*us, *(F.col(n).alias(f"{n}_u") for n in also), packed.bitwiseOR(F.col("b")).alias("k"))
        right = rows.withColumn("flip", F.explode(flips)).select(*vs, *(F.col(n).alias(f"{n}_v") for n in also), packed.bitwiseOR(F.col("b").bitwiseXOR(F.col("flip"))).alias("k"))
        return left, right

    # Merge joins: the sizes before the explosion would have either side broadcast.
    left, right = keyed(fps)
    hubs = left.groupBy("k").agg(F.min(F.struct("u", "fu")).alias("x")).select("k", "x.*") if named else left.groupBy("k").agg(F.min("u").alias("u"))
    first = stage(right.join(hubs.hint("merge"), "k").where(near).select("u", "v").distinct(), "simhash-hubs")
    if more is not None:
        pairs = first.union(more).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        first = stage(pairs, "simhash-pairs")
    if check:
        first = stage(check(first), "simhash-checked")
    classes = connected(first).withColumnRenamed("node", "_node")
    known = stage(fps.join(classes, fps[name] == classes["_node"], "left").select(*fps.columns, F.coalesce("root", name).alias("class")), "simhash-known")
    left, right = keyed(known)
    main = left.groupBy("k").agg(F.min(F.struct("u", "class_u")).alias("x")).select("k", F.col("x.class_u").alias("main"))
    left, right = left.join(main.hint("merge"), "k"), right.join(main.hint("merge"), "k")
    strange = right.where("class_v <> main").drop("main").hint("merge")
    one = left.drop("main").join(strange, "k")
    two = left.where("class_u <> main").drop("main").hint("merge").join(right.where("class_v = main").drop("main"), "k")
    rest = one.unionByName(two).where((F.col("class_u") != F.col("class_v")) & near).select("u", "v")
    if check:
        rest = stage(rest.distinct(), "simhash-rest")
        return first if rest.isEmpty() else first.union(check(rest))
    return first.union(rest)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links.

    Links join fingerprints that differ in 3 bits or fewer.  Null and empty
    texts have fingerprint zero and are linked like any other; an empty table
    gives an empty result; repeated rows appear as often as they came in.
    """
    rows = stage(fingerprints(docs, key, text), "simhash")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    classes = connected(links(nodes.select("fp")))
    joined = nodes.join(classes, nodes.fp == classes.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = joined.join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(F.col("doc_id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose id is the smallest of their near-duplicate class; all columns as they came.

    A document without an id can't be told apart from its class by it and stays.
    """
    kept = near_duplicates(docs, key).where(F.col(key).isNull() | (F.col(key) == F.col("component_id"))).select(key).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept[key]), "left_semi")


def shingles(text: bytes, words: int = WORDS) -> set[bytes]:
    """The distinct runs of ``words`` words; of a shorter text its words, of an empty one none."""
    tokens = text.lower().split()
    if len(tokens) < words:
        return {b" ".join(tokens)} if tokens else set()
    return {b" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)}


def sketch(text: bytes, words: int = WORDS) -> tuple[int, int, list[int]]:
    """Digest of the words, fingerprint of the set of shingles and its min-wise keys, all signed; a text shorter than a shingle has no keys."""
    joined = b" ".join(text.lower().split())
    made = shingles(text, words)
    node = xxhash.xxh64_intdigest(joined, SEED + 1)
    if joined.count(b" ") + 1 < words:
        return _signed(node), _signed(xxhash.xxh64_intdigest(joined, SEED)), []
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, SEED) for x in made), dtype=np.uint64, count=len(made))
    ones = np.zeros(BITS, dtype=np.int64)
    least = np.full(KEYS * MINIMA, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        least = np.minimum(least, ((part ^ _MIX[0]) * _MIX[1]).min(1))
    fp = int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])
    keys = [_signed(digest(row.tobytes(), k)) for k, row in enumerate(least.reshape(KEYS, MINIMA))]
    return _signed(node), _signed(fp), keys


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``(doc_id, row, node, fp, keys)``; ``row`` is a hash of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [sketch(t.encode() if t else b"", words) for t in batch.column(2).to_pylist()]
            nodes, fps, keys = ([m[i] for m in made] for i in range(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row", "node", "fp", "keys"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("row"), F.col(text).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, row long, node long, fp long, keys array<long>")


def candidates(nodes: DataFrame, radius: int = WIDE) -> DataFrame:
    """Pairs ``(u, v)`` of nodes that share a key and lie within ``radius`` bits; ``nodes`` has node, fp and keys.

    All that hold a key meet its smallest and its largest holder only, so that
    the number of pairs is linear in the nodes however many hold one key.
    """
    held = stage(nodes.select("node", "fp", F.explode("keys").alias("key")), "similar-keys")
    one = F.struct("node", "fp")
    ends = stage(held.groupBy("key").agg(F.min(one).alias("low"), F.max(one).alias("high")).where("low.node <> high.node"), "similar-ends")
    met = held.join(ends, "key")
    low = met.where("node <> low.node").select(F.col("low.node").alias("u"), F.col("node").alias("v"), F.col("low.fp").alias("a"), F.col("fp").alias("b"))
    high = met.where("node <> low.node and node <> high.node").select(F.col("high.node").alias("u"), F.col("node").alias("v"), F.col("high.fp").alias("a"), F.col("fp").alias("b"))
    return low.union(high).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("u", "v").distinct()


def similar(pairs: DataFrame, texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Those of the pairs ``(u, v)`` whose shingle sets have the Jaccard similarity; ``texts`` has node and text, each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "t"):
                ok = []
                for s, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    x, y = shingles(s.encode(), words), shingles(t.encode(), words)
                    both = len(x & y)
                    ok.append(both >= similarity * (len(x) + len(y) - both))
                yield part.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    one = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("s")).hint("merge"), "u")
    two = one.join(texts.select(F.col("node").alias("v"), F.col("text").alias("t")).hint("merge"), "v")
    return two.select("u", "v", "s", "t").mapInArrow(tidy(run), "u long, v long")


def keep_one_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, radius: int = WIDE) -> DataFrame:
    """The document with the smallest id of each class; all columns as they came.

    Texts of the same words are one class, and classes are linked by pairs whose
    sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more.
    Chains of the fingerprints find all such pairs within ``RADIUS`` bits, and
    ``candidates`` adds what lies further apart; every pair is checked exactly.
    """
    rows = stage(sketches(docs, key, text, words), "similar")
    nodes = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    # One row of each node stands for its text.
    first = rows.groupBy("node").agg(F.min("row").alias("row"))

    def checked(pairs: DataFrame) -> DataFrame:
        wanted = first.join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi")
        found = docs.select(F.xxhash64(key, text).alias("row"), F.col(text).alias("text")).join(wanted, "row").select("node", "text")
        return similar(pairs, stage(found.dropDuplicates(["node"]), "similar-texts"), words, similarity)

    # Texts shorter than a shingle have no keys: different ones share nothing.
    chained = stage(nodes.where(F.size("keys") > 0).select("node", "fp"), "similar-nodes")
    classes = connected(links(chained, checked, candidates(nodes, radius)))
    rooted = rows.select("doc_id", "row", "node").join(classes.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    return _least(docs, rooted.select("doc_id", "row", F.coalesce("root", "node").alias("root")), key, text)


def _least(docs: DataFrame, rooted: DataFrame, key: str, text: str) -> DataFrame:
    """One row of ``docs`` for each class: of its smallest id; without an id only where none of the class has one."""
    rows = rooted.groupBy("root", "doc_id", "row").agg(F.count("*").alias("n"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row", "n")).alias("one"))
    kept = stage(least.select("one.row", "one.n"), "similar-kept")
    tag, held = (free_name(docs, n) for n in ("_row", "_held"))
    tagged = docs.withColumn(tag, F.xxhash64(key, text))
    single = lambda rows: tagged.join(rows.select(F.col("row").alias(held)), F.col(tag) == F.col(held), "left_semi")
    if kept.where("n > 1").isEmpty():
        return single(kept).select(*docs.columns)
    # Rows that repeat both id and text: one of them.
    repeated = single(kept.where("n > 1")).dropDuplicates([tag])
    return single(kept.where("n = 1")).union(repeated).select(*docs.columns)
