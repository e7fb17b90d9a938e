"""Exact top-k inner products with a KD-tree for each shard.

Vectors are quantized, floor(64 * x).  A bounded sample gives the median splits
of a coarse tree, whose cells deal the vectors into shards, so that a shard is a
region and not a mixture; a full cell is dealt into several shards by hash.
Each shard's tree, with median splits of the widest side and tight boxes, is
built once and kept as a row of a staged table.

Queries are packed into blocks of one cell.  A block first meets a home shard of
its own cell, which gives each query a k-th score.  With that score a query goes
on only to cells whose box still allows a better product, and in each shard a
heap of nodes, best bound first, is walked until no box can win; the k-th score
rises as leaves are read.  Trees do not move with the queries: a task reads a
tree and then, one after another, all blocks that come to it.

Nothing that grows with the vectors is broadcast or collected but the numbers of
the shards; blocks are never the small side of a join, whatever the planner
takes their size for (small integers shrink in Parquet files to a tenth, and
each block is repeated for each shard).  Vectors and queries travel as the
smallest integers that hold them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import MOST_PARTS, parallelism, stage

SCALE, K, EVERY = 64, 20, 20
#: Vectors of a shard (least and most), queries of a block, vectors of a leaf; most vectors of a shard outside the coarse trees.
SHARD, BLOCK, LEAF, APART = (2048, 131072), 512, 256, 32768
#: Bytes of blocks that come to one shard's copy, and to one partition.
GROUP_BYTES = 32 << 20
#: Levels of the coarse tree, the vectors that it is learnt from, and the vector lengths that have one (the most frequent).
DEPTH, SAMPLE, LENGTHS = 8, 8192, 8
#: Components up to this size multiply exactly in float64 (2048 components); others are multiplied as Python integers.
EXACT = 1 << 21
#: A score beyond this saturates.
MOST = (1 << 63) - 1


def coarse_splits(vectors: np.ndarray, depth: int) -> tuple[list[int], list[float]]:
    """Axis and value of each inner node, numbered from 1 with children 2n and 2n + 1, by medians of the widest side."""
    axes, values = [0] * (1 << depth), [math.inf] * (1 << depth)
    parts = {1: vectors}
    for node in range(1, 1 << depth):
        part = parts.pop(node)
        if len(part):
            side = part.max(0) - part.min(0)
            axes[node] = int(np.argmax(side))
            column = part[:, axes[node]]
            values[node] = float(np.median(column)) if side[axes[node]] > 0 else math.inf
            right = column >= values[node]
            parts[2 * node], parts[2 * node + 1] = part[~right], part[right]
        else:
            parts[2 * node] = parts[2 * node + 1] = part
    return axes, values


def cell_of(q: Column, axes: list[int], values: list[float], depth: int) -> Column:
    """The cell of a vector: its leaf in the coarse tree, from 0."""
    axis, value = F.array(*map(F.lit, axes)), F.array(*map(F.lit, values))
    step = lambda node, _: node * 2 + (q[axis[node]] >= value[node]).cast("int")
    return F.aggregate(F.array_repeat(F.lit(0), depth), F.lit(1), step) - (1 << depth)


class Tree:
    """Median splits with tight boxes; rows are put in the order of the leaves."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        order: list[np.ndarray] = []
        self.low, self.high, self.kids, self.span = [], [], [], []
        todo, done = [(np.arange(len(vectors)), -1, 0)], 0
        while todo:
            rows, parent, side = todo.pop()
            me, part = len(self.low), vectors[rows]
            low, high = part.min(0).astype(float), part.max(0).astype(float)
            self.low.append(low)
            self.high.append(high)
            self.kids.append([-1, -1])
            self.span.append([0, 0])
            if parent >= 0:
                self.kids[parent][side] = me
            widest = int(np.argmax(high - low))
            if len(rows) <= leaf or high[widest] == low[widest]:
                self.span[me] = [done, done + len(rows)]
                order.append(rows)
                done += len(rows)
                continue
            cut = np.argpartition(part[:, widest], len(rows) // 2)
            todo.append((rows[cut[: len(rows) // 2]], me, 0))
            todo.append((rows[cut[len(rows) // 2 :]], me, 1))
        self.order = np.concatenate(order)
        self.low, self.high, self.kids, self.span = (np.array(x) for x in (self.low, self.high, self.kids, self.span))


class Best:
    """The best ``k`` of each query so far (query's row, score, id, times); hits wait in a list until they are many."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.kth = k, floors.copy()
        self.found = tuple(np.empty(0, dtype=t) for t in (np.int64, floors.dtype, np.int64, np.int64))
        self.held: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, *hits: np.ndarray) -> None:
        self.held.append(hits)
        self.waiting += len(hits[0])

    def settle(self) -> None:
        """Keep the best ``k`` of each query, ties to the smaller id, and raise the k-th scores."""
        row, score, ids, times = (np.concatenate(x) for x in zip(self.found, *self.held))
        self.held, self.waiting = [], 0
        order = np.lexsort((ids, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.kth[row[last]] = np.maximum(self.kth[row[last]], score[order][last])
        keep = order[place < self.k]
        self.found = row[place < self.k], score[keep], ids[keep], times[keep]


def search(tree: dict, queries: np.ndarray, names: np.ndarray, floors: np.ndarray, k: int = K) -> tuple[tuple[np.ndarray, ...], int]:
    """Query's row, score, id and times of the best ``k`` of one shard for each query, none below its floor; and the leaves read.

    Nodes are walked from a heap by the largest excess of their bound over a
    query's k-th score; a node that no query can win from is not opened.
    """
    vectors, ids, times, low, high, kids, span = (tree[n] for n in ("vectors", "ids", "times", "low", "high", "kids", "span"))
    exact = queries.dtype == object
    low, high = _exact(low, exact), _exact(high, exact)
    if not exact:
        most = queries.shape[1] * float(np.abs(queries).max(initial=0)) * float(max(np.abs(low[0]).max(), np.abs(high[0]).max()))
        asked = queries.astype(np.float32 if most < 1 << 24 else np.float64)  # sums of whole numbers below 2**24 are exact in 32 bits
    best, opened = Best(floors, k), 0
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)

    def bound(node: int) -> np.ndarray:
        b = up @ high[node] + down @ low[node]
        return np.array([min(MOST, max(-MOST, v)) for v in b], dtype=np.int64) if exact else b

    bounds = {0: bound(0)}
    heap = [(-float((bounds[0] - best.kth.astype(float)).max()), 0)]
    while heap:
        _, node = heapq.heappop(heap)
        who = np.flatnonzero(bounds.pop(node) >= best.kth)
        if not len(who):
            continue
        if kids[node][0] >= 0:
            for kid in kids[node].tolist():
                b = bound(kid)
                if (b >= best.kth).any():
                    bounds[kid] = b
                    heapq.heappush(heap, (-float((b - best.kth.astype(float)).max()), kid))
            continue
        opened += 1
        a, b = span[node].tolist()
        if exact:
            s = queries[who] @ _exact(vectors[a:b], True).T
            s = np.array([[min(MOST, max(-MOST, v)) for v in r] for r in s], dtype=np.int64).reshape(s.shape)
        else:
            s = asked[who] @ vectors[a:b].astype(asked.dtype).T
        row, column = np.nonzero(s >= best.kth[who][:, None].astype(s.dtype))
        other = ids[a + column] != names[who[row]]
        row, column = row[other], column[other]
        best.add(who[row], s[row, column], ids[a + column], times[a + column])
        if opened == 1 or best.waiting > k * len(queries):
            best.settle()
    best.settle()
    return best.found, opened


#: How whole numbers are stored, by their bytes.
WIDTHS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}


def _small(x: np.ndarray) -> np.ndarray:
    """The same whole numbers as the smallest integers that hold them, or float64."""
    most = np.abs(x).max(initial=0)
    return x.astype(next((WIDTHS[n] for n in (1, 2, 4) if most < 1 << (8 * n - 1)), np.float64))


def _numbers(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([_small(np.asarray(c.flatten())).reshape(-1, dim) for c in column.chunks])


def _exact(x: np.ndarray, big: bool) -> np.ndarray:
    """Float64, or Python integers where products would not be exact."""
    return np.array([[int(v) for v in r] for r in x.tolist()], dtype=object).reshape(x.shape) if big else x


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())


def _build(table: pa.Table) -> pa.Table:
    """One row with a shard's tree."""
    dim = table.column("dim")[0].as_py()
    vectors = _numbers(table.column("q"), dim)
    tree = Tree(vectors)
    arrays = {
        "vectors": vectors[tree.order], "ids": np.asarray(table.column("vec_id"))[tree.order], "times": np.asarray(table.column("times"))[tree.order],
        "low": tree.low, "high": tree.high, "kids": tree.kids.astype(np.int64), "span": tree.span.astype(np.int64),
    }
    key = {n: [table.column(n)[0].as_py()] for n in ("dim", "big", "cell", "part")}
    out = {**key, "rows": [len(vectors)], "nodes": [len(tree.low)], "width": [vectors.itemsize], "low": [tree.low[0].tolist()], "high": [tree.high[0].tolist()], "tree": [_pack(arrays)]}
    return pa.table(out, schema=pa.schema([("dim", pa.int32()), ("big", pa.bool_()), ("cell", pa.int32()), ("part", pa.int32()), ("rows", pa.int64()), ("nodes", pa.int64()), ("width", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("tree", pa.binary())]))


def _unpack(raw: bytes, dim: int, rows: int, nodes: int, width: int) -> dict[str, np.ndarray]:
    shapes = {"vectors": (rows, dim), "ids": (rows,), "times": (rows,), "low": (nodes, dim), "high": (nodes, dim), "kids": (nodes, 2), "span": (nodes, 2)}
    out, at = {}, 0
    for name, shape in shapes.items():
        kind = np.dtype(WIDTHS[width] if name == "vectors" else np.float64 if name in ("low", "high") else np.int64)
        n = math.prod(shape)
        out[name] = np.frombuffer(raw, dtype=kind, count=n, offset=at).reshape(shape)
        at += kind.itemsize * n
    return out


def _found(tree: dict, names: np.ndarray, queries: np.ndarray, floors: list[int | None], exact: bool, k: int) -> pa.RecordBatch:
    low = np.array([-MOST if f is None else f for f in floors], dtype=np.int64)
    low = low if exact else np.where([f is None for f in floors], -math.inf, low.astype(float))
    (row, score, ids, times), _ = search(tree, queries, names, low, k)
    many = np.minimum(times, k)
    out = (names[row], ids, score.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(x, many), pa.int64()) for x in out], names=["query_id", "vec_id", "score"])


SHARD_KEY = ("dim", "big", "cell", "part")
BLOCK_DATA = ("names", "floors", "qs", "width", "large")


BLOCK_TYPES = "names array<long>, floors array<long>, qs binary, width int, large boolean"
BLOCK_ARROW = [("names", pa.list_(pa.int64())), ("floors", pa.list_(pa.int64())), ("qs", pa.binary()), ("width", pa.int32()), ("large", pa.bool_())]


def _blocks(asked: DataFrame) -> DataFrame:
    """Queries packed by dim, cell and block: arrays of ids and floors, and all components as the smallest numbers."""
    one = F.struct("query_id", "floor", "q", "large")
    packed = asked.groupBy("dim", "cell", "block").agg(F.sort_array(F.collect_list(one)).alias("x"))
    packed = packed.select("dim", "cell", "block", F.col("x.query_id").alias("names"), F.col("x.floor").alias("floors"), F.flatten("x.q").alias("qs"), F.exists("x.large", lambda v: v).alias("large"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("block", pa.int32()), *BLOCK_ARROW])
        for batch in batches:
            qs = [_small(np.asarray(x.values)) for x in batch.column(5)]
            made = [pa.array([q.tobytes() for q in qs], pa.binary()), pa.array([q.itemsize for q in qs], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made, batch.column(6)], schema=schema)

    return packed.mapInArrow(run, f"dim int, cell int, block int, {BLOCK_TYPES}")


def _queries(row: dict) -> np.ndarray:
    return np.frombuffer(row["qs"].as_py(), dtype=WIDTHS[row["width"].as_py()]).reshape(-1, row["dim"].as_py()).astype(float)


def _meet(trees: DataFrame, sent: DataFrame, copies: int, parts: int, k: int) -> DataFrame:
    """``query_id, vec_id, score``: what each block finds in the shard (``SHARD_KEY``) that it is sent to.

    A shard's tree and its blocks come to one of ``parts`` partitions, the tree
    first; few shards with many blocks are copied ``copies`` times.
    """
    key = [*SHARD_KEY, "copy"]
    sent = sent.withColumn("copy", F.pmod(F.hash("names"), F.lit(copies)))
    every = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
    one = trees.select(*SHARD_KEY, "rows", "nodes", F.col("width").alias("wide"), "tree", every).withColumn("kind", F.lit(0))
    two = sent.select(*key, *BLOCK_DATA).withColumn("kind", F.lit(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, now = {}, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(i)[at] for i, n in enumerate(batch.schema.names)}
                place = tuple(row[n].as_py() for n in key)
                if row["kind"].as_py() == 0:
                    tree, now = _unpack(row["tree"].as_py(), *(row[n].as_py() for n in ("dim", "rows", "nodes", "wide"))), place
                    continue
                if place != now:
                    raise ValueError("a block came without its tree")
                exact = place[1] or row["large"].as_py()
                yield _found(tree, np.asarray(row["names"].values), _exact(_queries(row), exact), row["floors"].as_py(), exact, k)

    rows = one.unionByName(two, allowMissingColumns=True).repartition(parts, *key).sortWithinPartitions(*key, "kind")
    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def _still_open(blocks: DataFrame, boxes: dict[int, list[tuple[int, list[int], np.ndarray, np.ndarray]]]) -> DataFrame:
    """The blocks, once for each shard of each cell whose box can still win, with those of their queries that it can win for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dim", pa.int32()), ("from", pa.int32()), ("home", pa.int32()), ("to", pa.int32()), ("parts", pa.list_(pa.int32())), *BLOCK_ARROW])
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(i)[at] for i, n in enumerate(batch.schema.names)}
                dim, large, width = row["dim"].as_py(), row["large"].as_py(), row["width"].as_py()
                names, floors, qs = np.asarray(row["names"].values), row["floors"].as_py(), _queries(row)
                kth = np.array([-math.inf if f is None else f for f in floors], dtype=float)
                up, down, kept = np.maximum(qs, 0), np.minimum(qs, 0), qs.astype(WIDTHS[width])
                for cell, parts, low, high in boxes.get(dim, []):
                    who = np.flatnonzero(up @ high + down @ low >= kth) if not large else np.arange(len(names))
                    if len(who):
                        values = (dim, row["cell"].as_py(), row["home"].as_py(), cell, parts, names[who], [floors[i] for i in who.tolist()], kept[who].tobytes(), width, large)
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    sent = blocks.mapInArrow(run, f"dim int, from int, home int, to int, parts array<int>, {BLOCK_TYPES}")
    return sent.withColumn("part", F.explode("parts")).drop("parts").where((F.col("to") != F.col("from")) | (F.col("part") != F.col("home")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best inner products of each query, ties to the smaller id.

    Vectors that are null or hold null or non-finite components take no part,
    as queries or as candidates, nor do null ids; vectors meet those of their
    own length only.  A query never finds its own id.  Repeated candidate ids
    count as often as they occur; of a repeated query id the least vector asks.
    Scores are exact; one beyond a long becomes the nearest of plus and minus
    2**63 - 1 and is ranked as such.  Empty tables give an empty result.
    """
    spark = vectors.sparkSession

    def ready(df: DataFrame) -> DataFrame:
        ok = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        q = F.transform(value, lambda x: _whole(x.cast("double") * SCALE))
        return df.where(F.col(value).isNotNull() & F.col(key).isNotNull() & ok & (F.size(value) > 0)).select(F.col(key).cast("long").alias("vec_id"), q.alias("q"))

    dim, large = F.size("q"), F.exists("q", lambda x: F.abs(x) > EXACT)
    points = stage(ready(vectors).groupBy("vec_id", "q").agg(F.count("*").alias("times")).withColumns({"dim": dim, "big": large}), "topk-points")
    asked = stage(ready(queries).groupBy("vec_id").agg(F.min("q").alias("q")).select(F.col("vec_id").alias("query_id"), "q", dim.alias("dim"), large.alias("large")), "topk-asked")
    # Of shards times queries and copies times vectors, which both move, the sum is least at this number of shards.
    n, q = points.count(), asked.agg(F.count("*").alias("n"), F.coalesce(F.sum("dim"), F.lit(0)).alias("dims")).first()
    size = min(SHARD[1], max(SHARD[0], n // max(1, min(2 * parallelism(spark), math.isqrt(2 * parallelism(spark) * n // max(1, q.n))))))
    lengths = [(r.dim, r.n) for r in points.where("not big").groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()]
    cells: list[tuple[int, Column]] = []
    for d, many in lengths:
        depth = min(DEPTH, max(0, int(math.log2(max(1, many / size)))))
        chosen = F.pmod(F.xxhash64("vec_id", "q"), F.lit(many)) < SAMPLE
        sample = points.where((F.col("dim") == d) & ~F.col("big") & chosen).select("q").toPandas()["q"].tolist()
        cells.append((d, cell_of(F.col("q"), *coarse_splits(np.array(sample, dtype=float).reshape(-1, d), depth), depth) if depth else F.lit(0)))

    def dealt(df: DataFrame, apart: Column, name: str, most: int) -> DataFrame:
        """``cell``, and within it ``name``, so that the rows of each are about ``most``."""
        cell = F.lit(0)
        for d, c in cells:
            cell = F.when((F.col("dim") == d) & ~apart, c).otherwise(cell)
        df = df.withColumn("cell", cell)
        known = F.col("dim").isin([d for d, _ in cells]) & ~apart
        counts = {(r.dim, r.cell): r.n for r in df.where(known).groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}  # LENGTHS * 2**DEPTH rows at most
        parts = F.lit(max(1, -(-df.where(~known).count() // min(most, APART))))
        for d, _ in cells:
            of = [max(1, -(-counts.get((d, c), 0) // most)) for c in range(1 << DEPTH)]
            parts = F.when((F.col("dim") == d) & ~apart, F.array(*map(F.lit, of))[F.col("cell")]).otherwise(parts)
        return df.withColumn(name, F.pmod(F.xxhash64(*df.columns[:2]), parts).cast("int"))

    shards = dealt(points, F.col("big"), "part", size)
    built = "dim int, big boolean, cell int, part int, rows long, nodes long, width int, low array<double>, high array<double>, tree binary"
    trees = stage(shards.groupBy(*SHARD_KEY).applyInArrow(_build, built), "topk-trees")
    where = trees.select(*SHARD_KEY)
    many = max(1, where.count())
    bytes_asked = 2 * q.dims + 16 * q.n
    copies = max(1, 2 * parallelism(spark) // many, -(-bytes_asked // GROUP_BYTES))
    parts = min(MOST_PARTS, max(4 * parallelism(spark), -(-many * bytes_asked // GROUP_BYTES)))
    # Shards of the coarse cells, in LENGTHS * 2**DEPTH rows at most, and below the shards outside of them: a number for each SHARD[0] vectors or more.
    homes = F.broadcast(where.where("not big").groupBy("dim", "cell").agg(F.sort_array(F.collect_set("part")).alias("parts")))
    placed = stage(dealt(asked, F.col("large"), "block", BLOCK), "topk-placed").withColumn("floor", F.lit(None).cast("long"))

    def homed(blocks: DataFrame) -> DataFrame:
        home = F.get("parts", F.pmod("block", F.size("parts")))
        return blocks.join(homes, ["dim", "cell"], "left").withColumn("home", F.coalesce(home, F.lit(-1)).cast("int")).drop("parts")

    sent = homed(_blocks(placed)).where("home >= 0").withColumns({"big": F.lit(False), "part": F.col("home")})
    first = stage(_meet(trees, sent, 1 if many >= parallelism(spark) else copies, parts, k), "topk-home")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    told = placed.join(kth.hint("merge"), "query_id", "left").withColumn("floor", F.col("kth")).drop("kth")
    blocks = stage(homed(_blocks(told)), "topk-blocks")
    # Boxes of the coarse cells: LENGTHS * 2**DEPTH at most.
    sides = trees.where(~F.col("big") & F.col("dim").isin([d for d, _ in lengths])).select("dim", "cell", "part", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x"))
    sides = sides.groupBy("dim", "cell", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"), F.sort_array(F.collect_set("part")).alias("parts"))
    boxes: dict[int, list] = {}
    for r in sides.groupBy("dim", "cell").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("x"), F.first("parts").alias("parts")).collect():
        boxes.setdefault(r.dim, []).append((r.cell, r.parts, np.array([v.low for v in r.x]), np.array([v.high for v in r.x])))
    near = _still_open(blocks, boxes).select("dim", F.lit(False).alias("big"), F.col("to").alias("cell"), "part", *BLOCK_DATA)
    rest = where.where(F.col("big") | ~F.col("dim").isin([d for d, _ in lengths])).withColumnRenamed("cell", "to")
    far = blocks.join(F.broadcast(rest), "dim").where(F.col("big") | (F.col("to") != F.col("cell")) | (F.col("part") != F.col("home"))).select("dim", "big", F.col("to").alias("cell"), "part", *BLOCK_DATA)
    found = first.union(_meet(trees, near.unionByName(far), copies, parts, k))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _whole(x: Column) -> Column:
    """The floor as a double; floor() itself gives a long, too short for large components."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
