"""Compression classifier of text quality.

Two zstandard dictionaries are trained, one on good and one on bad labelled
texts.  A text is compressed with each; the difference of the two sizes, by the
larger size and by the text's own, says which it resembles.  A logistic curve
over that, with how far the text shrinks and its length as context, fitted on
labelled texts that no dictionary saw, calibrates the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import free_name, slices, text_bytes, tidy

#: Labelled texts of each class that are learnt from (half for the dictionary, half for the curve), and the longest, in bytes.
SAMPLE, LONGEST = 1500, 1 << 16
#: Bytes of sampled text of one class that come to the driver.
SAMPLE_BYTES = 16 << 20
DICTIONARY, LEVEL = 64 << 10, 3


def fold(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    middle: list[float]
    spread: list[float]
    weights: list[float]  # intercept first; empty where there was nothing to learn from
    share: float  # of label 1, for that case

    def tools(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return tuple(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, **({"dict_data": zstandard.ZstdCompressionDict(d)} if d else {})) for d in (self.good, self.bad))

    def features(self, texts: list[bytes]) -> np.ndarray:
        good, bad = self.tools()
        a = np.array([len(good.compress(t)) for t in texts], dtype=float)
        b = np.array([len(bad.compress(t)) for t in texts], dtype=float)
        n = np.array([len(t) + 1 for t in texts], dtype=float)
        by_size, by_text, shrunk, length = (b - a) / np.maximum(a, b), (b - a) / n, np.log(np.minimum(a, b) / n), np.log(n)
        return np.stack(
            [by_size, by_text, shrunk, shrunk**2, by_size * shrunk, by_text * shrunk, by_size**2, length, length * by_size, length * shrunk], axis=1
        )

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.share)
        x = (self.features(texts) - self.middle) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights[1:]) + self.weights[0], -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-4) -> np.ndarray:
    """Logistic weights by Newton's method; rows weigh so that label 1 has the share it has among all labels."""
    w = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    x = np.c_[np.ones(len(x)), x]
    b = np.zeros(x.shape[1])
    keep = ridge * len(x) * np.r_[0, np.ones(len(b) - 1)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (w * (p - y)) + keep * b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _dictionary(texts: list[bytes]) -> bytes:
    texts = [t for t in texts if len(t) >= 16]
    if len(texts) < 16:
        return b"".join(texts)[:DICTIONARY]
    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes()
    except zstandard.ZstdError:  # too few bytes for a dictionary
        return b"".join(texts)[:DICTIONARY]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from labelled rows outside the held-out fold: at most ``SAMPLE`` texts of each class, of ``LONGEST`` bytes or fewer and ``SAMPLE_BYTES`` in all.

    The sample is that of the lowest hashes of the id; of several labels of one
    id, any one counts.  Labels other than 0 and 1, null ids and ids without a
    document teach nothing.  With a class missing the model scores every text with the share of label 1 (0.5 without any label).
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key) != 1)).select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).dropDuplicates(["id"])
    counts = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return Model(b"", b"", [], [], [], share)
    order = F.xxhash64(F.col("id"), F.lit(4))
    picked = marked.where("y = 0").orderBy(order).limit(2 * SAMPLE).union(marked.where("y = 1").orderBy(order).limit(2 * SAMPLE))  # bounded by SAMPLE
    body = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.octet_length("text") <= LONGEST).join(F.broadcast(picked), "id")
    # Of an id that repeats, one text: that of the lowest hash.  First the sizes come, then the texts of those that are used.
    one = body.groupBy("id").agg(F.min("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))).alias("x")).select("id", "y", "x.h", "x.n", order.alias("o"))
    wanted, used = {}, {0: [0, 0], 1: [0, 0]}
    for r in sorted(one.collect(), key=lambda r: (r.o, r.id)):
        if used[r.y][0] < SAMPLE and used[r.y][1] + r.n <= SAMPLE_BYTES:
            used[r.y] = [used[r.y][0] + 1, used[r.y][1] + r.n]
            wanted[r.id] = r.h
    rows = body.where(F.col("id").isin(list(wanted)) & F.xxhash64("text").isin(list(set(wanted.values())))).withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).withColumn("o", order).collect() if wanted else []
    rows = [r for r in rows if wanted[r.id] == r.h]
    by = {c: [r.text.encode() for r in sorted((r for r in rows if r.y == c), key=lambda r: (r.o, r.id))] for c in (0, 1)}
    if min(map(len, by.values())) < 4:
        return Model(b"", b"", [], [], [], share)
    half = {c: len(t) // 2 for c, t in by.items()}
    model = Model(_dictionary(by[1][: half[1]]), _dictionary(by[0][: half[0]]), [], [], [], share)
    texts = by[1][half[1] :] + by[0][half[0] :]
    y = np.array([1.0] * (len(by[1]) - half[1]) + [0.0] * (len(by[0]) - half[0]))
    x = model.features(texts)
    model.middle, model.spread = x.mean(0).tolist(), (x.std(0) + 1e-9).tolist()
    model.weights = _fit((x - model.middle) / model.spread, y, share).tolist()
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """``out``, the score of every text beside ``keep`` (the id if not given), which must not have that name.

    Null text counts as empty; equal texts score alike; repeated rows are scored each.
    A text that is kept goes to the workers once, not a second time to be scored.
    """
    names = [key] if keep is None else keep
    body = free_name(docs, "_text")
    others = [n for n in names if n != text]
    back = [0 if n == text else 1 + others.index(n) for n in names]  # places of the kept columns among those sent
    told = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body):
            data, starts = text_bytes(batch.column(0))
            found = told.value.scores([data[a:b] for a, b in zip(starts[:-1], starts[1:])])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in back), pa.array(found, pa.float64())], names=[*names, out])

    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(F.col(text).alias(body), *others).mapInArrow(tidy(run), f"{schema}, `{out}` double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels)).select(
        "doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
