"""Media columns: texts as lossless images and back.

Payloads are stored as lossless WebP; the stored bytes are decoded again, all by
the general decoder, and features come from the decoded pixels.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import webp
from .runtime import slices, text_bytes

#: Bytes of text that are encoded, and of media that are decoded, in one step.
STEP, MEDIA_STEP = 1 << 19, 3 << 20
GRID = 8


def encode_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8, padded with spaces to a positive multiple of 192, as WebP.

    Null text counts as empty.  A payload of over 64 rows continues in further
    files within the same value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STEP):
            data, starts = text_bytes(batch.column(1))
            sizes = np.diff(starts)
            padded = np.maximum(webp.ROW, -(-sizes // webp.ROW) * webp.ROW)
            payload = np.full(int(padded.sum()), 32, dtype=np.uint8)
            place = np.repeat((np.cumsum(padded) - padded) - np.array(starts[:-1]), sizes) + np.arange(len(data))
            payload[place] = np.frombuffer(data, dtype=np.uint8)
            media = webp.encode_payloads(payload, padded)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary").withColumnRenamed("doc_id", key)


def decode_media(media: DataFrame, column: str = "media") -> DataFrame:
    """Pixel arrays of a column of lossless WebP: ``width``, ``height`` and ``pixels`` (R, G, B, A) beside the other columns.

    A null value gives nulls.  Any lossless file is read; several in one value
    are one image whose rows follow one another, and must have one width.
    """
    names = [n for n in media.columns if n not in (column, "width", "height", "pixels")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, MEDIA_STEP):
            files = [[] if m is None else webp.riff_files(m) for m in batch.column(0).to_pylist()]
            decoded = iter(webp.decode_many([f for of in files for f in of]))
            images = [np.concatenate([next(decoded) for _ in of]) if of else None for of in files]
            out = [
                pa.array([None if i is None else i.shape[1] for i in images], pa.int32()),
                pa.array([None if i is None else i.shape[0] for i in images], pa.int32()),
                pa.array([None if i is None else i.tobytes() for i in images], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *out], names=[*names, "width", "height", "pixels"])

    schema = ", ".join(f"`{n}` {media.schema[n].dataType.simpleString()}" for n in names)
    return media.select(column, *names).mapInArrow(run, f"{schema}, width int, height int, pixels binary")


def brightness_hash(payload: bytes) -> str:
    """16 hex digits: which cells of an 8 x 8 grid over the image are brighter than the mean."""
    pixels = np.frombuffer(payload, dtype=np.uint8).reshape(-1, webp.WIDTH, webp.CHANNELS).astype(np.int64)
    height = len(pixels)
    light = (pixels[..., 0] + 2 * pixels[..., 1] + pixels[..., 2]).reshape(height, GRID, -1).sum(2)
    edges = np.arange(GRID) * height // GRID
    tops = np.add.reduceat(light, edges, axis=0) if height >= GRID else light[edges]
    cells = tops * height // np.maximum(1, np.diff(np.append(edges, height)))[:, None] if height >= GRID else tops
    return np.packbits(cells * cells.size > cells.sum()).tobytes().hex()


def describe_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read stored payloads back and describe them: sizes, hashes and a feature of the pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", MEDIA_STEP):
            stored = batch.column(2).to_pylist()
            payloads = webp.decode_payloads(stored)
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(list(map(len, payloads)), pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                pa.array(list(map(len, stored)), pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in stored]),
                pa.array([brightness_hash(p) for p in payloads]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(F.col(key).alias("doc_id"), "n_bytes", "media").mapInArrow(run, schema)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_media(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
