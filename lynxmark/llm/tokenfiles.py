"""Token-id files: one zstandard frame per document under a shared dictionary.

A file holds the documents of one range of ids, ascending::

    magic (8 bytes) | dictionary id: SHA-256 (32) | frames | index | footer
    index: per document  id (8, signed), frame offset (8), ids (4), named (1: the id is real, 0: it is null)
    footer: index offset (8), documents (8), magic (8)

Numbers are little-endian; a frame holds the ids as 16-bit or 32-bit unsigned
integers, as the file's name says (``u2``, ``u4``).  The dictionary lies beside
the files under its hash.  Files are written to a name of their own attempt and
then renamed, so a repeated task leaves one whole file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .runtime import parts_for, shared_path, slices, text_bytes, utf8_size

MAGIC = b"LYNXTOK1"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("ids", "<u4"), ("named", "u1")])
#: Documents whose id arrays train the dictionary and the longest of them in bytes, the dictionary's bytes and the compression level.
SAMPLE, LONGEST, DICTIONARY, LEVEL = 400, 1 << 16, 32 << 10, 3
END_ID = 2


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary from serialized id arrays; empty where there is too little to learn from."""
    samples = [s for s in samples if len(s) >= 16]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few bytes for a dictionary
        return b""


def _tools(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int | None = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all documents, ascending by id, and return the manifest.

    The manifest has one row per file: ``part``, ``file``, ``documents``, ``ids``,
    ``start`` (ids in all files before).  Documents with a null id come first;
    equal ids are in the order of their texts' hashes.  Null text counts as
    empty.  An empty table gives no files.  The dictionary learns from at most
    ``SAMPLE`` texts of ``LONGEST`` bytes or fewer, those of the lowest hashes.
    """
    spark = docs.sparkSession
    width = "u4" if encoder(path).tokenizer.get_vocab_size() > 65536 else "u2"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Two hashes choose the sample; only its texts come here, not each task's first rows.
    keyed = rows.where(F.octet_length("text") <= LONGEST).select("text", F.xxhash64("doc_id").alias("id_hash"), F.xxhash64("text").alias("text_hash"))
    chosen = [(r[0], r[1]) for r in keyed.select("id_hash", "text_hash").distinct().orderBy("id_hash", "text_hash").limit(SAMPLE).collect()]
    held = keyed.where(F.col("id_hash").isin([a for a, _ in chosen]) & F.col("text_hash").isin([b for _, b in chosen])).dropDuplicates(["id_hash", "text_hash"]).collect()
    at = {(r.id_hash, r.text_hash): r.text.encode() for r in held}
    sample = [at[k] for k in chosen]
    ends = np.cumsum([0, *map(len, sample)]).tolist()
    ids, at_ids = encoder(path).encode(b"".join(sample), ends)
    taught = [ids[a:b].astype(f"<{width}").tobytes() for a, b in zip(at_ids[:-1].tolist(), at_ids[1:].tolist())]
    dictionary = train_dictionary(taught)
    name = hashlib.sha256(dictionary).digest()
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{name.hex()}.zdict") as out:
        out.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tool = encoder(path)
        pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **_tools(dictionary))
        out, final, draft, at, index, total = None, "", "", 0, [], 0  # index: an array for each batch
        store, base = _store(folder)
        for batch in slices(batches, "text"):
            if out is None:
                final, draft = f"{base}/part-{part:06d}.{width}", f"{base}/.part-{part:06d}-{uuid.uuid4().hex}"
                out = store.open_output_stream(draft)
                out.write(MAGIC + name)
                at = len(MAGIC) + len(name)
            data, starts = text_bytes(batch.column(1))
            ids, ends = tool.encode(data, starts)
            ids = ids.astype(f"<{width}")
            tail = np.array([] if end_id is None else [end_id], dtype=f"<{width}").tobytes()
            part_of = np.zeros(batch.num_rows, dtype=INDEX)
            part_of["named"] = np.asarray(batch.column(0).is_valid())
            part_of["doc_id"] = np.asarray(batch.column(0).fill_null(0))
            part_of["ids"] = np.diff(ends) + (end_id is not None)
            for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                frame = pack.compress(ids[a:b].tobytes() + tail)
                out.write(frame)
                part_of["offset"][k] = at
                at += len(frame)
            total += int(part_of["ids"].sum())
            index.append(part_of)
        if out is None:
            return
        listed = sum(map(len, index))
        for part_of in index:
            out.write(part_of.tobytes())
        out.write(struct.pack("<QQ", at, listed) + MAGIC)
        out.close()
        store.move(draft, final)
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [final.rpartition("/")[2]], "documents": [listed], "ids": [total]}, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    # A range is cut within an id, and within rows alike in all, so that one id in many rows doesn't come to one file.
    parts_wanted = parts_for(spark, rows.agg(F.sum(utf8_size())).first()[0])
    tie, any_ = F.xxhash64("text"), F.rand(5)
    spread = rows.withColumns({"tie": tie, "any": any_}).repartitionByRange(parts_wanted, F.col("doc_id").asc_nulls_first(), "tie", "any")
    ordered = spread.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text").select("doc_id", "text")
    # One row per file comes back; the files are there once this job ends.
    parts = sorted(ordered.mapInArrow(run, "part int, file string, documents long, ids long").collect(), key=lambda r: r.part)
    start, manifest = 0, []
    for r in parts:
        manifest.append((r.part, r.file, r.documents, r.ids, start))
        start += r.ids
    schema = T.StructType([T.StructField(n, k) for n, k in (("part", T.IntegerType()), ("file", T.StringType()), ("documents", T.LongType()), ("ids", T.LongType()), ("start", T.LongType()))])
    return spark.createDataFrame(manifest, schema)


class TokenFile:
    """One file: its index, and any document's ids without reading the rest."""

    def __init__(self, folder: str, file: str):
        self.store, base = _store(folder)
        self.path, self.width = f"{base}/{file}", file.rpartition(".")[2]
        self.input = self.store.open_input_file(self.path)
        size = self.input.size()
        at, count, magic = struct.unpack("<QQ8s", self.input.read_at(24, size - 24))
        head = self.input.read_at(40, 0)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError(f"{file} is no token file")
        self.end = at
        self.index = np.frombuffer(self.input.read_at(count * INDEX.itemsize, at), dtype=INDEX)
        name = head[8:].hex()
        with self.store.open_input_stream(f"{base}/{name}.zdict") as source:
            dictionary = source.read()
        if hashlib.sha256(dictionary).hexdigest() != name:
            raise ValueError(f"the dictionary {name} does not have that hash")
        self.unpack = zstandard.ZstdDecompressor(**_tools(dictionary))

    def ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(frame), dtype=f"<{self.width}")

    def frames(self, step: int = 4 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
        """``(doc_id, ids)`` of all documents, about ``step`` bytes read at a time."""
        bounds = [*self.index["offset"].tolist(), self.end]
        names, at = [d if n else None for d, n in zip(self.index["doc_id"].tolist(), self.index["named"].tolist())], 0
        while at < len(names):
            to = at + 1
            while to < len(names) and bounds[to + 1] - bounds[at] <= step:
                to += 1
            data = self.input.read_at(bounds[to] - bounds[at], bounds[at])
            for k in range(at, to):
                yield names[k], self.ids(data[bounds[k] - bounds[at] : bounds[k + 1] - bounds[at]])
            at = to

    def document(self, doc_id: int) -> np.ndarray | None:
        """Ids of one document by the index; None if it isn't here."""
        unnamed = len(self.index) - int(self.index["named"].sum())  # these come first
        k = unnamed + int(np.searchsorted(self.index["doc_id"][unnamed:], doc_id))
        if k == len(self.index) or self.index["doc_id"][k] != doc_id:
            return None
        end = self.index["offset"][k + 1] if k + 1 < len(self.index) else self.end
        at = int(self.index["offset"][k])
        return self.ids(self.input.read_at(int(end) - at, at))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, starts, counts, sums = [], [], [], []
                for name, ids in TokenFile(folder, file).frames():
                    names.append(name)
                    starts.append(start)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (names, starts, counts, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    n = 2 * spark.sparkContext.defaultParallelism
    return manifest.select("file", "start").repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-files")
    return read_token_files(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_vocabulary(), folder), folder)
