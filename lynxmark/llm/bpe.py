"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut into chunks where a rolling hash of the last 32 bytes says so, so
that a passage gives the same chunks in whatever document it stands.  Chunks are
named by a 128-bit hash; those that occur more than once are shared: one
occurrence is encoded, and the ids go to all others.  A chunk's edges mostly
fall inside a word; the ids of a chunk cover its inside only, from its first to
its last cut point, and each join (the loose end of one chunk and the loose
start of the next) is repaired by re-encoding it with context from both sides,
wider and wider, until the library's ids agree with those held on both sides.

Only hashes are shuffled to find what is shared.  Texts move once: one exchange,
by a hash of id and text, serves both the rows whose chunks are encoded for all
and the assembly of every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import PieceEncoder, cut_points
from .runtime import heavy, once_if_heavy, parts_for, slices, stage, text_bytes, tidy, utf8_size

#: Chunks hold about 2**MASK_BITS bytes, at least LEAST; longer than MOST only to reach a character's start.
MASK_BITS, LEAST, MOST = 10, 128, 16384
#: Shortest inside of a chunk that is worth sharing.
CONTEXT = 24


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@lru_cache(maxsize=2)
def token_strings(path: str) -> pa.Array:
    """The string of each id, as the library's decoder joins them for this vocabulary."""
    tokenizer = encoder(path).tokenizer
    return pa.array([tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))], pa.large_string())


def id_type(path: str) -> str:
    """The narrowest little-endian type that holds all ids of the vocabulary."""
    return "<u2" if encoder(path).tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def _gear() -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], dtype=np.uint32)


GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the last 32 bytes at each place: sum of GEAR[byte] shifted by its age."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        moved = h[:-step] << np.uint32(step)
        h[step:] += moved
    return h


def chunk_bounds(data: np.ndarray, starts: list[int]) -> np.ndarray:
    """All chunk bounds of the texts that begin at ``starts`` (the last entry is the end of ``data``)."""
    hits = np.flatnonzero(rolling(data) >> np.uint32(32 - MASK_BITS) == 0) + 1 if len(data) else np.empty(0, dtype=np.int64)
    out: list[int] = []
    at = 0
    hits = hits.tolist()
    for start, end in zip(starts[:-1], starts[1:]):
        out.append(start)
        last = start
        while at < len(hits) and hits[at] <= start + 31:  # the window still reaches into the text before
            at += 1
        while True:
            while at < len(hits) and hits[at] < last + LEAST:
                at += 1
            cut = hits[at] if at < len(hits) and hits[at] < end else end
            if cut - last > MOST:
                cut = last + MOST
            while cut < end and data[cut] & 0xC0 == 0x80:
                cut += 1
            if cut >= end:
                break
            out.append(cut)
            last = cut
    out.append(starts[-1])
    return np.array(out, dtype=np.int64)


def _inside(data: bytes) -> tuple[int, int]:
    """First and last cut point of a chunk; (0, 0) where there are not two."""
    cuts = cut_points(np.frombuffer(data, dtype=np.uint8))
    return (int(cuts[0]), int(cuts[-1])) if len(cuts) > 1 else (0, 0)


def chunk_hashes(docs: DataFrame) -> DataFrame:
    """``(row, chunk)`` for each chunk of each row of ``docs`` (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, starts = text_bytes(batch.column(1))
            bounds = chunk_bounds(np.frombuffer(data, dtype=np.uint8), starts)
            edges = bounds.tolist()
            view = memoryview(data)
            names = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            owner = np.searchsorted(np.array(starts[1:]), bounds[:-1], side="right")
            keep = np.diff(bounds) > 2 * CONTEXT
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner[keep])), pa.array([n for n, k in zip(names, keep.tolist()) if k], pa.binary())], names=["row", "chunk"]
            )

    return docs.select("row", "text").mapInArrow(tidy(run), "row long, chunk binary")


def encode_shared(owned: DataFrame, path: str) -> DataFrame:
    """``(chunk, ids)`` for the chunks listed in ``wanted`` of each row of ``owned`` (text, wanted, and what else it has); ids as ``id_type``, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, starts = text_bytes(batch.column(0))
            bounds = chunk_bounds(np.frombuffer(data, dtype=np.uint8), starts).tolist()
            wanted = {n for row in batch.column(1).to_pylist() for n in row or ()}
            found: dict[bytes, bytes] = {}
            for a, b in zip(bounds[:-1], bounds[1:]):
                name = xxhash.xxh3_128_digest(data[a:b])
                if name in wanted and name not in found:
                    found[name] = data[a:b]
            inside = [c[slice(*_inside(c))] for c in found.values()]
            ids, at = encoder(path).encode(b"".join(inside), np.cumsum([0, *map(len, inside)]).tolist())
            pack, narrow = zstandard.ZstdCompressor(level=9), ids.astype(id_type(path))
            raw = [pack.compress(narrow[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(raw, pa.binary())], names=["chunk", "ids"])

    # All columns are read, so that the exchange below is the one that assembly needs too.
    return owned.select("text", "wanted", *(n for n in owned.columns if n not in ("text", "wanted"))).mapInArrow(tidy(run), "chunk binary, ids binary")


def repair(tool: PieceEncoder, text: bytes, start: int, end: int) -> list[int] | None:
    """Ids of ``text[start:end]`` between its neighbours: re-encoded with more and more context until both sides agree.

    The ids of the context alone must be what the joint encoding begins and ends
    with.  None where not even the whole text as context brings agreement: a
    token crosses the join, and the text has to be encoded as one.
    """
    width = CONTEXT
    while True:
        before, after = _tail(text[max(0, start - 2 * width) : start], width), _head(text[end : end + 2 * width], width)
        if width >= len(text):
            before, after = text[:start], text[end:]
        whole, a, b = (e.ids for e in tool.tokenizer.encode_batch_fast([(before + text[start:end] + after).decode(), before.decode(), after.decode()], add_special_tokens=False))
        if whole[: len(a)] == a and whole[len(whole) - len(b) :] == b and len(a) + len(b) <= len(whole):
            return whole[len(a) : len(whole) - len(b)]
        if width >= len(text):
            return None
        width *= 4


def _tail(text: bytes, width: int) -> bytes:
    """The end of ``text`` from its last cut point that leaves ``width`` bytes; nothing where there is none."""
    for at in range(len(text) - width, 0, -1):
        if text[at] in b" \n" and 0x20 < text[at - 1] < 0x7F:
            return text[at:]
    return b""  # a cut point needs no context


def _head(text: bytes, width: int) -> bytes:
    for at in range(width, len(text)):
        if text[at] in b" \n" and 0x20 < text[at - 1] < 0x7F:
            return text[:at]
    return b""


def assemble(rows: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` of ``rows`` (doc_id, text, shared: array of (chunk, ids))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, unpack = encoder(path), zstandard.ZstdDecompressor()
        for batch in slices(batches, "text", 4 << 20):
            data, starts = text_bytes(batch.column(1))
            held = [{x["chunk"]: x["ids"] for x in row or ()} for row in batch.column(2).to_pylist()]
            parts: list[bytes] = []  # what is encoded here: whole runs between shared insides
            plan: list[list[tuple[int, object]]] = []
            seams: list[tuple[bytes, int, int]] = []
            for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                if not held[i]:
                    plan.append([(0, len(parts))])
                    parts.append(data[a:b])
                    continue
                text = data[a:b]
                cuts = chunk_bounds(np.frombuffer(text, dtype=np.uint8), [0, len(text)]).tolist()
                steps: list[tuple[int, object]] = []
                done = 0
                for c, d in zip(cuts[:-1], cuts[1:]):
                    ids = held[i].get(xxhash.xxh3_128_digest(text[c:d]))
                    low, high = _inside(text[c:d]) if ids else (0, 0)
                    if ids is None or high <= low:
                        continue
                    gap = text[done : c + low]
                    if len(gap) > 8 * CONTEXT:  # not a join but text of its own
                        steps.append((0, len(parts)))
                        parts.append(gap)
                    elif gap:
                        steps.append((1, len(seams)))
                        seams.append((text, done, c + low))
                    steps.append((2, ids))
                    done = c + high
                steps.append((0, len(parts)))
                parts.append(text[done:])
                plan.append(steps)
            joined = _seams(tool, seams)
            for i, steps in enumerate(plan):
                if any(kind == 1 and joined[x] is None for kind, x in steps):  # no agreement: this text as one
                    plan[i] = [(0, len(parts))]
                    parts.append(data[starts[i] : starts[i + 1]])
            ids, at = tool.encode(b"".join(parts), np.cumsum([0, *map(len, parts)]).tolist())
            if not seams and all(len(p) == 1 for p in plan):
                flat, ends = ids, at[1:]
            else:
                pieces, counts = [], []
                for steps in plan:
                    n = 0
                    for kind, x in steps:
                        part = ids[at[x] : at[x + 1]] if kind == 0 else np.array(joined[x], dtype=np.int32) if kind == 1 else np.frombuffer(unpack.decompress(x), dtype=id_type(path)).astype(np.int32)
                        pieces.append(part)
                        n += len(part)
                    counts.append(n)
                flat, ends = np.concatenate(pieces) if pieces else ids, np.cumsum(counts)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            values = pa.array(flat.astype(np.int32))
            columns = [batch.column(0), pa.ListArray.from_arrays(offsets, values)]
            if decode:
                columns.append(decode_ids(columns[1], path))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "shared").mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>" + ", decoded string" * decode)


def _seams(tool: PieceEncoder, seams: list[tuple[bytes, int, int]]) -> list[list[int] | None]:
    """Repair joins (text, start, end); those alike in the first width's context once and together, the rest with more."""
    near = [(_tail(t[max(0, a - 2 * CONTEXT) : a], CONTEXT), t[a:b], _head(t[b : b + 2 * CONTEXT], CONTEXT)) for t, a, b in seams]
    distinct = list(dict.fromkeys(near))
    texts = [t.decode() for a, m, b in distinct for t in (a + m + b, a, b)]
    made = [e.ids for at in range(0, len(texts), 3000) for e in tool.tokenizer.encode_batch_fast(texts[at : at + 3000], add_special_tokens=False)]
    agreed = {}
    for k, seam in enumerate(distinct):
        whole, a, b = made[3 * k : 3 * k + 3]
        if len(a) + len(b) <= len(whole) and whole[: len(a)] == a and whole[len(whole) - len(b) :] == b:
            agreed[seam] = whole[len(a) : len(whole) - len(b)]
    return [agreed[n] if n in agreed else repair(tool, *s) for n, s in zip(near, seams)]


def decode_ids(ids: pa.Array, path: str) -> pa.Array:
    """Texts of lists of ids, as the library's ``decode(ids, skip_special_tokens=False)`` of a vocabulary without a decoder: token strings joined by spaces."""
    strings = token_strings(path).take(ids.values)
    lists = pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), strings)
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` for every row of ``docs``.

    Null and empty texts give no ids and the empty text.  Repeated and null ids
    are served like any other: rows are named by a hash of id and text, shared
    ids are found by a chunk's hash, never by its place.  An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(key, text).alias("row"))
    sizes = plain.select("row", utf8_size().alias("size"))
    repeated = heavy(sizes, "row")
    parts = parts_for(spark, sizes.agg(F.sum("size")).first()[0])
    seen = stage(chunk_hashes(plain).groupBy("row", "chunk").agg(F.count("*").alias("times")), "bpe-chunks")
    shared = stage(seen.groupBy("chunk").agg(F.sum("times").alias("times"), F.min("row").alias("owner")).where("times > 1"), "bpe-shared")
    # Many rows that repeat both id and text are one until their ids are known.
    placed = once_if_heavy(plain, "row", repeated).repartition(parts, "row")
    owners = shared.select(F.col("owner").alias("row"), "chunk").repartition(parts, "row").groupBy("row").agg(F.collect_list("chunk").alias("wanted"))
    owned = placed.join(owners.hint("shuffle_hash"), "row")
    encoded = encode_shared(owned, path).dropDuplicates(["chunk"])
    uses = seen.join(encoded, "chunk").select("row", "chunk", "ids").repartition(parts, "row").groupBy("row").agg(F.collect_list(F.struct("chunk", "ids")).alias("shared"))
    rows = placed.join(uses.hint("shuffle_hash"), "row", "left")
    if repeated:
        copies = sizes.where(F.col("row").isin(repeated)).groupBy("row").agg(F.count("*").cast("int").alias("copies"))
        rows = rows.join(F.broadcast(copies), "row", "left").withColumn("copies", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))))
        rows = rows.repartition(parts)
    return assemble(rows, path, decode).withColumnRenamed("doc_id", key)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_vocabulary()))
