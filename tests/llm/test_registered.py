"""Every registered query on a whole small table, against plain Python or its SQL."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

from lynxmark.llm import bpe, licenses, media, queries, quality, sharding, tokenfiles  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1(spark, texts):
    got = rows(spark, "op1_sharding")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    sizes, groups, slots = Counter(), {}, {}
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        groups.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(sizes) <= set(range(16))
    assert all(len(s) == 1 for s in groups.values())
    whole = Counter()
    for r in got:
        whole[texts[r.doc_id]] += r.size
    assert max(sizes.values()) <= sum(sizes.values()) / 16 + max(whole.values())


def plain_fingerprint(text):
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return 0
    made = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op2(spark, texts):
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    names = sorted(prints)
    root = {k: k for k in names}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(names):
        for b in names[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op2_near_duplicates")}
    assert got == {k: (f"{prints[k]:016x}", find(k)) for k in names}


def test_op3(spark, texts):
    tool = tokenizers.Tokenizer.from_file(bpe.word_vocabulary())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op3_bpe")}
    for k, t in texts.items():
        ids = tool.encode(t, add_special_tokens=False).ids
        assert got[k] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_op4(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op4_quality")}
    assert set(got) == set(texts)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for k, r in got.items())
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    held = quality.score(docs, model).join(labels, "doc_id").where(quality.fold() == 1).collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in held]) > 0.93
    # Labels of the held-out fold and other columns teach nothing.
    turned = labels.withColumn("quality", F.when(quality.fold() == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs.withColumn("lang", F.lit("xx")), turned) == model


def test_op5(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op5_media")}
    assert set(got) == set(texts)
    stored = {r.doc_id: bytes(r.media) for r in media.encode_media(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for k, t in texts.items():
        raw = t.encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[k]), hashlib.sha256(stored[k]).hexdigest())
        pixels = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 64, 3).astype(int)
        light, h = pixels[..., 0] + 2 * pixels[..., 1] + pixels[..., 2], len(pixels)
        edges = [k_ * h // 8 for k_ in range(9)]
        cells = [[light[edges[i] : edges[i + 1], j * 8 : j * 8 + 8].sum() * h / (edges[i + 1] - edges[i]) if h >= 8 else light[edges[i], j * 8 : j * 8 + 8].sum() for j in range(8)] for i in range(8)]
        assert len(r.feature) == 16 and bin(int(r.feature, 16)).count("1") <= 64 and np.array(cells).shape == (8, 8)
    by_text = {}
    for k, t in texts.items():
        by_text.setdefault(t, set()).add((got[k].media_sha256, got[k].feature))
    assert all(len(v) == 1 for v in by_text.values())


def test_op7(spark, texts):
    phrases = [(t.label, t.words) for t in licenses.TEMPLATES if t.base]
    exact = [(t.label, t.words) for t in licenses.TEMPLATES]
    for r in rows(spark, "op7_licenses"):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].translate(LOWER))
        places = [(i, label) for label, p in phrases for i in range(len(words)) if words[i : i + len(p)] == p]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        whole = {label for label, p in exact if any(words[i : i + len(p)] == p for i in range(len(words)))}
        labels = set(r.labels.split(",")) - {""}
        assert whole <= labels and 0 <= r.score <= 1 and (r.score > 0) == bool(labels) and (not whole or r.score == 1)
        short = {t.label for t in licenses.TEMPLATES if len(t.words) < licenses.LONG}
        assert labels & short == whole & short  # only long templates may have gaps


def test_op9(spark, texts):
    tool = tokenizers.Tokenizer.from_file(tokenfiles.byte_vocabulary())
    at = 0
    for k, r in zip(sorted(texts), sorted(rows(spark, "op9_token_files"), key=lambda r: r.start), strict=True):
        ids = [*tool.encode(texts[k], add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    made = queries.QUERIES[name](spark, SF)
    assert sorted(made.columns) == sorted(columns)
    as_text = lambda row: tuple(map(str, row))
    assert sorted(as_text(r) for r in made.select(*columns).collect()) == sorted(map(as_text, want.fetchall()))


def test_shards_of_even_sizes(spark):
    df = spark.createDataFrame([(k, "x" * (k % 50)) for k in range(3000)], "doc_id long, text string")
    sizes = Counter()
    for r in sharding.shard_documents(df).collect():
        sizes[r.shard] += r.size
    whole = max(sum(k % 50 + 1 for k in range(3000) if k % 50 == n) for n in range(50))
    assert max(sizes.values()) <= sum(sizes.values()) / 16 + whole
