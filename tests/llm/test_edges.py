"""Each operator and each pipeline stage on awkward tables: nulls, empty and very long texts, repeated rows, no rows, clashing columns."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")

from lynxmark.llm import bpe, licenses, media, mixing, quality, runtime, secrets, sharding, simhash, tokenfiles  # noqa: E402

#: Names that the operators use for columns of their own.
INSIDE = """_text _score _row _held _of _blob _spans _turn _from _times _many _of_id _size _id _source _words row fp node root key keys law shard slot h x q a b bytes size blob spans rules rep pending wanted
    turn bucket base first_end total part tie any level weight media n_bytes feature hits n_words score shared chunk ids decoded times copies owner first component_id fingerprint up_to before""".split()
LONG = "a long line of words, again and again. " * 30000
TEXTS = [None, "", " ", "same words in this row", "same words in this row", LONG, "password = 'hunter22' and AKIA" + "Q" * 17, "All rights reserved under CC BY", "İ é 日本 　 x", "\x00\x01 control"]


def table(spark, tmp=None):
    names = [n for n in dict.fromkeys(INSIDE) if n not in ("doc_id", "text", "source", "lang", "n_chars")]
    rows = [(k, t, None if k % 4 == 0 else "s", "en", 0) for k, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (None, "no id", "s", None, None), (None, "no id", "s", None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return df.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for n in names})


def labels(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(len(TEXTS))] + [(3, None), (None, 1), (3, 1), (4, 7)], "doc_id long, quality int")


def operators(spark, docs, folder):
    model = quality.train(docs, labels(spark))
    path = f"file://{folder}"
    manifest = tokenfiles.write_token_files(docs, tokenfiles.byte_vocabulary(), f"{path}/tokens")
    return {
        "sharding": sharding.shard_documents(docs), "near_duplicates": simhash.near_duplicates(docs), "bpe": bpe.encode_documents(docs, bpe.word_vocabulary()),
        "quality": quality.score(docs, model, keep=docs.columns, out="a_score"), "media": media.describe_media(media.encode_media(docs)), "mixing": mixing.mix(docs),
        "licenses": licenses.scan_licenses(docs), "token_files": tokenfiles.read_token_files(manifest, f"{path}/tokens"), "secrets": secrets.scan_secrets(docs, f"{path}/ledger"),
        "redact": secrets.redact(docs, f"{path}/redacted"),
    }


def test_every_row_comes_back(spark, tmp_path):
    docs = table(spark).cache()
    for name, made in operators(spark, docs, tmp_path).items():
        assert made.count() == docs.count(), name
        got = sorted(str(r.doc_id) for r in made.select("doc_id").collect())
        assert got == sorted(str(r.doc_id) for r in docs.select("doc_id").collect()), name


def test_no_rows(spark, tmp_path):
    for name, made in operators(spark, table(spark).limit(0), tmp_path).items():
        assert made.count() == 0, name


def untouched(before, after, but=("text", "n_chars")):
    """The other columns of every row that stays are as they came."""
    kept = [c for c in before.columns if c not in but]
    return after.select(*kept).exceptAll(before.select(*kept).withColumn("n", F.explode(F.lit([1, 2]))).drop("n")).isEmpty()


def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = table(spark).cache()
    labels(spark).write.parquet(f"file://{tmp_path}/labels.parquet")
    for at, (name, function) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = runtime.stage(function(spark, docs, f"file://{tmp_path}"), "edges")
        assert after.columns == docs.columns, name
        assert untouched(docs, after), name
        assert runtime.stage(function(spark, docs.limit(0), f"file://{tmp_path}"), "edges").count() == 0, name
        if at == 2:
            assert after.count() == docs.count() and after.where(F.col("text").contains("hunter22") | F.col("text").contains("AKIA")).isEmpty()
    name, function = corpus_pipeline.STAGES[-1]
    assert function(spark, docs, f"file://{tmp_path}").count() == docs.count()


def test_taken_copies_of_repeated_rows(spark):
    docs = table(spark).cache()
    plan = mixing.mix(docs).where("taken > 0").select((F.col("taken") / F.col("size")).alias("n")).agg(F.sum("n")).first()[0]
    assert mixing.taken_documents(docs).count() == plan


def test_shared_folder_is_named_on_a_cluster(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"

    class Session:
        sparkContext = Cluster()

        class conf:
            get = staticmethod(lambda key, default=None: None)

    with pytest.raises(ValueError):
        runtime.shared_dir(Session())


def test_own_tables_go(spark):
    with runtime.temporary(spark):
        path = runtime.shared_path(spark, "scope")
        runtime.write(spark.range(3), path)
        assert spark.read.parquet(path).count() == 3
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def test_hot_rows(spark):
    """A third of all rows are one id and one text; they are one until they are needed again."""
    rows = [(7, "one and the same text of many words " * 9)] * 900 + [(k, f"text {k} " * 9) for k in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = bpe.word_vocabulary()
    got = bpe.encode_documents(docs, path).groupBy("doc_id", "ids").count().where("doc_id = 7").collect()
    assert sorted(r["count"] for r in got) == [1, 900]
    tool = bpe.encoder(path).tokenizer
    assert {tuple(r.ids) for r in got} == {tuple(tool.encode(t, add_special_tokens=False).ids) for t in (rows[0][1], "text 7 " * 9)}
