import random
import zlib

import numpy as np
import pytest

from locusflow.llm import quality as Q


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(2)
    vocab = [f"word{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(900):
        good = r.random() < 0.8
        words = [r.choice(vocab) for _ in range(r.choice([10, 60, 200]))]
        if not good:
            words = [w + "###" for w in words] if r.random() < 0.5 else [words[0]] * len(words)
        docs.append((i, " ".join(words), None if i % 3 else "en", 0.5))
        if r.random() < 0.6:
            labels.append((i, int(good), 0))
    docs += [(2000, None, "x", 0.0), (2001, "", "x", 0.0), (None, "word1 word2", "x", 0.0), docs[1], docs[1], (2002, "a b " * 50_000, "x", 0.0)]
    labels += [(5000, 1, 0), (None, 1, 0), (2001, None, 0)]
    where = str(tmp_path_factory.mktemp("q"))
    spark.createDataFrame(docs, "doc_id long, text string, source string, score double").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, docs, labels


def test_held_out_accuracy(spark, tables):
    where, docs, labels = tables
    got = Q.op9_quality(spark, where).toPandas()
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    by = got.drop_duplicates("doc_id").set_index("doc_id")
    held = [(q, by.loc[d, "predicted"]) for d, q, _ in labels if d is not None and d < 900 and zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(held) > 60 and np.mean([a == b for a, b in held]) > 0.95
    assert by.loc[5, "held_out"] == (zlib.crc32(b"5") % 5 == 0)


def test_held_out_labels_are_not_read(spark, tables):
    where, docs, labels = tables
    d = spark.read.parquet(f"{where}/documents.parquet")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    turned = spark.createDataFrame([(i, 1 - q if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert np.array_equal(Q.fit(d, lab).w1, Q.fit(d, turned).w1)


def test_keep_and_empty(spark, tables, none):
    where, docs, _ = tables
    d, lab = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    kept = Q.keep_good(d, lab)
    assert kept.columns == d.columns and 0 < kept.count() < len(docs)
    assert Q.fit(none, lab) is None and Q.keep_good(none, lab).count() == 0
    assert Q.fit(d, lab.where("false")) is None and Q.keep_good(d, lab.where("false")).count() == len(docs)


def test_features_are_finite():
    for text in (None, b"", b" \n", b"\xff\xfe", b"x" * 100_000, b"a a a a a a a a a a a a a a"):
        assert np.isfinite(Q.features(text)).all()
