import random
import zlib

import numpy as np
import pytest

from locusflow.llm import language as L

ROOTS = {"en": "the and ing tion er on".split(), "de": "sch ung der ein ü keit".split(), "fr": "eau que les é tion oi".split()}


def sentence(lang, r, n):
    return " ".join("".join(r.choice(ROOTS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    out = [(i, sentence(lang, r, r.choice([3, 20, 80])), lang, "s", 1) for i in range(600) for lang in [r.choice("en de fr".split())]]
    return out + [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "12 !! 34", "de", "s", 0), (None, "the and", None, "s", 0), (1003, "the and ing " * 20_000, None, None, 0), out[0], out[0]]


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int").write.parquet(str(tmp_path / "documents.parquet"))
    got = L.op2_language(spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows)
    by = got.set_index("doc_id")
    for d, text, lang, *_ in rows[:600]:
        r = by.loc[[d]].iloc[0]
        assert bool(r.held_out) == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    right = np.mean([by.loc[[d]].iloc[0].lang_pred == lang for d, _, lang, *_ in rows[:600] if by.loc[[d]].iloc[0].held_out])
    assert right > 0.95
    assert by.loc[[1000, 1001, 1002], "lang_pred"].tolist() == ["und"] * 3 and by.loc[1003, "lang_pred"] == "en"
    assert not got[got.doc_id.isna()].held_out.any()


def test_prediction_needs_text_alone_and_is_repeatable(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    a, b = L.fit(docs), L.fit(docs.repartition(7))
    assert a.languages == b.languages and np.array_equal(a.table, b.table)
    one = L.identify(docs.select("text", "doc_id"), a).toPandas().fillna(-1)
    two = L.identify(docs.repartition(3), b).toPandas().fillna(-1)
    key = lambda d: sorted(map(tuple, d.to_numpy().tolist()))
    assert key(one) == key(two)


def test_rejection(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    model = L.fit(docs)
    far = spark.createDataFrame([(1, "жзщ цчш ющя " * 9), (2, rows[0][1])], "doc_id long, text string")
    got = {r["doc_id"]: r["rejected"] for r in L.identify(far, model).collect()}
    assert got == {1: True, 2: False}


def test_empty(spark, none):
    assert L.fit(none) is None
    assert L.identify(none, None).count() == 0
    assert L.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), None).first()["lang_pred"] == "und"
