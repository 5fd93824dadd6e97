import pytest
from pyspark.sql import functions as F

from locusflow.llm import mixing, rules

from .oracle import same


def test_mix_matches_sql(spark, docs):
    same(mixing.mix(docs).drop("source"), mixing.OP3_SQL, documents=docs)


def test_mix_properties(spark, docs, none):
    got = mixing.mix(docs.withColumn("target", F.lit("clash")).withColumn("part", F.lit(1)))
    per = got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r["t"] - r["g"]) <= 1 and r["over"] <= 0 for r in per)
    total = docs.select(mixing.word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert abs(sum(r["g"] for r in per) - 1.5 * total) < 1e-6
    assert mixing.mix(none).count() == 0


def test_mix_with_clashing_names(spark, docs):
    clash = docs
    for name in ("_key", "_source", "_part", "key", "part", "row", "tie", "side"):
        clash = clash.withColumn(name, F.lit("mine"))
    got = mixing.mix(clash, whole=True)
    assert got.select("_key", "_source", "_part", "key", "part", "row", "tie", "side").distinct().collect() == [("mine",) * 8]
    plain = lambda df: sorted(map(str, df.select("doc_id", "size", "target", "taken").collect()))
    assert plain(got) == plain(mixing.mix(docs))


def test_mix_takes_rows_without_id_like_others(spark):
    docs = spark.createDataFrame([(None if i % 5 == 0 else i, f"t{i} " * 20, f"s{i % 2}") for i in range(2000)], "doc_id long, text string, source string")
    per = mixing.mix(docs).groupBy(F.col("doc_id").isNull().alias("lone")).agg((F.sum("taken") / F.sum("size")).alias("share")).collect()
    assert abs(per[0]["share"] - per[1]["share"]) < 0.15


def test_mix_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.mix(docs).select("size", "target", "taken").collect()] == [(0, 0.0, 0)] * 2


def test_rules_match_sql(spark, docs):
    got = rules.judge(docs).drop("failed")
    same(got, rules.OP5_SQL, documents=docs)


def test_rules_empty(spark, none):
    assert rules.judge(none).count() == 0


@pytest.mark.parametrize("text,words", [(None, 0), ("", 0), (" a", 1), ("a\tb\n", 2), ("\x0b", 0), ("a\u00a0b", 1)])
def test_word_count(spark, text, words):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(mixing.word_count(F.col("text"))).first()[0] == words


def test_mix_keeps_whole_rows(spark, docs):
    """With all columns: the same numbers, every row's own text, clashing names replaced; ranges of any size agree."""
    rows = docs.withColumn("target", F.lit("clash"))
    got, plain = mixing.mix(rows, whole=True), mixing.mix(docs)
    assert got.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    key = lambda df: sorted(map(str, df.select("doc_id", "source", "size", "source_size", "target", "taken").collect()))
    assert key(got) == key(plain) == key(mixing.mix(docs, range_rows=1))
    assert sorted(map(str, got.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))


def test_costs_of_rules_are_of_evaluation(spark):
    texts = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("AB cd cd #x "), F.col("id").cast("string"), F.lit(" ")), 60).alias("text"))
    measured = rules.base_measures(texts).cache()
    try:
        free = {"nothing": lambda: F.lit(True), "cheap": lambda: F.col("n_symbols") > 1, "shouting": rules.RULES["shouting"]}
        runs = [rules.rule_costs(measured, free) for _ in range(2)]
        assert all(c["shouting"] > 50 * c["cheap"] and c["shouting"] > 50 * c["nothing"] for c in runs)
        three = {"a_dear": lambda: F.size(F.filter("words", lambda w: F.upper(w) == w)) > 10, "b_cheap": lambda: F.col("n_words") > 100, "c_never": lambda: F.col("n_words") < 0}
        assert all(rules.ordered_rules(measured, three) == ["b_cheap", "a_dear", "c_never"] for _ in range(3))
    finally:
        measured.unpersist()
