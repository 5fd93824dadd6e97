import random

import pytest
from pyspark.sql import functions as F

from locusflow.llm import divergence

from .oracle import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def talk(spark):
    """Sources with words of their own, nulls, an empty language, a group without terms, ties, and terms at the bound."""
    r = random.Random(5)
    rows = []
    for i in range(400):
        lang, source = r.choice(["en", "en", "de", "", None]), r.choice(["a", "b", "B", "ä", "", None, "hot", "hot", "hot"])
        own = [f"own{source}", "Über", "ÜBER"] if i % 2 else []
        words = r.choices([*"abcdefgh", "The", "the", "naïve", "x1y", "don't"], k=r.randrange(30)) + own
        rows.append((i, r.choice([" ", "\n", "-", "\x00", "7"]).join(words) if i % 23 else None, lang, source, 1))
    rows += [(1000 + i, "edge" if i < 30 else "below", "fr", f"s{i % 3}", 1) for i in range(59)]
    rows += [(2000, "12 34", "fr", "wordless", 1), (2001, None, "it", "alone", 1), (2002, "", "it", "second", 1), (None, "edge", "fr", "s0", 1)]
    return spark.createDataFrame(rows + rows[:3], SCHEMA)


@pytest.mark.parametrize("shard_rows", [40, 10_000_000])
def test_audit_matches_sql(talk, shard_rows):
    same(divergence.audit(talk, shard_rows=shard_rows), divergence.OP12_SQL, documents=talk)


def test_tallies_sent_early_change_nothing(talk, monkeypatch):
    rows = [r for b in divergence.tally(iter(talk.select("lang", "source", "text").na.fill("").toArrow().to_batches())) for r in b.to_pylist()]
    monkeypatch.setattr(divergence, "HELD", 1)
    early = [r for b in divergence.tally(iter(talk.select("lang", "source", "text").na.fill("").toArrow().to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert sum(r["n"] for r in early) == sum(r["n"] for r in rows) and sum(r["d"] for r in early) == sum(r["d"] for r in rows)


def test_shares_beyond_64_bits(spark):
    """A count whose product with the scale leaves 64 bits is divided exactly."""
    con = divergence._database()
    con.execute("CREATE TABLE counts AS SELECT 'l' AS lang, 's' AS source, 't' AS term, 40000000000::BIGINT AS n")
    con.execute("CREATE TABLE groups AS SELECT 'l' AS lang, 's' AS source, 40000000001::BIGINT AS total, 40000000001::BIGINT AS lang_total, 2::BIGINT AS terms, 1::BIGINT AS z")
    con.execute(divergence._SHARES.format(scale=divergence.SCALE, smooth=divergence.SMOOTH))
    assert con.execute("SELECT p, q FROM shares").fetchall() == [(1 + 10**9 * 40_000_000_005 // 40_000_000_011,) * 2]


def test_empty_and_clashing(spark, none, talk):
    assert divergence.audit(none).count() == 0
    clash = talk.limit(90).withColumn("term", F.lit("x")).withColumn("shard", F.lit(1)).withColumn("value", F.lit(2))
    same(divergence.audit(clash), divergence.OP12_SQL, documents=clash)


def test_very_long_text(spark):
    rows = [(i, "word other " * 700_000 if i == 0 else "word", "en", "abc"[i % 3], 1) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    same(divergence.audit(docs), divergence.OP12_SQL, documents=docs)
