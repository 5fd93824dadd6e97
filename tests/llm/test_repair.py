import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from locusflow.llm import repair

from .oracle import same

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(turns):
    """(cost, audit) over all strings of edits, up to three insertions in a row, written out letter by letter."""
    found = []

    def go(i, roles, audit, cost):
        if not re.fullmatch("s?(ua)*u?", roles):
            return
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit))
        if not audit.endswith("III"):
            for name in "ua":
                go(i, roles + name, audit + "I", cost + 3)
        if i < len(turns):
            kind = turns[i][0]
            go(i + 1, roles, audit + "D", cost + 4)
            if kind != "D":
                broken = 3 if kind.isupper() else 0
                go(i + 1, roles + kind.lower(), audit + "K", cost + broken)
                for name in "ua":
                    go(i + 1, roles + name, audit + "R", cost + broken + 3)

    go(0, "", "", 0)
    return min(found)


def chained(segments):
    """(cost, audit) of segments through the operator's own folds."""
    class Row:
        pass

    chain, codes = repair._Chain(), []
    for k, turns in enumerate(segments):
        row = Row()
        row.conv, row.chunk, row.first, row.last, row.illegal = "c", k, "u", "a", 0
        row.costs, row.codes = repair.segment_ways(turns)
        codes.append(row.codes)
        chain.step(row)
    picks = sorted(chain.end(), key=lambda p: p[1])
    audit = "".join(codes[p[1]][p[2]] for p in picks) + picks[-1][3]
    return picks[-1][4], audit.translate(repair.LETTER)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_segments_against_all_edits(n):
    for kinds in itertools.product("suaoSUAOD", repeat=n):
        turns = [(k, 1) for k in kinds]
        want = brute(turns)
        assert chained([turns]) == want if turns else want == (0, "")
        assert chained([[t] for t in turns] or [[]]) == want


def test_longer_segments_against_all_edits():
    r = random.Random(2)
    for _ in range(40):
        turns = [(r.choice("suaoUAD"), 1) for _ in range(4)]
        want = brute(turns)
        assert chained([turns]) == chained([turns[:1], turns[1:]]) == want


def test_cuts_change_nothing():
    r = random.Random(3)
    for _ in range(400):
        turns = [(r.choice("ssuuuaaaoSUAOD"), r.choice([1, 1, 1, 3])) for _ in range(r.randrange(1, 30))]
        cuts = sorted(r.sample(range(len(turns) + 1), min(len(turns), r.randrange(5))))
        parts = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)], strict=True) if a < b]
        assert chained([turns]) == chained(parts)


def test_long_segment_in_linear_time():
    assert chained([[("u", 1), ("a", 1)] * 50_000 + [("u", 1)]]) == (3, "K" * 100_001 + "I")


@pytest.fixture(scope="module")
def talks(spark):
    """Conversations with nulls everywhere, ties, repeated rows, odd roles and a conversation with a third of all rows."""
    r = random.Random(8)
    texts = ["Yes.", "No!", "Why? ", "cut off", "", " \t", "a.\nb", "ends!\n", "ü…", None, "Yes.", "x" * 50 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "User", "assistante", None]
    rows = [(r.choice([None, *range(60)]), r.choice([None, *range(6), 9]), r.choice(roles), r.choice(texts)) for _ in range(500)]
    rows += [(77, i // 2, ["user", "assistant", "system"][i % 3 % (i % 5 + 1)], f"turn {i % 97}" + r.choice([".", ".", ""])) for i in range(300)]
    rows += [(78, 1, "user", "same.")] * 40 + [(79, 2, "user", ":")] * 2 + [(1000 + i, 0, "user", "Alone.") for i in range(40)]
    rows += [(-5, -9, "user", "Below."), (-5, 2**40, "assistant", "Far.")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_report_matches_sql(spark, talks, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(repair.report(talks, repair.damage(talks)), repair.OP11_SQL, conversations=talks)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_turns_are_whole(talks):
    """After the repair the roles of every conversation follow one another, and a second repair finds nothing to do."""
    turns = repair.Repair(talks).turns()
    told = turns.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "step", F.substring("role", 1, 1).alias("r")))).alias("rs")).collect()
    assert told and all(re.fullmatch("(s?(ua)+)?", "".join(x["r"] for x in row["rs"])) for row in told)


def test_empty_and_clashing(spark, talks):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.report(none, repair.damage(none)).count() == 0
    clash = talks.limit(60).withColumn("conv", F.lit("x")).withColumn("place", F.lit(1)).withColumn("copies", F.lit(2)).withColumn("harm", F.lit(0))
    same(repair.report(clash, repair.damage(clash)), repair.OP11_SQL, conversations=clash)


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word. " * 500_000), (1, 1, "assistant", "x" * 2_000_000 + " " * 100_000), (1, 2, "user", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    same(repair.report(docs, repair.damage(docs)), repair.OP11_SQL, conversations=docs)
