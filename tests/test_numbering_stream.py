import random

from pyspark.sql import functions as F

from locusflow.operators import classify
from locusflow.streaming import numbering


def cells_of(seed=5):
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.5 else r.choice("abc"), g, f"h{r.randrange(40)}") for g in range(60) for _ in range(6)]
    return rows + [("a", 3, None), (None, 3, "h1"), ("a", None, "h2")] + rows[:3]


ALLELES = [("hot", "h1", "1"), ("hot", "h2", "7"), ("hot", "h1", "9"), ("a", "h3", "1"), ("unused", "h1", "1")]


def run(spark, parts, tmp, stop_after=None):
    """Numbers of the parts as files that come one at a time; the stream is stopped and started anew after each trigger."""
    alleles = spark.createDataFrame(ALLELES, "locus string, dna_hash string, allele_id string")
    source = f"{tmp}/in"
    for part in parts:
        spark.createDataFrame(part, numbering.CELLS).coalesce(1).write.mode("append").parquet(source)
        q = numbering.number_incrementally(spark.readStream.schema(numbering.CELLS).parquet(source), alleles, f"{tmp}/out", f"{tmp}/ck")
        assert q.awaitTermination(120)
    return sorted(map(tuple, spark.read.schema(numbering.NUMBERED).parquet(f"{tmp}/out").collect()))


def test_batches_give_the_numbers_of_one(spark, tmp_path):
    rows = cells_of()
    order = lambda x: -1 if x[1] is None else x[1]
    cut = lambda lo, hi: [x for x in rows if lo <= order(x) < hi]
    one = run(spark, [rows], tmp_path / "one")
    three = run(spark, [cut(-1, 20), cut(20, 21), cut(21, 99)], tmp_path / "three")
    assert one == three and len(one) == len(rows) - 3
    # As the batch operator numbers them.
    cells = spark.createDataFrame([(x[0], x[1], "INF", x[2]) for x in rows if None not in x], "locus string, genome_ord long, class string, dna_hash string").distinct()
    alleles = spark.createDataFrame([(*x, i) for i, x in enumerate(ALLELES)], "locus string, dna_hash string, allele_id string, allele_ord int")
    want = classify.assign_ids(cells, alleles).select("locus", "genome_ord", "dna_hash", F.regexp_replace("cell", "^INF-", "").cast("long"), F.col("cell").startswith("INF-"))
    assert sorted(map(tuple, want.collect())) == sorted(set(one))


def test_empty_batches(spark, tmp_path):
    assert run(spark, [[], [("a", 1, "x")], []], tmp_path) == [("a", 1, "x", 2, True)]
