"""Typing inputs derived from general tables, so that every operator runs at any scale of them.

Profiles: a supplier is a sample, a part modulo 50 a locus, the number of their lineitems the allele.  Event profiles: a
user is a sample, an event type a locus.  Sequences: digits of a digest read as bases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.runtime import Stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("FILE"), (F.col("l_partkey") % 50).alias("locus")).agg(F.count("*").alias("n"))
    n = F.col("n").cast("string")
    cell = (
        F.when((F.col("FILE") * 31 + F.col("locus") * 17) % 100 < F.col("locus"), "LNF")
        .when(F.col("n") % 5 == 0, F.concat(F.lit("INF-"), n))
        .when(F.col("n") % 3 == 0, F.concat(F.lit("INF-*"), n))
        .otherwise(n)
    )
    return g.select("FILE", "locus", cell.alias("cell"))


PROF_LI = """prof AS (
  SELECT l_suppkey AS FILE, l_partkey % 50 AS locus, count(*) AS n FROM lineitem GROUP BY 1, 2),
p AS (
  SELECT FILE, locus, CASE WHEN (FILE * 31 + locus * 17) % 100 < locus THEN 'LNF' WHEN n % 5 = 0 THEN 'INF-' || n
         WHEN n % 3 = 0 THEN 'INF-*' || n ELSE CAST(n AS VARCHAR) END AS cell FROM prof)"""


def event_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("FILE"), F.col("event_type").alias("locus")).agg(F.count("*").alias("n"))
    return g.select("FILE", "locus", F.when(F.col("n") % 7 == 0, "LNF").when(F.col("n") % 3 == 0, F.concat(F.lit("INF-"), F.col("n"))).otherwise(F.col("n").cast("string")).alias("cell"))


PROF_EV = """prof AS (
  SELECT user_id AS FILE, event_type AS locus, count(*) AS n FROM events GROUP BY 1, 2),
p AS (
  SELECT FILE, locus, CASE WHEN n % 7 = 0 THEN 'LNF' WHEN n % 3 = 0 THEN 'INF-' || n ELSE CAST(n AS VARCHAR) END AS cell FROM prof)"""

MASK = r"regexp_replace(regexp_replace(regexp_replace(cell, 'INF-', '', 'g'), '\*', '', 'g'), '\D+.*', '0', 'g')"
PRESENT = f"CASE WHEN TRY_CAST({MASK} AS BIGINT) > 0 THEN 1 ELSE 0 END"


def bases(text: Column) -> Column:
    """64 bases from the SHA-256 of a text."""
    return F.translate(F.upper(F.sha2(text.cast("binary"), 256)), "0123456789ABCDEF", "ACGTACGTACGTACGT")


BASES = "translate(upper(sha256({})), '0123456789ABCDEF', 'ACGTACGTACGTACGT')"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as hits: a supplier is the query, a part the target, the price the score."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("target"), (F.col("l_partkey") % 50).alias("locus"), F.col("l_extendedprice").alias("score"),
        F.col("l_orderkey").alias("rep_ord"), F.col("l_linenumber").alias("line"), F.lit(1).alias("qstart"), F.col("l_quantity").cast("int").alias("qend"), F.col("l_quantity").cast("int").alias("slen"),
    )


def order_cds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as coding sequences: a customer is a genome; priority and status make the sequence."""
    dna = F.concat(F.lit("ATG"), F.substring(bases(F.concat("o_orderpriority", "o_orderstatus")), 1, 30), F.lit("TAA"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("genome"), F.col("o_custkey").cast("int").alias("genome_ord"), F.col("o_orderkey").cast("int").alias("protid"), dna.alias("dna"), "o_orderpriority", "o_orderstatus"
    )


def order_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue for them: a priority is a locus, the statuses F and O are its alleles; P is not known."""
    known = order_cds(spark, sf_dir).where("o_orderstatus in ('F', 'O')").select("o_orderpriority", "o_orderstatus", "dna").distinct()
    place = F.when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    return known.select(
        F.col("o_orderpriority").alias("locus"), F.substring("o_orderpriority", 1, 1).cast("int").alias("locus_idx"), place.alias("allele_ord"), place.cast("string").alias("allele_id"), F.lit(False).alias("is_local"), "dna"
    )


def supplier_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as genes without stops in frame: those of a nation are variants of one; five to a genome."""
    coding = lambda text: F.translate(F.upper(F.sha2(text.cast("binary"), 256)), "0123456789ABCDEF", "ACGCAGGCCAGAGCCA")
    family = F.substring(F.concat(*[coding(F.concat("s_nationkey", F.lit(f"-{k}"))) for k in range(4)]), 1, 255)
    variant = F.overlay(family, F.element_at(F.array(F.lit("GCC"), F.lit("ACC"), F.lit("CAC"), F.lit("GAC")), (F.col("s_suppkey") % 4 + 1).cast("int")), (F.col("s_suppkey") % 60 * 3 + 10).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("g"), F.floor(F.col("s_suppkey") / 5)).alias("genome"), F.floor(F.col("s_suppkey") / 5).cast("int").alias("genome_ord"), F.col("s_suppkey").cast("int").alias("protid"),
        F.concat(F.lit("g"), F.floor(F.col("s_suppkey") / 5), F.lit("-protein"), "s_suppkey").alias("seqid"),
        F.concat(F.lit("n"), "s_nationkey").alias("locus"), F.col("s_nationkey").alias("locus_idx"), F.concat(F.lit("ATG"), variant, F.lit("TAA")).alias("dna"),
    )


_FAMILY = "substr(" + " || ".join(f"translate(upper(sha256(s_nationkey || '-{k}')), '0123456789ABCDEF', 'ACGCAGGCCAGAGCCA')" for k in range(4)) + ", 1, 255)"
GENES = f"""genes AS (
  SELECT 'n' || s_nationkey AS locus, 'ATG' || substr(f, 1, pos - 1) || v || substr(f, pos + 3) || 'TAA' AS dna FROM (
    SELECT s_nationkey, {_FAMILY} AS f, s_suppkey % 60 * 3 + 10 AS pos, ['GCC', 'ACC', 'CAC', 'GAC'][s_suppkey % 4 + 1] AS v FROM supplier))"""


_RESIDUES = "ARNDCQEGHILKMFPS"


def part_proteins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(id, seq) of proteins: one of each brand, and one of each part, which keeps about three quarters of its brand's residues."""
    letters = lambda name, text: F.translate(F.upper(F.concat(*[F.sha2(F.concat(F.lit(f"{name}{k}-"), text).cast("binary"), 256) for k in range(2)])), "0123456789ABCDEF", _RESIDUES)
    # Dealt anew, as a short table is one small file and its sequences are all the work.
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    part = part.repartition(max(2 * spark.sparkContext.defaultParallelism, part.rdd.getNumPartitions()), "p_partkey")
    heads = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id")).distinct().withColumn("seq", letters("brand", F.col("id")))
    # Each text is made and split once: inside the function of a residue it would be made anew for every residue.
    split = lambda name, text: F.split(F.coalesce(letters(name, text), F.lit("")), "")
    key = F.col("p_partkey").cast("string")
    changed = F.zip_with(split("pick", key), F.arrays_zip(split("own", key), split("brand", F.col("p_brand"))), lambda p, x: F.when(p.isin("A", "R", "N", "D"), x["0"]).otherwise(x["1"]))
    each = part.select(F.col("p_partkey").alias("id"), F.array_join(changed, "").alias("seq"))
    # Written, as what is made from a sequence would else repeat its expression for every residue.
    stage = Stage(spark)
    return stage.write(heads, "heads"), stage.write(each, "parts")


def _letters(name: str, text: str) -> str:
    return "translate(upper(" + " || ".join(f"sha256('{name}{k}-' || {text})" for k in range(2)) + f"), '0123456789ABCDEF', '{_RESIDUES}')"


PROTEINS = f"""heads AS (SELECT id, {_letters('brand', 'id')} AS seq FROM (SELECT DISTINCT p_brand AS id FROM part)),
parts AS (
  SELECT id, array_to_string(list_transform(range(1, 129), lambda i: CASE WHEN substr(pick, i, 1) IN ('A', 'R', 'N', 'D') THEN substr(own, i, 1) ELSE substr(base, i, 1) END), '') AS seq
  FROM (SELECT p_partkey AS id, {_letters('brand', 'p_brand')} AS base, {_letters('own', 'p_partkey')} AS own, {_letters('pick', 'p_partkey')} AS pick FROM part))"""


def supplier_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their catalogue: all variants of a nation's gene, in the order of their first supplier."""
    from pyspark.sql import Window

    first = supplier_genes(spark, sf_dir).groupBy("locus", "locus_idx", "dna").agg(F.min("protid").alias("first"))
    place = F.row_number().over(Window.partitionBy("locus").orderBy("first"))
    return first.select("locus", "locus_idx", place.alias("allele_ord"), place.cast("string").alias("allele_id"), F.lit(False).alias("is_local"), "dna")


def nation_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(genome, rec_ord, seqid, seq): regions of odd and of even keys are two genomes, a nation with suppliers is a contig, a supplier a gene between stretches of noise.

    A gene is 200 codons of few kinds between a start and a stop; those of odd suppliers lie on the other strand.
    """
    hexes = lambda name, n: F.upper(F.concat(*[F.sha2(F.concat(F.lit(f"{name}{k}-"), F.col("s_suppkey").cast("string")).cast("binary"), 256) for k in range(n)]))
    codon = F.transform(F.split(F.substring(hexes("gene", 4), 1, 200), ""), lambda c: F.get(F.array(*map(F.lit, _CODONS)), F.instr(F.lit("0123456789ABCDEF"), c) - 1))
    dna = F.concat(F.lit("ATG"), F.array_join(codon, ""), F.lit("TAA"))
    placed = F.when(F.col("s_suppkey") % 2 == 1, F.reverse(F.translate(dna, "ACGT", "TGCA"))).otherwise(dna)
    noise = F.translate(hexes("noise", 5), "0123456789ABCDEF", "ACGTTGCAGTACCATG")
    genes = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    each = genes.select("n_regionkey", "n_nationkey", "s_suppkey", F.concat(F.lit(_WALL), noise, F.lit(_WALL), placed).alias("x"))
    whole = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "x"))), lambda r: r["x"]), ""), F.lit(_WALL))
    contigs = each.groupBy("n_regionkey", "n_nationkey").agg(whole.alias("seq"))
    named = contigs.select(F.concat(F.lit("r"), F.col("n_regionkey") % 2).alias("genome"), F.col("n_nationkey").cast("long").alias("rec_ord"), F.concat(F.lit("n"), "n_nationkey").alias("seqid"), "seq")
    return Stage(spark).write(named, "contigs")


_CODONS = "CTG GCG GAA AAA GGC ATC GTG AAC CAG ACC CGC GAT TTC CCG TAC AGC".split()
#: Stops in all six frames.
_WALL = "TTAATTAATTAACTAGCTAGCTAG"

#: Where the genes lie: noise of 320 bases between two walls, then the gene.
PLANTED = f"""planted AS (
  SELECT 'r' || (n_regionkey % 2) AS genome, 'n' || n_nationkey AS contig,
         (row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1) * {2 * len(_WALL) + 320 + 606} + {2 * len(_WALL) + 320} AS begin,
         CASE WHEN s_suppkey % 2 = 1 THEN -1 ELSE 1 END AS strand
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def brand_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(locus, FILE, seq): the proteins of the parts; a brand is a locus, a part a sample.  Every third lacks a stretch of its own."""
    _, parts = part_proteins(spark, sf_dir)
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("locus"))
    at = (F.col("id") % 90 + 1).cast("int")
    cut = F.concat(F.substr("seq", F.lit(1), at), F.substr("seq", at + 7))
    named = parts.join(brands, "id").select("locus", F.col("id").cast("string").alias("FILE"), F.when(F.col("id") % 3 == 0, cut).otherwise(F.col("seq")).alias("seq"))
    return Stage(spark).write(named, "brand_proteins")
