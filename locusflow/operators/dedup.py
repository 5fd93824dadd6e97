"""Exact deduplication with propagation to every genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.functions.sequence import sequence_hash


def distinct_dna(cds: DataFrame) -> DataFrame:
    """(dna_hash, dna, rep, n): distinct upper-cased sequences of ``cds`` (genome, genome_ord, protid, dna).

    ``rep`` is the first occurrence.  The others stay rows of their own, see occurrences(): a sequence that all genomes
    have is never one row with all of them.
    """
    upper = cds.withColumn("dna", F.upper("dna")).withColumn("dna_hash", sequence_hash("dna"))
    first = F.struct("genome_ord", "protid", "genome")
    return upper.groupBy("dna_hash").agg(
        F.first("dna").alias("dna"), F.min(first).alias("rep"), F.count("*").alias("n")
    )


def occurrences(cds: DataFrame) -> DataFrame:
    """(dna_hash, genome_ord, ord) of every coding sequence; ``ord`` is its place in the genome."""
    return cds.select(sequence_hash(F.upper("dna")).alias("dna_hash"), "genome_ord", F.col("protid").cast("int").alias("ord"))


def distinct_proteins(distinct: DataFrame) -> DataFrame:
    """(prot_hash, protein, rep, n): distinct proteins of distinct sequences (dna_hash, protein, rep), the first and their number."""
    hashed = distinct.withColumn("prot_hash", sequence_hash("protein"))
    return hashed.groupBy("prot_hash").agg(F.first("protein").alias("protein"), F.min("rep").alias("rep"), F.count("*").alias("n"))


def duplicate_groups(seqs: DataFrame, key: str = "seqid", value: str = "seq", order: str = "rec_ord") -> DataFrame:
    """(value, ids): the identifiers of each distinct value in input order."""
    pairs = F.array_sort(F.collect_list(F.struct(order, key)))
    return seqs.groupBy(value).agg(pairs.alias("p")).select(value, F.transform("p", lambda x: x[key]).alias("ids"))


def longest(seqs: DataFrame, by: str = "locus", key: str = "seqid", value: str = "seq") -> DataFrame:
    """(by, key, length): the longest sequence of each group, the first by ``key`` of those as long; a null sequence has length 0."""
    n = F.coalesce(F.length(value), F.lit(0))
    return seqs.groupBy(by).agg(F.min(F.struct((-n).alias("n"), F.col(key))).alias("x")).select(by, f"x.{key}", (-F.col("x.n")).alias("length"))


def propagate(distinct: DataFrame, cds: DataFrame) -> DataFrame:
    """Results on distinct sequences (dna_hash, ...) back on every coding sequence."""
    return cds.withColumn("dna_hash", sequence_hash(F.upper("dna"))).join(distinct, "dna_hash")


def invalid_counts(invalid: DataFrame, occurring: DataFrame) -> DataFrame:
    """(genome_ord, n): occurrences of invalid distinct sequences in each genome."""
    return occurring.join(invalid.select("dna_hash"), "dna_hash", "left_semi").groupBy("genome_ord").agg(F.count("*").alias("n"))
