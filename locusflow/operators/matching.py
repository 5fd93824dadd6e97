"""Matching distinct sequences to a catalogue: exact, by shared k-mers, by alignment score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.functions.align import local_alignment
from locusflow.functions.sequence import minimizers, self_score, sequence_hash
from locusflow.runtime import Stage, bounded, ship


def first_locus(alleles: DataFrame, key: str = "dna_hash") -> DataFrame:
    """One allele per hash: that of the lowest locus and place."""
    place = F.struct("locus_idx", "allele_ord")
    return alleles.groupBy(key).agg(F.min_by("locus", place).alias("locus"), F.min_by("allele_id", place).alias("allele_id"), F.min("locus_idx").alias("locus_idx"))


def dna_exact(occurring: DataFrame, alleles: DataFrame, loci: DataFrame | None = None) -> DataFrame:
    """(locus, genome_ord, ord, allele_id, dna_hash, class, bsr): every occurrence (dna_hash, genome_ord, ord) of a known sequence is EXC.

    The first locus of a hash is chosen before the restriction to the called ``loci``, so a shared allele whose first
    locus is not called is dropped, not given to another.
    """
    known = first_locus(alleles)
    if loci is not None:
        known = known.join(loci.select("locus"), "locus", "left_semi")
    hit = occurring.join(known.select("dna_hash", "locus", "allele_id"), "dna_hash")
    return hit.select("locus", "genome_ord", "ord", "allele_id", "dna_hash", F.lit("EXC").alias("class"), F.lit(1.0).alias("bsr"))


def protein_exact(distinct: DataFrame, occurring: DataFrame, alleles: DataFrame, loci: DataFrame | None = None) -> DataFrame:
    """As dna_exact, on prot_hash: the first occurrence of each distinct sequence (dna_hash, prot_hash, rep) is INF, the others EXC."""
    known = first_locus(alleles, "prot_hash")
    if loci is not None:
        known = known.join(loci.select("locus"), "locus", "left_semi")
    hit = distinct.select("dna_hash", "prot_hash", "rep").join(known.select("prot_hash", "locus", "allele_id"), "prot_hash").join(occurring, "dna_hash")
    first = (F.col("genome_ord") == F.col("rep.genome_ord")) & (F.col("ord") == F.col("rep.protid"))
    return hit.select("locus", "genome_ord", "ord", "allele_id", "dna_hash", F.when(first, "INF").otherwise("EXC").alias("class"), F.lit(1.0).alias("bsr"))


def expand_matches(hits: DataFrame, distinct: DataFrame, occurring: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """Protein hits (prot_hash, ...) on every occurrence of a sequence (dna_hash, prot_hash, dna) of the protein, with its
    contig-tip record if any."""
    each = hits.join(distinct.select("prot_hash", "dna_hash", F.length("dna").alias("dna_length")), "prot_hash")
    out = each.join(occurring, "dna_hash")
    if tips is None:
        return out
    first = tips.groupBy("genome_ord", "dna_hash").agg(F.min(F.struct("begin", "end", "contig_len", "strand")).alias("tip"))
    return out.join(first, ["genome_ord", "dna_hash"], "left")


def shared_minimizers(queries: DataFrame, references: DataFrame, threshold: float = 0.2, top: int | None = 30, k: int = 5, window: int = 5) -> DataFrame:
    """(query, reference, similarity, rank): share of a query's distinct minimizers that a reference has, best first.

    Both sides are (id, seq), with unlike ids.  A sequence without minimizers has no partners.  Ties rank by reference.
    ``top`` None keeps every partner, without a rank.  A word that all have brings no pairs together, if there are others,
    unless one word in common is enough.
    """
    stage = Stage(queries.sparkSession)
    q = stage.write(queries.select(F.col("id").alias("query"), minimizers("seq", k, window).alias("mine")), "queries")
    r = stage.write(references.select(F.col("id").alias("reference"), minimizers("seq", k, window).alias("theirs")), "references")
    words = r.select("reference", F.explode("theirs").alias("word"))
    n = F.size("mine")
    least = F.greatest(F.lit(1), F.ceil(n * threshold - 1e-9))
    # One word in common is enough of a query of few words, so all of its words are asked for, and counted as they are met.
    each = q.where(least <= 1).select("query", n.alias("n"), F.explode("mine").alias("word"))
    met = each.join(bounded(words), "word").groupBy("query", "n", "reference").agg(F.count("*").alias("shared"))
    sims = met.select("query", "reference", (F.col("shared") / F.col("n")).alias("similarity"))
    long = q.where(least > 1)
    if not long.isEmpty():
        # A reference that shares enough has one of the query's rarest words, as many as are left when the others would not do.
        asked = long.select("query", (n - least + 1).alias("most"), F.explode("mine").alias("word"))
        known = words.groupBy("word").agg(F.count("*").alias("rows"))
        rarest = F.row_number().over(Window.partitionBy("query").orderBy("rows", "word"))
        asked = asked.join(known, "word", "left").withColumn("place", rarest).where(F.col("place") <= F.col("most")).select("query", "word")
        pairs = asked.join(words, "word").select("query", "reference").distinct()
        share = F.size(F.array_intersect("mine", "theirs")) / n
        sims = sims.unionAll(pairs.join(long, "query").join(r, "reference").select("query", "reference", share.alias("similarity")))
    sims = sims.where(F.col("similarity") >= threshold)
    if top is None:
        return sims
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "reference"))
    return sims.withColumn("rank", rank).where(F.col("rank") <= top)


def align_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (query, query_seq, target, target_seq, ...) with the local alignment's score and query range.

    Distinct pairs are dealt evenly before Python aligns them.
    """
    ship(pairs.sparkSession)
    out = pairs.withColumn("_a", local_alignment("query_seq", "target_seq"))
    return out.select(*pairs.columns, F.col("_a.score").alias("score"), F.col("_a.qstart").alias("qstart"), F.col("_a.qend").alias("qend"))


def self_scores(proteins: DataFrame) -> DataFrame:
    """(seqid, nt_length, self_score): the length in nucleotides with the stop, and the score with itself."""
    return proteins.select("seqid", (F.length("protein") * 3 + 3).alias("nt_length"), self_score("protein").alias("self_score"))


def filter_bsr(hits: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Hits (query, target, qstart, qend, slen, score) whose score ratio reaches ``threshold``, in nucleotide coordinates."""
    rated = hits.join(scores.select(F.col("seqid").alias("query"), "self_score"), "query").withColumn("bsr", F.col("score") / F.col("self_score"))
    return rated.where(F.col("bsr") >= threshold).withColumns(
        {"nt_start": (F.col("qstart") - 1) * 3, "nt_end": F.col("qend") * 3 + 3, "target_nt": F.col("slen") * 3 + 3}
    )


def bsr_bands(hits: DataFrame, scores: DataFrame, low: float, high: float) -> DataFrame:
    """Hits that are neither with itself nor with a query, in bands: high from ``high``, low under ``low``, between else."""
    others = hits.where("query <> target").join(hits.select(F.col("query").alias("target")).distinct(), "target", "left_anti")
    rated = others.join(scores.select(F.col("seqid").alias("query"), "self_score"), "query").withColumn("bsr", F.col("score") / F.col("self_score"))
    return rated.withColumn("band", F.when(F.col("bsr") >= high, "high").when(F.col("bsr") < low, "low").otherwise("between"))


def best_hit(hits: DataFrame, by: tuple[str, ...] = ("locus", "target"), order: tuple[str, ...] = ("rep_ord",), compat: bool = False) -> DataFrame:
    """One hit per ``by``: the highest score, ties by ``order``; with ``compat`` the first by ``order`` alone."""
    keys = [*([] if compat else [F.desc("score")]), *order]
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where("_r = 1").drop("_r")


def top_hits(hits: DataFrame, scores: DataFrame, threshold: float, n: int) -> DataFrame:
    """The first ``n`` hits of each locus by score ratio in hundredths, at or above ``threshold``."""
    rated = hits.join(scores.select(F.col("seqid").alias("query"), "self_score"), "query").withColumn("bsr", F.bround(F.col("score") / F.col("self_score"), 2))
    rank = F.row_number().over(Window.partitionBy("locus").orderBy(F.desc("bsr"), "target"))
    return rated.where(F.col("bsr") >= threshold).withColumn("rank", rank).where(F.col("rank") <= n)


def hash_alleles(alleles: DataFrame) -> DataFrame:
    """``alleles`` with dna_hash of the upper-cased sequence and, where there is a protein, prot_hash."""
    out = alleles.withColumn("dna_hash", sequence_hash(F.upper("dna")))
    return out.withColumn("prot_hash", sequence_hash("protein")) if "protein" in alleles.columns else out
