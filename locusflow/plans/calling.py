"""Allele calling in four modes, and the building and adaptation of catalogues."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.config import Config
from locusflow.functions.sequence import ID_REPLACEMENTS, replace_in_order, sequence_hash
from locusflow.functions.translate import translated
from locusflow.operators import classify, cluster, dedup, matching, search
from locusflow.runtime import Stage, bounded


@dataclass
class Calls:
    """What calling finds, in long form."""

    matches: DataFrame
    cells: DataFrame
    profiles: DataFrame
    novel: DataFrame
    invalid: DataFrame


class AlleleCaller:
    """Modes: 1 exact DNA; 2 and exact protein; 3 and clusters at a tenth above the ratio; 4 and representatives until dry.

    ``alleles``: locus, locus_idx, allele_ord, allele_id, is_local, dna.  ``representatives``: locus, allele_id, protein;
    the first valid allele of each locus if not given.
    """

    def __init__(self, alleles: DataFrame, representatives: DataFrame | None = None, config: Config = Config(), mode: int = 4):
        if mode not in (1, 2, 3, 4):
            raise ValueError("mode must be 1, 2, 3 or 4")
        self.spark, self.config, self.mode = alleles.sparkSession, config, mode
        self.stage = Stage(self.spark)
        coded = translated(alleles.withColumn("dna", F.upper("dna")), "dna", config.translation_table)
        hashed = coded.withColumn("dna_hash", sequence_hash("dna")).withColumn("prot_hash", sequence_hash("protein"))
        self.alleles = self.stage.write(hashed, "alleles")
        if representatives is None:
            first = F.struct("allele_ord", "allele_id", "protein")
            representatives = self.alleles.where("protein is not null").groupBy("locus").agg(F.min(first).alias("f")).select("locus", "f.allele_id", "f.protein")
        self.representatives = representatives

    def run(self, cds: DataFrame, tips: DataFrame | None = None, loci: DataFrame | None = None) -> Calls:
        """Call ``cds`` (genome, genome_ord, protid, dna); ``tips`` (genome_ord, dna_hash, contig_len, begin, end, strand)."""
        stage, c = self.stage, self.config
        distinct = stage.write(dedup.distinct_dna(cds), "distinct")
        occurring = stage.write(dedup.occurrences(cds), "occurrences")
        exact = stage.write(matching.dna_exact(occurring, self.alleles, loci), "exact")
        columns = ["locus", "genome_ord", "ord", "allele_id", "dna_hash", "class", "bsr"]
        found, invalid = [exact.select(*columns)], distinct.where("false").select("dna_hash", F.lit("").alias("error"))
        if self.mode > 1:
            rest = distinct.join(exact.select("dna_hash").distinct(), "dna_hash", "left_anti")
            coded = stage.write(translated(rest, "dna", c.translation_table, c.minimum_length), "translated")
            invalid = coded.where("error is not null").select("dna_hash", "error")
            good = coded.where("error is null").withColumn("prot_hash", sequence_hash("protein"))
            same = stage.write(matching.protein_exact(good, occurring, self.alleles, loci), "protein")
            found.append(same.select(*columns))
            if self.mode > 2:
                left = stage.write(good.join(same.select("dna_hash"), "dna_hash", "left_anti"), "left")
                found += [m.select(*columns) for m in self._inexact(left, occurring, tips, loci)]
        matches = found[0]
        for more in found[1:]:
            matches = matches.unionAll(more)
        matches = stage.write(matches, "matches")
        return self._finish(cds, matches, invalid, loci)

    def _inexact(self, left: DataFrame, occurring: DataFrame, tips: DataFrame | None, loci: DataFrame | None) -> list[DataFrame]:
        stage, c, found = self.stage, self.config, []
        lengths = self.alleles.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("allele_ord", F.length("dna").alias("n")))).alias("l"))
        lengths = lengths.select("locus", F.transform("l", lambda x: x["n"]).alias("lengths"))
        reps = self.representatives if loci is None else self.representatives.join(loci.select("locus"), "locus", "left_semi")
        reps = reps.select("locus", F.concat_ws("_", "locus", "allele_id").alias("id"), F.col("protein").alias("seq"))
        for k in itertools.count() if self.mode == 4 else range(1):
            proteins = dedup.distinct_proteins(left)
            level = c.bsr + 0.1 if k == 0 else c.bsr
            # The first round looks at clusters; later ones search all proteins that are left with the representatives.
            if k == 0:
                near = matching.shared_minimizers(proteins.select(F.col("prot_hash").alias("id"), F.col("protein").alias("seq")), reps.select("id", "seq"), c.clustering_sim, None)
                pairs = near.join(reps.select(F.col("id").alias("reference"), "locus", F.col("seq").alias("query_seq")), "reference").join(
                    proteins.select(F.col("prot_hash").alias("query"), F.col("protein").alias("target_seq")), "query"
                )
                pairs = pairs.select(F.col("reference").alias("query"), "locus", "query_seq", F.col("query").alias("target"), "target_seq")
                hits = matching.align_pairs(pairs.repartition("query", "target")).withColumn("slen", F.length("target_seq"))
            else:
                found_by = search.search(reps.select("id", "seq"), proteins.select(F.col("prot_hash").alias("id"), F.col("protein").alias("seq")), stage=stage)
                hits = found_by.join(reps.select(F.col("id").alias("query"), "locus", F.col("seq").alias("query_seq")), "query")
            scores = matching.self_scores(reps.select(F.col("id").alias("seqid"), F.col("seq").alias("protein")))
            rated = matching.filter_bsr(matching.best_hit(hits, order=("query",)), scores, level).withColumn("rep_nt", F.length("query_seq") * 3 + 3)
            each = matching.expand_matches(rated.withColumnRenamed("target", "prot_hash"), left, occurring, tips)
            kind = F.lit(None).cast("string")
            if tips is not None:
                t = F.col("tip")
                whole = (F.col("nt_start") <= 0) & (F.col("nt_end") >= F.col("rep_nt"))
                kind = F.when(t.isNotNull() & ~whole, classify.tip_class(F.col("rep_nt"), F.col("nt_start"), F.col("nt_end"), t["contig_len"], t["begin"], t["end"], t["strand"]))
            ready = each.select("locus", "genome_ord", "ord", F.col("query").alias("allele_id"), "dna_hash", "prot_hash", "bsr", "dna_length", kind.alias("tip_class"))
            done = stage.write(classify.classify_inexact(ready, lengths, c.size_threshold, c.bsr), f"inexact{k}")
            if done.isEmpty():
                break
            found.append(done)
            left = stage.write(left.join(done.select("dna_hash"), "dna_hash", "left_anti"), f"left{k}")
            fresh = done.where("candidate").select("locus", F.col("dna_hash").alias("id"), "prot_hash").distinct()
            fresh = fresh.join(proteins.select("prot_hash", F.col("protein").alias("seq")), "prot_hash").select("locus", "id", "seq")
            fresh = stage.write(self._new_representatives(fresh), f"reps{k}")
            if k == 0 and self.mode == 4:
                reps = stage.write(reps.unionByName(fresh), "all_reps")
            elif fresh.isEmpty():
                break
            else:
                reps = fresh
        return found

    def _new_representatives(self, fresh: DataFrame) -> DataFrame:
        """Candidates of a locus meet those with which they share a minimizer, and themselves."""
        pairs = cluster.near_pairs(fresh.select(F.col("locus").alias("group"), F.col("id").alias("seqid"), "seq"), 0.0)
        hits = matching.align_pairs(pairs.withColumnRenamed("group", "locus")).withColumn("q_len", F.length("query_seq"))
        kept = cluster.select_representatives(hits, fresh.select("locus", F.col("id").alias("seqid")), self.config.bsr)
        return kept.select("locus", F.col("seqid").alias("id")).join(fresh, ["locus", "id"])

    def _finish(self, cds: DataFrame, matches: DataFrame, invalid: DataFrame, loci: DataFrame | None) -> Calls:
        folded = classify.fold_classes(matches)
        valid_first = F.when(F.col("class").isin("EXC", "INF"), 0).otherwise(1)
        chosen = matches.groupBy("locus", "genome_ord").agg(F.min_by("dna_hash", F.struct(valid_first, "ord", "dna_hash")).alias("dna_hash"))
        cells = self.stage.write(classify.mark_paralogous(folded.join(chosen, ["locus", "genome_ord"])), "cells")
        ids = self.stage.write(classify.assign_ids(cells, self.alleles), "ids")
        genomes = cds.select("genome_ord", F.col("genome").alias("FILE")).distinct()
        wanted = (self.alleles if loci is None else self.alleles.join(loci.select("locus"), "locus", "left_semi")).groupBy("locus").agg(F.min("locus_idx").alias("locus_ord"))
        missing = "LNF" if self.mode == 4 else classify.PROBABLE_LNF
        cell = F.coalesce(ids.cell, cells["class"], F.lit(missing))
        profiles = (
            genomes.join(bounded(wanted)).join(cells.drop("dna_hash", "n"), ["locus", "genome_ord"], "left").join(ids.select("locus", "genome_ord", "cell"), ["locus", "genome_ord"], "left")
            .select("FILE", "genome_ord", "locus", "locus_ord", cell.alias("cell"))
        )
        novel = ids.where(F.col("cell").startswith("INF-")).join(dedup.distinct_dna(cds).select("dna_hash", "dna"), "dna_hash")
        novel = novel.select("locus", F.regexp_replace("cell", "^INF-", "").alias("allele_id"), "dna", "dna_hash")
        return Calls(matches, cells, profiles, novel, invalid)


def updated_catalogue(alleles: DataFrame, novel: DataFrame) -> DataFrame:
    """The catalogue with the novel alleles behind the known ones of their locus."""
    last = alleles.groupBy("locus").agg(F.max("allele_ord").alias("last"), F.first("locus_idx").alias("locus_idx"))
    number = F.row_number().over(Window.partitionBy("locus").orderBy(F.regexp_replace("allele_id", r"\*", "").cast("int")))
    fresh = novel.join(last, "locus").withColumn("allele_ord", F.col("last") + number).withColumn("is_local", F.col("allele_id").startswith("*"))
    return alleles.select("locus", "locus_idx", "allele_ord", "allele_id", "is_local", "dna").unionByName(fresh.select("locus", "locus_idx", "allele_ord", "allele_id", "is_local", "dna"))


def create_catalogue(cds: DataFrame, config: Config = Config()) -> DataFrame:
    """(locus, dna, protein): one locus for each distinct protein that clustering and elimination leave.

    ``cds``: genome, genome_ord, protid, seqid, dna.
    """
    stage = Stage(cds.sparkSession)
    distinct = dedup.distinct_dna(cds)
    coded = stage.write(translated(distinct, "dna", config.translation_table, config.minimum_length), "translated").where("error is null")
    prot = stage.write(coded.withColumn("prot_hash", sequence_hash("protein")).groupBy("prot_hash").agg(F.min_by(F.struct("rep", "dna", "protein"), "rep").alias("x")).select("x.*"), "proteins")
    prot = prot.withColumn("seqid", F.concat(F.col("rep.genome"), F.lit("-protein"), F.col("rep.protid")))
    seqs = prot.select("seqid", F.col("protein").alias("seq"))
    clusters = stage.write(cluster.greedy_clusters(seqs, config.clustering_sim), "clusters")
    near = clusters.where((F.col("similarity") >= config.representative_filter) & (F.col("representative") != F.col("member"))).select(F.col("member").alias("seqid"))
    kept = stage.write(cluster.prune_near_representative(clusters, config.representative_filter), "kept")
    within = cluster.prune_within(kept, seqs, config.intra_filter)
    kept = stage.write(kept.join(within, ["representative", "member"], "left_anti"), "pruned")
    lengths = prot.select("seqid", F.length("protein").alias("length"))
    members = kept.select(F.col("representative").alias("group"), F.col("member").alias("seqid")).join(seqs, "seqid")
    pairs = cluster.near_pairs(members, 0.0).withColumnRenamed("group", "cluster")
    first = stage.write(cluster.eliminate_by_bsr(matching.align_pairs(pairs), lengths, config.bsr), "first")
    gone = near.unionAll(within.select(F.col("member").alias("seqid"))).unionAll(first.select("seqid")).distinct()
    left = stage.write(seqs.join(gone, "seqid", "left_anti"), "survivors")
    last = cluster.eliminate_near(left, lengths, 0.1, config.bsr, stage)
    out = left.join(last.select("seqid"), "seqid", "left_anti").join(prot.select("seqid", "dna", "protein"), "seqid")
    return out.select(replace_in_order("seqid", ID_REPLACEMENTS).alias("locus"), "dna", "protein")


def adapt_catalogue(alleles: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """Valid alleles, representatives, invalid alleles and a summary of an external catalogue (locus, allele_ord, allele_id, dna)."""
    stage = Stage(alleles.sparkSession)
    coded = stage.write(translated(alleles, "dna", config.translation_table, config.minimum_length), "translated")
    good = coded.where("error is null")
    if config.size_threshold is not None:
        sized = classify.filter_by_modes(good.withColumn("length", F.length("coding_dna")), config.size_threshold)
        outliers = sized.where("outlier is not null").select("locus", "allele_id", F.col("outlier").alias("error"))
        good = sized.where("outlier is null").drop("length", "outlier")
    else:
        outliers = coded.where("false").select("locus", "allele_id", "error")
    good = stage.write(good, "good")
    prot = good.groupBy("locus", "protein").agg(F.min(F.struct("allele_ord", "allele_id")).alias("f"))
    reps = cluster.represent(prot.select("locus", F.col("f.allele_id").alias("seqid"), F.col("protein").alias("seq")), config.bsr)
    reps = stage.write(reps.select("locus", F.col("seqid").alias("allele_id")), "representatives")
    count = lambda df, name: df.groupBy("locus").agg(F.count("*").alias(name))
    summary = count(alleles, "total_alleles").join(count(good, "valid_alleles"), "locus", "left").join(count(reps, "number_representatives"), "locus", "left").fillna(0)
    invalid = coded.where("error is not null").select("locus", "allele_id", "error").unionAll(outliers)
    return {"alleles": good, "representatives": reps, "invalid": invalid, "summary": summary}
