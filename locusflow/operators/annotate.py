"""Annotation of loci from proteomes and lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.functions.sequence import contains_any, header_field, header_product, sequence_hash

#: Parts of names that say nothing.
UNINFORMATIVE = ("uncharacterized", "hypothetical", "duf")


def proteome_terms(records: DataFrame) -> DataFrame:
    """``records`` (seqid, header) with product, gene name and species; not_found where the header has none."""
    return records.select("*", header_product("header").alias("product"), header_field("header", "GN").alias("gene"), header_field("header", "OS").alias("species"))


def informative_name(names: DataFrame, by: str = "prot_hash", name: str = "name", order: str = "ord") -> DataFrame:
    """(by, name): the first name that says something, else the first."""
    dull = contains_any(name, list(UNINFORMATIVE))
    return names.groupBy(by).agg(F.min_by(name, F.struct(dull.cast("int").alias("dull"), order)).alias(name))


def lookup_names(proteins: DataFrame, names: DataFrame) -> DataFrame:
    """(locus, name) by exact protein: ``proteins`` (locus, allele_ord, protein), ``names`` (protein, name, ord)."""
    keyed = names.withColumn("prot_hash", sequence_hash("protein")).drop("protein")
    best = informative_name(keyed)
    met = proteins.withColumn("prot_hash", sequence_hash("protein")).join(best, "prot_hash")
    return informative_name(met.select("locus", "name", F.col("allele_ord").alias("ord")), by="locus")


def proteome_annotations(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per locus of its ranked hits (locus, target, bsr, rank), fields of several hits joined by ;."""
    met = hits.join(terms.select(F.col("seqid").alias("target"), "product", "gene", "species"), "target")
    g = met.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("rank", "target", "product", "gene", "species", "bsr"))).alias("h"))
    joined = lambda f: F.array_join(F.transform("h", lambda x: x[f].cast("string")), ";").alias(f)
    return g.select("locus", joined("target"), joined("product"), joined("gene"), joined("species"), joined("bsr"))


def annotate(loci: DataFrame, *tables: DataFrame) -> DataFrame:
    """``loci`` with every column of the tables, empty text where a table has no row."""
    out = loci
    for t in tables:
        new = [c for c in t.columns if c != "locus"]
        out = out.join(t, "locus", "left").select(*out.columns, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in new])
    return out
