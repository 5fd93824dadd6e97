"""Stored profiles and catalogue merges: JSON profiles by hash, configuration, synchronisation with a remote catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusflow.functions.sequence import sequence_hash


def profile_json(profiles: DataFrame) -> DataFrame:
    """(FILE, profile_id, profile): the profile as JSON without INF- and absent loci, keyed by its SHA-256."""
    cells = profiles.withColumn("cell", F.regexp_replace("cell", "^INF-", "")).where(~F.col("cell").isin("LNF", "PLNF"))
    g = cells.groupBy("FILE").agg(F.array_sort(F.collect_list(F.struct("locus", "cell"))).alias("kv"))
    text = F.to_json(F.map_from_entries("kv"))
    return g.select("FILE", sequence_hash(text).alias("profile_id"), text.alias("profile"))


def insert_new(existing: DataFrame, fresh: DataFrame, key: str = "profile_id") -> DataFrame:
    """The rows of ``fresh`` to append: keys that are not there yet, one row each."""
    return fresh.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def outdated(stored: DataFrame, locus: str, old: str) -> DataFrame:
    """Stored profiles that have an identifier at a locus."""
    return stored.where(F.get_json_object("profile", f"$['{locus}']") == old)


def replace_identifiers(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored profiles with identifiers replaced by ``changes`` (locus, old, new); profile_id stays as it was."""
    cells = stored.select("FILE", "profile_id", F.explode(F.from_json("profile", "map<string,string>")).alias("locus", "cell"))
    met = cells.join(changes, (cells.locus == changes.locus) & (cells.cell == changes.old), "left").select("FILE", "profile_id", cells.locus, F.coalesce("new", "cell").alias("cell"))
    g = met.groupBy("FILE", "profile_id").agg(F.array_sort(F.collect_list(F.struct("locus", "cell"))).alias("kv"))
    return g.select("FILE", "profile_id", F.to_json(F.map_from_entries("kv")).alias("profile"))


def write_config(spark: SparkSession, path: str, values: dict[str, list]) -> None:
    """Every value a parameter ever had, in order."""
    rows = [(k, i, str(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "param string, ord int, value string").coalesce(1).write.mode("overwrite").parquet(path)


def read_config(spark: SparkSession, path: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in spark.read.parquet(path).orderBy("param", "ord").collect():
        out.setdefault(r["param"], []).append(r["value"])
    return out


def synchronise(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(locus, dna, allele_id, is_local, old_id, status) of the merged catalogue; both sides are (locus, allele_id, is_local, dna).

    A sequence that the remote side has takes its identifier.  Local ones it has not keep theirs, but novel ones are
    numbered anew from the locus' highest, in the order of their numbers, and stay marked as novel.
    """
    key = sequence_hash(F.upper("dna"))
    l = local.select("locus", key.alias("h"), F.col("allele_id").alias("old_id"), F.col("is_local").alias("novel"), F.col("dna").alias("l_dna"))  # noqa: E741
    r = remote.select("locus", key.alias("h"), F.col("allele_id").alias("remote_id"), F.col("dna").alias("r_dna"))
    both = l.join(r, ["locus", "h"], "full")
    fixed = F.coalesce("remote_id", F.when(~F.col("novel"), F.col("old_id")))
    highest = F.coalesce(F.max(fixed.cast("int")).over(Window.partitionBy("locus")), F.lit(0))
    number = F.row_number().over(Window.partitionBy("locus", fixed.isNull()).orderBy(F.col("old_id").cast("int")))
    status = F.when(F.col("old_id").isNull(), "added").when(F.col("remote_id").isNull() & F.col("novel"), "renumbered").when(F.col("remote_id").isNull(), "kept").when(F.col("remote_id") != F.col("old_id"), "switched").otherwise("same")
    return both.select(
        "locus", F.coalesce("r_dna", "l_dna").alias("dna"), F.coalesce(fixed, (highest + number).cast("string")).alias("allele_id"), fixed.isNull().alias("is_local"), "old_id", status.alias("status")
    )


def upload_payload(alleles: DataFrame) -> DataFrame:
    """(locus, n, lengths, locus_hash) of valid alleles: what a server compares before it takes sequences."""
    rows = alleles.where("error is null").withColumn("h", sequence_hash("dna"))
    g = rows.groupBy("locus").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("h", F.length("dna").alias("length")))).alias("lengths"))
    return g.withColumn("locus_hash", sequence_hash(F.array_join(F.transform("lengths", lambda x: x["h"]), "")))


def species_statistics(schemas: DataFrame) -> DataFrame:
    """Totals of a server's schemas (species, schema, nr_loci, nr_alleles) by species."""
    return schemas.groupBy("species").agg(F.count("*").alias("schemas"), F.sum("nr_loci").alias("nr_loci"), F.sum("nr_alleles").alias("nr_alleles"))
