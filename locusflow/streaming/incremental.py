"""Incremental exact calling: coding sequences that arrive are matched to a stored catalogue, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from locusflow.functions.sequence import sequence_hash
from locusflow.operators.matching import first_locus, hash_alleles

CDS = "genome string, genome_ord int, protid int, dna string"


def read_cds_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(CDS).parquet(folder)


def exact_stream(cds: DataFrame, alleles: DataFrame) -> DataFrame:
    """Stream-static join: each arriving sequence with its locus and allele; stateless, so nothing is kept."""
    known = first_locus(hash_alleles(alleles)).select("dna_hash", "locus", "allele_id")
    return cds.withColumn("dna_hash", sequence_hash(F.upper("dna"))).join(known, "dna_hash").select("genome", "genome_ord", "protid", "locus", "allele_id", "dna_hash")


def call_incrementally(cds: DataFrame, alleles: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the calls of each batch under its number: a batch that is run again replaces what it wrote."""
    calls = exact_stream(cds, alleles)

    def sink(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["genome", "protid"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return calls.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
