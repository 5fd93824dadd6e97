"""Statistics of catalogues and of allele calling results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.functions.sequence import error_category, missing_between
from locusflow.operators.classify import CLASSES, modes
from locusflow.operators.numbering import with_row_number

VALID = ("EXC", "INF")
INVALID = ("PLOT3", "PLOT5", "LOTSC", "NIPH", "NIPHEM", "ALM", "ASM", "PAMA")


def length_statistics(lengths: DataFrame, by: str = "locus", value: str = "length") -> DataFrame:
    """(by, n, min, max, mean, sd, q1, median, q3, size_range): mean rounded half to even, sd 0 for one value.

    q1 and q3 are the medians of the lower and upper floor(n/2) values.  Order statistics come from the counts of the
    distinct values, whose running sums tell where each place falls; a group's values are never gathered.
    """
    a = lengths.groupBy(by).agg(
        F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.bround(F.avg(value), 0).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd")
    )
    group = Window.partitionBy(by)
    counts = size_histogram(lengths.where(F.col(value).isNotNull()), by, value)
    placed = counts.select(by, value, F.sum("n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("end"), F.sum("n").over(group).alias("k"))
    k, half = F.col("k"), F.floor(F.col("k") / 2)
    at = lambda i: F.min(F.when(F.col("end") > i, F.col(value)))
    median = lambda first, n: F.bround(((at(first + F.floor((n - 1) / 2)) + at(first + F.floor(n / 2))) / 2).cast("double"), 0)
    of = {"q1": median(F.lit(0), half), "median": median(F.lit(0), k), "q3": median(k - half, half)}
    one = F.when(F.max("k") == 1, F.min(value).cast("double"))
    q = placed.groupBy(by).agg(*[F.coalesce(one, x).alias(name) for name, x in of.items()])
    both = a.alias("a").join(q.alias("q"), F.col(f"a.{by}").eqNullSafe(F.col(f"q.{by}")), "left")
    return both.select("a.*", "q1", "median", "q3", F.concat_ws("-", "min", "max").alias("size_range"))


def size_histogram(lengths: DataFrame, by: str = "locus", value: str = "length") -> DataFrame:
    return lengths.groupBy(by, value).agg(F.count("*").alias("n"))


def locus_statistics(alleles: DataFrame, minimum: int = 0, threshold: float = 0.2) -> DataFrame:
    """One row per locus of translated alleles (locus, allele_ord, allele_id, dna, protein, error).

    Invalid are those that do not translate; too short ones are counted apart and are not among them.
    """
    rows = alleles.withColumn("length", F.length("dna")).withColumn("category", error_category("error"))
    rows = rows.join(modes(rows), "locus")
    short = F.coalesce(F.col("error").startswith("sequence shorter"), F.lit(False))
    invalid = F.col("error").isNotNull() & ~short
    low, high = F.ceil(F.col("mode") * (1 - threshold)), F.floor(F.col("mode") * (1 + threshold))
    kinds = {"incomplete_orf": "Incomplete ORF", "ambiguous_bases": "Ambiguous Bases", "missing_start": "Missing Start Codon", "missing_stop": "Missing Stop Codon", "inframe_stop": "In-frame Stop Codon"}
    a = rows.groupBy("locus").agg(
        F.count("*").alias("total"), F.count_if(~invalid & ~short).alias("valid"), F.count_if(invalid).alias("invalid"), F.countDistinct("protein").alias("distinct_proteins"),
        *[F.count_if(F.col("category") == v).alias(k) for k, v in kinds.items()],
        F.count_if(short).alias("short"), F.count_if(F.col("length") < low).alias("below"), F.count_if(F.col("length") > high).alias("above"),
        F.first("mode").alias("mode"), F.array_sort(F.collect_set(F.col("allele_id").cast("int"))).alias("ids"),
    )
    return a.withColumn("proportion_valid", F.round(F.col("valid") / F.col("total"), 3)).withColumn("missing_ids", missing_between(F.col("ids"))).drop("ids")


def schema_totals(stats: DataFrame) -> DataFrame:
    cols = ("total", "valid", "invalid", "incomplete_orf", "ambiguous_bases", "missing_start", "missing_stop", "inframe_stop", "short", "below", "above")
    return stats.agg(F.count("*").alias("loci"), *[F.sum(c).alias(c) for c in cols])


def distinct_protein_alleles(alleles: DataFrame) -> DataFrame:
    """(locus, protein, n, allele_ids) of valid alleles."""
    g = alleles.where("error is null").groupBy("locus", "protein").agg(F.array_sort(F.collect_list(F.struct("allele_ord", "allele_id"))).alias("a"))
    return g.select("locus", "protein", F.size("a").alias("n"), F.array_join(F.transform("a", lambda x: x["allele_id"]), ", ").alias("allele_ids"))


def outside(values: DataFrame, threshold: float, above: bool = True, value: str = "value") -> DataFrame:
    return values.where(F.col(value) > threshold if above else F.col(value) < threshold)


def sample_statistics(cds: DataFrame, classes: DataFrame) -> DataFrame:
    """(FILE, contigs, cds, proportions...): ``cds`` (genome, contig), ``classes`` one count per class and sample."""
    per = cds.groupBy(F.col("genome").alias("FILE")).agg(F.countDistinct("contig").alias("total_contigs"), F.count("*").alias("total_cds"))
    total = sum((F.col(c) for c in CLASSES), F.lit(0))
    identified = total - F.col("LNF")
    valid, invalid = (sum((F.col(c) for c in group), F.lit(0)) for group in (VALID, INVALID))
    out = per.join(classes, "FILE")
    return out.select(
        "FILE", "total_contigs", "total_cds", F.round(identified / F.col("total_cds"), 3).alias("proportion_cds"), identified.alias("identified_loci"),
        F.round(identified / total, 3).alias("proportion_loci"), valid.alias("valid"), invalid.alias("invalid"), *CLASSES,
    )


def loci_statistics(classes: DataFrame, samples: int) -> DataFrame:
    """(locus, total_cds, valid, invalid, proportion_samples, classes...), most widespread loci first."""
    valid, invalid = (sum((F.col(c) for c in group), F.lit(0)) for group in (VALID, INVALID))
    total = [F.col("total_cds")] if "total_cds" in classes.columns else [(valid + invalid).alias("total_cds")]
    out = classes.select("locus", *total, valid.alias("valid"), invalid.alias("invalid"), F.round(valid / samples, 3).alias("proportion_samples"), *CLASSES)
    return out.orderBy(F.desc("proportion_samples"), "locus")


def summary(classes: DataFrame) -> DataFrame:
    return classes.agg(F.count("*").alias("total_loci"), *[F.sum(c).alias(c) for c in CLASSES])


def calls_per_sample(cells: DataFrame, samples: DataFrame, loci: DataFrame, invalid: DataFrame | None = None, totals: DataFrame | None = None, missing: str = "LNF") -> DataFrame:
    """(FILE, classes..., invalid_cds, classified_cds, total_cds): ``cells`` (FILE, locus, class, n)."""
    n_loci = loci.select("locus").distinct().agg(F.count("*").alias("n_loci"))
    counted = cells.groupBy("FILE").agg(*[F.count_if(F.col("class") == c).alias(c) for c in CLASSES if c != "LNF"], F.count("*").alias("found"), F.sum("n").alias("classified_cds"))
    out = samples.select("FILE").distinct().join(counted, "FILE", "left").join(F.broadcast(n_loci)).withColumn(missing, F.col("n_loci") - F.coalesce("found", F.lit(0)))
    for extra, name in ((invalid, "invalid_cds"), (totals, "total_cds")):
        out = out.withColumn(name, F.lit(0)) if extra is None else out.join(extra.select("FILE", F.col("n").alias(name)), "FILE", "left")
    return out.fillna(0).select("FILE", *[missing if c == "LNF" else c for c in CLASSES], "invalid_cds", "classified_cds", "total_cds")


def ambiguous_matches(matches: DataFrame, cells: DataFrame) -> DataFrame:
    """All matches of the cells that are neither found cleanly nor absent, numbered by locus, genome and order."""
    bad = cells.where(F.col("class").isin(*INVALID)).select("locus", "genome_ord", F.col("class").alias("locus_class"))
    out = with_row_number(matches.join(bad, ["locus", "genome_ord"]), "index", "locus", "genome_ord", "ord", "dna_hash")
    return out.select("index", "genome_ord", "locus", "locus_class", "dna_hash", F.col("class").alias("cds_class"))
