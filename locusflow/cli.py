"""Command line: one sub-command per module; thin, as everything it does is in the package."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow import __version__
from locusflow.config import Config
from locusflow.functions.sequence import sequence_hash
from locusflow.functions.translate import translated
from locusflow.operators import annotate, classify, dedup, evaluate, genes, profiles, store, tree
from locusflow.operators.numbering import with_row_number
from locusflow.plans import calling
from locusflow.runtime import Stage
from locusflow.sources import database, fasta, remote, sinks

MODULES = {
    "CreateSchema": "build a catalogue from coding sequences",
    "AlleleCall": "call alleles of coding sequences",
    "SchemaEvaluator": "statistics of a catalogue",
    "AlleleCallEvaluator": "statistics of results",
    "ExtractCgMLST": "core loci of profiles",
    "RemoveGenes": "drop or keep loci of a profile matrix",
    "JoinProfiles": "join profile matrices",
    "PrepExternalSchema": "adapt an external catalogue",
    "UniprotFinder": "annotate loci from proteomes",
    "DownloadSchema": "alleles of a server's dump as of a date",
    "LoadSchema": "what a server needs to take a catalogue",
    "SyncSchema": "merge a catalogue with a server's dump",
    "NSStats": "totals of a server's dump",
}


def _spark() -> SparkSession:
    return SparkSession.builder.appName("locusflow").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser(name: str) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=f"locusflow {name}", description=MODULES[name])
    p.add_argument("-i", "--input", required=True, nargs="+")
    p.add_argument("-o", "--output", required=True)
    if name in ("AlleleCall", "AlleleCallEvaluator", "UniprotFinder", "SyncSchema"):
        p.add_argument("-g", "--schema-directory", required=True)
    if name in ("AlleleCall", "CreateSchema", "PrepExternalSchema"):
        p.add_argument("--bsr", type=float, default=0.6)
        p.add_argument("--l", "--minimum-length", dest="minimum_length", type=int, default=201 if name != "PrepExternalSchema" else 0)
        p.add_argument("--t", "--translation-table", dest="translation_table", type=int, default=11)
        p.add_argument("--st", "--size-threshold", dest="size_threshold", type=float, default=0.2 if name != "PrepExternalSchema" else None)
    if name in ("AlleleCall", "CreateSchema"):
        p.add_argument("--cds", "--cds-input", dest="cds_input", action="store_true", help="files hold coding sequences; no genes are predicted")
    if name == "AlleleCall":
        p.add_argument("--profile-database", help="SQLite file that takes the profiles")
        p.add_argument("--mode", type=int, choices=(1, 2, 3, 4), default=4)
        p.add_argument("--gl", "--genes-list", dest="genes_list")
        p.add_argument("--no-inferred", action="store_true")
        p.add_argument("--hash-profiles")
        p.add_argument("--output-unclassified", action="store_true")
        p.add_argument("--output-missing", action="store_true")
        p.add_argument("--output-novel", action="store_true")
    if name == "ExtractCgMLST":
        p.add_argument("--t", "--threshold", dest="threshold", type=float, nargs="+", default=[0.95, 0.99, 1.0])
        p.add_argument("--s", "--step", dest="step", type=int, default=1)
        p.add_argument("--r", "--genes2remove", dest="genes")
        p.add_argument("--g", "--genomes2remove", dest="genomes")
    if name == "RemoveGenes":
        p.add_argument("--gl", "--genes-list", dest="genes_list", required=True)
        p.add_argument("--inverse", action="store_true")
    if name == "JoinProfiles":
        p.add_argument("--common", action="store_true")
    if name == "DownloadSchema":
        p.add_argument("--date", required=True)
    if name == "UniprotFinder":
        p.add_argument("--pm", "--proteome-matches", dest="matches", type=int, default=1)
        p.add_argument("--bsr", type=float, default=0.6)
        p.add_argument("--sparql", help="endpoint that is asked for names by exact protein")
    if name == "LoadSchema":
        p.add_argument("--url", help="server that takes the payload in batches")
    return p


def _config(a: argparse.Namespace) -> Config:
    return Config(bsr=a.bsr, translation_table=a.translation_table, minimum_length=a.minimum_length, size_threshold=a.size_threshold)


def _listed(spark: SparkSession, path: str, name: str) -> DataFrame:
    first = F.element_at(F.split("value", "\t"), 1)
    return spark.read.text(path).select(fasta.basename(first).alias(name) if name == "locus" else first.alias(name)).where(F.col(name) != "")


def _cds(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Coding sequences of the files, as they are or of the genes predicted in their contigs, which then have places."""
    records = fasta.read_fasta(spark, a.input, upper=True)
    if a.cds_input:
        seqs, place = fasta.rename_cds(records).withColumnRenamed("seq", "dna"), []
    else:
        contigs = records.select(fasta.genome_of("source").alias("genome"), "rec_ord", "seqid", "seq")
        seqs = genes.predict(contigs, a.translation_table).withColumn("seqid", F.concat("genome", F.lit("-protein"), "protid"))
        place = ["contig", "contig_len", "begin", "end", "strand"]
    names = seqs.select("genome").distinct().withColumn("_low", F.lower("genome"))
    order = with_row_number(names, "genome_ord", "_low", "genome").select("genome", F.col("genome_ord").cast("int"))
    out = seqs.join(order, "genome").select("genome", "genome_ord", F.col("protid").cast("int").alias("protid"), "seqid", "dna", *place)
    return Stage(spark).write(out.withColumn("dna_hash", sequence_hash(F.upper("dna"))), "cds")


#: What a server's pages hold.
ALLELES = "locus string, allele_id string, is_local boolean, dna string, inserted_at timestamp"
SCHEMAS = "species string, schema string, nr_loci long, nr_alleles long"


def _remote(paths: list[str]) -> bool:
    return len(paths) == 1 and paths[0].startswith(("http://", "https://"))


def _dump(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A server's alleles: from its pages if the only path is an address, else from Parquet."""
    return remote.read_pages(spark, paths[0], ALLELES, ("locus", "allele_id")) if _remote(paths) else spark.read.parquet(*paths)


def _wide(long: DataFrame, path: str, value: str = "cell", missing: str = "") -> None:
    sinks.write_matrix(long, path, single=True, value=value, missing=missing)


def create_schema(spark, a):
    out = calling.create_catalogue(_cds(spark, a), _config(a))
    sinks.write_fasta(out.select("locus", F.concat("locus", F.lit("_1")).alias("seqid"), F.col("dna").alias("seq")), f"{a.output}/schema_seed", by="locus")
    store.write_config(spark, f"{a.output}/config", {"bsr": [a.bsr], "translation_table": [a.translation_table], "minimum_locus_length": [0], "size_threshold": [a.size_threshold]})


def allele_call(spark, a):
    alleles, cds = fasta.read_alleles(spark, f"{a.schema_directory}/*.fasta"), _cds(spark, a)
    loci = _listed(spark, a.genes_list, "locus") if a.genes_list else None
    caller = calling.AlleleCaller(alleles, config=_config(a), mode=a.mode)
    tips = None if a.cds_input else classify.tips(cds).select("genome_ord", "dna_hash", "contig_len", "begin", "end", "strand")
    calls = caller.run(cds, tips, loci)
    ordered = calls.profiles.withColumnRenamed("genome_ord", "FILE_ord")
    _wide(ordered, f"{a.output}/results_alleles")
    genomes = cds.select("genome_ord", F.col("genome").alias("FILE")).distinct()
    cells = calls.cells.join(genomes, "genome_ord")
    found = classify.coordinate_cells(calls.cells, cds).withColumnRenamed("genome_ord", "FILE_ord").withColumnRenamed("cell", "place")
    placed = ordered.join(found, ["locus", "FILE_ord"], "left").withColumn("cell", F.coalesce("place", "cell"))
    _wide(placed, f"{a.output}/results_contigsInfo")
    invalid = dedup.invalid_counts(calls.invalid, dedup.occurrences(cds)).join(genomes, "genome_ord")
    shared = classify.paralog_groups(calls.cells).join(genomes, "genome_ord").join(classify.places(cds), ["genome_ord", "dna_hash"])
    shared = shared.select(F.col("FILE").alias("Genome"), F.col("loci").alias("Loci"), F.col("place").alias("CDS"))
    sinks.write_table(shared, f"{a.output}/paralogous_loci", single=True)
    totals = cds.groupBy(F.col("genome").alias("FILE")).agg(F.count("*").alias("n"))
    missing = "LNF" if a.mode == 4 else classify.PROBABLE_LNF
    sinks.write_table(evaluate.calls_per_sample(cells, calls.profiles, calls.profiles, invalid, totals, missing), f"{a.output}/results_statistics", single=True)
    matched = calls.cells.groupBy("locus").agg(F.sum("n").alias("Total_CDS"))
    per_locus = profiles.locus_classes(calls.profiles, classify.CLASSES).join(matched, "locus", "left").fillna(0, ["Total_CDS"])
    sinks.write_table(per_locus, f"{a.output}/loci_summary_stats", single=True)
    sinks.write_table(classify.paralog_counts(calls.cells), f"{a.output}/paralogous_counts", single=True)
    sinks.write_table(calls.invalid, f"{a.output}/invalid_cds", single=True)
    if a.output_missing:
        sinks.write_table(evaluate.ambiguous_matches(calls.matches, calls.cells), f"{a.output}/missing_classes", single=True)
    if a.output_novel:
        sinks.write_fasta(calls.novel.select(F.concat_ws("_", "locus", "allele_id").alias("seqid"), F.col("dna").alias("seq")), f"{a.output}/novel_alleles")
    if a.output_unclassified:
        rest = cds.join(calls.matches.select("dna_hash"), "dna_hash", "left_anti")
        sinks.write_fasta(rest.select("seqid", F.col("dna").alias("seq")), f"{a.output}/unclassified_sequences")
    if a.hash_profiles:
        known = calling.updated_catalogue(alleles, calls.novel)
        _wide(profiles.hashed(calls.profiles.select("FILE", "locus", "cell"), known, a.hash_profiles), f"{a.output}/results_alleles_hashed")
    if a.profile_database:
        database.store_profiles(calls.profiles.select("FILE", "locus", "cell"), a.profile_database, datetime.now(UTC).isoformat(timespec="seconds"))
    if not a.no_inferred:
        calling.updated_catalogue(alleles, calls.novel).write.mode("error").parquet(f"{a.output}/updated_catalogue")


def schema_evaluator(spark, a):
    coded = translated(fasta.read_alleles(spark, a.input))
    stats = evaluate.locus_statistics(coded)
    lengths = evaluate.length_statistics(coded.withColumn("length", F.length("dna")))
    tables = {"summary": evaluate.schema_totals(stats), "loci": stats, "lengths": lengths}
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{a.output}/{name}")
    sinks.report({"summaryData": tables["summary"]}, f"{a.output}/schema_report.html", "Schema report")


def allele_call_evaluator(spark, a):
    p = fasta.read_profiles(spark, a.input[0])
    present = profiles.presence(p)
    core = profiles.core_loci(present, 1.0)
    _wide(profiles.masked(p), f"{a.output}/masked_profiles")
    _wide(present.join(p.select("locus", "locus_ord").distinct(), "locus"), f"{a.output}/presence_absence", "present", "0")
    _wide(profiles.masked(p.join(core, "locus", "left_semi")), f"{a.output}/cgMLST_profiles")
    upper = Stage(spark).write(profiles.blocked_distances(p), "distances")
    text = tree.newick(tree.tree_edges(upper))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{a.output}/tree")
    dist = profiles.symmetrical(upper)
    _wide(dist.select(F.col("a").alias("FILE"), F.col("b").alias("locus"), F.col("distance").alias("cell")), f"{a.output}/distance_matrix_symmetric")
    sinks.report({"lociStats": evaluate.summary(profiles.locus_classes(p, classify.CLASSES))}, f"{a.output}/allelecall_report.html", "Allele call report")


def extract_cgmlst(spark, a):
    p = fasta.read_profiles(spark, a.input[0])
    if a.genes:
        p = profiles.select_loci(p, _listed(spark, a.genes, "locus"))
    if a.genomes:
        p = profiles.drop_samples(p, _listed(spark, a.genomes, "FILE"))
    present = profiles.presence(p)
    _wide(present.join(p.select("locus", "locus_ord").distinct(), "locus"), f"{a.output}/presence_absence", "present", "0")
    sinks.write_table(profiles.missing_data(present).orderBy("missing", "FILE"), f"{a.output}/missing_loci_stats", single=True)
    for t in a.threshold:
        core = profiles.core_loci(present, t)
        _wide(profiles.masked(p.join(core, "locus", "left_semi")), f"{a.output}/cgMLST{round(t * 100)}")
        core.select(F.col("locus").alias("value")).orderBy("value").coalesce(1).write.text(f"{a.output}/cgMLSTschema{round(t * 100)}")
    sinks.write_table(profiles.core_curves(present, tuple(a.threshold), a.step).orderBy("threshold", "rank"), f"{a.output}/curves", single=True)


def remove_genes(spark, a):
    wide = fasta.read_table(spark, a.input[0])
    loci = [r["locus"] for r in _listed(spark, a.genes_list, "locus").collect()]
    sinks.write_table(profiles.select_wide(wide, loci, a.inverse), a.output, single=True)


def join_profiles(spark, a):
    sinks.write_table(profiles.join_wide([fasta.read_table(spark, p) for p in a.input], a.common), a.output, single=True)


def prep_external_schema(spark, a):
    done = calling.adapt_catalogue(fasta.read_alleles(spark, a.input), _config(a))
    named = done["alleles"].withColumn("seqid", F.concat_ws("_", "locus", "allele_id"))
    sinks.write_fasta(named.select("locus", "seqid", F.col("coding_dna").alias("seq")), f"{a.output}/schema", by="locus")
    short = named.join(done["representatives"], ["locus", "allele_id"], "left_semi")
    sinks.write_fasta(short.select("locus", "seqid", F.col("coding_dna").alias("seq")), f"{a.output}/short", by="locus")
    sinks.write_table(done["summary"], f"{a.output}/summary_stats", single=True)
    sinks.write_table(done["invalid"], f"{a.output}/invalid_alleles", single=True)


def uniprot_finder(spark, a):
    from locusflow.operators import matching

    coded = translated(fasta.read_alleles(spark, f"{a.schema_directory}/*.fasta")).where("error is null")
    reps = coded.groupBy("locus").agg(F.min_by("protein", "allele_ord").alias("seq"))
    records = fasta.read_fasta(spark, a.input)
    near = matching.shared_minimizers(reps.select(F.col("locus").alias("id"), "seq"), records.select(F.col("seqid").alias("id"), "seq"))
    pairs = near.join(reps.select(F.col("locus").alias("query"), F.col("seq").alias("query_seq")), "query").join(records.select(F.col("seqid").alias("reference"), F.col("seq").alias("target_seq")), "reference")
    hits = matching.align_pairs(pairs.select(F.col("query").alias("locus"), "query", "query_seq", F.col("reference").alias("target"), "target_seq"))
    scores = matching.self_scores(reps.select(F.col("locus").alias("seqid"), F.col("seq").alias("protein")))
    found = annotate.proteome_annotations(matching.top_hits(hits, scores, a.bsr, a.matches), annotate.proteome_terms(records))
    tables = [found]
    if a.sparql:
        names, failed = remote.remote_names(coded.select(F.concat_ws("_", "locus", "allele_ord").alias("id"), "protein"), a.sparql)
        by_locus = coded.select("locus", "allele_ord", F.concat_ws("_", "locus", "allele_ord").alias("id")).join(annotate.informative_name(names, by="id"), "id")
        tables.append(annotate.informative_name(by_locus, by="locus", order="allele_ord").withColumnRenamed("name", "remote_name"))
        sinks.write_table(failed, f"{a.output}/failed_queries", single=True)
    sinks.write_table(annotate.annotate(reps.select("locus"), *tables), f"{a.output}/annotations", single=True)


def download_schema(spark, a):
    fasta.as_of(_dump(spark, a.input), a.date).write.mode("error").parquet(a.output)


def load_schema(spark, a):
    store.upload_payload(translated(fasta.read_alleles(spark, a.input))).write.mode("error").parquet(a.output)
    if a.url:
        sent = spark.read.parquet(a.output)
        database.upload(sent.withColumn("lengths", F.to_json("lengths")), a.url)


def sync_schema(spark, a):
    store.synchronise(fasta.read_alleles(spark, f"{a.schema_directory}/*.fasta"), _dump(spark, a.input)).write.mode("error").parquet(a.output)


def ns_stats(spark, a):
    schemas = remote.read_pages(spark, a.input[0], SCHEMAS, ("species", "schema")) if _remote(a.input) else fasta.read_json_dump(spark, a.input)
    sinks.write_table(store.species_statistics(schemas), a.output, single=True)


RUN = dict(zip(MODULES, (create_schema, allele_call, schema_evaluator, allele_call_evaluator, extract_cgmlst, remove_genes, join_profiles, prep_external_schema, uniprot_finder, download_schema, load_schema, sync_schema, ns_stats), strict=True))


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv[0] in ("-h", "--help"):
        print("usage: locusflow MODULE ...\n\n" + "\n".join(f"  {k:<20} {v}" for k, v in MODULES.items()))
        return 0
    if argv[0] in ("-v", "--version"):
        print(__version__)
        return 0
    if argv[0] not in MODULES:
        print(f"unknown module {argv[0]}; one of {', '.join(MODULES)}", file=sys.stderr)
        return 1
    RUN[argv[0]](_spark(), _parser(argv[0]).parse_args(argv[1:]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
