"""FASTA and table scans, input listings and their guards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusflow.functions.sequence import basename, genome_of

#: Suffixes of FASTA files; the longest file prefix.
SUFFIXES = ("fasta", "fna", "ffn", "fa", "fas")
PREFIX_LENGTH = 30


def read_fasta(spark: SparkSession, paths: str | list[str], upper: bool = False) -> DataFrame:
    """(source, rec_ord, seqid, header, seq) of each record; compressed files are read as such.

    A record starts at a ``>`` at the start of a line, so that one inside a header stays part of it.  The identifier is the
    header up to the first white space; carriage returns and white space in sequences go.  ``rec_ord`` orders the records
    of a file; it grows with the place in the file and is not dense.  Blank files have no records; text before the first
    header is taken for a record, which validity() tells.
    """
    raw = spark.read.text(paths, lineSep="\n>").select(F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("rec_ord"), F.col("_metadata.file_block_start").alias("block"), "value")
    # Only the first record of a file still has its mark.
    value = F.when((F.col("block") == 0) & F.col("value").startswith(">"), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    lines = F.split(F.regexp_replace(value, "\r", ""), "\n", 2)
    seq = F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s+", "")
    out = raw.where(F.trim("value") != "").select("source", "rec_ord", F.get(lines, F.lit(0)).alias("header"), (F.upper(seq) if upper else seq).alias("seq"))
    return out.select("source", "rec_ord", F.regexp_extract("header", r"^\s*(\S*)", 1).alias("seqid"), "header", "seq")


#: Identifiers up to which a fetch asks the index for each of them; more are joined.
ASKED = 256


def write_index(seqs: DataFrame, path: str, page_rows: int = 50) -> None:
    """``seqs`` sorted by identifier, in pages of few records with their bounds and a filter of the identifiers, for fetch_indexed()."""
    dealt = seqs.repartitionByRange("seqid", "source", "rec_ord").sortWithinPartitions("seqid", "source", "rec_ord")
    pages = {"parquet.page.row.count.limit": page_rows, "parquet.bloom.filter.enabled#seqid": "true", "compression": "zstd"}
    dealt.write.mode("errorifexists").options(**pages).parquet(path)


def fetch_indexed(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Records of the identifiers in ``ids`` (seqid, ord), in their order; of few, only their pages of the index are read.

    Null identifiers are none; one that is asked twice comes twice, and one that several records have brings all of them.
    """
    index, asked = spark.read.parquet(path), [r["seqid"] for r in ids.select("seqid").where("seqid is not null").distinct().limit(ASKED + 1).collect()]
    if len(asked) <= ASKED:
        tests = [F.col("seqid") == x for x in asked] or [F.lit(False)]
        while len(tests) > 1:
            tests = [a | b for a, b in zip(tests[::2], tests[1::2], strict=False)] + (tests[-1:] if len(tests) % 2 else [])
        index = index.where(tests[0])
    return ids.join(index, "seqid").orderBy("ord", "source", "rec_ord")


def last_record(seqs: DataFrame) -> DataFrame:
    """One record of each (source, seqid): the last."""
    return seqs.groupBy("source", "seqid").agg(F.max_by("seq", "rec_ord").alias("seq"), F.max("rec_ord").alias("rec_ord"))


def fetch(seqs: DataFrame, ids: DataFrame) -> DataFrame:
    """Sequences of the identifiers in ``ids`` (seqid, ord), in their order."""
    return ids.join(seqs, "seqid").orderBy("ord")


def statistics(seqs: DataFrame) -> DataFrame:
    """Records and lengths of each source."""
    n = F.length("seq")
    return seqs.groupBy("source").agg(F.count("*").alias("records"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("mean_length"))


def list_inputs(spark: SparkSession, directory: str) -> DataFrame:
    """(path, size, genome) of the FASTA files of a folder; files without any content are not listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(directory)
    return files.select("path", F.col("length").alias("size"), genome_of("path").alias("genome"))


def validity(inputs: DataFrame, seqs: DataFrame) -> DataFrame:
    """``inputs`` with ``is_fasta``: the first line with any text is a header; a file without content is none."""
    paths = [r["path"] for r in inputs.select("path").collect()]
    some = inputs.sparkSession.read.text(paths) if paths else None
    if some is None:
        return inputs.withColumn("is_fasta", F.lit(False))
    lines = some.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), F.substring("value", 1, 1).alias("mark"), (F.trim("value") != "").alias("text"))
    first = lines.where("text").groupBy("path").agg(F.min_by("mark", "at").alias("mark"))
    named = seqs.where(F.col("seqid") != "").select(F.col("source").alias("path")).distinct()
    good = first.where("mark = '>'").join(named, "path", "left_semi").select("path", F.lit(True).alias("is_fasta"))
    return inputs.join(good, "path", "left").withColumn("is_fasta", F.coalesce("is_fasta", F.lit(False)))


def name_problems(inputs: DataFrame) -> DataFrame:
    """(genome, problem): prefixes used twice, with blanks, too long, or like an entry of the protein data bank.

    Such an entry is a digit and three letters or digits, alone or with a chain of one or more after an underscore.
    """
    per = inputs.groupBy("genome").agg(F.count("*").alias("n"))
    problems = F.array_compact(
        F.array(F.when(F.col("n") > 1, "duplicate"), F.when(F.instr("genome", " ") > 0, "blank"), F.when(F.length("genome") > PREFIX_LENGTH, "long"), F.when(F.col("genome").rlike(r"^[0-9][A-Za-z0-9]{3}(_[A-Za-z0-9]+)?$"), "pdb"))
    )
    return per.select("genome", F.explode(problems).alias("problem"))


def rename_cds(seqs: DataFrame) -> DataFrame:
    """``seqs`` of coding-sequence files with genome, protid 1..n in file order and the new identifier."""
    numbered = seqs.withColumn("genome", genome_of("source")).withColumn("protid", F.row_number().over(Window.partitionBy("source").orderBy("rec_ord")))
    return numbered.withColumn("old_seqid", F.col("seqid")).withColumn("seqid", F.concat("genome", F.lit("-protein"), F.col("protid")))


def read_table(spark: SparkSession, path: str, header: bool = True, sep: str = "\t") -> DataFrame:
    """Delimited text with every cell a string; empty cells stay empty strings."""
    return spark.read.option("sep", sep).option("header", header).option("inferSchema", False).option("emptyValue", "").option("nullValue", "\u0000").csv(path)


def read_lines(spark: SparkSession, path: str, containing: str | None = None) -> DataFrame:
    lines = spark.read.text(path)
    return lines if containing is None else lines.where(F.col("value").contains(containing))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """A profile matrix in long form: (FILE, locus, locus_ord, cell)."""
    return to_long(read_table(spark, path))


def to_long(wide: DataFrame, key: str = "FILE") -> DataFrame:
    loci = [c for c in wide.columns if c != key]
    cells = F.array(*[F.struct(F.lit(c).alias("locus"), F.lit(i).alias("locus_ord"), F.col(f"`{c}`").cast("string").alias("cell")) for i, c in enumerate(loci)])
    return wide.select(F.col(key).cast("string").alias(key), F.explode(cells).alias("x")).select(key, "x.*")


def read_alleles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The alleles of locus files: (locus, locus_idx, allele_ord, allele_id, is_local, dna).

    Loci are numbered by their paths without regard to case; alleles in file order.
    """
    seqs = read_fasta(spark, paths, upper=True)
    loci = seqs.select("source").distinct().select("source", F.row_number().over(Window.orderBy(F.lower("source"), "source")).alias("locus_idx"))
    order = F.row_number().over(Window.partitionBy("source").orderBy("rec_ord"))
    named = seqs.withColumn("allele_ord", order).join(loci, "source").withColumn("allele_id", F.substring_index("seqid", "_", -1))
    return named.select(basename("source").alias("locus"), "locus_idx", "allele_ord", F.regexp_replace("allele_id", r"^\*", "").alias("allele_id"), F.col("allele_id").startswith("*").alias("is_local"), F.col("seq").alias("dna"))


def read_json_dump(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of a nomenclature server from a dump of its JSON documents; nothing is fetched."""
    return (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).json(path)


def as_of(alleles: DataFrame, when: str, column: str = "inserted_at") -> DataFrame:
    """The alleles inserted up to a moment."""
    return alleles.where(F.col(column) <= F.to_timestamp(F.lit(when)))


def snapshot_time(wanted: str | None, inserted: str, modified: str, archived: str | None = None, latest: bool = False) -> str:
    """The moment of a download: none takes the archive's, else the last change; a wanted one must lie between insertion and change."""
    if latest:
        return modified
    if wanted is None:
        return archived or modified
    if not inserted <= wanted <= modified:
        raise ValueError(f"{wanted} is not between {inserted} and {modified}")
    return wanted


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, problem) of a file with one path in its first column: a suffix that no FASTA file has, or a header line of one."""
    first = F.trim(F.element_at(F.split("value", "\t"), 1))
    rows = spark.read.text(path).select(first.alias("path")).where(F.col("path") != "")
    suffix = F.lower(F.substring_index("path", ".", -1)).isin(*SUFFIXES)
    return rows.withColumn("problem", F.when(F.col("path").startswith(">"), "FASTA instead of a list").when(~suffix, "invalid extension"))


def loci_list(spark: SparkSession, path: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(locus) of a list of identifiers, file names or paths, and those of it that ``known`` (locus) does not have."""
    first = F.trim(F.element_at(F.split("value", "\t"), 1))
    name = F.regexp_replace(F.substring_index(first, "/", -1), r"\.(" + "|".join(SUFFIXES) + r")\z", "")
    rows = spark.read.text(path).select(name.alias("locus")).where(F.col("locus") != "").distinct()
    return rows.join(known.select("locus"), "locus", "left_semi"), rows.join(known.select("locus"), "locus", "left_anti")


def numbered(values: DataFrame, column: str) -> DataFrame:
    """Surrogate numbers from 1, in the order of the values without regard to case."""
    from locusflow.operators.numbering import with_row_number

    return with_row_number(values.withColumn("_low", F.lower(column)), "number", "_low", column).drop("_low")


def file_hashes(spark: SparkSession, path: str, kind: str = "blake2b", block: int = 1 << 16) -> DataFrame:
    """(path, size, digest) of whole files, of any name of hashlib, or of crc32 and adler32 as unsigned decimals.

    Tasks read their files in blocks and carry the digest over them, so that no cell and no task holds a file.
    Files without any content are not listed, as in list_inputs().
    """
    from locusflow.functions.codecs import stream_digest
    from locusflow.runtime import ship

    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(p, *stream_digest(p, kind, block)) for p in batch["path"]]
            yield pd.DataFrame(found, columns=["path", "size", "digest"])

    listed = spark.read.format("binaryFile").load(path).select("path")
    dealt = listed.repartition(spark.sparkContext.defaultParallelism, "path")
    return dealt.mapInPandas(run, "path string, size long, digest string")


def small_sequences(seqs: DataFrame, minimum: int, variation: float = 0.0, key: str = "seqid", value: str = "seq") -> DataFrame:
    """(key, reason) of sequences shorter than the minimum less its variation."""
    return seqs.where(F.length(value) < minimum * (1 - variation)).select(key, F.concat(F.col(key).cast("string"), F.lit(f": smaller than {minimum} chars")).alias("reason"))
