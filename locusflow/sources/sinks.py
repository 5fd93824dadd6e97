"""Writers: FASTA, tables, profile matrices, coordinates, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions.sequence import elapsed, parse_time
from locusflow.operators.numbering import with_row_number
from locusflow.runtime import bounded


def fasta_record(seqid: Column | str, seq: Column | str) -> Column:
    return F.concat(F.lit(">"), seqid, F.lit("\n"), seq)


def write_fasta(seqs: DataFrame, path: str, by: str | None = None, mode: str = "error") -> None:
    """Single-line FASTA; ``by`` makes a folder for each of its values."""
    lines = seqs.select(*([by] if by else []), fasta_record(F.col("seqid"), F.col("seq")).alias("value"))
    (lines.write.partitionBy(by) if by else lines.write).mode(mode).text(path)


def write_table(df: DataFrame, path: str, single: bool = False, mode: str = "error") -> None:
    (df.coalesce(1) if single else df).write.mode(mode).option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "\u0000").csv(path)


def to_wide(long: DataFrame, loci: list[str], value: str = "cell", missing: object = None, key: str = "FILE") -> DataFrame:
    """One row per sample, one column per locus; absent cells get ``missing``.  Loci are given, so no job looks for them."""
    wide = long.groupBy(key).pivot("locus", loci).agg(F.first(value))
    return wide if missing is None else wide.fillna(missing, subset=loci)


def locus_names(long: DataFrame) -> list[str]:
    """Loci in their order; one name per column of the matrix to come."""
    order = "locus_ord" if "locus_ord" in long.columns else "locus"
    return [r["locus"] for r in long.groupBy("locus").agg(F.min(order).alias("o")).orderBy("o", "locus").collect()]


def transpose(long: DataFrame, key: str = "FILE", column: str = "locus") -> DataFrame:
    """A matrix in long form with rows and columns changed, their orders too; as long, it has no bound on either."""
    names = {key: column, column: key, f"{key}_ord": f"{column}_ord", f"{column}_ord": f"{key}_ord"}
    return long.select(*[F.col(c).alias(names.get(c, c)) for c in long.columns])


def matrix_lines(long: DataFrame, key: str = "FILE", column: str = "locus", value: str = "cell", missing: str = "", sep: str = "\t", block: int = 1000) -> DataFrame:
    """(place, value): the lines of a matrix of any width, its header first, from cells in long form.

    Rows and columns stand in the order of ``<key>_ord`` and ``<column>_ord`` where there are such, else of their names.
    Cells are put together in blocks of columns, and the blocks of a row to its line, so that no plan has a column a
    locus.  Cells that are absent or null are ``missing``; of several in one place the least is taken.
    """
    ordered = lambda name: [f"{name}_ord", name] if f"{name}_ord" in long.columns else [name]

    def numbered(name: str, as_: str) -> DataFrame:
        first = ordered(name)
        each = long.groupBy(name).agg(F.min(first[0]).alias(first[0])) if len(first) > 1 else long.select(name).distinct()
        return with_row_number(each, as_, *first).select(name, as_)

    rows, columns = numbered(key, "place"), numbered(column, "at").withColumn("block", F.floor((F.col("at") - 1) / block))
    blocks = columns.groupBy("block").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.array_sort(F.collect_list(F.struct("at", F.col(column).cast("string").alias("name")))).alias("names"))
    placed = long.select(key, column, F.col(value).cast("string").alias("cell")).where("cell is not null").join(bounded(columns), column)
    cells = placed.groupBy(key, "block", "at").agg(F.min("cell").alias("cell")).groupBy(key, "block").agg(F.map_from_entries(F.collect_list(F.struct("at", "cell"))).alias("cells"))
    # Every row has every block, whole or not: a line has as many cells as there are columns.
    whole = rows.join(bounded(blocks.select("block", "low", "high")), how="cross").join(cells, [key, "block"], "left")
    cell = lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(missing))
    part = F.array_join(F.transform(F.sequence("low", "high"), cell), sep)
    line = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", x.alias("text")))), lambda b: b["text"]), sep)
    body = whole.select("place", key, "block", part.alias("text")).groupBy("place", key).agg(line(F.col("text")).alias("cells"))
    head = blocks.select(F.lit(0).cast("long").alias("place"), F.lit(key).alias(key), "block", F.array_join(F.transform("names", lambda x: x["name"]), sep).alias("text"))
    head = head.groupBy("place", key).agg(line(F.col("text")).alias("cells"))
    return head.unionByName(body.withColumn("place", F.col("place").cast("long")).withColumn(key, F.col(key).cast("string"))).select("place", F.concat_ws(sep, key, "cells").alias("value"))


def write_matrix(long: DataFrame, path: str, single: bool = False, mode: str = "error", **how: str) -> None:
    """matrix_lines() as text, in order; ``single`` makes one file."""
    lines = matrix_lines(long, **how)
    dealt = lines.repartitionByRange(1, "place") if single else lines.repartitionByRange("place")
    dealt.sortWithinPartitions("place").select("value").write.mode(mode).text(path)


def concatenate(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coordinates(cds: DataFrame) -> DataFrame:
    """The coordinates table of coding sequences."""
    return cds.select(
        F.col("genome").alias("Genome"), F.col("contig").alias("Contig"), F.col("begin").alias("Start"), F.col("end").alias("Stop"),
        F.col("protid").alias("Protein_ID"), F.col("strand").alias("Coding_Strand"),
    )


def report(tables: dict[str, DataFrame], path: str, title: str) -> None:
    """A self-contained HTML page with the (aggregated, small) tables as one JSON object."""
    payload = {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in tables.items()}
    body = json.dumps(payload, default=str).replace("</", "<\\/")
    page = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><div id="root"></div><script>window.preloaded = {body};</script></body></html>\n'
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)


def payload(df: DataFrame) -> DataFrame:
    """Each row as JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def run_log(spark: SparkSession, started: str, finished: str, **facts: object) -> DataFrame:
    """One row about a run: both stamps, the time between them, and what else is to be kept."""
    row = spark.range(1).select(F.lit(started).alias("started"), F.lit(finished).alias("finished"), *[F.lit(v).alias(k) for k, v in facts.items()])
    return row.withColumn("elapsed", elapsed(parse_time("started"), parse_time("finished")))
