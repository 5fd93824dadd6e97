"""Analyses of allelic profiles in long form: (FILE, locus, cell)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.functions.sequence import is_present, mask_cell, sequence_hash
from locusflow.operators.numbering import with_row_number
from locusflow.runtime import bounded


def masked(profiles: DataFrame, missing: str = "0") -> DataFrame:
    return profiles.withColumn("cell", mask_cell("cell", missing))


def presence(profiles: DataFrame) -> DataFrame:
    """(FILE, locus, present): 1 where the masked cell is above zero."""
    return profiles.select("FILE", "locus", is_present(mask_cell("cell")).alias("present"))


def missing_data(present: DataFrame) -> DataFrame:
    """(FILE, missing, percentage): loci absent from each sample, and their fraction, of all loci there are."""
    loci = present.select("locus").distinct().agg(F.count("*").alias("n"))
    per = present.groupBy("FILE").agg(F.sum("present").alias("k"))
    return per.join(F.broadcast(loci)).select("FILE", (F.col("n") - F.col("k")).alias("missing"), (1 - F.col("k") / F.col("n")).alias("percentage"))


def ranked_samples(present: DataFrame) -> DataFrame:
    """(FILE, rank): samples from the most loci to the least, ties by name."""
    per = present.groupBy("FILE").agg((-F.sum("present")).alias("k"))
    return with_row_number(per, "rank", "k", "FILE").select("FILE", "rank")


def running_fraction(present: DataFrame) -> DataFrame:
    """(locus, rank, fraction): presence of each locus among the first samples, for every number of samples.

    Absent pairs count as missing: the running count of present pairs is divided by the rank.  Ranks at which nothing
    changes have no row unless the pair is listed.
    """
    order = Window.partitionBy("locus").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return present.join(ranked_samples(present), "FILE").select("locus", "rank", (F.sum("present").over(order) / F.col("rank")).alias("fraction"))


def core_loci(present: DataFrame, threshold: float) -> DataFrame:
    """(locus, fraction): loci that at least ``threshold`` of the samples have."""
    samples = present.select("FILE").distinct().agg(F.count("*").alias("n"))
    per = present.groupBy("locus").agg(F.sum("present").alias("k")).join(F.broadcast(samples))
    return per.select("locus", (F.col("k") / F.col("n")).alias("fraction")).where(F.col("fraction") >= threshold)


def core_curves(present: DataFrame, thresholds: tuple[float, ...], step: int = 1) -> DataFrame:
    """(threshold, rank, core): core loci among the first 1, 1 + step, ... samples, and among all.  Needs every pair listed.

    The running fractions are made once for all thresholds.
    """
    fractions = running_fraction(present)
    last = present.select("FILE").distinct().agg(F.count("*").alias("last"))
    chosen = fractions.join(F.broadcast(last)).where(((F.col("rank") - 1) % step == 0) | (F.col("rank") == F.col("last")))
    counts = chosen.groupBy("rank").agg(*[F.count_if(F.col("fraction") >= t).alias(f"t{k}") for k, t in enumerate(thresholds)])
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{k}").alias("core")) for k, t in enumerate(thresholds)])
    return counts.select("rank", F.inline(each)).select("threshold", "rank", "core")


def complete(profiles: DataFrame, missing: str = "LNF") -> DataFrame:
    """``profiles`` with a row for every sample and locus, by a join of the two short lists."""
    samples, loci = profiles.select("FILE").distinct(), profiles.select("locus").distinct()
    return samples.join(bounded(loci)).join(profiles, ["FILE", "locus"], "left").withColumn("cell", F.coalesce("cell", F.lit(missing)))


def distances(profiles: DataFrame, symmetric: bool = False) -> DataFrame:
    """(a, b, distance): loci at which two samples both have an allele and these differ, a <= b, itself included.

    Every pair of samples is listed, zero distances too, and both ways with ``symmetric``.
    """
    return blocked_distances(profiles, symmetric=symmetric)


def blocked_distances(profiles: DataFrame, block: int = 512, symmetric: bool = False) -> DataFrame:
    """distances() by blocks of samples: alleles are numbers within their locus, a block is one row of such numbers, and
    every block meets every other in a cross join.  Neither cells nor pairs are shuffled, and a task holds two blocks.

    Samples without a name are left out; of several cells of a sample and locus one counts.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from locusflow.runtime import Stage, map_arrow

    spark, names = profiles.sparkSession, ["a", "b", "distance"]
    kind = profiles.schema["FILE"].dataType.simpleString()
    stage = Stage(spark)
    given = stage.write(masked(profiles.where("FILE is not null")).select("FILE", "locus", "cell"), "cells")
    cells = given.where((is_present("cell") == 1) & F.col("locus").isNotNull())
    alleles = cells.select("locus", "cell").distinct().withColumn("code", F.row_number().over(Window.partitionBy("locus").orderBy("cell")))
    alleles = stage.write(alleles, "alleles")
    loci = with_row_number(alleles.groupBy("locus").agg(F.max("code").alias("most")), "at", "locus")
    order = with_row_number(given.select("FILE").distinct(), "ord", "FILE")
    n_loci, most = loci.agg(F.count("*"), F.coalesce(F.max("most"), F.lit(0))).first()
    # One number more than there are alleles: a missing one is 0 on one side and the largest on the other, and so never equal.
    width = "u1" if most < (1 << 8) - 1 else "u2" if most < (1 << 16) - 1 else "u4"
    codes = alleles.join(loci.select("locus", (F.col("at") - 1).alias("at")), "locus").select("locus", "cell", "at", "code")
    coded = cells.join(bounded(codes), ["locus", "cell"]).select("FILE", "at", "code")
    numbered = order.select("FILE", F.floor((F.col("ord") - 1) / block).cast("int").alias("block"), ((F.col("ord") - 1) % block).cast("int").alias("row"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        files = rows.drop_duplicates("row").sort_values("row")["FILE"].tolist()
        there = rows.dropna(subset=["code"])
        out = np.zeros((n_loci, len(files)), width)
        out[there["at"].to_numpy(np.int64), there["row"].to_numpy(np.int64)] = there["code"].to_numpy(np.int64)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "files": [files], "codes": [out.tobytes()]})

    packed = numbered.join(coded, "FILE", "left").groupBy("block").applyInPandas(pack, f"block int, files array<{kind}>, codes binary")
    blocks = stage.write(packed, "blocks")
    side = lambda name: blocks.select(*[F.col(c).alias(f"{name}_{c}") for c in ("block", "files", "codes")])
    met = side("x").repartition(4 * spark.sparkContext.defaultParallelism, "x_block").crossJoin(side("y")).where("x_block <= y_block")

    def count(batches):
        known = {}
        for batch in batches:
            get = {c: batch.column(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                a, b = (get[f"{s}_files"][k].values for s in "xy")
                x, y = (np.frombuffer(get[f"{s}_codes"][k].as_buffer(), width).reshape(n_loci, n) for s, n in (("x", len(a)), ("y", len(b))))
                own = get["x_block"][k] == get["y_block"][k]
                if (len(a), len(b), own) not in known:
                    known[len(a), len(b), own] = [z.astype(np.int32) for z in (np.triu_indices(len(a)) if own else np.divmod(np.arange(len(a) * len(b)), len(b)))]
                i, j = known[len(a), len(b), own]
                found = differing_alleles(x, y)
                left, right, d = a.take(pa.array(i)), b.take(pa.array(j)), pa.array(found[i, j] if own else found.ravel())
                yield pa.RecordBatch.from_arrays([left, right, d], names)
                if symmetric:
                    back = pa.RecordBatch.from_arrays([right, left, d], names)
                    yield back.filter(pa.array(i != j)) if own else back

    return map_arrow(met, count, f"a {kind}, b {kind}, distance long")


def differing_alleles(x, y):
    """Of each column of ``x`` with each of ``y``, the rows in which both have a number and these differ; 0 is none."""
    import numpy as np

    both = (x > 0).T.astype(np.float32) @ (y > 0).astype(np.float32)
    hidden = np.where(y == 0, np.iinfo(y.dtype).max, y)
    same, some = np.zeros(both.shape, np.int64), np.zeros(both.shape, np.uint8)
    for k in range(len(x)):
        some += x[k][:, None] == hidden[k]
        if k % 255 == 254:
            same += some
            some[:] = 0
    return both.astype(np.int64) - same - some


def symmetrical(upper: DataFrame) -> DataFrame:
    """Both halves of a triangle (a, b, distance), which is read once."""
    one = F.struct("a", "b", "distance")
    other = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "distance")
    return upper.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, other))))


def join_wide(tables: list[DataFrame], common: bool = False) -> DataFrame:
    """Rows of several profile matrices, columns in the first one's order; equal sets of loci, or the ``common`` ones."""
    if len(tables) < 2:
        raise ValueError("at least two tables are needed")
    first = tables[0].columns
    shared = [c for c in first if all(c in t.columns for t in tables)]
    if not common and any(set(t.columns) != set(first) for t in tables):
        raise ValueError("the tables do not have the same loci")
    if common and set(shared) <= {"FILE"}:
        raise ValueError("the tables have no locus in common")
    cols = shared if common else first
    return reduce(DataFrame.unionAll, [t.select(*cols) for t in tables])


def select_loci(profiles: DataFrame, loci: DataFrame, inverse: bool = False) -> DataFrame:
    """Without the listed loci, or with ``inverse`` only these."""
    return profiles.join(loci.select("locus").distinct(), "locus", "left_semi" if inverse else "left_anti")


def drop_samples(profiles: DataFrame, samples: DataFrame) -> DataFrame:
    return profiles.join(samples.select("FILE").distinct(), "FILE", "left_anti")


def select_wide(wide: DataFrame, loci: list[str], inverse: bool = False) -> DataFrame:
    """Locus columns without the listed ones, or only these, in their order; unknown names match nothing."""
    return wide.select(*[c for c in wide.columns if c == "FILE" or (c in set(loci)) == inverse])


def hashed(profiles: DataFrame, alleles: DataFrame, kind: str = "sha256") -> DataFrame:
    """Identifiers replaced by the digest of their sequence; unknown ones pass, classes become -."""
    plain = F.regexp_replace(F.regexp_replace("cell", "INF-", ""), r"\*", "")
    known = alleles.select("locus", F.col("allele_id").alias("plain"), sequence_hash("dna", kind).alias("digest"))
    out = profiles.withColumn("plain", F.when(plain.rlike(r"^\d+\z"), plain).otherwise("-")).join(known, ["locus", "plain"], "left")
    return out.select("FILE", "locus", F.coalesce("digest", "plain").alias("cell"))


def allele_sequences(profiles: DataFrame, alleles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sequence of each present cell, and the cells whose identifier the catalogue does not have."""
    cells = profiles.withColumn("allele_id", F.regexp_replace(F.regexp_replace("cell", "INF-", ""), r"\*", "")).where(F.col("allele_id").rlike(r"^\d+\z"))
    known = alleles.select("locus", "allele_id", "dna")
    return cells.join(known, ["locus", "allele_id"]), cells.join(known, ["locus", "allele_id"], "left_anti")


def sample_classes(profiles: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Counts of the classes in each sample; an identifier counts as EXC, one with INF- as INF."""
    return profiles.groupBy("FILE").agg(*[F.count_if(cell_class() == c).alias(c) for c in classes])


def locus_classes(profiles: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    return profiles.groupBy("locus").agg(*[F.count_if(cell_class() == c).alias(c) for c in classes])


def cell_class():
    return F.when(F.col("cell").startswith("INF-"), "INF").when(F.col("cell").rlike(r"^\*?\d+\z"), "EXC").when(F.col("cell") == "PLNF", "LNF").otherwise(F.col("cell"))
