"""Mixing sources to target weights, native.

Rows get hash-random keys and are dealt by a range of the key within their source, so a source with a third
of the rows is spread over all ranges.  Ranges are summed first; their prefix sums, on one row per source and
range, give every range its offset.  The prefix sum is cut at the exact budget of the source: whole epochs first, then
the rows of the last epoch up to the budget, of which the last is taken in part.  Ranges before and behind the cut
decide for their rows; the one range with the cut is sorted, and a window inside it gives every row its own sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusflow.llm.shared import SPACE_CLASS, Scratch, documents, whole_row

#: Fixed values of the mix: the weights of the sources in their order, repeated; share of all words; epochs at most.
WEIGHTS = (5, 2, 1)
SHARE_NUM, SHARE_DEN = 3, 2
EPOCHS = 2
#: Ranges of a source hold about so many rows at most if it has all rows; there are at least 256 of them.
RANGE_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    clean = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(clean, SPACE_CLASS + "+")).cast("long")
    at_ends = F.when(clean.rlike("^" + SPACE_CLASS), 1).otherwise(0) + F.when(clean.rlike(SPACE_CLASS + r"\z"), 1).otherwise(0)
    return F.when(~clean.rlike(r"[^\x20\x09-\x0D]"), F.lit(0).cast("long")).otherwise(pieces - at_ends)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The sources that reach the most they can give are those with the least size per weight; the running sums
    in that order tell how many, in integers, so that the target is one division.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank + 1).cast("int")))
    by_need = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    ranked = weighed.select(
        "*",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_full"),
        F.sum("source_size").over(everyone).alias("total"),
        F.sum("w").over(everyone).alias("w_all"),
    )
    num = SHARE_NUM * F.col("total") - SHARE_DEN * EPOCHS * F.col("full")
    den = SHARE_DEN * (F.col("w_all") - F.col("w_full"))
    capped = F.col("w") * num >= F.lit(EPOCHS) * F.col("source_size") * den
    level = ranked.select("*", num.alias("num"), den.alias("den"), capped.alias("capped"))
    free = F.struct((F.col("source_size") / F.col("w")).alias("need"), F.col("source"), F.col("num"), F.col("den"))
    first_free = F.min(F.when(~F.col("capped"), free)).over(everyone)
    return level.select("source", "source_size", "capped", "w", first_free.alias("free")).select(
        "source",
        "source_size",
        F.when(F.col("capped"), (EPOCHS * F.col("source_size")).cast("double"))
        .otherwise((F.col("w") * F.col("free.num")).cast("double") / F.col("free.den"))
        .alias("target"),
    )


#: Rows up to which the table of ranges is sent to every executor; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def _random_key() -> Column:
    """The MD5 of the id, or of the text where there is none."""
    text = F.concat(F.lit("text:"), F.coalesce(F.col("text"), F.lit("")))
    return F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.md5(text.cast("binary")))


def _sized(docs: DataFrame) -> list[Column]:
    """doc_id, source, size, key and, for rows that these do not tell apart, a hash of the text."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _random_key().alias("key"), F.xxhash64("text").alias("tie")]


def _range_plan(sizes: DataFrame, weights: tuple[int, ...], range_rows: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(source, part, ahead, part_size, source_size, target) of each range, and how many digits of the key name a range."""
    # The first digits of the key name the range; their number changes the work, never the order.
    digits, n = 2, sizes.count()
    while 16**digits * range_rows < n:
        digits += 1
    ranges = scratch.write(sizes.groupBy("source", F.substring("key", 1, digits).alias("part")).agg(F.sum("size").alias("part_size")), "ranges")
    goal = targets(ranges.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("source", "part", "part_size", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("ahead"))
    joined = offsets.alias("o").join(goal.alias("g"), F.expr("o.source <=> g.source"))
    return scratch.write(joined.select("o.source", "part", "ahead", "part_size", "source_size", "target"), "plan"), digits


def _taken(rows: DataFrame, plan: DataFrame, digits: int) -> DataFrame:
    """What ``row`` of ``rows`` (row, doc_id, source, size, key, tie) holds, then size, source_size, target and taken.

    A range that ends before the source's cut, or starts behind it, decides for its rows; only the range with the cut
    is sorted, for the running sums inside it.
    """
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    ahead, end = F.col("ahead"), F.col("ahead") + F.col("part_size")
    side = F.when(end <= rest, 1).when(ahead >= rest, -1).otherwise(0)
    plan = plan.select("source", "part", "source_size", "target", epochs.alias("epochs"), (rest - ahead).alias("room"), side.alias("side"))
    plan = (F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan).alias("p")
    on = F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part"))
    keyed = rows.withColumn("part", F.substring("key", 1, digits)).alias("r")
    placed = keyed.join(plan, on).select("r.*", *[f"p.{c}" for c in ("epochs", "room", "side", "source_size", "target")])
    every = F.col("epochs") * F.col("size")
    decided = placed.where("side <> 0").withColumn("taken", every + F.when(F.col("side") == 1, F.col("size")).otherwise(0))
    order = Window.partitionBy("source", "part").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("size").over(order), F.lit(0))
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("room") - inside))
    cut = placed.where("side = 0").withColumn("taken", every + last)
    return decided.unionAll(cut).select("row.*", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, range_rows: int = RANGE_ROWS, whole: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row of ``docs``; taken counts repeats.

    Size is the number of words (null: 0).  A null source is a source of its own, the last.  A row without an id is
    keyed by its text.  Rows with equal keys are ordered by size and a hash of the text; full repeats share what falls on them in one of the possible orders, which is always the
    same set of numbers.  Texts without words take 0.  No rows give no rows.  With ``whole`` all columns of ``docs`` are
    returned, but those named as the four new ones, which these replace; without, other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.write(docs.select(*_sized(docs)), "sizes")
    plan, digits = _range_plan(sizes, weights, range_rows, scratch)
    if whole:
        return _taken(docs.select(whole_row(docs, ("size", "source_size", "target", "taken")).alias("row"), *_sized(docs)), plan, digits)
    return _taken(sizes.withColumn("row", F.struct("doc_id", "source")), plan, digits)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(md5(CAST(doc_id AS VARCHAR)), md5('text:' || coalesce(text, ''))) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source),
run AS (
  SELECT *, coalesce(sum(source_size) OVER o, 0) AS full_size, coalesce(sum(w) OVER o, 0) AS full_w,
         sum(source_size) OVER () AS total, sum(w) OVER () AS w_all
  FROM per WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (
  SELECT *, 3 * total - 4 * full_size AS num, 2 * (w_all - full_w) AS den FROM run),
cap AS (
  SELECT *, w * num >= 2 * source_size * den AS capped FROM lev),
goal AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(w * (SELECT num FROM cap WHERE NOT capped ORDER BY source_size / w, source NULLS LAST LIMIT 1) AS DOUBLE)
                   / CAST((SELECT den FROM cap WHERE NOT capped ORDER BY source_size / w, source NULLS LAST LIMIT 1) AS DOUBLE) END AS target
  FROM cap),
pre AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size
            + greatest(0, least(size, budget - (budget // source_size) * source_size - ahead)) ELSE 0 END AS BIGINT) AS taken
FROM pre
"""
