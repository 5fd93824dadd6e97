"""How the sources of a language differ in their words: DuckDB aggregates shards, Spark merges sums and rankings.

Tasks tally the terms of whole texts before anything is shuffled, one row of each language, source and term.  The
tallies are dealt to shards by the hash of language and term, so that a shard sees a term with all its sources.
Inside a shard DuckDB sums the counts, keeps the terms of enough documents, and in a second pass, when the totals
are known, gives partial sums of the differences of every pair of sources, and its own best terms of every source.
Spark adds the sums of the shards and ranks.

A source that lacks a term has the same share there as for every other term it lacks.  So the difference of two
sources is that of these shares for all terms, and what the terms that occur add: a sum over the terms of either, and
one over the terms of both.  Nothing is filled up with zeros.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusflow.llm.shared import Scratch, batches_with, documents, utf8_cells, word_pieces
from locusflow.runtime import map_arrow, ship

#: Documents of a language in which a term must occur to be kept, and best terms of a source in the result.
MIN_DOCUMENTS = 30
BEST = 50
#: What is added to every count, and the scale of shares.
SMOOTH = 5
SCALE = 1_000_000_000

#: A task holds the tallies of about so many terms before it sends them on; tallies that make a shard.
HELD = 250_000
SHARD_ROWS = 200_000
DUCKDB = {"threads": "1", "memory_limit": "700MB", "temp_directory": "", "preserve_insertion_order": "false"}

#: Letters in lower case and all bytes of other characters stand, everything else separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _database():
    import duckdb

    return duckdb.connect(":memory:", config=DUCKDB)


TALLY = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of rows of lang, source and text; every group has a row of the empty term too."""
    occurrences: dict = defaultdict(Counter)
    spread: dict = defaultdict(Counter)

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in occurrences.items():
            d = spread[lang, source]
            terms = [b"", *n]
            text = pa.array(terms, pa.binary()).cast(pa.string())
            group = [pa.array([x] * len(terms), pa.binary()).cast(pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*group, text, pa.array([0, *n.values()]), pa.array([0, *(d[t] for t in n)])], schema=TALLY)
        occurrences.clear()
        spread.clear()

    for batch in batches_with(batches):
        for lang, source, text in zip(*map(utf8_cells, batch.columns), strict=True):
            n, seen = occurrences[lang, source], set()
            for words in word_pieces((text or b"").translate(_FOLD)):
                n.update(words)
                seen.update(words)
            spread[lang, source].update(seen)
        if sum(map(len, occurrences.values())) > HELD:
            yield from sent()
    yield from sent()


_COUNT = """
WITH c AS (SELECT lang, source, term, sum(n) AS n, sum(d) AS d FROM rows GROUP BY ALL)
SELECT lang, source, term, CAST(n AS BIGINT) AS n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS first
FROM c QUALIFY sum(d) OVER (PARTITION BY lang, term) >= {least}
"""


def count_shard(least: int, size: int = 50_000):
    """The tallies of a shard, as they stream in, to the counts of kept terms; ``first`` marks one row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _database()
        con.register("rows", pa.RecordBatchReader.from_batches(TALLY, (b.cast(TALLY) for b in batches)))
        yield from con.execute(_COUNT.format(least=int(least))).to_arrow_reader(size)

    return run


#: p of every count of the shard, and z, the share of a term that the group lacks.
_SHARES = """
CREATE OR REPLACE TEMP TABLE shares AS
SELECT c.lang, c.source, c.term, c.n, g.z,
       CAST(1 + ({scale}::HUGEINT * (c.n + {smooth})) // (g.total + {smooth} * g.terms) AS BIGINT) AS p,
       CAST(1 + ({scale}::HUGEINT * (sum(c.n) OVER (PARTITION BY c.lang, c.term) + {smooth})) // (g.lang_total + {smooth} * g.terms) AS BIGINT) AS q
FROM counts c JOIN groups g ON c.lang = g.lang AND c.source = g.source
"""
_PAIRS = """
WITH alike AS (SELECT lang, source, p, z, count(*) AS k FROM shares GROUP BY ALL),
one AS (
  SELECT a.lang, least(a.source, g.source) AS source, greatest(a.source, g.source) AS item,
         sum(a.k * (abs(a.p - g.z) - abs(a.z - g.z))) AS value
  FROM alike a JOIN groups g ON a.lang = g.lang AND a.source <> g.source GROUP BY ALL),
two AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(a.z - b.p) + abs(a.z - b.z)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL)
SELECT lang, source, 'pair' AS part, item, CAST(sum(value) AS BIGINT) AS value
FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL
UNION ALL
SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {best}
"""
PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def compare_shard(best: int):
    """Counts and groups of a shard to partial sums of pairs, each pair once, and the shard's best terms."""

    def run(counts: pa.Table, groups: pa.Table) -> pa.Table:
        con = _database()
        con.register("counts", counts)
        con.register("groups", groups)
        con.execute(_SHARES.format(scale=SCALE, smooth=SMOOTH))
        return con.execute(_PAIRS.format(best=int(best))).to_arrow_table().cast(PARTIAL)

    return run


def audit(docs: DataFrame, least: int = MIN_DOCUMENTS, best: int = BEST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every language and source of ``docs``.

    Part `pair` has a row of every other source of the language, with the sum of differences over all kept terms, 0 if
    there are none; part `term` the ``best`` terms that the source has more often than its language.  Null texts, languages
    and sources count as empty strings, and every row is a document, repeated ids or rows too.  Empty texts give a group
    without terms.  An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    tallies = scratch.write(map_arrow(filled, tally, "lang string, source string, term string, n long, d long"), "tallies")
    shards = -(-tallies.count() // shard_rows) or 1
    dealt = tallies.where("term <> ''").repartition(shards, "lang", "term")
    counts = map_arrow(dealt, count_shard(least), "lang string, source string, term string, n long, first boolean")
    counts = scratch.write(counts.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")), "counts")

    by_lang = Window.partitionBy("lang")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("terms"))
    found = tallies.where("term = ''").select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["total", "terms"])
    found = found.select("lang", "source", "total", F.sum("total").over(by_lang).alias("lang_total"), F.sum("terms").over(by_lang).alias("terms"))
    absent = F.when(F.col("terms") > 0, F.lit(1).cast("long") + F.expr(f"{SCALE * SMOOTH}L div (total + {SMOOTH}L * terms)")).otherwise(0)
    groups = scratch.write(found.withColumn("z", absent), "groups")

    everywhere = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    ship(spark)
    parts = (
        counts.drop("first").groupBy("shard").cogroup(everywhere.groupBy("shard"))
        .applyInArrow(compare_shard(best), "lang string, source string, part string, item string, value long")
    )
    parts = scratch.write(parts, "parts")

    added = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("added"))
    pairs = groups.alias("a").join(groups.alias("b"), F.expr("a.lang = b.lang and a.source <> b.source")).select(
        "a.lang", "a.source", F.col("b.source").alias("item"), F.expr("a.terms * abs(a.z - b.z)").alias("base"),
        F.least("a.source", "b.source").alias("low"), F.greatest("a.source", "b.source").alias("high"),
    )
    named = added.select("lang", F.col("source").alias("low"), F.col("item").alias("high"), "added")
    pairs = pairs.join(named, ["lang", "low", "high"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("base") + F.coalesce("added", F.lit(0))).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    ranked = pairs.unionAll(parts.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= best))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
tok AS (SELECT lang, source, term, sum(n) AS n, count(*) AS d FROM (
  SELECT lang, source, term, r, count(*) AS n FROM (SELECT lang, source, r, unnest(ts) AS term FROM docs) GROUP BY ALL) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS tn FROM tok GROUP BY lang, term HAVING sum(d) >= 30),
grp AS (SELECT DISTINCT lang, source FROM docs),
cnt AS (
  SELECT g.lang, g.source, k.term, coalesce(t.n, 0) AS n, k.tn
  FROM grp g JOIN kept k ON g.lang = k.lang LEFT JOIN tok t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
v AS (SELECT lang, count(*) AS terms, sum(tn) AS lang_total FROM kept GROUP BY lang),
tot AS (SELECT lang, source, sum(n) AS total FROM cnt GROUP BY lang, source),
p AS (
  SELECT c.lang, c.source, c.term, c.n,
         1 + (1000000000::HUGEINT * (c.n + 5)) // (t.total + 5 * v.terms) AS p,
         1 + (1000000000::HUGEINT * (c.tn + 5)) // (v.lang_total + 5 * v.terms) AS q
  FROM cnt c JOIN tot t ON c.lang = t.lang AND c.source = t.source JOIN v ON c.lang = v.lang),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 50
"""
