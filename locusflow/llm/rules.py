"""Quality rules as a short-circuit cascade, native.

Base measures are computed for every text.  The further rules form a chain that stops at the first rejection;
on a bounded sample each rule's cost (seconds of repeated evaluation, less those of an empty job) and selectivity (share
rejected) are estimated, and the chain runs in the order of rejection per cost.  The order changes the time, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.shared import documents, words_of

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PCT = 30
#: About so many rows of one input file, by a hash of the id, make the sample for costs and selectivities; verdicts
#: never depend on it.
SAMPLE_ROWS = 2000
#: A job's time is a rule's cost once it is so many times that of an empty one; evaluations of a row at most.
CLEAR, MOST_TIMES = 3, 16**4

#: Further rules: a rule is the condition under which a text is rejected, over the base measures and the words.
RULES: dict[str, Callable[[], Column]] = {
    "symbols": lambda: F.col("n_symbols") * 5 > F.col("n_words"),
    "duplicate_lines": lambda: F.col("n_dup_lines") * 2 > F.col("n_lines"),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 25 * F.col("n_words")),
    "shouting": lambda: F.size(F.filter("words", lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1))) * 5 > F.col("n_words") * 2,
    "stuttering": lambda: F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1))) * 10 > F.col("n_words") * 3,
}


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id, words and the base measures of each row; a null text has no words and no lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), words_of(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stage = words.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("coded"),
    )
    windows = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int")), lambda i: F.xxhash64(F.slice("coded", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    stage = stage.select(
        "doc_id", "words", "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # Repeats are looked for only where the distinct windows are fewer than the windows.
    stage = stage.withColumn("again", F.size("windows") > F.size(F.array_distinct("windows")))
    ranked = F.when(F.col("again"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    stage = stage.withColumn("ranked", ranked).drop("windows")
    same = lambda x, k: F.get("ranked", k)["h"] == x["h"]
    found = F.filter("ranked", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
    stage = stage.withColumn("at", F.when(F.col("again"), F.array_sort(F.transform(found, lambda x: x["i"])))).drop("ranked")
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    return stage.withColumn("n_repeat_words", F.coalesce(F.when(F.col("again"), covered), F.lit(0)).cast("long")).drop("at", "again")


def evaluation_seconds(measured: DataFrame, rule: Column, times: int) -> float:
    """Seconds of one job that evaluates ``rule`` so many times on each row; with no evaluation, those of the job alone."""
    again = F.aggregate(F.sequence(F.lit(1), F.lit(times)), F.lit(0), lambda n, k: n + (rule & (k > 0)).cast("int"))
    began = time.perf_counter()
    measured.agg(F.sum(again if times else F.lit(0))).collect()
    return time.perf_counter() - began


def rule_costs(measured: DataFrame, rules: dict[str, Callable[[], Column]]) -> dict[str, float]:
    """Seconds that one evaluation of each rule takes on all of ``measured``, without those of a job that evaluates none.

    A rule is evaluated ever more times in one job, until the job takes CLEAR times as long as an empty one.
    """
    evaluation_seconds(measured, F.lit(False), 0)
    empty = sorted(evaluation_seconds(measured, F.lit(False), 0) for _ in range(3))[1]
    costs = {}
    for name, rule in sorted(rules.items()):
        verdict, times = F.coalesce(rule(), F.lit(False)), 1
        took = evaluation_seconds(measured, verdict, times)
        while took < CLEAR * empty and times < MOST_TIMES:
            times *= 16 if took < 1.5 * empty else 4
            took = evaluation_seconds(measured, verdict, times)
        costs[name] = max(0.0, took - empty) / times
    return costs


def ordered_rules(measured: DataFrame, rules: dict[str, Callable[[], Column]]) -> list[str]:
    """Names by rejection per cost, estimated on ``measured``; ties by name.  Rules that reject none of it come last,
    and an empty sample keeps the names' order."""
    rates = measured.agg(*[F.avg(F.coalesce(rule(), F.lit(False)).cast("int")).alias(name) for name, rule in sorted(rules.items())]).first()
    useful = {name: rule for name, rule in rules.items() if rates[name]}
    costs = rule_costs(measured, useful) if len(useful) > 1 else {}
    worth = {name: (rates[name] or 0.0) / max(1e-9, costs.get(name, 1.0)) for name in rules}
    return sorted(worth, key=lambda name: (-worth[name], name))


def judge(docs: DataFrame, rules: dict[str, Callable[[], Column]] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base measures, base_failed, the first failed rule or null, kept.

    Null texts count as empty and fail the base rules, as do all texts under twenty words.  Repeated rows and null
    ids are judged row by row.  Only doc_id and text are read.
    """
    files = docs.inputFiles()[:1]
    some = docs.sparkSession.read.parquet(*files) if files and files[0].endswith(".parquet") else docs
    some = some if {"doc_id", "text"} <= set(some.columns) else docs
    every = max(1, some.count() // sample_rows)
    sample = base_measures(some.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).cache()
    order = ordered_rules(sample, rules)
    sample.unpersist()
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    chain = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        chain = chain.when(F.coalesce(rules[name](), F.lit(False)), F.lit(name))
    return (
        base_measures(docs)
        .withColumn("base_failed", base)
        .withColumn("failed", chain)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed").isNull().alias("kept"), "failed")
    )


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
win AS (
  SELECT r, i, array_to_string(ws[i:i+7], ' ') AS g FROM split, LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - 6))) AS i)),
rep AS (
  SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, sum(least(8, coalesce(gap, 8))) AS n FROM rep GROUP BY r),
ln AS (
  SELECT r, count(*) AS n_lines, count(DISTINCT l) AS d_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM split) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
tok AS (
  SELECT r, sum(CASE WHEN upper(w) = w AND lower(w) <> w AND length(w) > 1 THEN 1 ELSE 0 END) AS shout,
         sum(CASE WHEN w = p THEN 1 ELSE 0 END) AS stutter
  FROM (SELECT r, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS p
        FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split)) GROUP BY r),
m AS (
  SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines - d_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, coalesce(shout, 0) AS shout, coalesce(stutter, 0) AS stutter
  FROM split s LEFT JOIN cov USING (r) LEFT JOIN ln USING (r) LEFT JOIN tok USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_symbols * 5 > n_words OR n_dup_lines * 2 > n_lines OR word_chars < 2 * n_words
         OR word_chars > 25 * n_words OR shout * 5 > n_words * 2 OR stutter * 10 > n_words * 3) AS kept
FROM b
"""
