"""Benchmark decontamination by template canonicalisation, native.

Numbers, units and names become typed placeholders, so that a question whose parameters were changed keeps its
template.  Windows of five template tokens are hash-joined with those of the benchmark; an item is found in a
document that holds at least 0.8 of its distinct windows, either with the item's own slot values or with values
that replace them consistently: each slot of the item by one value within one occurrence, or each value of the item by
one value throughout the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.shared import Scratch, documents, row_key, table, whole_row

WINDOW = 5
CONTAINMENT = 0.8
#: Items of fewer tokens than a window are looked for inside longer documents from so many tokens on, as they are.
SHORTEST = 3
#: Rows up to which a table of ids or of benchmark windows is sent to every executor; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000

#: Rows up to which bare hashes are sent.
BROADCAST_HASHES = 2_000_000

#: Units that become a placeholder after a number, and words that count as numbers.
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mi", "mile", "miles",
    "mg", "g", "kg", "t", "ton", "tons", "oz", "lb", "lbs", "pound", "pounds", "ml", "l", "liter", "liters", "litre", "litres",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks",
    "month", "months", "year", "years", "hz", "khz", "mhz", "ghz", "v", "w", "kw", "kwh", "j", "kj", "n", "pa", "kpa", "bar",
    "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "percent", "degrees", "meter", "meters", "metre", "metres",
    "gram", "grams", "kilogram", "kilograms", "kilometer", "kilometers", "kilometre", "kilometres", "mph", "kph",
)
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "dozen", "hundred", "thousand",
    "million", "billion",
)

_NAME, _NUMBER = "\u0001", "\u0002"
#: Codes of tokens: even hashes of words, these for slots; a name is its word's hash plus one.
_NUMBER_CODE, _UNIT_CODE, _NAME_CODE = 4, 6, 1


def template_tokens(text: Column) -> Column:
    """Lower-case tokens without punctuation; a mark stands before names, which are capitalised words, and numbers.

    Tokens of punctuation alone vanish.  Null gives no tokens.
    """
    clean = F.coalesce(text, F.lit(""))
    clean = F.when(clean.contains(_NAME) | clean.contains(_NUMBER), F.regexp_replace(clean, f"[{_NAME}{_NUMBER}]", " ")).otherwise(clean)
    named = F.regexp_replace(clean, r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{Ll}+(?![\p{L}\p{N}])", f"{_NAME}$0")
    numbered = F.regexp_replace(F.regexp_replace(named, r"([0-9])(\p{L})", "$1 $2"), r"[0-9]+(?:[.,:][0-9]+)*", f"{_NUMBER}$0")
    digits = F.split(F.lower(numbered), rf"[^\p{{L}}\p{{N}}.,:{_NAME}{_NUMBER}]+|[.,:](?![0-9])")
    return F.array_remove(F.when(text.rlike("[0-9]"), digits).otherwise(F.split(F.lower(named), rf"[^\p{{L}}\p{{N}}{_NAME}]+")), "")


def _codes(tokens: Column) -> Column:
    """A number for each token: see the codes above.  A unit is one only after a number."""
    word = lambda w: F.xxhash64(w).bitwiseAND(F.lit(~1))
    number = lambda w: w.startswith(_NUMBER) | w.isin(*NUMBER_WORDS)
    after_number = lambda i: F.coalesce(number(F.get(tokens, i - 1)), F.lit(False))
    long = lambda n: F.lit(n).cast("long")
    return F.transform(
        tokens,
        lambda w, i: F.when(w.startswith(_NAME), word(F.substring(w, 2, 1 << 20)) + 1)
        .when(number(w), long(_NUMBER_CODE))
        .when(w.isin(*UNITS) & after_number(i), long(_UNIT_CODE))
        .otherwise(word(w)),
    )


def _value(token: Column) -> Column:
    return F.when(token.startswith(_NAME) | token.startswith(_NUMBER), F.substring(token, 2, 1 << 20)).otherwise(token)


def _named(code: Column) -> Column:
    return code.bitwiseAND(F.lit(1)) == 1


def _hashes(length: int, start: Column) -> tuple[Column, Column]:
    """Hashes of the window of so many codes from ``start``: names as slots, and names as words."""
    codes = [F.get("code", start + (k - 1)) for k in range(length)]
    return F.xxhash64(*[F.when(_named(c), F.lit(_NAME_CODE).cast("long")).otherwise(c) for c in codes]), F.xxhash64(*[c.bitwiseAND(F.lit(~1)) for c in codes])


def _coded(rows: DataFrame, key: str) -> DataFrame:
    tokens = rows.select(key, template_tokens(F.col("text")).alias("tokens"))
    return tokens.select(key, "tokens", _codes(F.col("tokens")).alias("code"))


def item_windows(items: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, window, length, at, h, place, own, swaps) of each window of each form.

    A window with names has two forms, as capitals are lost in some copies: names as slots, and names as words.  Both
    have the same ``window``, the hash of the first form.  ``at`` is the place of the window's first token, from 1, ``place``
    and ``own`` are the places and values of the form's slots.  ``swaps`` says that at least half of the item's tokens are no
    slots of the form, so that other values make the item re-parameterised and not another text.  Fewer tokens than five
    make one window of all, whose values stay; none make no row.
    """
    coded = _coded(items, key)
    length = F.least(F.lit(WINDOW), F.size("tokens"))
    each = coded.select("*", length.alias("length"), F.explode(F.when(length > 0, F.sequence(F.lit(1), F.size("tokens") - length + 1)).otherwise(F.array().cast("array<int>"))).alias("at"))
    hashes = lambda k: reduce(lambda rest, n: F.when(F.col("length") == n, _hashes(n, F.col("at"))[k]).otherwise(rest), range(1, WINDOW), _hashes(WINDOW, F.col("at"))[k])
    as_slot = lambda c: _named(c) | c.isin(_NUMBER_CODE, _UNIT_CODE)
    as_word = lambda c: c.isin(_NUMBER_CODE, _UNIT_CODE)

    def form(h: str, slot) -> Column:
        place = F.filter(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1), lambda j: slot(F.get("code", j - 1)))
        swaps = (F.col("length") == WINDOW) & (2 * F.size(F.filter("code", slot)) <= F.size("code"))
        return F.struct(F.col(h).alias("h"), place.alias("place"), F.transform(place, lambda j: _value(F.get("tokens", j - 1))).alias("own"), swaps.alias("swaps"))

    each = each.select("*", hashes(0).alias("window"), hashes(1).alias("worded"))
    forms = F.when(F.col("window") == F.col("worded"), F.array(form("window", as_slot))).otherwise(F.array(form("window", as_slot), form("worded", as_word)))
    return each.select(key, "window", "length", "at", F.explode(forms).alias("x")).select(key, "window", "length", "at", "x.*")


def document_windows(docs: DataFrame, lengths: list[int], key: str = "doc_id") -> DataFrame:
    """(key, start, length, h, near) of each window of each form, for windows of the given lengths; ``near`` are its tokens.

    Windows shorter than five tokens are made in documents of that many tokens, and in longer ones from SHORTEST on.
    Hashes come from places in the document's array, so that no window is built as an array to be hashed.
    """
    out = None
    for n in lengths:
        able = F.size("tokens") >= n if n >= SHORTEST else F.size("tokens") == n
        starts = F.when(able, F.sequence(F.lit(1), F.size("tokens") - (n - 1))).otherwise(F.array().cast("array<int>"))
        slots, words = _hashes(n, F.col("start"))
        each = _coded(docs, key).select("*", F.explode(starts).alias("start")).select(key, "start", F.slice("tokens", F.col("start"), n).alias("near"), slots.alias("a"), words.alias("b"))
        both = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
        each = each.select(key, "start", F.lit(n).alias("length"), F.explode(both).alias("h"), "near")
        out = each if out is None else out.unionAll(each)
    return out


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _joined(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows of documents with those of items that have their hash.  If the items' are too many to be broadcast, their
    hashes alone are, up to a bound of their own, so that only windows that are met are shuffled."""
    if windows.count() <= BROADCAST_ROWS:
        return found.join(F.broadcast(windows), ["h", "length"])
    return found.join(_small(windows.select("h").distinct(), BROADCAST_HASHES), "h", "left_semi").join(windows, ["h", "length"])


def _occurring(hits: DataFrame, sizes: DataFrame, containment: float) -> DataFrame:
    """(doc_id, item_id, occurs): items of which one occurrence alone holds enough windows.

    A hit's shift is the window's place in the document less that in the item.  An occurrence is the hits of one shift,
    or those of shifts within one of two rows of ranges as long as the item, half a length apart: two whole copies are
    never in one range, and a copy with tokens put in or left out is.  In a range, each window of the item is taken at
    its commonest shift.  No place of a slot in the item may have two values in an occurrence.
    """
    need = F.lit(containment) * F.col("n_windows")
    half = F.floor(F.col("width") / 2)
    spans = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("shift").cast("long").alias("no")),
        F.struct(F.lit(1).alias("kind"), F.floor(F.col("shift") / F.col("width")).alias("no")),
        F.struct(F.lit(2).alias("kind"), F.floor((F.col("shift") + half) / F.col("width")).alias("no")),
    )
    # Ids in structs, as null ids are equal there.
    hits = hits.select(F.struct("doc_id", "item_id").alias("pair"), F.struct("item_id").alias("item"), "shift", "at", "window", "places")
    sizes = sizes.select(F.struct("item_id").alias("item"), "n_windows", "width")
    shifts = hits.groupBy("pair", "item", "shift").agg(F.countDistinct("at").alias("support")).join(sizes, "item")
    each = shifts.select("pair", "shift", "support", "n_windows", F.explode(spans).alias("span"))
    able = each.groupBy("pair", "span").agg(F.sum("support").alias("most"), F.first("n_windows").alias("n_windows")).where(F.col("most") >= need)
    near = hits.join(each.select("pair", "shift", "support", "span"), ["pair", "shift"]).join(able, ["pair", "span"])
    best = F.max(F.struct("support", (-F.col("shift")).alias("least"), F.size("places").alias("n"), "places"))["places"]
    taken = near.groupBy("pair", "span", "n_windows", "at").agg(F.first("window").alias("window"), best.alias("places"))
    enough = taken.groupBy("pair", "span", "n_windows").agg(F.countDistinct("window").alias("n")).where(F.col("n") >= need)
    values = taken.select("pair", "span", F.explode("places").alias("x")).groupBy("pair", "span", "x.place").agg(F.countDistinct("x.value").alias("n"))
    torn = values.where("n > 1").select("pair", "span").distinct()
    return enough.join(torn, ["pair", "span"], "left_anti").select("pair.doc_id", "pair.item_id").distinct().withColumn("occurs", F.lit(True))


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, occurrences: bool = True) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, n_verbatim, reparameterised): items found in documents.

    With ``occurrences`` an item is also found where one occurrence of it holds enough windows with one value for each
    of the item's slots, whatever the rest of the document holds; without, values are judged over the whole document.

    n_windows are the item's distinct windows, n_found those that the document holds, n_verbatim those that it holds
    with the item's values.  Null texts hold nothing; null ids group together as one id; repeated rows count once.
    Items of three or four tokens are found as they are anywhere, shorter ones only as the whole of a document.  An item
    of which over half the tokens are slots is found as it is only.  An empty table on either side gives no rows.
    Only doc_id, item_id and the texts are read.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    windows = scratch.write(item_windows(items).distinct(), "windows")
    sizes = windows.groupBy("item_id").agg(F.countDistinct("window").alias("n_windows"), F.max(F.col("at") + F.col("length") - 1).alias("width"))
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())
    found = document_windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lengths or [WINDOW])
    met = _joined(found, windows)
    met = scratch.write(met.select("doc_id", "item_id", "window", "at", (F.col("start") - F.col("at")).alias("shift"), "swaps", "own", "place", "near"), "met")
    slots = F.transform("place", lambda j: _value(F.get("near", j - F.col("at"))))
    met = met.withColumn("slots", slots).withColumn("same", F.col("own") == F.col("slots")).where("swaps or same")
    pairs = F.arrays_zip(F.col("own").alias("a"), F.col("slots").alias("b"))
    places = F.arrays_zip("place", F.col("slots").alias("value"))
    met = met.select("doc_id", "item_id", "window", "at", "shift", "same", pairs.alias("pairs"), places.alias("places"))
    counts = met.groupBy("doc_id", "item_id").agg(F.countDistinct("window").alias("n_found"), F.countDistinct(F.when(F.col("same"), F.col("window"))).alias("n_verbatim"))
    swapped = met.where(F.size("pairs") > 0).select("doc_id", "item_id", F.explode("pairs").alias("p")).distinct()
    broken = (
        swapped.groupBy("doc_id", "item_id", F.col("p.a").alias("a")).agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "item_id").distinct().withColumn("broken", F.lit(True))
    )
    occurring = _occurring(met, sizes, containment) if occurrences else counts.where("false").select("doc_id", "item_id", F.lit(True).alias("occurs"))
    verdict = (
        counts.join(sizes, counts.item_id.eqNullSafe(sizes.item_id)).drop(sizes.item_id)
        .alias("c").join(broken.alias("b"), F.expr("c.doc_id <=> b.doc_id and c.item_id <=> b.item_id"), "left")
        .join(occurring.alias("o"), F.expr("c.doc_id <=> o.doc_id and c.item_id <=> o.item_id"), "left")
        .select("c.*", F.coalesce("b.broken", F.lit(False)).alias("broken"), F.coalesce("o.occurs", F.lit(False)).alias("occurs"))
    )
    enough = lambda n: F.col(n) >= F.lit(containment) * F.col("n_windows")
    return (
        verdict.where(enough("n_verbatim") | (enough("n_found") & ~F.col("broken")) | F.col("occurs"))
        .select("doc_id", "item_id", "n_windows", "n_found", "n_verbatim", (~enough("n_verbatim")).alias("reparameterised"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, occurrences: bool = True) -> DataFrame:
    """The documents in which no item was found, all columns as they were; rows without an id are judged by their text."""
    scratch = Scratch(docs.sparkSession, "clean")
    keyed = docs.select(row_key().alias("key"), whole_row(docs).alias("row"))
    found = contaminated(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), benchmark, occurrences=occurrences)
    bad = scratch.write(found.select(F.col("doc_id").alias("key")).distinct(), "bad")
    return keyed.join(_small(bad), "key", "left_anti").select("row.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
