"""Repair of the structure of conversations: the cheapest edits after which the roles follow one another.

Each conversation keeps or reroles a subsequence of its turns.  Prefix sums of the deletions price every gap between
retained turns; per state of the roles a running minimum, from the last turn backwards, holds the cheapest way on; the
pair of the state and the retained role determines the turns to insert.  Of ways of equal cost the one with the least
audit wins: a deletion comes before everything, and two ways that differ in the next turn differ in their first letter.

A conversation is not gathered.  Turns lie in ranges of the order by conversation and turn, so a long one falls into
several; its part in one range is a segment, for which the minima are found for every state that it can be entered and
left in.  Segments are joined in order by these sixteen costs and audits, the way distances are.
"""

from __future__ import annotations

import hashlib
import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.shared import Scratch, table
from locusflow.runtime import fold_sorted

#: The price of an edit, and of keeping a turn that breaks off.
DELETE, INSERT, REROLE, BROKEN = 4, 3, 3, 3

#: States: nothing retained, and the initial of the role retained last.  ``NEXT`` are the roles that may follow.
STATES = ("", "s", "u", "a")
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
#: Turns inserted at the end, by state; only an empty result or one that ends with an answer is whole.
TAIL = {"": "", "s": "UA", "u": "A", "a": ""}
#: Codes of edits: K keeps, u and a rerole to user and assistant, D deletes, x deletes a repetition of the turn before,
#: U and A insert in front.
LETTER = str.maketrans("uaUAx", "RRIID")
_UNIT = "[UA]*[KDua]x*"


def _ways(initial: str) -> list[list[tuple[int, str, int]]]:
    """By state: (price, codes, state after) of the ways to retain a turn, the cheapest and least of each state after."""
    found = []
    for start in STATES:
        best: dict[int, tuple[int, str, str]] = {}
        state, before = start, ""
        for _ in range(3):
            keep = [(0, "K", initial)] if initial in NEXT[state] and initial else []
            rerole = [(REROLE, to, to) for to in "ua" if to in NEXT[state]]
            for price, code, to in keep + rerole:
                way = (price + INSERT * len(before), (before + code).translate(LETTER), before + code)
                at = STATES.index(to)
                best[at] = min(best.get(at, way), way)
            state = "a" if state == "u" else "u"
            before += state.upper()
        found.append([(price, code, at) for at, (price, _, code) in best.items()])
    return found


#: The kinds of turns: the initial of a known role, or o; in upper case if the text breaks off.
WAYS = {kind: _ways(kind) for kind in "suao"} | {kind.upper(): _ways(kind) for kind in "suao"}


def segment_ways(turns: list[tuple[str, int]]) -> tuple[list[int | None], list[str | None]]:
    """Costs and codes from each state at the start of some turns to each state at their end, by 4 * start + end; null if none.

    A turn is (kind, copies): one of the kinds above, or ``D`` if it must be deleted; copies beyond the first repeat it
    and must go.
    """
    n = len(turns)
    gone = [0, *itertools.accumulate(DELETE * copies for _, copies in turns)]
    costs: list[int | None] = [None] * 16
    codes: list[str | None] = [None] * 16
    for end in range(4):
        best = [gone[n] if s == end else math.inf for s in range(4)]
        chosen: list[list | None] = [None] * n
        for j in range(n - 1, -1, -1):
            kind, copies = turns[j]
            if kind == "D":
                continue
            ways = WAYS[kind]
            extra = DELETE * (copies - 1) + (BROKEN if kind.isupper() else 0) + gone[j] - gone[j + 1]
            new, picks = best.copy(), [None] * 4
            for s in range(4):
                for price, code, to in ways[s]:
                    cost = best[to] + price + extra
                    # At equal cost the deletion stays, as its letter is the least; of two ways the lesser letters win.
                    if cost < new[s] or (cost == new[s] and picks[s] and code.translate(LETTER) < picks[s][0].translate(LETTER)):
                        new[s], picks[s] = cost, (code, to)
            best, chosen[j] = new, picks
        for start in range(4):
            if best[start] == math.inf:
                continue
            state, out = start, []
            for j, (_, copies) in enumerate(turns):
                pick = chosen[j][state] if chosen[j] else None
                code, state = pick if pick else ("D", state)
                out.append(code + "x" * (copies - 1))
            costs[4 * start + end], codes[4 * start + end] = int(best[start]), "".join(out)
    return costs, codes


class _Segment:
    """The turns of one segment as they stream by; at its end the row of its ways."""

    def __init__(self):
        self.turns: list[tuple[str, int]] = []
        self.illegal, self.before = 0, None

    def step(self, row) -> list:
        if not self.turns:
            self.conv, self.chunk, self.place, self.first = row.conv, row.chunk, row.place, row.initial
        else:
            self.illegal += self.before + row.initial not in LEGAL
        self.illegal += row.copies - 1
        self.before = row.initial
        self.turns.append((row.kind, row.copies))
        return []

    def end(self) -> list:
        costs, codes = segment_ways(self.turns)
        return [(self.conv, self.chunk, self.place, self.first, self.before, self.illegal, costs, codes)]


SEGMENTS = "conv string, chunk long, place long, first string, last string, illegal long, costs array<long>, codes array<string>"
#: Pairs of initials that may follow one another.
LEGAL = ("su", "ua", "au")


class _Chain:
    """The segments of one conversation as they stream by: the cheapest way to each state, and how it came there.

    Ways to different states are ranked by their audits, so that those of equal cost need no text of earlier segments:
    two audits of the same turns differ before either ends.
    """

    def __init__(self):
        self.ways: dict[int, tuple[int, int]] = {0: (0, 0)}
        self.origins: list[dict[int, int]] = []
        self.chunks: list[int] = []
        self.illegal, self.last = 0, None

    def step(self, row) -> list:
        self.conv = row.conv
        self.illegal += row.illegal + (self.last is not None and self.last + row.first not in LEGAL)
        self.last = row.last
        found = {}
        for start, (cost, rank) in self.ways.items():
            for end in range(4):
                code = row.codes[4 * start + end]
                if code is not None:
                    way = (cost + int(row.costs[4 * start + end]), rank, code.translate(LETTER), start)
                    found[end] = min(found.get(end, way), way)
        order = sorted({way[1:3] for way in found.values()})
        self.ways = {end: (way[0], order.index(way[1:3])) for end, way in found.items()}
        self.origins.append({end: way[3] for end, way in found.items()})
        self.chunks.append(row.chunk)
        return []

    def end(self) -> list:
        ends = {at: (cost + INSERT * len(TAIL[STATES[at]]), rank, len(TAIL[STATES[at]])) for at, (cost, rank) in self.ways.items()}
        at = min(ends, key=ends.get)
        cost, tail, out = ends[at][0], TAIL[STATES[at]], []
        for chunk, origin in zip(reversed(self.chunks), reversed(self.origins), strict=True):
            out.append((self.conv, chunk, 4 * origin[at] + at, tail, cost, self.illegal))
            at, tail, cost = origin[at], "", None
        return out


CHOSEN = "conv string, chunk long, way int, tail string, cost long, illegal long"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def with_faults(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct turns with conv (the id as text, empty for null), copies, place (their order), chunk, and their faults."""
    keyed = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    distinct = keyed.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    order = ("conv", "turn", "role", "text")
    placed = distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = scratch.write(placed.withColumn("digest", F.sha2(F.concat_ws("\x00", "role", "text"), 256)), "placed")
    # A turn with role and text of an earlier one lies at another place than the first of them.
    first = placed.groupBy("conv", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    broken = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    marked = placed.select("conv", "turn", "role", "digest", "copies", "place", initial.alias("initial"), kind.alias("kind"), blank.alias("blank"), broken.alias("broken"))
    marked = marked.join(first, ["conv", "role", "digest"], "left").withColumn("again", F.coalesce(F.col("first") < F.col("place"), F.lit(False)))
    return marked.select(
        "conv", "turn", "place", F.shiftright("place", 33).alias("chunk"), "copies", "initial",
        F.when(F.col("blank") | F.col("again"), "D").when(F.col("broken"), F.upper("kind")).otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("blank"), F.col("copies")).otherwise(0).alias("blank"),
        F.when(F.col("blank"), 0).when(F.col("again"), F.col("copies")).otherwise(F.col("copies") - 1).alias("duplicate"),
        F.when(F.col("blank") | F.col("again") | ~F.col("broken"), 0).otherwise(1).alias("truncated"),
    )


class Repair:
    """Edits, repaired turns and audits of the conversations of ``turns`` (conv_id, turn, role, text).

    Turns are taken by turn, nulls first, then by role and text.  Null roles and texts count as one space, a null id is a
    conversation like any other, repeated rows are turns that must be deleted.  Other columns are not read; an empty table
    gives empty results.
    """

    def __init__(self, turns: DataFrame):
        self.scratch = Scratch(turns.sparkSession, "repair")
        self.faults = self.scratch.write(with_faults(turns, self.scratch), "faults")
        self.placed = turns.sparkSession.read.parquet(f"{self.scratch.root}/placed")
        segment = self.faults.withColumn("segment", F.concat_ws(":", "chunk", "conv"))
        ways = fold_sorted(segment.select("segment", "conv", "chunk", "place", "initial", "kind", "copies"), "segment", ["place"], _Segment, SEGMENTS)
        self.segments = self.scratch.write(ways, "segments")
        chosen = fold_sorted(self.segments.select("conv", "chunk", "first", "last", "illegal", "costs", "codes"), "conv", ["chunk"], _Chain, CHOSEN)
        chosen = chosen.join(self.segments.select("conv", "chunk", "place", "codes"), ["conv", "chunk"])
        self.chosen = self.scratch.write(chosen.select("conv", "chunk", "place", F.get("codes", "way").alias("code"), "tail", "cost", "illegal"), "chosen")

    def edits(self) -> DataFrame:
        """(conv, place, code) of every distinct turn: what is done with it and its copies, and inserted before it."""
        each = self.chosen.select("conv", "place", F.posexplode(F.regexp_extract_all("code", F.lit(_UNIT), 0)).alias("at", "code"))
        return each.select("conv", (F.col("place") + F.col("at")).alias("place"), "code")

    def turns(self) -> DataFrame:
        """(conv, place, step, role, text) of the repaired conversations; step orders the turns of a place."""
        named = lambda c: F.when(c.isin("u", "U"), "user").otherwise("assistant")
        new = lambda step, role: F.struct(step.cast("int").alias("step"), role.alias("role"), F.lit("").alias("text"))
        inserted = lambda codes: F.transform(F.split(codes, ""), lambda c, i: new(i, named(c)))
        both = self.placed.select("place", "role", "text").join(self.edits(), "place")
        ahead, own = F.regexp_extract("code", "^[UA]*", 0), F.regexp_extract("code", "[KDua]", 0)
        kept = F.struct(F.length(ahead).alias("step"), F.when(own == "K", F.col("role")).otherwise(named(own)).alias("role"), F.col("text"))
        added = F.when(ahead == "", F.array().cast("array<struct<step:int,role:string,text:string>>")).otherwise(inserted(ahead))
        lines = F.when(own == "D", added).otherwise(F.concat(added, F.array(kept)))
        last = self.chosen.where("tail <> ''").select("conv", F.lit((1 << 63) - 1).alias("place"), F.explode(inserted(F.col("tail"))).alias("line"))
        return both.select("conv", "place", F.explode(lines).alias("line")).unionByName(last).select("conv", "place", "line.*")

    def audits(self) -> DataFrame:
        """(conv, illegal, cost, audit) of every conversation with a turn; the audit is one letter a turn, so it is one cell."""
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "code"))), lambda x: x["code"]), "")
        whole = self.chosen.groupBy("conv").agg(F.max("illegal").alias("illegal"), F.max("cost").alias("cost"), F.concat(joined, F.max("tail")).alias("codes"))
        return whole.select("conv", "illegal", "cost", F.translate("codes", "uaUAx", "RRIID").alias("audit"))

    def counts(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated) of every conversation with a turn."""
        per_turn = self.faults.groupBy("conv", "turn").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
        return per_turn.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


class _Digest:
    """SHA-256 of the lines of a conversation as they stream by; nothing of them is held."""

    def __init__(self):
        self.hash, self.empty = hashlib.sha256(), True

    def step(self, row) -> list:
        self.conv = row.conv
        self.hash.update(("" if self.empty else "\n").encode() + row.line.encode())
        self.empty = False
        return []

    def end(self) -> list:
        return [(self.conv, self.hash.hexdigest())]


def digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the conversations with a repaired turn."""
    lines = turns.select("conv", "place", "step", F.concat_ws(":", "role", "text").alias("line"))
    return fold_sorted(lines, "conv", ["place", "step"], _Digest, "conv string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with the damage of the test: by the crc32 of `conv_id:turn` modulo 20."""
    harm = F.crc32(F.concat_ws(":", _text("conv_id"), _text("turn")).cast("binary")) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace(_text("text"), "[.!?]", "")).otherwise(_text("text"))
    rows = conversations.select("conv_id", "turn", F.when(harm == 4, "user").otherwise(_text("role")).alias("role"), text.alias("text"), harm.alias("harm"))
    repeated = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where("harm <> 0").select("conv_id", "turn", "role", "text", repeated.alias("copy")).drop("copy")


def report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row of every conv_id of ``conversations``: the faults of ``turns``, and cost, audit and digest of their repair."""
    repair = Repair(turns)
    every = conversations.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    found = every.join(repair.counts(), "conv", "left").join(repair.audits(), "conv", "left").join(digests(repair.turns()), "conv", "left")
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in longs],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return report(conversations, damage(conversations))


def _step(state: str, retained: list[tuple[str, str, str, str]], gone: str) -> str:
    """SQL of the best way to a state: by deletion of the turn, or by (state before, condition, price and letters, lines)."""
    ways = [f"CASE WHEN {when} THEN {{'c': r.{before}.c + {price} + w.broken, 't': r.{before}.t || {letters}, 'x': r.{before}.x || {lines}}} END" for before, when, price, letters, lines in retained]
    return f"least({', '.join([gone, *ways])}) AS {state}"


def _sql() -> str:
    own, user, answer = "w.role || ':' || w.text || chr(10)", "'user:' || w.text || chr(10)", "'assistant:' || w.text || chr(10)"
    put = {"u": "'user:' || chr(10) || ", "a": "'assistant:' || chr(10) || "}
    gone = {s: f"{{'c': r.{s}.c + 4, 't': r.{s}.t || 'D', 'x': r.{s}.x}}" for s in ("n", "s", "u", "a")}
    may = "NOT w.gone"
    to_user = [(b, f"{may} AND w.initial = 'u'", 0, "'K'", own) for b in "nsa"] + [(b, may, 3, "'R'", user) for b in "nsa"]
    to_user += [("u", f"{may} AND w.initial = 'u'", 3, "'IK'", put["a"] + own), ("u", may, 6, "'IR'", put["a"] + user)]
    to_answer = [("u", f"{may} AND w.initial = 'a'", 0, "'K'", own), ("u", may, 3, "'R'", answer)]
    to_answer += [(b, f"{may} AND w.initial = 'a'", 3, "'IK'", put["u"] + own) for b in "nsa"] + [(b, may, 6, "'IR'", put["u"] + answer) for b in "nsa"]
    to_system = [("n", f"{may} AND w.initial = 's'", 0, "'K'", own)]
    steps = ",\n         ".join([gone["n"] + " AS n", _step("s", to_system, gone["s"]), _step("u", to_user, gone["u"]), _step("a", to_answer, gone["a"])])
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab
  FROM range(256) t(i)),
harmed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS harm
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy
  FROM harmed WHERE harm <> 0),
numbered AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), '') AS conv,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i
  FROM damaged),
judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS rest, left(role, 1) AS initial,
         lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS previous
  FROM numbered),
w AS (SELECT *, blank OR again AS gone, CASE WHEN rest THEN 3 ELSE 0 END AS broken FROM judged),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(again AND NOT blank) AS duplicate, count_if(rest AND NOT again AND NOT blank) AS truncated,
         count_if(i > 1 AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS turns
  FROM w GROUP BY conv),
r AS (
  SELECT conv, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 't': '', 'x': ''}} AS n,
         {', '.join(f"{{'c': CAST(1000000000000 AS BIGINT), 't': '', 'x': ''}} AS {s}" for s in 'sua')}
  FROM counts
  UNION ALL
  SELECT r.conv, w.i, {steps}
  FROM r JOIN w ON w.conv = r.conv AND w.i = r.i + 1),
best AS (
  SELECT conv, least(n, {{'c': s.c + 6, 't': s.t || 'II', 'x': s.x || 'user:' || chr(10) || 'assistant:' || chr(10)}},
         {{'c': u.c + 3, 't': u.t || 'I', 'x': u.x || 'assistant:' || chr(10)}}, a) AS b
  FROM r JOIN counts USING (conv) WHERE r.i = counts.turns)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.t, '') AS audit,
       sha256(CASE WHEN coalesce(b.x, '') = '' THEN '' ELSE left(b.x, length(b.x) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS conv FROM conversations) o
LEFT JOIN counts ON counts.conv = o.conv LEFT JOIN best ON best.conv = o.conv
"""


#: Whole conversations, forwards, with the texts of every way: what the segments' minima must agree with.
OP11_SQL = _sql()
