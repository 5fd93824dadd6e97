"""Clustering and elimination.  The folds depend on an order; each states it, and none depends on partitions."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.functions.sequence import minimizers
from locusflow.operators.components import components
from locusflow.operators.matching import align_pairs
from locusflow.operators.numbering import with_row_number
from locusflow.runtime import Stage, fold_sorted, ship

#: Groups that are clustered apart before their representatives are; a parameter of the result, not of the cluster.
GROUPS = 40


def _listed(by: str, key: object, ids: Iterable[str], name: str = "seqid") -> pd.DataFrame:
    return pd.DataFrame([(key, x) for x in ids], columns=[by, name], dtype=object)


def similar(rows: DataFrame, similarity: float, earlier: bool = False, others: DataFrame | None = None) -> DataFrame:
    """(group, member, other, similarity): the share of a member's words that another row of its group has, from ``similarity`` on.

    ``rows``: group, seqid, words (distinct), and place if only ``earlier`` rows count as others; ``others``: rows alike,
    if not all count.  A row that shares so much has in common at least one of the member's rarest words, as many as are
    left when the others would not do: only these are joined, so that words that all rows have bring no pairs together.
    """
    n, others = F.size("words"), rows if others is None else others
    least = F.greatest(F.lit(1), F.ceil(n * similarity - 1e-9))
    place = ["place"] if earlier else []
    each = rows.select("group", "seqid", *place, n.alias("n"), least.alias("least"), F.explode("words").alias("word"))
    theirs = others.select("group", "seqid", *place, F.explode("words").alias("word"))
    known = theirs.groupBy("group", "word").agg(F.count("*").alias("rows"))
    rarest = F.row_number().over(Window.partitionBy("group", "seqid").orderBy("rows", "word"))
    asked = each.join(known, ["group", "word"], "left").withColumn("rank", rarest).where(F.col("rank") <= F.col("n") - F.col("least") + 1)
    on = (F.col("a.group") == F.col("b.group")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.seqid") != F.col("b.seqid"))
    if earlier:
        on &= F.col("b.place") < F.col("a.place")
    pairs = asked.alias("a").join(theirs.alias("b"), on).select("a.group", F.col("a.seqid").alias("member"), F.col("b.seqid").alias("other")).distinct()
    words = lambda of, name, column: of.select("group", F.col("seqid").alias(name), F.col("words").alias(column))
    whole = pairs.join(words(rows, "member", "mine"), ["group", "member"]).join(words(others, "other", "theirs"), ["group", "other"])
    share = F.size(F.array_intersect("mine", "theirs")) / F.size("mine")
    return whole.select("group", "member", "other", share.alias("similarity")).where(F.col("similarity") >= similarity)


def _greedy(rows: DataFrame, similarity: float, top: int, stage: Stage, label: str) -> DataFrame:
    """(representative, member, similarity, length) within each group: rows by place, each joins the ``top`` most similar
    representatives before it (ties by identifier), or becomes one.

    ``rows``: group, seqid, place, length, words.  Rows with the words of an earlier one never become representatives, as
    they have one before them that it joined or is: so only kinds of words are linked, the first row of each.  A kind
    without an undecided similar one before it, and without such a representative, is a representative; kinds similar to
    it are members.  Rounds over written tables decide all as one pass in order would; then every row chooses among the
    representatives before it.
    """
    words = F.array_sort("words").alias("words")
    some = rows.where(F.size("words") > 0).select("group", "seqid", "place", words)
    kinds = stage.write(some.groupBy("group", "words").agg(F.min_by("seqid", "place").alias("seqid"), F.min("place").alias("place")), f"{label}-kinds")
    edges = stage.write(similar(kinds, similarity, True).select("member", F.col("other").alias("representative")), f"{label}-links")
    left, chosen, step = kinds.select("seqid"), [], 0
    while True:
        new = stage.write(left.join(edges.select(F.col("member").alias("seqid")).distinct(), "seqid", "left_anti"), f"{label}-new{step}")
        chosen.append(new)
        joined = stage.write(edges.join(new, edges.representative == new.seqid, "left_semi").select(F.col("member").alias("seqid")).distinct(), f"{label}-joined{step}")
        left = stage.write(left.join(new, "seqid", "left_anti").join(joined, "seqid", "left_anti"), f"{label}-left{step}")
        if left.isEmpty():
            break
        gone = joined.select(F.col("seqid").alias("member"))
        edges = edges.join(gone, "member", "left_anti").join(gone.withColumnRenamed("member", "representative"), "representative", "left_anti")
        edges = stage.write(edges.select("member", "representative"), f"{label}-edges{step}")
        step += 1
    reps = chosen[0]
    for more in chosen[1:]:
        reps = reps.unionAll(more)
    reps = stage.write(kinds.join(reps, "seqid", "left_semi").select("group", "seqid", "place", "words"), f"{label}-reps")
    near = similar(kinds, similarity, others=reps).select(F.col("member").alias("kind"), F.col("other").alias("representative"), "similarity")
    near = near.unionAll(reps.select(F.col("seqid").alias("kind"), F.col("seqid").alias("representative"), F.lit(1.0).alias("similarity")))
    near = near.join(reps.select(F.col("seqid").alias("representative"), F.col("place").alias("before")), "representative")
    members = rows.where(F.size("words") > 0).select("group", F.col("seqid").alias("member"), "place", "length", words)
    members = members.join(kinds.select("group", "words", F.col("seqid").alias("kind")), ["group", "words"]).join(reps.select(F.col("seqid").alias("member")), "member", "left_anti")
    best = F.row_number().over(Window.partitionBy("member").orderBy(F.desc("similarity"), "representative"))
    met = members.select("member", "place", "length", "kind").join(near, "kind").where(F.col("before") < F.col("place")).withColumn("rank", best).where(F.col("rank") <= top)
    alone = rows.where(F.size("words") == 0).select("seqid").unionAll(reps.select("seqid"))
    own = rows.join(alone, "seqid", "left_semi").select(F.col("seqid").alias("representative"), F.col("seqid").alias("member"), F.lit(1.0).alias("similarity"), "length")
    return met.select("representative", "member", "similarity", "length").unionAll(own)


def greedy_clusters(proteins: DataFrame, similarity: float = 0.2, top: int = 1, groups: int = GROUPS, k: int = 5, window: int = 5) -> DataFrame:
    """(representative, member, similarity, length) of (seqid, seq): longest first, ties by seqid.

    Sequences are cut by that order into ``groups`` that are clustered apart; then the representatives are clustered in
    the same order, and the members of one that joined another follow it.  No group is gathered: see _greedy().
    """
    stage = Stage(proteins.sparkSession)
    sized = proteins.select("seqid", F.length("seq").alias("length"), minimizers("seq", k, window).alias("words"))
    per = max(1, -(-proteins.count() // groups))
    placed = with_row_number(sized.withColumn("_size", -F.col("length")), "place", "_size", "seqid").drop("_size")
    placed = stage.write(placed.withColumn("group", F.floor((F.col("place") - 1) / per).cast("int")), "placed")
    first = stage.write(_greedy(placed, similarity, top, stage, "first"), "first")
    reps = placed.join(first.where("representative = member").select(F.col("member").alias("seqid")), "seqid", "left_semi").withColumn("group", F.lit(0))
    second = _greedy(reps, similarity, top, stage, "second")
    moved = second.select(F.col("member").alias("old"), F.col("representative").alias("new"), F.col("similarity").alias("s2"))
    joined = first.join(moved, first.representative == moved.old)
    same = F.col("representative") == F.col("member")
    return joined.select(F.col("new").alias("representative"), "member", F.when(same, F.col("s2")).otherwise(F.col("similarity")).alias("similarity"), "length")


def prune_near_representative(clusters: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """Clusters without the members that are as similar to a representative as the cutoff, in any cluster; representatives stay."""
    near = clusters.where((F.col("similarity") >= cutoff) & (F.col("representative") != F.col("member"))).select("member").distinct()
    return clusters.join(near, "member", "left_anti").select("representative", "member", "similarity", "length")


class _Pruning:
    """Members longest first; of each pair the shorter goes, or the other on ties; a member that is out is not looked at."""

    def __init__(self):
        self.out, self.now, self.skip = set(), None, False

    def step(self, r) -> list[tuple]:
        if r.member != self.now:
            self.now, self.skip = r.member, r.member in self.out
        loser = r.other if r.size >= r.other_size else r.member
        if self.skip or loser in self.out:
            return []
        self.out.add(loser)
        return [(r.group, loser)]

    def end(self) -> list[tuple]:
        return []


def prune_within(clusters: DataFrame, seqs: DataFrame, cutoff: float = 0.9, k: int = 5, window: int = 5) -> DataFrame:
    """(representative, member) to leave out: of two members of a cluster that share the cutoff of the minimizers of the
    one looked at, the shorter, or the other on ties.  Members are looked at longest first, ties by seqid; one that is
    out already is not looked at."""
    words = seqs.select(F.col("seqid").alias("member"), F.length("seq").alias("size"), minimizers("seq", k, window).alias("words"))
    members = clusters.where("representative <> member").select(F.col("representative").alias("group"), "member").join(words, "member")
    pairs = similar(members.withColumnRenamed("member", "seqid"), cutoff)
    sizes = members.select("group", "member", "size")
    pairs = pairs.join(sizes, ["group", "member"]).join(sizes.select("group", F.col("member").alias("other"), F.col("size").alias("other_size")), ["group", "other"])
    found = fold_sorted(pairs.select("group", "member", "other", "size", "other_size"), "group", [F.desc("size"), "member", "other"], _Pruning, "group string, member string")
    return found.withColumnRenamed("group", "representative")


class _Elimination:
    """Hits in order: of a query and a target that are both in, the shorter goes, or the target on ties."""

    def __init__(self):
        self.out = set()

    def step(self, r) -> list[tuple]:
        if r.query in self.out or (r.own > 0 and r.target in self.out):
            return []
        loser = r.query if not r.own > 0 or r.t_len > r.q_len else r.target
        self.out.add(loser)
        return [(r.key, loser)]

    def end(self) -> list[tuple]:
        return []


def _rated(hits: DataFrame, by: str, level: float, alone: bool) -> DataFrame:
    """Hits between two sequences whose score by the query's with itself reaches ``level``; with ``alone`` also those of
    queries without a score with themselves, whose ``own`` is 0."""
    own = hits.where("query = target").groupBy(by, "query").agg(F.max("score").alias("own"))
    both = hits.where("query <> target").join(own, [by, "query"], "left").withColumn("own", F.coalesce("own", F.lit(0.0)).cast("double"))
    good = F.try_divide("score", "own") >= level
    return both.where(good | (F.col("own") <= 0) if alone else good)


def eliminate_by_bsr(hits: DataFrame, lengths: DataFrame, threshold: float = 0.6, by: str = "cluster") -> DataFrame:
    """(by, seqid) to leave out, hit by hit in the order of (query, target) within each group.

    A query that is in and a target that is in, at a ratio of the threshold or more, lose the shorter of them, the target
    on ties.  A query without a score with itself is left out.  ``hits``: by, query, target, score; ``lengths``: seqid, length.
    Only hits that can put something out are folded, and they stream through.
    """
    sized = _rated(hits.select(by, "query", "target", "score"), by, threshold, True).join(lengths.select(F.col("seqid").alias("query"), F.col("length").alias("q_len")), "query").join(
        lengths.select(F.col("seqid").alias("target"), F.col("length").alias("t_len")), "target"
    )
    kind = hits.schema[by].dataType.simpleString()
    rows = sized.select(F.col(by).alias("key"), "query", "target", "own", "q_len", "t_len")
    return fold_sorted(rows, "key", ["query", "target"], _Elimination, f"key {kind}, seqid string").withColumnRenamed("key", by)


def near_pairs(seqs: DataFrame, similarity: float, k: int = 5, window: int = 5) -> DataFrame:
    """(group, query, query_seq, target, target_seq) of (group, seqid, seq): every two of a group of which the target has
    that share of the query's minimizers, one at least, and every sequence that is not empty with itself."""
    rows = seqs.select("group", "seqid", minimizers("seq", k, window).alias("words"))
    near = similar(rows, similarity).select("group", F.col("member").alias("query"), F.col("other").alias("target"))
    own = seqs.where("seq <> ''").select("group", F.col("seqid").alias("query"), F.col("seqid").alias("target"))
    texts = lambda name: seqs.select("group", F.col("seqid").alias(name), F.col("seq").alias(f"{name}_seq"))
    both = near.unionAll(own).distinct().join(texts("query"), ["group", "query"]).join(texts("target"), ["group", "target"])
    return both.select("group", "query", "query_seq", "target", "target_seq")


def eliminate_near(seqs: DataFrame, lengths: DataFrame, similarity: float, threshold: float, stage: Stage) -> DataFrame:
    """(cluster, seqid) to leave out of (seqid, seq), within the connected components of all near pairs; a component is
    named after its least sequence."""
    numbered = stage.write(with_row_number(seqs.select("seqid", "seq"), "number", "seqid"), "numbered")
    pairs = stage.write(near_pairs(numbered.select(F.lit(0).alias("group"), "seqid", "seq"), similarity).drop("group"), "near")
    number = lambda name, of: numbered.select(F.col("seqid").alias(of), F.col("number").cast("long").alias(name))
    links = pairs.where("query <> target").select("query", "target").join(number("u", "query"), "query").join(number("v", "target"), "target")
    roots = components(links.select("u", "v"), stage).select(F.col("node").alias("u"), F.col("root").alias("cluster"))
    of = number("u", "query").join(roots, "u", "left").select("query", F.coalesce("cluster", "u").alias("root")).join(number("root", "cluster"), "root").drop("root")
    return eliminate_by_bsr(align_pairs(pairs.join(of, "query").repartition("query", "target")), lengths, threshold)


class _Selection:
    """Hits in order: a query that is in puts its target out."""

    def __init__(self):
        self.out = set()

    def step(self, r) -> list[tuple]:
        if r.query in self.out or r.target in self.out:
            return []
        self.out.add(r.target)
        return [(r.locus, r.target)]

    def end(self) -> list[tuple]:
        return []


def select_representatives(hits: DataFrame, candidates: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(locus, seqid) that stay as new representatives: hits by the query's length, short ones first; a query that is in
    puts a target at a tenth above the threshold out.  ``hits``: locus, query, target, q_len, score; ``candidates``: locus, seqid."""
    rated = _rated(hits.select("locus", "query", "target", "q_len", "score"), "locus", threshold + 0.1, False)
    gone = fold_sorted(rated, "locus", ["q_len", "query", "target"], _Selection, "locus string, seqid string")
    return candidates.join(gone, ["locus", "seqid"], "left_anti")


def represent(proteins: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(locus, seqid) of representatives: for each locus, proteins until each has one at the threshold's ratio.

    ``proteins``: locus, seqid, seq, distinct.  The longest comes first; then the longest of those that hit within a tenth
    above the threshold, else the longest left.  Ties by seqid.  A locus is one group, bounded by its alleles.
    """
    ship(proteins.sparkSession)

    def loop(rows: pd.DataFrame) -> pd.DataFrame:
        from locusflow.functions.align import align, align_many

        rows = rows.assign(n=rows["seq"].str.len()).sort_values(["n", "seqid"], ascending=[False, True], kind="stable")
        seq = dict(zip(rows["seqid"], rows["seq"], strict=True))
        left, chosen, close = list(rows["seqid"]), [], set()
        while left:
            rep = left[0]
            if chosen:
                rep = next((s for s in left if s in close), left[0])
            chosen.append(rep)
            own = align(seq[rep], seq[rep])[0]
            others = [s for s in left if s != rep]
            found = align_many([seq[rep]] * len(others), [seq[s] for s in others])
            ratios = {s: x[0] / own if own else 0.0 for s, x in zip(others, found, strict=True)}
            left = [s for s, x in ratios.items() if x < threshold + 0.1]
            close = {s for s in left if s in close or ratios[s] >= threshold}
            if len(close) == len(left):
                break
        return _listed("locus", rows["locus"].iloc[0], chosen)

    return proteins.groupBy("locus").applyInPandas(loop, "locus string, seqid string")
