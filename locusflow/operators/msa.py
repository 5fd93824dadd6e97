"""Alignment of the sequences of each locus, progressively: the most alike are joined first, profile with profile.

Sequences of a locus stand in the order of a sketch of their k-mers, which puts like ones side by side.  In rounds over
written tables, every two neighbours that are more alike, by k-mers, than either is to its other neighbour are aligned
and become one node; a locus of n sequences takes about the logarithm of n rounds.  A node is a profile, the counts of
the residues of each column, and the k-mers of its consensus.  A locus of few nodes is finished in one task, which goes on
in the same rounds.  The sequences follow by a join: what merges say of the columns puts the gaps into all of a node's
members.  So no row, task or driver ever holds an alignment; a task holds a bounded number of profiles.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.functions.align import RESIDUES, matrix
from locusflow.runtime import Stage, ship

#: Length of the k-mers, and hashes in the sketch that orders the sequences.
KMER, SKETCH = 4, 3
#: Price of a gap against a whole column, in units of the substitution scores.
GAP = 6.0
#: Nodes, and columns of all of them, up to which a locus is finished in one task.
FINISH, COLUMNS = 1024, 1 << 18

_KINDS = len(RESIDUES) + 1
_INDEX = np.full(256, _KINDS - 1, np.uint8)
_INDEX[[ord(c) for c in RESIDUES]] = range(_KINDS - 1)
_SCORES = np.zeros((_KINDS, _KINDS))
_SCORES[:-1, :-1] = matrix()[np.ix_([ord(c) for c in RESIDUES], [ord(c) for c in RESIDUES])]
_SCORES[-1, :] = _SCORES[:, -1] = -1


def profile_of(seq: str) -> np.ndarray:
    """Counts of residues by column, the last kind for all other letters."""
    raw = np.frombuffer(seq.upper().encode("latin-1", "replace"), np.uint8)
    return np.eye(_KINDS)[_INDEX[raw]]


def consensus(profile: np.ndarray) -> str:
    """The commonest residue of each column that at least half of the sequences have."""
    total = profile.sum(1)
    letters = np.array([*RESIDUES, "X"])[profile.argmax(1)]
    return "".join(letters[2 * total >= total.max(initial=0)])


def merge(a: np.ndarray, b: np.ndarray, gap: float = GAP) -> tuple[list[int], list[int]]:
    """For each column of the best alignment of two profiles the column of either, or -1 for a gap.

    Columns score by the mean over pairs of sequences, in which a residue against a gap costs ``gap``, and so does a new gap
    for every residue it stands against: the best alignment has the highest pair_score() between the two.  Rows are computed whole, the gaps along a row by running maxima; ties go to no gap, then to one in ``b``.
    """
    n, m = len(a), len(b)
    na, nb = max(1.0, a.sum(1).max(initial=0)), max(1.0, b.sum(1).max(initial=0))
    full_a, full_b = a.sum(1) / na, b.sum(1) / nb
    against = full_a[:, None] * (1 - full_b) + (1 - full_a[:, None]) * full_b
    pairs = (a / na) @ _SCORES @ (b / nb).T - gap * against
    cost_a, cost_b = gap * full_a, gap * full_b
    down, along = np.concatenate([[0], np.cumsum(cost_a)]), np.concatenate([[0], np.cumsum(cost_b)])
    h = np.zeros((n + 1, m + 1))
    h[0], h[:, 0] = -along, -down
    row, up = np.empty(m + 1), np.empty(m)
    for i in range(1, n + 1):
        last = h[i - 1]
        np.add(last[:-1], pairs[i - 1], out=row[1:])
        np.subtract(last[1:], cost_a[i - 1], out=up)
        np.maximum(row[1:], up, out=row[1:])
        row[0] = h[i, 0]
        row += along
        np.maximum.accumulate(row, out=row)
        np.subtract(row, along, out=h[i])
    # Where each step is one of the best alignment's, for all cells at once.
    near = lambda x: np.abs(x) <= 1e-7
    both = near(h[1:, 1:] - (h[:-1, :-1] + pairs)).tobytes()
    above = near(h[1:] - (h[:-1] - cost_a[:, None])).tobytes()
    left, right, i, j = [], [], n, m
    while i or j:
        if i and j and both[(i - 1) * m + j - 1]:
            i, j = i - 1, j - 1
            left.append(i)
            right.append(j)
        elif i and (not j or above[(i - 1) * (m + 1) + j]):
            i -= 1
            left.append(i)
            right.append(-1)
        else:
            j -= 1
            left.append(-1)
            right.append(j)
    return left[::-1], right[::-1]


def joined(a: np.ndarray, b: np.ndarray, left: list[int], right: list[int]) -> np.ndarray:
    """The profile of two aligned ones."""
    rows = np.zeros((len(left), _KINDS))
    for profile, columns in ((a, left), (b, right)):
        at = np.array(columns, int)
        rows[at >= 0] += profile[at[at >= 0]]
    return rows


_MERGED = T.StructType().add("profile", T.BinaryType()).add("cols_left", T.ArrayType(T.IntegerType())).add("cols_right", T.ArrayType(T.IntegerType())).add("consensus", T.StringType())


def _stored(profile: np.ndarray) -> bytes:
    return b"\1" + profile.astype("<f4").tobytes()


def _profile(raw: bytes) -> np.ndarray:
    """The profile of a node: one letter's kind a column for a sequence, else counts."""
    if raw[:1] == b"\0":
        return np.eye(_KINDS)[np.frombuffer(raw, np.uint8, offset=1)]
    return np.frombuffer(raw, "<f4", offset=1).reshape(-1, _KINDS).astype(float)


@F.pandas_udf(_MERGED)
def _merged(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    out = []
    for x, y in zip(left, right, strict=True):
        a, b = _profile(x), _profile(y)
        cl, cr = merge(a, b)
        both = joined(a, b, cl, cr)
        out.append((_stored(both), cl, cr, consensus(both)))
    return pd.DataFrame(out, columns=["profile", "cols_left", "cols_right", "consensus"])


@F.pandas_udf(T.BinaryType())
def _first(seq: pd.Series) -> pd.Series:
    return seq.map(lambda s: b"\0" + _INDEX[np.frombuffer(s.upper().encode("latin-1", "replace"), np.uint8)].tobytes())


def _finished(rows: pd.DataFrame) -> pd.DataFrame:
    """(node, cols): the columns of each node of a locus in its whole alignment, by the rounds of align_groups()."""
    rows = rows.sort_values("rank", kind="stable")
    words = lambda text: {text[i : i + KMER] for i in range(max(1, len(text) - KMER + 1))}
    now = []  # (node, profile, k-mers, columns by the given nodes under it)
    for node, raw in zip(rows["node"], rows["profile"], strict=True):
        profile = _profile(raw)
        now.append((int(node), profile, words(consensus(profile)), {int(node): np.arange(len(profile))}))
    links: dict[tuple[int, int], tuple] = {}
    while len(now) > 1:
        for (u, _, x, _), (v, _, y, _) in zip(now, now[1:], strict=False):
            if (u, v) not in links:
                links[u, v] = (-len(x & y) / max(1, min(len(x), len(y))), zlib.crc32(b"%d %d" % (u, v)), u)
        order = [links[u[0], v[0]] for u, v in zip(now, now[1:], strict=False)]
        best = {k for k, x in enumerate(order) if (k == 0 or x < order[k - 1]) and (k + 1 == len(order) or x < order[k + 1])}
        links, after, k = {x: y for k, (x, y) in enumerate(zip(((u[0], v[0]) for u, v in zip(now, now[1:], strict=False)), order, strict=True)) if not best & {k - 1, k, k + 1}}, [], 0
        while k < len(now):
            if k in best:
                (node, a, _, under), (_, b, _, more) = now[k], now[k + 1]
                cl, cr = merge(a, b)
                both = joined(a, b, cl, cr)
                spread = lambda of, columns: {x: np.where(columns < 0, -1, y[columns]) if len(y) else columns for x, y in of.items()}
                after.append((node, both, words(consensus(both)), spread(under, np.array(cl, int)) | spread(more, np.array(cr, int))))
            else:
                after.append(now[k])
            k += 1 + (k in best)
        now = after
    return pd.DataFrame({"node": list(now[0][3]), "cols": list(now[0][3].values())})


def _words(text: str):
    """Hashes of the distinct k-mers; a shorter text is its own."""
    n = F.length(text) - (KMER - 1)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.substr(text, i, F.lit(KMER))))
    return F.array_distinct(F.when(n >= 1, each).otherwise(F.array(F.xxhash64(text))))


def _spread(members: DataFrame, moves: DataFrame) -> DataFrame:
    """The members of nodes in the columns that ``moves`` (node, to, cols) has for these; others stay as they are."""
    letters = F.array(F.split("aligned", ""))
    # An array around the letters, so that they are split once and not for every column.
    spread = F.element_at(F.transform(letters, lambda x: F.array_join(F.transform("cols", lambda i: F.when(i < 0, F.lit("-")).otherwise(F.get(x, i))), "")), 1)
    return members.join(moves, "node", "left").select("group", "leaf", F.coalesce("to", "node").alias("node"), F.when(F.col("cols").isNull(), F.col("aligned")).otherwise(spread).alias("aligned"))


def align_groups(seqs: DataFrame, stage: Stage | None = None, finish: int = FINISH) -> DataFrame:
    """(locus, seq, aligned) of the distinct sequences of each locus of ``seqs`` (locus, seq).

    Lower case counts as upper; letters that are no residues resemble nothing.  Null sequences are left out, an empty one
    is all gaps, and a locus with one sequence has that.  Locus may be null, as a group of its own.  A locus of ``finish``
    nodes or fewer is finished in one task, if they are not too long.
    """
    stage = stage or Stage(seqs.sparkSession)
    ship(seqs.sparkSession)
    own = stage.write(seqs.where("seq is not null").select(F.coalesce(F.to_json(F.struct("locus")), F.lit("")).alias("group"), "locus", "seq").distinct().withColumn("leaf", F.monotonically_increasing_id()), "msa-leaves")
    members = own.select("group", "leaf", F.col("leaf").alias("node"), F.col("seq").alias("aligned"))
    sketch = F.slice(F.array_sort("words"), 1, SKETCH)
    nodes = own.withColumn("words", _words("seq")).select("group", F.col("leaf").alias("node"), F.struct(sketch.alias("sketch"), "seq", "leaf").alias("place"), "words", _first("seq").alias("profile"))
    nodes, ready, step = stage.write(nodes, "msa-nodes"), [], 0
    columns = F.when(F.substring("profile", 1, 1) == F.lit(b"\0"), F.octet_length("profile") - 1).otherwise(F.octet_length("profile") / (4 * _KINDS))
    while True:
        few = nodes.groupBy("group").agg(F.count("*").alias("n"), F.sum(columns).alias("columns")).where((F.col("n") <= finish) & (F.col("columns") <= COLUMNS))
        few = stage.write(few.select("group"), f"msa-few{step}")
        ready.append(nodes.join(few, "group", "left_semi"))
        nodes = nodes.join(few, "group", "left_anti")
        if nodes.isEmpty():
            break
        row = Window.partitionBy("group").orderBy("place")
        beside = nodes.select("group", "node", "place", "words").withColumn("other", F.lead("node").over(row)).withColumn("theirs", F.lead("words").over(row))
        share = F.size(F.array_intersect("words", "theirs")) / F.greatest(F.lit(1), F.least(F.size("words"), F.size("theirs")))
        # Of equal neighbours chance decides, so that a run of them is joined in many places at once.
        rated = beside.select("group", "node", "place", "other", F.when(F.col("other").isNotNull(), F.struct((-share).alias("far"), F.xxhash64("node", "other").alias("lot"), "node")).alias("link"))
        last, following = F.lag("link").over(row), F.lead("link").over(row)
        best = F.col("other").isNotNull() & (last.isNull() | (F.col("link") < last)) & (following.isNull() | (F.col("link") < following))
        chosen = stage.write(rated.withColumn("best", best).where("best").select("node", "other"), f"msa-chosen{step}")
        if chosen.isEmpty():
            break
        profiles = nodes.select("node", "profile")
        both = chosen.join(profiles, "node").join(profiles.select(F.col("node").alias("other"), F.col("profile").alias("theirs")), "other")
        done = stage.write(both.select("node", "other", _merged("profile", "theirs").alias("x")).select("node", "other", "x.*"), f"msa-merged{step}")
        fresh = nodes.drop("words", "profile").join(done.select("node", "profile", _words("consensus").alias("words")), "node").select("group", "node", "place", "words", "profile")
        gone = chosen.select("node").unionAll(chosen.select(F.col("other").alias("node")))
        moves = done.select("node", F.col("node").alias("to"), F.col("cols_left").alias("cols")).unionAll(done.select("other", "node", "cols_right"))
        members = stage.write(_spread(members, moves), f"msa-members{step}")
        stage.drop(f"msa-members{step - 1}")
        nodes = stage.write(nodes.join(gone, "node", "left_anti").unionByName(fresh), f"msa-nodes{step}")
        step += 1
    rest = ready[0]
    for more in ready[1:]:
        rest = rest.unionAll(more)
    ranked = rest.select("group", "node", F.row_number().over(Window.partitionBy("group").orderBy("place")).alias("rank"), "profile")
    moves = stage.write(ranked.groupBy("group").applyInPandas(_finished, "node long, cols array<int>"), "msa-finished")
    members = stage.write(_spread(members, moves.select("node", F.col("node").alias("to"), "cols")), "msa-members")
    return own.select("leaf", "locus", "seq").join(members.select("leaf", "aligned"), "leaf").select("locus", "seq", "aligned")


def pair_score(aligned: list[str], gap: float = GAP) -> float:
    """The sum over all pairs of sequences and columns of their scores; a residue against a gap costs ``gap``."""
    raw = np.array([np.frombuffer(s.encode("latin-1", "replace"), np.uint8) for s in aligned])
    kinds, empty, total = _INDEX[raw], raw == ord("-"), 0.0
    for i in range(len(raw)):
        for j in range(i):
            total += _SCORES[kinds[i], kinds[j]][~empty[i] & ~empty[j]].sum() - gap * (empty[i] ^ empty[j]).sum()
    return float(total)
