"""Search of proteins by seeds: words alike, two of them on a diagonal, extension without gaps, then alignment.

A word of a query stands for all words that score at least a threshold with it.  Queries and targets are packed into
blocks, and every block of the ones meets every block of the others: the task looks the words of the targets up among
the neighbours of the queries' words, and keeps those with another one shortly before them on their diagonal.  Pairs with
such words are extended along their diagonals, as far as the score does not drop too much, and those that reach the
trigger are aligned.  There is no bound on partners.  Places of words are never shuffled nor written: their number is
that of queries times targets, in residues, over that of the words that a neighbourhood leaves apart (about 170 at a
threshold of 11, 900 at 13), and a task holds some of them at a time.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.functions.align import RESIDUES, matrix
from locusflow.operators.matching import align_pairs
from locusflow.runtime import Stage, map_arrow, ship

#: Constants of Karlin and Altschul for BLOSUM62 with gaps of 11 and 1.
LAMBDA, K = 0.267, 0.041
WORD = 3
THRESHOLD, WINDOW, DROP, TRIGGER, EVALUE = 11, 40, 16, 41, 1e-3
#: A word seeds nothing where the residues around it, as many as here, are of fewer kinds: such stretches resemble all others.
AROUND, KINDS = 12, 3
#: Residues of a block of queries and of targets, and places of words that a task holds at a time.
QUERY_BLOCK, TARGET_BLOCK, HELD = 1 << 14, 1 << 16, 1 << 20

_ALL = len(RESIDUES) ** WORD
_CODE = np.full(256, len(RESIDUES), np.uint8)
_CODE[[ord(c) for c in RESIDUES]] = range(len(RESIDUES))
#: Scores by 32 times one code and another; 20 is any other letter, 21 what stands between sequences and ends every stretch.
_SCORE = np.full(32 * 32, -1, np.int32)
_SCORE.reshape(32, 32)[:20, :20] = matrix()[np.ix_([ord(c) for c in RESIDUES], [ord(c) for c in RESIDUES])]
_SCORE.reshape(32, 32)[21, :] = _SCORE.reshape(32, 32)[:, 21] = -(1 << 20)
#: Steps between two looks at which stretches still grow, and as many residues around a text.
_STEPS = 6


def _near(word: int, threshold: int) -> np.ndarray:
    """The words, as numbers, that score at least so much with one, and itself."""
    a, b, c = (_SCORE.reshape(32, 32)[x, :20] for x in (word // 400, word // 20 % 20, word % 20))
    near = ((a[:, None, None] + b[:, None] + c) >= threshold).ravel()
    near[word] = True
    return np.flatnonzero(near)


def neighbours(words: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(word, near) of the words of ``words``: itself and all words of residues that score at least so much with it.

    A word is its own neighbour at any threshold.  Words with letters that are no residues have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(["".join(x) for x in product(RESIDUES, repeat=WORD)])
        number = {x: k for k, x in enumerate(names.tolist())}
        for batch in batches:
            for word in batch.column(0).to_pylist():
                if word in number:
                    found = names[_near(number[word], threshold)].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([word] * len(found)), pa.array(found)], ["word", "near"])

    return map_arrow(words.select("word").distinct(), run, "word string, near string")


class _Text(NamedTuple):
    """Sequences one after the other, something between them: codes, where each begins, its length; and their words
    outside stretches of few kinds of residues: numbers, sequences, places from 0."""

    codes: np.ndarray
    start: np.ndarray
    size: np.ndarray
    word: np.ndarray
    of: np.ndarray
    at: np.ndarray


def _text(seqs: list[str]) -> _Text:
    size = np.array([len(s) for s in seqs], np.int64)
    start = np.cumsum(size + _STEPS) - size
    letters = np.zeros(int(size.sum() + _STEPS * (len(seqs) + 1)), np.uint32)
    inside = _ranges(start, size)
    letters[inside] = np.frombuffer("".join(seqs).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.full(len(letters), 21, np.uint8)
    codes[inside] = _CODE[np.minimum(letters[inside], 255)]
    order = np.argsort(letters, kind="stable")
    last = np.full(len(letters), -1)
    last[order[1:]] = np.where(letters[order[1:]] == letters[order[:-1]], order[:-1], -1)
    n = np.maximum(size - WORD + 1, 0)
    of, at = np.repeat(np.arange(len(seqs)), n), _ranges(np.zeros(len(seqs), np.int64), n)
    first = start[of] + np.maximum(at - (AROUND - WORD) // 2, 0)
    end, kinds = np.minimum(first + AROUND, (start + size)[of]), np.zeros(len(of), np.int64)
    for k in range(AROUND):
        here = np.minimum(first + k, end - 1)
        kinds += (first + k < end) & (last[here] < first)
    place = start[of] + at
    a, b, c = (codes[place + k].astype(np.int64) for k in range(WORD))
    ok = (kinds >= KINDS) & (np.maximum(np.maximum(a, b), c) < len(RESIDUES))
    return _Text(codes, start, size, (400 * a + 20 * b + c)[ok], of[ok], at[ok])


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, ``n`` of them."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


class _Hits(NamedTuple):
    """Places in targets of words that are alike, by pair and diagonal, in their order."""

    q: np.ndarray
    t: np.ndarray
    diagonal: np.ndarray
    at: np.ndarray


def _index(queries: _Text, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds by word and, between them, the places in the list of the queries' words whose neighbour it is."""
    kinds, which = np.unique(queries.word, return_inverse=True)
    near = [_near(int(w), threshold) for w in kinds]
    n = np.array([len(x) for x in near], np.int64)
    flat = np.concatenate([*near, np.zeros(0, np.int64)])[_ranges((np.cumsum(n) - n)[which], n[which])]
    order = np.argsort(flat, kind="stable")
    return np.searchsorted(flat[order], np.arange(_ALL + 1)), np.repeat(np.arange(len(which)), n[which])[order]


def _double(queries: _Text, index: tuple[np.ndarray, np.ndarray], targets: _Text, window: int) -> Iterator[_Hits]:
    """Double hits of some targets at a time, all of a target together."""
    bounds, listed = index
    n = bounds[targets.word + 1] - bounds[targets.word]
    ends = np.cumsum(np.bincount(targets.of, n, len(targets.size)))
    wide, long = int(queries.size.max(initial=0)), int(targets.size.max(initial=0))
    across, along, begin = wide + long + 1, long + window + 1, 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + HELD, "right")))
        some = slice(*np.searchsorted(targets.of, [begin, stop]))
        begin = stop
        w = listed[_ranges(bounds[targets.word[some]], n[some])]
        t, at = np.repeat(targets.of[some], n[some]), np.repeat(targets.at[some], n[some])
        key = ((t * len(queries.size) + queries.of[w]) * across + at - queries.at[w] + wide) * along + at
        key.sort()
        # No place is there twice, so that at most two are nearer than a word: one of the last three is not, or none.
        good = np.zeros(len(key), bool)
        for k in (1, 2, 3):
            apart = key[k:] - key[:-k]
            good[k:] |= (apart >= WORD) & (apart <= window)
        line, at = np.divmod(key[good], along)
        pair, diagonal = np.divmod(line, across)
        t, q = np.divmod(pair, max(1, len(queries.size)))
        yield _Hits(q, t, diagonal - wide, at)


def _grow(a: np.ndarray, b: np.ndarray, step: int, drop: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_grown() of many lines at once, each from its places in the two texts in steps of 1 or -1."""
    best, end, which = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64), np.arange(len(x))
    total, top, grown = (np.zeros(len(x), np.int32) for _ in range(3))
    while len(which):
        for _ in range(_STEPS):
            total += _SCORE[a[x] + b[y]]
            np.maximum(top, total, out=top)
            total[top - total > drop] = -(1 << 29)
            grown += total > -(1 << 28)
            x, y = x + step, y + step
        over = total <= -(1 << 28)
        best[which[over]], end[which[over]] = top[over], grown[over]
        left = ~over
        which, x, y, total, top, grown = which[left], x[left], y[left], total[left], top[left], grown[left]
    return best, end


def _ungapped(queries: _Text, targets: _Text, hits: _Hits, drop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, target, score) of the pairs of ``hits`` as extension() gives it: in each round the first hits of all
    diagonals grow, and those that the stretches have reached go."""
    a, b = queries.codes.astype(np.int64) * 32, targets.codes.astype(np.int64)
    pair = hits.t * len(queries.size) + hits.q
    pairs, of = np.unique(pair, return_inverse=True)
    best = np.zeros(len(pairs), np.int32)
    line, diagonal, at = of, hits.diagonal, hits.at
    x, y = queries.start[hits.q] + at - diagonal, targets.start[hits.t] + at
    while len(line):
        first = np.concatenate([[True], (line[1:] != line[:-1]) | (diagonal[1:] != diagonal[:-1])])
        ahead, end = _grow(a, b, 1, drop, x[first], y[first])
        back, _ = _grow(a, b, -1, drop, x[first] - 1, y[first] - 1)
        np.maximum.at(best, line[first], ahead + back)
        reached = (at[first] + end)[np.cumsum(first) - 1]
        left = ~first & (at > reached)
        line, diagonal, at, x, y = line[left], diagonal[left], at[left], x[left], y[left]
    return pairs % len(queries.size), pairs // len(queries.size), best


def _packed(seqs: DataFrame, residues: int, name: str, stage: Stage) -> DataFrame:
    """One row for each block of (no, seq): its number and its sequences, of about so many residues together."""
    total = seqs.agg(F.sum(F.length("seq"))).first()[0] or 0
    parts = 2 * seqs.sparkSession.sparkContext.defaultParallelism
    block = F.pmod(F.xxhash64("no"), F.lit(max(1, -(-total // residues))))
    dealt = seqs.where("seq is not null").select(block.alias(f"{name}_block"), F.struct("no", "seq").alias("x")).repartition(parts, f"{name}_block")
    return stage.write(dealt.groupBy(f"{name}_block").agg(F.collect_list("x").alias(name)), name)


def _met(queries: DataFrame, targets: DataFrame, threshold: int, window: int, found: Callable, schema: str) -> DataFrame:
    """What ``found(queries, targets, hits)`` gives of the double hits of every two blocks: columns of ``schema``, which
    begins with q and t, there as places in the blocks."""
    stage, label = Stage(queries.sparkSession), uuid.uuid4().hex
    blocks = _packed(queries, QUERY_BLOCK, "queries", stage).crossJoin(_packed(targets, TARGET_BLOCK, "targets", stage))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None,)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("queries_block", "targets")}
                if known[0] != (label, row["queries_block"]):
                    asked = batch.column("queries")[k].as_py()
                    q = _text([x["seq"] for x in asked])
                    known = ((label, row["queries_block"]), q, np.array([x["no"] for x in asked], np.int64), _index(q, threshold))
                _, q, q_no, index = known
                t, t_no = _text([x["seq"] for x in row["targets"]]), np.array([x["no"] for x in row["targets"]], np.int64)
                for hits in _double(q, index, t, window):
                    if len(hits.at):
                        of_q, of_t, *more = found(q, t, hits)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q_no[of_q], t_no[of_t], *more)], names)

    return map_arrow(blocks, run, schema)


def double_hits(queries: DataFrame, targets: DataFrame, threshold: int = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """(q, t, diagonal, at): places in targets of words that are alike, with another such word of the pair before them on
    the diagonal, not overlapping and at most ``window`` residues ahead.  Both sides are (no, seq)."""
    return _met(queries, targets, threshold, window, lambda q, t, hits: hits, "q long, t long, diagonal long, at long")


def extension(query: str, target: str, hits: list[tuple[int, int]], drop: int = DROP) -> int:
    """The best score of a stretch without gaps through one of the hits (diagonal, place in the target); from each the
    stretch grows both ways until its score has dropped by more than ``drop``."""
    scores, best = matrix(), 0
    q, t = (np.frombuffer(s.encode("latin-1", "replace"), np.uint8) for s in (query, target))
    reached: dict[int, int] = {}
    for diagonal, at in sorted(hits):
        if reached.get(diagonal, -1) >= at:
            continue
        lo, hi = max(0, diagonal), min(len(t), len(q) + diagonal)
        line = scores[q[lo - diagonal : hi - diagonal], t[lo:hi]]
        ahead, end = _grown(line[at - lo :], drop)
        back, _ = _grown(line[: at - lo][::-1], drop)
        reached[diagonal] = at + end
        best = max(best, ahead + back)
    return best


def _grown(line: np.ndarray, drop: int) -> tuple[int, int]:
    """The highest sum of a beginning of the line, and where growing stops."""
    if not len(line):
        return 0, 0
    total = np.cumsum(line)
    top = np.maximum.accumulate(np.maximum(total, 0))
    fallen = np.flatnonzero(top - total > drop)
    end = int(fallen[0]) if len(fallen) else len(line)
    return (int(top[end - 1]) if end else 0), end


def search(
    queries: DataFrame, targets: DataFrame, threshold: int = THRESHOLD, window: int = WINDOW, trigger: int = TRIGGER, evalue: float | None = EVALUE, stage: Stage | None = None
) -> DataFrame:
    """(query, target, score, qstart, qend, slen, evalue) of pairs of ``queries`` and ``targets`` (id, seq) that are alike.

    The score is that of the best local alignment, so what the seeds decide is only which pairs are aligned.  The
    e-value counts the residues of all targets; none filters by it.  Null or empty sequences, and those shorter than a
    word, have no partners.  Repeated ids are sequences of their own; empty tables give an empty result.
    """
    stage = stage or Stage(queries.sparkSession)
    label = f"search-{uuid.uuid4().hex}"
    clean = lambda df: df.where("seq <> ''").select("id", F.upper("seq").alias("seq"), F.monotonically_increasing_id().alias("no"))
    queries, targets = stage.write(clean(queries), f"{label}-queries"), stage.write(clean(targets), f"{label}-targets")
    total = targets.agg(F.sum(F.length("seq"))).first()[0] or 0

    def extended(q: _Text, t: _Text, hits: _Hits) -> tuple[np.ndarray, ...]:
        of_q, of_t, score = _ungapped(q, t, hits, DROP)
        good = score >= trigger
        return of_q[good], of_t[good]

    pairs = stage.write(_met(queries.select("no", "seq"), targets.select("no", "seq"), threshold, window, extended, "q long, t long"), f"{label}-pairs")
    named = lambda df, no, name: df.select(F.col("no").alias(no), F.col("id").alias(name), F.col("seq").alias(f"{name}_seq"))
    near = pairs.join(named(queries, "q", "query"), "q").join(named(targets, "t", "target"), "t")
    near = stage.write(near.select("query", "query_seq", "target", "target_seq"), f"{label}-near")
    # Written, as a filter by the score would else align once more; into so many parts, as few rows are much work.
    dealt = near.repartition(4 * queries.sparkSession.sparkContext.defaultParallelism, "query", "target", "target_seq")
    found = stage.write(align_pairs(dealt), f"{label}-found").withColumn("slen", F.length("target_seq"))
    expected = K * F.length("query_seq") * F.lit(float(total)) * F.exp(-LAMBDA * F.col("score"))
    found = found.withColumn("evalue", expected).select("query", "target", "score", "qstart", "qend", "slen", "evalue")
    return found if evalue is None else found.where(F.col("evalue") <= evalue)


def least_score(length: int, residues: int, evalue: float = EVALUE) -> int:
    """The least score of a query of so many residues that reaches the e-value against so many residues."""
    return math.ceil(math.log(K * length * residues / evalue) / LAMBDA)
