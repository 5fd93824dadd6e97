"""Local alignment of proteins: Smith and Waterman with affine gaps, as an Arrow function over pairs."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: BLOSUM62, lower triangle; gap open 11, extend 1.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
OPEN, EXTEND = 11, 1


@lru_cache(1)
def matrix() -> np.ndarray:
    """Scores by letter code; letters that are no residue score -1 with all."""
    out = np.full((256, 256), -1, np.int32)
    for i, line in enumerate(BLOSUM62.split("\n")[1:-1]):
        for j, score in enumerate(line.split()):
            a, b = ord(RESIDUES[i]), ord(RESIDUES[j])
            out[a, b] = out[b, a] = int(score)
    return out


def align(query: str, target: str) -> tuple[int, int, int]:
    """(score, first, last) of the best local alignment; the query's range is one-based and inclusive, 0 and 0 if empty."""
    return align_many([query], [target])[0]


def align_many(queries: list[str], targets: list[str], block: int = 128) -> list[tuple[int, int, int]]:
    """align() of each pair, pairs of like size together: one row of all matrices of a block at a time."""
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(queries)
    order = sorted((i for i in range(len(queries)) if queries[i] and targets[i]), key=lambda i: (len(queries[i]), len(targets[i])))
    for at in range(0, len(order), block):
        some = order[at : at + block]
        for i, found in zip(some, _align_block([queries[i] for i in some], [targets[i] for i in some]), strict=True):
            out[i] = found
    return out


def _padded(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), max(map(len, texts))), np.uint8)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("latin-1", "replace"), np.uint8)
    return out


def _align_block(queries: list[str], targets: list[str]) -> list[tuple[int, int, int]]:
    """Gaps along a row come from a running maximum, as opening one from a cell that a gap reached never pays.

    Padding scores -1 with everything, so that no best cell lies in it.
    """
    q, t, scores = _padded(queries).astype(np.intp) * 256, _padded(targets).astype(np.intp), matrix().ravel()
    b, n = t.shape
    sizes = np.array([len(x) for x in queries])
    rows, columns = np.arange(b), np.arange(n + 1, dtype=np.int32)
    steps, none = columns * EXTEND, np.int32(-(1 << 28))
    h, origin, e_origin = (np.zeros((b, n + 1), np.int32) for _ in range(3))
    e = np.full((b, n + 1), none)
    edge, score, first, last = np.zeros((b, 1), np.int32), *(np.zeros(b, np.int64) for _ in range(3))
    for i in range(1, q.shape[1] + 1):
        opened = h - (OPEN + EXTEND)
        keep = e - EXTEND >= opened
        e_origin = np.where(keep, e_origin, origin)
        e = np.where(keep, e - EXTEND, opened)
        diagonal = np.concatenate([edge, h[:, :-1] + scores.take(q[:, i - 1, None] + t)], 1)
        from_diagonal = np.concatenate([edge, np.where(h[:, :-1] > 0, origin[:, :-1], i)], 1)
        base = np.maximum(np.maximum(diagonal, e), 0)
        base_origin = np.where(diagonal >= e, from_diagonal, e_origin)
        reach = base + steps
        run = np.maximum.accumulate(reach, 1)
        at = np.maximum.accumulate(np.where(reach == run, columns, 0), 1)
        f = np.concatenate([edge + none, run[:, :-1] - OPEN - steps[1:]], 1)
        f_origin = np.concatenate([edge, np.take_along_axis(base_origin, at[:, :-1], 1)], 1)
        h = np.maximum(base, f)
        origin = np.where(f > base, f_origin, base_origin)
        top = h.argmax(1)
        better = (h[rows, top] > score) & (i <= sizes)
        score = np.where(better, h[rows, top], score)
        first = np.where(better, origin[rows, top], first)
        last = np.where(better, i, last)
    return list(zip(score.tolist(), first.tolist(), last.tolist(), strict=True))


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("score", "qstart", "qend")]))
def local_alignment(query: pd.Series, target: pd.Series) -> pd.DataFrame:
    whole = query.notna() & target.notna()
    found = align_many([q if ok else "" for q, ok in zip(query, whole, strict=True)], [t if ok else "" for t, ok in zip(target, whole, strict=True)])
    out = pd.DataFrame(found, columns=["score", "qstart", "qend"], dtype="Int32", index=query.index)
    return out.where(whole, other=pd.NA)
