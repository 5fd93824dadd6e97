"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed letter n-grams.  Each language has several centroids, found
by spherical k-means on a bounded sample of labelled rows; a text gets the language of the nearest centroid by
cosine, and is rejected if it is farther from it than the training texts of that language are.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.shared import batches_with, documents, residue, str_cells
from locusflow.runtime import map_arrow

DIMS = 1 << 14
PIECE = 1 << 20
CENTROIDS = 5
#: Bound of the fit: about so many labelled rows of each language, chosen by a hash of the id.
ROWS_PER_LANGUAGE = 1500
#: A text is rejected below this quantile of its language's similarities in training, less a margin.
REJECT_QUANTILE, REJECT_MARGIN = 0.001, 0.05

_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to its lower-case letter's code point; 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha() or unicodedata.category(ch) in ("Mn", "Mc"):
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of the text's letters, pairs and triples, with their counts; a long text is counted in pieces."""
    counts = sum((_counts(text[at : at + PIECE]) for at in range(0, len(text), PIECE)), np.zeros(DIMS, np.int64))
    at = np.flatnonzero(counts)
    return at, counts[at]


def _counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _letters()[points]
    keep = (low != 0) | np.concatenate([[False], low[:-1] != 0]) if len(low) else np.zeros(0, bool)
    a = np.concatenate([[0], low[keep], [0]]).astype(np.uint64)
    pair = a[:-1] * _MULT[0] + a[1:] * _MULT[1]
    triple = pair[:-1] + a[2:] * _MULT[2] + np.uint64(77)
    coded = np.concatenate([pair, triple, a[a != 0] * _MULT[2] + np.uint64(5)])
    coded = (coded ^ (coded >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.bincount((coded >> np.uint64(64 - 14)).astype(np.int64), minlength=DIMS)


def _weights(counts: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)).astype(np.float32)


@dataclass(frozen=True)
class Centroids:
    """``table``: dimension by centroid, IDF already inside; ``of``: the language of each centroid."""

    languages: list[str]
    idf: np.ndarray
    table: np.ndarray
    of: np.ndarray
    floor: np.ndarray

    def nearest(self, text: str) -> tuple[int, float]:
        at, counts = grams(text)
        w = _weights(counts) * self.idf[at]
        norm = float(np.sqrt(w @ w))
        if not norm:
            return 0, 0.0
        sims = (w / norm) @ self.table[at]
        best = int(np.argmax(sims))
        return int(self.of[best]), float(min(1.0, max(0.0, sims[best])))


def _kmeans(rows: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(rows)))]
    while len(at) < min(k, len(rows)):
        at.append(int(np.argmin((rows @ rows[at].T).max(1))))
    centres = rows[at]
    for _ in range(rounds):
        mine = np.argmax(rows @ centres.T, 1)
        fresh = np.stack([rows[mine == c].sum(0) if (mine == c).any() else centres[c] for c in range(len(centres))])
        centres = fresh / np.maximum(1e-9, np.linalg.norm(fresh, axis=1, keepdims=True))
    return centres


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, centroids: int = CENTROIDS) -> Centroids | None:
    """Centroids from (doc_id, text, lang); rows without language or letters teach nothing.  None without any row.

    Only hashed n-gram counts of the sample, at most a few thousand short rows, reach the driver.
    """
    known = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, rows_per_language / n))])
    unit = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.where(unit < F.element_at(share, F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches):
            out = []
            for doc, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(text):
                    at, n = grams(text)
                    out.append((doc, lang, at.astype(np.uint16).tobytes(), np.minimum(n, 65535).astype(np.uint16).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "lang", "at", "n"])

    found = map_arrow(sample.select(F.col("doc_id").cast("long"), "text", "lang"), run, "doc_id long, lang string, at binary, n binary").toPandas()
    if found.empty:
        return None
    found = found.sort_values(["lang", "doc_id", "at", "n"], kind="stable", na_position="last")
    langs = found["lang"].tolist()
    ats = [np.frombuffer(x, np.uint16) for x in found["at"]]
    seen = np.bincount(np.concatenate(ats), minlength=DIMS)
    idf = (np.log((1 + len(ats)) / (1 + seen)) + 0.3).astype(np.float32)
    names = sorted(set(langs))
    tables, of, floor = [], [], []
    for k, name in enumerate(names):
        mine = [i for i, x in enumerate(langs) if x == name]
        rows = np.zeros((len(mine), DIMS), np.float32)
        for r, i in enumerate(mine):
            rows[r, ats[i]] = _weights(np.frombuffer(found["n"].iloc[i], np.uint16)) * idf[ats[i]]
        rows /= np.maximum(1e-9, np.linalg.norm(rows, axis=1, keepdims=True))
        centres = _kmeans(rows, centroids, seed=k)
        floor.append(float(np.quantile((rows @ centres.T).max(1), REJECT_QUANTILE)) - REJECT_MARGIN)
        tables.append(centres)
        of += [k] * len(centres)
    return Centroids(names, idf, np.ascontiguousarray(np.concatenate(tables).T), np.array(of), np.array(floor))


def identify(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """(doc_id, lang_near, score, rejected, lang_pred) of each row, from the text alone.

    ``lang_near`` is the nearest centroid's language, ``score`` the cosine with it; ``rejected`` says that it is too far.
    ``lang_pred`` is ``und`` for texts that are null or hold no letter, else the nearest language.  Without a model, all
    are ``und`` and rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches_with(batches):
            out = []
            for text in str_cells(batch.column(1)):
                if m is None or not has_letter(text):
                    out.append((None, 0.0, True, "und"))
                else:
                    k, score = m.nearest(text)
                    out.append((m.languages[k], score, score < m.floor[k], m.languages[k]))
            cols = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([*c], t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.bool_(), pa.string()), strict=True))],
                ["doc_id", "lang_near", "score", "rejected", "lang_pred"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_near string, score double, rejected boolean, lang_pred string")


def held_out(doc_id="doc_id"):
    return F.coalesce(residue(F.col(doc_id), 4) == 2, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
