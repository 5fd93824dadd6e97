"""Quality classifier by positive-unlabelled learning.

A small network is trained on trusted positives and unlabelled texts to minimise the non-negative unbiased risk:
the class prior times the positives' loss, plus the unlabelled texts' loss as negatives less what the positives
among them contribute, never below zero.  The prior is estimated from held-in labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.shared import batches_with, documents, residue, table, utf8_cells, word_pieces
from locusflow.runtime import map_arrow

THRESHOLD = 0.3
FOLDS = 5
#: Bounds of the fit: about so many positives and so many unlabelled rows, chosen by a hash of the id.
POSITIVES, UNLABELLED = 6000, 12000

_SYMBOLS = np.frombuffer(b"#*$%&<>~^\\{}[]@_=+/", np.uint8)


def features(text: bytes | None) -> np.ndarray:
    """Measures of form, free of language: shares of kinds of bytes, lengths, and repetition of words, lines and windows."""
    text = text or b""
    codes, widths, stutter, before = [], [], 0, None
    for words in word_pieces(text):
        codes.append(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
        widths.append(np.fromiter(map(len, words), np.int64, len(words)))
        stutter += sum(map(eq, words, words[1:])) + (before is not None and words[:1] == [before])
        before = words[-1] if words else before
    coded = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
    lengths = np.concatenate(widths) if widths else np.zeros(0, np.int64)
    n, size = max(1, len(coded)), max(1, len(text))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(coded) >= 8:
        code = np.zeros(len(coded) - 7, np.uint64)
        for k in range(8):
            code = code * np.uint64(0x9E3779B97F4A7C15) + coded[k : len(coded) - 7 + k]
        code.sort()
        twice = code[1:] == code[:-1]
        repeated = int((np.concatenate([twice, [False]]) | np.concatenate([[False], twice])).sum())
    unique = len(np.unique(coded))
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    letters = max(1, upper + lower)
    return np.array(
        [
            np.log1p(len(coded)), np.log1p(len(text)), size / n, float(lengths.std()) if len(coded) else 0.0,
            count[_SYMBOLS].sum() / n, count[124] / n, count[33] / n, count[63] / n, count[44] / n, count[46] / n,
            count[48:58].sum() / size, upper / letters, count[128:].sum() / size, count[10] / n, count[32] / size,
            np.log1p(count[_SYMBOLS].sum()), np.log1p(count[124]), np.log1p(count[33]),
            (len(lines) - len(set(lines))) / max(1, len(lines)), repeated / n, stutter / n, unique / n, np.log1p(unique),
            len(lines) / n, float(lengths.max()) / 50 if len(coded) else 0.0, count[34] / n, count[:32].sum() / size, float(len(coded) == 0),
        ],
        np.float32,
    )


N_FEATURES = len(features(None))


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-np.clip(np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, rounds: int = 60, batch: int = 512, rate: float = 0.01, seed: int = 7) -> Network:
    """Minimise the non-negative risk by Adam; when a batch's negative part falls below zero, its gradient is turned."""
    rng = np.random.default_rng(seed)
    mean = unlabelled.mean(0)
    scale = np.maximum(1e-3, unlabelled.std(0))
    p, u = (np.clip((x - mean) / scale, -6, 6).astype(np.float64) for x in (positive, unlabelled))
    d = p.shape[1]
    params = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params], 0
    steps = max(1, len(u) // batch)
    for _ in range(rounds):
        order_u, order_p = rng.permutation(len(u)), rng.permutation(len(p))
        for s in range(steps):
            xu = u[order_u[s * batch : (s + 1) * batch]]
            xp = p[np.take(order_p, np.arange(s * batch, (s + 1) * batch), mode="wrap")]
            x = np.concatenate([xp, xu])
            h = np.tanh(x @ params[0] + params[1])
            g = np.clip(h @ params[2] + params[3][0], -30, 30)
            sig = 1 / (1 + np.exp(-g))
            gp, gu = slice(0, len(xp)), slice(len(xp), None)
            negative = np.logaddexp(0, g[gu]).mean() - prior * np.logaddexp(0, g[gp]).mean()
            grad = np.zeros_like(g)
            if negative >= 0:
                grad[gu] = sig[gu] / len(xu)
                grad[gp] = prior * (sig[gp] - 1) / len(xp) - prior * sig[gp] / len(xp)
            else:
                grad[gu] = -sig[gu] / len(xu)
                grad[gp] = prior * sig[gp] / len(xp)
            back = np.outer(grad, params[2]) * (1 - h * h)
            grads = [x.T @ back + 1e-4 * params[0], back.sum(0), h.T @ grad + 1e-4 * params[2], np.array([grad.sum()])]
            t += 1
            for k, gk in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, params[0], params[1], params[2], float(params[3][0]), prior)


def _chosen(rows: DataFrame, bound: int, salt: str) -> DataFrame:
    """About ``bound`` rows, by a hash of the id."""
    share = min(1.0, bound / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def _rows(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches):
            x = [features(t).tobytes() for t in utf8_cells(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["doc_id", "x"])

    found = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, x binary").toPandas()
    found = found.sort_values(["doc_id", "x"], kind="stable")
    return np.frombuffer(b"".join(found["x"]), np.float32).reshape(-1, N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Network | None:
    """A network from (doc_id, text) and (doc_id, quality), or None without positives.

    Labels whose id has crc32 remainder 0 are not read.  An id with several labels counts as positive only if
    all its labels are 1.  Unlabelled texts are rows of ``docs`` by a hash of the id, whatever their label; the prior is
    the share of positives among the held-in labels.  Only feature rows of the bounded samples reach the driver.
    """
    usable = labels.where(residue(F.col("doc_id"), FOLDS) != 0).where("quality is not null")
    known = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n, good = known.agg(F.count("*"), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0))).first()
    if not good:
        return None
    prior = min(0.98, max(0.02, good / n))
    trusted = _chosen(known.where("quality = 1").select("doc_id"), positives, "positive")
    p = _rows(docs.join(F.broadcast(trusted), "doc_id", "left_semi").select("doc_id", "text"))
    u = _rows(_chosen(docs.where("doc_id is not null").select("doc_id", "text"), unlabelled, "unlabelled"))
    return train(p, u, prior) if len(p) and len(u) else None


def score(docs: DataFrame, model: Network | None) -> DataFrame:
    """(doc_id, score) of each row, from the text alone; null texts count as empty; without a model all score 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches):
            texts = utf8_cells(batch.column(1))
            if not texts:
                continue
            x = np.stack([features(t) for t in texts])
            s = np.ones(len(texts)) if shared.value is None else shared.value.score(x).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least ``threshold``, all columns as they were, repeated rows and null ids among them."""
    schema = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches):
            texts = utf8_cells(batch.column(batch.schema.get_field_index("text")))
            if not texts:
                continue
            if shared.value is None:
                yield batch
            else:
                yield batch.filter(pa.array(shared.value.score(np.stack([features(t) for t in texts])) >= threshold))

    return map_arrow(docs, run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(residue(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
