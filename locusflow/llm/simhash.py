"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are sorted by the population counts of their 16-bit quarters and cut into tiles.  A pair of
tiles is compared only if their population counts come within the radius: the sum over the quarters of the
counts' distance is a lower bound of the number of differing bits, so what is skipped holds no link.  Inside a
tile pair, small blocks are skipped in the same way and the rest is compared with numpy exclusive-or and bit
counts.  Each tile pair returns a spanning forest of its links, not the links, so a group of thousands of
near copies gives as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.operators.components import components
from locusflow.llm.shared import Scratch, batches_with, documents, row_key, utf8_cells, whole_row, word_pieces
from locusflow.runtime import map_arrow

SHINGLE = 4
SEED = 42
RADIUS = 4
TILE = 32768
BLOCK = 256

_PIECE = 1 << 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_ROWS = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles (repeats count).  No word: 0.  Fewer words than a shingle: one shingle."""
    counts, n, rest = np.zeros(2048, np.int64), 0, []
    for words in word_pieces((text or b"").lower()):
        words = rest + words
        if len(words) >= shingle:
            counts += _byte_counts(words, shingle, seed)
            n += len(words) - shingle + 1
            words = words[len(words) - shingle + 1 :]
        rest = words
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(rest), seed) if rest else 0
    ones = (counts.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _byte_counts(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """How often each byte of the shingles' hashes has each value."""
    flat = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    counts = np.zeros(2048, np.int64)
    for at in range(0, len(words) - shingle + 1, _PIECE):
        to = min(len(words) - shingle + 1, at + _PIECE)
        cut = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, [flat[a:b] for a, b in cut], repeat(seed)), np.uint64, to - at)
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _ROWS).ravel(), minlength=2048)
    return counts


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long) of each row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches):
            fps = np.array([fingerprint(t, shingle, seed) for t in utf8_cells(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def _quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _order(fps: np.ndarray) -> np.ndarray:
    q, b = _quarters(fps), np.bitwise_count(fps.view(np.uint8).reshape(-1, 8))
    return np.lexsort([fps, b[:, 6], b[:, 4], b[:, 2], b[:, 0], q[:, 3], q[:, 2], q[:, 1], q[:, 0]])


def _tiles(distinct: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """(tile, low, high, fps): at most ``size`` fingerprints as one binary, and the range of each quarter's count."""
    n = distinct.count()
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        fps = np.concatenate(parts).view(np.uint64) if parts else np.zeros(0, np.uint64)
        fps = fps[_order(fps)]
        own = TaskContext.get().partitionId() << 24
        for k, at in enumerate(range(0, len(fps), size)):
            q = _quarters(fps[at : at + size])
            yield pa.RecordBatch.from_pydict(
                {"tile": [own + k], "low": [q.min(0).tolist()], "high": [q.max(0).tolist()], "fps": [fps[at : at + size].tobytes()]},
                schema=pa.schema([("tile", pa.int64()), ("low", pa.list_(pa.int16())), ("high", pa.list_(pa.int16())), ("fps", pa.binary())]),
            )

    dealt = distinct.repartitionByRange(max(1, -(-n // size)), *quarter, "fp")
    return scratch.write(map_arrow(dealt, run, "tile long, low array<short>, high array<short>, fps binary"), "tiles")


def _tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """(i, j), i <= j, of the tiles whose counts come within the radius; found by an equi-join on the first quarter's count."""
    box = tiles.select("tile", "low", "high")
    left = box.select(F.col("tile").alias("i"), F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(F.sequence(F.col("low")[0] - radius, F.col("high")[0] + radius)).alias("q"))
    right = box.select(F.col("tile").alias("j"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.explode(F.sequence(F.col("low")[0].cast("int"), F.col("high")[0].cast("int"))).alias("q"))
    apart = sum((F.greatest(F.lit(0), F.col("la")[k] - F.col("hb")[k], F.col("lb")[k] - F.col("ha")[k]) for k in range(1, 4)), F.greatest(F.lit(0), F.col("la")[0] - F.col("hb")[0], F.col("lb")[0] - F.col("ha")[0]))
    return left.join(right, "q").where((F.col("i") <= F.col("j")) & (apart <= radius)).select("i", "j").distinct()


class _Forest:
    """Union of index pairs in bulk; ``root`` always points straight at the roots."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            if not (apart := a != b).any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def link_forest(left: np.ndarray, right: np.ndarray, radius: int = RADIUS, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as two arrays of fingerprints, of the links between and within two tiles given in tile order."""
    both = np.concatenate([left, right])
    forest = _Forest(len(both))
    cuts = [(at, min(at + block, len(side)) + 0, base) for side, base in ((left, 0), (right, len(left))) for at in range(0, len(side), block)]
    boxes = []
    for at, to, base in cuts:
        q = _quarters(both[base + at : base + to])
        boxes.append((q.min(0), q.max(0)))
    low, high = np.array([b[0] for b in boxes]).reshape(-1, 4), np.array([b[1] for b in boxes]).reshape(-1, 4)
    n_left = -(-len(left) // block)
    same = left is right or np.array_equal(left, right)
    for x in range(n_left):
        gap = np.maximum(0, np.maximum(low[x] - high[n_left:], low[n_left:] - high[x])).sum(1)
        ax, bx, _ = cuts[x]
        rows = both[ax:bx, None]
        for y in np.flatnonzero(gap <= radius).tolist():
            if same and y < x:
                continue
            ay, by, base = cuts[n_left + y]
            near = np.bitwise_count(rows ^ both[None, base + ay : base + by]) <= radius
            if near.any():
                i, j = np.nonzero(near)
                i, j = i + ax, j + ay + (0 if same else base)
                forest.add(i, j)
    away = np.flatnonzero(forest.root != np.arange(len(both)))
    return both[away], both[forest.root[away]]


def docs_parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def fingerprint_links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that join the same components as all links within the radius."""
    tiles = _tiles(distinct, scratch, tile)
    pairs = scratch.write(_tile_pairs(tiles, radius), "pairs")
    bits = tiles.select(F.col("tile"), "fps")
    length = F.length("fps") / 8
    compared = pairs.count() * (tiles.agg(F.avg(length)).first()[0] or 0) ** 2
    tasks = int(max(4 * docs_parallelism(scratch.spark), min(100_000, compared / 5e8)))
    work = (
        pairs.join(bits.select(F.col("tile").alias("i"), F.col("fps").alias("a")), "i")
        .join(bits.select(F.col("tile").alias("j"), F.col("fps").alias("b")), "j")
        .select("a", "b")
        .repartition(tasks)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                u, v = link_forest(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return scratch.write(map_arrow(work, run, "u long, v long"), "links")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id, root) of each row of ``docs``: component_id is the smallest doc_id linked to it, ``root``
    the least fingerprint, which tells components apart where ids repeat.

    Rows with the same fingerprint are linked; fingerprints link at ``radius`` or fewer differing bits.  A null
    text counts as empty (fingerprint 0); a null doc_id keeps its row and never is the smallest unless alone;
    repeated rows stay.  Other columns are not read.  No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = fingerprint_links(distinct.select("fp"), scratch, radius, tile)
    roots = components(links, scratch)
    classes = scratch.write(
        distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes"
    )
    least = scratch.write(classes.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of = scratch.write(classes.join(least, "root").select("fp", "component_id", "root"), "components")
    scratch.drop("tiles", "pairs", "links", "distinct", "classes", "least")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id", "root")


def hex_of(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Rows up to which a table of ids is sent to every executor; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: one of those with its smallest doc_id, all columns as they were.

    A row without a doc_id has its text's hash for one, above all usual ids: it stays if its group has no row with an id,
    and then one of them does.  Rows that share an id but not a group are rows of their own; of those that share both,
    the one with the least hash of all its columns stays.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    keyed = docs.select(row_key().alias("key"), whole_row(docs).alias("row"))
    text = F.col("row.text").alias("text")
    found = scratch.write(near_duplicates(keyed.select(F.col("key").alias("doc_id"), text)).withColumnRenamed("doc_id", "key"), "found")
    stands = F.max((F.col("key") == F.col("component_id")).cast("int"))
    ids = scratch.write(found.groupBy("key").agg(F.count("*").alias("n"), stands.alias("stands")).where("stands = 0 or n > 1"), "ids")
    away, many = ids.select("key"), ids.where("stands = 1").select("key")
    out = keyed.join(F.broadcast(away) if away.count() <= BROADCAST_ROWS else away, "key", "left_anti").select("row.*")
    if many.limit(1).count():
        # Rows of repeated ids find their groups by their fingerprints, which are made once for each text of an id.
        rows = keyed.join(many, "key", "left_semi").withColumn("known", F.xxhash64("key", "row.text"))
        fps = fingerprints(rows.select(F.col("known").alias("doc_id"), text).dropDuplicates(["doc_id"])).select(F.col("doc_id").alias("known"), "fp")
        roots = found.where("key = component_id").select("key", "fp", "root").distinct()
        placed = rows.join(fps, "known").join(roots, ["key", "fp"])
        one = placed.groupBy("key", "root").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = out.unionAll(one.select("row.*"))
    return out


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", hex_of().alias("fingerprint"), "component_id")
