"""Gene prediction by a coding model learned from the genome itself, in two passes.

Contigs are cut into pieces, so that one contig is spread over tasks.  Pieces give start and stop codons of both strands;
a window over the frame of a strand finds the stop of every start, across pieces.  Of the open frames, the long
ones that have most G and C at the codon position the genome prefers train the first model: how much more often a pair of
codons stands in frame than six bases stand anywhere.  Frames are scored, and the best set of genes that overlap little is
chosen by dynamic programming over stretches that no candidate bridges.  The genes of the first pass train the second.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.functions.sequence import reverse_complement, sequence_hash
from locusflow.functions.translate import codons
from locusflow.runtime import Stage, fold_sorted, map_arrow, ship

#: Bases of a piece; shortest gene; shortest frame that trains the first model.
PIECE = 1 << 14
MINIMUM, TRAINING = 90, 300
#: A gene's score is in nats; one shorter than ``SHORT`` bases needs more, up to ``EXTRA``.  Genes may overlap by so many bases on one strand and on both, each costing so much.
LEAST, SHORT, EXTRA = 6.0, 300, 14.0
OVERLAP = {1: 60, -1: 120}
OVERLAP_COST = 0.15
#: The start codons of genes in bacteria, and what each is worth in nats: about 80, 12 and 8 % of the genes
#: against a third each.
STARTS = ("ATG", "GTG", "TTG")
START_SCORES = (0.9, -1.0, -1.4)

_DIGIT = np.full(256, 64, np.int16)
_DIGIT[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3] * 2


def _codon_codes(raw: np.ndarray) -> np.ndarray:
    """Numbers of the codons at every place, 0 to 63; 64 or more with any letter that is no base."""
    d = _DIGIT[raw]
    return np.where((d[:-2] | d[1:-1] | d[2:]) >= 64, 64, 16 * d[:-2] + 4 * d[1:-1] + d[2:])


def _number(codon: str) -> int:
    return int(_codon_codes(np.frombuffer(codon.encode(), np.uint8))[0])


def _opposite(codon: str) -> str:
    return codon.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def pieces(contigs: DataFrame, size: int = PIECE) -> DataFrame:
    """(genome, contig, rec_ord, contig_len, piece, bases) of (genome, rec_ord, seqid, seq); five bases of the next piece are at the end of each."""
    n = F.length("seq")
    each = contigs.select("genome", F.col("seqid").alias("contig"), "rec_ord", n.alias("contig_len"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size))).alias("piece"), F.upper("seq").alias("seq")).where(n > 0)
    return each.select("genome", "contig", "rec_ord", "contig_len", F.col("piece").cast("int").alias("piece"), F.substr("seq", (F.col("piece") * size + 1).cast("int"), F.lit(size + 5)).alias("bases"))


def codon_places(parts: DataFrame, code: int = 11, size: int = PIECE) -> DataFrame:
    """(genome, contig, strand, frame, at, stop) of the start and stop codons of both strands."""
    stops = [c for c, residue in codons(code).items() if residue == "*"]
    kinds = [(strand, stop, [_number(c if strand == 1 else _opposite(c)) for c in group]) for strand in (1, -1) for stop, group in ((True, stops), (False, STARTS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for genome, contig, piece, bases in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(bases.encode("latin-1", "replace"), np.uint8)[: size + 2]
                if len(raw) < 3:
                    continue
                found = _codon_codes(raw)
                for strand, stop, numbers in kinds:
                    at = np.flatnonzero(np.isin(found, numbers)) + piece * size
                    n = len(at)
                    columns = [pa.array([genome] * n, pa.string()), pa.array([contig] * n, pa.string()), pa.array(np.full(n, strand, np.int32)), pa.array((at % 3).astype(np.int32)), pa.array(at.astype(np.int64)), pa.array(np.full(n, stop))]
                    yield pa.RecordBatch.from_arrays(columns, ["genome", "contig", "strand", "frame", "at", "stop"])

    return map_arrow(parts.select("genome", "contig", "piece", "bases"), run, "genome string, contig string, strand int, frame int, at long, stop boolean")


def open_frames(places: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """(genome, contig, strand, stop, begin, end, starts): frames from their first start to their stop, ends exclusive;
    ``starts`` are the codons from the first start on at which the gene may start."""
    way = Window.partitionBy("genome", "contig", "strand", "frame").orderBy((-F.col("strand")) * F.col("at")).rowsBetween(Window.unboundedPreceding, -1)
    met = places.withColumn("until", F.last(F.when(F.col("stop"), F.col("at")), ignorenulls=True).over(way)).where("not stop and until is not null")
    frames = met.groupBy("genome", "contig", "strand", F.col("until").alias("stop")).agg(F.min("at").alias("low"), F.max("at").alias("high"), F.collect_list("at").alias("places"))
    ahead = F.col("strand") == 1
    frames = frames.withColumn("begin", F.when(ahead, F.col("low")).otherwise(F.col("stop"))).withColumn("end", F.when(ahead, F.col("stop")).otherwise(F.col("high")) + 3)
    starts = F.array_sort(F.transform("places", lambda p: (F.when(ahead, p - F.col("low")).otherwise(F.col("high") - p) / 3).cast("int")))
    return frames.where(F.col("end") - F.col("begin") >= minimum).select("genome", "contig", "strand", "stop", "begin", "end", starts.alias("starts"))


def with_bases(frames: DataFrame, parts: DataFrame, size: int = PIECE) -> DataFrame:
    """``frames`` with ``dna``, the coding strand from begin to end, put together from the pieces it lies in."""
    lies = frames.select("genome", "contig", "strand", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / size).cast("int"), F.floor((F.col("end") - 1) / size).cast("int"))).alias("piece"))
    low = F.greatest(F.col("begin") - F.col("piece") * size, F.lit(0))
    high = F.least(F.col("end") - F.col("piece") * size, F.lit(size))
    cut = lies.join(parts.select("genome", "contig", "piece", "bases"), ["genome", "contig", "piece"]).select(
        "genome", "contig", "strand", "begin", "end", "piece", F.substr("bases", (low + 1).cast("int"), (high - low).cast("int")).alias("part")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "part"))), lambda x: x["part"]), "")
    keys = ["genome", "contig", "strand", "begin", "end"]
    dna = cut.groupBy(*keys).agg(joined.alias("dna")).withColumn("dna", F.when(F.col("strand") == 1, F.col("dna")).otherwise(reverse_complement("dna")))
    return frames.join(dna, keys)


def longest_frames(frames: DataFrame, bin_size: int = 100) -> DataFrame:
    """The frames that are the longest over more than half of the stretch they lie in, by bins of so many bases."""
    own = F.struct((F.col("end") - F.col("begin")).alias("n"), "begin", "strand", "end")
    lies = frames.select("genome", "contig", own.alias("own"), F.explode(F.sequence(F.floor(F.col("begin") / bin_size), F.floor((F.col("end") - 1) / bin_size))).alias("bin"))
    won = lies.groupBy("genome", "contig", "bin").agg(F.max("own").alias("own")).groupBy("genome", "contig", "own").agg(F.count("*").alias("won"))
    bins = F.floor((F.col("own.end") - 1) / bin_size) - F.floor(F.col("own.begin") / bin_size) + 1
    keep = won.where(2 * F.col("won") > bins).select("genome", "contig", "own.strand", "own.begin", "own.end")
    return frames.join(keep, keep.columns, "left_semi")


def training_frames(frames: DataFrame, least: int = TRAINING) -> DataFrame:
    """Frames of at least ``least`` bases, the longest where they lie, with most G and C at the codon position that most
    bases of such frames prefer."""
    frames = longest_frames(frames.where(F.length("dna") >= least))
    gc = [F.length(F.regexp_replace(F.regexp_replace("dna", "(.)(.)(.)", f"${k}"), "[^GC]", "")) for k in (1, 2, 3)]
    first = F.when((gc[0] > gc[1]) & (gc[0] >= gc[2]), 1).when((gc[1] >= gc[0]) & (gc[1] > gc[2]), 2).otherwise(3)
    long = frames.select("genome", "dna", first.alias("richest"))
    votes = long.groupBy("genome", "richest").agg(F.sum(F.length("dna")).alias("bases"))
    best = votes.groupBy("genome").agg(F.max_by("richest", F.struct("bases", "richest")).alias("richest"))
    return long.join(best, ["genome", "richest"], "left_semi").select("genome", "dna")


def hexamers(texts: DataFrame, step: int, both: bool = False, size: int | None = None) -> DataFrame:
    """(genome, hex, n): counts of six bases at every ``step``-th place of (genome, text), of both strands if asked; summed in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for genome, n in held.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([genome] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], ["genome", "hex", "n"])
            held.clear()

        for batch in batches:
            for genome, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
                counts = held.setdefault(genome, np.zeros(4096, np.int64))
                counts += np.bincount(pair_codes(raw[: size + 5] if size else raw, step), minlength=4096)
                if both:
                    counts += np.bincount(pair_codes(_reversed(raw[: size + 5] if size else raw), step), minlength=4096)
            if len(held) > 200:
                yield from rows()
        yield from rows()

    return map_arrow(texts, run, "genome string, hex int, n long").groupBy("genome", "hex").agg(F.sum("n").alias("n"))


def pair_codes(raw: np.ndarray, step: int) -> np.ndarray:
    """Numbers of six bases at every ``step``-th place; places with other letters are left out."""
    if len(raw) < 6:
        return np.empty(0, np.int64)
    c = _codon_codes(raw).astype(np.int64)
    both = np.where((c[:-3] | c[3:]) >= 64, -1, 64 * c[:-3] + c[3:])[::step]
    return both[both >= 0]


_OTHER = np.arange(256, dtype=np.uint8)
_OTHER[[ord(c) for c in "ACGT"]] = [ord(c) for c in "TGCA"]


def _reversed(raw: np.ndarray) -> np.ndarray:
    return _OTHER[raw][::-1]


def coding_model(coding: DataFrame, background: DataFrame) -> DataFrame:
    """(genome, hexes, odds): logarithms of how much more often a hexamer is in frame than anywhere, one added to every count."""
    share = lambda n, total: F.log((F.coalesce(F.col(n), F.lit(0)) + 1) / (F.col(total) + 4096))
    sums = lambda df, name: df.groupBy("genome").agg(F.sum("n").alias(name))
    joined = background.withColumnRenamed("n", "b").join(coding.withColumnRenamed("n", "c"), ["genome", "hex"], "left")
    joined = joined.join(sums(coding, "all_c"), "genome").join(sums(background, "all_b"), "genome")
    odds = joined.select("genome", F.struct("hex", (share("c", "all_c") - share("b", "all_b")).alias("odds")).alias("x"))
    return odds.groupBy("genome").agg(F.collect_list("x").alias("x")).select("genome", F.col("x.hex").alias("hexes"), F.col("x.odds").alias("odds"))


def scored(frames: DataFrame, model: DataFrame, minimum: int = MINIMUM, least: float = LEAST, group: int = 64 * PIECE) -> DataFrame:
    """(genome, contig, strand, begin, end, score): the genes that the frames allow, of each those starts that no longer gene beats.

    A genome's model goes to every part of the genome; no part is larger than ``group`` bases.
    """
    ship(frames.sparkSession)
    names = ("genome", "contig", "strand", "begin", "end", "score")
    types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64())

    def run(rows: pa.Table, models: pa.Table) -> pa.Table:
        odds, first, out = np.zeros(4096), np.zeros(64), []
        first[[_number(codon) for codon in STARTS]] = START_SCORES
        if models.num_rows:
            odds[models.column("hexes")[0].as_py()] = models.column("odds")[0].as_py()
        for r in rows.to_pylist() if models.num_rows else []:
            raw = np.frombuffer(r["dna"].encode("latin-1", "replace"), np.uint8)
            c = _codon_codes(raw)[::3].astype(np.int64)
            pairs = np.where((c[:-1] | c[1:]) >= 64, 0.0, odds[np.minimum(64 * c[:-1] + c[1:], 4095)])
            rest, best = np.cumsum(pairs[::-1])[::-1], 0.0
            rest = rest + first[np.minimum(c[:-1], 63)]
            # From the shortest on: a longer gene that scores no more only overlaps more.
            for k in reversed(r["starts"]):
                n = len(raw) - 3 * k
                if n >= minimum and rest[k] > best and rest[k] >= least + EXTRA * max(0.0, 1 - n / SHORT):
                    best = float(rest[k])
                    cut = 3 * k
                    out.append((r["genome"], r["contig"], r["strand"], r["begin"] + (cut if r["strand"] == 1 else 0), r["end"] - (0 if r["strand"] == 1 else cut), best))
        cols = zip(*out, strict=True) if out else [[]] * len(names)
        return pa.table([pa.array([*c], t) for c, t in zip(cols, types, strict=True)], names=list(names))

    part = frames.withColumn("part", F.concat_ws(":", "contig", F.floor(F.col("begin") / group)))
    every = part.select("genome", "part").distinct().join(model, "genome").select(F.col("genome").alias("of"), F.col("part").alias("within"), "hexes", "odds")
    cols = part.select("genome", "part", "contig", "strand", "begin", "end", "starts", "dna")
    return cols.groupBy("genome", "part").cogroup(every.groupBy("of", "within")).applyInArrow(run, "genome string, contig string, strand int, begin long, end long, score double")


class _Choice:
    """The best set of genes of a stretch, as its candidates stream by in order of their begins."""

    def __init__(self):
        self.genes: list = []
        self.best: list[float] = []
        self.before: list[int] = []
        self.open: list[tuple[int, int]] = []
        self.settled = (0.0, -1)

    def step(self, r) -> list[tuple]:
        while self.open and self.open[0][0] <= r.begin:
            _, i = heapq.heappop(self.open)
            self.settled = max(self.settled, (self.best[i], i))
        top = self.settled
        for end, i in self.open:
            g = self.genes[i]
            over = end - r.begin
            if end < r.end and over <= OVERLAP[1 if g.strand == r.strand else -1]:
                top = max(top, (self.best[i] - OVERLAP_COST * over, i))
        self.genes.append(r)
        self.best.append(top[0] + r.score)
        self.before.append(top[1])
        heapq.heappush(self.open, (r.end, len(self.genes) - 1))
        return []

    def end(self) -> list[tuple]:
        at, out = max(range(len(self.best)), key=self.best.__getitem__), []
        while at >= 0:
            g = self.genes[at]
            out.append((g.genome, g.contig, int(g.strand), int(g.begin), int(g.end), float(g.score)))
            at = self.before[at]
        return out


def chosen(candidates: DataFrame) -> DataFrame:
    """The genes of the best set: the sum of the scores, less what overlaps cost, is as high as can be."""
    row = Window.partitionBy("genome", "contig").orderBy("begin", "end", "strand")
    ahead = F.max("end").over(row.rowsBetween(Window.unboundedPreceding, -1))
    cut = candidates.withColumn("new", F.when(F.col("begin") < ahead, 0).otherwise(1))
    cut = cut.withColumn("stretch", F.concat_ws(":", "genome", "contig", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0))))
    return fold_sorted(cut.drop("new"), "stretch", ["begin", "end", "strand"], _Choice, "genome string, contig string, strand int, begin long, end long, score double")


def predict(contigs: DataFrame, code: int = 11, minimum: int = MINIMUM, least: float = LEAST, passes: int = 2, size: int = PIECE, stage: Stage | None = None) -> DataFrame:
    """(genome, contig, contig_len, begin, end, protid, strand, score, dna, dna_hash) of the genes of (genome, rec_ord, seqid, seq).

    Begins count from 0 and ends are exclusive; genes are numbered from 1 over the contigs of a genome in their order.
    Genes are whole: from a start to a stop on the contig.  A genome without a frame of ``TRAINING`` bases has no genes, nor
    have empty or null contigs.  Letters other than A, C, G and T are in no codon that counts.  Names of contigs are
    unlike within a genome.
    """
    stage = stage or Stage(contigs.sparkSession)
    parts = stage.write(pieces(contigs.where("seq <> ''"), size), "pieces")
    frames = stage.write(with_bases(open_frames(codon_places(parts, code, size), minimum), parts, size), "frames")
    background = stage.write(hexamers(parts.select("genome", F.col("bases").alias("text")), 1, True, size), "background")
    coding = hexamers(training_frames(frames).select("genome", F.col("dna").alias("text")), 3)
    for k in range(passes):
        model = stage.write(coding_model(coding, background), f"model{k}")
        found = stage.write(chosen(scored(frames, model, minimum, least)), f"genes{k}")
        mine = stage.write(with_bases(found, parts, size), f"bases{k}")
        coding = hexamers(mine.select("genome", F.col("dna").alias("text")), 3)
    lengths = parts.select("genome", "contig", "rec_ord", "contig_len").distinct()
    number = F.row_number().over(Window.partitionBy("genome").orderBy("rec_ord", "contig", "begin", "end"))
    genes = mine.join(lengths, ["genome", "contig"]).withColumn("protid", number)
    return genes.select("genome", "contig", "contig_len", "begin", "end", "protid", "strand", "score", "dna", sequence_hash("dna").alias("dna_hash"))
