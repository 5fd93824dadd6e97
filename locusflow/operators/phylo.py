"""Gene prediction by a plug-in, and alignments of many sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.functions.sequence import sequence_hash
from locusflow.runtime import bounded, ship

GENES = "genome string, contig string, contig_len int, begin int, end int, protid int, strand int, dna string"

#: A predictor gets (contig, sequence) pairs of one genome and yields (contig, begin, end, strand), ends exclusive.
Predictor = Callable[[list[tuple[str, str]]], Iterable[tuple[str, int, int, int]]]

_PAIR = str.maketrans("ACGT", "TGCA")


def predict_genes(contigs: DataFrame, predictor: Predictor) -> tuple[DataFrame, DataFrame]:
    """Coding sequences of ``contigs`` (genome, rec_ord, seqid, seq), and the genomes without any.

    Genes are numbered over all contigs of a genome, in the order the predictor gives them.  One genome is one group.
    """
    ship(contigs.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rec_ord", kind="stable")
        seqs = dict(zip(rows["seqid"], rows["seq"], strict=True))
        out = []
        for k, (contig, begin, end, strand) in enumerate(predictor(list(seqs.items())), 1):
            dna = seqs[contig][begin:end].upper()
            out.append((rows["genome"].iloc[0], contig, len(seqs[contig]), begin, end, k, strand, dna if strand == 1 else dna.translate(_PAIR)[::-1]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in GENES.split(", ")])

    genes = contigs.groupBy("genome").applyInPandas(run, GENES).withColumn("dna_hash", sequence_hash("dna"))
    return genes, contigs.select("genome").distinct().join(genes.select("genome"), "genome", "left_anti")


def open_frames(minimum: int = 90) -> Predictor:
    """The plain predictor: from a start codon to the next stop in frame, longest first per stop, on both strands."""

    def run(contigs: list[tuple[str, str]]) -> Iterable[tuple[str, int, int, int]]:
        for name, seq in contigs:
            found = []
            for strand, text in ((1, seq.upper()), (-1, seq.upper().translate(_PAIR)[::-1])):
                for frame in range(3):
                    start = None
                    for at in range(frame, len(text) - 2, 3):
                        codon = text[at : at + 3]
                        if start is None and codon in ("ATG", "GTG", "TTG"):
                            start = at
                        elif codon in ("TAA", "TAG", "TGA"):
                            if start is not None and at + 3 - start >= minimum:
                                a, b = (start, at + 3) if strand == 1 else (len(text) - at - 3, len(text) - start)
                                found.append((a, b, strand))
                            start = None
            yield from ((name, *x) for x in sorted(found))

    return run


def _global(a: str, b: str, gap: int = -4) -> tuple[str, str]:
    """Global alignment with linear gaps: rows by numpy, the path traced back."""
    x, y = (np.frombuffer(s.encode("latin-1", "replace"), np.uint8) for s in (a, b))
    n, m = len(x), len(y)
    h = np.zeros((n + 1, m + 1), np.int32)
    h[0] = gap * np.arange(m + 1)
    h[:, 0] = gap * np.arange(n + 1)
    slope = gap * np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.maximum(h[i - 1, :-1] + np.where(x[i - 1] == y, 4, -2), h[i - 1, 1:] + gap)
        h[i] = np.maximum.accumulate(np.concatenate([[h[i, 0]], best]) - slope) + slope
    left, right, i, j = [], [], n, m
    while i or j:
        if i and j and h[i, j] == h[i - 1, j - 1] + (4 if x[i - 1] == y[j - 1] else -2):
            i, j = i - 1, j - 1
            left.append(a[i])
            right.append(b[j])
        elif i and h[i, j] == h[i - 1, j] + gap:
            i -= 1
            left.append(a[i])
            right.append("-")
        else:
            j -= 1
            left.append("-")
            right.append(b[j])
    return "".join(reversed(left)), "".join(reversed(right))


def star_alignment(seqs: list[str]) -> list[str]:
    """All sequences aligned to the longest; gaps it gets from one are put into all."""
    if not seqs:
        return []
    centre = max(seqs, key=len)
    pairs = {s: _global(centre, s) for s in dict.fromkeys(seqs)}
    room = [0] * (len(centre) + 1)
    for top, _ in pairs.values():
        at = run = 0
        for c in top + "$":
            if c == "-":
                run += 1
            else:
                room[at] = max(room[at], run)
                at, run = at + 1, 0
    out = {}
    for s, (top, low) in pairs.items():
        parts, k = [], 0
        for at in range(len(centre) + 1):
            extra = ""
            while k < len(top) and top[k] == "-":
                extra += low[k]
                k += 1
            parts.append(extra.ljust(room[at], "-"))
            if at < len(centre):
                parts.append(low[k])
                k += 1
        out[s] = "".join(parts)
    return [out[s] for s in seqs]


def aligned_loci(proteins: DataFrame) -> DataFrame:
    """(locus, FILE, aligned) of (locus, FILE, seq): the distinct sequences of a locus, its alleles, are aligned once."""
    from locusflow.operators.msa import align_groups

    return proteins.join(align_groups(proteins.select("locus", "seq")), ["locus", "seq"]).select("locus", "FILE", "aligned")


def concatenated(aligned: DataFrame) -> DataFrame:
    """(FILE, aligned): the loci's alignments in their order, gaps where a sample has none."""
    widths = aligned.groupBy("locus").agg(F.max(F.length("aligned")).alias("width"))
    every = aligned.select("FILE").distinct().join(bounded(widths)).join(aligned, ["FILE", "locus"], "left")
    cell = F.coalesce("aligned", F.repeat(F.lit("-"), F.col("width")))
    return every.groupBy("FILE").agg(F.array_sort(F.collect_list(F.struct("locus", cell.alias("a")))).alias("x")).select("FILE", F.array_join(F.transform("x", lambda x: x["a"]), "").alias("aligned"))


def cluster_text(clusters: DataFrame) -> DataFrame:
    """Text of (representative, member, similarity, length): >representative, then its members; largest clusters first."""
    item = F.concat(F.lit("("), F.concat_ws(", ", "member", F.col("similarity").cast("string"), F.col("length").cast("string")), F.lit(")"))
    g = clusters.groupBy("representative").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("m"))
    return g.orderBy(F.desc("n"), "representative").select(F.concat(F.lit(">"), "representative", F.lit("\n"), F.array_join("m", "\n")).alias("value"))
