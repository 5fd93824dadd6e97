"""Identifiers of alleles that arrive in a stream: each new sequence of a locus gets the next number, once and for all."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from locusflow.runtime import ship

CELLS = "locus string, genome_ord long, dna_hash string"
NUMBERED = "locus string, genome_ord long, dna_hash string, allele_id long, novel boolean"

#: The store of the state, which keeps it on disk; rows that are given out at a time.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = 10_000


class Numbers(StatefulProcessor):
    """State of a locus: its highest number, and the number of each sequence, looked up one by one.

    Of a batch a task holds the distinct sequences of one locus and two integers a row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.highest = handle.getValueState("highest", "n long")
        self.numbers = handle.getMapState("numbers", "dna_hash string", "n long")

    def _known(self, dna_hash: str) -> int | None:
        return self.numbers.getValue((dna_hash,))[0] if self.numbers.containsKey((dna_hash,)) else None

    def handleInitialState(self, key: Any, initial: pd.DataFrame, timers: Any) -> None:
        """Alleles of the catalogue; a sequence that is there twice has its least number, and numbers go on after the highest."""
        top = self.highest.get()[0] if self.highest.exists() else 0
        for dna_hash, n in zip(initial["dna_hash"], initial["allele_id"].astype("int64"), strict=True):
            top, old = max(top, int(n)), self._known(dna_hash)
            if old is None or n < old:
                self.numbers.updateValue((dna_hash,), (int(n),))
        self.highest.update((top,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        place: dict[str, int] = {}
        first: list[int] = []
        whose, genomes = [], []
        for batch in rows:
            at = batch["dna_hash"].map(lambda h: place.setdefault(h, len(place))).to_numpy(np.int64)
            genome = batch["genome_ord"].to_numpy(np.int64)
            first += [np.iinfo(np.int64).max] * (len(place) - len(first))
            low = pd.Series(genome).groupby(at).min()
            for i, g in zip(low.index, low, strict=True):
                first[i] = min(first[i], int(g))
            whose.append(at)
            genomes.append(genome)
        hashes = list(place)
        numbers = [self._known(h) for h in hashes]
        novel = [n is None for n in numbers]
        top = self.highest.get()[0] if self.highest.exists() else 0
        for i in sorted((i for i, n in enumerate(novel) if n), key=lambda i: (first[i], hashes[i])):
            top += 1
            numbers[i] = top
            self.numbers.updateValue((hashes[i],), (top,))
        self.highest.update((top,))
        for at, genome in zip(whose, genomes, strict=True):
            for k in range(0, len(at), ROWS):
                i, g = at[k : k + ROWS], genome[k : k + ROWS]
                yield pd.DataFrame(
                    {"locus": key[0], "genome_ord": g, "dna_hash": [hashes[x] for x in i], "allele_id": [numbers[x] for x in i], "novel": [novel[x] and first[x] == y for x, y in zip(i, g, strict=True)]}
                )

    def close(self) -> None:
        pass


def numbered_stream(cells: DataFrame, alleles: DataFrame) -> DataFrame:
    """Streamed cells (locus, genome_ord, dna_hash) with allele_id, and whether they are the first of a new allele.

    ``alleles`` (locus, dna_hash, allele_id) are where numbers start.  New sequences of a batch are numbered in the order of
    their first genome, then of their hash: batches whose genomes follow one another get the numbers one batch would give.
    Cells with a null in any of the columns have no allele and are left out; repeated cells stay.
    """
    spark = cells.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    known = alleles.select("locus", "dna_hash", F.col("allele_id").cast("long").alias("allele_id")).where("locus is not null and dna_hash is not null and allele_id is not null")
    rows = cells.select("locus", F.col("genome_ord").cast("long").alias("genome_ord"), "dna_hash").dropna()
    return rows.groupBy("locus").transformWithStateInPandas(Numbers(), NUMBERED, "Append", "None", known.groupBy("locus"))


def number_incrementally(cells: DataFrame, alleles: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the numbered cells of each batch to Parquet; numbers and files survive a restart from the checkpoint."""
    return numbered_stream(cells, alleles).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
