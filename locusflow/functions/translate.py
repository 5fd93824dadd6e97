"""Translation of coding sequences with quality control, in four orientations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions.sequence import is_dna

#: The standard code in the order T, C, A, G, and for each public genetic code its differences and starts.
BASES = "TCAG"
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODES = {
    1: ({}, "TTG CTG ATG"),
    2: ({"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"}, "ATT ATC ATA ATG GTG"),
    3: ({"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"}, "ATA ATG GTG"),
    4: ({"TGA": "W"}, "TTA TTG CTG ATT ATC ATA ATG GTG"),
    5: ({"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"}, "TTG ATT ATC ATA ATG GTG"),
    6: ({"TAA": "Q", "TAG": "Q"}, "ATG"),
    9: ({"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"}, "ATG GTG"),
    10: ({"TGA": "C"}, "ATG"),
    11: ({}, "TTG CTG ATT ATC ATA ATG GTG"),
    12: ({"CTG": "S"}, "CTG ATG"),
    13: ({"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"}, "TTG ATA ATG GTG"),
    14: ({"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"}, "ATG"),
    15: ({"TAG": "Q"}, "ATG"),
    16: ({"TAG": "L"}, "ATG"),
    21: ({"TGA": "W", "ATA": "M", "AGA": "S", "AGG": "S", "AAA": "N"}, "ATG GTG"),
    22: ({"TCA": "*", "TAG": "L"}, "ATG"),
    23: ({"TTA": "*"}, "ATT ATG GTG"),
    24: ({"AGA": "S", "AGG": "K", "TGA": "W"}, "TTG CTG ATG GTG"),
    25: ({"TGA": "G"}, "TTG ATG GTG"),
}
ORIENTATIONS = ("sense", "antisense", "revsense", "revantisense")

_PAIR = str.maketrans("ACGT", "TGCA")


@lru_cache(None)
def codons(code: int) -> dict[str, str]:
    return dict(zip(map("".join, product(BASES, repeat=3)), STANDARD, strict=True)) | CODES[code][0]


@lru_cache(None)
def starts(code: int) -> frozenset[str]:
    return frozenset(CODES[code][1].split())


def translate_strict(dna: str, code: int = 11) -> tuple[str | None, str | None]:
    """(protein, error): a whole coding sequence, its first residue M; else what is wrong with it first."""
    table = codons(code)
    if dna[:3] not in starts(code):
        return None, f"First codon '{dna[:3]}' is not a start codon"
    if len(dna) % 3:
        return None, f"Sequence length {len(dna)} is not a multiple of three"
    residues = [table.get(dna[i : i + 3], "X") for i in range(0, len(dna), 3)]
    if residues[-1] != "*":
        return None, f"Final codon '{dna[-3:]}' is not a stop codon"
    if "*" in residues[:-1]:
        return None, "Extra in frame stop codon found."
    return "M" + "".join(residues[1:-1]), None


def orient(dna: str, orientation: str) -> str:
    return {"sense": dna, "antisense": dna.translate(_PAIR)[::-1], "revsense": dna[::-1], "revantisense": dna.translate(_PAIR)}[orientation]


def translate_any(dna: str, code: int = 11) -> tuple[str | None, str | None, str | None, str | None]:
    """(protein, coding strand's sequence, orientation, error) of the first orientation that translates."""
    errors = []
    for name in ORIENTATIONS:
        strand = orient(dna, name)
        protein, error = translate_strict(strand, code)
        if protein is not None:
            return protein, strand, name, None
        errors.append(f"{name}({error})")
    return None, None, None, ",".join(errors)


def precheck(dna: Column, minimum: int = 0) -> Column:
    """Message of the first cheap check that fails, before any Python: characters, multiple of three, length."""
    return (
        F.when(~is_dna(dna), F.lit("ambiguous or invalid characters"))
        .when(F.length(dna) % 3 != 0, F.lit("sequence length is not a multiple of 3"))
        .when(F.length(dna) < minimum, F.lit(f"sequence shorter than {minimum} nucleotides"))
    )


def translated(seqs: DataFrame, column: str = "dna", code: int = 11, minimum: int = 0) -> DataFrame:
    """``seqs`` with protein, coding_dna, orientation and error; what fails a cheap check never reaches Python.

    Deduplicate first: every row is translated.
    """
    if code not in CODES:
        raise ValueError(f"no genetic code {code}")

    @F.pandas_udf("protein string, coding_dna string, orientation string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for dna in batches:
            yield pd.DataFrame([(None,) * 4 if d is None else translate_any(d, code) for d in dna], columns=["protein", "coding_dna", "orientation", "error"], dtype=object)

    from locusflow.runtime import ship

    ship(seqs.sparkSession)
    checked = seqs.withColumn("_dna", F.upper(F.col(column))).withColumn("_bad", precheck(F.col("_dna"), minimum))
    out = checked.withColumn("_t", run(F.when(F.col("_bad").isNull(), F.col("_dna"))))
    return out.select(*seqs.columns, "_t.protein", "_t.coding_dna", "_t.orientation", F.coalesce("_bad", "_t.error").alias("error"))


def translate_native(dna: Column, code: int = 11) -> Column:
    """Residues of all whole codons, stops as *, by built-ins alone; unknown codons become X."""
    table = F.create_map(*[F.lit(x) for kv in sorted(codons(code).items()) for x in kv])
    n = F.floor(F.length(dna) / 3).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(table, F.substring(dna, i * 3 + 1, F.lit(3))), F.lit("X")))
    return F.when(n > 0, F.array_join(parts, "")).otherwise(F.lit(""))
