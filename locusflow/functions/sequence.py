"""Column expressions on sequences, identifiers and profile cells; all built-in, no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Diagonal of the BLOSUM62 matrix, by residue.
BLOSUM62_DIAGONAL = {
    "A": 4, "R": 5, "N": 6, "D": 6, "C": 9, "Q": 5, "E": 5, "G": 6, "H": 8, "I": 4, "L": 4, "K": 5, "M": 5, "F": 6,
    "P": 7, "S": 4, "T": 5, "W": 11, "Y": 7, "V": 4, "B": 4, "Z": 4, "X": -1, "*": 1,
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq: Column | str) -> Column:
    """Upper-cased, reversed, A-T and C-G swapped; other characters stay."""
    return F.reverse(F.translate(F.upper(_col(seq)), "ACGT", "TGCA"))


def subsequence(seq: Column | str, start: Column, stop: Column, strand: Column | None = None) -> Column:
    """Zero-based half-open slice; reverse-complemented where strand is 0."""
    cut = F.substring(_col(seq), start + 1, F.greatest(F.lit(0), stop - start))
    return cut if strand is None else F.when(strand == 0, reverse_complement(cut)).otherwise(cut)


def is_dna(seq: Column | str) -> Column:
    return _col(seq).rlike(r"^[ACGT]*\z")


def is_multiple(seq: Column | str, n: int = 3) -> Column:
    return F.length(_col(seq)) % n == 0


def sequence_hash(seq: Column | str, kind: str = "sha256") -> Column:
    """Hexadecimal digest of the UTF-8 bytes; crc32 as an unsigned decimal."""
    data = _col(seq).cast("binary")
    if kind in ("sha224", "sha256", "sha384", "sha512"):
        return F.sha2(data, int(kind[3:]))
    if kind == "md5":
        return F.md5(data)
    if kind == "sha1":
        return F.sha1(data)
    if kind == "crc32":
        return F.crc32(data).cast("string")
    from locusflow.functions.codecs import digest_udf

    return digest_udf(kind)(data)


def kmers(seq: Column | str, k: int, step: int = 1) -> Column:
    """All substrings of length k, ``step`` apart; an empty array for shorter sequences."""
    seq = _col(seq)
    starts = F.sequence(F.lit(1), F.length(seq) - (k - 1), F.lit(step))
    return F.when(F.length(seq) >= k, F.transform(starts, lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def minimizers(seq: Column | str, k: int = 5, window: int = 5) -> Column:
    """Distinct lexicographic minima of all windows of ``window`` adjacent k-mers; empty if there is no full window."""
    seq = _col(seq)
    n = F.length(seq) - (k - 1) - (window - 1)
    words = F.transform(F.sequence(F.lit(1), n + (window - 1)), lambda i: F.substring(seq, i, F.lit(k)))
    # An array around the words, so that they are made once and not anew for every window.
    minima = F.element_at(F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(*[F.get(w, i + j) for j in range(window)]))), 1)
    return F.when(n >= 1, F.array_distinct(minima)).otherwise(F.array().cast("array<string>"))


def replace_in_order(text: Column | str, pairs: tuple[tuple[str, str], ...]) -> Column:
    out = _col(text)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


#: What is replaced in sequence identifiers, in this order.
ID_REPLACEMENTS = (("|", "_"), ("_", "-"), ("(", ""), (")", ""), ("'", ""), ('"', ""), (":", ""))


def mask_cell(cell: Column | str, missing: str = "0") -> Column:
    """Drop INF- and *, then turn the first non-digit and all after it into ``missing``."""
    plain = F.regexp_replace(F.regexp_replace(_col(cell), "INF-", ""), r"\*", "")
    return F.regexp_replace(plain, r"\D+.*", missing)


def is_present(cell: Column | str) -> Column:
    """1 for a masked cell above zero, else 0."""
    return F.when(F.coalesce(_col(cell).try_cast("bigint"), F.lit(0)) > 0, 1).otherwise(0)


def allele_of(allele_id: Column | str) -> Column:
    return F.substring_index(_col(allele_id), "_", -1)


def genome_of(path: Column | str) -> Column:
    """Prefix of a file's base name up to the first dot."""
    return F.element_at(F.split(F.substring_index(_col(path), "/", -1), r"\."), 1)


def basename(path: Column | str) -> Column:
    """Base name without the last suffix."""
    return F.regexp_replace(F.substring_index(_col(path), "/", -1), r"\.[^.]*$", "")


def contains_any(text: Column | str, terms: list[str]) -> Column:
    text, out = _col(text), F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def first_match(text: Column | str, pattern: str) -> Column:
    return F.regexp_extract(_col(text), pattern, 0)


def self_score(protein: Column | str) -> Column:
    """Raw BLOSUM62 score of a protein with itself."""
    diagonal = F.create_map(*[F.lit(x) for kv in BLOSUM62_DIAGONAL.items() for x in kv])
    return F.aggregate(F.split(_col(protein), ""), F.lit(0), lambda s, a: s + F.coalesce(F.element_at(diagonal, a), F.lit(0)))


#: Categories of translation errors, by a part of the message.
ERROR_CATEGORIES = (
    ("Extra in frame stop codon", "In-frame Stop Codon"),
    ("is not a start codon", "Missing Start Codon"),
    ("is not a stop codon", "Missing Stop Codon"),
    ("sequence length is not a multiple of 3", "Incomplete ORF"),
    ("ambiguous or invalid characters", "Ambiguous Bases"),
)


def error_category(message: Column | str) -> Column:
    """Category by what stands before the first comma; null where none fits."""
    head, out = F.element_at(F.split(_col(message), ","), 1), None
    for part, name in ERROR_CATEGORIES:
        out = (F if out is None else out).when(head.contains(part), F.lit(name))
    return out


def header_field(header: Column | str, tag: str) -> Column:
    """Value of TAG= in a proteome header up to the next tag, or not_found."""
    found = F.regexp_extract(_col(header), tag + r"=(.*?)(?: [A-Z]{2}=|$)", 1)
    return F.when(found == "", F.lit("not_found")).otherwise(found)


def header_product(header: Column | str) -> Column:
    """Product name: after the identifier, before the first tag."""
    found = F.regexp_extract(_col(header), r"^\S+\s+(.*?)(?: [A-Z]{2}=|$)", 1)
    return F.when(found == "", F.lit("not_found")).otherwise(found)


def tukey_median(values: Column) -> Column:
    """Median of a sorted array, rounded half to even."""
    n = F.size(values)
    mid = (F.get(values, ((n - 1) / 2).cast("int")) + F.get(values, (n / 2).cast("int"))) / 2
    return F.bround(mid.cast("double"), 0)


def quartiles(values: Column) -> Column:
    """(q1, median, q3) of a sorted array: q1 and q3 are the medians of its lower and upper floor(n/2) values."""
    n = F.size(values)
    half = F.floor(n / 2).cast("int")
    low, high = F.slice(values, F.lit(1), half), F.slice(values, n - half + 1, half)
    one = F.when(n == 1, F.get(values, F.lit(0)).cast("double"))
    return F.struct(
        F.coalesce(one, tukey_median(low)).alias("q1"), F.coalesce(one, tukey_median(values)).alias("median"), F.coalesce(one, tukey_median(high)).alias("q3")
    )


def missing_between(ids: Column) -> Column:
    """Integers between an array's least and greatest that it does not have."""
    return F.array_except(F.sequence(F.array_min(ids), F.array_max(ids)), ids)


def range_with_stop(start: int, stop: int, step: int) -> Column:
    """start, start + step, ... and always stop."""
    return F.array_union(F.sequence(F.lit(start), F.lit(stop), F.lit(step)), F.array(F.lit(stop)))


def parse_time(text: Column | str) -> Column:
    """Timestamp of YYYY-MM-DDTHH:MM:SS with or without a fraction; null for others."""
    return F.when(_col(text).rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?\z"), _col(text).try_cast("timestamp"))


def elapsed(start: Column, end: Column) -> Column:
    """(minutes, seconds) between two timestamps."""
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return F.struct(F.floor(seconds / 60).alias("minutes"), (seconds % 60).alias("seconds"))
