import hashlib
import random
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from locusflow.functions import align as A
from locusflow.functions import codecs as C
from locusflow.functions import sequence as S
from locusflow.functions import translate as T


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_reverse_complement(spark):
    r = random.Random(1)
    seqs = ["", "acgtN", "ACG"] + ["".join(r.choice("ACGT") for _ in range(40)) for _ in range(20)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    for row in df.select("s", S.reverse_complement("s").alias("rc"), S.reverse_complement(S.reverse_complement("s")).alias("twice")).collect():
        pair = {"A": "T", "C": "G", "G": "C", "T": "A"}
        assert row["rc"] == "".join(pair.get(c, c) for c in row["s"].upper()[::-1]) and row["twice"] == row["s"].upper()


@pytest.mark.parametrize("cell,masked", [("INF-3", "3"), ("*7", "7"), ("INF-*9", "9"), ("LNF", "0"), ("12", "12"), ("12abc", "120"), ("PLOT3", "0")])
def test_mask(spark, cell, masked):
    assert one(spark, S.mask_cell("c"), c=cell) == masked


def plain_minimizers(s, k=5, w=5):
    words = [s[i : i + k] for i in range(len(s) - k + 1)]
    return {min(words[i : i + w]) for i in range(len(words) - w + 1)}


def test_minimizers(spark):
    r = random.Random(2)
    seqs = ["", "AAAA", "ABCDEFGH", "ABCDEFGHI"] + ["".join(r.choice("ACDEF") for _ in range(r.randrange(5, 60))) for _ in range(40)]
    got = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", S.minimizers("s").alias("m")).collect()
    assert all(set(x["m"]) == plain_minimizers(x["s"]) and len(x["m"]) == len(set(x["m"])) for x in got)


def test_kmers_and_helpers(spark):
    assert one(spark, S.kmers("s", 3, 2), s="ABCDEFG") == ["ABC", "CDE", "EFG"] and one(spark, S.kmers("s", 9), s="AB") == []
    assert one(spark, S.missing_between(F.array(F.lit(2), F.lit(5), F.lit(6)))) == [3, 4]
    assert one(spark, S.range_with_stop(1, 8, 3)) == [1, 4, 7, 8]
    assert one(spark, S.replace_in_order("s", S.ID_REPLACEMENTS), s="a|b_c(d)'e\":") == "a-b-cde"
    assert one(spark, S.genome_of("s"), s="/x/y/gen.one.fasta") == "gen" and one(spark, S.basename("s"), s="/x/gen.one.fasta") == "gen.one"
    assert one(spark, S.header_product("s"), s="sp|X|Y Protein of things OS=Some bug OX=1 GN=abc PE=1") == "Protein of things"
    assert one(spark, S.header_field("s", "GN"), s="x y OS=Some bug GN=abc PE=1") == "abc" and one(spark, S.header_field("s", "GN"), s="x y") == "not_found"
    assert one(spark, S.error_category("s"), s="sense(First codon 'AAA' is not a start codon),antisense(Extra in frame stop codon found.)") == "Missing Start Codon"
    assert [str(one(spark, S.parse_time("s"), s=x)) for x in ("2020-01-02T03:04:05.5", "2020-01-02T03:04:05", "2020-01-02")] == ["2020-01-02 03:04:05.500000", "2020-01-02 03:04:05", "None"]
    assert tuple(one(spark, S.elapsed(F.to_timestamp(F.lit("2020-01-01 00:00:00")), F.to_timestamp(F.lit("2020-01-01 00:02:05"))))) == (2, 5)


@pytest.mark.parametrize("kind", ["sha256", "sha512", "md5", "sha1", "crc32", "adler32", "blake2b"])
def test_hashes(spark, kind):
    want = str(getattr(zlib, kind)(b"ACGT") & 0xFFFFFFFF) if kind in ("crc32", "adler32") else hashlib.new(kind, b"ACGT").hexdigest()
    assert one(spark, S.sequence_hash("s", kind), s="ACGT") == want


@pytest.mark.parametrize("values,q", [([5], (5, 5, 5)), ([1, 2], (1, 2, 2)), ([1, 2, 3], (1, 2, 3)), ([1, 2, 3, 4], (2, 2, 4)), ([1, 3, 5, 7, 9, 11, 13], (3, 7, 11))])
def test_quartiles(spark, values, q):
    assert tuple(one(spark, S.quartiles(F.col("v")), v=values)) == q


def test_polyline():
    r = random.Random(3)
    for _ in range(200):
        numbers = [r.randrange(-10**6, 10**6) for _ in range(r.randrange(8))]
        assert C.decode_polyline(C.encode_polyline(numbers)) == numbers
    for precision in range(1, 7):
        for _ in range(100):
            numbers = [round(r.uniform(-500, 500), precision) for _ in range(r.randrange(8))]
            text = C.encode_polyline(numbers, precision)
            assert ord(text[0]) - 63 == precision and C.decode_polyline(text) == numbers
    assert C.decode_polyline(C.encode_polyline([0.29, 0.58, -0.29], 2)) == [0.29, 0.58, -0.29]
    assert C.encode_polyline([38.5], 5) == "D_p~iF" and C.encode_polyline([], 0) == "?" and C.encode_polyline([1, 0, 200], 0) == "?A@oK"


def test_codes():
    assert len(T.CODES) == 19 and all(len(T.codons(c)) == 64 for c in T.CODES)
    assert T.codons(11)["ATG"] == "M" and T.codons(4)["TGA"] == "W" and T.codons(1)["TGA"] == "*"


GENE = "ATGGCTTGGAAATAA"


@pytest.mark.parametrize("name", T.ORIENTATIONS)
def test_orientations(name):
    protein, strand, found, error = T.translate_any(T.orient(GENE, name))
    assert (protein, strand, error) == ("MAWK", GENE, None) and T.orient(T.orient(GENE, name), found) == GENE


def test_translation_errors(spark):
    rows = [(GENE,), ("ATGNCTTAA",), ("ATGCTAA",), ("ATGTAA",), ("GGGGGGGGG",), ("GTGTGGTAG",), ("atggcttggaaataa",), (None,), ("",)]
    got = [(r["protein"], r["error"]) for r in T.translated(spark.createDataFrame(rows, "dna string"), minimum=9).collect()]
    assert got[0] == got[6] == ("MAWK", None) and got[5] == ("MW", None)
    assert got[1][1] == "ambiguous or invalid characters" and got[2][1] == "sequence length is not a multiple of 3" and got[3][1] == "sequence shorter than 9 nucleotides"
    assert got[4][1].startswith("sense(First codon 'GGG' is not a start codon)") and got[4][1].count("(") == 4
    assert T.translate_strict("ATGTAAGCTTAA") == (None, "Extra in frame stop codon found.")


def test_native_translation(spark):
    assert one(spark, T.translate_native(F.col("s")), s="ATGGCNTAAGG") == "MX*"
    with pytest.raises(ValueError):
        T.translated(spark.createDataFrame([("A",)], "dna string"), code=99)


def plain_alignment(a, b):
    m = A.matrix()
    h, e, f = ([[0] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in range(3))
    best = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            e[i][j] = f[i][j] = -(10**9)
    for i, j in product(range(1, len(a) + 1), range(1, len(b) + 1)):
        e[i][j] = max(e[i - 1][j], h[i - 1][j] - 11) - 1
        f[i][j] = max(f[i][j - 1], h[i][j - 1] - 11) - 1
        h[i][j] = max(0, h[i - 1][j - 1] + int(m[ord(a[i - 1]), ord(b[j - 1])]), e[i][j], f[i][j])
        best = max(best, h[i][j])
    return best


def test_alignment():
    r = random.Random(7)
    for _ in range(60):
        a = "".join(r.choice(A.RESIDUES) for _ in range(r.randrange(1, 40)))
        b = a[r.randrange(len(a)) :] + "".join(r.choice(A.RESIDUES) for _ in range(r.randrange(5))) + a[: r.randrange(len(a) + 1)]
        score, first, last = A.align(a, b)
        assert score == plain_alignment(a, b)
        if score:
            assert 1 <= first <= last <= len(a) and plain_alignment(a[first - 1 : last], b) == score
    assert A.align("", "A") == (0, 0, 0)


def test_self_score(spark):
    p = "MKWVTFISLLFLFSSAYSRGVFRR"
    assert one(spark, S.self_score("s"), s=p) == A.align(p, p)[0]


def test_shared_minimizers_of_short_and_long_queries(spark):
    """Queries of which one word is enough are counted as they meet references; others are met by their rarest words."""
    from locusflow.operators.matching import shared_minimizers

    r = random.Random(6)
    base = "".join(r.choice("ACDEFGHIKL") for _ in range(120))
    cut = lambda n: base[(at := r.randrange(120 - n)) : at + n]
    queries = {f"q{i}": cut(r.choice([12, 20, 60, 100])) for i in range(40)} | {"none": "ACD"}
    references = {f"r{i}": cut(r.choice([15, 40, 90])) for i in range(15)}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "id string, seq string")
    for threshold in (0.02, 0.15):
        want = {}
        for a, x in queries.items():
            words = plain_minimizers(x)
            for b, y in references.items():
                if words and len(words & plain_minimizers(y)) >= max(1, threshold * len(words) - 1e-9):
                    want[a, b] = len(words & plain_minimizers(y)) / len(words)
        found = shared_minimizers(frame(queries), frame(references), threshold, None)
        assert {(x["query"], x["reference"]): x["similarity"] for x in found.collect()} == want and len(want) > 100
        assert ("array_intersect" in found._jdf.queryExecution().toString()) == (threshold > 0.1)
