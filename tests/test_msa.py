import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.functions.align import RESIDUES
from locusflow.operators import msa, phylo


def evolved(r, n=12, length=80):
    """Sequences of a family that split again and again, with substitutions and gaps nested in each other."""
    out = ["".join(r.choice(RESIDUES) for _ in range(length))]
    while len(out) < n:
        s = list(r.choice(out))
        for _ in range(r.randrange(1, 6)):
            at = r.randrange(len(s))
            s[at] = r.choice(RESIDUES)
        at = r.randrange(len(s) - 8)
        if r.random() < 0.5:
            del s[at : at + r.randrange(1, 7)]
        else:
            s[at:at] = [r.choice(RESIDUES) for _ in range(r.randrange(1, 5))]
        out.append("".join(s))
    return list(dict.fromkeys(out))


@pytest.fixture(scope="module")
def families():
    r = random.Random(12)
    return {f"l{k}": evolved(r) for k in range(4)}


def aligned(spark, groups):
    rows = [(locus, s) for locus, seqs in groups.items() for s in seqs]
    out = {}
    for x in msa.align_groups(spark.createDataFrame(rows, "locus string, seq string")).collect():
        out.setdefault(x["locus"], {})[x["seq"]] = x["aligned"]
    return out


def test_not_below_star_alignment(spark, families):
    got = aligned(spark, families)
    better = 0
    for locus, seqs in families.items():
        rows = [got[locus][s] for s in seqs]
        assert [x.replace("-", "") for x in rows] == seqs and len({len(x) for x in rows}) == 1
        star = phylo.star_alignment(seqs)
        assert msa.pair_score(rows) >= msa.pair_score(star)
        better += msa.pair_score(rows) > msa.pair_score(star)
    assert better >= 2


def test_nested_gaps_by_hand(spark):
    seqs = ["MKVLAWGHCE", "MKVAWGHCE", "MKAWGHCE", "MKVLAWGH"]
    got = aligned(spark, {"a": seqs, "one": ["MKV"], None: ["AC", "AWC"]})
    assert got["a"]["MKVLAWGHCE"] == "MKVLAWGHCE" and got["a"]["MKVLAWGH"] == "MKVLAWGH--"
    assert got["a"]["MKVAWGHCE"] == "MKV-AWGHCE" and got["a"]["MKAWGHCE"] == "MK--AWGHCE"
    assert got["one"] == {"MKV": "MKV"} and got[None] == {"AC": "A-C", "AWC": "AWC"}


def test_merge_against_all_alignments():
    """The best score of two short profiles is that of the best of all ways to align them."""
    r = random.Random(2)
    for _ in range(30):
        a, b = ("".join(r.choice("ACWKD") for _ in range(r.randrange(0, 5))) for _ in range(2))
        pa, pb = msa.profile_of(a) if a else np.zeros((0, 21)), msa.profile_of(b) if b else np.zeros((0, 21))

        def best(i, j):
            if i == len(a) or j == len(b):
                return -msa.GAP * (len(a) - i + len(b) - j)
            same = msa._SCORES[msa._INDEX[ord(a[i])], msa._INDEX[ord(b[j])]]
            return max(same + best(i + 1, j + 1), best(i + 1, j) - msa.GAP, best(i, j + 1) - msa.GAP)

        left, right = msa.merge(pa, pb)
        rows = ["".join("-" if i < 0 else s[i] for i in cols) for s, cols in ((a, left), (b, right))]
        assert [x.replace("-", "") for x in rows] == [a, b]
        assert abs((msa.pair_score(rows) if rows[0] else 0.0) - best(0, 0)) < 1e-6


def test_many_alike_take_few_rounds(spark, monkeypatch):
    """A locus of 300 sequences that differ in one place each, in the rounds that a logarithm allows."""
    r = random.Random(5)
    base = "".join(r.choice(RESIDUES) for _ in range(60))
    seqs = list(dict.fromkeys(base[:i] + c + base[i + 1 :] for i in range(0, 60, 4) for c in RESIDUES))[:200]
    rounds = []
    write = msa.Stage.write
    monkeypatch.setattr(msa.Stage, "write", lambda self, df, name: (rounds.append(name) if name.startswith("msa-chosen") else None, write(self, df, name))[1])
    got = aligned(spark, {"x": seqs})["x"]
    assert got == {s: s for s in seqs} and len(rounds) <= 22


def test_hard_rows(spark):
    rows = [("a", None), ("a", ""), ("a", "MK"), ("a", "mk*x"), ("a", "MK")]
    got = {x["seq"]: x["aligned"] for x in msa.align_groups(spark.createDataFrame(rows, "locus string, seq string")).collect()}
    assert set(got) == {"", "MK", "mk*x"} and len({len(v) for v in got.values()}) == 1 and set(got[""]) <= {"-"}
    assert msa.align_groups(spark.createDataFrame([], "locus string, seq string")).count() == 0


def test_alignments_of_samples(spark, families):
    rows = [(locus, f"s{i}", s) for locus, seqs in families.items() for i, s in enumerate(seqs) if not (locus == "l1" and i == 3)]
    out = phylo.concatenated(phylo.aligned_loci(spark.createDataFrame(rows, "locus string, FILE string, seq string")))
    assert out.select(F.length("aligned")).distinct().count() == 1 and out.count() == max(map(len, families.values()))


def test_rounds_and_one_task_agree(spark, families, monkeypatch):
    """A locus goes through rounds of tables down to few nodes and is finished in one task: no round if it is short."""
    rows = [(locus, s) for locus, seqs in families.items() for s in seqs] + [("one", "MKV"), ("none", "")]
    frame, rounds, write = spark.createDataFrame(rows, "locus string, seq string"), [], msa.Stage.write
    monkeypatch.setattr(msa.Stage, "write", lambda self, df, name: (rounds.append(name), write(self, df, name))[1])
    for finish, least, most in ((1024, 0, 0), (6, 1, 6), (1, 3, 12)):
        rounds.clear()
        got = {}
        for x in msa.align_groups(frame, finish=finish).collect():
            got.setdefault(x["locus"], {})[x["seq"]] = x["aligned"]
        assert least <= sum(name.startswith("msa-chosen") for name in rounds) <= most
        assert got["one"] == {"MKV": "MKV"} and got["none"] == {"": ""}
        for locus, seqs in families.items():
            aligned = [got[locus][s] for s in seqs]
            assert [a.replace("-", "") for a in aligned] == seqs and len({len(a) for a in aligned}) == 1
            assert msa.pair_score(aligned) >= msa.pair_score(phylo.star_alignment(seqs))
