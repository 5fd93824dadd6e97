import random

import pytest

from locusflow.functions.align import RESIDUES, align_many, matrix
from locusflow.operators import search as S

SCHEMA = "id string, seq string"


def mutated(r, seq, identity):
    """A copy that keeps about so many residues, with insertions and deletions."""
    out = []
    for c in seq:
        x = r.random()
        if x < identity:
            out.append(c)
        elif x < identity + (1 - identity) * 0.85:
            out.append(r.choice(RESIDUES))
        elif x < identity + (1 - identity) * 0.92:
            out += [c, r.choice(RESIDUES)]
    return "".join(out)


@pytest.fixture(scope="module")
def families():
    r = random.Random(7)
    heads = [("h%d" % i, "".join(r.choice(RESIDUES) for _ in range(r.randrange(60, 260)))) for i in range(12)]
    members = [(f"{name}-{k}-{pct}", mutated(r, seq, pct / 100)) for name, seq in heads for pct in (45, 55, 65, 80, 95) for k in range(4)]
    return heads, members


@pytest.mark.parametrize("threshold,least", [(11, 0.95), (13, 0.95)])
def test_recall_against_all_pairs(spark, families, threshold, least):
    """Of the pairs that an alignment of all with all puts under the e-value, nearly all are found, with its scores."""
    heads, members = families
    residues = sum(len(s) for _, s in members)
    pairs = [(h, m) for h in heads for m in members]
    scores = align_many([h[1] for h, _ in pairs], [m[1] for _, m in pairs])
    want = {(h[0], m[0]): s[0] for (h, m), s in zip(pairs, scores, strict=True) if s[0] >= S.least_score(len(h[1]), residues)}
    rows = S.search(spark.createDataFrame(heads, SCHEMA), spark.createDataFrame(members, SCHEMA), threshold=threshold).collect()
    got = {(x["query"], x["target"]): x["score"] for x in rows}
    assert len(got) == len(rows) and got.items() <= want.items()
    assert len(want) > 200 and len(got) >= least * len(want), (len(got), len(want))


def test_neighbours_against_all_words(spark):
    m, got = matrix(), {}
    for r in S.neighbours(spark.createDataFrame([("WCH",), ("AAA",), ("AAA",), ("AXA",), ("LIV",)], "word string")).collect():
        got.setdefault(r["word"], set()).add(r["near"])
    every = ["".join(x) for x in S.product(RESIDUES, repeat=3)]
    for word in ("WCH", "AAA", "LIV"):
        assert got[word] == {w for w in every if w == word or sum(m[ord(a), ord(b)] for a, b in zip(word, w, strict=True)) >= 11}
    assert "AXA" not in got


def test_double_hits_by_hand(spark):
    """Two words on one diagonal, apart: the second stays; overlapping ones, or one too far ahead, do not count."""
    frame = lambda s: spark.createDataFrame([(1, s)], "no long, seq string")
    pads = lambda a, n: "".join(a[i % len(a)] for i in range(n))
    q = "WCH" + pads("AST", 10) + "HMW" + pads("GPN", 50) + "CWM"
    t = "WCH" + pads("EKD", 10) + "HMW" + pads("QKE", 50) + "CWM"
    got = {(r["diagonal"], r["at"]) for r in S.double_hits(frame(q), frame(t), threshold=18).collect()}
    assert got == {(0, 13)}
    assert S.double_hits(frame("WCHM"), frame("WCHM"), threshold=15).count() == 0


def test_extension_by_hand():
    scores = matrix()
    own = lambda s: sum(int(scores[ord(c), ord(c)]) for c in s)
    assert S.extension("WCHMWCHM", "WCHMWCHM", [(0, 4)]) == own("WCHMWCHM")
    assert S.extension("WWWWPPPPPPPPPPWWWW", "WWWWGGGGGGGGGGWWWW", [(0, 0)]) == own("WWWW")
    assert S.extension("AAWCHMAA", "WCHM", [(-2, 0)]) == own("WCHM")


def test_hard_rows(spark):
    seqs = [("a", None), ("b", ""), ("c", "MK"), ("d", "A" * 500), ("e", "MKVLWAALLVTFLAGCQAKVEQ" * 3), ("e", "mkvlwaallvtflagcqakveq" * 3), (None, "MKVLWAALLVTFLAGCQAKVEQ"), ("x", "XXXX*XXX")]
    rows = S.search(spark.createDataFrame(seqs, SCHEMA), spark.createDataFrame(seqs, SCHEMA)).collect()
    assert {(r["query"], r["target"]) for r in rows} == {("e", "e"), ("e", None), (None, "e"), (None, None)}
    assert sum(r["query"] == r["target"] == "e" for r in rows) == 4
    none = spark.createDataFrame([], SCHEMA)
    assert S.search(none, spark.createDataFrame(seqs, SCHEMA)).count() == S.search(spark.createDataFrame(seqs, SCHEMA), none).count() == 0


def test_blocks_against_one_pair_at_a_time():
    """Hits and scores without gaps of a block, as plain loops find them for each pair."""
    r = random.Random(3)
    heads = ["".join(r.choice(RESIDUES + "X") for _ in range(n)) for n in (2, 3, 70, 150)] + ["A" * 60]
    members = [mutated(r, h, 0.6) for h in heads for _ in range(3)] + ["", "MK", "é€MKVLWAALLVTF"]
    q, t, m = S._text(heads), S._text(members), matrix()
    words = lambda s: [(i, s[i : i + 3]) for i in range(len(s) - 2) if set(s[i : i + 3]) <= set(RESIDUES) and len(set(s[max(0, i - 4) :][:12])) >= 3]
    want = {}
    for a, head in enumerate(heads):
        for b, member in enumerate(members):
            every = {(j - i, j) for i, x in words(head) for j, y in words(member) if x == y or sum(m[ord(c), ord(d)] for c, d in zip(x, y, strict=True)) >= 11}
            if double := [(d, j) for d, j in every if any((d, j - k) in every for k in range(3, 41))]:
                want[a, b] = (sorted(double), S.extension(head, member, double))
    hits, scores = {}, {}
    for found in S._double(q, S._index(q, 11), t, 40):
        for a, b, d, j in zip(*(x.tolist() for x in found), strict=True):
            hits.setdefault((a, b), []).append((d, j))
        scores |= {(a, b): s for a, b, s in zip(*(x.tolist() for x in S._ungapped(q, t, found, S.DROP)), strict=True)}
    assert {k: (sorted(hits[k]), scores[k]) for k in hits} == want and len(want) > 8


def test_only_pairs_at_the_trigger_are_written(spark, monkeypatch):
    """Words that are alike by chance, in nearly every two sequences, leave no row behind."""
    r = random.Random(4)
    text = lambda: "".join(r.choice(RESIDUES) for _ in range(150))
    heads, members = [(f"h{i}", text()) for i in range(4)], [(f"m{i}", text()) for i in range(150)]
    rows, write = {}, S.Stage.write
    monkeypatch.setattr(S.Stage, "write", lambda self, df, name: (out := write(self, df, name), rows.update({name: out.count()}))[0])
    got = S.search(spark.createDataFrame(heads, SCHEMA), spark.createDataFrame(members + heads[:1], SCHEMA)).collect()
    assert [(x["query"], x["target"]) for x in got] == [("h0", "h0")] and sum(rows.values()) < 2 * (len(heads) + len(members))
