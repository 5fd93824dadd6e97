"""Clustering and elimination on Spark against plain passes in order."""

import random

import pytest

from locusflow.operators import cluster


def words_of(seq, k=5, window=5):
    grams = [seq[i : i + k] for i in range(len(seq) - k + 1)]
    return set(min(grams[i : i + window]) for i in range(len(grams) - window + 1))


def share(a, b):
    return len(a & b) / len(a) if a else 0.0


@pytest.fixture(scope="module")
def seqs():
    """Families of near copies, a word that nearly all have, short and repeated sequences."""
    r = random.Random(5)
    text = lambda n: "".join(r.choice("ACDEFGHIKL") for _ in range(n))
    out = []
    for _ in range(12):
        base = text(r.choice([30, 45, 60]))
        for _ in range(r.choice([1, 2, 6])):
            s = list(base)
            for _ in range(r.choice([0, 1, 3])):
                s[r.randrange(len(s))] = r.choice("MNPQ")
            out.append("AAAAAAAAA" + "".join(s) if r.random() < 0.8 else "".join(s))
    out += ["ACD", "", "ACDEFGHI", out[0], out[0]]
    return {f"s{i:03d}": s for i, s in enumerate(out)}


def greedy(ids, words, similarity, top):
    out, reps = [], []
    for i in ids:
        near = sorted((-share(words[i], words[x]), x) for x in reps if words[i] and share(words[i], words[x]) >= similarity)
        if near:
            out += [(x, i, -s) for s, x in near[:top]]
        else:
            reps.append(i)
            out.append((i, i, 1.0))
    return out


@pytest.mark.parametrize(("groups", "top", "similarity"), [(1, 1, 0.2), (3, 2, 0.4), (7, 1, 0.05)])
def test_greedy(spark, seqs, groups, top, similarity):
    order = sorted(seqs, key=lambda i: (-len(seqs[i]), i))
    words, per = {i: words_of(s) for i, s in seqs.items()}, -(-len(seqs) // groups)
    first = [x for at in range(0, len(order), per) for x in greedy(order[at : at + per], words, similarity, top)]
    reps = [i for i in order if (i, i, 1.0) in first]
    second = greedy(reps, words, similarity, top)
    want = sorted((new, m, round(s2 if rep == m else s, 9)) for rep, m, s in first for new, old, s2 in second if old == rep)
    got = cluster.greedy_clusters(spark.createDataFrame(list(seqs.items()), "seqid string, seq string"), similarity, top, groups)
    assert sorted((r["representative"], r["member"], round(r["similarity"], 9)) for r in got.collect()) == want


def test_pruning(spark, seqs):
    clusters = [(f"r{int(i[1:]) % 3}", i) for i in seqs] + [("r0", "r0"), ("r1", "r1")]
    want = set()
    for rep in ("r0", "r1", "r2"):
        members = sorted((m for c, m in clusters if c == rep and m != rep), key=lambda m: (-len(seqs[m]), m))
        words, out = {m: words_of(seqs[m]) for m in members}, set()
        for m in members:
            if m not in out and words[m]:
                out |= {c if len(seqs[m]) >= len(seqs[c]) else m for c in members if c != m and share(words[m], words[c]) >= 0.9}
        want |= {(rep, m) for m in out}
    frame = spark.createDataFrame([(c, m, 1.0, 1) for c, m in clusters], cluster_schema)
    got = cluster.prune_within(frame, spark.createDataFrame(list(seqs.items()), "seqid string, seq string"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 3


cluster_schema = "representative string, member string, similarity double, length int"


def test_folds(spark):
    """Elimination and selection hit by hit, as plain loops do them."""
    r = random.Random(8)
    ids = [f"q{i:02d}" for i in range(25)]
    size = {i: r.choice([5, 6, 7]) for i in ids}
    hits = [(g, a, b, 100.0 if a == b else float(r.choice([10, 55, 65, 75]))) for g in ("x", "y") for a in ids for b in ids if (a != b or a not in ("q03", "q09")) and (a == b or r.random() < 0.2)]
    frame = spark.createDataFrame(hits, "cluster string, query string, target string, score double")
    want, chosen = set(), set()
    for g in ("x", "y"):
        rows = sorted((q, t, s) for c, q, t, s in hits if c == g)
        own, out = {q for q, t, _ in rows if q == t}, set()
        for q, t, s in rows:
            if q == t or q in out:
                continue
            if q not in own:
                out.add(q)
            elif s >= 60 and t not in out:
                out.add(q if size[t] > size[q] else t)
        want |= {(g, x) for x in out}
        gone = set()
        for q, t, s in sorted(rows, key=lambda x: (size[x[0]], x[0], x[1])):
            if q != t and q in own and s / 100 >= 0.7 and q not in gone:
                gone.add(t)
        chosen |= {(g, i) for i in ids if i not in gone}
    lengths = spark.createDataFrame(list(size.items()), "seqid string, length int")
    assert {tuple(x) for x in cluster.eliminate_by_bsr(frame, lengths).collect()} == want
    loci = frame.withColumnRenamed("cluster", "locus").join(lengths.withColumnsRenamed({"seqid": "query", "length": "q_len"}), "query")
    candidates = spark.createDataFrame([(g, i) for g in ("x", "y") for i in ids], "locus string, seqid string")
    assert {tuple(x) for x in cluster.select_representatives(loci, candidates).collect()} == chosen


def test_rows_of_equal_words_are_linked_once(spark, monkeypatch):
    """Many rows of few names: links are between kinds of words, and a later row may join a later representative."""
    names = ["ABCDEFGHIKLMNOPQ", "ABCDEFGHIXYZXYZX", "ABCDEFGHIXYZXYZA", "XYZXYZAABCDEFGHI", "ABC"]
    seqs = {f"s{i:03d}": names[i % 5] + ("M" * (i % 3) if i % 5 == 4 else "") for i in range(150)}
    order, words = sorted(seqs, key=lambda i: (-len(seqs[i]), i)), {i: words_of(s) for i, s in seqs.items()}
    rows, write = {}, cluster.Stage.write
    monkeypatch.setattr(cluster.Stage, "write", lambda self, df, name: (out := write(self, df, name), rows.update({name: out.count()}))[0])
    for similarity in (0.2, 0.6):
        first = greedy(order, words, similarity, 1)
        second = greedy([i for i in order if (i, i, 1.0) in first], words, similarity, 1)
        want = sorted((new, m, round(s2 if rep == m else s, 9)) for rep, m, s in first for new, old, s2 in second if old == rep)
        got = cluster.greedy_clusters(spark.createDataFrame(list(seqs.items()), "seqid string, seq string"), similarity, 1, 1)
        assert sorted((r["representative"], r["member"], round(r["similarity"], 9)) for r in got.collect()) == want
        assert rows["first-links"] <= 12
