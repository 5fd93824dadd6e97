import random

import pytest

from locusflow.operators import genes as G

SCHEMA = "genome string, rec_ord long, seqid string, seq string"
#: Codons of planted genes, the frequent ones repeated.
CODONS = ("CTG GCG GAA AAA GGC ATC GTG CTG GCG GAA AAC CAG ACC CGC GAT TTC CCG TAC AGC CTG GCG").split()
PAIR = str.maketrans("ACGT", "TGCA")


def gene(r, n, start="ATG"):
    return start + "".join(r.choice(CODONS) for _ in range(n)) + r.choice(["TAA", "TGA", "TAG"])


def spacer(r, n):
    """Random bases with stops in all six frames at both ends."""
    wall = "TTAATTAATTAACTAGCTAGCTAG"
    return wall + "".join(r.choice("ACGT") for _ in range(n)) + wall


@pytest.fixture(scope="module")
def planted():
    """Contigs with genes of both strands, some overlapping by four bases, and long random stretches with open frames."""
    r = random.Random(11)
    rows, want = [], set()
    for genome in ("g1", "g2"):
        for k in range(3):
            text = spacer(r, 400)
            for j in range(14):
                if j % 5 == 4:
                    # The next gene starts on the last bases of this one: ...ATGA.
                    first = gene(r, r.randrange(60, 200))[:-3] + "GCATGA"
                    two = "ATGAAA" + gene(r, r.randrange(60, 150))[3:]
                    at = len(text)
                    text += first + two[4:] + spacer(r, 150)
                    want |= {(genome, f"c{k}", at, at + len(first), 1), (genome, f"c{k}", at + len(first) - 4, at + len(first) - 4 + len(two), 1)}
                    continue
                dna = gene(r, r.randrange(70, 300), r.choice(["ATG", "ATG", "GTG"]))
                at = len(text)
                text += (dna if j % 2 else dna.translate(PAIR)[::-1]) + spacer(r, 300)
                want.add((genome, f"c{k}", at, at + len(dna), 1 if j % 2 else -1))
            rows.append((genome, k, f"c{k}", text))
    return rows, want


@pytest.mark.parametrize("size", [700, G.PIECE])
def test_planted_genes_are_found(spark, planted, size):
    rows, want = planted
    found = G.predict(spark.createDataFrame(rows, SCHEMA), size=size).collect()
    got = {(r["genome"], r["contig"], r["begin"], r["end"], r["strand"]) for r in found}
    stops = lambda xs: {(g, c, e if s == 1 else b, s) for g, c, b, e, s in xs}
    assert len(stops(want) & stops(got)) >= 0.97 * len(want), (len(want), stops(want) - stops(got))
    assert len(stops(got) - stops(want)) <= 0.05 * len(want)
    assert len(want & got) >= 0.9 * len(want)
    texts = {(g, c): s for g, _, c, s in rows}
    for r in found:
        dna = texts[r["genome"], r["contig"]][r["begin"] : r["end"]]
        assert r["dna"] == (dna if r["strand"] == 1 else dna.translate(PAIR)[::-1])
        assert r["dna"][:3] in G.STARTS and r["dna"][-3:] in ("TAA", "TAG", "TGA") and r["contig_len"] == len(texts[r["genome"], r["contig"]])
    for genome in ("g1", "g2"):
        mine = sorted((r for r in found if r["genome"] == genome), key=lambda r: (r["contig"], r["begin"]))
        assert [r["protid"] for r in mine] == list(range(1, len(mine) + 1))


def test_random_frames_are_rejected(spark, planted):
    """Beside genes, open frames of a random contig of the same genome have no coding signal and are no genes."""
    r = random.Random(4)
    noise = "".join(r.choice("ACGT") for _ in range(60_000))
    rows = [x for x in planted[0] if x[0] == "g1"] + [("g1", 9, "noise", noise)]
    contigs = spark.createDataFrame(rows, SCHEMA)
    frames = G.open_frames(G.codon_places(G.pieces(contigs))).where("contig = 'noise'").count()
    found = [x for x in G.predict(contigs).collect() if x["contig"] == "noise"]
    assert frames > 300 and len(found) <= frames // 100


def test_frames_against_a_plain_scan(spark):
    r = random.Random(6)
    rows = [("g", k, f"c{k}", "".join(r.choice("ACGTacgtN" if k else "ACGT") for _ in range(3000))) for k in range(2)]
    contigs = spark.createDataFrame(rows, SCHEMA)
    parts = G.pieces(contigs, 100)
    got = {(x["contig"], x["strand"], x["begin"], x["end"], x["dna"], tuple(x["starts"])) for x in G.with_bases(G.open_frames(G.codon_places(parts, size=100)), parts, 100).collect()}
    want = set()
    for _, _, name, seq in rows:
        for strand, text in ((1, seq.upper()), (-1, seq.upper().translate(PAIR)[::-1])):
            for frame in range(3):
                starts = []
                for at in range(frame, len(text) - 2, 3):
                    codon = text[at : at + 3]
                    if codon in G.STARTS:
                        starts.append(at)
                    elif codon in ("TAA", "TAG", "TGA"):
                        if starts and at + 3 - starts[0] >= G.MINIMUM:
                            a, b = (starts[0], at + 3) if strand == 1 else (len(text) - at - 3, len(text) - starts[0])
                            want.add((name, strand, a, b, text[starts[0] : at + 3], tuple((s - starts[0]) // 3 for s in starts)))
                        starts = []
    assert got == want and len(want) > 20


def test_best_set_against_all_sets(spark):
    r = random.Random(9)
    for _ in range(5):
        rows = []
        for k in range(9):
            a = r.randrange(900)
            rows.append(("g", "c", r.choice([1, -1]), a, a + r.randrange(100, 400), float(r.randrange(5, 60)) + k / 100))
        got = sorted(tuple(x) for x in G.chosen(spark.createDataFrame(rows, "genome string, contig string, strand int, begin long, end long, score double")).collect())
        order, best = sorted(rows, key=lambda x: (x[3], x[4], x[2])), (0.0, [])

        def go(i, last, total, taken):
            nonlocal best
            best = max(best, (total, taken), key=lambda x: x[0])
            for j in range(i, len(order)):
                g = order[j]
                over = max(0, last[4] - g[3]) if last else 0
                inside = any(t[4] > g[3] and t is not last for t in taken)
                if last and (over and (last[4] >= g[4] or over > G.OVERLAP[1 if last[2] == g[2] else -1]) or inside):
                    continue
                go(j + 1, g, total + g[5] - G.OVERLAP_COST * over, taken + [g])

        go(0, None, 0.0, [])
        assert abs(sum(x[5] for x in got) - sum(x[5] for x in best[1])) < 1e-6 and len(got) == len(best[1])


def test_hard_contigs(spark):
    rows = [("a", 0, "x", None), ("b", 0, "x", ""), ("c", 0, "x", "AC"), ("d", 0, "x", "N" * 5000), ("e", 0, "x", "ATG" + "GCG" * 20 + "TAA")]
    assert G.predict(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert G.predict(spark.createDataFrame([], SCHEMA)).count() == 0
