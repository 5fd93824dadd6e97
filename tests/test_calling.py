"""Calling, building and adapting catalogues, streaming and the command line, end to end on made sequences."""

import random

import pytest

from locusflow import cli
from locusflow.config import Config
from locusflow.plans import calling
from locusflow.sources import database, fasta
from locusflow.streaming import incremental

CODON = {"A": "GCT", "C": "TGT", "D": "GAT", "E": "GAA", "F": "TTT", "G": "GGT", "H": "CAT", "I": "ATT", "K": "AAA", "L": "CTT", "N": "AAT", "P": "CCT", "Q": "CAA", "R": "CGT", "S": "TCT", "T": "ACT", "V": "GTT", "W": "TGG", "Y": "TAT", "M": "ATG"}


def gene(protein, swap=None):
    return "".join((swap or {}).get(a, CODON[a]) for a in protein) + "TAA"


def proteins(n, seed=5, size=90):
    r = random.Random(seed)
    return ["M" + "".join(r.choice("ACDEFGHIKLNPQRSTVWY") for _ in range(size)) for _ in range(n)]


P = proteins(4)


def near(p, n, seed=3):
    r, out = random.Random(seed), list(p)
    for i in r.sample(range(5, len(p)), n):
        out[i] = r.choice([a for a in "ACDEFGHIKLNPQRSTVWY" if a != out[i]])
    return "".join(out)


@pytest.fixture(scope="module")
def alleles(spark):
    rows = [(f"locus{i}", i, 1, "1", False, gene(p)) for i, p in enumerate(P[:3], 1)]
    return spark.createDataFrame(rows, "locus string, locus_idx int, allele_ord int, allele_id string, is_local boolean, dna string")


@pytest.fixture(scope="module")
def cds(spark):
    silent = {"A": "GCC", "L": "CTC", "G": "GGC", "K": "AAG"}
    rows = [
        ("g1", 1, 1, gene(P[0])), ("g1", 1, 2, gene(P[1], silent)), ("g1", 1, 3, gene(near(P[2], 4))), ("g1", 1, 4, "ATGAAATAG"),
        ("g2", 2, 1, gene(P[0])), ("g2", 2, 2, gene(P[0])), ("g2", 2, 3, gene(P[1], silent)), ("g2", 2, 4, gene(near(P[2], 22, 9))),
        ("g3", 3, 1, gene(P[0])[::-1]), ("g3", 3, 2, gene(P[3])), ("g3", 3, 3, gene(near(P[2], 4))), ("g3", 3, 4, gene(P[1][:40])),
    ]
    return spark.createDataFrame([(*r[:3], f"{r[0]}-protein{r[2]}", r[3]) for r in rows], "genome string, genome_ord int, protid int, seqid string, dna string")


def table(calls):
    return {(r["FILE"], r["locus"]): r["cell"] for r in calls.profiles.collect()}


def test_modes(alleles, cds):
    one = table(calling.AlleleCaller(alleles, mode=1).run(cds))
    assert one["g1", "locus1"] == "1" and one["g2", "locus1"] == "NIPHEM" and one["g1", "locus2"] == "PLNF" and len(one) == 9
    two = table(calling.AlleleCaller(alleles, mode=2).run(cds))
    assert two["g1", "locus2"] == "INF-2" and two["g2", "locus2"] == "2" and two["g3", "locus1"] == "INF-2" or two["g3", "locus1"] in ("1", "2")
    three = table(calling.AlleleCaller(alleles, mode=3).run(cds))
    assert three["g1", "locus3"] == "INF-2" and three["g3", "locus3"] == "2" and three["g2", "locus3"] == "PLNF"
    calls = calling.AlleleCaller(alleles, mode=4).run(cds)
    four = table(calls)
    assert four["g1", "locus3"] == "INF-2" and four["g2", "locus3"].startswith("INF-") and "PLNF" not in four.values()
    assert calls.invalid.count() == 2
    grown = calling.updated_catalogue(alleles, calls.novel)
    again = table(calling.AlleleCaller(grown, mode=1).run(cds))
    assert again["g1", "locus3"] == "2" and again["g1", "locus2"] == "2"


def test_loci_subset_and_bad_mode(spark, alleles, cds):
    only = spark.createDataFrame([("locus1",)], "locus string")
    assert {k[1] for k in table(calling.AlleleCaller(alleles, mode=2).run(cds, loci=only))} == {"locus1"}
    with pytest.raises(ValueError):
        calling.AlleleCaller(alleles, mode=5)


def test_create_and_adapt(spark, cds):
    made = calling.create_catalogue(cds, Config(minimum_length=100))
    got = {r["protein"] for r in made.collect()}
    assert len(got) == made.count() and set(P[:2]) <= got and P[3] in got
    rows = [("L", i, str(i), gene(p)) for i, p in enumerate([P[0], near(P[0], 2), P[1]], 1)] + [("L", 4, "4", "ATGNNN"), ("K", 1, "1", gene(P[2]))]
    done = calling.adapt_catalogue(spark.createDataFrame(rows, "locus string, allele_ord int, allele_id string, dna string"), Config(minimum_length=0, size_threshold=None))
    summary = {r["locus"]: (r["total_alleles"], r["valid_alleles"], r["number_representatives"]) for r in done["summary"].collect()}
    assert summary == {"L": (4, 3, 2), "K": (1, 1, 1)} and done["invalid"].count() == 1


def test_stream(spark, alleles, cds, tmp_path):
    cds.select("genome", "genome_ord", "protid", "dna").write.parquet(f"{tmp_path}/in")
    q = incremental.call_incrementally(incremental.read_cds_stream(spark, f"{tmp_path}/in"), alleles, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def write(path, records):
    path.write_text("".join(f">{i}\n{s}\n" for i, s in records))


def test_command_line(spark, tmp_path):
    (tmp_path / "schema").mkdir()
    for i, p in enumerate(P[:3], 1):
        write(tmp_path / "schema" / f"locus{i}.fasta", [(f"locus{i}_1", gene(p))])
    write(tmp_path / "gA.fasta", [("x", gene(P[0])), ("y", gene(near(P[2], 4)))])
    write(tmp_path / "gB.fasta", [("x", gene(P[0])), ("z", gene(P[1])), ("bad", gene(P[1])[:-3])])
    out = str(tmp_path / "res")
    assert cli.main(["AlleleCall", "-i", f"{tmp_path}/gA.fasta", f"{tmp_path}/gB.fasta", "-g", f"{tmp_path}/schema", "-o", out, "--cds", "--hash-profiles", "crc32", "--output-novel", "--profile-database", f"{tmp_path}/p.db"]) == 0
    assert sorted(r["name"] for r in database.read_sqlite(spark, f"{tmp_path}/p.db", "samples").collect()) == ["gA", "gB"]
    wide = {r["FILE"]: r.asDict() for r in fasta.read_table(spark, f"{out}/results_alleles").collect()}
    assert wide["gA"] == {"FILE": "gA", "locus1": "1", "locus2": "LNF", "locus3": "INF-2"} and wide["gB"]["locus2"] == "1"
    stats = {r["FILE"]: r.asDict() for r in fasta.read_table(spark, f"{out}/results_statistics").collect()}
    info = {r["FILE"]: r.asDict() for r in fasta.read_table(spark, f"{out}/results_contigsInfo").collect()}
    assert info["gA"] == {"FILE": "gA", "locus1": "gA-protein1", "locus2": "LNF", "locus3": "gA-protein2"}
    assert stats["gB"]["invalid_cds"] == "1" and fasta.read_table(spark, f"{out}/paralogous_loci").count() == 0
    per = {r["locus"]: r["Total_CDS"] for r in fasta.read_table(spark, f"{out}/loci_summary_stats").collect()}
    assert per == {"locus1": "2", "locus2": "1", "locus3": "1"}
    assert stats["gA"]["EXC"] == "1" and stats["gA"]["INF"] == "1" and stats["gA"]["LNF"] == "1" and stats["gB"]["total_cds"] == "3"
    assert cli.main(["ExtractCgMLST", "-i", f"{out}/results_alleles", "-o", f"{tmp_path}/core"]) == 0
    assert [r[0] for r in spark.read.text(f"{tmp_path}/core/cgMLSTschema100").collect()] == ["locus1"]
    (tmp_path / "genes.txt").write_text("locus2.fasta\n")
    assert cli.main(["RemoveGenes", "-i", f"{out}/results_alleles", "-o", f"{tmp_path}/less", "--gl", f"{tmp_path}/genes.txt"]) == 0
    assert fasta.read_table(spark, f"{tmp_path}/less").columns == ["FILE", "locus1", "locus3"]
    assert cli.main(["JoinProfiles", "-i", f"{out}/results_alleles", f"{tmp_path}/less", "-o", f"{tmp_path}/both", "--common"]) == 0
    assert fasta.read_table(spark, f"{tmp_path}/both").count() == 4
    assert cli.main(["PrepExternalSchema", "-i", f"{tmp_path}/schema", "-o", f"{tmp_path}/ext"]) == 0
    assert cli.main(["SchemaEvaluator", "-i", f"{tmp_path}/schema", "-o", f"{tmp_path}/eval"]) == 0
    assert cli.main(["AlleleCallEvaluator", "-i", f"{out}/results_alleles", "-g", f"{tmp_path}/schema", "-o", f"{tmp_path}/calls"]) == 0
    assert spark.read.text(f"{tmp_path}/calls/tree").first()[0] == "(gA:0,gB:0);"


def test_command_line_on_genomes(spark, tmp_path):
    """Genes are predicted, calls have their places on the contigs, and a gene cut off near a contig's end is told."""
    wall, r = "TTAATTAATTAACTAGCTAGCTAG", random.Random(8)
    noise = lambda n: wall + "".join(r.choice("ACGT") for _ in range(n)) + wall
    ps = proteins(10, 21, 120)
    (tmp_path / "schema").mkdir()
    for i, p in enumerate(ps[:3], 1):
        write(tmp_path / "schema" / f"locus{i}.fasta", [(f"locus{i}_1", gene(p))])
    text, places = noise(100), {}
    for i, p in enumerate(ps[:2] + ps[3:], 1):
        dna = gene(near(p, 3) if i == 2 else p)
        places[i] = (len(text), len(text) + len(dna))
        text += (dna if i % 2 else dna.translate(str.maketrans("ACGT", "TGCA"))[::-1]) + noise(120)
    # The third locus lacks its first 40 residues: it starts anew at a methionine, right at the contig's start.
    cut = "AA" + gene("M" + ps[2][41:]) + noise(200)
    write(tmp_path / "gA.fasta", [("c1 5'->3'", text), ("c2", cut)])
    out = str(tmp_path / "res")
    assert cli.main(["AlleleCall", "-i", f"{tmp_path}/gA.fasta", "-g", f"{tmp_path}/schema", "-o", out]) == 0
    cells = fasta.read_table(spark, f"{out}/results_alleles").first().asDict()
    info = fasta.read_table(spark, f"{out}/results_contigsInfo").first().asDict()
    assert cells["locus1"] == "1" and cells["locus2"] == "INF-2" and cells["locus3"] in ("PLOT5", "PLOT3", "LOTSC"), cells
    assert info["locus1"] == f"c1&{places[1][0]}-{places[1][1]}&1" and info["locus2"] == f"c1&{places[2][0]}-{places[2][1]}&-1" and info["locus3"] == cells["locus3"]
    stats = fasta.read_table(spark, f"{out}/results_statistics").first().asDict()
    assert stats["EXC"] == stats["INF"] == "1" and int(stats["total_cds"]) >= 10


def test_help(capsys):
    assert cli.main([]) == 0 and cli.main(["--version"]) == 0 and cli.main(["Nonsense"]) == 1
    shown = capsys.readouterr().out
    assert all(m in shown for m in cli.MODULES)
