from locusflow.operators import phylo


def test_star_alignment():
    seqs = ["ACDEFGHIKL", "ACDGHIKL", "ACDEFGHWIKL", "ACDEFGHIKL", "A"]
    out = phylo.star_alignment(seqs)
    assert len({len(x) for x in out}) == 1 and [x.replace("-", "") for x in out] == seqs and out[0] == out[3]
    assert phylo.star_alignment([]) == []


def test_genes(spark):
    gene = "ATG" + "GCT" * 40 + "TAA"
    back = gene.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    contigs = spark.createDataFrame([("g", 1, "c1", "CCCCC" + gene + "CC"), ("g", 2, "c2", "C" + back), ("h", 1, "c", "CCCC")], "genome string, rec_ord int, seqid string, seq string")
    genes, failed = phylo.predict_genes(contigs, phylo.open_frames(120))
    got = {(r["contig"], r["begin"], r["strand"], r["dna"]) for r in genes.collect()}
    assert {("c1", 5, 1, gene), ("c2", 1, -1, gene)} <= got and [r[0] for r in failed.collect()] == ["h"]


def test_concatenated(spark):
    rows = [("l1", "a", "MKV"), ("l1", "b", "MV"), ("l2", "a", "WW")]
    out = phylo.concatenated(phylo.aligned_loci(spark.createDataFrame(rows, "locus string, FILE string, seq string")))
    assert {r["FILE"]: r["aligned"] for r in out.collect()} == {"a": "MKVWW", "b": "M-V--"}


def test_cluster_text(spark):
    c = spark.createDataFrame([("a", "a", 1.0, 5), ("a", "b", 0.5, 4), ("c", "c", 1.0, 3)], "representative string, member string, similarity double, length int")
    assert phylo.cluster_text(c).first()[0] == ">a\n(a, 1.0, 5)\n(b, 0.5, 4)"
