import random
from itertools import combinations_with_replacement

import pytest

from locusflow.config import Config, reconcile
from locusflow.operators import annotate, classify, cluster, dedup, evaluate, matching, profiles, store
from locusflow.sources import fasta, sinks


def fold(classes):
    """The class of a multiset, branch by branch."""
    kinds = set(classes)
    if len(classes) == 1:
        return classes[0]
    if len(kinds) == 1:
        return "NIPHEM" if kinds == {"EXC"} else "NIPH"
    if {"EXC", "INF"} <= kinds or kinds & {"PLOT3", "PLOT5", "LOTSC"}:
        return "NIPH"
    for k in ("EXC", "INF"):
        if k in kinds:
            return k if classes.count(k) == 1 else "NIPH"
    return "NIPH"


def test_class_fold(spark):
    kinds = ("EXC", "INF", "PLOT3", "PLOT5", "LOTSC", "ASM", "ALM")
    sets = [c for n in (1, 2, 3, 4) for c in combinations_with_replacement(kinds, n)]
    rows = [("l", i, c) for i, s in enumerate(sets) for c in s]
    got = {r["genome_ord"]: r["class"] for r in classify.fold_classes(spark.createDataFrame(rows, "locus string, genome_ord int, class string")).collect()}
    assert got == {i: fold(list(s)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(
    "rep_len,left,right,contig,c_left,c_right,strand,want",
    [
        (300, 0, 300, 200, 0, 200, "1", "LOTSC"), (300, 50, 300, 1000, 20, 900, "1", "PLOT5"), (300, 0, 250, 1000, 100, 970, "1", "PLOT3"), (300, 10, 290, 1000, 100, 900, "1", None),
        (300, 50, 300, 1000, 500, 980, "-1", "PLOT5"), (300, 0, 250, 1000, 20, 500, "-1", "PLOT3"), (300, 10, 290, 1000, 100, 900, "-1", None),
    ],
)
def test_tips(spark, rep_len, left, right, contig, c_left, c_right, strand, want):
    from pyspark.sql import functions as F

    row = spark.range(1).select(classify.tip_class(*map(F.lit, (rep_len, left, right, contig, c_left, c_right, strand))).alias("c")).first()
    assert row["c"] == want


def test_sizes_and_modes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(n,) for n in (80, 79, 120, 121, 100)], "n int")
    assert [r[0] for r in df.select(classify.size_class(F.col("n"), F.lit(100), 0.2)).collect()] == [None, "ASM", None, "ALM", None]
    values = [("a", [1, 2, 2, 1, 3]), ("b", [2, 1, 1, 2])]
    rows = [(k, i, v) for k, vs in values for i, v in enumerate(vs)]
    lengths = spark.createDataFrame(rows, "locus string, allele_ord int, length int")
    assert {r[0]: r[1] for r in classify.modes(lengths).collect()} == {"a": 1, "b": 2}
    assert {r[0]: r[1] for r in classify.all_modes(lengths).collect()} == {"a": [1, 2], "b": [1, 2]}


def test_dedup_and_exact(spark):
    cds = spark.createDataFrame([("g2", 2, 1, "acgt"), ("g1", 1, 1, "ACGT"), ("g1", 1, 2, "ACGT"), ("g1", 1, 3, "TTTT")], "genome string, genome_ord int, protid int, dna string")
    distinct = dedup.distinct_dna(cds)
    got = {r["dna"]: (r["rep"]["genome"], r["n"]) for r in distinct.collect()}
    assert got == {"ACGT": ("g1", 3), "TTTT": ("g1", 1)}
    occurring = dedup.occurrences(cds)
    assert sorted((r["genome_ord"], r["ord"]) for r in occurring.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    alleles = matching.hash_alleles(spark.createDataFrame([("L2", 2, 1, "1", "ACGT"), ("L1", 1, 5, "7", "ACGT"), ("L1", 1, 6, "8", "ACGT")], "locus string, locus_idx int, allele_ord int, allele_id string, dna string"))
    exact = matching.dna_exact(occurring, alleles)
    assert sorted((r["locus"], r["allele_id"], r["genome_ord"]) for r in exact.collect()) == [("L1", "7", 1), ("L1", "7", 1), ("L1", "7", 2)]
    only = spark.createDataFrame([("L2",)], "locus string")
    assert matching.dna_exact(occurring, alleles, only).count() == 0


def test_paralogous(spark):
    cells = spark.createDataFrame([("A", 1, "EXC", "h"), ("B", 1, "INF", "h"), ("A", 2, "EXC", "h"), ("B", 2, "NIPH", "h"), ("A", 3, "EXC", "k")], "locus string, genome_ord int, class string, dna_hash string")
    got = {(r["locus"], r["genome_ord"]): r["class"] for r in classify.mark_paralogous(cells).collect()}
    assert got == {("A", 1): "PAMA", ("B", 1): "PAMA", ("A", 2): "PAMA", ("B", 2): "NIPH", ("A", 3): "EXC"}


def test_ids(spark):
    cells = spark.createDataFrame([("L", 1, "EXC", "new"), ("L", 2, "INF", "new"), ("L", 3, "EXC", "old"), ("L", 4, "EXC", "late"), ("L", 5, "EXC", "late")], "locus string, genome_ord int, class string, dna_hash string")
    alleles = spark.createDataFrame([("L", "old", "4", 1)], "locus string, dna_hash string, allele_id string, allele_ord int")
    got = {r["genome_ord"]: (r["class"], r["cell"]) for r in classify.assign_ids(cells, alleles).collect()}
    assert got == {1: ("EXC", "5"), 2: ("INF", "INF-5"), 3: ("EXC", "4"), 4: ("INF", "INF-6"), 5: ("EXC", "6")}


def test_inexact(spark):
    m = [("L", 1, 0, "1", "a", "p", 0.65, 100, None), ("L", 2, 0, "1", "a", "p", 0.65, 100, None), ("L", 3, 0, "1", "b", "p", 0.65, 100, None), ("L", 4, 0, "1", "c", "q", 0.9, 70, None), ("L", 5, 0, "1", "d", "r", 0.9, 100, "PLOT5"), ("L", 6, 0, "1", "e", "s", 0.9, 130, None)]
    matches = spark.createDataFrame(m, "locus string, genome_ord int, ord int, allele_id string, dna_hash string, prot_hash string, bsr double, dna_length int, tip_class string")
    lengths = spark.createDataFrame([("L", [100, 100, 90])], "locus string, lengths array<int>")
    got = {r["genome_ord"]: (r["class"], r["candidate"]) for r in classify.classify_inexact(matches, lengths, 0.2, 0.6).collect()}
    assert got == {1: ("INF", True), 2: ("EXC", False), 3: ("INF", False), 4: ("ASM", False), 5: ("PLOT5", False), 6: ("ALM", False)}


def test_elimination(spark):
    hits = spark.createDataFrame([("c", "a", "a", 100.0), ("c", "b", "b", 90.0), ("c", "a", "b", 70.0), ("c", "b", "a", 70.0), ("c", "d", "a", 5.0)], "cluster string, query string, target string, score double")
    lengths = spark.createDataFrame([("a", 50), ("b", 60), ("d", 10)], "seqid string, length int")
    assert sorted(r["seqid"] for r in cluster.eliminate_by_bsr(hits, lengths).collect()) == ["a", "d"]


def test_clusters(spark):
    base = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVKALPDAQFEVVHSLAKWKRQTLGQHDFSAGEGLYTHMKALRPDEDRLSPLHSVYVDQWDWE"
    other = "GSHMSDKIIHLTDDSFDTDVLKADGAILVDFWAEWCGPCKMIAPILDEIADEYQGKLTVAKLNIDQNPGTAPKYGIRGIPTLLLFKNGEVAATKVGALSKGQLKEFLDANLA"
    seqs = spark.createDataFrame([("a", base), ("b", base[:-5]), ("c", other), ("d", other[3:])], "seqid string, seq string")
    for groups in (1, 4):
        got = {r["member"]: r["representative"] for r in cluster.greedy_clusters(seqs, groups=groups).collect()}
        assert got == {"a": "a", "b": "a", "c": "c", "d": "c"}
    clusters = cluster.greedy_clusters(seqs, groups=1)
    assert {r["member"] for r in cluster.prune_near_representative(clusters).collect()} == {"a", "c"}
    assert cluster.prune_within(clusters, seqs).count() == 0
    reps = cluster.represent(seqs.selectExpr("'L' as locus", "seqid", "seq"))
    assert {r["seqid"] for r in reps.collect()} == {"a", "c"}


def test_distances(spark):
    p = spark.createDataFrame([("s1", "a", "1"), ("s1", "b", "INF-2"), ("s2", "a", "1"), ("s2", "b", "3"), ("s3", "a", "LNF"), ("s3", "b", "2")], "FILE string, locus string, cell string")
    want = {("s1", "s1"): 0, ("s1", "s2"): 1, ("s1", "s3"): 0, ("s2", "s2"): 0, ("s2", "s3"): 1, ("s3", "s3"): 0}
    for df in (profiles.distances(p), profiles.blocked_distances(p, 2)):
        assert {(r["a"], r["b"]): r["distance"] for r in df.collect()} == want
    assert profiles.distances(p, symmetric=True).count() == 9


def test_distances_by_blocks(spark):
    """Odd cells and many loci, as loops count them; no pair and no sample's copy goes through a shuffle."""
    r = random.Random(4)
    kinds = ["LNF", "NIPH", "0", "*0", "1", "01", "INF-1", "INF-*2", "2", "123456789012", "123456789013", None]
    cells = {(f"s{a}", b): r.choice(kinds) for a in range(13) for b in range(300) if a != 5 and r.random() < 0.9} | {("s5", 0): "LNF"}
    rows = [(a, b, c) for (a, b), c in cells.items()] + [(None, 1, "1"), ("s1", None, "1"), ("s2", None, "2")]
    plain = {k: c.replace("INF-", "").replace("*", "") for k, c in cells.items() if c and c[0] not in "LN" and c not in ("0", "*0")}
    p = spark.createDataFrame(rows, "FILE string, locus long, cell string")
    want = {(f"s{a}", f"s{b}"): sum(plain[f"s{a}", k] != plain[f"s{b}", k] for k in range(300) if (f"s{a}", k) in plain and (f"s{b}", k) in plain) for a in range(13) for b in range(13)}
    for block in (4, 512):
        got = profiles.blocked_distances(p, block, symmetric=True).collect()
        assert {(x["a"], x["b"]): x["distance"] for x in got} == want and len(got) == 169
    upper = profiles.distances(p)
    assert {(x["a"], x["b"]): x["distance"] for x in upper.collect()} == {k: v for k, v in want.items() if k[0] <= k[1]}
    assert profiles.distances(p.where("FILE is null")).count() == 0
    plan = upper._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan


def test_joins(spark):
    a = spark.createDataFrame([("x", "1", "2")], "FILE string, l1 string, l2 string")
    b = spark.createDataFrame([("3", "y", "4")], "l2 string, FILE string, l1 string")
    assert [tuple(r) for r in profiles.join_wide([a, b]).collect()] == [("x", "1", "2"), ("y", "4", "3")]
    c = b.withColumnRenamed("l1", "l9")
    with pytest.raises(ValueError):
        profiles.join_wide([a, c])
    assert profiles.join_wide([a, c], common=True).columns == ["FILE", "l2"]
    with pytest.raises(ValueError):
        profiles.join_wide([a, c.drop("l2")], common=True)
    assert profiles.select_wide(a, ["l1", "nope"]).columns == ["FILE", "l2"] and profiles.select_wide(a, ["l1"], True).columns == ["FILE", "l1"]


def test_sync(spark):
    schema = "locus string, allele_id string, is_local boolean, dna string"
    local = spark.createDataFrame([("L", "1", False, "AA"), ("L", "2", True, "CC"), ("L", "3", True, "GG"), ("L", "4", True, "TT")], schema)
    remote = spark.createDataFrame([("L", "1", False, "AA"), ("L", "2", False, "GG"), ("L", "3", False, "AC")], schema)
    got = {r["dna"]: (r["allele_id"], r["is_local"], r["status"]) for r in store.synchronise(local, remote).collect()}
    assert got == {"AA": ("1", False, "same"), "GG": ("2", False, "switched"), "AC": ("3", False, "added"), "CC": ("4", True, "renumbered"), "TT": ("5", True, "renumbered")}


def test_store(spark, tmp_path):
    p = spark.createDataFrame([("a", "l1", "INF-3"), ("a", "l2", "LNF"), ("b", "l1", "3")], "FILE string, locus string, cell string")
    stored = store.profile_json(p)
    assert {r["profile"] for r in stored.collect()} == {'{"l1":"3"}'} and store.insert_new(stored.where("false"), stored).count() == 1
    changed = store.replace_identifiers(stored, spark.createDataFrame([("l1", "3", "8")], "locus string, old string, new string"))
    assert {r["profile"] for r in changed.collect()} == {'{"l1":"8"}'}
    store.write_config(spark, f"{tmp_path}/c", {"bsr": [0.6, 0.7]})
    assert store.read_config(spark, f"{tmp_path}/c") == {"bsr": ["0.6", "0.7"]}


def test_config():
    for bad in ({"bsr": 1.2}, {"minimum_length": -1}, {"size_threshold": -0.1}, {"size_threshold": 1.1}, {"translation_table": 7}, {"word_size": 4}, {"intra_filter": 0.5}):
        with pytest.raises(ValueError):
            Config(**bad)
    assert reconcile({"bsr": [0.6]}, {"bsr": 0.6})[0]["bsr"] == 0.6
    with pytest.raises(ValueError):
        reconcile({"bsr": [0.6]}, {"bsr": 0.7})
    assert reconcile({"bsr": [0.6]}, {"bsr": 0.7}, force=True)[1] == {"bsr": [0.6, 0.7]}


def test_annotations(spark):
    names = spark.createDataFrame([("h", "hypothetical protein", 1), ("h", "Ligase", 2), ("k", "duf12", 1)], "prot_hash string, name string, ord int")
    assert {r["prot_hash"]: r["name"] for r in annotate.informative_name(names).collect()} == {"h": "Ligase", "k": "duf12"}


def test_locus_statistics(spark):
    rows = [("L", 1, "1", "ATGGCTTGGAAATAA", "MAWK", None), ("L", 2, "2", "ATGGCTTGGAAGTAA", "MAWK", None), ("L", 3, "5", "ATGNCTTGGAAGTAA", None, "ambiguous or invalid characters")]
    s = evaluate.locus_statistics(spark.createDataFrame(rows, "locus string, allele_ord int, allele_id string, dna string, protein string, error string")).first()
    assert (s["total"], s["valid"], s["invalid"], s["distinct_proteins"], s["ambiguous_bases"], s["missing_ids"], s["proportion_valid"]) == (3, 2, 1, 1, 1, [3, 4], 0.667)


def test_fasta(spark, tmp_path):
    (tmp_path / "g.one.fasta").write_text(">a first x\nACG\nTTA\n>b\r\nac\r\n>a\nGGG\n")
    (tmp_path / "empty.fasta").write_text("")
    (tmp_path / "text.fasta").write_text("no header\n")
    seqs = fasta.read_fasta(spark, str(tmp_path / "g.one.fasta"), upper=True)
    assert [(r["seqid"], r["seq"]) for r in seqs.orderBy("rec_ord").collect()] == [("a", "ACGTTA"), ("b", "AC"), ("a", "GGG")]
    assert {r["seqid"]: r["seq"] for r in fasta.last_record(seqs).collect()} == {"a": "GGG", "b": "AC"}
    assert [r["seqid"] for r in fasta.rename_cds(seqs).orderBy("protid").collect()] == ["g-protein1", "g-protein2", "g-protein3"]
    inputs = fasta.list_inputs(spark, str(tmp_path))
    valid = fasta.validity(inputs, fasta.read_fasta(spark, str(tmp_path))).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["is_fasta"] for r in valid} == {"g.one.fasta": True, "text.fasta": False}
    assert inputs.count() == 2 and fasta.statistics(seqs).first()["max_length"] == 6
    sinks.write_fasta(seqs.select("seqid", "seq"), f"{tmp_path}/out")
    assert fasta.read_fasta(spark, f"{tmp_path}/out").count() == 3
    problems = fasta.name_problems(spark.createDataFrame([("a b",), ("x" * 31,), ("d",), ("d",), ("1abc",), ("8CAF_B",), ("abcd",), ("1abcd",)], "genome string"))
    assert {(r[0][:3], r[1]) for r in problems.collect()} == {("a b", "blank"), ("xxx", "long"), ("d", "duplicate"), ("1ab", "pdb"), ("8CA", "pdb")}


def test_fasta_records_start_at_lines(spark, tmp_path):
    """A mark inside a header is part of it; CRLF, blank lines, empty records, wrapped lines and files in small splits."""
    r = __import__("random").Random(3)
    text = "\n>sp|P1|X 5'->3' exonuclease\r\nACGT\r\nTT GG\r\n>empty\r\n>next a>b >c\nAC\n\nGT\n>>twice\nA\n>last"
    (tmp_path / "odd.fasta").write_bytes(text.encode())
    got = [(x["seqid"], x["header"], x["seq"]) for x in fasta.read_fasta(spark, f"{tmp_path}/odd.fasta").orderBy("rec_ord").collect()]
    assert got[:3] == [("sp|P1|X", "sp|P1|X 5'->3' exonuclease", "ACGTTTGG"), ("empty", "empty", ""), ("next", "next a>b >c", "ACGT")]
    assert [x[2] for x in got[3:]] == ["A", ""] and got[4][0] == "last"
    want = [(f"r{i}", "".join(r.choice("ACGT>") if j % 70 else r.choice("ACGT") for j in range(r.randrange(400)))) for i in range(2000)]
    wrapped = "".join(f">{i} 5'->3'\n" + "".join(s[k : k + 70] + "\n" for k in range(0, len(s), 70)) for i, s in want)
    (tmp_path / "many.fasta").write_text(wrapped)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = fasta.read_fasta(spark, f"{tmp_path}/many.fasta").orderBy("rec_ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(x["seqid"], x["seq"]) for x in rows] == want


def rows_read(df):
    """Rows that the scans of files gave in the plan of ``df``, which has run."""
    left, n = [df._jdf.queryExecution().executedPlan()], 0
    while left:
        node = left.pop()
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            n += node.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            left.append(node.plan())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return n


def test_index_reads_few_pages(spark, tmp_path):
    """Ten of 60,000 records are fetched by reading under one in a hundred of the rows."""
    seqs = spark.range(60_000).selectExpr("'f' as source", "id as rec_ord", "concat('s', lpad(id * 7919 % 60000, 6, '0')) as seqid", "concat('h', id) as header", "repeat('ACGT', 40) as seq")
    fasta.write_index(seqs, f"{tmp_path}/index")
    ids = spark.createDataFrame([(f"s{i * 6000 + 3:06d}", i) for i in range(10)] + [("none", 90), (None, 91), ("s000003", 92)], "seqid string, ord int")
    df = fasta.fetch_indexed(spark, f"{tmp_path}/index", ids)
    assert [r["seqid"] for r in df.collect()] == [f"s{i * 6000 + 3:06d}" for i in range(10)] + ["s000003"]
    assert rows_read(df) < 600
    many = spark.range(1000).selectExpr("concat('s', lpad(id, 6, '0')) as seqid", "id as ord")
    assert fasta.fetch_indexed(spark, f"{tmp_path}/index", many).count() == 1000
    assert fasta.fetch_indexed(spark, f"{tmp_path}/index", many.where("ord < 0")).count() == 0


def test_matrix_of_any_width(spark, tmp_path):
    """A matrix of 700 by 3,000 and its transpose, in order, with cells that are absent; beyond the columns a plan takes."""
    cells = spark.range(700 * 3000).where("id % 11 <> 0").selectExpr("concat('g', id div 3000) as FILE", "id div 3000 as FILE_ord", "concat('l', id % 3000) as locus", "id % 3000 as locus_ord", "cast(id % 97 as string) as cell")
    want = [["FILE", *(f"l{j}" for j in range(3000))]] + [[f"g{i}", *("-" if (i * 3000 + j) % 11 == 0 else str((i * 3000 + j) % 97) for j in range(3000))] for i in range(700)]
    lines = [r["value"].split("\t") for r in sinks.matrix_lines(cells, missing="-").orderBy("place").collect()]
    assert lines == want
    sinks.write_matrix(sinks.transpose(cells), f"{tmp_path}/t", single=True, missing="-")
    back = [r["value"].split("\t") for r in spark.read.text(f"{tmp_path}/t").collect()]
    assert [row[1:] for row in back[1:]] == [list(x) for x in zip(*(row[1:] for row in want[1:]), strict=True)] and [row[0] for row in back[1:]] == want[0][1:]


def test_row_numbers(spark):
    from locusflow.operators.numbering import with_row_number

    rows = [((i * 37) % 101, i) for i in range(101)]
    got = with_row_number(spark.createDataFrame(rows, "k int, v int").repartition(7), "n", "k").collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(i, i + 1) for i in range(101)]
    assert with_row_number(spark.createDataFrame([], "k int"), "n", "k").count() == 0
