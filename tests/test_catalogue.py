"""Every query of the catalogue gives the rows of its SQL."""

from collections import Counter

import duckdb
import pytest

from locusflow.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(arrow):
    cols = sorted(arrow.column_names)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return cols, Counter(tuple(plain(r[c]) for c in cols) for r in arrow.to_pylist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, duck, name):
    assert rows_of(catalogue.queries()[name](spark, SF).toArrow()) == rows_of(duck.sql(catalogue.oracle_sql()[name]).to_arrow_table())


@pytest.mark.parametrize("name", ["class_fold", "assign_ids", "pama_flags", "inexact_fold", "greedy_cluster"])
def test_partitions_do_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(rows_of(catalogue.queries()[name](spark, SF).toArrow()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


def test_translations_by_hand(spark):
    from locusflow.functions import translate as T

    def bases(key):
        import hashlib

        digest = hashlib.sha256(str(key).encode()).hexdigest().upper()
        return digest.translate(str.maketrans("0123456789ABCDEF", "ACGTACGTACGTACGT"))

    for r in catalogue.queries()["translate_four_orientations"](spark, SF).collect():
        k = r["o_orderkey"]
        dna = "ATG" + bases(k)[:9] + "TAA"
        dna = T.orient(dna, {1: "antisense", 2: "revsense"}.get(k % 4, "sense"))
        protein, _, orientation, error = T.translate_any(dna)
        assert (r["protein"], r["orientation"], r["error"]) == (protein, orientation, error)


def test_alignments_by_hand(spark, duck):
    from tests.test_functions import plain_alignment

    text = {str(i): t.upper() for i, t in duck.sql("SELECT item_id, text FROM benchmark").fetchall()}
    short = [r for r in catalogue.queries()["smith_waterman"](spark, SF).collect() if len(text[r["query"]]) * len(text[r["target"]]) < 30_000]
    assert len(short) > 10 and all(r["score"] == plain_alignment(text[r["query"]], text[r["target"]]) for r in short[:15])


def test_inexact_fold_by_hand(spark, duck):
    rows = duck.sql("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_discount + 0.6, CAST(l_quantity AS INT), l_tax > 0.07 FROM lineitem ORDER BY 1, 2, 3, CAST(l_partkey AS VARCHAR)").fetchall()
    want, state = {}, {}
    for at, (locus, genome, line, part, bsr, length, tip) in enumerate(rows):
        s = state.setdefault(locus, {"dna": set(), "prot": set(), "sizes": [20, 25, 25], "cell": []})
        mode = max(s["sizes"], key=lambda v: (s["sizes"].count(v), -s["sizes"].index(v)))
        if part in s["dna"]:
            kind, bsr = "EXC", 1.0
        elif part % 200 in s["prot"]:
            kind, bsr = "INF", 1.0
            s["dna"].add(part)
        elif tip:
            kind = "PLOT3"
        elif length < mode - mode * 0.4:
            kind = "ASM"
        elif length > mode + mode * 0.4:
            kind = "ALM"
        else:
            kind = "INF"
            s["dna"].add(part)
            s["prot"].add(part % 200)
        s["cell"].append((kind, length))
        want[str(locus), genome, line] = (kind, round(bsr, 6))
        if at + 1 == len(rows) or rows[at + 1][:2] != (locus, genome):
            kinds = [k for k, _ in s["cell"]]
            if kinds.count("INF") == 1 and set(kinds) <= {"INF", "ASM", "ALM"}:
                s["sizes"].append(next(n for k, n in s["cell"] if k == "INF"))
            s["cell"] = []
    got = {(r["locus"], r["genome_ord"], r["ord"]): (r["class"], round(r["bsr"], 6)) for r in catalogue.queries()["inexact_fold"](spark, SF).collect()}
    assert got == want


def test_item_pairs_have_no_rank_cut(spark, tmp_path):
    """Eight near copies all meet each other, short items meet themselves, and a component is eliminated as a whole."""
    copies = [(i, "the quick brown fox jumps over the lazy dog near the old river bank" + " and on" * (i % 3)) for i in range(8)]
    apart = [(20, "zwölf boxkämpfer jagen viktor quer über den großen sylter deich"), (21, "abc"), (22, ""), (23, None)]
    spark.createDataFrame(copies + apart, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["query"], r["target"]): r["score"] for r in catalogue.queries()["smith_waterman"](spark, str(tmp_path)).collect()}
    assert set(got) == {(str(a), str(b)) for a in range(8) for b in range(8)} | {("20", "20"), ("21", "21")}
    length, out = {str(i): len(t) for i, t in copies}, set()
    for (q, t), score in sorted(got.items()):
        if q != t and not {q, t} & out and score / got[q, q] >= 0.6:
            out.add(q if length[t] > length[q] else t)
    assert len(out) == 7
    rows = catalogue.queries()["bsr_eliminate"](spark, str(tmp_path)).collect()
    assert sorted((r["cluster"], r["seqid"]) for r in rows) == sorted(("0", x) for x in out)


def test_whole_runs_by_hand(spark, duck):
    """Every nation's gene is called in every genome, and makes one locus of a catalogue built from the genomes."""
    from locusflow.plans import derived as D

    rows = duck.sql(f"WITH {D.GENES}, s AS (SELECT *, row_number() OVER () AS r FROM supplier), g AS (SELECT *, row_number() OVER () AS r FROM genes) SELECT s_suppkey, locus, dna FROM s JOIN g USING (r)").fetchall()
    first, per = {}, {}
    for k, locus, dna in sorted(rows):
        first.setdefault(locus, dna)
        per.setdefault((f"g{k // 5}", locus), []).append(dna)
    got = {(r["FILE"], r["locus"]): r["cell"] for r in catalogue.queries()["all_calls"](spark, SF).collect()}
    assert set(got) == {(f"g{k // 5}", locus) for k, _, _ in rows for locus in first}
    for cell, name in got.items():
        mine = per.get(cell, [])
        if not mine:
            assert name == "LNF"
        elif len(mine) > 1:
            assert name == ("NIPHEM" if set(mine) == {first[cell[1]]} else name) and name in ("NIPH", "NIPHEM")
        else:
            assert name == "1" if mine[0] == first[cell[1]] else name.removeprefix("INF-").isdigit()
    made = [r["locus"] for r in catalogue.queries()["created_catalogue"](spark, SF).collect()]
    nation = {f"g{k // 5}-protein{k}": locus for k, locus, _ in rows}
    assert sorted(nation[m] for m in made) == sorted(first)
