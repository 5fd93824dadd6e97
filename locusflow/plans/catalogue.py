"""Every query of the typing engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions import sequence as S
from locusflow.functions.translate import codons, translate_native, translated
from locusflow.operators import annotate, classify, cluster, dedup, evaluate, genes, matching, phylo, profiles, search, store, tree
from locusflow.plans import calling
from locusflow.plans import derived as D
from locusflow.runtime import Stage, bounded
from locusflow.sources import fasta, sinks
from locusflow.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_LI, _EV, _PRESENT, _MASK = D.PROF_LI, D.PROF_EV, D.PRESENT, D.MASK
_PA = f"pa AS (SELECT FILE, locus, {_PRESENT} AS present FROM p)"
_RANK = "rk AS (SELECT FILE, row_number() OVER (ORDER BY sum(present) DESC, FILE) AS rank FROM pa GROUP BY FILE)"


# Profiles.
@query(f"WITH {_LI}, {_PA} SELECT locus, CAST(sum(present) AS DOUBLE) / (SELECT count(DISTINCT FILE) FROM pa) AS fraction FROM pa GROUP BY locus HAVING CAST(sum(present) AS DOUBLE) / (SELECT count(DISTINCT FILE) FROM pa) >= 0.95")
def q_entry_core_loci(spark, d):
    return profiles.core_loci(profiles.presence(D.lineitem_profiles(spark, d)), 0.95)


@query(f"WITH {_EV} SELECT FILE, locus, {_MASK} AS cell FROM p")
def mask_profiles(spark, d):
    return profiles.masked(D.event_profiles(spark, d))


@query(f"WITH {_EV}, {_PA} SELECT FILE, " + ", ".join(f"coalesce(max(CASE WHEN locus = '{e}' THEN present END), 0) AS {e}" for e in ("click", "view", "purchase", "signup", "error")) + " FROM pa GROUP BY FILE")
def presence_absence(spark, d):
    return sinks.to_wide(profiles.presence(D.event_profiles(spark, d)), ["click", "view", "purchase", "signup", "error"], "present", 0)


@query(f"WITH {_LI}, {_PA}, n AS (SELECT count(DISTINCT locus) AS n FROM pa) SELECT FILE, CAST(n - sum(present) AS BIGINT) AS missing, 1 - CAST(sum(present) AS DOUBLE) / n AS percentage FROM pa, n GROUP BY FILE, n")
def missing_per_sample(spark, d):
    return profiles.missing_data(profiles.presence(D.lineitem_profiles(spark, d)))


@query(f"WITH {_LI}, {_PA}, {_RANK} SELECT locus, rank, CAST(sum(present) OVER (PARTITION BY locus ORDER BY rank ROWS UNBOUNDED PRECEDING) AS DOUBLE) / rank AS fraction FROM pa JOIN rk USING (FILE)")
def running_fraction(spark, d):
    return profiles.running_fraction(profiles.presence(D.lineitem_profiles(spark, d)))


@query(
    f"WITH {_LI}, every AS (SELECT f.FILE, l.locus, coalesce(p.cell, 'LNF') AS cell FROM (SELECT DISTINCT FILE FROM p) f CROSS JOIN (SELECT DISTINCT locus FROM p) l LEFT JOIN p ON p.FILE = f.FILE AND p.locus = l.locus), "
    f"pa AS (SELECT FILE, locus, {_PRESENT} AS present FROM every), {_RANK}, "
    "fr AS (SELECT rank, CAST(sum(present) OVER (PARTITION BY locus ORDER BY rank ROWS UNBOUNDED PRECEDING) AS DOUBLE) / rank AS f FROM pa JOIN rk USING (FILE)) "
    "SELECT t AS threshold, rank, count(*) FILTER (f >= t) AS core FROM fr CROSS JOIN (SELECT unnest([0.95, 0.99, 1.0])::DOUBLE AS t) WHERE (rank - 1) % 5 = 0 OR rank = (SELECT max(rank) FROM rk) GROUP BY t, rank"
)
def core_size_by_threshold(spark, d):
    present = profiles.presence(profiles.complete(D.lineitem_profiles(spark, d)))
    return profiles.core_curves(present, (0.95, 0.99, 1.0), 5)


_DIST = f"c AS (SELECT FILE, locus, {_MASK} AS cell FROM p WHERE {_PRESENT} = 1), s AS (SELECT DISTINCT FILE FROM p), dd AS (SELECT x.FILE AS a, y.FILE AS b, sum(CASE WHEN x.cell <> y.cell THEN 1 ELSE 0 END) AS n FROM c x JOIN c y ON x.locus = y.locus AND x.FILE <= y.FILE GROUP BY 1, 2), dist AS (SELECT i.FILE AS a, j.FILE AS b, CAST(coalesce(dd.n, 0) AS BIGINT) AS distance FROM s i JOIN s j ON i.FILE <= j.FILE LEFT JOIN dd ON dd.a = i.FILE AND dd.b = j.FILE)"


@query(f"WITH {_LI}, {_DIST} SELECT * FROM dist")
def pairwise_distance(spark, d):
    return profiles.blocked_distances(D.lineitem_profiles(spark, d))


@query(f"WITH {_LI}, {_DIST} SELECT * FROM dist UNION ALL SELECT b AS a, a AS b, distance FROM dist WHERE a <> b")
def symmetric_distance(spark, d):
    return profiles.blocked_distances(D.lineitem_profiles(spark, d), symmetric=True)


@query(f"WITH {_EV}, {_DIST} SELECT * FROM dist")
def joined_distance(spark, d):
    return profiles.distances(D.event_profiles(spark, d))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS FILE, CAST(o_custkey AS VARCHAR) AS locus1, o_orderstatus AS locus2 FROM orders UNION ALL SELECT CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR), c_mktsegment FROM customer")
def join_profiles_common(spark, d):
    one = D.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("FILE"), F.col("o_custkey").cast("string").alias("locus1"), F.col("o_orderstatus").alias("locus2"), F.col("o_orderpriority").alias("locus3"))
    two = D.table(spark, d, "customer").select(F.col("c_mktsegment").alias("locus2"), F.col("c_name").alias("locus9"), F.col("c_custkey").cast("string").alias("FILE"), F.col("c_nationkey").cast("string").alias("locus1"))
    return profiles.join_wide([one, two], common=True)


@query(f"WITH {_LI} SELECT * FROM p WHERE locus NOT IN (SELECT n_nationkey FROM nation)")
def remove_loci(spark, d):
    return profiles.select_loci(D.lineitem_profiles(spark, d), D.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("locus")))


@query(f"WITH {_LI} SELECT * FROM p WHERE locus IN (SELECT n_nationkey FROM nation)")
def keep_loci(spark, d):
    return profiles.select_loci(D.lineitem_profiles(spark, d), D.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("locus")), inverse=True)


@query(f"WITH {_LI} SELECT * FROM p WHERE FILE NOT IN (SELECT n_nationkey FROM nation)")
def remove_genomes(spark, d):
    return profiles.drop_samples(D.lineitem_profiles(spark, d), D.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("FILE")))


@query(
    f"WITH {_EV}, a AS (SELECT event_type AS locus, CAST(e AS VARCHAR) AS plain, sha256(event_type || '-' || e) AS digest FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT unnest(range(1, 40)) AS e)), "
    "q AS (SELECT FILE, locus, CASE WHEN regexp_full_match(replace(cell, 'INF-', ''), '\\d+') THEN replace(cell, 'INF-', '') ELSE '-' END AS plain FROM p) SELECT FILE, q.locus, coalesce(digest, q.plain) AS cell FROM q LEFT JOIN a ON a.locus = q.locus AND a.plain = q.plain"
)
def hashed_profiles(spark, d):
    loci = D.table(spark, d, "events").select(F.col("event_type").alias("locus")).distinct()
    alleles = loci.select("locus", F.explode(F.sequence(F.lit(1), F.lit(39))).alias("e"))
    alleles = alleles.select("locus", F.col("e").cast("string").alias("allele_id"), F.concat_ws("-", "locus", "e").alias("dna"))
    return profiles.hashed(D.event_profiles(spark, d), alleles)


_CLASS = r"CASE WHEN cell LIKE 'INF-%' THEN 'INF' WHEN regexp_full_match(cell, '\*?\d+') THEN 'EXC' ELSE cell END"
_COUNTS = ", ".join(f"count(*) FILTER ({_CLASS} = '{c}') AS {c}" for c in classify.CLASSES)


@query(f"WITH {_LI} SELECT FILE, {_COUNTS} FROM p GROUP BY FILE")
def class_counts_by_sample(spark, d):
    return profiles.sample_classes(D.lineitem_profiles(spark, d), classify.CLASSES)


@query(f"WITH {_LI} SELECT locus, {_COUNTS} FROM p GROUP BY locus")
def class_counts_by_locus(spark, d):
    return profiles.locus_classes(D.lineitem_profiles(spark, d), classify.CLASSES)


# Deduplication and exact matching.
@query("SELECT sha256(upper(replace(text, 'ß', 'SS'))) AS dna_hash, min(doc_id) AS rep, count(*) AS n FROM documents GROUP BY 1")
def dedup_sequences(spark, d):
    cds = D.table(spark, d, "documents").select(F.col("source").alias("genome"), F.col("doc_id").alias("genome_ord"), F.lit(1).alias("protid"), F.col("text").alias("dna"))
    return dedup.distinct_dna(cds).select("dna_hash", F.col("rep.genome_ord").alias("rep"), "n")


@query("SELECT h.doc_id, s.sources FROM (SELECT doc_id, sha256(upper(text)) AS k FROM documents) h JOIN (SELECT sha256(upper(text)) AS k, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM documents GROUP BY 1) s USING (k)")
def propagate_to_sources(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("dna"))
    found = docs.select(S.sequence_hash(F.upper("dna")).alias("dna_hash"), "source").distinct()
    sources = found.groupBy("dna_hash").agg(F.array_join(F.array_sort(F.collect_list("source")), "|").alias("sources"))
    return dedup.propagate(sources, docs).select("doc_id", "sources")


@query("SELECT text, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("seqid"), "text")
    g = dedup.duplicate_groups(docs, "seqid", "text", "doc_id")
    return g.where(F.size("ids") > 1).select("text", F.array_join("ids", ",").alias("ids"))


@query("SELECT d.doc_id, c.locus, c.allele_id FROM documents d JOIN (SELECT sha256(upper(text)) AS k, min_by(lang, doc_id) AS locus, CAST(min(doc_id) AS VARCHAR) AS allele_id FROM documents WHERE source <> 'src0' GROUP BY 1) c ON c.k = sha256(upper(d.text))")
def exact_match_first(spark, d):
    docs = D.table(spark, d, "documents")
    alleles = docs.where("source <> 'src0'").select(F.col("lang").alias("locus"), F.col("doc_id").alias("locus_idx"), F.lit(1).alias("allele_ord"), F.col("doc_id").cast("string").alias("allele_id"), F.col("text").alias("dna"))
    cds = docs.select(F.col("source").alias("genome"), F.col("doc_id").alias("genome_ord"), F.lit(1).alias("protid"), F.col("text").alias("dna"))
    return matching.dna_exact(dedup.occurrences(cds), matching.hash_alleles(alleles)).select(F.col("genome_ord").alias("doc_id"), "locus", "allele_id")


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY sha256(upper(text)) ORDER BY doc_id) = 1 THEN 'INF' ELSE 'EXC' END AS class FROM documents")
def inf_exc_first_occurrence(spark, d):
    docs = D.table(spark, d, "documents")
    cds = docs.select(F.col("source").alias("genome"), F.col("doc_id").alias("genome_ord"), F.lit(1).alias("protid"), F.col("text").alias("dna"))
    distinct = dedup.distinct_dna(cds).withColumn("prot_hash", F.col("dna_hash"))
    alleles = distinct.select(F.lit("one").alias("locus"), F.lit(1).alias("locus_idx"), F.lit(1).alias("allele_ord"), F.lit("1").alias("allele_id"), "prot_hash")
    return matching.protein_exact(distinct, dedup.occurrences(cds), alleles).select(F.col("genome_ord").alias("doc_id"), "class")


# k-mers and sequences.
@query("SELECT substr(text, i, 8) AS kmer, count(*) AS n FROM benchmark, LATERAL (SELECT unnest(range(1, length(text) - 6)) AS i) GROUP BY 1")
def kmer_index(spark, d):
    return D.table(spark, d, "benchmark").select(F.explode(S.kmers("text", 8)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


_MINI = "SELECT {id} AS id, min(substr({t}, i, 5)) OVER (PARTITION BY {id} ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS m, i, length({t}) AS n FROM {src}, LATERAL (SELECT unnest(range(1, length({t}) - 3)) AS i)"


@query("WITH w AS (" + _MINI.format(id="item_id", t="text", src="benchmark") + ") SELECT DISTINCT id, m FROM w WHERE i <= n - 8")
def minimizer_set(spark, d):
    return D.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.explode(S.minimizers("text")).alias("m"))


@query(
    f"WITH {D.PROTEINS}, q AS (SELECT DISTINCT id, m FROM (" + _MINI.format(id="id", t="seq", src="parts") + ") WHERE i <= n - 8), r AS (SELECT DISTINCT id, m FROM (" + _MINI.format(id="id", t="seq", src="heads") + ") WHERE i <= n - 8), "
    "c AS (SELECT id, count(*) AS n FROM q GROUP BY id), s AS (SELECT q.id AS query, r.id AS reference, CAST(count(*) AS DOUBLE) / any_value(c.n) AS similarity FROM q JOIN r USING (m) JOIN c ON c.id = q.id GROUP BY 1, 2) "
    "SELECT query, reference, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, reference) AS rank FROM s WHERE similarity >= 0.01 QUALIFY rank <= 3"
)
def kmer_similarity_topn(spark, d):
    heads, parts = D.part_proteins(spark, d)
    return matching.shared_minimizers(parts, heads, 0.01, 3)


@query("SELECT p_brand AS query, p_partkey AS target FROM part")
def seeded_search(spark, d):
    """Every part's protein is found by that of its brand, and by no other, at a score ratio of 0.4 or more."""
    heads, parts = D.part_proteins(spark, d)
    scores = matching.self_scores(heads.select(F.col("id").alias("seqid"), F.col("seq").alias("protein")))
    return matching.filter_bsr(search.search(heads, parts), scores, 0.4).select("query", "target")


@query("SELECT p_partkey, reverse(translate(upper(p_name), 'ACGT', 'TGCA')) AS rc FROM part")
def revcomp(spark, d):
    return D.table(spark, d, "part").select("p_partkey", S.reverse_complement("p_name").alias("rc"))


_B = D.BASES.format("p_name")


@query(f"SELECT p_partkey, substr({_B}, p_size % 20 + 1, 30) AS plus, reverse(translate(substr({_B}, p_size % 20 + 1, 30), 'ACGT', 'TGCA')) AS minus FROM part")
def extract_cds(spark, d):
    seq, start = D.bases(F.col("p_name")), F.col("p_size") % 20
    return D.table(spark, d, "part").select("p_partkey", S.subsequence(seq, start, start + 30, F.lit(1)).alias("plus"), S.subsequence(seq, start, start + 30, F.lit(0)).alias("minus"))


@query("SELECT doc_id, regexp_full_match(upper(text), '[ACGT]*') AS is_dna, length(text) % 3 = 0 AS whole, length(text) < 201 - 201 * 0.2 AS small FROM documents")
def alphabet_length_checks(spark, d):
    return D.table(spark, d, "documents").select("doc_id", S.is_dna(F.upper("text")).alias("is_dna"), S.is_multiple("text").alias("whole"), (F.length("text") < F.lit(201 - 201 * 0.2)).alias("small"))


_CODONS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(codons(11).items())) + "}"


@query(f"SELECT p_partkey, (SELECT string_agg({_CODONS}[substr({_B}, 3 * i + 1, 3)], '' ORDER BY i) FROM (SELECT unnest(range(0, 21)) AS i)) AS protein FROM part")
def translate_cds(spark, d):
    return D.table(spark, d, "part").select("p_partkey", translate_native(D.bases(F.col("p_name"))).alias("protein"))


@query()
def translate_four_orientations(spark, d):
    orders = D.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("ATG"), F.substring(D.bases(F.col("o_orderkey").cast("string")), 1, 9), F.lit("TAA")).alias("dna"))
    flipped = orders.withColumn("dna", F.when(F.col("o_orderkey") % 4 == 1, S.reverse_complement("dna")).when(F.col("o_orderkey") % 4 == 2, F.reverse("dna")).otherwise(F.col("dna")))
    return translated(flipped).select("o_orderkey", "protein", "orientation", "error")


@query("SELECT p_partkey, (SELECT CAST(sum(coalesce(MAP {" + ", ".join(f"'{k}': {v}" for k, v in S.BLOSUM62_DIAGONAL.items()) + "}[a], 0)) AS INTEGER) FROM (SELECT unnest(string_split(upper(p_name), '')) AS a)) AS score FROM part")
def self_scores(spark, d):
    return D.table(spark, d, "part").select("p_partkey", S.self_score(F.upper("p_name")).alias("score"))


@query("SELECT c_custkey, replace(replace(replace(replace(c_name || '|(a''b\":', '|', '_'), '_', '-'), '(', ''), ')', '') AS half, regexp_replace(replace(replace(replace(replace(c_name || '|(a''b\":', '|', '_'), '_', '-'), '(', ''), ')', ''), '[''\":]', '', 'g') AS clean FROM customer")
def replace_characters(spark, d):
    name = F.concat("c_name", F.lit("|(a'b\":"))
    return D.table(spark, d, "customer").select("c_custkey", S.replace_in_order(name, S.ID_REPLACEMENTS[:4]).alias("half"), S.replace_in_order(name, S.ID_REPLACEMENTS).alias("clean"))


# Sizes and statistics.
_MODE = "cnt AS (SELECT source, n_chars, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1, 2), mode AS (SELECT source, n_chars AS mode FROM cnt QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first) = 1)"


@query(f"WITH {_MODE} SELECT * FROM mode")
def length_mode_first(spark, d):
    return classify.modes(D.table(spark, d, "documents"), "source", "n_chars", "doc_id")


@query(f"WITH {_MODE} SELECT doc_id, CASE WHEN n_chars < mode - mode * 0.2 THEN 'ASM' WHEN n_chars > mode + mode * 0.2 THEN 'ALM' END AS class FROM documents JOIN mode USING (source)")
def size_class(spark, d):
    docs = D.table(spark, d, "documents")
    return docs.join(classify.modes(docs, "source", "n_chars", "doc_id"), "source").select("doc_id", classify.size_class(F.col("n_chars"), F.col("mode"), 0.2).alias("class"))


@query("WITH c AS (SELECT source, n_chars, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT source, min(n_chars) AS lo, max(n_chars) AS hi FROM (SELECT *, max(n) OVER (PARTITION BY source) AS top FROM c) WHERE n = top GROUP BY 1) SELECT doc_id, CASE WHEN n_chars > hi * 1.2 THEN 'ALM' WHEN n_chars < lo * 0.8 THEN 'ASM' END AS outlier FROM documents JOIN t USING (source)")
def mode_filter(spark, d):
    return classify.filter_by_modes(D.table(spark, d, "documents").select("doc_id", "source", "n_chars"), 0.2, "source", "n_chars").select("doc_id", "outlier")


_HALF = "CASE WHEN n = 1 THEN CAST(v[1] AS DOUBLE) ELSE round_even((v[CAST({a} + 1 AS INT)] + v[CAST({b} + 1 AS INT)]) / 2.0, 0) END"
_QH = "(n // 2)"


@query(
    "WITH g AS (SELECT source, count(*) AS n, min(n_chars) AS min, max(n_chars) AS max, round_even(avg(n_chars), 0) AS mean, round(coalesce(stddev_samp(n_chars), 0.0), 6) AS sd, list_sort(list(n_chars)) AS v FROM documents GROUP BY source) "
    f"SELECT source, n, min, max, mean, sd, {_HALF.format(a=f'({_QH} - 1) // 2', b=f'{_QH} // 2')} AS q1, {_HALF.format(a='(n - 1) // 2', b='n // 2')} AS median, {_HALF.format(a=f'n - {_QH} + ({_QH} - 1) // 2', b=f'n - {_QH} + {_QH} // 2')} AS q3, min || '-' || max AS size_range FROM g"
)
def locus_stats(spark, d):
    return evaluate.length_statistics(D.table(spark, d, "documents"), "source", "n_chars").withColumn("sd", F.round("sd", 6))


@query("SELECT source, n_chars, count(*) AS n FROM documents GROUP BY 1, 2")
def size_histogram(spark, d):
    return evaluate.size_histogram(D.table(spark, d, "documents"), "source", "n_chars")


@query("SELECT source, arg_min(doc_id, (-length(text), doc_id)) AS longest FROM documents GROUP BY source")
def longest_per_group(spark, d):
    docs = D.table(spark, d, "documents").select("source", "doc_id", F.col("text").alias("seq"))
    return dedup.longest(docs, "source", "doc_id").select("source", F.col("doc_id").alias("longest"))


@query("SELECT l_orderkey, unnest(list_filter(range(min(l_linenumber), max(l_linenumber) + 1), lambda x: NOT list_contains(list(l_linenumber), x))) AS missing FROM (SELECT l_orderkey, l_linenumber * 2 AS l_linenumber FROM lineitem) GROUP BY l_orderkey")
def missing_ids(spark, d):
    g = D.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_linenumber") * 2).cast("bigint")).alias("ids"))
    return g.select("l_orderkey", F.explode(S.missing_between(F.col("ids"))).alias("missing"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 4000")
def outside_threshold(spark, d):
    return evaluate.outside(D.table(spark, d, "documents").select("doc_id", "n_chars"), 4000, True, "n_chars")


# Classes.
_TO_CLASS = {"click": "EXC", "view": "INF", "purchase": "ASM", "signup": "PLOT3", "error": "ALM"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TO_CLASS.items()) + " ELSE 'LOTSC' END"


def _event_matches(spark: SparkSession, d: str) -> DataFrame:
    to = F.create_map(*[F.lit(x) for kv in _TO_CLASS.items() for x in kv])
    return D.table(spark, d, "events").select(F.to_date("ts").cast("string").alias("locus"), F.col("user_id").alias("genome_ord"), F.coalesce(F.try_element_at(to, F.col("event_type")), F.lit("LOTSC")).alias("class"))


@query(
    f"WITH m AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS locus, user_id AS genome_ord, {_CASE} AS class FROM events), c AS (SELECT locus, genome_ord, count(*) AS n, min(class) AS o, count(*) FILTER (class = 'EXC') AS e, count(*) FILTER (class = 'INF') AS i, count(*) FILTER (class IN ('PLOT3', 'PLOT5', 'LOTSC')) AS p FROM m GROUP BY 1, 2) "
    "SELECT locus, genome_ord, CASE WHEN n = 1 THEN o WHEN e = n THEN 'NIPHEM' WHEN p = 0 AND e = 1 AND i = 0 THEN 'EXC' WHEN p = 0 AND e = 0 AND i = 1 THEN 'INF' ELSE 'NIPH' END AS class, n FROM c"
)
def class_fold(spark, d):
    return classify.fold_classes(_event_matches(spark, d))


_CELLS = "cells AS (SELECT l_partkey AS locus, l_orderkey AS genome_ord, min(CAST(l_suppkey AS VARCHAR)) AS dna_hash, CASE WHEN min(l_linenumber) % 3 = 0 THEN 'NIPH' WHEN min(l_linenumber) % 2 = 0 THEN 'INF' ELSE 'EXC' END AS class FROM lineitem GROUP BY 1, 2), bad AS (SELECT DISTINCT dna_hash FROM (SELECT genome_ord, dna_hash FROM cells WHERE class <> 'NIPH' GROUP BY 1, 2 HAVING count(*) > 1)), marked AS (SELECT locus, genome_ord, dna_hash, CASE WHEN class <> 'NIPH' AND dna_hash IN (SELECT dna_hash FROM bad) THEN 'PAMA' ELSE class END AS class FROM cells)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    g = D.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("locus"), F.col("l_orderkey").alias("genome_ord"))
    g = g.agg(F.min(F.col("l_suppkey").cast("string")).alias("dna_hash"), F.min("l_linenumber").alias("k"))
    return g.select("locus", "genome_ord", "dna_hash", F.when(F.col("k") % 3 == 0, "NIPH").when(F.col("k") % 2 == 0, "INF").otherwise("EXC").alias("class"))


@query(f"WITH {_CELLS} SELECT * FROM marked")
def pama_flags(spark, d):
    return classify.mark_paralogous(_cells(spark, d)).select("locus", "genome_ord", "dna_hash", "class")


@query(f"WITH {_CELLS} SELECT locus, count(*) AS n FROM marked WHERE class = 'PAMA' GROUP BY locus")
def paralog_counts(spark, d):
    return classify.paralog_counts(classify.mark_paralogous(_cells(spark, d)))


@query(f"WITH {_CELLS} SELECT genome_ord, dna_hash, string_agg(CAST(locus AS VARCHAR), '|' ORDER BY locus) AS loci FROM marked WHERE class = 'PAMA' GROUP BY 1, 2 HAVING count(*) > 1")
def paralog_groups(spark, d):
    return classify.paralog_groups(classify.mark_paralogous(_cells(spark, d)))


@query(
    "WITH r AS (SELECT DISTINCT c_mktsegment AS locus, c_custkey AS genome_ord, CASE WHEN c_custkey % 4 = 0 THEN 'INF' ELSE 'EXC' END AS class, CAST(c_nationkey AS VARCHAR) AS dna_hash FROM customer), k AS (SELECT CAST(c_nationkey AS VARCHAR) AS dna_hash, CAST(c_nationkey + 1 AS VARCHAR) AS id FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 3000))), "
    "f AS (SELECT r.*, k.id AS known, row_number() OVER (PARTITION BY locus, r.dna_hash ORDER BY CASE WHEN class = 'INF' THEN 0 ELSE 1 END, genome_ord) AS nth FROM r LEFT JOIN k ON k.dna_hash = r.dna_hash), "
    "nw AS (SELECT locus, dna_hash, row_number() OVER (PARTITION BY locus ORDER BY CASE WHEN class = 'INF' THEN 0 ELSE 1 END, genome_ord) + (SELECT max(CAST(id AS INT)) FROM k) AS new_id FROM f WHERE known IS NULL AND nth = 1) "
    "SELECT f.locus, genome_ord, f.dna_hash, CASE WHEN known IS NULL AND nth = 1 THEN 'INF' ELSE class END AS class, coalesce(known, CASE WHEN nth = 1 THEN 'INF-' ELSE '' END || new_id) AS cell FROM f LEFT JOIN nw ON nw.locus = f.locus AND nw.dna_hash = f.dna_hash"
)
def assign_ids(spark, d):
    c = D.table(spark, d, "customer")
    rows = c.select(F.col("c_mktsegment").alias("locus"), F.col("c_custkey").alias("genome_ord"), F.when(F.col("c_custkey") % 4 == 0, "INF").otherwise("EXC").alias("class"), F.col("c_nationkey").cast("string").alias("dna_hash"))
    seen = D.table(spark, d, "supplier").where("s_acctbal < 3000").select(F.col("s_nationkey").alias("c_nationkey"))
    known = c.select("c_nationkey").distinct().join(seen, "c_nationkey", "left_semi").join(bounded(c.select(F.col("c_mktsegment").alias("locus")).distinct()))
    alleles = known.select("locus", F.col("c_nationkey").cast("string").alias("dna_hash"), (F.col("c_nationkey") + 1).cast("string").alias("allele_id"), F.col("c_nationkey").alias("allele_ord"))
    return classify.assign_ids(rows, alleles)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey < l_quantity THEN 'LOTSC' WHEN (CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE l_suppkey - l_partkey % 100 END) < 3 THEN 'PLOT5' WHEN (CASE WHEN l_returnflag = 'A' THEN l_suppkey - l_partkey % 100 ELSE l_linenumber END) < l_quantity - 20 THEN 'PLOT3' END AS class FROM lineitem")
def contig_tip_class(spark, d):
    li = D.table(spark, d, "lineitem")
    c = classify.tip_class(F.col("l_quantity"), F.lit(3), F.lit(20), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_partkey") % 100, F.when(F.col("l_returnflag") == "A", "1").otherwise("-1"))
    return li.select("l_orderkey", "l_linenumber", c.alias("class"))


@query("SELECT DISTINCT user_id AS genome, event_type AS contig, event_id AS protid FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS f, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS l FROM events) WHERE f = 1 OR l = 1")
def first_last_per_contig(spark, d):
    cds = D.table(spark, d, "events").select(F.col("user_id").alias("genome"), F.col("event_type").alias("contig"), F.col("ts").alias("begin"), F.col("event_id").alias("protid"))
    return classify.tips(cds).select("genome", "contig", "protid")


# Hits.
@query("SELECT locus, target, query, score FROM (SELECT l_partkey % 50 AS locus, l_partkey AS target, l_suppkey AS query, l_extendedprice AS score, l_orderkey, l_linenumber FROM lineitem) QUALIFY row_number() OVER (PARTITION BY locus, target ORDER BY score DESC, l_orderkey, l_linenumber) = 1")
def best_hit_per_target(spark, d):
    return matching.best_hit(D.hits(spark, d), order=("rep_ord", "line")).select("locus", "target", "query", "score")


_SCORES = "self AS (SELECT l_suppkey AS query, max(l_extendedprice) AS self_score FROM lineitem GROUP BY 1)"


def _self(spark: SparkSession, d: str) -> DataFrame:
    return D.hits(spark, d).groupBy(F.col("query").alias("seqid")).agg(F.max("score").alias("self_score"))


@query(f"WITH {_SCORES} SELECT l_orderkey AS rep_ord, l_linenumber AS line, l_extendedprice / self_score AS bsr, 0 AS nt_start, CAST(l_quantity AS INT) * 3 + 3 AS nt_end FROM lineitem JOIN self ON query = l_suppkey WHERE l_extendedprice / self_score >= 0.6")
def bsr_filter(spark, d):
    return matching.filter_bsr(D.hits(spark, d), _self(spark, d), 0.6).select("rep_ord", "line", "bsr", "nt_start", "nt_end")


@query(f"WITH {_SCORES} SELECT l_orderkey AS rep_ord, l_linenumber AS line, CASE WHEN l_extendedprice / self_score >= 0.7 THEN 'high' WHEN l_extendedprice / self_score < 0.6 THEN 'low' ELSE 'between' END AS band FROM lineitem JOIN self ON query = l_suppkey WHERE l_suppkey <> l_partkey AND l_partkey NOT IN (SELECT l_suppkey FROM lineitem)")
def bsr_bands(spark, d):
    return matching.bsr_bands(D.hits(spark, d), _self(spark, d), 0.6, 0.7).select("rep_ord", "line", "band")


@query(f"WITH {_SCORES}, r AS (SELECT l_partkey % 50 AS locus, l_partkey AS target, max(round(l_extendedprice / self_score, 2)) AS bsr FROM lineitem JOIN self ON query = l_suppkey GROUP BY 1, 2) SELECT locus, target, rank FROM (SELECT locus, target, bsr, row_number() OVER (PARTITION BY locus ORDER BY bsr DESC, target) AS rank FROM r WHERE bsr >= 0.8) WHERE rank <= 3")
def proteome_topn(spark, d):
    rated = D.hits(spark, d).join(_self(spark, d).withColumnRenamed("seqid", "query"), "query")
    per = rated.groupBy("locus", "target").agg(F.max(F.round(F.col("score") / F.col("self_score"), 2)).alias("score"))
    one = per.select("locus", "target", F.lit(0).cast("long").alias("query"), "score")
    return matching.top_hits(one, spark.range(1).select(F.col("id").alias("seqid"), F.lit(1.0).alias("self_score")), 0.8, 3).select("locus", "target", "rank")


# Evaluation.
@query(f"WITH {_EV}, c AS (SELECT FILE, {_COUNTS} FROM p GROUP BY FILE), e AS (SELECT user_id AS FILE, count(DISTINCT event_type) AS total_contigs, count(*) AS total_cds FROM events GROUP BY 1) SELECT FILE, total_contigs, total_cds, EXC + INF AS identified_loci, EXC + INF AS valid, PAMA AS invalid FROM e JOIN c USING (FILE)")
def sample_stats(spark, d):
    cds = D.table(spark, d, "events").select(F.col("user_id").alias("genome"), F.col("event_type").alias("contig"))
    return evaluate.sample_statistics(cds, profiles.sample_classes(D.event_profiles(spark, d), classify.CLASSES)).select("FILE", "total_contigs", "total_cds", "identified_loci", "valid", "invalid")


@query(f"WITH {_LI}, c AS (SELECT locus, {_COUNTS} FROM p GROUP BY locus) SELECT locus, EXC + INF AS valid, round((EXC + INF) / CAST((SELECT count(DISTINCT FILE) FROM p) AS DOUBLE), 3) AS proportion_samples, LNF FROM c")
def loci_stats(spark, d):
    p = D.lineitem_profiles(spark, d)
    return evaluate.loci_statistics(profiles.locus_classes(p, classify.CLASSES), p.select("FILE").distinct().count()).select("locus", "valid", "proportion_samples", "LNF")


@query(f"WITH {_LI}, c AS (SELECT locus, {_COUNTS} FROM p GROUP BY locus) SELECT count(*) AS total_loci, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in classify.CLASSES) + " FROM c")
def summary_stats(spark, d):
    return evaluate.summary(profiles.locus_classes(D.lineitem_profiles(spark, d), classify.CLASSES))


# Stores, merges, annotations.
@query(
    "WITH l AS (SELECT c_mktsegment AS locus, c_name AS dna, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS VARCHAR) AS id, c_custkey % 3 = 0 AS novel FROM customer), r AS (SELECT c_mktsegment AS locus, CASE WHEN c_acctbal < 3000 THEN c_name || '-r' ELSE c_name END AS dna, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS VARCHAR) AS id FROM customer), "
    "b AS (SELECT coalesce(l.locus, r.locus) AS locus, coalesce(l.dna, r.dna) AS dna, l.id AS old_id, r.id AS remote_id, novel, CASE WHEN r.id IS NOT NULL THEN r.id WHEN NOT novel THEN l.id END AS fixed FROM l FULL JOIN r ON l.locus = r.locus AND l.dna = r.dna) "
    "SELECT locus, dna, coalesce(fixed, CAST(max(CAST(fixed AS INT)) OVER (PARTITION BY locus) + row_number() OVER (PARTITION BY locus, fixed IS NULL ORDER BY CAST(old_id AS INT)) AS VARCHAR)) AS allele_id, fixed IS NULL AS is_local, old_id, CASE WHEN old_id IS NULL THEN 'added' WHEN remote_id IS NULL AND novel THEN 'renumbered' WHEN remote_id IS NULL THEN 'kept' WHEN remote_id <> old_id THEN 'switched' ELSE 'same' END AS status FROM b"
)
def sync_merge(spark, d):
    from pyspark.sql import Window

    c = D.table(spark, d, "customer").select(F.col("c_mktsegment").alias("locus"), F.col("c_name").alias("dna"), "c_custkey", "c_acctbal")
    number = lambda *order: F.row_number().over(Window.partitionBy("locus").orderBy(*order)).cast("string")
    local = c.select("locus", number("c_custkey").alias("allele_id"), (F.col("c_custkey") % 3 == 0).alias("is_local"), "dna")
    changed = F.when(F.col("c_acctbal") < 3000, F.concat("dna", F.lit("-r"))).otherwise(F.col("dna"))
    remote = c.select("locus", number("c_acctbal", "c_custkey").alias("allele_id"), F.lit(False).alias("is_local"), changed.alias("dna"))
    return store.synchronise(local, remote)


@query(f"WITH {_EV}, q AS (SELECT FILE, locus, replace(cell, 'INF-', '') AS cell FROM p WHERE cell <> 'LNF') SELECT FILE, '{{' || string_agg('\"' || locus || '\":\"' || cell || '\"', ',' ORDER BY locus) || '}}' AS profile, sha256('{{' || string_agg('\"' || locus || '\":\"' || cell || '\"', ',' ORDER BY locus) || '}}') AS profile_id FROM q GROUP BY FILE")
def profile_store(spark, d):
    return store.profile_json(D.event_profiles(spark, d))


@query(f"WITH {_EV} SELECT FILE FROM p WHERE locus = 'click' AND replace(cell, 'INF-', '') = '10'")
def outdated_profiles(spark, d):
    return store.outdated(store.profile_json(D.event_profiles(spark, d)), "click", "10").select("FILE")


@query("SELECT n_nationkey AS locus, n_name, coalesce(r_name, '') AS region, coalesce(CAST(s.n AS VARCHAR), '') AS suppliers FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey > 0 LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) > 1) s ON s_nationkey = n_nationkey")
def annotate_loci(spark, d):
    nation = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("locus"), "n_name", "n_regionkey")
    region = nation.join(D.table(spark, d, "region").where("r_regionkey > 0"), F.col("n_regionkey") == F.col("r_regionkey")).select("locus", F.col("r_name").alias("region"))
    suppliers = D.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("locus")).agg(F.count("*").alias("suppliers")).where("suppliers > 1")
    return annotate.annotate(nation.select("locus", "n_name"), region, suppliers)


@query("SELECT p_brand AS prot_hash, arg_min(p_name, (CASE WHEN contains(p_name, 'duf') OR contains(p_name, 'hypothetical') OR contains(p_name, 'uncharacterized') THEN 1 ELSE 0 END, p_partkey)) AS name FROM part GROUP BY p_brand")
def informative_names(spark, d):
    return annotate.informative_name(D.table(spark, d, "part").select(F.col("p_brand").alias("prot_hash"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord")))


@query("SELECT c_mktsegment AS species, count(*) AS schemas, CAST(sum(c_nationkey) AS BIGINT) AS nr_loci, CAST(sum(c_custkey) AS BIGINT) AS nr_alleles FROM customer GROUP BY 1")
def species_totals(spark, d):
    return store.species_statistics(D.table(spark, d, "customer").select(F.col("c_mktsegment").alias("species"), F.col("c_nationkey").alias("nr_loci"), F.col("c_custkey").alias("nr_alleles")))


# Sinks and records of calling.
_PLACES = "places AS (SELECT l_orderkey AS genome_ord, CAST(l_suppkey AS VARCHAR) AS dna_hash, arg_min(l_returnflag || '&' || l_linenumber || '-' || CAST(l_quantity AS INT) || '&' || 1, (l_returnflag, l_linenumber, CAST(l_quantity AS INT))) AS place FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_CELLS}, {_PLACES} SELECT locus, genome_ord, CASE WHEN class IN ('EXC', 'INF') THEN coalesce(place, dna_hash) ELSE class END AS cell FROM marked LEFT JOIN places USING (genome_ord, dna_hash)")
def coordinate_matrix(spark, d):
    cds = D.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("genome_ord"), F.col("l_suppkey").cast("string").alias("dna_hash"), F.col("l_returnflag").alias("contig"), F.col("l_linenumber").alias("begin"), F.col("l_quantity").cast("int").alias("end"), F.lit(1).alias("strand")
    )
    return classify.coordinate_cells(classify.mark_paralogous(_cells(spark, d)), cds)


@query(
    f"WITH m AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS locus, user_id AS FILE, {_CASE} AS class FROM events), g AS (SELECT locus, FILE, count(*) AS n, min(class) AS o, count(*) FILTER (class = 'EXC') AS e, count(*) FILTER (class = 'INF') AS i, count(*) FILTER (class IN ('PLOT3', 'PLOT5', 'LOTSC')) AS p FROM m GROUP BY 1, 2), "
    "c AS (SELECT locus, FILE, n, CASE WHEN n = 1 THEN o WHEN e = n THEN 'NIPHEM' WHEN p = 0 AND e = 1 AND i = 0 THEN 'EXC' WHEN p = 0 AND e = 0 AND i = 1 THEN 'INF' ELSE 'NIPH' END AS class FROM g) "
    "SELECT FILE, " + ", ".join(f"count(*) FILTER (class = '{k}') AS {k}" for k in classify.CLASSES if k != "LNF") + ", (SELECT count(DISTINCT locus) FROM c) - count(*) AS LNF, 0 AS invalid_cds, CAST(sum(n) AS BIGINT) AS classified_cds, 0 AS total_cds FROM c GROUP BY FILE"
)
def calls_statistics(spark, d):
    m = classify.fold_classes(_event_matches(spark, d)).withColumnRenamed("genome_ord", "FILE")
    return evaluate.calls_per_sample(m, m, m)


@query(
    f"WITH m AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS locus, user_id AS genome_ord, event_id AS ord, CAST(event_id AS VARCHAR) AS dna_hash, {_CASE} AS class FROM events), g AS (SELECT locus, genome_ord, count(*) AS n, min(class) AS o, count(*) FILTER (class = 'EXC') AS e, count(*) FILTER (class = 'INF') AS i, count(*) FILTER (class IN ('PLOT3', 'PLOT5', 'LOTSC')) AS p FROM m GROUP BY 1, 2), "
    "c AS (SELECT locus, genome_ord, CASE WHEN n = 1 THEN o WHEN e = n THEN 'NIPHEM' WHEN p = 0 AND e = 1 AND i = 0 THEN 'EXC' WHEN p = 0 AND e = 0 AND i = 1 THEN 'INF' ELSE 'NIPH' END AS locus_class FROM g) "
    "SELECT row_number() OVER (ORDER BY locus, genome_ord, ord, dna_hash) AS index, genome_ord, locus, locus_class, dna_hash, class AS cds_class FROM m JOIN c USING (locus, genome_ord) WHERE locus_class NOT IN ('EXC', 'INF')"
)
def missing_class_records(spark, d):
    ids = D.table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("dna_hash"))
    to = F.create_map(*[F.lit(x) for kv in _TO_CLASS.items() for x in kv])
    m = D.table(spark, d, "events").select(F.to_date("ts").cast("string").alias("locus"), F.col("user_id").alias("genome_ord"), F.col("event_id").alias("ord"), F.coalesce(F.try_element_at(to, F.col("event_type")), F.lit("LOTSC")).alias("class")).join(ids, "ord")
    return evaluate.ambiguous_matches(m, classify.fold_classes(m))


@query("SELECT sha256(upper(replace(text, 'ß', 'SS'))) AS dna_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) FILTER (source = 'src0') = 0")
def unclassified_cds(spark, d):
    docs = D.table(spark, d, "documents")
    cds = docs.select(F.col("source").alias("genome"), F.col("doc_id").alias("genome_ord"), F.lit(1).alias("protid"), F.col("text").alias("dna"))
    distinct = dedup.distinct_dna(cds)
    matched = dedup.occurrences(cds).select("dna_hash", F.col("genome_ord").alias("doc_id")).join(docs.where("source = 'src0'").select("doc_id"), "doc_id")
    return classify.unclassified(distinct, matched).select("dna_hash", "n")


@query("SELECT doc_id, doc_id || ': smaller than 201 chars' AS reason FROM documents WHERE length(text) < 201 * (1 - 0.2)")
def small_sequences(spark, d):
    return fasta.small_sequences(D.table(spark, d, "documents"), 201, 0.2, "doc_id", "text")


@query("SELECT p_name, row_number() OVER (ORDER BY lower(p_name), p_name) AS number FROM (SELECT DISTINCT p_name FROM part)")
def surrogate_numbers(spark, d):
    return fasta.numbered(D.table(spark, d, "part").select("p_name").distinct(), "p_name")


@query(f"WITH {_LI}, a AS (SELECT DISTINCT locus, CAST(n AS VARCHAR) AS allele_id, 'ACGT' || locus || '-' || n AS dna FROM prof WHERE n > 10) SELECT FILE, p.locus, a.dna FROM p JOIN a ON a.locus = p.locus AND a.allele_id = regexp_replace(replace(cell, 'INF-', ''), '[*]', '')")
def allele_sequences(spark, d):
    g = D.table(spark, d, "lineitem").groupBy(F.col("l_suppkey"), (F.col("l_partkey") % 50).alias("locus")).agg(F.count("*").alias("n"))
    alleles = g.where("n > 10").select("locus", F.col("n").cast("string").alias("allele_id"), F.concat(F.lit("ACGT"), "locus", F.lit("-"), "n").alias("dna")).distinct()
    return profiles.allele_sequences(D.lineitem_profiles(spark, d), alleles)[0].select("FILE", "locus", "dna")


@query(f"WITH {_EV}, q AS (SELECT FILE, locus, replace(cell, 'INF-', '') AS cell FROM p WHERE cell <> 'LNF'), s AS (SELECT FILE, sha256('{{' || string_agg('\"' || locus || '\":\"' || cell || '\"', ',' ORDER BY locus) || '}}') AS profile_id FROM q GROUP BY FILE) SELECT DISTINCT profile_id FROM s WHERE profile_id NOT IN (SELECT profile_id FROM s WHERE FILE IN (SELECT c_custkey FROM customer WHERE c_acctbal < 3000))")
def insert_new_profiles(spark, d):
    stored = store.profile_json(D.event_profiles(spark, d))
    known = D.table(spark, d, "customer").where("c_acctbal < 3000").select(F.col("c_custkey").alias("FILE"))
    return store.insert_new(stored.join(known, "FILE", "left_semi"), stored).select("profile_id")


@query(f"WITH {_EV}, q AS (SELECT FILE, locus, CASE WHEN locus = 'click' AND replace(cell, 'INF-', '') = '10' THEN '99' ELSE replace(cell, 'INF-', '') END AS cell FROM p WHERE cell <> 'LNF') SELECT FILE, '{{' || string_agg('\"' || locus || '\":\"' || cell || '\"', ',' ORDER BY locus) || '}}' AS profile FROM q GROUP BY FILE")
def replace_identifiers(spark, d):
    changes = spark.range(1).select(F.lit("click").alias("locus"), F.lit("10").alias("old"), F.lit("99").alias("new"))
    return store.replace_identifiers(store.profile_json(D.event_profiles(spark, d)), changes).select("FILE", "profile")


@query("SELECT c_custkey, c_name || ' Thing of ' || c_mktsegment AS header, c_mktsegment AS gene, 'Thing of ' || c_mktsegment AS product FROM customer")
def header_terms(spark, d):
    text = F.concat("c_name", F.lit(" Thing of "), "c_mktsegment")
    records = D.table(spark, d, "customer").select("c_custkey", text.alias("name"), F.concat(F.regexp_replace("c_name", " ", "_"), F.lit(" Thing of "), "c_mktsegment", F.lit(" OS=Any GN="), "c_mktsegment", F.lit(" PE=1")).alias("header"))
    return annotate.proteome_terms(records).select("c_custkey", F.col("name").alias("header"), "gene", "product")


@query("SELECT event_id, date_diff('second', ts, ts + INTERVAL (user_id) SECOND) // 60 AS minutes, user_id % 60 AS seconds FROM events")
def elapsed_time(spark, d):
    ev = D.table(spark, d, "events").select("event_id", "ts", F.timestamp_add("SECOND", F.col("user_id").cast("int"), F.col("ts")).alias("later"))
    e = S.elapsed(S.parse_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), S.parse_time(F.date_format("later", "yyyy-MM-dd'T'HH:mm:ss")))
    return ev.select("event_id", e["minutes"].alias("minutes"), e["seconds"].alias("seconds"))


@query(f"WITH {_LI}, {_PA}, m AS (SELECT FILE, locus, {_MASK} AS cell FROM p) SELECT FILE, locus, cell FROM m WHERE locus IN (SELECT locus FROM pa GROUP BY locus HAVING CAST(sum(present) AS DOUBLE) / (SELECT count(DISTINCT FILE) FROM pa) >= 0.95)")
def core_profiles(spark, d):
    p = D.lineitem_profiles(spark, d)
    return profiles.masked(p.join(profiles.core_loci(profiles.presence(p), 0.95), "locus", "left_semi")).select("FILE", "locus", "cell")


# Sources and scalars.
@query("SELECT source, count(*) AS records, min(length(text)) AS min_length, max(length(text)) AS max_length, avg(length(text)) AS mean_length FROM documents GROUP BY source")
def fasta_statistics(spark, d):
    return fasta.statistics(D.table(spark, d, "documents").select("source", F.col("text").alias("seq")))


@query("SELECT event_id, split_part(event_type, '.', 1) || '-protein' || row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seqid FROM events")
def cds_names(spark, d):
    records = D.table(spark, d, "events").select(F.concat(F.lit("/genomes/"), "event_type", F.lit(".contigs.fasta")).alias("source"), F.col("event_id").alias("rec_ord"), F.lit("x").alias("seqid"), "event_id")
    return fasta.rename_cds(records).select("event_id", "seqid")


@query("SELECT page_id, regexp_replace(split_part(url, '/', -1), '[.][^.]*$', '') AS base, split_part(split_part(url, '/', -1), '.', 1) AS genome, contains(url, 'page') OR contains(url, 'ref') AS some, regexp_extract(url, '[0-9]+', 0) AS number FROM pages")
def identifier_parts(spark, d):
    return D.table(spark, d, "pages").select("page_id", S.basename("url").alias("base"), S.genome_of("url").alias("genome"), S.contains_any(F.col("url"), ["page", "ref"]).alias("some"), S.first_match("url", "[0-9]+").alias("number"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') = '69' AS outdated FROM events")
def profile_json(spark, d):
    k = F.get_json_object("props", "$.k")
    return D.table(spark, d, "events").select("event_id", k.alias("k"), (k == "69").alias("outdated"))


_MESSAGES = "m AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Extra in frame stop codon found' WHEN 1 THEN 'First codon ''AAA'' is not a start codon' WHEN 2 THEN 'Final codon ''AAA'' is not a stop codon' WHEN 3 THEN 'sequence length is not a multiple of 3' WHEN 4 THEN 'ambiguous or invalid characters' ELSE 'other' END || ', ' || p_name AS message FROM part)"


@query(f"WITH {_MESSAGES} SELECT p_partkey, CASE WHEN message LIKE 'Extra%' THEN 'In-frame Stop Codon' WHEN message LIKE 'First%' THEN 'Missing Start Codon' WHEN message LIKE 'Final%' THEN 'Missing Stop Codon' WHEN message LIKE 'sequence%' THEN 'Incomplete ORF' WHEN message LIKE 'ambiguous%' THEN 'Ambiguous Bases' END AS category FROM m")
def error_categories(spark, d):
    heads = ["Extra in frame stop codon found", "First codon 'AAA' is not a start codon", "Final codon 'AAA' is not a stop codon", "sequence length is not a multiple of 3", "ambiguous or invalid characters", "other"]
    message = F.concat(F.element_at(F.array(*map(F.lit, heads)), F.col("p_size") % 6 + 1), F.lit(", "), "p_name")
    return D.table(spark, d, "part").select("p_partkey", S.error_category(message).alias("category"))


# Whole runs: calling, building and adapting.
_ORDER_DNA = f"'ATG' || substr({D.BASES.format('o_orderpriority || o_orderstatus')}, 1, 30) || 'TAA'"


@query(
    "WITH g AS (SELECT DISTINCT o_custkey AS f FROM orders), l AS (SELECT DISTINCT o_orderpriority AS locus FROM orders WHERE o_orderstatus IN ('F', 'O')), m AS (SELECT o_custkey AS f, o_orderpriority AS locus, count(*) AS n, min(o_orderstatus) AS s FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2) "
    "SELECT CAST(f AS VARCHAR) AS FILE, locus, CASE WHEN n = 1 THEN CASE s WHEN 'F' THEN '1' ELSE '2' END WHEN n > 1 THEN 'NIPHEM' ELSE 'PLNF' END AS cell FROM g CROSS JOIN l LEFT JOIN m USING (f, locus)"
)
def exact_calls(spark, d):
    calls = calling.AlleleCaller(D.order_alleles(spark, d), mode=1).run(D.order_cds(spark, d).drop("o_orderpriority", "o_orderstatus"))
    return calls.profiles.select("FILE", "locus", "cell")


@query(f"SELECT CAST(o_custkey AS VARCHAR) AS genome, CAST(o_orderkey AS INT) AS protid, o_orderpriority AS locus, CASE o_orderstatus WHEN 'F' THEN '1' ELSE '2' END AS allele_id, sha256({_ORDER_DNA}) AS dna_hash FROM orders WHERE o_orderstatus IN ('F', 'O')")
def incremental_calls(spark, d):
    """A stream of files with coding sequences, called as they come; what is there is read and the stream ends."""
    stage = Stage(spark)
    stage.write(D.order_cds(spark, d).select("genome", "genome_ord", "protid", "dna"), "arrived")
    out = f"{stage.root}/calls"
    incremental.call_incrementally(incremental.read_cds_stream(spark, f"{stage.root}/arrived"), D.order_alleles(spark, d), out, f"{stage.root}/state").awaitTermination()
    return spark.read.parquet(out).select("genome", "protid", "locus", "allele_id", "dna_hash")


@query()
def all_calls(spark, d):
    """Mode 4 with the first variant of each gene known: the others are found by protein, cluster and representative."""
    alleles = D.supplier_alleles(spark, d).where("allele_ord = 1")
    calls = calling.AlleleCaller(alleles, mode=4).run(D.supplier_genes(spark, d).select("genome", "genome_ord", "protid", "dna"))
    return calls.profiles.select("FILE", "locus", "cell")


@query()
def created_catalogue(spark, d):
    return calling.create_catalogue(D.supplier_genes(spark, d).select("genome", "genome_ord", "protid", "seqid", "dna"))


@query(f"WITH {D.GENES} SELECT locus, count(DISTINCT dna) AS total_alleles, count(DISTINCT dna) AS valid_alleles, 1 AS number_representatives FROM genes GROUP BY locus")
def adapted_catalogue(spark, d):
    return calling.adapt_catalogue(D.supplier_alleles(spark, d))["summary"]


@query(f"WITH {D.PLANTED} SELECT genome, contig, begin, begin + 606 AS \"end\", CAST(row_number() OVER (PARTITION BY genome ORDER BY CAST(substr(contig, 2) AS INT), begin) AS INT) AS protid, strand FROM planted")
def predicted_genes(spark, d):
    """Every planted gene is predicted on its strand with its start and stop, and nothing in the noise between them."""
    return genes.predict(D.nation_contigs(spark, d), least=30.0).select("genome", "contig", "begin", "end", "protid", "strand")


@query(
    f"WITH {D.PROTEINS}, own AS (SELECT p_brand AS locus, p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN substr(seq, 1, p_partkey % 90 + 1) || substr(seq, CAST(p_partkey % 90 + 8 AS BIGINT)) ELSE seq END AS seq FROM part JOIN parts ON id = p_partkey) "
    "SELECT locus, CAST(id AS VARCHAR) AS FILE, seq, 1 AS widths FROM own"
)
def progressive_alignment(spark, d):
    """Every sequence of a locus is aligned to one width, and without its gaps is what it was."""
    aligned = phylo.aligned_loci(D.brand_proteins(spark, d))
    widths = aligned.groupBy("locus").agg(F.count_distinct(F.length("aligned")).cast("int").alias("widths"))
    return aligned.join(widths, "locus").select("locus", "FILE", F.replace("aligned", F.lit("-"), F.lit("")).alias("seq"), "widths")


@query()
def relaxed_tree(spark, d):
    """The tree of all samples, with the rounds of joins down to sixteen nodes."""
    return tree.tree_of_profiles(D.lineitem_profiles(spark, d), finish=16)


# Beyond SQL: folds and alignment, held against plain versions in the tests.
def _items(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("seqid"), F.upper("text").alias("seq"))


@query()
def smith_waterman(spark, d):
    """Every two items that share a tenth of the minimizers of the first, and every item that has text with itself."""
    pairs = cluster.near_pairs(_items(spark, d).withColumn("group", F.lit(0)), 0.1)
    return matching.align_pairs(pairs.repartition("query", "target")).select("query", "target", "score", "qstart", "qend")


@query()
def bsr_eliminate(spark, d):
    items = _items(spark, d)
    return cluster.eliminate_near(items, items.select("seqid", F.length("seq").alias("length")), 0.1, 0.6, Stage(spark))


@query()
def greedy_cluster(spark, d):
    return cluster.greedy_clusters(D.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("seqid"), F.col("p_name").alias("seq")))


@query()
def inexact_fold(spark, d):
    li = D.table(spark, d, "lineitem")
    m = li.select(
        F.col("l_suppkey").cast("string").alias("locus"), F.col("l_orderkey").cast("int").alias("genome_ord"), F.col("l_linenumber").cast("int").alias("ord"), F.lit("1").alias("allele_id"), F.col("l_partkey").cast("string").alias("dna_hash"),
        (F.col("l_partkey") % 200).cast("string").alias("prot_hash"), (F.col("l_discount") + 0.6).alias("bsr"), F.col("l_quantity").cast("int").alias("dna_length"), F.when(F.col("l_tax") > 0.07, "PLOT3").alias("tip_class"),
    )
    lengths = m.select("locus").distinct().select("locus", F.array(F.lit(20), F.lit(25), F.lit(25)).alias("lengths"))
    return classify.classify_inexact(m, lengths, 0.4, 0.6).select("locus", "genome_ord", "ord", "dna_hash", "class", "bsr", "candidate")
