"""Classes of matches and of (genome, locus) cells."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.runtime import fold_sorted

#: The classes in the order of the reports; the label of a locus that was not looked for to the end.
CLASSES = ("EXC", "INF", "PLOT3", "PLOT5", "LOTSC", "NIPH", "NIPHEM", "ALM", "ASM", "PAMA", "LNF")
PROBABLE_LNF = "PLNF"


def size_class(length: Column, mode: Column, threshold: float | None) -> Column:
    """ASM or ALM beyond the mode's share either way, strictly; null within and without a threshold."""
    if threshold is None:
        return F.lit(None).cast("string")
    return F.when(length < mode - mode * threshold, "ASM").when(length > mode + mode * threshold, "ALM")


def tip_class(rep_len: Column, rep_left: Column, rep_right: Column, contig_len: Column, left: Column, right: Column, strand: Column) -> Column:
    """LOTSC, PLOT5 or PLOT3 by what the contig has left on each side against what the representative needs there.

    Null where the contig suffices.  Forward strand is 1; on the other the sides change places.
    """
    before, after = left, contig_len - right
    need5, need3 = rep_left, rep_len - rep_right
    forward = strand.cast("string") == "1"
    side5, side3 = F.when(forward, before).otherwise(after), F.when(forward, after).otherwise(before)
    return F.when(contig_len < rep_len, "LOTSC").when(side5 < need5, "PLOT5").when(side3 < need3, "PLOT3")


def fold_classes(matches: DataFrame, by: tuple[str, ...] = ("locus", "genome_ord")) -> DataFrame:
    """(by..., class, n): the class of each cell from the multiset of its matches' classes.

    One match keeps its class; only exact ones make NIPHEM; a single EXC without INF, or a single INF without EXC, wins
    over ASM and ALM if nothing is at a contig's tip; all else is NIPH.
    """
    has = lambda *names: F.count_if(F.col("class").isin(*names))
    c = matches.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("class").alias("only"), has("EXC").alias("e"), has("INF").alias("i"), has("PLOT3", "PLOT5", "LOTSC").alias("p"), has("ASM", "ALM").alias("z")
    )
    clean = (F.col("p") == 0) & (F.col("e") + F.col("i") + F.col("z") == F.col("n"))
    label = (
        F.when(F.col("n") == 1, F.col("only"))
        .when(F.col("e") == F.col("n"), "NIPHEM")
        .when(clean & (F.col("e") == 1) & (F.col("i") == 0), "EXC")
        .when(clean & (F.col("e") == 0) & (F.col("i") == 1), "INF")
        .otherwise("NIPH")
    )
    return c.select(*by, label.alias("class"), "n")


def modes(lengths: DataFrame, by: str = "locus", value: str = "length", order: str = "allele_ord") -> DataFrame:
    """(by, mode): the most frequent value, the first seen on ties."""
    counts = lengths.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(by).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("mode"))


def all_modes(lengths: DataFrame, by: str = "locus", value: str = "length") -> DataFrame:
    """(by, modes): all most frequent values, sorted."""
    counts = lengths.groupBy(by, value).agg(F.count("*").alias("n"))
    top = counts.withColumn("top", F.max("n").over(Window.partitionBy(by))).where("n = top")
    return top.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("modes"))


def filter_by_modes(lengths: DataFrame, threshold: float, by: str = "locus", value: str = "length") -> DataFrame:
    """``lengths`` with ``outlier``: ASM below the least mode's share, ALM above the greatest's."""
    joined = lengths.join(all_modes(lengths, by, value), by)
    low, high = F.array_min("modes"), F.array_max("modes")
    return joined.withColumn("outlier", F.when(F.col(value) > high * (1 + threshold), "ALM").when(F.col(value) < low * (1 - threshold), "ASM")).drop("modes")


INEXACT = "locus string, genome_ord int, ord int, allele_id string, dna_hash string, prot_hash string, class string, bsr double, candidate boolean, mode int, length int"


class _InexactFold:
    """The matches of a locus, genome by genome; what is kept is what was seen: distinct sequences, sizes, one genome's rows."""

    def __init__(self, threshold: float | None, bsr: float):
        self.threshold, self.bsr = threshold, bsr
        self.sizes, self.mode = Counter(), None
        self.known_dna, self.known_protein = set(), set()
        self.genome, self.cell, self.own_length = None, [], None

    def step(self, m) -> list[tuple]:
        if m.lengths is not None:
            self.sizes = Counter(m.lengths)
            self.mode = self.sizes.most_common(1)[0][0] if self.sizes else None
            return []
        done = self.end() if m.genome_ord != self.genome else []
        self.genome = m.genome_ord
        ratio, low, high = m.bsr, None, None
        if self.threshold is not None and self.mode is not None:
            low, high = self.mode - self.mode * self.threshold, self.mode + self.mode * self.threshold
        if m.dna_hash in self.known_dna:
            kind, ratio = "EXC", 1.0
        elif m.prot_hash in self.known_protein:
            kind, ratio = "INF", 1.0
            self.known_dna.add(m.dna_hash)
        elif isinstance(m.tip_class, str):
            kind = m.tip_class
        elif low is not None and m.dna_length < low:
            kind = "ASM"
        elif high is not None and m.dna_length > high:
            kind = "ALM"
        else:
            kind = "INF"
            self.known_dna.add(m.dna_hash)
            self.known_protein.add(m.prot_hash)
        if kind == "INF":
            self.own_length = m.dna_length
        self.cell.append([m.locus, m.genome_ord, m.ord, m.allele_id, m.dna_hash, m.prot_hash, kind, ratio, False, self.mode, m.dna_length])
        return done

    def end(self) -> list[tuple]:
        """The rows of the genome that is over; a lone INF counts for the mode and may be a candidate."""
        kinds = [r[6] for r in self.cell]
        if kinds.count("INF") == 1 and set(kinds) <= {"INF", "ASM", "ALM"}:
            self.sizes[self.own_length] += 1
            self.mode = max(self.sizes, key=self.sizes.__getitem__)
            if self.bsr <= self.cell[0][7] < self.bsr + 0.1:
                for r in self.cell:
                    r[8] = r[6] == "INF"
        done, self.cell, self.own_length = self.cell, [], None
        return done


def classify_inexact(matches: DataFrame, lengths: DataFrame, threshold: float | None, bsr: float) -> DataFrame:
    """Classes of inexact matches, genome by genome within each locus.

    ``matches``: locus, genome_ord, ord, allele_id, dna_hash, prot_hash, bsr, dna_length, tip_class (null if none).
    ``lengths``: locus, lengths (array, allele order).  Within a locus the state is what was seen before: a known
    sequence is EXC, a sequence of a known protein INF; else the contig's tip, then the size against the running mode,
    decide, and what is left is INF.  A genome with one INF adds its length to the mode, and is a candidate for
    representative if its first ratio is within a tenth of the threshold.  A locus is folded in order by one task, through
    which its rows stream; it holds the distinct sequences that match the locus, not its rows.
    """
    rows = matches.select("locus", F.lit(1).alias("late"), "genome_ord", "ord", "allele_id", "dna_hash", "prot_hash", "bsr", "dna_length", "tip_class")
    first = lengths.where("lengths is not null").select("locus", F.lit(0).alias("late"), F.lit(0).alias("genome_ord"), F.lit(0).alias("ord"), F.lit(0).alias("dna_length"), F.lit(0.0).alias("bsr"), "lengths")
    both = rows.unionByName(first, allowMissingColumns=True)
    return fold_sorted(both, "locus", ["late", "genome_ord", "ord", "dna_hash"], lambda: _InexactFold(threshold, bsr), INEXACT)


def paralogous_hashes(valid: DataFrame) -> DataFrame:
    """(dna_hash) of valid cells (locus, genome_ord, dna_hash) that some genome has at two loci or more."""
    return valid.groupBy("genome_ord", "dna_hash").agg(F.count("*").alias("n")).where("n > 1").select("dna_hash").distinct()


def mark_paralogous(cells: DataFrame) -> DataFrame:
    """Cells (locus, genome_ord, class, dna_hash) with class PAMA wherever a valid cell's hash is paralogous in any genome."""
    valid = cells.where(F.col("class").isin("EXC", "INF"))
    bad = paralogous_hashes(valid).withColumn("_bad", F.lit(True))
    joined = cells.join(bad, "dna_hash", "left")
    changed = F.when(F.col("_bad") & F.col("class").isin("EXC", "INF"), "PAMA").otherwise(F.col("class"))
    return joined.withColumn("class", changed).drop("_bad")


def paralog_counts(marked: DataFrame) -> DataFrame:
    return marked.where("class = 'PAMA'").groupBy("locus").agg(F.count("*").alias("n"))


def paralog_groups(marked: DataFrame, by: str = "dna_hash") -> DataFrame:
    """(genome_ord, by, loci): loci that share a sequence in a genome, joined by |."""
    g = marked.where("class = 'PAMA'").groupBy("genome_ord", by).agg(F.array_sort(F.collect_list("locus")).alias("loci"))
    return g.where(F.size("loci") > 1).withColumn("loci", F.array_join("loci", "|"))


def assign_ids(cells: DataFrame, alleles: DataFrame, prefix: str = "") -> DataFrame:
    """Valid cells (locus, genome_ord, class, dna_hash) with ``cell``, the allele identifier, and class as it becomes.

    INF genomes come first, each in input order.  A known hash has its identifier.  A new one gets the next number after
    the locus' highest, by its first place; that first genome gets INF- before it and becomes INF, later ones do not.
    """
    known = alleles.groupBy("locus", "dna_hash").agg(F.min_by("allele_id", "allele_ord").alias("known"))
    highest = alleles.groupBy("locus").agg(F.max(F.col("allele_id").cast("int")).alias("highest"))
    place = F.struct((F.col("class") != "INF").cast("int").alias("late"), "genome_ord")
    rows = cells.where(F.col("class").isin("EXC", "INF")).withColumn("place", place).join(known, ["locus", "dna_hash"], "left")
    new = rows.where("known is null").groupBy("locus", "dna_hash").agg(F.min("place").alias("first"))
    number = F.row_number().over(Window.partitionBy("locus").orderBy("first", "dna_hash"))
    new = new.withColumn("number", number).join(highest, "locus", "left").select("locus", "dna_hash", "first", (F.coalesce("highest", F.lit(0)) + F.col("number")).alias("new_id"))
    out = rows.join(new, ["locus", "dna_hash"], "left")
    is_first = F.col("place") == F.col("first")
    identifier = F.when(F.col("known").isNotNull(), F.col("known")).otherwise(F.concat(F.when(is_first, "INF-").otherwise(""), F.lit(prefix), F.col("new_id")))
    return out.select("locus", "genome_ord", "dna_hash", F.when(F.col("known").isNull() & is_first, "INF").otherwise(F.col("class")).alias("class"), identifier.alias("cell"))


def tips(cds: DataFrame) -> DataFrame:
    """First and last coding sequence of each (genome, contig); one that is both is listed once."""
    w = Window.partitionBy("genome", "contig")
    first, last = F.row_number().over(w.orderBy("begin", "protid")), F.row_number().over(w.orderBy(F.desc("begin"), F.desc("protid")))
    return cds.withColumn("_f", first).withColumn("_l", last).where("_f = 1 or _l = 1").drop("_f", "_l")


def places(cds: DataFrame) -> DataFrame:
    """(genome_ord, dna_hash, place): where a sequence stands first in a genome, as contig&begin-end&strand, or its
    identifier where ``cds`` (genome_ord, dna_hash, contig, begin, end, strand or seqid, protid) has no contigs."""
    if "contig" not in cds.columns:
        return cds.groupBy("genome_ord", "dna_hash").agg(F.min_by("seqid", "protid").alias("place"))
    place = F.concat("contig", F.lit("&"), "begin", F.lit("-"), "end", F.lit("&"), "strand")
    return cds.groupBy("genome_ord", "dna_hash").agg(F.min_by(place, F.struct("contig", "begin")).alias("place"))


def coordinate_cells(marked: DataFrame, cds: DataFrame) -> DataFrame:
    """(locus, genome_ord, cell): place of valid cells, or the hash without a place; else the class.

    ``marked`` are cells after mark_paralogous; ``cds`` as for places().
    """
    first = places(cds)
    valid = F.col("class").isin("EXC", "INF")
    out = marked.join(first, ["genome_ord", "dna_hash"], "left")
    return out.select("locus", "genome_ord", F.when(valid, F.coalesce("place", "dna_hash")).otherwise(F.col("class")).alias("cell"))


def unclassified(distinct: DataFrame, matches: DataFrame) -> DataFrame:
    """Distinct sequences that no match has."""
    return distinct.join(matches.select("dna_hash"), "dna_hash", "left_anti")
