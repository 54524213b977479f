"""Reads and sites to observations: filters, CIGAR walk, interval join, dedup."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, sums_before
from ..functions.evidence import allele, error_rate, evidence_weight, usable_baseq
from ..params import Observing
from ..plans.tables import materialize

UNMAPPED, SECONDARY, SUPPLEMENTARY = 0x4, 0x100, 0x800
#: Flags that a pileup leaves out besides: failed quality checks, duplicates.
QC_FAIL, DUPLICATE = 0x200, 0x400
#: Flags of alignments that are in no column of a pileup; supplementary ones take up depth, but show nothing.
PILED = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE
#: How many times finer the bins of short intervals are.
FINE = 32


def usable_alignments(alignments: DataFrame, min_mapq: int, skip: int = UNMAPPED | SECONDARY | SUPPLEMENTARY) -> DataFrame:
    """Alignments with none of the ``skip`` flags, enough mapping quality, a sequence and a span."""
    return alignments.where((F.col("flag").bitwiseAND(F.lit(skip)) == 0) & (F.col("mapq") >= min_mapq) & (F.length("seq") > 0) & (F.length("cigar") > 1))


def aligned_blocks(alignments: DataFrame) -> DataFrame:
    """One row for each M, = or X run of a CIGAR: ``ref_start`` and ``ref_end`` (0-based, half-open) and ``query_start``.

    I and S use up the query, D and N the reference, H and P nothing. The walk is two running sums inside each row."""
    pattern = F.lit("([0-9]+)([MIDNSHPX=])")
    ops, sizes = F.regexp_extract_all("cigar", pattern, F.lit(2)), F.regexp_extract_all("cigar", pattern, F.lit(1))
    rows = F.zip_with(ops, sizes, lambda o, n: F.struct(o.alias("op"), n.cast("long").alias("n")))

    def walk(x: Column) -> Column:
        used = lambda kinds: sums_before(F.transform(x, lambda r: F.when(r["op"].isin(*kinds), r["n"]).otherwise(F.lit(0).cast("long"))))
        places = F.arrays_zip(x.alias("run"), used("M=XDN").alias("ref"), used("M=XIS").alias("query"))
        return F.filter(places, lambda p: p["run"]["op"].isin("M", "=", "X"))

    start = F.col("start0").cast("long")
    block = lambda p: F.struct((start + p["ref"]).alias("ref_start"), (start + p["ref"] + p["run"]["n"]).alias("ref_end"), p["query"].alias("query_start"))
    found = alignments.withColumn("block", F.explode(F.transform(let(rows, walk), block)))
    return found.select(*alignments.columns, "block.*")


def interval_join(intervals: DataFrame, points: DataFrame, start: str, end: str, point: str, keys: tuple[str, ...] = (), bin_size: int = 1 << 12) -> DataFrame:
    """Each interval [start, end) with each point in it, and equal ``keys``.

    Both sides meet on fixed bins, an equi-join that any executor can take part in. Intervals up to a ``FINE``-th of
    ``bin_size`` meet points in bins of that size, so that they are held against few of them; a point has one bin of
    each size and an interval one size, so no pair comes twice. Intervals that span more bins are repeated for each."""
    small = max(1, bin_size // FINE)
    size = F.when(F.col(end) - F.col(start) <= small, small).otherwise(bin_size)
    left = intervals.where(F.col(start) < F.col(end)).withColumn("_size", size).withColumn("_bin", F.explode(F.sequence(F.expr(f"{start} div _size"), F.expr(f"({end} - 1) div _size"))))
    sizes = sorted({small, bin_size})
    right = points.withColumn("_size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("_bin", F.expr(f"{point} div _size"))
    joined = left.join(right, ["_size", "_bin", *keys]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end)))
    return joined.drop("_size", "_bin")


def last_site_at(sites: DataFrame) -> DataFrame:
    """One site for each position: of several the last in file order."""
    return sites.groupBy("chrom", "pos1").agg(F.max_by(F.struct("snp_idx", "snp_id", "ref", "alt"), "snp_idx").alias("s")).select("chrom", "pos1", "s.*")


def observed_bases(alignments: DataFrame, sites: DataFrame) -> DataFrame:
    """Bases that alignments show at sites: ``(alignment columns, snp_idx, snp_id, base, baseq, ref, alt)``."""
    narrow = alignments.select("ordinal", "name", "chrom", "start0", "cigar", "mapq", "seq", "qual")
    blocks = aligned_blocks(narrow)
    points = sites.withColumn("pos0", F.col("pos1") - 1)
    found = interval_join(blocks, points, "ref_start", "ref_end", "pos0", ("chrom",))
    at = (F.col("query_start") + F.col("pos0") - F.col("ref_start")).cast("int")
    base = F.col("seq").substr(at + 1, F.lit(1))
    return found.select("ordinal", "name", "mapq", "chrom", "start0", "cigar", "pos1", "snp_idx", "snp_id", "ref", "alt", base.alias("base"), F.get("qual", at).cast("int").alias("baseq"), *[c for c in points.columns if c not in ("snp_idx", "snp_id", "chrom", "pos1", "ref", "alt", "pos0")])


def spans(alignments: DataFrame) -> DataFrame:
    """``(ordinal, chrom, start0, end0)``: the reference that each alignment covers, deletions and skips within it."""
    sizes = F.transform(F.regexp_extract_all("cigar", F.lit("([0-9]+)[MDN=X]"), F.lit(1)), lambda n: n.cast("long"))
    return alignments.select("ordinal", "chrom", "start0", (F.col("start0") + F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n)).alias("end0"))


def within_depth(alignments: DataFrame, sites: DataFrame, max_depth: int) -> DataFrame:
    """``(ordinal, snp_idx, rank)``: of the alignments that cover a site the first ``max_depth``, by start and then place in
    the file, ranked from 1.

    Ranks are taken within a site, and Spark drops what is beyond the limit in each task before the exchange, so a site
    that very many reads cover reaches its task as ``max_depth`` rows of every other one at most."""
    points = sites.select("chrom", "snp_idx", (F.col("pos1") - 1).alias("pos0"))
    met = interval_join(spans(alignments), points, "start0", "end0", "pos0", ("chrom",))
    rank = F.row_number().over(Window.partitionBy("snp_idx").orderBy("start0", "ordinal"))
    return met.select("ordinal", "snp_idx", "start0").withColumn("rank", rank).where(F.col("rank") <= max_depth).select("ordinal", "snp_idx", "rank")


def pileup_columns(alignments: DataFrame, sites: DataFrame, p: Observing = Observing(scan="pileup")) -> DataFrame:
    """``(snp_idx, chrom, pos1, covering, depth, n_ref, n_alt, n_other, n_low, n_gap)`` of each site: alignments that cover
    it, those within the depth limit, and what these show there: either allele, another base, a base or alignment of
    too little quality or that is supplementary, or no base at all. Sites that nothing covers have zeros."""
    sites = last_site_at(sites)
    piled = usable_alignments(alignments, 0, PILED)
    covering = interval_join(spans(piled), sites.select("chrom", "snp_idx", (F.col("pos1") - 1).alias("pos0")), "start0", "end0", "pos0", ("chrom",)).groupBy("snp_idx").agg(F.count("*").alias("covering"))
    kept = within_depth(piled, sites, p.max_depth)
    depth = kept.groupBy("snp_idx").agg(F.count("*").alias("depth"))
    based = observed_bases(piled, sites)
    shown = based.join(kept, ["ordinal", "snp_idx"], "left_semi").groupBy("snp_idx").agg(F.count("*").alias("shown"))
    passed = coded(observed_bases(usable_alignments(alignments, p.min_mapq, PILED | SUPPLEMENTARY), sites), p).join(kept, ["ordinal", "snp_idx"], "left_semi")
    alleles = passed.groupBy("snp_idx").agg(*(F.count_if(F.col("b") == b).alias(n) for n, b in (("n_ref", 1), ("n_alt", -1), ("n_other", 0))))
    out = sites.select("snp_idx", "chrom", "pos1")
    for part in (covering, depth, shown, alleles):
        out = out.join(part, "snp_idx", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counted = ("covering", "depth", "n_ref", "n_alt", "n_other")
    low = n("shown") - n("n_ref") - n("n_alt") - n("n_other")
    return out.select("snp_idx", "chrom", "pos1", *(n(c).alias(c) for c in counted), low.alias("n_low"), (n("depth") - n("shown")).alias("n_gap"))


def coded(bases: DataFrame, p: Observing = Observing()) -> DataFrame:
    """Bases of enough quality with their allele ``b`` (0: neither allele)."""
    return bases.withColumn("baseq", usable_baseq(F.col("baseq"), p)).where(F.col("baseq") >= p.min_baseq).withColumn("b", allele(F.col("base"), F.col("ref"), F.col("alt")))


def weighted(obs: DataFrame, p: Observing = Observing()) -> DataFrame:
    return obs.withColumn("epsilon", error_rate(F.col("baseq"), F.col("mapq"), p)).withColumn("weight", evidence_weight(F.col("epsilon")))


def best_per_read_site(obs: DataFrame, order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """Of several observations of a site by one read name the heaviest, the first of equals.

    Rows are dealt by read alone: the aggregate and all windows over reads that follow need no exchange of their own."""
    obs = obs.repartition("read_id")
    rest = [c for c in obs.columns if c not in ("read_id", "snp_idx")]
    first = F.struct(F.abs("weight").alias("_w"), *(((-F.col(c)) if dict(obs.dtypes)[c] != "string" else F.col(c)).alias(f"_{c}") for c in order))
    return obs.groupBy("read_id", "snp_idx").agg(F.max_by(F.struct(*rest), first).alias("_o")).select("read_id", "snp_idx", "_o.*").select(*obs.columns)


def observations(alignments: DataFrame, sites: DataFrame, p: Observing = Observing()) -> tuple[DataFrame, DataFrame]:
    """(observations, counts): ``(read_id, snp_idx, snp_id, b, baseq, mapq, epsilon, weight, ordinal)``, and one row
    ``(n_ref, n_alt, n_other)``. Without ``dedup`` mates that share a name keep both rows. A pileup scan goes by columns:
    failed and duplicate alignments are in none, and of the others the first ``max_depth`` of each site count."""
    piled, sites = p.scan == "pileup", last_site_at(sites)
    skip = UNMAPPED | SECONDARY | SUPPLEMENTARY | (PILED if piled else 0)
    seen = coded(observed_bases(usable_alignments(alignments, p.min_mapq, skip), sites), p)
    if piled:
        seen = seen.join(within_depth(usable_alignments(alignments, 0, PILED), sites, p.max_depth), ["ordinal", "snp_idx"], "left_semi")
    rows = weighted(seen.where("b <> 0"), p).select(F.col("name").alias("read_id"), "snp_idx", "snp_id", "b", "baseq", "mapq", "epsilon", "weight", "ordinal")
    if p.dedup:
        rows = best_per_read_site(rows)
    counts = rows.agg(F.count_if(F.col("b") == 1).alias("n_ref"), F.count_if(F.col("b") == -1).alias("n_alt")).crossJoin(seen.agg(F.count_if(F.col("b") == 0).alias("n_other")))
    return rows, counts


def read_index(obs: DataFrame) -> DataFrame:
    """``(read_id, read_idx)``: names numbered from 0 by first sight.

    Ranks are counted within ranges of the first ordinal, and the ranges are added up, so no task sees all names."""
    first = obs.groupBy("read_id").agg(F.min("ordinal").alias("_first"))
    return dense_index(first, ["_first", "read_id"], "read_idx").select("read_id", "read_idx")


def dense_index(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in order; rows must differ in ``order``.

    Rows are dealt out by range, sorted there and stored with their place in their range, once: counts of the ranges
    and rows are then read from the same table, and no plan can deal them out twice."""
    dealt = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")  # range << 33 | place in it
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))  # one row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_range", before.alias("_before")))
    found = placed.withColumn("_range", F.shiftright("_at", 33)).join(starts, "_range")
    return found.withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).drop("_range", "_at", "_before")


def site_chunks(sites: DataFrame, chunk_bp: int) -> DataFrame:
    """Sites with ``chunk``: windows of ``chunk_bp`` from the first site of each chromosome on, empty ones not counted."""
    if chunk_bp <= 0:
        return sites.withColumn("chunk", F.lit(0))
    w = Window.partitionBy("chrom")
    cell = F.expr(f"(pos1 - _first) div {int(chunk_bp)}")
    kept = sites.join(sites.groupBy("chrom").agg(F.min("pos1").alias("_first")), "chrom").withColumn("_cell", cell)
    cells = kept.select("chrom", "_cell").distinct().withColumn("chunk", F.row_number().over(w.orderBy("_cell")) - 1)
    return kept.join(cells, ["chrom", "_cell"]).drop("_cell", "_first")


def held_out(obs: DataFrame, fraction: float, salt: str) -> DataFrame:
    """``(read_id, validation)``: a stable share of the reads, by BLAKE2b of ``salt:read_id``.

    Spark has no BLAKE2b, hence a vectorised UDF over distinct names. Nothing is held out at 0 or below; half or
    more is an error."""
    if fraction >= 0.5:
        raise ValueError("less than half of the reads may be held out")
    reads = obs.select("read_id").distinct()
    if fraction <= 0:
        return reads.withColumn("validation", F.lit(False))

    @F.pandas_udf("double")
    def place(names: pd.Series) -> pd.Series:
        return names.map(lambda n: int.from_bytes(hashlib.blake2b(f"{salt}:{n}".encode(), digest_size=8).digest(), "little") / 2.0**64)

    return reads.withColumn("validation", place(F.col("read_id").cast("string")) < fraction)


def read_entries(obs: DataFrame, order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """``(read_id, entries)``: each read's observations in one array by site; as long as a read."""
    rest = [F.col(c) for c in ("snp_idx", *order, "b", "weight")]
    return obs.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("entries"))


def require_all(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """Inner join on ``key``; rows of ``left`` without a partner are an error when they are read."""
    mark = right.withColumn("_there", F.lit(True))
    j = left.join(mark, key, "left")
    seen = F.when(F.col("_there"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"no {what} for "), F.col(key).cast("string"))))
    return j.withColumn(key, seen).drop("_there")
