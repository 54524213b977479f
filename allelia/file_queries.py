"""Queries over the engine's file formats: files are made of the driver's tables, read back by the sources, and held against SQL on the tables.

A phased VCF, alignments with an index, TSV files and archives are written whole to the shared folder, by the engine's own sinks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as q
from .functions.evidence import site_id, site_order, site_parts
from .operators import contacts, evaluate, observe, parity, risk
from .operators.ranges import order_proof
from .params import Contact, Observing
from .plans import debug
from .plans.tables import folder, materialize
from .sources import bam, bgzf, indexed, npz, sinks, tsv, vcf

#: Reads of the grounded alignments, and the contact settings that all of them pass.
REGION = ("chr1", 5_000, 120_000)
LOOSE = Contact(min_mapq=10, min_score=1.0)
#: Reads that a column of the deep pileup takes.
DEPTH = 12


def place(spark: SparkSession, name: str) -> str:
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark)))
    return f"{folder(spark)}/{uuid.uuid4().hex}-{name}"


# ---- grounded files ----

HEAD = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=PS,Number=1,Type=Integer,Description="Phase set">', "##contig=<ID=chr1>", "##contig=<ID=chr2>",
        "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "S1", "S2"])]


def variants(spark, sf_dir) -> DataFrame:
    """Parts as records of two samples on two chromosomes: phased, unphased, homozygous and missing calls, indels, lower-case alleles."""
    k = F.col("p_partkey")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (k % len(x) + 1).cast("int"))
    other = F.when(k % 4 == 0, "0/1").otherwise("1|1")
    ps = F.expr("cast(p_partkey div 50 as string)")
    call = F.when(k % 3 == 0, F.concat(pick("0|1", "1|0", "0/1", "1/1", "./.", "1|0", "0|1"), F.lit(":"), ps)).otherwise(pick("0|1", "1|0", "0/1", "1/1", "./.", "1|0", "0|1"))
    return q.table(spark, sf_dir, "part").select(
        k.alias("key"), F.when(k % 2 == 0, "chr1").otherwise("chr2").alias("chrom"), ((k + 1) * 100).alias("pos"), pick("A", "c", "G").alias("ref"), F.when(k % 11 == 0, "GT").otherwise(pick("T", "t", "T", "*")).alias("alt"),
        F.when(k % 3 == 0, "GT:PS").otherwise("GT").alias("format"), other.alias("s1"), call.alias("s2"))


def vcf_file(spark, sf_dir) -> str:
    v = variants(spark, sf_dir)
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), "format", "s1", "s2")
    order = F.when(F.col("chrom") == "chr1", 0).otherwise(1) * F.lit(1 << 40) + F.col("pos")
    rows = v.select(order.alias("ordinal"), F.concat(line, F.lit("\n")).cast("binary").alias("data"), "chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.length("ref")).alias("end"))
    path = place(spark, "sites.vcf.gz")
    bgzf.write(("\n".join(HEAD) + "\n").encode(), rows, path, "tbi")
    return path


def reads(spark, sf_dir) -> DataFrame:
    """Events as alignments of twenty bases by an own rule, some of them filtered out by flag or quality."""
    e = q.table(spark, sf_dir, "events")
    k = F.col("event_id")
    flag = F.when(k % 13 == 0, 1024).when(k % 17 == 0, 256).when(k % 19 == 0, 4).otherwise(F.when(k % 2 == 0, 0).otherwise(16))
    # Bases (k * (7 + j) + j * j) % 4 and qualities (k * 3 + j * 5) % 40 + 2 at j come round after 4 and 40 reads.
    seq = F.element_at(F.array(*(F.lit("".join("ACGT"[(r * (7 + j) + j * j) % 4] for j in range(20))) for r in range(4))), (k % 4 + 1).cast("int"))
    qual = F.element_at(F.array(*(F.lit(bytes((r * 3 + j * 5) % 40 + 2 for j in range(20))) for r in range(40))), (k % 40 + 1).cast("int"))
    start = (k * 131) % 200_000
    return e.select(
        (start * F.lit(1 << 24) + k).alias("ordinal"), F.concat(F.lit("r"), (F.expr("event_id div 2")).cast("string"), F.lit("/"), (k % 2 + 1).cast("string")).alias("name"), flag.alias("flag"), F.lit("chr1").alias("chrom"),
        start.alias("start0"), (k % 60).alias("mapq"), F.lit("3S7M2D5M1I4M").alias("cigar"), seq.alias("seq"), qual.alias("qual"))


def bam_file(spark, sf_dir) -> str:
    path = place(spark, "reads.bam")
    bam.write(reads(spark, sf_dir), path, [("chr0", 1000), ("chr1", 300_000)])
    return path


def snps(spark, sf_dir) -> DataFrame:
    """Sites every hundred bases of the grounded reference."""
    k = F.col("p_partkey")
    pair = F.element_at(F.array(*(F.lit(x) for x in ("AC", "CG", "GT", "TA", "AG"))), (k % 5 + 1).cast("int"))
    at = q.table(spark, sf_dir, "part").select(k.cast("int").alias("snp_idx"), F.lit("chr1").alias("chrom"), ((k + 1) * 100).alias("pos1"), F.substring(pair, 1, 1).alias("ref"), F.substring(pair, 2, 1).alias("alt"))
    return at.withColumn("snp_id", site_id(F.col("chrom"), F.col("pos1"), F.col("ref"), F.col("alt")))


# ---- queries ----


def vcf_het_sites(spark, sf_dir):
    rows = vcf.het_sites(spark, vcf_file(spark, sf_dir), ("chr2", 3_000, 150_000), "S2")
    return rows.select(*q.big("snp_idx", "pos1"), "snp_id", "chrom", "ref", "alt")


def vcf_region_records(spark, sf_dir):
    """By the index; the whole file is scanned where there is none."""
    return vcf.records(spark, vcf_file(spark, sf_dir), "S1", REGION).select("chrom", *q.big("pos"), "ref", "alt", "gt")


def vcf_pushdown(spark, sf_dir):
    """SQL over the file as a source: chromosome and positions of the predicate go to the index."""
    view = f"records_{uuid.uuid4().hex}"
    indexed.records(spark, vcf_file(spark, sf_dir), "S1", 1 << 14).createTempView(view)
    return spark.sql(f"SELECT chrom, pos, ref, alt, split(call, ':')[0] AS gt FROM {view} WHERE chrom = '{REGION[0]}' AND pos BETWEEN {REGION[1]} AND {REGION[2]} AND length(ref) = 1")


def vcf_phase_calls(spark, sf_dir):
    return evaluate.phase_calls(vcf.records(spark, vcf_file(spark, sf_dir), "S2")).select("chrom", *q.big("pos", "phase"), "ref", "alt", "ps")


def _exported(spark, sf_dir):
    path, out = vcf_file(spark, sf_dir), place(spark, "phased.vcf.gz")
    v = variants(spark, sf_dir).where("key % 5 <> 2")
    phases = v.select(site_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("snp_id"), F.when(F.col("key") % 3 == 0, -1).otherwise(1).alias("delta"), F.when(F.col("key") % 4 != 1, F.expr("key div 50")).alias("ps"))
    head, lines = vcf.phased_lines(spark, path, phases, REGION, "S2", 7)
    return out, sinks.write_vcf(head, lines, out)


def vcf_phased_export(spark, sf_dir):
    out, _ = _exported(spark, sf_dir)
    return vcf.records(spark, out, None, ("chr1", 8_000, 90_000)).select("chrom", *q.big("pos"), "ref", "alt", "format", "gt", "ps")


def vcf_export_counts(spark, sf_dir):
    _, (written, skipped) = _exported(spark, sf_dir)
    return spark.createDataFrame([(written, skipped)], "written long, skipped long")


def bam_scan(spark, sf_dir):
    rows = bam.alignments(spark, bam_file(spark, sf_dir), "chr1:5,001-150,000", 1 << 16)
    return rows.select("name", *q.big("flag", "start0", "mapq"), "cigar", "seq", F.concat_ws(",", F.transform("qual", lambda x: x.cast("string"))).alias("qual"))


def _observed(spark, sf_dir, p):
    return observe.observations(bam.alignments(spark, bam_file(spark, sf_dir)), snps(spark, sf_dir), p)


def bam_observations(spark, sf_dir):
    rows, _ = _observed(spark, sf_dir, Observing(dedup=False))
    return rows.select("read_id", *q.big("snp_idx", "b", "baseq", "mapq"), q.r6("weight").alias("weight"))


def bam_pileup(spark, sf_dir):
    rows, _ = _observed(spark, sf_dir, Observing(dedup=False, scan="pileup"))
    return rows.select("read_id", *q.big("snp_idx", "b", "baseq", "mapq"))


def _deep(spark, sf_dir) -> DataFrame:
    """The reads of the grounded file in a tenth of the reference, with every eleventh a supplementary one."""
    e = bam.alignments(spark, bam_file(spark, sf_dir))
    return e.withColumn("start0", F.expr("start0 div 10")).withColumn("flag", F.when(F.substring("name", 2, 9).rlike("^[0-9]*7/"), F.col("flag").bitwiseOR(F.lit(2048))).otherwise(F.col("flag")))


def bam_pileup_depth(spark, sf_dir):
    """A pileup whose depth limit cuts most columns."""
    rows, _ = observe.observations(_deep(spark, sf_dir), snps(spark, sf_dir), Observing(dedup=False, scan="pileup", max_depth=DEPTH))
    return rows.select("read_id", *q.big("snp_idx", "b", "baseq", "mapq"))


def bam_pileup_columns(spark, sf_dir):
    rows = observe.pileup_columns(_deep(spark, sf_dir), snps(spark, sf_dir), Observing(scan="pileup", max_depth=DEPTH))
    return rows.select("chrom", *q.big("snp_idx", "pos1", "covering", "depth", "n_ref", "n_alt", "n_other", "n_low", "n_gap"))


def tsv_order(spark, sf_dir):
    """Observations as a sorted file, read by place in the file: keys never fall, and no rows are collected to see that."""
    path = place(spark, "sorted.tsv")
    sinks.write_tsv(sinks.observation_file(named(spark, sf_dir)[0]), path, ["read_id", "snp_id"])
    return order_proof(tsv.observations(spark, path, True), "ordinal", ["read_id", "snp_id"])


def bam_counts(spark, sf_dir):
    return _observed(spark, sf_dir, Observing(dedup=False))[1].select(*q.big("n_ref", "n_alt", "n_other"))


def bam_anchors(spark, sf_dir):
    s = snps(spark, sf_dir).select("chrom", "pos1", "ref", "alt", F.when(F.col("snp_idx") % 3 == 0, -1).otherwise(1).alias("delta"), F.expr("cast(snp_idx div 10 as string)").alias("component"))
    rows = contacts.anchors(bam.alignments(spark, bam_file(spark, sf_dir)), s, LOOSE)
    return rows.select("query_name", "component", *q.big("sign", "n_sites", "start", "end", "mapq"), q.r6("score").alias("score"))


def named(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(observations as files hold them, sites) of the dense grounding."""
    s = q.sites(spark, sf_dir).select("snp_idx", "chrom", "pos1", F.lit("A").alias("ref"), F.lit("C").alias("alt"))
    s = s.withColumn("snp_id", site_id(F.col("chrom"), F.col("pos1"), F.col("ref"), F.col("alt")))
    o = q.obs(spark, sf_dir).join(s.select("snp_idx", "snp_id"), "snp_idx")
    return o.select(F.concat(F.lit("q"), F.col("read_id").cast("string")).alias("read_id"), "snp_id", "snp_idx", "b", "baseq", "mapq", "epsilon", "weight", F.col("read_id").alias("ordinal")), s


def tsv_observations(spark, sf_dir):
    path = place(spark, "observations.tsv.gz")
    sinks.write_tsv(sinks.observation_file(named(spark, sf_dir)[0]), path, ["read_id", "snp_id"], compressed=True)
    return tsv.observations(spark, path, True).select("read_id", "snp_id", *q.big("b"), F.round("weight", 4).alias("weight"))


def tsv_indexed(spark, sf_dir):
    path = place(spark, "observations.tsv")
    sinks.write_tsv(sinks.observation_file(named(spark, sf_dir)[0]), path)
    rows, sites = tsv.indexed(tsv.observations(spark, path))
    return rows.groupBy("snp_idx").agg(F.count("*").alias("n")).join(sites, "snp_idx").select(*q.big("snp_idx", "pos1", "n"), "snp_id", "chrom", "ref", "alt")


def npz_graph(spark, sf_dir):
    o, s = named(spark, sf_dir)
    o, path = materialize(o, "obs"), place(spark, "observations.npz")
    # Every other site is one that no read shows.
    twice = s.withColumn("snp_idx", F.col("snp_idx") * 2)
    more = twice.unionByName(twice.withColumn("snp_idx", F.col("snp_idx") + 1).withColumn("snp_id", F.concat("snp_id", F.lit("x"))))
    npz.write(o.withColumn("snp_idx", F.col("snp_idx") * 2), more, observe.read_index(o), path)
    rows, sites = npz.graph(spark, path, True)
    return rows.join(sites.select("snp_idx", "pos1"), "snp_idx").select("read_id", *q.big("snp_idx", "pos1", "b", "baseq"), F.round("weight", 4).alias("weight"))


def npz_pairs(spark, sf_dir):
    o, s = named(spark, sf_dir)
    o, path = materialize(o, "obs"), place(spark, "observations.npz")
    npz.write(o, s, observe.read_index(o), path)
    return npz.pairs(npz.observations(spark, path)[0])


def npz_count(spark, sf_dir):
    """The number of observations by the header of an archive, and the sum of one array that is read by ranges."""
    o, s = named(spark, sf_dir)
    o, path = materialize(o, "obs"), place(spark, "observations.npz")
    npz.write(o, s, observe.read_index(o), path)
    return npz.arrays(spark, path, ["baseq"], 4096).agg(F.sum("baseq").alias("baseq")).select(F.lit(npz.count(path)).cast("long").alias("n"), "baseq")


def debug_pattern_matrix(spark, sf_dir):
    hyper, path = materialize(q.hyper(spark, sf_dir), "hyper"), place(spark, "hyperread_matrix.npz")
    debug.write_pattern_matrix(hyper, q.fixed_blocks(spark, sf_dir), path)
    return npz.sparse(spark, path).select(F.col("row").alias("hyper"), F.col("column").alias("block"), q.r6("value").alias("value"))


def debug_row_pointers(spark, sf_dir):
    """Where each block's row begins among the coefficients of the coupling, rows without any included."""
    soft, path = materialize(q.soft(spark, sf_dir), "soft"), place(spark, "soft_phaselet_coupling.npz")
    debug.write_coupling(soft, q.fixed_blocks(spark, sf_dir), path)
    return npz.arrays(spark, path, ["indptr"])


def debug_mapping(spark, sf_dir):
    """Blocks, signs and margins of the sites, by archives in their order."""
    _, s = named(spark, sf_dir)
    m = q.blocks.consistency_margin(q.matrix(spark, sf_dir), q.tau(spark, sf_dir))
    rows, path = q.fixed_blocks(spark, sf_dir).join(q.tau(spark, sf_dir), "snp_idx").join(m, "snp_idx").join(s.select("snp_idx", "snp_id"), "snp_idx"), place(spark, "mapping.npz")
    debug.write_by_site(rows, {"phaselet_ids": ("block", "<i4"), "tau": ("tau", "|i1"), "snp_ids": ("snp_id", "U"), "margin": ("margin", "<f8")}, path)
    back = npz.arrays(spark, path, ["phaselet_ids", "tau", "snp_ids", "margin"])
    return back.select(F.col("row").alias("snp_idx"), F.col("phaselet_ids").alias("block"), "tau", F.col("snp_ids").alias("snp_id"), q.r6("margin").alias("margin"))


def debug_blocks(spark, sf_dir):
    rows = debug.block_rows(q.fixed_blocks(spark, sf_dir), q.sites(spark, sf_dir))
    return rows.select("chrom", *q.big("phaselet_id", "start", "end", "n_snps"))


def debug_patterns(spark, sf_dir):
    rows = debug.pattern_rows(q.hyper(spark, sf_dir))
    return rows.select(*q.big("hyperread_id", "support_reads", "degree"), "path", "signs", q.r6(F.col("raw_abs_weight").cast("double")).alias("raw_abs_weight"))


def debug_pattern_edges(spark, sf_dir):
    rows = debug.pattern_edge_rows(q.hyper(spark, sf_dir))
    return rows.select(*q.big("hyperread_id", "phaselet_id"), *(q.r6(F.col(c).cast("double")).alias(c) for c in ("raw_value", "normalized_value")))


def tsv_parity_edges(spark, sf_dir):
    """Edges written, read by site id, and classed by near distance alone."""
    _, s = named(spark, sf_dir)
    path = place(spark, "parity_edges.tsv")
    sinks.write_tsv(sinks.edge_file(q.edges(spark, sf_dir), s), path, ["snp_i", "snp_j"])
    e = risk.measured(tsv.parity_edges(spark, path, s), s)
    return e.where(F.col("distance_bp") <= 20_000).select(*q.big("i", "j", "cnt", "distance_bp"), *(q.r6(c).alias(c) for c in ("score", "support", "confidence")))


def tsv_phases(spark, sf_dir):
    _, s = named(spark, sf_dir)
    path = place(spark, "snp_phases.tsv")
    ps = F.when(F.col("snp_idx") % 4 == 0, "NA").when(F.col("snp_idx") % 4 == 1, ".").otherwise(F.expr("cast(snp_idx div 7 as string)"))
    rows = s.select("snp_id", F.when(F.col("snp_idx") % 3 == 0, -1).otherwise(1).alias("delta"), ps.alias("ps"))
    rows.orderBy(*site_order(F.col("snp_id"))).write.csv(path, sep="\t", header=True)
    return tsv.phases(spark, path).select("snp_id", *q.big("delta", "ps"))


def tsv_component_edges(spark, sf_dir):
    path = place(spark, "component_edges.tsv")
    sinks.write_tsv(sinks.component_edge_file(q.contact_edges(spark, sf_dir)), path, ["component_i", "component_j"])
    return tsv.component_edges(spark, path).select("ci", "cj", *q.big("contacts"), *(q.r6(c).alias(c) for c in ("score", "abs_score", "same", "opposite", "confidence")))


def tsv_orientations(spark, sf_dir):
    path = place(spark, "orientations.tsv")
    n = q.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("component"), F.when(F.col("n_nationkey") % 3 == 0, -1).otherwise(1).alias("orientation"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string")).otherwise("").alias("hic_ps"))
    sinks.write_tsv(sinks.orientation_file(n), path)
    return tsv.orientations(spark, path).select("component", *q.big("orientation"), "hic_ps")


def tsv_metrics(spark, sf_dir):
    path = place(spark, "summary.tsv")
    row = q.table(spark, sf_dir, "nation").agg(F.count("*").alias("nations"), F.max("n_nationkey").alias("last"))
    sinks.write_tsv(sinks.metric_rows(row), path)
    return spark.createDataFrame(sorted(tsv.key_values(spark, path).items()), "metric string, value string")


def elapsed_log(spark, sf_dir):
    path = place(spark, "log.txt")
    k = F.col("n_nationkey")
    text = F.when(k % 2 == 0, F.format_string("\tElapsed (wall clock) time (h:mm:ss or m:ss): %d:%02d:%02d", k % 3, k, k * 2)).when(k % 5 == 0, F.format_string("\tElapsed (wall clock) time (h:mm:ss or m:ss): %d:%02d.50", k, k)).otherwise(F.lit("Maximum resident set size: 1"))
    q.table(spark, sf_dir, "nation").select(text).write.text(path)
    return evaluate.elapsed_seconds(spark.read.text(path)).select(q.r6("seconds").alias("seconds"))


def debug_edges(spark, sf_dir):
    _, s = named(spark, sf_dir)
    rows = sinks.edge_rows(q.classes(spark, sf_dir), s)
    return rows.select(*q.big("snp_i", "snp_j", "pos_i", "pos_j", "distance_bp", "count"), "snp_id_i", "snp_id_j", *(q.r6(F.col(c).cast("double")).alias(c) for c in ("score", "support", "confidence", "conflict", "domination", "risk")), "edge_class", "status")


def debug_soft_edges(spark, sf_dir):
    rows = sinks.soft_edge_rows(q.classes(spark, sf_dir), q.fixed_blocks(spark, sf_dir))
    return rows.select(*q.big("block_i", "block_j", "snp_i", "snp_j", "count"), *(q.r6(F.col(c).cast("double")).alias(c) for c in ("score", "support", "risk")), "status")


def site_names(spark, sf_dir):
    parts = site_parts(F.col("snp_id"))
    ids = variants(spark, sf_dir).select(site_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("snp_id"))
    return ids.select("snp_id", *(c.alias(n) for n, c in parts.items())).select("snp_id", "chrom", *q.big("pos1"), "ref", "alt")


def read_entries(spark, sf_dir):
    rows = observe.read_entries(q.obs(spark, sf_dir), q.ORDER)
    text = F.concat_ws(",", F.transform("entries", lambda e: F.concat_ws(":", e["snp_idx"].cast("string"), e["b"].cast("string"))))
    return rows.select(*q.big("read_id"), text.alias("entries"))


def required_sites(spark, sf_dir):
    """Every observation with its site's sign; one without a site is an error."""
    rows = observe.require_all(q.obs(spark, sf_dir), q.tau(spark, sf_dir), "snp_idx", "site")
    return rows.groupBy("read_id").agg(F.sum(F.col("b") * F.col("tau")).alias("field")).select(*q.big("read_id", "field"))


def component_sites(spark, sf_dir):
    """Phased sites by the sets of their own, and by those of the reads where phases have none."""
    s = snps(spark, sf_dir)
    k = F.col("snp_idx")
    phases = s.where("snp_idx % 6 <> 0").select("snp_idx", F.when(k % 4 == 0, -1).otherwise(1).alias("delta"), F.expr("snp_idx div 25").alias("ps"))
    seen = s.where("snp_idx % 7 <> 0").select("snp_idx", F.expr("snp_idx div 40").alias("ps"))
    own = contacts.component_sites(s, phases).withColumn("sets", F.lit("phases"))
    read = contacts.component_sites(s, phases.withColumn("ps", F.lit(None).cast("long")), seen).withColumn("sets", F.lit("reads"))
    return own.unionByName(read).select("sets", "chrom", *q.big("pos1", "delta"), "ref", "alt", "component")


def risk_summary(spark, sf_dir):
    c = q.classes(spark, sf_dir)
    forest = c.where("edge_class = 'hard' and (i + j) % 2 = 0").select("i", "j", F.lit("hard_retained").alias("status"))
    return risk.risk_stats(c, forest).select(*(q.r6(f"{f}_{k}_risk").alias(f"{f}_{k}_risk") for k in ("retained", "soft") for f in ("mean", "max")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        vcf_het_sites, vcf_region_records, vcf_pushdown, vcf_phase_calls, vcf_phased_export, vcf_export_counts, bam_scan, bam_observations, bam_pileup, bam_pileup_depth, bam_pileup_columns, tsv_order, bam_counts, bam_anchors, tsv_observations, tsv_indexed,
        npz_graph, npz_pairs, npz_count, tsv_parity_edges, tsv_phases, tsv_component_edges, tsv_orientations, tsv_metrics, elapsed_log, debug_edges, debug_soft_edges, debug_pattern_matrix, debug_row_pointers, debug_mapping, debug_blocks, debug_patterns, debug_pattern_edges, site_names, read_entries, required_sites, component_sites, risk_summary,
    )
}
