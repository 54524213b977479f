"""Contact evidence between phase sets: anchors, signed edges, orientation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import allele, anchor_score, component_order, pair_name
from ..params import Contact
from .graph import spanning_forest
from .observe import SECONDARY, SUPPLEMENTARY, UNMAPPED, aligned_blocks, interval_join, usable_alignments


def component_sites(sites: DataFrame, phases: DataFrame, read_sets: DataFrame | None = None) -> DataFrame:
    """``(chrom, pos1, ref, alt, delta, component)``: phased sites with the name of their phase set.

    A phase set column must cover all sites or none; with none the sets of ``read_sets(snp_idx, ps)`` are taken, and
    sites that are in none of these go. Whether it does is part of the plan: rows that break the rule are an error when
    they are read, and no job runs before."""
    covered = phases.agg(F.count("*").alias("_sites"), F.count("ps").alias("_sets"))  # one row
    p = sites.join(phases, "snp_idx").crossJoin(F.broadcast(covered)).withColumnRenamed("ps", "_own")
    if read_sets is None:
        instead = F.raise_error(F.lit("phases without phase sets need observations")).cast("string")
    else:
        p = p.join(read_sets.select("snp_idx", F.col("ps").cast("string").alias("_seen")), "snp_idx", "left")
        instead = F.col("_seen")
    some = (F.col("_sets") > 0) & (F.col("_sets") < F.col("_sites"))
    failed = F.raise_error(F.lit("phase sets must cover every site")).cast("string")
    p = p.withColumn("ps", F.when(some, failed).when(F.col("_sets") > 0, F.col("_own").cast("string")).otherwise(instead)).where("ps is not null")
    return p.select("chrom", "pos1", F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), "delta", F.col("ps").cast("string").alias("component"))


def anchors(alignments: DataFrame, sites: DataFrame, p: Contact = Contact()) -> DataFrame:
    """``(query_name, component, sign, score, n_sites, chrom, start, end, mapq, ordinal)``: the component that each
    alignment shows most strongly, the first seen of equals. Base qualities do not matter here."""
    skip = UNMAPPED | (0 if p.keep_secondary else SECONDARY | SUPPLEMENTARY)
    narrow = usable_alignments(alignments, p.min_mapq, skip).select("ordinal", "name", "chrom", "start0", "cigar", "mapq", "seq")
    found = interval_join(aligned_blocks(narrow), sites.withColumn("pos0", F.col("pos1") - 1), "ref_start", "ref_end", "pos0", ("chrom",))
    at = (F.col("query_start") + F.col("pos0") - F.col("ref_start")).cast("int")
    b = allele(F.col("seq").substr(at + 1, F.lit(1)), F.col("ref"), F.col("alt"))
    bases = found.withColumn("b", b).where("b <> 0")
    per = bases.groupBy("ordinal", "name", "mapq", "chrom", "start0", "cigar", "component").agg(F.sum(F.col("b") * F.col("delta")).alias("total"), F.count("*").alias("n"), F.min("pos0").alias("first"))
    best = per.groupBy("ordinal", "name", "mapq", "chrom", "start0", "cigar").agg(F.sum("n").alias("n_sites"), F.max_by(F.struct("component", "total"), F.struct(F.abs("total"), -F.col("first"))).alias("b"))
    kept = best.where((F.col("n_sites") >= p.min_sites) & (F.abs("b.total") >= p.min_score))
    span = F.aggregate(F.regexp_extract_all("cigar", F.lit("([0-9]+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return kept.select(
        pair_name(F.col("name")).alias("query_name"), F.col("b.component").alias("component"), F.when(F.col("b.total") > 0, 1).otherwise(-1).alias("sign"),
        anchor_score(F.col("b.total"), F.col("mapq"), p.mapq_cap).alias("score"), "n_sites", "chrom", (F.col("start0") + 1).alias("start"), (F.col("start0") + span).alias("end"), "mapq", "ordinal")


#: Components of one molecule that are paired as one array; more are dealt into cells of about twice as many.
CELL = 1000


def component_edges(found: DataFrame, alpha: float = 0.1, cell: int = CELL) -> DataFrame:
    """``(ci, cj, score, abs_score, contacts, same, opposite, confidence)``: of each molecule and component the best
    anchor, the first of equals, and of each molecule all its pairs of components, ci below cj as text.

    Pairs are made within short arrays, not by a join of all anchors. The components of a molecule with more than
    ``cell`` are dealt into parts by hash, and each two parts, and each part by itself, are a cell of their own: no task
    holds a whole molecule, and each component is in as many cells as there are parts."""
    best = found.groupBy("query_name", "component").agg(F.max_by(F.struct("sign", "score"), F.struct("score", -F.col("ordinal"))).alias("a"))
    large = best.groupBy("query_name").agg(F.count("*").alias("_n")).where(F.col("_n") > cell)
    parts = F.coalesce(F.ceil(F.col("_n") / cell), F.lit(1))
    dealt = best.join(large, "query_name", "left").withColumn("_parts", parts).withColumn("_part", F.pmod(F.xxhash64("component"), F.col("_parts")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    dealt = dealt.withColumn("_lo", F.least("_part", "_other")).withColumn("_hi", F.greatest("_part", "_other"))
    cells = dealt.repartition("query_name", "_lo", "_hi").groupBy("query_name", "_lo", "_hi")
    items = cells.agg(F.sort_array(F.collect_list(F.struct("component", "a.sign", "a.score", "_part"))).alias("x")).where(F.size("x") > 1)
    pairs = items.select("x", (F.col("_lo") == F.col("_hi")).alias("_alone"), F.posexplode("x").alias("_at", "one")).select("_alone", "one", F.explode(F.slice("x", F.col("_at") + 2, F.size("x"))).alias("two"))
    pairs = pairs.where(F.col("_alone") | (F.col("one._part") != F.col("two._part")))
    w = F.greatest(F.lit(float(alpha)), F.least("one.score", "two.score"))
    s = F.col("one.sign") * F.col("two.sign")
    rows = pairs.select(F.col("one.component").alias("ci"), F.col("two.component").alias("cj"), w.alias("w"), s.alias("s"))
    e = rows.groupBy("ci", "cj").agg(
        F.sum(F.col("w") * F.col("s")).alias("score"), F.count("*").alias("contacts"),
        F.sum(F.when(F.col("s") > 0, F.col("w")).otherwise(0.0)).alias("same"), F.sum(F.when(F.col("s") < 0, F.col("w")).otherwise(0.0)).alias("opposite"))
    total = F.col("same") + F.col("opposite")
    return e.withColumn("abs_score", F.abs("score")).withColumn("confidence", F.when(total > 0, F.abs("score") / total).otherwise(0.0))


def retained(edges: DataFrame, p: Contact = Contact()) -> DataFrame:
    kept = edges.where((F.col("contacts") >= p.min_contacts) & (F.col("confidence") >= p.min_confidence) & (F.abs("score") >= p.min_abs_score))
    return kept.withColumn("edge_sign", F.when(F.col("score") >= 0, 1).otherwise(-1))


def orient(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(component, orientation, hic_ps)`` of the components with a retained edge, and the edges of the forest.

    The least name of each tree is +1; its phase set is the least name by number. Equal scores go by (ci, cj)."""
    e = kept.select(F.col("ci").alias("u"), F.col("cj").alias("v"), F.abs("score").alias("weight"), F.col("edge_sign").alias("sign"), F.col("ci").alias("t1"), F.col("cj").alias("t2"))
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
    signed, marked = spanning_forest(nodes, e, ["t1", "t2"])
    sets = signed.groupBy("root").agg(F.min_by("node", component_order(F.col("node"))).alias("hic_ps"))
    table = signed.join(sets, "root").select(F.col("node").alias("component"), F.col("sign").alias("orientation"), "hic_ps")
    return table, marked.where("in_forest").select(F.col("u").alias("ci"), F.col("v").alias("cj"), F.col("sign").alias("edge_sign"), F.lit(1).alias("selected"))


def apply_orientation(phases: DataFrame, table: DataFrame) -> DataFrame:
    """``(snp_idx, delta, ps)`` after orientation; sites of other components stay as they are."""
    p = phases.withColumn("component", F.col("ps").cast("string")).join(table, "component", "left")
    return p.select("snp_idx", (F.col("delta") * F.coalesce("orientation", F.lit(1))).alias("delta"), F.coalesce("hic_ps", "component").alias("ps"))


def edge_summary(edges: DataFrame, p: Contact = Contact()) -> DataFrame:
    """One row of counts and means over the edges, and over those retained by their stored ``abs_score``; zeros if none."""
    keep = (F.col("contacts") >= p.min_contacts) & (F.col("confidence") >= p.min_confidence) & (F.col("abs_score") >= p.min_abs_score)
    z = F.lit(0.0)
    kept = F.count_if(keep)
    return edges.agg(
        F.count("*").alias("edges"), kept.alias("retained_edges"), F.when(F.count("*") > 0, kept / F.count("*")).otherwise(0.0).alias("retained_fraction"),
        F.coalesce(F.avg("confidence"), z).alias("mean_confidence"), F.coalesce(F.avg("contacts"), z).alias("mean_contacts"), F.coalesce(F.max("contacts"), F.lit(0)).alias("max_contacts"))
