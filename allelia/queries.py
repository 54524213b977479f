"""One query for each operator of the phasing engine, grounded on the driver's tables, with SQL that says the same.

The grounding only exercises the operators: reads are orders, sites are suppliers (dense) or parts (sparse), alleles
follow a planted phase with errors where the discount is high. It says nothing about real phasing accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.evidence import error_rate, evidence_weight
from .operators import blocks, collapse, contacts, coupling, evaluate, observe, parity, risk, select, solve
from .operators.graph import components
from .params import Collapse, Contact, Hard, Soft, Solver
from .plans.tables import materialize

ORDER = ("l_linenumber", "l_extendedprice")
NORMS = ("sum", "mean", "sqrt", "cap", "sqrt_cap", "degree_norm_cap", "adaptive_dom_cap")
#: Settings that make the small grounded tables exercise every class.
CAP = {"cap": 3.0, "domination": 0.30}
CONTACT = Contact(min_contacts=100, min_confidence=0.3)
SOLVER = Solver()
SITE = {"dense": "l_suppkey", "sparse": "l_partkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


# ---- grounded views ----


def raw(spark, sf_dir, kind="dense") -> DataFrame:
    site = SITE[kind]
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N' AND l_quantity >= 13 AND l_linenumber * 10 >= 20")
    b = F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1) * F.when(F.col(site) % 3 == 0, -1).otherwise(1) * F.when(F.col("l_discount") > 0.085, -1).otherwise(1)
    rows = li.select(F.col("l_orderkey").alias("read_id"), F.col(site).cast("int").alias("snp_idx"), b.alias("b"), F.col("l_quantity").cast("int").alias("baseq"), (F.col("l_linenumber") * 10).alias("mapq"), *ORDER)
    return observe.weighted(rows)


def obs(spark, sf_dir, kind="dense") -> DataFrame:
    return observe.best_per_read_site(raw(spark, sf_dir, kind), ORDER)


def sites(spark, sf_dir, kind="dense") -> DataFrame:
    name, key = ("supplier", "s_suppkey") if kind == "dense" else ("part", "p_partkey")
    return table(spark, sf_dir, name).select(F.col(key).cast("int").alias("snp_idx"), F.lit("chr1").alias("chrom"), ((F.col(key) + 1) * 1000).alias("pos1"))


def tau(spark, sf_dir, kind="dense") -> DataFrame:
    return sites(spark, sf_dir, kind).select("snp_idx", F.when(F.col("snp_idx") % 3 == 0, -1).otherwise(1).alias("tau"))


def fixed_blocks(spark, sf_dir, kind="dense") -> DataFrame:
    return sites(spark, sf_dir, kind).select("snp_idx", F.expr("cast(snp_idx div 5 as int)").alias("block"))


def edges(spark, sf_dir, kind="dense", weighted=False) -> DataFrame:
    return parity.parity_edges(obs(spark, sf_dir, kind), weighted=weighted, order=ORDER)


def classes(spark, sf_dir, kind="dense", hard=Hard(), soft=Soft()) -> DataFrame:
    e = risk.measured(edges(spark, sf_dir, kind), sites(spark, sf_dir, kind))
    return risk.classify(risk.with_signs(e, tau(spark, sf_dir, kind)), hard, soft)


def matrix(spark, sf_dir, kind="dense", weighted=False) -> DataFrame:
    return parity.read_site_matrix(obs(spark, sf_dir, kind), weighted, unique=True)


def projected(spark, sf_dir) -> DataFrame:
    return collapse.projection(matrix(spark, sf_dir), tau(spark, sf_dir), fixed_blocks(spark, sf_dir))


def anchors(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    c = F.col("event_id") % 20
    sign = F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1) * F.when(c % 3 == 0, -1).otherwise(1) * F.when(F.col("event_type") == "error", -1).otherwise(1)
    return e.select(F.col("user_id").cast("string").alias("query_name"), c.cast("string").alias("component"), sign.alias("sign"), F.col("value").alias("score"), F.col("event_id").alias("ordinal"))


def contact_edges(spark, sf_dir) -> DataFrame:
    return contacts.component_edges(anchors(spark, sf_dir))


def records(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    gt = F.element_at(F.array(*map(F.lit, ("0|1", "1|0", "0/1", "1/1", "0|1"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    alt = F.when(F.col("p_partkey") % 11 == 0, "GT").otherwise("C")
    return p.select(F.lit("chr1").alias("chrom"), ((F.col("p_partkey") + 1) * 100).alias("pos"), F.lit("A").alias("ref"), alt.alias("alt"), gt.alias("gt"), F.expr("cast(p_partkey div 50 as string)").alias("ps"), F.col("p_partkey").alias("ordinal"))


def pred(spark, sf_dir) -> DataFrame:
    return evaluate.phase_calls(records(spark, sf_dir))


def truth(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "part").where("p_partkey % 13 <> 0")
    return t.select(F.lit("chr1").alias("chrom"), ((F.col("p_partkey") + 1) * 100).alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), (F.expr("p_partkey div 3") % 2).cast("int").alias("phase"), F.expr("cast(p_partkey div 80 as string)").alias("ps"), F.col("p_partkey").alias("ordinal"))


def interleaved(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "part").select(F.lit("chr1").alias("chrom"), ((F.col("p_partkey") + 1) * 100).alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.lit(0).alias("phase"), F.col("p_partkey").alias("ordinal"))
    return c.withColumn("ps", F.expr("CASE WHEN ordinal % 17 < 3 THEN 'in' || cast(ordinal div 60 as string) ELSE 'out' || cast(ordinal div 40 as string) END"))


def samples(spark, sf_dir) -> DataFrame:
    b = fixed_blocks(spark, sf_dir).select("block").distinct()
    return b.select("block", F.explode(F.array(*map(F.lit, range(6)))).alias("cand")).withColumn("z", F.when((F.col("block") * 7 + F.col("cand") * 3) % 5 < 2, -1).otherwise(1))


def labels(spark, sf_dir) -> DataFrame:
    return fixed_blocks(spark, sf_dir).select("block", F.expr("cast(block div 4 as int)").alias("component")).distinct()


def cigars(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cigar = F.concat((F.col("event_id") % 7 + 1).cast("string"), F.lit("S"), (F.col("user_id") % 20 + 5).cast("string"), F.lit("M2I"), (F.col("event_id") % 3 + 1).cast("string"), F.lit("D"), (F.col("event_id") % 30 + 1).cast("string"), F.lit("=5H"))
    return e.select("event_id", F.col("user_id").alias("user"), (F.col("user_id") * 10).alias("start0"), cigar.alias("cigar"))


# ---- queries ----


def observation_weight(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("eps", error_rate(F.col("l_quantity").cast("int"), F.col("l_linenumber") * 10))
    return li.select(*big("l_orderkey", "l_linenumber"), F.round("eps", 9).alias("epsilon"), r6(evidence_weight(F.col("eps"))).alias("weight"))


def site_scan(spark, sf_dir):
    r = records(spark, sf_dir).where(evaluate.biallelic_snp()).where(r"split(replace(gt, '|', '/'), '/')[0] <> split(replace(gt, '|', '/'), '/')[1]")
    return observe.dense_index(r.select("chrom", "pos", "ref", "alt"), ["pos"], "snp_idx").select("chrom", *big("pos", "snp_idx"), "ref", "alt")


def interval_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") * 100).alias("s"), (F.col("o_custkey") * 100 + F.col("o_orderkey") % 1500 + 1).alias("e"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), (F.col("p_partkey") * 100 + 50).alias("at"))
    return observe.interval_join(o, p, "s", "e", "at", bin_size=1024).select(*big("k", "p", "at"))


def cigar_walk(spark, sf_dir):
    return observe.aligned_blocks(cigars(spark, sf_dir)).select(*big("event_id", "ref_start", "ref_end", "query_start"))


def dedup_best(spark, sf_dir):
    return obs(spark, sf_dir).select(*big("read_id", "snp_idx", "b", "baseq", "mapq", "l_linenumber"), r6("weight").alias("weight"))


def read_snp_matrix(spark, sf_dir):
    return parity.read_site_matrix(raw(spark, sf_dir), weighted=True).select(*big("read_id", "snp_idx"), r6("v").alias("v"))


def _edge_columns(e):
    e = parity.with_confidence(e)
    return e.select(*big("i", "j", "cnt"), *(r6(c).alias(c) for c in ("score", "support", "max_abs", "confidence")))


def parity_edges(spark, sf_dir):
    return _edge_columns(edges(spark, sf_dir))


def parity_edges_weighted(spark, sf_dir):
    return _edge_columns(edges(spark, sf_dir, weighted=True))


def parity_edges_near(spark, sf_dir):
    return _edge_columns(parity.parity_edges(obs(spark, sf_dir), sites(spark, sf_dir), 20_000, order=ORDER))


def edge_risk(spark, sf_dir):
    e = risk.measured(edges(spark, sf_dir, weighted=True), sites(spark, sf_dir))
    return e.select(*big("i", "j", "distance_bp"), *(r6(c).alias(c) for c in ("confidence", "conflict", "domination", "risk")))


def _class_columns(c):
    return c.select(*big("i", "j"), "edge_class", "status", "conflicting", "weak")


def edge_class(spark, sf_dir):
    return _class_columns(classes(spark, sf_dir))


def edge_class_confidence(spark, sf_dir):
    return _class_columns(classes(spark, sf_dir, "sparse", Hard(mode="confidence", max_distance=10**9), Soft(mode="none")))


def backbone_forest(spark, sf_dir):
    t = blocks.backbone(sites(spark, sf_dir), obs(spark, sf_dir), order=ORDER)
    return t.select(*big("snp_idx", "tau", "root"))


def read_components(spark, sf_dir):
    """Over every observation; its closure is too slow for SQL."""
    return select.read_components(obs(spark, sf_dir), sites(spark, sf_dir)).select(*big("snp_idx", "ps"))


def hard_components(spark, sf_dir):
    hard = classes(spark, sf_dir).where("edge_class = 'hard'")
    found = components(sites(spark, sf_dir).select(F.col("snp_idx").alias("node")), hard.select(F.col("i").alias("u"), F.col("j").alias("v")))
    return found.select(*big("node", "root"))


def phaselet_forest(spark, sf_dir):
    _, status = blocks.hard_forest(sites(spark, sf_dir), classes(spark, sf_dir))
    return status.select(*big("i", "j"), "status")


def phaselet_table(spark, sf_dir):
    at = sites(spark, sf_dir, "sparse")
    margins = blocks.consistency_margin(matrix(spark, sf_dir, "sparse"), tau(spark, sf_dir, "sparse"))
    found = blocks.numbered_blocks(blocks.relaxed_blocks(at, classes(spark, sf_dir, "sparse"), margins))
    return blocks.block_table(found, at).select(*big("block", "start", "end", "n_sites"), "chrom")


def consistency_margin(spark, sf_dir):
    m = blocks.consistency_margin(matrix(spark, sf_dir), tau(spark, sf_dir))
    return m.select(*big("snp_idx"), r6("margin").alias("margin"))


def released_edges(spark, sf_dir):
    m = blocks.consistency_margin(matrix(spark, sf_dir, "sparse"), tau(spark, sf_dir, "sparse"))
    return blocks.released(edges(spark, sf_dir, "sparse"), blocks.suspects(m)).select(*big("i", "j"))


def haplotags(spark, sf_dir):
    delta = tau(spark, sf_dir).withColumnRenamed("tau", "delta")
    return blocks.read_labels(matrix(spark, sf_dir), delta).select(*big("read_id", "sigma"), r6("f").alias("f"))


def profiled_objective(spark, sf_dir):
    delta = tau(spark, sf_dir).withColumnRenamed("tau", "delta")
    row = blocks.read_objective(matrix(spark, sf_dir), delta)
    return row.select(*(r6(c).alias(c) for c in ("objective", "total", "disagreement")))


def read_projection(spark, sf_dir):
    return projected(spark, sf_dir).select(*big("read_id", "block"), r6("v").alias("v"))


def single_profile(spark, sf_dir):
    s = collapse.single_profile(collapse.read_vectors(projected(spark, sf_dir)))
    return s.select(*big("single_reads", "multi_reads"), r6("single_constant").alias("single_constant"))


def hyper(spark, sf_dir, norm="sqrt_cap"):
    numbered = collapse.pattern_ids(collapse.patterns(collapse.read_vectors(projected(spark, sf_dir))))
    return collapse.hyper_matrix(numbered, Collapse(norm=norm, **CAP))


def hyperreads(norm: str):
    def query(spark, sf_dir):
        m = hyper(spark, sf_dir, norm)
        return m.select(*big("hyper", "block", "reads", "degree", "block_degree", "capped"), r6("raw").alias("raw"), r6("value").alias("value"), r6("domination").alias("domination"))

    return query


def hyperread_rows(spark, sf_dir):
    rows = collapse.pattern_rows(hyper(spark, sf_dir))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return rows.select(*big("hyper", "reads", "degree"), text("path").alias("path"), text("signs").alias("signs"), r6("raw_weight").alias("raw_weight"), r6("weight").alias("weight"))


def soft(spark, sf_dir):
    return coupling.soft_coupling(classes(spark, sf_dir), fixed_blocks(spark, sf_dir))


def soft_coupling(spark, sf_dir):
    return soft(spark, sf_dir).select(*big("l", "r", "support"), r6("coeff").alias("coeff"), r6("raw").alias("raw"))


N_HYPER = 1_000_000  # a fixed offset for block nodes, as ids need only differ


def ising(spark, sf_dir):
    return coupling.ising_coupling(hyper(spark, sf_dir), soft(spark, sf_dir), N_HYPER)


def ising_coupling(spark, sf_dir):
    return ising(spark, sf_dir).select(*big("u", "v"), r6("w").alias("w"))


def coupling_scale(spark, sf_dir):
    return coupling.largest_row_sum(ising(spark, sf_dir)).select(r6("largest").alias("largest"))


def compressed_score(spark, sf_dir):
    h = hyper(spark, sf_dir)
    eta = h.select("hyper").distinct().select("hyper", F.explode(F.array(*map(F.lit, range(6)))).alias("cand")).withColumn("s", F.when((F.col("hyper") + F.col("cand")) % 3 == 0, -1).otherwise(1))
    found = coupling.compressed_score(h, soft(spark, sf_dir), samples(spark, sf_dir), eta)
    return found.select(*big("cand"), r6("score").alias("score"))


def dealt(spark, sf_dir):
    """The whole projection, each read's values moved to the component that its number names, so that the choice separates.

    A block goes to the one at its place there, or to the first where the last component is shorter."""
    n = labels(spark, sf_dir).agg(F.count("*").alias("n"))
    at = projected(spark, sf_dir).crossJoin(n)  # one row
    first = F.col("read_id") % F.ceil(F.col("n") / 4) * 4
    moved = at.select("read_id", F.when(first + F.col("block") % 4 < F.col("n"), first + F.col("block") % 4).otherwise(first).cast("int").alias("block"), "v")
    return moved.groupBy("read_id", "block").agg(F.sum("v").alias("v"))


def candidate_scores(spark, sf_dir):
    return select.candidate_scores(dealt(spark, sf_dir), samples(spark, sf_dir), labels(spark, sf_dir)).select(*big("component", "cand"), r6("score").alias("score"))


def candidate_select(spark, sf_dir):
    z, mode = select.choose(dealt(spark, sf_dir), samples(spark, sf_dir), labels(spark, sf_dir))
    if mode != "component_profiled_F":
        raise RuntimeError("reads join components")
    return z.select(*big("block", "z"))


def candidate_select_global(spark, sf_dir):
    z, _ = select.choose(projected(spark, sf_dir), samples(spark, sf_dir), labels(spark, sf_dir))
    return z.select(*big("block", "z"))


def phase_sets(spark, sf_dir):
    return select.phase_sets(fixed_blocks(spark, sf_dir), labels(spark, sf_dir), sites(spark, sf_dir)).select(*big("snp_idx", "ps"))


def holdout_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"))
    return observe.held_out(o, 0.2, "validation").select(*big("read_id"), "validation")


def read_index(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("read_id"), F.col("event_id").alias("ordinal"))
    return observe.read_index(e).select(*big("read_id", "read_idx"))


def component_edges(spark, sf_dir):
    e = contact_edges(spark, sf_dir)
    return e.select("ci", "cj", *big("contacts"), *(r6(c).alias(c) for c in ("score", "abs_score", "same", "opposite", "confidence")))


def retained_edges(spark, sf_dir):
    return contacts.retained(contact_edges(spark, sf_dir), CONTACT).select("ci", "cj", *big("edge_sign"))


def contact_qc(spark, sf_dir):
    s = contacts.edge_summary(contact_edges(spark, sf_dir), CONTACT)
    return s.select(*big("edges", "retained_edges", "max_contacts"), *(r6(c).alias(c) for c in ("retained_fraction", "mean_confidence", "mean_contacts")))


def orient_components(spark, sf_dir):
    t, _ = contacts.orient(contacts.retained(contact_edges(spark, sf_dir), CONTACT))
    return t.select("component", *big("orientation"), "hic_ps")


def apply_orientation(spark, sf_dir):
    phases = tau(spark, sf_dir).select("snp_idx", F.col("tau").alias("delta"), F.expr("snp_idx div 7").alias("ps"))
    t = phases.select(F.col("ps").cast("string").alias("component")).distinct().where("cast(component as int) % 4 <> 3")
    t = t.withColumn("orientation", F.when(F.col("component").cast("int") % 2 == 0, 1).otherwise(-1)).withColumn("hic_ps", F.expr("cast(cast(component as int) div 2 as string)"))
    return contacts.apply_orientation(phases, t).select(*big("snp_idx", "delta"), "ps")


def phase_errors(spark, sf_dir):
    e = evaluate.phase_errors(truth(spark, sf_dir), pred(spark, sf_dir))
    return e.select(*big("covered_variants", "assessed_pairs", "switches", "hamming", "hamming_denominator"), r6("switch_error_rate").alias("switch_error_rate"), r6("hamming_error_rate").alias("hamming_error_rate"))


def span_n50(spark, sf_dir):
    return evaluate.span_n50(pred(spark, sf_dir)).select(r6("n50_kb").alias("n50_kb"))


def block_n50(spark, sf_dir):
    return evaluate.block_n50(interleaved(spark, sf_dir)).select(r6("n50_kb").alias("n50_kb"))


def completeness(spark, sf_dir):
    t = truth(spark, sf_dir)
    row = evaluate.metrics_row("grounded", t, pred(spark, sf_dir), evaluate.het_count(records(spark, sf_dir)), t.agg(F.count("*").alias("het")))
    return row.select("method", r6("phasing_completeness_percent").alias("phasing"), r6("SNP_completeness_percent").alias("snp"), *big("phased_snps", "input_het_snps", "truth_het_snps"))


def key_intersection(spark, sf_dir):
    return evaluate.shared_keys(pred(spark, sf_dir), truth(spark, sf_dir)).select("chrom", *big("pos"), "ref", "alt")


def chunking(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey % 97 < 40").select(F.lit("chr1").alias("chrom"), (F.col("p_partkey") * 100 + 70).alias("pos1"), F.col("p_partkey").alias("snp_idx"))
    return observe.site_chunks(p, 1500).select(*big("snp_idx", "chunk"))


def solver(spark, sf_dir):
    """All blocks of the dense grounding with a candidate each; held against exact optima in the tests."""
    h = materialize(hyper(spark, sf_dir), "hyper")
    n = h.agg(F.max("hyper")).first()[0]
    n_hyper = 0 if n is None else n + 1
    n_blocks = labels(spark, sf_dir).count()
    j = materialize(coupling.ising_coupling(h, soft(spark, sf_dir), n_hyper), "coupling")
    found = solve.solve(j, n_hyper, n_blocks, SOLVER)
    return found.select(*big("block", "cand", "z"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        observation_weight, site_scan, interval_join, cigar_walk, dedup_best, read_snp_matrix, parity_edges, parity_edges_weighted, parity_edges_near,
        edge_risk, edge_class, edge_class_confidence, backbone_forest, read_components, hard_components, phaselet_forest, phaselet_table, consistency_margin,
        released_edges, haplotags, profiled_objective, read_projection, single_profile, hyperread_rows, soft_coupling, ising_coupling, coupling_scale,
        compressed_score, candidate_scores, candidate_select, candidate_select_global, phase_sets, holdout_split, read_index, component_edges, retained_edges, contact_qc,
        orient_components, apply_orientation, phase_errors, span_n50, block_n50, completeness, key_intersection, chunking, solver,
    )
} | {f"hyperreads_{n}": hyperreads(n) for n in NORMS}
