"""Whole plans: reads and sites to phases, contacts to longer phase sets, phases against a truth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, collapse, contacts, coupling, evaluate, observe, parity, risk, select, solve
from ..operators.graph import components
from ..params import Params
from .tables import materialize


@dataclass
class Phasing:
    """Tables of a solved region. ``phases(snp_idx, delta, ps)``, ``haplotags(read_id, sigma)``; the rest by stage."""

    sites: DataFrame
    obs: DataFrame
    edges: DataFrame
    tau: DataFrame
    classes: DataFrame
    margins: DataFrame
    blocks: DataFrame
    hyper: DataFrame
    soft: DataFrame
    coupling: DataFrame
    samples: DataFrame
    phases: DataFrame
    haplotags: DataFrame
    mode: str

    def views(self) -> None:
        """Every stage as a temporary view, for SQL."""
        for name in ("sites", "obs", "edges", "tau", "classes", "margins", "blocks", "hyper", "soft", "coupling", "samples", "phases", "haplotags"):
            getattr(self, name).createOrReplaceTempView(f"phasing_{name}")

    def summary(self) -> DataFrame:
        """One row of counts and sizes."""
        size = self.blocks.groupBy("block").count()
        return (
            self.sites.agg(F.count("*").alias("sites")).crossJoin(self.obs.agg(F.count("*").alias("observations"), F.countDistinct("read_id").alias("reads")))
            .crossJoin(size.agg(F.count("*").alias("blocks"), F.max("count").alias("largest_block"), F.median("count").alias("median_block")))
            .crossJoin(self.classes.agg(F.count_if(F.col("edge_class") == "hard").alias("hard_edges"), F.count_if(F.col("edge_class").startswith("soft")).alias("soft_edges"), F.count_if("weak").alias("weak_edges"), F.count_if("conflicting").alias("conflicting_edges")))
            .crossJoin(self.hyper.agg(F.countDistinct("hyper").alias("patterns")))
            .crossJoin(self.margins.agg(F.count_if(F.col("margin") < 0).alias("suspects")))
            .crossJoin(blocks.read_objective(parity.read_site_matrix(self.obs), self.phases))
            .withColumn("mode", F.lit(self.mode))
        )


def phase(obs: DataFrame, sites: DataFrame, p: Params = Params(), validation: DataFrame | None = None, validation_weight: float = 1.0) -> Phasing:
    """``obs(read_id, snp_idx, b, weight, ordinal)`` and ``sites(snp_idx, snp_id, chrom, pos1, ...)`` → phases.

    ``validation(read_id, validation)`` keeps reads out of the graph; they still count, by ``validation_weight``, when
    candidates are chosen. Backbone signs come from all pairs, classes from near ones; the solve is one round after
    sites that their reads disagree with have been released."""
    obs, sites = materialize(obs, "obs"), materialize(sites, "sites")
    matrix = parity.read_site_matrix(obs, p.weighted)
    train, weights = obs, None
    if validation is not None:
        train = obs.join(validation.where("NOT validation").select("read_id"), "read_id", "left_semi")
        weights = validation.select("read_id", F.when(F.col("validation"), float(validation_weight)).otherwise(1.0).alias("weight"))
    tau = materialize(blocks.backbone(sites, train, p.weighted), "tau")
    edges = materialize(parity.parity_edges(train, sites, p.hard.max_distance, p.weighted), "edges")
    classes = materialize(risk.classify(risk.with_signs(risk.measured(edges, sites, p.risk), tau), p.hard, p.soft), "classes")
    margins = materialize(blocks.consistency_margin(matrix, tau), "margins")
    found = materialize(blocks.numbered_blocks(blocks.relaxed_blocks(sites, classes, margins)), "blocks")
    train_matrix = parity.read_site_matrix(train, p.weighted)
    vectors = collapse.read_vectors(collapse.projection(train_matrix, tau, found))
    hyper = materialize(collapse.hyper_matrix(collapse.pattern_ids(collapse.patterns(vectors)), p.collapse), "hyper")
    soft = materialize(coupling.soft_coupling(classes, found, p.soft), "soft")
    count = lambda df, c: (lambda top: 0 if top is None else top + 1)(df.agg(F.max(c)).first()[0])
    n_hyper, n_blocks = count(hyper, "hyper"), count(found, "block")
    j = materialize(coupling.ising_coupling(hyper, soft, n_hyper), "coupling")
    samples = materialize(solve.solve(j, n_hyper, n_blocks, p.solver), "samples")
    every = found.select("block").distinct()
    nodes = every.select((F.col("block") + n_hyper).cast("long").alias("node"))
    labels = components(nodes, _between_blocks(j, n_hyper)).select((F.col("node") - n_hyper).cast("int").alias("block"), F.col("root").alias("component"))
    labels = materialize(labels, "labels")
    alone = every.join(samples, "block", "left_anti").select("block", F.lit(0).alias("cand"), F.lit(1).alias("z"))
    z, mode = select.choose(collapse.projection(matrix, tau, found), samples.union(alone), labels, weights)
    ps = select.phase_sets(found, labels, sites)
    phases = found.join(z, "block").join(tau.select("snp_idx", "tau"), "snp_idx").join(ps, "snp_idx").select("snp_idx", (F.col("tau") * F.col("z")).alias("delta"), "ps")
    phases = materialize(phases, "phases")
    tags = blocks.read_labels(matrix, phases).select("read_id", "sigma")
    return Phasing(sites, obs, edges, tau, classes, margins, found, hyper, soft, j, samples, phases, tags, mode)


def _between_blocks(coupling_: DataFrame, n_hyper: int) -> DataFrame:
    """Links between blocks that have the components of the whole graph: each pattern joins its blocks to its least."""
    direct = coupling_.where((F.col("u") >= n_hyper) & (F.col("v") >= n_hyper)).select("u", "v")
    through = coupling_.where((F.col("u") < n_hyper) & (F.col("v") >= n_hyper))
    least = through.groupBy("u").agg(F.min("v").alias("_least"))
    return direct.union(through.join(least, "u").select(F.col("v").alias("u"), F.col("_least").alias("v")))


def edge_statuses(found: Phasing) -> DataFrame:
    """``(i, j, status)`` of all classified edges; hard ones by the forest, or released where they touch a suspect."""
    _, forest = blocks.hard_forest(found.sites, found.classes)
    bad = blocks.suspects(found.margins)
    gone = blocks.released(forest.select("i", "j"), bad).withColumn("_gone", F.lit(True))
    hard = forest.join(gone, ["i", "j"], "left").select("i", "j", F.when(F.col("_gone"), "read_consistency_released").otherwise(F.col("status")).alias("status"))
    return found.classes.where("edge_class <> 'hard'").select("i", "j", "status").union(hard)


def named_phases(found: Phasing) -> DataFrame:
    """``(snp_id, delta, ps)`` for export."""
    return found.phases.join(found.sites.select("snp_idx", "snp_id"), "snp_idx").select("snp_id", "delta", "ps")


def phase_files(spark, bam: str, vcf: str, region: str, sample: str | None = None, p: Params = Params(), out: str | None = None, force: bool = False) -> Phasing:
    """Alignments and sites of a region to phases, and a phased VCF under ``out``."""
    from ..functions.evidence import parse_region
    from ..sources import bam as bams
    from ..sources import sinks
    from ..sources import vcf as vcfs

    sites = materialize(vcfs.het_sites(spark, vcf, parse_region(region), sample), "sites")
    rows, _ = observe.observations(bams.alignments(spark, bam, region), sites, p.observing)
    found = phase(rows, sites, p)
    if out:
        head, lines = vcfs.phased_lines(spark, vcf, named_phases(found), parse_region(region), sample, 1)
        sinks.write_vcf(head, lines, f"{out}/phased.vcf.gz", force)
        sinks.write_tsv(named_phases(found), f"{out}/snp_phases.tsv", ["snp_id"], force)
        sinks.write_tsv(found.haplotags, f"{out}/haplotags.tsv", ["read_id"], force)
        sinks.write_tsv(sinks.metric_rows(found.summary()), f"{out}/summary.tsv", None, force)
    return found


def extend_by_contacts(phases: DataFrame, sites: DataFrame, alignments: DataFrame, p: Params = Params(), read_sets: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(oriented phases, component edges, orientations): phase sets joined by molecules that touch two of them."""
    c = p.contact
    table = materialize(contacts.component_sites(sites, phases, read_sets), "csites")
    edges = materialize(contacts.component_edges(contacts.anchors(alignments, table, c), c.alpha), "cedges")
    orientation, _ = contacts.orient(contacts.retained(edges, c))
    return contacts.apply_orientation(phases, orientation), edges, orientation


def benchmark(spark, input_vcf: str, truth_vcf: str, methods: list[str], region: str | None = None, input_sample: str | None = None, truth_sample: str | None = None, pred_sample: str | None = None) -> DataFrame:
    """A row of metrics for each ``NAME:VCF[:LOG,...]``."""
    from ..functions.evidence import method_spec, parse_region
    from ..sources import vcf as vcfs

    where = parse_region(region)
    in_het = materialize(evaluate.het_count(vcfs.records(spark, input_vcf, input_sample, where)), "het")
    truth_records = vcfs.records(spark, truth_vcf, truth_sample, where)
    truth_het, truth = materialize(evaluate.het_count(truth_records), "het"), materialize(evaluate.phase_calls(truth_records), "truth")
    rows = None
    for name, path, logs in map(method_spec, methods):
        pred = materialize(evaluate.phase_calls(vcfs.records(spark, path, pred_sample, where)), "pred")
        seconds = sum(evaluate.elapsed_seconds(spark.read.text(x)).first()[0] for x in logs)
        row = evaluate.metrics_row(name, truth, pred, in_het, truth_het, seconds)
        rows = row if rows is None else rows.unionByName(row)
    return rows
