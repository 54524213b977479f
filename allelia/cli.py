"""``python -m allelia COMMAND``: whole runs from the shell, on the session that spark-submit or the environment gives."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from dataclasses import asdict, fields, replace
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.evidence import parse_region
from .operators import blocks, contacts, observe, parity
from .operators.select import read_components
from .params import Params
from .plans import debug, phasing
from .plans.tables import materialize
from .sources import bam, npz, sinks, tsv, vcf


def settings(args: argparse.Namespace) -> Params:
    """The defaults with every ``--set part.name=value`` in place; ``weighted`` has no part."""
    p = Params()
    for item in args.set or []:
        key, _, value = item.partition("=")
        part, _, name = key.rpartition(".")
        owner = getattr(p, part) if part else p
        if name not in {f.name for f in fields(owner)}:
            raise SystemExit(f"no setting {key!r}")
        old = getattr(owner, name)
        new = value.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(value)
        p = replace(p, **{part: replace(owner, **{name: new})}) if part else replace(p, **{name: new})
    return p


def manifest(args: argparse.Namespace, p: Params) -> str:
    """What was run, with what: arguments, settings, versions, checksums of the sources."""
    here = Path(__file__).resolve().parent
    found = {}
    for name in ("pyspark", "pyarrow", "numpy"):
        try:
            found[name] = version(name)
        except PackageNotFoundError:
            continue
    rows = {k: str(v) for k, v in vars(args).items() if k != "run"}
    sums = {str(f.relative_to(here)): hashlib.sha256(f.read_bytes()).hexdigest() for f in sorted(here.rglob("*.py"))}
    return json.dumps({"python": sys.version, "arguments": rows, "settings": asdict(p), "versions": found, "sources": sums}, indent=2)


def load(spark: SparkSession, path: str, weighted: bool):
    """(observations, sites) of a TSV or an archive."""
    return npz.graph(spark, path, weighted) if path.endswith(".npz") else tsv.indexed(tsv.observations(spark, path, weighted))


def run(spark, a, p):
    phasing.phase_files(spark, a.bam, a.vcf, a.region, a.sample, p, a.out, a.force)
    spark.createDataFrame([(manifest(a, p),)], "value string").coalesce(1).write.mode("overwrite" if a.force else "errorifexists").text(f"{a.out}/manifest")


def extract(spark, a, p):
    where = parse_region(a.region)
    sites = materialize(vcf.het_sites(spark, a.vcf, where, a.sample), "sites")
    rows, counts = observe.observations(bam.alignments(spark, a.bam, a.region), sites, p.observing)
    rows = materialize(rows, "obs")
    reads = observe.read_index(rows)
    sinks.write_tsv(sinks.observation_file(rows), f"{a.out}.observations.tsv", None, a.force, True)
    sinks.write_tsv(sinks.edge_file(parity.parity_edges(rows, weighted=p.weighted), sites), f"{a.out}.parity_edges.tsv", ["snp_i", "snp_j"], a.force, True)
    sinks.write_tsv(sites.drop("snp_idx"), f"{a.out}.snps.tsv", ["chrom", "pos1"], a.force)
    sinks.write_tsv(reads, f"{a.out}.reads.tsv", ["read_idx"], a.force)
    sinks.write_tsv(sinks.metric_rows(counts), f"{a.out}.summary.tsv", None, a.force)
    if a.npz:
        npz.write(rows, sites, reads, f"{a.out}.npz", a.force)


def backbone(spark, a, p):
    obs, sites = load(spark, a.observations, p.weighted)
    tau = blocks.backbone(sites, obs, p.weighted).select("snp_idx", F.col("tau").alias("delta"))
    matrix = materialize(parity.read_site_matrix(obs, p.weighted), "matrix")
    sinks.write_tsv(tau.join(sites.select("snp_idx", "snp_id"), "snp_idx").select("snp_id", "delta"), f"{a.out}.snp_phases.tsv", ["snp_id"], a.force)
    sinks.write_tsv(blocks.read_labels(matrix, tau).select("read_id", "sigma"), f"{a.out}.read_haplotags.tsv", ["read_id"], a.force)
    sinks.write_tsv(sinks.metric_rows(blocks.read_objective(matrix, tau)), f"{a.out}.summary.tsv", None, a.force)


def solve(spark, a, p):
    obs, sites = load(spark, a.observations, p.weighted)
    held = observe.held_out(obs, a.validation, a.salt) if a.validation else None
    found = phasing.phase(obs, sites, p, held, a.validation_weight)
    sinks.write_tsv(phasing.named_phases(found), f"{a.out}/snp_phases.tsv", ["snp_id"], a.force)
    sinks.write_tsv(found.haplotags, f"{a.out}/haplotags.tsv", ["read_id"], a.force)
    summary = materialize(found.summary(), "summary")
    sinks.write_tsv(sinks.metric_rows(summary), f"{a.out}/summary.tsv", None, a.force)
    sinks.write_tsv(summary, f"{a.out}/config_metrics.tsv", None, a.force)
    print("\n".join(f"{k}\t{v}" for k, v in summary.first().asDict().items()))
    if a.debug:
        debug.write_debug(found, f"{a.out}/debug", a.force)
        for name in ("edges", "classes", "margins", "blocks", "hyper", "soft", "coupling", "samples"):
            getattr(found, name).write.mode("overwrite" if a.force else "errorifexists").parquet(f"{a.out}/debug/{name}")


def export(spark, a, p):
    ps = tsv.phases(spark, a.phases)
    if a.observations:
        obs, sites = load(spark, a.observations, False)
        sets = read_components(obs, sites).join(sites.select("snp_idx", "snp_id"), "snp_idx").select("snp_id", F.col("ps").alias("_ps"))
        ps = ps.join(sets, "snp_id", "left").select("snp_id", "delta", F.coalesce("ps", "_ps").alias("ps"))
    head, lines = vcf.phased_lines(spark, a.vcf, ps, parse_region(a.region), a.sample, a.ps_start)
    sinks.write_vcf(head, lines, a.out if a.out.endswith(".gz") else f"{a.out}.gz", a.force)


def benchmark(spark, a, p):
    rows = phasing.benchmark(spark, a.vcf, a.truth, a.method, a.region, a.sample, a.truth_sample, a.pred_sample)
    sinks.write_tsv(rows, a.out, None, a.force)


def _phased(spark, a):
    obs, sites = load(spark, a.observations, False)
    phases = tsv.phases(spark, a.phases).join(sites.select("snp_idx", "snp_id"), "snp_id").select("snp_idx", "delta", "ps")
    return obs, sites, phases


def hic_edges(spark, a, p):
    obs, sites, phases = _phased(spark, a)
    table = materialize(contacts.component_sites(sites, phases, read_components(obs, sites)), "csites")
    found = contacts.anchors(bam.alignments(spark, a.bam, a.region), table, p.contact)
    sinks.write_tsv(sinks.component_edge_file(contacts.component_edges(found, p.contact.alpha)), a.out, ["component_i", "component_j"], a.force)


def hic_orient(spark, a, p):
    table, chosen = contacts.orient(contacts.retained(tsv.component_edges(spark, a.edges), p.contact))
    sinks.write_tsv(sinks.orientation_file(table), f"{a.out}.orientations.tsv", None, a.force)
    sinks.write_tsv(chosen, f"{a.out}.selected_edges.tsv", ["ci", "cj"], a.force)


def hic_apply(spark, a, p):
    obs, sites, phases = _phased(spark, a)
    if phases.where("ps is null").limit(1).count():
        phases = phases.drop("ps").join(read_components(obs, sites), "snp_idx")
    done = contacts.apply_orientation(phases, tsv.orientations(spark, a.orientations)).join(sites.select("snp_idx", "snp_id"), "snp_idx").select("snp_id", "delta", "ps")
    done = materialize(done, "oriented")
    sinks.write_tsv(done, f"{a.out}/snp_phases.tsv", ["snp_id"], a.force)
    head, lines = vcf.phased_lines(spark, a.vcf, done, parse_region(a.region), a.sample, 1)
    sinks.write_vcf(head, lines, f"{a.out}/phased.vcf.gz", a.force)


def hic_qc(spark, a, p):
    sinks.write_tsv(contacts.edge_summary(tsv.component_edges(spark, a.edges), p.contact), a.out, None, a.force)


#: Commands: the function, required options, optional ones.
COMMANDS = {
    "run": (run, "bam vcf region out", "sample"),
    "extract": (extract, "bam vcf region out", "sample npz!"),
    "backbone": (backbone, "observations out", ""),
    "solve": (solve, "observations out", "validation# validation-weight# salt debug!"),
    "export": (export, "vcf phases region out", "sample observations ps-start#"),
    "benchmark": (benchmark, "vcf truth out method+", "region sample truth-sample pred-sample"),
    "hic-edges": (hic_edges, "observations phases bam region out", ""),
    "hic-orient": (hic_orient, "edges out", ""),
    "hic-apply": (hic_apply, "observations phases orientations vcf region out", "sample"),
    "hic-qc": (hic_qc, "edges out", ""),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="allelia")
    subs = top.add_subparsers(required=True, metavar="COMMAND")
    for name, (fn, required, optional) in COMMANDS.items():
        sub = subs.add_parser(name)
        sub.set_defaults(run=fn)
        sub.add_argument("--set", action="append", metavar="PART.NAME=VALUE", help="a setting of allelia.params")
        sub.add_argument("--force", action="store_true", help="overwrite what is there")
        for opt in required.split() + optional.split():
            flag, must = f"--{opt.rstrip('!#+')}", opt in required.split()
            if opt.endswith("!"):
                sub.add_argument(flag, action="store_true")
            elif opt.endswith("+"):
                sub.add_argument(flag, action="append", required=must)
            elif opt == "ps-start#":
                sub.add_argument(flag, type=int)
            elif opt.endswith("#"):
                sub.add_argument(flag, type=float, default=1.0 if opt == "validation-weight#" else 0.0)
            else:
                sub.add_argument(flag, required=must, default="validation" if opt == "salt" else None)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("allelia").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    args.run(spark, args, settings(args))
