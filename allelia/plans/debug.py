"""What a run found on its way, as files: tables of blocks and patterns, and archives of its matrices and signs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import fixed8
from ..operators import blocks, collapse
from ..operators.observe import dense_index
from ..sources import npz, sinks


def block_rows(found: DataFrame, sites: DataFrame) -> DataFrame:
    t = blocks.block_table(found, sites)
    return t.select(F.col("block").alias("phaselet_id"), "chrom", "start", "end", F.col("n_sites").alias("n_snps"))


def pattern_rows(hyper: DataFrame) -> DataFrame:
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c)
    rows = collapse.pattern_rows(hyper)
    return rows.select(F.col("hyper").alias("hyperread_id"), text("path"), text("signs"), F.col("reads").alias("support_reads"), "degree", fixed8(F.col("raw_weight")).alias("raw_abs_weight"))


def pattern_edge_rows(hyper: DataFrame) -> DataFrame:
    return hyper.select(F.col("hyper").alias("hyperread_id"), F.col("block").alias("phaselet_id"), fixed8(F.col("raw")).alias("raw_value"), fixed8(F.col("value")).alias("normalized_value"))


def _sizes(found: DataFrame, hyper: DataFrame) -> tuple[int, int]:
    """Blocks and patterns, by their last numbers."""
    n = found.agg(F.coalesce(F.max("block") + 1, F.lit(0)).alias("n")).crossJoin(hyper.agg(F.coalesce(F.max("hyper") + 1, F.lit(0)).alias("h"))).first()
    return n.n, n.h


def write_pattern_matrix(hyper: DataFrame, found: DataFrame, path: str, force: bool = False) -> None:
    """Values of patterns in blocks, as a sparse matrix by pattern."""
    n_blocks, n_hyper = _sizes(found, hyper)
    npz.write_sparse(hyper, n_hyper, n_blocks, path, "hyper", "block", "value", force)


def write_coupling(soft: DataFrame, found: DataFrame, path: str, force: bool = False) -> None:
    """Soft coefficients between blocks, in both directions, as a sparse matrix."""
    n = found.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]
    both = soft.select("l", "r", "coeff").union(soft.select("r", "l", "coeff"))
    npz.write_sparse(both, n, n, path, "l", "r", "coeff", force)


def write_by_site(values: DataFrame, columns: dict[str, tuple[str, str]], path: str, force: bool = False) -> None:
    """Columns of ``values(snp_idx, ...)`` as arrays in the order of the sites."""
    npz.write_arrays([(dense_index(values, ["snp_idx"], "_row"), columns)], path, force=force)


def write_debug(run, out: str, force: bool = False) -> None:
    """All of a run's debug files under ``out``: five tables and four archives. The archives need a shared disk."""
    named = run.sites.select("snp_idx", "snp_id")
    sinks.write_tsv(sinks.edge_rows(run.classes, run.sites), f"{out}/edges.tsv", ["snp_i", "snp_j"], force)
    sinks.write_tsv(sinks.soft_edge_rows(run.classes, run.blocks), f"{out}/soft_edges.tsv", ["snp_i", "snp_j"], force)
    sinks.write_tsv(block_rows(run.blocks, run.sites), f"{out}/phaselets.tsv", ["phaselet_id"], force)
    sinks.write_tsv(pattern_rows(run.hyper), f"{out}/hyperreads.tsv", ["hyperread_id"], force)
    sinks.write_tsv(pattern_edge_rows(run.hyper), f"{out}/hyperread_edges.tsv", ["hyperread_id", "phaselet_id"], force)
    write_pattern_matrix(run.hyper, run.blocks, f"{out}/hyperread_matrix.npz", force)
    write_coupling(run.soft, run.blocks, f"{out}/soft_phaselet_coupling.npz", force)
    mapping = run.blocks.join(run.tau.select("snp_idx", "tau"), "snp_idx").join(run.phases.select("snp_idx", "ps"), "snp_idx").join(named, "snp_idx")
    write_by_site(mapping, {"phaselet_ids": ("block", "<i4"), "tau": ("tau", "|i1"), "snp_ids": ("snp_id", "U"), "ps": ("ps", "<i8")}, f"{out}/phaselet_mapping.npz", force)
    write_by_site(run.margins.join(named, "snp_idx"), {"snp_ids": ("snp_id", "U"), "margin": ("margin", "<f8")}, f"{out}/read_consistency.npz", force)
