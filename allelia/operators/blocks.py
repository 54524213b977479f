"""Backbone, consistency of sites with their reads, and blocks of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, spanning_forest
from .observe import dense_index
from .parity import adjacent_pairs


def backbone(sites: DataFrame, obs: DataFrame, weighted: bool = False, order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """``(snp_idx, tau, root)``: signs along the signed maximum-spanning forest of adjacent-site parities.

    No distance limit; edges that sum to zero join nothing; equal scores go by first sight: the first read (by its
    least ordinal), then the left site. The least site of each tree is +1."""
    pairs = adjacent_pairs(obs, order)
    gamma = F.least("w_i", "w_j") if weighted else F.lit(1.0)
    seen = F.min(order[0]).over(Window.partitionBy("read_id"))
    pairs = pairs.withColumn("_seen", seen)
    edges = pairs.groupBy("i", "j").agg(F.sum(gamma * F.col("s")).alias("score"), F.min(F.struct("_seen", "i")).alias("_f")).where("score <> 0")
    e = edges.select(F.col("i").alias("u"), F.col("j").alias("v"), F.abs("score").alias("weight"), F.signum("score").cast("int").alias("sign"), F.col("_f._seen").alias("t1"), F.col("_f.i").alias("t2"), F.col("j").alias("t3"))
    signed, _ = spanning_forest(sites.select(F.col("snp_idx").alias("node")), e, ["t1", "t2", "t3"])
    return signed.select(F.col("node").alias("snp_idx"), F.col("sign").alias("tau"), "root")


def hard_forest(sites: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and statuses of the hard edges: ``(snp_idx, root)``, and the hard edges with ``hard_retained`` or ``hard_cycle``."""
    hard = classes.where("edge_class = 'hard'").select(F.col("i").alias("u"), F.col("j").alias("v"), F.abs("score").alias("weight"), F.lit(1).alias("sign"))
    signed, marked = spanning_forest(sites.select(F.col("snp_idx").alias("node")), hard.withColumns({"t1": F.col("u"), "t2": F.col("v")}), ["t1", "t2"])
    status = marked.select(F.col("u").alias("i"), F.col("v").alias("j"), F.when(F.col("in_forest"), "hard_retained").otherwise("hard_cycle").alias("status"))
    return signed.select(F.col("node").alias("snp_idx"), "root"), status


def consistency_margin(matrix: DataFrame, tau: DataFrame) -> DataFrame:
    """``(snp_idx, margin)``: how far each site agrees with what the rest of each of its reads says of it.

    A read of one site says nothing. ``matrix(read_id, snp_idx, v)``; sites without reads have margin 0."""
    m = matrix.join(tau.select("snp_idx", "tau"), "snp_idx").withColumn("_f", F.sum(F.col("v") * F.col("tau")).over(Window.partitionBy("read_id")))
    votes = m.groupBy("snp_idx").agg(F.sum(F.col("tau") * F.col("v") * F.signum(F.col("_f") - F.col("v") * F.col("tau"))).alias("margin"))
    return tau.select("snp_idx").join(votes, "snp_idx", "left").select("snp_idx", F.coalesce("margin", F.lit(0.0)).alias("margin"))


def suspects(margins: DataFrame) -> DataFrame:
    return margins.where("margin < 0").select("snp_idx")


def released(edges: DataFrame, bad: DataFrame) -> DataFrame:
    """Edges that touch a suspect site."""
    kept = untouched(edges, bad).select("i", "j")
    return edges.join(kept, ["i", "j"], "left_anti")


def untouched(edges: DataFrame, bad: DataFrame) -> DataFrame:
    """Edges with no suspect site at either end."""
    for side in ("i", "j"):
        edges = edges.join(bad.select(F.col("snp_idx").alias(side)), side, "left_anti")
    return edges


def relaxed_blocks(sites: DataFrame, classes: DataFrame, margins: DataFrame) -> DataFrame:
    """``(snp_idx, root)``: components of the hard edges that touch no suspect; the backbone stays as it is."""
    hard = untouched(classes.where("edge_class = 'hard'").select("i", "j"), suspects(margins))
    found = components(sites.select(F.col("snp_idx").alias("node")), hard.select(F.col("i").alias("u"), F.col("j").alias("v")))
    return found.select(F.col("node").alias("snp_idx"), "root")


def numbered_blocks(roots: DataFrame) -> DataFrame:
    """``(snp_idx, block)``: blocks numbered from 0 by their least site, which is their root."""
    ids = dense_index(roots.select("root").distinct(), ["root"], "block")
    return roots.join(ids, "root").select("snp_idx", F.col("block").cast("int").alias("block"))


def block_table(blocks: DataFrame, sites: DataFrame) -> DataFrame:
    """``(block, chrom, start, end, n_sites)``: of each block the first and last site in index order."""
    b = blocks.join(sites.select("snp_idx", "chrom", "pos1"), "snp_idx")
    return b.groupBy("block").agg(F.min_by("chrom", "snp_idx").alias("chrom"), F.min_by("pos1", "snp_idx").alias("start"), F.max_by("pos1", "snp_idx").alias("end"), F.count("*").alias("n_sites"))


def read_labels(matrix: DataFrame, delta: DataFrame) -> DataFrame:
    """``(read_id, f, sigma)``: each read's field under the phases and its side; zero is +1."""
    m = matrix.join(delta.select("snp_idx", "delta"), "snp_idx")
    return m.groupBy("read_id").agg(F.sum(F.col("v") * F.col("delta")).alias("f")).withColumn("sigma", F.when(F.col("f") < 0, -1).otherwise(1))


def read_objective(matrix: DataFrame, delta: DataFrame) -> DataFrame:
    """One row ``(objective, total, disagreement)``: the summed fields of all reads, and half of what they miss."""
    f = read_labels(matrix, delta).agg(F.coalesce(F.sum(F.abs("f")), F.lit(0.0)).alias("objective"))
    t = matrix.agg(F.coalesce(F.sum(F.abs("v")), F.lit(0.0)).alias("total"))
    return f.crossJoin(t).withColumn("disagreement", (F.col("total") - F.col("objective")) / 2)  # one row by one row
