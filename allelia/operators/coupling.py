"""Couplings between blocks and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import clip
from ..params import Soft


def soft_coupling(classes: DataFrame, blocks: DataFrame, p: Soft = Soft()) -> DataFrame:
    """``(l, r, coeff, support, raw)``, l below r: summed soft edges between different blocks.

    Each edge is scaled and clipped before the sum; sums of zero are left out. ``classes`` has ``expected_sign``."""
    side = lambda s: blocks.select(F.col("snp_idx").alias(s), F.col("block").alias(f"_b{s}"))
    e = classes.where(F.col("edge_class").startswith("soft")).join(side("i"), "i").join(side("j"), "j").where("_bi <> _bj")
    coeff = F.col("score") * F.col("expected_sign") * p.scale
    if p.cap > 0:
        coeff = clip(coeff, p.cap)
    out = e.groupBy(F.least("_bi", "_bj").alias("l"), F.greatest("_bi", "_bj").alias("r")).agg(F.sum(coeff).alias("coeff"), F.sum("cnt").alias("support"), F.sum(F.abs("score")).alias("raw"))
    return out.where("coeff <> 0")


def ising_coupling(hyper: DataFrame, soft: DataFrame, n_hyper: int) -> DataFrame:
    """``(u, v, w)``, both directions: patterns are nodes 0 on, blocks ``n_hyper`` on. ``hyper(hyper, block, value)``."""
    block = lambda c: (F.col(c) + n_hyper).cast("long")
    half = hyper.select(F.col("hyper").cast("long").alias("u"), block("block").alias("v"), F.col("value").alias("w")).union(soft.select(block("l").alias("u"), block("r").alias("v"), F.col("coeff").alias("w")))
    both = half.union(half.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    return both.groupBy("u", "v").agg(F.sum("w").alias("w")).where("w <> 0")


def row_sums(coupling: DataFrame) -> DataFrame:
    return coupling.groupBy("u").agg(F.sum(F.abs("w")).alias("s"))


def largest_row_sum(coupling: DataFrame) -> DataFrame:
    """One row ``(largest)``; 0 without couplings."""
    return row_sums(coupling).agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("largest"))


def compressed_score(hyper: DataFrame, soft: DataFrame, samples: DataFrame, eta: DataFrame) -> DataFrame:
    """``(cand, score)``: pattern fields under ``eta(hyper, cand, s)`` and soft couplings of ``samples(block, cand, z)``."""
    fields = hyper.join(samples, "block").groupBy("hyper", "cand").agg(F.sum(F.col("value") * F.col("z")).alias("h"))
    a = fields.join(eta, ["hyper", "cand"]).groupBy("cand").agg(F.sum(F.col("h") * F.col("s")).alias("x"))
    zl, zr = samples.select(F.col("block").alias("l"), "cand", F.col("z").alias("zl")), samples.select(F.col("block").alias("r"), "cand", F.col("z").alias("zr"))
    b = soft.join(zl, "l").join(zr, ["r", "cand"]).groupBy("cand").agg(F.sum(F.col("coeff") * F.col("zl") * F.col("zr")).alias("y"))
    return a.join(b, "cand", "full").select("cand", (F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0))).alias("score"))
