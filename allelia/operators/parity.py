"""Signed parity of sites that a read shows one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evidence import confidence


def adjacent_pairs(obs: DataFrame, order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """``(i, j, s, w_i, w_j)`` for each observation and the next of its read by site; equal sites make no pair.

    One window over the read, the only exchange; a site seen twice keeps both places, as the last of them pairs on."""
    w = Window.partitionBy("read_id").orderBy("snp_idx", *order)
    after = F.lead(F.struct("snp_idx", "b", "weight")).over(w)
    rows = obs.select("read_id", "snp_idx", "b", "weight", *order).withColumn("_next", after).where("_next is not null and _next.snp_idx <> snp_idx")
    return rows.select("read_id", F.col("snp_idx").alias("i"), F.col("_next.snp_idx").alias("j"), (F.col("b") * F.col("_next.b")).alias("s"), F.col("weight").alias("w_i"), F.col("_next.weight").alias("w_j"), *order)


def parity_edges(obs: DataFrame, sites: DataFrame | None = None, max_distance: int | None = None, weighted: bool = False, order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """``(i, j, score, support, cnt, max_abs)``: summed agreement of adjacent sites.

    ``sites(snp_idx, pos1)`` and ``max_distance`` drop far pairs after pairing; None keeps all. Pairs count 1, or the
    lesser weight of the two."""
    pairs = adjacent_pairs(obs, order)
    gamma = F.least("w_i", "w_j") if weighted else F.lit(1.0)
    value = gamma * F.col("s")
    edges = pairs.groupBy("i", "j").agg(F.sum(value).alias("score"), F.sum(F.abs(gamma)).alias("support"), F.count("*").alias("cnt"), F.max(F.abs(gamma)).alias("max_abs"))
    if sites is None or max_distance is None:
        return edges
    # Every pair of one edge has the same distance, so the limit applies to the few edges and not to the pairs.
    return with_distance(edges, sites).where(F.col("distance_bp") <= max_distance).drop("distance_bp")


def with_distance(edges: DataFrame, sites: DataFrame) -> DataFrame:
    at = lambda side: sites.select(F.col("snp_idx").alias(side), F.col("pos1").alias(f"_{side}"))
    return edges.join(at("i"), "i").join(at("j"), "j").withColumn("distance_bp", F.abs(F.col("_j") - F.col("_i"))).drop("_i", "_j")


def with_confidence(edges: DataFrame) -> DataFrame:
    return edges.withColumn("confidence", confidence(F.col("score"), F.col("support")))


def read_site_matrix(obs: DataFrame, weighted: bool = False, unique: bool = False) -> DataFrame:
    """``(read_id, snp_idx, v)``: summed signed weight; repeated observations add up.

    With ``unique`` there are none, as ``best_per_read_site`` leaves it, and no task holds tables of its reads to see that."""
    value = F.col("weight") * F.col("b") if weighted else F.col("b").cast("double")
    if unique:
        return obs.select("read_id", "snp_idx", value.alias("v"))
    return obs.groupBy("read_id", "snp_idx").agg(F.sum(value).alias("v"))


def file_edges(edges: DataFrame) -> DataFrame:
    """Edges of a file: loops dropped, i below j, a missing ``max_abs`` taken as the mean; of repeats the last (by ``ordinal``)."""
    e = edges.where("i <> j").select(
        F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "score", "support", "cnt",
        F.coalesce("max_abs", F.col("support") / F.greatest("cnt", F.lit(1))).alias("max_abs"), "ordinal")
    kept = F.max_by(F.struct("score", "support", "cnt", "max_abs"), "ordinal")
    return e.groupBy("i", "j").agg(kept.alias("e")).select("i", "j", "e.*")
