"""Choice among candidates by the reads' own objective."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialize


def fields(projected: DataFrame, samples: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``(read_id, cand, f)``: the weight of each read under each candidate; ``weights(read_id, weight)`` default to 1."""
    f = projected.join(samples, "block").groupBy("read_id", "cand").agg(F.abs(F.sum(F.col("v") * F.col("z"))).alias("f"))
    if weights is None:
        return f
    return f.join(weights, "read_id", "left").select("read_id", "cand", (F.col("f") * F.coalesce("weight", F.lit(1.0))).alias("f"))


def candidate_scores(projected: DataFrame, samples: DataFrame, labels: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``(component, cand, score)`` with ``labels(block, component)``; reads are in the component of their blocks."""
    own = projected.join(labels, "block").groupBy("read_id").agg(F.min("component").alias("component"))
    return fields(projected, samples, weights).join(own, "read_id").groupBy("component", "cand").agg(F.sum("f").alias("score"))


def separable(projected: DataFrame, labels: DataFrame) -> bool:
    """Whether no read touches blocks of two components."""
    crossing = projected.join(labels, "block").groupBy("read_id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    return crossing.isEmpty()


def _best(by: str | None) -> F.Column:
    return F.max_by("cand", F.struct(F.col("score"), -F.col("cand")))


def choose(projected: DataFrame, samples: DataFrame, labels: DataFrame, weights: DataFrame | None = None) -> tuple[DataFrame, str]:
    """``(block, z)`` and the mode. Each component takes its best candidate, the first of equals; if a read joins two
    components, all take the best one overall. Components that no read scores take candidate 0."""
    projected, samples = materialize(projected, "projected"), materialize(samples, "samples")
    if separable(projected, labels):
        scores = candidate_scores(projected, samples, labels, weights)
        picks = scores.groupBy("component").agg(_best("component").alias("cand"))
        chosen = labels.join(picks, "component", "left").select("block", F.coalesce("cand", F.lit(0)).alias("cand"))
        mode = "component_profiled_F"
    else:
        scores = fields(projected, samples, weights).groupBy("cand").agg(F.sum("f").alias("score"))
        picks = scores.agg(_best(None).alias("cand"))
        chosen = labels.select("block").crossJoin(picks)  # one row
        mode = "global_nonseparable_validation"
    return chosen.join(samples, ["block", "cand"], "left").select("block", F.coalesce("z", F.lit(1)).alias("z")), mode


def phase_sets(blocks: DataFrame, labels: DataFrame, sites: DataFrame) -> DataFrame:
    """``(snp_idx, ps)``: the least position of each site's component; an aggregate joined back."""
    s = blocks.join(labels, "block").join(sites.select("snp_idx", "pos1"), "snp_idx")
    return s.select("snp_idx", "component").join(s.groupBy("component").agg(F.min("pos1").alias("ps")), "component").select("snp_idx", "ps")


def read_components(obs: DataFrame, sites: DataFrame) -> DataFrame:
    """``(snp_idx, ps)`` by reads alone: sites that a chain of reads joins share the least position among them.

    A read's sites are linked to its least one, so the graph has one edge for each observation."""
    from .graph import components

    least = obs.groupBy("read_id").agg(F.min("snp_idx").alias("v"))
    edges = obs.join(least, "read_id").select(F.col("snp_idx").alias("u"), "v")
    found = components(obs.select(F.col("snp_idx").alias("node")).distinct(), edges)
    at = found.join(sites.select(F.col("snp_idx").alias("node"), "pos1"), "node")
    return at.join(at.groupBy("root").agg(F.min("pos1").alias("ps")), "root").select(F.col("node").alias("snp_idx"), "ps")
