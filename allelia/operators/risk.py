"""Edge measures and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import confidence, domination, edge_risk
from ..params import Hard, Risk, Soft
from .parity import with_distance


def measured(edges: DataFrame, sites: DataFrame, p: Risk = Risk()) -> DataFrame:
    """Edges with distance, confidence, conflict, domination and risk."""
    e = with_distance(edges, sites)
    e = e.withColumn("confidence", confidence(F.col("score"), F.col("support"))).withColumn("domination", domination(F.col("max_abs"), F.col("support")))
    e = e.withColumn("conflict", 1 - F.col("confidence"))
    return e.withColumn("risk", edge_risk(F.col("confidence"), F.col("cnt"), F.col("distance_bp"), F.col("domination"), p))


def with_signs(edges: DataFrame, tau: DataFrame) -> DataFrame:
    """Edges with the sign the backbone ``tau(snp_idx, tau)`` expects and whether the score has it."""
    t = lambda side: tau.select(F.col("snp_idx").alias(side), F.col("tau").alias(f"tau_{side}"))
    e = edges.join(t("i"), "i").join(t("j"), "j").withColumn("expected_sign", F.col("tau_i") * F.col("tau_j"))
    return e.withColumn("observed_sign", F.when(F.col("score") < 0, -1).otherwise(1)).withColumn("sign_ok", F.col("score") * F.col("expected_sign") > 0)


def _hard_filter(h: Hard) -> Column:
    if h.mode not in ("risk", "confidence"):
        raise ValueError(f"no such mode: {h.mode}")
    return F.col("confidence") >= h.min_confidence if h.mode == "confidence" else F.col("risk") <= h.max_risk


def classify(edges: DataFrame, h: Hard = Hard(), s: Soft = Soft()) -> DataFrame:
    """``edges`` of :func:`with_signs` → with ``edge_class`` (hard, soft, soft_conflicting_tau, drop) and ``status``.

    Edges beyond the distance limit vanish. ``conflicting`` marks edges that pass but disagree with the backbone, even
    if they couple softly; ``weak`` the dropped ones that fail a hard test. Hard edges get their status from the
    forest; until then it is ``hard``."""
    support = (F.col("support") >= h.min_support) & (F.col("cnt") >= h.min_count)
    passes = _hard_filter(h)
    soft = F.lit(False) if s.mode == "none" else (F.col("support") >= s.min_support) & (F.col("cnt") >= s.min_count) & (F.col("confidence") >= s.min_confidence) & (F.col("risk") <= s.max_risk)
    kind = F.when(support & passes & F.col("sign_ok"), "hard").when(soft & F.col("sign_ok"), "soft").when(soft, "soft_conflicting_tau").otherwise("drop")
    reason = F.when(~support, "drop_weak_hard_support").when(~passes, "drop_weak_hard_confidence" if h.mode == "confidence" else "drop_high_hard_risk").when(~F.col("sign_ok"), "drop_conflicting_tau").otherwise("drop_noisy_soft")
    status = F.when(F.col("edge_class") == "soft", "soft_bridge").when(F.col("edge_class") == "soft_conflicting_tau", "soft_bridge_conflicting_tau").when(F.col("edge_class") == "hard", "hard").otherwise(reason)
    e = edges.where(F.col("distance_bp") <= h.max_distance).withColumn("edge_class", kind).withColumn("status", status)
    e = e.withColumn("conflicting", support & passes & ~F.col("sign_ok"))
    return e.withColumn("weak", F.col("status").isin("drop_weak_hard_support", "drop_weak_hard_confidence", "drop_high_hard_risk"))


def risk_stats(classes: DataFrame, forest: DataFrame) -> DataFrame:
    """One row: mean and greatest risk of the retained edges of ``forest(i, j, status)`` and of the soft ones; zeros if none."""
    kept = forest.where("status = 'hard_retained'").select("i", "j", F.lit(True).alias("_kept"))
    e = classes.join(kept, ["i", "j"], "left")
    risk_of = {"retained": F.when(F.col("_kept"), F.col("risk")), "soft": F.when(F.col("edge_class").startswith("soft"), F.col("risk"))}
    return e.agg(*(F.coalesce(f(c), F.lit(0.0)).alias(f"{n}_{k}_risk") for k, c in risk_of.items() for n, f in (("mean", F.avg), ("max", F.max))))
