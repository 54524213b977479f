"""Reads as vectors over blocks, and patterns that many reads share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import canonical, capped_by_domination, normalized
from ..params import Collapse
from ..plans.tables import materialize
from .observe import dense_index


def projection(matrix: DataFrame, tau: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(read_id, block, v)``: summed signed weight of a read in each block under the backbone; zeros left out."""
    dims = tau.select("snp_idx", "tau").join(blocks.select("snp_idx", "block"), "snp_idx")
    rows = matrix.join(dims, "snp_idx").groupBy("read_id", "block").agg(F.sum(F.col("v") * F.col("tau")).alias("v"))
    return rows.where("v <> 0")


def read_vectors(projected: DataFrame) -> DataFrame:
    """``(read_id, path, vals)``: each read's blocks in order, with its values; as long as a read at most."""
    one = F.array_sort(F.collect_list(F.struct("block", "v")))
    return projected.groupBy("read_id").agg(one.alias("x")).select("read_id", F.col("x.block").alias("path"), F.col("x.v").alias("vals"))


def single_profile(vectors: DataFrame) -> DataFrame:
    """One row ``(single_reads, single_constant, multi_reads)``: reads in one block add a constant to any solution."""
    one = F.size("path") == 1
    return vectors.agg(F.count_if(one).alias("single_reads"), F.coalesce(F.sum(F.when(one, F.abs(F.col("vals")[0]))), F.lit(0.0)).alias("single_constant"), F.count_if(F.size("path") > 1).alias("multi_reads"))


def patterns(vectors: DataFrame) -> DataFrame:
    """``(path, signs, block, raw, reads)``: reads of several blocks summed by path and canonical signs."""
    multi = vectors.where(F.size("path") > 1).select("path", canonical(F.col("vals")).alias("vals"))
    keyed = multi.withColumn("signs", F.transform("vals", lambda v: F.signum(v).cast("int")))
    flat = keyed.select("path", "signs", F.posexplode("vals").alias("_at", "v"))
    summed = flat.groupBy("path", "signs", "_at").agg(F.sum("v").alias("raw"), F.count("*").alias("reads"))
    return summed.select("path", "signs", F.col("path")[F.col("_at")].alias("block"), "raw", "reads")


def hyper_matrix(pats: DataFrame, p: Collapse = Collapse()) -> DataFrame:
    """Patterns with degrees, domination and the normalised ``value``.

    The degree of a pattern is the length of its path, as none of its values is zero; those of blocks are aggregates
    joined back, so that a block in most patterns is no single task. Patterns are stored, as they are read twice, and so
    are the blocks' aggregates: their size is then known where Spark chooses whether the join deals the patterns out."""
    pats = materialize(pats, "patterns")
    per = pats.groupBy("block").agg(F.count("*").alias("block_degree"), F.sum(F.abs("raw")).alias("block_total"))
    m = pats.withColumn("degree", F.size("path")).join(materialize(per, "degrees"), "block").withColumn("domination", F.abs("raw") / F.col("block_total"))
    value = normalized(F.col("raw"), F.col("reads"), F.col("degree"), F.col("block_degree"), F.col("domination"), p)
    return m.withColumn("value", value).withColumn("capped", capped_by_domination(F.col("domination"), p))


def pattern_ids(pats: DataFrame) -> DataFrame:
    """``pats`` with ``hyper``: patterns numbered from 0 by path, then signs.

    A pattern has one row for each block of its path, so that of its least block stands for it. The rows are read twice,
    hence stored; what is reckoned from them is better added behind this, as all columns are dealt out to meet their number."""
    pats = materialize(pats, "patterns")
    ids = dense_index(pats.where(F.col("block") == F.array_min("path")).select("path", "signs"), ["path", "signs"], "hyper")
    return pats.join(ids, ["path", "signs"])


def pattern_rows(matrix: DataFrame) -> DataFrame:
    """One row for each pattern: ``(hyper, path, signs, reads, degree, raw_weight, weight)``."""
    return matrix.groupBy("hyper", "path", "signs").agg(F.max("reads").alias("reads"), F.max("degree").alias("degree"), F.sum(F.abs("raw")).alias("raw_weight"), F.sum(F.abs("value")).alias("weight"))


def domination_stats(matrix: DataFrame) -> DataFrame:
    z: Column = F.lit(0.0)
    return matrix.agg(F.coalesce(F.max("domination"), z).alias("max_domination"), F.coalesce(F.avg("domination"), z).alias("mean_domination"))
