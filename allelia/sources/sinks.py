"""Results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import fixed8
from . import bgzf


def write_tsv(df: DataFrame, path: str, order: list | None = None, force: bool = False, compressed: bool = False) -> None:
    """A folder of tab-separated files with header; sorted by range where ``order`` is given. An existing folder is an
    error unless ``force``."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite" if force else "errorifexists").csv(path, sep="\t", header=True, compression="gzip" if compressed else "none", quote="", emptyValue="", nullValue="")


def edge_file(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """Edges as they go to files: thirteen columns, numbers with eight decimals."""
    at = lambda s: sites.select(F.col("snp_idx").alias(s), F.col("snp_id").alias(f"snp_id_{s}"), F.col("chrom").alias(f"_c{s}"), F.col("pos1").alias(f"pos_{s}"))
    e = edges.join(at("i"), "i").join(at("j"), "j")
    conf = F.when(F.col("support") > 0, F.abs("score") / F.col("support")).otherwise(0.0)
    return e.select(
        F.col("i").alias("snp_i"), F.col("j").alias("snp_j"), "snp_id_i", "snp_id_j", F.col("_ci").alias("chrom"), "pos_i", "pos_j", F.abs(F.col("pos_j") - F.col("pos_i")).alias("distance_bp"),
        fixed8(F.col("score")).alias("score"), fixed8(F.col("support")).alias("support"), F.col("cnt").alias("count"), fixed8(conf).alias("confidence"), fixed8(F.col("max_abs")).alias("max_abs_contribution"))


def observation_file(obs: DataFrame) -> DataFrame:
    short = lambda c: F.format_string("%.8g", F.col(c).cast("double"))
    return obs.select("read_id", "snp_id", F.col("b").alias("b_ki"), "baseq", "mapq", short("epsilon").alias("epsilon"), short("weight").alias("weight"))


def component_edge_file(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("ci").alias("component_i"), F.col("cj").alias("component_j"), "score", "abs_score", "contacts", F.col("same").alias("same_support"), F.col("opposite").alias("opposite_support"), "confidence")


def orientation_file(table: DataFrame) -> DataFrame:
    return table.select(F.col("component").alias("component_id"), "orientation", "hic_ps").orderBy(F.length("component_id"), "component_id")


def write_vcf(head: list[str], lines: DataFrame, path: str, force: bool = False) -> tuple[int, int]:
    """(written, skipped): one bgzip file of VCF text, records in file order, with a tabix index beside it."""
    kept = lines.where("written")
    rows = kept.select("ordinal", F.concat("line", F.lit("\n")).cast("binary").alias("data"), "chrom", "start", "end")
    n = bgzf.write(("\n".join(head) + "\n").encode(), rows, path, "tbi", force=force)
    return n, lines.where("not written").count()


def metric_rows(row: DataFrame) -> DataFrame:
    """A one-row table as ``(metric, value)`` lines, in the order of its columns."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns))
    return row.select(F.inline(pairs))


def edge_rows(classes: DataFrame, sites: DataFrame) -> DataFrame:
    """Classified edges as debug rows of sixteen columns."""
    at = lambda s: sites.select(F.col("snp_idx").alias(s), F.col("snp_id").alias(f"snp_id_{s}"), F.col("pos1").alias(f"pos_{s}"))
    e = classes.join(at("i"), "i").join(at("j"), "j")
    return e.select(
        F.col("i").alias("snp_i"), F.col("j").alias("snp_j"), "snp_id_i", "snp_id_j", "pos_i", "pos_j", "distance_bp", fixed8(F.col("score")).alias("score"), fixed8(F.col("support")).alias("support"),
        F.col("cnt").alias("count"), fixed8(F.col("confidence")).alias("confidence"), fixed8(F.col("conflict")).alias("conflict"), fixed8(F.col("domination")).alias("domination"), fixed8(F.col("risk")).alias("risk"), "edge_class", "status")


def soft_edge_rows(classes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Soft edges between blocks as debug rows of nine columns."""
    at = lambda s: blocks.select(F.col("snp_idx").alias(s), F.col("block").alias(f"block_{s}"))
    e = classes.where(F.col("edge_class").startswith("soft")).join(at("i"), "i").join(at("j"), "j").where("block_i <> block_j")
    return e.select("block_i", "block_j", F.col("i").alias("snp_i"), F.col("j").alias("snp_j"), fixed8(F.col("score")).alias("score"), fixed8(F.col("support")).alias("support"), F.col("cnt").alias("count"), fixed8(F.col("risk")).alias("risk"), "status")
