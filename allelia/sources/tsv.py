"""Tab-separated tables with a header; ``.gz`` by suffix."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.evidence import site_parts
from ..operators.observe import dense_index
from ..operators.parity import file_edges


#: Bits of a row's place in its task, and bytes of a file's pieces that ordinals tell apart.
_PLACE, _PIECE = 33, 1 << 16


def _by_numbers(name: str) -> list:
    """A key that sorts part 10 of a folder behind part 9."""
    return [int(x) if x.isdigit() else x for x in re.split("([0-9]+)", name)]


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, blank lines left out, with ``_ordinal`` in file order: files by name, their numbers as numbers.

    Spark deals out pieces of files by size, so a row's task says nothing about its place in the folder. Ordinals go by
    file, piece of it and then row; the driver lists names and sizes. Pieces below 64 kB within a file are an error."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    files, firsts, at = spark.read.format("binaryFile").load(path).select("_metadata.file_path", "_metadata.file_size").collect(), [], 0
    for f in sorted(files, key=lambda f: _by_numbers(f.file_path)):
        firsts.append((f.file_path, at))
        at += f.file_size // _PIECE + 1
    if at >> 63 - _PLACE:
        raise ValueError(f"{path} is too large to number its rows")
    start, length, size = (F.col(f"_metadata.file_{c}") for c in ("block_start", "block_length", "size"))
    piece = F.when((length < _PIECE) & (start + length < size), F.raise_error(F.lit(f"pieces of {path} are too small to number its rows"))).otherwise(F.floor(start / _PIECE))
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), piece.cast("long").alias("_piece"), F.monotonically_increasing_id().alias("_row"))
    ordinal = F.shiftleft(F.col("_first") + F.col("_piece"), _PLACE).bitwiseOR(F.col("_row").bitwiseAND(F.lit((1 << _PLACE) - 1)))
    return rows.join(F.broadcast(spark.createDataFrame(firsts, "_file string, _first long")), "_file").select(*df.columns, ordinal.alias("_ordinal"))


def observations(spark: SparkSession, path: str, weighted: bool = False, weight: str = "weight") -> DataFrame:
    """``(read_id, snp_id, b, weight, ordinal)``; weights are 1 unless asked for, and then their column must be there."""
    df = read(spark, path)
    if weighted and weight not in df.columns:
        raise ValueError(f"{path} has no column {weight!r}")
    w = F.col(weight).cast("double") if weighted else F.lit(1.0)
    return df.select("read_id", "snp_id", F.col("b_ki").cast("int").alias("b"), w.alias("weight"), F.col("_ordinal").alias("ordinal"))


def indexed(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations with ``snp_idx``, sites): the observed sites numbered by chromosome, position and id."""
    s = site_parts(F.col("snp_id"))
    found = obs.select("snp_id").distinct().select("snp_id", *(c.alias(n) for n, c in s.items()))
    sites = dense_index(found, ["chrom", "pos1", "snp_id"], "snp_idx").select(F.col("snp_idx").cast("int").alias("snp_idx"), "snp_id", "chrom", "pos1", "ref", "alt")
    return obs.join(sites.select("snp_id", "snp_idx"), "snp_id"), sites


def phases(spark: SparkSession, path: str) -> DataFrame:
    """``(snp_id, delta, ps)``; an empty, NA or . phase set, or no such column, is null."""
    df = read(spark, path)
    name = next((c for c in ("ps", "PS") if c in df.columns), None)
    ps = F.when(~F.col(name).isin("", "NA", "."), F.col(name).cast("double").cast("long")) if name else F.lit(None).cast("long")
    return df.select("snp_id", F.col("delta").cast("int").alias("delta"), ps.alias("ps"))


def parity_edges(spark: SparkSession, path: str, sites: DataFrame | None = None) -> DataFrame:
    """Edges of a file, by site id where ``sites`` is given, else by the file's own numbers; an unknown site is an error."""
    df = read(spark, path).withColumnRenamed("_ordinal", "ordinal")
    max_abs = F.col("max_abs_contribution").cast("double") if "max_abs_contribution" in df.columns else F.lit(None).cast("double")
    e = df.select(*(F.col(c).cast("double").alias(c) for c in ("score", "support")), F.col("count").cast("long").alias("cnt"), max_abs.alias("max_abs"), "ordinal", *(c for c in ("snp_id_i", "snp_id_j", "snp_i", "snp_j") if c in df.columns))
    if sites is None:
        return file_edges(e.select(F.col("snp_i").cast("int").alias("i"), F.col("snp_j").cast("int").alias("j"), "score", "support", "cnt", "max_abs", "ordinal"))
    at = lambda s: sites.select(F.col("snp_id").alias(f"snp_id_{s}"), F.col("snp_idx").alias(s))
    j = e.join(at("i"), "snp_id_i", "left").join(at("j"), "snp_id_j", "left")
    known = lambda s: F.when(F.col(s).isNotNull(), F.col(s)).otherwise(F.raise_error(F.concat(F.lit("unknown site "), F.col(f"snp_id_{s}"))))
    return file_edges(j.select(known("i").alias("i"), known("j").alias("j"), "score", "support", "cnt", "max_abs", "ordinal"))


def component_edges(spark: SparkSession, path: str) -> DataFrame:
    df = read(spark, path)
    num = ("score", "abs_score", "confidence")
    return df.select(F.col("component_i").alias("ci"), F.col("component_j").alias("cj"), *(F.col(c).cast("double").alias(c) for c in num), F.col("contacts").cast("long").alias("contacts"), F.col("same_support").cast("double").alias("same"), F.col("opposite_support").cast("double").alias("opposite"))


def orientations(spark: SparkSession, path: str) -> DataFrame:
    """``(component, orientation, hic_ps)``; without a phase set the component itself."""
    df = read(spark, path)
    own = F.coalesce(F.nullif(F.col("hic_ps"), F.lit("")), F.col("component_id")) if "hic_ps" in df.columns else F.col("component_id")
    return df.select(F.col("component_id").alias("component"), F.col("orientation").cast("int").alias("orientation"), own.alias("hic_ps"))


#: Rows of a metric/value file that the driver takes in.
KEY_VALUES = 10_000


def key_values(spark: SparkSession, path: str, limit: int = KEY_VALUES) -> dict[str, str]:
    """A small metric/value file; empty if there is no such file, an error if it has more than ``limit`` rows."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.csv(path, sep="\t", header=True).limit(limit + 1).collect()
    except AnalysisException:
        return {}
    if len(rows) > limit:
        raise ValueError(f"{path} has more than {limit} rows")
    return {r[0]: r[1] for r in rows}
