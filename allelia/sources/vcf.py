"""VCF text as tables. Headers are read by the driver, records by the executors; ``.gz`` is read as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.evidence import site_id
from ..operators.observe import dense_index
from . import bgzf

HEADER_LIMIT = 100_000


def header(spark: SparkSession, path: str) -> list[str]:
    """The header lines, the last naming the columns; an error if there is none among the first lines."""
    lines = [r.value for r in spark.read.text(path).where(F.col("value").startswith("#")).limit(HEADER_LIMIT).collect()]
    if not lines or not lines[-1].startswith("#CHROM"):
        raise ValueError(f"{path} has no #CHROM line")
    return lines


def sample_names(lines: list[str]) -> list[str]:
    return lines[-1].rstrip("\n").split("\t")[9:]


def choose_sample(lines: list[str], requested: str | None = None) -> str:
    """The requested sample, else the first; an error if there is none of the name, or none at all."""
    names = sample_names(lines)
    if not names:
        raise ValueError("the file has no samples")
    if requested and requested not in names:
        raise ValueError(f"no sample {requested!r}; the file has {names}")
    return requested or names[0]


def records(spark: SparkSession, path: str, sample: str | None = None, region: tuple[str, int, int] | None = None) -> DataFrame:
    """``(ordinal, chrom, pos, id, ref, alt, qual, filter, info, format, call, gt, ps)`` of one sample.

    ``region`` is 1-based and inclusive; a tabix index beside a file that executors can open limits what is read, else
    all of it is scanned. ``gt`` and ``ps`` are null where the record has none."""
    lines = header(spark, path)
    column = 9 + sample_names(lines).index(choose_sample(lines, sample))
    f = F.split("value", "\t")
    ranges = bgzf.tabix_ranges(path, region[0], region[1] - 1, region[2]) if region else None
    lines_ = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id()) if ranges is None else bgzf.lines_between(spark, path, ranges)
    text = lines_.where(~F.col("value").startswith("#") & (F.length("value") > 0)).select("ordinal", f.alias("f"))
    names = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"]
    r = text.select("ordinal", *(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)), F.get("f", F.lit(column)).alias("call")).withColumn("pos", F.col("pos").cast("long"))
    if region:
        chrom, start, end = region
        r = r.where((F.col("chrom") == chrom) & F.col("pos").between(start, end))
    return r.withColumn("gt", call_field("GT")).withColumn("ps", F.when(~call_field("PS").isin("", "."), call_field("PS")))


def call_field(key: str) -> Column:
    """A field of the call by the record's FORMAT; null where there is none."""
    at = F.array_position(F.split("format", ":"), key)
    return F.when(at > 0, F.get(F.split("call", ":"), (at - 1).cast("int")))


def is_het(gt: str = "gt") -> Column:
    """Two alleles or more, none missing, the first two different."""
    a = F.split(F.translate(gt, "|", "/"), "/")
    return F.col(gt).isNotNull() & (F.size(a) > 1) & ~F.array_contains(a, ".") & (a[0] != a[1])


def single_base(ref: str = "ref", alt: str = "alt") -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1) & ~F.col(alt).isin(".", "*")


def het_sites(spark: SparkSession, path: str, region: tuple[str, int, int], sample: str | None = None) -> DataFrame:
    """``(snp_idx, snp_id, chrom, pos1, ref, alt)``: heterozygous single-base sites of a region in file order.

    Ids keep the alleles as written; alleles to compare with are in upper case."""
    kept = records(spark, path, sample, region).where(single_base() & is_het())
    rows = dense_index(kept.select("ordinal", "chrom", F.col("pos").alias("pos1"), "ref", "alt"), ["ordinal"], "snp_idx")
    return rows.select(F.col("snp_idx").cast("int").alias("snp_idx"), site_id(F.col("chrom"), F.col("pos1"), F.col("ref"), F.col("alt")).alias("snp_id"), "chrom", "pos1", F.upper("ref").alias("ref"), F.upper("alt").alias("alt"))


def phased_lines(spark: SparkSession, path: str, phases: DataFrame, region: tuple[str, int, int], sample: str | None = None, default_ps: int | None = None) -> tuple[list[str], DataFrame]:
    """(header, ``(ordinal, line, written, chrom, start, end)``): the records of a region with the phases of ``phases(snp_id, delta, ps)``.

    Only the chosen sample stays. Records that are no single-base site or have no phase are marked unwritten. A
    missing phase set takes ``default_ps``, else the region's start."""
    lines = header(spark, path)
    name = choose_sample(lines, sample)
    head = lines[:-1]
    for key, text in (("GT", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'), ("PS", '##FORMAT=<ID=PS,Number=1,Type=Integer,Description="Phase set">')):
        if not any(x.startswith(f"##FORMAT=<ID={key},") for x in head):
            head.append(text)
    head.append("\t".join(lines[-1].split("\t")[:9] + [name]))
    r = records(spark, path, name, region).withColumn("snp_id", site_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))
    p = phases.select("snp_id", F.col("delta").alias("_delta"), F.col("ps").alias("_ps"))
    j = r.join(p, "snp_id", "left").withColumn("written", single_base() & F.col("_delta").isNotNull())
    keys = F.split("format", ":")
    others = F.filter(F.zip_with(keys, F.split("call", ":"), lambda k, v: F.struct(k.alias("k"), F.coalesce(v, F.lit(".")).alias("v"))), lambda x: ~x["k"].isin("GT", "PS"))
    gt = F.when(F.col("_delta") == 1, "0|1").when(F.col("_delta") == -1, "1|0").otherwise(F.raise_error(F.concat(F.lit("invalid delta for "), F.col("snp_id"))))
    ps = F.coalesce(F.col("_ps").cast("long"), F.lit(default_ps if default_ps is not None else region[1])).cast("string")
    format_ = F.concat_ws(":", F.lit("GT"), F.transform(others, lambda x: x["k"]), F.lit("PS"))
    call = F.concat_ws(":", gt, F.transform(others, lambda x: x["v"]), ps)
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", "qual", "filter", "info", format_, call)
    return head, j.select("ordinal", F.when(F.col("written"), line).alias("line"), "written", "chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.length("ref")).alias("end"))
