"""Scalar functions of the evidence model, as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Collapse, Observing, Risk


def error_rate(baseq: Column, mapq: Column, p: Observing = Observing()) -> Column:
    """Chance that a base call or its alignment is wrong, kept within the floor and ceiling."""
    right = (1 - F.pow(F.lit(10.0), -baseq / 10.0)) * (1 - F.pow(F.lit(10.0), -F.least(mapq, F.lit(p.mapq_cap)) / 10.0))
    return F.least(F.greatest(1 - right, F.lit(p.eps_floor)), F.lit(p.eps_ceiling))


def evidence_weight(eps: Column) -> Column:
    return F.log((1 - eps) / eps)


def usable_baseq(baseq: Column, p: Observing = Observing()) -> Column:
    """A missing quality takes the default; a default of 0 means the least that passes."""
    return F.coalesce(baseq, F.lit(p.default_baseq or p.min_baseq))


def allele(base: Column, ref: Column, alt: Column) -> Column:
    """+1 for the reference base, -1 for the alternative, 0 for any other."""
    b = F.upper(base)
    return F.when(b == ref, 1).when(b == alt, -1).otherwise(0)


def confidence(score: Column, support: Column) -> Column:
    return F.when(support > 0, F.abs(score) / support).otherwise(0.0)


def domination(max_abs: Column, support: Column) -> Column:
    return F.when(support > 0, max_abs / support).otherwise(1.0)


def edge_risk(conf: Column, count: Column, distance: Column, dom: Column, p: Risk = Risk()) -> Column:
    """Weighted sum of doubt in an edge: few or disagreeing reads, distance, and one read that carries it."""
    rare = F.when(count > 0, 1 / F.log1p(count.cast("double"))).otherwise(1.0)
    far = F.least(distance / F.lit(float(max(1, p.distance_norm))), F.lit(1.0))
    return p.confidence * (1 - conf) + p.count * rare + p.conflict * (1 - conf) + p.distance * far + p.domination * dom


def sign_or(value: Column, previous: Column | None = None) -> Column:
    """Sign with zero taken as the previous sign, or +1."""
    return F.when(value < 0, -1).when(value > 0, 1).otherwise(F.coalesce(previous, F.lit(1)) if previous is not None else F.lit(1))


def pair_name(name: Column) -> Column:
    """A query name without its mate suffix."""
    return F.regexp_replace(name, "/[12]$", "")


def anchor_score(total: Column, mapq: Column, cap: int) -> Column:
    return F.abs(total) * F.greatest(F.least(mapq, F.lit(cap)) / F.lit(float(cap)), F.lit(0.05))


def site_id(chrom: Column, pos1: Column, ref: Column, alt: Column) -> Column:
    return F.format_string("%s:%d:%s>%s", chrom, pos1.cast("long"), ref, alt)


def site_parts(snp_id: Column) -> dict[str, Column]:
    """``chrom:pos:REF>ALT`` taken apart, alleles in upper case."""
    part = lambda n: F.regexp_extract(snp_id, "^([^:]*):([0-9]+):([^>]*)>(.*)$", n)
    return {"chrom": part(1), "pos1": part(2).cast("long"), "ref": F.upper(part(3)), "alt": F.upper(part(4))}


def site_order(snp_id: Column) -> list[Column]:
    s = site_parts(snp_id)
    return [s["chrom"], s["pos1"], snp_id]


def component_order(component: Column) -> Column:
    """Numeric ids by number, others behind them by name."""
    return F.struct(F.coalesce(component.try_cast("long"), F.lit(10**18)), component)


def genotype(delta: Column) -> Column:
    return F.when(delta == 1, "0|1").when(delta == -1, "1|0")


def chrom_alias(chrom: Column, alias: Mapping[str, str]) -> Column:
    if not alias:
        return chrom
    pairs = [F.lit(x) for kv in alias.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), chrom), chrom)


def parse_region(text: str | None, zero_based: bool = False) -> tuple[str, int, int] | None:
    """``chrom:start-end``, 1-based and inclusive, with or without commas; ``zero_based`` lowers the start by one."""
    if not text:
        return None
    chrom, _, rest = text.rpartition(":")
    start, _, end = rest.replace(",", "").partition("-")
    return chrom, int(start) - zero_based, int(end)


def method_spec(text: str) -> tuple[str, str, list[str]]:
    """``NAME:VCF[:LOG,LOG...]``."""
    name, sep, rest = text.partition(":")
    if not sep:
        raise ValueError("a method is NAME:VCF[:LOG[,LOG...]]")
    vcf, _, logs = rest.partition(":")
    return name, vcf, logs.split(",") if logs else []


def canonical(values: Column) -> Column:
    """An array of values with the sign of its first turned positive."""
    return F.transform(values, lambda v: v * F.signum(values[0]))


def clip(value: Column, cap: float) -> Column:
    return F.greatest(F.lit(-float(cap)), F.least(F.lit(float(cap)), value))


def normalized(value: Column, reads: Column, degree: Column, block_degree: Column, dom: Column, p: Collapse = Collapse()) -> Column:
    """A pattern's value at a block, by one of seven norms."""
    n, d = F.greatest(reads, F.lit(1)), F.greatest(degree, F.lit(1)) * F.greatest(block_degree, F.lit(1))
    forms = {
        "sum": lambda: value,
        "mean": lambda: value / n,
        "sqrt": lambda: value / F.sqrt(n),
        "cap": lambda: clip(value, p.cap),
        "sqrt_cap": lambda: clip(value / F.sqrt(n), p.cap),
        "degree_norm_cap": lambda: clip(value / F.sqrt(d), p.cap),
        "adaptive_dom_cap": lambda: F.when(dom >= p.domination, clip(value, p.cap)).otherwise(value),
    }
    if p.norm not in forms:
        raise ValueError(f"no such norm: {p.norm}")
    return forms[p.norm]()


def capped_by_domination(dom: Column, p: Collapse = Collapse()) -> Column:
    return F.when(dom >= p.domination, 1).otherwise(0) if p.norm == "adaptive_dom_cap" else F.lit(0)


def fixed8(value: Column) -> Column:
    return F.format_string("%.8f", value.cast("double"))
