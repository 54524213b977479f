"""Indexed VCF files as a data source for SQL, whose predicates on chromosome and position reach the tabix index.

``records(spark, path).createOrReplaceTempView("calls")``, then SQL over ``calls``. The path must be one that the driver and
executors can open.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from . import bgzf

#: Positions end before this in any index of the format.
FAR = 1 << 29
_TEXT = ("id", "ref", "alt", "qual", "filter", "info", "format", "call")
SCHEMA = "ordinal long, chrom string, pos long, " + ", ".join(f"`{n}` string" for n in _TEXT)


@dataclass
class Blocks(InputPartition):
    """Virtual offsets of one task, with what its rows must meet."""

    first: int
    last: int
    chroms: tuple[str, ...] | None
    start: int
    end: int


class Reader(DataSourceReader):
    """Chromosomes and inclusive 1-based positions of the predicates that were pushed, met by every row that is read."""

    def __init__(self, path: str, sample: str | None, split: int):
        self.path, self.sample, self.split = path, sample, split
        self.chroms: set[str] | None = None
        self.start, self.end = 0, FAR

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and lists of chromosomes and comparisons of positions; gives all others back to Spark."""
        for f in filters:
            match f:
                case EqualTo(("chrom",), str(x)):
                    self._only({x})
                case In(("chrom",), xs) if all(isinstance(x, str) for x in xs):
                    self._only(set(xs))
                case EqualTo(("pos",), int(x)):
                    self.start, self.end = max(self.start, x), min(self.end, x)
                case GreaterThanOrEqual(("pos",), int(x)):
                    self.start = max(self.start, x)
                case GreaterThan(("pos",), int(x)):
                    self.start = max(self.start, x + 1)
                case LessThanOrEqual(("pos",), int(x)):
                    self.end = min(self.end, x)
                case LessThan(("pos",), int(x)):
                    self.end = min(self.end, x - 1)
                case IsNotNull(("chrom" | "pos",)):
                    pass  # no record is without
                case _:
                    yield f

    def _only(self, names: set[str]) -> None:
        self.chroms = names if self.chroms is None else self.chroms & names

    def partitions(self) -> list[Blocks]:
        """By the index where there is one and a chromosome is asked for, else the whole file in ranges."""
        if self.start > self.end or self.chroms is not None and not self.chroms:
            return [Blocks(0, 0, (), 0, 0)]
        ranges = None
        if self.chroms is not None:
            found = [bgzf.tabix_ranges(self.path, c, max(0, self.start - 1), self.end, self.split) for c in sorted(self.chroms)]
            ranges = None if None in found else [r for own in found for r in own]
        if ranges is None:
            ranges = bgzf.whole_ranges(self.path, self.split)
        chroms = None if self.chroms is None else tuple(sorted(self.chroms))
        # Ranges of two chromosomes may meet in one block; each line starts in one of them.
        kept, at = [], 0
        for first, last in sorted(ranges):
            if last > max(first, at):
                kept.append(Blocks(max(first, at), last, chroms, self.start, self.end))
                at = last
        return kept or [Blocks(0, 0, (), 0, 0)]

    def _column(self) -> int:
        """The column of the sample, from the header: more of the file is read until its last line is there."""
        own, size = bgzf.local(self.path), 1 << 16
        while True:
            named = [x for x in bgzf.read_lines(own, 0, size << 16)[1] if not x.startswith("##")]
            if named or size >= os.path.getsize(own):
                return self._place(named[0] if named else "")
            size *= 4

    def _place(self, line: str) -> int:
        names = line.split("\t")[9:] if line.startswith("#CHROM") else []
        if not names or self.sample and self.sample not in names:
            raise ValueError(f"no sample {self.sample or ''} in {self.path}")
        return 9 + (names.index(self.sample) if self.sample else 0)

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if partition.last <= partition.first:
            return
        column, rows = self._column(), []
        for ordinal, line in zip(*bgzf.read_lines(bgzf.local(self.path), partition.first, partition.last)):
            if not line or line.startswith("#"):
                continue
            f = line.split("\t")
            pos = int(f[1])
            if (partition.chroms is None or f[0] in partition.chroms) and partition.start <= pos <= partition.end:
                rows.append((ordinal, f[0], pos, *f[2:9], f[column] if column < len(f) else None))
        if rows:
            kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.string()] * len(_TEXT)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["ordinal", "chrom", "pos", *_TEXT])


class IndexedVcf(DataSource):
    """The source behind :func:`records`. Options: ``path``, ``sample`` (the first unless given) and ``split`` (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "indexed_vcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        if bgzf.local(self.options["path"]) is None:
            raise ValueError("an indexed VCF must be on a disk that all executors share")
        return Reader(self.options["path"], self.options.get("sample"), int(self.options.get("split", 64 << 20)))


def records(spark: SparkSession, path: str, sample: str | None = None, split: int = 64 << 20) -> DataFrame:
    """All records of the file with the call of one sample, for any number of queries.

    Spark keeps what was pushed last with a relation, and asks it anew only where a query has a predicate. So that no
    query reads what an earlier one asked for, every query has one: positions are never negative."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedVcf)
    source = spark.read.format(IndexedVcf.name()).option("split", split)
    return (source.option("sample", sample) if sample else source).load(path).where("pos >= 0")
