"""BAM alignments as a data source: record blocks decoded on the executors.

A BAM file is BGZF blocks, each a gzip member, of records as the public SAM/BAM specification lays them out. With an
index beside it (``.bai``) the file is cut at record offsets that the index names, and each range is a task; without
one it is read by one task. Files are opened by path, so they must be where every executor sees them.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ordinal long, name string, flag int, chrom string, start0 long, mapq int, cigar string, seq string, qual binary"
_CIGAR, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"  # fixed values of the specification
BATCH = 4096
#: Bases are four bits each, so a hexadecimal digit of the record stands for one.
_TO_BASES = bytes.maketrans(b"0123456789abcdef", _BASES.encode())
_TO_DIGITS = bytes(b"0123456789abcdef"[_BASES.index(chr(x))] if chr(x) in _BASES else ord("?") for x in range(256))
SPLIT = 1 << 20


class _Blocks:
    """The inflated bytes of a BGZF file from a virtual offset on."""

    def __init__(self, path: str, virtual: int = 0):
        self.file = open(path, "rb")
        self.file.seek(virtual >> 16)
        self.at, self.next, self.data, self.pos = virtual >> 16, virtual >> 16, b"", 0
        self._fill()
        self.pos = virtual & 0xFFFF

    def _fill(self) -> bool:
        while True:
            self.at = self.next
            head = self.file.read(18)
            if len(head) < 18:
                self.data, self.pos = b"", 0
                return False
            extra = struct.unpack_from("<H", head, 10)[0]
            more = self.file.read(max(0, extra - 6))
            fields, size, k = head[12:18] + more, None, 0
            while k + 4 <= extra:
                tag, n = fields[k : k + 2], struct.unpack_from("<H", fields, k + 2)[0]
                if tag == b"BC":
                    size = struct.unpack_from("<H", fields, k + 4)[0] + 1
                k += 4 + n
            if head[:2] != b"\x1f\x8b" or size is None:
                raise ValueError("not a BGZF block")
            body = self.file.read(size - 12 - extra)
            self.next = self.at + size
            self.data, self.pos = zlib.decompress(body[:-8], -15), 0
            if self.data:
                return True

    @property
    def virtual(self) -> int:
        return self.at << 16 | self.pos if self.pos < len(self.data) else self.next << 16

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.pos >= len(self.data) and not self._fill():
                return out
            part = self.data[self.pos : self.pos + n - len(out)]
            self.pos += len(part)
            out += part
        return out


def _header(b: _Blocks) -> list[str]:
    if b.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    b.read(struct.unpack("<i", b.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", b.read(4))[0]):
        n = struct.unpack("<i", b.read(4))[0]
        names.append(b.read(n)[:-1].decode())
        b.read(4)
    return names


def _index(path: str) -> list[list[int]] | None:
    """The linear index of each reference: record offsets by 16 kb of positions; None without an index."""
    found = next((p for p in (path + ".bai", path[:-4] + ".bai") if os.path.exists(p)), None)
    if not found:
        return None
    data = open(found, "rb").read()
    n_ref, at, out = struct.unpack_from("<i", data, 4)[0], 8, []
    for _ in range(n_ref):
        n_bin = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(n_bin):
            at += 8 + 16 * struct.unpack_from("<i", data, at + 4)[0]
        n = struct.unpack_from("<i", data, at)[0]
        out.append(list(struct.unpack_from(f"<{n}Q", data, at + 4)))
        at += 4 + 8 * n
    return out


class BamPartition(InputPartition):
    def __init__(self, first: int, last: int | None, number: int):
        self.first, self.last, self.number = first, last, number


@lru_cache(4096)
def _cigar(packed: bytes) -> tuple[str, int]:
    """The text of a packed CIGAR and the length of reference that it covers."""
    ops = struct.unpack(f"<{len(packed) // 4}I", packed)
    return "".join(f"{o >> 4}{_CIGAR[o & 15]}" for o in ops), sum(o >> 4 for o in ops if _CIGAR[o & 15] in "MDN=X")


@lru_cache(4096)
def _packed_cigar(cigar: str) -> tuple[bytes, int]:
    """:func:`_cigar` the other way."""
    ops = [(int(n), _CIGAR.index(c)) for n, c in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar)]
    return struct.pack(f"<{len(ops)}I", *(n << 4 | c for n, c in ops)), sum(n for n, c in ops if _CIGAR[c] in "MDN=X")


def _packed_bases(seq: str) -> bytes:
    return bytes.fromhex((seq.encode().translate(_TO_DIGITS) + b"0" * (len(seq) % 2)).decode())


def _record(data: bytes, names: list[str], ordinal: int) -> tuple:
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", data, 0)
    at = 32 + l_name
    name = data[32 : at - 1].decode()
    cigar = _cigar(data[at : at + 4 * n_cigar])[0]
    at += 4 * n_cigar
    seq = data[at : at + (l_seq + 1) // 2].hex().encode().translate(_TO_BASES)[:l_seq].decode()
    at += (l_seq + 1) // 2
    qual = data[at : at + l_seq]
    return ordinal, name, flag, names[ref] if ref >= 0 else None, pos, mapq, cigar, seq, None if qual[:1] == b"\xff" else qual


class BamReader(DataSourceReader):
    def __init__(self, path: str, region: str | None, split: int):
        self.path, self.split, self.region = path, split, None
        if region:
            chrom, _, rest = region.rpartition(":")
            a, _, b = rest.replace(",", "").partition("-")
            self.region = (chrom, int(a) - 1, int(b))

    def partitions(self) -> list[BamPartition]:
        b = _Blocks(self.path)
        names = _header(b)
        start, index, last = b.virtual, _index(self.path), None
        offsets = [start]
        if index is not None:
            own = index
            if self.region:
                if self.region[0] not in names:
                    return [BamPartition(0, 0, 0)]
                own = [index[names.index(self.region[0])]]
                window = min(self.region[1] >> 14, len(own[0]) - 1)
                if own[0] and own[0][window]:
                    offsets = [own[0][window]]
            for v in sorted({v for r in own for v in r if v > offsets[0]}):
                if (v >> 16) - (offsets[-1] >> 16) >= self.split:
                    offsets.append(v)
        return [BamPartition(a, z, k) for k, (a, z) in enumerate(zip(offsets, [*offsets[1:], last]))]

    def read(self, partition: BamPartition) -> Iterator[pa.RecordBatch]:
        names = _header(_Blocks(self.path))
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.binary()]
        cols = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], cols)
        rows, n = [], 0
        if partition.last == 0:
            return
        b = _Blocks(self.path, partition.first)
        while partition.last is None or b.virtual < partition.last:
            size = b.read(4)
            if len(size) < 4:
                break
            data = b.read(struct.unpack("<i", size)[0])
            row = _record(data, names, partition.number << 40 | n)
            n += 1
            if self.region:
                chrom, start, end = self.region
                if row[3] == chrom and row[4] >= end:
                    break  # sorted by position
                span = _cigar(data[32 + data[8] : 32 + data[8] + 4 * struct.unpack_from("<H", data, 12)[0]])[1]
                if row[3] != chrom or row[4] + max(1, span) <= start:
                    continue
            rows.append(row)
            if len(rows) >= BATCH:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


class BamSource(DataSource):
    """``spark.read.format("bam").option("region", "chr1:1-1000").load(path)`` after :func:`register`."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"].removeprefix("file://"), self.options.get("region"), int(self.options.get("splitbytes", SPLIT)))


def register(spark) -> None:
    spark.dataSource.register(BamSource)


def alignments(spark, path: str, region: str | None = None, split_bytes: int = SPLIT):
    """Alignments of a file or region; ``qual`` as an array of integers, null where the file has none."""
    from pyspark.sql import functions as F

    register(spark)
    reader = spark.read.format("bam").option("splitbytes", split_bytes)
    df = (reader.option("region", region) if region else reader).load(path)
    return df.withColumn("qual", F.when(F.col("qual").isNotNull(), F.transform(F.sequence(F.lit(1), F.length("qual")), lambda i: F.conv(F.hex(F.substring(F.col("qual"), i, F.lit(1))), 16, 10).cast("int"))))


def encoded(rows, names: list[str]):
    """``rows(ordinal, name, flag, chrom, start0, mapq, cigar, seq, qual binary)`` as ``(ordinal, data, chrom, start, end)``: the records of a BAM file."""
    place = {x: k for k, x in enumerate(names)}

    def run(batches):
        for b in batches:
            data, ends = [], []
            for name, flag, chrom, start, mapq, cigar, seq, qual in zip(*(b.column(k).to_pylist() for k in range(1, 9))):
                ops, span = _packed_cigar(cigar)
                body = struct.pack("<iiBBHHHiiii", place.get(chrom, -1), start, len(name) + 1, mapq, 0, len(ops) // 4, flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
                body += ops + _packed_bases(seq) + (qual if qual is not None else b"\xff" * len(seq))
                data.append(struct.pack("<i", len(body)) + body)
                ends.append(start + max(1, span))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary()), b.column(3), b.column(4), pa.array(ends, pa.int64())], ["ordinal", "data", "chrom", "start", "end"])

    kept = rows.selectExpr("cast(ordinal as long) ordinal", "name", "cast(flag as int) flag", "chrom", "cast(start0 as long) start0", "cast(mapq as int) mapq", "cigar", "seq", "qual")
    return kept.mapInArrow(run, "ordinal long, data binary, chrom string, start long, end long")


def write(rows, path: str, references: list[tuple[str, int]], force: bool = False) -> int:
    """A BAM file of alignments sorted by reference and position, with a ``.bai`` index beside it; gives the number of records."""
    from . import bgzf

    text = b"@HD\tVN:1.6\tSO:coordinate\n"
    head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references))
    for name, size in references:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    names = [x for x, _ in references]
    return bgzf.write(head, rows, path, "bai", names, force, lambda dealt: encoded(dealt, names))
