"""One BGZF file from rows in order, with its position index; and ranges of such a file read back.

Executors compress ranges of the rows into whole BGZF blocks, which may simply follow each other in a file. Once the
sizes of the ranges are known, so is the address of every block: where executors share the file's disk each of them
writes its blocks to their places in one file, which is renamed when all are there; elsewhere the driver passes the
blocks on to the file system. The index is added up by bins and windows on executors too. Formats after the public SAM,
BAM and tabix specifications.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import materialize

# Fixed values of the specifications: the empty block that ends a file, bytes a block may hold, first bin of each level.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST = 60_000
LEVELS = ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))


def block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocks(data: bytes) -> bytes:
    return b"".join(block(data[k : k + MOST]) for k in range(0, len(data), MOST))


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds [start, end)."""
    for shift, first in reversed(LEVELS):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
    return 0


def bins_over(start: int, end: int) -> set[int]:
    return {0} | {first + k for shift, first in LEVELS for k in range(start >> shift, (end - 1 >> shift) + 1)}


_GROUP = pa.schema([("blob", pa.binary()), ("off", pa.int64()), ("records", pa.int64()), ("chrom", pa.list_(pa.string())), ("bin", pa.list_(pa.int64())), ("at", pa.list_(pa.int64()))])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of whole records as whole blocks: where each begins among the blocks of its task, the number of its records,
    and where in it the first record of each bin starts, and with bin -1 - w the first of window w."""
    held, found, n, off = bytearray(), {}, 0, 0

    def group() -> pa.RecordBatch:
        cols = [[blocks(bytes(held))], [off], [n], [[c for c, _ in found]], [[k for _, k in found]], [[*found.values()]]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _GROUP)], schema=_GROUP)

    for b in batches:
        for data, chrom, start, end in zip(*(b.column(k).to_pylist() for k in range(4))):
            if held and len(held) + len(data) > MOST:
                out = group()
                yield out
                off += len(out.column(0)[0].as_py())
                held, found, n = bytearray(), {}, 0
            end = max(end, start + 1)
            for k in (bin_of(start, end), *range(-1 - (end - 1 >> 14), -(start >> 14))):
                found.setdefault((chrom, k), len(held))
            n += 1
            held += data
    if held:
        yield group()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by ``(chrom, bin, first)``: those of one bin whose blocks touch as one; of windows the first."""
    now = None
    for b in batches:
        out = []
        for chrom, bin_, first, last in zip(*(b.column(k).to_pylist() for k in range(4))):
            if now is not None and now[:2] == [chrom, bin_] and (bin_ < 0 or now[3] >> 16 >= first >> 16):
                now[3] = max(now[3], last)
                continue
            if now is not None:
                out.append(now)
            now = [chrom, bin_, first, last]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["chrom", "bin", "first", "last"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in now], ["chrom", "bin", "first", "last"])


class _Index:
    """The bins and windows of each reference, from entries of executors that are merged already."""

    def __init__(self, entries):
        self.bins: dict[str, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        self.linear: dict[str, dict[int, int]] = defaultdict(dict)
        least: dict[str, int] = {}
        for chrom, bin_, first, last in entries:
            least[chrom] = min(first, least.get(chrom, first))
            if bin_ < 0:
                self.linear[chrom][-1 - bin_] = first
            else:
                self.bins[chrom][bin_].append((first, last))
        self.names = sorted(least, key=least.get)

    def body(self, names: list[str]) -> bytes:
        out = b""
        for name in names:
            own, lin = self.bins.get(name, {}), self.linear.get(name, {})
            out += struct.pack("<i", len(own))
            for b, chunks in sorted(own.items()):
                out += struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in sorted(chunks))
            n, at, filled = max(lin, default=-1) + 1, 0, []
            for w in range(n):
                at = lin.get(w, at)
                filled.append(at)
            out += struct.pack("<i", n) + struct.pack(f"<{n}Q", *filled)
        return out


def _put(path: str, starts: dict[int, int]):
    """A function of ``(part, off, blob)``: each blob at its place in the file, which is there already; done again after a
    lost task it writes the same bytes to the same place. Pickled rows come by the hundred, Arrow batches by thousands."""

    def run(part, off, blob):
        with open(path, "r+b") as f:
            f.seek(starts[part] + off)
            return f.write(blob)

    return F.udf(run, "long", useArrow=False)


def write(head: bytes, rows: DataFrame, path: str, kind: str, names: list[str] | None = None, force: bool = False, encode: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """``rows(ordinal, data, chrom, start, end)`` behind ``head`` as the file ``path``, with ``path + '.' + kind`` beside it.

    With ``encode``, which must keep rows in their tasks and order, those are its columns of ``rows(ordinal, ...)``: it
    runs once, behind the exchange, and not for the sample of the ranges as well.

    Records follow in order of ``ordinal``, which must be that of their places on each reference for the index to hold.
    ``kind`` is ``tbi`` (VCF text) or ``bai`` (BAM; ``names`` are its references). An existing file is an error unless
    ``force``; the file appears under its name when it is whole. Gives the number of records. The driver holds the size
    of each part and the finished index, which grows with the references' lengths."""
    spark = rows.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    where, half = fs.Path(path), f"{path}.{uuid.uuid4().hex}.tmp"
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not force and system.exists(where):
        raise FileExistsError(path)
    # A number of ranges, as adaptive execution would go by bytes, which say little of the work.
    ranges = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(ranges, "ordinal").sortWithinPartitions("ordinal")
    dealt = (encode(dealt) if encode else dealt).select("data", "chrom", "start", "end")
    groups = dealt.mapInArrow(_packed, "blob binary, off long, records long, chrom array<string>, bin array<long>, at array<long>")
    groups = materialize(groups.withColumn("n", F.monotonically_increasing_id()), "blocks")
    part, size = F.shiftright("n", 33).alias("part"), F.octet_length("blob").cast("long").alias("size")
    sizes = groups.groupBy(part).agg(F.sum(F.octet_length("blob")).alias("bytes"), F.sum("records").alias("n")).orderBy("part").collect()  # a row for each part
    first = blocks(head)
    starts, end = {}, len(first)
    for r in sizes:
        starts[r.part], end = end, end + r.bytes
    own = local(half)
    if own is not None:
        os.makedirs(os.path.dirname(os.path.abspath(own)), exist_ok=True)
        with open(own, "wb") as f:
            f.write(first)
            f.seek(end)
            f.write(END)
        written = groups.select(_put(own, starts)(part, "off", "blob").alias("written")).agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]
        if written != end - len(first):
            raise OSError(f"{written} of {end - len(first)} bytes are in {path}")
    else:
        out = system.create(fs.Path(half), True)
        try:
            out.write(bytearray(first))
            for g in groups.orderBy("n").select("blob").toLocalIterator():
                out.write(bytearray(g.blob))
            out.write(bytearray(END))
        finally:
            out.close()
    # One chunk of a bin for each group: blocks are not cut.
    marks = groups.select(part, "off", size, F.explode(F.arrays_zip("chrom", "bin", "at")).alias("m")).join(F.broadcast(spark.createDataFrame([*starts.items()], "part long, begun long")), "part")
    address = F.col("begun") + F.col("off")
    marks = marks.select("m.chrom", "m.bin", F.shiftleft(address, 16).bitwiseOR(F.col("m.at")).alias("first"), F.shiftleft(address + F.col("size"), 16).alias("last"))
    entries = marks.repartition("chrom", "bin").sortWithinPartitions("chrom", "bin", "first").mapInArrow(_merged, "chrom string, bin long, first long, last long")
    index = _Index(map(tuple, entries.collect()))
    names = names if names is not None else index.names
    if kind == "tbi":
        text = b"".join(x.encode() + b"\0" for x in names)
        body = blocks(b"TBI\x01" + struct.pack("<8i", len(names), 2, 1, 2, 0, ord("#"), 0, len(text)) + text + index.body(names)) + END
    else:
        body = b"BAI\x01" + struct.pack("<i", len(names)) + index.body(names)
    system.delete(where, False)
    if not system.rename(fs.Path(half), where):
        raise OSError(f"{half} cannot be renamed")
    beside = system.create(fs.Path(f"{path}.{kind}"), True)
    try:
        beside.write(bytearray(body))
    finally:
        beside.close()
    return sum(r.n for r in sizes)


def local(path: str) -> str | None:
    """The path as executors that share a disk open it; None for other file systems."""
    return path.removeprefix("file://").removeprefix("file:") if ":" not in path.removeprefix("file:") else None


def inflate(data: bytes) -> bytes:
    out = b""
    while data:
        d = zlib.decompressobj(31)
        out += d.decompress(data)
        data = d.unused_data
    return out


def read_tabix(path: str) -> dict[str, tuple[dict[int, list[tuple[int, int]]], tuple[int, ...]]] | None:
    """Each reference's chunks by bin and first offsets by window; None without an index that can be opened here."""
    own = local(path)
    if own is None or not os.path.exists(own + ".tbi"):
        return None
    with open(own + ".tbi", "rb") as f:
        data = inflate(f.read())
    n_ref, text = struct.unpack_from("<i", data, 4)[0], struct.unpack_from("<i", data, 32)[0]
    names, at, out = data[36 : 36 + text].split(b"\0")[:n_ref], 36 + text, {}
    for name in names:
        bins = {}
        for _ in range(struct.unpack_from("<i", data, at)[0]):
            b, n = struct.unpack_from("<Ii", data, at + 4)
            bins[b] = [struct.unpack_from("<QQ", data, at + 12 + 16 * k) for k in range(n)]
            at += 8 + 16 * n
        n = struct.unpack_from("<i", data, at + 4)[0]
        out[name.decode()] = bins, struct.unpack_from(f"<{n}Q", data, at + 8)
        at += 8 + 8 * n
    return out


def _cut(first: int, last: int, offsets, split: int) -> list[tuple[int, int]]:
    cuts = [first]
    for v in sorted({v for v in offsets if first < v < last}):
        if (v >> 16) - (cuts[-1] >> 16) >= split:
            cuts.append(v)
    return list(zip(cuts, [*cuts[1:], last]))


def tabix_ranges(path: str, chrom: str, start: int, end: int, split: int = 64 << 20) -> list[tuple[int, int]] | None:
    """Virtual offsets [first, last) that hold all records over [start, end) of ``chrom``, cut about every ``split``
    bytes; None without an index that can be opened here."""
    index = read_tabix(path)
    if index is None:
        return None
    bins, linear = index.get(chrom, ({}, ()))
    wanted = bins_over(start, max(end, start + 1))
    least = linear[min(start >> 14, len(linear) - 1)] if linear else 0
    chunks = [(max(a, least), z) for b, own in bins.items() if b in wanted for a, z in own if z > least]
    return _cut(min(a for a, _ in chunks), max(z for _, z in chunks), linear, split) if chunks else []


def whole_ranges(path: str, split: int = 64 << 20) -> list[tuple[int, int]]:
    """Virtual offsets that hold the whole file, cut where its index, if there is one, has a record."""
    offsets = [v for _, linear in (read_tabix(path) or {}).values() for v in linear]
    return _cut(0, os.path.getsize(local(path)) << 16, offsets, split)


def read_lines(path: str, first: int, last: int) -> tuple[list[int], list[str]]:
    """Virtual offsets and texts of the lines of a BGZF file that start in [first, last)."""
    ordinals, values = [], []
    with open(path, "rb") as f:
        f.seek(first >> 16)
        address, skip, rest, begun = first >> 16, first & 0xFFFF, b"", first
        while address << 16 < last or rest:
            head = f.read(18)
            if len(head) < 18:
                break
            size = struct.unpack_from("<H", head, 16)[0] + 1
            data = zlib.decompress(f.read(size - 18)[:-8], -15)
            at = skip
            while at < len(data):
                if not rest:
                    begun = address << 16 | at
                    if begun >= last:
                        break
                end = data.find(b"\n", at)
                rest += data[at:] if end < 0 else data[at:end]
                at = len(data) if end < 0 else end + 1
                if end >= 0:
                    ordinals.append(begun)
                    values.append(rest.decode())
                    rest = b""
            address, skip = address + size, 0
    return ordinals, values


def lines_between(spark: SparkSession, path: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """``(ordinal, value)``: the lines that start in each range of a BGZF text; ``ordinal`` is their virtual offset."""
    own = local(path)

    def run(batches):
        for b in batches:
            for first, last in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ordinals, values = read_lines(own, first, last)
                yield pa.RecordBatch.from_arrays([pa.array(ordinals, pa.int64()), pa.array(values, pa.string())], ["ordinal", "value"])

    rows = spark.createDataFrame(ranges, "first long, last long")
    return rows.repartition(max(1, len(ranges))).mapInArrow(run, "ordinal long, value string")
