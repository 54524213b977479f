"""Archives of numpy arrays, by ranges of rows: no array passes through the driver or one task.

An archive is a ZIP file of ``.npy`` members. Members that are stored plainly have every row at a place that follows from
their header, so tasks read ranges of rows and, when writing, put theirs into a file whose size is known beforehand;
the driver joins the checksums of the pieces and writes headers. Compressed members, which others may write, are read
by one task in bounded batches. Formats after the public ZIP and NPY specifications. Executors must share the file's disk.

Observation archives hold ``read_idx snp_idx b_ki baseq mapq epsilon weight`` by observation, ``read_ids`` by read,
``snp_ids chrom pos1 ref alt`` by site. The engine's own format is Parquet; these are for exchange.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.observe import dense_index
from ..operators.ranges import ranged, running_sum
from .bgzf import local

TAG = "observations_v1"  # a version tag; archives with others are read alike
BATCH = 16_384


def _own(path: str) -> str:
    own = local(path)
    if own is None:
        raise ValueError(f"{path} is not on a disk that executors share")
    return own


# ---- reading ----


@dataclass
class Member:
    """An array of one dimension: its type, its length, and where its rows begin in the file (None: compressed)."""

    dtype: np.dtype
    length: int
    begin: int | None


def _array_head(f) -> tuple[np.dtype, int]:
    known = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
    version = np.lib.format.read_magic(f)
    if version not in known:
        raise ValueError(f"arrays of version {version} are not read")
    shape, _, dtype = known[version](f)
    if len(shape) != 1 or dtype.kind not in "iubfUS":
        raise ValueError(f"an array of {dtype} with shape {shape} is not a column")
    return dtype, shape[0]


def members(path: str, names: list[str] | None = None) -> dict[str, Member]:
    """The named arrays (all columns where none are named) by their headers alone; the bytes read do not grow with them."""
    out = {}
    with zipfile.ZipFile(_own(path)) as z, open(_own(path), "rb") as raw:
        inside = {i.filename.removesuffix(".npy"): i for i in z.infolist()}
        for name in names if names is not None else inside:
            if name not in inside:
                raise ValueError(f"{path} has no array {name!r}")
            info = inside[name]
            with z.open(info) as f:
                try:
                    dtype, length = _array_head(f)
                except ValueError:
                    if names is not None:
                        raise
                    continue
                size = f.tell()
            raw.seek(info.header_offset + 26)
            begin = info.header_offset + 30 + sum(struct.unpack("<HH", raw.read(4))) + size
            out[name] = Member(dtype, length, begin if info.compress_type == zipfile.ZIP_STORED else None)
    return out


def count(path: str, name: str = "read_idx") -> int:
    """The length of an array, of the observations where none is named, from its header."""
    return members(path, [name])[name].length


def _column(data: bytes, dtype: np.dtype, n: int) -> pa.Array:
    x = np.frombuffer(data, dtype, n) if dtype.itemsize else np.zeros(n, "<U1")
    if x.dtype.kind in "US":
        return pa.array((np.char.decode(x, "utf-8") if x.dtype.kind == "S" else x).tolist(), pa.string())
    return pa.array(x.astype(np.float64)) if x.dtype.kind == "f" else pa.array(x.astype(x.dtype.newbyteorder("="))).cast(pa.int64())


@dataclass
class RowRange(InputPartition):
    first: int
    last: int


class NpzReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], split: int):
        self.path, self.names, self.split = path, names, split

    def partitions(self) -> list[RowRange]:
        found = members(self.path, self.names)
        lengths = {m.length for m in found.values()}
        if len(lengths) != 1:
            raise ValueError(f"arrays of different lengths in {self.path}: " + ", ".join(f"{k} {m.length}" for k, m in found.items()))
        n = lengths.pop()
        step = max(1, self.split // max(1, sum(m.dtype.itemsize for m in found.values())))
        if any(m.begin is None for m in found.values()):
            step = max(1, n)
        return [RowRange(a, min(a + step, n)) for a in range(0, max(1, n), step)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        found = members(self.path, self.names)
        with zipfile.ZipFile(self.path) as z:
            streams = []
            for name, m in found.items():
                if m.begin is None:  # from the start: its range is the whole array
                    f = z.open(f"{name}.npy")
                    _array_head(f)
                else:
                    f = open(self.path, "rb")
                    f.seek(m.begin + partition.first * m.dtype.itemsize)
                streams.append(f)
            try:
                for a in range(partition.first, partition.last, BATCH):
                    n = min(BATCH, partition.last - a)
                    columns = []
                    for f, (name, m) in zip(streams, found.items()):
                        data = f.read(n * m.dtype.itemsize)
                        if len(data) < n * m.dtype.itemsize:
                            raise ValueError(f"{self.path}: {name!r} ends early")
                        columns.append(_column(data, m.dtype, n))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), *columns], ["row", *found])
            finally:
                for f in streams:
                    f.close()


class NpzSource(DataSource):
    """``spark.read.format("npz").option("members", "a,b").load(path)``: ``row`` and an array a column, read by ranges."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def _names(self) -> list[str]:
        return self.options["members"].split(",") if "members" in self.options else list(members(self.options["path"]))

    def schema(self) -> str:
        kind = {"f": "double", "U": "string", "S": "string"}
        return ", ".join(["row long", *(f"`{k}` {kind.get(m.dtype.kind, 'long')}" for k, m in members(self.options["path"], self._names()).items())])

    def reader(self, schema) -> NpzReader:
        return NpzReader(_own(self.options["path"]), self._names(), int(self.options.get("splitbytes", 64 << 20)))


def arrays(spark: SparkSession, path: str, names: list[str], split_bytes: int = 64 << 20) -> DataFrame:
    """``row`` and the named arrays, which must be of one length."""
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz").option("members", ",".join(names)).option("splitbytes", split_bytes).load(path)


def observations(spark: SparkSession, path: str, weighted: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, sites, reads) of an archive; weights are 1 unless asked for, and 1 where the archive has none."""
    has = members(path)
    more = [c for c in ("baseq", "mapq", "epsilon") if c in has] + (["weight"] if weighted and "weight" in has else [])
    weight = F.col("weight") if "weight" in more else F.lit(1.0)
    kinds = {"baseq": "int", "mapq": "int", "epsilon": "double"}
    o = arrays(spark, path, ["read_idx", "snp_idx", "b_ki", *more])
    rows = o.select("read_idx", F.col("snp_idx").cast("int"), F.col("b_ki").cast("int").alias("b"), weight.alias("weight"), F.col("row").alias("ordinal"), *(F.col(c).cast(t) for c, t in kinds.items() if c in more))
    r = arrays(spark, path, ["read_ids"]).select(F.col("row").alias("read_idx"), F.col("read_ids").alias("read_id"))
    s = arrays(spark, path, ["snp_ids", "pos1", *(c for c in ("chrom", "ref", "alt") if c in has)])
    text = lambda c: (F.col(c) if c in has else F.lit("")).alias(c)
    s = s.select(F.col("row").cast("int").alias("snp_idx"), F.col("snp_ids").alias("snp_id"), text("chrom"), "pos1", text("ref"), text("alt"))
    return rows.join(r, "read_idx").join(s.select("snp_idx", "snp_id"), "snp_idx"), s, r


def graph(spark: SparkSession, path: str, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(observations, sites) with sites that no read shows left out and the others numbered anew."""
    rows, sites, _ = observations(spark, path, weighted)
    seen = sites.join(rows.select("snp_idx").distinct(), "snp_idx", "left_semi").withColumnRenamed("snp_idx", "_old")
    new = dense_index(seen, ["_old"], "snp_idx").withColumn("snp_idx", F.col("snp_idx").cast("int"))
    renumbered = rows.withColumnRenamed("snp_idx", "_old").join(new.select("_old", "snp_idx"), "_old").drop("_old")
    return renumbered, new.drop("_old")


def pairs(obs: DataFrame) -> DataFrame:
    """``(read_id, snp_id)`` of each observation; other columns are never read."""
    return obs.select("read_id", "snp_id")


# ---- writing ----

_POLYNOMIAL = 0xEDB88320  # of CRC-32, lowest power in the highest bit


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32."""
    out = 0
    for k in range(31, -1, -1):
        out ^= b if a >> k & 1 else 0
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two byte strings one after the other, from theirs and the length of the second."""
    shift, power = 1 << 31, 1 << 23  # 1 and x**8
    while length:
        shift = _times(shift, power) if length & 1 else shift
        power, length = _times(power, power), length >> 1
    return _times(shift, first) ^ second


def _encoded(column: pa.Array, name: str, dtype: np.dtype) -> bytes:
    if column.null_count:
        raise ValueError(f"a null in {name!r}")
    if dtype.kind == "U":
        return np.asarray(column.to_pylist(), dtype).tobytes()
    x = column.to_numpy(zero_copy_only=False)
    y = x.astype(dtype)
    if dtype.kind in "iu" and (y != x).any():
        raise ValueError(f"a value of {name!r} does not fit {dtype}")
    return y.tobytes()


def _put(path: str, places: list[tuple[str, str, int]]):
    """``mapInArrow`` over ``(_row, columns...)`` sorted by row: each value to its place in the file, which is there already.

    Gives a row for each member and run of neighbouring rows; a task that is done again writes the same bytes."""
    places = [(name, np.dtype(kind), begin) for name, kind, begin in places]

    def run(batches):
        first, last, crcs = 0, 0, [0] * len(places)

        def piece():
            k = len(places)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in places]), pa.array([first] * k, pa.int64()), pa.array([last - first] * k, pa.int64()), pa.array(crcs, pa.int64())], ["member", "first", "n", "crc"])

        with open(path, "r+b") as f:
            for b in batches:
                at = b.column(0).to_numpy()
                ends = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
                for a, z in zip(ends, ends[1:]):
                    if z > a and at[a] != last:
                        if last > first:
                            yield piece()
                        first = last = int(at[a])
                        crcs = [0] * len(places)
                    for k, (name, dtype, begin) in enumerate(places):
                        data = _encoded(b.column(k + 1).slice(a, z - a), name, dtype)
                        f.seek(begin + last * dtype.itemsize)
                        f.write(data)
                        crcs[k] = zlib.crc32(data, crcs[k])
                    last += z - a
        if last > first:
            yield piece()

    return run


def _npy_head(dtype: np.dtype, n: int) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(dtype), "fortran_order": False, "shape": (n,)})
    return out.getvalue()


def _entry(name: bytes, crc: int, size: int, at: int | None) -> bytes:
    """The header of a stored member with sizes of eight bytes: before its data, or with its place in the directory at the end."""
    if at is None:
        return struct.pack("<4s5H3L2H", b"PK\3\4", 45, 0, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<2H2Q", 1, 16, size, size)
    return struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45, 0, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<2H3Q", 1, 24, size, size, at)


def write_arrays(tables: list[tuple[DataFrame, dict[str, tuple[str, str]]]], path: str, fixed: dict[str, np.ndarray] | None = None, force: bool = False) -> None:
    """An archive of the columns of ``tables``, each numbered without gaps from 0 by ``_row``: ``{member: (column, type)}``.

    The type ``U`` becomes as wide as the longest text. ``fixed`` are small arrays of the caller. Executors write values
    to their places; the driver sees lengths and checksums of runs of rows. Nulls and integers that do not fit are
    errors. The file appears under its name when it is whole; an existing one is an error unless ``force``."""
    own = _own(path)
    if not force and os.path.exists(own):
        raise FileExistsError(path)
    os.makedirs(os.path.dirname(os.path.abspath(own)), exist_ok=True)
    half = f"{own}.{uuid.uuid4().hex}.tmp"
    at, entries, jobs = 0, [], []  # entries: name, place, head of the array, bytes a row, rows, finished data
    for name, value in (fixed or {}).items():
        out = io.BytesIO()
        np.lib.format.write_array(out, np.asarray(value), allow_pickle=False)
        entries.append([f"{name}.npy".encode(), at, out.getvalue(), 0, 0])
        at += len(_entry(entries[-1][0], 0, 0, None)) + len(entries[-1][2])
    for df, columns in tables:
        texts = [c for c, kind in columns.values() if kind == "U"]
        sizes = df.agg(F.count("*").alias("n"), *(F.coalesce(F.max(F.length(c)), F.lit(0)).alias(f"_{k}") for k, c in enumerate(texts))).first()
        places = []
        for name, (c, kind) in columns.items():
            dtype = np.dtype(f"<U{max(1, sizes[f'_{texts.index(c)}'])}" if kind == "U" else kind)
            entries.append([f"{name}.npy".encode(), at, _npy_head(dtype, sizes.n), dtype.itemsize, sizes.n])
            begin = at + len(_entry(entries[-1][0], 0, 0, None)) + len(entries[-1][2])
            places.append((name, dtype.str, begin))
            at = begin + dtype.itemsize * sizes.n
        jobs.append((df.select(F.col("_row").cast("long"), *(F.col(c).alias(f"_c{k}") for k, (c, _) in enumerate(columns.values()))), places))
    try:
        with open(half, "wb") as f:
            f.truncate(at)
        pieces: dict[bytes, list] = {}
        for df, places in jobs:
            for r in df.sortWithinPartitions("_row").mapInArrow(_put(half, places), "member string, first long, n long, crc long").collect():  # a row for each run
                pieces.setdefault(f"{r.member}.npy".encode(), []).append((r.first, r.n, r.crc))
        directory = b""
        with open(half, "r+b") as f:
            for name, place, head, width, n in entries:
                crc, seen = zlib.crc32(head), 0
                for first, k, other in sorted(pieces.get(name, [])):
                    if first != seen:
                        raise ValueError(f"rows of {name.decode()} are not numbered without gaps: {first} after {seen}")
                    crc, seen = joined_crc(crc, other, k * width), seen + k
                if seen != n:
                    raise ValueError(f"{seen} of {n} rows of {name.decode()} were written")
                size = len(head) + width * n
                f.seek(place)
                f.write(_entry(name, crc, size, None) + head)
                directory += _entry(name, crc, size, place)
            f.seek(at)
            k = len(entries)
            f.write(directory + struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, k, k, len(directory), at) + struct.pack("<4sLQL", b"PK\6\7", 0, at + len(directory), 1))
            f.write(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, min(k, 0xFFFF), min(k, 0xFFFF), 0xFFFFFFFF, 0xFFFFFFFF, 0))
        os.replace(half, own)
    finally:
        if os.path.exists(half):
            os.remove(half)


def write(obs: DataFrame, sites: DataFrame, reads: DataFrame, path: str, force: bool = False) -> None:
    """An archive of ``obs`` with ``sites`` and ``reads(read_id, read_idx)``, whose indices number them without gaps."""
    o = dense_index(obs.join(reads, "read_id").select("read_idx", "snp_idx", "ordinal", "b", "baseq", "mapq", "epsilon", "weight"), ["read_idx", "snp_idx", "ordinal"], "_row")
    numbers = {"read_idx": ("read_idx", "<i4"), "snp_idx": ("snp_idx", "<i4"), "b_ki": ("b", "|i1"), "baseq": ("baseq", "|u1"), "mapq": ("mapq", "<u2"), "epsilon": ("epsilon", "<f4"), "weight": ("weight", "<f4")}
    by_site = {"snp_ids": ("snp_id", "U"), "chrom": ("chrom", "U"), "pos1": ("pos1", "<i8"), "ref": ("ref", "U"), "alt": ("alt", "U")}
    in_order = lambda df, c: df.withColumn("_row", F.col(c)).repartitionByRange("_row")
    write_arrays([(o, numbers), (in_order(reads, "read_idx"), {"read_ids": ("read_id", "U")}), (in_order(sites, "snp_idx"), by_site)], path, {"format_version": np.asarray([TAG])}, force)


def write_sparse(entries: DataFrame, n_rows: int, n_columns: int, path: str, row: str = "row", column: str = "column", value: str = "value", force: bool = False) -> None:
    """A sparse matrix of ``entries``, one for each place, in compressed rows: ``data indices indptr shape format``.

    Row pointers are a running count by ranges of rows; rows without entries are counted too."""
    spark = entries.sparkSession
    e = dense_index(entries.select(F.col(row).cast("long").alias("_i"), F.col(column).cast("long").alias("_j"), F.col(value).cast("double").alias("_x")), ["_i", "_j"], "_row")
    sizes = spark.range(n_rows).join(e.groupBy(F.col("_i").alias("id")).agg(F.count("*").alias("_n")), "id", "left").select((F.col("id") + 1).alias("_row"), F.coalesce("_n", F.lit(0)).alias("_n"))
    counted = running_sum(ranged(sizes.union(spark.createDataFrame([(0, 0)], "_row long, _n long")), ["_row"]), "_n", "_pointer")
    write_arrays([(e, {"indices": ("_j", "<i8"), "data": ("_x", "<f8")}), (counted, {"indptr": ("_pointer", "<i8")})], path, {"shape": np.asarray([n_rows, n_columns]), "format": np.asarray(b"csr")}, force)


def sparse(spark: SparkSession, path: str) -> DataFrame:
    """``(row, column, value)`` of such a matrix: rows by the ranges between pointers that places fall into."""
    pointers = arrays(spark, path, ["indptr"])
    after = pointers.select((F.col("row") - 1).alias("row"), F.col("indptr").alias("_end"))
    filled = pointers.join(after, "row").where("_end > indptr").select(F.col("row").alias("_i"), F.explode(F.sequence("indptr", F.col("_end") - 1)).alias("row"))
    return arrays(spark, path, ["indices", "data"]).join(filled, "row").select(F.col("_i").alias("row"), F.col("indices").alias("column"), F.col("data").alias("value"))
