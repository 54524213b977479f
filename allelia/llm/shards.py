"""Shards by jump consistent hashing, in DataFrame functions.

A row's shard follows from its key and the number of shards alone (Lamping and Veach, 2014): the key seeds a linear
congruential generator, and each draw jumps to the next number of shards at which the row would move. There is no
table of ring points, and of n + 1 shards only the share 1 / (n + 1) of the rows, those of the new shard, was elsewhere
among n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.observe import dense_index
from .columns import let

# Multiplier of the published generator; draws are the upper 31 of 64 bits.
MULTIPLIER = 2862933555777941757
#: Shards of the query; the law that holds.
SHARDS, LAW = 16, "key"

_LIMB = 22
_MASK = (1 << _LIMB) - 1
_FACTOR = [MULTIPLIER >> (_LIMB * i) & _MASK for i in range(3)]


def _limb(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, _LIMB * i).bitwiseAND(F.lit(_MASK).cast("long"))


def _next(key: Column) -> Column:
    """``key * MULTIPLIER + 1`` modulo 2^64, by limbs of 22 bits, as products of longs must not overflow."""

    def carried(low: Column) -> Column:
        mid = lambda c: _limb(key, 0) * _FACTOR[1] + _limb(key, 1) * _FACTOR[0] + F.shiftright(c, _LIMB)
        high = lambda c: _limb(key, 0) * _FACTOR[2] + _limb(key, 1) * _FACTOR[1] + _limb(key, 2) * _FACTOR[0] + F.shiftright(c, _LIMB)
        return let(mid(low), lambda m: F.shiftleft(high(m), 2 * _LIMB).bitwiseOR(F.shiftleft(_limb(m, 0), _LIMB)).bitwiseOR(_limb(low, 0)))

    return let(_limb(key, 0) * _FACTOR[0] + 1, carried)


def jump(key: Column, shards: int) -> Column:
    """Shard from 0 to ``shards - 1`` of a long key, as the published function gives it. Null keys are key 0.

    A row jumps about ``ln(shards)`` times. Few rows need more than the steps of the first fold; these go on in a
    second one that has as many steps as there can be at all, and no steps for the others."""
    if shards < 1:
        raise ValueError("there must be a shard at least")
    first = min(shards, 8 + 3 * math.ceil(math.log2(shards + 1)))

    def step(state: Column, _: Column) -> Column:
        draw = lambda k: F.floor((state["at"] + 1).cast("double") * (F.lit(2.0**31) / (F.shiftrightunsigned(k, 33) + 1).cast("double"))).cast("long")
        moved = let(_next(state["key"]), lambda k: F.struct(k.alias("key"), state["at"].alias("shard"), draw(k).alias("at")))
        return F.when(state["at"] >= shards, state).otherwise(moved)

    start = F.struct(F.coalesce(key.cast("long"), F.lit(0).cast("long")).alias("key"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("at"))
    some = F.aggregate(F.sequence(F.lit(1), F.lit(first)), start, step)
    rest = lambda s: F.aggregate(F.array_repeat(F.lit(1), F.when(s["at"] < shards, F.lit(shards)).otherwise(F.lit(0))), s, step)
    return (let(some, rest) if first < shards else some)["shard"].cast("int")


def _long(docs: DataFrame, key: str) -> Column:
    return docs[key] if dict(docs.dtypes)[key] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(docs[key])


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard``, all columns as they were (one of that name is replaced). Keys that are no integers are
    hashed to a long; null keys share the shard of key 0. Nothing is shuffled; repeated rows go together."""
    return docs.withColumn("shard", jump(_long(docs, key), shards))


def moves(docs: DataFrame, before: int, after: int, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that go elsewhere when ``before`` shards become ``after``, with ``shard`` and ``new_shard``:
    when shards are appended, only rows of the new ones."""
    both = assign(docs, after, key).withColumnRenamed("shard", "new_shard")
    return assign(both, before, key).where("shard <> new_shard")


def _write(found: DataFrame, path: str, folders: int, files: int) -> None:
    """A folder for each shard. Rows are dealt to the files of their shard by a hash of their place, so that no task
    holds more than a file, whatever the sizes of groups."""
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files))
    found.withColumn("_file", salt).repartition(folders * files, "shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)


def write(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", files: int = 1) -> None:
    """``docs`` as Parquet with a folder for each shard and ``files`` files in each."""
    _write(assign(docs, shards, key), path, shards, files)


def append(docs: DataFrame, path: str, before: int, after: int, key: str = "doc_id", files: int = 1) -> None:
    """Write what appended shards take over from ``docs`` to ``path``, a folder for each of them. No other row moves; the
    old shards leave the rows of :func:`moves` out when they are next rewritten."""
    if after <= before:
        raise ValueError("shards are appended only")
    taken = moves(docs, before, after, key).drop("shard").withColumnRenamed("new_shard", "shard")
    _write(taken, path, after - before, files)


def placed(rows: DataFrame, order: list[str], name: str = "slot") -> DataFrame:
    """``rows`` with ``name``: their places from 0 within their ``shard``, by ``order``. Rows are numbered over all
    shards from one stored table dealt out by range, so no task holds a shard; a shard's first number is then taken off.
    Rows that agree in all of ``order`` are placed in any order, and do not meet in one task."""
    numbered = dense_index(rows.withColumn("_tie", F.monotonically_increasing_id()), ["shard", *order, "_tie"], "_number")
    first = numbered.groupBy("shard").agg(F.min("_number").alias("_first"))  # one row for each shard
    return numbered.join(F.broadcast(first), "shard").withColumn(name, F.col("_number") - F.col("_first")).drop("_number", "_first", "_tie")


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, a row for each row.

    Null texts are empty: size 1, CRC 0. Null ids share one shard, and rows with equal ids are together; slots go by
    id, null ones first, then by size and CRC, and rows that agree in these are in any order. Only these narrow rows are
    shuffled, never texts. An empty table gives an empty result; other columns are ignored."""
    text = F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = assign(rows, shards).withColumn("grown_shard", jump(_long(rows, "doc_id"), shards + 1))
    found = placed(rows, ["doc_id", "size", "text_crc32"])
    return found.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")
