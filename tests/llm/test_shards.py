"""Jump hashing against the published loop, and what holds when shards are appended."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from allelia.llm import shards


def published(key, n):
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 16, 17, 1000, 1 << 17])
def test_jump(spark, n):
    rnd = random.Random(n)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(rnd.getrandbits(64) - 2**63 for _ in range(300))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert all(r.s == published(r.k, n) for r in df.select("k", shards.jump(F.col("k"), n).alias("s")).collect())


ROWS = [(1, None), (2, ""), (2, ""), (2, "other"), (None, "a"), (None, "a"), (3, "é" * 10), *((i, "copy") for i in range(10, 400))]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("slot", "size", "law", "_tie", "_number")})


def test_report(spark):
    got = shards.report(frame(spark)).collect()
    assert len(got) == len(ROWS)
    said = sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got)
    assert said == sorted((d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in ROWS)
    for r in got:
        assert r.law == "key" and r.shard == published(r.doc_id or 0, 16) and r.grown_shard in (r.shard, 16)
        assert r.grown_shard == published(r.doc_id or 0, 17)
    for s in range(16):
        own = sorted((r.slot, r.doc_id or -1) for r in got if r.shard == s)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own)


def test_report_of_nothing(spark):
    assert shards.report(frame(spark, [])).collect() == []


def test_one_key_is_numbered_in_many_tasks(spark):
    """A key with all rows: slots stay gapless, and no range of the stored table holds them all."""
    rows = spark.range(40_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(1).alias("shard"))
    got = shards.placed(rows, ["doc_id"])
    assert got.agg(F.min("slot"), F.max("slot"), F.countDistinct("slot")).first()[:] == (0, 39_999, 40_000)


def test_appended_shards(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    shards.write(docs, str(tmp_path / "old"), 5, files=2)
    old = spark.read.parquet(str(tmp_path / "old"))
    assert old.count() == 3000 and all(r.shard == published(r.doc_id, 5) for r in old.collect())
    shards.append(docs, str(tmp_path / "new"), 5, 7)
    new = {r.doc_id: r.shard for r in spark.read.parquet(str(tmp_path / "new")).collect()}
    assert new == {i: published(i, 7) for i in range(3000) if published(i, 7) != published(i, 5)}
    assert set(new.values()) == {5, 6} and 0.2 < len(new) / 3000 < 0.37  # two sevenths move
    with pytest.raises(ValueError):
        shards.append(docs, str(tmp_path / "x"), 5, 5)


def test_other_keys(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "name string, text string")
    a, b = (sorted(map(tuple, shards.assign(docs.repartition(n), 9, "name").collect()), key=repr) for n in (1, 3))
    assert a == b and all(0 <= r[2] < 9 for r in a)
