"""One indexed file from many tasks: its bytes, its index against a plain loop, and what a failed write leaves."""

import glob
import gzip
import random
import struct
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from allelia.sources import bgzf


@pytest.fixture
def parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def lines(n, seed=1):
    rnd, at, out = random.Random(seed), 0, []
    for i in range(n):
        chrom = "chr1" if i < n * 2 // 3 else "chr2"
        at = 0 if out and out[-1][1] != chrom else at + rnd.randrange(0, 900)
        out.append((i, chrom, at, at + rnd.choice((1, 1, 1, 40_000)), f"{chrom}\t{at + 1}\t" + "x" * rnd.randrange(300) + "\n"))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "ordinal long, chrom string, start long, end long, line string")
    return df.select("ordinal", F.encode("line", "UTF-8").alias("data"), "chrom", "start", "end")


def plain_index(raw, rows, head):
    """(bins, windows) by one loop over the file: bin → chunks, window → first record, as virtual offsets."""
    places, at, address = [], 0, 0
    while address < len(raw):
        size = struct.unpack_from("<H", raw, address + 16)[0] + 1
        data = zlib.decompress(raw[address + 18 : address + size - 8], -15)
        places.append((at, address, len(data)))
        at, address = at + len(data), address + size
    starts = [p[0] for p in places]

    def virtual(x):
        import bisect

        k = bisect.bisect_right(starts, x) - 1
        while places[k][2] == 0:
            k -= 1
        return places[k][1] << 16 | x - places[k][0]

    windows, bins, x = defaultdict(dict), defaultdict(set), len(head)
    for _, chrom, start, end, line in rows:
        bins[chrom].add(bgzf.bin_of(start, end))
        for w in range(start >> 14, (end - 1 >> 14) + 1):
            windows[chrom].setdefault(w, virtual(x))
        x += len(line)
    return bins, windows


@pytest.mark.parametrize("n", [0, 1, 9000])
def test_file_of_many_tasks(spark, parts, tmp_path, n):
    rows, path, head = lines(n), str(tmp_path / "x.vcf.gz"), b"#head\n"
    assert bgzf.write(head, frame(spark, rows), path, "tbi") == n
    raw = open(path, "rb").read()
    assert gzip.decompress(raw) == head + "".join(r[4] for r in rows).encode() and raw.endswith(bgzf.END)
    assert not glob.glob(str(tmp_path / "*.tmp"))
    data = bgzf.inflate(open(path + ".tbi", "rb").read())
    names = data[36 : 36 + struct.unpack_from("<i", data, 32)[0]].split(b"\0")[:-1]
    assert [x.decode() for x in names] == list(dict.fromkeys(r[1] for r in rows))
    bins, windows = plain_index(raw, rows, head)
    at = 36 + struct.unpack_from("<i", data, 32)[0]
    for name in (x.decode() for x in names):
        found = set()
        for _ in range(struct.unpack_from("<i", data, at)[0]):
            b, k = struct.unpack_from("<Ii", data, at + 4)
            chunks = [struct.unpack_from("<QQ", data, at + 12 + 16 * i) for i in range(k)]
            assert chunks == sorted(chunks) and all(x < y for x, y in chunks) and all(x[1] >> 16 < y[0] >> 16 for x, y in zip(chunks, chunks[1:]))
            found.add(b)
            at += 8 + 16 * k
        at += 4
        k = struct.unpack_from("<i", data, at)[0]
        linear = struct.unpack_from(f"<{k}Q", data, at + 4)
        at += 4 + 8 * k
        assert found == bins[name] and {w: linear[w] for w in windows[name]} == windows[name]
    for chrom, a, b in (("chr1", 0, 100), ("chr1", 500_000, 520_000), ("chr2", 100_000, 900_000), ("chr1", 0, 1 << 28)) if n > 1 else ():
        ranges = bgzf.tabix_ranges(path, chrom, a, b)
        got = {r.value for r in bgzf.lines_between(spark, path, ranges).collect()}
        want = {r[4][:-1] for r in rows if r[1] == chrom and r[2] < b and r[3] > a}
        assert want <= got


def test_file_through_a_file_system(spark, parts, tmp_path, monkeypatch):
    """Where executors do not share the file's disk the same records and regions come about; ranges are cut by a sample, so blocks may differ."""
    rows, one, two = lines(3000, 5), str(tmp_path / "one.gz"), str(tmp_path / "two.gz")
    bgzf.write(b"#\n", frame(spark, rows), one, "tbi")
    with monkeypatch.context() as m:
        m.setattr(bgzf, "local", lambda path: None)
        bgzf.write(b"#\n", frame(spark, rows), two, "tbi")
    assert gzip.decompress(open(one, "rb").read()) == gzip.decompress(open(two, "rb").read())
    region = [sorted(r.value for r in bgzf.lines_between(spark, p, bgzf.tabix_ranges(p, "chr2", 50_000, 90_000)).collect() if 50_000 <= int(r.value.split("\t")[1]) <= 90_000) for p in (one, two)]
    assert region[0] == region[1] != []


def test_failed_write_leaves_the_old_file(spark, parts, tmp_path):
    path = str(tmp_path / "x.gz")
    bgzf.write(b"#\n", frame(spark, lines(50)), path, "tbi")
    before = open(path, "rb").read()
    bad = frame(spark, lines(50, 2)).withColumn("data", F.when(F.col("ordinal") < 40, F.col("data")).otherwise(F.raise_error(F.lit("lost")).cast("binary")))
    with pytest.raises(Exception, match="lost"):
        bgzf.write(b"#\n", bad, path, "tbi", force=True)
    assert open(path, "rb").read() == before
    with pytest.raises(FileExistsError):
        bgzf.write(b"#\n", frame(spark, lines(5)), path, "tbi")


def test_predicates_reach_the_index(spark, parts, tmp_path):
    """SQL over the source: rows as a scan gives them, fewer bytes planned, and what cannot be pushed is done by Spark."""
    from allelia.sources import indexed

    path, rnd = str(tmp_path / "calls.vcf.gz"), random.Random(3)
    rows = [(i, c, p, p + 1, f"{c}\t{p + 1}\ts{i}\tA\tC\t.\tPASS\t{'x' * rnd.randrange(400)}\tGT\t0|1\t1|0\n") for i, (c, p) in enumerate((c, p) for c in ("1", "2", "3") for p in range(0, 900_000, 300))]
    head = "##fileformat=VCFv4.2\n" + "##note=" + "y" * 200_000 + "\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n"
    bgzf.write(head.encode(), frame(spark, rows), path, "tbi")
    indexed.records(spark, path, "S2", 1 << 14).createOrReplaceTempView("calls")
    for where, keep in (
        ("chrom = '2' AND pos BETWEEN 300000 AND 360000", lambda c, p: c == "2" and 300_000 <= p <= 360_000),
        ("chrom IN ('1', '3') AND pos > 899000 AND id LIKE '%7'", lambda c, p: c in "13" and p > 899_000),
        ("pos <= 1000", lambda c, p: p <= 1000), ("chrom = '9'", lambda c, p: False), ("chrom = '1' AND pos > 10 AND pos < 5", lambda c, p: False), ("true", lambda c, p: True),
    ):
        want = sorted(r[4].split("\t")[2] for r in rows if keep(r[1], r[2] + 1) and ("LIKE" not in where or r[4].split("\t")[2].endswith("7")))
        got = spark.sql(f"SELECT id, call FROM calls WHERE {where}").collect()
        assert sorted(r.id for r in got) == want and {r.call for r in got} <= {"1|0"}, where

    def planned(*filters):
        reader = indexed.Reader(path, None, 1 << 14)
        back = list(reader.pushFilters(list(filters)))
        return back, sum((b.last >> 16) - (b.first >> 16) for b in reader.partitions())

    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual

    whole = planned()[1]
    back, some = planned(EqualTo(("chrom",), "2"), GreaterThanOrEqual(("pos",), 300_000), LessThanOrEqual(("pos",), 360_000), EqualTo(("id",), "s1"))
    assert back == [EqualTo(("id",), "s1")] and 0 < some < whole / 5
    with pytest.raises(Exception, match="no sample"):
        indexed.records(spark, path, "none").collect()
    plan = spark.sql("SELECT * FROM calls WHERE chrom = '2' AND pos > 5 AND id = 's1'")._jdf.queryExecution().executedPlan().toString()
    kept = "".join(x for x in plan.splitlines() if "Filter" in x and "BatchScan" not in x)
    assert "id" in kept and "chrom" not in kept and "pos" not in kept, plan
