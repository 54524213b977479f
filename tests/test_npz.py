"""Archives written by executors, held against numpy; compressed ones, and ones that must be refused."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelia.operators.observe import dense_index
from allelia.sources import npz


@pytest.mark.parametrize("a, b", [(b"", b""), (b"x", b""), (b"", b"abc"), (b"chr1", b"\0" * 1000), (bytes(range(256)) * 9, b"tail")])
def test_checksum_of_two_strings(a, b):
    assert npz.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def numbered(spark, n, parts=5):
    rows = spark.range(n).select("id", ((F.col("id") * 7) % 251).alias("k"), (F.col("id") / 3).alias("x"), F.concat(F.lit("é𝄞"), F.col("id").cast("string")).alias("t"))
    return dense_index(rows.repartition(parts), ["id"], "_row")


COLUMNS = {"k": ("k", "|u1"), "x": ("x", "<f4"), "t": ("t", "U")}


@pytest.mark.parametrize("n", [0, 1, 40_000])
def test_numpy_reads_what_executors_wrote(spark, tmp_path, n):
    path = str(tmp_path / "new" / "a.npz")
    npz.write_arrays([(numbered(spark, n), COLUMNS)], path, {"tag": np.asarray(["v"])})
    ids = np.arange(n)
    with np.load(path) as z:  # checks the checksums too
        assert z["tag"].tolist() == ["v"] and (z["k"] == ids * 7 % 251).all() and z["k"].dtype == np.uint8
        assert (z["x"] == (ids / 3).astype(np.float32)).all() and z["t"].tolist() == [f"é𝄞{i}" for i in ids]
    assert npz.count(path, "k") == n
    back = npz.arrays(spark, path, ["k", "t"], 4096)
    assert back.rdd.getNumPartitions() > 10 or n < 2
    assert [tuple(r) for r in back.orderBy("row").collect()] == [(i, i * 7 % 251, f"é𝄞{i}") for i in range(n)]
    with pytest.raises(FileExistsError):
        npz.write_arrays([(numbered(spark, 1), COLUMNS)], path)
    npz.write_arrays([(numbered(spark, 2), COLUMNS)], path, force=True)
    assert npz.count(path, "x") == 2 and [p.name for p in (tmp_path / "new").iterdir()] == ["a.npz"]


def test_compressed_and_foreign_arrays(spark, tmp_path):
    path = str(tmp_path / "c.npz")
    n = 3 * npz.BATCH + 5
    np.savez_compressed(path, a=np.arange(n, dtype=">i4"), b=np.arange(n) % 2 == 0, s=np.asarray([b"acgt"] * n), two=np.zeros((2, 2)), short=np.zeros(3))
    got = npz.arrays(spark, path, ["a", "b", "s"], 1024)
    assert got.agg(F.count("*"), F.sum("a"), F.sum("b"), F.min("s"), F.count_if(F.col("a") != F.col("row"))).first() == (n, n * (n - 1) // 2, (n + 1) // 2, "acgt", 0)
    assert npz.count(path, "a") == n and "two" not in npz.members(path)
    for bad in (["two"], ["a", "short"], ["none"]):
        with pytest.raises(Exception, match="not a column|different lengths|no array"):
            npz.arrays(spark, path, bad).collect()


@pytest.mark.parametrize("k, row, kind, match", [("256", "_row", "|u1", "does not fit"), ("cast(null as string)", "_row", "U", "null"), ("1", "_row * 2", "|u1", "without gaps")])
def test_rows_that_do_not_fit_leave_no_file(spark, tmp_path, k, row, kind, match):
    rows = numbered(spark, 9).selectExpr(f"{k} AS k", f"{row} AS _row")
    with pytest.raises(Exception, match=match):
        npz.write_arrays([(rows, {"k": ("k", kind)})], str(tmp_path / "a.npz"))
    assert not list(tmp_path.iterdir())


def test_sparse_rows_with_empty_ones(spark, tmp_path):
    path = str(tmp_path / "m.npz")
    cells = [(i, j, i + j / 10) for i in (0, 3, 4, 9) for j in (8, 2, 5)[: i % 3 + 1]]
    npz.write_sparse(spark.createDataFrame(cells, "row long, column long, value double"), 12, 9, path)
    with np.load(path) as z:
        assert z["shape"].tolist() == [12, 9] and z["format"].item() == b"csr"
        assert z["indptr"].tolist() == [sum(i < r for i, _, _ in cells) for r in range(13)]
        assert z["indices"].tolist() == [j for _, j, _ in sorted(cells)] and z["data"].tolist() == [x for _, _, x in sorted(cells)]
    assert sorted(map(tuple, npz.sparse(spark, path).collect())) == sorted(cells)
    npz.write_sparse(spark.createDataFrame([], "row long, column long, value double"), 0, 0, path, force=True)
    with np.load(path) as z:
        assert z["indptr"].tolist() == [0]
