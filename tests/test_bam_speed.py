"""Alignments are encoded once, in ranges of their own; short intervals meet few points."""

import pytest

from allelia.operators import observe
from allelia.sources import bam


def test_bases_and_cigars_there_and_back():
    for seq in ("", "A", "=ACMGRSVTWYHKDBN", "ACGTN"):
        packed = bam._packed_bases(seq)
        assert packed == bytes(bam._BASES.index(x) << 4 | bam._BASES.index(y) for x, y in zip(seq[::2], (seq[1::2] + "=")[: (len(seq) + 1) // 2]))
    for bad in ("a", "AX1", "é", "0"):
        with pytest.raises(ValueError):
            bam._packed_bases(bad)
    assert bam._cigar(bam._packed_cigar("3S7M2D5M1I4M")[0]) == ("3S7M2D5M1I4M", 18) and bam._packed_cigar("3S7M2D5M1I4M")[1] == 18


def test_records_are_encoded_behind_the_exchange_and_once(spark, tmp_path):
    done = spark.sparkContext.accumulator(0)
    encoded = bam.encoded

    def counted(rows, names):
        def run(batches):
            for b in batches:
                done.add(b.num_rows)
                yield b

        out = encoded(rows, names)
        return out.mapInArrow(run, out.schema)

    bam.encoded = counted
    try:
        rows = spark.range(500).selectExpr("id AS ordinal", "concat('r', id) AS name", "0 AS flag", "'c' AS chrom", "id AS start0", "30 AS mapq", "'4M' AS cigar", "'ACGT' AS seq", "unhex('1e1e1e1e') AS qual")
        assert bam.write(rows, str(tmp_path / "x.bam"), [("c", 1000)]) == 500
    finally:
        bam.encoded = encoded
    assert done.value == 500
    back = bam.alignments(spark, str(tmp_path / "x.bam")).collect()
    assert [(r.name, r.start0, r.cigar, r.seq, r.qual) for r in back] == [(f"r{k}", k, "4M", "ACGT", [30] * 4) for k in range(500)]


def test_short_and_long_intervals_meet_each_point_once(spark):
    a = [(k, s, s + n) for k, (s, n) in enumerate((s, n) for s in (0, 1, 31, 32, 127, 128, 1000, 4095) for n in (1, 2, 31, 32, 33, 128, 129, 1023, 1024, 5000))]
    b = list(range(0, 9000, 7))
    got = observe.interval_join(spark.createDataFrame(a, "k long, s long, e long"), spark.createDataFrame([(x,) for x in b], "p long"), "s", "e", "p", bin_size=1024).select("k", "p").collect()
    assert sorted(map(tuple, got)) == sorted((k, x) for k, s, e in a for x in b if s <= x < e)
    plan = observe.interval_join(spark.createDataFrame(a, "k long, s long, e long"), spark.createDataFrame([(x,) for x in b], "p long"), "s", "e", "p")
    assert plan.columns == ["k", "s", "e", "p"]
