"""Work carried over the ends of ranges, and columns of a pileup, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from allelia.operators import evaluate, observe, ranges
from allelia.params import Observing


@pytest.fixture
def small_ranges(spark):
    """Many ranges, some of them empty."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n", [0, 1, 5, 400])
def test_carried_rows_and_sums(spark, small_ranges, n):
    rnd = random.Random(n)
    rows = [(i, rnd.choice((None, 1, 2, 3))) for i in range(n)]
    df = spark.createDataFrame(rnd.sample(rows, n), "k int, v int")
    placed = ranges.ranged(df, ["k"])
    before = {r.k: (r._last_k, r._last_v) for r in ranges.with_previous(placed, ["k", "v"]).collect()}
    assert before == {k: rows[k - 1] if k else (None, None) for k, _ in rows}
    total, want = 0, {}
    for k, v in rows:
        total += v or 0
        want[k] = total
    assert {r.k: r.s for r in ranges.running_sum(placed.withColumn("w", F.coalesce("v", F.lit(0))), "w", "s").collect()} == want


def test_order_proof(spark, small_ranges):
    df = spark.range(300).select("id", (F.col("id") / 2).cast("long").alias("k"))
    proof = lambda d: tuple(ranges.order_proof(d, "id", ["k"]).first())
    assert proof(df) == (300, 0) and proof(df.limit(0)) == (0, 0)
    assert proof(df.withColumn("k", F.when(F.col("id").isin(7, 150), -1).otherwise(F.col("k")))) == (300, 2)


def calls(n, seed):
    rnd, out, at = random.Random(seed), [], 0
    for i in range(n):
        at += rnd.randrange(1, 50)
        out.append(("hot" if i < n * 4 // 5 else "c2", at, "A", "C", rnd.randrange(2), f"ps{rnd.choice((0, 0, 0, 1, rnd.randrange(2, 60)))}", i))
    return out


def plain_block_n50(rows):
    size = {}
    for c, *_, ps, _ in rows:
        size[c, ps] = size.get((c, ps), 0) + 1
    spans, last = [], None
    for c, pos, _, _, _, ps, _ in sorted(rows, key=lambda r: (r[0], r[1], r[6])):
        if size[c, ps] < 2:
            continue
        if last and last[:2] == [c, ps]:
            last[3], last[4] = pos, last[4] + 1
        else:
            last = [c, ps, pos, pos, 1]
            spans.append(last)
    spans = sorted((s[3] - s[2] for s in spans if s[4] > 1), reverse=True)
    run = 0
    for s in spans:
        run += s
        if 2 * run >= sum(spans):
            return s / 1000
    return 0.0


@pytest.mark.parametrize("n", [0, 3, 900])
def test_blocks_of_one_hot_chromosome(spark, small_ranges, n):
    rows = calls(n, n)
    df = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, phase int, ps string, ordinal long")
    assert evaluate.block_n50(df).first().n50_kb == pytest.approx(plain_block_n50(rows))
    plan = evaluate.block_n50(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "chrom" not in "".join(x for x in plan.splitlines() if "Window" in x)


def test_errors_of_one_long_phase_set(spark, small_ranges):
    rnd = random.Random(8)
    rows = [("c", i * 10, "A", "C", rnd.randrange(2), "one", i) for i in range(500)]
    truth = [(c, p, r, a, rnd.randrange(2), "t1" if i < 450 else "t2", i) for i, (c, p, r, a, *_) in enumerate(rows)]
    schema = "chrom string, pos long, ref string, alt string, phase int, ps string, ordinal long"
    got = evaluate.phase_errors(spark.createDataFrame(truth, schema), spark.createDataFrame(rows, schema)).first()
    d = [a[4] ^ b[4] for a, b in zip(rows, truth)]
    blocks = [d[:450], d[450:]]
    assert got.switches == sum(x != y for b in blocks for x, y in zip(b, b[1:])) and got.assessed_pairs == 498
    assert got.hamming == sum(min(sum(b), len(b) - sum(b)) for b in blocks)


def test_pileup_takes_the_first_reads_of_a_column(spark):
    """Supplementary, low and gapped alignments take up depth; failed and duplicate ones do not. A hot column is cut."""
    reads = []
    for i in range(60):
        flag = {3: 0x400, 4: 0x200, 5: 0x800, 6: 0x100, 7: 0x4}.get(i, 0)
        cigar = "2M4D8M" if i == 8 else "10M"
        reads.append((i, f"r{i}", flag, "c", 100 + i % 3, 5 if i == 9 else 60, cigar, "ACGTACGTAC", [30] * 10))
    al = spark.createDataFrame(reads, "ordinal long, name string, flag int, chrom string, start0 int, mapq int, cigar string, seq string, qual array<int>")
    sites = spark.createDataFrame([(0, "s0", "c", 105, "A", "C"), (1, "s1", "c", 500, "A", "C")], "snp_idx int, snp_id string, chrom string, pos1 int, ref string, alt string")
    p = Observing(dedup=False, scan="pileup", max_depth=15)
    piled = sorted((r for r in reads if not r[2] & (0x400 | 0x200 | 0x100 | 0x4)), key=lambda r: (r[4], r[0]))
    first = piled[:15]
    shown = [r for r in first if not r[2] & 0x800 and r[5] >= 20 and r[6] == "10M"]
    alleles = {r[1]: {"A": 1, "C": -1}.get(r[7][104 - r[4]]) for r in shown}
    rows, counts = observe.observations(al, sites, p)
    assert {r.read_id: r.b for r in rows.collect()} == {k: v for k, v in alleles.items() if v}
    assert counts.first().n_other == sum(v is None for v in alleles.values())
    got = {r.snp_idx: r for r in observe.pileup_columns(al, sites, p).collect()}
    assert (got[0].covering, got[0].depth, got[0].n_gap) == (len(piled), 15, sum(r[6] != "10M" for r in first))
    assert got[0].n_low == len(first) - len(shown) - got[0].n_gap and got[0].n_ref + got[0].n_alt + got[0].n_other == len(shown)
    assert got[1].depth == got[1].covering == got[1].n_low == 0
    limited = observe.within_depth(al, sites, 15)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in limited
