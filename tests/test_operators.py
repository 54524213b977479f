import itertools
import math
import random
import time

import files
import numpy as np
import pytest
from pyspark.sql import functions as F

from allelia.functions import arrays, evidence
from allelia.operators import blocks, collapse, contacts, coupling, evaluate, graph, observe, parity, risk, select, solve
from allelia.params import Collapse, Contact, Hard, Observing, Params, Soft, Solver
from allelia.plans import phasing
from allelia.sources import bam, bgzf, sinks, tsv, vcf


def obs(spark, rows):
    """rows: (read, site, b, weight)."""
    return spark.createDataFrame([(r, s, b, float(w), k) for k, (r, s, b, w) in enumerate(rows)], "read_id string, snp_idx int, b int, weight double, ordinal long")


def sites(spark, positions, chrom="chr1"):
    return spark.createDataFrame([(i, f"{chrom}:{p}:A>C", chrom, p, "A", "C") for i, p in enumerate(positions)], "snp_idx int, snp_id string, chrom string, pos1 long, ref string, alt string")


def taus(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "snp_idx int, tau int")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# ---- functions ----


@pytest.mark.parametrize("q, m, eps, w", [(13, 20, 0.059617536, 2.758336908), (30, 60, 0.001000999, 6.905755276), (60, 60, 0.0001, 9.210240367), (0, 60, 0.49, 0.040005335), (40, 90, 1.0099990e-4, 9.200290)])
def test_weights(spark, q, m, eps, w):
    e = evidence.error_rate(F.lit(q), F.lit(m))
    assert one(spark, e) == pytest.approx(eps, rel=1e-6) and one(spark, evidence.evidence_weight(e)) == pytest.approx(w, rel=1e-6)


def test_small_functions(spark):
    assert evidence.parse_region("chr1:1-1,000") == ("chr1", 1, 1000) and evidence.parse_region("chr1:1-1,000", True) == ("chr1", 0, 1000) and evidence.parse_region(None) is None
    assert one(spark, evidence.usable_baseq(F.lit(None).cast("int"), Observing(default_baseq=0))) == 13
    assert one(spark, evidence.usable_baseq(F.lit(None).cast("int"), Observing(default_baseq=30))) == 30
    assert [one(spark, evidence.sign_or(F.lit(v), F.lit(-1))) for v in (-2.0, 0.0, 3.0)] == [-1, -1, 1] and one(spark, evidence.sign_or(F.lit(0.0))) == 1
    assert one(spark, evidence.pair_name(F.lit("x/1/2"))) == "x/1" and one(spark, evidence.pair_name(F.lit("x/3"))) == "x/3"
    assert one(spark, evidence.anchor_score(F.lit(-2), F.lit(0), 60)) == pytest.approx(0.1)
    assert [one(spark, c) for c in evidence.site_parts(F.lit("chr1:5:a>c")).values()] == ["chr1", 5, "A", "C"]
    assert one(spark, evidence.edge_risk(F.lit(1.0), F.lit(2), F.lit(10), F.lit(0.5))) == pytest.approx(0.23653688, abs=1e-7)
    assert one(spark, evidence.edge_risk(F.lit(1.0), F.lit(1), F.lit(20), F.lit(1.0))) == pytest.approx(0.41640626, abs=1e-7)
    assert one(spark, evidence.chrom_alias(F.lit("1"), {"1": "chr1"})) == "chr1" and one(spark, evidence.chrom_alias(F.lit("2"), {"1": "chr1"})) == "2"
    assert evidence.method_spec("a:b.vcf:x,y") == ("a", "b.vcf", ["x", "y"]) and evidence.method_spec("a:b.vcf") == ("a", "b.vcf", [])
    with pytest.raises(ValueError):
        evidence.method_spec("a")
    assert [one(spark, evidence.component_order(F.lit(x)))[0] for x in ("7", "x")] == [7, 10**18]


@pytest.mark.parametrize("norm, value", [("sum", 2), ("mean", 1), ("sqrt", 1.414214), ("cap", 2), ("sqrt_cap", 1.414214), ("degree_norm_cap", 1.414214), ("adaptive_dom_cap", 2)])
def test_hyperread_collapse(spark, norm, value):
    o = obs(spark, [("a", 0, 1, 2), ("a", 1, 1, 1), ("b", 2, 1, 1), ("b", 3, 1, 1), ("c", 1, 1, 1), ("c", 2, 1, 1), ("d", 1, -1, 1), ("d", 2, -1, 1)])
    found = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "snp_idx int, block int")
    v = collapse.read_vectors(collapse.projection(parity.read_site_matrix(o, True), taus(spark, [1, 1, 1, 1]), found))
    assert tuple(collapse.single_profile(v).first()) == (2, 5.0, 2)
    m = collapse.pattern_ids(collapse.hyper_matrix(collapse.patterns(v), Collapse(norm=norm))).orderBy("block").collect()
    assert [(r.hyper, r.path, r.signs, r.raw, r.reads, r.degree, r.block_degree, r.domination) for r in m] == [(0, [0, 1], [1, 1], 2.0, 2, 2, 1, 1.0)] * 2
    assert [r.value for r in m] == pytest.approx([value] * 2, abs=1e-6) and m[0].capped == (norm == "adaptive_dom_cap")


def test_unknown_choices():
    with pytest.raises(ValueError):
        evidence.normalized(F.lit(1), F.lit(1), F.lit(1), F.lit(1), F.lit(1), Collapse(norm="x"))
    with pytest.raises(ValueError):
        risk.classify(None, Hard(mode="x"))


# ---- observations ----


def test_cigar_walk(spark):
    a = spark.createDataFrame([(1, 100, "5S10M2I3D10M"), (2, 0, "3H2P4=1X2N1M"), (3, 7, "5S")], "k int, start0 long, cigar string")
    got = sorted((r.k, r.ref_start, r.ref_end, r.query_start) for r in observe.aligned_blocks(a).collect())
    assert got == [(1, 100, 110, 5), (1, 113, 123, 17), (2, 0, 4, 0), (2, 4, 5, 4), (2, 7, 8, 5)]


def test_interval_join_against_all_pairs(spark):
    rnd = random.Random(1)
    iv = [(i, s := rnd.randrange(3000), s + rnd.randrange(0, 400)) for i in range(80)]
    pt = [(j, rnd.randrange(3200)) for j in range(150)]
    got = observe.interval_join(spark.createDataFrame(iv, "i int, s long, e long"), spark.createDataFrame(pt, "j int, p long"), "s", "e", "p", bin_size=64)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, s, e in iv for j, p in pt if s <= p < e)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_best_observation(spark):
    o = obs(spark, [("a", 1, 1, 2), ("a", 1, -1, -3), ("a", 1, 1, 3), ("b", 1, 1, 1)])
    assert sorted((r.read_id, r.b, r.weight) for r in observe.best_per_read_site(o).collect()) == [("a", -1, -3.0), ("b", 1, 1.0)]


def test_chunks_and_indices(spark):
    s = sites(spark, [10, 20, 40, 50])
    assert [r.chunk for r in observe.site_chunks(s, 20).orderBy("pos1").collect()] == [0, 0, 1, 2]
    assert {r.chunk for r in observe.site_chunks(s, 0).collect()} == {0}
    o = obs(spark, [("z", 1, 1, 1), ("a", 1, 1, 1), ("z", 2, 1, 1)])
    assert {r.read_id: r.read_idx for r in observe.read_index(o).collect()} == {"z": 0, "a": 1}
    assert observe.dense_index(o.limit(0), ["ordinal"], "n").count() == 0


def test_held_out(spark):
    import hashlib

    o = obs(spark, [(f"r{i}", 0, 1, 1) for i in range(200)])
    got = {r.read_id: r.validation for r in observe.held_out(o, 0.3, "salt").collect()}
    want = {r: int.from_bytes(hashlib.blake2b(f"salt:{r}".encode(), digest_size=8).digest(), "little") / 2**64 < 0.3 for r in got}
    assert got == want and not any(r.validation for r in observe.held_out(o, 0, "salt").collect())
    with pytest.raises(ValueError):
        observe.held_out(o, 0.5, "salt")


# ---- edges ----


def test_parity_edges(spark):
    o = obs(spark, [("0", 0, 1, 2), ("0", 1, 1, 1), ("1", 0, -1, 1), ("1", 1, -1, 1)])
    for weighted in (False, True):
        assert [tuple(r) for r in parity.parity_edges(o, weighted=weighted).collect()] == [(0, 1, 2.0, 2.0, 2, 1.0)]
    # a site seen twice keeps both places: only its last one pairs on
    twice = obs(spark, [("a", 0, 1, 1), ("a", 0, -1, 1), ("a", 1, 1, 1)])
    assert [tuple(r) for r in parity.parity_edges(twice).collect()] == [(0, 1, -1.0, 1.0, 1, 1.0)]
    far = parity.parity_edges(obs(spark, [("a", 0, 1, 1), ("a", 1, 1, 1), ("a", 2, 1, 1)]), sites(spark, [10, 20, 90]), 30)
    assert [(r.i, r.j) for r in far.collect()] == [(0, 1)]


def test_file_edges(spark):
    e = spark.createDataFrame([(2, 1, 1.0, 3.0, 2, None, 0), (1, 2, 5.0, 6.0, 3, 2.0, 1), (3, 3, 1.0, 1.0, 1, 1.0, 2), (4, 5, 1.0, 3.0, 0, None, 3)], "i int, j int, score double, support double, cnt long, max_abs double, ordinal long")
    assert sorted(map(tuple, parity.file_edges(e).collect())) == [(1, 2, 5.0, 6.0, 3, 2.0), (4, 5, 1.0, 3.0, 0, 3.0)]


def classified(spark, rows, tau, hard=Hard(), soft=Soft(), positions=(10, 20, 30, 40)):
    e = spark.createDataFrame(rows, "i int, j int, score double, support double, cnt long, max_abs double")
    m = risk.measured(e, sites(spark, list(positions)))
    return {(r.i, r.j): (r.edge_class, r.status, r.conflicting, r.weak) for r in risk.classify(risk.with_signs(m, taus(spark, tau)), hard, soft).collect()}


def test_classes(spark):
    strong, split = (4.0, 4.0, 4, 1.0), (0.0, 4.0, 4, 1.0)
    got = classified(spark, [(0, 1, *strong), (0, 2, -4.0, 4.0, 4, 1.0), (0, 3, *split), (1, 2, 1.0, 1.0, 1, 1.0)], [1, 1, 1, 1])
    assert got[0, 1][:2] == ("hard", "hard") and got[0, 2] == ("soft_conflicting_tau", "soft_bridge_conflicting_tau", True, False)
    assert got[0, 3] == ("drop", "drop_high_hard_risk", False, True) and got[1, 2][0] == "soft"
    none = classified(spark, [(0, 1, -4.0, 4.0, 4, 1.0), (0, 3, *split), (1, 2, 1.0, 1.0, 1, 1.0)], [1, 1, 1, 1], Hard(mode="confidence"), Soft(mode="none"))
    assert [none[k][1] for k in ((0, 1), (0, 3), (1, 2))] == ["drop_conflicting_tau", "drop_weak_hard_confidence", "drop_weak_hard_support"]
    # risk mode takes no notice of the least confidence; far edges vanish
    low = classified(spark, [(0, 1, 8.0, 10.0, 20, 0.5), (0, 3, *strong)], [1, 1, 1, 1], Hard(min_confidence=0.99, max_distance=20))
    assert low == {(0, 1): ("hard", "hard", False, False)}


# ---- graph ----


def kruskal(n, edges):
    root, sign = list(range(n)), [1] * n

    def find(x):
        s = 1
        while root[x] != x:
            s *= sign[x]
            x = root[x]
        return x, s

    kept = set()
    for u, v, w, s, t in sorted(edges, key=lambda e: (-e[2], e[4])):
        (a, sa), (b, sb) = find(u), find(v)
        if a != b:
            root[b], sign[b] = a, sa * sb * s
            kept.add((u, v))
    comp = [find(x) for x in range(n)]
    least = {}
    for x, (r, s) in enumerate(comp):
        least.setdefault(r, (x, s))
    return kept, {x: (least[r][0], s * least[r][1]) for x, (r, s) in enumerate(comp)}


@pytest.mark.parametrize("seed", range(2))
def test_forest_against_a_sorted_pass(spark, seed):
    rnd = random.Random(seed)
    n = 40
    edges = [(u, v, rnd.randrange(1, 6), rnd.choice((-1, 1)), k) for k, (u, v) in enumerate(rnd.sample(list(itertools.combinations(range(n), 2)), 50))]
    df = spark.createDataFrame([(u, v, float(w), s, t) for u, v, w, s, t in edges], "u int, v int, weight double, sign int, t int")
    signed, marked = graph.spanning_forest(spark.range(n).select(F.col("id").cast("int").alias("node")), df, ["t"])
    kept, want = kruskal(n, edges)
    assert {(r.u, r.v) for r in marked.collect() if r.in_forest} == kept
    assert {r.node: (r.root, r.sign) for r in signed.collect()} == want


def test_components_and_empty_graphs(spark):
    nodes = spark.range(6).withColumnRenamed("id", "node")
    e = spark.createDataFrame([(1, 2), (2, 4), (4, 1), (5, 5)], "u long, v long")
    assert {r.node: r.root for r in graph.components(nodes, e).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    signed, marked = graph.spanning_forest(nodes, spark.createDataFrame([], "u long, v long, weight double, sign int, t int"), ["t"])
    assert signed.count() == 6 and marked.count() == 0


def test_text_nodes_and_ties(spark):
    e = spark.createDataFrame([("10", "20", 5.0, 1), ("20", "30", 4.0, -1), ("10", "30", 4.0, 1)], "ci string, cj string, score double, x int")
    kept = contacts.retained(e.select("ci", "cj", (F.col("score") * F.col("x")).alias("score"), F.lit(20).alias("contacts"), F.lit(1.0).alias("confidence")))
    table, chosen = contacts.orient(kept)
    # two edges of one score: (10, 30) comes before (20, 30) as text
    assert {(r.ci, r.cj) for r in chosen.collect()} == {("10", "20"), ("10", "30")}
    assert {r.component: r.orientation for r in table.collect()} == {"10": 1, "20": 1, "30": 1}


def test_orientation(spark):
    e = spark.createDataFrame([("10", "20", 5.0, 20, 1.0), ("20", "30", -4.0, 20, 1.0), ("7", "8", 9.0, 3, 1.0)], "ci string, cj string, score double, contacts int, confidence double")
    table, chosen = contacts.orient(contacts.retained(e))
    assert {r.component: (r.orientation, r.hic_ps) for r in table.collect()} == {"10": (1, "10"), "20": (1, "10"), "30": (-1, "10")} and chosen.count() == 2
    assert [r.component_id for r in sinks.orientation_file(table).collect()] == ["10", "20", "30"]


# ---- blocks and choice ----


def test_margins_and_release(spark):
    m = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, -1.0), ("b", 2, -100.0)], "read_id string, snp_idx int, v double")
    tau = taus(spark, [1, 1, 1])
    margin = blocks.consistency_margin(m, tau)
    assert [r.margin for r in margin.orderBy("snp_idx").collect()] == [0.0, 0.0, -1.0]
    classes = spark.createDataFrame([(0, 1, "hard"), (1, 2, "hard")], "i int, j int, edge_class string")
    found = blocks.numbered_blocks(blocks.relaxed_blocks(sites(spark, [10, 20, 30]), classes, margin))
    assert {r.snp_idx: r.block for r in found.collect()} == {0: 0, 1: 0, 2: 1}
    v = collapse.projection(m.where("read_id = 'a'"), tau, found)
    assert sorted((r.block, r.v) for r in v.collect()) == [(0, 2.0), (1, -1.0)]
    t = blocks.block_table(found, sites(spark, [10, 20, 30])).orderBy("block").collect()
    assert [(r.start, r.end, r.n_sites) for r in t] == [(10, 20, 2), (30, 30, 1)]


def test_soft_edges_are_clipped_before_the_sum(spark):
    c = spark.createDataFrame([(0, 2, 100.0, 1, 1, "soft"), (1, 2, 100.0, 1, 1, "soft_conflicting_tau"), (0, 1, 9.0, 1, 1, "soft"), (0, 2, 9.0, 1, 1, "hard")], "i int, j int, score double, cnt int, expected_sign int, edge_class string")
    b = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "snp_idx int, block int")
    assert [tuple(r) for r in coupling.soft_coupling(c, b).collect()] == [(0, 1, 20.0, 2, 200.0)]


def choice(spark, p, candidates, labels):
    proj = spark.createDataFrame([(f"r{r}", b, float(v)) for r, row in enumerate(p) for b, v in enumerate(row) if v], "read_id string, block int, v double")
    s = spark.createDataFrame([(b, c, z) for c, col in enumerate(candidates) for b, z in enumerate(col)], "block int, cand int, z int")
    z, mode = select.choose(proj, s, spark.createDataFrame(list(enumerate(labels)), "block int, component long"))
    return [r.z for r in z.orderBy("block").collect()], mode


def test_choice_by_component(spark):
    assert choice(spark, [[3, 2, 0, 0], [0, 0, 1, 3]], [[1, 1, 1, -1], [1, -1, 1, 1]], [0, 0, 2, 2]) == ([1, 1, 1, 1], "component_profiled_F")
    assert choice(spark, [[1, 1]], [[1, -1], [1, 1]], [0, 1]) == ([1, 1], "global_nonseparable_validation")


def test_choice_against_all_combinations(spark):
    rng = np.random.default_rng(4)
    p = np.zeros((8, 6), int)
    p[:4, :3], p[4:, 3:] = rng.integers(-3, 4, (4, 3)), rng.integers(-3, 4, (4, 3))
    cands = rng.choice((-1, 1), (5, 6))
    got, _ = choice(spark, p.tolist(), cands.tolist(), [0, 0, 0, 3, 3, 3])
    best = max(np.abs(p @ np.concatenate([a[:3], b[3:]])).sum() for a in cands for b in cands)
    assert np.abs(p @ np.array(got)).sum() == best


def test_solver_is_exact_on_small_components_and_limited(spark):
    rng = np.random.default_rng(5)
    rows, n_hyper, n_blocks = [], 30, 9
    for h in range(n_hyper):
        part = rng.choice(4, 2, replace=False) if h % 2 else 4 + rng.choice(5, 3, replace=False)
        rows += [(h, int(b), float(rng.integers(-3, 4)) or 1.0) for b in part]
    hyper = spark.createDataFrame(rows, "hyper int, block int, value double")
    soft = spark.createDataFrame([(0, 3, -2.0), (4, 8, 1.5)], "l int, r int, coeff double")
    j = coupling.ising_coupling(hyper, soft, n_hyper)
    z = {r.block: r.z for r in solve.solve(j, n_hyper, n_blocks, Solver(batch=6, iterations=60)).where("cand = 0").collect()}
    dense = np.zeros((n_hyper, n_blocks))
    for h, b, v in rows:
        dense[h, b] += v

    def score(s):
        return np.abs(dense @ s).sum() - 2 * s[0] * s[3] + 1.5 * s[4] * s[8]

    assert score(np.array([z[b] for b in range(n_blocks)])) == pytest.approx(max(score(np.array(s)) for s in itertools.product((1, -1), repeat=n_blocks)))
    heuristic = {}
    for r in solve.solve(j, n_hyper, n_blocks, Solver(batch=20, iterations=300, exact_blocks=0)).collect():
        heuristic.setdefault(r.cand, {})[r.block] = r.z
    scores = [score(np.array([c[b] for b in range(n_blocks)])) for c in heuristic.values()]
    assert len(heuristic) == 21 and max(scores) >= 0.9 * max(score(np.array(s)) for s in itertools.product((1, -1), repeat=n_blocks))
    steps = solve.trace(j, n_hyper, n_blocks, Solver(batch=3, iterations=120)).collect()
    assert {r.step for r in steps} == {50, 100, 120} and len({r.root for r in steps}) * 3 * 3 == len(steps) and all(r.energy < 0 for r in steps if r.step == 120)
    assert solve.trace(j.limit(0), n_hyper, n_blocks).count() == 0
    with pytest.raises(solve.TooLarge):
        solve.solve(j, n_hyper, n_blocks, Solver(max_nodes=10))
    assert solve.solve(j.limit(0), n_hyper, n_blocks).count() == 0


# ---- evaluation ----


def calls(spark, rows):
    """rows: (pos, phase, ps[, chrom])."""
    return spark.createDataFrame([((r[3] if len(r) > 3 else "chr1"), r[0], "A", "C", r[1], r[2], k) for k, r in enumerate(rows)], "chrom string, pos long, ref string, alt string, phase int, ps string, ordinal long")


def test_block_sizes(spark):
    c = calls(spark, [(p, 0, "A") for p in (1, 101, 901, 1001)] + [(p, 0, "B") for p in (401, 501)] + [(601, 0, "S")])
    assert evaluate.span_n50(c).first()[0] == 1.001 and evaluate.block_n50(c).first()[0] == 0.1
    two = calls(spark, [(1, 0, "A"), (101, 0, "A"), (20, 0, "A", "chr2"), (30, 0, "A", "chr2")])
    assert evaluate.block_n50(two).first()[0] == 0.1
    single = calls(spark, [(1, 0, "A")])
    for n50 in (evaluate.span_n50, evaluate.block_n50):
        assert n50(single).first()[0] == 0 and n50(single.limit(0)).first()[0] == 0
    near = calls(spark, [(10, 0, "A"), (20, 0, "A")])
    assert evaluate.span_n50(near).first()[0] == 0.011 and evaluate.block_n50(near).first()[0] == 0.010


def test_phase_errors(spark):
    truth = calls(spark, [(10, 0, "T1"), (20, 0, "T1"), (30, 1, "T2"), (40, 1, "T2")])
    e = evaluate.phase_errors(truth, calls(spark, [(p, 0, "P") for p in (10, 20, 30, 40)])).first()
    assert (e.hamming, e.switches, e.covered_variants, e.assessed_pairs) == (0, 0, 4, 2)
    one_ = calls(spark, [(p, 0, "T") for p in (1, 2, 3, 4, 5)])
    e = evaluate.phase_errors(one_, calls(spark, [(p, int(p in (3,)), "P") for p in (1, 2, 3, 4, 5)])).first()
    assert (e.hamming, e.switches, e.assessed_pairs) == (1, 2, 4) and e.switch_error_rate == 0.5
    assert evaluate.phase_errors(one_, one_.limit(0)).first().covered_variants == 0


def test_elapsed(spark, tmp_path):
    log = tmp_path / "t.log"
    log.write_text("x\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 0:12.50\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02:03\n")
    assert evaluate.elapsed_seconds(spark.read.text(str(log))).first()[0] == 12.5 + 3723


def test_edge_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "ci string, cj string, score double, abs_score double, contacts int, confidence double")
    assert tuple(contacts.edge_summary(empty).first()) == (0, 0, 0.0, 0.0, 0.0, 0)


# ---- files ----


def test_bam_source(spark, tmp_path):
    path = str(tmp_path / "x.bam")
    reads = [(f"r{i}", 16 * (i % 2), 0, i * 1000, 60, "2S8M", "ACGTACGTAN", [30 + i % 5] * 10 if i % 3 else None) for i in range(100)] + [("u", 4, -1, -1, 0, "", "A", [1])]
    files.write_bam(path, [("chr1", 10**6)], reads, per_block=3, index=True)
    for split in (200, 1 << 26):
        got = bam.alignments(spark, path, split_bytes=split)
        assert (got.rdd.getNumPartitions() > 3) == (split == 200)
        rows = sorted(got.collect(), key=lambda r: r.start0)
        assert [(r.name, r.flag, r.start0, r.cigar, r.seq, r.qual) for r in rows] == sorted([(n, f, s, c, q, w) for n, f, _, s, _, c, q, w in reads], key=lambda r: r[2])
        some = bam.alignments(spark, path, "chr1:20,005-30,001", split)
        assert sorted(r.start0 for r in some.collect()) == [i * 1000 for i in range(20, 31)]
    assert bam.alignments(spark, path, "chr9:1-5").count() == 0


def test_vcf_source_and_export(spark, tmp_path):
    path, out = str(tmp_path / "x.vcf"), str(tmp_path / "out.vcf.gz")
    files.write_vcf(path, ["S1", "S2"], [
        ("chr1", 10, "A", "C", "ZZ=a;b", "GT", ["0/0", "0/1"]), ("chr1", 20, "g", "T", ".", "GT:DP", ["0/1", "1|0:7"]), ("chr1", 25, "AT", "A", ".", "GT", ["0/1", "0/1"]),
        ("chr1", 30, "A", "C,G", ".", "GT", ["0/1", "1/2"]), ("chr1", 40, "A", "C", ".", "GT", ["./.", "./1"]), ("chr2", 10, "A", "C", ".", "GT", ["0/1", "0/1"])])
    s = vcf.het_sites(spark, path, ("chr1", 1, 1000), "S2").orderBy("snp_idx").collect()
    assert [(r.snp_idx, r.snp_id, r.ref) for r in s] == [(0, "chr1:10:A>C", "A"), (1, "chr1:20:g>T", "G")]
    assert vcf.choose_sample(vcf.header(spark, path)) == "S1"
    with pytest.raises(ValueError):
        vcf.choose_sample(vcf.header(spark, path), "S3")
    p = spark.createDataFrame([("chr1:10:A>C", 1, None), ("chr1:20:g>T", -1, None)], "snp_id string, delta int, ps long")
    head, lines = vcf.phased_lines(spark, path, p, ("chr1", 1, 1000), "S2", 1)
    assert lines.where("written").count() == 2 and lines.where("NOT written").count() == 3
    assert sinks.write_vcf(head, lines, out) == (2, 3)
    back = vcf.records(spark, out).orderBy("ordinal").collect()
    assert [(r.pos, r.gt, r.ps, r["info"]) for r in back] == [(10, "0|1", "1", "ZZ=a;b"), (20, "1|0", "1", ".")]
    assert back[1].call == "1|0:7:1" and vcf.sample_names(vcf.header(spark, out)) == ["S2"]
    with pytest.raises(FileExistsError):
        sinks.write_vcf(head, lines, out)
    assert [r.pos for r in vcf.records(spark, out, None, ("chr1", 15, 25)).collect()] == [20]


def test_indexed_vcf_gives_the_same_rows_as_a_scan(spark, tmp_path):
    """Over several blocks and references, and with a line longer than a block."""
    path = str(tmp_path / "big.vcf.gz")
    rnd = random.Random(2)
    rows = [(k, f"chr{1 + k // 4000}", 1 + (k % 4000) * 37, "x" * (200_000 if k == 2500 else rnd.randrange(5, 80))) for k in range(8000)]
    df = spark.createDataFrame(rows, "ordinal long, chrom string, pos long, info string")
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), F.lit("A"), F.lit("C"), F.lit("."), F.lit("PASS"), "info", F.lit("GT"), F.lit("0|1"))
    head = "##fileformat=VCFv4.2\n" + "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "S"]) + "\n"
    n = bgzf.write(head.encode(), df.repartition(5).select("ordinal", F.concat(line, F.lit("\n")).cast("binary").alias("data"), "chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end")), path, "tbi")
    assert n == 8000 and vcf.records(spark, path).count() == 8000
    for chrom, a, b in (("chr1", 1, 10**9), ("chr1", 92_000, 93_000), ("chr2", 38, 38), ("chr2", 147_964, 10**6), ("chr2", 10**6, 10**7), ("chr3", 1, 5)):
        got = [(r.pos, r["info"]) for r in vcf.records(spark, path, None, (chrom, a, b)).orderBy("ordinal").collect()]
        assert got == [(p, i) for _, c, p, i in rows if c == chrom and a <= p <= b], (chrom, a, b)
    ranges = bgzf.tabix_ranges(path, "chr1", 0, 10**8, split=1000)
    assert len(ranges) > 3 and bgzf.lines_between(spark, path, ranges).where("value like 'chr1%'").count() == 4000


def test_bam_sink_reads_back_by_region(spark, tmp_path):
    path = str(tmp_path / "own.bam")
    rows = [(k, f"r{k}", 16 * (k % 2), "chr2", k * 50, 30, "5M1D5M", "ACGTACGTAC", bytes([20 + k % 10] * 10) if k % 7 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "ordinal long, name string, flag int, chrom string, start0 long, mapq int, cigar string, seq string, qual binary")
    assert bam.write(df.repartition(3), path, [("chr1", 10), ("chr2", 10**6)]) == 3000
    for region, split in (("chr2:1-200,000", 1 << 12), ("chr2:40,001-40,100", 64 << 20)):
        a, b = (int(x.replace(",", "")) for x in region[5:].split("-"))
        got = bam.alignments(spark, path, region, split).orderBy("start0").collect()
        want = [r for r in rows if r[4] < b and r[4] + 11 > a - 1]
        assert [(r.name, r.flag, r.start0, r.cigar, r.seq, r.qual and bytes(r.qual)) for r in got] == [(r[1], r[2], r[4], r[6], r[7], r[8]) for r in want]


def test_tables_round_trip(spark, tmp_path):
    o = obs(spark, [("a", 0, 1, 2), ("a", 1, -1, 1), ("b", 0, 1, 1)]).withColumns({"snp_id": F.format_string("chr1:%d:A>C", (F.col("snp_idx") + 1) * 10), "baseq": F.lit(30), "mapq": F.lit(60), "epsilon": F.lit(0.1)})
    sinks.write_tsv(sinks.observation_file(o), str(tmp_path / "o"), ["read_id", "snp_id"], compressed=True)
    back = tsv.observations(spark, str(tmp_path / "o"), weighted=True)
    assert sorted((r.read_id, r.snp_id, r.b, r.weight) for r in back.collect()) == [("a", "chr1:10:A>C", 1, 2.0), ("a", "chr1:20:A>C", -1, 1.0), ("b", "chr1:10:A>C", 1, 1.0)]
    with pytest.raises(ValueError):
        tsv.observations(spark, str(tmp_path / "o"), True, "nothing")
    indexed, s = tsv.indexed(tsv.observations(spark, str(tmp_path / "o")))
    assert [r.pos1 for r in s.orderBy("snp_idx").collect()] == [10, 20] and indexed.where("weight = 1").count() == 3
    sinks.write_tsv(sinks.edge_file(parity.parity_edges(indexed), s), str(tmp_path / "e"))
    e = tsv.parity_edges(spark, str(tmp_path / "e"), s).first()
    assert (e.i, e.j, e.score, e.support, e.cnt, e.max_abs) == (0, 1, -1.0, 1.0, 1, 1.0)
    (tmp_path / "p.tsv").write_text("snp_id\tdelta\tPS\nx\t1\t5.0\ny\t-1\tNA\n")
    assert [(r.delta, r.ps) for r in tsv.phases(spark, str(tmp_path / "p.tsv")).collect()] == [(1, 5), (-1, None)]
    assert tsv.key_values(spark, str(tmp_path / "none.tsv")) == {}


# ---- whole plans ----


def toy(tmp_path):
    files.write_vcf(str(tmp_path / "sites.vcf"), ["S"], [("chr1", p, "A", "C", ".", "GT", ["0/1"]) for p in (10, 20, 40, 50)])
    reads = [("left1", 0, 0, 9, 60, "11M", "A" * 11, [40] * 11), ("left2", 0, 0, 9, 60, "11M", "A" * 11, [40] * 11), ("bridge", 0, 0, 19, 60, "21M", "A" * 20 + "C", [40] * 21)]
    reads += [(f"right{k}", 0, 0, 39, 60, "11M", "C" * 11, [40] * 11) for k in (1, 2)]
    files.write_bam(str(tmp_path / "reads.bam"), [("chr1", 1000)], reads, index=True)
    return str(tmp_path / "reads.bam"), str(tmp_path / "sites.vcf")


def test_reads_to_phases(spark, tmp_path):
    reads, variants = toy(tmp_path)
    out = str(tmp_path / "out")
    r = phasing.phase_files(spark, reads, variants, "chr1:1-1000", None, Params(solver=Solver(batch=4, iterations=40)), out)
    assert r.obs.count() == 10 and r.obs.select("weight").first()[0] == pytest.approx(9.200290, abs=1e-5)
    assert {(x.i, x.j): x.score for x in r.edges.collect()} == {(0, 1): 2.0, (1, 2): -1.0, (2, 3): 2.0}
    assert [x.tau for x in r.tau.orderBy("snp_idx").collect()] == [1, 1, -1, -1]
    assert [x.margin for x in r.margins.orderBy("snp_idx").collect()] == [2.0, 3.0, 3.0, 2.0]
    assert {x.snp_idx: x.block for x in r.blocks.collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    assert [(x.path, x.signs, x.raw) for x in r.hyper.orderBy("block").collect()] == [([0, 1], [1, 1], 1.0)] * 2
    assert [tuple(x)[:3] for x in r.soft.collect()] == [(0, 1, 0.25)] and r.coupling.count() == 6
    p = r.phases.orderBy("snp_idx").collect()
    assert [x.delta * p[0].delta for x in p] == [1, 1, -1, -1] and {x.ps for x in p} == {10}
    s = r.summary().first()
    assert (s.objective, s.disagreement, s.blocks, s.patterns) == (10.0, 0.0, 2, 1)
    assert {x.status for x in phasing.edge_statuses(r).collect()} == {"soft_bridge", "hard_retained"}
    stats = risk.risk_stats(r.classes, phasing.edge_statuses(r)).first()
    assert stats.mean_retained_risk == pytest.approx(0.23653688, abs=1e-7) and stats.max_soft_risk == pytest.approx(0.41640626, abs=1e-7)
    back = vcf.records(spark, f"{out}/phased.vcf.gz").orderBy("pos").collect()
    assert [x.gt for x in back] in (["0|1", "0|1", "1|0", "1|0"], ["1|0", "1|0", "0|1", "0|1"]) and {x.ps for x in back} == {"10"}
    m = phasing.benchmark(spark, variants, f"{out}/phased.vcf.gz", [f"own:{out}/phased.vcf.gz"]).first()
    assert (m.SE_percent, m.HE_percent, m.phased_snps, m.input_het_snps, m.phasing_completeness_percent, m.SNP_completeness_percent) == (0, 0, 4, 4, 100, 100)
    r.views()
    assert spark.sql("SELECT count(*) FROM phasing_obs").first()[0] == 10


def test_weighted_and_held_out_reads(spark):
    rnd = random.Random(9)
    true = [rnd.choice((-1, 1)) for _ in range(30)]
    rows = []
    for k in range(400):
        a, side = rnd.randrange(27), rnd.choice((-1, 1))
        rows += [(f"r{k}", s, side * true[s] * (-1 if rnd.random() < 0.03 else 1), rnd.uniform(2, 9)) for s in range(a, a + 4) if s < 30]
    o = obs(spark, rows)
    for weighted in (False, True):
        r = phasing.phase(o, sites(spark, [i * 100 + 1 for i in range(30)]), Params(weighted=weighted, solver=Solver(batch=4, iterations=40)), observe.held_out(o, 0.1, "v") if weighted else None, 0.5)
        d = [x.delta for x in r.phases.orderBy("snp_idx").collect()]
        assert abs(sum(a * b for a, b in zip(d, true))) == 30


def test_contacts_extend_phase_sets(spark, tmp_path):
    reads = []
    for k in range(20):
        reads.append((f"m{k}/1", 0, 0, 9, 60, "11M", "A" * 11, [40] * 11))
    for k in range(20):
        reads.append((f"m{k}/2", 0, 0, 39, 60, "11M", "C" * 11, [40] * 11))
    path = str(tmp_path / "c.bam")
    files.write_bam(path, [("chr1", 1000)], reads)
    s = sites(spark, [10, 20, 40, 50, 80])
    phases = spark.createDataFrame([(0, 1, 10), (1, 1, 10), (2, 1, 40), (3, 1, 40), (4, 1, 80)], "snp_idx int, delta int, ps long")
    done, edges, table = phasing.extend_by_contacts(phases, s, bam.alignments(spark, path), Params())
    e = edges.first()
    assert (edges.count(), e.contacts, e.score, e.same, e.opposite, e.confidence) == (1, 20, -40.0, 0.0, 40.0, 1.0)
    got = {r.snp_idx: (r.delta, r.ps) for r in done.collect()}
    assert got == {0: (1, "10"), 1: (1, "10"), 2: (-1, "10"), 3: (-1, "10"), 4: (1, "80")}
    with pytest.raises(Exception, match="must cover"):
        contacts.component_sites(s, phases.withColumn("ps", F.when(F.col("snp_idx") > 0, F.col("ps")))).collect()
    with pytest.raises(Exception, match="need observations"):
        contacts.component_sites(s, phases.withColumn("ps", F.lit(None).cast("long"))).collect()
    bare = contacts.component_sites(s, phases.withColumn("ps", F.lit(None).cast("long")), phases.select("snp_idx", "ps"))
    assert bare.count() == 5 and math.isclose(Contact().alpha, 0.1)


def test_numbers_of_wide_rows_have_no_gaps(spark, tmp_path):
    """Written out, with columns beyond the order: every number once."""
    n = 300_000
    rows = spark.range(n).select((F.col("id") * 7919 % 300_007).alias("ordinal"), F.concat(F.lit("x" * 30), F.col("id").cast("string")).alias("wide"), F.lit("A").alias("ref"))
    observe.dense_index(rows.repartition(7), ["ordinal"], "idx").write.parquet(str(tmp_path / "n"))
    got = spark.read.parquet(str(tmp_path / "n"))
    assert got.agg(F.countDistinct("idx"), F.min("idx"), F.max("idx"), F.countDistinct("wide")).first() == (n, 0, n - 1, n)
    ordered = got.select("idx", "ordinal").orderBy("idx").toPandas()
    assert (ordered["ordinal"].diff().dropna() > 0).all()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 129, 5000])
def test_running_sums(spark, n):
    sizes = [(7 * k) % 11 for k in range(n)]
    got = spark.createDataFrame([(sizes,)], "x array<long>").select(arrays.sums_before(F.col("x")).alias("s")).first().s
    assert got == [sum(sizes[:k]) for k in range(n)]


def test_long_cigars_take_time_in_proportion(spark):
    took = {}
    for k in (20_000, 200_000):
        reads = spark.createDataFrame([(0, "5M1I" * k)], "start0 long, cigar string")
        began = time.time()
        assert observe.aligned_blocks(reads).agg(F.count("*"), F.max("ref_end"), F.max("query_start")).first() == (k, 5 * k, 6 * k - 6)
        took[k] = time.time() - began
    assert took[200_000] < 40 * max(took[20_000], 0.5)


def test_solver_limit_is_by_component(spark):
    j = [(0, 10, 1.0), (10, 0, 1.0), (1, 11, -1.0), (11, 1, -1.0)]
    df = spark.createDataFrame(j, "u long, v long, w double")
    small = Solver(batch=2, iterations=5, max_nodes=2)
    assert solve.solve(df, 10, 2, small).select("block").distinct().count() == 2
    with pytest.raises(solve.TooLarge):
        solve.solve(df.union(spark.createDataFrame([(0, 11, 1.0), (11, 0, 1.0)], df.schema)), 10, 2, small)


def test_key_value_files_are_whole_or_refused(spark, tmp_path):
    path = str(tmp_path / "kv.tsv")
    with open(path, "w") as f:
        f.write("metric\tvalue\n" + "".join(f"m{k}\t{k}\n" for k in range(30)))
    assert len(tsv.key_values(spark, path)) == 30 and tsv.key_values(spark, path + ".none") == {}
    with pytest.raises(ValueError, match="more than 20"):
        tsv.key_values(spark, path, 20)


def test_molecules_of_many_components_are_paired_in_cells(spark):
    rng = random.Random(5)
    rows = [(f"m{m}", f"c{rng.randrange(60):02d}", rng.choice((-1, 1)), rng.randrange(1, 9) / 4, k) for k, m in enumerate([0] * 150 + [1] * 40 + [2] * 6 + [3])]
    found = spark.createDataFrame(rows, "query_name string, component string, sign int, score double, ordinal long")
    best = {}
    for q, c, s, w, k in rows:
        if (q, c) not in best or (w, -k) > best[q, c][:2]:
            best[q, c] = w, -k, s
    want = {}
    for (q, a), (r, b) in itertools.product(best, best):
        if q == r and a < b:
            w, s = max(0.1, min(best[q, a][0], best[r, b][0])), best[q, a][2] * best[r, b][2]
            old = want.get((a, b), (0.0, 0))
            want[a, b] = old[0] + w * s, old[1] + 1
    for cell in (7, 1000):
        got = {(r.ci, r.cj): (r.score, r.contacts) for r in contacts.component_edges(found, cell=cell).collect()}
        assert got == want
    assert contacts.component_edges(found.limit(0)).count() == 0
