"""Queries over whole tables that SQL does not hold, against plain loops over all their rows."""

from collections import defaultdict

import pytest

from allelia import queries
from allelia.params import Solver

SF = "/root/testdata/sf0.01"


def test_read_components_of_all_observations(spark):
    root, by_read = {}, defaultdict(list)
    for r in queries.obs(spark, SF).select("read_id", "snp_idx").collect():
        by_read[r.read_id].append(r.snp_idx)
        root.setdefault(r.snp_idx, r.snp_idx)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for at in by_read.values():
        for x in at[1:]:
            a, b = sorted((find(at[0]), find(x)))
            root[b] = a
    pos = {r.snp_idx: r.pos1 for r in queries.sites(spark, SF).collect()}
    least = defaultdict(list)
    for x in root:
        least[find(x)].append(pos[x])
    got = {r.snp_idx: r.ps for r in queries.QUERIES["read_components"](spark, SF).collect()}
    assert got == {x: min(least[find(x)]) for x in root}


def test_candidates_over_every_read(spark):
    blocks = sorted(r.block for r in queries.labels(spark, SF).collect())
    z = {(r.block, r.cand): r.z for r in queries.samples(spark, SF).collect()}
    values, reads = defaultdict(float), set()
    parts = -(-len(blocks) // 4)
    for r in queries.projected(spark, SF).collect():
        first = r.read_id % parts * 4
        values[r.read_id, first + r.block % 4 if first + r.block % 4 < len(blocks) else first] += r.v
        reads.add(r.read_id)
    field, scores = defaultdict(float), defaultdict(float)
    for (read, block), v in values.items():
        for c in range(6):
            field[read, c] += v * z[block, c]
    for (read, c), f in field.items():
        scores[read % parts, c] += abs(f)
    assert parts > 1 and reads == {r.read_id for r in queries.dealt(spark, SF).select("read_id").distinct().collect()}  # none is dropped
    got = {(r.component, r.cand): r.score for r in queries.QUERIES["candidate_scores"](spark, SF).collect()}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in scores.items()}
    best = {p: max(range(6), key=lambda c: (round(scores[p, c], 6), -c)) for p in range(parts)}
    assert {r.block: r.z for r in queries.QUERIES["candidate_select"](spark, SF).collect()} == {b: z[b, best[b // 4]] for b in blocks}


def test_solver_query_has_the_default_settings(spark, sf_dir):
    assert queries.SOLVER == Solver()
    assert {r.cand for r in queries.QUERIES["solver"](spark, sf_dir).collect()} == set(range(Solver().batch + 1))
