"""What one task or one Python worker holds."""

import pyarrow as pa

from allelia import queries
from allelia.operators import parity
from allelia.sources import bgzf


def test_deduplicated_reads_are_not_added_up_again(spark, sf_dir, capsys):
    found = queries.matrix(spark, sf_dir, weighted=True)
    found.explain()
    assert "HashAggregate" not in capsys.readouterr().out  # two tables of all rows of a task, before
    summed = parity.read_site_matrix(queries.obs(spark, sf_dir), True)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, summed.collect()))


def test_groups_of_records_hold_a_mark_for_each_bin_and_not_for_each_record():
    n = 40_000
    rows = pa.RecordBatch.from_arrays([pa.array([b"x" * 20] * n), pa.array(["c"] * n), pa.array(range(n)), pa.array(range(10, n + 10))], ["data", "chrom", "start", "end"])
    groups = [g.to_pylist()[0] for g in bgzf._packed(iter([rows.slice(0, 25_000), rows.slice(25_000)]))]
    assert len(groups) == n * 20 // bgzf.MOST + 1
    assert all(len(x) < 12 for g in groups for x in g.values() if isinstance(x, list))  # one for each record, before
    assert sum(g["records"] for g in groups) == n
    first = 0
    for g in groups:
        marks = {}
        for k in range(first, first + g["records"]):
            for b in (bgzf.bin_of(k, k + 10), *(-1 - w for w in range(k >> 14, (k + 9 >> 14) + 1))):
                marks.setdefault(b, (k - first) * 20)
        assert dict(zip(g["bin"], g["at"])) == marks
        first += g["records"]
