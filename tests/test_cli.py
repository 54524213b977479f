import json
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import toy

from allelia import cli
from allelia.operators import observe
from allelia.plans import tables
from allelia.sources import npz, tsv, vcf


def tsv_rows(spark, path):
    return [r.asDict() for r in tsv.read(spark, path).drop("_ordinal").collect()]


def test_settings():
    p = cli.settings(cli.parser().parse_args(["hic-qc", "--edges", "e", "--out", "o", "--set", "contact.min_contacts=3", "--set", "hard.mode=confidence", "--set", "weighted=true"]))
    assert (p.contact.min_contacts, p.hard.mode, p.weighted) == (3, "confidence", True)
    with pytest.raises(SystemExit):
        cli.settings(cli.parser().parse_args(["hic-qc", "--edges", "e", "--out", "o", "--set", "hard.nothing=3"]))
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["nothing"])


def test_commands_end_to_end(spark, tmp_path):
    reads, variants = toy(tmp_path)
    at = lambda x: str(tmp_path / x)
    small = ["--set", "solver.batch=4", "--set", "solver.iterations=40"]
    cli.main(["extract", "--bam", reads, "--vcf", variants, "--region", "chr1:1-1000", "--out", at("x"), "--npz"])
    assert len(tsv_rows(spark, at("x.observations.tsv"))) == 10 and [r["read_id"] for r in tsv_rows(spark, at("x.reads.tsv"))][0] == "left1"
    assert {r["metric"]: int(r["value"]) for r in tsv_rows(spark, at("x.summary.tsv"))} == {"n_ref": 5, "n_alt": 5, "n_other": 0}
    obs, sites = npz.graph(spark, at("x.npz"), True)
    assert obs.count() == 10 and sites.count() == 4 and obs.agg(F.min("weight")).first()[0] == pytest.approx(9.20029, abs=1e-4)
    for src, out in ((at("x.observations.tsv"), at("a")), (at("x.npz"), at("b"))):
        cli.main(["backbone", "--observations", src, "--out", out])
        d = [int(r["delta"]) for r in tsv_rows(spark, out + ".snp_phases.tsv")]
        assert d == [1, 1, -1, -1]
    cli.main(["solve", "--observations", at("x.npz"), "--out", at("s"), "--debug", *small])
    with np.load(at("s/debug/phaselet_mapping.npz")) as m, np.load(at("s/debug/read_consistency.npz")) as c, np.load(at("s/debug/hyperread_matrix.npz")) as h, np.load(at("s/debug/soft_phaselet_coupling.npz")) as k:
        n = m["phaselet_ids"].max() + 1
        assert len(m["tau"]) == len(m["ps"]) == len(c["margin"]) > 0 and m["snp_ids"].tolist() == c["snp_ids"].tolist() and set(m["tau"].tolist()) <= {-1, 1}
        assert h["shape"][1] == n and k["shape"].tolist() == [n, n] and len(k["indptr"]) == n + 1 and h["indptr"][-1] == len(h["data"])
    assert {x.name for x in (tmp_path / "s" / "debug").iterdir()} >= {"edges.tsv", "soft_edges.tsv", "phaselets.tsv", "hyperreads.tsv", "hyperread_edges.tsv"}
    assert {r["ps"] for r in tsv_rows(spark, at("s/snp_phases.tsv"))} == {"10"} and spark.read.parquet(at("s/debug/coupling")).count() == 6
    cli.main(["export", "--vcf", variants, "--phases", at("a.snp_phases.tsv"), "--observations", at("x.npz"), "--region", "chr1:1-1000", "--out", at("o.vcf")])
    assert [(r.gt, r.ps) for r in vcf.records(spark, at("o.vcf.gz")).orderBy("pos").collect()] == [("0|1", "10")] * 2 + [("1|0", "10")] * 2
    cli.main(["benchmark", "--vcf", variants, "--truth", at("o.vcf.gz"), "--method", f"own:{at('o.vcf.gz')}", "--out", at("m")])
    assert tsv_rows(spark, at("m"))[0]["phased_snps"] == "4"
    cli.main(["run", "--bam", reads, "--vcf", variants, "--region", "chr1:1-1000", "--out", at("r"), *small])
    assert json.loads("\n".join(r.value for r in spark.read.text(at("r/manifest")).collect()))["settings"]["solver"]["batch"] == 4
    with pytest.raises(Exception, match="exists"):
        cli.main(["backbone", "--observations", at("x.npz"), "--out", at("b")])
    loose = ["--set", "contact.min_contacts=1", "--set", "contact.min_confidence=0"]
    cli.main(["hic-edges", "--observations", at("x.npz"), "--phases", at("s/snp_phases.tsv"), "--bam", reads, "--region", "chr1:1-1000", "--out", at("ce")])
    cli.main(["hic-orient", "--edges", at("ce"), "--out", at("co"), *loose])
    cli.main(["hic-qc", "--edges", at("ce"), "--out", at("cq"), *loose])
    assert tsv_rows(spark, at("cq"))[0]["edges"] == "0"  # one phase set has no partner
    cli.main(["hic-apply", "--observations", at("x.npz"), "--phases", at("s/snp_phases.tsv"), "--orientations", at("co.orientations.tsv"), "--vcf", variants, "--region", "chr1:1-1000", "--out", at("h")])
    assert vcf.records(spark, at("h/phased.vcf.gz")).count() == 4


def test_small_helpers(spark):
    o = spark.createDataFrame([("a", 2, 1, 1.0, 0), ("a", 1, -1, 2.0, 1)], "read_id string, snp_idx int, b int, weight double, ordinal long")
    assert [e.snp_idx for e in observe.read_entries(o).first().entries] == [1, 2]
    dim = spark.createDataFrame([(1, "x")], "snp_idx int, y string")
    assert observe.require_all(o.where("snp_idx = 1"), dim, "snp_idx", "site").count() == 1
    with pytest.raises(Exception, match="no site for 2"):
        observe.require_all(o, dim, "snp_idx", "site").collect()
    df, path = tables.stored(spark.range(3), "t")
    assert df.count() == 3
    tables.discard(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_tables_go_with_the_process_and_need_a_shared_folder(tmp_path):
    from conftest import ROOT

    code = f"""
from pyspark.sql import SparkSession
from allelia.plans import tables
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
df, path = tables.stored(spark.range(3), "t")
assert df.count() == 3 and "{tmp_path}/shared/allelia-" in path
class Far:
    master = "spark://host:7077"
class Session:
    sparkContext = Far()
    class conf:
        get = staticmethod(lambda key, default=None: None)
try:
    tables.shared_root(Session())
except RuntimeError:
    print("refused")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120, capture_output=True, text=True)
    assert "refused" in done.stdout and not [x for x in (tmp_path / "shared").iterdir() if x.name.startswith("allelia-")]


def test_the_rest_stands_without_the_training_part(sf_dir):
    code = """
import sys
WITHOUT = sys.argv[1]
class Gone:
    def find_spec(self, name, path=None, target=None):
        if not WITHOUT and (name.startswith("allelia.llm") or name == "corpus_pipeline"):
            raise ModuleNotFoundError(name, name=name)
        if name == WITHOUT:
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q = e.queries()
assert "parity_edges" in q and "vcf_het_sites" in q and not any(x.startswith("op") and x[2].isdigit() for x in q) and set(e.oracle_sql()) <= set(q)
"""
    from conftest import ROOT

    for without in ("", "regex", "xxhash"):
        subprocess.run([sys.executable, "-c", code, without], cwd=ROOT, check=True, timeout=120)
