import random

import brute
import pytest
from pyspark.sql import functions as F

from allelia.llm import substring


def check(spark, rows, size=35, run=12):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ranges": F.lit("x"), "mark": F.lit(0), "pos": F.lit(1)})
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digest(df, size, run).collect()}
    assert got == brute.repeats(dict(rows), size)
    return got


def test_table(spark, sf_dir):
    got = check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()])
    assert 0 < sum(x[1] for x in got.values()) < sum(x[0] for x in got.values())


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(spark, seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(40))
    passages = [[word() for _ in range(rnd.choice([8, 9, 12, 15, 30, 60]))] for _ in range(6)]
    rows = []
    for d in range(40):
        text = []
        for _ in range(rnd.randrange(5)):
            text += [word() for _ in range(rnd.randrange(12))]
            p = rnd.choice(passages)
            a = rnd.randrange(0, 6)
            text += p[a : a + rnd.randrange(4, 60)]
        rows.append((d, " ".join(text)))
    check(spark, rows, size=9, run=3)


def test_nasty(spark):
    line = " ".join(f"w{i}" for i in range(36))
    rows = [(1, None), (2, ""), (3, " \n"), (4, line), (5, "x " + line + " y"), (6, "a " * 500), (7, " ".join(f"u{i}" for i in range(34))), (8, " ".join(f"u{i}" for i in range(34))), (9, line.replace(" ", "\x0b")), (10, "é b " * 40)]
    got = check(spark, rows)
    assert got[5][1] == 36 and got[6][1] == 500 and got[7][1] == 0
    assert substring.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(None, line), (1, line + " tail"), (1, line + " tail")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in substring.remove_repeats(twice).collect()) == [("1", ""), ("1", ""), ("None", "")]
