"""Places of rows in files."""

from allelia.operators.ranges import order_proof
from allelia.sources import tsv


def test_ordinals_follow_the_files_of_a_folder(spark, tmp_path):
    sizes, n = {1: 5, 2: 4000, 9: 700, 10: 90_000, 11: 3}, 0
    (tmp_path / "t.tsv").mkdir()
    for part, size in sizes.items():
        with open(tmp_path / "t.tsv" / f"part-{part}.csv", "w") as f:
            f.write("key\tother\n" + "".join(f"{n + k}\tx\n" for k in range(size)))
        n += size
    rows = tsv.read(spark, str(tmp_path / "t.tsv"))
    assert rows.columns == ["key", "other", "_ordinal"] and rows.select("_ordinal").distinct().count() == n
    keyed = rows.selectExpr("_ordinal AS ordinal", "cast(key AS long) AS key")
    assert tuple(order_proof(keyed, "ordinal", ["key"]).first()) == (n, 0)
    assert tuple(order_proof(tsv.read(spark, str(tmp_path / "t.tsv" / "part-10.csv")).selectExpr("_ordinal AS ordinal", "cast(key AS long) AS key"), "ordinal", ["key"]).first()) == (90_000, 0)
