"""Components and signed maximum-spanning forests as rounds of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import discard, stored

ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    kept = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of any comparable type → ``(node, root)``: the least node of each component, for nodes that have
    a link to another. Alternating star contractions; each round is a stored table, and only a checksum is collected."""
    spark = edges.sparkSession
    now, path = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        after, new = stored(_small_star(_large_star(now)), "links")
        discard(spark, path)
        now, path = after, new
    raise RuntimeError("components did not settle")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(node)`` and ``edges(u, v)`` → ``(node, root)`` for every node; one without links is its own root."""
    return nodes.join(connected(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _jump(parents: DataFrame) -> DataFrame:
    """``(node, parent, sign)`` → the same with every parent a root: pointer doubling, signs multiplied."""
    spark = parents.sparkSession
    now, path = stored(parents, "parents")
    for _ in range(ROUNDS):
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("_p"), F.col("sign").alias("_s"))
        after, new = stored(now.join(up, "parent").select("node", F.col("_p").alias("parent"), (F.col("sign") * F.col("_s")).alias("sign"), (F.col("_p") != F.col("parent")).alias("moved")), "parents")
        discard(spark, path)
        still = after.where("moved").isEmpty()
        now, path = after.select("node", "parent", "sign"), new
        if still:
            return now
    raise RuntimeError("pointers did not settle")


def spanning_forest(nodes: DataFrame, edges: DataFrame, ties: list[str]) -> tuple[DataFrame, DataFrame]:
    """Signed maximum-spanning forest by rounds of best incident edges (Boruvka).

    ``edges(u, v, weight, sign, *ties)``: greater weights first, then lesser ``ties``, which with the weight must tell
    any two edges apart, so that the forest is the one a sorted greedy pass finds. Gives ``(node, root, sign)`` for
    every node of ``nodes(node)``, the sign being the product of edge signs on the way to the root, and the edges
    with ``in_forest``. Roots are the least nodes; zero weights must be left out before where they must not join."""
    spark = edges.sparkSession
    first = edges.where("u <> v").select("u", "v", "weight", "sign", *ties)
    live, live_path = stored(first.select(F.col("u").alias("ru"), F.col("v").alias("rv"), F.col("sign").alias("s"), "u", "v", "weight", *ties), "forest")
    state, state_path = stored(nodes.select("node", F.col("node").alias("root"), F.lit(1).alias("sign")), "roots")
    taken, kept_paths = None, []
    order = F.struct(F.col("weight"), *(_descending(c, dict(first.dtypes)[c]) for c in ties))
    for _ in range(ROUNDS):
        if live.isEmpty():
            break
        ends = live.select(F.col("ru").alias("node"), F.col("rv").alias("parent"), F.col("s").alias("sign"), "u", "v", *ties, order.alias("o")).union(
            live.select(F.col("rv").alias("node"), F.col("ru").alias("parent"), F.col("s").alias("sign"), "u", "v", *ties, order.alias("o")))
        best = ends.groupBy("node").agg(F.max_by(F.struct("parent", "sign", "u", "v", *ties), "o").alias("e")).select("node", "e.*")
        best, best_path = stored(best, "best")
        kept_paths.append(best_path)
        chosen = best.select("u", "v", *ties).distinct()
        taken = chosen if taken is None else taken.union(chosen)
        # Two roots that chose one another: the lesser stays root. Others that nothing chose keep themselves.
        back = best.select(F.col("node").alias("parent"), F.col("parent").alias("_back"))
        tree = best.join(back, "parent", "left").select("node", F.when((F.col("_back") == F.col("node")) & (F.col("node") < F.col("parent")), F.col("node")).otherwise(F.col("parent")).alias("p"), "parent", "sign")
        tree = tree.select("node", F.col("p").alias("parent"), F.when(F.col("p") == F.col("node"), 1).otherwise(F.col("sign")).alias("sign"))
        jumped = _jump(tree)
        roots = jumped.select(F.col("node").alias("root"), F.col("parent").alias("_r"), F.col("sign").alias("_s"))
        after, path = stored(state.join(roots, "root", "left").select("node", F.coalesce("_r", "root").alias("root"), (F.col("sign") * F.coalesce("_s", F.lit(1))).alias("sign")), "roots")
        discard(spark, state_path)
        state, state_path = after, path
        a = jumped.select(F.col("node").alias("ru"), F.col("parent").alias("_a"), F.col("sign").alias("_sa"))
        b = jumped.select(F.col("node").alias("rv"), F.col("parent").alias("_b"), F.col("sign").alias("_sb"))
        moved = live.join(a, "ru", "left").join(b, "rv", "left").select(
            F.coalesce("_a", "ru").alias("ru"), F.coalesce("_b", "rv").alias("rv"), (F.col("s") * F.coalesce("_sa", F.lit(1)) * F.coalesce("_sb", F.lit(1))).alias("s"), "u", "v", "weight", *ties)
        after, path = stored(moved.where("ru <> rv"), "forest")
        discard(spark, live_path)
        live, live_path = after, path
    else:
        raise RuntimeError("the forest did not settle")
    least = state.groupBy("root").agg(F.min(F.struct("node", "sign")).alias("l"))
    signed = state.join(least, "root").select("node", F.col("l.node").alias("root"), (F.col("sign") * F.col("l.sign")).alias("sign"))
    if taken is None:
        return signed, edges.withColumn("in_forest", F.lit(False))
    marks = taken.withColumn("_in", F.lit(True))
    return signed, edges.join(marks, ["u", "v", *ties], "left").withColumn("in_forest", F.coalesce("_in", F.lit(False))).drop("_in")


def _descending(name: str, kind: str) -> Column:
    """A key whose greatest value is the least of the column."""
    if kind == "string":
        # Each character turned round; the end of the string, behind a last high mark, sorts before any more of it.
        return F.concat(F.translate(F.hex(name), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~")).alias(name)
    return (-F.col(name)).alias(name)
