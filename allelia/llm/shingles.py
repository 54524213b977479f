"""Near copies by the words themselves: two texts are linked where the Jaccard similarity of their word shingles is high.

Candidates of a link share a band of ``ROWS`` least hashes: a pair at 0.8 has none of the ``BANDS`` in common once in
twenty million. A bucket's members are held against its most central one first, which settles nearly all of a group
of copies in a number of pairs that grows with its members. Of the buckets that are not one component then, rare
shingles come before common ones, and two similar texts must share one of the rarest fifth of theirs (a prefix filter):
texts that differ from all others in that many shingles meet nobody. Before sets are compared, a sketch of parities
gives a lower bound of how many shingles differ. Nothing is left out by any of this.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected
from .common import Words, materialize, merged, one_of_each, per_slice
from .xxh import xxh64

#: The similarity of a link as a fraction; bands and least hashes in each; words of 64 bits in a sketch.
SIMILAR, BANDS, ROWS, SKETCH = (4, 5), 32, 4, 8

_DRAW = np.random.default_rng(41)
_FLIP = _DRAW.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _DRAW.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def node_of() -> Column:
    """A row is known by its id and a hash of its text; null ids come last."""
    return F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")).alias("node")


def sets_of(texts: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in one array, and how many each has: one for texts of fewer words, whichever they are."""
    w = Words(texts, lower=True)
    n = np.where(w.count > 0, np.maximum(w.count - shingle + 1, 1), 0)
    offset = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(w.first - offset[:-1], n) + np.arange(offset[-1])
    last = first + np.repeat(np.minimum(w.count, shingle) - 1, n)
    h = xxh64(w.buf, w.start[first], w.end[last] - w.start[first]) if len(first) else np.zeros(0, np.uint64)
    bare = np.flatnonzero(n == 0)
    h = np.concatenate([h, np.zeros(len(bare), np.uint64)])
    at = np.concatenate([np.repeat(np.arange(len(texts)), n), bare])
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (at[1:] != at[:-1])]) if len(h) else np.zeros(0, bool)
    return h[new], np.bincount(at[new], minlength=len(texts))


def bands_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One key for each text and band, of the least hashes under the band's permutations."""
    begin = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), BANDS), np.uint64)
    for k, (flip, times) in enumerate(zip(_FLIP, _TIMES)):
        band = k // ROWS
        least = np.minimum.reduceat((hashes ^ flip) * times, begin)
        mixed = (out[:, band] ^ least ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, band] = mixed ^ (mixed >> np.uint64(29))
    return out


def sketches_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parity of how many shingles fall on each bit. Two texts' sketches differ in no more bits than their sets do in shingles."""
    bit = (hashes >> np.uint64(40)) % np.uint64(64 * SKETCH)
    begin = np.cumsum(sizes) - sizes
    one = np.uint64(1) << (bit % np.uint64(64))
    return np.stack([np.bitwise_xor.reduceat(np.where(bit // np.uint64(64) == k, one, np.uint64(0)), begin) for k in range(SKETCH)], axis=1)


def _lists(values: np.ndarray) -> pa.Array:
    """The rows of a table of unsigned longs as lists."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64).ravel()))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(node_of(), "text").select("node.id", "node.mark", "text")


def _noded(found: DataFrame) -> DataFrame:
    return found.select(F.struct("id", "mark").alias("node"), *found.columns[2:])


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """``(node, n, fp, keys)`` of each row, stored: how many shingles, the fingerprint, the key of each band."""
    from .simhash import fingerprints_of

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        hashes, sizes = sets_of(texts, shingle)
        fp = pa.array(fingerprints_of(texts, shingle).view(np.int64))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes.astype(np.int64)), fp, _lists(bands_of(hashes, sizes))], ["id", "mark", "n", "fp", "keys"])

    return materialize(_noded(_rows(docs).mapInArrow(per_slice(run), "id long, mark long, n long, fp long, keys array<long>")), "signatures")


def sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``(node, n, s, sketch)`` of the rows in ``nodes(node)``, stored."""

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        hashes, sizes = sets_of(texts, shingle)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        cols = [part.column(0), part.column(1), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(hashes.view(np.int64))), _lists(sketches_of(hashes, sizes))]
        return pa.RecordBatch.from_arrays(cols, ["id", "mark", "n", "s", "sketch"])

    kept = docs.select(node_of(), "text").join(merged(nodes.distinct()), "node", "left_semi").dropDuplicates(["node"])
    return materialize(_noded(kept.select("node.id", "node.mark", "text").mapInArrow(per_slice(run), "id long, mark long, n long, s array<long>, sketch array<long>")), "shingles")


def buckets(rows: DataFrame) -> DataFrame:
    """``(key, node, n, size)`` of the bands that several nodes share, stored. Keys are counted before any row is moved to its key."""
    banded = rows.select("node", "n", F.explode("keys").alias("key"))
    shared = materialize(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    return materialize(banded.join(shared, "key"), "buckets")


def stars(members: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of each member with its bucket's most central one: that which meets the most others in all its buckets."""
    score = members.groupBy("node").agg(F.sum("size").alias("score"))
    ranked = members.select("key", "node").join(score, "node")
    centre = ranked.groupBy("key").agg(F.max_by("node", F.struct("score", -F.col("node.id"), -F.col("node.mark"))).alias("v"))
    return members.select("key", F.col("node").alias("u")).join(centre, "key").where("u <> v").select("u", "v")


def _rare_pairs(texts: DataFrame, roots: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Pairs of texts in different components that share a shingle among the rarest of both, as similar texts must.

    Of n shingles so many may be missing from the other text, and one more is looked at. Shingles that one text alone
    has come first; they take up places but meet nobody. What comes before the rarest shared shingle in either text is
    not in the other, so what comes from there on must be as many as similar texts of these sizes share, in both. In
    the smaller one it is then early: among as many of the first as its half of what may differ. Others meet early ones
    only."""
    part, whole = similar
    owned = texts.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n", "s")
    tokens = owned.select("node", F.explode("s").alias("h"))
    common = materialize(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "common")
    ranked = tokens.join(common, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x"))  # as long as a text at most
    alone = F.col("n") - F.size("x")
    looked_at = F.greatest(F.lit(0), (F.col("n") - F.ceil(F.col("n") * part / whole) + 1 - alone).cast("int"))
    rare = owned.select("node", "root", "n").join(ranked, "node").select("node", "root", "n", alone.alias("alone"), F.transform(F.slice("x", 1, looked_at), lambda t: t["h"]).alias("rare"))
    placed = rare.select("node", "root", "n", "rare", "alone", F.posexplode("rare").alias("at", "h"))
    placed = placed.withColumn("place", F.col("alone") + F.col("at")).drop("alone", "at")
    posted = materialize(placed.withColumn("early", F.col("place") * (part + whole) <= F.col("n") * (whole - part)), "postings")
    several = posted.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("early").alias("early")).where("a <> b and early").select("h")
    posted = posted.join(several, "h", "left_semi")
    a, b = (posted.select("h", *(F.col(c).alias(c + x) for c in ("node", "root", "n", "place", "early", "rare"))) for x in "uv")
    a = a.where("earlyu")
    once = ~F.col("earlyv") | (F.col("nodeu") < F.col("nodev"))
    near = once & (F.col("rootu") != F.col("rootv")) & (F.least("nu", "nv") * whole >= F.greatest("nu", "nv") * part)
    left = F.least(F.col("nu") - F.col("placeu"), F.col("nv") - F.col("placev"))
    near = near & (left * (part + whole) >= (F.col("nu") + F.col("nv")) * part)
    # A pair is made at the rarest shingle it shares.
    near = near & (F.col("h") == F.get(F.array_intersect("rareu", "rarev"), F.lit(0)))
    return a.join(b, "h").where(near).select(F.col("nodeu").alias("u"), F.col("nodev").alias("v"))


def _verified(pairs: DataFrame, texts: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough, stored; sketches are compared before any set is sent."""
    part, whole = similar
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    a, b = (texts.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("k" + x)) for x in "uv")
    bits = F.aggregate(F.zip_with("ku", "kv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    # Jaccard similarity is (total - different) / (total + different).
    few = lambda different: different * (part + whole) <= (F.col("nu") + F.col("nv")) * (whole - part)
    likely = materialize(pairs.join(a, "u").join(b, "v").where(few(bits)).select("u", "v", "nu", "nv"), "likely")
    a, b = (texts.select(F.col("node").alias(x), F.col("s").alias("s" + x)) for x in "uv")
    both = F.size(F.array_intersect("su", "sv"))
    return materialize(likely.join(a, "u").join(b, "v").where(few(F.col("nu") + F.col("nv") - 2 * both)).select("u", "v"), "similar")


def similar_links(docs: DataFrame, rows: DataFrame, first: DataFrame, shingle: int, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``rows`` of :func:`signed` and first candidates ``(u, v)`` → links that keep every connection between similar texts."""
    first, members = materialize(first, "first"), buckets(rows)
    texts = sets(docs, members.select("node").union(first.select("u")).union(first.select("v")), shingle)
    found = _verified(first.union(stars(members)), texts, similar)
    roots = connected(found).select("node", "root")
    at = members.where("size > 2").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    several = at.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    open_ = materialize(at.join(several, "key", "left_semi").select("node").distinct(), "open")
    return found.union(_verified(_rare_pairs(texts.join(open_, "node", "left_semi"), roots, similar), texts, similar))


def without_copies(docs: DataFrame, rows: DataFrame, links: DataFrame) -> DataFrame:
    """``docs`` with the least node of each component; of rows that repeat a node one."""
    dropped = connected(links).select("node")  # a component's least node is none of them
    repeated = materialize(rows.groupBy("node").count().where("count > 1").select("node"), "repeated")
    kept = docs.select(F.struct(*docs.columns).alias("row"), node_of()).join(merged(dropped), "node", "left_anti")
    return one_of_each(kept, "node", repeated).select("row.*")
