"""Hard negatives by product quantisation, with bounds that make the filter rigorous.

Every vector is stored as the numbers of its nearest centroids, one for each part of its components, and with the norm
of what each part differs by. For a query, tables of its products with the centroids give a vector's score up to the sum
of the products of norms (Cauchy-Schwarz), so a vector is left out only where its best possible score is too low, or
its worst possible one too high. What remains is scored exactly, in whole numbers. How well the codebook fits, which is
trained on a bounded sample, decides how much remains, never what is found.

Vectors are dealt out in blocks; each block meets every query, as a stream. A block keeps the few best of each query,
and these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tasks

#: Components become ``floor(SCALE * x)``; every ``QUERY_EVERY``-th id is an anchor; ids divisible by ``SHIFT_EVERY`` have the next label of ``LABELS``.
SCALE, QUERY_EVERY, SHIFT_EVERY, LABELS = 256, 50, 7, 10
#: Positives of an anchor, negatives of a positive, and the window of negative scores as percent of the positive's.
POSITIVES, NEGATIVES, WINDOW = 5, 3, (50, 95)
#: Parts of a vector, centroids of each, vectors that the codebook is trained on at most and rounds of training.
PARTS, CENTROIDS, TRAIN_ROWS, ROUNDS = 32, 256, 4096, 8
#: Vectors in a block, and queries that meet it at once.
BLOCK, AT_ONCE = 1 << 14, 128
#: Greatest size of a whole-number component: sums of squares of 64 K such components fit a long.
LARGEST = 1 << 23


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``rows(vec_id, embedding, label)`` → ``(vec_id, label, v)`` with whole-number components. Rows with a null label or
    vector, or a null or non-finite component, take no part. Components of 2^23 and more are an error."""
    x = lambda c: F.lit(float(scale)) * c.cast("double")
    fit = lambda c: F.when(F.abs(x(c)) < LARGEST, F.floor(x(c)).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} must be under {LARGEST}")).cast("int"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return kept.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", fit).alias("v"))


def split(width: int, parts: int) -> list[slice]:
    cuts = [width * i // parts for i in range(parts + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def trained(sample: np.ndarray, parts: int = PARTS, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Whole-number centroids of each part by k-means over the sample; the same for the same sample."""
    rnd, out = np.random.default_rng(7), []
    for part in split(sample.shape[1], parts):
        x = sample[:, part].astype(np.float64)
        c = x[rnd.choice(len(x), min(centroids, len(x)), replace=False)] if len(x) else np.zeros((1, x.shape[1]))
        for _ in range(rounds if len(x) else 0):
            near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            n = np.bincount(near, minlength=len(c))
            total = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        out.append(np.rint(c).astype(np.int64))
    return out


class Coded:
    """A block of vectors as codes and residual norms, with the whole numbers they stand for."""

    def __init__(self, v: np.ndarray, codes: np.ndarray, rest: np.ndarray, book: list[np.ndarray]):
        self.v, self.codes, self.rest, self.book, self.parts = v, codes, rest, book, split(v.shape[1], len(book))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible product of each vector with each query: ``(vectors, queries)``."""
        q = q.astype(np.float64)
        score = np.zeros((len(self.v), len(q)))
        norms = np.zeros((len(self.book), len(q)))
        for i, (part, c) in enumerate(zip(self.parts, self.book)):
            score += (c.astype(np.float64) @ q[:, part].T)[self.codes[:, i]]  # whole numbers, so exact
            norms[i] = np.sqrt((q[:, part] ** 2).sum(1))
        slack = (self.rest.astype(np.float64) @ norms) * (1 + 1e-9) + 1e-6
        return score - slack, score + slack

    def exact(self, rows: np.ndarray, q: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Whole-number products of vectors ``rows`` of the block with rows ``of`` of ``q``."""
        out = np.empty(len(rows), np.int64)
        for a in range(0, len(rows), 8192):
            out[a : a + 8192] = np.einsum("ij,ij->i", self.v[rows[a : a + 8192]].astype(np.int64), q[of[a : a + 8192]].astype(np.int64))
        return out


def encoded(v: np.ndarray, book: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (one byte each) and norms of what is left, rounded up: ``(vectors, parts)`` each."""
    codes, rest = np.zeros((len(v), len(book)), np.uint8), np.zeros((len(v), len(book)), np.float32)
    for i, (part, c) in enumerate(zip(split(v.shape[1], len(book)), book)):
        x, c = v[:, part].astype(np.float64), c.astype(np.float64)
        for a in range(0, len(x), 2048):
            some = x[a : a + 2048]
            code = ((c * c).sum(1) - 2 * some @ c.T).argmin(1)
            codes[a : a + 2048, i] = code
            rest[a : a + 2048, i] = np.nextafter(np.sqrt(((some - c[code]) ** 2).sum(1)).astype(np.float32), np.float32(np.inf))
    return codes, rest


def best(block: Coded, ids: np.ndarray, num: np.ndarray, q: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, bounds: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the first ``most`` vectors of the block: ``(query, vector, score)``, by score, id and number.

    ``allowed(vectors, queries)`` says which may be taken, ``low`` and ``high`` the least and greatest score of each query.
    The ``most``-th greatest lower bound of vectors that are surely within is a score that is surely reached: vectors
    whose upper bound is below it are left out, and all others are scored."""
    least, greatest = bounds
    maybe = allowed & (greatest >= low) & (least <= high)
    if len(ids) > most:
        sure = np.where(maybe & (least >= low) & (greatest <= high), least, -np.inf)
        maybe &= greatest >= np.partition(sure, len(sure) - most, axis=0)[len(sure) - most]
    at, of = np.nonzero(maybe)
    score = block.exact(at, q, of)
    within = (score >= low[of]) & (score <= high[of])
    at, of, score = at[within], of[within], score[within]
    order = np.lexsort((num[at], ids[at], -score, of))
    at, of, score = at[order], of[order], score[order]
    first = np.arange(len(of)) - np.searchsorted(of, of) < most
    return of[first], at[first], score[first]


def _column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def _longs(b: pa.RecordBatch, name: str, null: int = 0) -> np.ndarray:
    return np.asarray(_column(b, name).fill_null(null), np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones go on with zeros."""
    offsets = np.asarray(column.offsets)
    n, flat = np.diff(offsets), np.asarray(column.values, np.int32)[offsets[0] : offsets[-1]]
    if (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width), np.int32)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _bytes(b: pa.RecordBatch, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(_column(b, name).to_pylist()), kind).reshape(b.num_rows, -1)


def _encoder(book, width: int):
    def run(batches):
        for b in batches:
            codes, rest = encoded(_matrix(_column(b, "v"), width), book.value)
            each = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, each(codes), each(rest)], [*b.schema.names, "codes", "rest"])

    return run


def _meet(book, width: int, most: int, same: bool):
    """``mapInArrow`` over rows sorted by block, vectors before queries: the first ``most`` of each block for each window
    of each query, numbered from ``of`` on."""
    schema = pa.schema([(n, pa.int64()) for n in ("of", "num", "vec_id", "score")])
    last = np.iinfo(np.int64).max  # rows without an id come last

    def runs(batches) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
        for b in batches:
            block, query = _longs(b, "block"), np.asarray(_column(b, "query").cast(pa.int8()))
            cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(query) != 0)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if y > x:
                    yield int(block[x]), bool(query[x]), b.slice(x, y - x)

    def met(block: Coded, side: tuple, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        num, ids, label = side
        for a in range(0, part.num_rows, AT_ONCE):
            b = part.slice(a, AT_ONCE)
            q, of_label, of = _matrix(_column(b, "v"), width), _longs(b, "label"), _longs(b, "of")
            allowed = ((label[:, None] == of_label[None]) == same) & (num[:, None] != _longs(b, "num")[None])
            bounds = block.bounds(q)
            low, high = (_column(b, x).to_pylist() for x in ("low", "high"))
            for w in range(max(map(len, low))):
                i = np.flatnonzero([len(x) > w for x in low])
                ends = (np.array([x[j][w] for j in i], np.float64) for x in (low, high))
                who, at, score = best(block, ids, num, q[i], allowed[:, i], *ends, most, tuple(x[:, i] for x in bounds))
                if len(who):
                    yield pa.RecordBatch.from_arrays([pa.array(of[i][who] + w), pa.array(num[at]), pa.array(ids[at]), pa.array(score)], schema=schema)

    def run(batches):
        held: list[pa.RecordBatch] = []
        block = side = at = None
        for number, query, part in runs(batches):
            if number != at:
                at, held, block = number, [], None
            if not query:
                held.append(part)
                continue
            if block is None and held:
                v = np.concatenate([_matrix(_column(p, "v"), width) for p in held])
                codes, rest = (np.concatenate([_bytes(p, n, kind) for p in held]) for n, kind in (("codes", np.uint8), ("rest", np.float32)))
                side = tuple(np.concatenate([_longs(p, n, last if n == "vec_id" else 0) for p in held]) for n in ("num", "vec_id", "label"))
                block, held = Coded(v, codes, rest, book.value), []
            if block is not None:
                yield from met(block, side, part)

    return run


def _search(vectors: DataFrame, queries: DataFrame, blocks: int, book, width: int, most: int, same: bool) -> DataFrame:
    """``queries(of, num, label, v, low, high)``, with a window for each place of the arrays ``low`` and ``high``, against all
    of ``vectors`` → the first ``most`` of window ``w``, ``(of + w, num, vec_id, score, rank)``: of the query's own label if
    ``same``, else of other labels."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = vectors.select("block", F.lit(False).alias("query"), "num", "vec_id", "label", "v", "codes", "rest", null("long", "of"), null("array<long>", "low"), null("array<long>", "high"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    asked = queries.select(every, F.lit(True).alias("query"), "num", null("long", "vec_id"), "label", "v", null("binary", "codes"), null("binary", "rest"), "of", "low", "high")
    dealt = rows.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "query")
    found = dealt.mapInArrow(_meet(book, width, most, same), "of long, num long, vec_id long, score long")
    by = Window.partitionBy("of").orderBy(F.desc("score"), "vec_id", "num")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def mine(
    rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, anchor: Column | None = None, block: int = BLOCK,
    parts: int = PARTS, centroids: int = CENTROIDS, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """``rows(vec_id, label, v)`` with whole-number vectors → ``(anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score)``: for each anchor and each of its ``positives`` best vectors of its own label, the
    first ``negatives`` of other labels whose score is within ``window`` percent of the positive's.

    Anchors are the rows where ``anchor`` holds (ids divisible by 50 unless given). Equal scores go by the smaller id,
    null ids last (as 2^63 - 1). Rows that repeat an id are rows of their own. Shorter vectors go on with zeros. A
    positive with a negative score has no negatives. Without rows or anchors there is nothing to return."""
    if not 1 <= centroids <= 256 or not 0 <= window[0] <= window[1]:
        raise ValueError("codes take one byte, and windows go up")
    spark = rows.sparkSession
    vectors = materialize(rows.select(F.monotonically_increasing_id().alias("num"), "vec_id", "label", "v"), "vectors")
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width, blocks = max(1, width), max(tasks(spark), -(-n // block))
    sample = vectors.select("v", F.xxhash64("num").alias("h")).orderBy("h").limit(train_rows).collect()  # at most train_rows vectors
    x = np.zeros((len(sample), width), np.int64)
    for i, r in enumerate(sample):
        x[i, : len(r.v)] = r.v
    book = spark.sparkContext.broadcast(trained(x, parts, centroids))
    coded = vectors.mapInArrow(_encoder(book, width), f"num long, vec_id long, label long, v array<int>, codes binary, rest binary")
    coded = materialize(coded.withColumn("block", F.pmod(F.xxhash64("num"), F.lit(blocks).cast("long"))), "codes")

    is_anchor = F.col("vec_id") % QUERY_EVERY == 0 if anchor is None else anchor
    anchors = vectors.where(is_anchor).select(F.col("num").alias("of"), "num", "label", "v", F.col("vec_id").alias("anchor_id"))
    of = lambda rank: F.col("anchor") * positives + rank
    all_scores = (F.array(F.lit(-(1 << 62))).alias("low"), F.array(F.lit(1 << 62)).alias("high"))
    near = _search(coded, anchors.select("of", "num", "label", "v", *all_scores), blocks, book, width, positives, same=True)
    near = near.select(F.col("of").alias("anchor"), "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).where("positive_score >= 0")
    near = materialize(near, "positives")
    # Scores fall with the rank, so those not below 0 are the first ones, and windows are numbered without a gap.
    least, most = F.expr(f"({window[0]} * positive_score + 99) div 100"), F.expr(f"({window[1]} * positive_score) div 100")
    ends = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", least.alias("low"), most.alias("high")))).alias("w"))
    asked = ends.join(anchors, F.col("anchor") == F.col("of")).select((F.col("anchor") * positives).alias("of"), "num", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    hard = _search(coded, asked, blocks, book, width, negatives, same=False).select("of", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    of_positive = near.join(anchors.select(F.col("of").alias("anchor"), "anchor_id"), "anchor").select(of(F.col("rank") - 1).alias("of"), "anchor_id", "positive_id", "positive_score")
    return hard.join(of_positive, "of").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(rows: DataFrame) -> DataFrame:
    """``rows(vec_id, embedding, label, ...)`` → :func:`mine` with the production settings: components ``floor(256 * x)``,
    and the label of every seventh id moved on by one. Other columns are ignored."""
    shifted = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(usable(rows).withColumn("label", shifted))
