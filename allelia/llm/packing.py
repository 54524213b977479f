"""Best-fit packing of token sequences by patterns.

The lengths to pack are counted, and the counts (one for each length, so bounded by the sequence length) are packed
on the driver: patterns of a few lengths that fill a sequence are enumerated, repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and what is left is packed best-fit decreasing. The plan
gives ranges of ranks within each length a place; every piece then finds its own by its rank.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, per_slice, tasks
from .vocab import ByteBpe

#: Tokens of a sequence, and the id that ends each document.
SEQUENCE, END_ID = 2048, 0
#: Most lengths in a pattern, patterns tried in all, and steps of the fit.
PATTERN_SIZE, PATTERNS, FIT_STEPS = 4, 20_000, 400
#: Parts of the fitted patterns, by what they leave empty, up to which a plan is tried.
WASTE_LEVELS = (0.25, 0.5, 0.75, 1.0)


def pieces(docs: DataFrame, vocab_path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of each document's ids, then the end id. Only documents longer
    than a sequence are cut; their first piece takes what full pieces leave."""

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        bpe = ByteBpe.load(vocab_path)
        out: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(part.column(0).to_pylist(), texts):
            ids = np.append(bpe.encode(text), np.uint32(end_id)).astype("<u4")
            first = len(ids) % sequence or min(len(ids), sequence)
            cuts = [0, *range(first, len(ids) + 1, sequence)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                for col, v in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                    col.append(v)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(per_slice(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def enumerate_patterns(counts: np.ndarray, size: int, most: int) -> list[tuple[int, ...]]:
    """Multisets of 2 to ``size`` lengths that fill a sequence as far as the histogram's lengths allow: for each length
    its exact complements, filled by one length or by runs of equal or neighbouring shares."""
    full = len(counts) - 1
    here = np.flatnonzero(counts)
    below = np.full(full + 1, 0)  # the largest length present that is at most x
    below[here] = here
    below = np.maximum.accumulate(below)
    found: dict[tuple[int, ...], int] = {}

    def add(*lengths: int) -> None:
        if all(lengths) and sum(lengths) <= full:
            found.setdefault(tuple(sorted(lengths, reverse=True)), full - sum(lengths))

    common = here[np.argsort(-counts[here], kind="stable")]
    per = max(1, most // max(1, len(here)) // 2)
    for a in here[::-1].tolist():
        rest = full - a
        add(a, int(below[rest]))
        for b in common[common <= rest][:per].tolist():
            left = rest - b
            c = int(below[left])
            add(a, b, c)
            if size > 3 and c:
                half = int(below[left // 2])
                add(a, b, half, int(below[left - half]) if half else 0)
    tight = sorted(found.items(), key=lambda x: (x[1], len(x[0]), x[0]))
    return [p for p, _ in tight[:most]]


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative repeat counts x that bring the sum of patterns near ``target``, by accelerated projected gradients."""
    if not columns:
        return np.zeros(0)
    row = np.array([a for p in columns for a in p])
    col = np.repeat(np.arange(len(columns)), [len(p) for p in columns])
    n, m = len(target), len(columns)
    apply = lambda x: np.bincount(row, weights=x[col], minlength=n)
    back = lambda r: np.bincount(col, weights=r[row], minlength=m)
    probe = np.ones(m)
    for _ in range(30):
        probe = back(apply(probe))
        norm = float(np.linalg.norm(probe)) or 1.0
        probe /= norm
    x = y = np.zeros(m)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(apply(y) - target) / (norm * 1.01))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def best_fit_decreasing(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Pack the whole histogram: the longest first, each sequence completed by the longest that fits. Equal sequences
    are made at once, so that the work follows the lengths and not the documents."""
    left, out = counts.copy(), []
    full = len(counts) - 1
    while True:
        here = np.flatnonzero(left)
        if not len(here):
            return out
        take: dict[int, int] = {}
        room = full
        while room > 0:
            fits = [int(x) for x in here[here <= room][::-1][:1] if left[x] > take.get(int(x), 0)]
            if not fits:
                open_ = [int(x) for x in here[here <= room] if left[x] > take.get(int(x), 0)]
                if not open_:
                    break
                fits = [open_[-1]]
            take[fits[0]] = take.get(fits[0], 0) + 1
            room -= fits[0]
        times = min(int(left[a]) // k for a, k in take.items())
        for a, k in take.items():
            left[a] -= k * times
        out.append((tuple(a for a, k in sorted(take.items(), reverse=True) for _ in range(k)), times))


def plan_patterns(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) that use each length exactly as often as ``counts`` says.

    The fitted repeat counts are rounded down and taken in order of what their patterns leave empty, up to a limit; the
    rest is packed best-fit. Of the limits tried the one that needs the fewest sequences counts, the largest of equals,
    so that a histogram whose lengths do not add up exactly is packed by patterns too."""
    left = counts.astype(np.int64).copy()
    whole: list[tuple[tuple[int, ...], int]] = [((len(left) - 1,), int(left[-1]))] if left[-1] else []
    left[-1] = 0
    columns = enumerate_patterns(left, PATTERN_SIZE, PATTERNS)
    fitted = np.floor(nnls(columns, left.astype(float), FIT_STEPS)).astype(np.int64)
    waste = np.array([len(left) - 1 - sum(p) for p in columns], dtype=np.int64)
    order = [k for k in np.lexsort((-fitted, waste)).tolist() if fitted[k] > 0]
    best: list[tuple[tuple[int, ...], int]] | None = None
    for limit in sorted({0, *np.quantile(waste[order], WASTE_LEVELS).astype(int).tolist()}, reverse=True) if order else [0]:
        rest, out = left.copy(), list(whole)
        for k in order:
            if waste[k] > limit:
                break
            need = np.bincount(columns[k])
            used = np.flatnonzero(need)
            times = int(min(fitted[k], (rest[used] // need[used]).min()))
            if times > 0:
                rest[used] -= need[used] * times
                out.append((columns[k], times))
        out += best_fit_decreasing(rest)
        if best is None or sum(n for _, n in out) < sum(n for _, n in best):
            best = out
    return best


@dataclass
class Plan:
    """Ranks ``rank`` on of length ``length`` go to sequences ``sequence`` on, one each, at ``offset``; sorted by (length, rank)."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.length * (1 << 46) + self.rank, length * (1 << 46) + rank, side="right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def make_plan(counts: np.ndarray) -> Plan:
    used = np.zeros(len(counts), np.int64)
    rows, sequence = [], 0
    for lengths, times in plan_patterns(counts):
        offset = 0
        for a in lengths:
            rows.append((a, int(used[a]), sequence, offset))
            used[a] += times
            offset += a
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return Plan(*cols, sequences=sequence)


def pack(found: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``found(length, ...)``, each length from 1 to ``sequence`` → the same rows with ``sequence_id`` and ``offset``.

    Only the histogram of lengths reaches the driver. Ranks are counted within (length, part), so that a length that
    a third of all rows have is spread. An empty table gives an empty result; equal rows get places of their own."""
    spark = found.sparkSession
    parts = tasks(spark)
    keyed = found.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    sizes = keyed.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    counts = np.zeros(sequence + 1, np.int64)
    for length, n in found.groupBy("length").count().collect():  # at most ``sequence`` rows
        counts[length] = n
    plan = spark.sparkContext.broadcast(make_plan(counts))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*found.columns)) - 1)
    ranked = ranked.join(offsets, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before")).select(*found.columns, "_rank")
    schema = found.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches):
        for b in batches:
            n = b.schema.get_field_index("length")
            seq, off = plan.value.place(np.asarray(b.column(n)), np.asarray(b.column(b.num_columns - 1), dtype=np.int64))
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], [*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocab_path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """``docs(doc_id, text, ...)`` → a row for each piece: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.

    Null and empty texts are one piece that holds the end id alone; other columns are ignored; repeated rows are
    packed each; null ids are carried; an empty table gives an empty result."""
    return pack(materialize(pieces(docs, vocab_path, sequence, end_id), "pieces"), sequence)
