"""SimHash near-duplicates, found by pigeonring chains of fingerprint segments.

Of two fingerprints that differ in at most ``max_bits`` bits, laid out as a ring of m segments, some chain of
consecutive segments stays within the budget ``l * max_bits / m`` for each of its lengths l (Qin and Xiao, VLDB 2018).
The leading segments whose budget is below one bit must be equal: they are the key of a bucket. Within a bucket the
longer chains are tested before the whole Hamming distance is. Large buckets are cut into blocks of members that meet
block by block, where only the links that join two components of what has met are kept. In the largest ones the bits
that are not fixed yet are a ring again first, by the same rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected
from . import shingles
from .common import Words, materialize, per_slice, tasks
from .xxh import xxh64

#: Words in a shingle, differing bits of a link.
SHINGLE, MAX_BITS = 3, 2
#: Members of a bucket that are compared pair by pair in a stream of buckets, members of a block of a larger bucket, and
#: members from which on a bucket is cut into a ring of its own. Blocks add ``members * members / BLOCK`` rows to a bucket.
PAIRWISE, BLOCK, LARGE = 64, 4096, 1 << 17
_WHOLE = (1 << 64) - 1

_LANES = np.array([sum(((v >> j) & 1) << (8 * j) for j in range(8)) for v in range(256)], dtype=np.uint64)


def fingerprints_of(texts: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text; zero for texts without words."""
    w = Words(texts, lower=True)
    n = np.where(w.count > 0, np.maximum(w.count - shingle + 1, 1), 0)
    out = np.zeros(len(texts), np.uint64)
    has = np.flatnonzero(n)
    if not len(has):
        return out
    n = n[has]
    offset = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(w.first[has] - offset[:-1], n) + np.arange(offset[-1])
    last = first + np.repeat(np.minimum(w.count[has], shingle) - 1, n)
    h = xxh64(w.buf, w.start[first], w.end[last] - w.start[first])
    # Sum the bits in eight byte lanes over runs of at most 255 shingles, then over each text.
    runs = -(-n // 255)
    run_of = np.concatenate([[0], np.cumsum(runs)])
    begin = np.repeat(offset[:-1] - 255 * run_of[:-1], runs) + 255 * np.arange(run_of[-1])
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[(h >> np.uint64(8 * byte)) & np.uint64(255)], begin)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), run_of[:-1], axis=0)
        for j in range(8):
            out[has] |= (2 * ones[:, j] > n).astype(np.uint64) << np.uint64(8 * byte + j)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` with ``fp`` the fingerprint as a signed long."""

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(texts, shingle).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(per_slice(run), "doc_id long, fp long")


def ring_of(free: int, max_bits: int) -> list[int]:
    """Masks of the ring's segments over the bits of ``free``: 2 * max_bits + 1 of them, or one for each bit."""
    bits = [b for b in range(64) if free >> b & 1]
    m = min(2 * max_bits + 1, len(bits))
    cuts = [len(bits) * i // m for i in range(m + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]


def key_length(segments: int, max_bits: int) -> int:
    """Leading segments of a chain that must be equal."""
    return max(n for n in range(1, segments + 1) if n * max_bits < segments)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


_BUCKET = "ring long, at int, free long, fixed long"


def _dealer(max_bits: int):
    """``mapInArrow``: each row ``(free, fp, rep)`` in the bucket of every position of the ring over its free bits."""

    def run(batches):
        for b in batches:
            free, fp, rep = (np.asarray(c, dtype=np.int64) for c in b.columns)
            for mask in np.unique(free).tolist():
                rows = free == mask
                u64, parts = fp[rows].view(np.uint64), ring_of(mask & _WHOLE, max_bits)
                lead = key_length(len(parts), max_bits)
                for at in range(len(parts)):
                    left = (mask & _WHOLE) & ~sum(parts[(at + k) % len(parts)] for k in range(lead))
                    same = lambda x, n=len(u64): pa.array(np.full(n, x), pa.int64())
                    fixed = (u64 & np.uint64(_WHOLE & ~left)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [same(mask), pa.array(np.full(len(u64), at, np.int32)), same(_signed(left)), pa.array(fixed), pa.array(fp[rows]), pa.array(rep[rows])], ["ring", "at", "free", "fixed", "fp", "rep"])

    return run


def deal(rows: DataFrame, max_bits: int) -> DataFrame:
    """``rows(free, fp, rep)`` → ``(ring, at, free, fixed, fp, rep)``: a bucket is one ring, position and value of all bits fixed so far."""
    return rows.select("free", "fp", "rep").mapInArrow(_dealer(max_bits), f"{_BUCKET}, fp long, rep long")


def _near(ring: int, at: int, x: np.ndarray, max_bits: int) -> np.ndarray:
    """Which differences have a chain from ``at`` on within its budgets, and then so few bits in all."""
    parts = ring_of(ring & _WHOLE, max_bits)
    total, ok = np.zeros(x.shape, np.int64), np.ones(x.shape, bool)
    for k in range(key_length(len(parts), max_bits), len(parts)):
        total += np.bitwise_count(x & np.uint64(parts[(at + k) % len(parts)]))
        ok &= total <= (k + 1) * max_bits // len(parts)
    ok[ok] = np.bitwise_count(x[ok]) <= max_bits
    return ok


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _new(cols: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before in any column."""
    changed = np.zeros(len(cols[0]) - 1, bool)
    for c in cols:
        changed |= c[1:] != c[:-1]
    return np.concatenate([[True], changed])


def _grouped(keys: int, work):
    """``mapInArrow`` over rows of longs sorted by their first ``keys`` columns: ``work`` on whole groups, several at once."""

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(c, dtype=np.int64) for c in b.columns]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            last = int(np.flatnonzero(_new(cols[:keys]))[-1])  # the last group may go on
            if last:
                yield from work([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None:
            yield from work(held)

    return run


def _linker(max_bits: int, most: int):
    """Buckets ``(ring, at, free, fixed, fp, rep)`` of ``most`` members at most: pairs within ``max_bits``, chains first."""

    def work(cols):
        ring, at, _, _, fp, rep = cols
        n = len(fp)
        begin = np.flatnonzero(_new(cols[:4]))
        size = np.diff(np.append(begin, n))
        left = np.repeat(begin + size, size) - np.arange(n) - 1  # members after this one in its bucket
        kind = ring * np.int64(64) + at
        u64 = fp.view(np.uint64)
        for d in range(1, most):
            idx = np.flatnonzero(left >= d)
            if not len(idx):
                break
            for k in np.unique(kind[idx]):
                i = idx[kind[idx] == k]
                i = i[_near(int(ring[i[0]]), int(at[i[0]]), u64[i] ^ u64[i + d], max_bits)]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[i + d])], schema=_LINKS)

    return _grouped(4, work)


def joining(fp: np.ndarray, ring: int, at: int, max_bits: int, cut: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links among members, or between the first ``cut`` and the others, that keep every connection: fewer than members.

    All are compared, a few rows at a time; of links whose ends are connected already none is kept."""
    n, u64 = len(fp), fp.view(np.uint64)
    root = np.arange(n)
    u, v = [], []
    for a in range(0, cut or n, 64):
        rows = np.arange(a, min(a + 64, cut or n))
        cols = np.arange(cut, n) if cut else np.arange(a + 1, n)
        x, y = np.nonzero(_near(ring, at, u64[rows][:, None] ^ u64[cols][None], max_bits))
        x, y = rows[x], cols[y]
        while len(x):
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            _, first = np.unique(high, return_index=True)  # a link for each component that joins a lesser one
            u.append(x[first])
            v.append(y[first])
            to = np.arange(n)
            to[high[first]] = low[first]
            while (to[to] != to).any():
                to = to[to]
            root = to[root]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(u or none), np.concatenate(v or none)


def _block_linker(max_bits: int):
    """Pairs of blocks ``(ring, at, free, fixed, i, j, block, fp, rep)``: links that keep every connection in and between them."""

    def work(cols):
        begin = np.flatnonzero(_new(cols[:6]))
        for a, b in zip(begin, np.append(begin[1:], len(cols[0]))):
            ring, at, i, j = (int(cols[c][a]) for c in (0, 1, 4, 5))
            block, fp, rep = (cols[c][a:b] for c in (6, 7, 8))
            cut = 0 if i == j else int((block == i).sum())
            if i == j or 0 < cut < len(fp):
                u, v = joining(fp, ring, at, max_bits, cut)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[u]), pa.array(rep[v])], schema=_LINKS)

    return _grouped(6, work)


def block_pairs(members: DataFrame, block: int) -> DataFrame:
    """``members(ring, at, free, fixed, fp, rep, n)`` with ``i``, ``j`` and ``block``: each member for every pair of blocks
    that its own is in. A bucket of n members has ``ceil(n / block)`` blocks, and each member as many rows."""
    blocks = F.ceil(F.col("n") / block)
    dealt = members.withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return dealt.select("ring", "at", "free", "fixed", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "fp", "rep")


def links(fps: DataFrame, max_bits: int = MAX_BITS, pairwise: int = PAIRWISE, block: int = BLOCK, large: int = LARGE) -> DataFrame:
    """``fps(fp, rep)``, fingerprints distinct → links ``(u, v)`` of representatives that keep every connection.

    Exact for any ``max_bits`` from 1 to 31. Buckets are counted before they are dealt out: those of one member go,
    those of up to ``pairwise`` are compared in a stream, those of up to ``large`` in blocks, and larger ones are cut
    further, each round as a stored table. A bucket of n members becomes ``n * ceil(n / block)`` rows, with n up to
    ``large``; only more members than that are dealt ``2 * max_bits + 1`` times again. Where no more bits are free than
    may differ all members are near, and are linked to the least."""
    if not 1 <= max_bits <= 31:
        raise ValueError("max_bits must be from 1 to 31")
    spark = fps.sparkSession
    bucket = ["ring", "at", "free", "fixed"]
    rows, found = fps.select(F.lit(-1).cast("long").alias("free"), "fp", "rep"), None
    for _ in range(64):  # every round fixes a bit or more
        dealt = materialize(deal(rows, max_bits), "chains")
        sizes = materialize(dealt.groupBy(*bucket).agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1"), "sizes")
        small = dealt.join(sizes.where(F.col("n") <= pairwise).select(*bucket), bucket).select(*dealt.columns)
        sorted_ = small.repartition(tasks(spark), *bucket).sortWithinPartitions(*bucket, "fp")
        pairs = sorted_.mapInArrow(_linker(max_bits, pairwise), "u long, v long")
        many = materialize(dealt.join(sizes.where(F.col("n") > pairwise), bucket), "large")
        if not many.isEmpty():
            all_near = F.bit_count("free") <= max_bits
            pairs = pairs.union(many.where(all_near & (F.col("rep") != F.col("least"))).select(F.col("rep").alias("u"), F.col("least").alias("v")))
            blocks = block_pairs(many.where(~all_near & (F.col("n") <= large)), block)
            met = blocks.repartition(tasks(spark), *bucket, "i", "j").sortWithinPartitions(*bucket, "i", "j", "block")
            pairs = pairs.union(met.mapInArrow(_block_linker(max_bits), "u long, v long"))
            rows = many.where(~all_near & (F.col("n") > large)).select("free", "fp", "rep").distinct()
        pairs = materialize(pairs.distinct(), "near")
        found = pairs if found is None else found.union(pairs)
        if many.isEmpty() or rows.isEmpty():
            return found
    raise RuntimeError("buckets did not settle")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, pairwise: int = PAIRWISE) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows share a component.
    Rows with a null doc_id keep a fingerprint, and join the component of their fingerprint's other rows, if any.
    Other columns are ignored. An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = connected(links(reps.where("rep is not null"), max_bits, pairwise))
    classes = reps.join(roots, reps.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The stage that keeps one text of each group: words in a shingle, and bits of fingerprints that are candidates.
STAGE_SHINGLE, STAGE_BITS = 5, 3


def keep_one(docs: DataFrame, shingle: int = STAGE_SHINGLE, max_bits: int = STAGE_BITS, similar: tuple[int, int] = shingles.SIMILAR) -> DataFrame:
    """``docs`` with one row of each group of texts linked at a Jaccard similarity of ``similar`` or more over word
    shingles, all columns as they were: the row of the least doc_id, of equal ids the one of the least text hash.

    Fingerprints within ``max_bits`` bits, found by pigeonring chains, are the first candidates. 64 bits do not reach
    a similarity of 0.8 (such pairs are ten bits apart on average, and up to seventeen), so :mod:`.shingles` adds the
    others; each candidate is held against the whole shingle sets. Null and empty texts are alike. Rows with a null
    doc_id come last in their group. Of rows that repeat id and text one stays; an empty table gives an empty result."""
    rows = shingles.signed(docs, shingle)
    classes = materialize(rows.groupBy("fp").agg(F.min("node").alias("least"), F.min(F.xxhash64("node")).alias("rep")), "classes")
    near = links(classes.select("fp", "rep"), max_bits)
    a, b = (classes.select(F.col("rep").alias(x), F.col("least").alias("_" + x)) for x in "uv")
    across = near.join(a, "u").join(b, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    equal = rows.join(classes, "fp").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return shingles.without_copies(docs, rows, shingles.similar_links(docs, rows, equal.union(across), shingle, similar))
