"""Removal of repeated passages by seeds and extension.

Winnowing picks anchors: word runs of which every window of ``size`` words holds at least one, by content alone, so
that equal passages have equal anchors. Documents are joined on the anchors. Each anchor that occurs again is a seed
and is extended both ways over all windows that hold it: first as one block, which settles the inside of a long
repeat at once; where the block differs, by each window that has the seed as its least run. Matching goes through counts of equal content, never
through pairs of documents. Windows that match are merged into the maximal repeats, and their words are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, materialize, per_slice
from .xxh import xxh64

#: Words of a window, and of an anchor's run.
SIZE, ANCHOR = 35, 12

# Odd multipliers of the two rolling hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


class Rolling:
    """Hashes of any run of words in a buffer, by prefix sums of word hashes times powers, modulo 2^64."""

    def __init__(self, word_hashes: np.ndarray, base: int):
        n = len(word_hashes)
        with np.errstate(over="ignore"):
            self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, np.uint64(base)))])
            inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, np.uint64(pow(base, -1, 1 << 64))))])[:n]
            self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(word_hashes * inverse)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.prefix[end] - self.prefix[start]) * self.power[start]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return x ^ (x >> np.uint64(32))


def word_hashes(w: Words) -> np.ndarray:
    return xxh64(w.buf, w.start, w.end - w.start)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over x[i : i + width] for each i that has a whole window."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def _least_runs(w: Words, hashes: np.ndarray, size: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text of each word; for each window the least hash of its runs, 0 where it leaves its text; the hash of each run."""
    n, own = len(hashes), w.text_of()
    if n < size:
        return own, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    runs = Rolling(hashes, _BASES[0]).of(np.arange(n - run + 1), np.arange(run, n + 1)) | np.uint64(1)
    least = _sliding(runs, size - run + 1, np.minimum)
    return own, np.where(own[: len(least)] == own[size - 1 :], least, np.uint64(0)), runs


def anchors(w: Words, hashes: np.ndarray, size: int, run: int) -> np.ndarray:
    """Places (words of the buffer) at which a least run of some window begins; ties all count."""
    _, least, runs = _least_runs(w, hashes, size, run)
    if not len(least):
        return np.zeros(0, np.int64)
    pad = np.zeros(size - run, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), size - run + 1, np.maximum) == runs)


def _keys() -> tuple[Column, Column]:
    """A row is known by its id and a hash of its text, so that repeated ids do not mix."""
    return F.col("doc_id"), F.xxhash64("text").alias("mark")


def _anchor_rows(docs: DataFrame, size: int, run: int) -> DataFrame:
    """``(doc_id, mark, pos, seed, block)``: each anchor, its hash, and the hash of all windows that hold it."""
    span = size - run

    def one(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        w = Words(texts)
        h = word_hashes(w)
        at = anchors(w, h, size, run)
        doc = w.text_of()[at]
        first, last = w.first[doc], w.first[doc] + w.count[doc]
        a, b = np.maximum(at - span, first), np.minimum(at + size, last)
        seed = Rolling(h, _BASES[0]).of(at, at + run)
        edges = (at - a) * (size + 1) + (b - at)
        with np.errstate(over="ignore"):
            block = Rolling(h, _BASES[1]).of(a, b) + edges.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        take = pa.array(doc)
        return pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array((at - first).astype(np.int32)), pa.array(seed.view(np.int64)), pa.array(block.view(np.int64))], ["doc_id", "mark", "pos", "seed", "block"])

    return docs.select(*_keys(), "text").mapInArrow(per_slice(one), "doc_id long, mark long, pos int, seed long, block long")


def _window_rows(docs: DataFrame, places: DataFrame, size: int, run: int) -> DataFrame:
    """``(doc_id, mark, pos, a, b)``: two hashes of each window whose own least run is in ``places(doc_id, mark, pos)``."""

    def one(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        w = Words(texts)
        h = word_hashes(w)
        pos = part.column(part.schema.get_field_index("places"))
        at = np.asarray(pos.flatten(), dtype=np.int64) + w.first[np.repeat(np.arange(len(pos)), np.asarray(pc.list_value_length(pos)))]
        own, least, runs = _least_runs(w, h, size, run)
        marked = np.full(len(runs), np.iinfo(np.uint64).max)
        marked[at] = runs[at]
        start = np.flatnonzero((_sliding(marked, size - run + 1, np.minimum) == least) & (least > 0)) if len(least) else np.zeros(0, np.int64)
        doc = own[start]
        take = pa.array(doc)
        a, b = (Rolling(h, base).of(start, start + size).view(np.int64) for base in _BASES)
        return pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array((start - w.first[doc]).astype(np.int32)), pa.array(a), pa.array(b)], ["doc_id", "mark", "pos", "a", "b"])

    lists = places.groupBy("doc_id", "mark").agg(F.collect_list("pos").alias("places"))  # as long as one text at most
    return _with(docs, lists, "inner").mapInArrow(per_slice(one), "doc_id long, mark long, pos int, a long, b long")


def _with(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``docs`` with the column of ``lists`` for the same row; null ids meet null ids."""
    left = docs.select(*_keys(), "text")
    right = lists.withColumnsRenamed({"doc_id": "_doc_id", "mark": "_mark"})
    same = (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    return left.join(right, same, how).drop("_doc_id", "_mark")


def repeats(docs: DataFrame, size: int = SIZE, run: int = ANCHOR) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, mark, ranges)``: for each row with repeats, the ranges [from, to) of
    words that are in a window whose words occur elsewhere."""
    span = size - run
    found = _anchor_rows(docs, size, run)
    # Stored, so that the join below is between two exchanges and Spark can split a seed that very many texts share.
    again = materialize(found.groupBy("seed").count().where("count > 1").select("seed"), "again")
    seeds = materialize(found.join(again, "seed"), "seeds")
    kinds = materialize(seeds.groupBy("seed", "block").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "pos")).alias("one")), "blocks")
    # Blocks that occur again settle all their windows.
    settled = seeds.join(kinds.where("n > 1").select("seed", "block"), ["seed", "block"], "left_semi")
    ranges = settled.select("doc_id", "mark", F.greatest(F.col("pos") - span, F.lit(0)).alias("from"), (F.col("pos") + size).alias("to"))
    # Where a seed has a block of its own, its windows are compared one by one, with one block of each other kind.
    single = materialize(kinds.where("n = 1").select("seed").distinct(), "single")
    places = kinds.join(single, "seed", "left_semi").select("one.doc_id", "one.mark", "one.pos")
    windows = materialize(_window_rows(docs, places, size, run), "windows")
    twice = materialize(windows.groupBy("a", "b").count().where("count > 1").select("a", "b"), "twice")
    matched = windows.join(twice, ["a", "b"], "left_semi")
    ranges = ranges.union(matched.select("doc_id", "mark", F.col("pos").alias("from"), (F.col("pos") + size).alias("to")))
    return ranges.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))  # as long as one text at most


def _kept(part: pa.RecordBatch, texts: list[str], size: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words that stay, and how many there were and were removed, of each text."""
    kept, total, gone = [], [], []
    for text, ranges in zip(texts, part.column(part.schema.get_field_index("ranges")).to_pylist()):
        words = text.encode().split()
        if ranges:
            edge = np.zeros(len(words) + 1, np.int64)
            a = np.array([r["from"] for r in ranges])
            # A block that meets its document's end reaches no further; shorter texts have no window at all.
            b = np.minimum([r["to"] for r in ranges], len(words))
            ok = b - a >= size
            np.add.at(edge, a[ok], 1)
            np.add.at(edge, b[ok], -1)
            stay = np.cumsum(edge[:-1]) == 0
            left = [w for w, s in zip(words, stay) if s]
        else:
            left = words
        kept.append(left)
        total.append(len(words))
        gone.append(len(words) - len(left))
    return kept, np.array(total, np.int64), np.array(gone, np.int64)


def _apply(docs: DataFrame, size: int, run: int, finish, schema: str) -> DataFrame:
    def one(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return finish(part.column(0), *_kept(part, texts, size))

    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _with(whole, repeats(whole, size, run), "left").mapInArrow(per_slice(one), schema)


def remove_repeats(docs: DataFrame, size: int = SIZE, run: int = ANCHOR) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, text)``: the words that stay, joined by one space.

    Every copy of a repeated passage goes, as all windows are judged on the input. Null and empty texts give empty
    ones; texts of fewer than ``size`` words stay whole; repeated rows are copies of each other; null ids are
    carried; other columns are ignored; an empty table gives an empty result."""

    def finish(ids, kept, total, gone):
        return pa.RecordBatch.from_arrays([ids, pa.array([b" ".join(k).decode() for k in kept], pa.string())], ["doc_id", "text"])

    return _apply(docs, size, run, finish, "doc_id long, text string")


def digest(docs: DataFrame, size: int = SIZE, run: int = ANCHOR) -> DataFrame:
    """Like :func:`remove_repeats`, as ``(doc_id, n_words, n_removed, kept_sha256)``."""

    def finish(ids, kept, total, gone):
        return pa.RecordBatch.from_arrays([ids, pa.array(total), pa.array(gone), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _apply(docs, size, run, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
