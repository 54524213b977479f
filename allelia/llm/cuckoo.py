"""Exact duplicates through a cuckoo-filter index of live digests, dealt into buckets by digest.

The index holds, in each slot of a two-choice table, a 16-bit tag and the stored key and payload behind it. A tag
hit is verified against the stored key of that slot; an insertion that finds no place after many moves doubles the
table and files the stored keys again. Keys that doubling would not part, as they share a hash, lie in a stash. Texts that the index calls equal are then held against each other, digest by
digest; where a digest has more than one text, the texts themselves decide. Beside the index lie the live rows by
digest and id, so that digests can be deleted row by row and the index follows a changing corpus.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, merged, one_of_each

SLOTS, MOVES = 4, 200
#: Rows of a bucket of the index, on average, and parts that a digest's rows are summed in before they meet.
BUCKET_ROWS, SALT = 20_000, 8


class CuckooIndex:
    """Keys are any bytes, filed by a hash of all of them; payloads are (keep_id, size, times): the id that stays, how many rows there are, and how many with that id."""

    def __init__(self, capacity: int = 64):
        self.buckets = 1 << max(2, (capacity * 5 // 4 // SLOTS).bit_length())
        self.tags = [0] * (self.buckets * SLOTS)
        self.keys: list[bytes | None] = [None] * (self.buckets * SLOTS)
        self.payload: list[tuple | None] = [None] * (self.buckets * SLOTS)
        self.stash: dict[bytes, tuple] = {}
        self.live = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh64_intdigest(key)
        tag, a = h >> 48 or 1, h & (self.buckets - 1)
        return tag, a, self._other(a, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & (self.buckets - 1)

    def _find(self, key: bytes) -> int:
        tag, a, b = self._places(key)
        for bucket in (a, b):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.tags[slot] == tag and self.keys[slot] == key:  # a tag hit counts only if the stored key agrees
                    return slot
        return -1

    def get(self, key: bytes) -> tuple | None:
        slot = self._find(key)
        return self.stash.get(key) if slot < 0 else self.payload[slot]

    def put(self, key: bytes, payload: tuple) -> None:
        """Insert a key, or replace its payload."""
        slot = self._find(key)
        if slot >= 0:
            self.payload[slot] = payload
            return
        if key in self.stash:
            self.stash[key] = payload
            return
        self.live += 1
        self._file(key, payload)

    def delete(self, key: bytes) -> bool:
        slot = self._find(key)
        if slot >= 0:
            self.tags[slot], self.keys[slot], self.payload[slot] = 0, None, None
        elif self.stash.pop(key, None) is None:
            return False
        self.live -= 1
        return True

    def _file(self, key: bytes, payload: tuple) -> None:
        tag, a, b = self._places(key)
        bucket = a
        for move in range(MOVES):
            for at in (a, b) if not move else (bucket,):
                for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                    if not self.tags[slot]:
                        self.tags[slot], self.keys[slot], self.payload[slot] = tag, key, payload
                        return
            slot = bucket * SLOTS + (tag + move) % SLOTS
            tag, self.tags[slot] = self.tags[slot], tag
            key, self.keys[slot] = self.keys[slot], key
            payload, self.payload[slot] = self.payload[slot], payload
            bucket = self._other(bucket, tag)
        if self.live * 4 < self.buckets * SLOTS:  # a table that is mostly empty does not overflow for want of room
            self.stash[key] = payload
            return
        held = [(k, p) for k, p in self.items()] + [(key, payload)]
        self.stash = {}
        self.buckets *= 2
        self.tags = [0] * (self.buckets * SLOTS)
        self.keys, self.payload = [None] * (self.buckets * SLOTS), [None] * (self.buckets * SLOTS)
        for k, p in held:
            self._file(k, p)

    def items(self):
        return chain(((k, p) for k, p in zip(self.keys, self.payload) if k is not None), self.stash.items())

    def to_bytes(self) -> bytes:
        return pickle.dumps((self.buckets, self.live, list(self.items())), 5)

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooIndex:
        index = cls()
        index.buckets, index.live, held = pickle.loads(blob)
        index.tags = [0] * (index.buckets * SLOTS)
        index.keys, index.payload = [None] * (index.buckets * SLOTS), [None] * (index.buckets * SLOTS)
        for k, p in held:
            index._file(k, p)
        return index

    def merge(self, key: bytes, keep_id, size: int, times: int) -> None:
        """Add ``size`` rows with this digest, ``times`` of them with ``keep_id``; the largest id so far stays."""
        old = self.get(key)
        if old is not None:
            size += old[1]
            if keep_id is None or old[0] is not None and old[0] > keep_id:
                keep_id, times = old[0], old[2] + (times if old[0] is None else 0)
            elif old[0] == keep_id:
                times += old[2]
        self.put(key, (keep_id, size, times))


def content() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def sha256(text: Column) -> Column:
    """The digest of a text as it is, 64 hex digits."""
    return F.sha2(text, 256)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


def _partial(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows with one digest are summed in a few parts, so that a group of any size reaches its bucket as a few rows."""
    by_id = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).alias("part")
    summed = by_id.groupBy("digest", part).agg(F.max(F.struct("doc_id", "n")).alias("most"), F.sum("n").alias("size"))
    return summed.select(_bucket(buckets), F.unhex("digest").alias("digest"), F.col("most.doc_id").alias("keep_id"), "size", F.col("most.n").alias("times"))


def _fill(index: CuckooIndex, rows: pa.Table) -> CuckooIndex:
    for row in zip(*(rows.column(c).to_pylist() for c in ("digest", "keep_id", "size", "times"))):
        index.merge(*row)
    return index


def groups(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows(doc_id, digest)`` → ``(digest, keep_id, group_size, times)`` of the digests that more than one row has."""

    def run(part: pa.Table) -> pa.Table:
        found = [(k.hex(), *p) for k, p in _fill(CuckooIndex(len(part)), part).items() if p[1] > 1]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], ["digest", "keep_id", "group_size", "times"])

    return _partial(rows, buckets).groupBy("bucket").applyInArrow(run, "digest string, keep_id long, group_size long, times long")


_INDEX = "bucket int, keys long, blob binary"


def _stored(bucket: int, index: CuckooIndex) -> pa.Table:
    return pa.table([pa.array([bucket], pa.int32()), pa.array([index.live], pa.int64()), pa.array([index.to_bytes()], pa.binary())], ["bucket", "keys", "blob"])


def live_rows(docs: DataFrame) -> DataFrame:
    """``(digest, doc_id, copies)``: the rows of a corpus that an index stands for."""
    return docs.select(sha256(content()).alias("digest"), "doc_id").groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))


def _states(live: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, digest, keep_id, size, times)`` of the digests in ``live``."""
    best = live.groupBy("digest").agg(F.max(F.struct("doc_id", "copies")).alias("most"), F.sum("copies").alias("size"))
    return best.select(_bucket(buckets), F.unhex("digest").alias("digest"), F.col("most.doc_id").alias("keep_id"), "size", F.col("most.copies").alias("times"))


def build_index(live: DataFrame, buckets: int) -> DataFrame:
    """:func:`live_rows` → ``(bucket, keys, blob)``: the index, one row for each bucket that has digests."""
    return _states(live, buckets).groupBy("bucket").applyInArrow(lambda part: _stored(part["bucket"][0].as_py(), _fill(CuckooIndex(len(part)), part)), _INDEX)


def update_index(index: DataFrame, live: DataFrame, added: DataFrame, removed: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(index, live rows) after the rows of ``removed(doc_id, text)`` are deleted and those of ``added`` are inserted.

    A digest goes from the index with its last row; while it has others, its size and the id that stays follow them.
    Rows that were never there are not removed."""
    change = live_rows(added).unionByName(live_rows(removed).withColumn("copies", -F.col("copies")))
    change = materialize(change.groupBy("digest", "doc_id").agg(F.sum("copies").alias("copies")), "change")
    after = materialize(live.unionByName(change).groupBy("digest", "doc_id").agg(F.sum("copies").alias("copies")).where("copies > 0"), "live")
    touched = change.select("digest").distinct()
    states = _states(after.join(touched, "digest", "left_semi"), buckets)
    gone = touched.join(after, "digest", "left_anti").select(_bucket(buckets), F.unhex("digest").alias("digest"))

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        held = CuckooIndex.from_bytes(old["blob"][0].as_py()) if len(old) else CuckooIndex(len(new))
        for key, keep_id, size, times in zip(*(new.column(c).to_pylist() for c in ("digest", "keep_id", "size", "times"))):
            held.delete(key) if size is None else held.put(key, (keep_id, size, times))
        return _stored((old if len(old) else new)["bucket"][0].as_py(), held)

    news = states.unionByName(gone, allowMissingColumns=True)
    return index.groupBy("bucket").cogroup(news.groupBy("bucket")).applyInArrow(run, _INDEX), after


def _decided(docs: DataFrame, digest: Callable[[Column], Column], bucket_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(groups by digest, groups by digest and text): what the index finds equal, and is; the second, for digests that
    several texts have, is None where there are none."""
    rows = materialize(docs.select("doc_id", digest(content()).alias("digest")), "digests")
    found = materialize(groups(rows, max(1, -(-rows.count() // bucket_rows))), "groups")
    # Of each digest the least and the greatest text, which are one; partly done before the exchange.
    texts = docs.select("doc_id", digest(content()).alias("digest"), content().alias("text")).join(merged(found.select("digest")), "digest", "left_semi")
    several = materialize(texts.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("digest"), "several")
    if several.isEmpty():
        return found, None
    by_id = texts.join(several, "digest", "left_semi").groupBy("digest", "text", "doc_id").agg(F.count("*").alias("n"))
    by_text = by_id.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "n")).alias("most"), F.sum("n").alias("group_size"))
    by_text = by_text.select("digest", F.col("text").alias("same"), F.col("most.doc_id").alias("keep_id"), "group_size", F.col("most.n").alias("times"))
    return found.join(several, "digest", "left_anti"), materialize(by_text, "by_text")


def _with_groups(rows: DataFrame, found: DataFrame, by_text: DataFrame | None) -> DataFrame:
    """``rows(digest, text, ...)`` with ``keep_id``, ``group_size`` and ``times``; null where a text is alone."""
    plain = rows.join(merged(found), "digest", "left")
    if by_text is None:
        return plain
    odd = by_text.select("digest").distinct()
    clash = rows.join(odd, "digest", "left_semi").join(by_text.withColumnRenamed("digest", "_digest"), (F.col("digest") == F.col("_digest")) & (F.col("text") == F.col("same")), "left")
    return plain.join(odd, "digest", "left_anti").unionByName(clash.drop("_digest", "same"))


def exact_duplicates(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for each row of ``docs``.

    Texts are equal if they are the same without any change; null is the empty text. Of a group the largest doc_id
    stays. Rows that repeat both id and text count in ``group_size`` and share one decision. Null ids stay only
    where no row of the group has an id. Other columns are ignored; an empty table gives an empty result.
    ``digest`` may be any key of an even number of hex digits: what it calls equal is held against the texts.
    """
    found, by_text = _decided(docs, digest, bucket_rows)
    rows = docs.select("doc_id", digest(content()).alias("digest"), *([content().alias("text")] if by_text is not None else []), sha256(content()).alias("text_sha256"))
    joined = _with_groups(rows, found, by_text)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def keep_last(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Each row is decided by its own id and text: the largest doc_id stays, a null one only where the group has no
    other. Of rows that repeat both, the least by the other columns stays. An empty table gives an empty result."""
    found, by_text = _decided(docs, digest, bucket_rows)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", digest(content()).alias("digest"), *([content().alias("text")] if by_text is not None else []))
    kept = _with_groups(rows, found, by_text).where(F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if by_text is None:
        return one_of_each(kept, "digest", found.where("times > 1").select("digest")).select("row.*")
    key = F.struct("digest", "text").alias("key")
    both = materialize(kept.where("times > 1").select(key).distinct(), "repeated")
    return one_of_each(kept.withColumn("key", key), "key", both).select("row.*")
