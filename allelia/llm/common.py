"""Helpers that the training-data operators share: Arrow text and word buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import discard, materialize, shared_root, stored  # noqa: F401

#: Whitespace of the word pattern ``[^\x20\x09-\x0D]+``, as a Java character class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: UTF-8 bytes that a Python worker handles at once; bounds its memory whatever the batch size.
SLICE_BYTES = 2 << 20

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's shuffle setting, sized by who runs the cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut a record batch into runs of rows with about ``limit`` bytes of text; null texts become empty."""
    at = batch.schema.get_field_index(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64)
    if not len(sizes):
        return
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        part = batch.slice(a, b - a)
        yield part, [t or "" for t in part.column(at).to_pylist()]


def per_slice(fn: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch | None], column: str = "text", limit: int = SLICE_BYTES):
    """A ``mapInArrow`` function that applies ``fn`` to each slice of :func:`text_slices`."""

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, column, limit):
                out = fn(part, texts)
                if out is not None and out.num_rows:
                    yield out

    return run


class Words:
    """The words of several texts in one buffer, single-spaced, each followed by one space.

    ``buf`` bytes; ``start``, ``end`` of each word; ``count`` words of each text; ``first`` word of each text.
    """

    def __init__(self, texts: list[str], lower: bool = False):
        rows = [t.encode() for t in texts]
        split = [(r.lower() if lower else r).split() for r in rows]  # bytes: ASCII rules only
        self.count = np.array([len(w) for w in split], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])[:-1]
        joined = b" ".join(b" ".join(w) for w in split if w) + b" "
        if not self.count.sum():
            joined = b""
        self.buf = np.frombuffer(joined + bytes(40), dtype=np.uint8)
        self.end = np.flatnonzero(self.buf[: len(joined)] == 32)
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else self.end

    def text_of(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.count)), self.count)


def merged(decisions: DataFrame) -> DataFrame:
    """A table that grows with the corpus, to be joined to its texts by merging at every size: what a small one costs
    then says what a large one will."""
    return decisions.hint("merge")


def one_of_each(kept: DataFrame, key: str, repeated: DataFrame) -> DataFrame:
    """``kept(row, key, ...)`` with one row of each key in the stored table ``repeated(key)``, the least, and all rows of other keys."""
    if repeated.isEmpty():
        return kept
    ordered = "map<" not in kept.schema["row"].dataType.simpleString()
    one = (F.min if ordered else F.first)("row").alias("row")  # partly done before the exchange
    again = kept.join(repeated, key, "left_semi").groupBy(key).agg(one).select("row", key)
    return kept.join(repeated, key, "left_anti").select("row", key).unionByName(again)
