"""How far the sources of a language differ in their words, with exact counts of the terms that can matter.

A count-min sketch holds in how many documents of its language each term is. Executors count cells and Spark adds them
up; as a sketch never understates, a term with a cell under the least document frequency cannot reach it, and is
dropped before anything is shuffled by term. What is left is counted exactly, and sources are compared by a sparse join
on the terms that both have; the terms that one or none of them has follow from counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .xxh import xxh64

#: Documents of its language that a kept term is in, counts that each term is given beforehand, scale of shares, ranks of terms.
LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Rows of the sketch and cells in each; the bits that the driver gets take ``DEPTH * WIDTH / 8`` bytes.
DEPTH, WIDTH = 2, 1 << 25
#: Distinct terms, and terms of single texts, that a task holds before it hands on what it has counted; bytes that are split at once.
HELD, HELD_OF_TEXTS, SPLIT_BYTES = 200_000, 2_000_000, 2 << 20
#: Bits of the sketch that one row carries.
_BLOCK = 1 << 16

#: Bytes of terms as they are, with A-Z in lower case, and all others as a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text, A-Z in lower case, in runs of bounded length."""
    raw = text.encode().translate(_FOLD)
    at = 0
    while at < len(raw):
        end = at + SPLIT_BYTES
        if end < len(raw):
            end = raw.rfind(b" ", at, end) if b" " in raw[at:end] else raw.find(b" ", end)
            end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end + 1


def cells_of(lang: str, terms: list[bytes], width: int) -> np.ndarray:
    """Numbers of a term's cells, one for each row of the sketch: ``(terms, DEPTH)``."""
    tail = b"\0" + lang.encode()
    rows = [t + tail for t in terms]
    size = np.array([len(r) for r in rows], np.int64)
    buf = np.frombuffer(b"".join(rows) + bytes(8), np.uint8)
    h = xxh64(buf, np.cumsum(size) - size, size)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        at = (low[:, None] + np.arange(DEPTH, dtype=np.uint64) * high[:, None]) % np.uint64(width)
    return at.astype(np.int64) + np.arange(DEPTH) * width


def _rows(batches) -> Iterator[tuple[str, str, str]]:
    for b in batches:
        lang, source, text = (b.column(i) for i in range(3))
        for i in range(b.num_rows):  # one text at a time, so that a batch of long ones is not held twice
            yield lang[i].as_py() or "", source[i].as_py() or "", text[i].as_py() or ""


def _sketcher(width: int):
    """``mapInArrow`` over ``(lang, source, text)``: cells and how many documents met them, each a few times a task."""

    def handed(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        at, n = [], []
        for lang, docs in seen.items():
            cells = cells_of(lang, list(docs), width)
            at.append(cells.ravel())
            n.append(np.repeat(np.fromiter(docs.values(), np.int64, len(docs)), DEPTH))
        if at:
            cells, where = np.unique(np.concatenate(at), return_inverse=True)
            total = np.bincount(where, np.concatenate(n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total)], ["cell", "n"])

    def run(batches):
        seen: dict[str, Counter] = {}
        held = 0
        for lang, _, text in _rows(batches):
            own: set[bytes] = set()
            for run_of in terms_of(text):
                own.update(run_of)
            docs = seen.setdefault(lang, Counter())
            held -= len(docs)
            docs.update(own)
            held += len(docs)
            if held > HELD:
                yield from handed(seen)
                seen, held = {}, 0
        yield from handed(seen)

    return run


def sketch(docs: DataFrame, least: int = LEAST_DOCS, width: int = WIDTH) -> bytes:
    """A bit for each cell of the merged sketch of ``docs(lang, source, text)``, set where it counts ``least`` documents
    or more; of ``DEPTH * width / 8`` bytes at any size of the corpus. ``width`` is a multiple of 65536. A wider sketch costs
    no more to add up, as only cells that were met are shuffled; it should have about as many cells in a row as terms."""
    cells = docs.select("lang", "source", "text").mapInArrow(_sketcher(width), "cell long, n long")
    reached = cells.repartition("cell").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= least)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(_BLOCK, bool)
        bits[np.asarray(table.column("cell")) % _BLOCK] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    blocks = reached.select((F.col("cell") / _BLOCK).cast("long").alias("block"), "cell").groupBy("block").applyInArrow(pack, "block long, bits binary")
    out = bytearray(DEPTH * width // 8)
    for block, bits in blocks.collect():  # at most DEPTH * width / _BLOCK rows
        out[block * _BLOCK // 8 : (block + 1) * _BLOCK // 8] = bits
    return bytes(out)


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


class _Held:
    """The terms of some texts as numbers: of each language, term and group of its own, and what each text adds."""

    def __init__(self):
        self.number: dict[str, dict[bytes, int]] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: dict[str, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        self.entries = self.terms = 0

    def add(self, lang: str, source: str, text: str) -> None:
        number = self.number.setdefault(lang, defaultdict(count().__next__))
        group = self.groups.setdefault((lang, source), len(self.groups))
        self.terms -= len(number)
        ids = [np.fromiter(map(number.__getitem__, run), np.int64, len(run)) for run in terms_of(text)]
        self.terms += len(number)
        if ids:
            own, n = np.unique(np.concatenate(ids), return_counts=True)
            self.parts.setdefault(lang, []).append((group, own, n))
            self.entries += len(own)

    def counted(self, able: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
        names = [source for _, source in self.groups]
        for lang, parts in self.parts.items():
            terms = list(self.number[lang])
            if not terms:
                continue
            kept = _set(able, cells_of(lang, terms, width)).all(axis=1)
            own, n = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
            group = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
            group, own, n = group[kept[own]], own[kept[own]], n[kept[own]]
            key, where = np.unique(group * len(terms) + own, return_inverse=True)
            said = pa.array([t.decode() for t in terms]).take(pa.array(key % len(terms)))
            source = pa.array(names, pa.string()).take(pa.array(key // len(terms)))
            total = [pa.array(x.astype(np.int64)) for x in (np.bincount(where, n, len(key)), np.bincount(where, minlength=len(key)))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), source, said, *total], ["lang", "source", "term", "count", "docs"])


def _counter(bits, width: int):
    """``mapInArrow`` over ``(lang, source, text)``: occurrences and documents of the terms whose cells are all set."""

    def run(batches):
        able, held = np.frombuffer(bits.value, np.uint8), _Held()
        for row in _rows(batches):
            held.add(*row)
            if held.terms > HELD or held.entries > HELD_OF_TEXTS:
                yield from held.counted(able, width)
                held = _Held()
        yield from held.counted(able, width)

    return run


def term_counts(docs: DataFrame, least: int = LEAST_DOCS, width: int = WIDTH) -> DataFrame:
    """``docs(lang, source, text)`` → ``(lang, source, term, count)`` of the terms in ``least`` documents of their
    language or more, exactly. Nulls count as empty strings. Groups of a common source are counted in part by each task."""
    bits = docs.sparkSession.sparkContext.broadcast(sketch(docs, least, width))
    partial = docs.select("lang", "source", "text").mapInArrow(_counter(bits, width), "lang string, source string, term string, count long, docs long")
    by_term = partial.repartition("lang", "term")  # tasks have added up what they hold: no use in a second time before the exchange
    found = materialize(by_term.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "terms")
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term")
    return found.join(kept, ["lang", "term"]).select("lang", "source", "term", "count")


def _share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """``1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms))``, in whole numbers."""
    exact = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    over, under = (exact(count) + SMOOTH) * SCALE, exact(total) + SMOOTH * exact(terms)
    return F.call_function("div", over, under) + 1


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(by))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, width: int = WIDTH) -> DataFrame:
    """``docs(text, lang, source, ...)`` → ``(lang, source, part, item, value, rank)``.

    Part ``pair``: every other source of the language, by how far the smoothed shares of all kept terms differ. Part
    ``term``: the ``top`` kept terms that the source has above its language's share. Nulls are empty strings, groups
    without any term count; repeated rows count each; other columns are ignored; an empty table gives no rows."""
    names = lambda c: F.coalesce(c, F.lit("")).alias(c)
    groups = docs.select(names("lang"), names("source")).distinct()
    counts = materialize(term_counts(docs, least, width), "kept")
    words = counts.groupBy("lang", "term").agg(F.sum("count").alias("total"))
    of_lang = words.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all"))
    own = counts.groupBy("lang", "source").agg(F.sum("count").alias("size"), F.count("*").alias("present"))
    zero = F.lit(0).cast("long")
    sized = groups.join(of_lang, "lang", "left").join(own, ["lang", "source"], "left").select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("terms", "all", "size", "present")))
    sized = materialize(sized.withColumn("none", F.when(F.col("terms") > 0, _share(zero, "size", "terms")).otherwise(zero)), "groups")

    shares = materialize(counts.join(sized, ["lang", "source"]).select("lang", "source", "term", "count", "none", "terms", "all", _share("count", "size", "terms").alias("p")), "shares")

    # Over the terms of a, |p_a - none_b| depends on the count alone: a few distinct shares of each source stand for all.
    spread = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    base = sized.select("lang", F.col("source").alias("item"), F.col("none").alias("q"))
    alone = spread.join(base, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("n") * F.abs(F.col("p") - F.col("q"))).alias("alone"))
    # Terms that both have: what they differ by, in place of what each differs from the other's share of none.
    a = shares.select("lang", "term", "source", "p", "none")
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("none").alias("q_none"))
    change = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("q_none")) - F.abs(F.col("q") - F.col("none"))
    shared = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(change).alias("change"), F.count("*").alias("both"))

    left = sized.select("lang", "source", "terms", "none", "present")
    right = sized.select("lang", F.col("source").alias("item"), F.col("none").alias("q"), F.col("present").alias("q_present"))
    pairs = left.join(right, "lang").where("source < item")
    of = lambda df, x, y, name: df.select("lang", F.col("source").alias(x), F.col("item").alias(y), F.col("alone").alias(name))
    pairs = pairs.join(of(alone, "source", "item", "alone"), ["lang", "source", "item"], "left").join(of(alone, "item", "source", "q_alone"), ["lang", "source", "item"], "left")
    pairs = pairs.join(shared, ["lang", "source", "item"], "left")
    n = lambda c: F.coalesce(c, zero)
    neither = F.col("terms") - F.col("present") - F.col("q_present") + n("both")
    value = n("alone") + n("q_alone") + n("change") + neither * F.abs(F.col("none") - F.col("q"))
    pairs = pairs.select("lang", "source", "item", value.cast("long").alias("value"))
    both = materialize(pairs, "pairs")
    pairs = _ranked(both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")))

    above = shares.join(words, ["lang", "term"]).withColumn("q", _share("total", "all", "terms")).where("p > q")
    terms = _ranked(above.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), top)
    out = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").unionByName(out(terms, "term"))
