"""Language identification by n-gram filters: a bit-sliced Bloom filter whose rows are bitmasks of languages.

Row r of the table holds one bit for each language. The rows that an n-gram hashes to, AND-ed, give all languages
whose filter contains it. A text's n-grams are looked up at once, counted by language, and the counts are corrected
for each filter's false positives before they are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, per_slice

UNKNOWN = "und"
#: Rows of the table, hashes of an n-gram, n-gram sizes in bytes of a letter run with its edges.
TABLE_BITS, HASHES, SIZES = 20, 3, (2, 3, 4)
#: The documented sample: labelled documents of each language that the filters are filled from.
SAMPLE_DOCS = 400
#: An n-gram enters a language's filter if it makes up this part of its n-grams, and this part of the best language's rate.
LEAST_SHARE, LEAST_RATIO = 2e-6, 0.25
#: Languages that the filters can hold: eight bytes of each table row for every 64.
MOST_LANGUAGES = 512
#: The filter stage rejects a document below this part of the share of known n-grams that all but a hundredth of its
#: best language's labelled documents reach.
REJECT_PART, REJECT_QUANTILE = 0.5, 0.01

_LETTER = regex.compile(r"\p{L}")
_NON_LETTERS = regex.compile(r"[^\p{L}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ASCII = bytes(b if chr(b).isalpha() else 32 for b in range(128)) + bytes(range(128, 256))
#: Bytes of text that a worker's arrays cover at once.
SLICE = 1 << 20


def letters(text: str) -> bytes:
    """Lower-case letter runs, each with one space on both sides; empty if there is no letter."""
    lower = text.lower()
    if lower.isascii():
        runs = b" ".join(lower.encode().translate(_ASCII).split())
    else:
        runs = _NON_LETTERS.sub(" ", lower).strip(" ").encode()
    return b" " + runs + b" " if runs else b""


def ngram_codes(buf: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code of the ``size`` bytes (8 at most) from each position on."""
    n = max(0, len(buf) - size + 1)
    code = np.zeros(n, np.uint64)
    for k in range(size):
        code = (code << np.uint64(8)) | buf[k : k + n].astype(np.uint64)
    return code | np.uint64(size << 56)


def rows_of(code: np.ndarray, bits: int, hashes: int) -> list[np.ndarray]:
    """The table's rows of each n-gram: fields of one mixed product (``bits`` times ``hashes`` within 64)."""
    with np.errstate(over="ignore"):
        x = (code ^ (code >> np.uint64(29))) * _MIX
    x ^= x >> np.uint64(32)
    mask = np.uint64((1 << bits) - 1)
    return [((x >> np.uint64(k * bits)) & mask).astype(np.int64) for k in range(hashes)]


@dataclass
class LanguageFilters:
    """``tables`` masks of languages by row, one table for every 64 languages; ``false_positive`` the rate of each
    language's filter; ``least_known`` the share of known n-grams below which the filter stage rejects a text."""

    languages: list[str]
    tables: list[np.ndarray]
    false_positive: np.ndarray
    sizes: tuple[int, ...]
    hashes: int
    least_known: np.ndarray | None = None

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], bits: int = TABLE_BITS, hashes: int = HASHES, sizes: tuple[int, ...] = SIZES) -> LanguageFilters:
        """From texts at hand."""
        names = sorted(set(langs))
        codes, owners, shares = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for k, name in enumerate(names):
            bufs = [np.frombuffer(letters(t), np.uint8) for t, x in zip(texts, langs) if x == name]
            for s in sizes:
                code, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(ngram_codes(b, s) for b in bufs)]), return_counts=True)
                codes.append(code)
                owners.append(np.full(len(code), k))
                shares.append(n / max(1, n.sum()))
        code, owner, share = (np.concatenate(x) for x in (codes, owners, shares))
        every, at = np.unique(code, return_inverse=True)
        best = np.zeros(len(every))
        np.maximum.at(best, at, share)
        inside = (share >= LEAST_SHARE) & (share >= LEAST_RATIO * best[at])
        return cls.of(names, code[inside], owner[inside], bits, hashes, sizes)

    @classmethod
    def of(cls, names: list[str], code: np.ndarray, owner: np.ndarray, bits: int = TABLE_BITS, hashes: int = HASHES, sizes: tuple[int, ...] = SIZES) -> LanguageFilters:
        """From the n-grams that enter the filters: ``owner`` is the place of each one's language in ``names``."""
        if len(names) > MOST_LANGUAGES:
            raise ValueError(f"{len(names)} languages; the filters hold {MOST_LANGUAGES}")
        tables, full = [], []
        for low in range(0, len(names), 64):
            own = names[low : low + 64]
            kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(own) <= 8 * t().itemsize)
            table = np.zeros(1 << bits, kind)
            for k in range(len(own)):
                for r in rows_of(code[owner == low + k], bits, hashes):
                    table[r] |= kind(1 << k)
            tables.append(table)
            full += [((table >> kind(k)) & kind(1)).mean() for k in range(len(own))]
        return cls(names, tables, np.array(full) ** hashes, tuple(sizes), hashes)

    def masks(self, code: np.ndarray) -> list[np.ndarray]:
        """The languages that contain each n-gram, as bits, for every 64 languages."""
        if not self.tables:
            return []
        rows = rows_of(code, len(self.tables[0]).bit_length() - 1, self.hashes)
        return [np.bitwise_and.reduce([table[r] for r in rows]) for table in self.tables]

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language the corrected share of known n-grams; and the n-grams of each text."""
        bufs = [letters(t) for t in texts]
        size = np.array([len(b) for b in bufs], np.int64)
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        has = np.flatnonzero(size)
        buf = np.frombuffer(b"".join(bufs) + bytes(8), np.uint8)
        begin = (np.cumsum(size) - size)[has]
        ends = begin + size[has]
        for s in self.sizes if len(has) else ():
            total[has] += np.maximum(size[has] - s + 1, 0)
            for low, mask in enumerate(self.masks(ngram_codes(buf, s))):
                mask, kind = mask[: ends[-1]], mask.dtype.type
                for back in range(1, s):  # n-grams that leave their text
                    mask[np.maximum(ends - back, begin)] = 0
                for k in range(min(64, len(self.languages) - 64 * low)):
                    hits[has, 64 * low + k] += np.add.reduceat((mask >> kind(k)) & kind(1), begin, dtype=np.int64)
        fp = self.false_positive
        share = (hits - total[:, None] * fp) / np.maximum(total[:, None] * (1 - fp), 1e-9)
        return np.clip(share, 0, 1), total

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (the best language's part of all shares), and the best language's share of known n-grams.

        ``und`` and 0 for texts without a letter. Ties go to the first language in order of name."""
        share, total = self.shares(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best = share.argmax(axis=1)
        top = share[np.arange(len(texts)), best]
        score = np.where(share.sum(axis=1) > 0, top / np.maximum(share.sum(axis=1), 1e-12), 1 / len(self.languages))
        known = total > 0
        alone = [_LETTER.search(t) is not None for t in texts]
        lang = [self.languages[b] if k or a else UNKNOWN for b, k, a in zip(best, known, alone)]
        return lang, np.where(alone, score, 0.0), np.where(known, top, 0.0)


def _sample(rows: DataFrame, sample_docs: int) -> tuple[list[str], DataFrame]:
    """(languages, ``(lang, text)``): of each language about ``sample_docs`` documents, those with the least hash of doc_id."""
    counts = dict(rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect())
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5  # uniform from 0 to 1
    shares = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, sample_docs / n))) if counts else F.create_map(F.lit(""), F.lit(0.0))
    kept = rows.where(place <= shares[F.col("lang")])
    # One row for each id, so that a repeated id cannot make the sample grow.
    return sorted(counts), kept.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("r.lang", "r.text")


def _counted(sizes: tuple[int, ...]):
    """``mapInArrow``: the n-grams of each language in a run of texts and how often each occurs."""

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        langs = np.array(part.column(part.schema.get_field_index("lang")).to_pylist())
        out = []
        for name in np.unique(langs):
            bufs = [np.frombuffer(letters(texts[i]), np.uint8) for i in np.flatnonzero(langs == name)]
            for s in sizes:
                code, n = np.unique(np.concatenate([ngram_codes(b, s) for b in bufs]), return_counts=True)
                out.append((np.full(len(code), name), np.full(len(code), s), code.view(np.int64), n))
        lang, size, code, n = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(lang.tolist(), pa.string()), pa.array(size, pa.int32()), pa.array(code), pa.array(n, pa.int64())], ["lang", "size", "code", "n"])

    return run


def fit_filters(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sizes: tuple[int, ...] = SIZES) -> LanguageFilters:
    """Fill filters from ``labelled(doc_id, text, lang)``.

    The sample is bounded and documented: of each language (``MOST_LANGUAGES`` at most) the whole texts of about
    ``sample_docs`` documents, those with the least hash of doc_id. Rows without a language or a letter teach nothing.
    N-grams are counted where the texts are; the driver gets those that enter a filter, of which a language has
    ``1 / LEAST_SHARE`` of each size at most."""
    names, sample = _sample(labelled.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}")), sample_docs)
    sample = materialize(sample, "sample")
    grams = sample.mapInArrow(per_slice(_counted(sizes), limit=SLICE), "lang string, size int, code long, n long").groupBy("lang", "size", "code").agg(F.sum("n").alias("n"))
    grams = materialize(grams, "ngrams")
    whole = grams.groupBy("lang", "size").agg(F.sum("n").alias("whole"))
    shares = grams.join(whole, ["lang", "size"]).select("lang", "code", (F.col("n") / F.col("whole")).alias("share")).where(F.col("share") >= LEAST_SHARE)
    best = shares.groupBy("code").agg(F.max("share").alias("best"))
    inside = shares.join(best, "code").where(F.col("share") >= LEAST_RATIO * F.col("best")).select("lang", "code").toArrow()
    place = {x: k for k, x in enumerate(names)}
    owner = np.array([place[x] for x in inside["lang"].to_pylist()], np.int64)
    filters = LanguageFilters.of(names, inside["code"].to_numpy().view(np.uint64), owner, sizes=sizes)
    filters.least_known = _least_known(sample, filters)
    return filters


def _least_known(sample: DataFrame, filters: LanguageFilters) -> np.ndarray:
    """The share of known n-grams below which a text is in no known language, from the sample's own shares by language."""
    found = identify(sample.select(F.lit(0).cast("long").alias("doc_id"), "text", "lang"), filters, "lang").where("lang_pred = lang")
    low = dict(found.groupBy("lang").agg(F.percentile_approx("known", REJECT_QUANTILE, 10_000)).collect())  # one row for each language
    return np.array([REJECT_PART * low.get(x, 0.0) for x in filters.languages])


def identify(docs: DataFrame, filters: LanguageFilters, *more: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, lang_pred, score, known)``, one row for each row, and columns ``more`` as they are.

    ``und`` with score 0 for null and empty texts and texts without a letter; repeated rows get equal results; other
    columns are ignored; null ids are carried; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kept = docs.select("doc_id", "text", *more)

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        lang, score, known = shared.value.predict(texts)
        cols = [part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(known), *part.columns[2:]]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "known", *more])

    schema = ", ".join(["doc_id long, lang_pred string, score double, known double", *(f"`{c}` {dict(kept.dtypes)[c]}" for c in more)])
    return kept.mapInArrow(per_slice(run, limit=SLICE), schema)


def keep_known(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """``docs`` without the texts in no known language: ``und``, or too few n-grams known to the best language.

    Rows are judged where they are, each by its own text, so repeated and null ids do not matter; null and empty texts
    go, and an empty table stays empty. No row is moved."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        filters = shared.value
        lang, _, known = filters.predict(texts)
        limit = dict(zip(filters.languages, filters.least_known if filters.least_known is not None else np.zeros(len(filters.languages))))
        return part.filter(pa.array([x != UNKNOWN and k >= limit[x] for x, k in zip(lang, known)], pa.bool_()))

    return docs.mapInArrow(per_slice(run, limit=SLICE), docs.schema)
