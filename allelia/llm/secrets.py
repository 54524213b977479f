"""Secret scans in DataFrame functions: three fixed patterns, and strings that pass for random.

A candidate is a long run of encoding characters with letters and digits. Its encoding is inferred from its
characters, and a battery asks whether it looks uniformly random in it: chi-squared over the alphabet, runs about
the median, serial correlation. Bonferroni combines the three. Ordinary strings pile up at small p-values; random
ones are uniform. For each class of lengths, over distinct strings that no pattern covers, the number of random ones
is read off the upper half of the p-values (Storey's estimate), and the cut is the least at which ordinary strings
are a small part of those above it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, log_tail, running, sums_before, whole_text
from .common import materialize

# The base patterns, all ASCII; (kind, pattern, group whose length counts, least length).
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KINDS = ("assign", "access", "hex", "random")
#: A sign before a string is none of it (``KEY=string``); behind it one or two are padding, unless more text follows at once.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings in the order they are tried: what the string may hold, and the alphabet it is tested over.
ENCODINGS = (
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", _UPPER + "234567"),
    ("^[0-9a-z]+$", _DIGITS + _LOWER),
    ("^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS),
    ("^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    ("", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
#: Lengths at which a class begins; steps of the p-value grid; part of ordinary strings allowed among those reported;
#: strings that the counts of the other lengths add to a class, and uniform ones to those; the least cut.
LENGTH_CLASSES, GRID, FALSE_PART, PRIOR, PLAIN_CUT = (20, 28, 40, 64), 50, 0.05, 200, 0.02
MASK = "[SECRET]"

#: Spans are (start, kind, end) in code points, and (from, to) in bytes of UTF-8, which any part can be cut out by at once.
_SPAN = "array<struct<start:long,kind:int,end:long,from:long,to:long>>"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<start, end, from, to, own>>`` of a pattern's matches, leftmost and non-overlapping; ``own`` is what a
    group matched. Places are running sums over the gaps and matches, so the work follows the text."""
    chars = lambda x: F.char_length(x).cast("long")
    bytes_ = lambda x: F.octet_length(x).cast("long")

    def placed(rows: Column) -> Column:
        before = lambda size: sums_before(F.transform(rows, lambda r: size(r["gap"]) + size(r["all"])))
        at = lambda x: (x["start"] + chars(x["row"]["gap"]), x["from"] + bytes_(x["row"]["gap"]))

        def span(x: Column) -> Column:
            start, from_ = at(x)
            return F.struct(start.alias("start"), (start + chars(x["row"]["all"])).alias("end"), from_.alias("from"), (from_ + bytes_(x["row"]["all"])).alias("to"), x["row"]["own"].alias("own"))

        return F.transform(F.arrays_zip(rows.alias("row"), before(chars).alias("start"), before(bytes_).alias("from")), span)

    all_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else all_
    rows = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), all_.alias("all"), own.alias("own")), lambda r: F.struct(r["gap"].alias("gap"), r["all"].alias("all"), r["own"].alias("own")))
    return let(F.filter(rows, lambda r: r["all"].isNotNull()), placed)  # the last gap has no match behind it


def _found(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of a pattern's matches; too short ones are dropped after the match, so they use up their text."""
    kept = F.filter(_matches(text, pattern, group), lambda m: F.char_length(m["own"]) >= least)
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["from"].alias("from"), m["to"].alias("to")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds as one array, by start and then kind."""
    return F.sort_array(F.concat(*(_found(text, KINDS.index(k), p, g, n) for k, p, g, n in BASE)))


def _symbols(token: Column) -> Column:
    """The positions of a string's characters in its encoding's alphabet, and the alphabet's size."""
    alphabet = F.coalesce(*(F.when(token.rlike(p), F.lit(a)) for p, a in ENCODINGS))
    places = lambda a: F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(a, c) - 1)
    return let(alphabet, lambda a: F.struct(places(a).alias("x"), F.length(a).alias("k")))


def battery(token: Column) -> Column:
    """p-value of the hypothesis that a string is uniformly random in its encoding: three tests, Bonferroni."""

    zero = F.lit(0.0)

    def counted(s: Column) -> Column:
        """Sums over the symbols, each taken once: what is said twice in an expression is computed twice."""
        x = s["x"]
        # Of equal symbols, which stand together once sorted, the one after r others adds (r + 1)^2 - r^2 to the sum of squares.
        none = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("sum"))
        run = lambda a, y: F.when(a["last"] == y, a["run"] + 1).otherwise(0)
        squares = F.aggregate(F.sort_array(x), none, lambda a, y: F.struct(y.alias("last"), run(a, y).alias("run"), (a["sum"] + 2 * run(a, y) + 1).alias("sum")), lambda a: a["sum"].cast("double"))
        mean = F.aggregate(x, zero, lambda a, y: a + y) / F.size(x)
        return F.struct(x.alias("x"), s["k"].cast("double").alias("k"), F.size(x).cast("double").alias("n"), squares.alias("squares"), mean.alias("mean"), F.transform(x, lambda y: y * 2 >= s["k"]).alias("above"))

    def spread(s: Column) -> Column:
        x, mean, above = s["x"], s["mean"], s["above"]
        var = F.aggregate(x, zero, lambda a, y: a + (y - mean) * (y - mean))
        lagged = F.aggregate(F.zip_with(x, F.slice(x, 2, F.size(x)), lambda a, b: F.coalesce((a - mean) * (b - mean), zero)), zero, lambda a, y: a + y)
        ups = F.size(F.filter(above, lambda y: y)).cast("double")
        changes = F.size(F.filter(F.zip_with(above, F.slice(above, 2, F.size(above)), lambda a, b: a != b), lambda y: y)).cast("double") + 1
        return F.struct(s["n"].alias("n"), s["k"].alias("k"), s["squares"].alias("squares"), var.alias("var"), lagged.alias("lagged"), ups.alias("ups"), changes.alias("changes"))

    def tests(s: Column) -> Column:
        n, k = s["n"], s["k"]
        p_chi = log_tail((s["squares"] * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
        expected = 2 * s["ups"] * (n - s["ups"]) / n + 1
        spread_ = (expected - 1) * (expected - 2) / (n - 1)
        p_runs = F.when(spread_ > 0, 2 * log_tail(F.abs(s["changes"] - expected) / F.sqrt(spread_))).otherwise(0.0)
        p_serial = F.when(s["var"] > 0, 2 * log_tail(F.abs(s["lagged"] / s["var"] + 1 / n) * F.sqrt(n))).otherwise(0.0)
        return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))

    return let(let(let(_symbols(token), counted), spread), tests)


_JUDGED = "array<struct<start:long,kind:int,end:long,from:long,to:long,p:double,h:long,free:boolean>>"


def candidates(text: Column) -> Column:
    """``array<struct<start, kind, end, from, to, p, h>>`` of the candidate strings, ``h`` a hash of the string."""

    def scored(m: Column) -> Column:
        token = F.regexp_replace(m["own"], "=+$", "")
        return let(token, lambda x: F.struct(m["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), m["end"].alias("end"), m["from"].alias("from"), m["to"].alias("to"), battery(x).alias("p"), F.xxhash64(x).alias("h")))

    return F.transform(_matches(text, CANDIDATE), scored)


def judged(text: Column) -> Column:
    """Base spans and candidates of a text by start and then kind; ``free`` candidates meet no base span.

    The greatest end among the base spans before a candidate and the least start among those behind it tell."""
    plain = F.transform(base_spans(text), lambda b: F.struct(*(b[c].alias(c) for c in ("start", "kind", "end", "from", "to")), F.lit(None).cast("double").alias("p"), F.lit(None).cast("long").alias("h")))
    far = F.lit((1 << 62)).cast("long")

    def told(spans: Column) -> Column:
        is_base = lambda x: x["kind"] < KINDS.index("random")
        ends = running(F.transform(spans, lambda x: F.when(is_base(x), x["end"]).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), F.greatest)
        starts = running(F.reverse(F.transform(spans, lambda x: F.when(is_base(x), x["start"]).otherwise(far))), far, F.least)
        rows = F.arrays_zip(spans.alias("x"), ends.alias("before"), F.reverse(starts).alias("behind"))
        free = lambda r: ~is_base(r["x"]) & (r["before"] <= r["x"]["start"]) & (r["behind"] >= r["x"]["end"])
        return F.transform(rows, lambda r: F.struct(*(r["x"][c].alias(c) for c in ("start", "kind", "end", "from", "to", "p", "h")), free(r).alias("free")))

    none = F.array().cast(_JUDGED)
    return let(F.sort_array(F.concat(plain, candidates(text))), lambda spans: F.when(F.size(spans) > 0, told(spans)).otherwise(none))


def _length_class(size: Column) -> Column:
    return sum(((size >= n).cast("int") for n in LENGTH_CLASSES), F.lit(0))


def cuts(scored: DataFrame) -> dict[int, float]:
    """The least p-value that is reported, by class of lengths, from ``scored(spans)`` of :func:`judged`; the counts are a bounded grid.

    A string counts once, however often it is repeated. A class's counts are shrunk towards those of the other
    lengths, by ``PRIOR`` strings at most and never by more than there are: no string counts that was not found."""
    free = scored.select(F.explode(F.filter("spans", lambda x: x["free"])).alias("c"))
    strings = free.groupBy("c.h").agg(F.min(F.struct((F.col("c.end") - F.col("c.start")).alias("length"), F.col("c.p").alias("p"))).alias("s")).select("s.length", "s.p")
    one = strings.select(_length_class(F.col("length")).alias("size"), F.least(F.floor(F.col("p") * GRID), F.lit(GRID - 1)).cast("int").alias("at"))
    table: dict[int, list[int]] = {k: [0] * GRID for k in range(len(LENGTH_CLASSES) + 1)}
    for size, at, n in one.groupBy("size", "at").count().collect():  # at most 5 x GRID rows
        table[size][at] += n
    out = {}
    for k, own in table.items():
        others = [sum(x) - n for x, n in zip(zip(*table.values()), own)]
        weight = min(1.0, PRIOR / max(1, sum(others)))
        out[k] = _cut([n + weight * m for n, m in zip(own, others)])
    return out


def _cut(counts: list[float]) -> float:
    """The least grid point from which on ordinary strings are FALSE_PART at most; 1 or more if there is none."""
    upper = sum(counts[GRID // 2 :])  # these are taken as random; as many are below, give or take what chance allows
    random = (upper + 1 + math.sqrt(upper + 1) / 2) / (GRID - GRID // 2)
    for at in range(GRID):
        above = sum(counts[at:])
        if above and above - random * (GRID - at) <= FALSE_PART * above:
            return max(at / GRID, PLAIN_CUT)
    return 2.0


def _accepted(spans: Column, limits: dict[int, float]) -> Column:
    """Base spans and the accepted candidates that meet none of them, in order."""
    table = F.array(*(F.lit(limits[k]) for k in sorted(limits)))
    limit = lambda c: F.element_at(table, _length_class(c["end"] - c["start"]) + 1)
    kept = F.filter(spans, lambda c: (c["kind"] < KINDS.index("random")) | c["free"] & (c["p"] >= limit(c)))
    return F.transform(kept, lambda x: F.struct(*(x[c].alias(c) for c in ("start", "kind", "end", "from", "to"))))


def joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, base, spans)``, arrays of (start, kind, end) in code points and (from, to) in bytes.

    Null and empty texts have no spans; repeated rows get equal ones; null ids are carried; other columns are
    ignored; an empty table gives an empty result. The work of a text follows its length and its spans."""
    first = materialize(docs.select("doc_id", judged(whole_text()).alias("spans")), "secrets")
    found = _accepted(F.col("spans"), cuts(first))
    return first.select("doc_id", F.filter(found, lambda x: x["kind"] < KINDS.index("random")).alias("base"), found.alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """Counts and span lists of :func:`scan`."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def base_report(docs: DataFrame) -> DataFrame:
    """``docs`` → ``(doc_id, spans)``: the base spans alone."""
    return docs.select("doc_id", joined(base_spans(whole_text())).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by MASK."""
    raw, zero = text.cast("binary"), F.lit(0).cast("long")
    cut = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string")

    def done(xs: Column) -> Column:
        ends = running(F.transform(xs, lambda x: x["to"]), zero, F.greatest)
        heads = F.filter(F.arrays_zip(xs.alias("x"), ends.alias("end")), lambda r: r["x"]["from"] >= r["end"])
        pieces = F.transform(heads, lambda r: F.concat(cut(r["end"], r["x"]["from"]), F.lit(MASK)))
        last = F.array_max(F.transform(xs, lambda x: x["to"]))
        return F.concat(F.array_join(pieces, ""), cut(last, F.octet_length(text).cast("long")))

    return F.when(F.size(spans) > 0, let(spans, done)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of :func:`scan` masked in ``text`` (and ``n_chars`` counted anew where it exists).

    Null texts stay null. Rows are scanned once and stored with their spans; repeated and null ids do not matter."""
    found = materialize(docs.select(F.struct(*docs.columns).alias("row"), judged(F.coalesce("text", F.lit(""))).alias("spans")), "secrets")
    text = F.col("row.text")
    out = F.when(text.isNotNull(), masked(text, _accepted(F.col("spans"), cuts(found)))).alias("text")
    kind = {f.name: f.dataType for f in docs.schema}
    done = found.select("row", out)
    size = F.char_length("text").cast(kind["n_chars"]) if "n_chars" in kind else None
    return done.select(*(F.col("text") if c == "text" else size.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns))
