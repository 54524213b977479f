"""Quality rules with adaptive thresholds, in DataFrame functions.

The rates of each text are sketched by language and source (KLL, mergeable): the rates above zero, and how many rows
have none, as most texts of a clean source have no repeated line or symbol at all. A group's upper limit follows from
its tail, its spread and how common and how high its positive rates are. These are drawn towards those of the merged
sketches of its language, and these towards those of all, by the weight of a fixed number of rows, so that every group
has limits of its own and none jumps as it grows. The limits are joined back to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, whole_text, words
from .common import SPACE_CHARS, materialize

SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 3, 50, 0.5
#: Rates that get a limit, with how far beyond the group's own level a text may be at least.
RATES = {"word_length": 0.0, "symbol_rate": 0.04, "dup_line_rate": 0.04, "repeat_rate": 0.35}
#: Rows from which on a rate is in the tail, as a share; interquartile ranges, and times the usual positive rate by its
#: share of rows and that of the others, from there to the limit; rows that what a group's parent has counts as.
TAIL, SPREAD, LIFT, PARENT_ROWS = 0.85, 6.0, 1.0, 300
#: Steps of the ranks at which sketches are read.
GRID = 64


def _repeated(w: Column) -> Column:
    """Words in windows of three that occur twice or more. Windows go by a 64-bit hash; 44 bits of it and the place
    are sorted as one long, and neighbours that agree are compared in full."""
    n = F.size(w)
    grams = F.transform(F.slice(w, 1, F.greatest(n - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    low = F.lit((1 << 20) - 1).cast("long")

    def places(g: Column) -> Column:
        packed = F.sort_array(F.transform(g, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
        at = lambda p, j: F.get(g, F.get(p, j).bitwiseAND(low).cast("int"))
        high = lambda p, j: F.shiftrightunsigned(F.get(p, j), 20)

        def hits(p: Column) -> Column:
            near = lambda j, k: (F.coalesce(high(p, j) == high(p, k), F.lit(False)))
            same = F.filter(p, lambda x, j: near(j, j - 1) | near(j, j + 1))
            return let(same, lambda s: F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(exact(g, s)))

        return let(packed, hits)

    def exact(g: Column, s: Column) -> Column:
        """Of the places whose 44 bits agree with a neighbour's, those whose whole hash does."""
        rows = F.sort_array(F.transform(s, lambda x: F.struct(F.get(g, x.bitwiseAND(low).cast("int")).alias("h"), x.bitwiseAND(low).cast("int").alias("i"))))
        return let(rows, lambda r: F.transform(F.filter(r, lambda x, j: F.coalesce(x["h"] == F.get(r, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(r, j + 1)["h"], F.lit(False))), lambda x: x["i"]))

    def long_places(g: Column) -> Column:
        rows = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(rows, lambda r: F.transform(F.filter(r, lambda x, j: F.coalesce(x["h"] == F.get(r, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(r, j + 1)["h"], F.lit(False))), lambda x: x["i"]))

    found = let(grams, lambda g: F.when(F.size(g) < (1 << 20), places(g)).otherwise(long_places(g)))
    covered = lambda p: F.size(F.array_distinct(F.flatten(F.transform(p, lambda i: F.array(i, i + 1, i + 2)))))
    return let(found, lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(covered(p))).cast("long")


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) of a non-null text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    return F.struct(
        F.char_length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"))).alias("w"),
    )


def measured(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang, source, ...)`` → the counts of :func:`measures`, ``base_failed`` and the rates, by doc_id, lang and source."""
    m = docs.select("doc_id", "lang", "source", measures(whole_text()).alias("m"))
    m = m.select("doc_id", "lang", "source", F.col("m.w.n_words").alias("n_words"), "m.word_chars", "m.n_symbols", "m.n_dup_lines", F.col("m.w.n_repeat_words").alias("n_repeat_words"))
    per = lambda x: F.col(x) / F.greatest("n_words", F.lit(1))
    return m.select(
        "*",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 100 * MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        per("word_chars").alias("word_length"), (F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("symbol_rate"),
        per("n_dup_lines").alias("dup_line_rate"), per("n_repeat_words").alias("repeat_rate"),
    )


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` → ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)``, without any limit."""
    return measured(docs).select("doc_id", *BASE, "base_failed")


def limits(rows: DataFrame) -> DataFrame:
    """``(lang, source, limit_<rate>...)`` of each language and source in ``rows``, from the rows that pass the base rules."""
    passed = rows.where("not base_failed")
    above = lambda r: F.when(F.col(r) > 0, F.col(r))
    own = passed.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.count(above(r)).alias(f"n_{r}") for r in RATES), *(F.kll_sketch_agg_double(above(r)).alias(r) for r in RATES))
    merged = lambda df: df.agg(F.sum("n").alias("n"), *(F.sum(f"n_{r}").alias(f"n_{r}") for r in RATES), *(F.kll_merge_agg_double(r).alias(r) for r in RATES))
    own = materialize(own, "sketches")
    every = ("n", *(f"n_{r}" for r in RATES), *RATES)
    by_lang = merged(own.groupBy("lang")).select(F.col("lang").alias("_lang"), F.struct(*every).alias("of_lang"))
    of_all = merged(own.groupBy()).select(F.struct(*every).alias("of_all"))
    joined = own.select("lang", "source", F.struct(*every).alias("of_group")).join(by_lang, F.col("lang").eqNullSafe(F.col("_lang"))).join(F.broadcast(of_all))  # of_all is one row

    def drawn(of) -> Column:
        """A figure of the group, drawn towards its language's, drawn towards that of all."""
        towards = lambda level, parent: (F.col(f"{level}.n") * of(level) + PARENT_ROWS * parent) / (F.col(f"{level}.n") + PARENT_ROWS)
        return towards("of_group", towards("of_lang", of("of_all")))

    def limit(rate: str, least: float) -> Column:
        share = lambda level: F.col(f"{level}.n_{rate}") / F.greatest(F.col(f"{level}.n"), F.lit(1))
        # A sketch takes fixed ranks only, so those of the positive rates are read off a grid.
        grid = lambda level: F.kll_sketch_get_quantile_double(F.col(f"{level}.{rate}"), F.array(*(F.lit(i / GRID) for i in range(GRID + 1))))
        positive = lambda level, at: F.get(grid(level), F.round(at * GRID).cast("int"))

        def quantile(at: float):
            """Of all rows: zero up to the share that has none, and then from the sketch of the others."""
            return lambda level: F.when(share(level) > 1 - at, positive(level, F.greatest(F.lit(0.0), 1 - (1 - at) / share(level)))).otherwise(0.0)

        usual = lambda level: F.when(share(level) > 0, share(level) * (1 - share(level)) * positive(level, F.lit(0.5))).otherwise(0.0)
        range_ = drawn(quantile(0.75)) - drawn(quantile(0.25))
        return (drawn(quantile(TAIL)) + SPREAD * range_ + LIFT * drawn(usual) + least).alias(f"limit_{rate}")

    return joined.select("lang", "source", *(limit(r, x) for r, x in RATES.items()))


def judge(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang, source, ...)`` → ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept)``, one row for each row of ``docs``.

    Null and empty texts count no words, fail the base rules and are not kept. Null languages and sources are groups
    of their own. Repeated rows get equal results; other columns are ignored; an empty table gives an empty result."""
    rows = materialize(measured(docs), "measures")
    found = limits(rows).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(f"limit_{r}" for r in RATES))
    both = rows.join(found, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    within = F.lit(True)
    for r in RATES:
        within = within & F.coalesce(F.col(r) <= F.col(f"limit_{r}"), F.lit(True))
    return both.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & within).alias("kept"))
