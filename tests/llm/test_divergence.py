"""The audit against plain loops; the sketch never drops a term that counts."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from allelia.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, top):
    groups, docs, counts = set(), Counter(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(q[t] - p[s][t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", sorted(term, key=lambda x: (x[0], x[1].encode()))[:top])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())))}
    return out


def corpus(n, seed=3):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "ÉÉ", "中文", "Word", "WORD", "x_y", "a1b"]
    rows = [(" ".join(rnd.choice(words[: rnd.choice((20, 127))]) for _ in range(rnd.randrange(40))), rnd.choice(("en", "de", None)), rnd.choice(("hot", "hot", "a", "b", None))) for _ in range(n)]
    return rows + [(None, "en", "bare"), ("", None, ""), ("12 34 !!", "fr", "digits"), ("one two", "fr", "few"), ("one two", "fr", "few")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "count", "value", "rank", "p", "terms")})


@pytest.mark.parametrize("least", [1, 5])
def test_audit(spark, least):
    rows = corpus(300)
    got = [tuple(r) for r in divergence.audit(frame(spark, rows), least, top=7).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, least, 7)


def test_narrow_sketch_changes_nothing(spark):
    """With cells that nearly all terms share nothing is discarded wrongly, and the result is the same."""
    rows = corpus(300)
    assert {tuple(r) for r in divergence.audit(frame(spark, rows), 5, 7, width=1 << 16).collect()} == plain(rows, 5, 7)


def test_sketch_prunes_and_never_understates(spark):
    rows = [(f"common once{''.join(chr(97 + int(c)) for c in str(i))}", "en", "a") for i in range(400)]
    bits = divergence.sketch(frame(spark, rows), 30)
    import numpy as np

    able = lambda t: divergence._set(np.frombuffer(bits, np.uint8), divergence.cells_of("en", [t], divergence.WIDTH)).all()
    assert able(b"common") and sum(able(r[0].split()[1].encode()) for r in rows) == 0


def test_nothing_and_no_terms(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    got = {tuple(r) for r in divergence.audit(frame(spark, [("a b", "en", "x"), (None, "en", "y")])).collect()}
    assert got == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


def test_long_texts_are_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(divergence, "SPLIT_BYTES", 7)
    for text in ("aa bb  cccccccccccc dd", " a b c d e f g h ", "x" * 30, "É" * 9 + " Éa"):
        assert [t.decode() for run in divergence.terms_of(text) for t in run] == TERM.findall(text.translate(LOWER))


def test_counts_are_handed_on(spark, monkeypatch):
    rows = corpus(200)
    whole = {tuple(r) for r in divergence.term_counts(frame(spark, rows), 5).collect()}
    counts = Counter((lang or "", s or "", t) for text, lang, s in rows for t in TERM.findall((text or "").translate(LOWER)))
    assert whole and all(counts[k[:3]] == k[3] for k in whole)
