import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelia.llm import secrets


@pytest.mark.parametrize("before,after", [("AWS_SECRET_ACCESS_KEY=", ""), ("ACCESS_KEY=", "\nB=1"), ("https://x.org/a?sig=", "&b=2"), ('auth="', '"'), ("auth='", "'"), ("key = ", ""), ("A=b=", ""), ("auth=", "=="), ("see ", "= there")])
def test_secrets_after_a_sign(spark, before, after):
    key = "Xq7RmZ2tLw9KcV4nBy8HsJ5dPf3GaT6uEe1QoWiC"
    found = secrets.report(secrets.scan(spark.createDataFrame([(1, before + key + after)], "doc_id long, text string"))).first().spans
    pad = len(after) - len(after.lstrip("="))
    assert found == f"random:{len(before)}:{len(before) + len(key) + pad}"
    masked = secrets.redact(spark.createDataFrame([(1, before + key + after)], "doc_id long, text string")).first().text
    assert masked == before + secrets.MASK + after[pad:]


def test_secrets_signs_between_strings(spark):
    a, b = "Xq7RmZ2tLw9KcV4nBy8HsJ5dPf3GaT6uEe1QoWiC", "b8Yt3QzLm5WcKx9RvN2pHd7SfJ4gAeU6iTo1DqVy"
    assert secrets.report(secrets.scan(spark.createDataFrame([(1, f"{a}={b}")], "doc_id long, text string"))).first().spans == "random:0:40,random:41:81"


def drawn(n, seed, length=44):
    rnd, b64 = random.Random(seed), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return ["".join(rnd.choice(b64) for _ in range(length)) for _ in range(n)]


@pytest.mark.parametrize("low,high", [(0.25, 0.5), (0.6, 1.01)])
def test_secrets_copies_of_a_string_do_not_move_the_cut(spark, low, high):
    texts = [f"see {k} there" for k in drawn(600, 11)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = {r.doc_id: r.p for r in docs.select("doc_id", secrets.candidates(F.col("text"))[0]["p"].alias("p")).collect()}
    again = next(i for i, x in sorted(p.items()) if low <= x < high)
    copies = spark.range(5000).select((F.col("id") + 1000).alias("doc_id"), F.lit(texts[again]).alias("text"))
    spans = lambda d: {r.doc_id: r.spans for r in secrets.report(secrets.scan(d)).collect() if r.doc_id < 1000}
    alone = spans(docs)
    assert np.mean([bool(x) for x in alone.values()]) > 0.9 and spans(docs.union(copies)) == alone


def test_secrets_under_base_spans_do_not_count(spark):
    keys, covered = drawn(600, 12), ["ab1" * 9 + "x" * (i % 7) + str(i) for i in range(3000)]
    texts = [f"see {k} there" for k in keys] + [f"token={c}" for c in covered]
    scored = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("text", secrets.judged(F.col("text")).alias("spans"))
    assert secrets.cuts(scored) == secrets.cuts(scored.where("text not like 'token=%'"))


@pytest.mark.parametrize("n", [1, 3, 30, 190, 210])
def test_secrets_cut_by_one_rule_at_every_count(spark, n):
    scored = spark.createDataFrame([(f"see {k} there",) for k in drawn(n, 13)], "text string").select("text", secrets.judged(F.col("text")).alias("spans"))
    assert max(secrets.cuts(scored).values()) <= 0.1


def at(*steps):
    """Counts on the grid with a string at each of the steps."""
    counts = [0] * secrets.GRID
    for x in steps:
        counts[x] += 1
    return counts


def test_few_ordinary_strings_are_not_reported():
    """Strings at small p-values and none elsewhere are no random ones, however few; nor are they hidden by some random ones."""
    for n in (6, 10, 40, 1000):
        assert secrets._cut(at(*[1] * n)) > 1 / secrets.GRID, n
    assert secrets._cut(at(*[1] * 9, 7, 20, 33, 41)) > 1 / secrets.GRID
    assert secrets._cut(at(*[1] * 100, *range(secrets.GRID))) > 1 / secrets.GRID
    for steps in ([14], [3, 30], [5, 20, 44], range(0, 50, 5), [i % 50 for i in range(1000)]):
        assert secrets._cut(at(*steps)) == secrets.PLAIN_CUT, steps


def test_few_ordinary_strings_of_a_table(spark):
    """Ten strings that the battery finds odd but not impossible, and nothing else: none is a secret."""
    pool = [x for x in drawn(4000, 17, 24) if 0.02 <= battery(x) < 0.04][:10]
    assert len(pool) == 10
    docs = spark.createDataFrame([(i, f"see {x} there") for i, x in enumerate(pool)], "doc_id long, text string")
    assert [r.spans for r in secrets.report(secrets.scan(docs)).collect()] == [""] * 10


def battery(token):
    """The three tests by plain loops, with the exact normal tail."""
    import math
    import re

    alphabet = next(a for p, a in secrets.ENCODINGS if re.match(p, token))
    x, k, n = [alphabet.index(c) for c in token], len(alphabet), len(token)
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = sum(x.count(v) ** 2 for v in range(k)) * k / n - n
    p_chi = tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    above = [y * 2 >= k for y in x]
    ups = sum(above)
    runs = 1 + sum(a != b for a, b in zip(above, above[1:]))
    expected = 2 * ups * (n - ups) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    p_runs = 2 * tail(abs(runs - expected) / math.sqrt(spread)) if spread > 0 else 0.0
    mean = sum(x) / n
    var = sum((y - mean) ** 2 for y in x)
    lag = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:]))
    p_serial = 2 * tail(abs(lag / var + 1 / n) * math.sqrt(n)) if var > 0 else 0.0
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


def cut(counts):
    """The cut of one class of lengths by its definition, from the counts of a grid."""
    upper = sum(counts[secrets.GRID // 2 :])
    random_ = (upper + 1 + (upper + 1) ** 0.5 / 2) / (secrets.GRID // 2)
    for at in range(secrets.GRID):
        above = sum(counts[at:])
        if above and (above - random_ * (secrets.GRID - at)) / above <= secrets.FALSE_PART:
            return max(at / secrets.GRID, secrets.PLAIN_CUT)
    return 2.0


def plain_spans(texts):
    """Spans of every text as the query gives them: base spans by the plain patterns, candidates by battery and cuts."""
    import re

    import brute

    found, strings = [], {}
    for t in texts:
        base = sorted((a, secrets.KINDS.index(k), b) for k, spans in brute.secrets(t).items() for a, b in spans)
        free = []
        for m in re.compile(secrets.CANDIDATE, re.ASCII).finditer(t or ""):
            if not any(a < m.end() and m.start() < b for a, _, b in base):
                token = m[0].rstrip("=")
                free.append((m.start(), m.end(), battery(token)))
                size = m.end() - m.start()
                strings[token] = min(strings.get(token, (size, 2.0)), (size, battery(token)))
        found.append((base, free))
    kind = lambda size: sum(size >= x for x in secrets.LENGTH_CLASSES)
    table = {k: [0] * secrets.GRID for k in range(len(secrets.LENGTH_CLASSES) + 1)}
    for size, p in strings.values():
        table[kind(size)][min(int(p * secrets.GRID), secrets.GRID - 1)] += 1
    cuts = {}
    for k, own in table.items():
        others = [sum(t[g] for j, t in table.items() if j != k) for g in range(secrets.GRID)]
        cuts[k] = cut([n + m * min(1, secrets.PRIOR / max(1, sum(others))) for n, m in zip(own, others)])
    out = []
    for base, free in found:
        spans = base + [(a, 3, b) for a, b, p in free if p >= cuts[kind(b - a)]]
        out.append(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)))
    return out


def test_secrets_battery_is_its_definition(spark):
    tokens = drawn(40, 5) + drawn(40, 6, 21) + ["deadbeef" * 4, "0123456789abcdef" * 2, "A1" * 15, "Q2W3E4R5T6Y7U2I3O4P5", "a-b_c1" * 5, "z9" * 40 + "/", "ABCDEF0123" * 3]
    got = spark.createDataFrame(list(enumerate(tokens)), "i long, t string").select("i", secrets.battery(F.col("t")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(battery(tokens[r.i]), abs=2e-6), tokens[r.i]


def test_secrets_spans_of_the_whole_table(spark):
    """Every span of every text, the cuts among them, by plain loops."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = spark.createDataFrame([(10**6 + k, f"é {x} there {x[:30]}=") for k, x in enumerate(drawn(40, 21))], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(more)
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(rows, plain_spans(rows.values())))
    got = {r.doc_id: r.spans for r in secrets.report(secrets.scan(docs)).collect()}
    assert got == want and sum("random" in x for x in want.values()) > 20


def test_secrets_of_texts_with_many_spans(spark):
    """Work follows the spans: ten times as many take about ten times as long."""
    import time

    took, line = {}, "é token=abcdef12 see 0123456789abcdef01234567 and Xq7RmZ2tLw9KcV4nBy8HsJ5dPf3GaT6uEe1QoWiC. "
    for n in (600, 6000, 60_000):
        docs = spark.createDataFrame([(1, line * (n // 3))], "doc_id long, text string")
        began = time.time()
        out = secrets.redact(docs).first().text
        took[n] = time.time() - began
        assert out == "é [SECRET] see [SECRET] and [SECRET]. " * (n // 3)
    assert took[60_000] < 20 * max(took[6000], 1.0)


def test_redaction_by_row(spark):
    """Rows that repeat an id, or have none, keep their own texts; clashing column names do not matter."""
    rows = [(1, "token=abcdef12 a", 5), (1, "no secret", 9), (None, "api_key: zzzzzz9", 1), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").withColumns({"row": F.lit("clash"), "spans": F.lit(1)})
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.n_chars, r.row) for r in got.collect()), key=str) == sorted([(1, "[SECRET] a", 10, "clash"), (1, "no secret", 9, "clash"), (None, "[SECRET]", 8, "clash"), (None, None, None, "clash")], key=str)
