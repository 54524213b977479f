import random

import brute
import numpy as np
from test_dedup import NASTY, frame

import corpus_pipeline
from allelia.llm import shingles, simhash


def shingle_set(text):
    words = brute.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def firsts(texts):
    """The least id of each group linked at similarity 0.8 or more, by all pairs."""
    sets, root = {d: shingle_set(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in texts if root[d] == d}


def changed(words, rnd, part):
    return [f"new{rnd.randrange(10**6)}" if rnd.random() < part else w for w in words]


def test_stage_drops_every_copy_at_four_fifths(spark):
    rnd, texts = random.Random(7), {}
    for _ in range(12):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(150, 600))]
        for _ in range(8):
            texts[len(texts)] = " ".join(changed(base, rnd, rnd.choice([0.005, 0.01, 0.02, 0.04])))
    docs = frame(spark, list(texts.items()))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == firsts(texts) and len(firsts(texts)) < 60


def test_stage_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == firsts(texts)


def test_shingles_nasty_and_empty(spark):
    hashes, sizes = shingles.sets_of([t or "" for _, t in NASTY], 5)
    assert sizes.tolist() == [len(shingle_set(t)) for _, t in NASTY] and len(hashes) == sizes.sum()
    assert np.array_equal(shingles.bands_of(hashes, sizes)[0], shingles.bands_of(hashes, sizes)[2])
    kept = simhash.keep_one(frame(spark, [*NASTY, (None, "one")]))
    assert {r.doc_id for r in kept.collect()} == {1, 4, 6, 7, 9, 10, 11} and "digest" in kept.columns
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_one_large_group_of_copies_of_copies(spark):
    """A tree of changes: neighbours are alike, most pairs are not, and some stand apart in the same buckets."""
    rnd, texts = random.Random(9), {0: [f"w{k}" for k in range(150)]}
    for k in range(1, 150):
        parent = texts[rnd.randrange(k)]
        words = list(parent)
        for _ in range(rnd.choice([1, 1, 2, 6])):
            words[rnd.randrange(150)] = f"new{rnd.randrange(10**6)}"
        texts[k] = words
    texts = {k: " ".join(w) for k, w in texts.items()}
    want = firsts(texts)
    assert 5 < len(want) < 100 and {r.doc_id for r in simhash.keep_one(frame(spark, list(texts.items()))).collect()} == want


def test_sketches_never_exceed_the_difference():
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(0, 400))) for _ in range(40)]
    hashes, sizes = shingles.sets_of(texts, 5)
    sets = [set(x.tolist()) for x in np.split(hashes, np.cumsum(sizes)[:-1])]
    sketch = shingles.sketches_of(hashes, sizes)
    for i in range(40):
        for j in range(i):
            assert np.bitwise_count(sketch[i] ^ sketch[j]).sum() <= len(sets[i] ^ sets[j])
