import hashlib
import random

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from allelia.llm import cuckoo, simhash
from allelia.operators.graph import connected
from allelia.llm.xxh import xxh64

NASTY = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d"), (8, "a  b\x0bc\x0cd"), (9, "É é"), (10, "x" * 5000 + " y z"), (11, "word " * 3000), (11, "word " * 3000), (12, "a b c d")]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"fp": F.lit("clash"), "digest": F.lit(1), "rep": F.lit(2), "component_id": F.lit(3)}) if extra else df


def test_xxh64_is_the_library_s():
    rnd = random.Random(1)
    rows = [bytes(rnd.randrange(256) for _ in range(n)) for n in [*range(80), 255, 256, 257, 4000]]
    buf = np.frombuffer(b"".join(rows) + bytes(40), np.uint8)
    size = np.array([len(r) for r in rows])
    got = xxh64(buf, np.cumsum(size) - size, size)
    assert got.tolist() == [xxhash.xxh64_intdigest(r, 42) for r in rows]


def test_fingerprints_nasty():
    assert simhash.fingerprints_of([t or "" for _, t in NASTY]).tolist() == [brute.fingerprint(t) for _, t in NASTY]


def test_simhash_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {d: brute.fingerprint(t) for d, t in texts.items()}
    want = brute.components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in texts}


@pytest.mark.parametrize("max_bits,pairwise", [(1, 64), (2, 2), (2, 64), (3, 4), (5, 16)])
def test_links_keep_every_component(spark, max_bits, pairwise):
    rnd = random.Random(3)
    seeds = [rnd.getrandbits(64) for _ in range(6)]
    fps = {s for s in seeds} | {seeds[0] ^ k for k in range(40)}  # the last differ in few bits, all of them near
    for s in seeds:
        for _ in range(40):
            for _ in range(rnd.randrange(1, max_bits + 2)):
                s ^= 1 << rnd.randrange(64)
            fps.add(s)
    rows = {i: f for i, f in enumerate(sorted(fps))}
    df = spark.createDataFrame([(f - (1 << 64) * (f >> 63), i) for i, f in rows.items()], "fp long, rep long")
    got = {r.node: r.root for r in connected(simhash.links(df, max_bits, pairwise)).collect()}
    assert {n: got.get(n, n) for n in rows} == brute.components(rows, max_bits)


@pytest.mark.parametrize("max_bits,how", [(2, {"block": 8}), (5, {"block": 16}), (2, {"block": 8, "large": 40}), (1, {"large": 60})])
def test_links_of_large_buckets(spark, max_bits, how):
    """Blocks and further rings keep every component, and rows stay within their bound."""
    rnd = random.Random(9)
    seed = rnd.getrandbits(64)
    fps = {seed ^ k for k in range(128)} | {seed ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(40)}
    rows = {i: f for i, f in enumerate(sorted(fps))}
    df = spark.createDataFrame([(f - (1 << 64) * (f >> 63), i) for i, f in rows.items()], "fp long, rep long")
    found = simhash.links(df, max_bits, pairwise=4, **how).collect()
    got = {r.node: r.root for r in connected(spark.createDataFrame(found)).collect()}
    assert {n: got.get(n, n) for n in rows} == brute.components(rows, max_bits)
    block = how.get("block", simhash.BLOCK)
    if "large" not in how:  # a bucket's links: fewer than the members of each pair of its blocks
        assert len(found) < (2 * max_bits + 1) * len(rows) * -(-len(rows) // block) + 2 * len(rows)


def test_rows_of_blocks_are_bounded(spark):
    members = spark.range(1000).select(*(F.lit(0).alias(c) for c in ("ring", "at", "free", "fixed")), F.col("id").alias("fp"), F.col("id").alias("rep"), F.lit(1000).alias("n"))
    blocks = simhash.block_pairs(members, 128)
    assert blocks.count() == 1000 * 8 and blocks.select("i", "j").distinct().count() == 36
    assert blocks.groupBy("i", "j").count().agg(F.max("count")).first()[0] < 4 * 128


def test_joining_links_are_a_forest():
    rnd = np.random.default_rng(2)
    fp = rnd.choice(1 << 12, 600, replace=False).astype(np.int64)
    for cut in (0, 250):
        u, v = simhash.joining(fp, -1, 0, 2, cut)
        assert len(u) < len(fp) and all(int(fp[a] ^ fp[b]).bit_count() <= 2 for a, b in zip(u, v))
        assert not cut or ((u < cut) & (v >= cut)).all()


def test_simhash_nasty_and_empty(spark):
    got = simhash.near_duplicates(frame(spark, NASTY)).collect()
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((d, f"{brute.fingerprint(t):016x}") for d, t in NASTY)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.near_duplicates(frame(spark, [(None, "a b c")])).first().component_id is None
    kept = simhash.keep_one(frame(spark, NASTY))
    assert {1, 4, 6, 7, 9, 10, 11} >= {r.doc_id for r in kept.collect()} and "digest" in kept.columns


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in connected(edges).collect()} == {0}
    assert connected(edges.limit(0)).count() == 0


def test_exact_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = {}
    for r in docs.collect():
        groups.setdefault(r.text or "", []).append(r.doc_id)
    want = {d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in cuckoo.exact_duplicates(docs, bucket_rows=20).collect()}
    assert got == want


def test_exact_nasty_and_empty(spark):
    got = {r.doc_id: r for r in cuckoo.exact_duplicates(frame(spark, NASTY)).collect()}
    assert got[1].keep_id == 2 and got[1].group_size == 2 and not got[1].kept and got[2].kept
    assert got[7].keep_id == 12 and got[11].group_size == 2 and got[11].kept and got[3].group_size == 1
    assert cuckoo.exact_duplicates(frame(spark, [])).count() == 0
    both = {r.doc_id: r.kept for r in cuckoo.exact_duplicates(frame(spark, [(None, "a"), (3, "a"), (None, "b")])).collect() if r.text_sha256 == hashlib.sha256(b"a").hexdigest()}
    assert both == {None: False, 3: True}


def test_cuckoo_index_inserts_deletes_and_grows():
    rnd = random.Random(5)
    index, live = cuckoo.CuckooIndex(4), {}
    for step in range(6000):
        key = rnd.randrange(2500).to_bytes(8, "big")
        key = hashlib.sha256(key).digest()
        if rnd.random() < 0.3:
            assert index.delete(key) == (live.pop(key, None) is not None)
        else:
            index.put(key, (step, 1))
            live[key] = (step, 1)
    assert index.live == len(live) and index.buckets > 8
    for i in range(2500):
        key = hashlib.sha256(i.to_bytes(8, "big")).digest()
        assert index.get(key) == live.get(key)
    again = cuckoo.CuckooIndex.from_bytes(index.to_bytes())
    assert dict(again.items()) == live


def test_cuckoo_tag_hits_are_verified():
    index = cuckoo.CuckooIndex(8)
    a = bytes(8) + b"a" * 24
    index.put(a, (1, 1))
    assert index.get(bytes(8) + b"b" * 24) is None
    for i in range(40):  # same tag, same buckets: only growth by stored keys could help, and it cannot; keys with other low bits can
        index.put(i.to_bytes(6, "little") + bytes(2) + b"c" * 24, (i, 1))
    assert index.get(a) == (1, 1)


def test_cuckoo_keys_of_any_kind(monkeypatch):
    index = cuckoo.CuckooIndex(8)
    keys = [bytes(8) + bytes([i]) for i in range(30)] + [b"", b"a"]  # equal first bytes, and short keys
    for i, k in enumerate(keys):
        index.put(k, (i, 1))
    assert index.buckets <= 64 and [index.get(k)[0] for k in keys] == list(range(32))
    monkeypatch.setattr(cuckoo.xxhash, "xxh64_intdigest", lambda key: 7)  # no doubling can part these
    index = cuckoo.CuckooIndex(8)
    for i, k in enumerate(keys):
        index.put(k, (i, 1))
        index.put(k, (i, 2))
    assert index.live == 32 and index.buckets <= 64 and index.stash and dict(index.items()) == {k: (i, 2) for i, k in enumerate(keys)}
    again = cuckoo.CuckooIndex.from_bytes(index.to_bytes())
    assert [again.delete(k) for k in keys] == [True] * 32 and again.live == 0 and not again.delete(b"a")


def test_short_digests_are_dealt_out(spark):
    rows = spark.createDataFrame([(i, f"t{i // 2}") for i in range(400)], "doc_id long, text string")
    short = lambda t: F.substring(F.sha2(t, 256), 1, 16)
    assert rows.select(short(F.col("text")).alias("digest")).select(cuckoo._bucket(8)).distinct().count() == 8
    got = cuckoo.exact_duplicates(rows, bucket_rows=50, digest=short).collect()
    assert all(r.group_size == 2 and r.keep_id == r.doc_id | 1 for r in got)


def test_index_tables_follow_a_corpus(spark):
    docs = spark.createDataFrame([(i, f"text {i % 30}") for i in range(90)], "doc_id long, text string")
    live = cuckoo.live_rows(docs)
    index = cuckoo.build_index(live, 4)
    assert index.agg(F.sum("keys")).first()[0] == 30

    def held(index):
        return {k.hex(): p for r in index.collect() for k, p in cuckoo.CuckooIndex.from_bytes(bytes(r.blob)).items()}

    text = lambda k: hashlib.sha256(f"text {k}".encode()).hexdigest()
    assert held(index)[text(7)] == (67, 3, 1)
    more = spark.createDataFrame([(500, "new"), (501, "text 3")], "doc_id long, text string")
    gone = docs.where("doc_id < 5 or doc_id = 67 or doc_id % 30 = 9").union(spark.createDataFrame([(999, "text 8"), (1, "never")], docs.schema))
    after, live = cuckoo.update_index(index, live, more, gone, 4)
    left = held(after)
    assert after.agg(F.sum("keys")).first()[0] == 30 == len(left)  # 30, less the one that lost its last row, and "new"
    assert left[text(7)] == (37, 2, 1) and left[text(3)] == (501, 3, 1) and left[text(0)] == (60, 2, 1) and left[text(8)] == (68, 3, 1) and text(9) not in left
    again, _ = cuckoo.update_index(after, live, docs.limit(0), more, 4)
    assert held(again)[text(3)] == (63, 2, 1) and len(held(again)) == 29


ROWS = [(5, "A dup"), (9, "A dup"), (5, "B unique text"), (None, "A dup"), (7, "C same"), (7, "C same"), (None, "D"), (None, "D"), (8, None), (8, "")]


@pytest.mark.parametrize("digest", [cuckoo.sha256, lambda t: F.lpad((F.length(t) % 3).cast("string"), 64, "0"), lambda t: F.lit("0" * 64)])
def test_exact_rows_are_decided_one_by_one(spark, digest):
    """Repeated and null ids; and digests that several texts share, which their texts decide."""
    df = frame(spark, ROWS)
    got = sorted(((r.doc_id, r.text or "") for r in cuckoo.keep_last(df, digest=digest).collect()), key=str)
    assert got == sorted([(9, "A dup"), (5, "B unique text"), (7, "C same"), (None, "D"), (8, "")], key=str)
    found = cuckoo.exact_duplicates(df, digest=digest).collect()
    want = {"A dup": (9, 3), "B unique text": (5, 1), "C same": (7, 2), "D": (None, 2), "": (8, 2)}
    names = {hashlib.sha256(t.encode()).hexdigest(): t for t in want}
    assert len(found) == len(ROWS) and all((r.keep_id, r.group_size) == want[names[r.text_sha256]] and r.kept == (r.doc_id == r.keep_id) for r in found)
    assert cuckoo.keep_last(df.limit(0)).count() == 0 and cuckoo.keep_last(df).columns == df.columns


def test_near_rows_are_decided_one_by_one(spark):
    got = simhash.keep_one(frame(spark, ROWS))
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == sorted([(5, "A dup"), (5, "B unique text"), (7, "C same"), (None, "D"), (8, "")], key=str)
