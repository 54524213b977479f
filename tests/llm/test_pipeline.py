import brute
from pyspark.sql import functions as F
from test_shingles import firsts
from test_text import check_packing

import corpus_pipeline
from allelia.llm import langid, secrets


def expected(docs, filters, hidden):
    """(ids that stay, texts that are packed) by plain loops; ``hidden``: text → its masked form."""
    lang, _, known = filters.predict([d["text"] or "" for d in docs])
    least = dict(zip(filters.languages, filters.least_known))
    docs = [d for d, k, x in zip(docs, known, lang) if x != "und" and k >= least[x]]
    last = {}
    for d in docs:
        last[d["text"]] = max(last.get(d["text"], -1), d["doc_id"])
    docs = [d for d in docs if last[d["text"]] == d["doc_id"]]
    stay = firsts({d["doc_id"]: d["text"] for d in docs})
    docs = [d for d in docs if d["doc_id"] in stay]
    return {d["doc_id"]: hidden(d["text"]) for d in docs}


def mask(text):
    """Base spans masked; the fixture has no other secrets."""
    out, at = "", 0
    for a, b in sorted(x for found in brute.secrets(text).values() for x in found):
        if a >= at:
            out += text[at:a] + secrets.MASK
        at = max(at, b)
    return out + text[at:]


def test_pipeline_against_plain_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = langid.fit_filters(docs)
    want = expected([r.asDict() for r in docs.collect()], filters, mask)
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert {r[0] for r in got} == set(want)
    check_packing(got, want)


def test_stages_return_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
    odd = docs.limit(5).unionByName(spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0)], docs.schema)).withColumn("digest", F.lit(1))
    for empty in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, empty, sf_dir)
            assert out.columns == odd.columns, name
            out.count()
        assert (corpus_pipeline.STAGES[-1][1](spark, empty, sf_dir).count() > 0) == (empty is odd)


def test_clean_documents_stay(spark):
    """Of unlike, clean texts in the corpus's languages the filters drop none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id")
    clean = docs.join(labels, "doc_id", "left_semi").dropDuplicates(["text"])
    kept = corpus_pipeline.language_id(spark, clean, "")
    assert kept.count() == clean.count()


def test_stages_decide_row_by_row(spark, sf_dir):
    """Ids that repeat with other texts, null ids and rows that repeat in full."""
    one, two = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' and n_chars > 800").dropDuplicates(["text"]).orderBy("doc_id").limit(2).collect()]
    rows = [(5, one), (9, one), (5, two), (None, one), (7, one + " and more"), (7, one + " and more"), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    after = lambda stage, df: sorted(((r.doc_id, r.text) for r in stage(spark, df, sf_dir).collect()), key=str)
    assert after(corpus_pipeline.language_id, docs) == sorted(rows[:-1], key=str)
    assert "Exchange" not in corpus_pipeline.language_id(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert after(corpus_pipeline.exact_dedup, docs) == sorted([(9, one), (5, two), (7, one + " and more"), (3, None)], key=str)
    assert after(corpus_pipeline.near_dedup, docs) == sorted([(5, one), (5, two), (3, None)], key=str)


def test_stages_in_any_order_and_read_late(spark):
    """No stage deletes what another has stored: results of several calls are read after all of them, and again."""
    rows = [(i, f"text number {i % 3} token=abcdef1{i % 3} and more words", "en", "s", 1) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    a = corpus_pipeline.exact_dedup(spark, docs, "")
    b = corpus_pipeline.secret_scan(spark, docs, "")
    c = corpus_pipeline.near_dedup(spark, b, "")
    d = corpus_pipeline.exact_dedup(spark, b, "")
    e = corpus_pipeline.best_fit_packing(spark, c, "")
    for _ in range(2):
        assert e.count() == c.count() and d.count() == 3 and b.count() == 9 and a.count() == 3
