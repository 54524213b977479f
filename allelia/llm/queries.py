"""The queries of the training-data operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, cuckoo, divergence, langid, negatives, packing, quality, secrets, shards, simhash, substring, toxicity
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    model = toxicity.fit_labelled(docs, table(spark, sf_dir, "labels").where(fold != 0))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.report(chat.format_conversations(turns.unionByName(planted)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    filters = langid.fit_filters(docs.where(fold != 1).select("doc_id", "text", "lang"))
    found = langid.identify(docs, filters)
    return found.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_duplicates(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jump consistent hashing of all documents to 16 shards, and to 17."""
    return shards.report(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How all sources of a language differ in the terms of at least 30 of its documents."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector among all others."""
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 counts of each text, for SQL; its limits follow from sketches, which SQL does not have."""
    return quality.counts(table(spark, sf_dir, "documents"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op5, for SQL; its tests of randomness are held against plain loops."""
    return secrets.base_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_best_fit_packing,
        op3_toxicity,
        op4_quality_rules,
        op5_secret_scan,
        op6_chat_formatting,
        op7_language_id,
        op8_substring_dedup,
        op9_bpe_round_trip,
        op10_exact_dedup,
        op11_sharding,
        op12_source_divergence,
        op13_hard_negatives,
        quality_counts,
        secret_base_spans,
    )
}


def _spans_sql() -> str:
    """Base spans in SQL: of each pattern the gaps between matches and the matches, added up, and matches of enough characters."""
    parts = []
    for at, (kind, pattern, group, least) in enumerate(secrets.BASE):
        p = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {at} AS kind, '{kind}' AS name, start, start + size AS "end" FROM (
            SELECT doc_id, g, size, sum(length(gap) + coalesce(size, 0)) OVER (PARTITION BY doc_id ORDER BY n) - size AS start, own FROM (
                SELECT doc_id, n, gaps[n] AS gap, length(alls[n]) AS size, length(owns[n]) AS own, n AS g FROM (
                    SELECT *, unnest(range(1, len(gaps) + 1)) AS n FROM (
                        SELECT doc_id, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS alls, regexp_extract_all(t, '{p}', {group}) AS owns FROM d)))) WHERE own >= {least}""")
    every = " UNION ALL ".join(parts)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({every}),
        said AS (SELECT doc_id, string_agg(name || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY start, kind) AS spans FROM found GROUP BY doc_id)
        SELECT doc_id, coalesce(spans, '') AS spans FROM d LEFT JOIN said USING (doc_id)"""



#: Queries that SQL can express; the others are held against plain versions in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "quality_counts": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        grams AS (SELECT doc_id, p, w[p : p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
        again AS (SELECT doc_id, p FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        repeated AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM again, range(3) r(o) GROUP BY doc_id),
        lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        counted AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
    """,
    "secret_base_spans": _spans_sql(),
    "op6_chat_formatting": r"""
        WITH turns AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
        sized AS (
            SELECT *, 20 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\]', '', 'g')) + len(regexp_extract_all(role, '</?s>|\[/?INST\]')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) AS n
            FROM turns),
        joined AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(n) AS BIGINT) AS formatted_chars
            FROM sized GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM joined
    """,
    "op8_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        windows AS (SELECT doc_id, p, array_to_string(ws[p : p + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM w)),
        again AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY k) > 1),
        gone AS (SELECT DISTINCT doc_id, p + o AS i FROM again, range(35) r(o)),
        words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
        left_ AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN left_ USING (doc_id)
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_sharding": """
        WITH RECURSIVE jumps(n, doc_id, k, b, j) AS (
            SELECT n, doc_id, CASE WHEN coalesce(doc_id, 0) < 0 THEN 18446744073709551616::HUGEINT + doc_id ELSE coalesce(doc_id, 0)::HUGEINT END, -1::BIGINT, 0::BIGINT
            FROM (SELECT DISTINCT doc_id FROM documents), (VALUES (16), (17)) v(n)
            UNION ALL
            SELECT n, doc_id, next, j, CAST(floor((j + 1)::DOUBLE * (2147483648::DOUBLE / (next // 8589934592 + 1)::DOUBLE)) AS BIGINT)
            FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS next FROM jumps WHERE j < n)),
        shards AS (SELECT n, doc_id, max(b) AS shard FROM jumps WHERE j >= n GROUP BY n, doc_id),
        crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS per_byte FROM range(256) v(i)),
        d AS (
            SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, xor(4294967295, list_reduce(
                list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                lambda c, b: xor(c // 256, per_byte[xor(c, b) % 256 + 1]), 4294967295)) AS crc32 FROM documents, crc)
        SELECT d.doc_id, size, crc32 AS text_crc32, 'key' AS law, CAST(a.shard AS INTEGER) AS shard,
            row_number() OVER (PARTITION BY a.shard ORDER BY d.doc_id NULLS FIRST, size, crc32) - 1 AS slot, CAST(g.shard AS INTEGER) AS grown_shard
        FROM d JOIN shards a ON a.n = 16 AND a.doc_id IS NOT DISTINCT FROM d.doc_id JOIN shards g ON g.n = 17 AND g.doc_id IS NOT DISTINCT FROM d.doc_id
    """,
    "op12_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
        found AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d),
        terms AS (SELECT i, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM found),
        kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
        groups AS (SELECT DISTINCT lang, source FROM d),
        counted AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        p AS (SELECT *, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM grid),
        totals AS (SELECT lang, term, sum(n) AS n FROM grid GROUP BY lang, term),
        q AS (SELECT *, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM totals),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        above AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
        UNION ALL SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM above QUALIFY rank <= 50
    """,
    "op13_hard_negatives": """
        WITH e AS (
            SELECT row_number() OVER () AS num, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.num AS a, a.vec_id AS anchor_id, b.num AS b, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
            FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.num <> b.num),
        positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id, n.b) AS INTEGER) AS rank,
            n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        QUALIFY rank <= 3
    """,
}
