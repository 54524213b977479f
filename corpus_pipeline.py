"""A corpus pipeline of five stages, each on all that the stage before it kept.

Language ID drops texts in no known language, exact dedup and near-dedup (five-word shingles, similarity 0.8) leave
one document of each group, the secret scan blanks secrets out, and packing gives each remaining piece its place in a
training sequence.

Every stage decides each row by itself: rows may repeat an id with other texts, have no id, or repeat in full. Extra
columns are carried by all stages but the last. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from allelia.llm import cuckoo, langid, packing, secrets, simhash
from allelia.llm.common import stored, table
from allelia.llm.queries import vocabulary
from allelia.plans.tables import discard, made


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too) and texts in no language that the table's own labels
    teach. Rows with a null or repeated id are judged by their own text; without any label all rows go."""
    return langid.keep_known(docs, langid.fit_filters(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text: the largest id, a null one only where there is no other, and one of equal rows."""
    return cuckoo.keep_last(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the least id, a null one only where there is no other, and one of
    equal rows. Texts without words, null ones too, are alike."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops no row; masks secrets in each row's text and counts ``n_chars`` anew. Null texts stay null."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row; null and empty texts are one piece. Repeated and null ids are carried."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express tokenizing or packing; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    What a stage stored for itself is deleted once its result is written, and that result once the next one is. Stages
    delete nothing: called by themselves, in any order, their results can be read at any time."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before = set(made(spark))
        docs, path = stored(stage(spark, docs, sf_dir), name)
        for own in made(spark):
            if own not in before and own != path:
                discard(spark, own)
        if last:
            discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
