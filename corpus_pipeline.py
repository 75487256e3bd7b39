"""A corpus pipeline of five of the numbered operators.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``docs``.

Ids may be null or repeat, and columns may have any names beside those of ``documents``; rows
equal in all columns count as one from the third stage on.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm import bpe, jaccard_join, language_id, mixing, quality
from loregraph.llm.common import discard, materialise, quoted, unused_name

#: A text is rejected, as of no known language, if its best language's score goes less than this
#: part of the way from chance, one in the number of languages, to certainty.
LEAST_ABOVE_CHANCE = 1 / 15


def least_language_score(languages: int) -> float:
    """The least score of a kept text: 0.3 of four languages; a single one is always certain."""
    chance = 1 / max(1, languages)
    return chance + (1 - chance) * LEAST_ABOVE_CHANCE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of no language that the labels know."""
    model = language_id.fit(docs)
    lang, score = (unused_name(n, *docs.columns) for n in ("language", "score"))
    found = language_id.identify(docs, model, names=(lang, score))
    least = least_language_score(len(model.languages) if model else 0)
    return found.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= least)).select(*quoted(docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score under 0.7; keeps all where there are no labels to learn from."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs
    score, good = (unused_name(n, *docs.columns) for n in ("score", "good"))
    return quality.score(docs, model, names=(score, good)).where(F.col(good) == 1).select(*quoted(docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays, of several with this id one.

    Rows with a null id come last.  Rows are equal if two 64-bit hashes are; one names them in
    the join, so that different rows which share it alone stay or go together.
    """
    values = [*quoted(docs.columns), *[c.isNull() for c in quoted(docs.columns)]]
    rows = docs.select(F.xxhash64(*values).alias("row"), F.xxhash64(F.lit("second"), *values).alias("second"), F.col("doc_id").alias("id"), "text", F.struct(*quoted(docs.columns)).alias("d"))
    groups = jaccard_join.jaccard_components(rows, id_col="row").distinct()
    named = groups.join(rows.select("row", "id").distinct(), F.col("doc_id") == F.col("row"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "row"))
    kept = named.groupBy("component_id").agg(first.alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").dropDuplicates(["row", "second"]).select("d.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts sources to their targets; the document at a source's cut keeps the words that fit."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of each row, as digests."""
    import public_tokenizers

    return bpe.encode_digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_copies", one_of_each_group),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: SQL can express neither the classifiers nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)  # the next stage's rows are written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
