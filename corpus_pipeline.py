"""From documents to training tokens: five stages, each over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import bpe, langid, minhash, mixing, substring_index
from headway.llm.common import WORD, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if a language takes at least this part of its probability.
LEAST_SCORE = 0.5
#: Near-duplicates: word shingles alike to so many hundredths.
PERCENT = 80
SEED = 0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a determined language stay; a missing lang is filled in.

    Null, empty and letterless texts go, and so do texts whose best language has less than LEAST_SCORE. Repeated rows are
    judged alike; rows without doc_id stay. An empty table gives no rows; columns beside those of documents are left out.
    """
    rows = langid.identify(docs.select(*COLUMNS), seed=SEED)
    rows = rows.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return rows.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates, linked at a similarity of PERCENT, stays.

    Rows that repeat a doc_id and a text stay once; rows of one doc_id with different texts all stay, if it does. Texts
    without words are in no group and stay. Rows without doc_id go, as they can't be told apart. An empty table gives no
    rows; columns beside those of documents are left out.
    """
    kept = minhash.link(docs, percent=PERCENT).filter("kept").select("doc_id").distinct()
    rows = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").withColumn("same", F.xxhash64("text"))
    return rows.dropDuplicates(["doc_id", "same"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has are cut out; a document of which nothing is left goes.

    Texts without such passages stay as they were, null and empty ones too. Rows of one doc_id don't cut each other. An
    empty table gives no rows; columns beside those of documents are left out.
    """
    rows = substring_index.remove_repeats(docs, keep=("lang", "source", "text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    rows = rows.filter("n_removed = 0 OR n_removed < n_words").withColumn("text", text)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes; of the one in which a source's target is reached, its first words.

    Documents of which nothing is taken go, and so do those without words. A null source is a source of its own. Repeated
    rows count each, and as they can't be told apart, which of them is cut is left open. Rows without doc_id take part. An
    empty table gives no rows; columns beside those of documents are left out.
    """
    # what is taken is found on slim rows; the texts are shuffled once, to meet it
    known = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("row_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("row_source"), F.xxhash64("text").alias("row_text")]
    same = ("row_id", "row_source", "row_text")
    taken = mixing.mix(docs.select("doc_id", "source", "text", *known), seed=SEED, keep=same).filter("taken > 0")
    rows = docs.select(*COLUMNS, *known).dropDuplicates([*same]).join(taken.select(*same, "size", "taken"), [*same])
    rows = rows.withColumn("part", F.col("taken") % F.col("size")).withColumn("copies", F.ceil(F.col("taken") / F.col("size")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    first = F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("part").cast("int")))
    rows = rows.withColumn("text", F.when((F.col("copy") == F.col("copies")) & (F.col("part") > 0), first).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows' tokens in place of their texts: a row for each row, repeated ones too.

    Null and empty texts have no tokens; very long ones are encoded whole. An empty table gives no rows; columns beside
    those of documents are left out.
    """
    rows = bpe.encode(docs.select("doc_id", "text", "lang", "source"), *bpe.default_vocabulary())
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix_sources", mix_sources), ("byte_bpe", byte_bpe)]
#: The model of the first stage can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
