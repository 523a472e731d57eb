"""A training corpus from ``documents``: five stages, each one of the corpus operators at work.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns what it
keeps, with the columns of ``documents``; the last returns packed pieces. ``run`` writes every stage's
result as Parquet into the shared checkpoint folder and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netpulse.llm import decontaminate, ngram_join, packing, pii, toxicity
from netpulse.llm.common import read, rows_of, text_key, written
from netpulse.llm.queries import TOKENIZER

REJECT_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier rejects go. A null text is scored as the empty text; rows
    of a null id are judged by their text; of rows that repeat an id each is judged by its own text."""
    scores = toxicity.toxicity_scores(docs, read(spark, sf_dir, "labels"), "toxic", folds=4, held_out=2)
    return rows_of(docs, scores.where(F.col("score") >= REJECT_SCORE), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; empty texts all stay.
    Of a group without ids, the row with the smallest text key stays; identical rows stay once."""
    # the joins behind the groups run once: each further use would plan all of them anew on the driver
    groups = written(ngram_join.jaccard_components(docs), "jaccard-groups")
    first = groups.where("n_shingles > 0 and component_id is null").groupBy("component").agg(F.min("key").alias("key"))
    kept = groups.where((F.col("n_shingles") == 0) | (F.col("doc_id") == F.col("component_id"))).select("doc_id", "key", "n_shingles")
    kept = kept.unionByName(first.select(F.lit(None).cast("long").alias("doc_id"), "key", F.lit(1).cast("long").alias("n_shingles")))
    kept = written(kept, "jaccard-kept")
    again = written(kept.where("n_shingles > 0").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "jaccard-again")
    stays = rows_of(docs, kept, "left_semi")
    # rows that agree in id and text, if any: one of them
    once = rows_of(stays, again, "left_semi").withColumn("_text_key", text_key()).dropDuplicates(["doc_id", "_text_key"])
    return rows_of(stays, again, "left_anti").unionByName(once.drop("_text_key"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row judged by its own text; null and empty texts stay, and
    without items all rows do."""
    return rows_of(docs, decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark")), "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text gives way to the kind in brackets. Null texts stay null,
    null and repeated ids stay as they are."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenized pieces with their sequence and place. A null text is the empty text: one piece that holds the end id
    alone; rows that repeat an id, or lack one, are packed row by row."""
    return packing.best_fit_packing(docs, TOKENIZER, capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack),
]

#: no stage's decisions can be written in SQL; tests/llm/test_pipeline.py has brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
