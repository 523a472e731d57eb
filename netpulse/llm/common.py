"""Shared pieces of the corpus operators: input columns, text sizes, blocks and folds."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netpulse.session import checkpoint_dir, materialize

#: bytes of text that one task of a block-wise operator holds (plus its working arrays)
BLOCK_BYTES = 24 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, null text as the empty text: extra columns never reach an operator."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def text_key(text_col: str = "text") -> Column:
    """64 bits that tell rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def rows_of(docs: DataFrame, chosen: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` rows with (``left_semi``) or without (``left_anti``) their id and text key in ``chosen``
    (doc_id, key); null ids match null ids, and no column of ``docs`` can clash."""
    right = chosen.select(F.col("doc_id").alias("_chosen_id"), F.col("key").alias("_chosen_key")).distinct()
    left = docs.select(*[F.col(f"`{c}`") for c in docs.columns])
    return left.join(right, left[id_col].cast("long").eqNullSafe(right["_chosen_id"])
                     & (text_key(text_col) == right["_chosen_key"]), how)


def fold(id_col: str | Column, k: int) -> Column:
    """crc32 of the id written as text, mod k; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % k


def text_bytes(texts: DataFrame) -> int:
    return int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def block_count(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks of at most about ``block_bytes`` of text hold all of ``texts``; with little
    text smaller blocks, so that every core has one."""
    size = text_bytes(texts)
    return max(1, math.ceil(size / block_bytes), min(texts.sparkSession.sparkContext.defaultParallelism, size // (2 << 20)))


def in_blocks(texts: DataFrame, blocks: int) -> DataFrame:
    """Add ``block`` and shuffle by it. Blocks are dealt by id and text, so a source, a group of
    copies or one repeated id is spread over all of them; only identical rows share a block, and
    each task drops those before it works on them."""
    return texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(
        blocks, "block"
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, k: int, held_out: int, max_rows: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, h, text) of at most ``max_rows`` labelled documents outside the held-out fold
    (crc32 of the id mod ``k``), half of each label where there are enough: those whose ids have the
    smallest hashes. Ids labelled twice count with the larger label; null labels and ids don't count."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.where(fold("doc_id", k) != held_out).withColumn("h", F.xxhash64("doc_id", F.lit(k)))
    # labels may name documents that the table lacks: join the ids before taking the smallest hashes
    known = known.join(docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    picked = [known.where(F.col("label") == y).orderBy("h", "doc_id").limit(max_rows // 2) for y in (0, 1)]
    picked = F.broadcast(materialize(picked[0].unionByName(picked[1])))  # at most max_rows ids
    return id_text(docs, id_col, text_col).join(picked, "doc_id").select("label", "h", "text")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a large intermediate as Parquet in the cluster's shared checkpoint folder and read it back:
    lineage is cut, and unlike a checkpoint the columns are encoded and can be pruned."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


__all__ = ["BLOCK_BYTES", "block_count", "fold", "id_text", "in_blocks", "labelled_sample", "materialize", "read", "rows_of", "text_bytes", "text_key", "written"]
