"""Token ids in ORC files: stripes with integer run-length encoding, row indexes and Bloom filters.

``write_token_ids`` range-partitions the documents by id, so files and their stripes hold
ascending, disjoint id ranges: the row indexes (minimum and maximum for every ``row_group`` rows)
and the Bloom filters on ``doc_id`` let a reader skip whole stripes and row groups, and every
stripe can be read by a task of its own. ORC stores the ids as run-length encoded integers.
``read_token_ids`` reads the files back; ``document_offsets`` gives each document's place in the
whole id stream from per-file totals (one row a file).

Nulls: a null text is the empty text, of which only the end id is written; null ids sort first.
Rows that repeat an id stay separate rows, next to each other. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netpulse.llm.common import id_text
from netpulse.llm.tokens import Encoder
from netpulse.session import checkpoint_dir

FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _encode(tokenizer: str, end_id: int):
    def run(batches):
        enc = Encoder(tokenizer)
        done = 0
        for batch in batches:
            for a, b, tokens, ends in enc.encode(batch.column("text")):
                at = np.concatenate([[0], ends + np.arange(1, b - a + 1)])
                ids = np.full(at[-1], end_id, np.int32)  # every text's last place keeps the end id
                inside = np.ones(len(ids), bool)
                inside[at[1:] - 1] = False
                ids[inside] = tokens
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("part"), pa.array(done + at[:-1]), pa.array(np.diff(at)),
                     pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"])
                done += int(at[-1])

    return run


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id",
                    text_col: str = "text", stripe_bytes: int = 8 << 20, row_group: int = 1000) -> None:
    """Write every whole document's ids, ascending by id, as ORC under ``path``."""
    texts = id_text(docs, id_col, text_col)
    ordered = (texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.crc32(F.col("text").cast("binary")))
               .withColumn("part", F.spark_partition_id()))
    (ordered.mapInArrow(_encode(tokenizer, end_id), FILE_SCHEMA)
     .write.option("compression", "zstd")
     .option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", row_group)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01)
     .orc(path))


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The stored documents; filters on ``doc_id`` prune stripes and row groups."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def document_offsets(stored: DataFrame) -> DataFrame:
    """``part`` and the number of ids in all earlier parts (one row per written file)."""
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))


def _crc(batches):
    for batch in batches:
        ids = batch.column("ids")
        at = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        n = (at[1:] - at[:-1]).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("part_start"), pa.array(n), pa.array(crc, pa.int64())],
            ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def stored_digest(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: per document its place in the id stream, length and crc32."""
    stored = read_token_ids(spark, path)
    rows = stored.mapInArrow(_crc, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    # one row per file; the join is left to the planner, which measures that side
    return rows.join(document_offsets(stored), "part").select(
        "doc_id", (F.col("_before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
