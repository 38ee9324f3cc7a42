"""Alignment of a stream of pairs: every pair stands alone, so each micro-batch is one run of the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.staging import staged
from ..operators.tokens import token_rows, tokenize
from ..operators.vectors import Embedder
from ..options import Repair, Settings
from ..plans.align import align
from ..sources.pairs import PAIR_SCHEMA, accept


def read_pairs(spark: SparkSession, path: str, format: str = "json", files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(PAIR_SCHEMA).option("maxFilesPerTrigger", files_per_batch).format(format).load(path)


def tokenize_stream(pairs: DataFrame) -> DataFrame:
    """Tokens of a stream: stateless, Catalyst only."""
    return token_rows(tokenize(pairs))


def align_stream(pairs: DataFrame, embedder: Embedder, out: str, checkpoint: str, method: str = "itermax", repair: Repair | None = None, settings: Settings | None = None, trigger: dict | None = None, rejected: str | None = None) -> StreamingQuery:
    """Aligns each micro-batch and writes it to a folder of its own number, replacing it after a retry: exactly once. Pairs with languages that break a rule go, with their
    `errors`, to folders of `rejected` (by default beside `out`), and the stream goes on. `trigger`: as of a stream's writer; by default what is there is aligned and the stream ends."""
    rejected = rejected or f"{out.rstrip('/')}-rejected"

    def write(batch: DataFrame, number: int) -> None:
        if {"source_language", "target_language"} <= set(batch.columns):
            batch, bad = accept(staged(batch, "batch"), "column")
            bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
            batch = staged(batch, "good")
        align(batch, embedder, method, repair, settings).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
