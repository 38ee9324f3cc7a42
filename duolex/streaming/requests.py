"""Requests whose pairs come one by one, in any order: gathered with keyed state and timers, served whole or refused after their time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.staging import staged
from ..operators.vectors import Embedder
from ..options import Settings
from ..plans.requests import align_requests, refused_requests, responses
from ..sources.pairs import PAIRS, REPAIR_SCHEMA, valid_repair

#: Pairs as they come: each knows its request, its place in it and how many there are. `repair` is JSON, as of a request.
ARRIVAL_SCHEMA = "request_id string, idx int, n_pairs int, id string, source string, target string, source_language string, target_language string, method string, repair string, sent_at timestamp"
_HEAD = ("n_pairs", "source_language", "target_language", "method", "repair")
GATHERED_SCHEMA = """request_id string, complete boolean, n_pairs int, source_language string, target_language string, method string, repair string, missing array<int>,
    sentence_pairs array<struct<idx: int, id: string, source: string, target: string>>"""


class Gather(StatefulProcessor):
    """One request: its pairs by place, its first pair's head, and a timer. Once told, whole or refused, a mark of it stays as long again, so that pairs that come late or come again
    don't make it a request anew."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "n_pairs int, source_language string, target_language string, method string, repair string")
        self.pairs = handle.getMapState("pairs", "idx int", "id string, source string, target string")
        self.told = handle.getValueState("told", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in batch.itertuples(index=False):
                if self.told.exists():
                    continue
                if not self.head.exists():
                    self.head.update(tuple(self._plain(getattr(r, c)) for c in _HEAD))
                    self.handle.registerTimer(int(r.sent_at.timestamp() * 1000) + self.wait_ms)
                n = self.head.get()[0]
                if n is not None and r.idx is not None and 0 <= r.idx < n and not self.pairs.containsKey((int(r.idx),)):
                    self.pairs.updateValue((int(r.idx),), tuple(self._plain(getattr(r, c)) for c in ("id", "source", "target")))
        if not self.told.exists() and self.head.exists() and sum(1 for _ in self.pairs.keys()) == self.head.get()[0]:
            yield self._tell(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.told.exists():
            if expiredTimerInfo.getExpiryTimeInMs() >= self.told.get()[0]:
                self.told.clear()
        elif self.head.exists():
            yield self._tell(key, timerValues)

    @staticmethod
    def _plain(x):
        return None if x is None or x != x else int(x) if isinstance(x, float) or hasattr(x, "dtype") else x

    def _tell(self, key, timers) -> pd.DataFrame:
        head = self.head.get()
        pairs = sorted((k[0], *v) for k, v in self.pairs.iterator())
        missing = sorted(set(range(head[0] or 0)) - {p[0] for p in pairs})
        self.head.clear()
        self.pairs.clear()
        until = max(timers.getCurrentWatermarkInMs(), *self.handle.listTimers(), 0) + self.wait_ms
        self.told.update((until,))
        self.handle.registerTimer(until)
        whole = bool(pairs) and not missing
        return pd.DataFrame({"request_id": [key[0]], "complete": [whole], **{c: [v] for c, v in zip(_HEAD, head, strict=True)}, "missing": [missing], "sentence_pairs": [[dict(zip(("idx", "id", "source", "target"), p, strict=True)) for p in pairs]]})

    def close(self) -> None:
        pass


def gather_requests(arrivals: DataFrame, wait: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """A stream of requests (GATHERED_SCHEMA) from a stream of pairs (ARRIVAL_SCHEMA): each once, as soon as all its pairs are there, or, incomplete and with the places it lacks, when its
    time is over: `wait` after its first pair by the pairs' own clock. A pair that comes again, or has no place in its request, changes nothing; the first pair says what the request asks for. `late`
    is how far pairs may be behind the newest; those behind more are passed over. State is a request's pairs, 100 at most for a valid one; it needs the RocksDB state store."""
    spark = arrivals.sparkSession
    seconds = spark.range(1).select(F.expr(f"cast(timestamp_seconds(0) + interval {wait} as double)")).first()[0]
    watched = arrivals.where(F.col("request_id").isNotNull() & F.col("sent_at").isNotNull() & F.col("n_pairs").between(*PAIRS)).withWatermark("sent_at", late)
    return watched.groupBy("request_id").transformWithStateInPandas(Gather(int(seconds * 1000)), GATHERED_SCHEMA, "Append", "EventTime")


def serve_stream(arrivals: DataFrame, embedder: Embedder, out: str, rejected: str, checkpoint: str, settings: Settings | None = None, wait: str = "60 seconds", late: str = "10 seconds", trigger: dict | None = None) -> StreamingQuery:
    """Serves requests as they become whole: responses as JSON in a folder for each micro-batch, requests that are refused (incomplete, or of broken rules) in another. A batch that is run again
    replaces its folders, so each request is answered once, over restarts too. `trigger`: as of a stream's writer; by default it runs on."""

    def write(batch: DataFrame, number: int) -> None:
        told = staged(batch.withColumn("repair", F.from_json("repair", REPAIR_SCHEMA)), "gathered")
        pairs = told.where("complete").select("request_id", "source_language", "target_language", F.coalesce("method", F.lit("itermax")).alias("method"), "repair", F.explode("sentence_pairs").alias("p"))
        pairs = pairs.select(F.concat_ws(":", "request_id", "p.idx").alias("pair_id"), "request_id", "p.idx", "source_language", "target_language", "p.source", "p.target", "method", "p.id", "repair", F.when(~valid_repair(F.col("repair")), F.array(F.lit("repair"))).otherwise(F.array().cast("array<string>")).alias("request_errors"))
        late_ = told.where("not complete").select("request_id", F.array(F.concat(F.lit("missing: "), F.concat_ws(",", F.transform("missing", lambda i: i.cast("string"))))).alias("errors"))
        refused = staged(refused_requests(pairs, settings).unionByName(late_), "refused")
        refused.write.mode("overwrite").json(f"{rejected}/batch={number}")
        responses(align_requests(pairs, embedder, settings, refused=refused), settings).write.mode("overwrite").json(f"{out}/batch={number}")

    return gather_requests(arrivals, wait, late).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()
