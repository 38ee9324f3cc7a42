"""Requests in, responses out: each request has languages, a method and repair options of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import staged
from ..operators.vectors import Embedder
from ..options import CONFIDENCE_METHOD, METHODS, Settings
from ..sources.pairs import broken, read_requests, validate, write_results
from .align import align

#: What a response tells of each pair.
PARTS = ("source", "target", "source_tokens", "target_tokens", "links", "alignment_groups", "unaligned_source_indices", "unaligned_target_indices")


def with_method(requests: DataFrame) -> DataFrame:
    """A request that names no method asks for itermax."""
    return requests.withColumn("method", F.coalesce("method", F.lit("itermax")))


def refused_requests(requests: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(request_id, errors): requests that break a rule, or ask for what the settings don't run. One bad pair refuses its request, whole, and no other."""
    settings = settings or Settings()
    requests, method, repair = with_method(requests), F.col("method"), F.col("repair")
    runs = {
        "method is not enabled": ~method.isin(*METHODS) | method.isin(*settings.methods),
        "repair needs mwmf": ~F.coalesce(repair["enabled"], repair.isNotNull()) | F.lit("mwmf" in settings.methods),
    }
    told = validate(requests).select("request_id", F.concat("errors", broken(runs)).alias("errors")).where(F.size("errors") > 0)
    return told.groupBy("request_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("errors")))).alias("errors"))


def align_requests(requests: DataFrame, embedder: Embedder, settings: Settings | None = None, segmenter=None, refused: DataFrame | None = None) -> DataFrame:
    """Aligns the pairs of requests (as `read_requests` gives them), one row per pair with the columns of the request. Methods and repair options go along as columns: one plan, however
    many different ones are asked for. Requests that are refused are left out (`refused`: those of `refused_requests`, if they are known already)."""
    settings = settings or Settings()
    if refused is None:
        requests = staged(requests, "requests")
        refused = refused_requests(requests, settings)
    # Written, so that the check in `align`, which fails the job, sees no row of theirs.
    good = staged(requests.join(refused.select("request_id"), "request_id", "left_anti"), "good")
    return align(with_method(good), embedder, None, None, settings, segmenter)


def responses(aligned: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per request: its envelope and its pairs in the order they were asked. A request has 100 pairs at most."""
    settings = settings or Settings()
    own = ["request_id", "source_language", "target_language", "method"]
    told = F.struct("idx", F.struct("id", *PARTS).alias("pair"))
    packed = aligned.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["pair"]).alias("sentence_alignments"))
    envelope = {"model": F.lit(settings.model), "embedding_layer": F.lit(settings.layer), "confidence_method": F.lit(CONFIDENCE_METHOD)}
    return packed.withColumns(envelope).select("request_id", "source_language", "target_language", "model", "embedding_layer", "method", "confidence_method", "sentence_alignments")


def serve(spark: SparkSession, source: str, out: str, rejected: str, embedder: Embedder, settings: Settings | None = None, segmenter=None) -> None:
    """Reads requests, writes the responses of those that are valid as JSON lines, and the others with the rules they break. A request is served whole or
    not at all."""
    read = staged(read_requests(spark, source), "read")
    refused = staged(refused_requests(read, settings), "refused")
    write_results(refused, rejected, "json")
    write_results(responses(align_requests(read, embedder, settings, segmenter, refused), settings), out, "json")
