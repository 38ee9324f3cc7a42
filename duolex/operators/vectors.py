"""Token vectors: an embedder seam and a hash embedder over a table of vectors."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import staged

#: Pairs of a bucket, whose vectors a task holds.
BUCKET = 20_000


class Embedder(Protocol):
    """Gives (pair_id, side, idx, vec array<double>) for token rows (pair_id, side, idx, text). A model-backed one runs in
    mapInPandas and loads its model once per Python worker; it fails if a pair exceeds the model's length."""

    def embed(self, tokens: DataFrame) -> DataFrame: ...


class HashEmbedder:
    """Context-free vectors: a token's lower-cased text picks a row of the `embeddings` table by md5."""

    def __init__(self, embeddings: DataFrame):
        self.embeddings = embeddings

    def embed(self, tokens: DataFrame) -> DataFrame:
        keyed = tokens.select("pair_id", "side", "idx", "text").crossJoin(F.broadcast(self._size())).withColumn("vec_id", self._picked(F.col("text")))
        vectors = self.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
        return keyed.join(vectors, "vec_id").select("pair_id", "side", "idx", "vec")

    def _size(self) -> DataFrame:
        return self.embeddings.agg(F.count("*").alias("n_vec"))  # one row

    @staticmethod
    def _picked(text: Column) -> Column:
        return F.conv(F.substring(F.md5(F.lower(text).cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n_vec")

    def dealt(self, pairs: DataFrame) -> DataFrame:
        """Pairs (any columns; tokens only as the numbers of their vectors, `a` and `b`) by buckets, a partition each. First in a partition, each once, are the vectors (vec_id, vec) that its pairs
        have: words recur, so far fewer vectors are moved than there are tokens. A bucket has BUCKET pairs or fewer on the mean."""
        ids = lambda side: F.transform(f"{side}_tokens", lambda x: self._picked(x["text"]))
        held = [c for c in pairs.columns if c not in ("source_tokens", "target_tokens")]
        numbered = pairs.crossJoin(F.broadcast(self._size())).select(*held, ids("source").alias("a"), ids("target").alias("b"))
        numbered = staged(numbered, "numbered")
        buckets = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-numbered.count() // BUCKET))
        numbered = numbered.withColumn("bucket", F.pmod(F.xxhash64("pair_id"), F.lit(buckets)).cast("int"))
        wanted = numbered.select("bucket", F.explode(F.array_distinct(F.concat(F.coalesce("a", F.array()), F.coalesce("b", F.array())))).alias("vec_id")).distinct()
        vectors = wanted.join(self.embeddings.select("vec_id", F.col("embedding").alias("vec")), "vec_id")
        rows = numbered.unionByName(vectors, allowMissingColumns=True)
        return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions(F.col("vec_id").isNull()).drop("bucket")
