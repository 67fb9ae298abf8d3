"""Streams of texts to vectors, and expiring state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkvec.functions import vector
from sparkvec.plans.providers import Provider, embed


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def shortened(rows: DataFrame, dim: int | None) -> DataFrame:
    """``rows`` with embeddings of their first ``dim`` numbers, brought to unit length again; those that are no longer stay."""
    if dim is None:
        return rows
    cut = F.slice("embedding", 1, dim)
    return rows.withColumn("embedding", F.when(F.size("embedding") > dim, vector.l2_normalize(cut)).otherwise(F.col("embedding")))


def embed_stream(texts: DataFrame, provider: Provider, callback: Callable[[DataFrame, int], None], checkpoint: str, dim: int | None = None, **trigger) -> StreamingQuery:
    """Embed a streaming (id, text) table and hand each micro-batch to ``callback`` with its number; a batch that is run again has
    the same number, so a sink that is keyed by it writes once. ``dim``: numbers of a vector to keep."""
    query = shortened(embed(texts, provider), dim).writeStream.option("checkpointLocation", checkpoint).foreachBatch(callback)
    return (query.trigger(**trigger) if trigger else query).start()


def embed_rows(df: DataFrame, provider: Provider, key: str = "id", dim: int | None = None) -> Iterator[Row]:
    """Rows with vectors in order of the key, a partition at a time on the driver."""
    return shortened(embed(df, provider), dim).orderBy(key).toLocalIterator(prefetchPartitions=True)


_OUT = "key string, hit boolean, at double"
_STATE = "expires double"


def expiring_hits(events: DataFrame, ttl: float) -> DataFrame:
    """Streaming (key, at): was the key seen within ``ttl`` seconds before? The state is one number a key, dropped when it times out."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        expires = state.get[0] if state.exists else float("-inf")
        rows = []
        for at in sorted(x for pdf in parts for x in pdf["at"].tolist()):
            hit = at <= expires
            if not hit:
                expires = at + ttl
            rows.append((key[0], hit, at))
        state.update((expires,))
        state.setTimeoutDuration(max(1, int(ttl * 1000)))
        yield pd.DataFrame(rows, columns=["key", "hit", "at"])

    return events.select("key", F.col("at").cast("double").alias("at")).groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
