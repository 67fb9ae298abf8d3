"""Caches of computed vectors: an LRU fold over an ordered event log, expiry, and the split before computing."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Lru:
    """put replaces and promotes, get promotes; beyond ``capacity`` the least recent goes. Capacity 0 keeps nothing."""

    def __init__(self, capacity: int, ttl: float | None = None):
        self.capacity, self.ttl, self.held = capacity, ttl, OrderedDict()

    def put(self, key, value, now: float = 0.0) -> None:
        if self.capacity <= 0:
            return
        self.held[key] = (value, None if not self.ttl else now + self.ttl)
        self.held.move_to_end(key)
        if len(self.held) > self.capacity:
            self.held.popitem(last=False)

    def get(self, key, now: float = 0.0, dim: int | None = None):
        """The value, or None if absent, expired (now after its time) or of another dimension."""
        if key not in self.held:
            return None
        value, until = self.held[key]
        if until is not None and now > until:
            del self.held[key]
            return None
        self.held.move_to_end(key)
        return None if dim is not None and len(value) != dim else value

    def clear(self) -> None:
        self.held.clear()

    def __len__(self) -> int:
        return len(self.held)


def replay(log: DataFrame, capacity: int, ttl: float | None = None) -> DataFrame:
    """(cache, seq, op, key, hit, size) of a log (cache, seq, op, key, at): each cache's operations in order of seq.

    The fold depends on order, so a cache's log streams through one task, sorted on disk; what it holds is ``capacity`` keys."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, Lru(capacity, ttl)
        for pdf in parts:
            hits, sizes = [], []
            for row in pdf.itertuples(index=False):
                if row.cache != now:
                    now, own = row.cache, Lru(capacity, ttl)
                hit = False
                if row.op == "put":
                    own.put(row.key, True, row.at)
                elif row.op == "get":
                    hit = own.get(row.key, row.at) is not None
                elif row.op == "clear":
                    own.clear()
                hits.append(hit)
                sizes.append(len(own))
            yield pdf[["cache", "seq", "op", "key"]].assign(hit=hits, size=sizes)

    dealt = log.select("cache", "seq", "op", "key", F.col("at").cast("double").alias("at")).repartition("cache").sortWithinPartitions("cache", "seq")
    return dealt.mapInPandas(run, "cache string, seq long, op string, key string, hit boolean, size int")


def live(entries: DataFrame, now: float) -> DataFrame:
    """Entries (key, value, expires_at) that have not expired; a null time never does."""
    return entries.where(F.col("expires_at").isNull() | (F.lit(now) <= F.col("expires_at")))


def counters(replayed: DataFrame) -> DataFrame:
    gets = F.col("op") == "get"
    return replayed.groupBy("cache").agg(F.count_if(gets & F.col("hit")).alias("hits"), F.count_if(gets & ~F.col("hit")).alias("misses"), F.max_by("size", "seq").alias("size"))
