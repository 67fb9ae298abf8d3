"""Batches of texts for a model: fixed, by length, by token budget; padding and shards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.storage import cut

#: Padded tokens of a batch that measured best for dense, sparse and rerank models.
TOKEN_BUDGET = 512


def number_rows(df: DataFrame, order: list[Column | str], name: str = "_n", by: list[str] | None = None) -> DataFrame:
    """Adds a row number from 0 in global order, or in each group of the columns ``by``, without one task for all.

    Rows are range-partitioned and sorted once and cut there, so that partitions and the order inside them hold whatever
    is read of them later. A row's number is its place in its partition after the counts of those before it: one row a
    partition is broadcast. A group's numbers begin at its least global one, so a large group is no task of its own."""
    full = [*(F.col(c).asc_nulls_first() for c in by or []), *order]
    dealt = cut(df.repartitionByRange(*full).sortWithinPartitions(*full)).withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = dealt.groupBy(part).agg(F.count("*").alias("_c"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    out = dealt.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place).drop("_part", "_at", "_before")
    if not by:
        return out
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    first = out.groupBy(*keys).agg(F.min(name).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)])
    return out.join(first, same).withColumn(name, F.col(name) - F.col("_first")).select(*df.columns, name)


def fixed_batches(df: DataFrame, order: list[Column | str], size: int) -> DataFrame:
    """Adds ``batch``: ceil(n / size) ranges in order; one for a size of 0 or less, and rows of their own for 1 (sequential)."""
    if size <= 0:
        return df.withColumn("batch", F.lit(0).cast("long"))
    return number_rows(df, order).withColumn("batch", F.floor(F.col("_n") / size)).drop("_n")


def length_batches(df: DataFrame, tokens: str, key: str, size: int, exact_length: bool = False) -> DataFrame:
    """Adds ``batch``: the longest texts first, ties by ``key``, ``size`` of them each. With ``exact_length`` only texts of
    one length share a batch, for models that padding disturbs."""
    if size <= 1:
        return fixed_batches(df, [key], 1)
    order = [F.desc(tokens), F.col(key)]
    if not exact_length:
        return fixed_batches(df, order, size)
    inside = number_rows(df, [F.col(key)], "_n", by=[tokens])
    return inside.withColumn("batch", F.concat_ws("-", F.col(tokens), F.floor(F.col("_n") / size))).drop("_n")


def cut_by_budget(lengths: list[int], size: int, budget: int = TOKEN_BUDGET) -> list[int]:
    """Batch number of each text of a list in order, longest first: as many as the budget takes at the first one's length."""
    out, at, batch = [], 0, 0
    while at < len(lengths):
        n = min(size, max(1, budget // max(1, lengths[at])))
        out += [batch] * len(lengths[at : at + n])
        at, batch = at + n, batch + 1
    return out


def budget_plan(counts: list[tuple[int, int]], size: int, budget: int = TOKEN_BUDGET) -> list[tuple[int, int, int, int]]:
    """(length, start, room, first) for each of the (length, rows) given, longest first: the place of the first row of this
    length that opens a batch, the rows of a batch opened here, and its number. Rows before ``start`` are in the batch
    before ``first``. A batch is cut by its first text's length alone, so the counts of lengths decide all."""
    out, at, start, batch = [], 0, 0, 0
    for length, rows in counts:
        end, room = at + rows, min(size, max(1, budget // max(1, length)))
        out.append((length, start, room, batch))
        opened = max(0, -(-(end - start) // room))
        start, batch, at = start + opened * room, batch + opened, end
    return out


def budget_batches(df: DataFrame, tokens: str, key: str, size: int, budget: int = TOKEN_BUDGET, shard: list[str] | None = None) -> DataFrame:
    """Adds ``batch``, numbered in each shard, or over the whole table without one. A shard streams through a sequential scan of its
    sorted rows that keeps only the current batch's room. The whole table is numbered in order and its batches are planned
    from the counts of its lengths, of which there are no more than tokens in the longest text."""
    order = [F.desc(tokens), F.col(key)]
    if not shard:
        numbered = number_rows(df, order)
        counts = df.groupBy(F.coalesce(F.col(tokens), F.lit(0)).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect()
        plan = budget_plan([(r["n"], r["c"]) for r in counts], size, budget)
        steps = F.broadcast(df.sparkSession.createDataFrame(plan, "_length long, _start long, _room long, _first long"))
        own = F.col("_first") + F.floor((F.col("_n") - F.col("_start")) / F.col("_room"))
        batch = F.when(F.col("_n") < F.col("_start"), F.col("_first") - 1).otherwise(own)
        return numbered.join(steps, F.coalesce(F.col(tokens), F.lit(0)) == F.col("_length")).select(*df.columns, batch.alias("batch"))
    sorted_ = df.repartition(*shard).sortWithinPartitions(*shard, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room, batch, group = 0, -1, None
        for pdf in parts:
            out = []
            for n, g in zip(pdf[tokens].tolist(), map(tuple, pdf[shard].itertuples(index=False)), strict=True):
                if g != group:
                    room, batch, group = 0, -1, g
                if not room:
                    room, batch = min(size, max(1, budget // max(1, n))), batch + 1
                room -= 1
                out.append(batch)
            yield pdf.assign(batch=out)

    return sorted_.mapInPandas(run, f"{fields}, batch long")


def padding_waste(batched: DataFrame, tokens: str, by: list[str]) -> DataFrame:
    """One row: padded tokens, tokens, and their ratio."""
    each = batched.groupBy(*by).agg((F.max(tokens) * F.count("*")).alias("padded"), F.sum(tokens).alias("tokens"))
    return each.agg(F.sum("padded").alias("padded"), F.sum("tokens").alias("tokens"), (F.sum("padded") / F.sum("tokens")).alias("ratio"))


def shards(df: DataFrame, order: list[Column | str], workers: int) -> DataFrame:
    """Adds ``shard``: contiguous ranges of ceil(n / workers) rows in order."""
    numbered = number_rows(df, order)
    size = df.agg(F.ceil(F.count("*") / workers)).scalar()
    return numbered.withColumn("shard", F.floor(F.col("_n") / F.greatest(size, F.lit(1)))).drop("_n")


def round_robin(df: DataFrame, order: list[Column | str], sessions: int) -> DataFrame:
    """Adds ``session``: rows go to ``sessions`` of them in turn."""
    if sessions < 1:
        raise ValueError("sessions must be at least 1")
    return number_rows(df, order).withColumn("session", (F.col("_n") % sessions).cast("int")).drop("_n")


def arrival_batches(df: DataFrame, at: str, key: str, shard: list[str], size: int = 32, wait: float = 5.0) -> DataFrame:
    """Adds ``batch`` in each shard: requests in order of their time ``at`` share a batch until it has ``size`` of them or the next
    comes over ``wait`` after its first. A shard streams through a sequential scan that keeps only the open batch."""
    sorted_ = df.repartition(*shard).sortWithinPartitions(*shard, at, key)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, batch, held, began = None, -1, 0, 0.0
        for pdf in parts:
            out = []
            for now, g in zip(pdf[at].tolist(), map(tuple, pdf[shard].itertuples(index=False)), strict=True):
                if g != group:
                    group, batch, held = g, -1, 0
                if not held or held == size or now - began > wait:
                    batch, held, began = batch + 1, 0, now
                held += 1
                out.append(batch)
            yield pdf.assign(batch=out)

    return sorted_.mapInPandas(run, f"{fields}, batch long")
