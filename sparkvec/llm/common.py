"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.storage import cut, spread

__all__ = ["SPACE", "SPACE_CLASS", "cut", "few", "labelled_sample", "let", "remainder", "table"]

#: ASCII white space, and the same as a Java character class; words are runs of anything else.
SPACE = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


#: Tables of texts, which are work for more than one task even when they are small.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``, so that no optimizer rule can evaluate it again for every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def few(df: DataFrame, most: int) -> DataFrame:
    """``df``, marked for a broadcast if it has no more rows than that; they are a few numbers each. Call it on a cut table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(labels: DataFrame, docs: DataFrame, keep: Column, columns: list[str], rows: int, seed: str = "") -> DataFrame:
    """At most ``rows`` labelled rows of documents that ``docs`` has, one for each doc_id, those with the smallest hash: the bound
    is a parameter, so the result may be broadcast whatever the size of the corpus."""
    known = docs.select("doc_id").where("doc_id is not null").distinct()
    return (
        labels.where(keep & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.count("*").alias("_n"), *[F.max(c).alias(c) for c in columns])
        .join(known, "doc_id", "left_semi")
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id")
        .limit(rows)
        .drop("_n")
    )
