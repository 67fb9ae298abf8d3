"""Sparse vectors as postings (id, term, weight): pooling, pruning, products and formats."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DICT, INDEX_ORDER = "dict", "index_order"


def splade_pool(logits: DataFrame, mask: str | None = None) -> DataFrame:
    """(id, term, weight) from (id, pos, term, logit): log(1 + the largest unmasked logit), only where over 0.

    The maximum is taken before the logarithm, which is monotone, so one partial aggregation carries a float a term."""
    rows = logits if mask is None else logits.where(F.col(mask) != 0)
    return rows.groupBy("id", "term").agg(F.max("logit").alias("m")).where("m > 0").select("id", "term", F.log1p("m").alias("weight"))


def scalar_max_pool(weights: DataFrame) -> DataFrame:
    """(id, term, weight) from each token's own weight on its id: the largest, without a logarithm."""
    return weights.groupBy("id", "term").agg(F.max("weight").alias("weight")).where("weight > 0")


def _pooled(logits: Column | str, log: bool) -> Column:
    """Entries (term, weight) of an array of (term, logit), the largest of each term where it is over 0: the array is sorted, and
    the first of each run stays."""
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (x["term"] != F.get(s, i - 1)["term"]))
    ranked = F.sort_array(F.transform(logits, lambda x: F.struct(x["term"].alias("term"), (-x["logit"]).alias("m"))))
    best = F.filter(F.transform(F.array(ranked), first)[0], lambda x: x["m"] < 0)
    return F.transform(best, lambda x: F.struct(x["term"].alias("term"), (F.log1p(-x["m"]) if log else -x["m"]).alias("weight")))


def _rows(rows: DataFrame, entries: Column) -> DataFrame:
    return rows.select("id", F.explode(entries).alias("e")).select("id", "e.term", "e.weight")


def splade_pool_rows(rows: DataFrame) -> DataFrame:
    """:func:`splade_pool` of (id, logits array<struct<term, logit>>): texts whose tokens are one row are pooled in it, and nothing
    is shuffled."""
    return _rows(rows, _pooled("logits", True))


def scalar_max_pool_rows(rows: DataFrame) -> DataFrame:
    """:func:`scalar_max_pool` of (id, logits array<struct<term, logit>>), pooled in each row."""
    return _rows(rows, _pooled("logits", False))


def term_counts(words: Column | str) -> Column:
    """(term, weight) entries by term, with how often an array of words holds each; n log n, in the row."""

    def runs(s: Column) -> Column:
        starts = F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)))
        each = lambda p: F.transform(p, lambda at, j: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(p, j + 1), F.size(s)) - at).cast("double").alias("weight")))
        return F.transform(F.array(starts), each)[0]

    return F.transform(F.array(F.sort_array(words)), runs)[0]


def counted_rows(rows: DataFrame, words: str) -> DataFrame:
    """(id, indices, values) of (id, words): one sparse vector a row, in order of the terms."""
    counted = rows.select("id", term_counts(words).alias("e"))
    return counted.select("id", F.transform("e", lambda x: x["term"]).alias("indices"), F.transform("e", lambda x: x["weight"]).alias("values"))


def extract_over(postings: DataFrame, threshold: float) -> DataFrame:
    return postings.where(F.col("weight") > threshold)


def drop_special(postings: DataFrame, ids: list[int]) -> DataFrame:
    return postings.where(~F.col("term").isin(ids)) if ids else postings


def prune(postings: DataFrame, min_weight: float = 0.0, top_k: int = 0) -> DataFrame:
    """Weights of at least ``min_weight`` if that is over 0, then the heaviest ``top_k`` of each id if that is over 0; ties by term."""
    if min_weight < 0 or top_k < 0:
        raise ValueError("min_weight and top_k must not be negative")
    out = postings.where(F.col("weight") >= min_weight) if min_weight > 0 else postings
    if top_k:
        heaviest = W.partitionBy("id").orderBy(F.desc("weight"), "term")
        out = out.withColumn("_r", F.row_number().over(heaviest)).where(F.col("_r") <= top_k).drop("_r")
    return out


@dataclass(frozen=True)
class Options:
    """What is done with pooled vectors. One set serves a context; a call may change some of it."""

    special: tuple[int, ...] = ()
    min_weight: float = 0.0
    top_k: int = 0
    order: str = DICT

    def __post_init__(self):
        if self.min_weight < 0 or self.top_k < 0:
            raise ValueError("min_weight and top_k must not be negative")
        if self.order not in (DICT, INDEX_ORDER):
            raise ValueError(f"order must be {DICT} or {INDEX_ORDER}")


def finish(postings: DataFrame, options: Options = Options(), **changes) -> DataFrame:
    """(id, indices, values) of pooled postings: special ids go, then light weights, then all but the heaviest, in the order
    asked for. ``changes`` that are not None hold for this call."""
    own = replace(options, **{k: v for k, v in changes.items() if v is not None})
    return to_struct(prune(drop_special(postings, list(own.special)), own.min_weight, own.top_k), own.order)


def to_struct(postings: DataFrame, order: str = DICT) -> DataFrame:
    """(id, indices, values): by weight downwards, or by index with INDEX_ORDER."""
    if order not in (DICT, INDEX_ORDER):
        raise ValueError(f"order must be {DICT} or {INDEX_ORDER}")
    key = F.struct((-F.col("weight")).alias("k"), "term", "weight") if order == DICT else F.struct("term", "weight")
    sorted_ = postings.groupBy("id").agg(F.array_sort(F.collect_list(key)).alias("s"))
    return sorted_.select("id", F.transform("s", lambda x: x["term"]).alias("indices"), F.transform("s", lambda x: x["weight"]).alias("values"))


def to_postings(vectors: DataFrame) -> DataFrame:
    zipped = F.explode(F.arrays_zip("indices", "values"))
    return vectors.select("id", zipped.alias("z")).select("id", F.col("z.indices").alias("term"), F.col("z.values").alias("weight"))


def to_map(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", F.map_from_arrays("indices", "values").alias("weights"))


def to_coo(vectors: DataFrame) -> DataFrame:
    """One row for each entry; an empty vector has none."""
    return to_postings(vectors).select(F.col("id").alias("row"), F.col("term").alias("col"), F.col("weight").alias("value"))


def to_csr(vectors: DataFrame, rows_per_block: int = 1_000_000) -> DataFrame:
    """Vectors with ``offset``, their start in the concatenation by id. The running sum goes over blocks of ids, then inside each."""
    blocked = vectors.select("id", "indices", "values", F.size("indices").cast("long").alias("n"), F.floor(F.col("id") / rows_per_block).alias("block"))
    totals = blocked.groupBy("block").agg(F.sum("n").alias("n"))
    before = totals.select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("block").orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocked.join(before, "block").select("id", "indices", "values", (F.col("base") + inside).alias("offset"))


def norms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def products(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(q, d, dot) of pairs that share a term: an equi-join of postings, folded before the shuffle by pair."""
    q = queries.select(F.col("id").alias("q"), "term", F.col("weight").alias("_qw"))
    d = docs.select(F.col("id").alias("d"), "term", F.col("weight").alias("_dw"))
    return q.join(d, "term").groupBy("q", "d").agg(F.sum(F.col("_qw") * F.col("_dw")).alias("dot"))


def cosine_value(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    """dot over norms; where a norm is 0: 1 if both are, else 0."""
    return F.when((norm_a > 0) & (norm_b > 0), dot / (norm_a * norm_b)).otherwise((norm_a == norm_b).cast("double"))


def cosines(a: DataFrame, b: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, cosine) of the vectors of equal id in two sets, for each of ``ids``."""
    dot = a.join(b.select("id", "term", F.col("weight").alias("_w")), ["id", "term"]).groupBy("id").agg(F.sum(F.col("weight") * F.col("_w")).alias("dot"))
    out = ids.select("id").join(dot, "id", "left").join(norms(a).withColumnRenamed("norm", "na"), "id", "left").join(norms(b).withColumnRenamed("norm", "nb"), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("id", cosine_value(zero(F.col("dot")), zero(F.col("na")), zero(F.col("nb"))).alias("cosine"))


def sparsity(vectors: DataFrame, vocabulary: int) -> DataFrame:
    return vectors.select("id", F.size("indices").alias("nnz"), (F.size("indices") / vocabulary).alias("density"))
