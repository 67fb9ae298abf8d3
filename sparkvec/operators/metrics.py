"""Retrieval quality, fidelity and latency aggregates. Ranked lists are rows (q, d, rank from 1); judgements (q, d, grade)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.operators import sparse
from sparkvec.storage import cut

#: Inverse of the error of the percentiles that bracket an exact one, as a share of the values.
ACCURACY = 10_000
#: Groups whose brackets are broadcast, at most.
MAX_GROUPS = 50_000
BANDS = (0.0, 0.1, 0.5, 1.0, 2.0, float("inf"))


def gain(grade: Column, kind: str) -> Column:
    if kind not in ("exp", "linear"):
        raise ValueError("gain must be exp or linear")
    return F.pow(F.lit(2.0), grade) - 1 if kind == "exp" else grade.cast("double")


def _discounted(g: Column, rank: Column) -> Column:
    return F.sum(g / (F.log(rank + 1.0) / F.log(F.lit(2.0))))


def _judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    return ranked.join(qrels.select("q", "d", "grade"), ["q", "d"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def ndcg(ranked: DataFrame, qrels: DataFrame, k: int = 10, kind: str = "exp", ideal: str = "qrels") -> DataFrame:
    """(q, ndcg). ``ideal`` orders the grades of the judgements, or those of the ranked list itself ("list"); 0 without any."""
    judged = _judged(ranked, qrels)
    dcg = judged.where(F.col("rank") <= k).groupBy("q").agg(_discounted(gain(F.col("grade"), kind), F.col("rank")).alias("dcg"))
    pool = qrels.select("q", "d", "grade") if ideal == "qrels" else judged.select("q", "d", "grade")
    best = pool.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("grade"), "d"))).where(F.col("r") <= k)
    idcg = best.groupBy("q").agg(_discounted(gain(F.col("grade"), kind), F.col("r")).alias("idcg"))
    value = F.when(F.coalesce("idcg", F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg"))
    queries = ranked.select("q").union(qrels.select("q")).distinct()
    return queries.join(dcg, "q", "left").join(idcg, "q", "left").select("q", value.alias("ndcg"))


def recall(ranked: DataFrame, qrels: DataFrame, k: int, least: float = 1) -> DataFrame:
    """(q, recall): relevant ones in the first k over all relevant, grade ``least`` or more; 0 without any."""
    relevant = qrels.where(F.col("grade") >= least)
    total = relevant.groupBy("q").agg(F.count("*").alias("n"))
    found = ranked.where(F.col("rank") <= k).join(relevant.select("q", "d"), ["q", "d"]).groupBy("q").agg(F.count("*").alias("hit"))
    queries = ranked.select("q").union(qrels.select("q")).distinct()
    value = F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).otherwise(F.coalesce("hit", F.lit(0)) / F.col("n"))
    return queries.join(total, "q", "left").join(found, "q", "left").select("q", value.alias("recall"))


def hit_at(ranked: DataFrame, qrels: DataFrame, k: int = 3) -> DataFrame:
    """(q, hit): 1 if any relevant one is in the first k."""
    relevant = qrels.where("grade > 0").select("q", "d", F.lit(1).alias("rel"))
    seen = ranked.where(F.col("rank") <= k).join(relevant, ["q", "d"], "left")
    return seen.groupBy("q").agg(F.coalesce(F.max("rel"), F.lit(0)).cast("double").alias("hit"))


def mrr(ranked: DataFrame, qrels: DataFrame, k: int | None = None) -> DataFrame:
    """(q, rr): one over the first relevant rank, 0 without any or beyond k."""
    within = ranked if k is None else ranked.where(F.col("rank") <= k)
    first = within.join(qrels.where("grade > 0").select("q", "d"), ["q", "d"]).groupBy("q").agg((1.0 / F.min("rank")).alias("rr"))
    return ranked.select("q").distinct().join(first, "q", "left").select("q", F.coalesce("rr", F.lit(0.0)).alias("rr"))


def average_precision(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(q, ap): mean precision at the relevant ranks over the relevant ones of the list."""
    judged = _judged(ranked, qrels).withColumn("rel", (F.col("grade") > 0).cast("int"))
    so_far = F.sum("rel").over(W.partitionBy("q").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return judged.withColumn("p", F.when(F.col("rel") == 1, so_far / F.col("rank"))).groupBy("q").agg(F.coalesce(F.avg("p"), F.lit(0.0)).alias("ap"))


def agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(q, agreement): common ones of two rankings' first k, over k."""
    both = a.where(F.col("rank") <= k).join(b.where(F.col("rank") <= k).select("q", "d"), ["q", "d"]).groupBy("q").agg(F.count("*").alias("n"))
    return a.select("q").distinct().join(both, "q", "left").select("q", (F.coalesce("n", F.lit(0)) / k).alias("agreement"))


def _aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select("id", "term", F.col("weight").alias("x"))
    y = b.select("id", "term", F.col("weight").alias("y"))
    return x.join(y, ["id", "term"], "full")


def fidelity(a: DataFrame, b: DataFrame, ids: DataFrame, top: int = 10) -> DataFrame:
    """One row: how two sets of sparse vectors agree over ``ids``."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    diff = _aligned(a, b).groupBy("id").agg(F.max(F.abs(zero(F.col("x")) - zero(F.col("y")))).alias("diff"), F.count("x").alias("na"), F.count("y").alias("nb"))
    tops = []
    for part, name in ((a, "ta"), (b, "tb")):
        best = sparse.prune(part, top_k=top)
        tops.append(best.groupBy("id").agg(F.collect_set("term").alias(name)))
    overlap = ids.select("id").join(tops[0], "id", "left").join(tops[1], "id", "left")
    none = F.array().cast(dict(tops[0].dtypes)["ta"])
    ta, tb = F.coalesce("ta", none), F.coalesce("tb", none)
    overlap = overlap.select("id", (F.size(F.array_intersect(ta, tb)) / F.greatest(F.lit(1), F.size(ta), F.size(tb))).alias("overlap"))
    rows = cut(sparse.cosines(a, b, ids).join(diff, "id", "left").join(overlap, "id", "left"))
    ratio = F.when(F.coalesce("na", F.lit(0)) == 0, 1.0).otherwise(F.col("nb") / F.col("na"))
    return rows.agg(
        F.count("*").alias("texts"),
        F.avg("cosine").alias("cosine_mean"),
        percentiles_linear(rows, "cosine", [], {"p5": 0.05}).scalar().alias("cosine_p5"),
        F.min("cosine").alias("cosine_min"),
        F.max(zero(F.col("diff"))).alias("max_weight_diff"),
        F.avg("overlap").alias("top_overlap_mean"),
        F.avg(ratio).alias("nnz_ratio_mean"),
    )


def weight_bands(a: DataFrame, b: DataFrame) -> DataFrame:
    """(band, terms, mean_delta, p99_delta, max_delta, max_relative, one_sided) by the larger of two weights."""
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    w = F.greatest(x, y)
    band = F.lit(None).cast("int")
    for i in reversed(range(len(BANDS) - 1)):
        band = F.when((w >= BANDS[i]) & (w < BANDS[i + 1]), i).otherwise(band)
    terms = cut(_aligned(a, b).select(band.alias("band"), w.alias("w"), F.abs(x - y).alias("delta"), (F.col("x").isNull() | F.col("y").isNull()).cast("int").alias("one")))
    sums = terms.groupBy("band").agg(
        F.count("*").alias("terms"),
        F.avg("delta").alias("mean_delta"),
        F.max("delta").alias("max_delta"),
        F.max(F.when(F.col("w") > 0, F.col("delta") / F.col("w")).otherwise(0.0)).alias("max_relative"),
        F.sum("one").alias("one_sided"),
    )
    high = percentiles_linear(terms, "delta", ["band"], {"p99_delta": 0.99}).withColumnRenamed("band", "_band")
    joined = sums.join(high, F.col("band").eqNullSafe(F.col("_band")))
    return joined.select("band", "terms", "mean_delta", "p99_delta", "max_delta", "max_relative", "one_sided")


def percentile_linear(values: str, p: float) -> Column:
    """Linear interpolation; 0 for no values; p is held in 0..1. An expression for groups that fit a task by their distinct values;
    :func:`percentiles_linear` is for larger ones."""
    return F.coalesce(F.percentile(values, max(0.0, min(1.0, p))), F.lit(0.0))


def percentile_percent(values: str, p: float) -> Column:
    """The same with p from 0 to 100."""
    return percentile_linear(values, p / 100)


def values_at(df: DataFrame, values: str, by: list[str], ranks: dict[str, tuple[float, Callable[[Column], Column]]], accuracy: int = ACCURACY) -> DataFrame:
    """(by, name...): the exact value at a rank from 0 of each group's sorted values; nulls do not count. ``ranks``: by name the share
    of the values that lies before it, and the rank for a count.

    A first pass brackets each rank by approximate percentiles, whose error is known; a second counts what lies below a bracket and the
    distinct values in it, so that only a thousandth or so of a group's values meet in one task."""
    rows = df.where(F.col(values).isNotNull()).select(*by, F.col(values).alias("_v"))
    margin = 5 / accuracy
    probes = [max(0.0, min(1.0, p + side * margin)) for p, _ in ranks.values() for side in (-1, 1)]
    groups = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", probes, accuracy).alias("_q"))
    parts = []
    for i, (name, (_, rank)) in enumerate(ranks.items()):
        small = F.col("_n") * margin < 4  # a bracket must hold the ranks beside the one in question
        low = F.when(small | F.lit(probes[2 * i] <= 0), F.col("_min")).otherwise(F.get("_q", F.lit(2 * i)))
        high = F.when(small | F.lit(probes[2 * i + 1] >= 1), F.col("_max")).otherwise(F.get("_q", F.lit(2 * i + 1)))
        at = F.greatest(F.lit(0), F.least(rank(F.col("_n")), F.col("_n") - 1))
        parts.append(F.struct(F.lit(name).alias("name"), low.alias("low"), high.alias("high"), at.cast("long").alias("rank")))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    brackets = cut(groups.select(*keys, F.array(*parts).alias("_t")))
    if by:
        few = F.broadcast(brackets) if brackets.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS else brackets
        met = rows.join(few, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]))
    else:
        met = rows.withColumn("_t", brackets.select("_t").scalar())
    each = met.select(*by, "_v", F.explode("_t").alias("_t")).where(F.col("_v") <= F.col("_t.high"))
    inside = F.when(F.col("_v") >= F.col("_t.low"), F.col("_v")).alias("_v")
    counted = each.select(*by, F.col("_t.name").alias("_name"), F.col("_t.rank").alias("_rank"), inside).groupBy(*by, "_name", "_rank", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*by, "_name").orderBy(F.col("_v").asc_nulls_first()))
    found = counted.withColumn("_upto", upto).where("_upto > _rank")
    return found.groupBy(*by).agg(*[F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])


def percentiles_linear(df: DataFrame, values: str, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """(by, name...): exact percentiles with linear interpolation, by names with their p in 0..1."""
    ranks = {}
    for name, p in wanted.items():
        ranks[f"_low_{name}"] = (p, lambda n, p=p: F.floor(F.lit(p) * (n - 1)))
        ranks[f"_high_{name}"] = (p, lambda n, p=p: F.ceil(F.lit(p) * (n - 1)))
    counts = df.where(F.col(values).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"))
    at = values_at(df, values, by, ranks)
    if by:
        keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
        rows = at.join(counts.select(*keys, "_n"), same)
    else:
        rows = at.withColumn("_n", counts.select("_n").scalar())

    def between(name: str, p: float) -> Column:
        low, high, h = F.col(f"_low_{name}").cast("double"), F.col(f"_high_{name}").cast("double"), F.lit(p) * (F.col("_n") - 1)
        return (low + (h - F.floor(h)) * (high - low)).alias(name)

    return rows.select(*by, *[between(name, p) for name, p in wanted.items()])


def percentile_nearest(df: DataFrame, values: str, p: float, by: list[str], rule: str = "nearest") -> DataFrame:
    """(by, value) at a rank counted from 0: ceil(p n) - 1 ("nearest"), int(p n) - 1 ("floor") or int(p n) ("index"), held in the list."""
    at = {"nearest": lambda n: F.ceil(n * F.lit(p)) - 1, "floor": lambda n: F.floor(n * F.lit(p)) - 1, "index": lambda n: F.floor(n * F.lit(p))}[rule]
    return values_at(df, values, by, {"value": (p, at)})


def upper_median(df: DataFrame, values: str, by: list[str]) -> DataFrame:
    """(by, value): the element at n / 2 of the sorted values."""
    return percentile_nearest(df, values, 0.5, by, "index")


def latency_summary(df: DataFrame, values: str, by: list[str]) -> DataFrame:
    """(by, n, min, p50, p95, max) of groups that have values."""
    plain = df.where(F.col(values).isNotNull()).groupBy(*by).agg(F.count(values).alias("n"), F.min(values).alias("min"), F.max(values).alias("max"))
    ranked = percentiles_linear(df, values, by, {"p50": 0.5, "p95": 0.95})
    if not by:
        return plain.select("n", "min", *[ranked.select(c).scalar().alias(c) for c in ("p50", "p95")], "max")
    keys = [F.col(c).alias(f"_j{i}") for i, c in enumerate(by)]
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_j{i}")) for i, c in enumerate(by)])
    return plain.join(ranked.select(*keys, "p50", "p95"), same).select(*by, "n", "min", "p50", "p95", "max")


def running_stats(calls: DataFrame, by: list[str]) -> DataFrame:
    """(by, texts, batches, calls, avg_latency_ms) of a log (by, kind, texts, batches, latency_ms): streams count their texts and batches
    but no latency; the average is 0 without a call that has one."""
    timed = F.col("kind") != "stream"
    n = F.count_if(timed)
    average = F.when(n > 0, F.coalesce(F.sum(F.when(timed, F.col("latency_ms"))), F.lit(0.0)) / n).otherwise(0.0)
    return calls.groupBy(*by).agg(F.sum("texts").alias("texts"), F.sum("batches").alias("batches"), n.alias("calls"), average.alias("avg_latency_ms"))


def relative_delta(current: Column, base: Column) -> Column:
    return 100 * (current - base) / base


def is_noise(current: Column, base: Column, percent: float = 5.0) -> Column:
    return F.abs(relative_delta(current, base)) < percent


def missing_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``missing``: names of the columns that are null, "unknown" or 0."""
    text = lambda c: F.col(c).cast("string")
    marks = [F.when(F.col(c).isNull() | (text(c) == "unknown") | (text(c).cast("string").isin("0", "0.0", "")), F.lit(c)) for c in columns]
    return df.withColumn("missing", F.array_compact(F.array(*marks)))
