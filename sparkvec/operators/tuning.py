"""Search over measured configurations: objectives, selection, frontiers, grids and samples, as queries on measurements."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.operators.batching import number_rows
from sparkvec.storage import cut

OBJECTIVES = ("latency", "throughput", "memory", "balanced")
TASKS = ("embedding", "reranking", "sparse", "image")
TIE = 0.05
#: How much slower than the best a median may be before a measurement stops, and the gain that another session must bring.
PRUNE_FACTOR, SESSION_GAIN = 2.5, 1.05
#: Fixed values of the objectives, scores and picks.
MEMORY_OFFSET, MEMORY_LATENCY_SHARE, NO_THROUGHPUT = 16.0, 0.1, 1e30
QUANT_MIN_GAIN, QUANT_DYNAMIC_PREFERENCE = 1.05, 1.15
PLATEAU = 0.95
PROFILES = {"throughput": (0.20, 0.70, 0.10), "latency": (0.70, 0.20, 0.10), "memory": (0.40, 0.10, 0.50), "balanced": (0.50, 0.30, 0.20)}
FRONTIER_EPS = (0.01, 1.0, 0.5)
# The words of the synthetic texts, in order, and the texts' lengths in words.
WORDS = (
    "the", "quick", "brown", "fox", "jumps", "over", "lazy", "dog", "machine", "learning", "algorithms", "process", "data", "efficiently", "natural", "language",
    "processing", "enables", "understanding", "semantic", "embeddings", "represent", "meaningful", "vector", "representations", "transformer", "models", "utilize",
    "attention", "mechanisms", "deep", "neural", "networks", "learn", "patterns", "from", "training", "optimization", "techniques", "improve", "convergence", "accuracy",
    "inference", "latency", "throughput", "benchmark", "performance", "production", "deployment", "scalable", "reliable", "systems",
)
LENGTHS = (16, 16, 16, 16, 64, 64, 64, 64, 128, 128)


def feasible(measurements: DataFrame, budget_ms: float = 0.0) -> DataFrame:
    rows = measurements.where("valid")
    return rows.where(F.col("p95_ms") <= budget_ms) if budget_ms > 0 else rows


def tail_latency() -> Column:
    return F.col("p50_ms") + 0.5 * (F.col("p95_ms") - F.col("p50_ms"))


def costs(measurements: DataFrame, objective: str, budget_ms: float = 0.0) -> DataFrame:
    """Feasible rows with ``cost``, relative to the best values among them."""
    if objective not in OBJECTIVES:
        raise ValueError(f"objective must be one of {OBJECTIVES}")
    rows = feasible(measurements, budget_ms).withColumn("tail", tail_latency())
    best = rows.agg(F.min("tail").alias("tail"), F.max("throughput").alias("most"), F.min("memory_mb").alias("memory"))
    least_tail, most, least_memory = (best.select(c).scalar() for c in ("tail", "most", "memory"))
    latency = F.when(least_tail > 0, F.col("tail") / least_tail).otherwise(1.0)
    speed = F.when(F.col("throughput") > 0, most / F.col("throughput")).otherwise(NO_THROUGHPUT)
    memory = (F.col("memory_mb") + MEMORY_OFFSET) / (least_memory + MEMORY_OFFSET) + MEMORY_LATENCY_SHARE * latency
    by = {"latency": latency, "throughput": speed, "memory": memory, "balanced": (latency + speed) / 2}
    return rows.withColumn("cost", by[objective])


def select_best(measurements: DataFrame, objective: str, budget_ms: float = 0.0, tie: float = TIE) -> DataFrame:
    """At most one row: the earliest ``idx`` whose cost is within ``tie`` of the least."""
    rows = costs(measurements, objective, budget_ms)
    least = rows.agg(F.min("cost")).scalar()
    return rows.where(F.col("cost") <= least * (1 + tie)).orderBy("idx").limit(1).drop("tail")


def search(measurements: DataFrame, objective: str, budget_ms: float = 0.0) -> DataFrame:
    """The best feasible row, or the best of all valid ones with ``constraints_met`` false."""
    met = select_best(measurements, objective, budget_ms).withColumn("constraints_met", F.lit(True))
    free = select_best(measurements, objective).withColumn("constraints_met", F.lit(False))
    return met.unionByName(free).orderBy(F.desc("constraints_met")).limit(1)


def raced(measurements: DataFrame, objective: str, factor: float = PRUNE_FACTOR) -> DataFrame:
    """``measurements`` with ``pruned``: in order of idx, those whose median is over ``factor`` times the best valid one before
    them would have been stopped early. A factor of 0, or memory as the objective, prunes none."""
    if factor <= 0 or objective == "memory":
        return measurements.withColumn("pruned", F.lit(False))
    before = F.min(F.when(F.col("valid"), F.col("p50_ms"))).over(W.orderBy("idx").rowsBetween(W.unboundedPreceding, -1))
    return measurements.withColumn("pruned", F.coalesce(F.col("p50_ms") > factor * before, F.lit(False)))


def check_request(task: str, objective: str | None = None, n_texts: int = 0, max_latency_ms: float = 0.0, min_tokens: int = 0, mode: str = "quick") -> None:
    """Raise for a tuning request that makes no sense."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}, only {TASKS}")
    if mode not in ("quick", "full"):
        raise ValueError("mode must be quick or full")
    if objective is not None and objective not in OBJECTIVES:
        raise ValueError(f"unknown objective {objective!r}, only {OBJECTIVES}")
    if n_texts and task == "image":
        raise ValueError("images take no texts of one's own")
    if min_tokens and task != "reranking":
        raise ValueError("min_tokens is for reranking alone")
    if max_latency_ms < 0 or min_tokens < 0:
        raise ValueError("max_latency_ms and min_tokens must not be negative")


def keep_baseline(measurements: DataFrame, objective: str, baseline: int) -> DataFrame:
    """The selected row, but the baseline's unless that costs strictly more."""
    priced = costs(measurements, objective)
    base = priced.where(F.col("idx") == baseline)
    best = priced.join(select_best(measurements, objective).select("idx"), "idx", "left_semi")
    both = best.withColumn("_first", F.lit(1)).unionByName(base.withColumn("_first", F.lit(0)))
    return both.orderBy("cost", "_first").limit(1).drop("_first", "tail")


def grid(spark: SparkSession, **options: list) -> DataFrame:
    """(idx, options...): the product of the options in the order given, the first one slowest."""
    names = list(options)
    out = None
    for name in names:
        part = spark.createDataFrame(list(enumerate(options[name])), f"_{name} int, {name} {'double' if any(isinstance(v, float) for v in options[name]) else 'int'}")
        part = part.select(F.struct(f"_{name}", name).alias(name))
        lists = part.agg(F.array_sort(F.collect_list(name))).scalar()
        out = spark.range(1).select(F.explode(lists).alias(name)) if out is None else out.withColumn(name, F.explode(lists))
    order = F.struct(*[F.col(f"{n}._{n}") for n in names])
    ranked = out.withColumn("idx", F.row_number().over(W.orderBy(order)) - 1)
    return ranked.select("idx", *[F.col(f"{n}.{n}").alias(n) for n in names])


def _sizes(*values: int) -> list[int]:
    return sorted({v for v in values if v >= 1})


def text_grid(spark: SparkSession, physical: int, logical: int, full: bool = False) -> DataFrame:
    """Splits of cores into workers and threads, in order of preference, by batch sizes."""
    splits = [(1, physical)] + ([(2, physical // 2)] if physical >= 4 else []) + [(physical, 1)]
    if full:
        splits += ([(1, logical)] if logical > physical else []) + ([(4, physical // 4)] if physical >= 8 else [])
    splits = list(dict.fromkeys((max(1, a), max(1, b)) for a, b in splits))
    rows = [(workers, threads, b) for workers, threads in splits for b in ((16, 32, 64, 128) if full else (32,))]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "idx int, workers int, threads int, batch_size int")


def rerank_grid(spark: SparkSession, physical: int, logical: int, full: bool = False, min_tokens: int = 0) -> DataFrame:
    """Threads, then token limits from the largest, then batch sizes; the floor alone if it is over every limit."""
    threads = _sizes(physical, logical, *((1, 2, physical // 2) if full else ()))
    tokens = [t for t in ((256, 128, 64, 32) if full else (256, 64)) if t >= min_tokens] or [min_tokens]
    return grid(spark, threads=threads, max_tokens=tokens, batch_size=[4, 8, 16] if full else [4, 16])


def sparse_grid(spark: SparkSession, physical: int, logical: int, full: bool = False) -> DataFrame:
    threads = sorted({physical, logical, *((max(1, physical // 2),) if full else ())})
    return grid(spark, threads=threads, batch_size=[4, 8, 16, 32] if full else [4, 16])


def image_grid(spark: SparkSession, physical: int, logical: int, full: bool = False) -> DataFrame:
    threads = sorted({physical, logical, *((1, max(1, physical // 2)) if full else ())})
    return grid(spark, threads=threads, batch_size=[1, 4, 8, 16, 32] if full else [1, 8, 16])


def prune_grid(spark: SparkSession) -> DataFrame:
    """The grid of sparse pruning options; the first of equal throughput wins."""
    return grid(spark, top_k=[16, 32, 64, 128], min_weight=[0.0, 0.01, 0.05])


def benchmark_grid(spark: SparkSession) -> DataFrame:
    """Threads by batch sizes of a benchmark of an ONNX model."""
    return grid(spark, threads=[1, 2, 3, 4], batch_size=[32, 64, 128])


def benchmark_sessions(runs: DataFrame, gain: float = SESSION_GAIN) -> DataFrame:
    """(series, sessions, throughput) of (series, sessions, throughput): sessions are tried in order until one after the first is
    under ``gain`` times the best so far, itself included; the best of those tried, the first of equals."""
    w = W.partitionBy("series").orderBy("sessions")
    rows = runs.withColumn("_best", F.max("throughput").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_i", F.row_number().over(w))
    stopped = F.coalesce(F.max(((F.col("_i") > 1) & (F.col("throughput") < F.col("_best") * gain)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tried = rows.withColumn("_stopped", stopped).where("_stopped = 0")
    return tried.groupBy("series").agg(F.max_by(F.struct("sessions", "throughput"), F.struct("throughput", (-F.col("sessions")).alias("s"))).alias("b")).select("series", "b.sessions", "b.throughput")


def compare_backends(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, backend, idx, throughput, recommended): the fastest run of each backend, and whether it is the fastest of all; the first
    of equals."""
    best = F.max_by(F.struct("idx", "throughput"), F.struct("throughput", (-F.col("idx")).alias("i"))).alias("b")
    rows = results.groupBy(*by, "backend").agg(best).select(*by, "backend", "b.idx", "b.throughput")
    first = W.partitionBy(*by).orderBy(F.desc("throughput"), "idx") if by else W.orderBy(F.desc("throughput"), "idx")
    return rows.withColumn("recommended", F.row_number().over(first) == 1)


def sweep(spark: SparkSession, models: dict[str, str], corpora: list[str]) -> DataFrame:
    """(model, path, backend, corpus): what a sweep runs; the extension tells the backend, and an ONNX model is its folder."""
    rows = spark.createDataFrame(sorted(models.items()) or [], "model string, file string")
    onnx = F.endswith(F.col("file"), F.lit(".onnx"))
    folder = F.regexp_replace("file", r"/?[^/]*$", "")
    each = F.explode(F.array(*[F.lit(c) for c in corpora])) if corpora else F.explode(F.array().cast("array<string>"))
    return rows.select("model", F.when(onnx, folder).otherwise(F.col("file")).alias("path"), F.when(onnx, "onnx").otherwise("llama").alias("backend"), each.alias("corpus"))


def fastest(measurements: DataFrame, value: str = "throughput") -> DataFrame:
    return measurements.orderBy(F.desc(value), "idx").limit(1)


def model_score(use_case: str, memory: Column | None = None) -> Column:
    """Score of (throughput, latency_ms, workers, quality); memory is estimated as 100 MB a worker."""
    t, lat, q, m = F.col("throughput"), F.col("latency_ms"), F.col("quality"), memory if memory is not None else F.col("workers") * 100.0
    by = {
        "speed": t * 10 - lat * 0.5 - m * 0.01 + q * 2,
        "quality": q * 100 + t * 0.1 - lat * 0.1 - m * 0.005,
        "balanced": t * 5 + q * 10 - lat * 0.2 - m * 0.01,
    }
    if use_case not in by:
        raise ValueError(f"use_case must be one of {sorted(by)}")
    return by[use_case]


def best_model(models: DataFrame, use_case: str) -> DataFrame:
    return fastest(models.withColumn("score", model_score(use_case)), "score")


def custom_weights(quality: float, throughput: float, cost: float) -> tuple[float, float, float]:
    total = quality + throughput + cost
    total = total if total > 0 else 1.0
    return quality / total, throughput / total, cost / total


def composite_score(weights: tuple[float, float, float]) -> Column:
    q, t, c = weights
    return q * F.col("quality") + t * F.least(F.col("throughput") / 300, F.lit(1.0)) + c * F.least(20 / F.greatest(F.col("file_mb"), F.lit(1.0)), F.lit(1.0))


def within(models: DataFrame, quality_min: float = 0, memory_max_mb: float = 0, throughput_min: float = 0) -> DataFrame:
    """Hard constraints; 0 or less sets none."""
    for name, op, limit in (("quality", ">=", quality_min), ("file_mb", "<=", memory_max_mb), ("throughput", ">=", throughput_min)):
        if limit > 0:
            models = models.where(f"{name} {op} {limit}")
    return models


def pareto(models: DataFrame, eps: tuple[float, float, float] = FRONTIER_EPS) -> DataFrame:
    """Rows that no other dominates: at least as good in quality, throughput and size within the tolerances, and better in one by more."""
    eq, et, em = eps
    o = models.select(F.col("idx").alias("o"), F.col("quality").alias("oq"), F.col("throughput").alias("ot"), F.col("file_mb").alias("om"))
    as_good = (F.col("oq") >= F.col("quality") - eq) & (F.col("ot") >= F.col("throughput") - et) & (F.col("om") <= F.col("file_mb") + em)
    better = (F.col("oq") > F.col("quality") + eq) | (F.col("ot") > F.col("throughput") + et) | (F.col("om") < F.col("file_mb") - em)
    return models.join(o, (F.col("o") != F.col("idx")) & as_good & better, "left_anti")


def plateau(runs: DataFrame) -> DataFrame:
    """(series, best, measured) of (series, sessions, throughput): stop after two results in a row under 95 % of the best."""
    rows = runs.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("sessions", "throughput"))).alias("r"))
    start = F.struct(F.lit(0.0).alias("best"), F.lit(0).alias("at"), F.lit(0).alias("low"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        on, up = a["low"] < 2, x["throughput"] > a["best"]
        low = F.when(up, 0).when(x["throughput"] < PLATEAU * a["best"], a["low"] + 1).otherwise(a["low"])
        return F.struct(
            F.when(on & up, x["throughput"]).otherwise(a["best"]).alias("best"),
            F.when(on & up, x["sessions"]).otherwise(a["at"]).cast("int").alias("at"),
            F.when(on, low).otherwise(a["low"]).alias("low"),
            F.when(on, a["n"] + 1).otherwise(a["n"]).alias("n"),
        )

    return rows.select("series", F.aggregate("r", start, step).alias("a")).select("series", F.col("a.at").alias("sessions"), F.col("a.best").alias("best"), F.col("a.n").alias("measured"))


def pick_quantization(measured: DataFrame, model: str = "model") -> DataFrame:
    """(model, pick) of (model, quantization, docs_per_sec): the fastest variant that beats the plain one by 5 %, but dynamic
    unless the fastest is 15 % faster than it; "none" without a usable baseline."""
    used = measured.where("docs_per_sec > 0")
    base = F.max(F.when(F.col("quantization") == "none", F.col("docs_per_sec")))
    dynamic = F.max(F.when(F.col("quantization") == "dynamic", F.col("docs_per_sec")))
    rate = F.col("docs_per_sec")
    per = used.groupBy(model).agg(base.alias("base"), dynamic.alias("dynamic"))
    fast = used.where("quantization <> 'none'").join(per, model).where((rate / F.col("base") >= QUANT_MIN_GAIN) & (rate > F.col("base")))
    best = fast.groupBy(model).agg(F.max_by("quantization", F.struct(rate, F.col("quantization"))).alias("best"), F.max(rate).alias("rate"))
    rows = measured.select(model).distinct().join(per, model, "left").join(best, model, "left")
    pick = F.when(F.col("base").isNull() | F.col("best").isNull(), "none").when(F.col("dynamic").isNotNull() & (F.col("rate") / F.col("dynamic") < QUANT_DYNAMIC_PREFERENCE), "dynamic").otherwise(F.col("best"))
    return rows.select(model, pick.alias("pick"))


def worth_measuring(probes: DataFrame, times: float = 3.0) -> DataFrame:
    """Probes that are less than ``times`` slower than the best rate of their model."""
    best = F.max("rate").over(W.partitionBy("model"))
    return probes.withColumn("_best", best).where(F.col("rate") * times >= F.col("_best")).drop("_best")


def workers(cores: Column) -> Column:
    return F.least(2 * cores, F.lit(8))


def length_bucket(text: Column | str) -> Column:
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when(n <= 0, 0).otherwise(F.least(F.floor(F.log10(n) * 2.5), F.lit(9))).cast("int")


def stratified_sample(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``size`` rows spread over length buckets: in each, every step-th by key; filled up in order of the MD5 of the key. Keys are numbered
    without their texts, by ranges of them; the sample of texts is met at the end."""
    total = df.count()
    if total <= size:
        return df
    per = max(1, size // 10)
    rows = df.select(key, length_bucket(text).cast("int").alias("_b"))
    placed = cut(number_rows(rows, [F.col(key)], "_i", by=["_b"]))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_c"))
    wanted = counts.select(F.col("_b"), F.explode(F.when(F.col("_c") <= per, F.sequence(F.lit(0), F.col("_c").cast("int") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.floor(i * (F.col("_c") / F.lit(per))).cast("int")))).alias("_i"))
    first = placed.join(F.broadcast(wanted.distinct()), ["_b", "_i"], "left_semi").withColumn("_o", F.struct(F.lit(0), F.lpad(F.col("_b").cast("string"), 4, "0"), F.lpad(F.col("_i").cast("string"), 20, "0")))
    rest = placed.join(F.broadcast(first.select(key)), key, "left_anti").withColumn("_o", F.struct(F.lit(1), F.md5(F.col(key).cast("string")), F.lit("")))
    chosen = first.unionByName(rest.orderBy("_o").limit(size)).orderBy("_o").limit(size).select(key)
    return df.join(F.broadcast(chosen), key, "left_semi")


def split_workload(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(query, documents): the last text by key is the query."""
    last = df.orderBy(F.desc(key)).limit(1)
    return last, df.join(last.select(key), key, "left_anti")


def synthetic_corpus(spark: SparkSession, n: int) -> DataFrame:
    """(i, n_words, text): word number (7 i + j) of a fixed list, in fixed lengths."""
    words, lengths = F.array(*[F.lit(w) for w in WORDS]), F.array(*[F.lit(x) for x in LENGTHS])
    rows = spark.range(n).select(F.col("id").alias("i"), F.get(lengths, (F.col("id") % len(LENGTHS)).cast("int")).alias("n_words"))
    parts = F.transform(F.sequence(F.lit(0), F.col("n_words") - 1), lambda j: F.get(words, ((F.col("i") * 7 + j) % len(WORDS)).cast("int")))
    return rows.withColumn("text", F.array_join(parts, " "))


def cache_key(model: str, logical: int, physical: int, brand: str, runtime: str, version: str, variant: str = "") -> str:
    """Identity of a tuned machine and model; the variant is the first 12 digits of its hash."""
    safe = "".join("_" if c in "/\\: " else c for c in model + (f"_{hashlib.sha256(variant.encode()).hexdigest()[:12]}" if variant else ""))
    return f"{logical}x{physical}_{brand}_{safe}_ort{'.'.join(runtime.split('.')[:2])}_v{'.'.join(version.split('.')[:2])}"

