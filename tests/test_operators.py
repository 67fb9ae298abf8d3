"""Literal cases, closed forms and metamorphic checks of the operators."""

import math
import os
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sparkvec.functions import subword, text, vector
from sparkvec.operators import batching, cache, metrics, retrieve, sparse, tuning
from sparkvec.plans import providers, registry, resolve
from sparkvec.sources import corpora, readers
from sparkvec.streaming import embed as streaming


def one(spark, column, **values):
    """The value of an expression over one row of arrays of floats."""
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} array<float>" for n in names))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "a", "b", "expect"),
    [
        (vector.cosine, [1, 2, 3], [1, 2, 3], 1), (vector.cosine, [1, 0], [0, 1], 0), (vector.cosine, [1, 2], [-1, -2], -1), (vector.cosine, [0, 0], [1, 2], 0), (vector.cosine, None, [1], 0),
        (vector.dot, [1, 2, 3], [4, 5, 6], 32), (vector.dot, None, None, 0), (vector.euclidean, [0, 0], [3, 4], 5), (vector.euclidean, [1, 2], [1, 2], 0), (vector.benchmark_cosine, [1e-9, 0], [1e-9, 0], 0),
    ],
)
def test_similarity(spark, f, a, b, expect):
    floats = lambda v: None if v is None else [float(x) for x in v]
    assert math.isclose(one(spark, f("a", "b"), a=floats(a), b=floats(b)), expect, abs_tol=1e-5)


def test_lengths_must_agree(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="length"):
        retrieve.pair_scores(df).collect()
    with pytest.raises(ValueError):
        retrieve.pair_scores(df, "other")


def test_normalize_pool_quantize(spark):
    assert one(spark, vector.l2_normalize("v"), v=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, vector.l2_normalize("v"), v=[0.0, 0.0]) == [0, 0]
    tokens = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "t array<array<float>>, m array<int>")
    assert [r[0] for r in tokens.select(vector.mean_pool("t", "m")).collect()] == [[2, 3], [0, 0]]
    assert tokens.select(vector.cls_pool("t")).first()[0] == [1, 2]
    assert one(spark, vector.quantize_int8("v"), v=[0.0, 0.5, 1.0]) == [-128, 0, 127]
    assert one(spark, vector.quantize_int8("v"), v=[2.0, 2.0]) == [0, 0]
    for k in (0, 4):
        with pytest.raises(ValueError):
            vector.truncate("v", k, 3)
    half = one(spark, vector.as_float("v", "float16"), v=[1.0, 0.1])
    assert np.frombuffer(bytes(half), np.float16).tolist() == [1.0, np.float16(0.1)]
    with pytest.raises(ValueError):
        vector.as_float("v", "int8")


def test_truncate_is_a_prefix(spark):
    s, v = 1, []
    for _ in range(256):
        s = (s * 1664525 + 1013904223) % 2**32
        v.append(((s >> 8) & 0xFFFF) / 32768 - 1)
    v = np.array(v, np.float32).tolist()
    for k in (256, 64, 1):
        assert one(spark, vector.truncate("v", k), v=v) == v[:k]
        got = np.array(one(spark, vector.l2_normalize(vector.truncate("v", k)), v=v))
        want = np.array(v[:k]) / np.linalg.norm(v[:k])
        assert np.abs(got - want).max() < 1e-6


def test_search_does_not_depend_on_partitions_or_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(90)] + [(90, [0.0] * 8), (91, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    q = df.where("id % 9 = 0")
    results = [sorted(map(tuple, retrieve.search(q, df.repartition(n), 5, same_table=True, query_bytes=b).select("q", "d", "rank").collect())) for n, b in ((1, 1 << 20), (3, 1 << 20), (8, 200))]
    assert results[0] == results[1] == results[2] and len(results[0]) == 55
    exact = {r["j"]: r["score"] for r in retrieve.pair_scores(retrieve.neighbour_pairs(df.where("v is not null"))).where("i = 0").collect()}
    best = sorted(exact, key=lambda j: (-exact[j], j))[:5]
    assert [d for a, d, _ in sorted((r for r in results[0] if r[0] == 0), key=lambda r: r[2])] == best


def test_sparse_prune_and_order(spark):
    rows = [(1, t, w) for t, w in ((5, 0.2), (3, 0.9), (9, 0.9), (7, 0.4))]
    p = spark.createDataFrame(rows, "id int, term int, weight double")
    assert [r["term"] for r in sparse.prune(p, 0.3, 2).orderBy("term").collect()] == [3, 9]
    assert sparse.to_struct(p).first()["indices"] == [3, 9, 7, 5]
    assert sparse.to_struct(p, sparse.INDEX_ORDER).first()["indices"] == [3, 5, 7, 9]
    back = sparse.to_postings(sparse.to_struct(p))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    with pytest.raises(ValueError):
        sparse.prune(p, -1)
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    assert {r["id"]: r["cosine"] for r in sparse.cosines(p, p, ids).collect()} == pytest.approx({1: 1.0, 2: 1.0})


def test_search_fills_with_zero_scores(spark):
    docs = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0), (3, "c", 1.0)], "id int, term string, weight double")
    got = retrieve.sparse_search(sparse.to_struct(docs.where("id = 3")), sparse.to_struct(docs), 3).orderBy("rank").collect()
    assert [(r["d"], r["score"]) for r in got] == [(3, 1.0), (1, 0.0), (2, 0.0)]


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "q int, d string, rank int")
    qrels = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (1, "z", 1), (2, "y", 1)], "q int, d string, grade int")
    value = lambda df: {r[0]: r[1] for r in df.collect()}
    dcg = 3 / math.log2(3) + 1 / math.log2(4)
    ideal = 3 + 1 / math.log2(3) + 1 / math.log2(4)
    assert value(metrics.ndcg(ranked, qrels)) == pytest.approx({1: dcg / ideal, 2: 0})
    assert value(metrics.ndcg(ranked, qrels, ideal="list"))[1] == pytest.approx(dcg / (3 + 1 / math.log2(3)))
    assert value(metrics.recall(ranked, qrels, 3)) == pytest.approx({1: 2 / 3, 2: 0})
    assert value(metrics.mrr(ranked, qrels)) == {1: 0.5, 2: 0}
    assert value(metrics.average_precision(ranked, qrels)) == pytest.approx({1: (1 / 2 + 2 / 3) / 2, 2: 0})
    assert value(metrics.hit_at(ranked, qrels)) == {1: 1, 2: 0}


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 10)], "g string, v double")
    assert df.agg(metrics.percentile_linear("v", 0.95)).first()[0] == pytest.approx(9.2)
    assert df.where("false").agg(metrics.percentile_linear("v", 0.95)).first()[0] == 0
    for rule, expect in (("nearest", 10), ("floor", 2), ("index", 10)):
        assert metrics.percentile_nearest(df, "v", 0.95, ["g"], rule).first()["value"] == expect
    assert metrics.upper_median(df, "v", ["g"]).first()["value"] == 2


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 60), st.integers(0, 60), st.integers(0, 40))
def test_pair_lengths_follow_the_loop(na, nb, budget):
    a, b = na, nb
    while a + b > budget:
        if a > b:
            a -= 1
        else:
            b -= 1
    kb = min(nb, max(budget - na, budget // 2)) if na + nb > budget else nb
    ka = min(na, budget - kb) if na + nb > budget else na
    assert (ka, kb) == (a, b)


def test_encoding(spark):
    df = spark.createDataFrame([(list(range(10)), list(range(20, 40)))], "a array<int>, b array<int>")
    assert df.select(text.encode_single("a", 101, 102, 5)).first()[0] == [101, 0, 1, 2, 102]
    ids, types = text.encode_pair("a", "b", 101, 102, 13)
    r = df.select(ids.alias("i"), types.alias("t")).first()
    assert r["i"] == [101, 0, 1, 2, 3, 4, 102, 20, 21, 22, 23, 24, 102] and r["t"] == [0] * 7 + [1] * 6
    padded = text.pad_batch(spark.createDataFrame([(1, [1, 2]), (1, [1, 2, 3])], "g int, ids array<int>"), "ids", ["g"]).orderBy(F.size("ids")).collect()
    assert padded[0]["padded"] == [1, 2, 0] and padded[0]["mask"] == [1, 1, 0]


EDGE = ["", "   ", "\t\t", "a\r\nb", "\U0001f600 \U0001f1e9\U0001f1ea", "\u05e9\u05dc\u05d5\u05dd", "zero\u200bwidth", "e\u0301", "x" * 1000, "word " * 2000, "\x07bell"]


def test_edge_texts(spark):
    df = spark.createDataFrame(list(enumerate(EDGE)), "id int, text string")
    got = {r["id"]: r["w"] for r in df.select("id", text.basic_tokenize("text").alias("w")).collect()}
    assert got[0] == got[1] == got[2] == [] and got[3] == ["a", "b"] and got[6] == ["zerowidth"] and got[10] == ["bell"] and len(got[9]) == 2000
    han = spark.createDataFrame([("ab\u4e2d\u6587c, d",)], "t string").select(text.basic_tokenize("t")).first()[0]
    assert han == ["ab", "\u4e2d", "\u6587", "c", ",", "d"]
    assert spark.createDataFrame([("a b",)], "t string").select(text.metaspace("t")).first()[0] == ["\u2581a", "\u2581b"]
    for provider in (providers.HashingProvider(16),):
        whole = providers.embed(df, provider).orderBy("id").collect()
        single = [provider.embed([t])[0] for t in EDGE]
        assert all(np.allclose(r["embedding"], v) for r, v in zip(whole, single, strict=True))


def test_hashed_words_never_cancel_wholly(spark):
    provider = providers.HashingProvider(64)
    texts = ["Anouble thwh.", "\u00a0", "\x0b", "a\u3000b c", " \t\n\f\r", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["embedding"] for r in providers.embed(df, provider).collect()}
    assert [got[i] and round(float(np.linalg.norm(got[i])), 3) for i in range(7)] == [1.0, 1.0, 1.0, 1.0, 0.0, 0.0, None]
    assert provider.lengths(texts[:6]) == [2, 1, 1, 2, 0, 0]


def test_subwords():
    vocab = {"un": 1, "##aff": 2, "##able": 3, "hello": 4}
    assert subword.wordpiece("unaffable", vocab, 0) == [1, 2, 3] and subword.wordpiece("unknown", vocab, 0) == [0] and subword.wordpiece("h" * 101, vocab, 0) == [0] and subword.wordpiece("hello", vocab, 0) == [4]
    ids = {s: i for i, s in enumerate("abc") } | {"ab": 9, "abc": 8}
    assert subword.bpe(list("abcab"), {("a", "b"): 0, ("ab", "c"): 1}, ids, 7) == [8, 9]
    assert subword.bpe(list("aaa"), {("a", "a"): 0}, {"aa": 5, "a": 0}, 7) == [5, 0]
    scores = {"a": -1.0, "b": -1.0, "ab": -1.5}
    assert subword.unigram("abxyb", scores, {"a": 1, "b": 2, "ab": 3}, 0) == [3, 0, 2]
    assert subword.unigram("x", scores, {}, 0, {120: 77}) == [77]
    assert subword.decode_utf8(b"a\xff\xc3\xa9\xed\xa0\x80") == "a\xffé\xed\xa0\x80"
    assert subword.bert_normalize("Crème Ångström") == "creme angstrom" and subword.bert_normalize("É", lower=False, strip=False) == "É"
    assert len(subword.fnv1a("")) == 16 and subword.fnv1a("a") != subword.fnv1a("b")


def charsmap(pairs):
    """A map of one-byte and two-byte keys, laid out by trial."""
    units, texts = [0] * 1024, b""
    used = {0}

    def place(at, children):
        base = next(b for b in range(256, 1024) if all((b ^ c) not in used and (b ^ c) < 1024 for c in children) and not (at ^ b) >> 21)
        used.update(base ^ c for c in children)
        units[at] |= (at ^ base) << 10
        return base

    tree = {}
    for k, v in pairs.items():
        raw = k.encode()
        node = tree
        for b in raw:
            node = node.setdefault(b, {})
        node[0] = len(texts)
        texts += v.encode() + b"\0"

    def lay(at, node):
        base = place(at, list(node))
        for b, child in node.items():
            if b == 0:
                units[base] = 1 << 31 | child
                units[at] |= 1 << 8
            else:
                units[base ^ b] |= b
                lay(base ^ b, child)

    lay(0, tree)
    return (4 * 1024).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + texts


def test_character_map():
    change = subword.Charsmap(charsmap({"a": "x", "é": "e", "e\u0301": "E"}))
    assert change("abé") == "xbe" and change("e\u0301!") == "E!" and change("") == "" and change("e") == "e"
    with pytest.raises(ValueError):
        subword.Charsmap(b"\xff\xff\xff\x7f")


def test_vocabulary_and_legacy_tokens(spark):
    assert subword.load_vocab(["The", "the", "Été"]) == {"the": 0, "ete": 2} and subword.load_vocab(["The", "the"], lower=False) == {"The": 0, "the": 1}
    got = spark.createDataFrame([("Crème brûlée, ÆØ ıſ Ā-x\x07y",)], "t string").select(text.legacy_tokenize("t")).first()[0]
    assert got == ["creme", "brulee", ",", "Æ", "Ø", "is", "Ā", "-", "x", "y"]


def test_exact_ranks_of_any_values(spark):
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(size=30_000), "b": rng.integers(0, 4, 5000).astype(float), None: np.array([3.0]), "c": np.repeat([1.0, 2.0], [9000, 10]), "d": rng.exponential(size=77)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for p in (0.0, 0.003, 0.5, 0.95, 0.999, 1.0):
        for accuracy in (metrics.ACCURACY, 200):
            got = {r["g"]: r["x"] for r in metrics.values_at(df, "v", ["g"], {"x": (p, lambda n, p=p: F.floor(n * F.lit(p)))}, accuracy).collect()}
            assert got == {g: np.sort(v)[min(len(v) - 1, int(len(v) * p))] for g, v in groups.items()}
        got = {r["g"]: r["x"] for r in metrics.percentiles_linear(df, "v", ["g"], {"x": p}).collect()}
        assert got == pytest.approx({g: np.percentile(v, 100 * p) for g, v in groups.items()})
    every = np.concatenate(list(groups.values()))
    assert metrics.percentiles_linear(df, "v", [], {"x": 0.3}).first()[0] == pytest.approx(np.percentile(every, 30))
    whole = metrics.latency_summary(df, "v", []).first()
    assert (whole["n"], whole["max"]) == (len(every), every.max()) and whole["p95"] == pytest.approx(np.percentile(every, 95))


def test_budget_batches(spark):
    lengths = [300, 200, 200, 60, 50, 50, 1, 0]
    expect = batching.cut_by_budget(lengths, 16, 512)
    assert expect == [0, 1, 1, 2, 2, 2, 2, 2]
    df = spark.createDataFrame([(i, n, "s") for i, n in enumerate(lengths)], "id int, n int, s string")
    got = batching.budget_batches(df.repartition(3), "n", "id", 16, 512, ["s"]).orderBy("id").collect()
    assert [r["batch"] for r in got] == expect


def test_numbering_spans_partitions(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000)
    got = batching.fixed_batches(df, ["k"], 30)
    assert got.where(F.col("batch") != F.floor(F.col("k") / 30)).count() == 0
    assert batching.shards(df, ["k"], 7).groupBy("shard").count().agg(F.max("count"), F.count("*")).first() == (143, 7)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbering_keeps_every_row(spark, tmp_path, adaptive):
    n = 400_000
    spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.repeat(F.lit("word "), (F.col("id") % 23).cast("int")).alias("text")).repartition(8).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = batching.number_rows(df, ["k"])
        assert got.columns == ["k", "text", "_n"]
        assert got.agg(F.count("*"), F.sum((F.col("k") != F.col("_n")).cast("int")), F.countDistinct("_n")).first() == (n, 0, n)
        batches = batching.length_batches(df.withColumn("n", F.length("text")), "n", "k", 16)
        assert batches.groupBy("batch").count().groupBy("count").count().collect() == [(16, n // 16)]
        assert batching.shards(df, ["k"], 7).groupBy("shard").agg(F.count("*").alias("c"), F.min("k").alias("k")).orderBy("shard").collect()[-1] == (6, n - 6 * (-(-n // 7)), 6 * (-(-n // 7)))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_numbering_in_groups(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 3, i, str(i)) for i in range(100)], "g int, k int, text string")
    got = {r["k"]: r["n"] for r in batching.number_rows(df, ["k"], "n", by=["g"]).collect()}
    seen = {}
    for i in range(100):
        g = None if i % 5 == 0 else i % 3
        assert got[i] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + 1
    assert batching.number_rows(df.where("false"), ["k"]).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=80), st.integers(1, 9), st.integers(1, 600))
def test_budget_plan_is_the_scan(lengths, size, budget):
    lengths = sorted(lengths, reverse=True)
    counts = [(n, lengths.count(n)) for n in sorted(set(lengths), reverse=True)]
    steps = {n: (start, room, first) for n, start, room, first in batching.budget_plan(counts, size, budget)}
    got = [steps[n][2] - 1 if i < steps[n][0] else steps[n][2] + (i - steps[n][0]) // steps[n][1] for i, n in enumerate(lengths)]
    assert got == batching.cut_by_budget(lengths, size, budget)


def test_selection(spark):
    rows = [(0, True, 10.0, 12.0, 100.0, 50.0), (1, True, 9.8, 11.8, 103.0, 40.0), (2, False, 1.0, 1.0, 999.0, 1.0), (3, True, 5.0, 30.0, 60.0, 10.0)]
    m = spark.createDataFrame(rows, "idx int, valid boolean, p50_ms double, p95_ms double, throughput double, memory_mb double")
    assert tuning.select_best(m, "throughput").first()["idx"] == 0
    assert tuning.select_best(m, "memory").first()["idx"] == 3
    assert tuning.select_best(m, "latency", 0.5).count() == 0
    r = tuning.search(m, "latency", 0.5).first()
    assert (r["idx"], r["constraints_met"]) == (0, False)
    assert tuning.keep_baseline(m, "throughput", 1).first()["idx"] == 1
    with pytest.raises(ValueError):
        tuning.costs(m, "speed")
    runs = spark.createDataFrame([("s", i + 1, v) for i, v in enumerate((10.0, 20.0, 18.0, 18.5, 40.0))], "series string, sessions int, throughput double")
    assert tuning.plateau(runs).first().asDict() == {"series": "s", "sessions": 2, "best": 20.0, "measured": 4}
    quant = lambda *v: spark.createDataFrame([("m", k, x) for k, x in v], "model string, quantization string, docs_per_sec double")
    pick = lambda *v: tuning.pick_quantization(quant(*v)).first()["pick"]
    assert pick(("none", 100.0), ("dynamic", 104.0)) == "none"
    assert pick(("none", 100.0), ("dynamic", 120.0), ("static", 130.0)) == "dynamic"
    assert pick(("none", 100.0), ("dynamic", 110.0), ("static", 130.0)) == "static"
    assert pick(("dynamic", 120.0)) == "none"


def test_sample(spark):
    df = spark.createDataFrame([(i, " ".join(["w"] * (1, 20, 100)[i // 50])) for i in range(150)], "id int, text string")
    got = tuning.stratified_sample(df, "id", "text", 30)
    sizes = [len(r["text"].split()) for r in got.collect()]
    assert len(sizes) == 30 and min(sizes) < 10 and max(sizes) > 50 and got.select("id").distinct().count() == 30
    last, rest = tuning.split_workload(df, "id")
    assert last.first()["id"] == 149 and rest.count() == 149


def test_cache(spark):
    log = [("c", 0, "put", "a"), ("c", 1, "put", "b"), ("c", 2, "get", "a"), ("c", 3, "put", "c"), ("c", 4, "get", "b"), ("c", 5, "get", "a"), ("c", 6, "get", "c")]
    df = spark.createDataFrame([(*r, 0.0) for r in log], "cache string, seq long, op string, key string, at double")
    assert [r["hit"] for r in cache.replay(df, 2).where("op = 'get'").orderBy("seq").collect()] == [True, False, True, True]
    assert cache.replay(df, 0).where("hit").count() == 0
    c = cache.Lru(2, 1.0)
    c.put("k", [1.0, 2.0], 0.0)
    assert c.get("k", 1.0, dim=3) is None and c.get("k", 1.0) == [1.0, 2.0] and c.get("k", 1.1) is None and len(c) == 0


def test_registry(spark):
    assert {r["kind"]: r["count"] for r in registry.models(spark).groupBy("kind").count().collect()} == {"text": 45, "sparse": 2, "image": 6, "reranker": 5}
    assert registry.with_sizes(spark).where("size_mb is null").count() == 0
    assert registry.quantized_variant(spark, "BAAI/bge-small-en-v1.5", "dynamic").count() == 1
    with pytest.raises(ValueError, match="only"):
        registry.quantized_variant(spark, "BAAI/bge-m3", "dynamic")
    assert spark.createDataFrame([("C:\\m\\BGE-x",), ("a/mini",)], "p string").select(registry.infer_pooling("p")).collect() == [("cls",), ("mean",)]


def test_resolution(tmp_path):
    known = {"MiniLM-L6-Q4": "second-state/repo/file.gguf"}
    assert resolve.gguf_source("x/y.gguf", known, lambda p: True)[0] == "file"
    assert resolve.gguf_source("https://huggingface.co/o/r/resolve/main/f.gguf", known, lambda p: False) == ("url", "o/r", "f.gguf")
    assert resolve.gguf_source("minilm", known, lambda p: False) == ("registry", "second-state/repo", "file.gguf")
    assert resolve.gguf_source("o/f.gguf", known, lambda p: False) == ("shorthand", "o", "f.gguf")
    with pytest.raises(ValueError):
        resolve.gguf_source("https://example.com/x.gguf", known)
    (tmp_path / "a.gguf").touch()
    assert resolve.detect_backend(str(tmp_path)) == "llama" and resolve.detect_backend("m.onnx") == "onnx" and resolve.detect_backend("m", "llama") == "llama"
    assert resolve.pick_output(["x", "last_hidden_state"]) == 1 and resolve.pick_output(["only"]) == 0 and resolve.pick_output(["a", "text_embeds", "p"], "p") == 2
    with pytest.raises(FileNotFoundError):
        resolve.local_model("m", str(tmp_path))


def gguf(meta, tensors):
    s = lambda x: struct.pack("<Q", len(x)) + x.encode()
    out = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(meta))
    for k, v in meta.items():
        out += s(k) + (struct.pack("<I", 8) + s(v) if isinstance(v, str) else struct.pack("<II", 4, v))
    for name, shape in tensors.items():
        out += s(name) + struct.pack("<I", len(shape)) + struct.pack(f"<{len(shape)}Q", *shape) + struct.pack("<IQ", 0, 0)
    return out


def test_model_files(spark, tmp_path):
    bert = {"general.architecture": "bert", "bert.vocab_size": 30522, "bert.embedding_length": 384, "tokenizer.ggml.cls_token_id": 101}
    files = {
        "a": gguf(bert, {"token_embd.weight": [384, 30522], "mlm_transform.weight": [384, 384], "mlm_bias": [30522]}), "b": b"not a model", "c": gguf(bert, {"x": [1]}),
        "d": gguf({"general.architecture": "bert"}, {"token_embd.weight": [1], "sparse_linear.weight": [384, 1]}), "e": gguf(bert, {"token_embd.weight": [1], "sparse_linear.weight": [384, 1]})[:60],
    }
    for name, raw in files.items():
        (tmp_path / f"{name}.gguf").write_bytes(raw)
    got = {os.path.basename(r["path"])[0]: r for r in readers.inspect_gguf(spark, str(tmp_path)).collect()}
    assert (got["a"]["capabilities"], got["a"]["sparse_formula"], got["a"]["vocab_size"], got["a"]["diagnostic"]) == (1 | 2 | 4 | 64 | 128, "splade", 30522, "")
    assert got["b"]["capabilities"] == 0 and "not a readable" in got["b"]["diagnostic"]
    assert got["c"]["capabilities"] == 0 and "token_embd" in got["c"]["diagnostic"]
    assert got["d"]["capabilities"] == 1 and got["d"]["sparse_formula"] == "unknown" and got["d"]["diagnostic"]
    assert got["e"]["diagnostic"]


def test_collections(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("".join(f'{{"_id": "{i}", "title": "{"T" if i else ""}", "text": "t{i}"}}\n' for i in range(6)))
    (tmp_path / "queries.jsonl").write_text("".join(f'{{"_id": "{i}", "text": "q{i}"}}\n' for i in (10, 9, 2)))
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\n10\t5\t1\n9\t4\t2\n9\t3\t0\n2\t1\t1\n")
    docs, queries, qrels = readers.load_collection(spark, str(tmp_path), max_docs=3, max_queries=2)
    assert sorted(r["q"] for r in queries.collect()) == ["2", "9"] and sorted(r["d"] for r in qrels.collect()) == ["1", "4"]
    assert sorted((r["d"], r["text"]) for r in docs.collect()) == [("0", "t0"), ("1", "T t1"), ("4", "T t4")]


def test_stores_and_reports(spark, tmp_path):
    v = readers.read_csr(spark, np.array([0, 2, 2]), np.array([3, 7]), np.array([0.5, 1.0]))
    readers.write_sparse(v, str(tmp_path / "s"))
    assert [r["indices"] for r in readers.read_sparse(spark, str(tmp_path / "s")).orderBy("id").collect()] == [[3, 7], []]
    rows = spark.createDataFrame([("k", "cpu", 1, 5.0), ("k", "cpu", 2, 7.0), ("o", "other", 1, 1.0)], "key string, brand string, at int, rate double")
    readers.write_tuning(rows, str(tmp_path / "t"))
    assert [(r["key"], r["rate"]) for r in readers.read_tuning(spark, str(tmp_path / "t"), {"brand": "cpu"}).collect()] == [("k", 7.0)]
    assert "| k | cpu | 1 | 5.0 |" in readers.report_markdown(rows) and '"rate": 5.0' in readers.report_json(rows, {})
    files = spark.createDataFrame([("a", "p", 3), ("b", "q", 4)], "model string, path string, size long")
    assert readers.stale_files(files, files.where("model = 'a'")).first().asDict() == {"n": 1, "bytes": 4}
    image = readers.preprocess_image(np.full((300, 500, 3), 255, np.uint8))
    assert image.shape == (3, 224, 224) and np.allclose(image[:, 0, 0], (1 - np.array(readers.IMAGE_MEAN)) / np.array(readers.IMAGE_STD))
    assert corpora.corpora(spark).where("category = 'edge' and text = ''").count() == 1
    texts, queries, qrels = corpora.answers(spark)
    assert (texts.count(), queries.count(), qrels.count()) == (12, 7, 14)


def test_embed_missing(spark):
    provider = providers.HashingProvider(8)
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "c"), (4, None)], "id int, text string")
    cached = providers.embed(df.where("id = 1").select("text"), provider)
    got = {r["id"]: r["embedding"] for r in providers.embed_missing(df.where("text is not null"), cached, provider).collect()}
    assert np.allclose(got[2], provider.embed(["c"])[0]) and got[2] == got[3] and len(got) == 3
    assert providers.embed(df, provider).where("id = 4").first()["embedding"] is None
    counts = Observation()
    providers.observed(providers.embed(df, provider), counts).collect()
    assert counts.get == {"texts": 4, "embedded": 3, "skipped": 1}
    assert df.select(retrieve.joined_pair(F.lit("q"), F.col("text")).alias("p")).first()["p"] == "q [SEP] a b"


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), []
    spark.createDataFrame([(i, f"text {i}") for i in range(10)], "id long, text string").repartition(3).write.parquet(source)
    stream = streaming.read_stream(spark, source, "id long, text string", 1)
    query = streaming.embed_stream(stream, providers.HashingProvider(4), lambda df, n: out.extend((n, r["id"], len(r["embedding"])) for r in df.collect()), str(tmp_path / "c"), availableNow=True)
    query.awaitTermination(120)
    assert sorted(i for _, i, _ in out) == list(range(10)) and {d for *_, d in out} == {4} and len({n for n, *_ in out}) > 1
    ordered = [r["id"] for r in streaming.embed_rows(spark.read.parquet(source), providers.HashingProvider(4))]
    assert ordered == list(range(10))


def test_expiring_state(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 0.0), ("a", 5.0), ("a", 20.0), ("b", 1.0)], "key string, at double").coalesce(1).write.parquet(source)
    stream = streaming.expiring_hits(spark.readStream.schema("key string, at double").parquet(source), 10.0)
    query = stream.writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("select key, at, hit from hits").collect())) == [("a", 0.0, False), ("a", 5.0, True), ("a", 20.0, False), ("b", 1.0, False)]


def field(number, value):
    """One protobuf field: an integer, or bytes with their length."""
    def varint(n):
        out = b""
        while True:
            n, low = n >> 7, n & 127
            if not n:
                return out + bytes([low])
            out += bytes([low | 128])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def gather_model(table):
    """A model that looks each id up in a table of vectors."""
    info = lambda name, kind, dims: field(1, name) + field(2, field(1, field(1, kind) + field(2, b"".join(field(1, field(2, d)) for d in dims))))
    weights = b"".join(field(1, d) for d in table.shape) + field(2, 1) + field(8, "table") + field(9, table.astype("<f4").tobytes())
    node = field(1, "table") + field(1, "input_ids") + field(2, "last_hidden_state") + field(4, "Gather")
    graph = field(1, node) + field(2, "g") + field(5, weights) + field(11, info("input_ids", 7, "bs")) + field(11, info("attention_mask", 7, "bs")) + field(12, info("last_hidden_state", 1, "bsd"))
    return field(1, 8) + field(8, field(1, "") + field(2, 13)) + field(7, graph)


@pytest.mark.parametrize("pooling", ["mean", "cls"])
def test_onnx_provider(spark, tmp_path, pooling):
    from tokenizers import Tokenizer, models, pre_tokenizers

    table = np.array([[0, 0, 1], [1, 0, 0], [0, 2, 0]], np.float32)
    (tmp_path / "model.onnx").write_bytes(gather_model(table))
    tokenizer = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "b": 2}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    provider = providers.OnnxProvider(str(tmp_path / "model.onnx"), str(tmp_path / "tokenizer.json"), 3, pooling=pooling)
    df = spark.createDataFrame([(1, "a b"), (2, "b"), (3, "a a a z")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in providers.embed(df, provider).collect()}
    for i, t in ((1, [1, 2]), (2, [2]), (3, [1, 1, 1, 0])):
        v = table[t].mean(axis=0) if pooling == "mean" else table[t[0]]
        assert np.allclose(got[i], v / np.linalg.norm(v), atol=1e-6)
    with pytest.raises(ValueError):
        providers.OnnxProvider("m", "t", 3, pooling="max")
    with pytest.raises(ValueError):
        resolve.check_provider("cuda", ["cpu"])
