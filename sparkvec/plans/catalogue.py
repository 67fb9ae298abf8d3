"""Queries over the driver's tables, one for each operator, and the SQL that checks them. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.functions import subword, text, vector
from sparkvec.operators import batching, cache, metrics, retrieve, sparse, tuning
from sparkvec.plans import registry, resolve
from sparkvec.plans.providers import HashingProvider, embed
from sparkvec.sources import corpora
from sparkvec.storage import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Searches take as queries every row whose id this divides, against all rows.
EVERY = 100


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


#: Tables of texts, which are work for more than one task even when they are small.
TEXTS = ("documents", "conversations")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(table) if name in TEXTS else table


# Dense vectors

_DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
_V = "e.embedding"


def _dot(a: str, b: str) -> str:
    return _DOT.format(a, b)


def _cos(a: str, b: str) -> str:
    return f"{_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}))"


_NEXT = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _next(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("i"), F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("i"), F.col("embedding").alias("b"))
    return a.join(b, "i")


def _pair_query(kind: str, sql: str) -> None:
    query(f"vec_{kind}_pairs", f"SELECT a.vec_id AS i, round({sql}, 6) AS score {_NEXT}")(
        lambda spark, sf: retrieve.pair_scores(_next(spark, sf), kind).select("i", F.round("score", 6).alias("score"))
    )


_pair_query("dot", _dot("a.embedding", "b.embedding"))
_pair_query("cosine", _cos("a.embedding", "b.embedding"))
_pair_query("benchmark_cosine", _cos("a.embedding", "b.embedding"))
_pair_query("l2", "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))")


def _exploded(df: DataFrame, key: str, values: str) -> DataFrame:
    return df.select(key, F.posexplode(values).alias("pos", "x")).select(key, "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


_UNNEST = "SELECT {key}, CAST(i AS INT) AS pos, round(CAST(v[i + 1] AS DOUBLE), 6) AS x FROM (SELECT {key}, v, unnest(range(0, len(v))) AS i FROM ({inner}))"


def _unnest(inner: str, key: str = "vec_id") -> str:
    return _UNNEST.format(key=key, inner=inner)


@query("vec_l2_normalize", _unnest("SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / n) AS v FROM (SELECT *, sqrt(" + _dot("embedding", "embedding") + ") AS n FROM embeddings)"))
def _(spark, sf):
    e = read(spark, sf, "embeddings").withColumn("n", vector.norm("embedding"))
    return _exploded(e.select("vec_id", vector.scale("embedding", F.col("n")).alias("v")), "vec_id", "v")


@query("vec_truncate_renorm", _unnest("SELECT vec_id, list_transform(p, lambda x: x::DOUBLE / sqrt(" + _dot("p", "p") + ")) AS v FROM (SELECT vec_id, embedding[1:32] AS p FROM embeddings)"))
def _(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", vector.truncate("embedding", 32, 64).alias("p")).withColumn("n", vector.norm("p"))
    return _exploded(e.select("vec_id", vector.scale("p", F.col("n")).alias("v")), "vec_id", "v")


@query("vec_truncate_prefix", _unnest("SELECT vec_id, embedding[1:16] AS v FROM embeddings"))
def _(spark, sf):
    return _exploded(read(spark, sf, "embeddings").select("vec_id", vector.truncate("embedding", 16).alias("v")), "vec_id", "v")


_INT8 = "SELECT vec_id, embedding, lo, hi, list_transform(embedding, lambda x: CASE WHEN hi > lo THEN trunc((x::DOUBLE - lo) / (hi - lo) * 255 - 128) ELSE 0 END) AS v FROM (SELECT *, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)"


@query("vec_quant_int8", _unnest(_INT8))
def _(spark, sf):
    return _exploded(read(spark, sf, "embeddings").select("vec_id", vector.quantize_int8("embedding").alias("v")), "vec_id", "v")


@query("vec_dequant_error", f"SELECT vec_id, round(list_max(list_transform(list_zip(v, embedding), lambda z: abs((z[1] + 128) / 255 * (hi - lo) + lo - z[2]::DOUBLE))), 6) AS error FROM ({_INT8})")
def _(spark, sf):
    e = read(spark, sf, "embeddings").withColumn("q", vector.quantize_int8("embedding"))
    back = vector.dequantize_int8("q", F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double"))
    e = e.withColumn("back", back)
    return e.select("vec_id", F.round(F.array_max(F.zip_with("back", "embedding", lambda x, y: F.abs(x - y))), 6).alias("error"))


@query("vec_int8_cosine", f"WITH q AS ({_INT8}) SELECT a.vec_id AS i, round({_cos('a.v', 'b.v')}, 6) AS score FROM q a JOIN q b ON b.vec_id = a.vec_id + 1")
def _(spark, sf):
    pairs = _next(spark, sf).select("i", vector.quantize_int8("a").alias("a"), vector.quantize_int8("b").alias("b"))
    return retrieve.pair_scores(pairs).select("i", F.round("score", 6).alias("score"))


def _tensor(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as eight tokens of eight dimensions, some of them masked."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((F.col("vec_id") + i) % 3 == 0, 0).otherwise(1))
    return read(spark, sf, "embeddings").select("vec_id", tokens.alias("tokens"), mask.alias("mask"))


@query("pool_cls", _unnest("SELECT vec_id, embedding[1:8] AS v FROM embeddings"))
def _(spark, sf):
    return _exploded(_tensor(spark, sf).select("vec_id", vector.cls_pool("tokens").alias("v")), "vec_id", "v")


@query("pool_mean", "SELECT vec_id, CAST(j AS INT) AS pos, round(avg(embedding[i * 8 + j + 1]::DOUBLE), 6) AS x FROM embeddings, range(8) a(i), range(8) b(j) WHERE (vec_id + i) % 3 <> 0 GROUP BY vec_id, j")
def _(spark, sf):
    return _exploded(_tensor(spark, sf).select("vec_id", vector.mean_pool("tokens", "mask").alias("v")), "vec_id", "v")


@query("vec_float16")
def _(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.hex(vector.as_float("embedding", "float16")).alias("halves"), F.hex(vector.to_bytes("embedding")).alias("floats"))


def _knn(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieve.search(e.where(F.col("id") % EVERY == 0), e, 10, kind, same_table=True)


def _knn_sql(score: str) -> str:
    return f"SELECT q, d, score, rank FROM (SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS d, {score} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 10"


_KNN_COS, _KNN_DOT = _knn_sql(_cos("a.embedding", "b.embedding")), _knn_sql(_dot("a.embedding", "b.embedding"))
for _kind, _knn_text in (("cosine", _KNN_COS), ("dot", _KNN_DOT)):
    query(f"knn_top10_{_kind}", f"SELECT q, d, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ({_knn_text})")(
        lambda spark, sf, kind=_kind: _knn(spark, sf, kind).select("q", "d", F.round("score", 6).alias("score"), "rank")
    )

@query("pairwise_similarity", f"SELECT a.vec_id AS i, b.vec_id AS j, round({_cos('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def _(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieve.pair_cosines(e, digits=6)


_IMAGES = _knn_sql(_cos("a.embedding", "b.embedding")).replace("a.vec_id <> b.vec_id", "b.vec_id % 2 = 1")


@query("cross_modal_top10", f"SELECT q, d, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ({_IMAGES})")
def _(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return _rounded(retrieve.cross_modal(e.where(F.col("id") % EVERY == 0), e.where("id % 2 = 1"), 10), "score").select("q", "d", "score", "rank")


# Sparse vectors: terms of whole documents

_PAT = text.BASIC_ASCII.replace("'", "''")
_TOKENS = f"SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '{_PAT}') AS w FROM documents"
_TF = f"SELECT id, term, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT id, unnest(w) AS term FROM ({_TOKENS})) GROUP BY id, term"
_LOGITS = f"SELECT id, i AS pos, w[i + 1] AS term, ((i * 7 + length(w[i + 1])) % 11 - 3) / 4.0 AS logit FROM (SELECT id, w, unnest(range(0, len(w))) AS i FROM ({_TOKENS}))"
_SPLADE = f"SELECT id, term, ln(1 + max(logit)) AS weight FROM ({_LOGITS}) GROUP BY id, term HAVING max(logit) > 0"
_PRUNED = f"SELECT id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, term) AS r FROM ({_SPLADE}) WHERE weight >= 0.3) WHERE r <= 10"


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(text.BASIC_ASCII_JVM), F.lit(0))
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), words.alias("w"))


def _tf(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("id", F.explode(sparse.term_counts("w")).alias("e")).select("id", "e.term", "e.weight")


def _logits(spark: SparkSession, sf: str) -> DataFrame:
    logit = lambda t, i: F.struct(t.alias("term"), (((i * 7 + F.length(t)) % 11 - 3) / 4.0).alias("logit"))
    return _tokens(spark, sf).select("id", F.transform("w", logit).alias("logits"))


def _splade(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.splade_pool_rows(_logits(spark, sf))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


@query("sparse_splade_pool", f"SELECT id, term, round(weight, 6) AS weight FROM ({_SPLADE})")
def _(spark, sf):
    return _rounded(_splade(spark, sf), "weight")


@query("sparse_scalar_pool", f"SELECT id, term, max(logit) AS weight FROM ({_LOGITS}) GROUP BY id, term HAVING max(logit) > 0")
def _(spark, sf):
    return sparse.scalar_max_pool_rows(_logits(spark, sf))


@query("sparse_splade_postings", f"SELECT id, term, round(weight, 6) AS weight FROM ({_SPLADE})")
def _(spark, sf):
    return _rounded(sparse.splade_pool(_logits(spark, sf).select("id", F.inline("logits"))), "weight")


@query("sparse_prune", f"SELECT id, term, round(weight, 6) AS weight FROM ({_PRUNED})")
def _(spark, sf):
    return _rounded(sparse.prune(_splade(spark, sf).withColumn("weight", F.round("weight", 9)), 0.3, 10), "weight")


@query("sparse_threshold", f"SELECT id, term, weight FROM ({_TF}) WHERE weight > 5")
def _(spark, sf):
    return sparse.extract_over(_tf(spark, sf), 5)


@query("sparse_drop_special", f"SELECT id, term, weight FROM ({_TF}) WHERE term NOT IN ('the', 'of', '.')")
def _(spark, sf):
    return sparse.drop_special(_tf(spark, sf), ["the", "of", "."])


for _order, _by in ((sparse.DICT, "weight DESC, term"), (sparse.INDEX_ORDER, "term")):
    query(
        f"sparse_{_order}_order" if _order == "dict" else f"sparse_{_order}",
        f"SELECT id, string_agg(term, ' ' ORDER BY {_by}) AS terms, string_agg(CAST(CAST(weight AS BIGINT) AS VARCHAR), ' ' ORDER BY {_by}) AS weights FROM ({_TF}) GROUP BY id",
    )(
        lambda spark, sf, order=_order: sparse.to_struct(_tf(spark, sf), order).select(
            "id", F.array_join("indices", " ").alias("terms"), F.array_join(F.transform("values", lambda x: x.cast("long").cast("string")), " ").alias("weights")
        )
    )


@query("sparse_finish", f"SELECT id, string_agg(term, ' ' ORDER BY term) AS terms FROM (SELECT * FROM ({_TF}) WHERE term NOT IN ('the', '.') AND weight >= 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) <= 5) GROUP BY id")
def _(spark, sf):
    own = sparse.Options(special=("the", "."), min_weight=1.0, top_k=5)
    return sparse.finish(_tf(spark, sf), own, min_weight=2.0, top_k=None, order=sparse.INDEX_ORDER).select("id", F.array_join("indices", " ").alias("terms"))


@query("sparse_csr", f'SELECT id, n AS nnz, CAST(sum(n) OVER (ORDER BY id) - n AS BIGINT) AS "offset" FROM (SELECT id, count(*) AS n FROM ({_TF}) GROUP BY id)')
def _(spark, sf):
    return sparse.to_csr(sparse.to_struct(_tf(spark, sf), sparse.INDEX_ORDER)).select("id", F.size("indices").cast("long").alias("nnz"), "offset")


@query("sparse_coo", f'SELECT id AS "row", term AS col, weight AS "value" FROM ({_TF})')
def _(spark, sf):
    return sparse.to_coo(sparse.to_struct(_tf(spark, sf)))


@query("sparse_sparsity", f"SELECT id, CAST(count(*) AS INT) AS nnz, round(count(*) / 30522, 6) AS density FROM ({_TF}) GROUP BY id")
def _(spark, sf):
    return _rounded(sparse.sparsity(sparse.to_struct(_tf(spark, sf)), 30522), "density")


_DOTS = f"SELECT q.id AS q, d.id AS d, sum(q.weight * d.weight) AS score FROM tf q JOIN tf d ON q.term = d.term WHERE q.id % {EVERY} = 0 GROUP BY q.id, d.id"
_SPARSE_TOP = f"SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM (SELECT a.id AS q, b.id AS d, coalesce(s.score, 0) AS score FROM (SELECT DISTINCT id FROM tf WHERE id % {EVERY} = 0) a CROSS JOIN (SELECT DISTINCT id FROM tf) b LEFT JOIN ({_DOTS}) s ON s.q = a.id AND s.d = b.id) QUALIFY rank <= 20"


def _sparse_top(spark: SparkSession, sf: str) -> DataFrame:
    tf = sparse.counted_rows(_tokens(spark, sf).where(F.size("w") > 0), "w")
    return retrieve.sparse_search(tf.where(F.col("id") % EVERY == 0), tf, 20)


@query("sparse_dot_search", f"WITH tf AS MATERIALIZED ({_TF}) SELECT q, d, score, CAST(rank AS INT) AS rank FROM ({_SPARSE_TOP})")
def _(spark, sf):
    return _sparse_top(spark, sf)


@query("sparse_cosine", f"WITH a AS MATERIALIZED ({_SPLADE}), b AS MATERIALIZED ({_PRUNED}), n AS (SELECT id, sqrt(sum(weight * weight)) AS n FROM a GROUP BY id), m AS (SELECT id, sqrt(sum(weight * weight)) AS n FROM b GROUP BY id), p AS (SELECT a.id, sum(a.weight * b.weight) AS dot FROM a JOIN b ON a.id = b.id AND a.term = b.term GROUP BY a.id) SELECT d.doc_id AS id, round(CASE WHEN coalesce(n.n, 0) > 0 AND coalesce(m.n, 0) > 0 THEN coalesce(dot, 0) / (n.n * m.n) WHEN coalesce(n.n, 0) = coalesce(m.n, 0) THEN 1 ELSE 0 END, 6) AS cosine FROM documents d LEFT JOIN n ON d.doc_id = n.id LEFT JOIN m ON d.doc_id = m.id LEFT JOIN p ON d.doc_id = p.id")
def _(spark, sf):
    a = _splade(spark, sf)
    b = sparse.prune(a.withColumn("weight", F.round("weight", 9)), 0.3, 10)
    return _rounded(sparse.cosines(a, b, read(spark, sf, "documents").select(F.col("doc_id").alias("id"))), "cosine")


@query("hybrid_search", f"WITH tf AS MATERIALIZED ({_TF}), x AS ({_KNN_DOT}), y AS ({_SPARSE_TOP}) SELECT coalesce(x.q, y.q) AS q, coalesce(x.d, y.d) AS d, round(0.5 * coalesce(x.score, 0) + 0.5 * coalesce(y.score, 0), 6) AS score FROM x FULL JOIN y ON x.q = y.q AND x.d = y.d")
def _(spark, sf):
    return _rounded(retrieve.hybrid(_knn(spark, sf, "dot"), _sparse_top(spark, sf)), "score")


# Retrieval quality: an item is relevant to a query of its label, grade 2 if its id is even


_RANKED, _RANKED_DOT = f"SELECT q, d, rank FROM ({_KNN_COS})", f"SELECT q, d, rank FROM ({_KNN_DOT})"
_QRELS = f"SELECT a.vec_id AS q, b.vec_id AS d, CASE WHEN b.vec_id % 2 = 0 THEN 2 ELSE 1 END AS grade FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0"
_WITH = f"WITH r AS MATERIALIZED ({_RANKED}), g AS MATERIALIZED ({_QRELS}), j AS MATERIALIZED (SELECT r.*, coalesce(g.grade, 0) AS grade FROM r LEFT JOIN g ON r.q = g.q AND r.d = g.d), qs AS (SELECT DISTINCT q FROM r) "


def _qrels(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    a = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("q"), "label")
    b = e.select(F.col("vec_id").alias("d"), "label")
    return a.join(b, "label").where("q <> d").select("q", "d", F.when(F.col("d") % 2 == 0, 2).otherwise(1).alias("grade"))


def _ndcg_sql(gain: str, pool: str) -> str:
    return (
        _WITH + f"SELECT qs.q, round(CASE WHEN coalesce(i.v, 0) = 0 THEN 0 ELSE coalesce(c.v, 0) / i.v END, 6) AS ndcg FROM qs "
        f"LEFT JOIN (SELECT q, sum(({gain}) / log2(rank + 1)) AS v FROM j WHERE rank <= 10 GROUP BY q) c USING (q) "
        f"LEFT JOIN (SELECT q, sum(({gain}) / log2(p + 1)) AS v FROM (SELECT q, grade, row_number() OVER (PARTITION BY q ORDER BY grade DESC, d) AS p FROM {pool}) WHERE p <= 10 GROUP BY q) i USING (q)"
    )


for _name, _gain, _ideal, _sql in (("ndcg_exp", "exp", "qrels", "pow(2, grade) - 1"), ("ndcg_linear", "linear", "qrels", "grade"), ("ndcg_judged_list", "exp", "list", "pow(2, grade) - 1")):
    query(_name, _ndcg_sql(_sql, "g" if _ideal == "qrels" else "j"))(
        lambda spark, sf, gain=_gain, ideal=_ideal: _rounded(metrics.ndcg(_knn(spark, sf, "cosine"), _qrels(spark, sf), 10, gain, ideal), "ndcg")
    )


@query("recall_at_10", _WITH + "SELECT qs.q, round(coalesce(h.n, 0) / t.n, 6) AS recall FROM qs JOIN (SELECT q, count(*) AS n FROM g GROUP BY q) t USING (q) LEFT JOIN (SELECT q, count(*) AS n FROM j WHERE grade >= 1 AND rank <= 10 GROUP BY q) h USING (q)")
def _(spark, sf):
    return _rounded(metrics.recall(_knn(spark, sf, "cosine"), _qrels(spark, sf), 10), "recall")


@query("recall_at_100", f"WITH r AS MATERIALIZED ({_knn_sql(_cos('a.embedding', 'b.embedding')).replace('rank <= 10', 'rank <= 100')}), g AS MATERIALIZED ({_QRELS}) SELECT g.q, round(count(r.d) / count(*), 6) AS recall FROM g LEFT JOIN r ON r.q = g.q AND r.d = g.d GROUP BY g.q")
def _(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    ranked = retrieve.search(e.where(F.col("id") % EVERY == 0), e, 100, same_table=True)
    return _rounded(metrics.recall(ranked, _qrels(spark, sf), 100), "recall")


@query("recall_percent", _WITH + "SELECT qs.q, round(100 * coalesce(h.n, 0) / t.n, 6) AS recall FROM qs JOIN (SELECT q, count(*) AS n FROM g WHERE grade >= 2 GROUP BY q) t USING (q) LEFT JOIN (SELECT q, count(*) AS n FROM j WHERE grade >= 2 AND rank <= 5 GROUP BY q) h USING (q)")
def _(spark, sf):
    return _rounded(metrics.recall(_knn(spark, sf, "cosine"), _qrels(spark, sf), 5, 2).withColumn("recall", F.col("recall") * 100), "recall")


@query("hit3", _WITH + "SELECT q, CAST(max(CASE WHEN rank <= 3 AND grade > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS hit FROM j GROUP BY q")
def _(spark, sf):
    return metrics.hit_at(_knn(spark, sf, "cosine"), _qrels(spark, sf), 3)


@query("mrr_at_10", _WITH + "SELECT qs.q, round(coalesce(1.0 / f, 0), 6) AS rr FROM qs LEFT JOIN (SELECT q, min(rank) AS f FROM j WHERE grade > 0 GROUP BY q) USING (q)")
def _(spark, sf):
    return _rounded(metrics.mrr(_knn(spark, sf, "cosine"), _qrels(spark, sf), 10), "rr")


@query("average_precision", _WITH + "SELECT q, round(coalesce(avg(p), 0), 6) AS ap FROM (SELECT q, CASE WHEN grade > 0 THEN sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY rank) / rank END AS p FROM j) GROUP BY q")
def _(spark, sf):
    return _rounded(metrics.average_precision(_knn(spark, sf, "cosine"), _qrels(spark, sf)), "ap")


@query("topk_agreement", f"WITH a AS ({_RANKED}), b AS ({_RANKED_DOT}) SELECT a.q, round(count(b.d) / 10, 6) AS agreement FROM a LEFT JOIN b ON a.q = b.q AND a.d = b.d GROUP BY a.q")
def _(spark, sf):
    return _rounded(metrics.agreement(_knn(spark, sf, "cosine"), _knn(spark, sf, "dot"), 10), "agreement")


@query("score_correlation", "SELECT round(corr(x, y), 6) AS pearson FROM (SELECT " + _dot("a.embedding", "b.embedding") + " AS x, " + _cos("a.embedding", "b.embedding") + f" AS y {_NEXT})")
def _(spark, sf):
    pairs = _next(spark, sf).select(vector.dot("a", "b").alias("x"), vector.cosine("a", "b").alias("y"))
    return pairs.agg(F.round(F.corr("x", "y"), 6).alias("pearson"))


_COARSE = f"SELECT id, term, floor(weight * 10) / 10 AS weight FROM ({_SPLADE}) WHERE floor(weight * 10) / 10 > 0.3"


def _coarse(spark: SparkSession, sf: str) -> DataFrame:
    return _splade(spark, sf).withColumn("weight", F.floor(F.col("weight") * 10) / 10).where("weight > 0.3")


_BOTH = f"WITH a AS MATERIALIZED ({_SPLADE}), b AS MATERIALIZED ({_COARSE}), u AS (SELECT coalesce(a.id, b.id) AS id, a.weight AS x, b.weight AS y FROM a FULL JOIN b ON a.id = b.id AND a.term = b.term) "


@query("weight_bands", _BOTH + "SELECT CAST(CASE WHEN w < 0.1 THEN 0 WHEN w < 0.5 THEN 1 WHEN w < 1 THEN 2 WHEN w < 2 THEN 3 ELSE 4 END AS INT) AS band, count(*) AS terms, round(avg(d), 6) AS mean_delta, round(quantile_cont(d, 0.99), 6) AS p99_delta, round(max(d), 6) AS max_delta, round(max(d / w), 6) AS max_relative, CAST(sum(o) AS BIGINT) AS one_sided FROM (SELECT greatest(coalesce(x, 0), coalesce(y, 0)) AS w, abs(coalesce(x, 0) - coalesce(y, 0)) AS d, CASE WHEN x IS NULL OR y IS NULL THEN 1 ELSE 0 END AS o FROM u) GROUP BY 1")
def _(spark, sf):
    return _rounded(metrics.weight_bands(_splade(spark, sf), _coarse(spark, sf)), "mean_delta", "p99_delta", "max_delta", "max_relative")


@query("fidelity_summary", _BOTH + """, per AS (SELECT id, sum(coalesce(x, 0) * coalesce(y, 0)) AS dot, sqrt(sum(coalesce(x * x, 0))) AS n, sqrt(sum(coalesce(y * y, 0))) AS m, max(abs(coalesce(x, 0) - coalesce(y, 0))) AS diff, count(x) AS na, count(y) AS nb FROM u GROUP BY id),
ta AS (SELECT id, term FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, term) <= 10), tb AS (SELECT id, term FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, term) <= 10),
o AS (SELECT d.doc_id AS id, (SELECT count(*) FROM ta JOIN tb ON ta.id = tb.id AND ta.term = tb.term WHERE ta.id = d.doc_id) / greatest(1, (SELECT count(*) FROM ta WHERE ta.id = d.doc_id), (SELECT count(*) FROM tb WHERE tb.id = d.doc_id)) AS overlap FROM documents d),
c AS (SELECT d.doc_id AS id, CASE WHEN coalesce(n, 0) > 0 AND coalesce(m, 0) > 0 THEN dot / (n * m) WHEN coalesce(n, 0) = coalesce(m, 0) THEN 1.0 ELSE 0.0 END AS cosine, coalesce(diff, 0) AS diff, CASE WHEN coalesce(na, 0) = 0 THEN 1.0 ELSE nb / na END AS ratio FROM documents d LEFT JOIN per ON per.id = d.doc_id)
SELECT count(*) AS texts, round(avg(cosine), 6) AS cosine_mean, round(quantile_cont(cosine, 0.05), 6) AS cosine_p5, round(min(cosine), 6) AS cosine_min, round(max(diff), 6) AS max_weight_diff, round(avg(overlap), 6) AS top_overlap_mean, round(avg(ratio), 6) AS nnz_ratio_mean FROM c JOIN o USING (id)""")
def _(spark, sf):
    a, b = (x.withColumn("weight", F.round("weight", 9)) for x in (_splade(spark, sf), _coarse(spark, sf)))
    out = metrics.fidelity(a, b, read(spark, sf, "documents").select(F.col("doc_id").alias("id")))
    return _rounded(out, *[c for c in out.columns if c != "texts"])


# Percentiles of measured values

_EVENTS = "FROM events WHERE value IS NOT NULL GROUP BY event_type"


@query("percentile_linear", f"SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 {_EVENTS}")
def _(spark, sf):
    return _rounded(read(spark, sf, "events").groupBy("event_type").agg(metrics.percentile_linear("value", 0.95).alias("p95")), "p95")


@query("percentile_percent", f"SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90 {_EVENTS}")
def _(spark, sf):
    return _rounded(read(spark, sf, "events").groupBy("event_type").agg(metrics.percentile_percent("value", 90).alias("p90")), "p90")


for _rule, _index in (("nearest", "CAST(ceil(0.95 * count(*)) AS BIGINT)"), ("floor", "greatest(1, CAST(floor(0.95 * count(*)) AS BIGINT))"), ("index", "least(count(*), CAST(floor(0.95 * count(*)) AS BIGINT) + 1)")):
    query(f"percentile_{_rule}", f'SELECT event_type, list_sort(list(value))[{_index}] AS "value" {_EVENTS}')(
        lambda spark, sf, rule=_rule: metrics.percentile_nearest(read(spark, sf, "events"), "value", 0.95, ["event_type"], rule)
    )


@query("median_upper", f'SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS "value" {_EVENTS}')
def _(spark, sf):
    return metrics.upper_median(read(spark, sf, "events"), "value", ["event_type"])


@query("median_averaged", f"SELECT event_type, round(median(value), 6) AS m {_EVENTS}")
def _(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("m"))


@query("latency_summary", f'SELECT event_type, count(value) AS n, min(value) AS "min", round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS "max" {_EVENTS}')
def _(spark, sf):
    return _rounded(metrics.latency_summary(read(spark, sf, "events"), "value", ["event_type"]), "p50", "p95")


_CALLS = "SELECT event_type, CASE WHEN event_id % 4 = 0 THEN 'stream' ELSE 'call' END AS kind, event_id % 50 AS texts, event_id % 50 // 32 + 1 AS batches, value AS latency_ms FROM events"


@query("running_stats", f"SELECT event_type, CAST(sum(texts) AS BIGINT) AS texts, CAST(sum(batches) AS BIGINT) AS batches, count(*) FILTER (WHERE kind <> 'stream') AS calls, round(coalesce(sum(latency_ms) FILTER (WHERE kind <> 'stream') / nullif(count(*) FILTER (WHERE kind <> 'stream'), 0), 0), 6) AS avg_latency_ms FROM ({_CALLS}) GROUP BY event_type")
def _(spark, sf):
    kind = F.when(F.col("event_id") % 4 == 0, "stream").otherwise("call")
    texts = F.col("event_id") % 50
    calls = read(spark, sf, "events").select("event_type", kind.alias("kind"), texts.alias("texts"), (F.floor(texts / 32) + 1).alias("batches"), F.col("value").alias("latency_ms"))
    return _rounded(metrics.running_stats(calls, ["event_type"]), "avg_latency_ms")


@query("noise_test", "SELECT event_type, round(100 * (m - t) / t, 6) AS delta, abs(100 * (m - t) / t) < 5 AS noise FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type), (SELECT avg(value) AS t FROM events)")
def _(spark, sf):
    e = read(spark, sf, "events")
    rows = e.groupBy("event_type").agg(F.avg("value").alias("m")).withColumn("t", e.agg(F.avg("value")).scalar())
    return rows.select("event_type", F.round(metrics.relative_delta(F.col("m"), F.col("t")), 6).alias("delta"), metrics.is_noise(F.col("m"), F.col("t")).alias("noise"))


@query("missing_fields", "SELECT s_suppkey, CASE WHEN s_nationkey = 0 THEN 'kind,s_nationkey' ELSE 'kind' END AS missing FROM supplier")
def _(spark, sf):
    rows = read(spark, sf, "supplier").withColumn("kind", F.lit("unknown"))
    return metrics.missing_fields(rows, ["kind", "s_nationkey", "s_name"]).select("s_suppkey", F.array_join("missing", ",").alias("missing"))


# Reranking: benchmark items against the documents that share most words with them

_BTF = f"SELECT id, term, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '{_PAT}')) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY id, term"
_CANDIDATES = f"SELECT q, d FROM (SELECT q.id AS q, d.id AS d, sum(q.weight * d.weight) AS s FROM ({_BTF}) q JOIN ({_TF}) d ON q.term = d.term GROUP BY q.id, d.id) QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, d) <= 10"
_WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: w <> ''))"
_RERANK = f"SELECT query_id, doc_index, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_index) AS rank FROM (SELECT c.q AS query_id, c.d AS doc_index, round(len(list_intersect({_WORDS.format('b.text')}, {_WORDS.format('d.text')})) / greatest(len({_WORDS.format('b.text')}), 1), 6) AS score FROM ({_CANDIDATES}) c JOIN benchmark b ON b.item_id = c.q JOIN documents d ON d.doc_id = c.d)"


def _rerank_pairs(spark: SparkSession, sf: str) -> DataFrame:
    items, docs = read(spark, sf, "benchmark").where("text is not null"), read(spark, sf, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit(text.BASIC_ASCII_JVM), F.lit(0))
    queries = sparse.counted_rows(items.select(F.col("item_id").alias("id"), words.alias("w")), "w")
    found = retrieve.sparse_search(queries, sparse.counted_rows(_tokens(spark, sf), "w"), 10).where("score > 0")
    top = found.select(F.col("q").alias("query_id"), F.col("d").alias("doc_index"))
    return top.join(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id").join(docs.select(F.col("doc_id").alias("doc_index"), "text"), "doc_index")


def _overlap(a, b):
    return F.round(retrieve.term_overlap(a, b), 6)


@query("rerank_overlap", f"SELECT query_id, doc_index, score, CAST(rank AS INT) AS rank FROM ({_RERANK})")
def _(spark, sf):
    return retrieve.rerank(_rerank_pairs(spark, sf), _overlap).select("query_id", "doc_index", "score", "rank")


@query("rerank_cache_split", f"SELECT query_id, doc_index, score, doc_index % 2 = 0 AS cached FROM ({_RERANK})")
def _(spark, sf):
    pairs = _rerank_pairs(spark, sf).withColumn("score", _overlap(F.col("query"), F.col("text")))
    keys = ["query_id", "doc_index"]
    held = pairs.where("doc_index % 2 = 0").select(*keys, "score").withColumn("cached", F.lit(True))
    fresh = pairs.select(*keys, "score").withColumn("cached", F.lit(False))
    return retrieve.cached_scores(pairs.select(*keys), held, keys, lambda misses: misses.join(fresh, keys)).select(*keys, "score", "cached")


# Texts

_DOCS = "FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, a null text as an empty one."""
    return read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))



@query("ascii_lower", f"SELECT doc_id, md5(translate(text, '{text.UPPER}', '{text.LOWER}')) AS digest {_DOCS}")
def _(spark, sf):
    return _texts(spark, sf).select("doc_id", F.md5(text.ascii_lower("text")).alias("digest"))


@query("clean_text", f"SELECT doc_id, md5(regexp_replace(text, '{text.REMOVED}', '', 'g')) AS digest {_DOCS}")
def _(spark, sf):
    return _texts(spark, sf).select("doc_id", F.md5(text.clean_text("text")).alias("digest"))


@query("isolate_ideographs", f"SELECT doc_id, md5(regexp_replace(text, '{text.IDEOGRAPH}', ' \\1 ', 'g')) AS digest {_DOCS}")
def _(spark, sf):
    return _texts(spark, sf).select("doc_id", F.md5(text.isolate_ideographs("text")).alias("digest"))


@query("basic_tokenize", f"SELECT id AS doc_id, CAST(len(w) AS INT) AS n, md5(array_to_string(w, ' ')) AS digest FROM ({_TOKENS})")
def _(spark, sf):
    rows = _texts(spark, sf).select("doc_id", text.basic_tokenize("text", ascii_only=True).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


_FOLDED = f"translate(text, '{text.UPPER + text.FOLD_FROM}', '{text.LOWER + text.FOLD_TO}')"


@query("legacy_tokenize", f"SELECT doc_id, CAST(len(w) AS INT) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all({_FOLDED}, '{text.LEGACY}') AS w {_DOCS})")
def _(spark, sf):
    rows = _texts(spark, sf).select("doc_id", text.legacy_tokenize("text").alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("metaspace", f"SELECT doc_id, CAST(length(m) - length(replace(m, '▁', '')) AS INT) AS n, md5(m) AS digest FROM (SELECT doc_id, CASE WHEN starts_with(text, ' ') OR text = '' THEN replace(text, ' ', '▁') ELSE '▁' || replace(text, ' ', '▁') END AS m {_DOCS})")
def _(spark, sf):
    rows = _texts(spark, sf).select("doc_id", text.metaspace("text").alias("p"))
    return rows.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "")).alias("digest"))


@query("unigram_normalize", f"SELECT doc_id, md5(CASE WHEN text = '' THEN '' ELSE regexp_replace('_' || regexp_replace(replace(text, 'the', 'THE'), ' {{2,}}', ' ', 'g'), '\\s+$', '') END) AS digest {_DOCS}")
def _(spark, sf):
    steps = [("replace", "the", "THE"), ("collapse", 2, " "), ("prepend", "_"), ("strip", False, True)]
    return _texts(spark, sf).select("doc_id", F.md5(text.unigram_normalize("text", steps)).alias("digest"))


_IDS = f"SELECT id, list_transform(w, lambda x: length(x)) AS ids FROM ({_TOKENS})"


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("id", F.transform("w", F.length).alias("ids"))


@query("encode_single", f"SELECT id, array_to_string(list_concat([101], ids[1:126], [102]), ' ') AS ids FROM ({_IDS})")
def _(spark, sf):
    return _lengths(spark, sf).select("id", F.array_join(text.encode_single("ids", 101, 102, 128).cast("array<string>"), " ").alias("ids"))


_TURNS = f"SELECT conv_id, turn, list_transform(regexp_extract_all(lower(coalesce(text, '')), '{_PAT}'), lambda x: length(x)) AS ids FROM conversations"
_PAIRS = f"SELECT a.conv_id, a.turn, a.ids AS x, b.ids AS y, len(a.ids) AS na, len(b.ids) AS nb FROM ({_TURNS}) a JOIN ({_TURNS}) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
_KEPT = {
    "longest_first": ("least(na, 61 - least(nb, greatest(61 - na, 30)))", "least(nb, greatest(61 - na, 30))"),
    "only_first": ("greatest(0, 61 - nb)", "nb"),
    "only_second": ("na", "greatest(0, 61 - na)"),
}
for _strategy, (_ka, _kb) in _KEPT.items():
    query(
        f"encode_pair_{_strategy}",
        f"SELECT conv_id, turn, array_to_string(list_concat(list_concat([101], x[1:ka], [102]), y[1:kb], [102]), ' ') AS ids, CAST(ka AS INT) AS kept FROM (SELECT *, CASE WHEN na + nb > 61 THEN {_ka} ELSE na END AS ka, CASE WHEN na + nb > 61 THEN {_kb} ELSE nb END AS kb FROM ({_PAIRS}))",
    )(lambda spark, sf, strategy=_strategy: _pairs(spark, sf, strategy))


def _pairs(spark: SparkSession, sf: str, strategy: str) -> DataFrame:
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(text.BASIC_ASCII_JVM), F.lit(0)), F.length)
    turns = read(spark, sf, "conversations").select("conv_id", "turn", words.alias("x"))
    rows = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"])
    ids, types = text.encode_pair("x", "y", 101, 102, 64, strategy)
    return rows.select("conv_id", "turn", F.array_join(ids.cast("array<string>"), " ").alias("ids"), (F.size(F.filter(types, lambda t: t == 0)) - 2).alias("kept"))


@query("pad_batch", f"SELECT id, CAST(max(len(ids)) OVER (PARTITION BY id // 32) AS INT) AS width, CAST(len(ids) AS INT) AS ones FROM (SELECT id, list_concat([101], ids[1:62], [102]) AS ids FROM ({_IDS}))")
def _(spark, sf):
    rows = _lengths(spark, sf).select("id", F.floor(F.col("id") / 32).alias("batch"), text.encode_single("ids", 101, 102, 64).alias("ids"))
    padded = text.pad_batch(rows, "ids", ["batch"])
    return padded.select("id", F.size("padded").alias("width"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("ones"))


_VOCAB = {"[UNK]": 0, "the": 1, "th": 2, "##e": 3, "##n": 4, "er": 5, "##er": 6, "##th": 7, "an": 8, "##d": 9, "in": 10, "##ing": 11, "##on": 12, "on": 13, "en": 14, "##t": 15}


_PIECES = ", ".join(f"('{p.removeprefix('##')}', {str(p.startswith('##')).lower()}, {i})" for p, i in _VOCAB.items() if i)
_WORDPIECES = f"""WITH RECURSIVE t AS MATERIALIZED ({_TOKENS}), v(piece, inside, pid) AS (VALUES {_PIECES}), words AS (SELECT DISTINCT unnest(w) AS w FROM t),
r AS (SELECT w, 0 AS place, '' AS ids FROM words UNION ALL SELECT r.w, r.place + CAST(max(length(piece)) AS INT), r.ids || ' ' || arg_max(pid, length(piece)) FROM r JOIN v ON inside = (r.place > 0) AND substr(r.w, r.place + 1, length(piece)) = piece WHERE r.place < length(r.w) GROUP BY r.w, r.place, r.ids),
done AS (SELECT words.w, coalesce(max(CASE WHEN place = length(words.w) AND length(words.w) <= {subword.MOST_CHARACTERS} THEN trim(ids) END), '0') AS ids FROM words JOIN r ON r.w = words.w GROUP BY words.w),
each AS (SELECT id, i, list_extract(w, i) AS w FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM t))
SELECT t.id, CAST(coalesce(n, 0) AS INT) AS n, md5(coalesce(s, '')) AS digest FROM t LEFT JOIN (SELECT id, sum(len(string_split(ids, ' '))) AS n, string_agg(ids, ' ' ORDER BY i) AS s FROM each JOIN done ON done.w = each.w GROUP BY id) x ON x.id = t.id"""


def _ids_digest(ids: str):
    return F.md5(F.array_join(F.col(ids).cast("array<string>"), " ")).alias("digest")


@query("wordpiece_encode", _WORDPIECES)
def _(spark, sf):
    encode = subword.tokens_udf(lambda w: subword.wordpiece(w, _VOCAB, 0))
    return _tokens(spark, sf).select("id", encode("w").alias("ids")).select("id", F.size("ids").alias("n"), _ids_digest("ids"))


@query("bpe_encode")
def _(spark, sf):
    ranks = {p: i for i, p in enumerate([("t", "h"), ("th", "e"), ("e", "r"), ("o", "n"), ("i", "n"), ("in", "g"), ("a", "n")])}
    vocab = {s: i for i, s in enumerate(["[UNK]", "t", "h", "e", "r", "o", "n", "i", "g", "a", "th", "the", "er", "on", "in", "ing", "an"])}
    encode = subword.tokens_udf(lambda w: subword.bpe(list(w), ranks, vocab, 0))
    return _tokens(spark, sf).select("id", encode("w").alias("ids")).select("id", F.size("ids").alias("n"), F.hash("ids").alias("digest"))


@query("unigram_encode")
def _(spark, sf):
    scores = {"t": -3.0, "h": -3.1, "e": -2.5, "th": -2.0, "the": -1.5, "er": -2.2, "on": -2.1, "in": -2.3, "ing": -1.9, "an": -2.4, "n": -3.3, "a": -3.2, "o": -3.0, "i": -3.0}
    ids = {p: i + 1 for i, p in enumerate(scores)}
    encode = subword.tokens_udf(lambda w: subword.unigram(w, scores, ids, 0))
    return _tokens(spark, sf).select("id", encode("w").alias("ids")).select("id", F.size("ids").alias("n"), F.hash("ids").alias("digest"))


@query("bert_normalize", "SELECT doc_id, md5(lower(strip_accents(text))) AS digest FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(subword.bert_normalized("text")).alias("digest"))


_BYTES = "list_transform(range(0, len(c) // 2), lambda i: (instr('0123456789ABCDEF', c[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', c[2 * i + 2]) - 1)"
_LENGTH = "list_transform(range(0, 8), lambda i: (n >> CAST(8 * i AS INT)) & 255)"


@query("fnv_fingerprint", f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN lpad(lower(to_hex(CAST(list_reduce(list_concat([{subword.FNV_OFFSET}::HUGEINT], CAST({_LENGTH} AS HUGEINT[]), CAST(CASE WHEN n = 0 THEN [] ELSE {_BYTES} END AS HUGEINT[])), lambda h, b: (CAST(xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT)) AS HUGEINT) * {subword.FNV_PRIME}) % 18446744073709551616) AS UBIGINT))), 16, '0') END AS fingerprint FROM (SELECT doc_id, text, CAST(octet_length(encode(text)) AS BIGINT) AS n, string_split(hex(encode(text)), '') AS c FROM documents)")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", subword.fingerprint("text").alias("fingerprint"))


@query("hashing_embed", "SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(text, '\\S') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents")
def _(spark, sf):
    rows = embed(read(spark, sf, "documents").select("doc_id", "text"), HashingProvider(64))
    return rows.select("doc_id", F.when(F.col("embedding").isNotNull(), F.round(vector.norm("embedding"), 3)).alias("norm"))


# Batches

_N = f"SELECT doc_id AS id, text, md5(coalesce(text, '')) AS digest, coalesce(len(regexp_extract_all(lower(text), '{_PAT}')), 0) AS n FROM documents"


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with their texts, as a user's batches carry them."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(text.BASIC_ASCII_JVM), F.lit(0))
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.coalesce(F.size(words), F.lit(0)).alias("n"))


def _digest():
    return F.md5(F.coalesce("text", F.lit(""))).alias("digest")


@query("batch_fixed", f"SELECT id, digest, (row_number() OVER (ORDER BY id) - 1) // 32 AS batch FROM ({_N})")
def _(spark, sf):
    return batching.fixed_batches(_sized(spark, sf), ["id"], 32).select("id", _digest(), "batch")


_BY_LENGTH = f"SELECT id, digest, n, (row_number() OVER (ORDER BY n DESC, id) - 1) // 16 AS batch FROM ({_N})"


@query("batch_length_bucket", f"SELECT id, digest, batch FROM ({_BY_LENGTH})")
def _(spark, sf):
    return batching.length_batches(_sized(spark, sf), "n", "id", 16).select("id", _digest(), "batch")


@query("batch_equal_length", f"SELECT id, n || '-' || ((row_number() OVER (PARTITION BY n ORDER BY id) - 1) // 8) AS batch FROM ({_N})")
def _(spark, sf):
    return batching.length_batches(_sized(spark, sf).drop("text"), "n", "id", 8, exact_length=True).select("id", "batch")


@query("batch_padding_waste", f"SELECT CAST(sum(m * c) AS BIGINT) AS padded, CAST(sum(t) AS BIGINT) AS tokens, round(sum(m * c) / sum(t), 6) AS ratio FROM (SELECT batch, max(n) AS m, count(*) AS c, sum(n) AS t FROM ({_BY_LENGTH}) GROUP BY batch)")
def _(spark, sf):
    return _rounded(batching.padding_waste(batching.length_batches(_sized(spark, sf).drop("text"), "n", "id", 16), "n", ["batch"]), "ratio")


_SHARDED = f"SELECT id, n, id // 64 AS shard, row_number() OVER (PARTITION BY id // 64 ORDER BY n DESC, id) AS p FROM ({_N})"


@query("batch_token_budget", f"WITH RECURSIVE s AS MATERIALIZED ({_SHARDED}), w AS (SELECT shard, p, id, least(16, greatest(1, 512 // greatest(1, n))) - 1 AS room, 0 AS batch FROM s WHERE p = 1 UNION ALL SELECT s.shard, s.p, s.id, CASE WHEN w.room > 0 THEN w.room - 1 ELSE least(16, greatest(1, 512 // greatest(1, s.n))) - 1 END, CASE WHEN w.room > 0 THEN w.batch ELSE w.batch + 1 END FROM w JOIN s ON s.shard = w.shard AND s.p = w.p + 1) SELECT id, shard, CAST(batch AS BIGINT) AS batch FROM w")
def _(spark, sf):
    rows = _sized(spark, sf).drop("text").withColumn("shard", F.floor(F.col("id") / 64))
    return batching.budget_batches(rows, "n", "id", 16, shard=["shard"]).select("id", "shard", "batch")


@query("batch_token_budget_global", f"WITH RECURSIVE s AS MATERIALIZED (SELECT id, n, row_number() OVER (ORDER BY n DESC, id) AS p FROM ({_N})), w AS (SELECT p, id, least(16, greatest(1, 512 // greatest(1, n))) - 1 AS room, 0 AS batch FROM s WHERE p = 1 UNION ALL SELECT s.p, s.id, CASE WHEN w.room > 0 THEN w.room - 1 ELSE least(16, greatest(1, 512 // greatest(1, s.n))) - 1 END, CASE WHEN w.room > 0 THEN w.batch ELSE w.batch + 1 END FROM w JOIN s ON s.p = w.p + 1) SELECT id, CAST(batch AS BIGINT) AS batch FROM w")
def _(spark, sf):
    return batching.budget_batches(_sized(spark, sf), "n", "id", 16).select("id", "batch")


_TIMED = "SELECT event_id AS id, user_id AS shard, floor(epoch(ts)) AS came, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS p FROM events"
_WAIT = 200_000.0


@query("arrival_batches", f"WITH RECURSIVE s AS MATERIALIZED ({_TIMED}), w AS (SELECT shard, p, id, came AS began, 1 AS held, 0 AS batch FROM s WHERE p = 1 UNION ALL SELECT s.shard, s.p, s.id, CASE WHEN w.held = 8 OR s.came - w.began > {_WAIT} THEN s.came ELSE w.began END, CASE WHEN w.held = 8 OR s.came - w.began > {_WAIT} THEN 1 ELSE w.held + 1 END, CASE WHEN w.held = 8 OR s.came - w.began > {_WAIT} THEN w.batch + 1 ELSE w.batch END FROM w JOIN s ON s.shard = w.shard AND s.p = w.p + 1) SELECT id, CAST(batch AS BIGINT) AS batch FROM w")
def _(spark, sf):
    rows = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("shard"), F.unix_timestamp("ts").cast("double").alias("at"))
    return batching.arrival_batches(rows, "at", "id", ["shard"], 8, _WAIT).select("id", "batch")


@query("session_round_robin", f"SELECT id, digest, CAST((row_number() OVER (ORDER BY id) - 1) % 3 AS INT) AS session FROM ({_N})")
def _(spark, sf):
    return batching.round_robin(_sized(spark, sf), ["id"], 3).select("id", _digest(), "session")


@query("pool_shards", f"SELECT id, digest, (row_number() OVER (ORDER BY id) - 1) // CAST(ceil(count(*) OVER () / 4) AS BIGINT) AS shard FROM ({_N})")
def _(spark, sf):
    return batching.shards(_sized(spark, sf), ["id"], 4).select("id", _digest(), "shard")


# Measured configurations, made from the suppliers

_M = "SELECT s_suppkey AS idx, s_acctbal > -500 AS valid, 5 + abs(s_acctbal) / 1000 AS p50_ms, 6 + abs(s_acctbal) / 800 + s_nationkey AS p95_ms, 50.0 + (s_suppkey * 37) % 101 AS throughput, 20.0 + (s_suppkey * 53) % 307 AS memory_mb FROM supplier"
_COST = {
    "latency": "t / nullif(mt, 0)",
    "throughput": "CASE WHEN throughput > 0 THEN mx / throughput ELSE 1e30 END",
    "memory": "(memory_mb + 16) / (mm + 16) + 0.1 * t / mt",
    "balanced": "(t / mt + mx / throughput) / 2",
}


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    s, bal = read(spark, sf, "supplier"), F.abs("s_acctbal")
    key = F.col("s_suppkey")
    return s.select(key.alias("idx"), (F.col("s_acctbal") > -500).alias("valid"), (5 + bal / 1000).alias("p50_ms"), (6 + bal / 800 + F.col("s_nationkey")).alias("p95_ms"), (50.0 + (key * 37) % 101).alias("throughput"), (20.0 + (key * 53) % 307).alias("memory_mb"))


def _cost_sql(objective: str, budget: float = 0) -> str:
    limit = f" AND p95_ms <= {budget}" if budget else ""
    return f"SELECT idx, {_COST[objective]} AS cost FROM (SELECT *, min(t) OVER () AS mt, max(throughput) OVER () AS mx, min(memory_mb) OVER () AS mm FROM (SELECT *, p50_ms + 0.5 * (p95_ms - p50_ms) AS t FROM ({_M}) WHERE valid{limit}))"


def _best_sql(objective: str, budget: float = 0) -> str:
    return f"SELECT idx, cost FROM (SELECT *, min(cost) OVER () AS least FROM ({_cost_sql(objective, budget)})) WHERE cost <= least * 1.05 ORDER BY idx LIMIT 1"


for _objective in tuning.OBJECTIVES:
    query(f"tune_cost_{_objective}", f"SELECT idx, round(cost, 6) AS cost FROM ({_cost_sql(_objective)})")(lambda spark, sf, o=_objective: _rounded(tuning.costs(_measured(spark, sf), o).select("idx", "cost"), "cost"))
    query(f"tune_select_{_objective}", f"SELECT idx, round(cost, 6) AS cost FROM ({_best_sql(_objective, 20)})")(lambda spark, sf, o=_objective: _rounded(tuning.select_best(_measured(spark, sf), o, 20).select("idx", "cost"), "cost"))


@query("tune_search_relaxed", f"SELECT idx, false AS constraints_met FROM ({_best_sql('latency')})")
def _(spark, sf):
    return tuning.search(_measured(spark, sf), "latency", 0.001).select("idx", "constraints_met")


@query("tune_keep_baseline", f"SELECT idx FROM (SELECT idx, cost, 1 AS f FROM ({_best_sql('latency')}) UNION ALL SELECT idx, cost, 0 FROM ({_cost_sql('latency')}) WHERE idx = (SELECT min(idx) FROM ({_M}) WHERE valid)) ORDER BY cost, f LIMIT 1")
def _(spark, sf):
    m = _measured(spark, sf)
    return tuning.keep_baseline(m, "latency", m.where("valid").agg(F.min("idx")).first()[0]).select("idx")


@query("tune_prune_grid", "SELECT CAST(row_number() OVER (ORDER BY k, w) - 1 AS INT) AS idx, k AS top_k, w AS min_weight FROM (SELECT unnest([16, 32, 64, 128]) AS k), (SELECT unnest([0.0::DOUBLE, 0.01, 0.05]) AS w)")
def _(spark, sf):
    return tuning.prune_grid(spark)


@query("tune_rerank_grid", "SELECT CAST(row_number() OVER (ORDER BY t, k DESC, b) - 1 AS INT) AS idx, t AS threads, k AS max_tokens, b AS batch_size FROM (SELECT unnest([1, 2, 4, 8]) AS t), (SELECT unnest([256, 128, 64, 32]) AS k), (SELECT unnest([4, 8, 16]) AS b)")
def _(spark, sf):
    return tuning.rerank_grid(spark, 4, 8, full=True)


@query("tune_text_grid", "SELECT CAST(row_number() OVER (ORDER BY p, b) - 1 AS INT) AS idx, w AS workers, t AS threads, b AS batch_size FROM (VALUES (0, 1, 4), (1, 2, 2), (2, 4, 1), (3, 1, 8)) s(p, w, t), (SELECT unnest([16, 32, 64, 128]) AS b)")
def _(spark, sf):
    return tuning.text_grid(spark, 4, 8, full=True)


_MODELS = "SELECT s_suppkey AS idx, (s_suppkey * 13) % 97 / 97.0 AS quality, 50.0 + (s_suppkey * 37) % 101 AS throughput, 20.0 + (s_suppkey * 53) % 307 AS file_mb, 1 + s_suppkey % 8 AS workers, 5 + abs(s_acctbal) / 1000 AS latency_ms FROM supplier"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(key.alias("idx"), (key * 13 % 97 / 97.0).alias("quality"), (50.0 + (key * 37) % 101).alias("throughput"), (20.0 + (key * 53) % 307).alias("file_mb"), (1 + key % 8).alias("workers"), (5 + F.abs("s_acctbal") / 1000).alias("latency_ms"))


@query("pareto", f"WITH m AS ({_MODELS}) SELECT idx FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.idx <> m.idx AND o.quality >= m.quality - 0.01 AND o.throughput >= m.throughput - 1 AND o.file_mb <= m.file_mb + 0.5 AND (o.quality > m.quality + 0.01 OR o.throughput > m.throughput + 1 OR o.file_mb < m.file_mb - 0.5))")
def _(spark, sf):
    return tuning.pareto(_scored(spark, sf)).select("idx")


for _case, _sql in (("speed", "throughput * 10 - latency_ms * 0.5 - workers * 100 * 0.01 + quality * 2"), ("quality", "quality * 100 + throughput * 0.1 - latency_ms * 0.1 - workers * 100 * 0.005"), ("balanced", "throughput * 5 + quality * 10 - latency_ms * 0.2 - workers * 100 * 0.01")):
    query(f"model_score_{_case}", f"SELECT idx, round({_sql}, 6) AS score FROM ({_MODELS})")(lambda spark, sf, c=_case: _scored(spark, sf).select("idx", F.round(tuning.model_score(c), 6).alias("score")))


@query("composite_score", f"SELECT idx, round(0.5 * quality + 0.3 * least(throughput / 300, 1) + 0.2 * least(20 / greatest(file_mb, 1), 1), 6) AS score FROM ({_MODELS}) WHERE quality >= 0.2 AND file_mb <= 300 AND throughput >= 60")
def _(spark, sf):
    rows = tuning.within(_scored(spark, sf), 0.2, 300, 60)
    return rows.select("idx", F.round(tuning.composite_score(tuning.PROFILES["balanced"]), 6).alias("score"))


_QUANT = "SELECT s_nationkey AS model, ['none', 'dynamic', 'fp16', 'static'][s_suppkey % 4 + 1] AS quantization, 50.0 + (s_suppkey * 37) % 101 AS docs_per_sec FROM supplier"


@query("quant_pick", f"""WITH m AS ({_QUANT}), p AS (SELECT model, max(docs_per_sec) FILTER (WHERE quantization = 'none') AS base, max(docs_per_sec) FILTER (WHERE quantization = 'dynamic') AS dyn FROM m GROUP BY model),
b AS (SELECT m.model, arg_max(quantization, (docs_per_sec, quantization)) AS best, max(docs_per_sec) AS rate FROM m JOIN p USING (model) WHERE quantization <> 'none' AND docs_per_sec / base >= 1.05 AND docs_per_sec > base GROUP BY m.model)
SELECT p.model, CASE WHEN base IS NULL OR best IS NULL THEN 'none' WHEN dyn IS NOT NULL AND rate / dyn < 1.15 THEN 'dynamic' ELSE best END AS pick FROM p LEFT JOIN b USING (model)""")
def _(spark, sf):
    key = F.col("s_suppkey")
    kind = F.get(F.array(*map(F.lit, ("none", "dynamic", "fp16", "static"))), (key % 4).cast("int"))
    return tuning.pick_quantization(read(spark, sf, "supplier").select(F.col("s_nationkey").alias("model"), kind.alias("quantization"), (50.0 + (key * 37) % 101).alias("docs_per_sec")))


_PLATEAU = """WITH RECURSIVE s AS MATERIALIZED (SELECT s_nationkey AS series, s_suppkey AS sessions, 50.0 + (s_suppkey * 37) % 101 AS t, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS p FROM supplier),
w AS (SELECT series, p, CAST(t AS DOUBLE) AS best, sessions AS place, 0 AS low, 1 AS n FROM s WHERE p = 1 UNION ALL
SELECT s.series, s.p, CASE WHEN low < 2 AND t > best THEN t ELSE best END, CASE WHEN low < 2 AND t > best THEN s.sessions ELSE place END, CASE WHEN low = 2 THEN 2 WHEN t > best THEN 0 WHEN t < 0.95 * best THEN low + 1 ELSE low END, CASE WHEN low < 2 THEN n + 1 ELSE n END FROM w JOIN s ON s.series = w.series AND s.p = w.p + 1)
SELECT series, CAST(place AS INT) AS sessions, best, CAST(n AS INT) AS measured FROM w QUALIFY row_number() OVER (PARTITION BY series ORDER BY p DESC) = 1"""


@query("session_plateau", _PLATEAU)
def _(spark, sf):
    rows = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("series"), F.col("s_suppkey").alias("sessions"), (50.0 + (F.col("s_suppkey") * 37) % 101).alias("throughput"))
    return tuning.plateau(rows)


@query("tune_raced", f"SELECT idx, coalesce(p50_ms > 2.5 * min(CASE WHEN valid THEN p50_ms END) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS pruned FROM ({_M})")
def _(spark, sf):
    return tuning.raced(_measured(spark, sf), "balanced").select("idx", "pruned")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    rate = (50.0 + (F.col("s_suppkey") * 37) % 101).alias("throughput")
    return read(spark, sf, "supplier").select(F.col("s_nationkey").alias("series"), F.col("s_suppkey").alias("idx"), F.when(F.col("s_suppkey") % 3 == 0, "llama").otherwise("onnx").alias("backend"), rate)


_RUNS = "SELECT s_nationkey AS series, s_suppkey AS idx, CASE WHEN s_suppkey % 3 = 0 THEN 'llama' ELSE 'onnx' END AS backend, 50.0 + (s_suppkey * 37) % 101 AS throughput FROM supplier"


@query("backend_compare", f"SELECT series, backend, idx, CAST(throughput AS DOUBLE) AS throughput, row_number() OVER (PARTITION BY series ORDER BY throughput DESC, idx) = 1 AS recommended FROM (SELECT * FROM ({_RUNS}) QUALIFY row_number() OVER (PARTITION BY series, backend ORDER BY throughput DESC, idx) = 1)")
def _(spark, sf):
    return tuning.compare_backends(_runs(spark, sf), ["series"])


@query("benchmark_sessions", f"SELECT series, arg_max(idx, throughput) AS sessions, CAST(max(throughput) AS DOUBLE) AS throughput FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY idx) AS p FROM ({_RUNS})) WHERE p <= 2 GROUP BY series HAVING count(DISTINCT throughput) = count(*)")
def _(spark, sf):
    return tuning.benchmark_sessions(_runs(spark, sf).withColumnRenamed("idx", "sessions"))


@query("benchmark_grid", "SELECT CAST(3 * t + b AS INT) AS idx, CAST(t + 1 AS INT) AS threads, CAST(32 << CAST(b AS INT) AS INT) AS batch_size FROM range(4) x(t), range(3) y(b)")
def _(spark, sf):
    return tuning.benchmark_grid(spark)


@query("worker_heuristic", "SELECT c_custkey, CAST(least(2 * c_nationkey, 8) AS INT) AS workers FROM customer")
def _(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", tuning.workers(F.col("c_nationkey")).alias("workers"))


_BUCKETED = "SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE least(CAST(floor(log10(n) * 2.5) AS INT), 9) END AS b FROM (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS n FROM documents)"


@query("sample_stratified", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY b) AS c FROM ({_BUCKETED})),
f AS (SELECT doc_id, b, i FROM r WHERE c <= 10 OR i IN (SELECT CAST(floor(k * (r.c / 10)) AS BIGINT) FROM range(10) g(k)))
SELECT doc_id FROM (SELECT doc_id, 0 AS o, lpad(CAST(b AS VARCHAR), 4, '0') AS x, lpad(CAST(i AS VARCHAR), 20, '0') AS y FROM f UNION ALL SELECT doc_id, 1, md5(CAST(doc_id AS VARCHAR)), '' FROM r WHERE doc_id NOT IN (SELECT doc_id FROM f)) ORDER BY o, x, y LIMIT 100""")
def _(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return tuning.stratified_sample(rows, "doc_id", "text", 100).select("doc_id")


@query("synthetic_corpus", f"SELECT i, n AS n_words, md5(array_to_string(list_transform(range(0, n), lambda j: w[(i * 7 + j) % len(w) + 1]), ' ')) AS digest FROM (SELECT i, w, [{', '.join(map(str, tuning.LENGTHS))}][i % 10 + 1] AS n FROM range(50) g(i), (SELECT string_split('{' '.join(tuning.WORDS)}', ' ') AS w))")
def _(spark, sf):
    return tuning.synthetic_corpus(spark, 50).select("i", "n_words", F.md5("text").alias("digest"))


# Registry and rules


def _values(rows: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


def _lines(table: str) -> list[tuple]:
    return [(i, *line.split("|")) for i, line in enumerate(table.strip().splitlines())]


_REG = _values(_lines(registry.MODELS), "ordinal, kind, name, code, file, dim, max_tokens, pooling, quantization")
_REG_SIZES = _values(_lines(registry.SIZES), "o, code, file, size_mb")
_WANTED = ["BAAI/bge-small-en-v1.5", "Xenova/bge-base-en-v1.5", "all-MiniLM-L6-v2", "minilm_l12", "nowhere"]


def _wanted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in _WANTED], "wanted string")


@query("registry_models", f"SELECT kind, count(*) AS n, CAST(sum(CAST(dim AS INT)) AS BIGINT) AS dims FROM {_REG} GROUP BY kind")
def _(spark, sf):
    return registry.models(spark).groupBy("kind").agg(F.count("*").alias("n"), F.sum("dim").alias("dims"))


@query("registry_mobile_limit", f"SELECT t.code, t.file, CAST(s.size_mb AS INT) AS size_mb FROM {_REG} JOIN (SELECT * FROM {_REG_SIZES.replace('AS t(', 'AS u(')}) s ON t.code = s.code AND t.file = s.file WHERE CAST(s.size_mb AS INT) BETWEEN 0 AND 150")
def _(spark, sf):
    return registry.mobile_models(spark).select("code", "file", "size_mb")


@query("registry_allowed", f"SELECT kind, code FROM {_REG} WHERE code NOT IN ('jinaai/jina-reranker-v2-base-multilingual', 'onnx-community/embeddinggemma-300m-ONNX')")
def _(spark, sf):
    return registry.allowed_models(spark).select("kind", "code")


@query("registry_resolve", f"SELECT wanted, ordinal FROM (SELECT wanted, ordinal, row_number() OVER (PARTITION BY wanted ORDER BY CASE WHEN code = wanted THEN 1 ELSE 2 END, ordinal) AS r FROM (SELECT unnest({_WANTED}) AS wanted), {_REG} WHERE kind = 'text' AND (code = wanted OR name = wanted)) WHERE r = 1")
def _(spark, sf):
    return registry.resolve(spark, _wanted(spark)).select("wanted", "ordinal")


_KEY = "regexp_replace(lower({0}), '[-_]', '', 'g')"
_LAST = "list_extract(string_split(lower({0}), '/'), -1)"
_FUZZY = " OR ".join(f"lower({c}) = lower(wanted) OR {_LAST.format(c)} = {_LAST.format('wanted')} OR contains({_KEY.format(c)}, {_KEY.format('wanted')})" for c in ("name", "code"))


@query("registry_fuzzy", f"SELECT wanted, ordinal FROM (SELECT wanted, ordinal, row_number() OVER (PARTITION BY wanted ORDER BY CASE WHEN code = wanted THEN 1 ELSE 2 END, ordinal) AS r FROM (SELECT unnest({_WANTED}) AS wanted), {_REG} WHERE kind = 'text' AND ({_FUZZY})) WHERE r = 1")
def _(spark, sf):
    return registry.resolve_fuzzy(spark, _wanted(spark)).select("wanted", "ordinal")


@query("registry_gguf", f"SELECT wanted, CAST(min(ordinal) AS INT) AS ordinal FROM (VALUES ('snowflake'), ('MINILM'), ('SPLADE-PP-En-v1-GGUF'), ('splade-pp')) AS t(wanted) JOIN (SELECT row_number() OVER () - 1 AS ordinal, * FROM {_values([tuple(x.split('|')[:2]) for x in registry.GGUF_MODELS.strip().splitlines()], 'kind, name')}) g ON CASE WHEN kind = 'sparse' THEN name = wanted ELSE contains(lower(name), lower(wanted)) END GROUP BY wanted")
def _(spark, sf):
    wanted = spark.createDataFrame([("snowflake",), ("MINILM",), ("SPLADE-PP-En-v1-GGUF",), ("splade-pp",)], "wanted string")
    return registry.resolve_gguf(spark, wanted).select("wanted", "ordinal")


@query("registry_variants", f"SELECT name, CAST(min(CASE quantization WHEN 'none' THEN 0 WHEN 'dynamic' THEN 1 WHEN 'fp16' THEN 2 ELSE 3 END) AS INT) AS first_slot, count(*) AS n FROM {_REG} WHERE kind = 'text' GROUP BY name")
def _(spark, sf):
    return registry.variants(spark).groupBy("name").agg(F.min("slot").alias("first_slot"), F.count("*").alias("n"))


@query("registry_pooling_infer", f"SELECT code, CASE WHEN regexp_matches(lower(list_extract(string_split(code, '/'), -1)), 'bge|snowflake|arctic|gte|mxbai') THEN 'cls' ELSE 'mean' END AS pooling FROM {_REG} WHERE kind = 'text'")
def _(spark, sf):
    return registry.models(spark).where("kind = 'text'").select("code", registry.infer_pooling("code").alias("pooling"))


@query("registry_extra_files", f"SELECT kind, code, extra FROM {_values(_lines(registry.ADDITIONAL_FILES), 'o, kind, code, file, extra')}")
def _(spark, sf):
    return registry.additional_files(spark).select("kind", "code", "extra")


@query("backend_by_extension", f"SELECT file, CASE WHEN lower(file) LIKE '%.gguf' THEN 'llama' ELSE 'onnx' END AS backend FROM (SELECT file FROM {_REG} UNION ALL SELECT file FROM {_values(_lines(registry.GGUF_MODELS), 'o, kind, name, file, base, dim, p, s, sc, se').replace('AS t(', 'AS u(')})")
def _(spark, sf):
    files = registry.models(spark).select("file").union(registry.gguf_models(spark).select(F.col("path").alias("file")))
    return files.select("file", resolve.backend_expression("file").alias("backend"))


_FILES = [(1, ["token_embd.weight", "mlm_transform.weight", "mlm_bias", "colbert_linear.weight"], True), (2, ["mlm_transform.weight"], True), (3, ["token_embd.weight", "sparse_linear.weight"], False), (4, ["token_embd.weight", "classifier.dense.weight"], False), (5, ["token_embd.weight", "mlm_transform.weight", "mlm_head.weight"], True)]
_HAS = "CAST(list_contains(tensors, '{0}') AS INT)"


@query("capability_bits", "SELECT f, CAST({0} * (1 + 2 * {1} + 4 * {1} * {2} + 8 * {3} + 16 * {4} + 32 * {5} + 64 * {1} * (1 - {6}) + 128 * CAST(special AS INT)) AS INT) AS mask FROM (VALUES {7}) AS t(f, tensors, special)".format(
    *[_HAS.format(n) for n in ("token_embd.weight", "mlm_transform.weight", "mlm_bias", "sparse_linear.weight", "colbert_linear.weight", "classifier.dense.weight", "mlm_head.weight")], ", ".join(f"({f}, {t}, {str(x).lower()})" for f, t, x in _FILES)
))
def _(spark, sf):
    df = spark.createDataFrame(_FILES, "f int, tensors array<string>, special boolean")
    return df.select("f", registry.capability_mask(F.col("tensors"), F.col("special")).cast("int").alias("mask"))


@query("benchmark_corpora", f"SELECT category, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM {_values(corpora.rows(), 'category, i, text')} GROUP BY category")
def _(spark, sf):
    return corpora.corpora(spark).groupBy("category").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# Caches


_REPLAY = """WITH RECURSIVE s AS MATERIALIZED (SELECT CAST(user_id // 10 AS VARCHAR) AS cache, event_type AS key, event_id % 3 = 0 AS put, row_number() OVER (PARTITION BY user_id // 10 ORDER BY event_id) AS p FROM events),
w AS (SELECT cache, p, CASE WHEN put THEN [key] ELSE [] END AS keys, 0 AS hits, CASE WHEN put THEN 0 ELSE 1 END AS misses FROM s WHERE p = 1 UNION ALL
SELECT s.cache, s.p, CASE WHEN put AND len(moved) > 2 THEN moved[2:] WHEN put OR list_contains(keys, key) THEN moved ELSE keys END, hits + CASE WHEN NOT put AND list_contains(keys, key) THEN 1 ELSE 0 END, misses + CASE WHEN NOT put AND NOT list_contains(keys, key) THEN 1 ELSE 0 END
FROM (SELECT s.*, w.keys, w.hits, w.misses, list_append(list_filter(w.keys, lambda x: x <> s.key), s.key) AS moved FROM w JOIN s ON s.cache = w.cache AND s.p = w.p + 1) s)
SELECT cache, CAST(hits AS BIGINT) AS hits, CAST(misses AS BIGINT) AS misses, CAST(len(keys) AS INT) AS size FROM w QUALIFY row_number() OVER (PARTITION BY cache ORDER BY p DESC) = 1"""


@query("cache_replay", _REPLAY)
def _(spark, sf):
    e = read(spark, sf, "events")
    op = F.when(F.col("event_id") % 3 == 0, "put").otherwise("get")
    log = e.select(F.floor(F.col("user_id") / 10).cast("string").alias("cache"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_type").alias("key"), F.unix_timestamp("ts").cast("double").alias("at"))
    return cache.counters(cache.replay(log, 2))


@query("cache_ttl", "SELECT event_id FROM events WHERE value IS NULL OR 50.0 <= value")
def _(spark, sf):
    rows = read(spark, sf, "events").select("event_id", F.col("value").alias("expires_at"))
    return cache.live(rows, 50.0).select("event_id")


@query("cache_hit_split", "SELECT d.doc_id, l.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def _(spark, sf):
    docs, held = read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels").select("doc_id").distinct().withColumn("hit", F.lit(True))
    hits, misses = retrieve.split_cached(docs, held, ["doc_id"])
    return hits.unionByName(misses.withColumn("hit", F.lit(False)))
