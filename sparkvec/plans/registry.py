"""Model registry as dimension tables, and the rules that resolve names against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# kind|name|code|file|dim|max tokens|pooling|quantization, in registry order.
MODELS = """
text|sentence-transformers/all-MiniLM-L6-v2|Qdrant/all-MiniLM-L6-v2-onnx|model.onnx|384|512|mean|none
text|sentence-transformers/all-MiniLM-L6-v2|Xenova/all-MiniLM-L6-v2|onnx/model_quantized.onnx|384|512|mean|dynamic
text|sentence-transformers/all-MiniLM-L12-v2|Xenova/all-MiniLM-L12-v2|onnx/model.onnx|384|512|mean|none
text|sentence-transformers/all-MiniLM-L12-v2|Xenova/all-MiniLM-L12-v2|onnx/model_quantized.onnx|384|512|mean|dynamic
text|sentence-transformers/all-mpnet-base-v2|Xenova/all-mpnet-base-v2|onnx/model.onnx|768|512|mean|none
text|BAAI/bge-base-en-v1.5|Xenova/bge-base-en-v1.5|onnx/model.onnx|768|512|cls|none
text|BAAI/bge-base-en-v1.5|Qdrant/bge-base-en-v1.5-onnx-Q|model_optimized.onnx|768|512|cls|fp16
text|BAAI/bge-large-en-v1.5|Xenova/bge-large-en-v1.5|onnx/model.onnx|1024|512|cls|none
text|BAAI/bge-large-en-v1.5|Qdrant/bge-large-en-v1.5-onnx-Q|model_optimized.onnx|1024|512|cls|fp16
text|BAAI/bge-small-en-v1.5|Xenova/bge-small-en-v1.5|onnx/model.onnx|384|512|cls|none
text|BAAI/bge-small-en-v1.5|Qdrant/bge-small-en-v1.5-onnx-Q|model_optimized.onnx|384|512|cls|fp16
text|nomic-ai/nomic-embed-text-v1|nomic-ai/nomic-embed-text-v1|onnx/model.onnx|768|8192|mean|none
text|nomic-ai/nomic-embed-text-v1.5|nomic-ai/nomic-embed-text-v1.5|onnx/model.onnx|768|8192|mean|none
text|nomic-ai/nomic-embed-text-v1.5|nomic-ai/nomic-embed-text-v1.5|onnx/model_quantized.onnx|768|8192|mean|dynamic
text|sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2|Xenova/paraphrase-multilingual-MiniLM-L12-v2|onnx/model.onnx|384|512|mean|none
text|sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2|Qdrant/paraphrase-multilingual-MiniLM-L12-v2-onnx-Q|model_optimized.onnx|384|512|mean|fp16
text|sentence-transformers/paraphrase-multilingual-mpnet-base-v2|Xenova/paraphrase-multilingual-mpnet-base-v2|onnx/model.onnx|768|512|mean|none
text|BAAI/bge-small-zh-v1.5|Xenova/bge-small-zh-v1.5|onnx/model.onnx|512|512|cls|none
text|BAAI/bge-large-zh-v1.5|Xenova/bge-large-zh-v1.5|onnx/model.onnx|1024|512|cls|none
text|BAAI/bge-m3|BAAI/bge-m3|onnx/model.onnx|1024|8192|cls|none
text|lightonai/modernbert-embed-large|lightonai/modernbert-embed-large|onnx/model.onnx|1024|8192|mean|none
text|intfloat/multilingual-e5-small|intfloat/multilingual-e5-small|onnx/model.onnx|384|512|mean|none
text|intfloat/multilingual-e5-base|intfloat/multilingual-e5-base|onnx/model.onnx|768|512|mean|none
text|intfloat/multilingual-e5-large|Qdrant/multilingual-e5-large-onnx|model.onnx|1024|512|mean|none
text|mixedbread-ai/mxbai-embed-large-v1|mixedbread-ai/mxbai-embed-large-v1|onnx/model.onnx|1024|512|cls|none
text|mixedbread-ai/mxbai-embed-large-v1|mixedbread-ai/mxbai-embed-large-v1|onnx/model_quantized.onnx|1024|512|cls|dynamic
text|Alibaba-NLP/gte-base-en-v1.5|Alibaba-NLP/gte-base-en-v1.5|onnx/model.onnx|768|8192|cls|none
text|Alibaba-NLP/gte-base-en-v1.5|Alibaba-NLP/gte-base-en-v1.5|onnx/model_quantized.onnx|768|8192|cls|dynamic
text|Alibaba-NLP/gte-large-en-v1.5|Alibaba-NLP/gte-large-en-v1.5|onnx/model.onnx|1024|8192|cls|none
text|Alibaba-NLP/gte-large-en-v1.5|Alibaba-NLP/gte-large-en-v1.5|onnx/model_quantized.onnx|1024|8192|cls|dynamic
text|openai/clip-vit-base-patch32|Qdrant/clip-ViT-B-32-text|model.onnx|512|77|mean|none
text|jinaai/jina-embeddings-v2-base-code|jinaai/jina-embeddings-v2-base-code|onnx/model.onnx|768|8192|mean|none
text|jinaai/jina-embeddings-v2-base-en|jinaai/jina-embeddings-v2-base-en|model.onnx|768|8192|mean|none
text|google/embeddinggemma-300m|onnx-community/embeddinggemma-300m-ONNX|onnx/model.onnx|768|2048|mean|none
text|snowflake/snowflake-arctic-embed-xs|snowflake/snowflake-arctic-embed-xs|onnx/model.onnx|384|512|cls|none
text|snowflake/snowflake-arctic-embed-xs|snowflake/snowflake-arctic-embed-xs|onnx/model_quantized.onnx|384|512|cls|dynamic
text|snowflake/snowflake-arctic-embed-s|snowflake/snowflake-arctic-embed-s|onnx/model.onnx|384|512|cls|none
text|snowflake/snowflake-arctic-embed-s|snowflake/snowflake-arctic-embed-s|onnx/model_quantized.onnx|384|512|cls|dynamic
text|snowflake/snowflake-arctic-embed-m|Snowflake/snowflake-arctic-embed-m|onnx/model.onnx|768|512|cls|none
text|snowflake/snowflake-arctic-embed-m|Snowflake/snowflake-arctic-embed-m|onnx/model_quantized.onnx|768|512|cls|dynamic
text|snowflake/snowflake-arctic-embed-m-long|snowflake/snowflake-arctic-embed-m-long|onnx/model.onnx|768|2048|cls|none
text|snowflake/snowflake-arctic-embed-m-long|snowflake/snowflake-arctic-embed-m-long|onnx/model_quantized.onnx|768|2048|cls|dynamic
text|snowflake/snowflake-arctic-embed-l|snowflake/snowflake-arctic-embed-l|onnx/model.onnx|1024|512|cls|none
text|snowflake/snowflake-arctic-embed-l|snowflake/snowflake-arctic-embed-l|onnx/model_quantized.onnx|1024|512|cls|dynamic
text|BAAI/bge-small-en-v1.5|onnx-community/bge-small-en-v1.5-ONNX|onnx/model_quantized.onnx|384|512|cls|dynamic
sparse|prithivida/Splade_PP_en_v1|Qdrant/Splade_PP_en_v1|model.onnx|0|512||none
sparse|BAAI/bge-m3|BAAI/bge-m3|onnx/model.onnx|0|8192||none
image|openai/clip-vit-base-patch32|Qdrant/clip-ViT-B-32-vision|model.onnx|512|0||none
image|microsoft/resnet-50|Qdrant/resnet50-onnx|model.onnx|2048|0||none
image|open-metric-learning/unicom-vit-b-16|Qdrant/Unicom-ViT-B-16|model.onnx|768|0||none
image|open-metric-learning/unicom-vit-b-32|Qdrant/Unicom-ViT-B-32|model.onnx|512|0||none
image|nomic-ai/nomic-embed-vision-v1.5|nomic-ai/nomic-embed-vision-v1.5|onnx/model.onnx|768|0||none
image|openai/clip-vit-base-patch32-quantized|Xenova/clip-vit-base-patch32|onnx/vision_model_int8.onnx|512|0||static
reranker|BAAI/bge-reranker-base|BAAI/bge-reranker-base|onnx/model.onnx|0|512||none
reranker|BAAI/bge-reranker-v2-m3|rozgo/bge-reranker-v2-m3|model.onnx|0|512||none
reranker|jinaai/jina-reranker-v1-turbo-en|jinaai/jina-reranker-v1-turbo-en|onnx/model.onnx|0|8192||none
reranker|jinaai/jina-reranker-v2-base-multilingual|jinaai/jina-reranker-v2-base-multilingual|onnx/model.onnx|0|8192||none
reranker|jinaai/jina-reranker-v1-turbo-en-quantized|jinaai/jina-reranker-v1-turbo-en|onnx/model_quantized.onnx|0|8192||static
"""

# code|file|download size in MB.
SIZES = """
Qdrant/all-MiniLM-L6-v2-onnx|model.onnx|90
Xenova/all-MiniLM-L6-v2|onnx/model_quantized.onnx|23
Xenova/all-MiniLM-L12-v2|onnx/model.onnx|133
Xenova/all-MiniLM-L12-v2|onnx/model_quantized.onnx|34
Xenova/all-mpnet-base-v2|onnx/model.onnx|436
Xenova/bge-base-en-v1.5|onnx/model.onnx|436
Qdrant/bge-base-en-v1.5-onnx-Q|model_optimized.onnx|218
Xenova/bge-large-en-v1.5|onnx/model.onnx|1337
Qdrant/bge-large-en-v1.5-onnx-Q|model_optimized.onnx|668
Xenova/bge-small-en-v1.5|onnx/model.onnx|133
Qdrant/bge-small-en-v1.5-onnx-Q|model_optimized.onnx|66
nomic-ai/nomic-embed-text-v1|onnx/model.onnx|548
nomic-ai/nomic-embed-text-v1.5|onnx/model.onnx|547
nomic-ai/nomic-embed-text-v1.5|onnx/model_quantized.onnx|137
Xenova/paraphrase-multilingual-MiniLM-L12-v2|onnx/model.onnx|470
Qdrant/paraphrase-multilingual-MiniLM-L12-v2-onnx-Q|model_optimized.onnx|235
Xenova/paraphrase-multilingual-mpnet-base-v2|onnx/model.onnx|1110
Xenova/bge-small-zh-v1.5|onnx/model.onnx|95
Xenova/bge-large-zh-v1.5|onnx/model.onnx|1298
BAAI/bge-m3|onnx/model.onnx|2268
lightonai/modernbert-embed-large|onnx/model.onnx|1580
intfloat/multilingual-e5-small|onnx/model.onnx|470
intfloat/multilingual-e5-base|onnx/model.onnx|1110
Qdrant/multilingual-e5-large-onnx|model.onnx|2236
mixedbread-ai/mxbai-embed-large-v1|onnx/model.onnx|1337
mixedbread-ai/mxbai-embed-large-v1|onnx/model_quantized.onnx|337
Alibaba-NLP/gte-base-en-v1.5|onnx/model.onnx|556
Alibaba-NLP/gte-base-en-v1.5|onnx/model_quantized.onnx|147
Alibaba-NLP/gte-large-en-v1.5|onnx/model.onnx|1746
Alibaba-NLP/gte-large-en-v1.5|onnx/model_quantized.onnx|446
Qdrant/clip-ViT-B-32-text|model.onnx|254
jinaai/jina-embeddings-v2-base-code|onnx/model.onnx|642
jinaai/jina-embeddings-v2-base-en|model.onnx|547
onnx-community/embeddinggemma-300m-ONNX|onnx/model.onnx|1235
snowflake/snowflake-arctic-embed-xs|onnx/model.onnx|90
snowflake/snowflake-arctic-embed-xs|onnx/model_quantized.onnx|23
snowflake/snowflake-arctic-embed-s|onnx/model.onnx|133
snowflake/snowflake-arctic-embed-s|onnx/model_quantized.onnx|34
Snowflake/snowflake-arctic-embed-m|onnx/model.onnx|436
Snowflake/snowflake-arctic-embed-m|onnx/model_quantized.onnx|110
snowflake/snowflake-arctic-embed-m-long|onnx/model.onnx|548
snowflake/snowflake-arctic-embed-m-long|onnx/model_quantized.onnx|138
snowflake/snowflake-arctic-embed-l|onnx/model.onnx|1337
snowflake/snowflake-arctic-embed-l|onnx/model_quantized.onnx|337
onnx-community/bge-small-en-v1.5-ONNX|onnx/model_quantized.onnx|34
Qdrant/Splade_PP_en_v1|model.onnx|532
Qdrant/clip-ViT-B-32-vision|model.onnx|352
Qdrant/resnet50-onnx|model.onnx|94
Qdrant/Unicom-ViT-B-16|model.onnx|808
Qdrant/Unicom-ViT-B-32|model.onnx|467
nomic-ai/nomic-embed-vision-v1.5|onnx/model.onnx|374
Xenova/clip-vit-base-patch32|onnx/vision_model_int8.onnx|89
BAAI/bge-reranker-base|onnx/model.onnx|1112
rozgo/bge-reranker-v2-m3|model.onnx|2271
jinaai/jina-reranker-v1-turbo-en|onnx/model.onnx|151
jinaai/jina-reranker-v2-base-multilingual|onnx/model.onnx|1114
jinaai/jina-reranker-v1-turbo-en|onnx/model_quantized.onnx|38
"""

# kind|code|file|further files of the model.
ADDITIONAL_FILES = """
text|BAAI/bge-m3|onnx/model.onnx|onnx/model.onnx_data
text|BAAI/bge-m3|onnx/model.onnx|onnx/Constant_7_attr__value
text|Qdrant/multilingual-e5-large-onnx|model.onnx|model.onnx_data
text|onnx-community/embeddinggemma-300m-ONNX|onnx/model.onnx|onnx/model.onnx_data
text|onnx-community/bge-small-en-v1.5-ONNX|onnx/model_quantized.onnx|onnx/model_quantized.onnx_data
sparse|BAAI/bge-m3|onnx/model.onnx|onnx/model.onnx_data
sparse|BAAI/bge-m3|onnx/model.onnx|onnx/Constant_7_attr__value
reranker|rozgo/bge-reranker-v2-m3|model.onnx|model.onnx.data
"""

# kind|name|repository and file|base model|dim|million parameters|size in MB|retrieval score|recommended sessions, best first.
GGUF_MODELS = """
dense|Snowflake-XS-Q4|ChristianAzinn/snowflake-arctic-embed-xs-gguf/snowflake-arctic-embed-xs--Q4_K_M.GGUF|snowflake/snowflake-arctic-embed-xs|384|22|20|50.2|4
dense|MiniLM-L6-Q4|second-state/All-MiniLM-L6-v2-Embedding-GGUF/all-MiniLM-L6-v2-Q4_K_M.gguf|sentence-transformers/all-MiniLM-L6-v2|384|22|20|41.9|4
dense|MiniLM-L6-Q8|second-state/All-MiniLM-L6-v2-Embedding-GGUF/all-MiniLM-L6-v2-Q8_0.gguf|sentence-transformers/all-MiniLM-L6-v2|384|22|24|41.9|4
dense|Snowflake-S-Q4|ChristianAzinn/snowflake-arctic-embed-s-gguf/snowflake-arctic-embed-s--Q4_K_M.GGUF|snowflake/snowflake-arctic-embed-s|384|33|28|52.0|4
dense|E5-small-Q4|ChristianAzinn/e5-small-v2-gguf/e5-small-v2.Q4_K_M.gguf|intfloat/e5-small-v2|384|33|28|46.0|4
dense|GIST-small-Q4|ChristianAzinn/gist-small-embedding-v0-gguf/gist-small-embedding-v0.Q4_K_M.gguf|avsolatorio/GIST-small-Embedding-v0|384|33|28|48.0|4
reranker|BGE-Reranker-v2-M3|smarttasks/bge-reranker-v2-m3-GGUF/bge-reranker-v2-m3-Q4_K_M.gguf|BAAI/bge-reranker-v2-m3|0|560|438|0.0|4
reranker|BGE-Reranker-Base|sinjab/bge-reranker-base-Q4_K_M-GGUF/bge-reranker-base-Q4_K_M.gguf|BAAI/bge-reranker-base|0|110|219|0.0|4
reranker|BGE-Reranker-Large|sinjab/bge-reranker-large-Q4_K_M-GGUF/bge-reranker-large-Q4_K_M.gguf|BAAI/bge-reranker-large|0|560|407|0.0|4
reranker|Qwen3-Reranker-0.6B|sinjab/Qwen3-Reranker-0.6B-Q4_K_M-GGUF/Qwen3-Reranker-0.6B-Q4_K_M.gguf|Qwen/Qwen3-Reranker-0.6B|0|600|396|0.0|4
reranker|Jina-Reranker-v1-Turbo-En|sinjab/jina-reranker-v1-turbo-en-Q8_0-GGUF/jina-reranker-v1-turbo-en-Q8_0.gguf|jinaai/jina-reranker-v1-turbo-en|0|38|36|0.0|4
sparse|SPLADE-PP-En-v1-GGUF|cstr/splade-pp-en-v1-GGUF/splade-pp-en-v1-q8_0.gguf|prithivida/Splade_PP_en_v1|30522|110|112|0.0|1
"""

# code|licence, of models that are refused unless allowed.
RESTRICTED = """
jinaai/jina-reranker-v2-base-multilingual|CC-BY-NC-4.0
onnx-community/embeddinggemma-300m-ONNX|Gemma Terms of Use
"""

# mode|model.
MODES = """
fast|sentence-transformers/all-MiniLM-L6-v2
balanced|BAAI/bge-small-en-v1.5
quality|BAAI/bge-base-en-v1.5
"""

CLS_NAMES = ("bge", "snowflake", "arctic", "gte", "mxbai")
#: Download size in MB that a phone may take.
MOBILE_LIMIT_MB = 150
# Bits of the capability mask of a model file, and the tensor that shows each.
CAPABILITIES = {"dense": 0, "splade": 1, "splade_bias": 2, "sparse_linear": 3, "colbert": 4, "reranker": 5, "tied_decoder": 6, "special_tokens": 7}
HEADS = {"splade": "mlm_transform.weight", "sparse_linear": "sparse_linear.weight", "colbert": "colbert_linear.weight", "reranker": "classifier.dense.weight"}


def _frame(spark: SparkSession, text: str, schema: str) -> DataFrame:
    kinds = [c.split()[1] for c in schema.split(", ")]
    change = {"int": int, "double": float, "string": str}
    rows = [tuple(change[k](v) for k, v in zip(kinds, line.split("|"), strict=True)) for line in text.strip().splitlines()]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ordinal int, {schema}")


def models(spark: SparkSession) -> DataFrame:
    """All rows in registry order, each with a description made from what they say."""
    rows = _frame(spark, MODELS, "kind string, name string, code string, file string, dim int, max_tokens int, pooling string, quantization string")
    said = F.concat(F.col("kind"), F.lit(" model of dimension "), F.col("dim"), F.lit(", up to "), F.col("max_tokens"), F.lit(" tokens, "), F.col("pooling"), F.lit(" pooling, quantization: "), F.col("quantization"))
    return rows.withColumn("description", said)


def sizes(spark: SparkSession) -> DataFrame:
    return _frame(spark, SIZES, "code string, file string, size_mb int").drop("ordinal")


def additional_files(spark: SparkSession) -> DataFrame:
    return _frame(spark, ADDITIONAL_FILES, "kind string, code string, file string, extra string").drop("ordinal")


def gguf_models(spark: SparkSession) -> DataFrame:
    return _frame(spark, GGUF_MODELS, "kind string, name string, path string, base string, dim int, params_m int, size_mb int, score double, sessions int")


def restricted(spark: SparkSession) -> DataFrame:
    return _frame(spark, RESTRICTED, "code string, licence string").drop("ordinal")


def modes(spark: SparkSession) -> DataFrame:
    return _frame(spark, MODES, "mode string, name string").drop("ordinal")


def mode_model(mode: str) -> str:
    """The model's name of a mode, whatever its case."""
    known = dict(line.split("|") for line in MODES.strip().splitlines())
    if mode.lower() not in known:
        raise ValueError(f"unknown mode {mode!r}, only {sorted(known)}")
    return known[mode.lower()]


def with_sizes(spark: SparkSession) -> DataFrame:
    return models(spark).join(sizes(spark), ["code", "file"], "left")


def mobile_models(spark: SparkSession, limit_mb: int = MOBILE_LIMIT_MB) -> DataFrame:
    """Models of a known size within the limit; 0 sets none."""
    rows = with_sizes(spark)
    return rows.where(F.col("size_mb").between(0, limit_mb)) if limit_mb > 0 else rows


def allowed_models(spark: SparkSession) -> DataFrame:
    return models(spark).join(restricted(spark), "code", "left_anti")


def _first(matches: DataFrame, wanted: str = "wanted") -> DataFrame:
    return matches.withColumn("_r", F.row_number().over(W.partitionBy(wanted).orderBy("_step", "ordinal"))).where("_r = 1").drop("_r", "_step")


def resolve(spark: SparkSession, wanted: DataFrame, kind: str = "text") -> DataFrame:
    """The first model of a kind for each ``wanted``: by exact code, else by exact name."""
    rows = models(spark).where(F.col("kind") == kind)
    step = F.when(F.col("code") == F.col("wanted"), 1).when(F.col("name") == F.col("wanted"), 2)
    return _first(F.broadcast(rows).join(wanted, step.isNotNull()).withColumn("_step", step))


def _slashes(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit("\\"), F.lit("/"))


def resolve_fuzzy(spark: SparkSession, wanted: DataFrame, kind: str = "text") -> DataFrame:
    """By exact code, else the first whose name or code equals the wanted one in lower case, or ends in its last path part, or
    contains it without dashes and underscores."""
    rows = models(spark).where(F.col("kind") == kind)
    w, key = _slashes(F.col("wanted")), lambda c: F.regexp_replace(c, "[-_]", "")
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    match = F.lit(False)
    for c in (_slashes(F.col("name")), _slashes(F.col("code"))):
        match = match | (c == w) | (last(c) == last(w)) | F.contains(key(c), key(w))
    step = F.when(F.col("code") == F.col("wanted"), 1).when(match, 2)
    return _first(F.broadcast(rows).join(wanted, step.isNotNull()).withColumn("_step", step))


def resolve_gguf(spark: SparkSession, wanted: DataFrame) -> DataFrame:
    """The first model file whose name contains the wanted one without regard to case; sparse ones by exact name only."""
    rows = gguf_models(spark)
    step = F.when((F.col("kind") == "sparse") & (F.col("name") == F.col("wanted")), 1).when((F.col("kind") != "sparse") & F.contains(F.lower("name"), F.lower("wanted")), 2)
    return _first(F.broadcast(rows).join(wanted, step.isNotNull()).withColumn("_step", step))


def variants(spark: SparkSession) -> DataFrame:
    """(name, slot, quantization, code, file): the plain row in slot 0, then dynamic, fp16 and static ones."""
    slot = F.when(F.col("quantization") == "none", 0).when(F.col("quantization") == "dynamic", 1).when(F.col("quantization") == "fp16", 2).otherwise(3)
    return models(spark).where("kind = 'text'").select("name", slot.alias("slot"), "quantization", "code", "file", "ordinal")


def quantized_variant(spark: SparkSession, name: str, quantization: str) -> DataFrame:
    """The rows of a variant; without any, an error that lists those there are."""
    rows = models(spark).where((F.col("kind") == "text") & (F.col("name") == name))
    have = sorted({r["quantization"] for r in rows.select("quantization").collect()})
    if quantization not in have:
        raise ValueError(f"{name} has no {quantization} variant, only {have}")
    return rows.where(F.col("quantization") == quantization)


def infer_pooling(path: Column | str) -> Column:
    base = F.translate(F.regexp_extract(path, r"([^/\\]*)$", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(base.rlike("|".join(CLS_NAMES)), "cls").otherwise("mean")


def capability_mask(tensors: Column, has_special: Column | None = None) -> Column:
    """Bits of what a model file with these tensors can do; 0 without token embeddings."""
    has = lambda name: F.array_contains(tensors, name)
    bit = lambda name, on: F.when(on, 1 << CAPABILITIES[name]).otherwise(0)
    mask = F.lit(1 << CAPABILITIES["dense"])
    for name, tensor in HEADS.items():
        mask = mask.bitwiseOR(bit(name, has(tensor)))
    splade = has(HEADS["splade"])
    mask = mask.bitwiseOR(bit("splade_bias", splade & has("mlm_bias"))).bitwiseOR(bit("tied_decoder", splade & ~has("mlm_head.weight")))
    if has_special is not None:
        mask = mask.bitwiseOR(bit("special_tokens", has_special))
    return F.when(has("token_embd.weight"), mask).otherwise(0).cast("long")


def sparse_formula(mask: Column, out_dim: Column, vocab: Column) -> Column:
    """splade, scalar or unknown: by the heads, and with both by the shape of the linear one."""
    splade, linear = mask.bitwiseAND(2) != 0, mask.bitwiseAND(8) != 0
    both = F.when(vocab.isNotNull() & (out_dim == 1), "scalar").when(vocab.isNotNull() & (out_dim == vocab), "splade").otherwise("unknown")
    return F.when(splade & linear, both).when(splade, "splade").when(linear, "scalar").otherwise("unknown")
