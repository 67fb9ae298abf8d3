"""Sources and sinks: benchmark collections, sparse stores, model files, images, tuning tables and reports."""

from __future__ import annotations

import json
import shutil
import struct
import uuid
from collections.abc import Iterator
from io import BytesIO
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.functions.vector import to_bytes
from sparkvec.plans import registry

#: Per-channel mean and deviation of image inputs, and their side.
IMAGE_MEAN, IMAGE_STD, IMAGE_SIDE = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), 224
# Value types of a model file's metadata, by number.
GGUF_TYPES = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}


#: Bytes of a model file that hold most headers.
HEAD_BYTES = 32 << 20
EARLY = "header ends early"
#: Rows of a report that is made on the driver, at most.
REPORT_ROWS = 10_000


def read_texts(spark: SparkSession, path: str, form: str = "parquet", text: str = "text", key: str | None = None) -> DataFrame:
    """(id, text) of a table; without a key the id is a 64-bit hash of the text, the same in every scan, so equal texts share it."""
    df = spark.read.text(path).withColumnRenamed("value", text) if form == "text" else spark.read.format(form).load(path)
    return df.select((F.col(key) if key else F.xxhash64(text)).alias("id"), F.col(text).alias("text"))


def natural_key(c) -> list:
    """Sort columns that put ids of digits by number, before others by text."""
    number = F.expr(f"try_cast({c} as bigint)")
    return [number.isNull(), number, F.col(c)]


def load_collection(spark: SparkSession, root: str, split: str = "test", max_docs: int = 0, max_queries: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, queries, qrels) of corpus.jsonl, queries.jsonl and qrels/<split>.tsv. Only grades over 0 count; queries are the first
    by number; all relevant documents stay, then others by position in the file."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{root}/corpus.jsonl")
    place = F.monotonically_increasing_id().alias("place")
    docs = corpus.select(F.col("_id").alias("d"), F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), "text")).alias("text"), place)
    queries = spark.read.schema("_id string, text string").json(f"{root}/queries.jsonl").select(F.col("_id").alias("q"), "text")
    raw = spark.read.option("sep", "\t").option("header", True).schema("q string, d string, grade int").csv(f"{root}/qrels/{split}.tsv")
    qrels = raw.where("grade > 0")
    queries = queries.join(qrels.select("q").distinct(), "q", "left_semi")
    if max_queries > 0:
        queries = queries.orderBy(*natural_key("q")).limit(max_queries)
    qrels = qrels.join(queries.select("q"), "q", "left_semi")
    if max_docs > 0:
        marked = docs.join(qrels.select("d").distinct().withColumn("rel", F.lit(1)), "d", "left")
        relevant = marked.where("rel = 1").select("d", "text", "place")
        room = max(0, max_docs - relevant.count())
        docs = relevant.union(marked.where("rel is null").select("d", "text", "place").orderBy("place").limit(room))
    return docs, queries, qrels


def write_sparse(vectors: DataFrame, path: str) -> None:
    vectors.select("id", "indices", "values").write.mode("overwrite").parquet(path)


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csr(spark: SparkSession, offsets: np.ndarray, indices: np.ndarray, values: np.ndarray) -> DataFrame:
    """(id, indices, values) of arrays that are on the driver already."""
    rows = [(i, indices[a:b].tolist(), values[a:b].astype(float).tolist()) for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True))]
    return spark.createDataFrame(rows, "id long, indices array<int>, values array<float>")


def save_npz(vectors: DataFrame, path: str, most: int = 1_000_000) -> int:
    """Write up to ``most`` vectors (id, indices, values) in order of id as one npz file of the driver: offsets, indices and values
    as arrays. Returns how many there are; more are an error, for which :func:`write_sparse` is the way."""
    rows = vectors.orderBy("id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} vectors: use write_sparse()")
    offsets = np.concatenate([[0], np.cumsum([len(r["indices"]) for r in rows])]).astype(np.int64)
    flat = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.asarray(r[name], kind) for r in rows)])
    np.savez(path, offsets=offsets, indices=flat("indices", np.int32), values=flat("values", np.float32))
    return len(rows)


def load_npz(spark: SparkSession, path: str) -> DataFrame:
    """(id, indices, values) of npz files of :func:`save_npz`, read where they are and parsed by the executors; ``path`` in front of
    the id tells several files apart."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(BytesIO(bytes(raw)), allow_pickle=False) as held:
                    offsets, indices, values = (held[k] for k in ("offsets", "indices", "values"))
                for at in range(0, len(offsets) - 1, 4096):
                    ids = range(at, min(at + 4096, len(offsets) - 1))
                    cut = lambda x, ids=ids, offsets=offsets: [x[offsets[i] : offsets[i + 1]] for i in ids]
                    yield pd.DataFrame({"path": name, "id": list(ids), "indices": cut(indices), "values": cut(values)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, id long, indices array<int>, values array<float>")


def parse_gguf(raw: bytes) -> dict:
    """Metadata and tensors of a model file's header; ``diagnostic`` says why it is not usable."""
    out: dict = {"meta": {}, "tensors": {}, "places": {}, "data": 0, "diagnostic": ""}
    at = 0

    def take(form: str):
        nonlocal at
        size = struct.calcsize("<" + form)
        if at + size > len(raw):
            raise ValueError(EARLY)
        value = struct.unpack_from("<" + form, raw, at)[0]
        at += size
        return value

    def string() -> str:
        nonlocal at
        n = take("Q")
        if at + n > len(raw):
            raise ValueError(EARLY)
        at += n
        return raw[at - n : at].decode("utf-8", "replace")

    def value(kind: int, depth: int = 0):
        if kind == 8:
            return string()
        if kind == 9:
            if depth:
                raise ValueError("nested array")
            of, n = take("I"), take("Q")
            if n > len(raw):
                raise ValueError(EARLY)
            return [value(of, 1) for _ in range(n)]
        if kind not in GGUF_TYPES:
            raise ValueError(f"unknown type {kind}")
        return take(GGUF_TYPES[kind])

    try:
        if raw[:4] != b"GGUF":
            raise ValueError("not a readable GGUF file")
        at = 4
        take("I")
        n_tensors, n_meta = take("Q"), take("Q")
        for _ in range(n_meta):
            key = string()
            out["meta"][key] = value(take("I"))
        for _ in range(n_tensors):
            name = string()
            shape = [take("Q") for _ in range(take("I"))]
            out["tensors"][name] = shape
            out["places"][name] = (take("I"), take("Q"))
        step = int(out["meta"].get("general.alignment", 32))
        out["data"] = -(-at // step) * step
    except (ValueError, struct.error) as e:
        out["diagnostic"] = str(e)
    return out


def gguf_tensors(raw: bytes) -> dict[str, np.ndarray]:
    """Tensors of a model file as floats, rows first: 32-bit, 16-bit and 8-bit ones in blocks of 32 with a 16-bit scale."""
    head = parse_gguf(raw)
    if head["diagnostic"]:
        raise ValueError(head["diagnostic"])
    out = {}
    for name, shape in head["tensors"].items():
        kind, offset = head["places"][name]
        at, n = head["data"] + offset, int(np.prod(shape, dtype=np.int64))
        if kind in (0, 1):
            flat = np.frombuffer(raw, "<f4" if kind == 0 else "<f2", n, at).astype(np.float32)
        elif kind == 8:
            blocks = np.frombuffer(raw, np.dtype([("scale", "<f2"), ("q", "i1", 32)]), n // 32, at)
            flat = (blocks["q"].astype(np.float32) * blocks["scale"].astype(np.float32)[:, None]).reshape(-1)
        else:
            raise ValueError(f"{name} is of a kind that is not read: {kind}")
        out[name] = flat.reshape(shape[::-1])
    return out


_GGUF = "path string, architecture string, name string, vocab_size int, embedding_length int, block_count int, context_length int, n_tensors long, tensors array<string>, sparse_out long, has_special boolean, diagnostic string"


def inspect_gguf(spark: SparkSession, path: str, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """One row for each model file: its hyperparameters (null where the file does not say), capability bits and sparse formula.

    Only the first ``HEAD_BYTES`` of a file go to Python; files whose header is longer are read again whole, which Spark can
    up to 2 GB."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for p, raw in zip(pdf["path"], pdf["head"], strict=True):
                d = parse_gguf(bytes(raw))
                m, arch = d["meta"], d["meta"].get("general.architecture")
                own = lambda k, m=m, arch=arch: m.get(f"{arch}.{k}")
                vocab = own("vocab_size") or (len(m["tokenizer.ggml.tokens"]) if isinstance(m.get("tokenizer.ggml.tokens"), list) else None)
                shape = d["tensors"].get("sparse_linear.weight")
                diagnostic = d["diagnostic"] or ("" if "token_embd.weight" in d["tensors"] else "missing encoder tensor 'token_embd.weight'")
                rows.append((p, arch, m.get("general.name"), vocab, own("embedding_length"), own("block_count"), own("context_length"), len(d["tensors"]), sorted(d["tensors"]), shape[-1] if shape else None, any(k.endswith("_token_id") for k in m), diagnostic))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _GGUF.split(", ")])
            for c in ("vocab_size", "embedding_length", "block_count", "context_length"):
                out[c] = out[c].astype("Int32")
            out["sparse_out"] = out["sparse_out"].astype("Int64")
            yield out

    found = spark.read.format("binaryFile").load(path)
    heads = found.select("path", F.substring("content", 1, head_bytes).alias("head")).mapInPandas(run, _GGUF)
    early = F.col("diagnostic") == EARLY
    again = found.join(heads.where(early).select("path"), "path", "left_semi").where(F.col("length") > head_bytes)
    long = again.select("path", F.col("content").alias("head")).mapInPandas(run, _GGUF)
    files = heads.join(long.select("path"), "path", "left_anti").unionByName(long)
    mask = registry.capability_mask(F.col("tensors"), F.col("has_special"))
    rows = files.withColumn("mask", mask)
    unsound = (F.col("mask").bitwiseAND(10) != 0) & F.col("vocab_size").isNull()
    formula = F.when(unsound, "unknown").otherwise(registry.sparse_formula(F.col("mask"), F.col("sparse_out"), F.col("vocab_size")))
    return rows.select(
        *[c.split()[0] for c in _GGUF.split(", ")[:8]],
        F.when(unsound, F.col("mask").bitwiseAND(~10)).otherwise(F.col("mask")).alias("capabilities"),
        formula.alias("sparse_formula"),
        F.when((F.col("diagnostic") == "") & unsound, "sparse head present but the vocabulary size is absent").otherwise(F.col("diagnostic")).alias("diagnostic"),
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of image files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def preprocess_image(pixels: np.ndarray, side: int = IMAGE_SIDE) -> np.ndarray:
    """Height x width x 3 bytes to normalised 3 x side x side floats: short side by bilinear resampling, then the centre."""
    h, w, _ = pixels.shape
    scale = side / min(h, w)
    nh, nw = max(side, round(h * scale)), max(side, round(w * scale))
    ys, xs = (np.clip((np.arange(n) + 0.5) * o / n - 0.5, 0, o - 1) for n, o in ((nh, h), (nw, w)))
    y0, x0 = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    p = pixels.astype(np.float32)
    big = (p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx) * (1 - fy) + (p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx) * fy
    top, left = (nh - side) // 2, (nw - side) // 2
    cut = big[top : top + side, left : left + side] / 255
    return ((cut - np.array(IMAGE_MEAN)) / np.array(IMAGE_STD)).transpose(2, 0, 1).astype(np.float32)


def stale_files(files: DataFrame, keep: DataFrame) -> DataFrame:
    """(n, bytes) of cached files (model, path, size) whose model is not kept: a dry run of a clean-up."""
    return files.join(keep.select("model"), "model", "left_anti").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def clean_cache(folder: str, keep: list[str], repositories: dict[str, str], dry_run: bool = True) -> tuple[int, int]:
    """(n, bytes) of a local cache folder's model folders that are not kept, deleted unless it is a dry run. A kept name holds its own
    folder and those of the ``repositories`` (by model name) that it or its name in the registry stands for, whatever the case."""
    root = Path(folder)
    if not root.is_dir():
        return 0, 0
    wanted = {k.lower() for k in keep}
    names = wanted | {repo.lower() for name, repo in repositories.items() if name.lower() in wanted or repo.lower() in wanted}
    held = {f"models--{n.replace('/', '--')}" for n in names}
    gone = [p for p in sorted(root.iterdir()) if p.is_dir() and p.name.startswith("models--") and p.name.lower() not in held]
    size = sum(f.stat().st_size for p in gone for f in p.rglob("*") if f.is_file() and not f.is_symlink())
    if not dry_run:
        for p in gone:
            shutil.rmtree(p)
    return len(gone), size


def write_tuning(table: DataFrame, path: str) -> None:
    """Tuning results by key, in a folder of their own for each call, which the commit of the write makes whole or not at all; of equal
    keys the latest row counts (:func:`read_tuning`)."""
    at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/run={uuid.uuid4().hex}")
    part = f"{path}/_{at.getName()}"
    table.write.mode("errorifexists").parquet(part)
    source = table.sparkSession._jvm.org.apache.hadoop.fs.Path(part)
    if not source.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).rename(source, at):
        raise OSError(f"cannot move {part} to {at}")


def read_tuning(spark: SparkSession, path: str, identity: dict[str, str]) -> DataFrame:
    """The latest row of each key whose identity columns still hold."""
    rows = spark.read.parquet(path).drop("run")
    for column, value in identity.items():
        rows = rows.where(F.col(column) == value)
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("at")))).where("_r = 1").drop("_r")


def _all_rows(rows: DataFrame, most: int) -> list:
    """All rows of a summary table; an error if there are more than ``most``."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of over {most} rows: use write_report()")
    return found


def report_json(rows: DataFrame, meta: dict, most: int = REPORT_ROWS) -> str:
    """A report of a summary table of up to ``most`` rows."""
    return json.dumps({"meta": meta, "rows": [r.asDict(recursive=True) for r in _all_rows(rows, most)]}, default=str, sort_keys=True)


def report_markdown(rows: DataFrame, most: int = REPORT_ROWS) -> str:
    names = rows.columns
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(str(r[n]) for n in names) + " |" for r in _all_rows(rows, most)])


def write_report(rows: DataFrame, path: str) -> None:
    """A report of any number of rows, as files of JSON lines."""
    rows.write.mode("errorifexists").json(path)


def write_raw(vectors: DataFrame, path: str, column: str = "v") -> None:
    """Vectors as raw little-endian float32 bytes beside their ids."""
    vectors.select("id", to_bytes(column).alias("raw")).write.mode("errorifexists").parquet(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) of :func:`write_raw`."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"id": pdf["id"], "v": [None if r is None else np.frombuffer(r, "<f4") for r in pdf["raw"]]})

    rows = spark.read.parquet(path)
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<float>")
