"""Dense vector expressions. Vectors are ARRAY<FLOAT>; all folds run in double, in order of the elements."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms up to this are zero for normalisation.
ZERO_NORM = 1e-12
#: Denominators up to this are zero for the benchmark's cosine.
ZERO_DENOMINATOR = 1e-8


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def same_size(a: Column | str, b: Column | str, then: Column) -> Column:
    """``then``, but an error at run time for vectors of different lengths."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length"))).otherwise(then)


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products; 0 for null or empty vectors."""
    return F.coalesce(_sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y)), F.lit(0.0))


def squared_norm(v: Column | str) -> Column:
    return dot(v, v)


def norm(v: Column | str) -> Column:
    return F.sqrt(squared_norm(v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """dot / (norm * norm); 0 where a vector is null, empty or all zeros."""
    na, nb = squared_norm(a), squared_norm(b)
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (F.sqrt(na) * F.sqrt(nb)))


def cosine_of(product: Column, norm_a: Column, norm_b: Column) -> Column:
    """The same from a product and norms that are already there."""
    return F.when((norm_a == 0) | (norm_b == 0), 0.0).otherwise(product / (norm_a * norm_b))


def benchmark_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine with a threshold on the denominator instead of a test for zero."""
    below = norm(a) * norm(b)
    return F.when(below <= ZERO_DENOMINATOR, 0.0).otherwise(dot(a, b) / below)


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))), F.lit(0.0))


def l2_normalize(v: Column | str) -> Column:
    """v / norm as ARRAY<DOUBLE>; zeros where the norm is at most 1e-12."""
    return F.transform(_double(v), lambda x: F.when(norm(v) > ZERO_NORM, x / norm(v)).otherwise(0.0))


def scale(v: Column | str, by: Column) -> Column:
    """v / by, zeros where ``by`` is at most 1e-12; give a norm that a former step computed."""
    return F.transform(_double(v), lambda x: F.when(by > ZERO_NORM, x / by).otherwise(0.0))


def truncate(v: Column | str, k: int, dim: int | None = None) -> Column:
    """The first k elements; ``dim`` lets a k out of 1..dim fail when the plan is made."""
    if k < 1 or (dim is not None and k > dim):
        raise ValueError(f"cannot keep {k} of {dim} dimensions")
    v = F.col(v) if isinstance(v, str) else v
    return F.when(F.size(v) < k, F.raise_error(F.lit(f"vectors have fewer than {k} dimensions"))).otherwise(F.slice(v, 1, k))


def quantize_int8(v: Column | str) -> Column:
    """Min-max codes of each vector, cut toward zero; a constant vector gives zeros."""
    v = _double(v)
    low, high = F.array_min(v), F.array_max(v)
    code = lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), (x - low) / (high - low) * 255 - 128))
    return F.transform(v, lambda x: F.when(high > low, code(x)).otherwise(0.0).cast("tinyint"))


def dequantize_int8(codes: Column | str, low: Column, high: Column) -> Column:
    return F.transform(_double(codes), lambda q: (q + 128) / 255 * (high - low) + low)


def cls_pool(tokens: Column | str) -> Column:
    """The first token's vector of ARRAY<ARRAY<FLOAT>>."""
    return F.element_at(tokens, 1)


def mean_pool(tokens: Column | str, mask: Column | str) -> Column:
    """Mean of the vectors whose mask is not 0; zeros without any."""
    tokens, mask = (F.col(x) if isinstance(x, str) else x for x in (tokens, mask))
    zipped = F.zip_with(tokens, mask, lambda t, m: F.struct(t.cast("array<double>").alias("t"), m.alias("m")))
    kept = F.transform(F.filter(zipped, lambda x: x["m"] != 0), lambda x: x["t"])
    zeros = F.transform(F.element_at(tokens, 1), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zeros, lambda a, t: F.zip_with(a, t, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def as_float(v: Column | str, dtype: str = "float32") -> Column:
    """float32 stays an array; float16 is the bytes of each element's half."""
    if dtype == "float32":
        return (F.col(v) if isinstance(v, str) else v).cast("array<float>")
    if dtype != "float16":
        raise ValueError(f"dtype must be float32 or float16, not {dtype!r}")
    return _row_bytes("<f2")((F.col(v) if isinstance(v, str) else v).cast("array<float>"))


def _row_bytes(kind: str):
    """Little-endian bytes of each array of a column, by one cast over all its elements."""

    @F.arrow_udf("binary")
    def cast(v: pa.Array) -> pa.Array:
        width = np.dtype(kind).itemsize
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
        sizes = np.where(v.is_valid(), np.diff(np.asarray(v.offsets)), 0) * width
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        mask = pa.py_buffer(np.packbits(np.asarray(v.is_valid()), bitorder="little"))
        large = pa.Array.from_buffers(pa.large_binary(), len(v), [mask, pa.py_buffer(ends), pa.py_buffer(flat)])
        return large.cast(pa.binary())

    return cast


def to_bytes(v: Column | str) -> Column:
    """Little-endian float32 bytes of each vector, for raw sinks."""
    return _row_bytes("<f4")((F.col(v) if isinstance(v, str) else v).cast("array<float>"))
