"""Images as rows of bytes: decoding, preprocessing and embedding."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sparkvec.sources.readers import IMAGE_SIDE, preprocess_image

_PNG = b"\x89PNG\r\n\x1a\n"
#: Channels of a pixel by the colour type of a PNG file.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Most pixels of an image that is decoded.
MOST_PIXELS = 100_000_000


def _unfilter(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes from a PNG file's filtered rows, each with its filter's number first."""
    rows = raw.reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + step), np.uint8)  # a row of zeros above, a pixel of zeros to the left
    for y in range(height):
        kind, line, above, own = rows[y, 0], rows[y, 1:], out[y], out[y + 1]
        if kind == 0:
            own[step:] = line
        elif kind == 2:
            own[step:] = line + above[step:]
        elif kind == 1:
            own[step:] = np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind in (3, 4):
            a, up, new = own.tolist(), above.tolist(), line.tolist()
            for x in range(step, stride + step):
                left, top = a[x - step], up[x]
                if kind == 3:
                    guess = (left + top) // 2
                else:
                    corner = up[x - step]
                    p = left + top - corner
                    d = abs(p - left), abs(p - top), abs(p - corner)
                    guess = left if d[0] <= d[1] and d[0] <= d[2] else top if d[1] <= d[2] else corner
                a[x] = (new[x - step] + guess) & 255
            own[:] = a
        else:
            raise ValueError(f"unknown filter {kind}")
    return out[1:, step:]


def decode_png(raw: bytes) -> np.ndarray:
    """Height x width x 3 bytes of an 8-bit PNG file that is not interlaced; transparency is dropped."""
    at, data, palette, head = len(_PNG), [], None, None
    while at + 8 <= len(raw):
        size, name = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        at += size + 12
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data.append(body)
        elif name == b"IEND":
            break
    if head is None or head[2] != 8 or head[6] or head[3] not in _CHANNELS or not 0 < head[0] * head[1] <= MOST_PIXELS:
        raise ValueError("only 8-bit PNG images that are not interlaced")
    width, height, channels = head[0], head[1], _CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    pixels = _unfilter(rows, height, width * channels, channels).reshape(height, width, channels)
    if head[3] == 3:
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3]


def decode_ppm(raw: bytes) -> np.ndarray:
    """Pixels of a binary PPM or PGM file of 8 bits."""
    fields, at = [], 0
    while len(fields) < 4:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while not raw[end : end + 1].isspace():
            end += 1
        fields.append(raw[at:end])
        at = end
    kind, width, height, most = fields[0], *(int(x) for x in fields[1:])
    channels = {b"P6": 3, b"P5": 1}.get(kind)
    if channels is None or most > 255 or width * height > MOST_PIXELS:
        raise ValueError("only binary PPM and PGM images of 8 bits")
    pixels = np.frombuffer(raw, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels


def decode_image(raw: bytes) -> np.ndarray:
    """Height x width x 3 bytes: PNG, PPM and PGM here, other formats by Pillow where it is installed."""
    if raw[:8] == _PNG:
        return decode_png(raw)
    if raw[:2] in (b"P5", b"P6"):
        return decode_ppm(raw)
    try:
        from io import BytesIO

        from PIL import Image
    except ImportError:
        raise ValueError("only PNG, PPM and PGM images without Pillow") from None
    return np.asarray(Image.open(BytesIO(raw)).convert("RGB"))


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, pixels) of image files that the JVM decodes (JPEG, PNG, GIF, BMP); pixels are RGB bytes, row by row."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").where("nChannels in (3, 4)")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pixels = [np.frombuffer(d, np.uint8).reshape(h, w, c)[:, :, 2::-1].tobytes() for d, h, w, c in zip(pdf["data"], pdf["height"], pdf["width"], pdf["nChannels"], strict=True)]
            yield pd.DataFrame({"path": pdf["origin"], "height": pdf["height"], "width": pdf["width"], "pixels": pixels})

    return rows.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "path string, height int, width int, pixels binary")


def preprocess(images: DataFrame, content: str = "content", side: int = IMAGE_SIDE) -> DataFrame:
    """``images`` with ``tensor``, the normalised 3 x side x side floats of their bytes, and ``diagnostic``, why there is none.
    Null bytes give neither."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), 16):  # a tensor is 600 kB
                some = pdf.iloc[at : at + 16]
                tensors, why = [], []
                for raw in some[content]:
                    tensor, reason = None, None
                    if raw is not None:
                        try:
                            tensor = preprocess_image(decode_image(bytes(raw)), side).reshape(-1)
                        except (ValueError, IndexError, struct.error, zlib.error) as e:
                            reason = str(e)
                    tensors.append(tensor)
                    why.append(reason)
                yield some.assign(tensor=tensors, diagnostic=why)

    return images.mapInPandas(run, f"{fields}, tensor array<float>, diagnostic string")


def embed_images(images: DataFrame, model, dim: int, content: str = "content", side: int = IMAGE_SIDE, batch_size: int = 8) -> DataFrame:
    """``images`` (bytes) with ``embedding``: ``model`` turns n x 3 x side x side floats into n vectors of ``dim``, which is checked,
    of unit length afterwards. Images that cannot be decoded have a diagnostic and no vector."""
    rows = preprocess(images, content, side)
    kept = [c for c in rows.columns if c != "tensor"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out: list = [None] * len(pdf)
            known = [i for i, t in enumerate(pdf["tensor"]) if t is not None]
            for a in range(0, len(known), batch_size):
                some = known[a : a + batch_size]
                out_rows = np.asarray(model(np.stack([np.asarray(pdf["tensor"].iloc[i], np.float32).reshape(3, side, side) for i in some])))
                for i, v in zip(some, unit_rows(out_rows, len(some), dim), strict=True):
                    out[i] = v.tolist()
            yield pdf[kept].assign(embedding=out)

    return rows.mapInPandas(run, f"{fields}, embedding array<float>")


def unit_rows(values: np.ndarray, n: int, dim: int) -> np.ndarray:
    """n vectors of unit length; an output of another size is an error."""
    if values.size != n * dim or (values.ndim and len(values) != n):
        raise ValueError(f"the model's output has {values.size} numbers for {n} images of dimension {dim}")
    v = values.reshape(n, dim).astype(np.float64)
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 1e-12).astype(np.float32)


def onnx_image_model(path: str):
    """A model file as a function for :func:`embed_images`; one session a worker process."""

    def model(batch: np.ndarray) -> np.ndarray:
        from sparkvec.plans.providers import SESSIONS

        if path not in SESSIONS:
            import onnxruntime as ort

            SESSIONS[path] = ort.InferenceSession(path, providers=["CPUExecutionProvider"])
        session = SESSIONS[path]
        return session.run(None, {session.get_inputs()[0].name: batch})[0]

    return model
