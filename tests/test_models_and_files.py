"""Models, tokenizer files, images, stores, reports and tuning requests."""

import json
import os
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvec.functions import subword, vector
from sparkvec.operators import batching, retrieve, sparse, tuning
from sparkvec.plans import bert, providers, registry, resolve
from sparkvec.sources import images, readers
from sparkvec.streaming import embed as streaming
from test_operators import gather_model, gguf

TABLE = np.array([[0, 0, 1], [1, 0, 0], [0, 2, 0]], np.float32)


@pytest.fixture
def model(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    folder = tmp_path / "bge-tiny"
    folder.mkdir()
    (folder / "model.onnx").write_bytes(gather_model(TABLE))
    tokenizer = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "b": 2}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(folder / "tokenizer.json"))
    return folder


def test_model_folder(spark, model):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "b")], "id int, text string")
    vectors = lambda p: {r["id"]: r["embedding"] for r in providers.embed(df, p).collect()}
    plain = vectors(providers.model_folder(str(model), dim=3))
    assert np.allclose(plain[1], [1 / 5**0.5, 2 / 5**0.5, 0]) and plain[2] is None
    (model / "config.json").write_text(json.dumps({"hidden_size": 3, "max_position_embeddings": 16}))
    told = providers.model_folder(str(model))
    assert (told.dim, told.max_length, told.pooling) == (3, 16, "cls") and np.allclose(vectors(told)[1], [1, 0, 0])
    held = providers.OnnxProvider((model / "model.onnx").read_bytes(), (model / "tokenizer.json").read_bytes(), 3)
    assert np.allclose(vectors(held)[1], plain[1])
    (model / "config.json").unlink()
    with pytest.raises(ValueError):
        providers.model_folder(str(model))
    (model / "tokenizer.json").unlink()
    with pytest.raises(FileNotFoundError):
        providers.model_folder(str(model), dim=3)


def test_rerank_by_a_model(spark, model):
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "b", "a a"), (3, None, "a"), (4, "z", "z")], "id int, query string, text string")
    provider = providers.model_folder(str(model), dim=3)
    got = {r["id"]: r["score"] for r in providers.rerank_pairs(pairs, provider, batch_size=2).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: None, 4: 0.0}

    class Lengths:
        def score(self, pairs):
            return [len(a) - len(b) for a, b in pairs]

    got = {r["id"]: r["score"] for r in providers.rerank_pairs(pairs, Lengths(), joined=True).collect()}
    assert got == {1: 9.0, 2: 11.0, 3: None, 4: 9.0}


def test_fallback():
    def missing():
        raise FileNotFoundError("model")

    def broken():
        raise ValueError("provider")

    assert resolve.with_fallback("auto", missing, lambda: "llama") == "llama" and resolve.with_fallback("auto", lambda: "onnx", missing) == "onnx"
    assert resolve.with_fallback("llama", missing, lambda: "llama") == "llama"
    for backend, load, error in (("onnx", missing, FileNotFoundError), ("auto", broken, ValueError), ("other", missing, ValueError)):
        with pytest.raises(error):
            resolve.with_fallback(backend, load, lambda: "llama")


def test_modes(spark):
    assert registry.mode_model("FAST") == "sentence-transformers/all-MiniLM-L6-v2"
    with pytest.raises(ValueError):
        registry.mode_model("best")
    known = registry.models(spark).select("name")
    assert registry.modes(spark).join(known, "name", "left_semi").count() == 3


def test_embed_missing_with_repeated_texts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, text string")
    cached = spark.createDataFrame([("a", [9.0]), ("a", [9.0]), ("c", [1.0])], "text string, embedding array<float>")
    got = {r["id"]: r["embedding"] for r in providers.embed_missing(df, cached, providers.HashingProvider(1)).collect()}
    assert got[1] == got[2] == [9.0] and got[3] in ([1.0], [-1.0]) and got[4] is None and len(got) == 4


def bert_by_hand(w, heads, ids):
    """Logits of one text without a mask, number by number."""
    norm = lambda x, name: [(v - np.mean(x)) / np.sqrt(np.mean((np.array(x) - np.mean(x)) ** 2) + 1e-12) * a + b for v, a, b in zip(x, w[f"{name}.weight"], w[f"{name}.bias"], strict=True)]
    dense = lambda x, name: [sum(a * b for a, b in zip(row, x, strict=True)) + c for row, c in zip(w[f"{name}.weight"], w[f"{name}.bias"], strict=True)]
    gelu = lambda x: [0.5 * v * (1 + np.tanh(np.sqrt(2 / np.pi) * (v + 0.044715 * v**3))) for v in x]
    xs = [norm(w["token_embd.weight"][t] + w["position_embd.weight"][p] + w["token_type_embd.weight"][0], "embd_ln") for p, t in enumerate(ids)]
    for k in range(2):
        q, key, v = ([dense(x, f"enc.{k}.attn.{c}") for x in xs] for c in "qkv")
        size, out = len(xs[0]) // heads, []
        for i, x in enumerate(xs):
            seen = []
            for h in range(heads):
                own = slice(h * size, (h + 1) * size)
                e = np.exp([np.dot(q[i][own], other[own]) / np.sqrt(size) for other in key])
                seen += sum(a * np.array(u[own]) for a, u in zip(e / e.sum(), v, strict=True)).tolist()
            a = norm([s + t for s, t in zip(x, dense(seen, f"enc.{k}.attn.o"), strict=True)], f"enc.{k}.ln1")
            out.append(norm([s + t for s, t in zip(a, dense(gelu(dense(a, f"enc.{k}.ffn.fc1")), f"enc.{k}.ffn.fc2"), strict=True)], f"enc.{k}.ln2"))
        xs = out
    return np.array([[np.dot(norm(gelu(dense(x, "mlm_transform")), "mlm_ln"), e) + b for e, b in zip(w["token_embd.weight"], w["mlm_bias"], strict=True)] for x in xs])


def test_sparse_vectors_of_a_model_file(spark, tmp_path):
    rng = np.random.default_rng(7)
    pieces = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "the", "cat", "##s", "sat"]
    width, inner = 32, 64
    shapes = {"token_embd.weight": (len(pieces), width), "position_embd.weight": (16, width), "token_type_embd.weight": (2, width), "mlm_bias": (len(pieces),), "mlm_transform.weight": (width, width), "mlm_transform.bias": (width,)}
    for k in range(2):
        for c in "qkvo":
            shapes |= {f"enc.{k}.attn.{c}.weight": (width, width), f"enc.{k}.attn.{c}.bias": (width,)}
        shapes |= {f"enc.{k}.ffn.fc1.weight": (inner, width), f"enc.{k}.ffn.fc1.bias": (inner,), f"enc.{k}.ffn.fc2.weight": (width, inner), f"enc.{k}.ffn.fc2.bias": (width,)}
    for name in ("embd_ln", "mlm_ln", *(f"enc.{k}.ln{i}" for k in range(2) for i in (1, 2))):
        shapes |= {f"{name}.weight": (width,), f"{name}.bias": (width,)}
    w = {n: (rng.normal(size=s) / 4).astype(np.float32) for n, s in shapes.items()}
    # as a file: one matrix of halves, one of blocks of bytes, the rest whole
    text = lambda x: struct.pack("<Q", len(x)) + x.encode()
    head, body = b"", b""
    for name, a in w.items():
        kind = {"mlm_transform.weight": 1, "enc.1.ffn.fc2.weight": 8}.get(name, 0)
        if kind == 8:
            blocks = a.reshape(-1, 32)
            scale = (np.abs(blocks).max(axis=1) / 127).astype("<f2")
            q = np.round(blocks / scale.astype(np.float32)[:, None]).astype("i1")
            raw = b"".join(s.tobytes() + x.tobytes() for s, x in zip(scale, q, strict=True))
            w[name] = (q * scale.astype(np.float32)[:, None]).reshape(a.shape)
        else:
            w[name] = a.astype("<f2" if kind else "<f4").astype(np.float32)
            raw = a.astype("<f2" if kind else "<f4").tobytes()
        head += text(name) + struct.pack("<I", a.ndim) + struct.pack(f"<{a.ndim}Q", *a.shape[::-1]) + struct.pack("<IQ", kind, len(body))
        body += raw + b"\0" * (-len(raw) % 32)
    meta = text("general.architecture") + struct.pack("<I", 8) + text("bert") + text("bert.attention.head_count") + struct.pack("<II", 4, 4)
    whole = b"GGUF" + struct.pack("<IQQ", 3, len(w), 2) + meta + head
    (tmp_path / "m.gguf").write_bytes(whole + b"\0" * (-len(whole) % 32) + body)
    tensors = readers.gguf_tensors((tmp_path / "m.gguf").read_bytes())
    assert all((tensors[n] == w[n]).all() for n in w)

    file = subword.load_tokenizer(json.dumps({"model": {"type": "WordPiece", "vocab": {p: i for i, p in enumerate(pieces)}, "unk_token": "[UNK]"}, "normalizer": {"type": "BertNormalizer"}}))
    provider = bert.SpladeProvider(str(tmp_path / "m.gguf"), file, max_length=8)
    texts = ["The cats sat", "cat", None, "the the the the the the the the the the", "dog sat"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: dict(zip(r["indices"], r["values"], strict=True)) if r["indices"] is not None else None for r in bert.sparse_embed(rows, provider, batch_size=2).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
            continue
        ids = provider.ids(t)
        best = bert_by_hand({n: a.astype(np.float64) for n, a in w.items()}, 4, ids).max(axis=0)
        assert len(ids) <= 8 and got[i] == pytest.approx({k: np.log1p(best[k]) for k in range(4, len(pieces)) if best[k] > 0}, abs=1e-4)


# Tokenizer files


def test_tokenizer_files():
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    pieces = {"[UNK]": 0, "the": 1, "th": 2, "##e": 3, "##n": 4, "e": 5, ",": 6, "##re": 7}
    t = Tokenizer(models.WordPiece(pieces, unk_token="[UNK]"))
    t.normalizer, t.pre_tokenizer = normalizers.BertNormalizer(), pre_tokenizers.BertPreTokenizer()
    t.add_special_tokens(["[SEP]"])
    t.add_tokens(["<x>", "<xy>"])
    own = subword.load_tokenizer(t.to_str())
    assert (own.kind, own.unknown, own.lower, own.special) == ("WordPiece", 0, True, frozenset(["[SEP]"]))
    for text in ("The then, thé[SEP]e<xy>there<x> zz", "", "the"):
        assert own.encode(text) == t.encode(text, add_special_tokens=False).ids, text

    t = Tokenizer(models.BPE({"t": 0, "h": 1, "e": 2, "th": 3, "the": 4, "[UNK]": 5}, [("t", "h"), ("th", "e")], unk_token="[UNK]"))
    t.normalizer, t.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.Whitespace()
    own = subword.load_tokenizer(t.to_str())
    for text in ("the hth et", "THE the"):
        assert own.encode(text) == t.encode(text).ids
    raw = json.loads(t.to_str())
    del raw["model"]["type"]
    assert subword.load_tokenizer(json.dumps(raw)).kind == "BPE"

    t = Tokenizer(models.Unigram([("<unk>", 0.0), ("▁the", -1.0), ("▁", -3.0), ("the", -2.0), ("n", -2.5)], 0))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    own = subword.load_tokenizer(t.to_str())
    for text in ("the then n", "nthe"):
        assert own.encode(text) == t.encode(text).ids
    with pytest.raises(ValueError):
        subword.load_tokenizer('{"model": {"type": "Other"}}')


# Images


def png(pixels, colour, palette=None, filters=(0,)):
    """A PNG file whose rows take the filters in turn."""
    h, w, c = pixels.shape
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    flat, rows = pixels.reshape(h, w * c).astype(int), []
    for y in range(h):
        kind = filters[y % len(filters)]
        up = flat[y - 1] if y else np.zeros(w * c, int)
        left, corner = np.r_[np.zeros(c, int), flat[y][:-c]], np.r_[np.zeros(c, int), up[:-c]]
        p = left + up - corner
        d = np.abs(np.stack([p - left, p - up, p - corner]))
        guess = [0, left, up, (left + up) // 2, np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))][kind]
        rows.append(bytes([kind]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes())
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_decoding():
    rng = np.random.default_rng(0)
    rgb = rng.integers(0, 256, (11, 7, 3)).astype(np.uint8)
    assert (images.decode_image(png(rgb, 2, filters=(0, 1, 2, 3, 4))) == rgb).all()
    rgba = np.concatenate([rgb, rgb[:, :, :1]], axis=2)
    assert (images.decode_image(png(rgba, 6, filters=(4, 3))) == rgb).all()
    grey = rgb[:, :, :1]
    assert (images.decode_image(png(grey, 0, filters=(1,))) == np.repeat(grey, 3, axis=2)).all()
    assert (images.decode_image(png(rgb[:, :, :2], 4)) == np.repeat(grey, 3, axis=2)).all()
    palette = rng.integers(0, 256, (256, 3)).astype(np.uint8)
    assert (images.decode_image(png(grey, 3, palette)) == palette[grey[:, :, 0]]).all()
    assert (images.decode_image(b"P6\n# note\n7 11\n255\n" + rgb.tobytes()) == rgb).all()
    for wrong in (b"", b"\xff\xd8nothing", png(rgb, 2)[:40]):
        with pytest.raises((ValueError, zlib.error)):
            images.decode_image(wrong)


def test_image_embeddings(spark, tmp_path):
    rng = np.random.default_rng(1)
    pixels = [rng.integers(0, 256, (9 + i, 12, 3)).astype(np.uint8) for i in range(5)]
    rows = [(i, png(p, 2)) for i, p in enumerate(pixels)] + [(5, b"no image"), (6, None)]
    df = spark.createDataFrame(rows, "id int, content binary")
    got = {r["id"]: r for r in images.embed_images(df, lambda x: x.mean(axis=(2, 3)), 3, side=8, batch_size=2).collect()}
    for i, p in enumerate(pixels):
        expect = readers.preprocess_image(p, 8).mean(axis=(1, 2))
        assert np.allclose(got[i]["embedding"], expect / np.linalg.norm(expect), atol=1e-5) and got[i]["diagnostic"] is None
    assert got[5]["embedding"] is None and got[5]["diagnostic"] and got[6]["embedding"] is None and got[6]["diagnostic"] is None
    with pytest.raises(ValueError):
        images.unit_rows(np.zeros((2, 4)), 2, 3)
    (tmp_path / "x.png").write_bytes(png(pixels[0], 2))
    read = images.read_pixels(spark, str(tmp_path)).first()
    assert (read["height"], read["width"]) == (9, 12) and read["pixels"] == pixels[0].tobytes()


# Stores and reports


def test_npz_and_raw_stores(spark, tmp_path):
    df = spark.createDataFrame([(2, [], []), (0, [3, 9], [0.5, 1.0]), (1, [7], [2.0])], "id long, indices array<int>, values array<float>")
    at = str(tmp_path / "v.npz")
    assert readers.save_npz(df, at) == 3
    with np.load(at) as held:
        assert held["offsets"].tolist() == [0, 2, 3, 3] and held["indices"].tolist() == [3, 9, 7]
    back = readers.load_npz(spark, at).orderBy("id")
    assert [(r["id"], r["indices"], r["values"]) for r in back.collect()] == [(0, [3, 9], [0.5, 1.0]), (1, [7], [2.0]), (2, [], [])]
    with pytest.raises(ValueError):
        readers.save_npz(df, at, most=2)
    vectors = spark.createDataFrame([(1, [1.0, -2.5]), (2, None), (3, [])], "id long, v array<float>")
    readers.write_raw(vectors, str(tmp_path / "raw"))
    assert {r["id"]: r["v"] for r in readers.read_raw(spark, str(tmp_path / "raw")).collect()} == {1: [1.0, -2.5], 2: None, 3: []}
    halves = {r["id"]: r["h"] for r in vectors.select("id", vector.as_float("v", "float16").alias("h")).collect()}
    assert halves == {1: np.array([1.0, -2.5], "<f2").tobytes(), 2: None, 3: b""}


def test_reports_keep_all_rows_or_say_so(spark, tmp_path):
    rows = spark.range(10_001)
    for report in (lambda r: readers.report_json(r, {}), readers.report_markdown):
        with pytest.raises(ValueError):
            report(rows)
        assert report(rows.limit(10_000)).count("\n" if report is readers.report_markdown else '"id"') >= 10_000
    readers.write_report(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 10_001


def test_texts_have_stable_ids(spark, tmp_path):
    (tmp_path / "t.txt").write_text("b\na\nb\n")
    first = {(r["id"], r["text"]) for r in readers.read_texts(spark, str(tmp_path), "text").collect()}
    assert first == {(r["id"], r["text"]) for r in readers.read_texts(spark, str(tmp_path), "text").repartition(3).collect()} and len(first) == 2


def test_clean_up_of_models(tmp_path):
    for name in ("models--Qdrant--bge", "models--other--m", "models--X--y"):
        (tmp_path / name / "snapshots").mkdir(parents=True)
        (tmp_path / name / "snapshots" / "f").write_bytes(b"12345")
    (tmp_path / "notes").mkdir()
    known = {"BAAI/bge": "Qdrant/bge"}
    assert readers.clean_cache(str(tmp_path), ["baai/BGE", "x/Y"], known) == (1, 5) and len(list(tmp_path.iterdir())) == 4
    assert readers.clean_cache(str(tmp_path), ["baai/BGE", "x/Y"], known, dry_run=False) == (1, 5)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["models--Qdrant--bge", "models--X--y", "notes"]
    assert readers.clean_cache(str(tmp_path / "none"), [], {}) == (0, 0)


def test_tuning_table_is_whole_or_not_there(spark, tmp_path):
    at = str(tmp_path / "tuning")
    rows = lambda v, t: spark.createDataFrame([("k", v, t, "m")], "key string, value int, at double, machine string")
    readers.write_tuning(rows(1, 1.0), at)
    readers.write_tuning(rows(2, 2.0), at)
    os.makedirs(f"{at}/_run=half")  # what a write that died leaves
    assert [r["value"] for r in readers.read_tuning(spark, at, {"machine": "m"}).collect()] == [2]
    assert readers.read_tuning(spark, at, {"machine": "other"}).count() == 0


def test_long_headers_are_read_whole(spark, tmp_path):
    raw = gguf({"general.architecture": "bert", "bert.vocab_size": 9}, {f"x{i}": [1] for i in range(50)} | {"token_embd.weight": [1]})
    (tmp_path / "a.gguf").write_bytes(raw)
    for head in (10, 100, 1 << 20):
        got = readers.inspect_gguf(spark, str(tmp_path), head).collect()
        assert len(got) == 1 and (got[0]["n_tensors"], got[0]["diagnostic"]) == (51, "")


# Search


def test_all_pairs_of_any_table(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(int(i), rng.normal(size=3).tolist()) for i in rng.permutation(60)], "id long, v array<float>")
    own = {r["id"]: r["v"] for r in df.collect()}
    for most in (10, 25, 60):
        got = retrieve.neighbour_pairs(df, most).collect()
        assert sorted((r["i"], r["j"]) for r in got) == [(i, j) for i in range(60) for j in range(i + 1, 60)]
        assert all(r["a"] == own[r["i"]] and r["b"] == own[r["j"]] for r in got)


def test_all_pairs_are_scored_as_matrices(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(size=5).tolist() if i else [0.0] * 5) for i in rng.permutation(50)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    ways = [sorted(map(tuple, retrieve.pair_cosines(df, b).collect())) for b in (1 << 20, 100)]
    assert len(ways[0]) == 50 * 49 // 2 and ways[0] == ways[1]


def test_all_pairs_take_few_bytes_and_no_join(spark, tmp_path):
    """Scores in order of the ids took 9 to 10 bytes a row in files. Beyond the block's bytes, and with nulls, vectors met in joins
    whose rows grew as the square of the table."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame(list(zip(rng.permutation(4000).tolist(), rng.normal(size=(4000, 64)).tolist(), strict=True)), "id long, v array<float>")
    retrieve.pair_cosines(df, digits=6).write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs")
    assert got.count() == got.where("i < j").distinct().count() == 4000 * 3999 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 8 * 4000 * 3999 // 2
    few = spark.createDataFrame([(3, [1.0, 2.0]), (1, None), (2, [1.0, None]), (None, [1.0, 1.0]), (5, [2.0, 1.0]), (4, [float("nan"), 1.0]), (3, [-1.0, 0.0])], "id long, v array<float>")
    rows = lambda df: sorted(map(str, df.select("i", "j", "score").collect()))
    joined = rows(retrieve.pair_scores(retrieve.neighbour_pairs(few)).withColumn("score", F.round("score", 2)))
    for size in (1 << 20, 16):
        pairs = retrieve.pair_cosines(few, size, digits=2)
        assert "Join" not in pairs._jdf.queryExecution().toString()
        assert rows(pairs) == joined and len(joined) == 14


def test_sparse_search_reads_texts_once_for_many_queries(spark):
    """Queries of 64 MB of postings are one block, where their matrix over all terms would be many; norms and ties by brute force."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        words = np.unique(rng.zipf(1.3, rng.integers(0, 60)) % 3000).tolist()
        rows.append((i, [f"t{w}" for w in words], [float(rng.integers(1, 9 if i % 50 else 200)) for _ in words]))
    df = spark.createDataFrame(rows, "id long, indices array<string>, values array<double>").repartition(3)
    got = retrieve.sparse_search(df.where("id % 3 = 0"), df, 7, query_bytes=1 << 18)
    assert got._jdf.queryExecution().logical().toString().count("MapInArrow") == 1
    own = {i: dict(zip(t, w, strict=True)) for i, t, w in rows}
    expect = []
    for i in range(0, 900, 3):
        scores = sorted((-sum(w * own[d].get(t, 0) for t, w in own[i].items()), d) for d in own)[:7]
        expect += [(i, d, -s, r + 1) for r, (s, d) in enumerate(scores)]
    assert sorted(map(tuple, got.collect())) == sorted(expect)


def test_sparse_search_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, sorted(rng.choice(40, rng.integers(0, 9), replace=False).tolist())) for i in range(80)]
    df = spark.createDataFrame([(i, t, [float(1 + (i * x) % 5) for x in t]) for i, t in rows], "id long, indices array<int>, values array<double>").repartition(5)
    q = df.where("id % 7 = 0")
    ways = [sorted(map(tuple, retrieve.sparse_search(q, df, 6, query_bytes=b).collect())) for b in (1 << 20, 600)]
    own = {i: dict(zip(t, [float(1 + (i * x) % 5) for x in t], strict=True)) for i, t in rows}
    expect = []
    for i in range(0, 80, 7):
        scores = sorted((-sum(w * own[d].get(t, 0) for t, w in own[i].items()), d) for d in own)[:6]
        expect += [(i, d, -s, r + 1) for r, (s, d) in enumerate(scores)]
    assert ways[0] == ways[1] == sorted(expect)


def test_pooling_in_rows_is_pooling(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [(f"t{rng.integers(9)}", float(rng.normal())) for _ in range(rng.integers(0, 30))]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, logits array<struct<term:string,logit:double>>")
    flat = df.select("id", F.inline("logits"))
    for by_row, by_group in ((sparse.splade_pool_rows(df), sparse.splade_pool(flat)), (sparse.scalar_max_pool_rows(df), sparse.scalar_max_pool(flat.withColumnRenamed("logit", "weight")))):
        assert sorted(map(tuple, by_row.collect())) == sorted(map(tuple, by_group.collect()))
    words = spark.createDataFrame([(1, ["b", "a", "b"]), (2, [])], "id int, w array<string>")
    assert [tuple(r) for r in sparse.counted_rows(words, "w").orderBy("id").collect()] == [(1, ["a", "b"], [1.0, 2.0]), (2, [], [])]


def test_options_of_a_call(spark):
    p = spark.createDataFrame([(1, t, w) for t, w in ((5, 0.2), (3, 0.9), (9, 0.9), (101, 2.0))], "id int, term int, weight double")
    own = sparse.Options(special=(101,), min_weight=0.1)
    assert sparse.finish(p, own).first()["indices"] == [3, 9, 5] and sparse.finish(p, own, top_k=1, min_weight=None).first()["indices"] == [3]
    assert sparse.finish(p).first()["indices"] == [101, 3, 9, 5] and own == sparse.Options((101,), 0.1)
    for wrong in ({"min_weight": -1.0}, {"top_k": -1}, {"order": "other"}):
        with pytest.raises(ValueError):
            sparse.finish(p, own, **wrong)


# Batches, tuning and streams


def test_arrivals(spark):
    times = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.5, 20.0, 21.0, 40.0]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(times)] + [(99, 1.0, "other")], "id int, at double, s string")
    got = {r["id"]: r["batch"] for r in batching.arrival_batches(df.repartition(4), "at", "id", ["s"], 4, 5.0).collect()}
    assert [got[i] for i in range(10)] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 3] and got[99] == 0
    turns = batching.round_robin(spark.range(10), ["id"], 4)
    assert [r["session"] for r in turns.orderBy("id").collect()] == [i % 4 for i in range(10)]
    with pytest.raises(ValueError):
        batching.round_robin(df, ["id"], 0)


def test_racing_and_requests(spark):
    rows = [(0, True, 10.0), (1, True, 26.0), (2, False, 1.0), (3, True, 25.0), (4, True, 4.0), (5, True, 11.0)]
    df = spark.createDataFrame(rows, "idx int, valid boolean, p50_ms double")
    flags = lambda d: [r["pruned"] for r in d.orderBy("idx").collect()]
    assert flags(tuning.raced(df, "latency")) == [False, True, False, False, False, True]
    assert not any(flags(tuning.raced(df, "memory"))) and not any(flags(tuning.raced(df, "latency", 0)))
    tuning.check_request("reranking", "latency", 3, 1.0, 64, "full")
    for wrong in ({"task": "other"}, {"task": "image", "n_texts": 1}, {"task": "embedding", "min_tokens": 1}, {"task": "sparse", "max_latency_ms": -1.0}, {"task": "sparse", "objective": "best"}, {"task": "sparse", "mode": "slow"}):
        with pytest.raises(ValueError):
            tuning.check_request(**wrong)
    got = tuning.sweep(spark, {"m": "/x/y/model.onnx", "g": "z.gguf"}, ["short", "long"]).collect()
    assert {(r["model"], r["path"], r["backend"]) for r in got} == {("m", "/x/y", "onnx"), ("g", "z.gguf", "llama")} and len(got) == 4


def test_shortened_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(i, f"some text {i}") for i in range(20)], "id long, text string").write.parquet(source)
    seen = []
    query = streaming.embed_stream(streaming.read_stream(spark, source, "id long, text string"), providers.HashingProvider(16), lambda df, n: seen.extend(df.collect()), str(tmp_path / "c"), dim=4, availableNow=True)
    query.awaitTermination(120)
    rows = {r["id"]: r["embedding"] for r in streaming.embed_rows(spark.read.parquet(source), providers.HashingProvider(16), dim=4)}
    assert len(seen) == 20 and all(len(r["embedding"]) == 4 and r["embedding"] == rows[r["id"]] for r in seen)
    assert all(np.isclose(np.linalg.norm(v), 1, atol=1e-5) or not any(v) for v in rows.values())


def test_no_search_takes_long(spark):
    """A thousand queries against ten thousand rows in seconds."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(10_000, 16)).round(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>").repartition(8).cache()
    df.count()
    began = time.time()
    got = retrieve.search(df.where("id % 10 = 0"), df, 10, same_table=True).collect()
    assert len(got) == 10_000 and time.time() - began < 40
