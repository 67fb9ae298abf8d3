"""The pipeline against its stages by brute force on a small fixture."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sparkvec.llm import packing
from test_llm import DOCS, components_by_hand, counts_by_hand, fingerprint_by_hand, leaks_by_hand


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    vocabulary = [f"word{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary, n))
    item = line(30)
    texts = ["\n".join(line(40) for _ in range(3)) for _ in range(30)]
    notice = line(12)
    texts += [f"{notice}\n" + "\n".join(line(40) for _ in range(3)) for _ in range(12)]
    texts += [texts[3], texts[3].upper(), texts[4] + " extra"]
    texts += [line(60) + "\n" + " ".join(item.split()[5:25]) + "\n" + line(30)]
    texts += ["too short", None, "", "again and again " * 40]
    junk = [" ".join(w + "%%%" for w in rng.choice(vocabulary, 120)) for _ in range(6)]
    texts += junk
    rows = [(i, t, "en", f"s{i % 12}", len(t or "")) for i, t in enumerate(texts)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 42), 0) for i in list(range(40)) + [r[0] for r in rows[-6:]]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, item


def test_run_by_hand(spark, folder):
    from tokenizers import Tokenizer

    at, rows, item = folder
    docs = [(i, t, s) for i, t, _, s, _ in rows if not (counts_by_hand(t)[0] < 50 or 2 * counts_by_hand(t)[4] > counts_by_hand(t)[0]) and not re.search("%%%", t)]
    sites, first = {}, {}
    for i, t, s in docs:
        for p, x in enumerate(t.split("\n")):
            sites.setdefault(x.strip(), set()).add(s)
            first.setdefault(x.strip(), (i, p))
    docs = [(i, "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip() or len(sites[x.strip()]) < 10 or first[x.strip()] == (i, p))) for i, t, _ in docs]
    roots = components_by_hand([fingerprint_by_hand(t) for _, t in docs])
    docs = [d for k, d in enumerate(docs) if roots[k] == k]
    docs = [d for d in docs if not leaks_by_hand(d[1], [(1, item)])[1]]
    t = Tokenizer.from_file(packing.tokenizer_path())
    expect = {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for i, x in docs}
    got = corpus_pipeline.run(spark, at).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in got} == expect
    assert len(expect) == 42


def test_stages_take_odd_rows(spark, folder):
    """Nulls in any column, empty and long texts, repeated rows and ids, and columns of clashing names."""
    from pyspark.sql import functions as F

    at, rows, item = folder
    good = rows[3][1]
    long = "\n".join(rows[i % 30][1] for i in range(400))
    odd = [(1, None, "en", "s1", None), (2, "", None, None, 0), (3, " \n\t", "en", "s2", 3), (4, good, "en", "s3", 1), (4, good, "en", "s3", 1), (5, good.upper(), None, None, 1), (None, good, "en", "s4", 1), (6, long, "en", "s5", 1), (6, "other " + item, "en", "s6", 1)]
    df = spark.createDataFrame(odd, DOCS).withColumns({c: F.lit(7) for c in ("_row", "_fp", "_id", "h", "key", "n_words", "kept", "llr", "ranges", "items", "fp", "ids", "_k1")})
    stages = dict(corpus_pipeline.STAGES)

    def kept(name, docs=df):
        out = stages[name](spark, docs, at)
        assert out.columns == docs.columns
        return sorted(((r["doc_id"], len(r["text"] or "")) for r in out.collect()), key=str)

    every = sorted(((i, len(t or "")) for i, t, *_ in odd), key=str)
    of = lambda *gone: [x for x in every if x not in gone]
    short = (6, len("other " + item))
    assert kept("quality_rules") == of((1, 0), (2, 0), (3, 3), short, *(x for x in every if x[1] > 10_000))  # the long one repeats itself
    assert kept("line_dedup") == every
    assert kept("simhash_near_dedup") == of((2, 0), (3, 3), (5, len(good)))
    assert kept("decontamination") == of(short)
    pieces = stages["packing"](spark, df, at).collect()
    assert sum(r["start"] == 0 for r in pieces) == len(odd) and all(len(r["ids"]) == r["length"] for r in pieces)
    assert {r["doc_id"] for r in pieces if r["ids"] == [1]} == {1, 2}


def test_stages(spark, folder, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), folder[0]).count() == 0
    assert corpus_pipeline.run(spark, sf).count() > 0
