"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; a bit is 1 if it is set in over half the XXH64 hashes of the text's 3-word shingles.
Fingerprints link at ``RADIUS`` or fewer differing bits. Candidates come from 2^(RADIUS+1) - 1 bit masks: bit i
has the code i % 15 + 1, a nonzero vector of RADIUS+1 bits, and mask v drops the bits whose code has an even inner
product with v. At most RADIUS codes span a space of at most
RADIUS dimensions, so some v is orthogonal to them all: the mask v drops all differing bits, and the two
fingerprints meet in table v. No pair within the radius is missed; a mask keeps about 34 bits, so few others meet.

Only distinct fingerprints are hashed, so a group of exact copies counts once. A bucket of two is one comparison; one of
up to ``IN_TASK`` distinct fingerprints is walked breadth-first in blocks, which yields a spanning forest of its links,
not its pairs; a larger one is joined by masked neighbourhoods (:func:`_large_buckets`), linear in its size.

Defined results: null and empty texts have fingerprint 0 and link like any other; repeated rows and ties share a
component; a row whose doc_id is null gets the component of its links, null if it has none with an id; an empty table
gives no rows; further columns of ``docs`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.llm.common import SPACE, cut, few, table
from sparkvec.llm.graph import connected_components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Distinct fingerprints of a bucket that one task compares, at most (8 bytes each).
IN_TASK = 4096
#: Fingerprints that hold over this share of all rows, of which there can be no more than its inverse, are broadcast.
HOT_SHARE = 1 / 1000
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 17

# :func:`keep_one`, the pipeline's stage, has parameters of its own.
#: Words of a shingle, and Jaccard similarity of two shingle sets from which texts are near copies.
STAGE_SHINGLE = 5
SIMILARITY = 0.8
#: Min-hashes are grouped in bands; a pair at 0.8 shares no band in 0.02 % of cases, one at 0.85 in 0.001 %.
BANDS = 16
BAND_ROWS = 4
#: Distinct texts of a band's bucket of which all pairs are compared; in a larger one each is compared with ``HUBS`` of them, and
#: what these leave apart meets by its rarest shingles.
ALL_PAIRS = 64
HUBS = 4
#: Counters of the shingles of large buckets, by hash (a power of two); they only order shingles.
COUNTERS = 1 << 18
#: Hashes that are broadcast, at most, 16 bytes each; more are joined.
MAX_BROADCAST = 1_000_000


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks as signed longs."""
    codes = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, codes + 1):
        mask = sum(1 << i for i in range(64) if ((i % codes + 1) & v).bit_count() & 1)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of a UTF-8 text; a text of fewer words is one shingle, one of none has none."""
    words = text.lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(b" ".join(words), SEED)]
    return [h(b" ".join(w), SEED) for w in zip(*(words[k:] for k in range(width)), strict=False)]


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array of uint64 hashes, as int64."""
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    counts = np.zeros((len(hashes), 64), dtype=np.int64)
    flat = np.concatenate(hashes) if len(hashes) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(hashes)), sizes)
    for at in range(0, len(flat), BLOCK):
        part, who = flat[at : at + BLOCK], owner[at : at + BLOCK]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        counts[who[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    bits = (counts * 2 > sizes[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64).view(np.int64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        out, pending, held = [], [], 0
        for text in texts:
            pending.append(np.array(shingle_hashes(text.as_py() or b""), dtype=np.uint64))
            held += len(pending[-1])
            if held > BLOCK:
                out.append(fingerprints(pending))
                pending, held = [], 0
        out.append(fingerprints(pending))
        yield pa.record_batch([ids, pa.array(np.concatenate(out))], names=["doc_id", "fp"])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links (from, to) of a spanning forest over fingerprints within the radius."""
    left, a, b = np.sort(fps), [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            found = []
            for at in range(0, len(front), 256):
                part = front[at : at + 256]
                near = np.bitwise_count(part[:, None] ^ left[None, :]) <= radius
                hit = near.any(axis=0)
                a += part[near[:, hit].argmax(axis=0)].tolist()
                b += left[hit].tolist()
                found.append(left[hit])
                left = left[~hit]
                if not len(left):
                    break
            front = np.concatenate(found)
    return a, b


def _walk_buckets(radius: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for bucket in batch.column(0):
                x, y = _forest(np.array(bucket.as_py(), dtype=np.int64), radius)
                a += x
                b += y
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return walk


def _large_buckets(members: DataFrame, radius: int) -> DataFrame:
    """Links that connect what is within the radius in large buckets, without comparing pairs.

    Each member sends itself to every key within 1 bit of it and to every key within radius - 1 bits, over the bits that vary
    in its bucket. Two members within the radius share a key that one of them reaches by at most 1 bit. A key's members by 1 bit
    differ in at most 2, and any other member from them in at most radius; so a key with a 1-bit member links all it
    has to that one, correctly, and one without links none. Keys hold few distinct members by construction.
    """
    if radius != 3:
        raise ValueError("written for a radius of 3")
    flips = members.withColumn("_vary", F.col("bits_or").bitwiseAND(F.bitwise_not("bits_and"))).select(
        "t", "key", "fp", F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.getbit("_vary", i) == 1, F.call_function("shiftleft", F.lit(1).cast("long"), i))), lambda x: x.isNotNull()).alias("flips")
    )
    near = flips.select("t", "key", "fp", F.explode(F.concat(F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(True).alias("one"))), F.transform("flips", lambda x: F.struct(x.alias("x"), F.lit(True).alias("one"))))).alias("s"))
    far = flips.select("t", "key", "fp", "flips", F.posexplode("flips").alias("i", "x")).select(
        "t", "key", "fp", F.explode(F.transform(F.slice("flips", F.col("i") + 2, F.size("flips")), lambda y: F.struct(F.col("x").bitwiseOR(y).alias("x"), F.lit(False).alias("one")))).alias("s")
    )
    keyed = near.union(far).select("t", "key", F.col("fp").bitwiseXOR(F.col("s.x")).alias("k"), "fp", "s.one")
    return (
        keyed.groupBy("t", "key", "k")
        .agg(F.min(F.when(F.col("one"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("all"))
        .where(F.col("a").isNotNull() & (F.size("all") > 1))
        .select("a", F.explode("all").alias("b"))
    )


def links(distinct: DataFrame, radius: int = RADIUS, in_task: int = IN_TASK) -> DataFrame:
    """(a, b) links between the distinct values of ``fp`` that connect all within the radius. Call it on a cut table."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(masks(radius))])
    keys = distinct.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.key")
    buckets = cut(
        keys.groupBy("t", "key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_or("fp").alias("bits_or"), F.bit_and("fp").alias("bits_and"))
        .where("n > 1")
    )
    twos = buckets.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    small = (
        keys.join(buckets.where((F.col("n") > 2) & (F.col("n") <= in_task)).select("t", "key"), ["t", "key"])
        .groupBy("t", "key")
        .agg(F.collect_list("fp").alias("fps"))
        .select("fps")
        .mapInArrow(_walk_buckets(radius), "a long, b long")
    )
    out = twos.union(small)
    if not buckets.where(F.col("n") > in_task).isEmpty():
        large = keys.join(buckets.where(F.col("n") > in_task).select("t", "key", "bits_or", "bits_and"), ["t", "key"])
        out = out.union(_large_buckets(large, radius))
    return out.where("a <> b").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, in_task: int = IN_TASK) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the smallest doc_id that links reach."""
    fps = cut(fingerprint_documents(docs))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    return _labelled(fps, distinct, links(distinct, radius, in_task))


def _components(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, n, component_id, linked) of the ``distinct`` values of fp (fp, rep, n), which ``edges`` link."""
    roots = connected_components(edges)
    linked = cut(roots.join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "rep"))
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "root").select("fp", "least", F.lit(True).alias("linked"))
    return distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("least", "rep").alias("component_id"), F.coalesce("linked", F.lit(False)).alias("linked"))


def _labelled(fps: DataFrame, distinct: DataFrame, edges: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """(doc_id, fp, component_id) of the rows of ``fps``, whose ``distinct`` values of fp are linked by ``edges``."""
    labels = _components(distinct, edges)
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = labels.where(F.col("n") > hot_share * total).select("fp", "component_id")
    copies = fps.join(F.broadcast(hot), "fp")
    others = fps.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(labels.where(F.col("n") <= hot_share * total).select("fp", "component_id"), "fp")
    return copies.unionByName(others, allowMissingColumns=True).select("doc_id", "fp", "component_id")


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty array of uint64 hashes, a key for each band of its min-hashes, as int64."""
    rng = np.random.default_rng(SEED)
    flat, starts = np.concatenate(sets), np.cumsum([0, *(len(x) for x in sets[:-1])])
    keys = np.empty((len(sets), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, dtype=np.uint64)
        for flip, factor in rng.integers(0, 1 << 64, (BAND_ROWS, 2), dtype=np.uint64):
            least = np.minimum.reduceat((flat ^ flip) * (factor | np.uint64(1)), starts)
            key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys.view(np.int64)


def _band_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes: list[int] = []
            keys: list[list[int]] = []
            pending: list[np.ndarray] = []
            held = 0

            def flush() -> None:
                found = iter(band_keys(some).tolist() if (some := [x for x in pending if len(x)]) else [])
                for x in pending:
                    sizes.append(len(x))
                    keys.append(next(found) if len(x) else [])
                pending.clear()

            for text in batch.column(1).cast(pa.binary()):
                pending.append(np.unique(np.array(shingle_hashes(text.as_py() or b"", width), dtype=np.uint64)))
                held += len(pending[-1])
                if held > BLOCK:
                    flush()
                    held = 0
            flush()
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["fp", "size", "keys"])

    return run


def _verify_batches(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, set[int]] = {}
        held = 0
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for k, pair in enumerate(zip(a, b, strict=True)):
                if held > 1 << 19:
                    known.clear()
                    held = 0
                sets = []
                for fp, column in zip(pair, (2, 3), strict=True):
                    if fp not in known:
                        known[fp] = set(shingle_hashes(batch.column(column)[k].as_py().encode(), width))
                        held += len(known[fp])
                    sets.append(known[fp])
                both = len(sets[0] & sets[1])
                if both >= similarity * (len(sets[0]) + len(sets[1]) - both):
                    keep.append(k)
            yield pa.record_batch([pa.array([x[k] for k in keep], pa.int64()) for x in (a, b)], names=["a", "b"])

    return run


def _count_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                own = np.unique(np.array(shingle_hashes(text.as_py() or b"", width), dtype=np.uint64))
                np.add.at(counts, own & np.uint64(COUNTERS - 1), 1)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(counts[at])], names=["at", "n"])

    return run


def _prefix_batches(width: int, similarity: float, sent):
    """The rarest shingles of each text, so many that two texts of the similarity share one, with their places in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            prefixes = []
            for text in batch.column(1).cast(pa.binary()):
                own = np.unique(np.array(shingle_hashes(text.as_py() or b"", width), dtype=np.uint64))
                ranked = own[np.lexsort((own, counts[own & np.uint64(COUNTERS - 1)]))]
                prefixes.append(ranked[: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1].view(np.int64))
            yield pa.record_batch([batch.column(0), pa.array(prefixes, pa.list_(pa.int64()))], names=["fp", "prefix"])

    return run


def _apart(members: DataFrame, texts: DataFrame, links: DataFrame, similarity: float, width: int) -> DataFrame:
    """(a, b): all pairs of ``members`` (fp, size) that may have the similarity and that ``links`` (a, b) do not connect already.

    Texts of the similarity share one of their rarest shingles, in any one order of all. Those whose texts are all connected make no pairs,
    so a group of near copies costs its size; pairs are told apart by sizes and by what can still follow the shared shingle."""
    spark = members.sparkSession
    among = links.join(members.select(F.col("fp").alias("a")), "a", "left_semi").join(members.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")
    roots = connected_components(among)
    grouped = members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "size", F.coalesce("root", "fp").alias("root"))
    own = texts.join(members.select("fp"), "fp", "left_semi").select("fp", "text")
    found = own.select("text").mapInArrow(_count_batches(width), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # at most COUNTERS rows
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for r in found:
        counts[r["at"]] = r["n"]
    sent = spark.sparkContext.broadcast(counts)
    prefixes = own.mapInArrow(_prefix_batches(width, similarity, sent), "fp long, prefix array<long>")
    entries = cut(prefixes.join(grouped, "fp").select("fp", "size", "root", F.posexplode("prefix").alias("pos", "token")))
    mixed = entries.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    lists = cut(entries.join(mixed, "token").groupBy("token", "root").agg(F.collect_list(F.struct("fp", "size", "pos")).alias("s")))
    left, right = lists.select("token", F.col("root").alias("ra"), F.col("s").alias("sa")), lists.select("token", F.col("root").alias("rb"), F.col("s").alias("sb"))
    met = left.join(right, "token").where("ra < rb").select(F.explode("sa").alias("x"), "sb").select("x", F.explode("sb").alias("y"))
    close = F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size")
    left_over = F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos"))
    enough = left_over >= similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size")) - 1e-6
    return met.where(close & enough).select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def similar_links(texts: DataFrame, similarity: float = SIMILARITY, width: int = STAGE_SHINGLE, all_pairs: int = ALL_PAIRS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(a, b) links between texts (fp, text) whose shingle sets have the Jaccard similarity or more, all of them verified.

    Candidates share a band of min-hashes. A bucket's pairs are all compared up to ``all_pairs`` texts. In a larger one
    each text is compared with ``HUBS`` texts, others in each bucket; whatever these links do not connect is then joined exactly
    (:func:`_apart`), so the components are those of all pairs. Only texts of candidate pairs and of large buckets are shuffled.
    """
    banded = cut(texts.mapInArrow(_band_batches(width), "fp long, size int, keys array<long>").dropDuplicates(["fp"]))
    keys = banded.select(F.struct("fp", "size").alias("s"), F.explode("keys").alias("key"))
    hubs = [F.min(F.struct(F.xxhash64("s.fp", "key", F.lit(k)).alias("h"), F.col("s").alias("s")))["s"] for k in range(HUBS)]
    buckets = cut(keys.groupBy("key").agg(F.count("*").alias("n"), F.array_distinct(F.array(*hubs)).alias("hubs")).where("n > 1"))
    small = (
        keys.join(buckets.where(F.col("n") <= all_pairs).select("key"), "key")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("s")).alias("all"))
        .select(F.posexplode("all").alias("i", "a"), "all")
        .select("a", F.explode(F.slice("all", F.col("i") + 2, F.lit(all_pairs))).alias("b"))
    )
    crowded = buckets.where(F.col("n") > all_pairs)
    large = keys.join(crowded, "key").select(F.explode("hubs").alias("a"), F.col("s").alias("b"))
    close = F.least("a.size", "b.size") >= similarity * F.greatest("a.size", "b.size")
    pairs = cut(small.union(large).where((F.col("a.fp") != F.col("b.fp")) & close).select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b")).distinct())
    members = None if crowded.isEmpty() else cut(keys.join(crowded.select("key"), "key").select("s.fp", "s.size").distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp"))
    wanted = cut((wanted if members is None else wanted.union(members.select("fp"))).distinct())
    found = cut(texts.join(few(wanted, max_broadcast), "fp", "left_semi").dropDuplicates(["fp"]))

    def verified(some: DataFrame) -> DataFrame:
        return (
            some.join(found.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a")
            .join(found.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b")
            .mapInArrow(_verify_batches(width, similarity), "a long, b long")
        )

    if members is None:
        return verified(pairs)
    links = cut(verified(pairs))
    return links.union(verified(cut(_apart(members, found, links, similarity, width))))


def _text_hash() -> tuple:
    """(hash, text): null is empty, and texts without words are alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.when(F.btrim(text, F.lit(SPACE)) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(text)), text


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, width: int = STAGE_SHINGLE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of the near copies of their text; rows without an id stay. Each row
    is judged by its own text, so of rows that repeat a doc_id those stay whose text has no copy under a smaller id. Near
    copies are linked by :func:`similar_links`; texts are told apart by 64-bit hashes, and those without words are alike.

    Up to ``max_broadcast`` hashes with copies are sent to the rows, so that no text moves; more are joined, with the same result."""
    fp, text = _text_hash()
    fps = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fp.alias("fp"))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    found = _components(distinct, similar_links(docs.select(fp.alias("fp"), text.alias("text")), similarity, width, max_broadcast=max_broadcast))
    copies = cut(found.where("n > 1 or linked").select(F.col("fp").alias("_fp"), F.col("component_id").alias("_least")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), fp.alias("_fp"))  # columns may have these names
    stays = F.col("_least").isNull() | F.col("_id").isNull() | (F.col("_id") == F.col("_least"))
    return rows.join(few(copies, max_broadcast), "_fp", "left").where(stays).select("_row.*")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
