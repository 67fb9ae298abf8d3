"""Benchmark decontamination as a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of an item, or the whole item if that is shorter; as a set it holds its
shingles of ``SHINGLE`` words. Containment must be whole, so of a window's n shingles, ordered by rarity in the corpus, a prefix of
n - n + 1 = 1 is necessary: its rarest. A first pass counts, over all documents, in how many each benchmark shingle
occurs; the second looks documents up by rarest shingles only, applies the positional bound (the window must
begin inside the text) and the length bound (and end inside it), and verifies the window word by word.

The benchmark is the stated query set. It is dealt into blocks of at most about ``BLOCK_WORDS`` words by a hash of the item; one
block at a time is on the driver and the executors, and makes two passes over the documents. What a block but the last finds is
a table of texts with hits, told apart by a 128-bit hash, and is written to the shared folder before the next block comes.
Documents meet it by that hash, and texts are shuffled only beyond ``MAX_BROADCAST`` texts with hits.

Defined results: null, empty and wordless texts have no words, no hits and are clean; wordless or null items
have no windows; items that repeat an item_id count as one item; rows that repeat a doc_id are judged one by one;
an empty benchmark leaves all clean. Further columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.llm.common import cut, table

WINDOW = 10
SHINGLE = 5
#: Words of the benchmark items that are sent to the executors at once, at most about: some 100 MB in a worker.
BLOCK_WORDS = 1_000_000
#: Texts with hits, and their ranges and items, that are broadcast, at most; more are joined, with the same result.
MAX_BROADCAST = 1_000_000
# All but ASCII letters, digits and what lies beyond ASCII ends a word.
GAPS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return text.lower().translate(GAPS).split()


def _rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit code of each ``width`` ids in a row."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            code = (code ^ ids[k : k + n].astype(np.uint64)) * _MULTIPLIER
            code ^= code >> np.uint64(29)
    return code


class Index:
    """Windows of a block of benchmark items and their shingles, in flat arrays. Rarity comes later, by :meth:`order`."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW, shingle: int = SHINGLE):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[object] = []
        by_item: dict[object, int] = {}
        known: dict[bytes, int] = {}
        words, starts, lengths, owners = [], [], [], []
        at = 0
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in split_words(text)], dtype=np.int32)
            if not len(ids):
                continue
            if item not in by_item:
                by_item[item] = len(self.items)
                self.items.append(item)
            k = min(window, len(ids))
            for p in range(len(ids) - k + 1):
                w = known.setdefault(ids[p : p + k].tobytes(), len(starts))
                if w == len(starts):
                    starts.append(at + p)
                    lengths.append(k)
                owners.append((w, by_item[item]))
            words.append(ids)
            at += len(ids)
        self.words = np.concatenate(words) if words else np.zeros(0, np.int32)
        #: Each window's place in ``words``, its length, and its items from ``first[w]`` on in ``owners``.
        self.starts, self.lengths = np.array(starts, np.int64), np.array(lengths, np.int64)
        pairs = np.unique(np.array(owners, np.int64).reshape(-1, 2), axis=0)
        self.owners, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(starts) + 1))
        #: For each shingle width the codes of all windows' shingles, and the sorted distinct ones.
        self.widths = {int(s): np.flatnonzero(np.minimum(self.lengths, shingle) == s) for s in np.unique(np.minimum(self.lengths, shingle))}
        self.codes = {s: np.unique(np.concatenate([_rolling(self.window(w), s) for w in which])) for s, which in self.widths.items()}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def window(self, w: int) -> np.ndarray:
        return self.words[self.starts[w] : self.starts[w] + self.lengths[w]]

    def order(self, frequency: dict[tuple[int, int], int]) -> None:
        """Choose each window's rarest shingle by (document frequency, code, position)."""
        for s, which in self.widths.items():
            counts = np.array([frequency.get((s, c), 0) for c in self.codes[s].tolist()], np.int64)
            found = []
            for w in which.tolist():
                codes = _rolling(self.window(w), s)
                at = np.searchsorted(self.codes[s], codes)
                p = int(np.lexsort((codes, counts[at]))[0])
                found.append((int(at[p]), w, p))
            chosen = np.array(sorted(found), np.int64).reshape(-1, 3)
            codes, first = np.unique(chosen[:, 0], return_index=True)
            self.prefix[s] = (self.codes[s][codes], np.append(first, len(chosen)), chosen[:, 1:])

    def ids(self, text: bytes) -> np.ndarray:
        words = split_words(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))

    def matches(self, ids: np.ndarray, which: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(width, positions, index into the sorted codes) of a text's shingles that are among them."""
        known = ids >= 0
        if not known.any():
            return
        for s, codes in which.items():
            if len(ids) < s or not len(codes):
                continue
            run = known[: len(ids) - s + 1].copy()
            for k in range(1, s):
                run &= known[k : k + len(run)]
            at = np.flatnonzero(run)
            if not len(at):
                continue
            code = np.zeros(len(at), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(s):
                    code = (code ^ ids[at + k].astype(np.uint64)) * _MULTIPLIER
                    code ^= code >> np.uint64(29)
            found = np.searchsorted(codes, code)
            found[found == len(codes)] = 0
            hit = codes[found] == code
            if hit.any():
                yield s, at[hit], found[hit]

    def hits(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Ranges of words that windows cover, merged and in order, and the items that they are of."""
        ranges: set[tuple[int, int]] = set()
        owners: set[int] = set()
        n = len(ids)
        for s, where, which in self.matches(ids, {s: p[0] for s, p in self.prefix.items()}):
            _, first, chosen = self.prefix[s]
            for p, c in zip(where.tolist(), which.tolist(), strict=True):
                for w, offset in chosen[first[c] : first[c + 1]].tolist():
                    start, length = p - offset, int(self.lengths[w])
                    if start < 0 or start + length > n:
                        continue
                    if np.array_equal(ids[start : start + length], self.window(w)):
                        ranges.add((start, start + length))
                        owners.update(self.owners[self.first[w] : self.first[w + 1]].tolist())
        return merge(ranges), owners


def merge(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _frequencies(index):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        totals = {s: np.zeros(len(c), np.int64) for s, c in own.codes.items()}
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                for s, _, which in own.matches(own.ids(text.as_py() or b""), own.codes):
                    totals[s][np.unique(which)] += 1
        for s, n in totals.items():
            seen = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(seen), s, np.int32)), pa.array(own.codes[s][seen].view(np.int64)), pa.array(n[seen])], names=["width", "code", "n"])

    return count


HITS = "_k1 long, _k2 long, ranges array<array<long>>, items array<string>"
_HITS = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()))


def _search(index):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            out = []
            for k, text in enumerate(batch.column("text").cast(pa.binary())):
                ranges, owners = own.hits(own.ids(text.as_py() or b""))
                if ranges:
                    out.append((batch.column("_k1")[k].as_py(), batch.column("_k2")[k].as_py(), [list(x) for x in ranges], [str(own.items[i]) for i in owners]))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(_HITS)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _HITS, strict=True)], names=["_k1", "_k2", "ranges", "items"])

    return search


def _judge(index, rest: list[str]):
    """All rows with their words, and hits of this block merged with those of earlier ones."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            n_words, ranges, items = [], [], []
            earlier = zip(batch.column("_ranges"), batch.column("_items"), strict=True)
            for text, (a, b) in zip(batch.column("_text").cast(pa.binary()), earlier, strict=True):
                ids = own.ids(text.as_py() or b"")
                found, owners = own.hits(ids)
                if a.is_valid:
                    found = merge([*found, *map(tuple, a.as_py())])
                n_words.append(len(ids))
                ranges.append([list(x) for x in found])
                items.append(sorted({*(str(own.items[i]) for i in owners), *(b.as_py() or ())}))
            new = (pa.array(n_words, pa.int64()), pa.array(ranges, _HITS[2]), pa.array(items, _HITS[3]))
            yield pa.record_batch([*(batch.column(c) for c in rest), *new], names=[*rest, "n_words", "ranges", "items"])

    return judge


def _indexed(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, block_words: int) -> Iterator[tuple[bool, Broadcast]]:
    """(whether it is the last, the broadcast index) of each block of the benchmark; an empty benchmark is one empty block."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    words = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 2 + 1
    n = -(-words // block_words)
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        index = Index([(r["item_id"], r["text"].encode()) for r in part.collect()], window, shingle)
        sent = spark.sparkContext.broadcast(index)
        counted = texts.mapInArrow(_frequencies(sent), "width int, code long, n long").groupBy("width", "code").agg(F.sum("n").alias("n"))
        index.order({(r["width"], r["code"] & (2**64 - 1)): r["n"] for r in counted.collect()})
        sent.destroy()
        yield k == n - 1, spark.sparkContext.broadcast(index)


def _keys() -> list[Column]:
    """A 128-bit hash of the text; a null one hashes like no text at all, and has no hits."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2")]


def _merged(hits: DataFrame) -> DataFrame:
    """Hits of several blocks as one row a text, with the union of its ranges."""
    keys = ["_k1", "_k2"]
    each = hits.select(*keys, F.explode("ranges").alias("r")).select(*keys, F.col("r")[0].alias("a"), F.col("r")[1].alias("b"))
    before = W.partitionBy(*keys).orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*keys).orderBy("a", "b").rowsBetween(W.unboundedPreceding, 0)
    islands = each.withColumn("new", (F.col("a") > F.coalesce(F.max("b").over(before), F.lit(-1))).cast("int")).withColumn("island", F.sum("new").over(upto))
    ranges = islands.groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.array("a", "b"))).alias("ranges"))
    items = hits.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return ranges.join(items, keys)


def _block_hits(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """What one block finds, written to the shared folder; its broadcast is released."""
    texts = docs.select(F.col("text").cast("string").alias("text"), *_keys()).where("text is not null")
    found = cut(texts.mapInArrow(_search(sent), HITS).dropDuplicates(["_k1", "_k2"]))
    sent.destroy()
    return found


def _union(parts: list[DataFrame]) -> DataFrame:
    return parts[0] if len(parts) == 1 else cut(_merged(reduce(DataFrame.union, parts)))


def _sent(hits: DataFrame, max_broadcast: int) -> DataFrame:
    size = hits.agg(F.coalesce(F.sum(1 + F.size("ranges") + F.size("items")), F.lit(0))).first()[0]
    return F.broadcast(hits) if size <= max_broadcast else hits


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The columns of ``docs`` but text, with ``n_words``, ``ranges`` (merged [start, end) of hit words) and ``items`` (ids as sorted strings)."""
    plain = [c for c in docs.columns if c not in ("text", "n_words", "ranges", "items")]
    names = {c: f"_c{i}" for i, c in enumerate(plain)}  # columns may have the names used here
    given = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("text").cast("string").alias("_text"), *_keys())
    parts, last, sent = [], False, None
    for last, sent in _indexed(docs, benchmark, window, shingle, block_words):
        if not last:
            parts.append(_block_hits(docs, sent))
    if parts:
        hits = _sent(_union(parts), max_broadcast).select("_k1", "_k2", F.col("ranges").alias("_ranges"), F.col("items").alias("_items"))
        given = given.join(hits, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    else:
        given = given.drop("_k1", "_k2").withColumns({"_ranges": F.lit(None).cast("array<array<bigint>>"), "_items": F.lit(None).cast("array<string>")})
    shape = ", ".join([f"`{n}` {given.schema[n].dataType.simpleString()}" for n in names.values()] + ["n_words long, ranges array<array<long>>, items array<string>"])
    found = given.mapInArrow(_judge(sent, list(names.values())), shape)
    return found.select(*[F.col(n).alias(c) for c, n in names.items()], "n_words", "ranges", "items")


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_leaks(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with their columns."""
    hits = _union([_block_hits(docs, sent) for _, sent in _indexed(docs, benchmark, WINDOW, SHINGLE, block_words)])
    keys = _sent(hits.select("_k1", "_k2", F.array().alias("ranges"), F.array().alias("items")), max_broadcast)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *_keys())  # columns may have the names of the keys
    return rows.join(keys, ["_k1", "_k2"], "left_anti").select("_row.*")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_PATTERN}') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_PATTERN}') AS w FROM benchmark),
sized AS (SELECT *, least(len(w), {WINDOW}) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, lengths WHERE len(w) >= k)),
found AS (SELECT doc_id, item_id, i, k FROM grams JOIN windows USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
