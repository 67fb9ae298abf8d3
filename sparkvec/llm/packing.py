"""Packing of token pieces into windows: best-fit decreasing over a segment tree of remaining capacities.

Overlong documents are first cut into full windows; what remains of each document is one piece shorter than a window. Best-fit
decreasing looks at nothing but lengths, of which there are at most ``WINDOW``: it runs once over the histogram
of lengths, whole runs of equal pieces at a time, and yields a plan of a few thousand segments that does not grow with the
corpus. The r-th piece of its length, by order in the tokenised table, finds its window in the plan by binary search. So packing is global and exact, while no task sees more than its partition.

Ids are those of the tokenizer file, found by another library through ranks of the same vocabulary, which lie beside it;
that both agree rests on tests. Texts that hold a special token's text are encoded by the tokenizer file itself.

Defined results: null text is empty and gives one piece, the end id; repeated rows are packed each for itself; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.llm.common import cut, few, table

WINDOW = 2048
END_ID = 1
#: Counts of lengths by partition that are broadcast, at most; more are joined.
MAX_BROADCAST = 1_000_000


class SegmentTree:
    """The open windows by remaining capacity; finds the tightest capacity that still takes a piece."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.has = bytearray(2 * self.leaves)
        self.stacks: list[list[list[int]]] = [[] for _ in range(self.leaves)]

    def push(self, capacity: int, first: int, count: int) -> None:
        self.stacks[capacity].append([first, count])
        at = self.leaves + capacity
        while at and not self.has[at]:
            self.has[at] = 1
            at //= 2

    def take(self, capacity: int, count: int) -> tuple[int, int]:
        """First id and number of at most ``count`` consecutive windows of that capacity."""
        run = self.stacks[capacity][-1]
        first, got = run[0], min(count, run[1])
        run[0] += got
        run[1] -= got
        if not run[1]:
            self.stacks[capacity].pop()
            if not self.stacks[capacity]:
                at = self.leaves + capacity
                self.has[at] = 0
                while at > 1 and not (self.has[at] | self.has[at ^ 1]):
                    at //= 2
                    self.has[at] = 0
        return first, got

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` that has an open window."""
        at = self.leaves + length
        if self.has[at]:
            return length
        while at > 1:
            if not at & 1 and self.has[at ^ 1]:
                at ^= 1
                while at < self.leaves:
                    at = 2 * at if self.has[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Segments (length, first rank, first window, offset, pieces a window) in order of length and rank. Piece number r of a
    length, in its last segment that begins at or before r, is number k = r - first rank there, and lies in window
    ``first window + k // pieces`` behind ``k % pieces`` equal ones.

    One by one, equal pieces would fill the tightest window until it takes no more of them, then the next one: so a run of
    windows of one capacity takes ``capacity // length`` pieces each."""
    tree, opened, plan = SegmentTree(window), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first = window, opened
                each = window // length
                got = -(-left // each)
                opened += got
            else:
                each = capacity // length
                first, got = tree.take(capacity, -(-left // each))
            plan.append((length, rank, first, window - capacity, each))
            placed = min(left, got * each)
            full, rest = divmod(placed, each)
            if full and capacity > each * length:
                tree.push(capacity - each * length, first, full)
            if rest:
                tree.push(capacity - rest * length, first + full, 1)
            rank += placed
            left -= placed
    return sorted(plan)


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        special = any(s in text for s in self.special)
        ids = array("I", self.whole.encode(text, add_special_tokens=False).ids if special else self.encode(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


_ENCODERS: dict[str, Encoder] = {}
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("local", pa.int64())])
_IDS = pa.list_(pa.int32())
#: Bytes of ids that a worker holds before it passes them on.
HELD_BYTES = 1 << 23


def _cut_pieces(path: str, window: int, end_id: int, with_ids: bool):
    schema = _PIECES.append(pa.field("ids", _IDS)) if with_ids else _PIECES

    def made(rows: list[tuple], held: list) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_PIECES), _PIECES, strict=True)]
        if with_ids:
            ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in held])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(held), "<i4"))))
        return pa.record_batch(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encode, part, seen = _ENCODERS[path], TaskContext.get().partitionId(), [0] * (window + 1)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            held: list = []
            size = 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py() or "") + end)
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    length = len(piece) // 4
                    rows.append((doc_id.as_py(), start, length, zlib.crc32(piece), n, part, seen[length]))
                    seen[length] += 1
                    if with_ids:
                        held.append(piece)
                        size += len(piece)
                if size > HELD_BYTES:
                    yield made(rows, held)
                    rows, held, size = [], [], 0
            yield made(rows, held)

    return run


def _place(plan: list[tuple[int, int, int, int, int]], with_ids: bool):
    length, rank, first, offset, each = (np.array(c, dtype=np.int64) for c in zip(*plan, strict=True)) if plan else (np.zeros(0, np.int64),) * 5
    keys = (length << 48) | rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("length").to_numpy().astype(np.int64)
            r = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (n << 48) | r, side="right") - 1
            k = r - rank[at]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            columns = [batch.column(c).cast(pa.int64()) for c in names] + [pa.array(first[at] + k // each[at]), pa.array(offset[at] + k % each[at] * n)]
            if with_ids:
                columns.append(batch.column("ids"))
            yield pa.record_batch(columns, names=[*names, "sequence_id", "offset", *(["ids"] if with_ids else [])])

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places, and their ``ids`` if wanted. ``tokenizer``: path of the tokenizer file
    on every executor, its ranks beside it. Pieces lie where they were cut, and nothing but counts is shuffled, up to
    ``MAX_BROADCAST`` of those."""
    more = ", ids array<int>" if with_ids else ""
    pieces = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            _cut_pieces(tokenizer, window, end_id, with_ids), "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, local long" + more
        )
    )
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = cut(counts.select("length", "part", "n", F.coalesce(before, F.lit(0)).alias("before")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = pieces.join(few(counts.select("length", "part", "before"), MAX_BROADCAST), ["length", "part"]).withColumn("rank", F.col("before") + F.col("local"))
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(_place(plan_windows(histogram, window), with_ids), shape + more)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op6_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer or tokenizer_path())
