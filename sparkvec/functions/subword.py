"""Subword tokenizers and text functions that need a sequential scan: Arrow-batched UDFs over broadcast vocabularies."""

from __future__ import annotations

import heapq
import json
import math
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARACTERS = 100
#: Fixed values of the 64-bit FNV-1a fingerprint.
FNV_OFFSET, FNV_PRIME = 1469598103934665603, 1099511628211
UNKNOWN_PENALTY = 10.0


def decode_utf8(raw: bytes) -> str:
    """Strict decoding; a byte that begins no valid sequence stays alone, as its Latin-1 character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode("utf-8"))
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append(chr(raw[at]))
                at += 1
        return "".join(out)


def bert_normalize(text: str, lower: bool = True, strip: bool = True) -> str:
    """Lower-casing and stripping of accents, each by its own switch."""
    if strip:
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return text.lower() if lower else text


def wordpiece(word: str, vocab: dict[str, int], unknown: int, mark: str = "##") -> list[int]:
    """Greedy longest match; one unknown for a word that is too long or has a piece that is not in the vocabulary."""
    if len(word) > MOST_CHARACTERS:
        return [unknown]
    if word in vocab:
        return [vocab[word]]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = vocab.get((mark if at else "") + word[at:end])
            if piece is not None:
                out.append(piece)
                at = end
                break
        else:
            return [unknown]
    return out


def bpe(symbols: list[str], ranks: dict[tuple[str, str], int], vocab: dict[str, int], unknown: int) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until none is left: a heap over a linked list of symbols."""
    symbols = list(symbols)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or (symbols[i], symbols[j]) != pair:
            continue
        symbols[i] += symbols[j]
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n and (p := (symbols[left], symbols[after[left]])) in ranks:
                heapq.heappush(heap, (ranks[p], left, p))
    return [vocab.get(s, unknown) for s, on in zip(symbols, alive, strict=True) if on]


def unigram(word: str, scores: dict[str, float], ids: dict[str, int], unknown: int, byte_ids: dict[int, int] | None = None) -> list[int]:
    """Viterbi segmentation; unknown characters cost the least score less 10, and neighbouring ones fuse."""
    if not word:
        return []
    longest = max(map(len, scores), default=1)
    lost = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
    best: list[tuple[float, int, str | None]] = [(0.0, 0, None)] + [(-math.inf, 0, None)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - longest), end):
            piece = word[start:end]
            if piece in scores and best[start][0] + scores[piece] > best[end][0]:
                best[end] = (best[start][0] + scores[piece], start, piece)
        if word[end - 1] not in scores and best[end - 1][0] + lost > best[end][0]:
            best[end] = (best[end - 1][0] + lost, end - 1, None)
    path, at = [], len(word)
    while at:
        _, start, piece = best[at]
        path.append((piece, word[start:at]))
        at = start
    out: list[int] = []
    fused = False
    for piece, surface in reversed(path):
        if piece is not None:
            out.append(ids[piece])
            fused = False
        elif byte_ids:
            out += [byte_ids.get(b, unknown) for b in surface.encode()]
        elif not fused:
            out.append(unknown)
            fused = True
    return out


def load_vocab(lines: list[str], lower: bool = True, strip: bool = True) -> dict[str, int]:
    """Ids by order of the lines; of pieces that are equal after normalisation the first id holds."""
    out: dict[str, int] = {}
    for i, line in enumerate(lines):
        out.setdefault(bert_normalize(line, lower, strip), i)
    return out


@dataclass
class TokenizerFile:
    """What a tokenizer.json says: the kind of model, its pieces, and tokens that were added to it, which texts are split at first."""

    kind: str
    vocab: dict[str, int]
    unknown: int
    ranks: dict[tuple[str, str], int]
    scores: dict[str, float]
    added: dict[str, int]
    special: frozenset[str]
    lower: bool
    strip: bool
    mark: str

    def encode(self, text: str) -> list[int]:
        """Ids of a text without special tokens around it: added tokens are looked for first, the longest at each place."""
        out: list[int] = []
        for part in self._split(text):
            if part in self.added:
                out.append(self.added[part])
                continue
            for word in self._words(part):
                out += self._pieces(word)
        return out

    def _split(self, text: str) -> list[str]:
        if not self.added:
            return [text]
        found = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=lambda t: (-len(t), t))) + ")")
        return [p for p in found.split(text) if p]

    def _words(self, text: str) -> list[str]:
        if self.kind == "Unigram":
            return ["\u2581" + w for w in text.split()]
        return regex.findall(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]", bert_normalize(text, self.lower, self.strip))

    def _pieces(self, word: str) -> list[int]:
        if self.kind == "WordPiece":
            return wordpiece(word, self.vocab, self.unknown, self.mark)
        if self.kind == "BPE":
            return bpe(list(word), self.ranks, self.vocab, self.unknown)
        return unigram(word, self.scores, self.vocab, self.unknown)


def load_tokenizer(raw: str) -> TokenizerFile:
    """The model of a tokenizer.json: WordPiece, BPE or Unigram; a file without a type is told by what it has."""
    held = json.loads(raw)
    model = held.get("model") or {}
    pieces = model.get("vocab") or {}
    kind = model.get("type") or ("Unigram" if isinstance(pieces, list) else "BPE" if model.get("merges") else "WordPiece")
    if kind not in ("WordPiece", "BPE", "Unigram"):
        raise ValueError(f"unknown kind of tokenizer: {kind}")
    scores = {p: float(s) for p, s in pieces} if kind == "Unigram" else {}
    vocab = {p: i for i, (p, _) in enumerate(pieces)} if kind == "Unigram" else dict(pieces)
    added = {t["content"]: int(t["id"]) for t in held.get("added_tokens") or []}
    unknown = model.get("unk_id") if kind == "Unigram" else {**vocab, **added}.get(model.get("unk_token") or "[UNK]")
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model.get("merges") or []]
    steps = held.get("normalizer") or {}
    steps = steps.get("normalizers", [steps])
    own = next((s for s in steps if s.get("type") == "BertNormalizer"), None)
    lower = own.get("lowercase", True) if own else any(s.get("type") == "Lowercase" for s in steps)
    accents = own.get("strip_accents") if own else any(s.get("type") == "StripAccents" for s in steps)
    strip = lower if accents is None else bool(accents)
    special = frozenset(t["content"] for t in held.get("added_tokens") or [] if t.get("special"))
    return TokenizerFile(kind, vocab, int(unknown or 0), {m: i for i, m in enumerate(merges)}, scores, added, special, lower, strip, model.get("continuing_subword_prefix") or "##")


class Charsmap:
    """A precompiled character map: the size of a double-array trie, its units, then replacements that end in a zero byte.

    A unit holds a label in its low byte, a leaf mark in bit 8, a scale in bit 9 and an offset above; a leaf's value is its low 31 bits."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        if size % 4 or 4 + size > len(blob):
            raise ValueError("malformed character map")
        self.units = [int.from_bytes(blob[i : i + 4], "little") for i in range(4, 4 + size, 4)]
        self.texts = blob[4 + size :]

    def replacement(self, key: bytes) -> str | None:
        """What replaces a key that is in the map as a whole."""
        at, found = 0, None
        at ^= self._offset(self.units[0])
        for n, b in enumerate(key):
            at ^= b
            if not b or at >= len(self.units) or self.units[at] & 0x800000FF != b:
                return None
            unit = self.units[at]
            at ^= self._offset(unit)
            if n == len(key) - 1 and unit >> 8 & 1:
                value = self.units[at] & 0x7FFFFFFF
                found = self.texts[value : self.texts.index(b"\0", value)].decode()
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def __call__(self, text: str) -> str:
        """Clusters of under six bytes are looked up whole first, then all by character."""
        out = []
        for cluster in regex.findall(r"\X", text):
            raw = cluster.encode()
            whole = self.replacement(raw) if len(raw) < 6 else None
            if whole is not None:
                out.append(whole)
                continue
            for c in cluster:
                new = self.replacement(c.encode())
                out.append(c if new is None else new)
        return "".join(out)


def fnv1a(text: str) -> str:
    """16 hexadecimal digits over the length in 8 bytes, then the text."""
    raw, h = text.encode(), FNV_OFFSET
    for b in len(raw).to_bytes(8, "little") + raw:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def tokens_udf(encode: Callable[[str], list[int]]):
    """A column function: ids of every word of an ARRAY<STRING>, words encoded once a batch."""

    @F.pandas_udf("array<int>")
    def run(words: pd.Series) -> pd.Series:
        known: dict[str, list[int]] = {}

        def ids(row) -> list[int] | None:
            if row is None:
                return None
            out: list[int] = []
            for w in row:
                if w not in known:
                    known[w] = encode(w)
                out += known[w]
            return out

        return words.map(ids)

    return run


def text_udf(change: Callable[[str], str]):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else change(x))

    return run


def fingerprint(text: Column | str) -> Column:
    return text_udf(fnv1a)(text)


def bert_normalized(text: Column | str, lower: bool = True, strip: bool = True) -> Column:
    return text_udf(lambda x: bert_normalize(x, lower, strip))(text)
