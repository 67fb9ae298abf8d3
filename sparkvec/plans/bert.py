"""A BERT encoder with a masked-language head in numpy, for sparse vectors of a model file without a runtime."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sparkvec.functions.subword import TokenizerFile
from sparkvec.operators.batching import TOKEN_BUDGET, cut_by_budget
from sparkvec.plans.providers import SESSIONS
from sparkvec.sources.readers import gguf_tensors, parse_gguf

EPS = 1e-12


def _gelu(x: np.ndarray) -> np.ndarray:
    """The tanh form."""
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


class Bert:
    """``weights`` by name; matrices are (out, in). ``layer`` is the prefix of a block's names."""

    def __init__(self, weights: dict[str, np.ndarray], heads: int, eps: float = EPS, layer: str = "enc.{}."):
        self.w, self.heads, self.eps, self.layer = weights, heads, eps, layer
        self.blocks = 0
        while f"{layer.format(self.blocks)}attn.q.weight" in weights:
            self.blocks += 1

    def _dense(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.w[f"{name}.weight"].T + self.w[f"{name}.bias"]

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        x = x - x.mean(axis=-1, keepdims=True)
        return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + self.eps) * self.w[f"{name}.weight"] + self.w[f"{name}.bias"]

    def hidden(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(texts, tokens, width) of token ids; masked tokens are seen by none."""
        n, width = ids.shape
        x = self.w["token_embd.weight"][ids] + self.w["position_embd.weight"][:width] + self.w["token_type_embd.weight"][0]
        x = self._norm(x, "embd_ln")
        unseen = np.where(mask[:, None, None, :] > 0, 0.0, -np.inf)
        split = lambda t: t.reshape(n, width, self.heads, -1).transpose(0, 2, 1, 3)
        for k in range(self.blocks):
            at = self.layer.format(k)
            q, key, v = (split(self._dense(x, f"{at}attn.{c}")) for c in "qkv")
            scores = q @ key.transpose(0, 1, 3, 2) / np.sqrt(q.shape[-1]) + unseen
            scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
            seen = (scores / scores.sum(axis=-1, keepdims=True)) @ v
            x = self._norm(x + self._dense(seen.transpose(0, 2, 1, 3).reshape(n, width, -1), f"{at}attn.o"), f"{at}ln1")
            x = self._norm(x + self._dense(_gelu(self._dense(x, f"{at}ffn.fc1")), f"{at}ffn.fc2"), f"{at}ln2")
        return x

    def logits(self, hidden: np.ndarray) -> np.ndarray:
        """A score of each token of the vocabulary at each place; without a decoder of its own the embeddings are it."""
        x = self._norm(_gelu(self._dense(hidden, "mlm_transform")), "mlm_ln")
        return x @ self.w.get("mlm_head.weight", self.w["token_embd.weight"]).T + self.w["mlm_bias"]

    def splade(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(texts, vocabulary): log(1 + the largest logit over 0) of the tokens that count."""
        best = np.where(mask[:, :, None] > 0, self.logits(self.hidden(ids, mask)), 0.0).max(axis=1)
        return np.log1p(np.maximum(best, 0.0))


class SpladeProvider:
    """Sparse vectors of texts by a model file that all workers can open, and a tokenizer. One model a worker process."""

    def __init__(self, path: str, tokenizer: TokenizerFile, heads: int = 0, max_length: int = 512, layer: str = "enc.{}."):
        self.path, self.tokenizer, self.heads, self.max_length, self.layer = path, tokenizer, heads, max_length, layer

    def _model(self) -> Bert:
        if self.path not in SESSIONS:
            with open(self.path, "rb") as f:
                raw = f.read()
            meta = parse_gguf(raw)["meta"]
            arch = meta.get("general.architecture", "bert")
            heads = self.heads or int(meta.get(f"{arch}.attention.head_count") or 0)
            if heads < 1:
                raise ValueError("cannot tell how many heads the model has")
            SESSIONS[self.path] = Bert(gguf_tensors(raw), heads, float(meta.get(f"{arch}.attention.layer_norm_epsilon", EPS)), self.layer)
        return SESSIONS[self.path]

    def ids(self, text: str) -> list[int]:
        added = {**self.tokenizer.vocab, **self.tokenizer.added}
        return [added["[CLS]"], *self.tokenizer.encode(text)[: self.max_length - 2], added["[SEP]"]]

    def sparse(self, rows: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(indices, values) of texts given by their ids; special tokens weigh nothing."""
        width = max(map(len, rows))
        ids, mask = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width))
        for i, row in enumerate(rows):
            ids[i, : len(row)], mask[i, : len(row)] = row, 1
        weights = self._model().splade(ids, mask)
        known = {**self.tokenizer.vocab, **self.tokenizer.added}
        weights[:, [known[t] for t in ("[CLS]", "[SEP]", "[PAD]", "[UNK]", "[MASK]") if t in known]] = 0
        return [(np.flatnonzero(w), w[np.flatnonzero(w)]) for w in weights]


def sparse_embed(df: DataFrame, provider: SpladeProvider, text: str = "text", batch_size: int = 32, budget: int = TOKEN_BUDGET) -> DataFrame:
    """``df`` with ``indices`` and ``values``; texts alike in length go together, within a budget of tokens. Null texts have none."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            ids = {i: provider.ids(t) for i, t in enumerate(pdf[text]) if isinstance(t, str)}
            order = sorted(ids, key=lambda i: (-len(ids[i]), i))
            indices, values = [None] * len(pdf), [None] * len(pdf)
            at = 0
            batches = cut_by_budget([len(ids[i]) for i in order], batch_size, budget)
            while at < len(order):
                end = at + batches.count(batches[at])
                for i, (terms, weights) in zip(order[at:end], provider.sparse([ids[i] for i in order[at:end]]), strict=True):
                    indices[i], values[i] = terms.tolist(), weights.tolist()
                at = end
            yield pdf.assign(indices=indices, values=values)

    return df.mapInPandas(run, f"{fields}, indices array<int>, values array<double>")
