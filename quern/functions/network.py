"""Transformer layers on whole sequences, in Arrow batches. Weights are matrices by name, one row for
each output; they go to the workers once, so a model must fit there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Weights = dict[str, np.ndarray]


def turned(x: np.ndarray, theta: float) -> np.ndarray:
    """Rotary embedding of (..., places, entries): pairs of entries turn with the place."""
    half = x.shape[-1] // 2
    angle = np.arange(x.shape[-2])[:, None] * theta ** (-np.arange(half) / half)
    even, odd = x[..., 0::2], x[..., 1::2]
    out = np.empty_like(x)
    out[..., 0::2] = even * np.cos(angle) - odd * np.sin(angle)
    out[..., 1::2] = odd * np.cos(angle) + even * np.sin(angle)
    return out


def self_attention(x: np.ndarray, heads: int, weights: Weights, theta: float | None = None) -> np.ndarray:
    """Causal self-attention of (places, entries) in several heads, with rotary places if ``theta`` is given."""
    parts = [(x @ weights[f"attn.{n}_proj.weight"].T).reshape(len(x), heads, -1).swapaxes(0, 1) for n in "qkv"]
    q, k, v = parts if theta is None else (turned(parts[0], theta), turned(parts[1], theta), parts[2])
    scores = q @ k.swapaxes(1, 2) / np.sqrt(q.shape[-1])
    scores[:, ~np.tri(len(x), dtype=bool)] = -np.inf
    shares = np.exp(scores - scores.max(axis=-1, keepdims=True))
    shares /= shares.sum(axis=-1, keepdims=True)
    return (shares @ v).swapaxes(0, 1).reshape(len(x), -1) @ weights["attn.output_proj.weight"].T


def normed(x: np.ndarray, gain: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + eps) * gain


def feed_forward(x: np.ndarray, weights: Weights) -> np.ndarray:
    gate = x @ weights["ffn.w1.weight"].T
    return (gate / (1 + np.exp(-gate)) * (x @ weights["ffn.w3.weight"].T)) @ weights["ffn.w2.weight"].T


def block(x: np.ndarray, heads: int, weights: Weights, theta: float) -> np.ndarray:
    """A layer: attention, then the feed-forward part, each after a norm and added to what came in."""
    x = x + self_attention(normed(x, weights["ln1.weight"]), heads, weights, theta)
    return x + feed_forward(normed(x, weights["ln2.weight"]), weights)


def language_model(ids: np.ndarray, layers: int, heads: int, weights: Weights, theta: float) -> np.ndarray:
    """(places, vocabulary): scores of the next token after each place."""
    x = weights["token_embeddings.weight"][ids]
    for k in range(layers):
        lead = f"layers.{k}."
        x = block(x, heads, {n.removeprefix(lead): w for n, w in weights.items() if n.startswith(lead)}, theta)
    return normed(x, weights["ln_final.weight"]) @ weights["lm_head.weight"].T


def mapped(rows: DataFrame, column: str, name: str, layer: Callable[[np.ndarray, Weights], np.ndarray], weights: Weights) -> DataFrame:
    """``rows`` with ``name`` array<double>: what a layer makes of each array, in the order of its
    entries. Null arrays give null, and no array meets another. A column of that name is replaced."""
    plain = rows.drop(name)
    names, held = plain.columns, rows.sparkSession.sparkContext.broadcast(weights)  # the model

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            arrays = batch.column(names.index(column))
            out = [layer(x.values.to_numpy(zero_copy_only=False), held.value).ravel() if x.is_valid else None for x in arrays]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*names, name])

    return plain.mapInArrow(batches, T.StructType([*plain.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))
