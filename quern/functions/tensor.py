"""Numeric contracts on ``array<double>`` columns, as higher-order functions of the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def dot(xs: Column, ys: Column) -> Column:
    return total(F.zip_with(xs, ys, lambda x, y: x * y))


def linear(weights: Column, x: Column) -> Column:
    """``W x`` for a row-major matrix: one product for each output."""
    return F.transform(weights, lambda row: dot(row, x))


def silu(xs: Column) -> Column:
    return F.transform(xs, lambda x: x / (1.0 + F.exp(-x)))


def swiglu(w1: Column, w2: Column, w3: Column, x: Column) -> Column:
    gated = F.zip_with(silu(linear(w1, x)), linear(w3, x), lambda a, b: a * b)
    return linear(w2, gated)


def softmax(xs: Column) -> Column:
    """Softmax that doesn't overflow: the largest entry is subtracted first."""
    return bound(_shifted(xs), lambda e: bound(total(e), lambda t: F.transform(e, lambda v: v / t)))


def _shifted(xs: Column) -> Column:
    """Exponentials of the distances to the largest entry."""
    return bound(xs, lambda x: bound(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m))))


def log_sum_exp(xs: Column) -> Column:
    return bound(xs, lambda x: F.array_max(x) + F.log(total(_shifted(x))))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Loss of one row; the target counts from 0."""
    return bound(logits, lambda x: log_sum_exp(x) - F.element_at(x, target.cast("int") + 1))


def rms_norm(xs: Column, gain: Column | None = None, eps: float = 1e-5) -> Column:
    scale = lambda x: F.sqrt(total(F.transform(x, lambda v: v * v)) / F.size(x) + F.lit(eps))
    normed = bound(xs, lambda x: bound(scale(x), lambda s: F.transform(x, lambda v: v / s)))
    return normed if gain is None else F.zip_with(normed, gain, lambda x, g: x * g)


def rope(xs: Column, position: Column, theta: float = 10_000.0) -> Column:
    """Rotary embedding of pairs (0,1), (2,3), … of a vector at a position."""

    def turned(x: Column, v: Column, k: Column) -> Column:
        angle = position * F.pow(F.lit(theta), -F.floor(k / 2).cast("double") / F.floor(F.size(x) / 2))
        other = F.get(x, F.when(k % 2 == 0, k + 1).otherwise(k - 1))
        return v * F.cos(angle) + F.when(k % 2 == 0, -other).otherwise(other) * F.sin(angle)

    return bound(xs, lambda x: F.transform(x, lambda v, k: turned(x, v, k)))


def attention(query: Column, keys: Column, values: Column, mask: Column | None = None) -> Column:
    """Scaled dot-product attention of one query over arrays of keys and values."""
    scores = bound(query, lambda q: F.transform(keys, lambda k: dot(q, k) / F.sqrt(F.size(q).cast("double"))))
    if mask is not None:
        scores = F.zip_with(scores, mask, lambda s, m: F.when(m, s).otherwise(F.lit(-1e300)))
    weighted = F.zip_with(softmax(scores), values, lambda w, v: F.transform(v, lambda x: w * x))
    zeros = F.transform(F.get(values, F.lit(0)), lambda _: F.lit(0.0))
    return F.aggregate(weighted, zeros, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))


def cosine_lr(step: Column, highest: float, lowest: float, warm_up: int, cycle: int) -> Column:
    """Learning rate with linear warm-up, a half cosine and a floor."""
    part = (step - warm_up) / float(cycle - warm_up)
    half = F.lit(lowest) + F.lit(0.5) * (1.0 + F.cos(part * math.pi)) * (highest - lowest)
    return F.when(step < warm_up, step * highest / float(warm_up)).when(step <= cycle, half).otherwise(F.lit(lowest))


def clip_scale(norm: Column, limit: float, eps: float = 1e-6) -> Column:
    """The factor that brings a global L2 norm down to a limit."""
    return F.when(norm > limit, F.lit(limit) / (norm + eps)).otherwise(F.lit(1.0))
