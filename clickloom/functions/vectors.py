"""Vector, pooling, activation and loss expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _add(acc: Column, x: Column) -> Column:
    return acc + x


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), _add)


def l2_normalise(v: Column, eps: float = 1e-8) -> Column:
    """v / (norm + eps)."""
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), _add))
    return F.transform(v, lambda x: x.cast("double") / (norm + F.lit(eps)))


def clamp(v: Column, low: float, high: float) -> Column:
    """Each component within [low, high]."""
    return F.transform(v, lambda x: F.greatest(F.least(x.cast("double"), F.lit(high)), F.lit(low)))


def clamp_value(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def masked_mean(tokens: Column, mask: Column, width: int) -> Column:
    """Mean of the token vectors whose mask is 1 (masked mean pooling)."""
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(F.arrays_zip(tokens.alias("v"), mask.alias("m")), zero, lambda acc, t: F.zip_with(acc, t["v"], lambda a, x: a + x.cast("double") * t["m"]))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m), F.lit(1e-9))
    return F.transform(total, lambda x: x / count)


def last_pool(tokens: Column, mask: Column) -> Column:
    """The vector of the last token that isn't padding; the last position if all are."""
    last = F.array_max(F.transform(mask, lambda m, i: F.when(m > 0, i + 1).otherwise(0)))
    return F.element_at(tokens, F.when(last > 0, last).otherwise(F.size(tokens)).cast("int"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bce_with_logits(logit: Column, label: Column, pos_weight: Column | float = 1.0) -> Column:
    """Binary cross entropy of a logit, in the stable form, positives weighted."""
    weight = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    soft = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return (1 - label) * logit + (1 + (weight - 1) * label) * soft


def focal_loss(logit: Column, label: Column, gamma: float = 2.0, alpha: Column | float = 0.25) -> Column:
    """alpha (1 - exp(-bce)) ** gamma * bce."""
    bce = bce_with_logits(logit, label)
    return (alpha if isinstance(alpha, Column) else F.lit(float(alpha))) * F.pow(1 - F.exp(-bce), F.lit(gamma)) * bce


def squared_error(x: Column, y: Column) -> Column:
    return (x - y) * (x - y)


def smooth_l1(x: Column, y: Column) -> Column:
    gap = F.abs(x - y)
    return F.when(gap < 1, gap * gap * 0.5).otherwise(gap - 0.5)


def fm_second_order(x: Column, factors: list[list[float]]) -> Column:
    """Half of sum over factors of (sum v x)**2 - sum (v x)**2; ``factors[i]`` belongs to component i."""
    width = len(factors[0])
    total = F.lit(0.0)
    for f in range(width):
        column = F.array(*[F.lit(float(row[f])) for row in factors])
        vx = F.zip_with(x, column, lambda a, b: a.cast("double") * b)
        s = F.aggregate(vx, F.lit(0.0), _add)
        total = total + (s * s - F.aggregate(F.transform(vx, lambda t: t * t), F.lit(0.0), _add))
    return total * 0.5
