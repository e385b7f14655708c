"""A small reverse-mode differentiator over numpy arrays, enough for the fusion models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def _unbroadcast(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    while g.ndim > len(shape):
        g = g.sum(axis=0)
    for k, n in enumerate(shape):
        if n == 1 and g.shape[k] != 1:
            g = g.sum(axis=k, keepdims=True)
    return g


class Var:
    """An array that remembers how it was made."""

    __array_priority__ = 100

    def __init__(self, value, parents: Sequence[tuple["Var", Callable[[np.ndarray], np.ndarray]]] = ()):
        self.value = np.asarray(value, dtype=np.float64)
        self.parents = parents
        self.grad: np.ndarray | None = None

    @property
    def shape(self) -> tuple[int, ...]:
        return self.value.shape

    def __add__(self, other):
        other = var(other)
        return Var(self.value + other.value, [(self, lambda g: _unbroadcast(g, self.shape)), (other, lambda g: _unbroadcast(g, other.shape))])

    def __mul__(self, other):
        other = var(other)
        return Var(self.value * other.value, [(self, lambda g: _unbroadcast(g * other.value, self.shape)), (other, lambda g: _unbroadcast(g * self.value, other.shape))])

    def __neg__(self):
        return self * -1.0

    def __sub__(self, other):
        return self + -var(other)

    def __rsub__(self, other):
        return var(other) + -self

    __radd__, __rmul__ = __add__, __mul__

    def __matmul__(self, other):
        other = var(other)

        def left(g):
            return _unbroadcast(g @ np.swapaxes(other.value, -1, -2), self.shape)

        def right(g):
            return _unbroadcast(np.swapaxes(self.value, -1, -2) @ g, other.shape)

        return Var(self.value @ other.value, [(self, left), (other, right)])

    def __getitem__(self, key):
        def back(g):
            out = np.zeros_like(self.value)
            np.add.at(out, key, g)
            return out

        return Var(self.value[key], [(self, back)])

    def reshape(self, *shape):
        return Var(self.value.reshape(*shape), [(self, lambda g: g.reshape(self.shape))])

    def swap(self, a: int, b: int):
        return Var(np.swapaxes(self.value, a, b), [(self, lambda g: np.swapaxes(g, a, b))])

    def sum(self, axis=None, keepdims=False):
        def back(g):
            if axis is not None and not keepdims:
                g = np.expand_dims(g, axis)
            return np.broadcast_to(g, self.shape).copy()

        return Var(self.value.sum(axis=axis, keepdims=keepdims), [(self, back)])

    def mean(self, axis=None, keepdims=False):
        n = self.value.size if axis is None else self.value.shape[axis]
        return self.sum(axis, keepdims) * (1.0 / n)

    def apply(self, value: np.ndarray, slope: np.ndarray):
        return Var(value, [(self, lambda g: g * slope)])

    def exp(self):
        e = np.exp(self.value)
        return self.apply(e, e)

    def power(self, p: float):
        return self.apply(self.value**p, p * self.value ** (p - 1))

    def relu(self):
        return self.apply(np.maximum(self.value, 0), (self.value > 0).astype(float))

    def leaky_relu(self, slope: float):
        return self.apply(np.where(self.value >= 0, self.value, slope * self.value), np.where(self.value >= 0, 1.0, slope))

    def sigmoid(self):
        s = 1 / (1 + np.exp(-np.clip(self.value, -500, 500)))
        return self.apply(s, s * (1 - s))

    def softplus(self):
        return self.apply(np.logaddexp(0, self.value), 1 / (1 + np.exp(-np.clip(self.value, -500, 500))))

    def clip(self, low: float, high: float):
        return self.apply(np.clip(self.value, low, high), ((self.value >= low) & (self.value <= high)).astype(float))

    def softmax(self):
        shifted = np.exp(self.value - self.value.max(axis=-1, keepdims=True))
        s = shifted / shifted.sum(axis=-1, keepdims=True)
        return Var(s, [(self, lambda g: s * (g - (g * s).sum(axis=-1, keepdims=True)))])

    def backward(self) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack += [(p, False) for p, _ in node.parents]
        for node in order:
            node.grad = None
        self.grad = np.ones_like(self.value)
        for node in reversed(order):
            for parent, back in node.parents:
                g = back(node.grad)
                parent.grad = g if parent.grad is None else parent.grad + g


def var(x) -> Var:
    return x if isinstance(x, Var) else Var(x)


def concat(parts: Sequence[Var], axis: int = -1) -> Var:
    sizes = np.cumsum([0] + [p.value.shape[axis] for p in parts])

    def piece(k):
        return lambda g: np.take(g, range(sizes[k], sizes[k + 1]), axis=axis)

    return Var(np.concatenate([p.value for p in parts], axis=axis), [(p, piece(k)) for k, p in enumerate(parts)])
