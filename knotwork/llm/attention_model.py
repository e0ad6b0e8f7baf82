"""A small causal self-attention model in numpy: one layer, one head, and a softmax over classes of tokens.

The input at a place is the token before it. A class stands for one frequent token or for a bin of rarer ones, within
which a token has its share of the training counts; so a token's probability is that of its class, given the context,
times its share. Parameters are one flat vector, which is what tasks train, average and broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np


@dataclass(frozen=True)
class Shape:
    inputs: int  # different input embeddings
    classes: int
    width: int = 16
    window: int = 16

    def parts(self) -> list[tuple[str, tuple[int, ...]]]:
        d = self.width
        return [("e", (self.inputs, d)), ("p", (self.window, d)), ("q", (d, d)), ("k", (d, d)), ("v", (d, d)), ("o", (d, d)), ("c", (d, self.classes)), ("b", (self.classes,))]

    def size(self) -> int:
        return sum(int(np.prod(s)) for _, s in self.parts())

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out


def fresh(shape: Shape, class_share: np.ndarray, seed: int = 7) -> np.ndarray:
    """Starting parameters: the classes' shares as biases, the rest small."""
    flat = np.random.default_rng(seed).normal(0, 0.1, shape.size()).astype(np.float32)
    shape.split(flat)["b"][:] = np.log(np.maximum(class_share, 1e-9))
    return flat


def _summed(x: np.ndarray) -> np.ndarray:
    """Sums of rows, as a product: faster than a sum over short rows."""
    return x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)


def _exponentials(w: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Of the logits of classes. Logits are cut at 80 instead of shifted: single precision holds their exponentials."""
    p = h @ w["c"]
    p += w["b"]
    # no logit is above the product of norms
    if not (np.square(h).sum(axis=1).max(initial=0) * np.square(w["c"]).sum(axis=0).max()) ** 0.5 + w["b"].max() < 80:
        np.minimum(p, 80, out=p)
    return np.exp(p, out=p)


@lru_cache(maxsize=64)
def _later(t: int, kind: str) -> np.ndarray:
    """What hides later places from earlier ones."""
    return np.triu(np.full((t, t), -1e9, kind), 1)


def _forward(w: dict[str, np.ndarray], inputs: np.ndarray) -> tuple[np.ndarray, ...]:
    """The inputs, these under the product of queries and keys and under that of values and outputs, the attention, the sum."""
    b, t = inputs.shape
    d = w["q"].shape[0]
    x = w["e"][inputs]
    x += w["p"][:t]
    flat = x.reshape(-1, d)
    y = (flat @ (w["q"] @ w["k"].T * x.dtype.type(d**-0.5))).reshape(b, t, d)
    z = (flat @ (w["v"] @ w["o"])).reshape(b, t, d)
    s = y @ x.transpose(0, 2, 1)
    s += _later(t, s.dtype.char)
    a = np.exp(np.minimum(s, 80, out=s), out=s)
    a /= _summed(a).reshape(b, t, 1)
    h = a @ z
    h += x
    return x, y, z, a, h


def class_log_probs(w: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Natural log probability of the target class at each wanted place of windows in rows; later places never show in earlier
    ones. Places that are not wanted are context only: their classes are not worked out."""
    p = _exponentials(w, _forward(w, inputs)[-1][wanted])
    return np.log(p[np.arange(len(p)), targets[wanted]] / _summed(p))


def gradient(shape: Shape, flat: np.ndarray, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, float]:
    """The gradient of the mean loss over valid places, and that loss."""
    w, out = shape.split(flat), np.zeros_like(flat)
    g = shape.split(out)
    d = shape.width
    scale = flat.dtype.type(d**-0.5)
    x, y, z, a, h = _forward(w, inputs)
    flat_h, flat_x = h.reshape(-1, d), x.reshape(-1, d)
    p = _exponentials(w, flat_h)
    rows, target, good = np.arange(len(p)), targets.ravel(), valid.ravel()
    n = max(1, int(good.sum()))
    total = _summed(p)
    loss = -float(np.log(p[rows, target] / total + 1e-30)[good].sum()) / n
    # p less 1 at the target, times part, is the gradient of the logits
    p[rows, target] -= total
    part = (good / n).astype(p.dtype) / total
    g["c"][:] = (flat_h * part[:, None]).T @ p
    g["b"][:] = part @ p
    dh = ((p @ w["c"].T) * part[:, None]).reshape(x.shape)
    dz = a.transpose(0, 2, 1) @ dh
    ds = dh @ z.transpose(0, 2, 1)
    ds -= np.einsum("ijk,ijk->ij", ds, a)[:, :, None]
    ds *= a
    dy = ds @ x
    # of the two products of matrices, and of the inputs
    both = flat_x.T @ dy.reshape(-1, d) * scale
    g["q"][:], g["k"][:] = both @ w["k"], both.T @ w["q"]
    both = flat_x.T @ dz.reshape(-1, d)
    g["v"][:], g["o"][:] = both @ w["o"].T, w["v"].T @ both
    dx = ds.transpose(0, 2, 1) @ y
    dx += dh
    dx += (dy.reshape(-1, d) @ (w["k"] @ w["q"].T * scale)).reshape(x.shape)
    dx += (dz.reshape(-1, d) @ (w["v"] @ w["o"]).T).reshape(x.shape)
    g["p"][: x.shape[1]] = dx.sum(axis=0)
    np.add.at(g["e"].reshape(-1), (inputs.reshape(-1, 1) * d + np.arange(d)).ravel(), dx.ravel())
    return out, loss


def train(shape: Shape, flat: np.ndarray, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray, rate: float, batch: int = 64) -> np.ndarray:
    """One pass over the windows in the given order, with Adam. Its means are kept as sums, ten and a hundred times as large."""
    flat, m, s = flat.copy(), np.zeros_like(flat), np.zeros_like(flat)
    for step, at in enumerate(range(0, len(inputs), batch), 1):
        g, _ = gradient(shape, flat, inputs[at : at + batch], targets[at : at + batch], valid[at : at + batch])
        m *= 0.9
        m += g
        s *= 0.99
        g *= g
        s += g
        np.sqrt(s, out=g)
        scale = (0.01 / (1 - 0.99**step)) ** 0.5
        g += 1e-8 / scale
        np.divide(m, g, out=g)
        g *= 0.1 * rate / (1 - 0.9**step) / scale
        flat -= g
    return flat


def windows(length: int, window: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of overlapping windows over a text of length tokens, and how many places at the front of each are context only."""
    if length <= window:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    starts = np.arange(0, length - window + stride, stride)
    starts = np.minimum(starts, length - window)
    starts = np.unique(starts)
    return starts, np.append(0, starts[:-1] + window - starts[1:])
