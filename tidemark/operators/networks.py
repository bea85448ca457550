"""Sequence networks as layers with their own backward passes: recurrent ones and a causal convolutional one.

Inputs are (rows, days, features); a layer's forward gives its output and what backward needs; backward gives the gradient
of its input and of its weights. Weights are named arrays; a network's are one flat vector, so that gradients add up as such.
A network works through its rows a STRIP at a time, whose arrays stay in the processor's cache, and adds up losses and gradients.
Normalisation is over the channels of one row and day, never over a batch: a row's output doesn't depend on the rows it is
dealt with, nor a day's on later days. There is no dropout; training stops early instead.
"""

from __future__ import annotations

import numpy as np

#: Rows that go through a network at once; a sum over rows depends on it in its last digits.
STRIP = 8


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Layer:
    shapes: dict[str, tuple[int, ...]] = {}

    def start(self, rng: np.random.Generator) -> dict[str, np.ndarray]:
        """Uniform within 1 / sqrt(inputs) for matrices and their biases."""
        return {k: rng.uniform(-1, 1, s) / np.sqrt(self.wide) for k, s in self.shapes.items()}


class Linear(Layer):
    """On the last axis; over days it is a convolution of width 1."""

    def __init__(self, inputs: int, outputs: int):
        self.wide, self.shapes = inputs, {"w": (inputs, outputs), "b": (outputs,)}

    def forward(self, p, x):
        return x @ p["w"] + p["b"], x

    def backward(self, p, x, dy):
        flat = x.reshape(-1, x.shape[-1])
        d = dy.reshape(-1, dy.shape[-1])
        return dy @ p["w"].T, {"w": flat.T @ d, "b": d.sum(axis=0)}


def channel_mean(x: np.ndarray) -> np.ndarray:
    """The mean over the last axis, as a product with a vector, which is faster on few channels."""
    return (x.reshape(-1, x.shape[-1]) @ np.full((x.shape[-1], 1), 1 / x.shape[-1])).reshape(*x.shape[:-1], 1)


class LayerNorm(Layer):
    def __init__(self, channels: int):
        self.shapes = {"scale": (channels,), "shift": (channels,)}

    def start(self, rng):
        return {"scale": np.ones(self.shapes["scale"]), "shift": np.zeros(self.shapes["shift"])}

    def forward(self, p, x):
        centred = x - channel_mean(x)
        inverse = 1 / np.sqrt(channel_mean(centred * centred) + 1e-5)
        unit = centred * inverse
        return unit * p["scale"] + p["shift"], (unit, inverse)

    def backward(self, p, held, dy):
        unit, inverse = held
        du = dy * p["scale"]
        dx = inverse * (du - channel_mean(du) - unit * channel_mean(du * unit))
        axes = tuple(range(dy.ndim - 1))
        return dx, {"scale": (dy * unit).sum(axis=axes), "shift": dy.sum(axis=axes)}


class Gelu(Layer):
    """In its form by tanh, which differs from the one by the normal distribution by less than 0.001."""

    def forward(self, p, x):
        square = x * x
        # (1 + tanh(u)) / 2, by the exponential, which numpy has faster
        share = 1 / (1 + np.exp(np.minimum(-np.sqrt(8 / np.pi) * x * (1 + 0.044715 * square), 700)))
        return x * share, (x, square, share)

    def backward(self, p, held, dy):
        x, square, share = held
        return dy * (share + np.sqrt(8 / np.pi) * x * share * (1 - share) * (1 + 3 * 0.044715 * square)), {}

    def start(self, rng):
        return {}


class Silu(Gelu):
    def forward(self, p, x):
        return x * sigmoid(x), x

    def backward(self, p, x, dy):
        s = sigmoid(x)
        return dy * (s + x * s * (1 - s)), {}


class LastDay(Gelu):
    def forward(self, p, x):
        return x[:, -1], x.shape

    def backward(self, p, shape, dy):
        dx = np.zeros(shape)
        dx[:, -1] = dy
        return dx, {}


class MeanDay(Gelu):
    def forward(self, p, x):
        return x.mean(axis=1), x.shape

    def backward(self, p, shape, dy):
        return np.repeat(dy[:, None] / shape[1], shape[1], axis=1), {}


class Recurrent(Layer):
    """A recurrent layer; gates is how many times the hidden size its matrices are wide."""

    gates = 1

    def __init__(self, inputs: int, hidden: int):
        self.hidden, self.wide = hidden, hidden
        self.shapes = {"w": (inputs, self.gates * hidden), "b": (self.gates * hidden,), "u": (hidden, self.gates * hidden), "c": (self.gates * hidden,)}

    def forward(self, p, x):
        inputs = x @ p["w"] + p["b"]
        out, state, held = np.zeros((*x.shape[:2], self.hidden)), self.first(len(x)), []
        for t in range(x.shape[1]):
            state, kept = self.step(inputs[:, t], state[0] @ p["u"] + p["c"], state)
            out[:, t] = state[0]
            held.append(kept)
        return out, (x, out, held)

    def backward(self, p, held, dy):
        x, out, steps = held
        d_in, g = np.zeros((*x.shape[:2], self.gates * self.hidden)), {"u": np.zeros(self.shapes["u"]), "c": np.zeros(self.shapes["c"])}
        d_state = [np.zeros_like(s) for s in self.first(len(x))]
        for t in range(x.shape[1] - 1, -1, -1):
            d_state[0] = d_state[0] + dy[:, t]
            d_in[:, t], d_rec, d_state = self.back(steps[t], d_state)
            before = out[:, t - 1] if t else np.zeros_like(out[:, 0])
            g["u"] += before.T @ d_rec
            g["c"] += d_rec.sum(axis=0)
            d_state[0] = d_state[0] + d_rec @ p["u"].T
        flat, d = x.reshape(-1, x.shape[-1]), d_in.reshape(-1, d_in.shape[-1])
        return d_in @ p["w"].T, g | {"w": flat.T @ d, "b": d.sum(axis=0)}

    def first(self, rows: int) -> list[np.ndarray]:
        return [np.zeros((rows, self.hidden))]


class Rnn(Recurrent):
    def step(self, a, r, state):
        h = np.tanh(a + r)
        return [h], h

    def back(self, h, d_state):
        d = d_state[0] * (1 - h * h)
        return d, d, [np.zeros_like(d)]


class Gru(Recurrent):
    gates = 3

    def step(self, a, r, state):
        k, h = self.hidden, state[0]
        reset, update = sigmoid(a[:, :k] + r[:, :k]), sigmoid(a[:, k : 2 * k] + r[:, k : 2 * k])
        new = np.tanh(a[:, 2 * k :] + reset * r[:, 2 * k :])
        return [(1 - update) * new + update * h], (reset, update, new, r[:, 2 * k :], h)

    def back(self, kept, d_state):
        reset, update, new, recurrent, h = kept
        d = d_state[0]
        d_new = d * (1 - update) * (1 - new * new)
        d_update = d * (h - new) * update * (1 - update)
        d_reset = d_new * recurrent * reset * (1 - reset)
        return np.concatenate([d_reset, d_update, d_new], axis=1), np.concatenate([d_reset, d_update, d_new * reset], axis=1), [d * update]


class Lstm(Recurrent):
    gates = 4

    def first(self, rows):
        return [np.zeros((rows, self.hidden)), np.zeros((rows, self.hidden))]

    def step(self, a, r, state):
        k, x = self.hidden, a + r
        enter, forget, out = sigmoid(x[:, :k]), sigmoid(x[:, k : 2 * k]), sigmoid(x[:, 3 * k :])
        new = np.tanh(x[:, 2 * k : 3 * k])
        cell = forget * state[1] + enter * new
        return [out * np.tanh(cell), cell], (enter, forget, new, out, state[1], np.tanh(cell))

    def back(self, kept, d_state):
        enter, forget, new, out, before, cell = kept
        d_cell = d_state[1] + d_state[0] * out * (1 - cell * cell)
        d = np.concatenate([d_cell * new * enter * (1 - enter), d_cell * before * forget * (1 - forget), d_cell * enter * (1 - new * new), d_state[0] * cell * out * (1 - out)], axis=1)
        return d, d, [np.zeros_like(d_cell), d_cell * forget]


class CausalConv(Layer):
    """A dilated convolution over days; a day sees itself and earlier days, zeros before the first."""

    def __init__(self, channels: int, width: int = 3, dilation: int = 1):
        self.reach, self.wide = [(width - 1 - k) * dilation for k in range(width)], channels * width
        self.shapes = {"w": (width, channels, channels), "b": (channels,)}

    def forward(self, p, x):
        # the days that a day sees stand beside each other, for one product of matrices
        seen = np.zeros((*x.shape[:2], len(self.reach), x.shape[2]))
        for k, back in enumerate(self.reach):
            if back < x.shape[1]:
                seen[:, back:, k] = x[:, : x.shape[1] - back]
        flat = seen.reshape(x.shape[0] * x.shape[1], -1)
        return (flat @ p["w"].reshape(flat.shape[1], -1)).reshape(x.shape) + p["b"], flat

    def backward(self, p, flat, dy):
        d = dy.reshape(-1, dy.shape[-1])
        d_seen = (d @ p["w"].reshape(flat.shape[1], -1).T).reshape(*dy.shape[:2], len(self.reach), -1)
        dx = np.zeros_like(dy)
        for k, back in enumerate(self.reach):
            if back < dy.shape[1]:
                dx[:, : dy.shape[1] - back] += d_seen[:, back:, k]
        return dx, {"w": (flat.T @ d).reshape(p["w"].shape), "b": d.sum(axis=0)}


class Chain(Layer):
    """Layers one after the other, with the input added at the end if it is residual."""

    def __init__(self, *layers: Layer, residual: bool = False):
        self.layers, self.residual = layers, residual
        self.shapes = {f"{i}.{k}": s for i, layer in enumerate(layers) for k, s in layer.shapes.items()}

    def start(self, rng):
        return {f"{i}.{k}": v for i, layer in enumerate(self.layers) for k, v in layer.start(rng).items()}

    def _own(self, p, i):
        return {k.split(".", 1)[1]: v for k, v in p.items() if k.split(".", 1)[0] == str(i)}

    def forward(self, p, x):
        y, held = x, []
        for i, layer in enumerate(self.layers):
            y, kept = layer.forward(self._own(p, i), y)
            held.append(kept)
        return y + x if self.residual else y, held

    def backward(self, p, held, dy):
        d, grads = dy, {}
        for i in range(len(self.layers) - 1, -1, -1):
            d, g = self.layers[i].backward(self._own(p, i), held[i], d)
            grads |= {f"{i}.{k}": v for k, v in g.items()}
        return d + dy if self.residual else d, grads


class Network:
    """A chain that gives one number a row, with its weights as one vector."""

    def __init__(self, *layers: Layer):
        self.chain = Chain(*layers)
        self.names = sorted(self.chain.shapes)
        self.size = sum(int(np.prod(self.chain.shapes[n])) for n in self.names)

    def start(self, seed: int = 0) -> np.ndarray:
        found = self.chain.start(np.random.default_rng(seed))
        return np.concatenate([found[n].ravel() for n in self.names])

    def named(self, weights: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for n in self.names:
            shape = self.chain.shapes[n]
            out[n] = weights[at : at + int(np.prod(shape))].reshape(shape)
            at += int(np.prod(shape))
        return out

    def predict(self, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
        p = self.named(weights)
        return np.concatenate([np.zeros(0), *(self.chain.forward(p, x[lo : lo + STRIP])[0][:, 0] for lo in range(0, len(x), STRIP))])

    def gradient(self, weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """(sum of squared errors, its gradient) over rows."""
        p, loss, total = self.named(weights), 0.0, np.zeros(self.size)
        for lo in range(0, len(x), STRIP):
            out, held = self.chain.forward(p, x[lo : lo + STRIP])
            error = out[:, 0] - y[lo : lo + STRIP]
            _, grads = self.chain.backward(p, held, 2 * error[:, None])
            loss += float((error**2).sum())
            total += np.concatenate([grads[n].ravel() for n in self.names])
        return loss, total


def rnn(features: int, hidden: int = 32) -> Network:
    return Network(Rnn(features, hidden), LastDay(), Linear(hidden, 1))


def lstm(features: int, hidden: int = 32) -> Network:
    return Network(Lstm(features, hidden), LastDay(), Linear(hidden, 1))


def gru(features: int, hidden: int = 32, layers: int = 2) -> Network:
    stack = [Gru(features if i == 0 else hidden, hidden) for i in range(layers)]
    return Network(*stack, LastDay(), LayerNorm(hidden), Linear(hidden, hidden // 2), Gelu(), Linear(hidden // 2, 1))


def wide_gru(features: int, hidden: int = 128, layers: int = 2, head: int = 64) -> Network:
    """Normalised and projected inputs, and a head of its own width."""
    stack = [Gru(hidden, hidden) for _ in range(layers)]
    return Network(LayerNorm(features), Linear(features, hidden), *stack, LastDay(), LayerNorm(hidden), Linear(hidden, head), Silu(), Linear(head, 1))


def tcn(features: int, hidden: int = 128, dilations: tuple[int, ...] = (1, 2, 4, 8)) -> Network:
    """Residual blocks of dilated causal convolutions, averaged over the days."""
    blocks = [Chain(CausalConv(hidden, 3, d), LayerNorm(hidden), Gelu(), residual=True) for d in dilations]
    return Network(Linear(features, hidden), *blocks, MeanDay(), LayerNorm(hidden), Linear(hidden, 1))
