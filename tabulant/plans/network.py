"""Layers in NumPy, used inside tasks on one mini-batch or one Arrow batch.

A network is a list of layers; its parameters are views of one flat vector so that a
state can be shipped, averaged and updated as a whole.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# fixed values: defaults of the layers and the optimizer
NORM_EPS = 1e-5
NORM_MOMENTUM = 0.1
ADAM_BETAS = (0.9, 0.999)
ADAM_EPS = 1e-8


def rows_of(column, dtype=np.float64) -> np.ndarray:
    """A column of equally long lists as a matrix; null or ragged rows and null cells are refused."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if column.null_count or flat.null_count or lengths["min"] != lengths["max"]:
        raise ValueError("arrays must all have one length and hold no nulls")
    flat = flat.to_numpy(zero_copy_only=False)
    width = lengths["max"] or 0
    return flat.reshape(len(column), width).astype(dtype, copy=False)


def lists_of(matrix: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    n, width = matrix.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


@dataclass(frozen=True)
class Layer:
    kind: str  # linear, norm, relu, dropout
    name: str = ""
    fan_in: int = 0
    width: int = 0
    rate: float = 0.0

    def shapes(self) -> dict:
        if self.kind == "linear":
            return {f"{self.name}.weight": (self.width, self.fan_in), f"{self.name}.bias": (self.width,)}
        if self.kind == "norm":
            return {f"{self.name}.weight": (self.width,), f"{self.name}.bias": (self.width,)}
        return {}

    def buffers(self) -> dict:
        if self.kind == "norm":
            return {f"{self.name}.mean": (self.width,), f"{self.name}.var": (self.width,)}
        return {}


def dense_stack(name: str, in_dim: int, hidden: int, depth: int, dropout: float) -> list[Layer]:
    """depth - 1 blocks of linear, norm, relu, dropout and a closing linear layer."""
    layers = []
    for i in range(depth - 1):
        layers += [
            Layer("linear", f"{name}.{i}.linear", in_dim, hidden),
            Layer("norm", f"{name}.{i}.norm", hidden, hidden),
            Layer("relu"),
            Layer("dropout", rate=dropout),
        ]
        in_dim = hidden
    return [*layers, Layer("linear", f"{name}.{depth - 1}.linear", in_dim, hidden)]


def classifier_stack(in_dim: int, hidden: int, classes: int, dropout: float) -> list[Layer]:
    body = dense_stack("head", in_dim, hidden, 2, dropout)
    return [*body[:-1], Layer("linear", "head.1.linear", hidden, classes)]


def named_views(flat: np.ndarray, shapes: dict) -> dict:
    views, at = {}, 0
    for name, shape in shapes.items():
        size = int(np.prod(shape))
        views[name] = flat[at : at + size].reshape(shape)
        at += size
    return views


def count(shapes: dict) -> int:
    return sum(int(np.prod(s)) for s in shapes.values())


class Net:
    def __init__(self, layers):
        self.layers = list(layers)
        self.shapes, self.buffers = {}, {}
        for layer in self.layers:
            self.shapes.update(layer.shapes())
            self.buffers.update(layer.buffers())
        self.held = {}

    def room(self, at, shape, dtype) -> np.ndarray:
        """An array of a training step, used again by the next step of the same shape."""
        found = self.held.get((at, dtype))
        if found is None or found.shape != shape:
            found = self.held[at, dtype] = np.empty(shape, dtype)
        return found

    def initial(self, rng) -> dict:
        """Uniform(+-1/sqrt(fan_in)) linear layers, unit norms, zero Adam moments."""
        theta = np.zeros(count(self.shapes), np.float32)
        stats = np.zeros(count(self.buffers), np.float32)
        params, running = named_views(theta, self.shapes), named_views(stats, self.buffers)
        for layer in self.layers:
            if layer.kind == "linear":
                bound = 1.0 / np.sqrt(layer.fan_in)
                for part in ("weight", "bias"):
                    view = params[f"{layer.name}.{part}"]
                    view[...] = rng.uniform(-bound, bound, view.shape)
            elif layer.kind == "norm":
                params[f"{layer.name}.weight"][...] = 1.0
                running[f"{layer.name}.var"][...] = 1.0
        zeros = np.zeros_like(theta)
        return {"theta": theta, "stats": stats, "m": zeros, "v": zeros.copy(), "t": 0}

    def export(self, state: dict, prefix: str) -> dict:
        """Parameters and running statistics of the layers under ``prefix``."""
        named = {**named_views(state["theta"], self.shapes), **named_views(state["stats"], self.buffers)}
        return {k: v.copy() for k, v in named.items() if k.startswith(prefix)}

    def forward(self, params, stats, x, train=False, rng=None, views=1):
        """Output and what the backward pass needs; training updates ``stats`` in place.

        ``x`` may stack several views of equal size.  Batch statistics are taken per view
        and the running statistics are updated once per view, in order.  What a training pass returns
        is overwritten by the next one.
        """
        cache = []
        for at, layer in enumerate(self.layers):
            kept = None
            if layer.kind == "linear":
                kept = x
                out = self.room(at, (len(x), layer.width), x.dtype.type) if train else None
                x = np.matmul(x, params[f"{layer.name}.weight"].T, out=out)
                x += params[f"{layer.name}.bias"]
            elif layer.kind == "norm":
                mean, var = stats[f"{layer.name}.mean"], stats[f"{layer.name}.var"]
                grouped = x.reshape(views, -1, layer.width)
                if train:
                    n = grouped.shape[1]
                    batch_mean = grouped.mean(axis=1, keepdims=True)
                    unit = np.subtract(grouped, batch_mean, out=self.room(at, grouped.shape, x.dtype.type))
                    spare = grouped if at else None  # the caller's array stays as it is
                    batch_var = np.square(unit, out=spare).mean(axis=1, keepdims=True)
                    for m, v in zip(batch_mean[:, 0], batch_var[:, 0]):
                        mean += NORM_MOMENTUM * (m - mean)
                        var += NORM_MOMENTUM * (v * (n / (n - 1)) - var)
                    var = batch_var
                else:
                    unit, spare = grouped - mean, None
                scale = 1.0 / np.sqrt(var + x.dtype.type(NORM_EPS))
                unit *= scale
                kept = (unit, scale)
                x = np.multiply(unit, params[f"{layer.name}.weight"], out=spare).reshape(x.shape)
                x += params[f"{layer.name}.bias"]
            elif layer.kind == "relu":
                kept = np.greater(x, 0, out=self.room(at, x.shape, np.bool_) if train else None)
                x *= kept
            elif layer.kind == "dropout" and train and layer.rate > 0:
                drawn = rng.random(dtype=np.float32, out=self.room(at, x.shape, np.float32))
                kept = (drawn >= layer.rate) / x.dtype.type(1 - layer.rate)
                x *= kept
            cache.append(kept)
        return x, cache

    def backward(self, params, cache, dx, grads) -> None:
        """Write the gradients of one forward pass into ``grads``."""
        first = self.layers[0]
        for at, layer, kept in reversed(list(zip(range(len(cache)), self.layers, cache))):
            if layer.kind == "linear":
                np.matmul(dx.T, kept, out=grads[f"{layer.name}.weight"])
                np.sum(dx, axis=0, out=grads[f"{layer.name}.bias"])
                if layer is not first:
                    dx = np.matmul(dx, params[f"{layer.name}.weight"], out=self.room(("dx", at), kept.shape, dx.dtype.type))
            elif layer.kind == "norm":
                unit, scale = kept
                grouped = dx.reshape(unit.shape)
                by_unit = np.multiply(grouped, unit, out=self.room(("dx", at), unit.shape, dx.dtype.type))
                np.sum(by_unit, axis=(0, 1), out=grads[f"{layer.name}.weight"])
                np.sum(dx, axis=0, out=grads[f"{layer.name}.bias"])
                # mean over the view of dy and dy * unit, per column
                centre, slope = grouped.mean(axis=1, keepdims=True), by_unit.mean(axis=1, keepdims=True)
                np.multiply(unit, slope, out=by_unit)
                by_unit += centre
                np.subtract(grouped, by_unit, out=by_unit)
                by_unit *= scale * params[f"{layer.name}.weight"]
                dx = by_unit.reshape(dx.shape)
            elif kept is not None:
                dx = np.multiply(dx, kept, out=self.room(("dx", at), dx.shape, dx.dtype.type))


def unit_rows(u: np.ndarray):
    norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", u, u))[:, None], 1e-12)
    return u / norm, norm


def nt_xent(u: np.ndarray, temperature: float):
    """Similarities (own entry -inf), loss and positive similarity of each of 2B rows."""
    half = len(u) // 2
    z, _ = unit_rows(u)
    sims = z @ z.T
    sims /= u.dtype.type(temperature)
    np.fill_diagonal(sims, -np.inf)
    mine = np.arange(2 * half)
    positive = sims[mine, (mine + half) % (2 * half)]
    top = sims.max(axis=1)
    logsum = top + np.log(np.exp(sims - top[:, None]).sum(axis=1))
    return sims, logsum - positive, positive


def nt_xent_gradient(u: np.ndarray, temperature: float, rooms=(None, None)):
    """Mean loss over the 2B rows and its gradient in the unnormalised rows; ``rooms`` may give two (2B, 2B) arrays to work in."""
    n = len(u)
    z, norm = unit_rows(u)
    pull = np.matmul(z, z.T, out=rooms[0])
    pull /= u.dtype.type(temperature)
    np.fill_diagonal(pull, -np.inf)
    mine = np.arange(n)
    other = (mine + n // 2) % n
    positive = pull[mine, other]
    top = pull.max(axis=1)
    # similarities become softmax weights minus the one-hot positive, in place
    pull -= top[:, None]
    np.exp(pull, out=pull)
    total = pull.sum(axis=1)
    loss = top + np.log(total) - positive
    pull /= total[:, None]
    pull[mine, other] -= 1.0
    dz = np.add(pull, pull.T, out=rooms[1]) @ z
    dz /= u.dtype.type(temperature * n)
    dz -= z * np.einsum("ij,ij->i", z, dz)[:, None]
    dz /= norm
    return float(loss.mean()), dz


def corrupt_block(x: np.ndarray, rate: float, rng) -> np.ndarray:
    """One mini-batch with random cells taken from random rows of the same batch."""
    donors = rng.integers(0, len(x), x.shape)
    return np.where(rng.random(x.shape) < rate, np.take_along_axis(x, donors, axis=0), x)


def adam(state: dict, gradient: np.ndarray, rate: float) -> None:
    """One step; ``gradient`` is used as scratch space."""
    first, second = ADAM_BETAS
    state["t"] += 1
    m, v, scratch = state["m"], state["v"], state["scratch"]
    m *= first
    np.multiply(gradient, 1 - first, out=scratch)
    m += scratch
    v *= second
    np.multiply(gradient, gradient, out=gradient)
    gradient *= 1 - second
    v += gradient
    np.sqrt(v, out=scratch)
    scratch /= (1 - second ** state["t"]) ** 0.5
    scratch += ADAM_EPS
    np.divide(m, scratch, out=scratch)
    scratch *= rate / (1 - first ** state["t"])
    state["theta"] -= scratch


class Contrastive:
    """Rows against their corrupted views under NT-Xent."""

    def __init__(self, layers, rate: float, corruption: float, temperature: float):
        self.net = Net(layers)
        self.rate, self.corruption, self.temperature = rate, corruption, temperature

    def step(self, params, stats, grads, x, y, rng) -> float:
        both = np.concatenate([x, corrupt_block(x, self.corruption, rng)])
        u, cache = self.net.forward(params, stats, both, True, rng, views=2)
        loss, du = nt_xent_gradient(u, self.temperature, self.net.room("pairs", (2, len(u), len(u)), u.dtype.type))
        self.net.backward(params, cache, du, grads)
        return loss

    def evaluate(self, params, stats, x, rng) -> np.ndarray:
        both = np.concatenate([x, corrupt_block(x, self.corruption, rng)])
        return nt_xent(self.net.forward(params, stats, both)[0], self.temperature)[1]


class Supervised:
    """Softmax cross-entropy on class indices."""

    def __init__(self, layers, rate: float):
        self.net = Net(layers)
        self.rate = rate

    def step(self, params, stats, grads, x, y, rng) -> float:
        logits, cache = self.net.forward(params, stats, x, True, rng)
        p = softmax(logits)
        mine = np.arange(len(x))
        loss = -np.log(np.maximum(p[mine, y], np.finfo(p.dtype).tiny)).mean()
        p[mine, y] -= 1.0
        self.net.backward(params, cache, p / len(x), grads)
        return float(loss)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
