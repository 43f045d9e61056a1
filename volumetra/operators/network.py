"""Networks as tables: a graph of layers and their weights, run over batches of packed volumes.

``layers`` has a row a layer (its operation, the layers it reads, its parameters), ``weights`` the values of each part of a layer in chunks. Both are tables, so a
network is stored, joined and updated like any other data. A graph runs as one ``mapInArrow``: each operation works on the whole block of volumes (rows, x, y, z,
channels), a convolution as one matrix product for each offset of its kernel over shifted views of the padded block. Every operation also
gives its own derivative, which ``training`` uses.

Operations: ``conv`` (odd kernel, outside counts as 0), ``pool`` (mean over boxes; what is left over at an end is dropped), ``norm`` (groups are contiguous slabs of the
flattened sample, scaled by slab and channel), ``mish``, ``square``, ``add``, ``flatten``, ``dense``, ``join`` (outputs side by side), ``dropout`` (only while training).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from volumetra.operators import batches, packed

#: Values in a row of the weights.
CHUNK = 1 << 16
#: Bytes of weights that may be sent to every executor: a network's size does not depend on the data, and this bounds it.
MOST_BYTES = 1 << 30
LAYERS = "position int, layer string, op string, inputs array<string>, params map<string,double>"
WEIGHTS = "layer string, part string, dims array<int>, chunk int, `values` array<double>"

Parts = dict[str, np.ndarray]
Back = Callable[[np.ndarray], tuple[list[np.ndarray], Parts]]


@dataclass(frozen=True)
class Layer:
    name: str
    op: str
    inputs: tuple[str, ...]
    params: dict[str, float] = field(default_factory=dict)


def _conv(p: dict, w: Parts, rng, x: np.ndarray) -> tuple[np.ndarray, Back]:
    kernel, (rows, *space, cin) = w["kernel"], x.shape
    k, cout = len(kernel), kernel.shape[-1]
    low = k // 2
    inner = (slice(None), *[slice(0, n) for n in space])
    padded = np.pad(x, ((0, 0), *[(low, k - 1 - low)] * 3, (0, 0)))
    wide, flat = padded.shape[:4], padded.reshape(-1, cin)
    # a voxel's neighbour is a fixed number of rows on, so each offset is one product over contiguous rows
    offsets = [(i, j, l, (i * wide[2] + j) * wide[3] + l) for i, j, l in np.ndindex(k, k, k)]
    n = len(flat) - offsets[-1][3]
    total = np.zeros((len(flat), cout), x.dtype)
    for i, j, l, at in offsets:
        total[:n] += flat[at : at + n] @ kernel[i, j, l]
    y = total.reshape(*wide, cout)[inner] + w["bias"]

    def back(dy: np.ndarray):
        d = np.zeros((*wide, cout), x.dtype)
        d[inner] = dy
        d = d.reshape(-1, cout)[:n]
        dx, dk = np.zeros_like(flat), np.empty_like(kernel)
        for i, j, l, at in offsets:
            dk[i, j, l] = flat[at : at + n].T @ d
            dx[at : at + n] += d @ kernel[i, j, l].T
        dx = dx.reshape(padded.shape)[(slice(None), *[slice(low, low + m) for m in space])]
        return [dx], {"kernel": dk, "bias": dy.reshape(-1, cout).sum(axis=0)}

    return y, back


def _pool(p: dict, w: Parts, rng, x: np.ndarray) -> tuple[np.ndarray, Back]:
    by, (rows, *space, c) = int(p["by"]), x.shape
    small = [n // by for n in space]
    whole = (slice(None), *[slice(0, n * by) for n in small])
    y = x[whole].reshape(rows, small[0], by, small[1], by, small[2], by, c).mean(axis=(2, 4, 6))

    def back(dy: np.ndarray):
        dx = np.zeros_like(x)
        dx[whole] = dy.repeat(by, 1).repeat(by, 2).repeat(by, 3) / by**3
        return [dx], {}

    return y, back


def _norm(p: dict, w: Parts, rng, x: np.ndarray) -> tuple[np.ndarray, Back]:
    groups, c = int(p["groups"]), x.shape[-1]
    slabs = lambda a: a.reshape(len(a), groups, -1)
    scaled = lambda v: v.reshape(1, groups, 1, -1)
    flat = slabs(x)
    centred = flat - flat.mean(axis=2, keepdims=True)
    inverse = 1 / np.sqrt((centred * centred).mean(axis=2, keepdims=True) + x.dtype.type(p.get("eps", 1e-5)))
    unit = centred * inverse
    per = (len(x), groups, -1, len(w["gamma"]) // groups)
    y = (unit.reshape(per) * scaled(w["gamma"]) + scaled(w["beta"])).reshape(x.shape)

    def back(dy: np.ndarray):
        d = dy.reshape(per)
        parts = {"gamma": (d * unit.reshape(per)).sum(axis=(0, 2)).ravel(), "beta": d.sum(axis=(0, 2)).ravel()}
        g = slabs((d * scaled(w["gamma"])).reshape(x.shape))
        dx = (g - g.mean(axis=2, keepdims=True) - unit * (g * unit).mean(axis=2, keepdims=True)) * inverse
        return [dx.reshape(x.shape)], parts

    return y, back


def _mish(p: dict, w: Parts, rng, x: np.ndarray) -> tuple[np.ndarray, Back]:
    e = np.exp(np.minimum(x, 20))
    n = e * (e + 2)
    bend = n / (n + 2)  # tanh(log(1 + e))
    return x * bend, lambda dy: ([dy * (bend + x * (1 - bend * bend) * e / (1 + e))], {})


def _square(p: dict, w: Parts, rng, x: np.ndarray) -> tuple[np.ndarray, Back]:
    return x * x, lambda dy: ([2 * dy * x], {})


def _add(p: dict, w: Parts, rng, *xs: np.ndarray) -> tuple[np.ndarray, Back]:
    return sum(xs[1:], xs[0]), lambda dy: ([dy] * len(xs), {})


def _flatten(p: dict, w: Parts, rng, x: np.ndarray) -> tuple[np.ndarray, Back]:
    return x.reshape(len(x), -1), lambda dy: ([dy.reshape(x.shape)], {})


def _dense(p: dict, w: Parts, rng, x: np.ndarray) -> tuple[np.ndarray, Back]:
    return x @ w["kernel"] + w["bias"], lambda dy: ([dy @ w["kernel"].T], {"kernel": x.T @ dy, "bias": dy.sum(axis=0)})


def _join(p: dict, w: Parts, rng, *xs: np.ndarray) -> tuple[np.ndarray, Back]:
    at = np.cumsum([x.shape[-1] for x in xs])[:-1]
    return np.concatenate(xs, axis=-1), lambda dy: (np.split(dy, at, axis=-1), {})


def _dropout(p: dict, w: Parts, rng, x: np.ndarray) -> tuple[np.ndarray, Back]:
    if rng is None or not p["rate"]:
        return x, lambda dy: ([dy], {})
    keep = np.stack([r.random(x.shape[1:]) >= p["rate"] for r in rng]).astype(x.dtype) / x.dtype.type(1 - p["rate"])
    return x * keep, lambda dy: ([dy * keep], {})


OPS = {"conv": _conv, "pool": _pool, "norm": _norm, "mish": _mish, "square": _square, "add": _add, "flatten": _flatten, "dense": _dense, "join": _join, "dropout": _dropout}


def _fresh(layer: Layer, x: np.ndarray, rng: np.random.Generator) -> Parts:
    """Weights of a layer that gets ``x``: uniform within the bound that keeps the variance of what goes through (Glorot), biases 0, scales 1."""
    p, c = layer.params, x.shape[-1]
    if layer.op == "norm":
        return {"gamma": np.ones(c), "beta": np.zeros(c)}
    if layer.op not in ("conv", "dense"):
        return {}
    field_, out = ((int(p["kernel"]),) * 3, int(p["filters"])) if layer.op == "conv" else ((), int(p["units"]))
    size = int(np.prod(field_, dtype=int))
    bound = np.sqrt(6 / (size * (c + out)))
    return {"kernel": rng.uniform(-bound, bound, (*field_, c, out)), "bias": np.zeros(out)}


class Network:
    """A graph with its weights. ``shape``: of the volumes, which have one channel. The last layer is the output, flattened."""

    def __init__(self, layers: Sequence[Layer], weights: dict[str, Parts], shape: packed.Shape, kind: type = np.float32):
        self.layers, self.shape, self.kind = list(layers), tuple(shape), kind
        self.weights = {name: {k: np.asarray(v, kind) for k, v in parts.items()} for name, parts in weights.items()}
        self.outputs = int(self.predict(np.zeros((1, packed.size(self.shape)))).shape[1])

    @classmethod
    def fresh(cls, layers: Sequence[Layer], shape: packed.Shape, seed: int = 0, kind: type = np.float32) -> Network:
        """With drawn weights: each layer's depend on the seed and its position alone."""
        values, weights = {"input": np.zeros((1, *shape, 1), kind)}, {}
        for i, layer in enumerate(layers):
            xs = [values[k] for k in layer.inputs]
            weights[layer.name] = {k: v.astype(kind) for k, v in _fresh(layer, xs[0], np.random.default_rng([seed, i])).items()}
            values[layer.name] = OPS[layer.op](layer.params, weights[layer.name], None, *xs)[0]
        return cls(layers, weights, shape, kind)

    def forward(self, voxels: np.ndarray, rng=None) -> tuple[np.ndarray, list]:
        values, backs = {"input": np.nan_to_num(voxels).astype(self.kind).reshape(len(voxels), *self.shape, 1)}, []
        for layer in self.layers:
            values[layer.name], back = OPS[layer.op](layer.params, self.weights.get(layer.name, {}), rng, *[values[k] for k in layer.inputs])
            backs.append(back)
        out = values[self.layers[-1].name]
        return out, backs

    def backward(self, d: np.ndarray, backs: list) -> dict[str, Parts]:
        """The derivative of every weight, given that of the output."""
        due, parts = {self.layers[-1].name: d.astype(self.kind)}, {}
        for layer, back in zip(reversed(self.layers), reversed(backs)):
            if layer.name not in due:  # nothing reads it
                continue
            dxs, own = back(due.pop(layer.name))
            parts[layer.name] = own
            for name, dx in zip(layer.inputs, dxs):
                due[name] = due[name] + dx if name in due else dx
        return parts

    def predict(self, voxels: np.ndarray) -> np.ndarray:
        out, _ = self.forward(voxels)
        return out.reshape(len(out), -1).astype(float)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(layers, weights)."""
        rows = [(i, x.name, x.op, list(x.inputs), {k: float(v) for k, v in x.params.items()}) for i, x in enumerate(self.layers)]
        return spark.createDataFrame(rows, LAYERS), spark.createDataFrame(_arrow(chunked(self.weights)), WEIGHTS)

    @classmethod
    def from_tables(cls, layers: DataFrame, weights: DataFrame, shape: packed.Shape, kind: type = np.float32) -> Network:
        rows = sorted(layers.collect(), key=lambda r: r["position"])  # a row a layer
        return cls([Layer(r["layer"], r["op"], tuple(r["inputs"]), dict(r["params"])) for r in rows], gathered(weights), shape, kind)

    def bytes(self) -> int:
        return sum(v.nbytes for parts in self.weights.values() for v in parts.values())


def chunked(weights: dict[str, Parts]):
    """(layer, part, dims, chunk, values) of every part, ``CHUNK`` values a row."""
    for layer, parts in weights.items():
        for part, v in parts.items():
            flat = np.asarray(v, float).ravel()
            for i in range(0, len(flat), CHUNK):
                yield layer, part, list(v.shape), i // CHUNK, flat[i : i + CHUNK]


def _arrow(rows) -> pa.Table:
    kinds = {"layer": pa.string(), "part": pa.string(), "dims": pa.list_(pa.int32()), "chunk": pa.int32(), "values": pa.list_(pa.float64())}
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.table({c: pa.array(v, k) for (c, k), v in zip(kinds.items(), columns)})


def gathered(weights: DataFrame) -> dict[str, Parts]:
    """The weights on the driver: a network's size, refused beyond ``MOST_BYTES``."""
    size = weights.selectExpr("sum(8 * size(`values`)) AS n").first()["n"] or 0
    if size > 2 * MOST_BYTES:
        raise ValueError(f"{size} bytes of weights are more than may be sent to every executor")
    out: dict[str, Parts] = {}
    dims, flat = {}, {}
    for r in weights.select("layer", "part", "dims", "chunk", "values").toPandas().sort_values("chunk").itertuples(index=False):
        flat.setdefault((r.layer, r.part), []).append(np.asarray(r.values))
        dims[r.layer, r.part] = list(r.dims)
    for (layer, part), chunks in flat.items():
        out.setdefault(layer, {})[part] = np.concatenate(chunks).reshape(dims[layer, part])
    return out


def run(volumes: DataFrame, network: Network, keys: Sequence[str] = ("tr",)) -> DataFrame:
    """(keys, voxels): what the network makes of each volume, flattened. Missing voxels count as 0."""
    if network.bytes() > MOST_BYTES:
        raise ValueError(f"{network.bytes()} bytes of weights are more than may be sent to every executor")
    sent = volumes.sparkSession.sparkContext.broadcast(network)
    wide = max([1, *[int(x.params.get("filters", 1)) for x in network.layers]])
    return batches.over(volumes, lambda x: sent.value.predict(x), keys, voxel_bytes=16 * wide)


def chain(*steps: tuple[str, dict], start: str = "input", prefix: str = "") -> list[Layer]:
    """Layers one after the other."""
    out, before = [], start
    for i, (op, params) in enumerate(steps):
        out.append(Layer(f"{prefix}{op}{i}", op, (before,), params))
        before = out[-1].name
    return out


def residual(start: str, name: str, filters: int, groups: int) -> list[Layer]:
    """norm, mish, convolution and mish, twice, added to a convolution of one voxel."""
    conv = lambda k: ("conv", {"kernel": k, "filters": filters})
    side = chain(conv(1), ("mish", {}), start=start, prefix=f"{name}.side.")
    main = chain(*[("norm", {"groups": groups}), ("mish", {}), conv(3), ("mish", {})] * 2, start=start, prefix=f"{name}.")
    return [*side, *main, Layer(name, "add", (main[-1].name, side[-1].name))]


def gaze_layers(filters: int = 32, kernel: int = 3, depth: int = 4, multiplier: int = 2, groups: int = 8, stacks: int = 10, dense: int = 2, units: int = 1024, dropout: float = 0.1) -> list[Layer]:
    """The decoder of gaze: a convolution, levels of residual blocks that each halve the volume, one stack of dense layers for the position of every sample and one for all confidences.

    The output is x and y of each sample in turn, then the samples' confidences.
    """
    rate = {"rate": dropout}
    out = chain(("conv", {"kernel": kernel, "filters": filters}), ("mish", {}), ("dropout", rate), prefix="first.")
    for level in range(depth):
        n = multiplier**level * filters
        for i in range(level):
            out += residual(out[-1].name, f"level{level}.block{i}", n, groups)
        if level < depth - 1:
            out += chain(("conv", {"kernel": 3, "filters": n}), ("mish", {}), ("pool", {"by": 2}), start=out[-1].name, prefix=f"level{level}.down.")
    out += chain(("norm", {"groups": groups}), ("mish", {}), ("flatten", {}), start=out[-1].name, prefix="last.")
    flat, ends = out[-1].name, []
    hidden = [("dense", {"units": units}), ("mish", {}), ("dropout", rate)]
    for s in range(stacks):
        out += chain(*hidden * dense, ("dense", {"units": 2}), start=flat, prefix=f"sample{s}.")
        ends.append(out[-1].name)
    out += chain(*hidden, ("dense", {"units": stacks}), ("mish", {}), start=flat, prefix="confidence.")
    return [*out, Layer("output", "join", (*ends, out[-1].name))]
