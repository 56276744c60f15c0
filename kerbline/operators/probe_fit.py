"""Linear probes fitted across tasks: full-batch Adam whose gradients are sums over blocks of rows.

Rows are packed once into blocks of bounded size, without a shuffle, and written.
An epoch is one pass over the blocks for all fits at once: the weights of all fits of an
aid meet its rows in one matrix product, with their scales taken into the weights, and the
slopes in another; the driver adds up one vector a fit and task, and moves the weights.  The driver holds weights and per-dimension
moments, whose size is that of the settings and not of the table.  A fold is a mask over the
blocks, so a table is never multiplied by its folds or settings.

A table of at most ``LOCAL_NUMBERS`` numbers takes all its epochs in one task, by the
same functions; tests hold both ways against fits of whole arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kerbline.plans.scratch import Scratch

#: Numbers (rows x dimensions) of one block, and of a table that one task may fit.
BLOCK_NUMBERS, LOCAL_NUMBERS = 1 << 18, 1 << 21
#: Temperatures compared in one pass; a pass leaves two steps of the last one's range.
GRID = 64

BLOCKS = "n long, aid binary, fold binary, item_id array<long>, label array<int>, x binary, y binary, counts binary, weight binary"


@dataclass
class Fit:
    """One fit: what it is called, which rows it takes, and where it stands."""

    key: dict
    aids: list[int]
    held: int = -1
    loss: str = "soft_kl"
    head: str = "independent"
    rank: int = 0
    seed: int = 42
    weight_decay: float = 1e-4
    calibrate: bool = False
    n: float = 0.0
    unit: float = 1.0
    shift: np.ndarray = field(default_factory=lambda: np.zeros(0))
    divisor: np.ndarray = field(default_factory=lambda: np.ones(0))
    theta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    classes: int = 3
    temperature: float = 1.0
    value: float = float("nan")
    grid: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def low(self) -> bool:
        return self.rank > 0 or self.head != "independent"

    def shapes(self) -> dict[str, tuple[int, ...]]:
        a, c, d, r = len(self.aids), self.classes, len(self.divisor), self.rank or 8
        own = {"P": (a if self.head == "low_rank_per_aid" else 1, r, d), "W": (a, c, r)} if self.low else {"W": (a, c, d)}
        return own | {"b": (a, c)} | ({"conc": (1,)} if self.loss == "dirichlet" else {})

    def parts(self, theta: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            size = math.prod(shape)
            out[name], at = theta[at : at + size].reshape(shape), at + size
        return out

    def begin(self) -> None:
        """The first weights, drawn in the order P, W."""
        rng = np.random.default_rng(self.seed)
        first = {name: rng.uniform(-1, 1, shape) / math.sqrt(shape[-1]) for name, shape in self.shapes().items() if name in "PW"}
        first |= {"b": np.zeros(self.shapes()["b"])} | ({"conc": np.array([math.log(200.0)])} if self.loss == "dirichlet" else {})
        self.theta = np.concatenate([first[name].reshape(-1) for name in self.shapes()])

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Effective W (aids, classes, dimensions) and b."""
        p = self.parts(self.theta)
        return (p["W"] @ p["P"] if self.low else p["W"]), p["b"]

    def own_gradient(self, total: np.ndarray) -> np.ndarray:
        """The gradient on theta, and the loss, from that on the effective W and b (and conc): the chain rule of a coupled head."""
        if not self.low:
            return total
        par, (a, c), d = self.parts(self.theta), self.shapes()["b"], len(self.divisor)
        effective = total[: a * c * d].reshape(a, c, d)
        p = par["W"].transpose(0, 2, 1) @ effective
        p = p if len(par["P"]) > 1 else p.sum(0, keepdims=True)
        return np.concatenate([p.reshape(-1), (effective @ par["P"].transpose(0, 2, 1)).reshape(-1), total[a * c * d :]])


def calibration_rows(item_id: np.ndarray, seed: int, share: float = 0.2) -> np.ndarray:
    """The rows that a fit leaves out to tune its temperature: a share by a hash of item and seed."""
    h = (item_id.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(32)).astype(float) < share * 2**32


@dataclass
class Block:
    aid: np.ndarray
    fold: np.ndarray
    item_id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    y: np.ndarray
    counts: np.ndarray
    weight: np.ndarray

    def of(self, fit: Fit, part: str) -> np.ndarray:
        """Rows of a fit: ``train``, ``calibration`` or ``test``."""
        own = np.isin(self.aid, fit.aids)
        if part == "test":
            return np.flatnonzero(own & (self.fold == fit.held))
        own &= self.fold != fit.held
        if fit.calibrate:
            held = calibration_rows(self.item_id, fit.seed)
            own &= held if part == "calibration" else ~held
        return np.flatnonzero(own)

    def scaled(self, fit: Fit, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x of the rows under the fit's scale, and the place of each row's aid among the fit's."""
        return (self.x[rows] - fit.shift) / fit.divisor, np.searchsorted(fit.aids, self.aid[rows])


def pack(rows: DataFrame, aids: list[str], scratch: Scratch) -> DataFrame:
    """Blocks of ``rows`` (item_id, aid, vec, y, counts, label, sample_weight, fold), in the order in which tasks read them."""
    place, numbers = {a: i for i, a in enumerate(aids)}, BLOCK_NUMBERS
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                width = len(batch.column("vec")[at])
                part = batch.slice(at, max(1, numbers // max(1, width)))
                at += part.num_rows
                plain = lambda c, kind: np.asarray(part.column(c).to_pylist(), kind)  # noqa: B023, E731
                wide = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()  # noqa: B023, E731
                aid = np.array([place[a] for a in part.column("aid").to_pylist()], "<i4").tobytes()
                values = [part.num_rows, aid, plain("fold", "<i4").tobytes(), part.column("item_id"), part.column("label"), wide("vec"), wide("y"), wide("counts"), plain("sample_weight", "<f8").tobytes()]
                columns = [pa.ListArray.from_arrays([0, len(v)], v) if isinstance(v, pa.Array) else pa.array([v]) for v in values]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    wanted = rows.select(F.col("item_id").cast("long"), "aid", "vec", "y", "counts", F.col("label").cast("int").alias("label"), F.col("sample_weight").cast("double").alias("sample_weight"), F.col("fold").cast("int").alias("fold"))
    return scratch.write(wanted.mapInArrow(run, BLOCKS), "blocks")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
            n = get("n")
            number = lambda c: np.frombuffer(get(c), "<f8")  # noqa: B023, E731
            label = batch.column("label")[row].values.to_numpy(zero_copy_only=False)
            yield Block(np.frombuffer(get("aid"), "<i4"), np.frombuffer(get("fold"), "<i4"), batch.column("item_id")[row].values.to_numpy(zero_copy_only=False), np.nan_to_num(label.astype(float), nan=-1).astype(int), number("x").reshape(n, -1), number("y").reshape(n, -1), number("counts").reshape(n, -1), number("weight"))


# ---- what a block gives ----------------------------------------------------------------------------------------------


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _row_terms(loss: str, y: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(target, its sum, weight, constant of the value) of the rows; the slope on logits is weight * (p * sum - target) over the fit's rows."""
    one = np.ones(len(y))
    if loss == "soft_kl":
        return y, y.sum(1), weight, np.where(y > 0, y * np.log(np.maximum(y, 1e-300)), 0).sum(1)
    if loss == "hard_ce":
        return np.eye(y.shape[1])[y.argmax(1)], one, weight, 0 * one
    return counts, counts.sum(1), one, 0 * one


def _slopes(z: np.ndarray, loss: str, terms: tuple, masks: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Turn logits (fits, classes, rows) into their slopes, in place; the value of each fit's loss is returned."""
    target, total, weight, constant = terms
    z -= z.max(axis=1, keepdims=True)
    told = sum(target[:, c] * z[:, c] for c in range(z.shape[1]))
    np.exp(z, out=z)
    norm = z.sum(axis=1)
    share = masks * weight * scale[:, None]
    z *= (total / norm)[:, None]
    z -= target.T
    z *= share[:, None]
    return ((constant - told + total * np.log(norm)) * share).sum(1)


def gradients(fits: list[Fit], block: Block, loss_and_grad: Callable) -> dict[int, np.ndarray]:
    """What a block adds to each fit's gradient on its effective W, on b and conc; the loss itself is the last number.

    Fits of a loss go side by side, but those of ``dirichlet`` by ``loss_and_grad``.  Fits without a training row in the block are missing.
    """
    out: dict[int, np.ndarray] = {}
    weights = [f.weights() for f in fits]
    left_out = {seed: calibration_rows(block.item_id, seed) for seed in {f.seed for f in fits if f.calibrate}}
    for a in np.unique(block.aid):
        own, takes = np.flatnonzero(block.aid == a), sorted((i for i, f in enumerate(fits) if a in f.aids), key=lambda i: fits[i].loss)
        if not takes:
            continue
        fold, y, counts, weight = block.fold[own], block.y[own], block.counts[own], block.weight[own]
        centre, c = fits[takes[0]].shift, fits[takes[0]].classes  # shifts of different folds are nearly one, so what is left of them is small
        x, places = block.x[own] - centre, [fits[i].aids.index(a) for i in takes]
        ws = [weights[i][0][at] / fits[i].divisor for i, at in zip(takes, places, strict=True)]
        bs = [weights[i][1][at] - w @ (fits[i].shift - centre) for i, at, w in zip(takes, places, ws, strict=True)]
        z = (np.concatenate(ws) @ x.T + np.concatenate(bs)[:, None]).reshape(len(takes), c, len(own))
        masks = np.stack([(fold != f.held) & ~left_out[f.seed][own] if f.calibrate else fold != f.held for f in (fits[i] for i in takes)])
        extra = np.zeros((len(takes), 2))  # slope on conc, value
        for loss in sorted({fits[i].loss for i in takes}):
            some = [k for k, i in enumerate(takes) if fits[i].loss == loss]
            if loss != "dirichlet":
                scale = np.array([1 / fits[takes[k]].n / (fits[takes[k]].unit if loss == "multinomial" else 1.0) for k in some])
                group = slice(some[0], some[-1] + 1)
                extra[group, 1] = _slopes(z[group], loss, _row_terms(loss, y, counts, weight), masks[group], scale)
                continue
            for k in some:
                f, rows = fits[takes[k]], np.flatnonzero(masks[k])
                value, dz, dconc = loss_and_grad(loss, z[k].T[rows], y[rows], counts[rows], weight[rows], float(f.parts(f.theta)["conc"][0]), f.n, f.unit)
                z[k] = 0
                z[k].T[rows] = dz
                extra[k] = dconc, value
        slopes, sums = (z.reshape(-1, len(own)) @ x).reshape(len(takes), c, -1), z.sum(2)
        for k, (i, at) in enumerate(zip(takes, places, strict=True)):
            if not masks[k].any():
                continue
            f, d = fits[i], x.shape[1]
            if i not in out:
                out[i] = np.zeros(len(f.aids) * c * (d + 1) + (f.loss == "dirichlet") + 1)
            out[i][at * c * d : (at + 1) * c * d] += ((slopes[k] - np.outer(sums[k], f.shift - centre)) / f.divisor).reshape(-1)
            bias = len(f.aids) * c * d + at * c
            out[i][bias : bias + c] += sums[k]
            out[i][-1] += extra[k, 1]
            if f.loss == "dirichlet":
                out[i][-2] += extra[k, 0]
    return out


class Adam:
    """Steps of one fit, with L2 in the gradient."""

    def __init__(self, fit: Fit, lr: float):
        self.fit, self.lr, self.step = fit, lr, 0
        self.m = self.v = np.zeros(len(fit.theta))

    def move(self, total: np.ndarray) -> None:
        fit = self.fit
        self.step += 1
        fit.value = float(total[-1])
        g = total[:-1] + fit.weight_decay * fit.theta
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g**2
        fit.theta = fit.theta - self.lr * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.999**self.step)) + 1e-8)


def _sums(blocks: DataFrame, of: Callable[[Block], dict[tuple[int, int], np.ndarray]]) -> dict[tuple[int, int], np.ndarray]:
    """By key the sum of what ``of`` gives over all blocks; a task sends one row for each key it met, which are added up in the order of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for block in unpacked(batches):
            for key, own in of(block).items():
                total[key] = total[key] + own if key in total else own
        keys = [pa.array([k[i] for k in total], pa.int32()) for i in (0, 1)]
        ends = np.cumsum([0, *(len(t) for t in total.values())])
        yield pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), np.concatenate([*total.values(), np.zeros(0)]))], names=["one", "two", "part"])

    found: dict[tuple[int, int], np.ndarray] = {}
    for batch in blocks.mapInArrow(run, "one int, two int, part array<double>").toArrow().to_batches():  # weights times tasks
        part = batch.column("part")
        for row, key in enumerate(zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True)):
            own = part[row].values.to_numpy(zero_copy_only=False)
            found[key] = found[key] + own if key in found else own
    return found


def _summed(blocks: DataFrame, fits: list[Fit], of: Callable[[list[Fit], Block], dict[int, np.ndarray]]) -> list[np.ndarray]:
    """Per fit the sum over all blocks of what ``of`` gives by the fit's place; empty where no block gave anything."""
    found = _sums(blocks, lambda block: {(i, 0): own for i, own in of(fits, block).items()})
    return [found.get((i, 0), np.zeros(0)) for i in range(len(fits))]


def _each(of: Callable[[Fit, Block], np.ndarray]) -> Callable[[list[Fit], Block], dict[int, np.ndarray]]:
    """``of`` for one fit after the other."""
    return lambda fits, block: {i: own for i, f in enumerate(fits) if (own := of(f, block)).any()}


def _epochs(fits: list[Fit], epochs: int, lr: float, gather: Callable[[], list[np.ndarray]]) -> None:
    steps = [Adam(f, lr) for f in fits]
    for _ in range(epochs):
        for one, total in zip(steps, gather(), strict=True):
            one.move(one.fit.own_gradient(total) if len(total) else np.zeros(len(one.fit.theta) + 1))


def train(blocks: DataFrame, fits: list[Fit], numbers: int, loss_and_grad: Callable, epochs: int, lr: float) -> None:
    """Run all fits' epochs; each fit's weights are left in it."""
    of = lambda some, block: gradients(some, block, loss_and_grad)
    for f in fits:
        f.begin()
    if numbers > LOCAL_NUMBERS:
        _epochs(fits, epochs, lr, lambda: _summed(blocks, fits, of))
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(unpacked(batches))

        def gather() -> list[np.ndarray]:
            given = [of(fits, b) for b in held]
            return [sum((g[i] for g in given if i in g), np.zeros(1)) if any(i in g for g in given) else np.zeros(0) for i in range(len(fits))]

        _epochs(fits, epochs, lr, gather)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(fits)), pa.int32()), pa.array([[*f.theta, f.value] for f in fits], pa.list_(pa.float64()))], names=["fit", "theta"])

    for r in blocks.coalesce(1).mapInArrow(run, "fit int, theta array<double>").collect():
        fits[r["fit"]].theta, fits[r["fit"]].value = np.array(r["theta"][:-1]), r["theta"][-1]


# ---- scales, temperatures, scores ------------------------------------------------------------------------------------


@dataclass
class Moments:
    """Rows, vote totals, means and squared deviations by (place of aid, fold); merging two gives those of their union."""

    n: float
    total: float
    mean: np.ndarray
    m2: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(n, self.total + other.total, self.mean + gap * other.n / n, self.m2 + other.m2 + gap**2 * self.n * other.n / n)


def moments(blocks: DataFrame) -> dict[tuple[int, int], Moments]:
    """Moments of x by place of aid and fold, from two passes over the blocks: sums, and squared deviations from their means."""

    def cells(block: Block) -> dict[tuple[int, int], np.ndarray]:
        keys = np.unique(np.stack([block.aid, block.fold]), axis=1).T
        return {(int(a), int(f)): np.flatnonzero((block.aid == a) & (block.fold == f)) for a, f in keys}

    first = _sums(blocks, lambda b: {k: np.r_[float(len(r)), b.counts[r].sum(), b.x[r].sum(0)] for k, r in cells(b).items()})
    mean = {k: v[2:] / v[0] for k, v in first.items()}
    second = _sums(blocks, lambda b: {k: ((b.x[r] - mean[k]) ** 2).sum(0) for k, r in cells(b).items()}) if first else {}
    return {k: Moments(v[0], v[1], mean[k], second[k]) for k, v in first.items()}


def prepare(fit: Fit, known: dict[tuple[int, int], Moments], centre: bool = False) -> bool:
    """Set a fit's scale and row count from the moments of what it trains on; False where there is nothing to train on or to score."""
    own = [m for (a, f), m in known.items() if a in fit.aids and f != fit.held]
    if not own or (fit.held >= 0 and not any(a in fit.aids and f == fit.held for a, f in known)):
        return False
    all_rows = own[0]
    for m in own[1:]:
        all_rows = all_rows + m
    std = np.sqrt(all_rows.m2 / all_rows.n)
    fit.shift = all_rows.mean if centre else np.zeros(len(std))
    fit.divisor = np.where(std < 1e-12, 1.0, std)
    fit.n, fit.unit = all_rows.n, all_rows.total / all_rows.n
    return True


def count_training(blocks: DataFrame, fits: list[Fit]) -> None:
    """Rows and mean votes of fits that leave calibration rows out."""
    some = [f for f in fits if f.calibrate]
    totals = _summed(blocks, some, _each(lambda f, b: np.array([float(len(r := b.of(f, "train"))), b.counts[r].sum(), float(len(b.of(f, "calibration")))]))) if some else []
    for f, t in zip(some, totals, strict=True):
        if len(t):
            f.n, f.unit = max(t[0], 1.0), t[1] / max(t[0], 1.0)


def logits(fit: Fit, block: Block, rows: np.ndarray) -> np.ndarray:
    w, b = fit.weights()
    x, aid = block.scaled(fit, rows)
    out = np.zeros((len(rows), fit.classes))
    for a in np.unique(aid):
        own = aid == a
        out[own] = x[own] @ w[a].T + b[a]
    return out


def tune(blocks: DataFrame, fits: list[Fit], low: float = 0.05, high: float = 20.0, tolerance: float = 1e-4) -> None:
    """Each fit's temperature of least negative log-likelihood on its calibration rows, by passes over a grid that narrows."""
    some = [f for f in fits if f.calibrate]
    ranges = [(low, high) for _ in some]
    while some and max(b - a for a, b in ranges) > tolerance:
        grids = [np.linspace(a, b, GRID) for a, b in ranges]
        for f, grid in zip(some, grids, strict=True):
            f.grid = grid

        def nll(fit: Fit, block: Block) -> np.ndarray:
            rows = block.of(fit, "calibration")
            if not len(rows):
                return np.zeros(GRID)
            z = logits(fit, block, rows)
            z -= z.max(axis=1, keepdims=True)
            norm = sum(np.exp(z[:, c] / fit.grid[:, None]) for c in range(z.shape[1]))  # temperatures x rows
            return np.log(norm).sum(1) - z[np.arange(len(rows)), block.label[rows]].sum() / fit.grid

        new = []
        for (a, b), grid, total in zip(ranges, grids, _summed(blocks, some, _each(nll)), strict=True):
            if not len(total):
                new.append((1.0, 1.0))  # nothing to tune on
                continue
            i = int(total.argmin())
            new.append((grid[max(i - 1, 0)], grid[min(i + 1, GRID - 1)]))
        ranges = new
    for f, (a, b) in zip(some, ranges, strict=True):
        f.temperature = (a + b) / 2


def scored(blocks: DataFrame, fits: list[Fit], aids: list[str], keys: dict[str, str]) -> DataFrame:
    """Held-out rows of every fit: the columns of its key, held, aid, item_id, label, y, probs, temperature."""
    schema = ", ".join(f"{k} {kind}" for k, kind in keys.items()) + ", held int, aid string, item_id long, label int, y array<double>, probs array<double>, temperature double"

    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), m.reshape(-1))
        for block in unpacked(batches):
            for fit in fits:
                rows = block.of(fit, "test")
                if len(rows):
                    p = np.exp(log_softmax(logits(fit, block, rows) / fit.temperature))
                    fixed = fit.key | {"held": fit.held, "temperature": fit.temperature}
                    own = {"aid": pa.array(aids).take(pa.array(block.aid[rows])), "item_id": pa.array(block.item_id[rows]), "label": pa.array(block.label[rows]), "y": lists(block.y[rows]), "probs": lists(p)}
                    columns = [own[k.name].cast(k.type) if k.name in own else pa.repeat(pa.scalar(fixed[k.name], k.type), len(rows)) for k in kinds]
                    yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return blocks.mapInArrow(run, schema)
