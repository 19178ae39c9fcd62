"""Multi-layer perceptrons: logistic or rectified hidden layers, a softmax output, weight decay, Adam or plain steps.

Few rows are sent to all tasks, and each task trains one network, so that the
settings and folds of a search train side by side. Many rows stay in slices: in
a pass over them each task takes steps on its own rows, for all networks of a
search, and the weights and the state of the steps are averaged over the tasks,
which is all that the driver holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F

from phrasemill.session import fits, written

#: Bytes of training rows that are sent to all tasks.
LOCAL_BYTES = 64 << 20
#: Slices of a bigger table, at most, and rows of a slice, at least.
SLICES = 200
SLICE_ROWS = 20_000
#: Steps are given up below this rate.
LEAST_RATE = 1e-6


@dataclass(frozen=True)
class Training:
    """How a network is trained. ``learning_rate`` ``adaptive`` (plain steps only): a fifth of it whenever the loss rests."""

    hidden: tuple[int, ...] = (100, 50)
    activation: str = "logistic"
    alpha: float = 1e-4
    solver: str = "adam"
    learning_rate: str = "constant"
    rate: float = 0.001
    batch: int = 200
    max_iter: int = 10_000
    tol: float = 1e-4
    patience: int = 10
    seed: int = 17

    def __post_init__(self):
        for value, known in ((self.activation, ("logistic", "relu")), (self.solver, ("adam", "sgd")), (self.learning_rate, ("constant", "adaptive"))):
            if value not in known:
                raise ValueError(f"{value} is none of {known}")


@dataclass
class Network:
    """Weights and offsets of each layer."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    activation: str

    @staticmethod
    def drawn(dim: int, classes: int, how: Training) -> Network:
        draw, sizes = np.random.default_rng(how.seed), [dim, *how.hidden, classes]
        reach = lambda a, b: math.sqrt((2.0 if how.activation == "logistic" else 6.0) / (a + b))
        return Network([(draw.uniform(-reach(a, b), reach(a, b), (a, b)), draw.uniform(-reach(a, b), reach(a, b), b))
                        for a, b in zip(sizes, sizes[1:], strict=False)], how.activation)

    def outputs(self, x: np.ndarray) -> list[np.ndarray]:
        """The input and what each layer makes of it; the last one are class probabilities."""
        found = [x]
        for i, (w, b) in enumerate(self.layers):
            z = found[-1] @ w + b
            if i == len(self.layers) - 1:
                z = np.exp(z - z.max(axis=1, keepdims=True))
                found.append(z / z.sum(axis=1, keepdims=True))
            else:
                found.append(np.maximum(z, 0) if self.activation == "relu" else 1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return found

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Cross-entropy summed over rows, and its gradient by weights and offsets of each layer in turn."""
        found = self.outputs(x)
        loss = -np.log(np.maximum(found[-1][np.arange(len(y)), y], 1e-300)).sum()
        delta = found[-1].copy()
        delta[np.arange(len(y)), y] -= 1
        out: list[np.ndarray] = []
        for i in reversed(range(len(self.layers))):
            out[:0] = [found[i].T @ delta, delta.sum(axis=0)]
            if i:
                slope = found[i] > 0 if self.activation == "relu" else found[i] * (1 - found[i])
                delta = (delta @ self.layers[i][0].T) * slope
        return float(loss), out

    def decayed(self, loss: float, gradient: list[np.ndarray], alpha: float, n: int) -> tuple[float, list[np.ndarray]]:
        """Means over ``n`` rows, with the decay of weights."""
        decay = sum(float((w * w).sum()) for w, _ in self.layers)
        return (loss + alpha * decay / 2) / n, [
            (g + alpha * self.layers[k // 2][0] if k % 2 == 0 else g) / n for k, g in enumerate(gradient)]


@dataclass
class Steps:
    """Changes the weights by gradients, and tells when the loss rests."""

    how: Training
    first: list[np.ndarray] = field(default_factory=list)
    second: list[np.ndarray] = field(default_factory=list)
    count: int = 0
    best: float = math.inf
    idle: int = 0

    def __post_init__(self):
        self.rate = self.how.rate

    def take(self, network: Network, gradient: list[np.ndarray]) -> None:
        if not self.first:
            self.first = [np.zeros_like(g) for g in gradient]
            self.second = [np.zeros_like(g) for g in gradient]
        self.count += 1
        for k, g in enumerate(gradient):
            if self.how.solver == "adam":
                self.first[k] += 0.1 * (g - self.first[k])
                self.second[k] += 0.001 * (g * g - self.second[k])
                rate = self.rate * math.sqrt(1 - 0.999 ** self.count) / (1 - 0.9 ** self.count)
                change = -rate * self.first[k] / (np.sqrt(self.second[k]) + 1e-8)
            else:  # looks ahead along its momentum
                self.first[k] = 0.9 * self.first[k] - self.rate * g
                change = 0.9 * self.first[k] - self.rate * g
            network.layers[k // 2][k % 2][...] += change

    def rests(self, loss: float) -> bool:
        """After a pass over all rows with a mean ``loss``: whether training is done."""
        self.idle = self.idle + 1 if loss > self.best - self.how.tol else 0
        self.best = min(self.best, loss)
        if self.idle <= self.how.patience:
            return False
        if self.how.solver == "sgd" and self.how.learning_rate == "adaptive" and self.rate > LEAST_RATE:
            self.rate, self.idle = self.rate / 5, 0
            return False
        return True


def trained(x: np.ndarray, y: np.ndarray, classes: int, how: Training) -> tuple[Network, bool]:
    """A network from rows at hand, and whether its loss came to rest."""
    network, steps, draw = Network.drawn(x.shape[1], classes, how), Steps(how), np.random.default_rng(how.seed + 1)
    for _ in range(how.max_iter):
        order, total = draw.permutation(len(y)), 0.0
        for at in range(0, len(y), how.batch):
            rows = order[at:at + how.batch]
            loss, gradient = network.decayed(*network.gradient(x[rows], y[rows]), how.alpha, len(rows))
            steps.take(network, gradient)
            total += loss * len(rows)
        if steps.rests(total / len(y)):
            return network, True
    return network, False


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(rows, -1)


def summed_gradient(rows: DataFrame, network: Network) -> tuple[float, list[np.ndarray], int]:
    """Loss and gradient summed over rows (label, vec), and how many there are."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(network)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _added((loss, n, np.concatenate([g.ravel() for g in gradient])) for batch in batches if (n := batch.num_rows)
                          for loss, gradient in [sent.value.gradient(_matrix(batch.column("vec"), n), batch.column("label").to_numpy())])

    def both(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _added((r["loss"], r["n"], np.frombuffer(r["g"])) for batch in batches for r in batch.to_pylist())

    schema = "loss double, n long, g binary"
    parts = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    # As many rows as the square root of the tasks, each of the size of the network.
    found = rows.select("label", "vec").mapInArrow(each, schema).repartition(parts).mapInArrow(both, schema).collect()
    sent.unpersist()
    flat = sum(np.frombuffer(r["g"]) for r in found)
    cuts = np.cumsum([v.size for layer in network.layers for v in layer])[:-1]
    shapes = [v.shape for layer in network.layers for v in layer]
    return (sum(r["loss"] for r in found), [g.reshape(s) for g, s in zip(np.split(flat, cuts), shapes, strict=True)], sum(r["n"] for r in found))


def _added(parts: Iterable[tuple[float, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    loss, n, total = 0.0, 0, None
    for a, b, g in parts:
        loss, n, total = loss + a, n + b, g.copy() if total is None else total + g
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["loss", "n", "g"])


def _state(network: Network, steps: Steps) -> np.ndarray:
    """Weights and what the steps remember, in a row."""
    flat = [v for layer in network.layers for v in layer]
    return np.concatenate([v.ravel() for kind in (flat, steps.first or map(np.zeros_like, flat), steps.second or map(np.zeros_like, flat)) for v in kind])


def _restored(network: Network, steps: Steps, state: np.ndarray) -> None:
    """The reverse of ``_state``."""
    flat = [v for layer in network.layers for v in layer]
    cuts = np.cumsum([v.size for v in flat * 3])[:-1]
    parts = [x.reshape(v.shape).copy() for x, v in zip(np.split(state, cuts), flat * 3, strict=True)]
    for v, x in zip(flat, parts, strict=False):
        v[...] = x
    steps.first, steps.second = parts[len(flat):2 * len(flat)], parts[2 * len(flat):]


def sliced(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows (label, vec, part) stored in slices that are alike, each in an order drawn by hashes, as blocks of a batch of rows.

    A block is one row (part, label, vec) of bytes, since lists of numbers take longer to read than to learn from.
    """
    slices = max(1, min(SLICES, rows.count() // slice_rows))
    key, kinds = F.xxhash64("label", "vec"), (("part", np.int32), ("label", np.int32), ("vec", np.float64))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = (_matrix(batch.column(c), batch.num_rows) if c == "vec" else batch.column(c).to_numpy() for c, _ in kinds)
                yield pa.RecordBatch.from_arrays([pa.array([v.astype(kind).tobytes()], pa.binary()) for v, (_, kind) in zip(found, kinds, strict=True)],
                                                 [c for c, _ in kinds])

    dealt = rows.select("part", "label", "vec").repartition(slices, F.xxhash64(key)).sortWithinPartitions(key, "label", "vec", "part")
    return written(dealt.mapInArrow(pack, "part binary, label binary, vec binary"), "slices")


def _unpacked(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts, labels and vectors of each block."""
    for batch in batches:
        for part, label, vec in zip(*(batch.column(c) for c in ("part", "label", "vec")), strict=True):
            yield (np.frombuffer(part.as_buffer(), np.int32), np.frombuffer(label.as_buffer(), np.int32),
                   np.frombuffer(vec.as_buffer(), np.float64).reshape(-1, dim))


def trained_together(table: DataFrame, dim: int, classes: int, jobs: list[tuple[Training, int | None]]) -> list[tuple[Network, bool]]:
    """As ``trained`` for a table (``sliced``) that no task holds, and for several networks side by side.

    A job is a way to train and the part that its network does not see. In a pass, every task takes the steps of its
    own rows, for all networks; then weights and steps of the tasks are averaged by their rows.
    """
    spark = table.sparkSession
    networks, steps = [Network.drawn(dim, classes, how) for how, _ in jobs], [Steps(how) for how, _ in jobs]
    states, settled = [_state(*x) for x in zip(networks, steps, strict=True)], [False] * len(jobs)
    schema, names = "job long, loss double, n long, count long, state binary", ["job", "loss", "n", "count", "state"]

    def told(held: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        for j, (loss, n, count, state) in sorted(held.items()):
            yield pa.RecordBatch.from_arrays([pa.array([j]), pa.array([loss]), pa.array([n]), pa.array([count]), pa.array([state.tobytes()], pa.binary())], names)

    def both(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                loss, n, count, state = held.get(r["job"], (0.0, 0, 0, 0.0))
                held[r["job"]] = loss + r["loss"], n + r["n"], max(count, r["count"]), state + np.frombuffer(r["state"])
        yield from told(held)

    todo = list(range(len(jobs)))
    for step in range(max((how.max_iter for how, _ in jobs), default=0)):
        moving = [j for j in todo if not settled[j] and step < jobs[j][0].max_iter]
        if not moving:
            break
        sent = spark.sparkContext.broadcast({j: (*jobs[j], steps[j].rate, steps[j].count, states[j]) for j in moving})

        def each(batches: Iterable[pa.RecordBatch], sent=sent, step=step) -> Iterator[pa.RecordBatch]:
            at_work: dict[int, tuple[Network, Steps, list]] = {}
            for no, (part, y, x) in enumerate(_unpacked(batches, dim)):
                for j, (how, apart, rate, count, state) in sent.value.items():
                    if j not in at_work:
                        at_work[j] = Network.drawn(dim, classes, how), Steps(how, count=count), [0.0, 0]
                        _restored(*at_work[j][:2], state)
                        at_work[j][1].rate = rate
                    network, own, sums = at_work[j]
                    order = np.random.default_rng([how.seed + 1, step, no]).permutation(len(y) if apart is None else np.flatnonzero(part != apart))
                    for at in range(0, len(order), how.batch):
                        rows = order[at:at + how.batch]
                        loss, gradient = network.decayed(*network.gradient(x[rows], y[rows]), how.alpha, len(rows))
                        own.take(network, gradient)
                        sums[0], sums[1] = sums[0] + loss * len(rows), sums[1] + len(rows)
            yield from told({j: (loss, n, own.count, n * _state(network, own)) for j, (network, own, (loss, n)) in at_work.items() if n})

        # As many rows as networks, each three times of the size of its network.
        found = table.mapInArrow(each, schema).repartition(len(moving), "job").mapInArrow(both, schema).collect()
        sent.unpersist()
        todo = [r["job"] for r in found]  # not those that see no row
        for r in found:
            j = r["job"]
            states[j], steps[j].count = np.frombuffer(r["state"]) / r["n"], r["count"]
            settled[j] = steps[j].rests(r["loss"] / r["n"])
    for network, own, state in zip(networks, steps, states, strict=True):
        _restored(network, own, state)
    return list(zip(networks, settled, strict=True))


def trained_wide(rows: DataFrame, dim: int, classes: int, how: Training, slice_rows: int = SLICE_ROWS) -> tuple[Network, bool]:
    """As ``trained`` for a table that no task holds."""
    return trained_together(sliced(rows.withColumn("part", F.lit(-1)), slice_rows), dim, classes, [(how, None)])[0]


def _held(rows: DataFrame, part: str | None = None) -> pa.Table:
    """Rows in a fixed order, for tables of checked size."""
    where = F.lit(-1) if part is None else F.col(part)
    return rows.select(where.cast("int").alias("part"), F.col("label").cast("int").alias("label"), F.col("vec").cast("array<double>").alias("vec")).orderBy(
        "part", "label", F.xxhash64("vec"), "vec").toArrow()


def is_small(rows: DataFrame, dim: int, local_bytes: int = LOCAL_BYTES) -> bool:
    return fits(rows, 8 * dim + 16, local_bytes)


def fold_hits(rows: DataFrame, classes: int, settings: list[Training], fold: str, folds: int, local_bytes: int = LOCAL_BYTES,
              slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(setting, fold, hits, n, settled) for every setting and fold.

    Of few ``rows`` (label, vec, ``fold``) each network trains in a task of its own.
    """
    jobs = [(s, f) for s in range(len(settings)) for f in range(folds)]
    schema = "setting long, fold long, hits long, n long, settled boolean"
    first = rows.select(F.size("vec").alias("dim")).first()
    if first is None:
        raise ValueError("the training set is empty")
    dim = first["dim"]
    if not is_small(rows, dim, local_bytes):
        return _fold_hits_wide(rows, dim, classes, settings, jobs, fold, slice_rows, schema)
    spark, table = rows.sparkSession, _held(rows, fold)
    sent = spark.sparkContext.broadcast((table.column("part").to_numpy(), table.column("label").to_numpy(),
                                         _matrix(table.column("vec").combine_chunks(), table.num_rows)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, y, x = sent.value
        for batch in batches:
            for job in batch.column(0).to_pylist():
                s, f = jobs[job]
                network, settled = trained(x[part != f], y[part != f], classes, settings[s])
                right = network.outputs(x[part == f])[-1].argmax(axis=1) == y[part == f]
                yield pa.RecordBatch.from_pylist([{"setting": s, "fold": f, "hits": int(right.sum()), "n": len(right), "settled": settled}])

    return spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, schema)


def _fold_hits_wide(rows: DataFrame, dim: int, classes: int, settings: list[Training], jobs: list[tuple[int, int]], fold: str, slice_rows: int,
                    schema: str) -> DataFrame:
    """As ``fold_hits`` for many rows: all networks meet the slices of the table together."""
    table = sliced(rows.select(F.col(fold).cast("int").alias("part"), F.col("label").cast("int").alias("label"),
                               F.col("vec").cast("array<double>").alias("vec")), slice_rows)
    fitted = trained_together(table, dim, classes, [(settings[s], f) for s, f in jobs])
    sent = rows.sparkSession.sparkContext.broadcast(fitted)

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, y, x in _unpacked(batches, dim):
            for (s, f), (network, settled) in zip(jobs, sent.value, strict=True):
                own = np.flatnonzero(part == f)
                right = network.outputs(x[own])[-1].argmax(axis=1) == y[own]
                yield pa.RecordBatch.from_pylist([{"setting": s, "fold": f, "hits": int(right.sum()), "n": len(own), "settled": settled}])

    return table.mapInArrow(tell, schema).groupBy("setting", "fold", "settled").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).select(
        "setting", "fold", "hits", "n", "settled")


class Perceptron(Estimator):
    """Estimator over (label, features)."""

    def __init__(self, dim: int, classes: int, how: Training, local_bytes: int = LOCAL_BYTES):
        super().__init__()
        self.dim, self.classes, self.how, self.local_bytes = dim, classes, how, local_bytes

    def _fit(self, df: DataFrame) -> PerceptronModel:
        rows = df.select(F.col("label").cast("int").alias("label"), _array(df).alias("vec"))
        if not is_small(rows, self.dim, self.local_bytes):
            return PerceptronModel(*trained_wide(rows, self.dim, self.classes, self.how))
        table = _held(rows)
        if not table.num_rows:
            raise ValueError("the training set is empty")
        x, y = _matrix(table.column("vec").combine_chunks(), table.num_rows), table.column("label").to_numpy()
        spark, classes, how = df.sparkSession, self.classes, self.how
        sent = spark.sparkContext.broadcast((x, y))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                network, settled = trained(*sent.value, classes, how)
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([v.ravel() for layer in network.layers for v in layer]).tobytes()], pa.binary()),
                                                  pa.array([settled])], ["weights", "settled"])

        row = spark.range(0, 1, 1, 1).mapInArrow(run, "weights binary, settled boolean").first()
        network = Network.drawn(self.dim, classes, how)
        flat = np.frombuffer(row["weights"])
        for layer in network.layers:
            for v in layer:
                v[...], flat = flat[:v.size].reshape(v.shape), flat[v.size:]
        return PerceptronModel(network, row["settled"])


def _array(df: DataFrame, column: str = "features"):
    return vector_to_array(column) if isinstance(df.schema[column].dataType, VectorUDT) else F.col(column).cast("array<double>")


def _scorer(names: list[str], sent: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                share = sent.value.outputs(_matrix(batch.column("_x"), n))[-1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * share.shape[1]), pa.array(share.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(share.argmax(axis=1).astype(np.float64)), lists],
                                                 [*names, "prediction", "_share"])
    return run


class PerceptronModel(Model):
    """Adds ``prediction`` and ``probability``; ``settled`` tells whether the loss came to rest."""

    def __init__(self, network: Network, settled: bool):
        super().__init__()
        self.network, self.settled = network, settled

    def _transform(self, df: DataFrame) -> DataFrame:
        # ML vectors do not travel through Arrow.
        names = [c for c in df.columns if c not in ("prediction", "probability") and not isinstance(df.schema[c].dataType, VectorUDT)]
        source = df.select(*names, _array(df).alias("_x"))
        schema = source.select(*names, F.lit(0.0).alias("prediction"), F.array(F.lit(0.0)).alias("_share")).schema
        sent = df.sparkSession.sparkContext.broadcast(self.network)
        out = source.mapInArrow(_scorer(names, sent), schema)
        return out.select(*names, "prediction", array_to_vector("_share").alias("probability"))
