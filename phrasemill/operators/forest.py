"""Random forests, grown level by level over all nodes of several trees at once.

Few rows are sent to all tasks, and each task grows some of the trees. Of many
rows, the upper levels come from histograms that are summed over the cluster;
as soon as a node's rows are few, they go to one task, which grows the rest of
that tree below it. Splits of few rows are exact. A tree has no limit of depth,
and the draws of a node depend on the seed, the tree and the path to the node
alone: a tree of limited depth is the top of the unlimited one, so a search over
depths grows each forest once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F

from phrasemill.session import fits, written

#: Bytes of training rows that are sent to all tasks, or to one task for the rest of a tree.
LOCAL_BYTES = 64 << 20
#: Bytes of trees that are sent out at a time to score rows.
MODEL_BYTES = 64 << 20
#: Values of (row, feature) that a task sorts at once.
CELLS = 2_000_000
#: Borders of a feature's histogram.
BINS = 64
#: Trees whose upper levels are grown together.
TOGETHER = 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Growth:
    """How trees grow; ``max_depth`` none: until nodes are pure or small."""

    criterion: str = "gini"
    features: int = 1  # looked at for a split
    max_depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    seed: int = 17


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers, well mixed."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def drawn(keys: np.ndarray, dim: int, count: int) -> np.ndarray:
    """``count`` different features for each node key."""
    if count >= dim:
        return np.tile(np.arange(dim), (len(keys), 1))
    with np.errstate(over="ignore"):
        order = mixed(keys[:, None] + _GOLDEN * np.arange(1, dim + 1, dtype=np.uint64))
    return np.argpartition(order, count, axis=1)[:, :count]


def worth(left: list[np.ndarray], right: list[np.ndarray], n_left: np.ndarray, n_right: np.ndarray, criterion: str) -> np.ndarray:
    """How good splits are, from counts on both sides, an array for each class; the larger the better, for splits of the same node."""
    if criterion == "gini":
        return sum(n * n for n in left) / n_left + sum(n * n for n in right) / n_right
    told = lambda n: n * np.log(np.maximum(n, 1))
    return sum(map(told, left)) + sum(map(told, right)) - told(n_left) - told(n_right)


@dataclass
class Nodes:
    """Nodes of trees end to end: the right child follows the left one; a leaf has the feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    counts: np.ndarray

    @staticmethod
    def joined(parts: list[Nodes]) -> Nodes:
        base = np.cumsum([0, *(len(p.feature) for p in parts)])
        return Nodes(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("feature", "threshold")),
                     np.concatenate([np.where(p.feature >= 0, p.left + b, 0) for p, b in zip(parts, base, strict=False)]),
                     np.concatenate([p.counts for p in parts]))


@dataclass
class Level:
    """Best splits of some nodes; ``found`` tells which have one."""

    found: np.ndarray
    feature: np.ndarray
    rank: np.ndarray
    above: np.ndarray


@dataclass
class Rows:
    """Training rows of a task, and each value's rank among its feature's values."""

    x: np.ndarray
    y: np.ndarray
    classes: int
    rank: np.ndarray = field(init=False)
    values: np.ndarray = field(init=False)  # of all features, end to end
    first: np.ndarray = field(init=False)

    def __post_init__(self):
        self.rank = np.empty(self.x.shape, dtype=np.int32)
        values = []
        for f in range(self.x.shape[1]):
            found, self.rank[:, f] = np.unique(self.x[:, f], return_inverse=True)
            values.append(found)
        self.values, self.first = np.concatenate(values), np.cumsum([0, *map(len, values)])[:-1]


def best_splits(rows: Rows, sample: np.ndarray, weight: np.ndarray, node: np.ndarray, features: np.ndarray, totals: np.ndarray,
                growth: Growth) -> Level:
    """The best split of every node over its features; ``node`` numbers the nodes of ``sample`` from 0 in order."""
    n, m = features.shape
    # Segment, rank, label and weight side by side in one number, so that sorting numbers sorts the rows of all segments.
    bits = int(weight.max(initial=1)).bit_length()
    low = max(rows.classes - 1, 1).bit_length()
    middle = max(len(rows.x) - 1, 1).bit_length()
    segment = node.astype(np.int64)[:, None] * m + np.arange(m)
    keys = (((segment << middle) + rows.rank[sample[:, None], features[node]]) << low + bits) + ((rows.y[sample] << bits) + weight)[:, None]
    keys = np.sort(keys, axis=None)
    place, label = keys >> low + bits, (keys >> bits & (1 << low) - 1).astype(np.int16)
    often = (keys & (1 << bits) - 1).astype(np.float64)
    segment = (place >> middle).astype(np.int32)
    border = np.flatnonzero((place[1:] != place[:-1]) & (segment[1:] == segment[:-1]))
    first = np.searchsorted(segment, np.arange(n * m))
    begin, owner = first[segment[border]], segment[border] // m
    upto = np.zeros(len(keys) + 1, dtype=np.float64)
    np.cumsum(often, out=upto[1:])
    n_left = upto[border + 1] - upto[begin]
    n_right = totals.sum(axis=1).astype(np.float64)[owner] - n_left
    fine = (n_left >= growth.min_leaf) & (n_right >= growth.min_leaf)
    if not fine.all():
        border, owner, begin, n_left, n_right = (v[fine] for v in (border, owner, begin, n_left, n_right))
    left, right = [], []
    for k in range(rows.classes):
        np.cumsum(often * (label == k), out=upto[1:])
        left.append(upto[border + 1] - upto[begin])
        right.append(totals[:, k].astype(np.float64)[owner] - left[-1])
    score = worth(left, right, n_left, n_right, growth.criterion)
    found = np.zeros(n, dtype=bool)
    out = Level(found, *(np.zeros(n, dtype=np.int64) for _ in range(3)))
    if len(border):
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        top = np.maximum.reduceat(score, begins)
        sizes = np.diff(np.append(begins, len(owner)))
        hits = np.flatnonzero(score == np.repeat(top, sizes))
        at = border[hits[np.searchsorted(hits, begins)]]
        who, ranks = owner[begins], place & (1 << middle) - 1
        found[who] = True
        out.feature[who] = features[who, segment[at] % m]
        out.rank[who], out.above[who] = ranks[at], ranks[at + 1]
    return out


def grown(rows: Rows, samples: list[np.ndarray], keys: np.ndarray, growth: Growth, depth: int = 0) -> list[Nodes]:
    """A tree for each sample of rows; ``keys`` are those of the roots, which lie at ``depth``."""
    trees, dim = len(samples), rows.x.shape[1]
    found = [np.unique(s, return_counts=True) for s in samples]  # rows that a sample has several times weigh more
    sample, weight = (np.concatenate([x[k] for x in found]).astype(np.int64) for k in (0, 1))
    node = np.repeat(np.arange(trees), [len(x[0]) for x in found])
    of, keys, count = np.arange(trees), keys.astype(np.uint64), trees  # of the level's nodes: the tree, the key, how many
    levels: list[tuple] = []
    while True:
        totals = np.bincount(node * rows.classes + rows.y[sample], weight, count * rows.classes).astype(np.int64).reshape(count, rows.classes)
        size = totals.sum(axis=1)
        split = (size >= max(growth.min_split, 2 * growth.min_leaf)) & ((totals > 0).sum(axis=1) > 1)
        if growth.max_depth is not None and depth >= growth.max_depth:
            split[:] = False
        feature, threshold = np.full(count, -1, dtype=np.int32), np.zeros(count)
        border = np.zeros(count, dtype=np.int64)
        inside = split[node]
        sample, weight, node = sample[inside], weight[inside], node[inside]
        order = np.argsort(node, kind="stable")
        sample, weight, node = sample[order], weight[order], node[order]
        open_nodes = np.flatnonzero(split)
        bounds = np.searchsorted(node, np.append(open_nodes, count))
        for most in (min(growth.features, dim), dim):  # if no drawn feature varies, all are looked at
            todo = np.flatnonzero(feature[open_nodes] < 0)
            if not len(todo):
                break
            cells = np.cumsum((bounds[todo + 1] - bounds[todo]) * most)
            for part in np.split(todo, np.searchsorted(cells, np.arange(CELLS, cells[-1], CELLS))):
                if not len(part):
                    continue
                ids = open_nodes[part]
                pick = np.concatenate([np.arange(bounds[p], bounds[p + 1]) for p in part.tolist()])
                local = np.repeat(np.arange(len(part)), bounds[part + 1] - bounds[part])
                got = best_splits(rows, sample[pick], weight[pick], local, drawn(keys[ids], dim, most), totals[ids], growth)
                hit = ids[got.found]
                feature[hit] = got.feature[got.found]
                border[hit] = got.rank[got.found]
                low, high = (rows.values[rows.first[got.feature] + r][got.found] for r in (got.rank, got.above))
                middle = low + (high - low) / 2
                threshold[hit] = np.where(middle < high, middle, low)
            if most == dim:
                break
        parents = np.flatnonzero(feature >= 0)
        child = np.full(count, -1, dtype=np.int64)
        child[parents] = 2 * np.arange(len(parents))
        levels.append((of, feature, threshold, child, totals))
        if not len(parents):
            break
        stay = feature[node] >= 0
        sample, weight, node = sample[stay], weight[stay], node[stay]
        node = child[node] + (rows.rank[sample, feature[node]] > border[node])
        with np.errstate(over="ignore"):
            keys = mixed(np.repeat(keys[parents], 2) * np.uint64(2) + np.tile(np.array([1, 2], dtype=np.uint64), len(parents)))
        of, count, depth = np.repeat(of[parents], 2), 2 * len(parents), depth + 1
    return _by_tree(levels, trees)


def _by_tree(levels: list[tuple], trees: int) -> list[Nodes]:
    """Nodes of each tree, level after level."""
    base = np.cumsum([0, *(len(x[0]) for x in levels)])
    of = np.concatenate([x[0] for x in levels])
    left = np.concatenate([np.where(x[3] >= 0, x[3] + b, 0) for x, b in zip(levels, base[1:], strict=True)])
    order = np.argsort(of, kind="stable")
    place = np.empty(len(of), dtype=np.int64)
    place[order] = np.arange(len(of))
    feature, threshold, totals = (np.concatenate([x[k] for x in levels])[order] for k in (1, 2, 4))
    starts = np.searchsorted(of[order], np.arange(trees + 1))
    left = np.where(feature >= 0, place[left[order]], 0)
    return [Nodes(feature[a:b], threshold[a:b], np.where(feature[a:b] >= 0, left[a:b] - a, 0).astype(np.int32), totals[a:b].astype(np.int32))
            for a, b in zip(starts[:-1], starts[1:], strict=True)]


def votes(nodes: Nodes, roots: np.ndarray, x: np.ndarray, depths: list[int | None]) -> np.ndarray:
    """Class probabilities of rows summed over trees, for trees cut at each of some depths: (depths, rows, classes)."""
    share = nodes.counts / nodes.counts.sum(axis=1, keepdims=True)
    n, out = len(x), np.zeros((len(depths), len(x), nodes.counts.shape[1]))
    for root in roots.tolist():
        node = np.full(n, root, dtype=np.int64)
        moving, level = np.arange(n), 0
        while True:
            for k, d in enumerate(depths):
                if d == level:
                    out[k] += share[node]
            moving = moving[nodes.feature[node[moving]] >= 0]
            if not len(moving) or all(d is not None and d <= level for d in depths):
                break
            at = node[moving]
            node[moving] = nodes.left[at] + (x[moving, nodes.feature[at]] > nodes.threshold[at])
            level += 1
        for k, d in enumerate(depths):
            if d is None or d > level:
                out[k] += share[node]
    return out


def root_keys(seed: int, group: int, trees: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(mixed(np.uint64(seed) + _GOLDEN * np.uint64(group + 1)) + _GOLDEN * (trees.astype(np.uint64) + np.uint64(1)))


TREES = "part int, tree int, feature array<int>, threshold array<double>, left array<int>, counts array<int>"


def _told(part: int, tree: int, nodes: Nodes) -> tuple:
    return part, tree, nodes.feature, nodes.threshold, nodes.left, nodes.counts.ravel()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
        *(pa.array([r[k] for r in rows], pa.list_(kind)) for k, kind in ((2, pa.int32()), (3, pa.float64()), (4, pa.int32()), (5, pa.int32())))],
        ["part", "tree", "feature", "threshold", "left", "counts"])


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def grow_forest(rows: DataFrame, classes: int, trees: int, growth: Growth, apart: str | None = None, parts: int = 1,
                local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """Trees (``TREES``) over rows (label, vec), every tree on a sample with replacement of as many rows.

    With ``apart``, a column of part numbers below ``parts``, there is a forest
    for each part, of the rows of all other parts. Within ``local_bytes`` the
    rows are sent to all tasks; else the upper levels are grown by histograms.
    """
    spark = rows.sparkSession
    first = rows.select(F.size("vec").alias("dim")).first()
    if first is None:
        raise ValueError("the training set is empty")
    dim = first["dim"]
    part = F.lit(-1) if apart is None else F.col(apart)
    source = rows.select(part.cast("int").alias("part"), F.col("label").cast("int").alias("label"), F.col("vec").cast("array<double>").alias("vec"))
    if not fits(source, 8 * dim + 16, local_bytes):
        return _grown_wide(source, dim, classes, trees, growth, parts if apart else 1, local_bytes)
    # Rows in a fixed order, so that samples do not depend on how they come in.
    held = source.orderBy("part", "label", F.xxhash64("vec"), "vec").toArrow()
    sent = spark.sparkContext.broadcast((held.column("part").to_numpy(), held.column("label").to_numpy(),
                                         _matrix(held.column("vec").combine_chunks(), dim)))
    groups = parts if apart else 1
    # Trees that are grown together share the cost of a level; all cores get some.
    cores = spark.sparkContext.defaultParallelism
    each = max(1, min(TOGETHER, CELLS // (4 * max(held.num_rows, 1)), trees * groups // cores or 1))
    units = [(g, a, min(a + each, trees)) for g in range(groups) for a in range(0, trees, each)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, label, x = sent.value
        ready: tuple[int, Rows] | None = None
        for batch in batches:
            for u in batch.column(0).to_pylist():
                g, a, b = units[u]
                if ready is None or ready[0] != g:
                    keep = of != g
                    ready = g, Rows(x[keep], label[keep].astype(np.int64), classes)
                n, ids = len(ready[1].x), np.arange(a, b)
                samples = [np.random.default_rng([growth.seed, g, t]).integers(0, n, n) for t in ids.tolist()]
                found = grown(ready[1], samples, root_keys(growth.seed, g, ids), growth)
                yield _batch([_told(g, t, nodes) for t, nodes in zip(ids.tolist(), found, strict=True)])

    return spark.range(0, len(units), 1, min(len(units), 4 * cores)).mapInArrow(run, TREES)


def _sampled(keys: np.ndarray, part: int, tree: int, seed: int) -> np.ndarray:
    """How often a tree's sample has each row: Poisson numbers of mean 1, by a hash of row and tree."""
    with np.errstate(over="ignore"):
        u = mixed(keys ^ root_keys(seed + 1, part, np.array([tree]))) >> np.uint64(11)
    limits = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(limits, u / float(1 << 53), side="right")


def _grown_wide(source: DataFrame, dim: int, classes: int, trees: int, growth: Growth, groups: int, local_bytes: int) -> DataFrame:
    """As ``grow_forest`` for many rows."""
    spark = source.sparkSession
    table = written(source.withColumn("key", F.xxhash64("label", "vec", F.monotonically_increasing_id())), "forest-rows")
    few = max(local_bytes // (8 * dim + 16), 1)
    steps = [i / BINS for i in range(1, BINS)]
    borders = table.agg(*[F.percentile_approx(F.get("vec", F.lit(f)), steps, 1000).alias(f"b{f}") for f in range(dim)]).first()
    borders = [np.unique(np.array(b)) for b in borders]
    out = None
    for g in range(groups):
        rows = table.filter(F.col("part") != g).select("key", "label", "vec")
        for begin in range(0, trees, TOGETHER):
            ids = np.arange(begin, min(begin + TOGETHER, trees))
            tops, leaves = _tops(rows, g, ids, borders, dim, classes, growth, few)
            found = written(_below(rows, g, ids, tops, leaves, dim, classes, growth), "trees")
            out = found if out is None else out.unionByName(found)
    return out


@dataclass
class Top:
    """The upper levels of a tree as they grow; nodes that wait for their rows are in ``open``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    counts: list[np.ndarray] = field(default_factory=list)
    key: list[np.uint64] = field(default_factory=list)
    depth: list[int] = field(default_factory=lambda: [0])

    def nodes(self) -> Nodes:
        return Nodes(np.array(self.feature, dtype=np.int32), np.array(self.threshold), np.array(self.left, dtype=np.int32), np.array(self.counts))


def _leaf_of(nodes: Nodes, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), dtype=np.int64)
    while len(moving := np.flatnonzero(nodes.feature[at] >= 0)):
        here = at[moving]
        at[moving] = nodes.left[here] + (x[moving, nodes.feature[here]] > nodes.threshold[here])
    return at


def _tops(rows: DataFrame, group: int, ids: np.ndarray, borders: list[np.ndarray], dim: int, classes: int, growth: Growth, few: int,
          ) -> tuple[dict[int, Top], dict[int, list[int]]]:
    """Upper levels of trees, until no node has more than ``few`` rows; and the leaves whose rows are to be grown further."""
    tops = {t: Top(key=[k], counts=[np.zeros(classes, dtype=np.int64)]) for t, k in zip(ids.tolist(), root_keys(growth.seed, group, ids), strict=True)}
    waiting, further = {t: [0] for t in tops}, {t: [] for t in tops}
    most = min(growth.features, dim)
    while any(waiting.values()):
        # The draws of a node, and all features for one that could not be split by them, are part of its histogram.
        asked = {t: (np.array(w), drawn(np.array([tops[t].key[i] for i in w], dtype=np.uint64), dim, most)) for t, w in waiting.items() if w}
        shipped = {t: (tops[t].nodes(), *a) for t, a in asked.items()}

        def count(batches: Iterable[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                x, y = _matrix(batch.column("vec"), dim), batch.column("label").to_numpy()
                keys = batch.column("key").to_numpy().view(np.uint64)
                bins = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(borders)], axis=1)
                for t, (nodes, which, features) in shipped.items():
                    weight = _sampled(keys, group, t, growth.seed)
                    leaf = _leaf_of(nodes, x)
                    at = np.minimum(np.searchsorted(which, leaf), len(which) - 1)
                    use = (which[at] == leaf) & (weight > 0)
                    at, m = at[use], features.shape[1]
                    cell = ((at[:, None] * m + np.arange(m)) * BINS + bins[use][np.arange(len(at))[:, None], features[at]]) * classes + y[use][:, None]
                    found = np.bincount(cell.ravel(), weights=np.repeat(weight[use], m), minlength=len(which) * m * BINS * classes)
                    total[t] = total.get(t, 0) + found
            for t, found in total.items():
                seen = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), t, np.int32)), pa.array(seen), pa.array(found[seen].astype(np.int64))],
                                                 ["tree", "cell", "n"])

        sums = rows.mapInArrow(count, "tree int, cell long, n long").groupBy("tree", "cell").agg(F.sum("n").alias("n"))
        per_node = most * BINS * classes
        owner = F.expr(f"cell div {per_node}")
        level = sums.select("tree", owner.alias("node"), (F.col("cell") % per_node).alias("cell"), "n")

        def best(keys: tuple[pa.Scalar, ...], group_table: pa.Table) -> pa.Table:
            t, k = keys[0].as_py(), keys[1].as_py()
            cells = np.zeros(per_node, dtype=np.int64)
            cells[group_table.column("cell").to_numpy()] = group_table.column("n").to_numpy()
            cells = cells.reshape(most, BINS, classes)
            totals = cells[0].sum(axis=0)
            left = cells.cumsum(axis=1)[:, :-1].reshape(-1, classes)
            right = totals - left
            fine = (left.sum(axis=1) >= growth.min_leaf) & (right.sum(axis=1) >= growth.min_leaf) & (np.arange(len(left)) % (BINS - 1) < np.repeat(
                [len(borders[f]) for f in asked[t][1][k]], BINS - 1))
            f, b = -1, 0
            if fine.any():
                score = np.full(len(left), -np.inf)
                sides = [v[fine].astype(np.float64) for v in (left, right)]
                score[fine] = worth(*(list(v.T) for v in sides), *(v.sum(axis=1) for v in sides), growth.criterion)
                at = int(score.argmax())
                f, b = int(asked[t][1][k][at // (BINS - 1)]), at % (BINS - 1)
                lower = left[at].tolist()
            else:
                lower = totals.tolist()
            return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([k], pa.int64()), "feature": pa.array([f], pa.int32()),
                             "border": pa.array([b], pa.int32()), "counts": pa.array([totals.tolist()], pa.list_(pa.int64())),
                             "lower": pa.array([lower], pa.list_(pa.int64()))})

        # One row for each node that waits.
        found = level.groupBy("tree", "node").applyInArrow(
            best, "tree int, node long, feature int, border int, counts array<long>, lower array<long>").collect()
        waiting = {t: [] for t in tops}
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            top, node = tops[r["tree"]], int(asked[r["tree"]][0][r["node"]])
            totals = np.array(r["counts"])
            top.counts[node] = totals
            size, deep = totals.sum(), growth.max_depth is not None and top.depth[node] >= growth.max_depth
            if deep or (totals > 0).sum() < 2 or size < max(growth.min_split, 2 * growth.min_leaf):
                continue
            if size <= few or r["feature"] < 0:
                further[r["tree"]].append(node)
                continue
            top.feature[node], top.threshold[node], top.left[node] = r["feature"], float(borders[r["feature"]][r["border"]]), len(top.feature)
            for side, counts in enumerate((np.array(r["lower"]), totals - np.array(r["lower"]))):
                top.feature.append(-1)
                top.threshold.append(0.0)
                top.left.append(0)
                top.counts.append(counts)
                top.depth.append(top.depth[node] + 1)
                with np.errstate(over="ignore"):
                    top.key.append(mixed(np.array([top.key[node]], dtype=np.uint64) * np.uint64(2) + np.uint64(side + 1))[0])
                waiting[r["tree"]].append(len(top.feature) - 1)
    return tops, further


def _below(rows: DataFrame, group: int, ids: np.ndarray, tops: dict[int, Top], further: dict[int, list[int]], dim: int, classes: int,
           growth: Growth) -> DataFrame:
    """Whole trees: the rows of a node that is to grow further meet in one task."""
    shipped = {t: (top.nodes(), np.array(further[t], dtype=np.int64), np.array(top.key, dtype=np.uint64), np.array(top.depth)) for t, top in tops.items()}
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(shipped)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, keys = _matrix(batch.column("vec"), dim), batch.column("key").to_numpy().view(np.uint64)
            for t, (nodes, leaves, _, _) in sent.value.items():
                leaf, weight = _leaf_of(nodes, x), _sampled(keys, group, t, growth.seed)
                use = np.flatnonzero((weight > 0) & np.isin(leaf, leaves))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(use), t, np.int32)), pa.array(leaf[use]), pa.array(weight[use]), batch.column("key").take(pa.array(use)),
                    batch.column("label").take(pa.array(use)), batch.column("vec").take(pa.array(use))], ["tree", "leaf", "weight", "key", "label", "vec"])

    def rest(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t, leaf = keys[0].as_py(), keys[1].as_py()
        order = np.argsort(table.column("key").to_numpy(), kind="stable")  # whatever order the rows came in
        local = Rows(_matrix(table.column("vec").combine_chunks(), dim)[order], table.column("label").to_numpy()[order].astype(np.int64), classes)
        _, _, key, depth = sent.value[t]
        sample = np.repeat(np.arange(len(local.x)), table.column("weight").to_numpy()[order])
        found = grown(local, [sample], key[leaf:leaf + 1], growth, int(depth[leaf]))[0]
        return pa.Table.from_batches([_batch([_told(leaf, t, found)])])

    below = rows.mapInArrow(deal, "tree int, leaf long, weight long, key long, label int, vec array<double>").groupBy("tree", "leaf").applyInArrow(rest, TREES)
    alone = spark.createDataFrame([(-1, t, [], [], [], []) for t in ids.tolist()], TREES)  # trees without such nodes

    def whole(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = keys[0].as_py()
        top = sent.value[t][0]
        parts, leaves = [top], []
        for r in sorted((r for r in table.to_pylist() if r["part"] >= 0), key=lambda r: r["part"]):
            parts.append(Nodes(np.array(r["feature"], dtype=np.int32), np.array(r["threshold"]), np.array(r["left"], dtype=np.int32),
                               np.array(r["counts"], dtype=np.int64).reshape(-1, classes)))
            leaves.append(r["part"])
        nodes = Nodes.joined(parts)
        starts = np.cumsum([len(p.feature) for p in parts])[:-1]
        for leaf, start in zip(leaves, starts.tolist(), strict=True):  # the leaf takes the place of the root below it
            for column in (nodes.feature, nodes.threshold, nodes.left, nodes.counts):
                column[leaf] = column[start]
        return pa.Table.from_batches([_batch([_told(group, t, nodes)])])

    # A tree fits into a task, as it must to be used.
    return below.unionByName(alone).groupBy("tree").applyInArrow(whole, TREES)


def _blocks(trees: DataFrame, classes: int, model_bytes: int) -> Iterator[list]:
    """Trees in order, blocks of bounded size at a time."""
    sizes = trees.select("part", "tree", (F.size("feature") * (16 + 4 * classes)).alias("bytes")).orderBy("part", "tree").collect()
    blocks: list[list[tuple[int, int]]] = [[]]
    held = 0
    for r in sizes:
        if blocks[-1] and held + r["bytes"] > model_bytes:
            blocks.append([])
            held = 0
        blocks[-1].append((r["part"], r["tree"]))
        held += r["bytes"]
    for block in filter(None, blocks):
        low, high = (F.struct(*map(F.lit, end)) for end in (block[0], block[-1]))
        yield trees.filter(F.struct("part", "tree").between(low, high)).orderBy("part", "tree").collect()


def _nodes(row, classes: int) -> Nodes:
    return Nodes(np.array(row["feature"], dtype=np.int32), np.array(row["threshold"]), np.array(row["left"], dtype=np.int32),
                 np.array(row["counts"], dtype=np.int32).reshape(-1, classes))


def tree_labels(points: DataFrame, trees: DataFrame, classes: int, keep: list[str], depth: int | None = None,
                model_bytes: int = MODEL_BYTES) -> DataFrame:
    """``keep`` columns, ``tree`` and ``prediction``: the label that each tree gives each point (``vec``), in one pass a block of trees."""
    spark, out = points.sparkSession, None
    source = points.select(*keep, F.col("vec").cast("array<double>").alias("_vec"))
    schema = source.select(*keep, F.lit(0).alias("tree"), F.lit(0).alias("prediction")).schema
    for found in _blocks(trees, classes, model_bytes):
        sent = spark.sparkContext.broadcast([(r["tree"], _nodes(r, classes)) for r in found])

        def tell(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = np.asarray(batch.column("_vec").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
                    for tree, nodes in sent.value:
                        label = votes(nodes, np.array([0]), x, [depth])[0].argmax(axis=1).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.full(len(x), tree, np.int32)), pa.array(label)],
                                                         schema.names)

        part = source.mapInArrow(tell, schema)
        out = part if out is None else out.unionByName(part)
    return out


def forest_votes(points: DataFrame, trees: DataFrame, classes: int, depths: list[int | None], keep: list[str], apart: str | None = None,
                 model_bytes: int = MODEL_BYTES) -> DataFrame:
    """``keep`` columns, ``depth_no`` and ``votes``, class probabilities summed over trees, for each of ``depths``.

    ``points`` have ``vec``; with ``apart`` a point meets the trees of its own
    part. Trees are sent out in blocks of bounded size; each adds its votes.
    """
    spark = points.sparkSession
    part = F.lit(0) if apart is None else F.col(apart)
    start = F.array_repeat(F.lit(0.0), len(depths) * classes)
    out = points.select(*keep, part.cast("int").alias("_part"), F.col("vec").cast("array<double>").alias("_vec"), start.alias("_votes"))
    schema = out.schema
    for found in _blocks(trees, classes, model_bytes):
        parts = [_nodes(r, classes) for r in found]
        roots = np.cumsum([0, *(len(p.feature) for p in parts)])[:-1]
        sent = spark.sparkContext.broadcast((Nodes.joined(parts), roots, np.array([r["part"] for r in found])))

        def add(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            nodes, roots, of = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.asarray(batch.column("_vec").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
                own = batch.column("_part").to_numpy()
                total = np.asarray(batch.column("_votes").flatten()).reshape(batch.num_rows, len(depths), classes).copy()
                for p in np.unique(own).tolist():
                    rows = np.flatnonzero(own == p)
                    total[rows] += votes(nodes, roots[of == p], x[rows], depths).transpose(1, 0, 2)
                offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * (len(depths) * classes)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]),
                                                  pa.ListArray.from_arrays(pa.array(offsets), pa.array(total.ravel()))], schema.names)

        out = out.mapInArrow(add, schema)
    each = F.transform(F.sequence(F.lit(0), F.lit(len(depths) - 1)), lambda i: F.slice("_votes", i * classes + 1, F.lit(classes)))
    return out.select(*keep, F.posexplode(each).alias("depth_no", "votes"))


def subset(kind: str | None, dim: int) -> int:
    """Features that a split looks at, by the name of the rule."""
    return {"auto": int(math.sqrt(dim)), "sqrt": int(math.sqrt(dim)), "log2": int(math.log2(dim)), None: dim}[kind] or 1


class Forest(Estimator):
    """Estimator over (label, features); see ``grow_forest``."""

    def __init__(self, dim: int, classes: int, trees: int, growth: Growth, local_bytes: int = LOCAL_BYTES):
        super().__init__()
        self.dim, self.classes, self.trees, self.growth, self.local_bytes = dim, classes, trees, growth, local_bytes

    def _fit(self, df: DataFrame) -> ForestModel:
        features = vector_to_array("features") if isinstance(df.schema["features"].dataType, VectorUDT) else F.col("features")
        rows = df.select("label", features.alias("vec"))
        return ForestModel(written(grow_forest(rows, self.classes, self.trees, self.growth, local_bytes=self.local_bytes), "forest"),
                           self.classes, self.growth)


class ForestModel(Model):
    """A stored forest; adds ``prediction`` (ties: the lower label) and ``probability``, the mean over all trees."""

    def __init__(self, trees: DataFrame, classes: int, growth: Growth):
        super().__init__()
        self.trees, self.classes, self.growth = trees, classes, growth

    def cut(self, max_depth: int | None) -> ForestModel:
        """The same forest with trees of limited depth."""
        return ForestModel(self.trees, self.classes, replace(self.growth, max_depth=max_depth))

    def _transform(self, df: DataFrame) -> DataFrame:
        features = vector_to_array("features") if isinstance(df.schema["features"].dataType, VectorUDT) else F.col("features")
        kept = [c for c in df.columns if c not in ("prediction", "probability")]
        # ML vectors do not travel through Arrow; they are made again from the array.
        rest = [c for c in kept if not isinstance(df.schema[c].dataType, VectorUDT)]
        out = forest_votes(df.select(*rest, features.alias("vec")) if "vec" not in rest else df.select(*rest), self.trees, self.classes,
                           [self.growth.max_depth], rest)
        total = F.aggregate("votes", F.lit(0.0), lambda a, v: a + v)
        return out.select(*rest, (F.array_position("votes", F.array_max("votes")) - 1).cast("double").alias("prediction"),
                          array_to_vector(F.transform("votes", lambda v: v / total)).alias("probability"))
