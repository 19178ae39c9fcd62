"""SimHash near-duplicates: BK-trees over shards of fingerprints.

Two fingerprints that differ in at most ``r`` bits agree in at least one of
``r + 1`` blocks of bits, so a fingerprint belongs to one shard for each block
and every link lies inside a shard. A shard is one BK-tree of bounded size:
children are keyed by their Hamming distance to the parent, and a search
follows only edges within the radius. Crowded blocks are cut into pieces whose
trees are searched by all pieces. A shard tree reaches its tasks by shuffle:
all trees together hold all fingerprints, too many for a driver to broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import attach, by_batch, parts_for, whole
from phrasemill.session import written

BITS = 64
SEED = 42
#: Fingerprints in one BK-tree, on average; a crowded block value is cut from half of this on.
SHARD = 20_000
#: Queries that walk a tree together.
TOGETHER = 256

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of some 64-bit hashes have, as a signed integer; 0 without any."""
    hashes = hashes.astype(">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    """The fingerprint of a whole text, as a signed 64-bit integer; 0 without words."""
    words = _WORD.findall(text.encode().lower())  # bytes: only A-Z change
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(b" ".join(words[i:i + shingle]), SEED)
                              for i in range(max(len(words) - shingle + 1, 1))], dtype=np.uint64))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp) of every row; a null text counts as empty, its fingerprint is 0."""
    source = df.select(F.col(key).cast("long").alias(key), whole(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], [key, "fp"])

        return by_batch(batches, work)

    return source.mapInArrow(run, f"`{key}` long, fp long")


class BKTree:
    """Distinct fingerprints; children of a node are keyed by their Hamming distance to it."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints = prints.astype(np.uint64)
        keys, children = [], []
        waiting = np.arange(1, len(prints))  # item 0 is the root
        owner = np.zeros(len(waiting), dtype=np.int64)
        while len(waiting):
            edge = np.bitwise_count(prints[waiting] ^ prints[owner]).astype(np.int64)
            slot = owner * (BITS + 1) + edge
            taken, first, which = np.unique(slot, return_index=True, return_inverse=True)
            keys.append(taken)
            children.append(waiting[first])  # the first of a slot becomes the child, the others go below it
            below = np.ones(len(waiting), dtype=bool)
            below[first] = False
            owner = waiting[first][which][below]
            waiting = waiting[below]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.children = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.children = self.keys[order], self.children[order]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query position, tree position) within ``radius``, level by level for a block of queries."""
        queries = queries.astype(np.uint64)
        for at in range(0, len(queries) if len(self.prints) else 0, TOGETHER):
            who = np.arange(at, min(at + TOGETHER, len(queries)))
            node = np.zeros(len(who), dtype=np.int64)
            while len(who):
                far = np.bitwise_count(queries[who] ^ self.prints[node]).astype(np.int64)
                near = far <= radius
                if near.any():
                    yield who[near], node[near]
                base = node * (BITS + 1)
                low = np.searchsorted(self.keys, base + np.maximum(far - radius, 0))
                high = np.searchsorted(self.keys, base + np.minimum(far + radius, BITS), side="right")
                count = high - low
                start = np.cumsum(count) - count
                who = np.repeat(who, count)
                node = self.children[np.repeat(low - start, count) + np.arange(len(who))]


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the sets that ``labels`` describes along the links (a, b)."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels != (up := labels[labels])).any():
            labels = up


def links(prints: DataFrame, radius: int = 2, shard: int = SHARD, fp: str = "fp") -> DataFrame:
    """(a, b) links that connect the distinct fingerprints of ``prints`` as all links within ``radius`` would.

    A tree gives each fingerprint one link to the root of its set in that tree,
    so the result is at most (radius + 1) times the input, however many links a
    dense set has.
    """
    blocks = radius + 1
    width = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    start = [sum(width[:i]) for i in range(blocks)]
    total = prints.count()
    values = F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, start[i]).bitwiseAND(
        F.lit((1 << width[i]) - 1).cast("long")).alias("value")) for i in range(blocks)])
    members = prints.select(F.col(fp).alias("fp"), F.explode(values).alias("v")).select("fp", "v.block", "v.value")
    shards = max(1, -(-total * blocks // shard))
    crowded = written(members.groupBy("block", "value").count().filter(F.col("count") > shard // 2), "crowded")
    cold = members.join(crowded, ["block", "value"], "left_anti").select(
        "block", F.pmod(F.xxhash64("block", "value"), F.lit(shards)).alias("place"),
        F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("piece"), "fp")
    # Pieces of a crowded value: group (i, j) holds the tree of piece i and the queries of piece j.
    pieces = F.ceil(F.col("count") / F.lit(shard // 2)).cast("int")
    hot = (members.join(crowded, ["block", "value"]).withColumn("piece", F.pmod(F.xxhash64("fp"), pieces).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
           .select("block", (-F.col("value") - 1).alias("place"), F.least("piece", "other").alias("i"),
                   F.greatest("piece", "other").alias("j"), "piece", "fp"))

    def connect(group: pa.Table) -> pa.Table:
        prints = group.column("fp").to_numpy()
        piece, i, j = (group.column(c).to_numpy() for c in ("piece", "i", "j"))
        inside = np.flatnonzero(piece == i)
        asking = inside if i[0] == j[0] else np.flatnonzero(piece == j)
        labels = np.arange(len(prints))
        for who, node in BKTree(prints[inside]).search(prints[asking], radius):
            labels = _join(labels, asking[who], inside[node])
        moved = labels != np.arange(len(prints))
        return pa.table({"a": prints[moved], "b": prints[labels[moved]]}, schema=pa.schema(
            [("a", pa.int64()), ("b", pa.int64())]))

    # Too few groups for a shuffle by key alone to spread them: one partition holds a tree or two.
    grouped = cold.unionByName(hot).repartition(parts_for(prints.sparkSession, min(blocks * shards, 20_000)),
                                                "block", "place", "i", "j")
    return grouped.groupBy("block", "place", "i", "j").applyInArrow(connect, "a long, b long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Large-star and small-star steps in turn, each round stored, until the edges
    stay the same; a logarithmic number of rounds, and never more edges.
    """
    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        kept = both.filter("b > a") if large else both
        out = kept.join(least, "a").select(F.col("b").alias("x"), "m")
        if not large:  # a node's own place under the smallest of its smaller neighbours
            out = out.unionByName(least.select(F.col("a").alias("x"), "m"))
        return out.filter("x != m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                  "edges")
    before = mark(now)
    for _ in range(rounds if before[0] else 0):
        now = written(stars(stars(now, True), False), "edges")
        if (after := mark(now)) == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def by_component(rows: DataFrame, nodes: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """Stored ``rows`` with the smallest ``least`` of their component, and its root; ``nodes`` (name, least, rows) has one row for each node."""
    roots = written(roots.withColumnRenamed("node", name), "roots")
    linked = written(nodes.select(name, "least", "rows").join(roots, name, "left").withColumn(
        "root", F.coalesce("root", name)), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    facts = written(linked.join(least, "root").select(name, "rows", "component", "root"), "facts")
    return attach(rows, facts, name, "rows", rows.count())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 3,
                    shard: int = SHARD) -> DataFrame:
    """(key, fp, component) of every row: the smallest key reachable over fingerprints within ``radius`` bits.

    Rows with equal fingerprints are one node, so copies never become pairs.
    Texts without words, nulls among them, have fingerprint 0 and are linked
    like any other. Repeated rows stay rows of their own; a row whose key is
    null gets the smallest other key of its component, or null. An empty table
    gives an empty table; further columns of ``df`` are not read.
    """
    prints = written(fingerprints(df, key, text, shingle), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("rows")), "nodes")
    return by_component(prints, nodes, components(links(nodes.select("fp"), radius, shard)), "fp").select(key, "fp", "component")


def hex_print(fp: str = "fp") -> F.Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
