"""A cluster tree over all rows: the leaf with the largest cost is split in two, again and again.

A node's height is its cost, the sum of squared distances to its mean. Children never
cost more than their parent, so heights fall along every path and in the order of the
splits. Cutting the tree after its first k - 1 splits gives k clusters, nested in those
of every smaller k.

Where a row belongs follows from its vector alone: from the root it goes to the nearer
of the two centres of each split. No labels are stored while the tree grows; all leaves
that may be split next are fitted together, in one pass over the rows per round.

Rows of one component need no sample: the best pair of clusters is the best cut of the
sorted values, which is found over all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators.lloyd import (
    SLOT_SCHEMA,
    group_sums,
    matrix,
    nearest,
    packed,
    settle,
    slots,
    spread_starts,
)
from cohortloom.session import materialise

# Rows of a leaf that are fetched for the starts of its split.
LEAF_SAMPLE = 20_000
STARTS = 4


@dataclass
class Node:
    """A cluster: its rows, mean and cost; once split, the two centres and its children."""

    name: int
    parent: int | None
    size: int
    mean: np.ndarray
    cost: float
    centres: np.ndarray | None = None
    halves: list[tuple[int, np.ndarray, float]] = field(default_factory=list)
    children: tuple[int, int] | None = None
    order: int | None = None

    @property
    def whole(self) -> bool:
        """Nothing left to split, up to rounding."""
        return self.size < 2 or self.cost <= 1e-12 * self.size * (1.0 + float((self.mean**2).sum()))


@dataclass
class Tree:
    nodes: dict[int, Node]

    def splits(self, limit: int | None = None) -> list[Node]:
        done = sorted((n for n in self.nodes.values() if n.order is not None), key=lambda n: n.order)
        return done if limit is None else done[:limit]

    def descend(self, x: np.ndarray, limit: int | None = None) -> np.ndarray:
        """The node of every row after the first `limit` splits."""
        at = np.ones(len(x), np.int64)
        # A split comes after the one that made its node, so one pass in order is enough.
        for node in self.splits(limit):
            here = np.flatnonzero(at == node.name)
            side = nearest(x[here], node.centres)[0]
            at[here] = np.array(node.children)[side]
        return at


def _node(name: int, parent: int | None, n: float, total: np.ndarray, square: float) -> Node:
    mean = total / n
    return Node(name, parent, int(n), mean, max(float(square - n * (mean * mean).sum()), 0.0))


def _root(points: DataFrame) -> Node | None:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                own = np.concatenate([np.ravel(s) for s in group_sums(x, np.zeros(len(x), int), 1)])
                whole = own if whole is None else whole + own
        if whole is not None:
            yield packed(whole)

    found = points.select("x").mapInArrow(add, SLOT_SCHEMA).groupBy("slot").agg(F.sum("value")).collect()
    if not found:
        return None
    whole = np.zeros(max(s for s, _ in found) + 1)
    for slot, value in found:
        whole[slot] = value
    # Zero sums send no slot; the length follows from the vectors.
    d = points.select(F.size("x")).first()[0]
    whole = np.concatenate((whole, np.zeros(d + 2 - len(whole))))
    return _node(1, None, whole[0], whole[1:-1], whole[-1])


def _samples(points: DataFrame, tree: Tree, leaves: list[Node]) -> dict[int, np.ndarray]:
    """About LEAF_SAMPLE rows of every leaf (all, if fewer), chosen by the hash of their key."""
    steps = 1 << 40
    keep = {n.name: min(steps, math.ceil(LEAF_SAMPLE / n.size * steps)) for n in leaves}
    sent = points.sparkSession.sparkContext.broadcast((tree, keep))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, keep = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at = tree.descend(matrix(batch.column(0)))
            most = np.array([keep.get(n, 0) for n in at.tolist()])
            chosen = np.flatnonzero(batch.column(1).to_numpy() < most)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[chosen]), batch.column(0).take(pa.array(chosen))], ["node", "x"]
            )

    place = F.pmod(F.xxhash64("key"), F.lit(steps))
    found = points.select("x", place.alias("place")).mapInArrow(pick, "node long, x array<double>")
    table = found.limit(2 * LEAF_SAMPLE * len(leaves)).toArrow().combine_chunks()
    if not table.num_rows:
        return {}
    node, x = table.column(0).to_numpy(), matrix(table.column(1).combine_chunks())
    return {n.name: x[node == n.name] for n in leaves}


def _axis_start(x: np.ndarray) -> np.ndarray:
    """Two means: the best cut along the axis on which the rows spread most."""
    middle = x - x.mean(axis=0)
    axis = np.linalg.eigh(middle.T @ middle)[1][:, -1]
    place = middle @ axis
    order = np.argsort(place, kind="stable")
    place, n = place[order], len(x)
    left = np.cumsum(place)[:-1]
    count = np.arange(1, n)
    gain = left**2 / count + (place.sum() - left) ** 2 / (n - count)
    gain[np.diff(place) <= 0] = -1.0
    cut = int(gain.argmax()) + 1
    return np.stack((x[order[:cut]].mean(axis=0), x[order[cut:]].mean(axis=0)))


def _start(x: np.ndarray, seed: int, name: int) -> np.ndarray | None:
    """The cheapest of several settled pairs of centres on a leaf's sample."""
    if len(x) < 2 or (x == x[0]).all():
        return None
    rng = np.random.default_rng([seed, name])
    tried = [settle(x, _axis_start(x))]
    for _ in range(STARTS):
        pair = spread_starts(x, 2, rng)
        if len(pair) == 2:
            tried.append(settle(x, pair))
    return min(tried, key=lambda t: t[1])[0]


def _line_values(points: DataFrame) -> DataFrame:
    """The different values of rows of one component, stored in order: (v, c, part), c rows each."""
    counted = points.groupBy(F.col("x")[0].alias("v")).agg(F.count("*").alias("c"))
    ranges = counted.repartitionByRange("v").withColumn("part", F.spark_partition_id())
    return materialise(ranges, "values")


def _line_starts(values: DataFrame, tree: Tree, leaves: list[Node]) -> dict[int, np.ndarray]:
    """The means on both sides of every leaf's best cut; on a tie the smaller cut.

    Sums run within a range of values and go on from the totals of the ranges before it,
    so no leaf is sorted as a whole.
    """
    sent = values.sparkSession.sparkContext.broadcast((tree, [n.name for n in leaves]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, names = sent.value
        for batch in batches:
            if batch.num_rows:
                at = tree.descend(batch.column(0).to_numpy()[:, None])
                own = pa.array(np.flatnonzero(np.isin(at, names)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at).take(own), *(c.take(own) for c in batch.columns)], ["node", "v", "c", "part"]
                )

    placed = values.select("v", "c", "part").mapInArrow(place, "node long, v double, c long, part int")
    total = F.sum(F.col("v") * F.col("c"))
    ranges = placed.groupBy("node", "part").agg(F.sum("c").alias("n"), total.alias("t")).orderBy("part").collect()
    n, t, before = {}, {}, []
    for r in ranges:
        before.append((r["node"], r["part"], n.get(r["node"], 0), t.get(r["node"], 0.0)))
        n[r["node"]] = n.get(r["node"], 0) + r["n"]
        t[r["node"]] = t.get(r["node"], 0.0) + r["t"]
    rows = [(node, part, n0, t0, n[node], t[node]) for node, part, n0, t0 in before]
    schema = "node long, part int, n0 long, t0 double, n long, t double"
    offsets = F.broadcast(values.sparkSession.createDataFrame(rows, schema))
    upto = Window.partitionBy("node", "part").orderBy("v")
    n1 = F.col("n0") + F.sum("c").over(upto)
    t1 = F.col("t0") + total.over(upto)
    cuts = placed.join(offsets, ["node", "part"]).withColumns({"n1": n1, "t1": t1}).where("n1 < n")
    gain = F.col("t1") * F.col("t1") / F.col("n1") + F.pow(F.col("t") - F.col("t1"), 2) / (F.col("n") - F.col("n1"))
    best = F.max(F.struct(gain.alias("gain"), (-F.col("v")).alias("last"), "n1", "t1", "n", "t")).alias("best")
    found = {}
    for r in cuts.groupBy("node").agg(best).collect():  # one row per leaf
        b = r["best"]
        found[r["node"]] = np.array([[b["t1"] / b["n1"]], [(b["t"] - b["t1"]) / (b["n"] - b["n1"])]])
    return found


def _fit_pairs(points: DataFrame, tree: Tree, pairs: dict[int, np.ndarray], rounds: int, tolerance: float) -> dict:
    """Settled centres, counts, sums and squares of the two halves of every leaf in `pairs`."""
    done: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
    open_ = dict(pairs)
    for turn in range(rounds):
        names = list(open_)
        d = next(iter(open_.values())).shape[1]
        width = 2 * (d + 2)
        sent = points.sparkSession.sparkContext.broadcast((tree, open_, names))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, open_, names = sent.value
            whole = np.zeros(width * len(names))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column(0))
                at = tree.descend(x)
                for i, name in enumerate(names):
                    own = x[at == name]
                    if len(own):
                        sums = group_sums(own, nearest(own, open_[name])[0], 2)
                        whole[i * width : (i + 1) * width] += np.concatenate([np.ravel(s) for s in sums])
            yield packed(whole)

        whole = slots(points.select("x").mapInArrow(add, SLOT_SCHEMA), width * len(names))
        for i, name in enumerate(names):
            own = whole[i * width : (i + 1) * width]
            counts, sums, squares = own[:2], own[2 : 2 + 2 * d].reshape(2, d), own[2 + 2 * d :]
            centres = open_[name]
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
            if ((new - centres) ** 2).sum(axis=1).max() <= tolerance**2 or turn == rounds - 1:
                done[name] = (centres, counts, sums, squares)
                del open_[name]
            else:
                open_[name] = new
        if not open_:
            break
    return done


def grow(
    points: DataFrame, k: int, seed: int = 42, rounds: int = 30, tolerance: float = 1e-9
) -> Tree:
    """The tree with k leaves over all rows of `points`, a stored table (key, x).

    Fewer leaves if no leaf with different rows is left; no nodes for an empty
    table. The root is node 1; the split with number i (from 0) makes the nodes
    2i + 2 and 2i + 3, the former with the smaller centre, component by component.
    """
    root = _root(points)
    tree = Tree({1: root} if root else {})
    order = 0
    leaves = [root] if root else []
    values = _line_values(points) if root and k > 1 and len(root.mean) == 1 else None
    while leaves and order < k - 1:
        left = k - 1 - order
        ranked = sorted((n for n in leaves if not n.whole), key=lambda n: (-n.cost, n.name))[:left]
        if not ranked:
            break
        wanted = [n for n in ranked if n.centres is None]
        if wanted:
            if values is not None:
                pairs = _line_starts(values, tree, wanted)
            else:
                samples = _samples(points, tree, wanted)
                pairs = {n.name: _start(samples.get(n.name, np.zeros((0, 1))), seed, n.name) for n in wanted}
                pairs = {name: pair for name, pair in pairs.items() if pair is not None}
            done = _fit_pairs(points, tree, pairs, rounds, tolerance) if pairs else {}
            for n in wanted:
                fit = done.get(n.name)
                if fit is None or (fit[1] < 1).any():
                    n.cost = 0.0  # its rows do not come apart
                    continue
                first = sorted((0, 1), key=lambda i: fit[0][i].tolist())
                n.centres = fit[0][first]
                n.halves = [(fit[1][i], fit[2][i], fit[3][i]) for i in first]
        # Split while the costliest leaf has its halves at hand.
        while order < k - 1:
            ranked = sorted((n for n in leaves if not n.whole), key=lambda n: (-n.cost, n.name))
            if not ranked or ranked[0].centres is None:
                break
            n = ranked[0]
            n.order, n.children = order, (2 * order + 2, 2 * order + 3)
            made = [_node(c, n.name, *half) for c, half in zip(n.children, n.halves, strict=True)]
            tree.nodes.update({m.name: m for m in made})
            leaves = [m for m in leaves if m is not n] + made
            order += 1
    return tree


def tree_table(tree: Tree, spark) -> DataFrame:
    """Rows (node, parent, split, height, size, depth); split and depth from 0, split NULL for leaves."""
    rows, depth = [], {}
    for name in sorted(tree.nodes):
        n = tree.nodes[name]
        depth[name] = 0 if n.parent is None else depth[n.parent] + 1
        rows.append((n.name, n.parent, n.order, n.cost, n.size, depth[name]))
    schema = "node bigint, parent bigint, split bigint, height double, size bigint, depth bigint"
    return spark.createDataFrame(rows, schema)


def tree_labels(points: DataFrame, tree: Tree, key: str, key_type: str, ks: list[int]) -> DataFrame:
    """(key, k, node) of every row for each k: the node it is in after k - 1 splits."""
    sent = points.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            for k in ks:
                at = sent.value.descend(x, k - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(x), k, np.int32)), pa.array(at)], [key, "k", "node"]
                )

    rows = points.select(F.col("key").alias(key), "x")
    return rows.mapInArrow(place, f"`{key}` {key_type}, k int, node bigint")
