"""k-means for many k, restarts and spaces at once: one pass over the rows per round.

All centre sets are compared with a row while it is at hand. A task adds up counts,
sums, squares and costs of its rows for every centre; only these few numbers are
shuffled. Sets that have settled take no part in later rounds.

Starts come from a bounded sample on the driver (k-means++ and rounds on the sample),
so the rounds over all rows only refine them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a space that are fetched for the starts, and starts tried on them.
SAMPLE_ROWS = 4_096
SAMPLE_STARTS = 4
SAMPLE_ROUNDS = 25


@dataclass
class CentreSet:
    """Centres of one space, and the sums over the rows nearest to each of them."""

    space: str
    centres: np.ndarray
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sums: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    squares: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cost: float = math.inf
    settled: bool = False

    @property
    def k(self) -> int:
        return len(self.centres)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of doubles as rows of a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), values.size // max(len(column), 1))


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    far = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)
    return np.maximum(far, 0.0)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = squared_distances(x, centres)
    near = far.argmin(axis=1)
    return near, far[np.arange(len(x)), near]


def group_sums(x: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of squared lengths of the rows of each group."""
    member = np.zeros((len(x), k))
    member[np.arange(len(x)), group] = 1.0
    return member.sum(axis=0), member.T @ x, member.T @ (x * x).sum(axis=1)


def sample_rows(points: DataFrame, space: str, n: int, total: int) -> np.ndarray:
    """About n rows of a space (all, if fewer), chosen by the hash of their key; never over 2n."""
    steps = 1 << 40
    keep = min(steps, math.ceil(n / max(total, 1) * steps))
    chosen = points.filter((F.col("space") == space) & (F.pmod(F.xxhash64("key"), F.lit(steps)) < keep))
    found = chosen.select("x").limit(2 * n).toArrow().column(0).combine_chunks()
    return matrix(found)


def spread_starts(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each chosen with a probability in proportion to its squared distance from those before."""
    chosen = [x[rng.integers(len(x))]]
    far = ((x - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and far.sum() > 0:
        chosen.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def settle(x: np.ndarray, centres: np.ndarray, rounds: int = SAMPLE_ROUNDS) -> tuple[np.ndarray, float]:
    """Centres after rounds on the rows at hand, and their cost."""
    for _ in range(rounds):
        near, far = nearest(x, centres)
        counts, sums, _ = group_sums(x, near, len(centres))
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if np.array_equal(new, centres):
            break
        centres = new
    return centres, float(nearest(x, centres)[1].sum())


def starts(x: np.ndarray, k: int, n_init: int, seed: int) -> list[np.ndarray]:
    """The best `n_init` of several starts, by their cost on the sample."""
    rng = np.random.default_rng([seed, k])
    tried = [settle(x, spread_starts(x, k, rng)) for _ in range(max(n_init, SAMPLE_STARTS))]
    tried.sort(key=lambda t: t[1])
    return [centres for centres, _ in tried[:n_init]]


def by_space(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """The rows of a batch (space, x) as a matrix per space."""
    names = np.array(batch.column(0).to_pylist(), dtype=object)
    for space in dict.fromkeys(names):
        own = np.flatnonzero(names == space)
        part = batch if len(own) == len(names) else batch.take(pa.array(own))
        yield space, matrix(part.column(1))


def slots(totals: DataFrame, size: int) -> np.ndarray:
    """Rows (slot, value) of all tasks added up, as an array."""
    whole = np.zeros(size)
    for slot, value in totals.groupBy("slot").agg(F.sum("value")).collect():
        whole[slot] = value
    return whole


def packed(whole: np.ndarray) -> pa.RecordBatch:
    slot = np.flatnonzero(whole)
    return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(whole[slot])], ["slot", "value"])


SLOT_SCHEMA = "slot long, value double"


def one_round(points: DataFrame, sets: Sequence[CentreSet]) -> None:
    """Counts, sums, squares and cost of every set, for its present centres, in one pass."""
    sent = points.sparkSession.sparkContext.broadcast([(s.space, s.centres) for s in sets])
    widths = [s.k * (s.centres.shape[1] + 2) + 1 for s in sets]
    at = np.concatenate(([0], np.cumsum(widths)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(at[-1])
        for batch in batches:
            for space, x in by_space(batch):
                for i, (own, centres) in enumerate(sent.value):
                    if own == space:
                        near, far = nearest(x, centres)
                        counts, sums, squares = group_sums(x, near, len(centres))
                        whole[at[i] : at[i + 1]] += np.concatenate((counts, sums.ravel(), squares, [far.sum()]))
        yield packed(whole)

    whole = slots(points.select("space", "x").mapInArrow(add, SLOT_SCHEMA), int(at[-1]))
    for i, s in enumerate(sets):
        own, d = whole[at[i] : at[i + 1]], s.centres.shape[1]
        s.counts, s.squares, s.cost = own[: s.k], own[s.k * (d + 1) : -1], float(own[-1])
        s.sums = own[s.k : s.k * (d + 1)].reshape(s.k, d)


def lloyd(points: DataFrame, sets: Sequence[CentreSet], rounds: int = 20, tolerance: float = 2e-4) -> int:
    """Move all centres to the means of their rows until a pass gains less than `tolerance` of the cost.

    `points` is a stored table (space, key, x). Returns the number of passes; the
    sums of every set belong to its final centres.
    """
    passes = 0
    open_ = list(sets)
    while open_:
        before = [s.cost for s in open_]
        one_round(points, open_)
        passes += 1
        for s, cost in zip(open_, before, strict=True):
            new = np.where(s.counts[:, None] > 0, s.sums / np.maximum(s.counts, 1)[:, None], s.centres)
            small = cost - s.cost <= tolerance * s.cost if cost < math.inf else False
            s.settled = small or np.array_equal(new, s.centres) or passes >= rounds
            if not s.settled:
                s.centres = new
        open_ = [s for s in open_ if not s.settled]
    return passes


def silhouettes(points: DataFrame, sets: Sequence[CentreSet]) -> list[float]:
    """The mean silhouette with squared distances of every set, in one pass over all rows.

    The mean squared distance from a row to a cluster follows from the cluster's
    sums. A row alone in its cluster counts 0; one cluster only has 0.
    """
    sent = points.sparkSession.sparkContext.broadcast(
        [(s.space, s.centres, s.counts, s.sums, s.squares) for s in sets]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(len(sent.value))
        for batch in batches:
            for space, x in by_space(batch):
                for i, (own, centres, counts, sums, squares) in enumerate(sent.value):
                    used = np.flatnonzero(counts > 0)
                    if own != space or len(used) < 2:
                        continue
                    near = nearest(x, centres)[0]
                    n = counts[used]
                    length = (x * x).sum(axis=1)[:, None]
                    total = np.maximum(length * n - 2 * (x @ sums[used].T) + squares[used], 0.0)
                    mine = near[:, None] == used
                    inside = (total * mine).sum(axis=1) / np.maximum(counts[near] - 1, 1)
                    outside = np.where(mine, np.inf, total / n).min(axis=1)
                    widest = np.maximum(inside, outside)
                    width = np.where(widest > 0, (outside - inside) / np.where(widest > 0, widest, 1), 0.0)
                    whole[i] += width[counts[near] > 1].sum()
        yield packed(whole)

    whole = slots(points.select("space", "x").mapInArrow(score, SLOT_SCHEMA), len(sets))
    return [float(total / max(s.counts.sum(), 1)) for total, s in zip(whole, sets, strict=True)]


def label(points: DataFrame, centres: np.ndarray, key: str, key_type: str, output: str = "cluster") -> DataFrame:
    """(key, cluster) of every row by its nearest centre; ties go to the smaller number."""
    sent = points.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = nearest(matrix(batch.column(1)), sent.value)[0] if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32))], [key, output])

    rows = points.select(F.col("key").alias(key), "x")
    return rows.mapInArrow(place, f"`{key}` {key_type}, `{output}` int")


def fit_sets(
    points: DataFrame, spaces: Sequence[str], ks: Iterable[int], n_init: int, seed: int
) -> dict[tuple[str, int], CentreSet]:
    """By space and k, the cheapest of `n_init` fits; all are fitted together."""
    totals = {r["space"]: r["count"] for r in points.groupBy("space").count().collect()}
    sets = []
    for space in spaces:
        if not totals.get(space):
            continue
        x = sample_rows(points, space, SAMPLE_ROWS, totals[space])
        sets += [(k, CentreSet(space, c)) for k in ks for c in starts(x, k, n_init, seed)]
    lloyd(points, [s for _, s in sets])
    best: dict[tuple[str, int], CentreSet] = {}
    for k, s in sets:
        if (s.space, k) not in best or s.cost < best[s.space, k].cost:
            best[s.space, k] = s
    return best
