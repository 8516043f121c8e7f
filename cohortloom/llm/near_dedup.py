"""Near-duplicate texts by SetSketch registers on word shingles.

A sketch holds m registers. Every shingle draws one exponentially distributed
value per register, all correlated: the unit of probability is cut into m
intervals, the j-th smallest value of a shingle is drawn from interval j by a
truncated exponential, and goes to the j-th register of the shingle's own
permutation. A register keeps the smallest value it got, on an exponential
scale: K = floor(1 - log_b(minimum)). Registers merge by the maximum, and two
sets agree in a register about as often as their Jaccard similarity.

1. Texts with the same shingle set form a class; its smallest id stands for it.
2. Registers are cut into bands; classes that agree in a whole band are
   candidates. Each is compared with the smallest class of its band (a star, so
   a band of n classes gives n - 1 pairs).
3. A joint likelihood estimate of the similarity from the registers drops pairs
   far below the threshold; the rest are confirmed on their full shingle sets.
4. Confirmed links are joined to components. Texts of different components that
   meet in a band may still be linked. Two such texts can only reach the
   threshold if they share one of their rarest shingles, near enough to the
   front of both lists (the prefix and position bounds of exact set-similarity
   joins). Those pairs are confirmed too, so no link of a band is left out,
   and texts that share a frequent passage but nothing rare make no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.blocks import as_block, blocks, bounded_batches, mix, shingle_sets
from cohortloom.llm.graph import checkpoint, components
from cohortloom.session import materialise

_BASE = 1.001
_MISS = 1e-6
_U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    """Shingle length in words, similarity in hundredths, registers per band.

    The number of bands is the smallest with which a pair at exactly the
    threshold shares no band with a probability below one in a million.
    """

    words: int = 5
    percent: int = 80
    rows: int = 6

    @property
    def bands(self) -> int:
        return math.ceil(math.log(_MISS) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def _odd_prime(m: int) -> int:
    while any(m % d == 0 for d in range(2, math.isqrt(m) + 1)):
        m += 1
    return m


def sketches(hashes: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """Registers (one row of m per set) of consecutive runs of element hashes.

    Values are drawn interval by interval, in ascending order, for all sets at
    once. A set is finished when its lowest register already exceeds whatever
    the next interval could give; that changes no register.
    """
    n = len(counts)
    size = _odd_prime(m)  # a prime size makes start + j * step a permutation
    out = np.zeros((n, size), np.uint16)
    owner = np.repeat(np.arange(n), counts)
    start = (mix(hashes ^ _U64(0xA5A5A5A5A5A5A5A5)) % _U64(size)).astype(np.int64)
    step = (mix(hashes + _U64(0x1F83D9ABFB41BD6B)) % _U64(size - 1)).astype(np.int64) + 1
    limits = np.log1p(np.arange(size) / (size - np.arange(size)))
    scale = 1 / math.log(_BASE)
    seeds = hashes
    flat = out.reshape(-1)
    for j in range(size):
        if not len(seeds):
            break
        draw = (mix(seeds + _U64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> _U64(11)) * 2.0**-53
        width = limits[j + 1] - limits[j] if j + 1 < size else math.inf
        x = limits[j] - np.log1p(-draw * (-math.expm1(-width)))
        # 40,000 places the range of the scale for sets of up to about 10^16 shingles.
        k = np.floor(20001 - np.log(np.maximum(x, 1e-300)) * scale)
        np.maximum.at(flat, owner * size + start, np.clip(k, 1, 65535).astype(np.uint16))
        start += step
        start -= size * (start >= size)
        if j + 1 < size:
            most = math.floor(20001 - math.log(limits[j + 1]) * scale)
            if j % 4 == 3 or j < 4:
                alive = (out.min(axis=1) < most)[owner]
                if not alive.all():
                    seeds, owner, start, step = seeds[alive], owner[alive], start[alive], step[alive]
    return out[:, :m]


def _log_ratio(x: np.ndarray) -> np.ndarray:
    """p_b(x) = -log_b(1 - x (b - 1) / b)."""
    return -np.log1p(-x * (_BASE - 1) / _BASE) / math.log(_BASE)


def joint_similarity(
    a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: int = 400
) -> np.ndarray:
    """Jaccard similarity of pairs of sketches with known set sizes, by maximum likelihood.

    The numbers of registers in which a is larger, smaller and equal follow a
    multinomial law that depends on the similarity only; its likelihood is
    evaluated on a grid up to the largest similarity the sizes allow.
    """
    plus, minus = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - plus - minus
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u / v, v / u)
    best = np.zeros(len(plus))
    most = np.full(len(plus), -np.inf)
    for i in range(grid + 1):
        j = top * i / grid
        p = _log_ratio(np.maximum(u - v * j, 0))
        q = _log_ratio(np.maximum(v - u * j, 0))
        found = (
            plus * np.log(np.maximum(p, 1e-12))
            + minus * np.log(np.maximum(q, 1e-12))
            + same * np.log(np.maximum(1 - p - q, 1e-12))
        )
        better = found > most
        best, most = np.where(better, j, best), np.where(better, found, most)
    return best


def band_keys(found: np.ndarray, how: Settings) -> np.ndarray:
    """One key per band of every sketch. A band's registers are dealt by a fixed shuffle.

    Neighbouring or evenly spaced registers depend on each other in small sets,
    as a set's elements go to registers in steps of their own.
    """
    order = np.random.default_rng(1).permutation(how.registers)
    keys = np.zeros((len(found), how.bands), _U64)
    for r in range(how.rows):
        keys = mix(keys + found[:, order[r :: how.rows]].astype(_U64) + _U64(r + 1))
    return keys ^ mix(np.arange(1, how.bands + 1, dtype=_U64))[None, :]


def sketch_table(docs: DataFrame, key: str, text: str, how: Settings) -> DataFrame:
    """Per row: id, n_shingles, two hashes of the set, band keys and registers."""
    taken = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    m = how.registers
    schema = (
        "id long, n_shingles long, set_a long, set_b long, bands array<long>, registers binary"
    )

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            hashes, counts = shingle_sets(block, how.words)
            found = sketches(hashes, counts, m)
            owner = np.repeat(np.arange(len(block)), counts)
            sums = []
            for salt in (1, 2):
                total = np.zeros(len(block), _U64)
                np.add.at(total, owner, mix(hashes + _U64(salt * 0x632BE59BD9B4E019)))
                sums.append(pa.array(total.view(np.int64)))
            keys = band_keys(found, how)
            # Sets so small that only equal ones reach the threshold need no bands.
            banded = 100 * counts >= how.percent * (counts + 1)
            lists = pa.ListArray.from_arrays(
                np.concatenate(([0], np.cumsum(banded * how.bands))).astype(np.int32),
                pa.array(keys[banded].reshape(-1).view(np.int64)),
            )
            raw = np.ascontiguousarray(found)
            kept = pa.array([raw[i].tobytes() if banded[i] else b"" for i in range(len(block))])
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0), pa.array(counts.astype(np.int64)), *sums, lists, kept],
                ["id", "n_shingles", "set_a", "set_b", "bands", "registers"],
            )

    return taken.mapInArrow(draw, schema)


def _likely(pairs: DataFrame, reps: DataFrame, how: Settings) -> DataFrame:
    """Pairs whose estimated similarity is not far (six deviations) below the threshold."""
    least = how.percent / 100
    least -= 6 * math.sqrt(least * (1 - least) / how.registers)
    one = reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    two = reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = [
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(
                    batch.num_rows, -1
                )
                for i in (4, 5)
            ]
            n = [batch.column(i).to_numpy() for i in (2, 3)]
            good = joint_similarity(r[0], r[1], n[0], n[1]) >= least
            yield batch.select([0, 1]).filter(pa.array(good))

    return joined.mapInArrow(judge, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, how: Settings) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold; each pair row holds two texts."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (x.rows for x in blocks(batches, "text_a")):
            h_a, c_a = shingle_sets(as_block(rows, "text_a"), how.words)
            h_b, c_b = shingle_sets(as_block(rows, "text_b"), how.words)
            at_a = np.concatenate(([0], np.cumsum(c_a)))
            at_b = np.concatenate(([0], np.cumsum(c_b)))
            good = np.zeros(rows.num_rows, bool)
            for i in range(rows.num_rows):
                both = np.concatenate((h_a[at_a[i] : at_a[i + 1]], h_b[at_b[i] : at_b[i + 1]]))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good[i] = shared and 100 * shared >= how.percent * (len(both) - shared)
            yield rows.select([0, 1]).filter(pa.array(good))

    return joined.mapInArrow(confirm, "a long, b long")


def _rare_pairs(open_ids: DataFrame, texts: DataFrame, how: Settings) -> DataFrame:
    """Pairs of open ids in different components that share one of their rarest shingles.

    `open_ids` has id and component. How often a shingle occurs is counted
    among the open texts; any order that is the same for all would be right.
    Every text of an id has its own ranks.
    """
    schema = "id long, mark long, n long, shingle long"

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            hashes, counts = shingle_sets(block, how.words)
            owner = pa.array(np.repeat(np.arange(len(block)), counts))
            yield pa.RecordBatch.from_arrays(
                [
                    *(block.rows.column(c).take(owner) for c in (0, 1)),
                    pa.array(np.repeat(counts, counts).astype(np.int64)),
                    pa.array(hashes.view(np.int64)),
                ],
                ["id", "mark", "n", "shingle"],
            )

    found = texts.join(open_ids.select("id"), "id", "left_semi").select("id", "mark", "text")
    found = materialise(found.mapInArrow(explode, schema), "open-shingles")
    often = found.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1")
    ranked = found.join(often, "shingle", "left").fillna(1, ["often"])
    order = Window.partitionBy("id", "mark").orderBy("often", "shingle")
    ranked = ranked.withColumn("place", F.row_number().over(order)).join(open_ids, "id")
    needed = F.floor((F.col("n") * how.percent + 99) / 100)
    rare = ranked.filter((F.col("place") <= F.col("n") - needed + 1) & (F.col("often") > 1))
    rare = materialise(rare.select("shingle", "id", "n", "place", "component"), "rare-shingles")
    one, two = rare.alias("x"), rare.alias("y")
    # Of the first shingle they share, no more than these can still be common.
    ahead = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    pairs = one.join(
        two,
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.col("x.id") < F.col("y.id"))
        & (100 * F.least("x.n", "y.n") >= how.percent * F.greatest("x.n", "y.n"))
        & ((100 + how.percent) * ahead >= how.percent * (F.col("x.n") + F.col("y.n"))),
    )
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _open_bands(shared: DataFrame, links: DataFrame) -> DataFrame:
    """(key, id, n, component) of the bands in which different components still meet."""
    parts = components(links)
    placed = shared.select("key", "id", "n").join(parts, "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    placed = checkpoint(placed)
    mixed = placed.groupBy("key").agg(
        F.min("component").alias("first"), F.max("component").alias("last")
    )
    mixed = mixed.filter("first <> last").select("key")
    return placed.join(mixed, "key", "left_semi")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    how: Settings = Settings(),  # noqa: B008
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    The component is the smallest id reachable over links of at least
    `how.percent` hundredths similarity; `kept` is true for that id. NULL, empty
    and blank texts have no shingles and are linked with nothing. Rows with one
    id and equal texts are both returned; of one id with several texts each
    text is its own set, and the id joins their components. A NULL id is linked
    with nothing: its component is NULL and it is kept. An empty table gives no
    row. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    table = materialise(sketch_table(docs, key, text, how), "sketches")
    named = table.filter("id IS NOT NULL AND n_shingles > 0")
    per_class = named.groupBy("n_shingles", "set_a", "set_b").agg(F.min("id").alias("rep"))
    # One class per (id, set): the class of a text is found again by its set's hashes.
    members = named.join(per_class, ["n_shingles", "set_a", "set_b"])
    reps = materialise(
        members.filter("id = rep")
        .dropDuplicates(["id", "n_shingles", "set_a", "set_b"])
        .select("id", F.col("n_shingles").alias("n"), "bands", "registers"),
        "classes",
    )
    keyed = reps.filter(F.size("bands") > 0).select(
        "id", "n", F.posexplode("bands").alias("band", "key")
    )
    keyed = keyed.select("id", "n", "key")
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"))
    shared = materialise(keyed.join(hubs.filter("hub <> last"), "key").drop("last"), "shared-bands")
    small = reps.select("id", "n", "registers")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    wanted = shared.select("id").distinct()
    # An id may have several texts: each is compared, and a link of any is one of the id.
    texts = texts.join(wanted, "id", "left_semi").withColumn("mark", F.xxhash64("text"))
    texts = materialise(texts.dropDuplicates(["id", "mark"]), "candidate-texts")
    star = shared.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    tried = checkpoint(star.distinct())
    links = checkpoint(_confirmed(_likely(tried, small, how), texts, how))
    open_ids = _open_bands(shared, links).select("id", "component").distinct()
    across = _rare_pairs(checkpoint(open_ids), texts, how).join(tried, ["a", "b"], "left_anti")
    more = _confirmed(_likely(checkpoint(across), small, how), texts, how)
    tied = members.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    found = components(links.union(more).union(tied))
    return (
        table.select("id", "n_shingles")
        .join(found, "id", "left")
        .select(
            F.col("id").alias(key),
            "n_shingles",
            F.coalesce("component", "id").alias("component_id"),
            (F.col("component").isNull() | (F.col("component") == F.col("id"))).alias("kept"),
        )
    )
