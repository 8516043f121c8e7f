"""Vector codes from per-part codebooks, fitted on all rows by active-entry Lloyd rounds.

Components become integers, vectors are cut into equal consecutive parts, and
every part position has a codebook. All distances are integers and exact, so the
result does not depend on how the rows are dealt.

A round is one pass over a stored table that holds, for every vector, its integers,
its assigned entries and their exact distances. A part whose entry did not move
since the last round still has its stored distance, and no entry that stayed can
have become better: only the entries that moved are compared with it. A part whose
entry moved is compared with all. Every task adds one row with its own sums and
counts to the table it writes, so the next codebooks come from those few rows, with
no second pass and no shuffle of vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.attach import attach
from cohortloom.llm.blocks import bounded_batches
from cohortloom.session import materialise, scratch_path


@dataclass
class Codebooks:
    """One array (entries, width) of integers per part position."""

    parts: list[np.ndarray]

    def sha256(self) -> str:
        """Of all components by part, entry and position, as decimal numbers joined by commas."""
        numbers = (str(v) for part in self.parts for v in part.ravel().tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def finite(vector: Column) -> Column:
    """Not NULL, and no component NULL or not finite."""
    whole = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vector.isNotNull() & whole


def cuts(size: int, parts: int) -> list[int]:
    return [i * size // parts for i in range(parts + 1)]


def limit(size: int) -> int:
    """The largest integer whose squared distances add up within 62 bits for `size` components."""
    return min(math.isqrt((1 << 62) // max(size, 1)) // 2, (1 << 31) - 1)


def to_integers(x: np.ndarray, scale: float) -> np.ndarray:
    most = limit(x.shape[1])
    return np.clip(np.floor(x * scale), -most, most).astype(np.int64)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of integer rows, exact."""
    largest = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * int(largest) ** 2 * max(x.shape[1], 1) < 1 << 53:
        a, b = x.astype(float), entries.astype(float)
        far = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
        return far.astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def rescan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every row, the lower index at equal distances, and its distance."""
    far = distances(x, entries)
    near = far.argmin(axis=1)
    return near, far[np.arange(len(x)), near]


def reassign(
    x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, far: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """New codes and distances, and the number of comparisons, from the former ones.

    `moved` marks the entries that differ from those that `code` and `far` hold for.
    """
    code, far = code.copy(), far.copy()
    active = np.flatnonzero(moved)
    if not len(active):
        return code, far, 0
    lost = moved[code]
    again, stay = np.flatnonzero(lost), np.flatnonzero(~lost)
    if len(again):
        code[again], far[again] = rescan(x[again], entries)
    if len(stay):
        near, best = rescan(x[stay], entries[active])
        near = active[near]
        better = (best < far[stay]) | ((best == far[stay]) & (near < code[stay]))
        code[stay[better]], far[stay[better]] = near[better], best[better]
    return code, far, len(again) * len(entries) + len(stay) * len(active)


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return values.reshape(len(column), -1)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel(), kind))


_STATE = (
    T.StructField("__ints", T.ArrayType(T.IntegerType())),
    T.StructField("__codes", T.ArrayType(T.IntegerType())),
    T.StructField("__far", T.ArrayType(T.LongType())),
    T.StructField("__sums", T.BinaryType()),
)


def _pass(
    rows: DataFrame, books: Codebooks, moved: list[np.ndarray] | None, size: int, scale: float
) -> DataFrame:
    """Rows with codes and distances for `books`, and one row of sums per task.

    With `moved` the rows come from the pass before; without, they hold `__vec`.
    """
    at = cuts(size, len(books.parts))
    carried = [f for f in rows.schema if not f.name.startswith("__")]
    schema = T.StructType([*carried, *_STATE])
    source = ["__vec"] if moved is None else ["__ints", "__codes", "__far"]
    sent = rows.sparkSession.sparkContext.broadcast((books.parts, moved))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, moved = sent.value
        width = len(carried)
        totals = [np.zeros((len(e), e.shape[1] + 1), np.int64) for e in parts]
        kinds = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [c.type for c in batch.columns[:width]]
            if moved is None:
                x = to_integers(_matrix(batch.column(width), float), scale)
                codes = np.zeros((len(x), len(parts)), np.int64)
                far = np.zeros_like(codes)
            else:
                x, codes, far = (_matrix(batch.column(width + i), np.int64) for i in range(3))
                codes, far = codes.copy(), far.copy()
            for p, entries in enumerate(parts):
                own = x[:, at[p] : at[p + 1]]
                if moved is None:
                    codes[:, p], far[:, p] = rescan(own, entries)
                else:
                    codes[:, p], far[:, p], _ = reassign(own, entries, moved[p], codes[:, p], far[:, p])
                np.add.at(totals[p][:, 0], codes[:, p], 1)
                np.add.at(totals[p][:, 1:], codes[:, p], own)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:width],
                    _lists(x, pa.int32()),
                    _lists(codes, pa.int32()),
                    _lists(far, pa.int64()),
                    pa.nulls(len(x), pa.binary()),
                ],
                schema.names,
            )
        if kinds is not None:
            packed = np.concatenate([t.ravel() for t in totals]).tobytes()
            empty = [pa.nulls(1, k) for k in kinds]
            empty += [pa.nulls(1, pa.list_(k)) for k in (pa.int32(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([packed], pa.binary())], schema.names)

    read = rows if moved is None else rows.filter("__sums IS NULL")
    return read.select(*(f.name for f in carried), *source).mapInArrow(assign, schema)


def _totals(state: DataFrame, books: Codebooks) -> list[np.ndarray]:
    """Counts and sums of every entry, from the tasks' own rows."""
    length = sum(len(e) * (e.shape[1] + 1) for e in books.parts)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(length, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                whole += np.frombuffer(packed.as_buffer(), np.int64)
        slot = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot), pa.array(whole[slot])], ["slot", "total"]
        )

    few = state.filter("__sums IS NOT NULL").select("__sums").mapInArrow(unfold, "slot long, total long")
    whole = np.zeros(length, np.int64)
    for slot, total in few.groupBy("slot").agg(F.sum("total")).collect():
        whole[slot] = total
    shapes = [(len(e), e.shape[1] + 1) for e in books.parts]
    split = np.cumsum([a * b for a, b in shapes])[:-1]
    return [t.reshape(shape) for t, shape in zip(np.split(whole, split), shapes, strict=True)]


def _updated(books: Codebooks, totals: list[np.ndarray]) -> tuple[Codebooks, list[np.ndarray]]:
    """Floored means of the assigned parts, unused entries as they were; and which entries moved."""
    parts, moved = [], []
    for entries, total in zip(books.parts, totals, strict=True):
        n = total[:, :1]
        new = np.where(n > 0, total[:, 1:] // np.maximum(n, 1), entries)
        parts.append(new)
        moved.append((new != entries).any(axis=1))
    return Codebooks(parts), moved


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    keep: Sequence[str] = (),
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: float = 1024.0,
) -> tuple[DataFrame, Codebooks]:
    """(<key>, <keep>..., code, error) of every vector, and the final codebooks.

    Component x becomes floor(scale * x). The codebooks start as the parts of the
    `entries` vectors with the smallest keys (repeated keys: by vector; NULL keys
    last; all vectors, if fewer). `code` holds the entries' numbers in two hex
    digits each (more where `entries` needs them), `error` the squared distances
    summed over the parts.

    NULL vectors and those with NULL or non-finite components have no row, nor have
    vectors of another than the commonest length (the shorter at a tie). A length
    that `parts` does not divide is cut as evenly as it goes. Repeated rows are rows
    of their own. Scaled components are held within +-2^30 / sqrt(length), so that
    distances stay exact in 64 bits. An empty table gives no rows and no entries.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    vec = F.col(vector).cast("array<double>")
    taken = vectors.select(F.col(key).alias("key"), *(F.col(c).alias(f"k_{c}") for c in keep), vec.alias("__vec"))
    taken = taken.filter(finite(F.col("__vec")))
    sizes = taken.groupBy(F.size("__vec").alias("n")).agg(F.count("*").alias("rows"))
    top = sizes.orderBy(F.desc("rows"), "n").first()
    size = top["n"] if top else 0
    taken = taken.filter(F.size("__vec") == size)
    first = taken.select("key", "__vec").orderBy(F.asc_nulls_last("key"), "__vec").limit(entries).collect()
    start = to_integers(np.array([r["__vec"] for r in first], float).reshape(len(first), size), scale)
    at = cuts(size, parts)
    books = Codebooks([start[:, a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
    moved, state, path = None, taken, None
    for turn in range(rounds + 1):
        written = scratch_path(spark, f"codes-{turn}")
        found = _pass(state, books, moved, size, scale)
        found.write.parquet(written)
        state = spark.read.schema(found.schema).parquet(written)
        if path:
            _remove(spark, path)
        path = written
        if turn < rounds:
            books, moved = _updated(books, _totals(state, books))
    digits = max(2, len(f"{max(entries - 1, 0):x}"))
    code = F.transform("__codes", lambda c: F.lpad(F.lower(F.hex(c)), digits, "0"))
    done = state.filter("__sums IS NULL").select(
        F.col("key").alias(key),
        *(F.col(f"k_{c}").alias(c) for c in keep),
        F.array_join(code, "").alias("code"),
        F.aggregate("__far", F.lit(0).cast("long"), lambda s, x: s + x).alias("error"),
    )
    return done, books


def label_errors(codes: DataFrame, label: str, key: str = "vec_id", name: str = "label_error") -> DataFrame:
    """`codes` with the errors summed over the rows of equal label, NULLs together."""
    sums = codes.groupBy(F.col(label)).agg(F.sum("error").alias(name), F.count("*").alias("__n"))
    return attach(codes, materialise(sums, "label-errors"), label, "__n", F.col(key))
