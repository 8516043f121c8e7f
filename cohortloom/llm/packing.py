"""Best-fit packing of token pieces into sequences by exact complements.

Only the number of pieces of each length matters for which lengths share a
sequence, and there are at most `capacity` lengths. So the plan is made on that
table of counts, of bounded size whatever the corpus: for every length, longest
first, gaps are filled exactly by one, two or three available lengths, as often
as their counts allow; what is left goes best fit into the tightest open
sequence. The plan gives runs of places to runs of equally long pieces; pieces
are numbered per length with counts per task and a running sum over tasks, and
look up their places. No step gathers rows of one length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from cohortloom.llm.blocks import blocks, bounded_batches
from cohortloom.llm.tokens import encoder
from cohortloom.session import materialise


@dataclass
class Plan:
    """Runs of places: pieces rank..rank + per * bins - 1 of a length, `per` to a sequence."""

    n_sequences: int = 0
    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)


def _exact(counts: np.ndarray, capacity: int):
    """Yield (lengths, times) whose lengths sum to the capacity, consuming `counts`."""
    sums, stale = None, 0

    def pair(total):
        a = np.flatnonzero(counts[:total] > 0)
        a = a[a * 2 >= total]
        a = a[counts[total - a] > (a * 2 == total)]
        return (int(a[-1]), int(total - a[-1])) if len(a) else None

    def triple(total):
        nonlocal sums, stale
        if sums is None or stale > 64:
            have = (counts > 0).astype(np.float32)
            sums = np.convolve(have, have)[: capacity + 1] > 0.5
            stale = 0
        a = np.flatnonzero(counts[:total] > 0)
        a = a[sums[total - a]]
        for x in a[::-1]:
            counts[x] -= 1
            found = pair(int(total - x))
            counts[x] += 1
            if found:
                return (int(x), *found)
        return None

    for length in range(capacity, 0, -1):
        while counts[length] > 0:
            gap = capacity - length
            counts[length] -= 1
            if gap == 0:
                rest = ()
            elif counts[gap] > 0:
                rest = (gap,)
            else:
                rest = pair(gap) or triple(gap)
            counts[length] += 1
            if rest is None:
                break
            lengths = (length, *rest)
            kinds, each = np.unique(lengths, return_counts=True)
            times = int((counts[kinds] // each).min())
            counts[kinds] -= each * times
            stale += int((counts[kinds] == 0).sum())
            yield lengths, times


def _best_fit(counts: np.ndarray, capacity: int):
    """Yield (lengths, times) for what is left: best fit, longest first, over counts."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps = np.zeros(capacity + 1, bool)

    def put(gap, pattern, times):
        if times:
            open_bins.setdefault(gap, []).append((pattern, times))
            gaps[gap] = True

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            fitting = np.flatnonzero(gaps[length:])
            if len(fitting):
                gap = int(fitting[0]) + length
                pattern, times = open_bins[gap].pop()
                if not open_bins[gap]:
                    gaps[gap] = False
                used = min(left, times)
                put(gap, pattern, times - used)
                put(gap - length, (*pattern, length), used)
                left -= used
            else:
                per = capacity // length
                full, rest = divmod(left, per)
                put(capacity - per * length, (length,) * per, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                left = 0
        counts[length] = 0
    for groups in open_bins.values():
        yield from groups


def plan_lengths(counts: np.ndarray, capacity: int) -> Plan:
    """Which lengths share sequences; counts[n] is the number of pieces of n tokens."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros(capacity + 1, np.int64)
    plan = Plan()
    for source in (_exact, _best_fit):
        for lengths, times in source(left, capacity):
            offset = 0
            for length in dict.fromkeys(lengths):
                per = lengths.count(length)
                plan.length.append(length)
                plan.rank.append(int(used[length]))
                plan.per.append(per)
                plan.sequence.append(plan.n_sequences)
                plan.offset.append(offset)
                used[length] += per * times
                offset += per * length
            plan.n_sequences += times
    return plan


def token_pieces(
    docs: DataFrame, key: str, text: str, path: str, capacity: int, end_id: int, with_ids: bool
) -> DataFrame:
    """Pieces of all texts: key, piece, start, length, ids_crc32, chunk, place and, if asked, ids.

    `chunk` is the task and `place` the number of the piece among those of its
    length in the task, so that ranks need no gathering.
    """
    taken = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    fields = [
        StructField(key, taken.schema["__key"].dataType),
        StructField("piece", IntegerType()),
        StructField("start", LongType()),
        StructField("length", LongType()),
        StructField("ids_crc32", LongType()),
        StructField("chunk", IntegerType()),
        StructField("place", LongType()),
    ]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        chunk = TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        closing = np.array([end_id], "<u4")
        for block in blocks(batches, "__text"):
            ids, counts = words.encode_block(block)
            ids = ids.astype("<u4")
            at = np.concatenate(([0], np.cumsum(counts)))
            owner, piece, start, length, crc, place, parts = [], [], [], [], [], [], []
            for i in range(len(block)):
                own = np.concatenate((ids[at[i] : at[i + 1]], closing))
                for number, begin in enumerate(range(0, len(own), capacity)):
                    part = own[begin : begin + capacity]
                    owner.append(i)
                    piece.append(number)
                    start.append(begin)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    place.append(int(met[len(part)]))
                    met[len(part)] += 1
                    parts.append(part.astype(np.int32))
            columns = [
                block.rows.column(0).take(pa.array(owner, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array([chunk] * len(owner), pa.int32()),
                pa.array(place, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return taken.mapInArrow(cut, StructType(fields))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 4096,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A text becomes its token ids and `end_id`; a NULL or empty text is the end
    alone. Texts of more than `capacity` ids are cut into pieces of `capacity`,
    the last one shorter; others stay whole. Repeated rows and NULL keys are
    packed like any other. An empty table gives no row. Columns of docs other
    than the key and the text do not appear.
    """
    bounded_batches(docs.sparkSession)
    pieces = materialise(
        token_pieces(docs, key, text, tokenizer_path, capacity, end_id, with_ids), "pieces"
    )
    per_chunk = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    per_chunk = materialise(per_chunk, "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    plan = plan_lengths(counts, capacity)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_chunk.select(
        F.col("chunk").alias("__chunk"),
        F.col("length").alias("__length"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"),
    )
    ranked = pieces.join(
        bases,
        (F.col("chunk") == F.col("__chunk")) & (F.col("length") == F.col("__length")),
    )
    shown = [c for c in pieces.columns if c not in ("chunk", "place")]
    ranked = ranked.select(*shown, (F.col("__base") + F.col("place")).alias("__rank"))
    return _placed(ranked, shown, plan)


def _placed(ranked: DataFrame, shown: list[str], plan: Plan) -> DataFrame:
    columns = [np.array(x, np.int64) for x in (plan.length, plan.rank, plan.per, plan.sequence, plan.offset)]
    order = np.lexsort((columns[1], columns[0]))
    sent = ranked.sparkSession.sparkContext.broadcast([x[order] for x in columns])
    schema = StructType(
        [
            *(ranked.schema[c] for c in shown),
            StructField("sequence_id", LongType()),
            StructField("offset", LongType()),
        ]
    )
    at_length, at_rank = shown.index("length"), len(shown)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, per, sequence, offset = sent.value
        run_keys = (length << 48) + rank  # ranks stay below 2^48
        for batch in batches:
            n = batch.column(at_length).to_numpy()
            own = batch.column(at_rank).to_numpy()
            run = np.searchsorted(run_keys, (n << 48) + own, "right") - 1
            ahead = own - rank[run]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(at_rank)),
                    pa.array(sequence[run] + ahead // per[run]),
                    pa.array(offset[run] + ahead % per[run] * n),
                ],
                schema.names,
            )

    return ranked.mapInArrow(place, schema)
