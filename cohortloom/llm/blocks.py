"""Texts of an Arrow column as numpy arrays, in blocks of bounded size.

Every operator that reads whole texts in Python goes through these helpers. A
block is a run of rows whose texts together hold at most `max_bytes` bytes (one
longer text is a block of its own), so the memory of a task depends on the
block size and on the longest single text, never on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BLOCK_BYTES = 512 << 10

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"base": np.ones(1, _U64), "inverse": np.ones(1, _U64)}

# Bytes 9 to 13 and 32 end a word; so does the line end that closes every text.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

# Lower case for A to Z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Everything in ASCII but letters and digits; bytes of longer characters count as letters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[48:58] = PUNCTUATION[65:91] = PUNCTUATION[97:123] = PUNCTUATION[128:] = False


def bounded_batches(spark: SparkSession, rows: int = 2048, size: str = "4m") -> None:
    """Bound the Arrow batches that Python workers get, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@dataclass
class Block:
    """Rows of a batch and their texts, one after the other, each closed by a line end.

    Text i is `data[offsets[i]:offsets[i + 1] - 1]`. A null text is empty.
    """

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1] - 1].tobytes()


def as_block(rows: pa.RecordBatch, column: str = "text") -> Block:
    texts = rows.column(rows.schema.get_field_index(column))
    return Block(rows, *flat_texts(texts))


def flat_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, each closed by a line end, and where each begins."""
    empty, line_end = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
    whole = pc.fill_null(texts.cast(pa.large_string()), empty)
    closed = pc.binary_join_element_wise(whole, empty, line_end)
    _, offsets, data = closed.buffers()
    where = np.frombuffer(offsets, np.int64, len(closed) + 1, closed.offset * 8)
    if data is None or not len(closed):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[where[0] : where[-1]], where - where[0]


def slices(texts: pa.Array, rows: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of a sample, a few texts at a time, to bound the memory of fits."""
    for start in range(0, len(texts), rows):
        yield start, *flat_texts(texts.slice(start, rows))


def blocks(
    batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = BLOCK_BYTES
) -> Iterator[Block]:
    """Blocks of the batches' rows, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes + 1)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield as_block(batch.slice(start, stop - start), column)
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (shifts and odd multipliers)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x = x * _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    table = _powers[name]
    if len(table) < n:
        size = max(n, 1 << 16)
        table = np.cumprod(np.full(size, base, _U64)) * _U64(pow(base, -1, 1 << 64))
        _powers[name] = table
    return table[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every span, in time linear in the data."""
    n = len(data)
    values = data.astype(_U64)
    values += _U64(1)
    values *= _power_table("base", _BASE, n)
    sums = np.empty(n + 1, _U64)
    sums[0] = 0
    np.cumsum(values, out=sums[1:])
    inverse = _power_table("inverse", _INVERSE, max(n, 1))
    starts = np.asarray(starts)
    raw = (sums[ends] - sums[starts]) * inverse[np.minimum(starts, max(n - 1, 0))]
    return mix(raw + (np.asarray(ends) - starts).astype(_U64) * _U64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word; words never cross texts, as a line end closes each."""
    inside = ~separator[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def counts_per_text(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """How many of the ascending positions lie in each text."""
    return np.diff(np.searchsorted(positions, offsets))


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count c, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of every text, ascending in each, and the counts.

    Words are runs of anything but ASCII white space, after lowering A to Z. A
    text with fewer words has its whole sequence as its only shingle.
    """
    data = LOWER[block.data]
    starts, ends = word_spans(data)
    words = span_hashes(data, starts, ends)
    per_text = counts_per_text(block.offsets, starts)
    n_shingles = np.where(per_text == 0, 0, np.maximum(per_text - k + 1, 1))
    first = np.repeat(np.cumsum(per_text) - per_text, n_shingles) + ranges(n_shingles)
    hashes = np.zeros(len(first), _U64)
    short = np.repeat(per_text, n_shingles)
    for i in range(k):
        have = i < short
        at = np.minimum(first + i, len(words) - 1)
        hashes = np.where(have, mix(hashes + words[at] * _U64(2 * i + 3) + _U64(i + 1)), hashes)
    bounds = np.concatenate(([0], np.cumsum(n_shingles)))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[bounds[:-1][n_shingles > 0]] = True
    owner = np.repeat(np.arange(len(block)), n_shingles)
    return hashes[keep], np.bincount(owner[keep], minlength=len(block))
