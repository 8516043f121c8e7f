"""Importance resampling of documents towards a target text, by hashed word runs.

Runs of consecutive words are hashed to buckets. The corpus and the target give
every bucket a gain, the logarithm of how much commoner it is in the target. A
document's weight is the mean gain of its features; a random part (Gumbel noise made
from its key) turns the highest scores into a sample without replacement in
proportion to the weights. Buckets and weights are computed on arrays; ranks come
from `regular_sort`.

CRC sums are linear: the sum of two strings in a row follows from the sums of both
and the length of the second, so a run of words needs no bytes of its own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.blocks import LOWER, PUNCTUATION, Block, blocks, bounded_batches, counts_per_text, word_spans
from cohortloom.llm.regular_sort import exact_ranks
from cohortloom.session import materialise

_POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)
_LOW_BITS = 6
_LONG_WORD = 1 << _LOW_BITS
_WORDS_AT_ONCE = 1 << 17


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1)
    return c


_BYTE = _byte_table()


def _zero_byte(c: np.ndarray) -> np.ndarray:
    return _BYTE[c & 255] ^ (c >> 8)


def _apply(lanes: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map, given by its values for every value of every byte."""
    return lanes[0][c & 255] ^ lanes[1][(c >> 8) & 255] ^ lanes[2][(c >> 16) & 255] ^ lanes[3][c >> 24]


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps for 0..63 zero bytes, and for 64, 128, 256, ... of them."""
    lanes = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    low = [lanes]
    for _ in range(_LONG_WORD):
        low.append(_zero_byte(low[-1]))
    high = [low.pop()]
    while len(high) < 32 - _LOW_BITS:
        high.append(_apply(high[-1], high[-1]))
    return np.stack(low), high


_LOW, _HIGH = _shift_tables()


def shift(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What n further bytes do to sums of what came before them."""
    few = n & (_LONG_WORD - 1)
    c = (
        _LOW[few, 0, c & 255]
        ^ _LOW[few, 1, (c >> 8) & 255]
        ^ _LOW[few, 2, (c >> 16) & 255]
        ^ _LOW[few, 3, c >> 24]
    )
    rest = n >> _LOW_BITS
    for lanes in _HIGH:
        if not rest.any():
            break
        odd = np.flatnonzero(rest & 1)
        c[odd] = _apply(lanes, c[odd])
        rest = rest >> 1
    return c


def crc_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of data[start:end] for every span."""
    lengths = ends - starts
    c = np.full(len(starts), _ONES, np.uint32)
    active = np.flatnonzero((lengths > 0) & (lengths < _LONG_WORD))
    i = 0
    while len(active):
        own = c[active]
        c[active] = _BYTE[(own ^ data[starts[active] + i]) & 255] ^ (own >> 8)
        i += 1
        active = active[lengths[active] > i]
    c ^= _ONES
    for j in np.flatnonzero(lengths >= _LONG_WORD):
        c[j] = zlib.crc32(data[starts[j] : ends[j]])
    return c


def word_runs(block: Block, most: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Words per text; and, a bounded number of words at a time, (text, CRC-32) of all runs of 1 to `most` words.

    Words are runs of digits, letters (A to Z lowered) and all characters beyond
    ASCII; the words of a run are joined by one space.
    """
    data = LOWER[block.data]
    starts, ends = word_spans(data, PUNCTUATION)
    n_words = counts_per_text(block.offsets, starts)

    def runs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        text = np.repeat(np.arange(len(block)), n_words)
        for a in range(0, len(starts), _WORDS_AT_ONCE):
            b = min(a + _WORDS_AT_ONCE, len(starts))
            reach = min(b + most - 1, len(starts))
            single = crc_of_spans(data, starts[a:reach], ends[a:reach])
            length = (ends - starts)[a:reach]
            run, owner = single[: b - a], text[a:b]
            yield owner, run
            for k in range(1, most):
                ahead = np.arange(len(run)) + k
                inside = ahead < reach - a
                ahead, run, owner = ahead[inside], run[inside], owner[inside]
                same = text[a + ahead] == owner
                open_ = run ^ _ONES
                spaced = (_BYTE[(open_ ^ np.uint32(32)) & 255] ^ (open_ >> 8)) ^ _ONES
                run = shift(spaced, length[ahead]) ^ single[ahead]
                # Runs that leave their text stay in place for the next length but do not count.
                yield owner[same], run[same]

    return n_words, runs()


def bucket_counts(texts: DataFrame, text: str = "text", most: int = 2, buckets: int = 10_000) -> np.ndarray:
    """How many word runs of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(buckets, np.int64)
        for block in blocks(batches):
            for _, run in word_runs(block, most)[1]:
                whole += np.bincount(run % np.uint32(buckets), minlength=buckets)
        slot = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(whole[slot])], ["bucket", "n"])

    bounded_batches(texts.sparkSession)
    found = texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long")
    whole = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():
        whole[bucket] = n
    return whole


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of every bucket's smoothed share in the target over that in the corpus."""
    size = len(corpus)
    s_all, t_all = float(corpus.sum() + size), float(target.sum() + size)
    return np.array(
        [
            math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all)))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weighted(docs: DataFrame, gains: np.ndarray, text: str, most: int) -> DataFrame:
    """The rows of `docs` (without `text`) with n_words, n_features and weight."""
    kept = [f for f in docs.schema if f.name != text]
    schema = T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = sent.value
        for block in blocks(batches, text):
            n_words, runs = word_runs(block, most)
            n, total = np.zeros(len(block), np.int64), np.zeros(len(block))
            for owner, run in runs:
                n += np.bincount(owner, minlength=len(block))
                total += np.bincount(owner, gains[run % np.uint32(len(gains))], len(block))
            mean = np.where(n > 0, total.astype(np.int64) // np.maximum(n, 1), 0)
            own = [block.rows.column(block.rows.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*own, *(pa.array(c.astype(np.int64)) for c in (n_words, n, mean))], schema.names
            )

    return docs.select(*(f.name for f in kept), text).mapInArrow(weigh, schema)


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of the digest of `seed:key`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    keep: Sequence[str] = (),
    percent: int = 25,
    least_words: int = 20,
    most: int = 2,
    buckets: int = 10_000,
    seed: int = 7,
) -> DataFrame:
    """(<key>, <keep>..., n_features, weight, score, rank) of every document.

    Of the documents with at least `least_words` words, `percent` in a hundred
    (rounded down) with the highest scores have a rank from 1; ties go to the
    smaller key (a whole number; NULL last), then to fewer features. All others
    have rank NULL. A NULL text, or one without words, has no features and
    weight 0. Repeated rows count, and are drawn, as rows of their own; NULL keys
    share one noise value. Without target text every feature is equally rare
    there; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    gains = bucket_gains(bucket_counts(docs, text, most, buckets), bucket_counts(target, target_text, most, buckets))
    rows = docs.select(F.col(key).alias("__key"), *(F.col(c).alias(f"k_{c}") for c in keep), F.col(text).alias("__text"))
    found = weighted(rows, gains, "__text", most)
    score = F.col("weight") + noise(F.col("__key"), seed)
    found = found.select(
        "*",
        score.alias("score"),
        (F.col("n_words") >= least_words).alias("__enough"),
        (-score).alias("__o1"),
        F.col("__key").isNull().cast("long").alias("__o2"),
        F.coalesce(F.col("__key").cast("long"), F.lit(0)).alias("__o3"),
        F.col("n_features").alias("__o4"),
        F.monotonically_increasing_id().alias("__o5"),
    )
    scored = materialise(found, "scores")
    ranked = exact_ranks(scored, [f"__o{i}" for i in range(1, 6)], "__enough", (percent, 100))
    return ranked.select(
        F.col("__key").alias(key), *(F.col(f"k_{c}").alias(c) for c in keep), "n_features", "weight", "score", "rank"
    )
