"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping windows (a short item is one window).
A window of m characters found with at most k edits shares at least
m + 1 - q * (k + 1) of its character q-grams with the place, all of them on
diagonals (place in the text minus place in the window) that differ by at most
2k. So shared q-grams are counted in diagonal bands, each twice as wide as that
and overlapping the next by half; bands that reach the bound are regions, and
each is verified by an alignment within the band.

Texts are compared in a plain form: letters in lower case, every run of white
space and punctuation one blank. Reported places are code points of the original.

Short windows take shorter q-grams, as long as the bound stays at least one, so no
match within the edits is lost at any length. Windows overlap by half: an unchanged
excerpt of `excerpt` plain characters or more lies in one of them with all its
q-grams, so its region is found too. Regions that fail the alignment as a whole are
looked through for such an unchanged run. (Excerpts with edits are found only where
they cover a window.)

The benchmark is the stated query set. It is taken in blocks of bounded size,
and every block passes over all texts; texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from cohortloom.llm.blocks import as_block, blocks, bounded_batches, ranges, span_hashes

HIT = StructType(
    [
        StructField("item_id", LongType()),
        StructField("start", LongType()),
        StructField("end", LongType()),
        StructField("edits", IntegerType()),
    ]
)
_FILTER_BITS = 22


@dataclass(frozen=True)
class Settings:
    """q-gram length, edits per hundred characters, window length and step, in characters.

    An item is found in part from `excerpt` unchanged characters on; that needs
    excerpt <= window - step + 1.
    """

    q: int = 8
    percent: int = 10
    window: int = 120
    step: int = 60
    excerpt: int = 60
    block_chars: int = 2_000_000

    def edits(self, m):
        return m * self.percent // 100

    def gram(self, m: int) -> int:
        """The longest q-gram up to `q` for which a window of m characters has a bound of one or more."""
        return max(min(self.q, m // (self.edits(m) + 1)), 1)

    def bound(self, m, q):
        return m + 1 - q * (self.edits(m) + 1)


def _apart_table() -> np.ndarray:
    """Which code points up to U+30FF are white space or punctuation; later ones are letters."""
    apart = np.zeros(0x3100, bool)
    for c in range(0x3100):
        apart[c] = not chr(c).isalnum() and not 0x300 <= c < 0x370
    return apart


_APART = _apart_table()


def _lowered(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Plain code points of all texts, where each begins, their original places, and the originals' begins."""
    first = (data & 0xC0) != 0x80
    begins = np.concatenate(([0], np.cumsum(first)))[offsets]
    chars = np.frombuffer(_lowered(data.tobytes().decode("utf-8", "replace")).encode("utf-32-le"), np.uint32)
    apart = _APART[np.minimum(chars, 0x30FF)] & (chars < 0x3100)
    keep = ~apart
    keep[1:] |= apart[1:] & ~apart[:-1]
    at = np.flatnonzero(keep)
    small = np.where(apart[at], np.uint32(32), chars[at])
    return small, np.searchsorted(at, begins), at, begins


@dataclass
class Index:
    """The windows of one block of the benchmark that take q-grams of one length, and these, sorted by hash."""

    q: int
    items: np.ndarray
    windows: list[np.ndarray]
    sizes: np.ndarray
    hashes: np.ndarray
    window_of: np.ndarray
    place_of: np.ndarray
    maybe: np.ndarray


def _low_bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)


def index(item_ids: Sequence[int], texts: Sequence[str | None], how: Settings) -> list[Index]:
    """One index for every length of q-grams. Items shorter than `q` plain characters cannot be found."""
    by_gram: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, text in zip(item_ids, texts, strict=True):
        block = as_block(pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"]))
        small = plain(block.data, block.offsets)[0]
        while len(small) and small[-1] == 32:
            small = small[:-1]
        small = small[1:] if len(small) and small[0] == 32 else small
        last = max(len(small) - how.window, 0)
        for start in [*range(0, last, how.step), last]:
            part = small[start : start + how.window]
            if len(part) >= how.q:
                by_gram.setdefault(how.gram(len(part)), []).append((item, part))
    return [_index(q, *zip(*found, strict=True)) for q, found in sorted(by_gram.items())]


def _index(q: int, items: Sequence[int], windows: Sequence[np.ndarray]) -> Index:
    hashes, window_of, place_of = [], [], []
    for i, part in enumerate(windows):
        starts = np.arange(len(part) - q + 1)
        hashes.append(span_hashes(part, starts, starts + q))
        window_of.append(np.full(len(starts), i))
        place_of.append(starts)
    hashes = np.concatenate(hashes)
    order = np.argsort(hashes, kind="stable")
    maybe = np.zeros(1 << _FILTER_BITS, bool)
    maybe[_low_bits(hashes)] = True
    return Index(
        q,
        np.array(items),
        list(windows),
        np.array([len(x) for x in windows]),
        hashes[order],
        np.concatenate(window_of)[order],
        np.concatenate(place_of)[order],
        maybe,
    )


def regions(found: Index, small: np.ndarray, at_text: np.ndarray, how: Settings):
    """(text, window, first diagonal) of every band with enough shared q-grams."""
    n = len(small) - found.q + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    starts = np.arange(n)
    hashes = span_hashes(small, starts, starts + found.q)
    here = np.flatnonzero(found.maybe[_low_bits(hashes)])
    hashes = hashes[here]
    low = np.searchsorted(found.hashes, hashes)
    times = np.searchsorted(found.hashes, hashes, "right") - low
    text = np.searchsorted(at_text, here, "right") - 1
    times[here + found.q > at_text[text + 1]] = 0
    entry = np.repeat(low, times) + ranges(times)
    window = found.window_of[entry]
    text = np.repeat(text, times)
    diagonal = np.repeat(here, times) - found.place_of[entry] - at_text[text]
    step = 2 * how.edits(found.sizes[window]) + 1
    band = diagonal // step
    # A window starts at most `window` places before its text; shift bands to be positive.
    shift = how.window + 2
    span = int(band.max(initial=0)) + shift + 2
    key = (text * len(found.windows) + window) * span + band + shift
    keys, counts = np.unique(np.concatenate((key, key - 1)), return_counts=True)
    pair = keys // span
    text, window = pair // len(found.windows), pair % len(found.windows)
    good = counts >= how.bound(found.sizes[window], found.q)
    text, window = text[good], window[good]
    band = (keys % span)[good] - shift
    return text, window, band * (2 * how.edits(found.sizes[window]) + 1)


def align(
    pattern: np.ndarray, texts: np.ndarray, anchor: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits of `pattern` (n, m) against parts of `texts` (n, m + width - 1), and where they end.

    Row i of the table holds, for offsets 0..width-1, the cost of the first i
    pattern characters ending at place i + offset. A match may start anywhere,
    or at place `anchor` only.
    """
    n, m = pattern.shape
    width = texts.shape[1] - m + 1
    steps = np.arange(width)
    cost = np.zeros((n, width), np.int32)
    if anchor is not None:
        cost[:] = np.where(steps >= anchor, steps - anchor, 2 * (m + width))
    for i in range(m):
        kept = cost + (texts[:, i : i + width] != pattern[:, i : i + 1])
        kept[:, :-1] = np.minimum(kept[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(kept - steps, axis=1) + steps
    best = cost.argmin(axis=1)
    return cost[np.arange(n), best], best + m


def unchanged(patterns: np.ndarray, texts: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(row, start, end) in `texts` of the longest runs, `least` characters or more, equal on one diagonal.

    Row i of `patterns` (n, m) is laid at every place of row i of `texts`; per row
    the run of the first such place counts.
    """
    n, m = patterns.shape
    width = texts.shape[1] - m + 1
    where = np.full((n, 2), -1)
    for offset in range(width):
        open_ = np.flatnonzero(where[:, 0] < 0)
        differs = texts[open_, offset : offset + m] != patterns[open_]
        sums = np.concatenate((np.zeros((len(open_), 1), np.int32), np.cumsum(differs, axis=1, dtype=np.int32)), axis=1)
        clean = sums[:, least:] == sums[:, :-least]
        hit = np.flatnonzero(clean.any(axis=1))
        if len(hit):
            first = clean[hit].argmax(axis=1)
            rest = differs[hit] & (np.arange(m) >= first[:, None])
            stop = np.where(rest.any(axis=1), rest.argmax(axis=1), m)
            where[open_[hit]] = np.stack((offset + first, offset + stop), axis=1)
    rows = np.flatnonzero(where[:, 0] >= 0)
    return rows, where[rows, 0], where[rows, 1]


def verified(found: Index, small, at_text, text, window, diagonal, how: Settings):
    """Of the regions, (text, window, start, end, edits) in plain places; others are dropped."""
    out = []
    size = found.sizes[window]
    for m in np.unique(size):
        own = np.flatnonzero(size == m)
        k = int(how.edits(int(m)))
        width = 2 * (2 * k + 1) + 2 * k
        for part in np.array_split(own, math.ceil(len(own) / 512)):
            base = diagonal[part] - k
            begin, end = at_text[text[part]], at_text[text[part] + 1]
            place = base[:, None] + np.arange(m + width - 1)
            inside = (place >= 0) & (place < (end - begin)[:, None])
            absolute = np.where(inside, begin[:, None] + place, 0)
            texts = np.where(inside, small[absolute], np.uint32(0))
            patterns = np.stack([found.windows[w] for w in window[part]])
            edits, stop = align(patterns, texts)
            good = np.flatnonzero(edits <= k)
            failed = np.flatnonzero(edits > k)
            if m >= how.excerpt and len(failed):
                for row, start, stop_at in zip(*unchanged(patterns[failed], texts[failed], how.excerpt), strict=True):
                    j = part[failed[row]]
                    at = int(base[failed[row]])
                    out.append((int(text[j]), int(window[j]), at + int(start), at + int(stop_at), 0))
            if not len(good):
                continue
            # The start: align backwards from the end, with room for k on both sides.
            back = stop[good][:, None] - 1 + k - np.arange(m + 2 * k)
            real = (back >= 0) & (back < stop[good][:, None])
            ahead = np.where(
                real, texts[good][np.arange(len(good))[:, None], np.where(real, back, 0)], np.uint32(0)
            )
            _, reach = align(patterns[good][:, ::-1], ahead, anchor=k)
            for g, length in zip(good, reach - k, strict=True):
                j = part[g]
                finish = int(base[g] + stop[g])
                start = max(finish - int(length), 0)
                out.append((int(text[j]), int(window[j]), start, finish, int(edits[g])))
    return out


def _merged(hits) -> dict[int, list[tuple[int, int, int, int]]]:
    """Overlapping or touching hits of one item in one text are one leak; its edits are the most of a window."""
    by_text: dict[int, list[tuple[int, int, int, int]]] = {}
    for t, item, start, end, edits in sorted(hits):
        own = by_text.setdefault(t, [])
        if own and own[-1][0] == item and start <= own[-1][2] + 1:
            last = own[-1]
            own[-1] = (item, last[1], max(last[2], end), max(last[3], edits))
        else:
            own.append((item, start, end, edits))
    return by_text


def _one_pass(docs: DataFrame, text: str, name: str, found: list[Index], how: Settings) -> DataFrame:
    kept = [c for c in docs.columns if c != name]
    before = F.col(name) if name in docs.columns else F.lit(None).cast(ArrayType(HIT))
    taken = docs.select(*kept, F.col(text).alias("__text"), before.alias("__before"))
    schema = StructType([*(taken.schema[c] for c in kept), StructField(name, ArrayType(HIT))])
    sent = docs.sparkSession.sparkContext.broadcast(found)
    arrow = pa.list_(
        pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        for block in blocks(batches, "__text"):
            small, at_text, at, begins = plain(block.data, block.offsets)
            hits = []
            for one in found:
                place = regions(one, small, at_text, how)
                if len(place[0]):
                    leaks = verified(one, small, at_text, *place, how)
                    hits += [(t, int(one.items[w]), s, e, k) for t, w, s, e, k in leaks]
            old = block.rows.column(len(kept) + 1).to_pylist()
            lists = [x or [] for x in old]
            for i, leaks in _merged(hits).items():
                for item, start, end, edits in leaks:
                    first = int(at[at_text[i] + start] - begins[i])
                    last = int(at[at_text[i] + end - 1] - begins[i]) + 1
                    lists[i].append({"item_id": item, "start": first, "end": last, "edits": edits})
            yield pa.RecordBatch.from_arrays(
                [*(block.rows.column(c) for c in range(len(kept))), pa.array(lists, arrow)],
                schema.names,
            )

    return taken.mapInArrow(search, schema)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep: Sequence[str] | None = None,
    name: str = "leaks",
    how: Settings = Settings(),  # noqa: B008
) -> DataFrame:
    """The columns `keep` of docs (all by default) and an array of leaks.

    A leak names a benchmark item, the first and one past the last code point of
    the place in the text, and the edits of its worst window. A NULL or empty
    text has none; NULL benchmark texts, and items shorter than `how.q` plain
    characters, are found nowhere. Items with equal texts are all reported.
    Repeated rows stay. An empty benchmark gives empty arrays. A column of docs
    with the result's name is replaced.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    out = docs.select(*dict.fromkeys([*kept, text]))
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text"))
    items = items.filter("text IS NOT NULL").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(chars / how.block_chars))
    for i in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == i).collect()
        part.sort(key=lambda r: (r["item"] is not None, r["item"], r["text"]))
        found = index([r["item"] if r["item"] is not None else -1 for r in part], [r["text"] for r in part], how)
        if found:
            out = _one_pass(out, text, name, found, how)
    if name not in out.columns:
        out = out.withColumn(name, F.array().cast(ArrayType(HIT)))
    return out.select(*kept, name)
