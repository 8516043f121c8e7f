"""Substring deduplication by hashing units of text.

A text is cut into units: lines, paragraphs, or (by default) sentences within
lines, so that a passage set into the middle of a line is still made of whole
units. Every unit ends with its white space, so the units of a text join to the
text again, and a unit without words belongs to the one before it. Units are
compared in a plain form: words in lower case, without the white space between
them, as a 128-bit digest.

Digests are grouped over all texts; the occurrence that ranks first (smallest
id, then place) stays. Of the others, neighbouring ones are joined to runs, and
a run of at least `min_words` words is removed. Shorter runs stay: a short line
met twice is no passage. Only whole units count: a repeated passage that begins
and ends inside units stays if the whole ones in it are too short. All places are code points of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.attach import meet
from cohortloom.llm.blocks import (
    LOWER,
    Block,
    blocks,
    bounded_batches,
    counts_per_text,
    mix,
    ranges,
    span_hashes,
    word_spans,
)
from cohortloom.session import materialise

UNITS = ("sentence", "line", "paragraph")
_SPANS = "array<struct<start: int, end: int>>"
_END = np.zeros(256, bool)
_END[[33, 46, 63]] = True  # ! . ?


def _cuts(data: np.ndarray, unit: str) -> np.ndarray:
    """Places where a unit may begin, text begins aside."""
    line = np.flatnonzero(data == 10)
    if unit == "line":
        return line + 1
    if unit == "paragraph":
        return line[1:][np.diff(line) == 1] + 1
    stop = np.flatnonzero(_END[data[:-1]] & (data[1:] == 32)) + 2
    return np.union1d(line + 1, stop)


def units(block: Block, unit: str = "sentence"):
    """Per unit: text, number in it, first and last code point, words, two hashes, met before in the text."""
    data = LOWER[block.data]
    starts, ends = word_spans(data)
    words = span_hashes(data, starts, ends)
    cuts = np.union1d(_cuts(data, unit), block.offsets[:-1])
    cuts = cuts[cuts < len(data)]
    # A cut opens a unit only if a word follows before the next cut, or a text begins.
    n_words = np.diff(np.searchsorted(starts, np.append(cuts, len(data))))
    opens = (n_words > 0) | np.isin(cuts, block.offsets[:-1])
    cuts = cuts[opens]
    first = np.searchsorted(starts, cuts)
    last = np.append(first[1:], len(starts))
    text = np.searchsorted(block.offsets, cuts, "right") - 1
    number = ranges(np.diff(np.searchsorted(cuts, block.offsets)))
    chars = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
    stop = np.append(cuts[1:], len(data))
    stop = np.minimum(stop, block.offsets[text + 1] - 1)
    base = chars[block.offsets[text]]
    one = span_hashes(words, first, last)
    two = span_hashes(mix(words ^ np.uint64(0x5851F42D4C957F2D)), first, last)
    key = one ^ mix(text.astype(np.uint64) + np.uint64(1))
    again = np.ones(len(cuts), bool)
    again[np.unique(key, return_index=True)[1]] = False
    return text, number, chars[cuts] - base, chars[stop] - base, last - first, one, two, again


def unit_table(docs: DataFrame, key: str, text: str, unit: str) -> DataFrame:
    """One row per unit with words: id, mark (of the text), unit, start, end, n_words, h1, h2, again."""
    taken = docs.select(
        F.col(key).cast("long").alias("id"), F.hash(F.col(text)).alias("mark"), F.col(text).alias("text")
    )
    schema = (
        "id long, mark int, unit int, start int, end int, n_words int, h1 long, h2 long, again boolean"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            owner, number, start, end, n, one, two, again = units(block, unit)
            full = n > 0
            yield pa.RecordBatch.from_arrays(
                [
                    *(block.rows.column(c).take(pa.array(owner[full])) for c in (0, 1)),
                    pa.array(number[full].astype(np.int32)),
                    pa.array(start[full].astype(np.int32)),
                    pa.array(end[full].astype(np.int32)),
                    pa.array(n[full].astype(np.int32)),
                    pa.array(one[full].view(np.int64)),
                    pa.array(two[full].view(np.int64)),
                    pa.array(again[full]),
                ],
                ["id", "mark", "unit", "start", "end", "n_words", "h1", "h2", "again"],
            )

    return taken.filter("id IS NOT NULL AND text IS NOT NULL").mapInArrow(cut, schema)


def repeated_spans(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    unit: str = "sentence",
    min_words: int = 25,
) -> DataFrame:
    """(id, mark, removed): the spans to remove from every text that has any, in order.

    `mark`, a hash of the text, tells apart the texts of a repeated id.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    bounded_batches(docs.sparkSession)
    table = materialise(unit_table(docs, key, text, unit), "units")
    # Within a text only the first occurrence can be the earliest of all.
    first = (
        table.filter("NOT again")
        .groupBy("h1", "h2")
        .agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))
        .filter("first_id < last_id")
        .select("h1", "h2", "first_id", "n")
    )
    shown = ["id", "mark", "unit", "start", "end", "n_words"]
    others = meet(table.filter("NOT again").drop("again"), materialise(first, "repeated-units"), ["h1", "h2"], "n")
    others = others.filter("id > first_id").select(*shown)
    found = others.union(table.filter("again").select(*shown)).distinct()
    place = Window.partitionBy("id", "mark").orderBy("unit")
    runs = found.withColumn("run", F.col("unit") - F.row_number().over(place))
    runs = runs.groupBy("id", "mark", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words")
    )
    runs = runs.filter(F.col("n_words") >= min_words)
    spans = F.sort_array(F.collect_list(F.struct("start", "end"))).cast(_SPANS)
    return runs.groupBy("id", "mark").agg(spans.alias("removed"))


def drop_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    unit: str = "sentence",
    min_words: int = 25,
    names: tuple[str, str] = ("kept_spans", "removed_spans"),
) -> DataFrame:
    """docs with the rest as text, and the kept and removed spans of the original text.

    All rows and columns stay. A NULL text stays NULL and has no spans; a text
    without words stays as it is. A row with a NULL id takes no part. Rows that
    repeat an id and a text are changed alike; a row that repeats an id with
    another text is a text of its own. Columns with the names of the
    results are replaced. An empty table gives none.
    """
    rows = docs.drop(*names)
    gone = repeated_spans(docs, key, text, unit, min_words)
    gone = gone.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("removed").alias("__gone"))
    own = (F.col(key).cast("long") == F.col("__id")) & (F.hash(F.col(text)) == F.col("__mark"))
    joined = rows.join(gone, own, "left")
    none = F.array().cast(_SPANS)
    joined = joined.withColumn("__gone", F.coalesce("__gone", none))
    n = F.size("__gone")
    length = F.length(F.col(text))
    # The kept spans lie before, between and behind the removed ones.
    between = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.get("__gone", i - 1)["end"]).alias("start"),
            F.when(i == n, length).otherwise(F.get("__gone", i)["start"]).alias("end"),
        ),
    )
    kept = F.filter(between, lambda s: s["start"] < s["end"])
    joined = joined.withColumn("__kept", F.when(length.isNull(), none).otherwise(kept).cast(_SPANS))
    parts = F.transform(
        "__kept", lambda s: F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"])
    )
    rest = F.when(n == 0, F.col(text)).otherwise(F.array_join(parts, ""))
    return joined.select(
        *(rest.alias(c) if c == text else F.col(c) for c in rows.columns),
        F.col("__kept").alias(names[0]),
        F.col("__gone").alias(names[1]),
    )
