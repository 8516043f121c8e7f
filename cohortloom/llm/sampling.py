"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key written as text, modulo `modulus`; NULL for a NULL key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus))


def _pick(key: str, text: str) -> Column:
    return F.xxhash64(F.lit(7), F.col(key), F.col(text))


def fingerprints(df: DataFrame, key: str, text: str, *others: str) -> DataFrame:
    """(key, pick, chars) and other columns of every row: what a sample is chosen by, without the text."""
    return df.select(
        F.col(key).alias("key"),
        _pick(key, text).alias("pick"),
        F.length(text).alias("chars"),
        *others,
    )


def bounded_sample(
    labelled: DataFrame, df: DataFrame, key: str, text: str, per_label: int, max_chars: int
) -> pa.Table:
    """About `per_label` rows of every label, as an Arrow table (label, text).

    `labelled` is `fingerprints(df)` with a column `label`. Rows are chosen by
    the hash of their key and text, so the same rows are chosen each time. Only
    texts of 1 to `max_chars` characters are sampled (they are taken whole); of
    a label that has none, the beginnings of longer ones are. At
    most `2 * per_label` rows per label are chosen, whatever the size of `df`;
    their keys are sent to the scan that fetches the texts, so no text is
    shuffled. Rows without a key or label are not sampled. Labels are assumed
    few (languages, classes).
    """
    rows = labelled.filter(
        F.col("key").isNotNull() & F.col("label").isNotNull() & (F.col("chars") >= 1)
    )
    short = F.col("chars") <= max_chars
    found = rows.groupBy("label").agg(F.count_if(short).alias("short"), F.count("*").alias("n")).collect()
    counts = {r["label"]: r["short"] or r["n"] for r in found}
    only_long = [r["label"] for r in found if not r["short"]]
    rows = rows.filter(short | F.col("label").isin(only_long) if only_long else short)
    if not counts:
        return pa.table({"label": pa.array([], pa.string()), "text": pa.array([], pa.string())})
    share = F.lit(0)
    for name, n in sorted(counts.items()):
        steps = min(_STEPS, int(1.1 * per_label / n * _STEPS) + 1)
        share = F.when(F.col("label") == name, F.lit(steps)).otherwise(share)
    chosen = rows.filter(F.pmod(F.col("pick"), F.lit(_STEPS)) < share)
    chosen = chosen.select("label", "key", "pick").distinct().limit(2 * per_label * len(counts))
    named = df.select(
        F.col(key).alias("key"),
        _pick(key, text).alias("pick"),
        F.substring(text, 1, max_chars).alias("text"),
    )
    bounded = named.join(F.broadcast(chosen), ["key", "pick"])
    # A row met many times is one of the sample.
    bounded = bounded.dropDuplicates(["label", "key", "pick"]).select("label", "text")
    return bounded.toArrow().sort_by([("label", "ascending"), ("text", "ascending")])
