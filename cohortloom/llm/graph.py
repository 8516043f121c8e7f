"""Connected components of a graph of links, and a small shared checkpoint helper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import scratch_root


def checkpoint(df: DataFrame) -> DataFrame:
    """`df` written once to the shared checkpoint folder; its lineage ends there.

    The files go when nothing refers to the result any more, if the session has
    `spark.cleaner.referenceTracking.cleanCheckpoints`.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in a link; the component is its smallest reachable id.

    Alternates two steps on (a, b) rows until nothing changes: every id passes
    its larger neighbours on to the smallest id around it, then its smaller
    ones. Every step is a grouped minimum (combined before the shuffle) and a
    join on the id, so an id with very many links is split by adaptive
    execution. Each round is written to the shared checkpoint folder. Links of
    an id with itself are allowed and give it a component; NULL ends are
    dropped; an empty table gives none.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    edges = checkpoint(
        ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    ids = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    ids = checkpoint(ids)
    edges = edges.filter("u <> v")
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.filter("v > u").join(low, "u")
        large = large.select(F.col("v").alias("u"), F.col("low").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = small.filter("u <> v").union(low.select("u", F.col("low").alias("v"))).distinct()
        edges = checkpoint(small)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.join(roots, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
