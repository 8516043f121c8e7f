"""Secret scans with multipart credential linking, in DataFrame functions only.

Patterns find parts of credentials. Some are secrets by themselves (`assign`,
`access`, `hex`) and are always reported. Others are weak candidates: a long
token, a login name, an endpoint. A weak candidate is reported only if a part
that completes it lies in its scope, which is a number of characters around it:
a token needs an identifier or an endpoint, an identifier or an endpoint needs a
secret. Parts are joined as intervals: both sides are listed under the bins they
reach, and only the existence of a partner is asked (a semi join), so no pairs
are made.

Spark has no function for the places of all matches of a pattern. They follow
from the texts of the matches and of the pieces between them: a match starts
after all pieces up to it and all matches before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialise

BASE = ("assign", "access", "hex")
WEAK = ("token", "identifier", "endpoint")

# What makes each kind. Group 2 of `assign` must have 6 characters.
# For `access` and `hex` the least length is part of the pattern; as both take
# the longest run, that gives the same matches as dropping short ones afterwards.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "token": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{32,}",
    "identifier": r"""(?i:user_?name|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""",
    "endpoint": r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s"'<>]*)?""",
}
# What completes each weak kind.
PARTNERS = {
    "token": ("access", "identifier", "endpoint"),
    "identifier": ("assign", "hex", "token"),
    "endpoint": ("assign", "hex", "token"),
}


def _found(text: Column, kind: str) -> Column:
    """Lengths of pieces and matches, and which matches count, for one kind; NULL without a match."""
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = F.transform(matches, lambda m: F.length(m))
    pieces = F.transform(F.split(text, pattern), lambda p: F.length(p))
    if kind == "assign":
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        valid = F.transform(values, lambda v: F.length(v) >= 6)
    else:
        valid = F.transform(matches, lambda m: F.lit(True))
    rows = F.arrays_zip(pieces.alias("piece"), size.alias("size"), valid.alias("valid"))
    found = F.struct(F.lit(kind).alias("kind"), rows.alias("rows"))
    return F.when(text.rlike(pattern), found)


def _row_key(key: str, text: str) -> list[Column]:
    """Two hashes that name a row by its id and text; equal rows share them."""
    return [
        F.xxhash64(F.lit(salt), F.col(key).isNull(), F.col(key), F.col(text)).alias(name)
        for salt, name in ((1, "r1"), (2, "r2"))
    ]


def part_table(docs: DataFrame, key: str, text: str, kinds=(*BASE, *WEAK)) -> DataFrame:
    """One row per part: r1, r2 (the row), kind, start, end, in code points, end exclusive."""
    rows = docs.filter(F.col(text).isNotNull())
    each = F.filter(F.array(*(_found(F.col(text), k) for k in kinds)), lambda x: x.isNotNull())
    rows = rows.select(*_row_key(key, text), F.explode(each).alias("found"))
    rows = rows.select("r1", "r2", "found.kind", F.posexplode("found.rows").alias("i", "m"))
    rows = rows.select("r1", "r2", "kind", "i", "m.piece", "m.size", "m.valid").dropDuplicates(
        ["r1", "r2", "kind", "i"]
    )
    before = Window.partitionBy("r1", "r2", "kind").orderBy("i")
    end = F.sum(F.col("piece").cast("long") + F.coalesce("size", F.lit(0))).over(before)
    placed = rows.withColumn("end", end).filter("size IS NOT NULL AND valid")
    return placed.select("r1", "r2", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _reach(parts: DataFrame, width: int, around: int) -> DataFrame:
    """Parts under every bin of `width` that they reach, `around` characters on both sides included."""
    first = F.floor((F.col("start") - around) / width)
    last = F.floor((F.col("end") + around) / width)
    return parts.withColumn("bin", F.explode(F.sequence(first, last)))


def _meeting(left: DataFrame, right: DataFrame, scope: int, extra: Column, how: str) -> DataFrame:
    """Rows of left that have (or have not) a row of right within `scope` characters in their text."""
    width = max(scope, 64)
    a, b = _reach(left, width, scope).alias("a"), _reach(right, width, 0).alias("b")
    near = (
        (F.col("a.r1") == F.col("b.r1"))
        & (F.col("a.r2") == F.col("b.r2"))
        & (F.col("a.bin") == F.col("b.bin"))
        & (F.col("b.start") <= F.col("a.end") + scope - (0 if scope else 1))
        & (F.col("a.start") <= F.col("b.end") + scope - (0 if scope else 1))
        & extra
    )
    met = a.join(b, near, "left_semi").select(*left.columns).distinct()
    return met if how == "with" else left.join(met, left.columns, "left_anti")


def linked_parts(parts: DataFrame, scope: int) -> DataFrame:
    """The base parts, and the weak ones that are completed within `scope` characters."""
    base = parts.filter(F.col("kind").isin(*BASE))
    # A weak candidate that overlaps a reported secret adds nothing.
    weak = _meeting(parts.filter(F.col("kind").isin(*WEAK)), base, 0, F.lit(True), "without")
    complete = F.lit(False)
    for kind, partners in PARTNERS.items():
        complete |= (F.col("a.kind") == kind) & F.col("b.kind").isin(*partners)
    return base.unionByName(_meeting(weak, base.unionByName(weak), scope, complete, "with"))


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = 200, name: str = "secrets"
) -> DataFrame:
    """docs with an array of (start, kind, end), by start and then in the order of the kinds.

    A NULL or empty text has none. All rows and columns stay; rows with equal
    ids and texts get the same array, NULL ids too. A column with the result's
    name is replaced. An empty table gives none. Texts are not shuffled if the
    caller does not ask for them.
    """
    parts = materialise(part_table(docs, key, text), "secret-parts")
    found = linked_parts(parts, scope)
    rank = F.array_position(F.array(*(F.lit(k) for k in (*BASE, *WEAK))), F.col("kind"))
    spans = F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end")))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    found = found.groupBy("r1", "r2").agg(spans.alias(name))
    rows = docs.drop(name)
    kept = rows.columns
    named = rows.select("*", *(c.alias(f"__{n}") for c, n in zip(_row_key(key, text), ("r1", "r2"), strict=True)))
    joined = named.join(
        found, (F.col("__r1") == F.col("r1")) & (F.col("__r2") == F.col("r2")), "left"
    )
    none = F.array().cast("array<struct<start: bigint, kind: string, end: bigint>>")
    return joined.select(*kept, F.coalesce(F.col(name), none).alias(name))
