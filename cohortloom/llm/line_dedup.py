"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared in a plain form (lower case, white space squeezed). Equal
plain lines are duplicates at any length. Lines of at least `min_words` words
are also duplicates when one word inserted, deleted or replaced turns one into
the other (an edit distance of at most one, in words).

Every line that can have such a partner is listed under its own key and under
the key of each variant with one word left out. Two lines within one edit share
a key: the same variant at the same place for a replaced word, or the whole of
the shorter line and a variant of the longer one. Within a key every line is
joined with the earliest line only, never with all others, and the pair is
verified on the words. A line with an earlier duplicate goes.

Two lines within one edit agree in their first or in their last half, so halves
are hashed first (two to four short keys a line) and only lines that share one
with another line make variants. Nothing is lost by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.attach import meet
from cohortloom.session import materialise

_LINE_STEP = 4294967296


def plain(line: Column) -> Column:
    """Lower case, runs of ASCII white space one blank; most lines need no replacement."""
    odd = line.contains("  ")
    for c in "\t\r\f\v":
        odd |= line.contains(c)
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line)))


def _order(doc: Column, line: Column) -> Column:
    """One sortable number for (document, line)."""
    return doc.cast("decimal(20,0)") * F.lit(_LINE_STEP).cast("decimal(11,0)") + line


def _line_table(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """All plain lines: h1, h2 (two hashes), id, mark (of the text), line_no, and up to four half keys."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.filter("id IS NOT NULL AND text IS NOT NULL")
    lines = rows.select("id", F.hash("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.filter(F.col("line").rlike(r"\S"))
    lines = lines.select("id", "mark", "line_no", plain(F.col("line")).alias("line"))
    n = F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1
    lines = lines.select("id", "mark", "line_no", "line", n.cast("int").alias("n"))
    long = F.col("n") >= min_words - 1

    def half(size: str, side: int, when: Column) -> Column:
        part = F.expr(f"substring_index(line, ' ', {'-' if side else ''}({size}))")
        return F.when(long & when, F.xxhash64(F.lit(side), part))

    # The shorter line of a pair has n or n - 1 words; for odd n both halves are alike.
    even = F.col("n") % 2 == 0
    return lines.select(
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit("again"), "line").alias("h2"),
        "id",
        "mark",
        "line_no",
        half("n DIV 2", 0, F.lit(True)).alias("half_a"),
        half("n DIV 2", 1, F.lit(True)).alias("half_b"),
        half("n DIV 2 - 1", 0, even).alias("half_c"),
        half("n DIV 2 - 1", 1, even).alias("half_d"),
    )


_HALVES = ("half_a", "half_b", "half_c", "half_d")


def _variants(lines: DataFrame, min_words: int) -> DataFrame:
    """(v, q, cls, ord) for every left-out word q, and q = 0 for the whole line.

    v combines one hash per (word, place), places behind the left-out word
    moved by one; both sums run along the words of a line. Lines under
    `min_words` words are listed whole only: they have longer partners, but
    none by a replaced word, and must not stand before one that counts.
    """
    cut = (F.size("words") >= min_words).alias("cut")
    words = lines.select("cls", "ord", cut, F.posexplode("words").alias("p", "word"))
    words = words.select(
        "cls",
        "ord",
        "cut",
        "p",
        F.xxhash64("word", "p").alias("here"),
        F.xxhash64("word", F.col("p") - 1).alias("moved"),
    )
    line = Window.partitionBy("cls")
    running = line.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = words.select(
        "cls",
        "ord",
        "cut",
        "p",
        "here",
        F.bit_xor("here").over(running).alias("before"),
        F.bit_xor("moved").over(running).alias("moved_before"),
    )
    ends = words.select(
        "*",
        F.last("before").over(line).alias("whole"),
        F.last("moved_before").over(line).alias("moved_whole"),
    )
    left_out = F.col("before").bitwiseXOR(F.col("here"))
    left_out = left_out.bitwiseXOR(F.col("moved_before")).bitwiseXOR(F.col("moved_whole"))
    keys = F.array(
        F.when(F.col("cut"), F.struct(left_out.alias("v"), (F.col("p") + 1).alias("q"))),
        F.when(F.col("p") == 0, F.struct(F.col("whole").alias("v"), F.lit(0).alias("q"))),
    )
    found = ends.select("cls", "ord", F.explode(keys).alias("key")).filter("key IS NOT NULL")
    return found.select("key.v", "key.q", "cls", "ord")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one inserted, deleted or replaced word."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)  # 0 if equal
    n, m = F.size(a), F.size(b)

    def after(words: Column, skip: int) -> Column:
        return F.slice(words, (first + skip).cast("int"), F.greatest(F.size(words), F.lit(1)))

    return (
        F.when(first == 0, F.lit(True))
        .when(n == m, after(a, 1) == after(b, 1))
        .when(n == m + 1, after(a, 1) == after(b, 0))
        .when(n + 1 == m, after(a, 0) == after(b, 1))
        .otherwise(F.lit(False))
    )


def _near_classes(classes: DataFrame, docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(h1, h2) of distinct lines with an earlier line within one edit."""
    halves = classes.select("h1", F.explode(F.array_compact(F.array(*_HALVES))).alias("half"))
    groups = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
    able = halves.join(groups.filter("low <> high").select("half"), "half", "left_semi")
    able = able.select("h1").distinct()
    firsts = classes.join(able, "h1", "left_semi").select("h1", "h2", "ord", "id", "line_no")
    wanted = firsts.groupBy("id").agg(
        F.collect_list(F.struct("line_no", "h1", "h2", "ord")).alias("wanted")
    )
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    source = source.filter("text IS NOT NULL")
    # Only short lists are hashed; texts need no sort. The array of lines stays a
    # column of its own, so a text is split once and not once for every line.
    found = source.join(wanted.hint("shuffle_hash"), "id")
    found = found.select(F.split("text", "\n").alias("lines"), "wanted")
    taken = F.transform(
        "wanted",
        lambda w: F.struct(
            w["h1"].alias("h1"),
            w["h2"].alias("h2"),
            w["ord"].alias("ord"),
            F.when(w["line_no"] < F.size("lines"), F.get("lines", w["line_no"])).alias("line"),
        ),
    )
    found = found.select(F.explode(taken).alias("w")).select("w.h1", "w.h2", "w.ord", "w.line")
    found = found.withColumn("line", plain(F.col("line")))
    # A repeated id may have other texts: the line must be the listed one.
    found = found.filter((F.xxhash64("line") == F.col("h1")) & F.col("line").isNotNull())
    found = found.dropDuplicates(["h1", "h2"])
    lines = materialise(
        found.select(F.col("h1").alias("cls"), "h2", "ord", F.split("line", " ").alias("words")),
        "near-lines",
    )
    rows = materialise(_variants(lines.repartition("cls"), min_words), "variants")
    parts = rows.filter("q > 0")
    wholes = rows.filter("q = 0").select("v", F.col("cls").alias("w_cls"), F.col("ord").alias("w_ord"))
    firsts = parts.groupBy("v", "q").agg(F.min("ord").alias("witness"), F.max("ord").alias("last"))
    firsts = firsts.filter("witness < last").select("v", "q", "witness")
    replaced = parts.join(firsts, ["v", "q"]).filter("witness < ord").select("cls", "witness")
    met = parts.join(wholes, "v").filter("cls <> w_cls")
    longer = met.filter("w_ord < ord").select("cls", F.col("w_ord").alias("witness"))
    shorter = met.filter("ord < w_ord").select(
        F.col("w_cls").alias("cls"), F.col("ord").alias("witness")
    )
    pairs = replaced.union(longer).union(shorter).groupBy("cls").agg(F.min("witness").alias("witness"))
    other = lines.select(F.col("ord").alias("witness"), F.col("words").alias("others"))
    checked = pairs.join(lines, "cls").join(other, "witness")
    long = F.least(F.size("words"), F.size("others")) >= min_words - 1
    long &= F.greatest(F.size("words"), F.size("others")) >= min_words
    checked = checked.filter(long & _one_edit(F.col("words"), F.col("others")))
    return checked.select(F.col("cls").alias("h1"), "h2").distinct()


def duplicate_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 8
) -> DataFrame:
    """(id, mark, line_nos): the numbers (from 0) of the lines to remove, per text with any.

    Lines are ranked by id and number; of equal lines and of lines within one
    edit the earliest stays. Blank lines are never duplicates. Rows with NULL
    ids or texts take no part. Rows that repeat an id with an equal text are
    treated alike, as one document; `mark`, a hash of the text, tells apart the
    texts of one id. Equal lines with the same number in two texts of one id
    are one place and both stay.
    """
    lines = materialise(_line_table(docs, key, text, min_words), "lines")
    # Few columns and plain numbers: equal lines are combined before the shuffle.
    classes = lines.groupBy("h1", "h2").agg(
        F.min(_order(F.col("id"), F.col("line_no"))).alias("ord"),
        F.count("*").alias("n"),
        *(F.min(c).alias(c) for c in _HALVES),
    )
    line_no = F.pmod(F.col("ord"), F.lit(_LINE_STEP).cast("decimal(11,0)"))
    classes = materialise(classes, "line-classes").withColumns(
        {
            "line_no": line_no.cast("int"),
            "id": ((F.col("ord") - line_no) / F.lit(_LINE_STEP)).cast("long"),
        }
    )
    near = _near_classes(classes, docs, key, text, min_words).withColumn("near", F.lit(True))
    touched = (
        classes.select("h1", "h2", F.col("id").alias("first_id"), F.col("line_no").alias("first_no"), "n")
        .join(near, ["h1", "h2"], "left")
        .filter("n > 1 OR near")
    )
    touched = materialise(touched, "touched-lines")
    # Number and mark travel as one number through the shuffle.
    low = F.col("mark").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    place = F.shiftleft(F.col("line_no").cast("long"), 32).bitwiseOR(low)
    placed = lines.select("id", place.alias("place"), "h1", "h2")
    line_no = F.shiftright("place", 32).cast("int")
    met = meet(placed, touched, ["h1", "h2"], "n").select(
        "id", line_no.alias("line_no"), F.shiftright(F.shiftleft("place", 32), 32).cast("int").alias("mark"),
        "near", "first_id", "first_no",
    )
    gone = met.filter("near OR id <> first_id OR line_no <> first_no")
    return gone.groupBy("id", "mark").agg(F.sort_array(F.collect_set("line_no")).alias("line_nos"))


def dedup_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    removed: str = "removed_lines",
    min_words: int = 8,
) -> DataFrame:
    """docs with the remaining lines as text, and the numbers of the removed lines.

    All rows and columns stay; a text whose lines all go becomes empty, a NULL
    text stays NULL, and a row with a NULL id keeps its text. A column with the
    name `removed` is replaced. Repeated rows are changed alike; a row that
    repeats an id with another text only loses lines of its own. An empty table
    gives none.
    """
    rows = docs.drop(removed)
    gone = duplicate_lines(docs, key, text, min_words).select(
        F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("line_nos").alias("__gone")
    )
    own = (F.col(key).cast("long") == F.col("__id")) & (F.hash(F.col(text)) == F.col("__mark"))
    joined = rows.join(gone.hint("shuffle_hash"), own, "left")
    # As above: one split per text.
    lines = F.when(F.col("__gone").isNotNull(), F.split(F.col(text), "\n"))
    joined = joined.select(*rows.columns, "__gone", lines.alias("__lines"))
    rest = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.array_join(F.transform(rest, lambda i: F.get("__lines", i)), "\n")
    changed = F.when(F.col("__lines").isNull(), F.col(text)).otherwise(kept)
    none = F.array().cast("array<int>")
    return joined.select(
        *(changed.alias(c) if c == text else F.col(c) for c in rows.columns),
        F.coalesce("__gone", none).alias(removed),
    )
