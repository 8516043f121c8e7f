import random

from pyspark.sql import functions as F

from cohortloom.llm import line_dedup
from tests.llm.helpers import empty_docs, odd_docs, sentence


def plain(line):
    return " ".join(line.lower().split())


def one_edit(a, b):
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, min_words=8):
    lines = [(d, i, plain(x)) for d, t in sorted(rows) for i, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    gone = {}
    for at, (d, i, line) in enumerate(lines):
        words = line.split(" ")
        for _, _, other in lines[:at]:
            near = other.split(" ")
            n = sorted((len(words), len(near)))
            if other == line or (n[1] >= min_words and n[0] >= min_words - 1 and one_edit(words, near)):
                gone.setdefault(d, []).append(i)
                break
    return gone


def test_brute_force(spark):
    rng = random.Random(5)
    pool = [sentence(rng, rng.choice([1, 3, 7, 8, 9, 15, 30])) for _ in range(40)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(pool).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"], [f"v{rng.randint(0, 2)}"]])
            lines.append(rng.choice([" ", ""]) + " ".join(words).title())
        rows.append((d, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["line_nos"] for r in line_dedup.duplicate_lines(docs).collect()}
    assert got == brute(rows)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    for d, text in rows:
        rest = [x for i, x in enumerate(text.split("\n")) if i not in got.get(d, [])]
        assert kept[d] == "\n".join(rest)


def test_odd_rows(spark):
    docs = odd_docs(spark, ["ANOTHER  line there. \nnew words", "new words"])
    found = line_dedup.dedup_lines(docs)
    assert found.columns[-1] == "removed_lines" and found.count() == docs.count()
    rows = found.collect()
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in rows}
    assert [r["text"] for r in rows if r["doc_id"] == 1] == ["One line here.\nAnother line there."] * 2
    assert got[None] == ("One line here.\nAnother line there.", [])
    assert got[2] == (None, []) and got[3] == ("", []) and got[4] == (" \n\t\n ", [])
    assert got[100] == ("new words", [0]) and got[101] == ("", [0])
    assert line_dedup.dedup_lines(empty_docs(spark)).count() == 0


def test_only_native_operators(spark):
    docs = odd_docs(spark)
    for frame in (line_dedup.dedup_lines(docs), line_dedup.duplicate_lines(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_template_with_one_changing_word(spark):
    # All lines share one variant: each is joined with the earliest only.
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("this page was seen by the visitor number "), "id", F.lit(" today")).alias("text"),
    )
    found = line_dedup.duplicate_lines(docs)
    assert found.count() == 2999 and found.filter("id = 0").count() == 0


def test_a_replaced_word_in_a_short_line_hides_no_later_witness(spark):
    # Seven words: one replaced is no duplicate, but the line of eight words in between is one.
    short = "please read our terms of use today"
    other = "please read our terms of use tomorrow"
    for longer in ("please read our terms of use again today", short + " please", "now " + short):
        for rows in ([(1, f"{other}\n{longer}\n{short}")], [(1, other), (2, longer), (3, short)]):
            docs = spark.createDataFrame(rows, "doc_id long, text string")
            got = {r["id"]: r["line_nos"] for r in line_dedup.duplicate_lines(docs).collect()}
            assert got == brute(rows) and sum(map(len, got.values())) == 1


def test_texts_of_a_repeated_id_only_lose_lines_of_their_own(spark):
    rows = [(1, "alpha beta gamma"), (2, "alpha beta gamma\nX"), (2, "clean unique line\nY"), (2, "Z\nclean unique line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect())
    assert texts == [(1, "alpha beta gamma"), (2, "X"), (2, "Z"), (2, "clean unique line\nY")]


def test_a_very_common_line_is_met_by_broadcast_and_by_shuffle(spark):
    hot = "this line is everywhere in the whole of the corpus"
    rows = [(i, f"{hot}\nrare line {i // 2}\nown {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["id"]: r["line_nos"] for r in line_dedup.duplicate_lines(docs).collect()}
    assert got == {i: ([0, 1] if i % 2 else [0]) for i in range(1, 3000)}
