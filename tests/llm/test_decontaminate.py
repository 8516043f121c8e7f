import random

import numpy as np
from pyspark.sql import functions as F

from cohortloom.llm import decontaminate
from tests.llm.helpers import empty_docs, odd_docs, sentence


def edit_distance(pattern, text):
    """Fewest edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def hits(docs, benchmark, **how):
    rows = decontaminate.leaks(docs, benchmark, keep=["doc_id"], **how)
    return rows.select("doc_id", F.inline("leaks")).collect()


def test_windows_with_edits_against_brute_force(spark):
    rng = random.Random(7)
    items = [sentence(rng, 14)[:110] for _ in range(6)]
    rows = []
    for d in range(60):
        text = list(rng.choice(items))
        for _ in range(rng.choice([0, 2, 6, 10, 13, 20])):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice(["", "q", text[at] + "z"])
        rows.append((d, f"{sentence(rng, 6)}, {''.join(text)}. {sentence(rng, 5)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in hits(docs, benchmark)}

    def plain(text):
        return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())

    for d, text in rows:
        for i, item in enumerate(items):
            pattern = plain(item)
            edits = edit_distance(pattern, plain(text))
            assert ((d, i) in got) == (edits <= len(pattern) // 10), (d, i, edits)
            if (d, i) in got:
                assert got[d, i]["edits"] == edits
                place = text[got[d, i]["start"] : got[d, i]["end"]]
                assert abs(len(plain(place)) - len(pattern)) <= edits
    assert len({r["edits"] for r in got.values()}) > 3


def test_long_items_are_found_in_part(spark):
    rng = random.Random(9)
    item = sentence(rng, 80)
    docs = spark.createDataFrame(
        [(1, "intro. " + item[100:400] + " end"), (2, sentence(rng, 60)), (3, item.upper().replace(" ", "\n"))],
        "doc_id long, text string",
    )
    benchmark = spark.createDataFrame([(5, item), (6, item), (7, None), (8, "short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["end"]) for r in hits(docs, benchmark)}
    assert set(got) == {(1, 5), (1, 6), (3, 5), (3, 6)}
    assert got[3, 5] == (0, len(item))


def test_blocks_of_the_benchmark_give_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, hits(docs, benchmark)))
    parts = sorted(map(tuple, hits(docs, benchmark, how=decontaminate.Settings(block_chars=1500))))
    assert whole and whole == parts


def test_odd_rows(spark):
    docs = odd_docs(spark, ["xx One line here.\nAnother line there! xx"])
    benchmark = spark.createDataFrame([(1, "one line here another line there")], "item_id long, text string")
    found = decontaminate.leaks(docs, benchmark)
    assert found.count() == docs.count() and found.columns[-1] == "leaks"
    got = {r["doc_id"]: r["leaks"] for r in found.collect()}
    assert got[2] == got[3] == got[4] == got[5] == []
    assert [tuple(x) for x in got[100]] == [(1, 3, 36, 0)]
    assert len(got[None]) == 1
    assert decontaminate.leaks(empty_docs(spark), benchmark).count() == 0
    assert all(r["leaks"] == [] for r in decontaminate.leaks(docs, benchmark.limit(0)).collect())


def test_align_counts_edits():
    pattern = np.frombuffer(b"abcdef", np.uint8)[None, :].astype(np.uint32)
    for text, edits in ((b"xxabcdefxx", 0), (b"xxabXdefxx", 1), (b"xxabdefxxx", 1), (b"xxabcYdefx", 1), (b"zzzzzzzzzz", 6)):
        row = np.frombuffer(text, np.uint8)[None, :].astype(np.uint32)
        assert decontaminate.align(pattern, row)[0][0] == edits


def test_no_match_within_the_edits_is_lost_at_any_length(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnop"
    items = ["".join(rng.choice(letters) for _ in range(m)) for m in range(8, 41)]
    rows = []
    for i, item in enumerate(items):
        for r in range(12):
            text = list(item)
            # Spread edits break as many q-grams as they can.
            k = len(item) // 10 + (r == 11)
            for e in range(k):
                at = min((2 * e + 1) * len(text) // (2 * k), len(text) - 1)
                text[at : at + 1] = rng.choice(["Z", "", text[at] + "Z"]).lower()
            rows.append((100 * i + r, f"zz {''.join(text)} zz"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in hits(docs, benchmark)}
    for d, text in rows:
        item = items[d // 100]
        assert ((d, d // 100) in got) == (edit_distance(item, text) <= len(item) // 10), (item, text)


def test_every_unchanged_excerpt_is_found_from_the_stated_length_on(spark):
    rng = random.Random(13)
    letters = "abcdefghijklmnop    "
    item = " ".join("".join(rng.choice(letters) for _ in range(420)).split())
    rows = []
    for n in (59, 60, 61, 80, 100, 107, 120, 150):
        for start in range(0, len(item) - n, 7):
            rows.append((len(rows), n, start, f"0123 {item[start:start + n]} 4567"))
    docs = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item), (2, sentence(rng, 90))], "item_id long, text string")
    got = {}
    for r in hits(docs, benchmark):
        got.setdefault(r["doc_id"], []).append(r)
    for d, n, start, text in rows:
        # A blank at an end of the excerpt meets one of the text.
        real = len(item[start : start + n].strip())
        if real >= 60:
            assert len(got[d]) == 1 and got[d][0]["item_id"] == 1, (n, start)
            assert got[d][0]["end"] - got[d][0]["start"] >= min(real, 60)
        elif real + 2 < 60:
            assert d not in got
