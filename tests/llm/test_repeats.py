import random

from cohortloom.llm import repeats
from tests.llm.helpers import empty_docs, odd_docs, sentence


def test_inline_passage_is_removed_and_places_are_kept(spark):
    rng = random.Random(2)
    passage = " ".join(sentence(rng, 9).capitalize() + "." for _ in range(7))
    rows = [(i, f"{sentence(rng, 20)}. {passage} {sentence(rng, 12)}é.") for i in range(4)]
    rows.append((9, f"{sentence(rng, 30)}.\nShort one. Short one."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeats.drop_repeats(docs).collect()}
    assert got[0]["text"] == rows[0][1] and got[9]["text"] == rows[4][1]
    for i in (1, 2, 3):
        text = rows[i][1]
        start, end = got[i]["removed_spans"][0]
        assert text[start:end] == passage + " "
        assert got[i]["text"] == text[:start] + text[end:]
        assert [text[a:b] for a, b in got[i]["kept_spans"]] == [text[:start], text[end:]]


def test_units_join_to_the_text(spark):
    rows = [(1, "A b. C d!\n\nE f? g\n\n\nh"), (2, "  x"), (3, "\n\n"), (4, "é. ü\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for unit in repeats.UNITS:
        table = repeats.unit_table(docs, "doc_id", "text", unit).orderBy("id", "unit").collect()
        for d, text in rows:
            parts = [(r["start"], r["end"]) for r in table if r["id"] == d]
            if text.strip():
                assert "".join(text[a:b] for a, b in parts) == text
            else:
                assert not parts


def test_lines_and_paragraphs(spark):
    rng = random.Random(4)
    block = sentence(rng, 30) + "\n" + sentence(rng, 30)
    rows = [(1, block + "\n\nfirst end"), (2, "start\n\n" + block + "\n\nend")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for unit in ("line", "paragraph"):
        got = {r["doc_id"]: r["text"] for r in repeats.drop_repeats(docs, unit=unit).collect()}
        assert got[2].split() == ["start", "end"] and got[1] == rows[0][1]


def test_odd_rows(spark):
    docs = odd_docs(spark)
    found = repeats.drop_repeats(docs)
    rows = found.collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: r for r in rows}
    assert got[2]["text"] is None and got[2]["kept_spans"] == []
    assert got[3]["text"] == "" and got[4]["text"] == " \n\t\n "
    assert got[5]["removed_spans"] == []
    assert repeats.drop_repeats(empty_docs(spark)).count() == 0


def test_texts_of_a_repeated_id_only_lose_spans_of_their_own(spark):
    rng = random.Random(8)
    passage = " ".join(sentence(rng, 9).capitalize() + "." for _ in range(5))
    other = " ".join(sentence(rng, 9).capitalize() + "." for _ in range(9))
    rows = [(1, passage), (2, f"Start here. {passage} End there."), (2, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in repeats.drop_repeats(docs).collect())
    assert got == sorted([(1, passage), (2, "Start here. End there."), (2, other)])
