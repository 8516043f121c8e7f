import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.llm import decontaminate
from cohortloom.llm.line_dedup import duplicate_lines
from cohortloom.llm.sampling import bounded_sample, fingerprints
from tests.llm.test_line_dedup import brute as line_brute
from tests.llm.test_near_dedup import brute as near_brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontaminate", "best_fit_packing"]

    known = stages["language_id"](spark, docs, SF).cache()
    assert known.columns == columns and known.count() >= 0.98 * docs.filter("text rlike '[a-z]'").count()

    lines = stages["line_dedup"](spark, known, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in known.collect()]
    gone = line_brute(rows)
    assert {r["id"]: r["line_nos"] for r in duplicate_lines(known).collect()} == gone
    expected = {}
    for d, t in rows:
        rest = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, []))
        if rest.strip() or d not in gone:
            expected[d] = rest
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == expected
    assert lines.columns == columns and lines.filter("n_chars <> length(text)").count() == 0

    single = stages["near_dedup"](spark, lines, SF).cache()
    groups = near_brute(list(expected.items()), 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {d for d, (_, c) in groups.items() if c == d}
    assert single.columns == columns

    clean = stages["decontaminate"](spark, single, SF).cache()
    found = decontaminate.leaks(single, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("size(leaks) > 0")
    assert clean.count() == single.count() - found.count() and clean.columns == columns

    pieces = stages["best_fit_packing"](spark, clean, SF)
    assert pieces.select("doc_id").distinct().count() == clean.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length").collect())) == sorted(
        map(tuple, pieces.select("doc_id", "piece", "length").collect())
    )


def test_documents_without_a_labelled_text_are_not_dropped(spark):
    rows = [(1, "the cat and the dog", None), (2, "le chat et le chien", None), (3, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.warns(UserWarning, match="no labelled text"):
        known = corpus_pipeline.known_language(spark, docs, SF)
    assert sorted(map(tuple, known.collect())) == rows


def test_a_label_with_long_texts_only_is_sampled(spark):
    rows = [(1, "short one", "en"), (2, "long" * 9, "en"), (3, "lang" * 9, "de"), (4, "", "fr"), (5, None, "it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marked = fingerprints(docs.withColumn("label", F.col("lang")), "doc_id", "text", "label")
    found = bounded_sample(marked, docs, "doc_id", "text", 10, 20)
    assert found.to_pylist() == [{"label": "de", "text": "lang" * 5}, {"label": "en", "text": "short one"}]
