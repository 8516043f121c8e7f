import numpy as np
import pyarrow as pa

from cohortloom.llm import language
from cohortloom.llm.queries import registry
from tests.llm.helpers import empty_docs, odd_docs


def sample(n=60):
    texts = ["the cat and the dog were here", "le chat et le chien étaient là"] * n
    return pa.table({"label": ["en", "fr"] * n, "text": texts})


def test_held_out_accuracy(spark):
    rows = registry.queries["op1_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = rows.filter("held_out").join(docs, "doc_id").collect()
    assert len(found) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_odd_rows(spark):
    model = language.train(sample())
    docs = odd_docs(spark, ["le chat et le chien", "the dog and the cat"])
    found = language.identify(docs, model)
    assert found.count() == docs.count()
    assert set(docs.columns) - {"score"} < set(found.columns)
    got = {r["doc_id"]: r for r in found.collect()}
    for blank in (2, 3, 4, 6):
        assert (got[blank]["lang_pred"], got[blank]["score"], got[blank]["accepted"]) == ("und", 0.0, False)
    assert got[100]["lang_pred"] == "fr" and got[101]["lang_pred"] == "en"
    assert language.identify(empty_docs(spark), model).count() == 0


def test_texts_of_unknown_features_are_rejected(spark):
    model = language.train(sample())
    docs = spark.createDataFrame([(1, "中文字符測試"), (2, "the cat")], "doc_id long, text string")
    got = {r["doc_id"]: r["accepted"] for r in language.identify(docs, model).collect()}
    assert got[2]
    assert model.threshold <= 0.5


def test_models_without_or_with_one_label(spark):
    docs = odd_docs(spark)
    none = language.train(pa.table({"label": pa.array([], pa.string()), "text": pa.array([], pa.string())}))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}
    one = language.train(pa.table({"label": ["en"] * 12, "text": ["the cat"] * 12}))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, one).collect()}
    assert got[1] == "en" and got[2] == "und"
