import numpy as np
import pyarrow as pa

from cohortloom.llm import toxicity
from cohortloom.llm.queries import registry
from tests.llm.helpers import empty_docs, odd_docs


def trained():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    clean = [" ".join(rng.choice(words, 40)) for _ in range(400)]
    toxic = [" ".join(rng.choice(words, 40)) + " blurgh" for _ in range(60)]
    return toxicity.train(pa.array(toxic[:40]), pa.array(clean[:360] + toxic[40:]), 0.1)


def test_marker_is_found_through_unlabelled_text(spark):
    model = trained()
    docs = odd_docs(spark, ["w1 w2 w3 blurgh w4", "w1 w2 w3 w4", "Blurgh!"])
    found = toxicity.toxicity(docs, model)
    got = {r["doc_id"]: r["score"] for r in found.collect()}
    assert found.count() == docs.count() and found.columns.count("score") == 1
    assert got[100] > 0.5 > got[101] and got[102] > 0.5
    assert all(0 <= s <= 1 for s in got.values())
    assert got[2] == got[3] == got[4]
    assert toxicity.toxicity(empty_docs(spark), model).count() == 0


def test_without_examples_every_text_scores_the_prior(spark):
    model = toxicity.train(pa.array([], pa.string()), pa.array(["a"]), 0.2)
    got = toxicity.toxicity(odd_docs(spark), model).select("score").distinct().collect()
    assert len(got) == 1 and abs(got[0][0] - 0.2) < 1e-6


def test_held_out_separation(spark):
    rows = registry.queries["op8_toxicity"](spark, "/root/testdata/sf0.1").filter("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = rows.join(labels, "doc_id").collect()
    toxic = [r["score"] for r in found if r["toxic"] == 1]
    clean = [r["score"] for r in found if r["toxic"] == 0]
    assert np.mean(np.array(toxic)[:, None] > np.array(clean)[None, :]) > 0.9
    assert np.mean(np.array(clean) >= 0.7) < 0.02
    # With some 300 confirmed examples about seven in ten are found at the threshold.
    assert np.mean(np.array(toxic) >= 0.7) > 0.6
