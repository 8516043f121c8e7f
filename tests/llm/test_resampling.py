import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import regular_sort, resampling
from cohortloom.llm.blocks import as_block
from cohortloom.llm.queries import registry
from cohortloom.session import materialise
from tests.compare import connect, differences
from tests.llm.helpers import LONG, empty_docs, odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most=2):
    words = WORD.findall((text or "").translate(LOWERED))
    runs = [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]
    return words, [zlib.crc32(r.encode()) for r in runs]


def brute(docs, target, buckets=10_000, percent=25, least=20):
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, text in docs:
        np.add.at(s, np.array(features(text)[1], int) % buckets, 1)
    for text in target:
        np.add.at(t, np.array(features(text)[1], int) % buckets, 1)
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets))))
        for b in range(buckets)
    ]
    rows, enough = [], []
    for key, text in docs:
        words, runs = features(text)
        weight = sum(gain[r % buckets] for r in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(runs), weight, score, None])
        if len(words) >= least:
            enough.append(rows[-1])
    enough.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, row in enumerate(enough[: percent * len(enough) // 100]):
        row[4] = i + 1
    return sorted(map(tuple, rows), key=repr)


def some_text(rng):
    words = ["é", "Straße", "x" * 64, "y" * 63, "z" * 300, "1", "the", "Of", "日本"]
    gaps = [" ", "\n", "-", "._", "\t \r\n", "`{"]
    return "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(0, 60)))


@pytest.mark.parametrize("at_once", [3, 1 << 17])
def test_runs_and_sums_equal_plain_ones(monkeypatch, at_once):
    monkeypatch.setattr(resampling, "_WORDS_AT_ONCE", at_once)
    rng = random.Random(5)
    texts = [some_text(rng) for _ in range(40)] + [None, "", " ", "x" * 70_000 + " " + "b" * 4095 + " c"]
    block = as_block(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}))
    for most in (1, 2, 4):
        n_words, runs = resampling.word_runs(block, most)
        got = [[] for _ in texts]
        for owner, run in runs:
            for o, r in zip(owner.tolist(), run.tolist(), strict=True):
                got[o].append(r)
        for text, n, own in zip(texts, n_words.tolist(), got, strict=True):
            words, expected = features(text, most)
            assert n == len(words) and sorted(own) == sorted(expected)


def test_resample_equals_brute_force_with_odd_rows(spark):
    rng = random.Random(6)
    texts = [some_text(rng) for _ in range(150)] + [LONG[:5000]] * 30
    frame = odd_docs(spark, texts).selectExpr("*", "'r' AS rank", "'w' AS weight", "1 AS __text", "2 AS __o1")
    target = spark.createDataFrame([("the of 日本 straße",), (None,), ("x",)], "text string")
    found = resampling.resample(frame.repartition(6), target, keep=["n", "kept"])
    assert {(r["n"], r["kept"]) for r in found.collect()} == {("x", "x")}
    got = [tuple(r) for r in found.drop("n", "kept").collect()]
    docs = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert sorted(got, key=repr) == brute(docs, [r["text"] for r in target.collect()])
    assert any(r[4] == 1 for r in got)
    assert resampling.resample(empty_docs(spark), target).count() == 0
    without = resampling.resample(frame, target.limit(0))
    assert sorted([tuple(r) for r in without.collect()], key=repr) == brute(docs, [])


def test_ranks_are_exact_with_one_hot_key_and_uneven_runs(spark):
    rng = random.Random(7)
    rows = [(5 if i % 3 == 0 else rng.randrange(-50, 50), rng.randrange(3), i, i % 11 != 0) for i in range(4000)]
    frame = spark.createDataFrame(rows, "a long, b long, c long, w boolean").repartitionByRange(9, "c")
    frame = materialise(frame.withColumn("w", F.when(F.col("c") != 12, F.col("w"))), "ranks-test")
    order = sorted((r[:3] for r in rows if r[3] and r[2] != 12))
    for segments, share in ((1, (1, 1)), (13, (1, 4)), (64, (99, 100)), (5, (0, 1))):
        found = regular_sort.exact_ranks(frame, ["a", "b", "c"], "w", share, segments=segments)
        take = len(order) * share[0] // share[1]
        got = {tuple(r)[:3]: r["rank"] for r in found.collect()}
        assert len(got) == 4000
        assert {k: v for k, v in got.items() if v} == {k: i + 1 for i, k in enumerate(order[:take])}


def test_segments_keep_the_bound_of_regular_samples():
    rng = np.random.default_rng(8)
    runs = [np.sort(rng.zipf(1.3, n).clip(0, 1000) * 10_000 + np.arange(n)) for n in (3000, 500, 40, 1)]
    step, segments = 20, 8
    samples = np.concatenate([r[step - 1 :: step] for r in runs])[:, None]
    cuts = regular_sort.splitters(samples, segments)
    place = regular_sort.segment_of(np.concatenate(runs)[:, None], cuts)
    sizes = np.bincount(place, minlength=segments)
    assert sizes.max() <= (-(-len(samples) // segments) + len(runs)) * step
    assert (place == np.searchsorted(cuts[:, 0], np.concatenate(runs), "right")).all()


def test_noise_is_the_stated_one(spark):
    found = spark.range(200).select("id", resampling.noise(F.col("id"), 7).alias("g")).collect()
    for key, g in found:
        h = int(hashlib.sha256(f"7:{key}".encode()).hexdigest()[:8], 16)
        assert g == math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def test_query_equals_sql(spark):
    name = "op11_importance_resampling"
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert differences(registry.queries[name](spark, sf), connect(sf), registry.sql[name]) is None
