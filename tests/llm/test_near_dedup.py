import random
import re

import numpy as np

from cohortloom.llm import near_dedup
from cohortloom.llm.graph import components
from tests.llm.helpers import WORDS, empty_docs, odd_docs, sentence


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute(rows, k, percent):
    sets = {d: shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.choice([5, 12, 60, 150]))
        for copy in range(8):
            own = list(words)
            for _ in range(copy * len(own) // 80):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if base % 3 == 0:
                own += passage
            rows.append((base * 10 + copy, " ".join(own)))
    rng.shuffle(rows)
    return rows


def test_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for how in (near_dedup.Settings(), near_dedup.Settings(3, 85, 8)):
        expected = brute(rows, how.words, how.percent)
        got = {
            r["doc_id"]: (r["n_shingles"], r["component_id"])
            for r in near_dedup.near_duplicates(docs, how=how).collect()
        }
        assert got == expected


def test_sample_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {
        r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
        for r in near_dedup.near_duplicates(docs, how=near_dedup.Settings(3, 85, 8)).collect()
    }
    assert got == {d: (n, c, c == d) for d, (n, c) in brute(rows, 3, 85).items()}


def test_odd_rows(spark):
    docs = odd_docs(spark, ["One line here.\nAnother line there.", "ONE line here. another LINE there."])
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    got = {r["doc_id"]: r for r in found}
    for blank in (2, 3, 4):
        assert (got[blank]["n_shingles"], got[blank]["component_id"], got[blank]["kept"]) == (0, blank, True)
    assert got[100]["component_id"] == got[101]["component_id"] == 1
    assert [r["kept"] for r in found if r["doc_id"] == 1] == [True, True]
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert near_dedup.near_duplicates(empty_docs(spark)).count() == 0


def test_registers_agree_like_similarity_and_estimate_it():
    rng = np.random.default_rng(0)
    m = 276
    for j in (0.5, 0.8, 0.95):
        shared = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        rest = int(2000 * (1 - j) / j / 2)
        a = np.concatenate((shared, rng.integers(0, 2**63, rest, dtype=np.uint64)))
        b = np.concatenate((shared, rng.integers(0, 2**63, rest, dtype=np.uint64)))
        found = near_dedup.sketches(np.concatenate((a, b)), np.array([len(a), len(b)]), m)
        assert abs((found[0] == found[1]).mean() - j) < 0.1
        n = np.array([len(a)])
        assert abs(near_dedup.joint_similarity(found[:1], found[1:], n, n)[0] - j) < 0.1


def test_sketches_merge_by_the_maximum():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = rng.integers(0, 2**63, 30, dtype=np.uint64)
    both = near_dedup.sketches(np.concatenate((a, b)), np.array([530]), 100)
    apart = near_dedup.sketches(np.concatenate((a, b)), np.array([500, 30]), 100)
    assert (both[0] == apart.max(axis=0)).all()


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (8, 8), (7, None), (20, 10), (20, 11), (11, 1)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in found} == {
        3: 3, 4: 3, 5: 3, 8: 8, 9: 8, 1: 1, 10: 1, 11: 1, 20: 1,
    }
    chain = spark.range(1, 60).selectExpr("id AS a", "id - 1 AS b")
    assert components(chain).filter("component <> 0").count() == 0
    assert components(chain.limit(0)).count() == 0


def test_small_sets_at_the_threshold_share_a_band():
    # Four of five shingles: with neighbouring registers in a band, two of these pairs share none.
    how = near_dedup.Settings()
    big = np.random.default_rng(4).integers(0, 1 << 63, (10_000, 5), dtype=np.int64).astype(np.uint64)
    keys = []
    for sets in (big, big[:, :4]):
        n, size = sets.shape
        found = near_dedup.sketches(np.sort(sets, 1).ravel(), np.full(n, size), how.registers)
        keys.append(near_dedup.band_keys(found, how))
    assert (keys[0] == keys[1]).any(axis=1).all()


def test_texts_of_a_repeated_id_are_sets_of_their_own(spark):
    rng = random.Random(31)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(45)]
    near = base[:44] + ["other"]
    rows = [(2, sentence(rng, 60)), (2, " ".join(base)), (5, " ".join(near)), (7, sentence(rng, 40)), (2, sentence(rng, 9))]
    for _ in range(3):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        found = near_dedup.near_duplicates(docs).collect()
        assert {(r["doc_id"], r["component_id"]) for r in found} == {(2, 2), (5, 2), (7, 7)} and len(found) == 5
