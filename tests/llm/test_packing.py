import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from cohortloom.llm import packing, tokens
from cohortloom.llm.blocks import as_block
from cohortloom.llm.tokens import WordEncoder, encoder
from tests.llm.helpers import empty_docs, odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(6)
    alphabet = [*"abcXYZ stmdrevl'\"\n\t019.,;!<|>-", *map(chr, range(0x80, 0x100)), "'s", "'LL", "'re", "'d"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 50))) for _ in range(1500)]
    texts += ["x<|endoftext|>y", "İstanbul ΑΣ", "日本語 text", "", None, "œuvre", "a\x1cb", "e\u0301"]
    block = as_block(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))
    ids, counts = encoder(PATH).encode_block(block)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for text, part in zip(texts, parts, strict=True):
        assert part.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_a_text_with_more_words_than_the_table_holds(monkeypatch):
    monkeypatch.setattr(tokens, "_MAX_WORDS", 50)
    monkeypatch.setattr(tokens, "_APART", 20, raising=False)
    tokenizer = Tokenizer.from_file(PATH)
    own = WordEncoder(PATH)
    rng = random.Random(8)
    many = [" ".join("".join(rng.choices("abcdé'019.", k=6)) for _ in range(300)), "one two"]
    for texts in (["one two three"], many, ["日本語", *many], ["two three four"]):
        block = as_block(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))
        ids, counts = own.encode_block(block)
        for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert part.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_plan(counts, capacity):
    plan = packing.plan_lengths(np.array(counts), capacity)
    places = defaultdict(list)
    ranks = defaultdict(list)
    runs = sorted(zip(plan.length, plan.rank, plan.per, plan.sequence, plan.offset, strict=True))
    for i, (length, rank, per, sequence, offset) in enumerate(runs):
        after = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else counts[length]
        for t in range(after - rank):
            places[sequence + t // per].append((offset + t % per * length, length))
            ranks[length].append(rank + t)
    for own in places.values():
        own.sort()
        assert own[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
        assert own[-1][0] + own[-1][1] <= capacity
    assert {n: len(r) for n, r in ranks.items()} == {n: c for n, c in enumerate(counts) if c and n}
    assert sorted(places) == list(range(plan.n_sequences))
    return plan.n_sequences


def test_plans_are_valid_and_tight():
    rng = random.Random(1)
    for capacity in (1, 7, 50, 300):
        for _ in range(12):
            counts = [0] * (capacity + 1)
            for _ in range(rng.randint(0, 400)):
                counts[rng.randint(1, capacity)] += 1
            total = sum(n * c for n, c in enumerate(counts))
            n = check_plan(counts, capacity)
            assert n >= -(-total // capacity)
            big = sum(c for length, c in enumerate(counts) if 2 * length > capacity)
            assert n <= max(-(-total * 11 // capacity // 9), big) + 2


def test_exact_complements_are_used():
    counts = [0] * 101
    for a, b, c, d in ((40, 30, 20, 10), (60, 40, 0, 0), (50, 25, 25, 0), (97, 3, 0, 0)):
        for n in (a, b, c, d):
            counts[n] += 7 * (n > 0)
    assert check_plan(counts, 100) == 28


def test_pack(spark):
    docs = odd_docs(spark, ["the cat " * 40, "a", "the cat " * 40, "b c"])
    found = packing.pack(docs, PATH, capacity=64, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    by_doc = defaultdict(list)
    for r in found:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        by_doc[r["doc_id"]].append(r)
    for row in docs.collect():
        ids = [*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[row["doc_id"]], key=lambda r: r["piece"])
        if row["doc_id"] == 1:
            assert len(own) == 2
            continue
        assert sum((r["ids"] for r in own), []) == ids
        assert [r["start"] for r in own] == list(range(0, len(ids), 64))
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and sum(n for _, n in own) <= 64
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    total = sum(r["length"] for r in found)
    assert len(sequences) <= -(-total // 64) + 1
    assert packing.pack(empty_docs(spark), PATH).count() == 0
