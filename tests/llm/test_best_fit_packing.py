import random
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from dealsight.llm import packing
from tests.llm.fixture_rows import awkward, documents, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_equal_the_tokenizer():
    whole, mine = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    rng = random.Random(3)
    alphabet = list("aBcé'ß.,!<|>_-0 9\n\tÉİσΣ\x1ć ªµ½") + ["<|endoftext|>", "'s", "don't", "ﬁ", " ", "ŒU"]
    items = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(3000)] + [t or "" for _, t in awkward()]
    for text in items:
        assert np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes() == mine.encode(text), repr(text)


def test_configurations_cover_the_demand_exactly():
    rng = random.Random(5)
    for _ in range(20):
        cap = rng.choice([20, 64, 200])
        demand = {n: rng.randrange(1, 40) for n in rng.sample(range(1, cap + 1), rng.randrange(1, min(cap, 30)))}
        plan = packing.solve(dict(demand), cap)
        held = {}
        for used, m in plan:
            assert m > 0 and sum(k * n for k, n in used.items()) <= cap
            for k, n in used.items():
                held[k] = held.get(k, 0) + n * m
        assert held == demand
        plain = packing.best_fit(dict(demand), [], cap)
        assert sum(m for _, m in plan) <= 1.01 * sum(m for _, m in plain) + 1


def check(rows, docs, cap):
    whole = Tokenizer.from_file(PATH)
    want = []
    for doc, text in docs:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(doc, k, a, len(ids[a:a + cap]), zlib.crc32(np.array(ids[a:a + cap], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), cap))]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=order) == sorted(want, key=order)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    plain = packing.best_fit(dict(Counter(r.length for r in rows)), [], cap)
    return len(by), sum(m for _, m in plain)


@pytest.mark.parametrize("cap", [64, 4096])
def test_round_trip(spark, cap):
    docs = awkward() + [(100 + i, prose(i, 5 + i % 70)) for i in range(150)]
    n, plain = check(packing.pack(documents(spark, docs), PATH, capacity=cap).collect(), docs, cap)
    assert n <= 1.01 * plain + 1


def test_ids_and_empty_table(spark):
    r = packing.pack(documents(spark, [(1, "hello world")]), PATH, with_ids=True).first()
    assert r.ids[-1] == 1 and len(r.ids) == r.length
    assert packing.pack(documents(spark, []), PATH).count() == 0
