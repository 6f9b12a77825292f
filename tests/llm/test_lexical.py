"""Ranked lexical search against scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from faultline.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(docs, items, k=10):
    own = [(key, Counter(TERM.findall((text or "").translate(LOWER)))) for key, text in docs]
    own = [(key, c, sum(c.values())) for key, c in own if c]
    n, total = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in sorted({(i, t or "") for i, t in items}, key=str):
        scored = []
        for key, c, size in own:
            m = 100 - 90 + 90 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(text.translate(LOWER))) if t in c)
            if score > 0:
                scored.append((-score, key is None, key))
        out += [(item, rank, key, -s) for rank, (s, _, key) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], str(x[2]).zfill(20)))[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, kind="long"):
    d = spark.createDataFrame([(k, t, 1, 2, [3], 4) for k, t in docs], f"doc_id {kind}, text string, sizes int, rank int, df array<int>, score int")
    i = spark.createDataFrame([(k, t, 7, 8) for k, t in items], "item_id long, text string, doc_id int, part int")
    return sorted(map(tuple, lexical.search(lexical.index(d), i).collect()), key=str)


def made(seed, n, longest):
    rng, words = random.Random(seed), [f"t{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, longest))) for _ in range(n)]
    return [(i, rng.choice(texts) if rng.random() < 0.3 else t) for i, t in enumerate(texts)], [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 30)))) for i in range(25)]


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, monkeypatch, small):
    if small:
        for name, value in {"BLOCK": 16, "STEP": 3000, "ITEMS": 7, "FIRST": 2}.items():
            monkeypatch.setattr(lexical, name, value)
    docs, items = made(1 + small, 400, 120)
    assert found(spark, docs, items) == by_hand(docs, items)


def test_awkward_rows(spark):
    docs = [(1, "One two, two THREE"), (1, "One two, two THREE"), (1, "four"), (2, None), (3, ""), (4, "?! \x00\x7f"), (None, "two two two"), (5, "Éa éa éA two"), (6, "a1b2 a1-b2"), (9, "pad " * 50_000 + "rare")]
    items = [(1, "two three"), (1, "two three"), (1, "rare four"), (2, None), (3, ""), (4, "unknown"), (5, "éa Éa É a"), (None, "a1b2 b2 pad")]
    assert found(spark, docs, items) == by_hand(docs, items)
    assert found(spark, [(None if k is None else str(k), t) for k, t in docs], items, "string") == by_hand([(None if k is None else str(k), t) for k, t in docs], items)
    assert found(spark, docs, items, "int") == by_hand(docs, items)
    assert found(spark, [], items) == found(spark, docs, []) == found(spark, [(1, None)], items) == []


def test_very_long_text(spark):
    docs = [(1, " ".join(f"w{i % 40_000}" for i in range(800_000))), (2, "w1 w2 w3"), (3, "w1 w1 w1 w1 x")]
    items = [(1, "w1 w2"), (2, "w39999 x")]
    assert len(docs[0][1]) > 5_000_000 and found(spark, docs, items) == by_hand(docs, items)


def test_bounds_are_never_too_low():
    docs, items = made(5, 300, 200)
    own = [list(dict.fromkeys(lexical.terms(t.encode()))) for _, t in items]
    wanted = list(dict.fromkeys(t for x in own for t in x))
    import numpy as np

    weights = np.arange(1, len(wanted) + 1)
    look = lexical.Search(own, wanted, weights, 300, 30_000, 10)
    left_out = 0
    for block in lexical.blocks_of([k for k, _ in docs], [t.encode() for _, t in docs]):
        sizes = np.array(block["sizes"])
        length = 10 + 90 * sizes * 300 // 30_000
        bounds = look.bounds(np.frombuffer(block["bits"], np.uint8).reshape(block["rows"], -1), block["levels"], length)
        often = look.scores(block["texts"]).astype(np.int64)
        exact = np.stack([look.shares(often[:, at], length[:, None]) @ weights[at] for at in look.items])
        assert (bounds >= exact).all()
        left_out += (bounds == 0).sum()
    assert left_out > 0
