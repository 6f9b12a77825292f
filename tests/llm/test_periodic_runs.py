"""Periodic runs against a search over all periods and stretches."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import periodic_runs
from faultline.llm.catalog import LLM_QUERIES

SF = "/root/testdata/sf0.001"


def by_hand(words):
    """(start, length, period) of every maximal run: for each period the stretches over which words agree a period on."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        start = None
        for k in range(n - q + 1):
            if k < n - q and words[k] == words[k + q]:
                start = k if start is None else start
            elif start is not None:
                length = k - start + q
                if length >= max(6, 4 * q):
                    out.setdefault((start, length), q)
                start = None
    return sorted(((s, l, q) for (s, l), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed_by_hand(words, runs):
    dropped = {k for s, l, q in runs for k in range(s + q, s + l)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


def made_texts(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = []
        while len(words) < rng.randint(0, 90):
            unit = [rng.choice("abcdef"[: rng.randint(1, 6)]) for _ in range(rng.randint(1, 9))]
            words += (unit * rng.randint(1, 7))[: rng.randint(1, 60)]
        out.append(words)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_words(seed, monkeypatch):
    monkeypatch.setattr(periodic_runs, "TOGETHER", 200)
    texts = made_texts(seed, 150) + [[], ["a"], ["a"] * 6, ["a"] * 5, list("ab") * 4, list("ab") * 3 + ["a"], list("abcabcabcabc"), list("aabaab") * 9]
    rows = periodic_runs.runs_of([[w.encode() for w in t] for t in texts])
    got = [[] for _ in texts]
    for text, *run in rows.tolist():
        got[text].append(tuple(run))
    assert got == [by_hand(t) for t in texts]


def test_agree():
    rng = np.random.default_rng(3)
    symbols = np.concatenate([[0], rng.integers(1, 3, 60), np.tile(rng.integers(1, 4, 7), 12), np.full(40, 2), [9]])
    grammar = periodic_runs.Grammar(symbols)
    back = grammar.mirrored()
    i, j = np.triu_indices(len(symbols), 1)
    plain = [next(k for k in range(len(symbols)) if b + k == len(symbols) or symbols[a + k] != symbols[b + k]) for a, b in zip(i.tolist(), j.tolist())]
    assert grammar.agree(i, j).tolist() == plain
    plain = [next(k for k in range(len(symbols)) if a - k < 0 or symbols[a - k] != symbols[b - k]) for a, b in zip(i.tolist(), j.tolist())]
    assert back.agree(len(symbols) - 1 - i, len(symbols) - 1 - j).tolist() == plain


def test_find_awkward_rows(spark):
    rows = [(1, "a a a a a a"), (2, None), (3, ""), (4, " \t\n"), (5, "x y x y x y x y z"), (5, "x y x y x y x y z"), (None, "b\tb\nb b b b b"), (6, "é ü " * 5), (7, "u v u v u v u v u v u v")]
    schema = "doc_id {}, text string, runs int, start int, collapsed string, words int, n int"
    for kind in ("long", "int", "string"):
        own = [(k if k is None or kind != "string" else str(k), t, 1, 2, "c", 3, 4) for k, t in rows]
        found = periodic_runs.find(spark.createDataFrame(own, schema.format(kind)))
        assert dict(found.dtypes)["doc_id"] == {"long": "bigint"}.get(kind, kind)
        got = sorted(((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()), key=str)
        want = []
        for k, t in rows:
            words = re.findall("[^\x20\x09-\x0d]+", t or "")
            want.append((str(k), by_hand(words), collapsed_by_hand(words, by_hand(words))))
        assert got == sorted(want, key=str)
        assert periodic_runs.repeat_tails(spark.createDataFrame(own, schema.format(kind))).count() == len(rows)
    assert periodic_runs.find(spark.createDataFrame([], schema.format("long"))).count() == 0


def test_find_very_long_text(spark):
    unit = [f"w{k}" for k in range(20_000)]
    words = ["start"] + unit * 40 + ["end"]  # some 5 MB with one run of period 20,000
    text = " ".join(words)
    assert len(text) > 5_000_000
    (row,) = periodic_runs.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(1, 800_000, 20_000)] and row.collapsed == " ".join(["start", *unit, "end"])


def test_query(spark):
    got = {r.doc_id: r for r in LLM_QUERIES["op13_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = by_hand(words)
        best = min(((-l, s, q) for s, l, q in runs), default=None)
        want = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        r = got[doc_id]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        assert r.runs_sha256 == sha("".join(f"{s},{l},{q}\n" for s, l, q in runs)) and r.collapsed_sha256 == sha(collapsed_by_hand(words, runs))


def test_tails_of_periodic_documents(spark):
    rows = [(k, " ".join(f"w{i}" for i in range(k % 97))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    changed = periodic_runs.repeat_tails(docs).join(docs.select("doc_id", F.col("text").alias("before")), "doc_id").where("text <> before").count()
    assert 0 < changed < 60
