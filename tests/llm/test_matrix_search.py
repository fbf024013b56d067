"""The blocked product against a loop over documents and items."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from siltwork.llm import matrix_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    tf = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n, total = sum(x[2] > 0 for x in tf), sum(x[2] for x in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, want in asked.items():
        found = []
        for d, c, m in tf:
            norm = 75 + (25 * m * n) // max(total, 1)
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * norm)) for t, times in want.items() if c[t])
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


def items(spark, corpus):
    rows = [(k, r[1][:300] if r[1] else r[1]) for k, r in enumerate(corpus) if k % 7 == 0 or r[0] is None or r[0] >= 300]
    rows += [(None, "one"), (0, "Th-TH th er"), (9000, "nowhere at all zzz"), (9001, None), (9002, corpus[156][1])]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def test_equals_a_loop(spark, documents, corpus, monkeypatch):
    rows, table = items(spark, corpus)
    want = brute([r[:2] for r in corpus], rows, 6)
    found = lambda: sorted(tuple(r) for r in matrix_search.top_k(documents, table, k=6).collect())
    assert found() == want
    monkeypatch.setattr(matrix_search, "DOCS", 20)
    monkeypatch.setattr(matrix_search, "ITEM_TERMS", 100)
    assert found() == want


def test_empty_tables(spark, documents, nothing):
    asked = spark.createDataFrame([(1, "the one")], "item_id long, text string")
    assert matrix_search.top_k(nothing, asked).collect() == []
    assert matrix_search.top_k(documents, asked.limit(0)).collect() == []


def test_lengths_beyond_64_bits():
    n = np.array([0, 3, 10**9])
    got = matrix_search._lengths(n, 10**11, 10**13)
    assert got.tolist() == [75 + 25 * int(x) * 10**11 // 10**13 for x in n]
