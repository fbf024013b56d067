"""The source audit against a loop over all groups and terms."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
from siltwork.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, most):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    held, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        held[lang, source].update(terms)
        df[lang].update(set(terms))
    kept = {lang: [t for t, n in df[lang].items() if n >= 3] for lang in {r[1] for r in rows}}
    share = lambda n, whole: 1 + 10**9 * (n + 1) // whole
    p = {}
    for (lang, source), c in held.items():
        whole = sum(c[t] for t in kept[lang]) + len(kept[lang])
        p[lang, source] = {t: share(c[t], whole) for t in kept[lang]}
    q = {}
    for lang, terms in kept.items():
        c = Counter()
        for (of, _), own in held.items():
            if of == lang:
                c.update(own)
        whole = sum(c[t] for t in terms) + len(terms)
        q[lang] = {t: share(c[t], whole) for t in terms}
    f = lambda x, y: (x - y) ** 2 // y
    out = []
    for lang, source in held:
        own = p[lang, source]
        pairs = [(-sum(f(own[t], p[o][t]) for t in own), o[1]) for o in held if o[0] == lang and o[1] != source]
        terms = [(-f(own[t], q[lang][t]), t) for t in own if held[lang, source][t] and own[t] > q[lang][t]]
        for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:most])):
            out += [(lang, source, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_a_loop(documents, corpus):
    want = brute([r[1:4] for r in corpus], 25)
    assert got(divergence.audit(documents, most_terms=25)) == want
    assert {r[2] for r in want} == {"pair", "term"}


def test_many_sources_and_ranges(spark, monkeypatch):
    """More sources than teams hold, an odd number of teams, vectors in many ranges, a source with most rows, terms with equal values."""
    rng = random.Random(5)
    vocabulary = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'é' if k % 7 else 'Z'}" for k in range(100)]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randrange(30))), rng.choice(["x", "y"]), f"s{rng.randrange(20) if rng.random() < 0.6 else 0}") for _ in range(400)]
    rows += [("alone here", "z", f"s{k}") for k in range(2)]  # keeps no term
    monkeypatch.setattr(divergence, "RANGE", 16)
    monkeypatch.setattr(divergence, "HELD", 64)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert got(divergence.audit(docs, most_terms=5)) == brute(rows, 5)


def test_empty_table(spark, nothing):
    assert divergence.audit(nothing).collect() == []
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("siltwork")]  # nothing is left in the catalog


def test_rounds_meet_once():
    for teams in (2, 4, 6, 12):
        met = [frozenset(x) for r in divergence.rounds(teams) for x in r.items()]
        assert len(met) == len(set(met)) == teams * (teams - 1) // 2
        for r in divergence.rounds(teams):
            assert not set(r) & set(r.values()) and len(set(r.values())) == len(r)


def test_vectors_survive_packing():
    rng = np.random.default_rng(3)
    for n, most in ((0, 2), (1, 200), (50, 1 << 20), (900, 1 << 47)):
        ids = np.sort(rng.choice(1 << 20, n, replace=False)).astype(np.int64)
        counts = rng.integers(1, most, n)
        a, b = divergence.unpacked(divergence.packed(ids, counts))
        assert a.tolist() == ids.tolist() and b.tolist() == counts.tolist()


def test_shares_are_exact_for_large_counts():
    n, whole = np.array([0, 7, 123_456_789_012_345]), 140_000_000_000_001
    assert divergence.shares(n, whole).tolist() == [1 + 10**9 * (int(x) + 1) // whole for x in n]
