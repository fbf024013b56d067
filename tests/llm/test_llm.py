"""The dealt operators against brute force, on whole small tables with the awkward rows."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from siltwork.llm import chat, cover_tree, mixing, ngram_join, packing, pii, quality, queries, search, suffix_tree, textscan, toxicity
from siltwork.operators import graph

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def held(doc_id, of):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % of


# --- words ------------------------------------------------------------------------


def test_words_and_shingles(corpus, words):
    import pyarrow as pa

    texts = [r[1] for r in corpus]
    offsets, data = textscan.string_bytes(pa.array(texts))
    seen = {}
    for limit in (1, 500, 1 << 20):
        for i, j in textscan.slices(offsets, limit):
            w = textscan.words(offsets, data, i, j)
            assert w.per_row.tolist() == [len(words(t)) for t in texts[i:j]]
            flat = [x for t in texts[i:j] for x in words(t)]
            for x, h in zip(flat, w.hash.tolist(), strict=True):
                assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


# --- op1 --------------------------------------------------------------------------


def test_lm_base_score_and_gain(documents, corpus, words):
    got = suffix_tree.score_texts(documents).collect()
    tok = [(r[0], held(r[0], 10) == 0, [*words(r[1]), "\n"]) for r in corpus]
    c = Counter(w for _, h, t in tok if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((d if d is not None else -1), h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 5)) for d, h, t in tok)
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    away = [r for r in got if r.held_out]
    assert sum(r.score for r in away) > sum(r.base_score for r in away)


def test_lm_same_for_any_head(documents):
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens)
    a = sorted(suffix_tree.score_texts(documents).collect(), key=key)
    b = sorted(suffix_tree.score_texts(documents, head_words=50).collect(), key=key)
    assert np.allclose([r.base_score for r in a], [r.base_score for r in b]) and [r.n_known for r in a] == [r.n_known for r in b]


def test_lm_score_is_the_same_for_any_head(documents):
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens)
    a = sorted(suffix_tree.score_texts(documents).collect(), key=key)
    b = sorted(suffix_tree.score_texts(documents, head_words=50).collect(), key=key)
    assert np.allclose([r.score for r in a], [r.score for r in b], rtol=1e-5)


def tree_scores(tok):
    """log10 scores of (learn, words and end) by all contexts of 1 to 3 words, and the retained contexts' distributions."""
    c = Counter(w for learn, t in tok if learn for w in t)
    n, v = sum(c.values()), len(c)
    root = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    nexts = defaultdict(Counter)
    for learn, t in tok:
        full = ["<start>", *t]
        for i in range(1, len(full)):
            for k in range(1, min(3, i) + 1):
                nexts[tuple(full[i - k : i])][full[i]] += learn

    state = {}

    def p(context, w):
        if not context:
            return root(w)
        if context not in state:
            own = +nexts[context]
            m, kinds = sum(own.values()), max(1, len(own))
            gain = sum(x * (math.log((x - 1 + kinds * p(context[1:], s)) / max(m - 1 + kinds, 1e-9)) - math.log(p(context[1:], s))) for s, x in own.items())
            state[context] = (own, m, kinds) if gain > math.log(m + 1) else None
        if state[context] is None:
            return p(context[1:], w)
        own, m, kinds = state[context]
        return (own[w] + kinds * p(context[1:], w)) / (m + kinds)

    scores = []
    for _, t in tok:
        full = ["<start>", *t]
        scores.append(sum(math.log10(p(tuple(full[max(0, i - 3) : i]), full[i])) for i in range(1, len(full))))
    for context in [x for x, kept in state.items() if kept]:
        assert math.isclose(sum(p(context, w) for w in c) + p(context, "<unknown>"), 1)
    return scores, Counter(len(x) for x, kept in state.items() if kept)


@pytest.mark.parametrize(("head_words", "hot_share", "hot_least"), [(1 << 18, 1e-4, 1 << 14), (30, 0.0, 40), (0, 0.0, 3)])
def test_lm_scores_in_the_longest_retained_suffix(spark, words, tmp_path, head_words, hot_share, hot_least):
    rng = random.Random(4)
    line = "of the one and of the two and then of the end".split()
    texts = []
    for i in range(160):
        t = [rng.choice(["of", "the", "and", "in", *(f"w{rng.randrange(40)}" for _ in range(3))]) for _ in range(rng.randrange(30))]
        texts.append(" ".join([*line, *t, "in the", f"once{i}"] if i % 2 else ["of of of", *t, "the the and", *line[3:]]))
    texts += ["", None, "of", "of the of", "never seen of the"]
    path = f"file://{tmp_path}/d"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    want, kept = tree_scores([(held(i, 10) != 0, [*words(t), "\n"]) for i, t in enumerate(texts)])
    assert all(kept[k] for k in (1, 2, 3))
    got = {r.doc_id: r.score for r in suffix_tree.score_texts(spark.read.parquet(path), head_words=head_words, hot_share=hot_share, hot_least=hot_least).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, rtol=1e-5, atol=1e-5)


# --- op2 --------------------------------------------------------------------------


def classes(rows, width, percent, words):
    sets = []
    for d, t in rows:
        w = words(t)
        sets.append((d, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    names = defaultdict(list)
    for i in range(len(sets)):
        if sets[i][0] is not None:
            names[find(i)].append(sets[i][0])
    return sorted((repr(d), len(s), min(names[find(i)], default=None)) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_classes(documents, corpus, words, width, percent):
    got = ngram_join.jaccard_classes(documents, width, percent).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in got) == classes([(r[0], r[1]) for r in corpus], width, percent, words)


def test_one_of_each_class_stays(documents):
    kept = ngram_join.one_of_each(documents, 5, 80)
    again = ngram_join.jaccard_classes(kept, 5, 80).collect()
    assert kept.columns == documents.columns
    full = ngram_join.jaccard_classes(documents, 5, 80).collect()
    assert kept.count() == sum(r.keep for r in full)
    assert {r.component_id for r in full if r.n_shingles} >= {r.doc_id for r in again if r.n_shingles}
    assert {300, 301, 302} <= {r.doc_id for r in kept.collect()}


# --- op3 --------------------------------------------------------------------------

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= sum(c.isdigit() for c in v) <= 19 and luhn(v)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= sum(c.isdigit() for c in v) <= 15),
)


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in re.finditer(p, text) if ok(m.group())]


PERSONAL = [
    "a@b.c_d@e.f x", "a@b@c.d", "1.2.3.4.5", "1.2.3.4 5.6.7.8", "4111 1111 1111 1111", "14111-1111-1111-1111 9", "+1 (222) 333-4444 5", "+++1 22 33 44 55 66  ", "é+1 (222) 333-4444 \U0001f600 x@y.zz",
    "5" * 5000, "a" * 20000 + "@b.c", "1 " * 3000 + "4111111111111111", "", None, "user (at) host (dot) com", "x@y", "300.1.1.1", "001.002.003.004", "4111111111111111-4111111111111111", "4111111111111111,4111111111111111",
    "+1-" * 40 + "2", "a@b.c@d.e.f g@h.i..j", "x@-.-", "٣٣٣٣ 1.2.3.4", " ".join(f"m{i}@h.org" for i in range(200)), "(319) 555-5010",
]


@pytest.fixture(scope="module")
def personal(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(PERSONAL)], "doc_id long, text string, base string")


def test_base_spans(personal):
    got = pii.spans(personal, pii.Booster([], 0.0, [float("inf")] * 4)).select("doc_id", F.expr(pii.text_of("__base")).alias("b")).collect()
    for r in got:
        assert r.b == ",".join(base_spans(PERSONAL[r.doc_id] or "")), PERSONAL[r.doc_id]


def test_added_spans_overlap_nothing(personal):
    eager = pii.Booster([], 5.0, [0.0] * 4)
    for r in pii.spans(personal, eager).select("doc_id", "__base", "__added").collect():
        every = sorted((x.s, x.e) for x in r["__base"] + r["__added"] if x in r["__added"])
        for x in r["__added"]:
            assert not any(b.s < x.e and x.s < b.e for b in r["__base"])
        assert all(a[1] <= b[0] for a, b in zip(every, every[1:], strict=False))
    found = {r.doc_id: r.a for r in pii.spans(personal, eager).select("doc_id", F.expr(pii.text_of("__added")).alias("a")).collect()}
    assert found[14] == "email:0:24" and found[25] == "phone:0:14"


def test_spans_in_texts_without_digits(spark):
    texts = ["write to anna [at] posta [dot] example", "ask anna [AT] posta.example", "host ab:cd:ef:ab:cd:ef:ab:cd up", "anna (at) posta (dot) example", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    eager = pii.Booster([], 5.0, [0.0] * 4)
    got = {r.doc_id: r.a for r in pii.spans(docs, eager).select("doc_id", F.expr(pii.text_of("__added")).alias("a")).collect()}
    assert got == {0: "email:9:38", 1: "email:4:27", 2: "ip:5:28", 3: "email:0:29", 4: ""}
    assert {r.doc_id: r.text for r in pii.redact(docs, eager).collect()}[0] == "write to <email>"


def test_redaction(personal):
    got = {r.doc_id: r.text for r in pii.redact(personal, pii.Booster([], 0.0, [float("inf")] * 4)).collect()}
    for i, t in enumerate(PERSONAL):
        want, at = t, 0
        if t:
            marks = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in base_spans(t)))
            want = ""
            for s, e, k in marks:
                if s >= at:
                    want += t[at:s] + f"<{k}>"
                at = max(at, e)
            want += t[at:]
        assert got[i] == want


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, (400, len(pii.FEATURES))).astype(float)
    y = ((x[:, 1] > 2) & (x[:, 2] <= 1)).astype(float)
    trees, bias = pii.boost(x, y, np.ones(400))
    assert ((pii.Booster(trees, bias, []).score(x) > 0) == (y == 1)).mean() > 0.99


def test_training_on_texts(documents, personal, nothing):
    assert pii.train(nothing).thresholds == [float("inf")] * 4
    assert pii.spans(documents, pii.train(personal)).count() == documents.count()


@pytest.fixture(scope="module")
def planted(spark):
    """(doc_id, text) with verified spans, loose forms and secrets in prose, and what must be found of the last."""
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice(["the", "re", "onan", "house", "e1r", "i2n", "of", "then"]) for _ in range(n))
    code = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n)) + "a1"
    phone = lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    rows, secrets = [], {}
    for i in range(900):
        a, b, kind = prose(rng.randint(3, 30)) + " ", " " + prose(rng.randint(3, 30)), i % 9
        value = [f"u{i}@mail{i % 7}.example.com", "+1 " + phone(), phone(), f"u{i} (at) mail (dot) org", code(18), code(38), f"10.{i % 256}.3.4", "plain", code(24)][kind]
        if kind in (4, 5):
            lead = "password=" if kind == 4 else 'token = "'
            rows.append((i, a + lead + value + ('"' if kind == 5 else "") + b))
            secrets[i] = f"secret:{len(a + lead)}:{len(a + lead + value)}"
        else:
            rows.append((i, a + value + b))
    return spark.createDataFrame(rows, "doc_id long, text string"), secrets


def test_added_spans_on_planted_texts(planted):
    docs, secrets = planted
    model = pii.train(docs)
    got = {r.doc_id: r.a for r in pii.spans(docs, model).select("doc_id", F.expr(pii.text_of("__added")).alias("a")).collect()}
    found = {i for i, a in got.items() if a}
    assert all(got[i] == a for i, a in secrets.items())  # recall of named secrets
    assert sum(i % 9 in (2, 3, 4, 5) for i in found) >= 0.99 * len(found)  # precision; loose phones and addresses are none of the base's
    assert sum(i % 9 in (2, 3) for i in found) >= 0.95 * 200


def test_sql_scores_equal_the_trees(planted):
    docs, _ = planted
    model = pii.train(docs)
    features = ", ".join(f"'{n}', {sql}" for n, sql in pii.FEATURES.items())
    rows = pii.labelled(docs).select(F.expr(f"named_struct({features})").alias("f")).select("f", F.expr(model.sql()).alias("s")).collect()
    assert len(rows) > 500 and len(model.trees) == 40
    assert np.allclose(model.score(np.array([list(r.f) for r in rows], dtype=float)), [r.s for r in rows])


def test_overlap_with_many_spans(spark):
    rng = random.Random(3)
    for _ in range(6):
        make = lambda n: sorted((a := rng.randrange(900), a + rng.randint(1, 9)) for _ in range(n))
        x, y = make(rng.choice([0, 5, 200])), make(rng.choice([0, 7, 150]))
        df = spark.createDataFrame([([{"s": a, "e": b} for a, b in x], [{"s": a, "e": b} for a, b in y])], "x array<struct<s: long, e: long>>, y array<struct<s: long, e: long>>")
        got = df.select(F.expr(pii._touched("x", "y")).alias("r")).first().r
        assert [(r.x.s, r.x.e, r.hit) for r in got] == [(a, b, any(c < b and a < d for c, d in y)) for a, b in x]


def test_a_text_of_100000_spans(spark):
    import time

    text = " ".join(f"m{i}@h.org or (at) {i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = pii.redact(docs, pii.Booster([], 5.0, [0.0] * 4)).first().text
    assert got == " ".join(f"<email> or (at) {i}" for i in range(100_000)) and time.time() - began < 60


def test_personal_data_beside_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x a@b.cc", 7, "b"), (1, "x a@b.cc", 7, "b"), (None, None, None, None)], "doc_id long, text string, __pii int, __base string")
    out = pii.redact(docs, pii.Booster([], 0.0, [float("inf")] * 4))
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, [r if r.text is None else type(r)(**(r.asDict() | {"text": "x <email>"})) for r in docs.collect()]))


def test_digest_is_of_the_base_spans(spark, personal, tmp_path):
    """The query's digest column over written documents, by kind and then start."""
    personal.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_pii_boosted_spans(spark, f"file://{tmp_path}").collect()}
    kinds = ["email", "ip", "card", "phone"]
    for i, t in enumerate(PERSONAL):
        spots = [x.split(":") for x in base_spans(t or "")]
        spots.sort(key=lambda x: (kinds.index(x[0]), int(x[1])))
        assert got[i].base_sha256 == hashlib.sha256(",".join(":".join(x) for x in spots).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(x[0] == k for x in spots) for k in kinds]
    assert len({r.base_sha256 for r in got.values()}) > 3


def greedy(spans):
    kept = []
    for s, e, kind, m in sorted(spans, key=lambda x: (-x[3], x[0], -x[1], x[2])):
        if all(e <= a or b <= s for a, b, *_ in kept):
            kept.append((s, e, kind, m))
    return sorted(kept)


def test_overlapping_proposals_compete(spark):
    """Any number of spans over one place; chains; one long span over hundreds; ties; equal spans; none."""
    rng = random.Random(8)
    cases = [[], [(0, 5, 1, 1.0)], [(0, 10, 4, 3.0), (8, 20, 4, 2.0), (18, 30, 4, 1.0)], [(0, 900, 4, 9.0)] + [(k * 2, k * 2 + 1, 3, 1.0) for k in range(400)], [(0, 900, 4, 0.5)] + [(k * 2, k * 2 + 2, 3, 1.0) for k in range(400)], [(3, 9, 1, 1.0)] * 4 + [(3, 9, 0, 1.0), (3, 12, 2, 1.0)]]
    for n in (5, 40, 150, 300):
        cases += [[(s := rng.randrange(n), s + rng.randint(1, 30), rng.randrange(5), rng.choice([0.0, 1.0, rng.random()])) for _ in range(n)] for _ in range(6)]
        cases.append([(rng.randrange(20), 50 + rng.randrange(20), rng.randrange(5), rng.random()) for _ in range(n)])  # all over one another
    rows = spark.createDataFrame([(i, sorted(c)) for i, c in enumerate(cases)], "i int, free array<struct<s: long, e: long, kind: int, m: double>>")
    got = {r.i: sorted(map(tuple, r.best)) for r in rows.select("i", F.expr(pii._best("free")).alias("best")).collect()}
    assert got == {i: greedy(c) for i, c in enumerate(cases)}


def test_one_secret_over_many_phones(spark):
    """A secret of hundreds of characters with forty phones in it is one span, if it is furthest above its threshold."""
    value = "a1" + "".join(f"{200 + k}.555-{1000 + k}x" for k in range(40))
    model = pii.Booster([("gen", list(pii.GENERATORS).index("bare_phone"), -1.0, 1.0)], 2.0, [float("inf")] * 4, {"named_secret": 0.0, "bare_phone": 0.0})
    docs = spark.createDataFrame([(0, f"token={value} end")], "doc_id long, text string")
    (row,) = pii.spans(docs, model).select(F.expr(pii.text_of("__added")).alias("a")).collect()
    assert row.a == f"secret:6:{6 + len(value)}"


# --- op4 --------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "window", "query_terms", "waves"), [(8, 1024, 1 << 22, (1 / 32, 1 / 8)), (4, 1, 400, (0.1, 0.4)), (2, 3, 1 << 22, ())])
def test_bm25_top_k(documents, corpus, words, monkeypatch, block, window, query_terms, waves):
    for name, value in (("SHARD", 40), ("BLOCK", block), ("WINDOW", window), ("QUERY_TERMS", query_terms), ("WAVES", waves)):
        monkeypatch.setattr(search, name, value)
    got = defaultdict(list)
    for r in search.top_k(documents, F.col("doc_id") % 25 == 0, 7).collect():
        got[r.query_id].append((r["rank"], r.doc_id, r.score))
    bags = [(d, Counter(words(t))) for d, t, *_ in corpus]
    n, average = len(bags), sum(sum(c.values()) for _, c in bags) / len(bags)
    df = Counter(w for _, c in bags for w in c)
    for q in {d for d, _ in bags if d is not None and d % 25 == 0}:
        asks = {w for d, c in bags if d == q for w in c}
        scores = []
        for d, c in bags:
            s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average)) for w in asks if w in c)
            if d is not None and s > 0:
                scores.append((-round(s, 6), d))
        want = [(k + 1, d, -s) for k, (s, d) in enumerate(sorted(scores)[:7])]
        assert [(a, b) for a, b, _ in sorted(got[q])] == [(a, b) for a, b, _ in want] and np.allclose([c for *_, c in sorted(got[q])], [c for *_, c in want])


def _shard(held, idf, rng, **blocks):
    """A shard over a matrix of counts, and the scores of its documents by term."""
    row, term = np.nonzero(held)
    tf, lengths = held[row, term], held.sum(axis=1)
    ids = rng.permutation(len(held)) * 7
    made = search.shard_row(ids, np.zeros(len(held), bool), lengths, row, (term + 1).astype(np.int64), tf)
    average = lengths.mean()
    full = np.where(held > 0, idf * held * 2.2 / (held + 1.2 * (0.25 + 0.75 * lengths[:, None] / average)), 0.0)
    return search.Shard(made, suffix_tree.Head(np.arange(1, held.shape[1] + 1, dtype=np.uint64)), idf, average, **blocks), ids, full


def test_pivots_and_block_maxima_lose_nothing():
    """A shard's answers with and without a threshold equal a sort of all scores."""
    rng = np.random.default_rng(5)
    n, terms = 400, 60
    held = (rng.random((n, terms)) < np.linspace(0.9, 0.02, terms)) * rng.integers(1, 5, (n, terms))
    shard, ids, full = _shard(held, np.linspace(0.2, 6, terms), rng, block=8, window=3)
    for _ in range(60):
        asks = np.sort(rng.choice(terms, rng.integers(1, terms), replace=False)).astype(np.int32)
        score = np.round(full[:, asks].sum(axis=1), 6)
        order = np.lexsort((ids, -score))[:10]
        order = order[score[order] > 0]
        for least in (0.0, *(score[order][[-1, len(order) // 2]] if len(order) else ())):
            found, got = shard.top(asks, least, 10)
            reach = score[order] >= least
            assert found[got >= least].tolist() == ids[order][reach].tolist() and np.allclose(got[got >= least], score[order][reach])


def test_fewer_postings_are_scored_than_lists_hold():
    """With the k-th best score known, fewer postings are scored than MaxScore walks in its essential lists and finds by looking candidates up in the others."""
    rng = np.random.default_rng(11)
    n, terms = 4000, 80
    topic = rng.integers(0, 8, n)
    chance = np.where(np.arange(terms)[None] % 8 == topic[:, None], 0.5, 0.05)
    held = (rng.random((n, terms)) < chance) * rng.integers(1, 4, (n, terms))
    df = (held > 0).sum(axis=0)
    shard, _, full = _shard(held, np.log((n - df + 0.5) / (df + 0.5) + 1), rng)
    maxscore = 0
    for q in range(40):
        asks = np.flatnonzero(held[q]).astype(np.int32)
        least = np.sort(np.round(full[:, asks].sum(axis=1), 6))[-10]
        most = full[:, asks].max(axis=0)
        by = np.argsort(most)
        others = np.cumsum(most[by]) < least
        walked, others = asks[by[~others]], asks[by[others]]
        part = full[:, walked].sum(axis=1)
        candidates = (part > 0) & (part + full[:, others].max(axis=0).sum() >= least)
        maxscore += int(df[walked].sum() + (held[candidates][:, others] > 0).sum())
        shard.top(asks, least, 10)
    assert 0 < shard.touched < maxscore


def test_only_documents_that_reach_the_threshold_are_scored():
    """With the k-th best score known, what is scored in full are the best documents' postings, however many blocks, and answers do not change with the company a query has."""
    rng = np.random.default_rng(23)
    n, terms = 3001, 90
    held = (rng.random((n, terms)) < np.linspace(0.6, 0.004, terms)) * rng.integers(1, 4, (n, terms))
    shard, _, full = _shard(held, np.linspace(0.3, 7, terms), rng)
    asks = [np.flatnonzero(held[q]).astype(np.int32) for q in range(50)]
    score = [np.round(full[:, a].sum(axis=1), 6) for a in asks]
    least = np.array([np.sort(s)[-10] for s in score])
    best = sum(int((held[np.ix_(s >= x - 0.01, a)] > 0).sum()) for a, s, x in zip(asks, score, least, strict=True))
    together = shard.reached(asks, least)
    answers = [shard.top(a, x, 10, r) for a, x, r in zip(asks, least, together, strict=True)]
    assert 0 < shard.touched <= best < 0.1 * sum(int((held[:, a] > 0).sum()) for a in asks)
    for a, x, (ids, scores) in zip(asks, least, answers, strict=True):
        alone = shard.top(a, x, 10)
        assert len(ids) == 10 and ids.tolist() == alone[0].tolist() and scores.tolist() == alone[1].tolist()


def test_rows_of_an_index(spark):
    """Every row is in one shard, with its length; shards stay within their limits; ids may be missing."""
    texts = [(None if x % 7 == 3 else x, None if x % 11 == 5 else "a b " * (x % 4) + f"w{x}") for x in range(60)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").mapInArrow(search._indexed(5), search._INDEX).collect()
    assert all(0 < r.rows <= 5 for r in rows) and sum(r.rows for r in rows) == 60
    assert sum(r.words for r in rows) == sum(len((t or "").split()) for _, t in texts)
    got = sorted(int(d) for r in rows for d, null in zip(np.frombuffer(r.ids, "<i8"), np.frombuffer(r.nulls, bool), strict=True) if not null)
    assert got == [d for d, _ in texts if d is not None]


# --- op5 --------------------------------------------------------------------------


def test_targets():
    t = mixing.targets({"b": 100, "a": 10, None: 50, "c": 0})
    assert t["a"] == 30 and t["c"] == 0 and math.isclose(sum(t.values()), 160) and all(t[s] <= 3 * n for s, n in {"b": 100, "a": 10, None: 50, "c": 0}.items())
    assert mixing.targets({}) == {}


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 64, 1000):
        k = np.arange(n)
        assert sorted(mixing._permuted(k, np.full(n, n), np.full(n, np.uint64(77)))) == list(range(n))


def test_mix(documents, corpus, words):
    got = mixing.Mix(documents).taken().collect()
    assert sorted(r.size for r in got) == sorted(len(words(r[1])) for r in corpus)
    assert all(r.taken <= 3 * r.size for r in got)
    by = defaultdict(lambda: [0.0, 0])
    for r in got:
        by[r.source_size, r.target][1] += r.taken
    assert all(abs(taken - target) <= 0.05 * target + 3 * mixing.BLOCK for (_, target), (_, taken) in by.items())
    again = mixing.Mix(documents).taken().collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_texts_are_the_taken_words(documents, words):
    plan = Counter()
    for r in mixing.Mix(documents).taken().collect():
        plan[r.doc_id] += r.taken
    out = mixing.mixed_documents(documents)
    assert out.columns == documents.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert got == +plan


# --- op6 --------------------------------------------------------------------------


@pytest.mark.parametrize("window", [300, 5000, 1 << 22])
def test_packing(documents, corpus, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in corpus]
    got = packing.pack(documents, VOCABULARY, window=window).collect()
    whole = Counter((d, tuple(x)) for d, x in ids)
    parts = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        parts[r.sequence_id].append(r)
    assert sum(r.length for r in got) == sum(len(x) for _, x in ids)
    for rs in parts.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:k]) for k in range(len(rs))]
        n = sum(r.length for r in rs)
        assert n <= 1024 and n & (n - 1) == 0
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for d, rs in by.items():
        if sum(k[0] == d for k in whole) == 1 and whole[next(k for k in whole if k[0] == d)] == 1:
            rs.sort(key=lambda r: r.start)
            assert [x for r in rs for x in r.ids] == list(next(k for k in whole if k[0] == d)[1])


def test_added_tokens_inside_texts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|><|endoftext|>\n", "<|endoftext|", "x <|ENDOFTEXT|> y"]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), VOCABULARY).collect()
    ids = defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        ids[r.doc_id] += r.ids
    assert [ids[i] for i in range(len(texts))] == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    assert 50256 in ids[0]


def test_assignment_balances_cost():
    rng = random.Random(0)
    sizes = [rng.randint(1, 900) for _ in range(300)]
    pieces = packing.assign(sizes)
    load = Counter()
    for _, _, n, s, _ in pieces:
        load[s] += n
    assert sum(load.values()) == sum(sizes) and max(load.values()) <= 1024


def test_costs_are_balanced():
    rng = random.Random(4)
    sizes = [rng.choice([20, 60, 200, 700]) for _ in range(600)]
    spent, own = Counter(), Counter()
    for _, _, n, s, _ in packing.assign(sizes):
        spent[s] += packing.cost(n)
        own[s] += n
    full = [spent[s] for s in spent if own[s] == 1024]
    dealt = [0.0] * len(full)  # the same documents one after another
    rest = sorted(sizes, reverse=True)
    for k in range(len(full)):
        room = 1024
        while rest and room:
            n = min(rest[0], room)
            dealt[k] += packing.cost(n)
            room, rest = room - n, ([rest[0] - n] if rest[0] > n else []) + rest[1:]
    assert np.std(full) < 0.5 * np.std(dealt) and sum(own.values()) == sum(sizes)


def test_many_empty_texts_are_packed_in_bounded_windows(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_DOCS", 100)
    docs = spark.createDataFrame([(i if i % 3 else None, None if i % 2 else "") for i in range(1000)], "doc_id long, text string").coalesce(1)
    got = packing.pack(docs, VOCABULARY).collect()
    assert len(got) == 1000 and all(r.length == r.doc_tokens == 1 and r.ids == [0] for r in got)


# --- op7 --------------------------------------------------------------------------


def test_grammar():
    m = toxicity.Matcher(toxicity.Lexicon({"idiot$": 5.0, "lowei": 4.0}))
    label = lambda t: [b for *_, hits in m.clauses(t) for b, _, _ in hits]
    assert label("an idiot.") == [0] and label("you idiot") == [toxicity.AIMED]
    assert label("not an idiot") == [toxicity.NEGATED] and label("someone said idiot") == [toxicity.REPORTED]
    assert label("idiots sloweis lowei loweixyz") == [0, 0] and label("") == [] and m.features(None)[-1] == 0
    assert label("kill the time") == [] and label("they kill him") == [toxicity.THREATENS | toxicity.AIMED]
    weight = lambda t: sum(w for *_, hits in m.clauses(t) for _, w, _ in hits)
    assert weight("you idiot") > weight("an idiot") > weight("not an idiot")
    assert len(m.clauses("idiot. fine. idiot! " * 50)) == 100


def test_the_machine_equals_its_parts_in_turn():
    rng = random.Random(12)
    arcs = toxicity.Arcs(1.0, -0.3, 0.2, 0.7, -0.6)
    machine, parts = toxicity.grammar(arcs), toxicity.parts(arcs)
    for _ in range(300):
        said = [rng.randrange(6) for _ in range(rng.randrange(25))]
        state, whole = 0, []
        for x in said:
            state, out, weight = machine.step[state, x]
            whole.append((out, round(weight, 9)))
        states, in_turn = [0] * len(parts), []
        for x in said:
            total = 0.0
            for k, part in enumerate(parts):
                states[k], x, weight = part.step[states[k], x]
                total += weight
            in_turn.append((x, round(total, 9)))
        assert whole == in_turn


def test_clauses_equal_a_split():
    rng = random.Random(13)
    m = toxicity.Matcher(toxicity.Lexicon({"idiot$": 5.0, "lowei": 4.0}))
    words = ["idiot", "loweish", "idiots", "xidiot", "you", "not", "said", "kill", "they", "fine", "_idiot", "idiot_"]
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", ". ", "!", "?;", "\n"]) for _ in range(rng.randrange(30)))
        want, at = [], 0
        for part in re.split("([.!?;:\n])", text):
            if hits := m.clause(part):
                want.append((at, at + len(part), hits))
            at += len(part)
        assert m.clauses(text) == want, text


def test_a_long_text_without_clause_ends():
    import time

    m = toxicity.Matcher(toxicity.Lexicon({"idiot$": 5.0}))
    began = time.time()
    for end in (" ", ", ", ". "):
        assert m.features(("you idiot" + end) * 100_000)[toxicity.AIMED] == pytest.approx(math.log1p(100_000))
    assert time.time() - began < 30


def test_arcs_are_learned():
    rng = np.random.default_rng(3)
    x = np.zeros((3000, toxicity.FEATURES))
    kind = rng.integers(0, 5, 3000)
    for k, label in enumerate((0, toxicity.NEGATED, toxicity.AIMED, toxicity.THREATENS | toxicity.AIMED)):
        x[kind == k, label] = np.log1p(1)
    y = (rng.random(3000) < np.array([0.9, 0.1, 0.97, 0.97, 0.02])[kind]).astype(float)
    arcs = toxicity.fit_arcs(x, y)
    assert arcs.negated < -0.5 and arcs.aimed > 0 and abs(arcs.reported - toxicity.Arcs().reported) < 0.3  # no hit was reported: the prior's
    assert np.isfinite(toxicity.fit_arcs(np.zeros((4, toxicity.FEATURES)), np.array([0.0, 1, 0, 1])).prior()).all()


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(8)
    plain = lambda n: " ".join(rng.choice(["the", "re", "of", "tion", "ing", "house", "er"]) + rng.choice(["a", "on", "er"]) for _ in range(n))
    rows = []
    for i in range(600):
        toxic, junk = i % 5 == 0, i % 7 == 0
        t = plain(60)
        if toxic:
            t += " such a " + rng.choice(["moron", "scumbag"]) + " " + plain(5)
        if junk:
            t = "!! ".join(t.upper().split())
        rows.append((i, t, int(not junk), int(toxic)))
    rows += [(900, None, None, None), (901, "", 1, None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], *r[2:]) for r in rows] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def auc(y, s):
    pairs = [(a > b) + 0.5 * (a == b) for a, u in zip(s, y, strict=True) if u for b, v in zip(s, y, strict=True) if not v]
    return sum(pairs) / len(pairs)


def test_toxicity_on_held_out_texts(judged, spark):
    docs, labels = judged
    out = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels), ["doc_id"]).collect()}
    apart = [r for r in labels.collect() if r.doc_id is not None and r.toxic is not None and held(r.doc_id, 4) == 2]
    assert len(out) == 602 and all(0 <= s <= 1 for s in out.values()) and auc([r.toxic for r in apart], [out[r.doc_id] for r in apart]) > 0.99
    kept = {r.doc_id for r in toxicity.kept(docs, toxicity.train(docs, labels)).collect()}
    assert {900, 901, 1} <= kept and sum(i % 5 == 0 for i in kept if i < 600) <= 2


def test_stage_rejects_what_the_operator_predicts(spark):
    docs = spark.createDataFrame([(0, "plain words"), (1, None)], "doc_id long, text string")
    for p, stays in ((0.2, 2), (0.4, 0), (0.6, 0)):
        model = toxicity.Model(toxicity.Lexicon({}), np.zeros(toxicity.FEATURES), math.log(p / (1 - p)))
        assert toxicity.kept(docs, model).count() == stays


# --- op8 --------------------------------------------------------------------------


def least_cost(roles):
    best, queue = set(), [(0, 0, 0)]
    while queue:
        c, i, s = heapq.heappop(queue)
        if (i, s) in best:
            continue
        best.add((i, s))
        if i == len(roles) and s in (chat.START, chat.ASSISTANT):
            return c
        for x in (1, 2, 3):
            if (s, x) in chat.LEGAL and x != chat.SYSTEM:
                heapq.heappush(queue, (c + chat.INSERT, i, x))
            if i < len(roles):
                change = 0 if roles[i] == x else chat.GUESS if roles[i] == 0 else chat.RELABEL
                if (s, x) in chat.LEGAL:
                    heapq.heappush(queue, (c + change, i + 1, x))
                if s == x:
                    heapq.heappush(queue, (c + change + chat.MERGE, i + 1, x))


def repaired_ok(rows, roles):
    rows = sorted(rows, key=lambda r: (r.seg, r.pos, r.sub))
    state = chat.START
    for r in rows:
        role = chat.ROLES.index(r.role)
        if not r.action.endswith("merge"):
            assert (state, role) in chat.LEGAL
        state = role
    assert state in (chat.START, chat.ASSISTANT)
    assert {r.cost for r in rows} == {least_cost(roles)} and sum(r.step_cost for r in rows) == rows[0].cost


def test_roles_are_repaired_at_least_cost(spark):
    rng = random.Random(1)
    rows = [(k if k else None, t, rng.choice(["user", " Assistant ", "system", "?", None, "human"]), None if rng.random() < 0.1 else f"t{t}", 0) for k in range(60) for t in range(rng.randint(1, 7))]
    rows += [(70, 5, "user", "a", 0), (70, 5, "user", "a", 0), (70, None, "system", "b", 0)]
    by = defaultdict(list)
    for r in chat.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")).collect():
        by[r.conv_id].append(r)
    for k, rs in by.items():
        if k != 70:
            repaired_ok(rs, [chat.NAMES.get((r[2] or "").strip().lower(), 0) for r in rows if r[0] == k])
    assert chat.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_conversation_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3000).selectExpr("7L AS conv_id", "id AS turn", "element_at(array('user', 'user', 'assistant', 'zz'), CAST(pmod(xxhash64(id), 4) + 1 AS INT)) AS role", "CAST(id AS STRING) AS text")
        rows = chat.repaired(df).collect()
        assert len({r.seg for r in rows}) > 1
        repaired_ok(rows, [chat.NAMES.get(r.role, 0) for r in df.orderBy("turn").collect()])
        text = "".join(r.rendered for r in sorted(rows, key=lambda r: (r.seg, r.pos, r.sub)))
        assert [x for x in text.split("\n") if x.isdigit()] == [str(i) for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- op9 --------------------------------------------------------------------------


def test_quality_on_held_out_texts(judged):
    docs, labels = judged
    out = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels), ["doc_id"]).collect()}
    apart = [r for r in labels.collect() if r.doc_id is not None and r.quality is not None and r.doc_id < 600 and held(r.doc_id, 5) == 0]
    assert len(out) == 602 and auc([r.quality for r in apart], [out[r.doc_id] for r in apart]) > 0.99


def test_gradient():
    rng = np.random.default_rng(0)
    x, row, y = rng.normal(size=(12, quality.INPUTS)), np.repeat(np.arange(4), 3), np.array([0.0, 1, 1, 0])
    net = quality.fit(x, row, y, rounds=3, batch=4)
    loss = lambda: -np.mean(y * np.log(net.forward(x, row)[0]) + (1 - y) * np.log(1 - net.forward(x, row)[0]))
    for k, g in net.gradient(x, row, y).items():
        at = tuple(0 for _ in net.p[k].shape)
        old = np.array(net.p[k], dtype=float)
        up, down = old.copy(), old.copy()
        up[at], down[at] = old[at] + 1e-5, old[at] - 1e-5
        net.p[k] = up
        a = loss()
        net.p[k] = down
        b = loss()
        net.p[k] = old
        assert math.isclose((a - b) / 2e-5, g[at], rel_tol=1e-3, abs_tol=1e-7)


def test_training_sees_every_passage(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda x, row, y: seen.update(n=np.bincount(row)))
    texts = ["word " * 24_000, "short text", "other " * 2_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    quality.train(docs, spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int"), fold_of=5, fold=9)
    assert sorted(seen["n"].tolist()) == [1, 20, 200]


def test_no_labels(judged, spark):
    docs, labels = judged
    assert quality.train(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score(docs, None, ["doc_id"]).collect()} == {0.5}
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0)), ["doc_id"]).count() == 602


# --- op10 -------------------------------------------------------------------------


@pytest.mark.parametrize("block", [16, 4096])
def test_embedding_links(spark, block, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    vecs = [(i, (centres[i % 12] * (1 + i % 3) + rng.normal(size=8) * rng.choice([0.05, 0.3, 2.0])).tolist(), i % 2) for i in range(220)]
    vecs += [(300 + i, vecs[0][1], 0) for i in range(30)]
    odd = [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] * 8, 0), (403, [None] + [1.0] * 7, 0), (404, vecs[0][1], None), (405, [], 0), (406, [float("inf")] + [1.0] * 7, 0), (407, [1.0, 2.0], 0), (300, vecs[0][1], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in cover_tree.embedding_links(spark.createDataFrame(vecs + odd, "vec_id long, embedding array<double>, label int")).collect())
    rows = vecs + odd
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in good}
    near = {k: [j for j in good if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.93] for k in good}
    want = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        name = min(rows[j][0] for j in seen)
        want.append((i, len(near.get(k, [])), name, i == name))
    assert got == sorted(want)


def test_many_labels_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) + 9 * (i % 2)).tolist(), f"label{i // 2}", 1, 2) for i in range(3000)]
    rows += [(3000 + i, rows[0][1], "label0", 1, 2) for i in range(3)]
    got = cover_tree.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, space int, rid int"))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    by = {r.vec_id: r for r in got.collect()}
    assert len(by) == 3003 and all(by[3000 + i].component_id == 0 and by[3000 + i].n_links >= 3 for i in range(3))
    for i in range(2, 3000, 2):
        a, b = (np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in (i, i + 1))
        assert by[i].n_links == by[i + 1].n_links == int(a @ b >= 0.93)


def test_vectors_are_sent_where_they_can_link(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 256)
    monkeypatch.setattr(cover_tree, "CELL", 16)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 32))
    x = np.concatenate([centres[i % 60] + rng.normal(size=(1, 32)) * 0.12 for i in range(6000)])
    reps = spark.createDataFrame([(i, v.tolist(), "a", 1) for i, v in enumerate(x)], "rid long, vec array<double>, label string, m long")
    sent = cover_tree._routed(reps, float(np.sqrt(2 - 2 * 0.93))).groupBy("low", "high").count().collect()
    total = sum(r["count"] for r in sent)
    assert total < 0.2 * 6000 * 6000 / 256  # all pairs of blocks would be that many
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    got = cover_tree.embedding_links(reps.select(F.col("rid").alias("vec_id"), F.col("vec").alias("embedding"), "label")).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(links.tolist()))


def test_far_vectors_meet_in_few_products(monkeypatch):
    """Among vectors without structure nodes meet by the list, not one by one; links, counts and classes are those of all pairs."""
    rng = np.random.default_rng(9)
    x, y = (rng.normal(size=(n, 48)) for n in (1500, 1300))
    x[:120] = x[0] + rng.normal(size=(120, 48)) * 0.15
    y[:200] = x[0] + rng.normal(size=(200, 48)) * np.linspace(0.01, 0.4, 200)[:, None]
    y[300:900] = x[300:900] + rng.normal(size=(600, 48)) * 0.25
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    wx, wy = rng.integers(1, 4, len(x)).astype(float), rng.integers(1, 4, len(y)).astype(float)
    calls, plain = [], cover_tree._distances
    trees = {id(v): cover_tree.build(v) for v in (x, y)}
    monkeypatch.setattr(cover_tree, "build", lambda v: trees[id(v)])
    monkeypatch.setattr(cover_tree, "_distances", lambda *a: calls.append(1) or plain(*a))
    for other, weights in ((y, wy), (None, None)):
        calls.clear()
        na, nb, forest = cover_tree.links(x, wx, other, weights, 0.93)
        assert len(calls) < 100
        hit = x @ (x if other is None else y).T >= 0.93
        if other is None:
            np.fill_diagonal(hit, False)
            assert np.array_equal(na, hit @ wx)
            n, i, j = len(x), *np.nonzero(hit)
        else:
            assert np.array_equal(na, hit @ wy) and np.array_equal(nb, hit.T @ wx)
            n, i, j = len(x) + len(y), *np.nonzero(hit)
            j = j + len(x)
        want = cover_tree.Forest(n)
        want.join(i, j)
        assert hit.sum() > 1000 and np.array_equal(forest.roots(), want.roots())


def test_no_vectors(spark):
    assert cover_tree.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components_chain(spark):
    got = {r.node: r.root for r in graph.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)}


# --- clashing columns -------------------------------------------------------------


def test_columns_of_clashing_names(spark, corpus, tmp_path):
    names = ["uid", "parts", "__text", "keep", "component_id", "size", "h1", "key", "held", "base", "ids", "spans", "text_"]
    rows = [(r[0], r[1], r[3], *([k] * len(names))) for k, r in enumerate(corpus) if r[0] is None or r[0] < 40 or r[0] >= 300]
    path = f"file://{tmp_path}/d"
    spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names)).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    plain = docs.select("doc_id", "text", "source")
    assert ngram_join.one_of_each(docs).columns == mixing.mixed_documents(docs).columns == pii.redact(docs, pii.train(docs)).columns == docs.columns
    assert ngram_join.one_of_each(docs).count() == ngram_join.one_of_each(plain).count()
    assert mixing.mixed_documents(docs).select("doc_id", "uid").join(docs.select("doc_id", "uid"), ["uid"]).count() == mixing.mixed_documents(plain).count()
    key = lambda rows: sorted(map(str, rows))
    assert key(packing.pack(docs, VOCABULARY, with_ids=False).collect()) == key(packing.pack(plain, VOCABULARY, with_ids=False).collect())
    assert key(suffix_tree.score_texts(docs).select("doc_id", "score").collect()) == key(suffix_tree.score_texts(plain).select("doc_id", "score").collect())
    assert key(search.top_k(docs, F.col("doc_id") % 25 == 0).collect()) == key(search.top_k(plain, F.col("doc_id") % 25 == 0).collect())
    model = toxicity.Model(toxicity.Lexicon({"idiot$": 5.0}), np.zeros(toxicity.FEATURES), -3.0)
    for scored in (toxicity.score(docs, model, ["doc_id", "text", "__text"]), quality.score(docs, None, ["doc_id", "text", "__text"])):
        assert scored.columns[:4] == ["doc_id", "text", "__text", "score"] and scored.count() == len(rows)
    assert toxicity.kept(docs, model).columns == docs.columns


# --- empty tables -----------------------------------------------------------------


def test_empty_documents(nothing):
    assert suffix_tree.score_texts(nothing).count() == 0
    assert ngram_join.jaccard_classes(nothing).count() == 0
    assert ngram_join.one_of_each(nothing).count() == 0
    assert mixing.Mix(nothing).taken().count() == 0
    assert mixing.mixed_documents(nothing).count() == 0
    assert packing.pack(nothing, VOCABULARY).count() == 0
    assert search.top_k(nothing, F.col("doc_id") % 50 == 0).count() == 0
    assert pii.redact(nothing, pii.train(nothing)).count() == 0


def test_empty_tables_of_labelled_operators(nothing, judged, spark):
    docs, labels = judged
    for texts, marks in ((nothing, labels), (nothing, labels.limit(0)), (docs, labels.limit(0))):
        model, net = toxicity.train(texts, marks), quality.train(texts, marks)
        assert toxicity.score(nothing, model, ["doc_id"]).count() == quality.score(nothing, net, ["doc_id"]).count() == 0
        assert toxicity.kept(nothing, model).count() == 0
    out = spark.createDataFrame([(1, "", 5), (1, "", 5), (None, None, None)], "doc_id long, text string, score int")
    model, net = toxicity.train(docs, labels), quality.train(docs, labels)
    assert sorted(toxicity.kept(out, model).collect(), key=str) == sorted(out.collect(), key=str)
    for scored in (toxicity.score(out, model, ["doc_id"]), quality.score(out, net, ["doc_id"])):
        assert len({r.score for r in scored.collect()}) == 1 and scored.count() == 3
