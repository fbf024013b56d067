"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded from its
shares of byte kinds, of repeated words, and of its words and word pairs by hash, so
that both the words and their order count; gated attention weighs the passages and
a logistic layer scores their weighted sum. All weights are learned from labels of
whole texts, on a bounded sample; every passage of every text is encoded and scored.
A null or empty text has one empty passage. Repeated rows stay rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from ..sources.scratch import small_batches
from .labelled import free_name, remainder, sample

PASSAGE = 600
_OWN = b"\n.,!?|&%#*$:;-'\"()"
_KIND = np.full(256, 0, dtype=np.int64)  # 0: other bytes below 128
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, 9]], _KIND[0x80:0xC0], _KIND[0xC0:] = 1, 2, 3, 4, 5, 6
for _k, _b in enumerate(_OWN):
    _KIND[_b] = 7 + _k
KINDS = 7 + len(_OWN)
WORDS, PAIRS = 96, 64  # hash classes
LEXICAL = KINDS + 5
INPUTS = LEXICAL + WORDS + PAIRS
HIDDEN, ATTENTION = 16, 8


def passages(offsets: np.ndarray, data: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, row) of every passage of rows i to j; an empty text has one empty passage."""
    base = offsets[i]
    size = np.diff(offsets[i : j + 1])
    per_row = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(per_row) - per_row
    n = int(per_row.sum())
    begin = offsets[i:j] - base
    row = np.repeat(np.arange(j - i), per_row)
    b = data[base : offsets[j]]
    of = np.repeat(first, size) + (np.arange(len(b)) - np.repeat(begin, size)) // PASSAGE
    x = np.zeros((n, INPUTS))
    x[:, :KINDS] = np.bincount(of * KINDS + _KIND[b], minlength=n * KINDS).reshape(n, KINDS)
    length = x[:, :KINDS].sum(axis=1)
    x[:, :KINDS] /= np.maximum(length, 1)[:, None]
    w = textscan.words(offsets, data, i, j)
    if len(w.hash):
        p = of[w.start]
        count = np.bincount(p, minlength=n)
        again = np.zeros(len(p), dtype=bool)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (p[1:] == p[:-1])
        order = np.lexsort((w.hash, p))
        ps, hs = p[order], w.hash[order]
        new = np.ones(len(ps), dtype=bool)
        new[1:] = (ps[1:] != ps[:-1]) | (hs[1:] != hs[:-1])
        some = np.maximum(count, 1)
        x[:, KINDS] = np.bincount(p, again, minlength=n) / some
        x[:, KINDS + 1] = np.bincount(ps, new, minlength=n) / some
        x[:, KINDS + 2] = np.log1p(np.bincount(p, w.end - w.start, minlength=n) / some)
        x[:, KINDS + 3] = np.log1p(count) / 5
        x[:, LEXICAL : LEXICAL + WORDS] = np.bincount(p * WORDS + (w.hash % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS) / some[:, None]
        two = np.flatnonzero(p[1:] == p[:-1])
        pair = (textscan.mix(w.hash[two] * np.uint64(3) + w.hash[two + 1]) % np.uint64(PAIRS)).astype(np.int64)
        x[:, LEXICAL + WORDS :] = np.bincount(p[two] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS) / some[:, None]
    x[:, KINDS + 4] = np.log1p(length) / 7
    return x, row


@dataclass
class Net:
    """Encoder, gated attention and output; ``mean`` and ``scale`` standardise the inputs."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, row: np.ndarray) -> tuple:
        """Passages of a row are adjacent, and every row has some."""
        p = self.p
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        head = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        bag = np.cumsum(np.concatenate(([0], row[1:] != row[:-1])))
        s = np.exp(s - np.maximum.reduceat(s, head)[bag])
        a = s / np.add.reduceat(s, head)[bag]
        m = np.add.reduceat(a[:, None] * h, head)
        return 1 / (1 + np.exp(-np.clip(m @ p["o"] + p["c"], -30, 30))), (z, h, t, g, a, m, head, bag)

    def gradient(self, x: np.ndarray, row: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        out, (z, h, t, g, a, m, head, bag) = self.forward(x, row)
        d = (out - y) / len(y)
        dm = d[:, None] * p["o"]
        da = (dm[bag] * h).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, head)[bag])
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dm[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"E": z.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "o": m.T @ d, "c": np.array(d.sum())}


def fit(x: np.ndarray, row: np.ndarray, y: np.ndarray, rounds: int = 300, batch: int = 512, seed: int = 3) -> Net:
    """Adam on shuffled batches of whole bags."""
    rng = np.random.default_rng(seed)
    centre = x.mean(axis=0, dtype=float)
    parts = (x[i : i + (1 << 16)] for i in range(0, len(x), 1 << 16))
    scale = np.sqrt(sum(((part - centre) ** 2).sum(axis=0) for part in parts) / len(x))
    shape = {"E": (INPUTS, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "o": (HIDDEN,), "c": ()}
    net = Net(centre, np.where(scale > 1e-6, scale, 1.0), {k: rng.normal(0, 0.3, s) * (k not in "ec") for k, s in shape.items()})
    first = np.searchsorted(row, np.arange(len(y) + 1))
    m1, m2 = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2))
    order, at = rng.permutation(len(y)), 0
    for step in range(1, rounds + 1):
        if at + batch > len(y):
            order, at = rng.permutation(len(y)), 0
        bags = np.sort(order[at : at + batch])
        at += batch
        pick = np.concatenate([np.arange(first[b], first[b + 1]) for b in bags])
        for k, g in net.gradient(x[pick].astype(float), row[pick], y[bags]).items():
            g = g + 1e-4 * net.p[k]
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
            net.p[k] = net.p[k] - 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return net


def train(documents: DataFrame, labels: DataFrame, fold_of: int = 5, fold: int = 0, most_rows: int = 8_000) -> Net | None:
    """Learns from all passages of about ``most_rows`` labelled rows at most outside the held-out fold."""
    sampled = sample(documents, labels, "quality", remainder(fold_of) != fold, most_rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = textscan.string_bytes(batch.column(0))
            y = np.asarray(batch.column(1))
            for i, j in textscan.slices(offsets):
                x, row = passages(offsets, data, i, j)
                first = np.searchsorted(row, np.arange(j - i + 1))
                out = [x[first[k] : first[k + 1]].astype(np.float32).tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(y[i:j])], ["x", "label"])

    with small_batches(documents.sparkSession):
        got = sampled.mapInArrow(encode, "x binary, label int").toPandas()
    if not len(got) or got["label"].nunique() < 2:
        return None
    bags = [np.frombuffer(b, dtype=np.float32).reshape(-1, INPUTS) for b in got["x"]]
    return fit(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), got["label"].to_numpy(float))


def score(documents: DataFrame, net: Net | None, columns: list[str]) -> DataFrame:
    """The named columns, the text's score between 0 and 1, and its most attended passage; without a net all score 0.5. A null text is empty."""
    shared = documents.sparkSession.sparkContext.broadcast(net)
    rows = documents.select(*columns, F.col("text").cast("string").alias(free_name(columns, "text")))
    schema = rows.select(*columns).schema.add("score", "double").add("passage", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            offsets, data = textscan.string_bytes(batch.column(len(columns)))
            for i, j in textscan.slices(offsets):
                x, row = passages(offsets, data, i, j)
                p, best = np.full(j - i, 0.5), np.zeros(j - i, dtype=np.int64)
                if net is not None:
                    p, (_, _, _, _, a, _, head, bag) = net.forward(x, row)
                    top = np.lexsort((np.arange(len(a)), -a, bag))
                    best = top[np.flatnonzero(np.concatenate(([True], np.diff(bag[top]) > 0)))] - head
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[: len(columns)]), pa.array(p), pa.array(best)], [*columns, "score", "passage"])

    return rows.mapInArrow(run, schema)
