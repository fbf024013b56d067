"""Cost-balanced packing of token ids into sequences of fixed capacity.

Each task tokenises its rows once and packs windows of about ``WINDOW`` tokens, or of
``MOST_DOCS`` documents, as they come, so nothing is exchanged and memory is bounded by
the window. In a
window, whole multiples of the capacity are sequences of their own; what remains
of each document, in descending order of length, goes to the sequence of lowest
estimated cost (linear plus quadratic attention cost of its pieces) that still has
room. A remainder that fits nowhere is cut over what room is left, and the tokens
beyond whole sequences form sequences of powers of two, so nothing is padded.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import tasks_for

CAPACITY = 1024
WINDOW, MOST_DOCS = 1 << 22, 1 << 16
LINEAR, QUADRATIC = 1.0, 1.0 / 2048  # cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n
BOUNDARY = 0
ADDED = {"<|endoftext|>": 50256}  # the vocabulary's added token, which a tokenizer finds inside texts too

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """Encodes a text to ids by the ranks of a byte-level vocabulary file; one a worker."""
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
    return _encoders[vocabulary]


def cost(n: float) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(sizes: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents with so many tokens."""
    pieces, sequence, rest = [], 0, []
    for doc, n in enumerate(sizes):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((doc, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((doc, n - n % capacity, n % capacity))
    rest.sort(key=lambda x: (-x[2], x[0]))
    bins = sum(x[2] for x in rest) // capacity
    load, spent = np.zeros(bins, dtype=np.int64), np.zeros(bins)
    late = []
    for doc, start, n in rest:
        if bins:
            fits = np.where(load + n <= capacity, spent, np.inf)
            to = int(fits.argmin())
            if fits[to] < np.inf:
                pieces.append((doc, start, n, sequence + to, int(load[to])))
                load[to] += n
                spent[to] += cost(n)
                continue
        late.append((doc, start, n))
    room = [(sequence + int(b), int(load[b]), capacity) for b in np.argsort(load, kind="stable") if load[b] < capacity]
    over = sum(n for _, _, n in late) - sum(stop - at for _, at, stop in room)
    sequence += bins
    for bit in reversed(range(capacity.bit_length())):
        if over >> bit & 1:
            room.append((sequence, 0, 1 << bit))
            sequence += 1
    room.reverse()
    for doc, start, n in late:
        while n:
            to, at, stop = room.pop()
            m = min(n, stop - at)
            pieces.append((doc, start, m, to, at))
            start, n = start + m, n - m
            if at + m < stop:
                room.append((to, at + m, stop))
    return pieces


def _packed(vocabulary: str, capacity: int, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_to_numpy
        first = TaskContext.get().partitionId() << 40
        docs: list = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, held
            pieces = assign([len(x) for x in ids], capacity)
            for i in range(0, len(pieces), 5000):
                part = pieces[i : i + 5000]
                doc, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*part, strict=True))
                crc = [zlib.crc32(ids[d][s : s + n].tobytes()) for d, s, n, _, _ in part]
                out = [pa.array([docs[d] for d in doc], pa.int64()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array([len(ids[d]) for d in doc], pa.int64()), pa.array(first + sequence), pa.array(offset)]
                if with_ids:
                    flat = np.concatenate([ids[d][s : s + n] for d, s, n, _, _ in part]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids)
            first += max(p[3] for p in pieces) + 1
            docs.clear()
            ids.clear()
            held = 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.append(encode(text.as_py() or "", allowed_special="all"), BOUNDARY).astype("<u4")
                docs.append(doc_id)
                ids.append(own)
                held += len(own)
                if held >= window or len(ids) >= MOST_DOCS:
                    yield from flush()
        if ids:
            yield from flush()

    return run


def pack(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """A row for each piece of documents (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    An added token's string in a text becomes its one id, as ``tokenizers`` encodes it
    with ``add_special_tokens=False``; a null or empty text has its one boundary id. Rows with equal (or null) doc_ids are packed as documents of their
    own; texts of any length are read whole, other columns are not looked at.
    ``sequence_id`` is unique over tasks. ``vocabulary``: path of a rank file.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.coalesce(tasks_for(docs)).mapInArrow(_packed(vocabulary, capacity, window, with_ids), _PIECES + ", ids array<int>" * with_ids)
