"""What a session keeps while its photos arrive: chapters, upload chunks, a byte ledger, a cache, jobs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .ordered import InOrder, untimed

# --- chapters -------------------------------------------------------------------

# The rules of chapters, as operators/stories.py has them.
GAP_SECONDS, GAP_KM, RADIUS_KM = 2700.0, 5.0, 6371.0


def capacity(photos: int) -> int:
    return 24 if photos > 200 else 16 if photos > 50 else 12


def kilometres(a: tuple, b: tuple) -> float:
    if None in a or None in b:
        return 0.0
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return RADIUS_KM * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


class Chapters(InOrder):
    """A session's chapters as they close: by a gap in time or place, when full, or when nothing came for long.

    The state is the open chapter: its number, first photo, size and the last photo's time
    and place. ``expected`` is how many photos the session has announced; it fixes the
    capacity, as the final count does in batch.
    """

    schema = "session_id string, chapter long, first_id long, n long, starts long, ends long"
    columns = ["latitude", "longitude", "expected"]

    def begin(self, handle) -> None:
        self.open = handle.getValueState("open", "chapter long, first_id long, n long, starts long, ends long, latitude double, longitude double, capacity long, closed boolean")

    def load(self) -> None:
        held = self.open.get()
        self.now = tuple(held) if held else None

    def save(self) -> None:
        if self.now is not None:
            self.open.update(self.now)

    def _closed(self, key) -> tuple:
        chapter, first, n, starts, ends = (int(x) for x in self.now[:5])
        self.now = (*self.now[:8], True)
        return (key[0], chapter, first, n, starts, ends)

    def apply(self, key, at, id, row):
        out, place = [], (row.get("latitude"), row.get("longitude"))
        if self.now is None:
            number = 1
        else:
            known = lambda x: None if x is None or math.isnan(x) else x
            far = kilometres((known(self.now[5]), known(self.now[6])), place) > GAP_KM
            if not self.now[8] and (far or self.now[2] >= self.now[7]):
                out.append(self._closed(key))
            if not self.now[8]:
                self.now = (*(int(x) for x in self.now[:2]), int(self.now[2]) + 1, int(self.now[3]), at, *place, int(self.now[7]), False)
                return out
            number = int(self.now[0]) + 1
        self.now = (number, id, 1, at, at, *place, capacity(row["expected"]), False)
        return out

    def tick(self, key, now):
        if self.now is not None and not self.now[8] and now >= self.now[4] + int(GAP_SECONDS * 1e6):
            return [self._closed(key)]
        return []

    def due(self):
        return None if self.now is None or self.now[8] else int(self.now[4] + GAP_SECONDS * 1e6)


# --- chunks ---------------------------------------------------------------------


class Chunks(StatefulProcessor):
    """Upload chunks, each passed on once when all its photos are there; the last of a session's also makes it ready.

    The state holds the rows of a session's incomplete chunks, and the numbers of those
    passed on; so replayed photos and replayed chunks change nothing, in whichever order
    they come. It is one value, read and written once a call, not once a chunk.
    """

    schema = "session_id string, chunk long, rows array<string>, ready boolean"

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "chunk array<long>, ids array<array<long>>, rows array<array<string>>, done array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *open_, done = self.held.get() or ((), (), (), ())
        chunks, done = {int(c): dict(zip(ids, texts, strict=True)) for c, ids, texts in zip(*open_, strict=True)}, {int(c): None for c in done}
        sizes, total = {}, 0
        for frame in rows:
            for chunk, size, of, id, row in zip(*(frame[c].tolist() for c in ("chunk", "chunk_size", "chunk_count", "photo_id", "row")), strict=True):
                if chunk not in done:
                    chunks.setdefault(chunk, {})[id] = row
                    sizes[chunk], total = size, of
        out = []
        for chunk in sorted(c for c, size in sizes.items() if len(chunks[c]) >= size):
            done[chunk] = None
            out.append((key[0], chunk, list(chunks.pop(chunk).values()), len(done) == total))
        self.held.update((list(chunks), [list(x) for x in chunks.values()], [list(x.values()) for x in chunks.values()], list(done)))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "chunk", "rows", "ready"])

    def close(self) -> None:
        pass


def complete_chunks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """session_id, chunk, ps (its photos as structs of ``columns``, in order of the first) and ready, for every chunk when it is complete.

    ``rows``: session_id, chunk, chunk_size, chunk_count, photo_id and ``columns``.
    """
    fields = ", ".join(f"{c}: {t}" for c, t in rows.select(*columns).dtypes)
    r = rows.select("session_id", "chunk", "chunk_size", "chunk_count", "photo_id", F.to_json(F.struct(*columns)).alias("row"))
    out = untimed(r, "session_id", Chunks())
    ps = F.array_sort(F.transform("rows", lambda x: F.from_json(x, f"struct<{fields}>")))
    return out.select("session_id", "chunk", ps.alias("ps"), "ready")


# --- ledger ---------------------------------------------------------------------


class Ledger(InOrder):
    """Bytes of a session: presigned uploads are admitted by count and room, confirmed ones counted by difference.

    A presign counts even if refused (429 above ``ceiling``); it is refused (413) if what
    is confirmed, what is promised and what it asks for exceed ``room``. It promises its
    declared bytes, or what was declared before, until its photo is confirmed. A
    confirmation with the bytes already counted changes nothing.
    """

    schema = "session_id string, request long, code int, total long, reserved long, presigns long"
    columns = ["kind", "photo", "bytes"]

    def __init__(self, ceiling: int, room: int):
        self.ceiling, self.room = ceiling, room

    def begin(self, handle) -> None:
        self.sums = handle.getValueState("sums", "total long, reserved long, presigns long, photo array<long>, declared array<long>, presigned array<boolean>, synced array<boolean>, bytes array<long>")

    def load(self) -> None:
        """The session's photos come and go with its sums: each access to state is a call to the JVM, so one a photo would be one a row."""
        held = self.sums.get()
        self.total, self.reserved, self.presigns = (int(x) for x in held[:3]) if held else (0, 0, 0)
        self.photos = {int(p): (int(d), bool(a), bool(s), int(b)) for p, d, a, s, b in zip(*held[3:], strict=True)} if held else {}

    def save(self) -> None:
        photos = [list(x) for x in zip(*((p, *x) for p, x in self.photos.items()), strict=True)] or [[]] * 5
        self.sums.update((self.total, self.reserved, self.presigns, *photos))

    def apply(self, key, at, id, row):
        photo, n, code = int(row["photo"]), int(row["bytes"]), 200
        declared, presigned, synced, counted = self.photos.get(photo, (0, False, False, 0))
        if row["kind"] == "presign":
            self.presigns += 1
            if self.presigns > self.ceiling:
                code = 429
            elif self.total + self.reserved + n > self.room:
                code = 413
            else:
                now = n if n > 0 else declared
                if not synced:
                    self.reserved += now - (declared if presigned else 0)
                self.photos[photo] = (now, True, synced, counted)
        elif not synced or counted != n:
            self.total += n - counted
            if presigned and not synced:
                self.reserved -= declared
            self.photos[photo] = (declared, presigned, True, n)
        return [(key[0], id, code, self.total, self.reserved, self.presigns)]


# --- cache ----------------------------------------------------------------------


class Cache(InOrder):
    """A cache of at most ``limit`` entries that each live ``seconds``: every request and whether it hit.

    A put starts an entry's life anew; puts and hits make it the last to go; a full cache
    drops its expired entries, then the one unused for longest.
    """

    schema = "cache string, request long, hit boolean, size int"
    columns = ["item", "put"]

    def __init__(self, limit: int, seconds: float):
        self.limit, self.life = limit, int(seconds * 1e6)

    def begin(self, handle) -> None:
        self.entries = handle.getValueState("entries", "items array<long>, ends array<long>")

    def load(self) -> None:
        held = self.entries.get()
        self.live = {int(k): int(e) for k, e in zip(*held, strict=True)} if held else {}

    def save(self) -> None:
        self.entries.update((list(self.live), list(self.live.values())))

    def apply(self, key, at, id, row):
        item, hit = int(row["item"]), False
        self.live = {k: e for k, e in self.live.items() if e > at}
        if row["put"]:
            self.live.pop(item, None)
            if len(self.live) >= self.limit:
                del self.live[next(iter(self.live))]
            self.live[item] = at + self.life
        elif item in self.live:
            hit = True
            self.live[item] = self.live.pop(item)
        return [(key[0], id, hit, len(self.live))]


# --- jobs -----------------------------------------------------------------------


class Jobs(InOrder):
    """Every change of a job's status: answers move it, time wakes it for another attempt.

    200 completes it; 4xx other than 429 fails it for good; 429 and 5xx make it wait 1, 2,
    4 seconds for its next attempt, and fail it after ``retries`` of these. What comes after
    an end starts the next version.
    """

    schema = "job string, version long, status string, attempt int, at_us long"
    columns = ["code"]

    def __init__(self, retries: int = 3):
        self.retries = retries

    def begin(self, handle) -> None:
        self.job = handle.getValueState("job", "version long, status string, attempt int, wake long")

    def load(self) -> None:
        self.version, self.status, self.attempt, self.wake = self.job.get() or (1, "processing", 1, 0)
        self.version, self.attempt, self.wake = int(self.version), int(self.attempt), int(self.wake)

    def save(self) -> None:
        self.job.update((self.version, self.status, self.attempt, self.wake))

    def _now(self, key, at) -> tuple:
        return (key[0], self.version, self.status, self.attempt, at)

    def apply(self, key, at, id, row):
        code = row["code"]
        if self.status in ("completed", "failed"):
            self.version, self.attempt = self.version + 1, 1
        if code < 400:
            self.status = "completed"
        elif code != 429 and code < 500 or self.attempt > self.retries:
            self.status = "failed"
        else:
            self.status, self.wake = "waiting", at + (1_000_000 << (self.attempt - 1))
            self.attempt += 1
        return [self._now(key, at)]

    def tick(self, key, now):
        if self.status != "waiting" or self.wake > now:
            return []
        self.status = "processing"
        return [self._now(key, self.wake)]

    def due(self):
        return self.wake if self.status == "waiting" else None


# --- limits ---------------------------------------------------------------------


class Limit(InOrder):
    """At most ``limit`` admitted hits of a key in any trailing window; refused hits leave no trace. The state is the last admitted times."""

    schema = "key string, hit long, allowed boolean"
    columns = ["event_id"]

    def __init__(self, limit: int, seconds: float):
        self.limit, self.window = limit, int(seconds * 1e6)

    def begin(self, handle) -> None:
        self.admitted = handle.getValueState("admitted", "times array<long>")

    def load(self) -> None:
        held = self.admitted.get()
        self.times = [int(t) for t in held[0]] if held else []

    def save(self) -> None:
        self.admitted.update((self.times,))

    def apply(self, key, at, id, row):
        ok = len(self.times) < self.limit or self.times[0] <= at - self.window
        if ok:
            self.times = [*self.times, at][-self.limit :]
        return [(key[0], id, ok)]
