"""Limiters, caches and the event hub as streams with state, which outlives a lost executor in the query's checkpoint.

Each is a processor for transformWithStateInPandas. Rows of a key are handled in order of time (ts, then id), and time is that
of the rows: timers fire as the watermark passes, so what runs out does so without a new row of its key. What a key holds is
bounded: a limiter's grants of one window, FIFO entries of a cache, the last events and the queues of an epoch.
The state store has to be RocksDB (store()).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import HISTORY

#: Seconds of the window and between spaced requests, what a caller waits at most, how long entries live, how many a cache has, how far a subscriber may fall behind, and how long nobody is left without a word.
WINDOW, GAP, MAX_WAIT, TTL, FIFO, BEHIND, KEEP_ALIVE = 60.0, 1.1, 3.0, 600.0, 256, 64, 25.0


def store(spark: SparkSession) -> None:
    """Set what processors with several state variables and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rows(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(pdfs), ignore_index=True)
    rows["at"] = rows["ts"].astype("datetime64[us]").astype("int64") / 1e6
    return rows.sort_values(["at", "id"], kind="stable")


class _Processor(StatefulProcessor):
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wake(self, at: float) -> None:
        """Fire one timer of this key, at this second and no other."""
        ms = int(at * 1000) + 1
        for old in list(self.handle.listTimers()):
            if old != ms:
                self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)

    def out(self, rows: list[tuple], **kinds: str) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns).astype(kinds)

    def close(self) -> None:
        pass


LIMITED = "key string, id long, answer string, slot double, remaining long"


class Window(_Processor):
    """At most `limit` requests in any `window` seconds; the less of its own count and the server's last word less what was spent since counts.

    In: key, ts, id, kind ('take'; 'observed' with what the server says is left as amount and its limit as cap).
    Out: of each request 'granted' at its slot, after a wait of max_wait seconds at most, or 'refused' with the time at which to come again;
    and 'refilled' once a key has been idle for a window, which forgets it.
    """

    columns = ["key", "id", "answer", "slot", "remaining"]

    def __init__(self, limit: int, window: float = WINDOW, max_wait: float = MAX_WAIT) -> None:
        self.limit, self.window, self.max_wait = limit, window, max_wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("limiter", "taken array<double>, cap long, said long, told double")

    def _left(self, taken: list[float], cap: int, said: int, told: float, now: float) -> int:
        left = cap - len(taken)
        if said >= 0 and now - told < self.window:
            left = min(left, said - sum(t > told for t in taken))
        return max(left, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        taken, cap, said, told = self.state.get() if self.state.exists() else ((), self.limit, -1, 0.0)
        taken, out = list(taken), []
        for r in _rows(rows).itertuples():
            if r.kind == "observed":
                said, told, cap = int(r.amount), r.at, int(r.cap) if r.cap > 0 else cap
                continue
            now = r.at
            while True:
                taken = sorted(t for t in taken if t > now - self.window)
                if self._left(taken, cap, said, told, now) > 0:
                    taken.append(now)
                    out.append((key[0], r.id, "granted", now, self._left(taken, cap, said, told, now)))
                    break
                wait = self.window - (now - taken[0]) if taken else self.window
                if now + wait - r.at > self.max_wait:
                    out.append((key[0], r.id, "refused", now + wait, 0))
                    break
                now += wait
        self.state.update((taken, cap, said, told))
        self.wake(max([told, *taken]) + self.window)
        yield self.out(out, remaining="int64", id="Int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, cap, *_ = self.state.get()
        self.state.clear()
        yield self.out([(key[0], None, "refilled", expiredTimerInfo.getExpiryTimeInMs() / 1000, cap)], remaining="int64", id="Int64")


class Spaced(_Processor):
    """Requests `gap` seconds apart: each is granted the next slot if that is no more than max_wait off, else refused.

    In: key, ts, id, kind ('take'; 'back_off' with seconds as amount). Out: as Window gives it, remaining being 0.
    """

    columns = Window.columns

    def __init__(self, gap: float = GAP, max_wait: float = MAX_WAIT) -> None:
        self.gap, self.max_wait = gap, max_wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("next", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        following, out = self.state.get()[0] if self.state.exists() else 0.0, []
        for r in _rows(rows).itertuples():
            if r.kind == "back_off":
                following = max(following, r.at + r.amount)
            elif max(following, r.at) - r.at > self.max_wait:
                out.append((key[0], r.id, "refused", following, 0))
            else:
                slot = max(following, r.at)
                following = slot + self.gap
                out.append((key[0], r.id, "granted", slot, 0))
        self.state.update((following,))
        self.wake(following)
        yield self.out(out, remaining="int64", id="Int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield self.out([], remaining="int64", id="Int64")


CACHED = "key string, id long, entry string, answer string, value string"


class Cache(_Processor):
    """Entries that live ttl seconds, and of which the one that came first goes when there are more than `size`.

    In: key (of the cache), ts, id, kind ('put', 'get'), entry, value. Out: of a get 'hit' with the value or 'miss', and 'evicted' or
    'expired' for each entry that goes. A put of an entry that is there gives it a new value and age, and keeps its place in line.
    """

    columns = ["key", "id", "entry", "answer", "value"]

    def __init__(self, ttl: float = TTL, size: int = FIFO) -> None:
        self.ttl, self.size = ttl, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.entries = handle.getMapState("entries", "entry string", "at double, place long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = {k[0]: tuple(v) for k, v in self.entries.iterator()}, []
        was = dict(held)
        place = max((p for _, p, _ in held.values()), default=0)
        for r in _rows(rows).itertuples():
            for e in [e for e, (at, *_) in held.items() if r.at - at > self.ttl]:
                out.append((key[0], None, e, "expired", None))
                del held[e]
            if r.kind == "get":
                out.append((key[0], r.id, r.entry, "hit" if r.entry in held else "miss", held[r.entry][2] if r.entry in held else None))
                continue
            if r.entry not in held:
                place += 1
                if len(held) == self.size:
                    first = min(held, key=lambda e: held[e][1])
                    out.append((key[0], None, first, "evicted", None))
                    del held[first]
            held[r.entry] = (r.at, held[r.entry][1] if r.entry in held else place, r.value)
        self._keep(was, held)
        yield self.out(out, id="Int64")

    def _keep(self, was: dict, held: dict) -> None:
        for e in was.keys() - held.keys():
            self.entries.removeKey((e,))
        for e, v in held.items():
            if was.get(e) != v:
                self.entries.updateValue((e,), v)
        if held:
            self.wake(min(at for at, *_ in held.values()) + self.ttl)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        was = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        held = {e: v for e, v in was.items() if now - v[0] <= self.ttl}
        self._keep(was, held)
        yield self.out([(key[0], None, e, "expired", None) for e in sorted(was.keys() - held.keys())], id="Int64")


TOLD = "epoch string, subscriber long, seq long, type string, job string, missed long"


class Hub(_Processor):
    """Numbers the events of an epoch, hands them to its subscribers, and answers those that resume from its last `keep` events.

    In: epoch, ts, id, kind, subscriber, type, job, known, after. 'event': type and job. 'subscribe': with the epoch and number it knows, if it
    resumes, and a job if it wants to hear of that one alone. 'read': it has taken what it was handed. 'leave'.
    Out: what each subscriber is handed, in order: events, one gap (missed: how many, -1 if that cannot be known) where the events it needs are no
    longer held, and 'keep-alive' every 25 s of the stream's time. A subscriber that has `behind` events to read is handed no more
    until it reads, and no other waits for it; what it lost shows as a jump in seq. Gaps go out whatever job was asked for.
    """

    columns = ["epoch", "subscriber", "seq", "type", "job", "missed"]

    def __init__(self, keep: int = HISTORY, behind: int = BEHIND, alive: float = KEEP_ALIVE) -> None:
        self.keep, self.behind, self.alive = keep, behind, alive

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getValueState("ring", "seq long, types array<string>, jobs array<string>")
        self.queues = handle.getMapState("queues", "subscriber long", "waiting long, job string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, types, jobs = self.ring.get() if self.ring.exists() else (0, (), ())
        types, jobs, out, epoch, last = list(types), list(jobs), [], key[0], 0.0
        queues = {k[0]: list(v) for k, v in self.queues.iterator()}
        gone = set()
        for r in _rows(rows).itertuples():
            last = r.at
            who = None if pd.isna(r.subscriber) else int(r.subscriber)
            if r.kind == "event":
                seq += 1
                types, jobs = [*types, r.type][-self.keep :], [*jobs, r.job or ""][-self.keep :]
                for s, queue in queues.items():
                    if queue[0] < self.behind:
                        queue[0] += 1
                        if not queue[1] or queue[1] == r.job:
                            out.append((epoch, s, seq, r.type, r.job, None))
            elif r.kind == "subscribe":
                queues[who] = [0, r.job or ""]
                gone.discard(who)
                first = seq - len(types) + 1
                if not r.known:
                    pass
                elif r.known != epoch:
                    out.append((epoch, who, seq, "gap", None, -1))
                elif r.after < first - 1:
                    out.append((epoch, who, seq, "gap", None, first - int(r.after) - 1))
                else:
                    missed = [(n, types[n - first], jobs[n - first]) for n in range(int(r.after) + 1, seq + 1)]
                    out += [(epoch, who, n, t, j or None, None) for n, t, j in missed if not r.job or j == r.job]
            elif r.kind == "read" and who in queues:
                queues[who][0] = 0
            elif r.kind == "leave" and queues.pop(who, None):
                gone.add(who)
        self.ring.update((seq, types, jobs))
        for s in gone:
            self.queues.removeKey((s,))
        for s, queue in queues.items():
            self.queues.updateValue((s,), tuple(queue))
        if queues and not list(self.handle.listTimers()):
            self.wake(last + self.alive)
        yield self.out(out, subscriber="Int64", seq="Int64", missed="Int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = sorted(k[0] for k in self.queues.keys())
        if known:
            self.wake(expiredTimerInfo.getExpiryTimeInMs() / 1000 + self.alive)
        yield self.out([(key[0], s, None, "keep-alive", None, None) for s in known], subscriber="Int64", seq="Int64", missed="Int64")


def _run(stream: DataFrame, by: str, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    store(stream.sparkSession)
    return stream.withWatermark("ts", late).groupBy(by).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def limited(stream: DataFrame, limit: int, window: float = WINDOW, max_wait: float = MAX_WAIT, late: str = "0 seconds") -> DataFrame:
    """Answers of a sliding-window limiter for each key (see Window)."""
    return _run(stream, "key", Window(limit, window, max_wait), LIMITED, late)


def paced(stream: DataFrame, gap: float = GAP, max_wait: float = MAX_WAIT, late: str = "0 seconds") -> DataFrame:
    """Answers of a limiter that spaces requests (see Spaced)."""
    return _run(stream, "key", Spaced(gap, max_wait), LIMITED, late)


def cached(stream: DataFrame, ttl: float = TTL, size: int = FIFO, late: str = "0 seconds") -> DataFrame:
    """Answers of a cache for each key (see Cache)."""
    return _run(stream, "key", Cache(ttl, size), CACHED, late)


def handed(stream: DataFrame, keep: int = HISTORY, behind: int = BEHIND, alive: float = KEEP_ALIVE, late: str = "0 seconds") -> DataFrame:
    """What subscribers of each epoch are handed (see Hub)."""
    return _run(stream, "epoch", Hub(keep, behind, alive), TOLD, late)
