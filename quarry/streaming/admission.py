"""Per-key sliding-window admission and time-to-live caches, batch and streaming.

A state that expires splits a key's history: once the gap between two events reaches the
window, nothing from before matters.  The batch forms cut every key into such bursts
first (in hour-wide pieces, so that a key with a third of all rows is no single task's),
and then walk the bursts, sorted, partition by partition, with nothing gathered.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator
from math import isfinite

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICRO = 1_000_000


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def bursts(df: DataFrame, key: str, at: str, gap: int, piece: int = 3_600 * MICRO) -> DataFrame:
    """``df`` with ``burst``: the time of the first event of the event's burst.

    ``at`` is in microseconds.  A burst ends where the key's next event is ``gap`` later or
    more.  Windows run within pieces of time and, over one row per piece, between them.
    """
    p = df.withColumn("_piece", F.floor(F.col(at) / F.lit(piece)))
    inside = W.partitionBy(key, "_piece").orderBy(at)
    p = p.withColumn("_prev", F.lag(at).over(inside))
    p = p.withColumn("_start", F.when(F.col("_prev").isNull() | (F.col(at) - F.col("_prev") >= gap), F.col(at)))
    ends = p.groupBy(key, "_piece").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.max(F.when(F.col("_prev").isNotNull(), F.col("_start"))).alias("_inner"))
    along = W.partitionBy(key).orderBy("_piece")
    ends = ends.withColumn("_before", F.lag("_last").over(along)).withColumn("_opens", F.col("_before").isNull() | (F.col("_first") - F.col("_before") >= gap))
    # The burst open at a piece's end: begun inside it, at its first event, or earlier.
    begun = F.coalesce("_inner", F.when(F.col("_opens"), F.col("_first")))
    ends = ends.withColumn("_carry", F.last(begun, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)))
    ends = ends.select(F.col(key).alias("_k"), F.col("_piece").alias("_p"), F.when(F.col("_opens"), F.col("_first")).otherwise(F.col("_carry")).alias("_head"))
    j = p.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_piece") == F.col("_p")))
    inner = F.max(F.when(F.col("_prev").isNotNull(), F.col("_start"))).over(inside.rangeBetween(W.unboundedPreceding, 0))
    return j.withColumn("burst", F.coalesce(inner, F.col("_head"))).drop("_piece", "_prev", "_start", "_k", "_p", "_head")


class Admission:
    """At most ``limit`` accepted events in any ``window``; refused ones consume nothing."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window, self.kept = limit, window, deque()

    def accept(self, now: int) -> bool:
        while self.kept and now - self.kept[0] >= self.window:
            self.kept.popleft()
        if len(self.kept) >= self.limit:
            return False
        self.kept.append(now)
        return True


class TtlCache:
    """Hits of a cache whose entries live ``ttl`` from their insertion (reads don't extend it), least recently used out first."""

    def __init__(self, size: int, ttl: int):
        self.size, self.ttl, self.at = size, ttl, OrderedDict()

    def get(self, name, now: int) -> bool:
        if self.size <= 0 or self.ttl <= 0:
            return False
        for k in [k for k, t in self.at.items() if now - t >= self.ttl]:
            del self.at[k]
        if name in self.at:
            self.at.move_to_end(name)
            return True
        while len(self.at) >= self.size:
            self.at.popitem(last=False)
        self.at[name] = now
        return False


class Clients:
    """``Admission`` per client for at most ``most`` clients at once; a client is forgotten ``ttl`` after its last accepted event.

    While all places are taken, new clients are refused and none is put out; refused events
    neither extend a client's time nor take a place.
    """

    def __init__(self, limit: int, window: int, most: int, ttl: int):
        self.limit, self.window, self.most, self.ttl = limit, window, most, ttl
        self.of: OrderedDict = OrderedDict()  # by last accepted event, the oldest first

    def accept(self, client, now: int) -> bool:
        while self.of and now - next(iter(self.of.values())).kept[-1] >= self.ttl:
            self.of.popitem(last=False)
        if not self.limit or client not in self.of and len(self.of) >= self.most:
            return False
        a = self.of.get(client) or Admission(self.limit, self.window)
        last = a.kept[-1] if a.kept else None
        if not a.accept(now):
            if last is not None and not a.kept:
                a.kept.append(last)
            return False
        self.of[client] = a
        self.of.move_to_end(client)
        return True


def check_limit(limit: int, window: float) -> None:
    """A limit is a whole number of 0 or more, a window a finite number above 0."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
        raise ValueError("the limit must be a whole number of 0 or more")
    if isinstance(window, bool) or not isinstance(window, (int, float)) or not isfinite(window) or window <= 0:
        raise ValueError("the window must be a finite number above 0")


def _walk(df: DataFrame, key: str, at: str, tie: str, extra: str | None, make, step, out: str, gap: int) -> DataFrame:
    """One flag per event: bursts are spread over the partitions, each sorted by time and walked in order."""
    cols = [key, "burst", at, tie] + ([extra] if extra else [])
    parts = bursts(df.select(key, at, tie, *([extra] if extra else [])), key, at, gap).select(*cols).repartition(key, "burst").sortWithinPartitions(key, "burst", at, tie)
    tie_type = df.schema[tie].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for b in batches:
            data = [c.to_pylist() for c in b.columns]
            flags = []
            for i in range(b.num_rows):
                if (data[0][i], data[1][i]) != current:
                    current, state = (data[0][i], data[1][i]), make()
                flags.append(step(state, data[2][i], data[4][i] if extra else None))
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(flags, pa.bool_())], names=[tie, out])

    return parts.mapInArrow(run, f"{tie} {tie_type}, {out} boolean")


def admit(df: DataFrame, key: str, ts: str, tie: str, limit: int = 6, window: float = 60) -> DataFrame:
    """``tie, accepted`` of every event with a time: sliding-window admission per key, events in order of time and ``tie``."""
    check_limit(limit, window)
    w = int(window * MICRO)
    timed = df.where(F.col(ts).isNotNull()).withColumn("_at", _micros(ts))
    return _walk(timed, key, "_at", tie, None, lambda: Admission(limit, w), lambda s, now, _: s.accept(now), "accepted", w)


def admit_all(df: DataFrame, ts: str, tie: str, limit: int = 60, window: float = 3600) -> DataFrame:
    """``tie, accepted``: one budget for all events together; what was accepted isn't given back.

    One task walks a stretch of time in which no pause reaches the window; it holds
    ``limit`` times, whatever the stretch.
    """
    return admit(df.withColumn("_all", F.lit(0)), "_all", ts, tie, limit, window)


def admit_clients(df: DataFrame, key: str, ts: str, tie: str, limit: int = 6, window: float = 60, most: int = 1024, ttl: float = 600) -> DataFrame:
    """``tie, accepted`` of every event with a time and a client: ``admit``, for at most ``most`` clients at once.

    A client's place is free ``ttl`` seconds after its last accepted event, which must cover
    the window.  Keys that differ in letter case are one client.  A limit or number of
    clients of 0 refuses all.  As clients share the places, one task walks a stretch of time
    in which no pause reaches ``ttl``; it holds ``most * limit`` times, whatever the stretch.
    """
    check_limit(limit, window)
    check_limit(most, ttl)
    if ttl < window:
        raise ValueError("the time of a client must cover the window")
    w, t = int(window * MICRO), int(ttl * MICRO)
    timed = df.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(F.lit(0).alias("_all"), _micros(ts).alias("_at"), tie, F.lower(F.col(key).cast("string")).alias("_client"))
    return _walk(timed, "_all", "_at", tie, "_client", lambda: Clients(limit, w, most, t), lambda s, now, c: s.accept(c, now), "accepted", t)


def cache_hits(df: DataFrame, key: str, name: str, ts: str, tie: str, size: int = 2, ttl: float = 600) -> DataFrame:
    """``tie, hit`` of every event with a time: one cache of ``size`` entries per key, ``ttl`` seconds from insertion."""
    t = int(ttl * MICRO)
    timed = df.where(F.col(ts).isNotNull()).withColumn("_at", _micros(ts))
    return _walk(timed, key, "_at", tie, name, lambda: TtlCache(size, t), lambda s, now, x: s.get(x, now), "hit", max(t, 1))


def window_counts(df: DataFrame, key: str, ts: str, tie: str, window: float = 60, pieces: int = 16) -> DataFrame:
    """``tie, n``: events of the key in the half-open window that ends with the event, refused ones included.

    Time is cut into pieces of ``pieces`` windows; an event also goes to the next piece if
    a window there reaches back to it.  So a key's events spread over many tasks.
    """
    w = int(window * MICRO)
    size = w * pieces
    timed = df.where(F.col(ts).isNotNull()).select(F.col(key).alias("_k"), F.col(tie), _micros(ts).alias("_at"))
    own, reach = F.floor(F.col("_at") / F.lit(size)), F.floor((F.col("_at") + (w - 1)) / F.lit(size))
    placed = timed.select("*", own.alias("_own"), F.explode(F.array_distinct(F.array(own, reach))).alias("_piece"))
    span = W.partitionBy("_k", "_piece").orderBy("_at").rangeBetween(-(w - 1), 0)
    return placed.withColumn("n", F.count("*").over(span)).where("_own = _piece").select(tie, "n")


def admit_stream(stream: DataFrame, key: str, ts: str, tie: str, limit: int = 6, window: float = 60, late: str = "10 minutes") -> DataFrame:
    """The same admission over a stream: ``key, tie, accepted``.

    The state of a key is its accepted times within the window; it times out with the
    watermark once they have all expired.  A key's events of one micro-batch are taken in
    order of time and ``tie``: their times are held at once, which what the source takes per
    trigger bounds.  Events behind the watermark get no decision.
    """
    check_limit(limit, window)
    w = int(window * MICRO)
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, tie)}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        a = Admission(limit, w)
        a.kept.extend(state.get[0] if state.exists else [])
        rows = pd.concat([b[["_at", tie]] for b in batches]).sort_values(["_at", tie], kind="stable")
        flags = [a.accept(int(t)) for t in rows["_at"]]
        state.update((list(a.kept),))
        expires = (a.kept[-1] if a.kept else int(rows["_at"].iloc[-1])) // 1000 + w // 1000
        state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(rows), tie: rows[tie], "accepted": flags})

    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).withColumn("_at", _micros("_ts")).select(key, tie, "_ts", "_at")
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {tie} {kinds[tie]}, accepted boolean", "kept array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
