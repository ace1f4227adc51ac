"""Sequential state for each key: call limiter, token bucket, LRU cache with a time to live.

All three are folds over a key's events in time order. The fold is one function; the batch form
streams over sorted partitions with the state of one key in memory, and the streaming form keeps it
in Spark's state store.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SlidingLog:
    """At most ``calls`` accepted calls within ``seconds``; only accepted ones count."""

    def __init__(self, calls: int = 5, seconds: float = 60.0):
        self.calls, self.seconds, self.log = calls, seconds, deque()

    def __call__(self, t: float, value: str | None = None) -> str:
        while self.log and t - self.log[0] >= self.seconds:
            self.log.popleft()
        if len(self.log) >= self.calls:
            return "rejected"
        self.log.append(t)
        return "accepted"


class TokenBucket:
    """``rate`` tokens for each ``seconds``, refilled by whole tokens; full at first and after two idle intervals."""

    def __init__(self, rate: int = 60, seconds: float = 60.0):
        self.rate, self.seconds, self.tokens, self.last = rate, seconds, rate, None

    def __call__(self, t: float, value: str | None = None) -> str:
        if self.last is None or t - self.last > 2 * self.seconds:
            self.tokens, self.last = self.rate, t
        fresh = int((t - self.last) / self.seconds * self.rate)
        if fresh > 0:
            self.tokens, self.last = min(self.rate, self.tokens + fresh), t
        if self.tokens <= 0:
            return "rejected"
        self.tokens -= 1
        return "accepted"


class LruTtl:
    """Hit or miss of a cache of ``size`` values; an entry lives ``seconds`` from its creation, whatever reads it."""

    def __init__(self, size: int = 1000, seconds: float = 1800.0):
        self.size, self.seconds, self.held = size, seconds, OrderedDict()

    def __call__(self, t: float, value: str | None = None) -> str:
        made = self.held.get(value)
        if made is not None and t - made <= self.seconds:
            self.held.move_to_end(value)
            return "hit"
        self.held.pop(value, None)
        self.held[value] = t
        if len(self.held) > self.size:
            self.held.popitem(last=False)
        return "miss"


def fold(events: DataFrame, key: str, time: str, tie: str, make: Callable[[], Callable], value: str | None = None) -> DataFrame:
    """``events``' key, time and tie with outcome, in order of time and tie for each key. Null times come first."""
    rows = events.select(F.col(key).alias("key"), F.col(tie).alias("tie"), F.coalesce(F.unix_micros(F.col(time).cast("timestamp")) / 1e6, F.lit(0.0)).alias("t"), (F.col(value).cast("string") if value else F.lit(None).cast("string")).alias("value"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "t", "tie")
    kind = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = object(), None
        for b in batches:
            keys, t, values = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            out = []
            for k, x, v in zip(keys, t, values):
                if step is None or k != now:
                    now, step = k, make()
                out.append(step(x, v))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.string())], ["key", "tie", "t", "outcome"])

    return ordered.mapInArrow(run, f"key {kind['key']}, tie {kind['tie']}, t double, outcome string")


def limit_stream(events: DataFrame, calls: int = 5, seconds: float = 60.0) -> DataFrame:
    """The sliding log as a streaming operator over events(key long, t double): (key, t, outcome).

    Rows of one micro-batch are taken by time; the state is the log of accepted times.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        log = SlidingLog(calls, seconds)
        log.log = deque(state.get[0] if state.exists else [])
        pdf = pd.concat(list(frames)).sort_values("t", kind="stable")
        out = [log(float(t)) for t in pdf["t"]]
        state.update((list(map(float, log.log)),))
        yield pd.DataFrame({"key": np.full(len(pdf), key[0]), "t": pdf["t"].to_numpy(), "outcome": out})

    return events.groupBy("key").applyInPandasWithState(step, "key long, t double, outcome string", "log array<double>", "append", GroupStateTimeout.NoTimeout)
