"""Sliding-window admission per key, as a batch job and as a stateful stream.

An event is admitted when fewer than ``max_requests`` admitted events of its
key lie in the ``window_seconds`` before it; rejected events do not count.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from grainfold.functions.columns import ref

MAX_REQUESTS, WINDOW_SECONDS = 60, 60
SPANS = 16  # windows per time bucket


def _micros(c: Column) -> Column:
    """Microseconds since 1970, exact for time stamps with and without zone."""
    return F.unix_micros(c.cast("timestamp"))


def window_hits(events: DataFrame, key: str, ts: str, window_seconds: int = WINDOW_SECONDS, spans: int = SPANS) -> DataFrame:
    """(key, ts, events, hits): events at each moment and hits in the trailing window.

    Equal moments are counted together first, so a burst is one row.
    """
    moments = events.groupBy(ref(key).alias("_k"), ref(ts).alias("_t")).agg(F.count("*").alias("_n")).withColumn("_u", _micros(F.col("_t")))
    return _trailing(moments, "_n", "_h", window_seconds * 1_000_000, spans).select(
        F.col("_k").alias(key), F.col("_t").alias(ts), F.col("_n").alias("events"), F.col("_h").alias("hits"))


def _trailing(moments: DataFrame, value: str, name: str, width: int, spans: int) -> DataFrame:
    """Sum of a column over the moments of the same key in the trailing window.

    Time is cut into buckets of ``spans`` windows. A bucket also receives the
    moments of one window before it, so it is complete by itself and a busy key
    is spread over many tasks.
    """
    bucket = width * spans
    own, next_one = F.floor(F.col("_u") / bucket), F.floor((F.col("_u") + width) / bucket)
    both = moments.select("*", own.alias("_own"), F.explode(F.array_distinct(F.array(own, next_one))).alias("_b"))
    w = Window.partitionBy("_k", "_b").orderBy("_u").rangeBetween(-width, 0)
    return both.withColumn(name, F.sum(value).over(w)).where("_b = _own").drop("_own", "_b")


def _admit(micros: int, held: deque, max_requests: int, width: int) -> tuple[bool, int, int]:
    """(admitted, remaining, retry_after) for the next event; updates the admitted moments."""
    while held and held[0] <= micros - width:
        held.popleft()
    if len(held) >= max_requests:
        return False, 0, max(1, (held[0] + width - micros) // 1_000_000 + 1)
    held.append(micros)
    return True, max_requests - len(held), 0


_OUT = "admitted boolean, remaining int, retry_after int"


def admit(
    events: DataFrame, key: str, ts: str, order: str, max_requests: int = MAX_REQUESTS, window_seconds: int = WINDOW_SECONDS,
) -> DataFrame:
    """Events with ``admitted``, ``remaining`` and ``retry_after``.

    The history of a key is cut into spells that do not depend on each other.
    A spell may start where the whole window before it was calm (never more
    hits than allowed): there every event was admitted, so the state is known
    without looking further back, and the spell receives the events of that
    window as its start. A busy key is cut about once per time bucket; only
    where it is overloaded without a pause does one spell go on. Inside a spell
    events pass in batches, with only one window of admitted moments in memory.
    """
    width = window_seconds * 1_000_000
    bucket = F.floor(F.col("_u") / (width * SPANS))
    untimed = events.where(ref(ts).isNull())  # no moment, no verdict: these come back with null results
    keyed = events.where(ref(ts).isNotNull()).withColumns({"_k": ref(key), "_u": _micros(ref(ts))}).withColumn("_b", bucket)
    cuts, marks = _spells(keyed, max_requests, width)
    marks = marks.select(F.col("_k").alias("_mk"), F.col("_b").alias("_mb"), "_cut", "_before")
    own = keyed.join(marks, F.col("_k").eqNullSafe(F.col("_mk")) & (F.col("_b") == F.col("_mb")))
    own = own.withColumn("_spell", F.when(F.col("_u") >= F.col("_cut"), F.col("_cut")).otherwise(F.coalesce("_before", F.lit(-1))))
    # The window before a cut lies in the bucket of the cut or in the one before it.
    cuts = cuts.select(F.col("_k").alias("_mk"), "_cut", F.explode(F.array(F.col("_b") - 1, F.col("_b"))).alias("_mb"))
    lead = keyed.join(cuts, F.col("_k").eqNullSafe(F.col("_mk")) & (F.col("_b") == F.col("_mb"))
                      & (F.col("_u") < F.col("_cut")) & (F.col("_u") > F.col("_cut") - width))
    names = [*events.columns, "_k", "_u", "_spell", "_lead"]
    rows = own.withColumn("_lead", F.lit(False)).select(*names).unionByName(
        lead.withColumns({"_spell": F.col("_cut"), "_lead": F.lit(True)}).select(*names))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "_k", "_spell").sortWithinPartitions("_k", "_spell", "_u", ref(order))
    columns = list(events.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, deque()
        for batch in batches:
            results = []
            for k, spell, u, is_lead in zip(batch["_k"], batch["_spell"], batch["_u"], batch["_lead"]):
                if (k, spell) != current:
                    current, held = (k, spell), deque()
                if is_lead:
                    held.append(int(u))
                else:
                    results.append(_admit(int(u), held, max_requests, width))
            out = batch.loc[~batch["_lead"].astype(bool), columns].copy()
            if results:
                out["admitted"], out["remaining"], out["retry_after"] = zip(*results)
                yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    timed = ordered.mapInPandas(run, f"{fields}, {_OUT}")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (part.split() for part in _OUT.split(", "))]
    return timed.unionByName(untimed.select("*", *nothing))


def _spells(keyed: DataFrame, max_requests: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(cuts, marks): the first possible cut per key and bucket, and per bucket also the cut before it."""
    from grainfold.operators import ordering

    moments = keyed.groupBy("_k", "_u").agg(F.count("*").alias("_n"))
    hits = _trailing(moments, "_n", "_h", width, SPANS).withColumn("_over", (F.col("_h") > max_requests).cast("int"))
    calm = _trailing(hits, "_over", "_overs", width, SPANS)
    bucket = F.floor(F.col("_u") / (width * SPANS))
    first = calm.groupBy("_k", bucket.alias("_b")).agg(F.min(F.when(F.col("_overs") == 0, F.col("_u"))).alias("_cut"))
    marks = ordering.carry(first.withColumn("_before", F.col("_cut")), ["_before"], ["_b"], ["_k"], include_current=False)
    return marks.where("_cut IS NOT NULL").select("_k", "_b", "_cut"), marks


class _Admission(StatefulProcessor):
    """One key of a stream: events wait until the watermark has passed them, and then come in the order of their time.

    State is what waits and the admitted moments of one window. A single timer
    stands at the next moment at which either changes; once the watermark has
    left the last window behind, nothing of the key is kept.
    """

    def __init__(self, max_requests: int, width: int, order_type: str):
        self.max_requests, self.width, self.order_type = max_requests, width, order_type

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "u bigint")
        self.waiting = handle.getListState("waiting", f"u bigint, o {self.order_type}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if len(batch):
                self.waiting.appendList([(int(u), o) for u, o in zip(batch["u"], batch["o"].tolist())])
                first = min(int(batch["u"].min()), first if first is not None else int(batch["u"].max()))
        timers = list(self.handle.listTimers())
        if first is not None and (not timers or _millis(first) < min(timers)):
            self._wake(timers, first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for u, o in self.waiting.get():
            (due if u <= passed else later).append((u, o))
        held = deque(u for (u,) in self.held.get())
        due.sort()
        results = [(key[0], o, u, *_admit(u, held, self.max_requests, self.width)) for u, o in due]
        while held and held[0] <= passed - self.width:  # events to come are later than ``passed``
            held.popleft()
        for state, rows in ((self.held, [(u,) for u in held]), (self.waiting, later)):
            state.put(rows) if rows else state.clear()
        following = [min(later)[0]] if later else []
        following += [held[-1] + self.width] if held else []
        self._wake([t for t in self.handle.listTimers() if t > timerValues.getCurrentWatermarkInMs()], *following)
        yield pd.DataFrame(results, columns=["k", "o", "u", "admitted", "remaining", "retry_after"])

    def _wake(self, timers: list[int], *moments: int) -> None:
        for t in timers:
            self.handle.deleteTimer(t)
        if moments:
            self.handle.registerTimer(_millis(min(moments)))

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """The first millisecond at which a moment has passed."""
    return -(-micros // 1000)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def admit_stream(
    events: DataFrame, key: str, ts: str, order: str, max_requests: int = MAX_REQUESTS, window_seconds: int = WINDOW_SECONDS, late: str = "10 minutes",
) -> DataFrame:
    """The same filter over a stream: key, order, ts and the verdict, the same rows that ``admit`` gives.

    Events may come in any order. A verdict is given once the watermark, ``late``
    behind the latest event, has passed the event; what comes later still is left
    out, as everywhere behind a watermark. Events without a moment come back at
    once with null results. The key has any type, null is a key; the state of a
    key goes when its last window has passed.

    The state lies in RocksDB; the session is set to it if it names no store of its own.
    """
    spark = events.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(setting, ""):
        spark.conf.set(setting, ROCKSDB)
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    named = events.select(ref(key).alias("k"), ref(order).alias("o"), ref(ts).alias("t"))
    timed = named.where("t IS NOT NULL").withColumn("w", F.col("t").cast("timestamp")).withWatermark("w", late)
    keyed = timed.select("k", "o", _micros(F.col("w")).alias("u"), "w")
    out = keyed.groupBy("k").transformWithStateInPandas(
        _Admission(max_requests, window_seconds * 1_000_000, types[order]), f"k {types[key]}, o {types[order]}, u bigint, {_OUT}", "Append", "EventTime")
    done = out.select(F.col("k").alias(key), F.col("o").alias(order), F.timestamp_micros("u").cast(types[ts]).alias(ts), "admitted", "remaining", "retry_after")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (part.split() for part in _OUT.split(", "))]
    return done.unionByName(named.where("t IS NULL").select(F.col("k").alias(key), F.col("o").alias(order), F.col("t").alias(ts), *nothing))


def window_hits_stream(events: DataFrame, key: str, ts: str, window_seconds: int = WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Hits per key in windows that slide by a quarter of their length; late events up to the watermark count."""
    slide = max(1, window_seconds // 4)
    stamped = events.withColumn("_t", ref(ts).cast("timestamp"))
    return (
        stamped.withWatermark("_t", late)
        .groupBy(ref(key), F.window("_t", f"{window_seconds} seconds", f"{slide} seconds")).agg(F.count("*").alias("hits"))
        .select(ref(key), F.col("window.start").alias("start"), F.col("window.end").alias("end"), "hits")
    )
