"""Streams with keyed state and event-time timers: alert episodes (ST12), request quotas (ST13), traffic watch (ST4).

Rows wait in a key's state until the watermark has passed them, and are then taken in event-time order, so the result does
not depend on how they were spread over files and batches: it is the batch result on all rows that came no later than
the watermark. Timers end what nothing ends by itself: an episode that falls silent, a quota window that runs out (its state
is evicted), a traffic bucket in which nothing happens. The state store has to be RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import episodes as E

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATERMARK = "10 minutes"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class Ordered(StatefulProcessor):
    """Holds rows back until the watermark has passed them; subclasses take them one by one, in order.

    ``ROW`` is the schema of what is kept of a row: first ``t`` (microseconds), then what breaks its ties. ``STATE`` is the schema of
    the key's state. ``columns`` are those of the output. What waits is as much as comes within the watermark's delay: a list that
    is read and written as a whole, with a timer for the first of its rows.
    """

    ROW, STATE, columns = "t long", "", ()

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROW)
        self.value = handle.getValueState("state", self.STATE)
        self.done: tuple[int, set] = (-1, set())

    def kept(self, rows: pd.DataFrame) -> Iterator[tuple]:
        return rows[self.names()].itertuples(index=False, name=None)

    def names(self) -> list[str]:
        return [c.split()[0] for c in self.ROW.split(", ")]

    def timer(self, t_us: int) -> None:
        self.handle.registerTimer(-(-int(t_us) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            kept = [(int(row[0]), *row[1:]) for row in self.kept(pdf)]
            if kept:
                self.waiting.appendList(kept)
                first = min(kept[0][0] if first is None else first, *(row[0] for row in kept))
        if first is not None:
            self.due(first)
        return iter([])

    def due(self, t_us: int) -> None:
        """A timer at which rows of the time are taken."""
        self.handle.registerTimer(-(-t_us // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if self.done[0] != now:
            self.done = (now, set())
        if key in self.done[1]:  # an earlier timer of this batch took all there is
            return
        self.done[1].add(key)
        waiting = set(map(tuple, self.waiting.get()))  # equal rows are one
        ready = [row for row in waiting if row[0] <= now]
        state = tuple(self.value.get()) if self.value.exists() else None
        out: list[tuple] = []
        for row in self.ordered(ready):
            state = self.take(key, row, state, out)
        if len(ready) == len(waiting):
            self.waiting.clear()
        elif ready:
            left = [row for row in waiting if row[0] > now]
            self.waiting.put(left)
            self.due(min(row[0] for row in left))
        state = self.passed(key, now, state, out)
        if state is None:
            self.value.clear()
        else:
            self.value.update(state)
        if out:
            yield pd.DataFrame(out, columns=list(self.columns))

    def ordered(self, rows: list[tuple]) -> list[tuple]:
        return sorted(rows)

    def take(self, key, row: tuple, state: tuple | None, out: list[tuple]) -> tuple | None:
        raise NotImplementedError

    def passed(self, key, now: int, state: tuple | None, out: list[tuple]) -> tuple | None:
        return state

    def close(self) -> None:
        pass


# ------------------------------------------------------------------ ST12 alert episodes
class Episodes(Ordered):
    """The rule of ``operators.episodes`` for one (alert, service); an episode that falls silent is reported as resolved."""

    ROW = "t long, rank int"
    STATE = "episode long, last long, sent long, sent_rank int, top int, open boolean"
    columns = ("alert_type", "service", "severity", "t", "notified", "episode", "resolved")
    SCHEMA = "alert_type string, service string, severity string, t long, notified boolean, episode long, resolved boolean"
    step = E.STEP_S * 1_000_000

    def row(self, key, t: int, rank: int, notified: bool, episode: int, resolved: bool) -> tuple:
        return (key[0], key[1], E.SEVERITIES[rank - 1] if rank else None, t, notified, episode, resolved)

    def ordered(self, rows):
        return sorted(dict(sorted(rows)).items())  # of one window the highest severity

    def take(self, key, row, state, out):
        t, rank = row
        episode, last, sent, sent_rank, top, is_open = state or (0, None, None, 0, 0, False)
        opens = last is None or t - last > self.step
        if opens and is_open:
            out.append(self.row(key, last + self.step, top, True, episode, True))
        if opens:
            episode, top, sent_rank = episode + 1, 0, 0
        notify = opens or rank > sent_rank or t - sent >= E.repeat_us(rank)
        out.append(self.row(key, t, rank, notify, episode, False))
        if notify:
            sent, sent_rank = t, rank
        self.timer(t + self.step + 1)
        return episode, t, sent, sent_rank, max(top, rank), True

    def passed(self, key, now, state, out):
        if state is None or not state[5] or now <= state[1] + self.step:
            return state
        episode, last, sent, sent_rank, top, _ = state
        out.append(self.row(key, last + self.step, top, True, episode, True))
        return episode, last, sent, sent_rank, top, False


def alert_episodes(alerts: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """ST12 on a stream of ``alert_type, service, severity, window_start timestamp``."""
    a = alerts.withWatermark("window_start", watermark).select(
        *[F.coalesce(k, F.lit("")).alias(k) for k in E.GROUP], "window_start", E.severity_rank(F.col("severity")).alias("rank"))
    out = a.withColumn("t", F.unix_micros("window_start")).groupBy(*E.GROUP).transformWithStateInPandas(
        statefulProcessor=Episodes(), outputStructType=Episodes.SCHEMA, outputMode="Append", timeMode="EventTime")
    return out.withColumn("t", F.timestamp_micros("t")).withColumnRenamed("t", "window_start")


# ------------------------------------------------------------------ ST13 request quota
class Quota(Ordered):
    """A client's window starts at its first request and lasts ``window_us``; after it the state is evicted."""

    ROW = "t long, request_id long"
    STATE = "start long, n long"
    columns = ("client", "request_id", "t", "start", "rank_in_window", "allowed")
    SCHEMA = "client string, request_id long, t long, start long, rank_in_window long, allowed boolean"

    def __init__(self, window_us: int, limit: int):
        self.window_us, self.limit = window_us, limit

    def take(self, key, row, state, out):
        t, request = row
        start, n = state if state is not None and t <= state[0] + self.window_us else (t, 0)
        if n == 0:
            self.timer(start + self.window_us + 1)
        out.append((key[0], request, t, start, n + 1, n < self.limit))
        return start, n + 1

    def passed(self, key, now, state, out):
        return None if state is not None and now > state[0] + self.window_us else state


def quota(requests: DataFrame, window_us: int, limit: int, watermark: str = WATERMARK) -> DataFrame:
    """ST13 on a stream of ``client, request_id, ts timestamp``; requests without a client count as one client ``unknown``."""
    r = requests.withWatermark("ts", watermark).select(
        F.coalesce(F.col("client").cast("string"), F.lit("unknown")).alias("client"), "request_id", "ts",
        F.unix_micros("ts").alias("t"))
    out = r.groupBy("client").transformWithStateInPandas(
        statefulProcessor=Quota(window_us, limit), outputStructType=Quota.SCHEMA, outputMode="Append", timeMode="EventTime")
    return out.select("client", "request_id", F.timestamp_micros("t").alias("ts"), F.timestamp_micros("start").alias("window_start"),
                      "rank_in_window", "allowed")


# ------------------------------------------------------------------ ST4 traffic watch
BUCKET_US = 300_000_000
TOP_ENDPOINTS = 10


class Calendar(Ordered):
    """5-minute buckets in order; a bucket in which nothing came is a row too, once the watermark has passed its end."""

    ROW = "t long, n long, errors long, ips long, endpoint string"
    STATE = "last long, n long"
    columns = ("bucket", "n", "errors", "error_share", "distinct_ips", "top_endpoints", "prev_n", "spike", "drop")
    SCHEMA = ("bucket long, n long, errors long, error_share double, distinct_ips long, top_endpoints string, prev_n long, "
              "spike boolean, drop boolean")

    def kept(self, rows):
        rows = rows[self.names()].astype(object)
        return rows.where(rows.notna(), None).itertuples(index=False, name=None)

    def timer(self, t_us: int) -> None:  # a bucket is over at its end
        super().timer(t_us + BUCKET_US)

    def ordered(self, rows):
        buckets: dict[int, list] = {}
        for t, n, errors, ips, endpoint in rows:
            buckets.setdefault(t, []).append((endpoint, n, errors, ips))
        out = []
        for t, found in sorted(buckets.items()):
            total = next(x for x in found if x[0] is None)
            top = sorted((x for x in found if x[0] is not None), key=lambda x: (-x[1], x[0]))[:TOP_ENDPOINTS]
            out.append((t, *total[1:], "|".join(f"{x[0]}:{x[1]}" for x in top)))
        return out

    def emit(self, t, n, errors, ips, top, state, out):
        prev = state[1] if state else None
        share = round(errors / n, 4) if n else None
        out.append((t, n, errors, share, ips, top, prev or 0, prev is not None and n > 3 * prev,
                    prev is not None and prev > 10 and n < 0.3 * prev))
        self.timer(t + BUCKET_US)
        return t, n

    def empty_until(self, end, state, out):
        while state and state[0] + BUCKET_US < end:
            state = self.emit(state[0] + BUCKET_US, 0, 0, 0, "", state, out)
        return state

    def take(self, key, row, state, out):
        state = self.empty_until(row[0], state, out)
        return self.emit(*row, state, out)

    def passed(self, key, now, state, out):
        return self.empty_until(now - BUCKET_US + 1, state, out)


def traffic_watch(requests: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """ST4 on a stream of ``ts timestamp, status_code, ip, route``: the rows of the batch report, bucket by bucket.

    An aggregate with a partial per task counts each bucket and its endpoints (addresses by sketch); only these few rows,
    never requests, come to the calendar's one key.
    """
    r = requests.withWatermark("ts", watermark)
    # per endpoint, and once for all of them (null)
    both = r.withColumn("endpoint", F.explode(F.array(F.lit(None).cast("string"), F.col("route"))))
    b = both.groupBy(F.window("ts", "5 minutes").alias("w"), "endpoint").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_code") >= 400).alias("errors"),
        F.approx_count_distinct("ip", 0.02).alias("ips"))
    rows = b.select(F.lit("traffic").alias("watch"), F.window_time("w").alias("at"), "n", "errors", "ips", "endpoint",
                    F.unix_micros("w.start").alias("t"))
    out = rows.groupBy("watch").transformWithStateInPandas(
        statefulProcessor=Calendar(), outputStructType=Calendar.SCHEMA, outputMode="Append", timeMode="EventTime")
    return out.withColumn("bucket", F.timestamp_micros("bucket"))
