"""Streams: candles, bar upserts, watchlist alerts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pastcast.functions.common import micros
from pastcast.operators.search import correlation
from pastcast.operators.windows import windows
from pastcast.session import ship, stored, with_fields
from pastcast.sources.bars import BarStore
from pastcast.sources.series import framed, positions


def candles(ticks: DataFrame, size: str, lateness: str = "10 minutes") -> DataFrame:
    """(series_id, ts, open, high, low, close, volume, n) of closed windows of ticks (series_id, ts, event_id, value); batch or stream.

    On a stream, rows later than the watermark are left out and a window is emitted once the watermark passes it.
    """
    rows = ticks.withWatermark("ts", lateness) if ticks.isStreaming else ticks
    order = F.struct("ts", "event_id")
    out = rows.groupBy("series_id", F.window("ts", size).alias("w")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum("value").alias("volume"), F.count("*").alias("n")
    )
    return out.select("series_id", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "n")


class BarTable:
    """Bars that a stream upserts, for foreachBatch: a ``BarStore`` under a path that outlives the process.

    A batch that is delivered again, by a restarted query too, is left out. Streams with checkpoints of their own need names of their own.
    """

    def __init__(self, keys: list[str], path: str, writer: str = "stream") -> None:
        self.keys, self.path, self.writer = keys, path, writer

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        BarStore(batch.sparkSession, self.path, self.keys, self.writer).upsert(batch, batch_id)


def _fired(hits: DataFrame) -> DataFrame:
    """Hits (watchlist_id, ts, score, cooldown_seconds) that fire, as a batch of any size.

    Hits of a list are numbered by (ts, score downwards). Each finds the number of the first hit at or after its cooldown, which is as many as
    there are hits before that time; both come from running counts inside days that start from the days' totals. Those that fire are what the
    first hit reaches by such jumps; every round doubles the length of the jumps that are followed.
    """
    us = micros("ts")
    day = lambda x: F.floor(x / 86_400_000_000)
    rows = stored(hits.withColumn("us", us))
    inside = Window.partitionBy("watchlist_id", "day").orderBy("us", F.desc("score"))
    own = rows.withColumn("day", day(F.col("us")))
    totals = own.groupBy("watchlist_id", "day").agg(F.count("*").alias("n"))
    before = totals.select("watchlist_id", "day", (F.sum("n").over(Window.partitionBy("watchlist_id").orderBy("day")) - F.col("n")).alias("skip"))  # a row per list and day
    numbered = stored(own.withColumn("k", F.row_number().over(inside)).join(before, ["watchlist_id", "day"]).select("watchlist_id", "ts", "us", "score", "cooldown_seconds", (F.col("skip") + F.col("k") - 1).alias("k")))
    # one union of hits and of the times when silences end, an end before the hits of its own time
    ends = numbered.select("watchlist_id", (F.col("us") + F.ceil(F.col("cooldown_seconds") * 1e6).cast("long")).alias("us"), F.lit(0).alias("is_hit"), "k")
    both = numbered.select("watchlist_id", "us", F.lit(1).alias("is_hit"), "k").unionByName(ends).withColumn("day", day(F.col("us")))
    sums = both.groupBy("watchlist_id", "day").agg(F.sum("is_hit").alias("n"))
    skips = sums.select("watchlist_id", "day", (F.sum("n").over(Window.partitionBy("watchlist_id").orderBy("day")) - F.col("n")).alias("skip"))
    run = F.sum("is_hit").over(Window.partitionBy("watchlist_id", "day").orderBy("us", "is_hit").rowsBetween(Window.unboundedPreceding, 0))
    jump = stored(both.withColumn("run", run).filter("is_hit = 0").join(skips, ["watchlist_id", "day"]).select("watchlist_id", "k", F.greatest(F.col("skip") + F.col("run"), F.col("k") + 1).alias("next")))
    fired = stored(numbered.filter("k = 0").select("watchlist_id", "k"))
    n = fired.count()
    while n:
        reached = fired.join(jump, ["watchlist_id", "k"]).select("watchlist_id", F.col("next").alias("k")).join(numbered.select("watchlist_id", "k"), ["watchlist_id", "k"], "left_semi")
        fired = stored(fired.unionByName(reached).distinct())
        now = fired.count()
        if now == n:
            break
        n = now
        ahead = jump.select(F.col("watchlist_id").alias("_w"), F.col("k").alias("_k"), F.col("next").alias("_n"))
        jump = stored(jump.join(ahead, (F.col("watchlist_id") == F.col("_w")) & (F.col("next") == F.col("_k")), "left").select("watchlist_id", "k", F.coalesce("_n", "next").alias("next")))
    return numbered.join(fired, ["watchlist_id", "k"]).select("watchlist_id", "ts", "score")


def alerts(scores: DataFrame, watchlists: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """(watchlist_id, ts, score) of scores (watchlist_id, ts, score) that reach their list's threshold; batch or stream.

    A disabled list is silent, and so is a list for cooldown_seconds after an alert. On a stream the state is the time of the last alert and it is
    forgotten once event time (the watermark, ``lateness`` behind) has passed the list's own cooldown.
    """
    ship(scores.sparkSession)
    lists = watchlists.filter("enabled").select("watchlist_id", "threshold", "cooldown_seconds")
    rows = scores.select("watchlist_id", F.col("ts").cast("timestamp").alias("ts"), "score")
    rows = rows.withWatermark("ts", lateness) if scores.isStreaming else rows
    hits = rows.join(F.broadcast(lists) if watchlists.limit(100_001).count() <= 100_000 else lists, "watchlist_id").filter("score >= threshold").select("watchlist_id", "ts", "score", "cooldown_seconds")
    if not scores.isStreaming:
        return _fired(hits)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, kept, quiet = (pd.Timestamp(state.get[0], unit="us") if state.exists else None), [], 0.0
        for row in pd.concat(list(parts)).sort_values(["ts", "score"], ascending=[True, False]).itertuples():
            quiet = row.cooldown_seconds
            if last is None or (row.ts - last).total_seconds() >= quiet:
                kept.append((row.watchlist_id, row.ts, row.score))
                last = row.ts
        us = int(last.value // 1000)
        state.update((us,))
        state.setTimeoutTimestamp(max(us // 1000 + int(quiet * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(kept, columns=["watchlist_id", "ts", "score"])

    return hits.groupBy("watchlist_id").applyInPandasWithState(step, "watchlist_id string, ts timestamp, score double", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def watch(candles_: DataFrame, watches: DataFrame, every: int = 5, most: int = 500) -> DataFrame:
    """(watch_id, n, ts, score, kind): after every so many candles, the best Pearson score of the watch's query over its last ``most`` values.

    candles_: (series_id, ts, event_id, value); watches: (watch_id, series_id, query, threshold), queries of one length. The score is
    50 (1 + r), 0 for flat windows; kind is alert from the threshold on, else scan. As a batch, windows are scored as rows and the best is a
    bounded frame, so that no task folds a whole series. On a stream, the state holds the last ``most`` values and how many
    came; candles must arrive in order.
    """
    lists = watches.select("watch_id", "series_id", F.col("query").alias("_q"), "threshold")
    kind = F.when(F.col("score") >= F.col("threshold"), "alert").otherwise("scan").alias("kind")
    if not candles_.isStreaming:
        width = lists.select(F.size("_q").alias("n")).first()
        rows = positions(candles_, "event_id")
        at = rows.select("series_id", F.col("pos").alias("end"), "ts")
        w = windows(rows, width.n if width else 2).withColumn("end", F.col("start") + F.size("values") - 1)
        met = w.join(F.broadcast(lists) if lists.limit(1001).count() <= 1000 else lists, "series_id")
        met = met.select("watch_id", "series_id", "threshold", F.col("end").alias("pos"), F.coalesce(50 * (1 + correlation(F.col("values"), F.col("_q"))), F.lit(0.0)).alias("s"))
        frame = Window.partitionBy("watch_id", "chunk").orderBy("pos").rowsBetween(-(most - (width.n if width else 2)), 0)
        best = framed(met, {"score": F.max("s").over(frame)}, before=most).filter((F.col("pos") + 1) % every == 0)
        best = best.withColumnRenamed("pos", "end").join(at, ["series_id", "end"])
        return best.select("watch_id", (F.col("end") + 1).alias("n"), F.col("ts").cast("timestamp").alias("ts"), "score", kind)
    ship(candles_.sparkSession)
    met = candles_.select("series_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").cast("double").alias("value")).join(lists, "series_id")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        n, last = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        q, out = np.asarray(pdf["_q"].iloc[0], dtype=float), []
        for row in pdf.itertuples():
            n, last = n + 1, [*last, row.value][-most:]
            if n % every == 0 and len(last) >= len(q):
                out.append((key[0], n, row.ts, _best_score(np.array(last), q), row.threshold))
        state.update((n, last))
        yield pd.DataFrame(out, columns=["watch_id", "n", "ts", "score", "threshold"])

    found = met.groupBy("watch_id").applyInPandasWithState(step, with_fields(met.select("watch_id"), "n long, ts timestamp, score double, threshold double"), "n long, last array<double>", "append", GroupStateTimeout.NoTimeout)
    return found.select("watch_id", "n", "ts", "score", kind)


def _best_score(values: np.ndarray, q: np.ndarray) -> float:
    w = np.lib.stride_tricks.sliding_window_view(values, len(q))
    d = w.std(axis=1) * q.std()
    r = np.divide((w - w.mean(axis=1, keepdims=True)) @ (q - q.mean()) / len(q), d, out=np.full(len(w), -1.0), where=d != 0)
    return float(50 * (1 + r.max()))
