"""Conversation sessions that end by a clear, or by silence longer than a time to live; in batch and as a keyed stream.

Input is turns(session_id, ts, seq, kind, question, answer), ordered by (ts, seq) in each session; kind `clear` ends the
session's life and is no turn, anything else (null too) is a turn. The next turn opens a new life; a clear without a life gives
nothing. A gap of exactly the time to live keeps the life. Rows without session or time are dropped. Times are of the event.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

_SAID = "seq long, question string, answer string"
LIFE = f"session_id string, started timestamp, last_active timestamp, turns long, cause string, recent array<struct<{_SAID}>>"


def _known(turns: DataFrame) -> DataFrame:
    clear = F.coalesce(F.col("kind") == "clear", F.lit(False))
    rows = turns.select(F.col("session_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), clear.alias("clear"), "question", "answer")
    return rows.where("session_id is not null and ts is not null")


def session_lives(turns: DataFrame, ttl_minutes: int = 120, exchanges: int = 6) -> DataFrame:
    """One row for each life: session_id, started, last_active, turns, cause (cleared, expired, live at the last event of
    all), recent (its last `exchanges`).

    A session is worked on by days, and only a row for each of its days is ordered as a whole, so that a session with a large
    share of all rows spreads over many tasks.
    """
    rows = _known(turns).withColumn("day", F.to_date("ts"))
    ttl = F.expr(f"make_dt_interval(0, 0, {ttl_minutes}, 0)")
    place = ["ts", "seq", "clear"]
    inside = Window.partitionBy("session_id", "day").orderBy(*place)
    by_day = Window.partitionBy("session_id").orderBy("day")
    days = rows.groupBy("session_id", "day").agg(F.max(F.struct(*place)).alias("end"))
    days = days.select("session_id", "day", F.lag("end").over(by_day).alias("yesterday"))
    rows = rows.join(days, ["session_id", "day"]).withColumn("before", F.coalesce(F.lag(F.struct(*place)).over(inside), "yesterday"))
    fresh = F.col("before").isNull() | F.col("before.clear") | (F.col("ts") > F.col("before.ts") + ttl)
    rows = rows.withColumn("own", F.when(fresh, F.struct(*place))).withColumn("start", F.last("own", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    opened = rows.groupBy("session_id", "day").agg(F.max("own").alias("latest"))
    carried = opened.select("session_id", "day", F.last("latest", True).over(by_day.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    rows = rows.join(carried, ["session_id", "day"]).withColumn("start", F.coalesce("start", "carried"))
    said = F.struct("ts", "seq", "question", "answer")
    newest = F.row_number().over(Window.partitionBy("session_id", "start", "day").orderBy(F.desc("ts"), F.desc("seq"), "clear"))
    rows = rows.withColumn("nth", newest)
    turn = ~F.col("clear")
    lives = rows.groupBy("session_id", "start").agg(
        F.min(F.when(turn, F.col("ts"))).alias("started"), F.max(F.when(turn, F.col("ts"))).alias("last_active"), F.count(F.when(turn, 1)).alias("turns"),
        F.bool_or("clear").alias("cleared"), F.sort_array(F.collect_list(F.when(turn & (F.col("nth") <= exchanges + 1), said)), asc=False).alias("x"),
    )
    now = rows.agg(F.max("ts").alias("now"))  # one row
    cause = F.when(F.col("cleared"), "cleared").when((F.col("last_active") + ttl < F.col("now")), "expired").otherwise("live")
    last = F.reverse(F.transform(F.slice("x", 1, exchanges), lambda s: F.struct(s["seq"].alias("seq"), s["question"].alias("question"), s["answer"].alias("answer"))))
    return lives.where("turns > 0").join(F.broadcast(now)).select("session_id", "started", "last_active", "turns", cause.alias("cause"), last.alias("recent"))


class _Lives(StatefulProcessor):
    """The open life of one session; a timer ends it when the watermark has passed its time to live."""

    def __init__(self, ttl_ms: int, exchanges: int):
        self.ttl, self.exchanges = ttl_ms, exchanges

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", f"started long, last long, turns long, recent array<struct<{_SAID}>>")

    def _ended(self, key: Any, life: list, cause: str) -> dict:
        return {"session_id": key[0], "started": life[0], "last_active": life[1], "turns": life[2], "cause": cause, "recent": life[3]}

    def _keep(self, life: list | None) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if life is None:
            self.life.clear()
        else:
            self.life.update((life[0], life[1], life[2], life[3]))
            self.handle.registerTimer(life[1] // 1000 + self.ttl + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = self.life.get()
        life = [found[0], found[1], found[2], [tuple(x) for x in found[3]]] if found is not None else None
        out = []
        f = pd.concat(list(rows)).sort_values(["us", "seq", "clear"])
        for us, seq, clear, question, answer in zip(f["us"].tolist(), f["seq"].tolist(), f["clear"].tolist(), f["question"].tolist(), f["answer"].tolist()):
            if life and us > life[1] + self.ttl * 1000:
                out.append(self._ended(key, life, "expired"))
                life = None
            if clear:
                if life:
                    out.append(self._ended(key, life, "cleared"))
                life = None
            else:
                life = life or [us, us, 0, []]
                life = [life[0], max(life[1], us), life[2] + 1, [*life[3], (int(seq), question, answer)][-self.exchanges :]]
        self._keep(life)
        yield pd.DataFrame(out, columns=["session_id", "started", "last_active", "turns", "cause", "recent"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        found = self.life.get()
        if found is not None:
            yield pd.DataFrame([self._ended(key, [found[0], found[1], found[2], [tuple(x) for x in found[3]]], "expired")])
            self.life.clear()

    def close(self) -> None:
        pass


def session_stream(turns: DataFrame, ttl_minutes: int = 120, exchanges: int = 6, late: str = "10 minutes") -> DataFrame:
    """session_lives over a stream: a life is emitted when it has ended (append mode). The state holds, for each open session,
    its times and last exchanges. Needs the RocksDB state store (`streaming_settings`)."""
    rows = _known(turns).withColumn("seq", F.coalesce("seq", F.lit(0))).withWatermark("ts", late)
    rows = rows.select("session_id", "ts", F.unix_micros("ts").alias("us"), "seq", "clear", "question", "answer")
    inner = LIFE.replace("started timestamp, last_active timestamp", "started long, last_active long")
    lives = rows.groupBy("session_id").transformWithStateInPandas(_Lives(ttl_minutes * 60_000, exchanges), inner, "append", "EventTime")
    return lives.withColumns({c: F.timestamp_micros(c) for c in ("started", "last_active")})


def streaming_settings() -> dict[str, str]:
    return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
