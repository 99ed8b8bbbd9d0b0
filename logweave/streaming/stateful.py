"""Streams with state of their own for each key: events held back to a rate, and labelling sessions.

State is kept by ``transformWithStateInPandas`` in the checkpoint; sessions need
the RocksDB state store, which ``stateful_session`` sets for a session beside one's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.running import positions, running

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB."""
    beside = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        beside.conf.set(key, spark.conf.get(key))
    beside.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return beside


def _millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def release_windows(events: DataFrame, most: int, seconds: int, order: list[str], by: str = "target", ts_col: str = "ts") -> DataFrame:
    """Adds ``release``: the number of the window of ``seconds`` in which an event may leave, at most ``most`` for each ``by`` and window.

    An event leaves in the window of its own time if there is room, else in the first that has some; in the order of ``ts_col``, then ``order``. The
    n-th event of a key can't leave before the one ``most`` places ahead has and a window has passed. So along each of these
    chains release is a running maximum: no state, and no window function over a whole key.
    """
    place = [F.col(ts_col), *map(F.col, order)]
    own = F.floor(_millis(F.col(ts_col)) / (1000 * seconds)).cast("long")
    numbered = positions(events, place, by, "__n").withColumns({"__chain": (F.col("__n") - 1) % most, "__step": F.floor((F.col("__n") - 1) / most).cast("long")})
    numbered = numbered.withColumn("__key", F.xxhash64(F.col(by), F.col("__chain"))).withColumn("__lead", own - F.col("__step"))
    run = running(numbered, [F.col("__step"), *map(F.col, order)], "__key", __most=("max", F.col("__lead")))
    return run.withColumn("release", F.col("__most") + F.col("__step")).select(*events.columns, "release")


class _Bucket(StatefulProcessor):
    """One key's bucket: which window it fills, how much of it is taken, and the events that wait, by their number."""

    def __init__(self, most: int, seconds: int, event_time: bool):
        self.most, self.span, self.event_time = most, 1000 * seconds, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "window long, used long, head long, tail long")
        self.waiting = handle.getMapState("waiting", "number long", "release long, payload string")

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self._now(timerValues)
        window, used, head, tail = self.at.get() if self.at.exists() else (-1, 0, 0, 0)
        batch = pd.concat(list(rows)).sort_values(["millis", "place"])
        out = []
        for millis, payload in zip(batch["millis"], batch["payload"]):
            own = int(millis if self.event_time else now) // self.span
            if own > window:
                window, used = own, 0
            elif used >= self.most:
                window, used = window + 1, 0
            used += 1
            if head == tail and (window == own or window * self.span <= now):
                out.append((window, payload))
                continue
            if used == 1 or head == tail:
                self.handle.registerTimer(max(window * self.span, 1))
            self.waiting.updateValue((tail,), (window, payload))
            tail += 1
        self.at.update((window, used, head, tail))
        yield self._said(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(self._now(timerValues), expiredTimerInfo.getExpiryTimeInMs())
        window, used, head, tail = self.at.get()
        out = []
        while head < tail:
            release, payload = self.waiting.getValue((head,))
            if release * self.span > now:
                break
            out.append((release, payload))
            self.waiting.removeKey((head,))
            head += 1
        self.at.update((window, used, head, tail))
        yield self._said(key, out)

    @staticmethod
    def _said(key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"by": [key[0]] * len(out), "release": [r for r, _ in out], "payload": [p for _, p in out]}, dtype=object)

    def close(self) -> None:
        pass


def rate_limited(
    stream: DataFrame, most: int, seconds: int = 60, by: str = "target", ts_col: str = "ts", order: str | None = None, late: str | None = None
) -> DataFrame:
    """``stream`` with the window of its release: at most ``most`` rows for each ``by`` leave in a window of ``seconds``, the others wait, in order.

    What waits lies in the state, which a restart finds again, and leaves on a timer; nothing is given up. Windows are of the clock,
    or, with ``late``, of the event time in ``ts_col`` with a watermark of that delay, behind which the engine drops rows. Rows of
    one batch go by ``ts_col``, then ``order``. A key's rows are met in one task, as they must be to be counted, but not held in memory: a key's state is
    read row by row, and its own rate bounds what leaves. A null ``by`` is a key.
    """
    rows = stream.withWatermark(ts_col, late) if late else stream
    fields = T.StructType(list(stream.schema.fields))
    keyed = rows.select(
        F.col(by).cast("string").alias("by"), *([F.col(ts_col)] if late else []), F.coalesce(_millis(F.col(ts_col)), F.lit(0)).alias("millis"),
        (F.col(order) if order else F.lit(0)).alias("place"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in stream.columns])).alias("payload"),
    )
    left = keyed.groupBy("by").transformWithStateInPandas(
        statefulProcessor=_Bucket(most, seconds, bool(late)), outputStructType="by string, release long, payload string", outputMode="Append",
        timeMode="EventTime" if late else "ProcessingTime",
    )
    return left.select(F.from_json("payload", fields).alias("row"), "release").select("row.*", "release")


ACTIONS = ("label", "skip", "back")


def replayed(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, position, label): what labelling sessions came to, from the log of their actions.

    ``actions`` has session, seq, action and label; ``sessions`` session and total, the number of its pairs. A label goes to the pair
    at hand and moves on; 'skip' is the label of a skipped pair; 'back' takes the last one back. Behind the last
    pair nothing is labelled, and before the first there is no way back. Other actions and null sessions don't count. A session's actions are one
    person's, so they are folded in one row. Positions are from 0.
    """
    steps = actions.where(F.col("action").isin(*ACTIONS) & F.col("session").isNotNull())
    label = F.when(F.col("action") == "label", F.coalesce("label", F.lit(""))).when(F.col("action") == "skip", "skip")
    logs = steps.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", label.alias("label")))).alias("log"))
    undo = lambda held: F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))
    folded = F.aggregate(
        "log", F.expr("cast(array() as array<string>)"),
        lambda held, s: F.when(s["label"].isNull(), undo(held)).when(F.size(held) < F.col("total"), F.array_append(held, s["label"])).otherwise(held),
    )
    done = logs.join(sessions.select("session", "total"), "session").select("session", folded.alias("labels"))
    return done.select("session", F.posexplode("labels").alias("position", "label"))


class _Session(StatefulProcessor):
    """One session's labels by position, and the position at hand."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "position long, skipped long")
        self.labels = handle.getMapState("labels", "position long", "label string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, skipped = self.at.get() if self.at.exists() else (0, 0)
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for action, label, total in zip(batch["action"], batch["label"], batch["total"]):
            if action == "back":
                if at > 0:
                    at -= 1
                    skipped -= self.labels.getValue((at,))[0] == "skip"
                    self.labels.removeKey((at,))
            elif at < total:
                label = "skip" if action == "skip" else label or ""
                self.labels.updateValue((at,), (label,))
                skipped += label == "skip"
                at += 1
        self.at.update((at, int(skipped)))
        held = sorted((k[0], v[0]) for k, v in self.labels.iterator())
        total = int(batch["total"].iloc[-1])
        yield pd.DataFrame(
            {
                "session": [key[0]], "seq": [int(batch["seq"].iloc[-1])], "labelled": [at], "skipped": [int(skipped)], "remaining": [total - at],
                "labels": [[label for _, label in held]],
            },
            dtype=object,
        )

    def close(self) -> None:
        pass


def labelled(actions: DataFrame) -> DataFrame:
    """A stream of (session, seq, labelled, skipped, remaining, labels) after each batch that has actions of a session.

    ``actions`` is a stream of session, seq, action, label and total; semantics as in ``replayed``, in the order of ``seq`` within a batch.
    """
    known = actions.where(F.col("action").isin(*ACTIONS) & F.col("session").isNotNull())
    own = known.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), "action", "label", F.col("total").cast("long").alias("total"))
    return own.groupBy("session").transformWithStateInPandas(
        statefulProcessor=_Session(), outputStructType="session string, seq long, labelled long, skipped long, remaining long, labels array<string>",
        outputMode="Update", timeMode="None",
    )
