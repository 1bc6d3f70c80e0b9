"""Productions over streams: stateless filters, joins and windows with watermarks, and keyed state for what they cannot say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ruleloom.functions.columns import Scope, condition
from ruleloom.operators.flow import Chart
from ruleloom.operators.match import match
from ruleloom.plans.ir import Node, Rule, RuleError
from ruleloom.sources.messages import Messages

#: state of transformWithState needs this store
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def matches_of(rule: Rule, messages: Messages, keep: list[str] | None = None) -> DataFrame:
    """Matches of a rule with one pattern: stateless, each message is looked at once."""
    return match(rule, messages, keep=keep)


def first_observed(messages: Messages, ts: str, delay: str) -> Messages:
    """Messages without those of an identity that was observed within the delay."""
    df = messages.df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([messages.sid, messages.mid])
    return Messages(df, messages.sid, messages.mid, messages.seq, messages.body)


def sequence(first: DataFrame, second: DataFrame, sid: str, ts: str, within: str, delay: str, related: Callable[[str, str], object] | None = None) -> DataFrame:
    """Pairs of a message of each stream in one context, the second at most `within` after the first.

    Both sides have a watermark, so the join's state is bounded by `within` and `delay`. related: a further condition
    on the column prefixes of the two sides.
    """
    a = first.withWatermark(ts, delay).select(F.struct("*").alias("first"), F.col(sid).alias("sid"), F.col(ts).alias("first_ts"))
    b = second.withWatermark(ts, delay).select(F.struct("*").alias("second"), F.col(sid).alias("_sid"), F.col(ts).alias("second_ts"))
    on = (F.col("sid") == F.col("_sid")) & (F.col("second_ts") >= F.col("first_ts")) & (F.col("second_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    if related is not None:
        on = on & related("first", "second")
    return a.join(b, on).drop("_sid")


def velocity(rows: DataFrame, sid: str, ts: str, length: str, delay: str) -> DataFrame:
    """Rows of each context in tumbling windows of event time: (sid, start, n), a window once it is over."""
    return rows.withWatermark(ts, delay).groupBy(F.col(sid).alias("sid"), F.window(ts, length)).agg(F.count("*").alias("n")).select("sid", F.col("window.start").alias("start"), "n")


class Pairs(StatefulProcessor):
    """Consume-once pairing: each arrival takes the newest waiting partner, else it waits."""

    def init(self, handle) -> None:
        self.waiting = handle.getListState("waiting", "is_a boolean, mid string, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stack = [tuple(x) for x in self.waiting.get()]
        out = []
        for b in sorted((r for f in rows for r in f.itertuples(index=False)), key=lambda r: (r.seq, r.mid)):
            if stack and stack[-1][0] != b.is_a:
                other = stack.pop()
                out.append((key[0], b.mid if b.is_a else other[1], other[1] if b.is_a else b.mid, b.seq))
            else:
                stack.append((bool(b.is_a), b.mid, int(b.seq)))
        if stack:
            self.waiting.put(stack)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["sid", "a", "b", "seq"])

    def close(self) -> None:
        pass


def pairs(messages: Messages, first: Node, second: Node) -> DataFrame:
    """The pairs of two disjoint patterns as the stream brings them: (sid, a, b, seq), as lifo_pairs does in batch."""
    scope = Scope((messages.schema, messages.getter()), {})
    a, b = condition(first, scope), condition(second, scope)
    some = messages.df.select(F.col(messages.sid).cast("string").alias("sid"), F.col(messages.mid).cast("string").alias("mid"), F.col(messages.seq).cast("long").alias("seq"), a.alias("is_a"), b.alias("is_b")).where(F.col("is_a") != F.col("is_b"))
    return some.groupBy("sid").transformWithStateInPandas(statefulProcessor=Pairs(), outputStructType="sid string, a string, b string, seq long", outputMode="Append", timeMode="None")


class Charts(StatefulProcessor):
    """The state of a chart in each context; messages that no trigger takes are dropped."""

    def __init__(self, table: dict[str, list[tuple[int | None, str, str]]], start: str):
        self.table, self.start = table, start

    def init(self, handle) -> None:
        self.at = handle.getValueState("at", "state string, nth long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, nth = self.at.get() if self.at.exists() else (self.start, 0)
        out = []

        def enter(s):
            seen = set()
            while s not in seen and (to := next((t for k, t, _ in self.table[s] if k is None and t != s), None)):
                seen.add(s)
                s = to
            return s

        state = enter(state)
        for r in sorted((r for f in rows for r in f.itertuples(index=False)), key=lambda r: (r.seq, r.mid)):
            hit = next(((t, n) for k, t, n in self.table[state] if k is not None and r.bits[k]), None)
            if hit:
                nth += 1
                out.append((key[0], nth, state, hit[0], hit[1], r.mid))
                state = enter(hit[0])
        self.at.update((state, nth))
        yield pd.DataFrame(out, columns=["sid", "nth", "from_state", "to_state", "trigger", "mid"])

    def close(self) -> None:
        pass


def chart(messages: Messages, c: Chart) -> DataFrame:
    """Transitions as the stream brings them: (sid, nth, from_state, to_state, trigger, mid)."""
    leaves, conditions = c.leaves(), []
    if any(isinstance(t.when, Rule) for ts in leaves.values() for t in ts):
        raise RuleError(f"{c.name}: a stream's triggers are conditions on one message")
    for ts in leaves.values():
        conditions += [t.when for t in ts if t.when is not None and not any(t.when is x for x in conditions)]
    table = {s: [(next((k for k, x in enumerate(conditions) if x is t.when), None), t.to, t.name) for t in ts] for s, ts in leaves.items()}
    scope = Scope((messages.schema, messages.getter()), {})
    read = messages.df.select(F.col(messages.sid).cast("string").alias("sid"), F.col(messages.mid).cast("string").alias("mid"), F.col(messages.seq).cast("long").alias("seq"), F.array(*(condition(x, scope) for x in conditions)).alias("bits"))
    return read.groupBy("sid").transformWithStateInPandas(statefulProcessor=Charts(table, c.initial()), outputStructType="sid string, nth long, from_state string, to_state string, trigger string, mid string", outputMode="Append", timeMode="None")


class Timers(StatefulProcessor):
    """A timer that every `start` row (re)starts and every `cancel` row ends; it fires when the clock reaches it."""

    def __init__(self, millis: int):
        self.millis = millis

    def init(self, handle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    def _stop(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for r in sorted((r for f in rows for r in f.itertuples(index=False)), key=lambda r: r.seq):
            self._stop()
            if r.kind == "start":
                at = timerValues.getCurrentProcessingTimeInMs() + self.millis
                self.handle.registerTimer(at)
                self.due.update((at,))
        yield pd.DataFrame({"sid": pd.Series([], dtype=object), "base_time": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.due.clear()
        yield pd.DataFrame({"sid": pd.Series([key[0]], dtype=object), "base_time": [at]})

    def close(self) -> None:
        pass


def timers(rows: DataFrame, seconds: float) -> DataFrame:
    """Timers by processing time over rows (sid, kind: start or cancel, seq): (sid, base_time in ms) when one fires."""
    return rows.select(F.col("sid").cast("string").alias("sid"), "kind", F.col("seq").cast("long").alias("seq")).groupBy("sid").transformWithStateInPandas(statefulProcessor=Timers(int(seconds * 1000)), outputStructType="sid string, base_time long", outputMode="Append", timeMode="ProcessingTime")


def deliver(matches: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs an action on each micro-batch of matches, at least once; a failed batch is delivered again."""
    return matches.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
