"""The whole firing loop: facts, events, states and timers, with actions in Python whose effects the next pick sees.

In each round every context fires the first match of its agenda. The actions of all picked matches run as one Spark job
and their effects are applied by joins: events that fired are consumed, messages asserted, posted or retracted, states
replaced or deleted, timers started or cancelled. A context with nothing to fire moves its clock to its next timer.
Messages for other rule sets are kept, and `run_all` feeds them on.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.operators.actions import effects_of
from ruleloom.operators.agenda import agenda, first_to_fire
from ruleloom.plans.dsl import RuleSet
from ruleloom.plans.ir import Rule
from ruleloom.sources.messages import Messages
from ruleloom.sources.store import drop, written

#: columns that timers and the clock use, and the one that says that a message is an event
TIMER = {"timer_name": T.StringType(), "base_time": T.LongType(), "time": T.LongType()}
EVENT = "is_event"
CLOCK = "$pulse"


@dataclass
class Outcome:
    """What a loop leaves: its messages and states, what fired (sid, rule, mids, nth), what it posted elsewhere."""

    messages: Messages
    state: Messages | None
    fired: DataFrame
    posted: DataFrame


def same(a: str, b: str = "_sid") -> Column:
    return F.col(a) == F.col(b)


class Loop:
    def __init__(self, productions: RuleSet | list[Rule], messages: Messages, state: Messages | None = None, until: int | None = None):
        self.productions, self.until = list(productions), until
        self.actions = {r.name: r.run for r in self.productions if callable(r.run)}
        df = messages.df
        for name, kind in {**TIMER, EVENT: T.BooleanType()}.items():
            if name not in df.columns:
                df = df.withColumn(name, F.lit(False if name == EVENT else None).cast(kind))
        self.at, self.types = replace(messages, df=df), {f.name: f.dataType for f in df.schema}
        self.state_at = state
        self.now = written(df, "messages")
        self.state = None if state is None else written(state.df, "states")
        self.top = self.now.agg(F.max(messages.seq).alias("n")).first()["n"] or 0
        self.log: DataFrame | None = None
        self.elsewhere: list[DataFrame] = []
        self.events = not self.now.where(EVENT).isEmpty()
        self.timed = not self.now.where("base_time IS NOT NULL").isEmpty()

    def here(self) -> tuple[Messages, Messages | None]:
        return replace(self.at, df=self.now), None if self.state is None else replace(self.state_at, df=self.state)

    def waiting(self) -> DataFrame:
        messages, state = self.here()
        wide = [c for c in self.now.columns if c not in (messages.sid, messages.mid, messages.seq)]
        out = agenda(self.productions, messages, state, keep=wide, deal=False)
        if self.log is None:
            return out
        done = self.log.select(F.col("sid").alias("_sid"), F.col("rule").alias("_rule"), F.col("mids").alias("_mids"))
        return out.join(done, same("sid") & same("rule", "_rule") & F.col("mids").eqNullSafe(F.col("_mids")), "left_anti")

    def step(self, n: int) -> bool:
        """One round; False if no context fired and no clock moved."""
        picked = written(first_to_fire(self.waiting()).withColumn("nth", F.lit(n)), "picked")
        moved = self.clocks(picked)
        if picked.isEmpty():
            if moved is None:
                return False
            self.keep(messages=moved)
            return True
        self.timed = self.timed or moved is not None
        state = None if self.state is None else self.state.withColumnRenamed(self.state_at.sid, "sid")
        asked = written(effects_of(picked, self.actions, state).withColumn("sid", F.col("sid").cast(self.types[self.at.sid])), "effects")
        log = picked.select("sid", "rule", "mids", "nth")
        # what the round asks for at all: a row a kind
        kinds = {(r["kind"], r["away"]) for r in asked.select("kind", F.col("ruleset").isNotNull().alias("away")).distinct().collect()}
        self.timed = self.timed or ("start_timer", False) in kinds
        messages = self.applied(self.now if moved is None else moved, picked, asked, n, {k for k, away in kinds if not away})
        states = self.states(asked, n) if {k for k, away in kinds if not away} & {"state", "error", "delete_state"} else None
        old = self.log
        self.log = log if old is None else old.unionByName(log)
        if n % 16 == 0:
            self.log = written(self.log, "fired")
        if any(away for _, away in kinds):
            self.elsewhere.append(asked.where("ruleset IS NOT NULL").select("ruleset", "sid", "kind", "payload"))
        self.keep(None if messages is self.now else messages, states)
        return True

    def keep(self, messages: DataFrame | None = None, states: DataFrame | None = None) -> None:
        if messages is not None:
            old, self.now = self.now, written(messages, "messages")
            drop(old)
        if states is not None:
            old, self.state = self.state, written(states, "states")
            drop(old)

    def clock_rows(self, of: DataFrame) -> DataFrame:
        """Clock messages from (sid, time)."""
        made = {self.at.sid: F.col("sid"), self.at.mid: F.concat(F.lit(f"{CLOCK}-"), "time"), self.at.seq: F.lit(self.top), "time": F.col("time"), EVENT: F.lit(False)}
        return of.select(*(made.get(c, F.lit(None)).cast(t).alias(c) for c, t in self.types.items()))

    def clocks(self, picked: DataFrame) -> DataFrame | None:
        """Messages in which the contexts that fire nothing have moved on to their next timer, if there is one."""
        if self.until is None or not self.timed:
            return None
        sid, mid = self.at.sid, self.at.mid
        was = self.now.groupBy(F.col(sid).alias("_sid")).agg(F.max(F.when(F.col(mid).startswith(CLOCK), F.col("time"))).alias("was"))
        due = self.now.join(was, same(sid)).where(F.col("base_time") > F.coalesce("was", F.lit(-(1 << 62)))).groupBy(F.col(sid).alias("sid")).agg(F.min("base_time").alias("time"))
        due = due.where(F.col("time") <= self.until).join(picked.select(F.col("sid").alias("_sid")), same("sid"), "left_anti")
        due = written(due, "clocks")
        if due.isEmpty():
            return None
        rest = self.now.join(due.select(F.col("sid").alias("_sid")), same(sid) & (F.col(mid).startswith(CLOCK)), "left_anti")
        return rest.unionByName(self.clock_rows(due))

    def applied(self, now: DataFrame, picked: DataFrame, asked: DataFrame, n: int, kinds: set[str]) -> DataFrame:
        """Messages after a round: what fired is consumed, what the actions retracted or cancelled goes, what they said comes."""
        sid, mid, seq = self.at.sid, self.at.mid, self.at.seq
        own = asked.where("ruleset IS NULL")
        get = lambda x: F.get_json_object("payload", f"$.{x}")
        if self.events or self.timed:
            used = picked.select(F.col("sid").alias("_sid"), F.explode("mids").alias("_mid"))
            now = now.join(used, same(sid) & (F.col(mid).cast("string") == F.col("_mid")) & F.col(EVENT), "left_anti")
        self.events = self.events or "event" in kinds
        gone = own.where("kind = 'retract'").select(F.col("sid").alias("_sid"), F.coalesce(get("id"), get(mid)).alias("_mid"))
        if "retract" in kinds:
            now = now.join(gone, same(sid) & (F.col(mid).cast("string") == F.col("_mid")), "left_anti")
        # a timer that starts again replaces the one of its name
        ended = own.where("kind IN ('start_timer', 'cancel_timer')").select(F.col("sid").alias("_sid"), F.col("name").alias("_name"))
        if kinds & {"start_timer", "cancel_timer"}:
            now = now.join(ended, same(sid) & (F.col("timer_name") == F.col("_name")), "left_anti")
        if "delete_state" in kinds:
            now = now.join(own.where("kind = 'delete_state'").select(F.col("sid").alias("_sid")), same(sid), "left_anti")
        if not kinds & {"fact", "event", "start_timer"}:
            return now
        # new messages; their identity is their id, or else a digest of what they say
        schema = T.StructType([T.StructField(c, t) for c, t in self.types.items() if c not in (sid, EVENT)])
        said = own.where("kind IN ('fact', 'event')").withColumn("_m", F.from_json("payload", schema))
        ident = F.coalesce(F.col(f"_m.{mid}").cast("string"), get("id"), F.concat(F.lit("$"), F.sha2("payload", 256), F.when(F.col("kind") == "event", F.concat(F.lit("-"), F.lit(n), F.lit("-"), F.col("nth"))).otherwise("")))
        made = {sid: F.col("sid"), mid: ident, seq: F.lit(self.top + n), EVENT: F.col("kind") == "event"}
        new = said.select(*(made.get(c, F.col(f"_m.{c}") if c in schema.names else None).cast(t).alias(c) for c, t in self.types.items()))
        clock = now.where(F.col(mid).startswith(CLOCK)).select(F.col(sid).alias("_sid"), F.col("time").alias("_now"))
        last = own.where("kind = 'start_timer'").groupBy("sid", "name").agg(F.max_by("payload", "nth").alias("payload"))
        timers = last.join(clock, same("sid"), "left")
        made = {sid: F.col("sid"), mid: F.concat(F.lit("$timer-"), F.col("name"), F.lit(f"-{n}")), seq: F.lit(self.top + n), "timer_name": F.col("name"), "base_time": F.coalesce("_now", F.lit(0)) + get("seconds").cast("double").cast("long"), EVENT: ~F.coalesce(get("manual_reset").cast("boolean"), F.lit(False))}
        started = timers.select(*(made.get(c, F.lit(None)).cast(t).alias(c) for c, t in self.types.items()))
        parts = ([new] if kinds & {"fact", "event"} else []) + ([started] if "start_timer" in kinds else [])
        more = reduce(DataFrame.unionByName, parts).dropDuplicates([sid, mid])
        known = now.select(F.col(sid).alias("_sid"), F.col(mid).alias("_mid"))
        return now.unionByName(more.join(known, same(sid) & same(mid, "_mid"), "left_anti"))

    def states(self, asked: DataFrame, n: int) -> DataFrame | None:
        """States after a round: those that actions changed have a new identity, so that conditions on them hold anew."""
        if self.state is None:
            return None
        at = self.state_at
        types = {f.name: f.dataType for f in self.state.schema}
        own = asked.where("ruleset IS NULL")
        told = own.groupBy("sid").agg(
            F.max_by(F.when(F.col("kind") == "state", F.col("payload")), F.when(F.col("kind") == "state", F.col("nth"))).alias("payload"), F.max("error").alias("error"), F.max(F.col("kind") == "delete_state").alias("deleted")
        )
        told = told.where("payload IS NOT NULL OR error IS NOT NULL OR deleted")
        said = F.from_json("payload", T.StructType([T.StructField(c, t) for c, t in types.items() if c != at.sid]))
        both = told.join(self.state.withColumnRenamed(at.sid, "_sid"), same("sid"), "left").where("NOT deleted").withColumn("_m", said)
        made = {at.sid: F.col("sid"), at.mid: F.concat(F.lit("sid-"), F.col("sid").cast("string"), F.lit(f"-{n}")), at.seq: F.lit(self.top + n)}
        value = lambda c: F.when(F.col("payload").isNotNull(), F.col(f"_m.{c}")).otherwise(F.col(c))
        if "exception" in types:
            made["exception"] = F.coalesce(F.col("error"), value("exception"))
        new = both.select(*(made.get(c, value(c) if c not in made else None).cast(t).alias(c) for c, t in types.items()))
        return self.state.join(told.select(F.col("sid").alias("_sid")), same(at.sid), "left_anti").unionByName(new)


def run(productions: RuleSet | list[Rule], messages: Messages, state: Messages | None = None, until: int | None = None, most: int | None = None) -> Outcome:
    """Fires until nothing is left to fire and no timer is due by `until` (in the unit of `seconds`, from 0).

    Messages with a true `is_event` are consumed by the match that fires with them, others are facts. state: one row a
    context, whose columns actions read and set as `c.s`; with a column `exception` it takes the error of an action that
    raised. Identities must be strings. most: rounds after which an unfinished loop raises; by default it goes on, since
    a program may well be endless by intent.
    """
    loop, n = Loop(productions, messages, state, until), 1
    while loop.step(n):
        n += 1
        if most is not None and n > most:
            raise RuntimeError(f"matches still fire after {most} rounds")
    out, states = loop.here()
    spark = messages.df.sparkSession
    empty = spark.createDataFrame([], T.StructType([T.StructField("sid", loop.types[messages.sid]), *T.StructType.fromDDL("rule string, mids array<string>, nth int").fields]))
    posted = reduce(DataFrame.unionByName, loop.elsewhere) if loop.elsewhere else spark.createDataFrame([], T.StructType([T.StructField("ruleset", T.StringType()), T.StructField("sid", loop.types[messages.sid]), *T.StructType.fromDDL("kind string, payload string").fields]))
    return Outcome(out, states, loop.log if loop.log is not None else empty, posted)


def run_all(programs: dict[str, RuleSet | list[Rule]], messages: dict[str, Messages], state: dict[str, Messages] | None = None, until: int | None = None) -> dict[str, list[Outcome]]:
    """Several rule sets: what one posts to another is an input of the other's next run, until nothing is posted."""
    state, waiting = dict(state or {}), dict(messages)
    memory: dict[str, Messages] = {}
    out: dict[str, list[Outcome]] = {name: [] for name in programs}
    while waiting:
        name = next(iter(waiting))
        more = waiting.pop(name)
        before = memory.get(name)
        came = more if before is None else replace(before, df=before.df.unionByName(more.df, allowMissingColumns=True))
        done = run(programs[name], came, state.get(name), until)
        out[name].append(done)
        memory[name] = done.messages
        if done.state is not None:
            state[name] = done.state
        for other in [r["ruleset"] for r in done.posted.select("ruleset").distinct().collect()]:  # a row a rule set
            like = waiting.get(other) or memory.get(other) or messages[other]
            sent = arrivals(done.posted.where(F.col("ruleset") == other), like)
            waiting[other] = sent if other not in waiting else replace(waiting[other], df=waiting[other].df.unionByName(sent.df, allowMissingColumns=True))
    return out


def arrivals(posted: DataFrame, like: Messages) -> Messages:
    """Posted messages with the columns of the rule set that they are for."""
    types = {f.name: f.dataType for f in like.df.schema}
    schema = T.StructType([T.StructField(c, t) for c, t in types.items() if c != like.sid])
    rows = posted.where("kind IN ('fact', 'event')").withColumn("_m", F.from_json("payload", schema))
    made = {like.sid: F.col("sid"), like.mid: F.coalesce(F.col(f"_m.{like.mid}").cast("string"), F.concat(F.lit("$"), F.sha2("payload", 256))), EVENT: F.col("kind") == "event"}
    types[EVENT] = T.BooleanType()
    df = rows.select(*(made.get(c, F.col(f"_m.{c}") if c in schema.names else None).cast(t).alias(c) for c, t in types.items()))
    return replace(like, df=written(df.withColumn(like.seq, F.coalesce(like.seq, F.lit(0)).cast(types[like.seq])), "arrivals"))
