"""Statecharts and flowcharts over the ordered messages of each context."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.functions.columns import Scope, condition
from ruleloom.operators.actions import effects_of
from ruleloom.operators.agenda import agenda
from ruleloom.plans.ir import Node, Rule, RuleError
from ruleloom.sources.messages import Messages


@dataclass
class Trigger:
    """A way out of a state. pri: lower first. run: an action.

    when: a condition on one message; a Rule for several patterns, `any`, `none`, timeouts, `count` and `cap`; None for a
    trigger that is taken on entry.
    """

    to: str
    when: Node | Rule | None = None
    pri: int = 0
    name: str | None = None
    run: Callable | None = None


@dataclass
class Chart:
    """States with their triggers. Names of nested states are `parent.child`; a parent's triggers hold in its leaves."""

    name: str
    states: dict[str, list[Trigger]] = field(default_factory=dict)

    def state(self, name: str, *triggers: Trigger) -> "Chart":
        if name in self.states:
            raise RuleError(f"{self.name}: state {name} is defined twice")
        self.states[name] = list(triggers)
        return self

    def leaves(self) -> dict[str, list[Trigger]]:
        """Leaf states with their own and inherited triggers, by priority; a trigger to a parent enters its first leaf."""
        parents = {s.rsplit(".", 1)[0] for s in self.states if "." in s}
        leaf = lambda s: s if s not in parents else leaf(next(x for x in self.states if x.rpartition(".")[0] == s))
        out = {}
        for s in self.states:
            if s in parents:
                continue
            chain, up = [], s
            while up:
                chain += self.states.get(up, [])
                up = up.rpartition(".")[0]
            for t in chain:
                if t.to not in self.states:
                    raise RuleError(f"{self.name}: no state {t.to}")
            out[s] = sorted((Trigger(leaf(t.to), t.when, t.pri, t.name or f"{s}->{t.to}", t.run) for t in chain), key=lambda t: t.pri)
        return out

    def initial(self) -> str:
        """The one state that no other leads to."""
        leaves = self.leaves()
        reached = {t.to for s, ts in leaves.items() for t in ts if t.to != s}
        starts = [s for s in leaves if s not in reached and (s.rpartition(".")[0] == "" or s == next(iter(leaves)))]
        if len(starts) != 1:
            raise RuleError(f"{self.name}: {len(starts)} initial states")
        return starts[0]


def candidates(messages: Messages, wanted: list[Node | Rule], state: Messages | None = None) -> DataFrame:
    """What may take a chart on: (sid, at, mid, mids, hits) in which hits are the places in `wanted` that it fulfils.

    One pass over the messages for all conditions; the matches of a Rule come from its joins, with the arrival and the
    message that complete them.
    """
    scope = Scope((messages.schema, messages.getter()), {})
    hits = [F.when(condition(x, scope), F.lit(k)) for k, x in enumerate(wanted) if not isinstance(x, Rule)]
    mid, kind = F.col(messages.mid), messages.df.schema[messages.mid].dataType
    parts = [messages.df.select(F.col(messages.sid).alias("sid"), F.col(messages.seq).cast("long").alias("at"), mid.alias("mid"), F.array(mid.cast("string")).alias("mids"), (F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")).alias("hits"))]
    for k, x in enumerate(wanted):
        if isinstance(x, Rule):
            found = agenda([x], messages, state)
            last = F.element_at("mids", F.array_position("seqs", F.col("at")).cast("int")).cast(kind)
            parts.append(found.select("sid", "at", last.alias("mid"), F.array_compact("mids").alias("mids"), F.array(F.lit(k)).alias("hits")))
    return reduce(DataFrame.unionByName, parts).where(F.size("hits") > 0)


class Fold:
    """The state of one context, and what waits for a trigger: a stack for each, only of what a reachable state takes."""

    def __init__(self, table: dict[str, list[tuple]], start: str, several: bool):
        self.table, self.state, self.nth, self.several = table, start, 0, several
        self.waiting: dict[int, list] = {}
        self.used: set[str] = set()

    def alive(self, entry: list) -> bool:
        return entry[0] and not (self.several and not self.used.isdisjoint(entry[3]))

    def take(self, k: int, count: int | None, cap: int | None) -> list | None:
        """The newest waiting entry; for count the oldest so many, or none if there are fewer; for cap the oldest up to so many."""
        stack = self.waiting.get(k)
        while stack and not self.alive(stack[-1]):
            stack.pop()
        if not stack:
            return None
        if count is None and cap is None:
            chosen = [stack.pop()]
        else:
            stack[:] = [e for e in stack if self.alive(e)]
            n = count or cap
            if count and len(stack) < n:
                return None
            chosen, stack[:] = stack[:n], stack[n:]
        for e in chosen:
            e[0] = False
            if self.several:
                self.used.update(e[3])
        return chosen

    def settle(self) -> Iterator[tuple]:
        """Transitions on entry and by what waits, until none moves the context on."""
        idle = 0
        while idle <= len(self.table):  # a circle of triggers on entry ends
            for k, to, name, count, cap, reach in self.table[self.state]:
                if k is None:
                    if to == self.state:
                        continue
                    idle += 1
                    found = (None, None, None)
                else:
                    taken = self.take(k, count, cap)
                    if taken is None:
                        continue
                    idle = 0
                    found = (taken[-1][1], taken[-1][2], [x for e in taken for x in e[3]])
                self.nth += 1
                yield (self.nth, self.state, to, name, *found)
                self.state = to
                for gone in [x for x in self.waiting if x not in reach]:
                    del self.waiting[gone]
                break
            else:
                return


def run_chart(messages: Messages, chart: Chart, pending: bool = True, state: Messages | None = None) -> DataFrame:
    """Transitions of each context: (sid, nth, from_state, to_state, trigger, mid, seq, mids).

    mid and seq are of the message that completed the trigger (NULL for those on entry), mids of all that it took.
    Conditions are evaluated by Spark as columns, and triggers of several patterns by joins; what may take a context on is
    then read in order, batch by batch, with its state at hand. pending: what no trigger of the current state takes waits,
    and the newest that waits may be taken when its state is reached; else it is dropped, but for what a `count` of the
    current state gathers. A message is taken once. A reflexive trigger stays in its state and fires each time.
    """
    leaves, start = chart.leaves(), chart.initial()
    wanted: list[Node | Rule] = []
    for ts in leaves.values():
        for t in ts:
            if t.when is not None and not any(t.when is x for x in wanted):
                wanted.append(t.when)
    place = lambda w: next((k for k, x in enumerate(wanted) if x is w), None)
    reach = {s: {place(t.when) for t in ts if t.when is not None} for s, ts in leaves.items()}
    while any(not reach[t.to] <= reach[s] for s, ts in leaves.items() for t in ts):
        for s, ts in leaves.items():
            reach[s] = reach[s].union(*(reach[t.to] for t in ts))
    setting = lambda t, name: getattr(t.when, name) if isinstance(t.when, Rule) else None
    table = {s: [(place(t.when), t.to, t.name, setting(t, "count"), setting(t, "cap"), reach[t.to]) for t in ts] for s, ts in leaves.items()}
    several = any(isinstance(x, Rule) for x in wanted)
    read = candidates(messages, wanted, state)
    ordered = read.repartition("sid").sortWithinPartitions("sid", "at", F.col("mids").desc())
    kinds = {f.name: f.dataType for f in read.schema}
    text = T.StringType()
    schema = T.StructType([T.StructField("sid", kinds["sid"]), T.StructField("nth", T.LongType()), *(T.StructField(c, text) for c in ("from_state", "to_state", "trigger")), T.StructField("mid", kinds["mid"]), T.StructField("seq", T.LongType()), T.StructField("mids", T.ArrayType(text))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sid, fold = object(), Fold(table, start, several)
        for b in batches:
            out: list[tuple] = []
            for s, at, mid, mids, hits in zip(b["sid"], b["at"], b["mid"], b["mids"], b["hits"]):
                if s != sid:
                    sid, fold = s, Fold(table, start, several)
                    out += [(s, *x) for x in fold.settle()]
                entry = [True, mid, at, list(mids)]
                held = [k for k in hits if k in reach[fold.state]]
                for k in held:
                    fold.waiting.setdefault(k, []).append(entry)
                if held:
                    out += [(s, *x) for x in fold.settle()]
                    if not pending:
                        counted = {k for k, _, _, n, _, _ in table[fold.state] if n}
                        for k in [k for k in fold.waiting if k not in counted]:
                            del fold.waiting[k]
            frame = pd.DataFrame(out, columns=["sid", "nth", "from_state", "to_state", "trigger", "mid", "seq", "mids"])
            for c in ("mid", "seq"):
                if isinstance(schema[c].dataType, T.IntegralType):
                    frame[c] = frame[c].astype("Int64")
            yield frame

    return ordered.mapInPandas(run, schema)


def effects_of_chart(transitions: DataFrame, messages: Messages, chart: Chart, state: DataFrame | None = None) -> DataFrame:
    """What the actions of the triggers ask for, as rows (see `effects_of`); `m` is the message that completed a trigger."""
    actions = {t.name: t.run for ts in chart.leaves().values() for t in ts if t.run is not None}
    rows = messages.df.select(F.col(messages.sid).alias("_sid"), F.col(messages.mid).alias("_mid"), F.struct("*").alias("m"))
    found = transitions.join(rows, (F.col("sid") == F.col("_sid")) & (F.col("mid") == F.col("_mid")), "left")
    return effects_of(found.select("sid", F.col("trigger").alias("rule"), F.struct("m").alias("match")), actions, state)


def current_states(transitions: DataFrame) -> DataFrame:
    """(sid, state): where each context that moved stands."""
    return transitions.groupBy("sid").agg(F.max_by("to_state", "nth").alias("state"))


def run_flow(messages: Messages, flow: Chart, pending: bool = True) -> DataFrame:
    """Stages of a flowchart as they are entered: (sid, nth, stage, mid); a stage acts on entry, the first one at once."""
    moves = run_chart(messages, flow, pending).select("sid", "nth", F.col("to_state").alias("stage"), "mid")
    begun = messages.df.select(F.col(messages.sid).alias("sid")).distinct()
    return moves.unionByName(begun.select("sid", F.lit(0).cast("long").alias("nth"), F.lit(flow.initial()).alias("stage"), F.lit(None).cast(moves.schema["mid"].dataType).alias("mid")))
