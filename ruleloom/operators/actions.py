"""Actions in Python: functions of a match that say what should happen, run where the matches are.

An action gets a MatchContext and calls its verbs; what it asked for comes back as rows, which the caller turns into
facts, tombstones, events, state updates and timers of this or another rule set. An action that raises yields one row
with the error, so productions can look at it as data.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EFFECTS = "sid string, rule string, nth int, kind string, ruleset string, name string, payload string, error string"


class Row(dict):
    """A message or state whose properties are attributes too."""

    def __getattr__(self, name: str):
        try:
            v = self[name]
        except KeyError:
            raise AttributeError(name) from None
        return Row(v) if isinstance(v, dict) else v

    def __setattr__(self, name: str, value) -> None:
        self[name] = value


class MatchContext:
    """One match: its messages by alias (`m` for a lone one), the context's state `s`, and the verbs of an action."""

    def __init__(self, sid, rule: str, messages: dict, state: dict | None = None):
        self.sid, self.rule = sid, rule
        self.s = Row(state or {})
        self._messages = {k: [Row(x) for x in v] if isinstance(v, list) else Row(v) for k, v in messages.items() if v is not None}
        self._before = json.dumps(self.s, sort_keys=True, default=str)
        self.effects: list[tuple[str, str | None, str | None, str | None]] = []

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in self._messages:
            raise AttributeError(name)
        return self._messages[name]

    def _add(self, kind: str, args: tuple, name: str | None = None) -> None:
        ruleset, message = args if len(args) == 2 else (None, args[0] if args else None)
        self.effects.append((kind, ruleset, name, None if message is None else json.dumps(message, default=str)))

    def post(self, *args) -> None:
        """post(message) or post(ruleset, message)"""
        self._add("event", args)

    def assert_fact(self, *args) -> None:
        self._add("fact", args)

    def retract_fact(self, *args) -> None:
        self._add("retract", args)

    def start_timer(self, name: str, seconds: float, manual_reset: bool = False) -> None:
        self._add("start_timer", ({"seconds": seconds, "manual_reset": manual_reset},), name)

    def cancel_timer(self, name: str) -> None:
        self._add("cancel_timer", (), name)

    reset_timer = cancel_timer

    def delete_state(self) -> None:
        self._add("delete_state", ())

    delete = delete_state

    def finished(self) -> list[tuple[str, str | None, str | None, str | None]]:
        """All effects, with the state if the action changed it."""
        if json.dumps(self.s, sort_keys=True, default=str) != self._before:
            self._add("state", (dict(self.s),))
        return self.effects


def chained(*actions: Callable[[MatchContext], None]) -> Callable[[MatchContext], None]:
    """Actions one after the other, on one context."""

    def run(c: MatchContext) -> None:
        for a in actions:
            a(c)

    return run


def effects_of(matches: DataFrame, actions: dict[str, Callable[[MatchContext], None]], state: DataFrame | None = None) -> DataFrame:
    """What the actions of an agenda's matches ask for: one row an effect, in order within a match.

    matches: the columns of `agenda` (sid, rule, match); productions without an action are left out. state: (sid, columns) of
    the latest states. A message is what the match kept of it. Matches are independent: order them by batches.
    """
    rows = matches.where(F.col("rule").isin(*actions)).select(F.col("sid").cast("string").alias("sid"), "rule", F.to_json("match").alias("match"))
    if state is not None:
        rest = [c for c in state.columns if c != "sid"]
        rows = rows.join(state.select(F.col("sid").cast("string").alias("sid"), F.to_json(F.struct(*rest)).alias("state")), "sid", "left")
    else:
        rows = rows.withColumn("state", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sid, rule, match, s in zip(b["sid"], b["rule"], b["match"], b["state"]):
                c = MatchContext(sid, rule, json.loads(match), json.loads(s) if isinstance(s, str) else None)
                try:
                    actions[rule](c)
                    found = c.finished()
                except Exception as e:  # an error is data: a state property that productions may test
                    found = [*c.effects, ("error", None, None, None)]
                    out += [(sid, rule, k, *x, f"{type(e).__name__}: {e}" if x[0] == "error" else None) for k, x in enumerate(found)]
                    continue
                out += [(sid, rule, k, *x, None) for k, x in enumerate(found)]
            frame = pd.DataFrame(out, columns=["sid", "rule", "nth", "kind", "ruleset", "name", "payload", "error"]).astype(object)
            yield frame.assign(nth=frame["nth"].astype("int32"))

    return rows.select("sid", "rule", "match", "state").mapInPandas(run, EFFECTS)
