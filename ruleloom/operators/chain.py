"""Forward chaining: matches assert or retract facts, until nothing more follows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.columns import Scope, condition, operand
from ruleloom.operators.agenda import agenda, first_to_fire
from ruleloom.operators.match import Matcher, flat, positive, split
from ruleloom.plans.ir import Prop, Rule, RuleError, Value, constant, patterns, values
from ruleloom.sources.messages import Messages, retracted
from ruleloom.sources.store import written


#: Rounds whose tables are read one by one before they are written as one.
TABLES_READ = 32


@dataclass(frozen=True)
class Assert:
    """A fact that a match asserts: values by property, which may refer to the match's messages."""

    values: dict[str, object]


@dataclass(frozen=True)
class Retract:
    """The message under this alias is retracted."""

    alias: str


Effect = Assert | Retract


def asserts(**values: object) -> Assert:
    return Assert(values)


def facts_of(rule: Rule, effects: list[Effect], matches: DataFrame, facts: Messages, name: Callable[[str], str] = flat) -> DataFrame | None:
    """The facts that the matches assert, with the columns of `facts`; their identity is a digest of what they say."""
    types = {f.name: f.dataType for f in facts.df.schema}
    if types[facts.mid].typeName() != "string" and any(isinstance(e, Assert) for e in effects):
        raise RuleError(f"{rule.name}: derived facts are told apart by a digest, so {facts.mid} must be a string")
    scope = Scope((None, lambda n: F.lit(None)), {p.alias: (facts.schema, facts.getter(f"{name(p.alias)}.")) for p in positive(rule)})
    out = []
    for e in effects:
        if not isinstance(e, Assert):
            continue
        said: dict[str, Column] = {k: operand(v if isinstance(v, Value) else constant(v), scope).col for k, v in e.values.items()}
        cols = {c: (F.col("sid") if c == facts.sid else said.get(c, F.lit(None))).cast(t) for c, t in types.items() if c not in (facts.mid, facts.seq)}
        row = matches.select(*(v.alias(k) for k, v in cols.items()))
        mid = F.concat(F.lit("$"), F.sha2(F.to_json(F.struct(*cols)), 256))
        out.append(row.withColumn(facts.mid, mid).withColumn(facts.seq, F.lit(None).cast(types[facts.seq])).select(*types))
    return reduce(DataFrame.unionByName, out).dropDuplicates([facts.sid, facts.mid]) if out else None


def referred(effects: list[Effect]) -> list[str]:
    """Columns that the asserted values take from the match's messages."""
    said = [v for e in effects if isinstance(e, Assert) for x in e.values.values() if isinstance(x, Value) for v in values(x)]
    return sorted({v.name.split(".")[0] for v in said if isinstance(v, Prop)})


def closure(facts: Messages, program: list[tuple[Rule, list[Effect]]], most: int | None = None) -> Messages:
    """All facts that follow: rounds in which at least one pattern of a match takes a fact of the round before.

    For programs that only assert. A `none` sees the facts so far, so its productions belong in a later call than the ones
    that assert what it excludes. Each round's new facts are written, most: rounds after which it raises (by default none); `seq` of a derived fact is its round.
    """
    if any(isinstance(e, Retract) for _, effects in program for e in effects):
        raise ValueError("a program that retracts fires one match at a time: see fire()")
    base = written(facts.df.withColumn(facts.mid, F.col(facts.mid)), "facts")
    seq_type = base.schema[facts.seq].dataType
    before, delta = None, base
    for n in count(1):
        if most is not None and n > most:
            raise RuntimeError(f"facts still follow after {most} rounds")
        every = delta if before is None else before.unionByName(delta)
        found = []
        for rule, effects in program:
            slots = list(positive(rule))
            for k, slot in enumerate(slots):
                if before is None and k:
                    break  # in the first round all facts are new

                def source(p, k=k, slots=slots):
                    at = next((i for i, q in enumerate(slots) if q is p), None)
                    df = every if at is None or before is None or at > k else delta if at == k else before
                    return replace(facts, df=df)

                matches = Matcher(rule, source, keep=referred(effects)).matches()
                new = facts_of(rule, effects, matches, facts)
                if new is not None:
                    found.append(new)
        if not found:
            return replace(facts, df=every)
        new = reduce(DataFrame.unionByName, found).dropDuplicates([facts.sid, facts.mid])
        known = every.select(F.col(facts.sid).alias("_sid"), F.col(facts.mid).alias("_mid"))
        new = new.join(known, (F.col(facts.sid) == F.col("_sid")) & (F.col(facts.mid) == F.col("_mid")), "left_anti").withColumn(facts.seq, F.lit(n).cast(seq_type))
        delta = written(new.select(*base.columns), "delta")
        before = every
        if delta.isEmpty():
            return replace(facts, df=before)


def fire(facts: Messages, program: list[tuple[Rule, list[Effect]]], most: int | None = None) -> tuple[Messages, DataFrame]:
    """Facts and firings (sid, rule, mids, nth) when each context fires one match at a time, by priority and recency.

    Effects show before the next pick, and a match fires once. Every step is one round for all contexts together, so
    the rounds follow the longest chain of firings of one context. A context in which nothing fires is done, for its facts
    change no more: a round reads and writes the facts of the contexts that fired in the round before, and of the first
    facts only those that some pattern could take.
    """
    productions = [r for r, _ in program]
    base = written(facts.df, "facts")
    top = base.agg(F.max(facts.seq).alias("n")).first()["n"] or 0
    idle = F.lit(False) if facts.body else ~usable(productions, facts)
    now, idle = base.where(~idle), base.where(idle)
    done: list[DataFrame] = []
    fired: list[DataFrame] = []
    lost: list[DataFrame] = []
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    for n in count(1):
        if most is not None and n > most:
            raise RuntimeError(f"matches still fire after {most} rounds")
        here = replace(facts, df=now)
        wide = [c for c in now.columns if c not in (facts.sid, facts.mid, facts.seq)]
        waiting = agenda(productions, here, keep=wide, deal=False)
        if fired:
            before = reduce(DataFrame.unionByName, fired).select(F.col("sid").alias("_sid"), F.col("rule").alias("_rule"), F.col("mids").alias("_mids"))
            waiting = waiting.join(before, same("sid", "_sid") & (F.col("rule") == F.col("_rule")) & same("mids", "_mids"), "left_anti")
        picked = written(first_to_fire(waiting).withColumn("nth", F.lit(n)), "picked")
        if picked.isEmpty():
            if lost:  # an identity may also be that of facts which no pattern takes
                idle = retracted(replace(facts, df=idle), reduce(DataFrame.unionByName, lost)).df
            return replace(facts, df=reduce(DataFrame.unionByName, [idle, *done, now])), reduce(DataFrame.unionByName, fired) if fired else picked.select("sid", "rule", "mids", "nth")
        fired.append(picked.select("sid", "rule", "mids", "nth"))
        going = picked.select(F.col("sid").alias("_sid"))
        done.append(now.join(going, same(facts.sid, "_sid"), "left_anti"))
        now = now.join(going, same(facts.sid, "_sid"), "left_semi")
        new, gone = [], []
        for rule, effects in program:
            mine = picked.where(F.col("rule") == rule.name).select("sid", "match.*")
            got = facts_of(rule, effects, mine, facts)
            if got is not None:
                new.append(got)
            gone += [mine.select(F.col("sid").alias(facts.sid), F.col(f"{flat(e.alias)}.{facts.mid}").alias(facts.mid)) for e in effects if isinstance(e, Retract)]
        if gone:
            lost.append(reduce(DataFrame.unionByName, gone))
            now = retracted(replace(facts, df=now), lost[-1]).df
        if new:
            more = reduce(DataFrame.unionByName, new).dropDuplicates([facts.sid, facts.mid]).withColumn(facts.seq, F.lit(top + n).cast(now.schema[facts.seq].dataType))
            known = now.where(F.col(facts.mid).startswith("$")).select(F.col(facts.sid).alias("_sid"), F.col(facts.mid).alias("_mid"))  # derived facts are named so
            now = now.unionByName(more.join(known, same(facts.sid, "_sid") & same(facts.mid, "_mid"), "left_anti"))
        now = written(now, "facts")
        if len(done) > TABLES_READ:
            done = [written(reduce(DataFrame.unionByName, done), "done")]
        if len(fired) > TABLES_READ:
            fired = [written(reduce(DataFrame.unionByName, fired), "fired")]
        if len(lost) > TABLES_READ:
            lost = [written(reduce(DataFrame.unionByName, lost), "lost")]


def usable(productions: list[Rule], facts: Messages) -> Column:
    """Whether a fact fulfils what some pattern asks of it alone, or bears a name like that of a derived fact, which it would be."""
    scope = Scope((facts.schema, facts.getter()), {})
    alone = [reduce(lambda a, b: a & b, (condition(n, scope) for n in split(p.condition)[0]), F.lit(True)) for r in productions for p in patterns(r.when) if not p.on_state]
    return F.coalesce(reduce(lambda a, b: a | b, alone), F.lit(False)) | F.coalesce(F.col(facts.mid).cast("string").startswith("$"), F.lit(False))
