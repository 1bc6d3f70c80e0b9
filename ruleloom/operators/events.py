"""Events that are observed once: a firing consumes its messages.

Candidates are the set-oriented matches of the productions, found by joins. What fires is decided by arrival: an event that
completes several candidates fires the first of them (priority, definition order, newest partner), which consumes its
events and so cancels every other candidate that holds one. That is one pass over the candidates in that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ruleloom.functions.columns import Scope, condition
from ruleloom.plans.ir import Node
from ruleloom.sources.messages import Messages


def consumed_once(matches: DataFrame, facts: list[int] | None = None) -> DataFrame:
    """The candidates of an agenda that fire when messages are posted one by one: (sid, rule, mids, seqs, at, nth).

    facts: positions in `mids` of patterns whose messages are facts, which firings do not consume. Contexts are spread
    over tasks and read in order, batch by batch; a task holds the consumed identities of one context at a time.
    """
    skip = set(facts or [])
    ordered = matches.select("sid", "rule", "mids", "seqs", "at", "pri", "rule_index").repartition("sid").sortWithinPartitions("sid", "at", "pri", "rule_index", F.col("seqs").desc())
    schema = T.StructType([*ordered.select("sid", "rule", "mids", "seqs", "at").schema.fields, T.StructField("nth", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sid, used, nth = object(), set(), 0
        for b in batches:
            keep, number = [], []
            for s, mids in zip(b["sid"], b["mids"]):
                if s != sid:
                    sid, used, nth = s, set(), 0
                events = [m for k, m in enumerate(mids) if m is not None and k not in skip]
                ok = used.isdisjoint(events)
                if ok:
                    used.update(events)
                    nth += 1
                keep.append(ok)
                number.append(nth)
            out = b.loc[keep, ["sid", "rule", "mids", "seqs", "at"]]
            yield out.assign(nth=[n for n, k in zip(number, keep) if k])

    return ordered.mapInPandas(run, schema)


def lifo_pairs(messages: Messages, first: Node, second: Node, key: list[str] | None = None) -> DataFrame:
    """Consume-once pairs of two disjoint patterns, each arrival taking the newest waiting partner: (sid, a, b, seq).

    At any time only one of the patterns has messages waiting, so the pairing is that of nested brackets, and windows
    express it: with +1 and -1 as depth, partners alternate on the level between two depths. `a` and `b` are the
    identities of the messages under `first` and `second`; `seq` is the arrival that completed the pair.
    """
    scope = Scope((messages.schema, messages.getter()), {})
    a, b = condition(first, scope), condition(second, scope)
    by = ["sid", *(key or [])]
    some = messages.df.select(F.col(messages.sid).alias("sid"), F.col(messages.mid).alias("mid"), F.col(messages.seq).alias("seq"), *(key or []), a.alias("is_a"), b.alias("is_b")).where(F.col("is_a") != F.col("is_b"))
    order = Window.partitionBy(*by).orderBy("seq", "mid")
    depth = some.withColumn("depth", F.sum(F.when(F.col("is_a"), 1).otherwise(-1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    level = depth.withColumn("level", F.when(F.col("is_a"), F.col("depth") - 1).otherwise(F.col("depth")))
    on_level = Window.partitionBy(*by, "level").orderBy("seq", "mid")
    paired = level.withColumn("n", F.row_number().over(on_level)).withColumn("other", F.lead(F.struct("mid", "is_a", "seq")).over(on_level))
    paired = paired.where("n % 2 = 1 AND other IS NOT NULL")
    return paired.select(*by, F.when(F.col("is_a"), F.col("mid")).otherwise(F.col("other.mid")).alias("a"), F.when(F.col("is_a"), F.col("other.mid")).otherwise(F.col("mid")).alias("b"), F.col("other.seq").alias("seq"))
