"""Messages: rows with a context id, an identity and an order, over typed columns or one VARIANT column.

Facts stay until they are retracted, events are observed once, and a context's state is its latest row. All of them are
DataFrames; nothing is kept between queries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Messages:
    """df with the columns that hold the context id (sid), the identity (mid) and the order of arrival (seq).

    body: the VARIANT column that holds the properties; None if they are the typed columns themselves.
    """

    df: DataFrame
    sid: str = "sid"
    mid: str = "mid"
    seq: str = "seq"
    body: str | None = None

    @property
    def schema(self) -> T.StructType | None:
        return None if self.body else self.df.schema

    def getter(self, prefix: str = "") -> Callable[[str], Column]:
        if self.body:
            return lambda name: F.try_variant_get(F.col(f"{prefix}{self.body}"), f"$.{name}", "variant")
        return lambda name: F.col(f"{prefix}{name}")

    def where(self, condition: Column | str) -> "Messages":
        return replace(self, df=self.df.where(condition))


def from_json(df: DataFrame, text: str, seq: str) -> Messages:
    """Messages from JSON texts: sid defaults to "0"; texts that are no JSON objects are left out.

    The id defaults to a 256-bit digest of the properties in order of their names, so equal ids are equal properties.
    """
    body = F.try_parse_json(F.col(text))
    get = lambda name: F.try_variant_get(F.col("body"), f"$.{name}", "string")
    out = df.select(F.col(seq).alias("seq"), body.alias("body")).where(F.schema_of_variant("body").startswith("OBJECT"))
    bare = F.map_filter(F.try_variant_get("body", "$", "map<string,variant>"), lambda name, _: name != "id")  # a null id is none
    said = F.transform(F.array_sort(F.map_keys(bare)), lambda name: F.struct(name.alias("name"), F.to_json(bare[name]).alias("value")))
    return Messages(out.select(F.coalesce(get("sid"), F.lit("0")).alias("sid"), F.coalesce(get("id"), F.concat(F.lit("$"), F.sha2(F.to_json(said), 256))).alias("mid"), "seq", "body"), body="body")


def observed(messages: Messages) -> tuple[Messages, DataFrame]:
    """The first message of each identity in its context, and the later ones, which count as observed already."""
    df = messages.df
    order = F.struct(messages.seq, F.to_json(F.struct(*df.columns)))  # ties are told apart by what they say
    first = df.groupBy(messages.sid, messages.mid).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")  # partial results, no sort
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(messages.sid, messages.mid).orderBy(order)))
    return replace(messages, df=first), ranked.where("_rank > 1").drop("_rank")


def retracted(facts: Messages, tombstones: DataFrame) -> Messages:
    """Facts without those that a tombstone of the same context and identity deletes; unknown ones change nothing."""
    keys = tombstones.select(F.col(facts.sid).alias("_sid"), F.col(facts.mid).alias("_mid")).distinct()
    return replace(facts, df=facts.df.join(keys, (F.col(facts.sid) == F.col("_sid")) & (F.col(facts.mid) == F.col("_mid")), "left_anti"))


def latest_state(updates: Messages) -> Messages:
    """The state of each context: its latest row, by order and then identity. One aggregation, no window over history."""
    df = updates.df
    newest = df.groupBy(updates.sid).agg(F.max_by(F.struct(*df.columns), F.struct(updates.seq, updates.mid)).alias("_row"))
    return replace(updates, df=newest.select("_row.*"))


def initial_states(messages: Messages) -> DataFrame:
    """A state row for each context that has any message."""
    sid = F.col(messages.sid)
    return messages.df.select(sid.alias("sid")).distinct().select("sid", F.concat(F.lit("sid-"), F.col("sid").cast("string")).alias("mid"))


def union(*parts: Messages) -> Messages:
    """Messages of several batches or tables; properties that some do not have are missing there."""
    out = parts[0].df
    for p in parts[1:]:
        out = out.unionByName(p.df, allowMissingColumns=True)
    return replace(parts[0], df=out)


def without_contexts(messages: Messages, deleted: DataFrame) -> Messages:
    """Messages of the contexts that are not deleted (`deleted` has the sid column)."""
    return replace(messages, df=messages.df.join(deleted.select(messages.sid).distinct(), messages.sid, "left_anti"))


def pending_events(events: Messages, consumed: DataFrame) -> Messages:
    """Events that no firing has consumed (`consumed` has sid and mid)."""
    return retracted(events, consumed)


def changes(before: Messages, after: Messages) -> DataFrame:
    """What was stored and deleted between two states of working memory: (action, sid, mid), by one full outer join."""
    keys = lambda x, side: x.df.select(F.col(x.sid).alias("sid"), F.col(x.mid).alias("mid")).distinct().withColumn(side, F.lit(True))
    both = keys(before, "old").join(keys(after, "new"), ["sid", "mid"], "full_outer")
    action = F.when(F.col("old").isNull(), "store").when(F.col("new").isNull(), "delete")
    return both.select(action.alias("action"), "sid", "mid").where("action IS NOT NULL")


def replayed(log: Messages, action: str = "action") -> Messages:
    """Working memory from a log of stores and deletes: each message whose last entry stores it."""
    df = log.df
    last = df.groupBy(log.sid, log.mid).agg(F.max_by(F.struct(*df.columns), log.seq).alias("_row")).select("_row.*")
    return replace(log, df=last.where(F.col(action) == "store").drop(action))
