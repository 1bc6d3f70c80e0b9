"""The order in which matches fire: priority, definition order, recency; and their delivery in batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.operators.match import flat, match, positive
from ruleloom.plans.ir import Rule
from ruleloom.sources.messages import Messages


def agenda(productions: list[Rule], source: Messages, state: Messages | None = None, keep: list[str] | None = None, deal: bool = True) -> DataFrame:
    """All matches of the productions: sid, rule, pri, rule_index, mids, seqs (by pattern, NULL where one is left out), at, match.

    `at` is the arrival that completed the match; `match` holds the aliases' structs. Productions whose patterns differ share
    the columns, with NULL for aliases they do not have. deal: as in match(); loops that plan each round anew go without.
    """
    parts = []
    for k, rule in enumerate(productions):
        found = match(rule, source, state, keep, deal)
        names = [p.alias for p in positive(rule)]
        of = lambda c, kind: F.array(*(F.col(f"{flat(a)}.{c}").cast(kind) for a in names))
        row = found.select("sid", F.lit(rule.name).alias("rule"), F.lit(rule.pri).alias("pri"), F.lit(k).alias("rule_index"), of(source.mid, "string").alias("mids"), of(source.seq, "long").alias("seqs"), *(F.col(flat(a)) for a in names))
        parts.append(row)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    structs = [c for c in out.columns if c not in ("sid", "rule", "pri", "rule_index", "mids", "seqs")]
    return out.select("sid", "rule", "pri", "rule_index", "mids", "seqs", F.array_max("seqs").alias("at"), F.struct(*structs).alias("match"))


def recency() -> list[Column]:
    """Most recent first: by the completing arrival, then by each pattern's message."""
    return [F.col("at").desc(), F.col("seqs").desc()]


def first_to_fire(matches: DataFrame) -> DataFrame:
    """The match that each context fires first: lowest pri, then definition order, then recency. An aggregation, not a sort of all."""
    order = F.struct(-F.col("pri"), -F.col("rule_index"), "at", "seqs")
    return matches.groupBy("sid").agg(F.max_by(F.struct(*matches.columns), order).alias("_m")).select("_m.*")


def firing_order(matches: DataFrame) -> DataFrame:
    """The matches of each context numbered as they fire, all of them being on the agenda at once."""
    w = Window.partitionBy("sid").orderBy("pri", "rule_index", *recency())
    return matches.withColumn("nth", F.row_number().over(w))


def batched(matches: DataFrame, count: int | None = None, cap: int | None = None) -> DataFrame:
    """Matches delivered n at a time, in order of completion: sid, rule, batch, size, matches (newest first).

    count: batches of exactly n, an incomplete one waits. cap: of at most n. A batch is all that is collected in a row.
    """
    n = count or cap or 1
    w = Window.partitionBy("sid", "rule").orderBy("at", "seqs")
    nth = matches.withColumn("batch", F.floor((F.row_number().over(w) - 1) / n))
    out = nth.groupBy("sid", "rule", "batch").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(F.struct("at", "seqs", "mids", "match")), asc=False).alias("matches"))
    return out.where(F.col("size") == n) if count else out


def batches_of(rule: Rule, source: Messages, state: Messages | None = None, keep: list[str] | None = None) -> DataFrame:
    return batched(agenda([rule], source, state, keep), rule.count, rule.cap)
