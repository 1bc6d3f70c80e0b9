"""Chat formatting, with DataFrame functions only.

A conversation becomes windows of at most `budget` tokens. Prefix sums of the turns' tokens choose turn-aligned spans;
a later window first repeats the system turn and a limited history, and only texts of assistant turns that stand in
their first window are under the loss mask, so each is a target once.

Template: <turn ROLE>TEXT</turn>\\n for each turn. In ROLE and TEXT, \\ < > are written \\\\ \\l \\g, so no control
string can stand inside a text, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm.common import table, written

END = "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    """Each backslash of an escaped text starts a pair: the doubled ones part it, the others are replaced between them."""
    parts = F.split(c, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))), "\\")


def count_tokens(c: Column) -> Column:
    """Words and single marks: a stand-in for a tokenizer that the JVM can count."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]")).cast("long")


#: bytes of a conversation's roles and texts up to which it is put together in one row
ROW_BYTES = 4 << 20
#: window starts that a fold appends to one array before it opens the next
RUN = 512


def window_starts(ends: str, room: Column) -> Column:
    """Positions of the turns that open a window: a fold over the prefix sums (pos, before, tokens) of a conversation."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<int>>").alias("runs"), F.array(F.lit(0)).alias("run"))

    def step(acc: Column, e: Column) -> Column:
        full = F.size(acc["run"]) >= RUN
        opened = F.struct(
            e["before"].alias("at"),
            F.when(full, F.concat(acc["runs"], F.array(acc["run"]))).otherwise(acc["runs"]).alias("runs"),
            F.when(full, F.array(e["pos"])).otherwise(F.concat(acc["run"], F.array(e["pos"]))).alias("run"),
        )
        return F.when((e["pos"] > 0) & (e["before"] + e["tokens"] - acc["at"] > room), opened).otherwise(acc)

    return F.aggregate(ends, zero, step, lambda acc: F.flatten(F.concat(acc["runs"], F.array(acc["run"]))))


def format_chats(turns: DataFrame, budget: int = 512, history_turns: int = 2, history_tokens: int = 128, tokens: str | None = None, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Rows (conv_id, turn, role, text) to windows: conv_id, window, formatted, n_repeated, loss (spans), n_tokens.

    loss holds (start, length) in code points of `formatted`. tokens: a column with the number of tokens of each turn's
    text, as a tokenizer counts them (null: none); without it `count_tokens` stands in. Four more are added for a turn's
    marks. A turn that does not fit beside the system turn and the history is a window of its own, with these before it,
    and may exceed the budget: so may all later windows of a conversation whose system turn leaves no room.
    Turns stand by turn, then role and text (nulls first), so repeated rows and ties have one order and all stay; null
    role or text is empty; a null conv_id is a conversation as any other; other columns are ignored.

    Texts are shuffled once, by conversation, and a conversation's windows are cut from one row. Conversations of more
    than row_bytes are counted first and take another way: their texts meet by window, and only their prefix sums stand
    in one row. Both ways give the same windows.
    """
    counted = F.coalesce(F.col(tokens).cast("long"), F.lit(0)) if tokens else count_tokens(F.coalesce("text", F.lit("")))
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), (counted + 4).alias("tokens"))
    sizes = turns.groupBy("conv_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.coalesce(F.octet_length("role"), F.lit(0)) + 64).alias("size"))
    large = sizes.where(F.col("size") > row_bytes).select(F.col("conv_id").alias("large"))
    options = (budget, history_turns, history_tokens)
    if large.isEmpty():
        return _cut_in_rows(_placed(clean), *options)
    large = written(large, "large")
    same = F.col("conv_id").eqNullSafe(F.col("large"))
    return _cut_in_rows(_placed(clean.join(large, same, "left_anti")), *options).unionByName(_cut_by_joins(written(_placed(clean.join(large, same, "left_semi")), "turns"), *options))


def _placed(clean: DataFrame) -> DataFrame:
    """Turns with their position, the tokens before them, and whether they are the system turn."""
    by_conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "tokens")
    return (
        clean.withColumn("pos", F.row_number().over(by_conv) - 1)
        .withColumn("before", F.sum("tokens").over(by_conv.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
        .withColumn("system", (F.col("pos") == 0) & (F.col("role") == "system"))
    )


def _said() -> tuple[Column, Column]:
    """What opens a turn in the template, and its escaped text."""
    return F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">")), escape(F.col("text"))


def _room(budget: int, history_tokens: int) -> Column:
    return F.greatest(F.lit(1), F.lit(budget - history_tokens) - F.col("system_tokens"))


def _cut_in_rows(placed: DataFrame, budget: int, history_turns: int, history_tokens: int) -> DataFrame:
    """Windows cut from the array of a conversation's turns, without another shuffle of texts."""
    head, body = _said()
    told = placed.select("conv_id", "pos", "before", "tokens", "system", (F.col("role") == "assistant").alias("target"), head.alias("head"), body.alias("body"))
    turn = F.struct("pos", "before", "tokens", "system", "target", F.char_length("head").alias("head"), F.char_length("body").alias("length"), F.concat("head", "body", F.lit(END)).alias("said"))
    whole = told.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).alias("system_tokens"))
    whole = whole.withColumn("starts", window_starts("turns", _room(budget, history_tokens)))
    turns = F.col("turns")

    def spans(start: Column, window: Column) -> Column:
        own = F.slice(turns, start + 1, F.coalesce(F.get("starts", window + 1), F.size(turns)) - start)
        at = F.get(turns, start)["before"]
        last = F.least(F.lit(history_turns), start)
        recent = F.filter(F.slice(turns, start - last + 1, last), lambda t: t["system"] | (at - t["before"] <= history_tokens))
        opening = F.filter(F.slice(turns, 1, F.when(last < start, 1).otherwise(0)), lambda t: t["system"])
        return F.struct(F.concat(opening, recent).alias("again"), own.alias("own"))

    def window_of(w: Column) -> Column:
        chars = lambda t: F.char_length(t["said"])
        total = lambda ts, f: F.aggregate(ts, F.lit(0).cast("long"), lambda acc, t: acc + f(t))
        none = F.array().cast("array<struct<start:bigint,length:int>>")
        zero = F.struct(total(w["again"], chars).alias("at"), none.alias("spans"))
        loss = F.aggregate(
            w["own"],
            zero,
            lambda acc, t: F.struct(
                (acc["at"] + chars(t)).alias("at"),
                F.when(t["target"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["head"]).alias("start"), t["length"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
            ),
            lambda acc: acc["spans"],
        )
        every = F.concat(w["again"], w["own"])
        return F.struct(
            F.array_join(F.transform(every, lambda t: t["said"]), "").alias("formatted"), F.size(w["again"]).cast("long").alias("n_repeated"), loss.alias("loss"), total(every, lambda t: t["tokens"]).alias("n_tokens")
        )

    made = F.transform(F.transform("starts", spans), window_of)
    return whole.select("conv_id", F.posexplode(made).alias("window", "w")).select("conv_id", "window", "w.*")


def _cut_by_joins(told: DataFrame, budget: int, history_turns: int, history_tokens: int) -> DataFrame:
    """The same windows for conversations of any size: each window's turns meet by (conversation, window)."""
    starts = (
        told.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "before", "tokens"))).alias("ends"), F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).alias("system_tokens"))
        .withColumn("starts", window_starts("ends", _room(budget, history_tokens)))
        .select("conv_id", "system_tokens", "ends", F.posexplode("starts").alias("window", "start"))
        .select("conv_id", "window", "start", F.get("ends", F.col("start"))["before"].alias("start_before"), (F.col("system_tokens") > 0).alias("has_system"))
    )
    starts = written(starts, "starts")
    same = told["conv_id"].eqNullSafe
    first = starts.select(F.col("conv_id").alias("c"), F.col("start").alias("p"), F.col("window"))
    own = told.join(first, same(F.col("c")) & (F.col("pos") == F.col("p")), "left")
    own = own.withColumn("window", F.max("window").over(Window.partitionBy("conv_id").orderBy("pos"))).withColumn("repeated", F.lit(False))
    none = F.array().cast("array<int>")
    history = F.sequence(F.greatest(F.lit(0), F.col("start") - history_turns), F.col("start") - 1) if history_turns > 0 else none
    again = starts.where("window > 0").select(F.col("conv_id").alias("c"), "window", "start_before", F.explode(F.array_distinct(F.concat(F.when(F.col("has_system"), F.array(F.lit(0))).otherwise(none), history))).alias("p"))
    again = told.join(again, same(F.col("c")) & (F.col("pos") == F.col("p"))).where(F.col("system") | (F.col("start_before") - F.col("before") <= history_tokens)).withColumn("repeated", F.lit(True))
    cols = ["conv_id", "window", "pos", "role", "text", "tokens", "repeated"]
    head, body = _said()
    said = own.select(*cols).unionByName(again.select(*cols)).select("conv_id", "window", "pos", "repeated", "tokens", F.concat(head, body, F.lit(END)).alias("said"), F.char_length(head).alias("head"), F.char_length(body).alias("length"), ((F.col("role") == "assistant") & ~F.col("repeated")).alias("target"))
    ahead = F.coalesce(F.sum(F.char_length("said")).over(Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    said = said.withColumn("start", ahead + F.col("head"))
    return said.groupBy("conv_id", "window").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), "").alias("formatted"),
        F.sum(F.col("repeated").cast("int")).alias("n_repeated"),
        F.sort_array(F.collect_list(F.when(F.col("target"), F.struct("start", "length")))).alias("loss"),
        F.sum("tokens").alias("n_tokens"),
    )


def read_chats(windows: DataFrame) -> DataFrame:
    """What the windows hold, read from them alone: conv_id, window, turns (role, text; repeated ones left out), targets, chars."""
    marks = F.slice(F.split("formatted", END, -1), F.col("n_repeated") + 1, F.greatest(F.lit(0), F.size(F.split("formatted", END, -1)) - 1 - F.col("n_repeated")))
    turn = lambda x: F.struct(unescape(F.substring_index(F.substr(x, F.lit(7)), ">", 1)).alias("role"), unescape(F.substring_index(x, ">", -1)).alias("text"))
    target = lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"]))
    return windows.select("conv_id", "window", F.transform(marks, turn).alias("turns"), F.transform("loss", target).alias("targets"), F.char_length("formatted").cast("long").alias("chars"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, '\\\\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    read = read_chats(format_chats(turns))
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns_of = F.flatten(F.transform("w", lambda x: x["turns"]))
    loss = F.array_join(F.flatten(F.transform("w", lambda x: x["targets"])), "")
    told = F.array_join(F.transform(turns_of, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id", F.size(turns_of).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars"
    )


ORACLE = """
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
o AS (SELECT *, row_number() OVER w - 1 AS pos, len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}]+|[^\\s\\p{L}\\p{M}\\p{N}]')) + 4 AS tokens FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
t AS MATERIALIZED (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) - tokens AS before, pos = 0 AND role = 'system' AS system,
  length('<turn ></turn>') + 1 + length(replace(replace(replace(role, '\\', '\\\\'), '<', '\\l'), '>', '\\g')) + length(replace(replace(replace(text, '\\', '\\\\'), '<', '\\l'), '>', '\\g')) AS chars FROM o),
room AS (SELECT conv_id, greatest(1, 512 - 128 - max(CASE WHEN system THEN tokens ELSE 0 END)) AS room, bool_or(system) AS has_system FROM t GROUP BY conv_id),
f AS (SELECT conv_id, 0 AS pos, 0 AS win, 0 AS start, CAST(0 AS HUGEINT) AS start_before FROM room
  UNION ALL SELECT t.conv_id, t.pos, CASE WHEN before + tokens - start_before > room THEN win + 1 ELSE win END, CASE WHEN before + tokens - start_before > room THEN t.pos ELSE start END, CASE WHEN before + tokens - start_before > room THEN before ELSE start_before END
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.pos = f.pos + 1 JOIN room ON room.conv_id = f.conv_id),
again AS (SELECT s.conv_id, sum(t.chars) AS chars FROM (SELECT DISTINCT f.conv_id, win, start, start_before FROM f WHERE win > 0) s JOIN t ON t.conv_id = s.conv_id
  AND (t.system OR t.pos BETWEEN start - 2 AND start - 1 AND start_before - t.before <= 128) AND t.pos < start GROUP BY s.conv_id)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(t.chars) + coalesce(any_value(again.chars), 0) AS BIGINT) AS formatted_chars
FROM t LEFT JOIN again ON again.conv_id = t.conv_id GROUP BY t.conv_id
"""
