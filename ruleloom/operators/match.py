"""Productions to matches: filters, joins within a context, anti-joins for `none`, outer joins for `any`.

A match is a row with the context id (sid) and a struct for each alias; aliases that an `any` left out are NULL.
Conditions on one message filter it before any join; conditions that relate messages become join conditions, whose
equalities Catalyst turns into hash or merge keys beside the context id. Structs hold only the columns that the rule or
the caller names. Where a context's messages make many rows of each other, the rows of a join are counted first and dealt
to as many tasks as they need: the size of a join's inputs says nothing of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.functions.columns import Scope, condition, truth
from ruleloom.plans.ir import All, Compare, Group, Node, Pattern, Prop, Rule, RuleError, aliases, names_of, own_names, patterns
from ruleloom.sources.messages import Messages

Source = Callable[[Pattern], Messages]

#: Rows that a task may make in a join; where a context can make more, joins are counted and dealt.
TASK_ROWS = 1 << 21
#: Rows that are sent to all executors; more of them go to the parts of their key.
SENT_ROWS = 1 << 18
#: Frames that are moved to be dealt; more of them stay where the join that made them was dealt.
MOVED_ROWS = 1 << 26
#: Tasks that a join is dealt to; beyond, each makes more rows.
MOST_TASKS = 20_000
#: Tasks that count frames which were dealt finely for a later join.
COUNT_TASKS = 1024
#: Patterns whose combinations are counted without listing matches: a context's sums are as many as their subsets.
MOST_COUNTED = 8


def flat(alias: str) -> str:
    """An alias as a column name: those of groups have dots."""
    return alias.replace(".", "__")


def split(node: Node) -> tuple[list[Node], list[Node]]:
    """Top-level conjuncts on the message alone, and those that relate it to others."""
    parts = node.parts if isinstance(node, All) else (node,)
    return [p for p in parts if not aliases(p)], [p for p in parts if aliases(p)]


def optional(g: Group) -> Iterator[str]:
    """Aliases of patterns that a match may leave out."""
    for e in g.elements:
        if isinstance(e, Group):
            yield from (p.alias for p in patterns(e)) if g.kind == "any" else optional(e)
        elif g.kind == "any":
            yield e.alias


def inside(e: Pattern | Group) -> list[Pattern]:
    """Patterns of an element: itself, or those of the group."""
    return list(patterns(e)) if isinstance(e, Group) else [e]


class Matcher:
    def __init__(self, rule: Rule, source: Messages | Source, state: Messages | None = None, keep: list[str] | None = None, where: Callable[[Pattern], Column | None] | None = None, deal: bool = False):
        self.rule, self.state, self.keep, self.where = rule, state, keep or [], where
        self.deal = deal and isinstance(source, Messages) and not source.df.isStreaming
        self.source: Source = source if callable(source) else lambda p: source
        self.all = list(patterns(rule.when))
        self.optional = set(optional(rule.when))
        self.fine = False  # frames are dealt for the joins that follow, too
        self.held = 0.0  # about how many frames there are, as far as the last join's counts tell

    def messages(self, p: Pattern) -> Messages:
        if p.on_state:
            if self.state is None:
                raise ValueError(f"{self.rule.name}: {p.alias} needs the context's state")
            return self.state
        return self.source(p)

    def columns(self, p: Pattern, src: Messages) -> list[str]:
        """Top-level columns of a pattern's struct: its identity and order, what the rule refers to, what the caller keeps."""
        if src.body:
            return [c for c in dict.fromkeys([src.mid, src.seq, src.body, *self.keep]) if c in src.df.columns]
        named = set().union(*(names_of(q.condition, p.alias) for q in self.all), *((names_of(q.condition, "s") for q in self.all) if p.on_state else ()))
        related = set().union(*(own_names(n) for n in split(p.condition)[1])) if split(p.condition)[1] else set()
        return [c for c in dict.fromkeys([src.mid, src.seq, *(n.split(".")[0] for n in sorted(named | related)), *self.keep]) if c in src.df.columns]

    def scope(self, own: tuple, known: list[Pattern]) -> Scope:
        others = {}
        for q in known:
            src = self.messages(q)
            others[q.alias] = (src.schema, src.getter(f"{flat(q.alias)}."))
            if q.on_state:
                others["s"] = others[q.alias]
        if self.state is not None and "s" not in others:
            others["s"] = (self.state.schema, self.state.getter("_s."))
        return Scope(own, others)

    def rows(self, p: Pattern) -> DataFrame:
        """(_sid, alias) of the messages that a pattern's own conditions let through."""
        src = self.messages(p)
        df = src.df
        alone, _ = split(p.condition)
        for n in alone:
            df = df.where(truth(n, Scope((src.schema, src.getter()), {})))
        if self.where and not p.negated and (more := self.where(p)) is not None:
            df = df.where(more)
        return df.select(F.col(src.sid).alias("_sid"), F.struct(*(F.col(c) for c in self.columns(p, src))).alias(flat(p.alias)))

    def joined_on(self, p: Pattern, known: list[Pattern], apart: list[Pattern] = ()) -> Column:
        """What a pattern's rows must fulfil beside the messages matched so far."""
        src = self.messages(p)
        own = (src.schema, src.getter(f"{flat(p.alias)}."))
        out = F.col("sid") == F.col("_sid")
        scope = self.scope(own, known)
        for n in split(p.condition)[1]:
            out = out & (condition(n, scope) if p.negated else truth(n, scope))
        if self.rule.distinct:
            for q in known:
                if not q.on_state and not p.on_state and not any(q is x for x in apart):
                    other = F.col(f"{flat(q.alias)}.{self.messages(q).mid}") != F.col(f"{flat(p.alias)}.{src.mid}")
                    out = out & (F.coalesce(other, F.lit(True)) if q.alias in self.optional else other)  # an `any` may have left it out
        return out

    @cached_property
    def large(self) -> bool:
        """Whether one context could make more rows than a task should: its messages counted by pattern, in one pass."""
        taking = [p for p in self.all if not p.on_state]
        if not self.deal or len(taking) < 2:
            return False
        src = self.messages(taking[0])
        scope = Scope((src.schema, src.getter()), {})
        own = src.df.select(F.col(src.sid).alias("_sid"), *(reduce(lambda a, b: a & b, (truth(n, scope) for n in split(p.condition)[0]), F.lit(True)).alias(f"_{k}") for k, p in enumerate(taking)))
        counts = own.groupBy("_sid").agg(*(F.count_if(f"_{k}").alias(f"_{k}") for k in range(len(taking))))
        made = reduce(lambda a, b: a * b, (F.col(f"_{k}").cast("double") + 1 for k in range(len(taking))))
        return (counts.agg(F.max(made).alias("n")).first()["n"] or 0) > TASK_ROWS

    def equal(self, p: Pattern, known: list[Pattern]) -> list[tuple[Column, Column]]:
        """Columns of messages matched so far and of a pattern's message that must be equal, beside the context id."""
        out = []
        src = self.messages(p)
        for n in split(p.condition)[1]:
            if not (isinstance(n, Compare) and n.op == "eq" and isinstance(n.left, Prop) and isinstance(n.right, Prop)):
                continue
            mine, other = (n.left, n.right) if n.left.alias is None else (n.right, n.left)
            q = next((q for q in known if q.alias == other.alias), None)
            if mine.alias is None and q and (theirs := self.messages(q)).schema and src.schema:
                types = [{f.name: f.dataType for f in x.schema}.get(y.name) for x, y in ((src, mine), (theirs, other))]
                if types[0] is not None and types[0] == types[1]:
                    out.append((theirs.getter(f"{flat(q.alias)}.")(other.name), src.getter(f"{flat(p.alias)}.")(mine.name)))
        return out

    def join(self, frames: DataFrame, rows: DataFrame, on: Column, how: str, known: list[Pattern], equal: list[tuple[Column, Column]] = (), whole: bool = True) -> DataFrame:
        """frames joined with (_sid, ...) rows. Where contexts are large, the pairs are counted by key: few rows are then
        sent to all tasks, among which the frames are dealt; of more rows, each part of a large key has its own. whole: no
        more than the equalities relates them, so that the pairs tell how many frames the next join has: if these stay where
        they were dealt in any case, they are not listed for a count."""
        if not self.large:
            return frames.join(rows, on, how)
        mids = [F.col(f"{flat(q.alias)}.{self.messages(q).mid}") for q in known]
        met = {flat(q.alias) for q in known} | set(rows.columns)
        more = any(not q.negated and not q.on_state and flat(q.alias) not in met for q in self.all)
        size, self.held = self.held, 0.0
        if self.fine and size > MOVED_ROWS and rows.count() <= SENT_ROWS:
            self.held = size if whole else 0.0
            return self.sent(frames, rows, on, how, mids, more)
        ours, theirs = zip((F.col("sid"), F.col("_sid")), *equal)
        keys = [f"_k{k}" for k in range(len(ours))]
        named = lambda cols: [c.alias(k) for k, c in zip(keys, cols)]
        few = frames.coalesce(COUNT_TASKS) if self.fine else frames  # tasks dealt finely make few of these rows each
        left = few.groupBy(*named(ours)).agg(F.count("*").cast("double").alias("_l"))
        right = rows.groupBy(*named(theirs)).agg(F.count("*").cast("double").alias("_r"))
        pairs = left.join(right, keys, "right")
        made, sent, held = pairs.agg(F.sum(F.col("_l") * F.col("_r")), F.sum("_r"), F.sum("_l")).first()
        if (made or 0) <= TASK_ROWS:
            return frames.join(rows, on, how)
        if sent <= SENT_ROWS:
            if not (self.fine and held > MOVED_ROWS):
                self.fine = made > MOVED_ROWS and more
                frames = self.dealt(frames, pairs, ours, mids, made, held)
            self.held = made if whole else 0.0
            return self.sent(frames, rows, on, how, mids, more)
        self.fine = False
        unit = max(TASK_ROWS, made / MOST_TASKS)  # of all keys together, so that their parts are few: rows are repeated for each
        needed = pairs.select(*keys, F.least(F.ceil(F.col("_l") * F.col("_r") / unit), F.col("_l")).cast("int").alias("_parts"), "_r").where("_parts > 1")
        large = needed.collect()
        parts = frames.sparkSession.createDataFrame(large, needed.schema).drop("_r")
        tasks = min(ceil(made / TASK_ROWS), MOST_TASKS)
        if (copies := sum(r["_parts"] * r["_r"] for r in large)) > TASK_ROWS:
            rows = rows.repartition(min(ceil(copies / TASK_ROWS), COUNT_TASKS))

        def cut(df: DataFrame, cols: tuple, part: Column, name: str) -> DataFrame:
            df = df.select("*", *named(cols)).join(parts, keys, "left").withColumn(name, part)
            return df.drop(*keys, "_parts").repartition(tasks, *cols, name)

        n = F.coalesce("_parts", F.lit(1))
        one = cut(frames, ours, F.pmod(F.xxhash64("sid", *mids), n).cast("int"), "_part")
        all_ = cut(rows, theirs, F.explode(F.sequence(F.lit(0), n - 1)), "_of")
        return one.join(all_, on & (F.col("_part") == F.col("_of")), how).drop("_part", "_of")

    def sent(self, frames: DataFrame, rows: DataFrame, on: Column, how: str, mids: list[Column], more: bool) -> DataFrame:
        """frames joined with rows that are sent to all tasks. more: other joins follow."""
        return frames.join(F.broadcast(rows), on & self.one_by_one(rows, mids) if self.fine and more and how != "left_anti" else on, how)

    def one_by_one(self, rows: DataFrame, mids: list[Column]) -> Column:
        """A condition that always holds, for a join whose frames the next join takes in the same task. Joins that are compiled
        as one keep all that a frame makes in all of them in memory, the product of their rows; an expression that is not
        compiled parts them, and the frames of this join come one by one."""
        theirs = [F.col(f"{flat(q.alias)}.{self.messages(q).mid}") for q in self.all if flat(q.alias) in rows.columns]
        return F.exists(F.array(F.xxhash64(*(mids or ["sid"]), *theirs)), lambda _: F.lit(True))  # of both sides, so that it stays in the join

    def dealt(self, frames: DataFrame, pairs: DataFrame, cols: tuple, mids: list[Column], made: float, held: float) -> DataFrame:
        """frames dealt to tasks. Those of a key go to tasks of their own, as far as it fills any: what a task makes then
        repeats few messages in one order, which its files keep in a fraction of the bytes. If later joins will not move
        their frames, these are dealt as finely as they can be, and evenly, since nobody knows yet what each will make."""
        tasks = min(ceil(made / TASK_ROWS), MOST_TASKS)
        if self.fine:
            return frames.repartition(max(tasks, min(int(held) // 4, MOST_TASKS)))
        if held < 16 * tasks or not mids:
            return frames.repartition(tasks)
        keys, unit = [f"_k{k}" for k in range(len(cols))], max(TASK_ROWS, made / MOST_TASKS)
        large = pairs.select(*keys, (F.col("_l") * F.col("_r")).alias("_n")).where(F.col("_n") > unit).collect()
        at, own = 0, []
        for r in large:
            own.append((*r[:-1], at, n := ceil(r["_n"] / unit)))
            at += n
        tasks = at + ceil((made - sum(r["_n"] for r in large)) / unit)
        if not own:
            return frames.repartition(tasks)
        schema = T.StructType([*pairs.select(*keys).schema, T.StructField("_at", T.IntegerType()), T.StructField("_parts", T.IntegerType())])
        parts = frames.sparkSession.createDataFrame(own, schema)
        to = F.coalesce(F.col("_at") + F.pmod(F.xxhash64(*mids), F.col("_parts")), F.pmod(F.xxhash64(*mids), F.lit(tasks)))
        return frames.select("*", *(c.alias(k) for k, c in zip(keys, cols))).join(F.broadcast(parts), keys, "left").repartitionById(tasks, to.cast("int")).drop(*keys, "_at", "_parts")

    def sequence(self, elements: list[Pattern | Group], frames: DataFrame | None = None, known: list[Pattern] | None = None, apart: list[Pattern] | None = None, use: Column | None = None) -> DataFrame:
        """Frames in which all elements hold: a left-deep join in written order; a leading `none` waits for the first pattern.

        frames: what is matched so far, with the patterns `known`, which conditions may refer to. apart: those of them
        in other groups, whose messages need not differ from the ones here. use: which frames take the elements, all of
        them patterns; other frames stay without them.
        """
        first = next((k for k, e in enumerate(elements) if isinstance(e, Group) or not e.negated), None)
        if first is None:
            if frames is None:
                raise RuleError(f"{self.rule.name}: a rule of `none` alone fires when its last message goes; see emptied()")
            first = 0
        ordered = [elements[first], *elements[:first], *elements[first + 1 :]]
        known, apart = list(known or []), list(apart or [])
        for e in ordered:
            if isinstance(e, Group):
                frames = (self.any_of if e.kind == "any" else self.sequence)(list(e.elements), frames, known, known)
                inner = [p for p in patterns(e) if not p.negated]
                known, apart = [*known, *inner], [*apart, *inner]
                continue
            if frames is None:
                frames = self.with_state(e, self.rows(e).withColumnRenamed("_sid", "sid"))
                if related := split(e.condition)[1]:
                    src = self.messages(e)
                    scope = self.scope((src.schema, src.getter(f"{flat(e.alias)}.")), [])
                    frames = frames.where(reduce(lambda a, b: a & b, (truth(n, scope) for n in related)))
            else:
                on, equal = self.joined_on(e, known, apart), self.equal(e, known)
                whole = not e.negated and len(equal) == len(split(e.condition)[1])
                frames = self.join(frames, self.rows(e), on if use is None else on & use, "left_anti" if e.negated else "inner" if use is None else "left", known, equal, whole)
                if use is not None and not e.negated:
                    frames = frames.where(~use | F.col(flat(e.alias)).isNotNull())
                frames = frames if e.negated else frames.drop("_sid")
            if not e.negated:
                known.append(e)
        return frames

    def with_state(self, p: Pattern, frames: DataFrame) -> DataFrame:
        """Frames with the state's row, where conditions refer to `s` and no pattern is on it."""
        uses = any("s" in aliases(q.condition) for q in self.all) and not any(q.on_state for q in self.all)
        if not uses or self.state is None or "_s" in frames.columns:
            return frames
        rows = self.state.df.select(F.col(self.state.sid).alias("_sid"), F.struct("*").alias("_s"))
        return frames.join(rows, F.col("sid") == F.col("_sid")).drop("_sid")

    def any_of(self, elements: list[Pattern | Group], frames: DataFrame | None = None, known: list[Pattern] | None = None, apart: list[Pattern] | None = None) -> DataFrame:
        """Frames of every non-empty combination of the elements; one that refers to another never stands without it.

        Each element in turn is left out or joined: one outer join for each, whatever their number. In large contexts the
        patterns of a group are joined so one by one, since its own matches may be too many to be sent or repeated.
        """
        known, outer = list(known or []), list(apart or [])
        if any(isinstance(e, Pattern) and e.negated for e in elements):
            raise RuleError(f"{self.rule.name}: `none` stands in no `any`")
        if frames is None:
            alone = [x for e in elements if not self.related(e) for x in ([self.rows(p) for p in inside(e) if not p.negated] or [self.sequence([e])])]  # contexts that could hold one
            frames = reduce(DataFrame.union, (x.select("_sid") for x in alone)).distinct().withColumnRenamed("_sid", "sid")
            frames = self.with_state(elements[0], frames)
        taken = []
        for e in elements:
            use = F.col("_use")
            inner = [p for p in inside(e) if not p.negated]
            if isinstance(e, Pattern):
                frames = frames.withColumn("_use", F.explode(F.array(F.lit(True), F.lit(False))))
                frames = self.sequence([e], frames, known, outer, use).drop("_use")
            else:
                if self.large and inner and e.kind == "all" and all(isinstance(x, Pattern) for x in e.elements):
                    frames = frames.withColumn("_use", F.explode(F.array(F.lit(True), F.lit(False))))
                    frames = self.sequence(list(e.elements), frames, known, known, use).drop("_use")
                elif self.related(e):
                    frames = self.sequence([e], frames, known, known).unionByName(frames, allowMissingColumns=True)
                    self.held = 0.0
                else:
                    dealt = self.fine, self.held
                    found = self.sequence([e]).withColumn("_found", F.lit(True)).withColumnRenamed("sid", "_sid").drop("_s")
                    self.fine, self.held = dealt
                    frames = frames.withColumn("_use", F.explode(F.array(F.lit(True), F.lit(False))))
                    frames = self.join(frames, found, (F.col("sid") == F.col("_sid")) & use, "left", known).where(~use | F.col("_found")).drop("_sid", "_use", "_found")
                outer += inner
            known += inner
            taken += inner
        return frames.where(reduce(lambda a, b: a | b, (F.col(flat(p.alias)).isNotNull() for p in taken)))

    def related(self, e: Pattern | Group) -> bool:
        """Whether an element refers to patterns outside it."""
        own = {p.alias for p in inside(e)}
        return any(aliases(p.condition) - own - {"s"} for p in inside(e))

    def matches(self) -> DataFrame:
        elements = list(self.rule.when.elements)
        out = self.any_of(elements) if self.rule.when.kind == "any" else self.sequence(elements)
        return out.drop("_s")


def match(rule: Rule, source: Messages | Source, state: Messages | None = None, keep: list[str] | None = None, deal: bool = True) -> DataFrame:
    """The rule's matches: sid and a struct for each alias. keep: further columns of the messages to carry.

    deal: messages are counted, and joins of large contexts dealt to tasks, when the matches are planned."""
    return Matcher(rule, source, state, keep, deal=deal).matches()


def counted(rule: Rule, messages: Messages) -> DataFrame:
    """How many matches each context has that has any (sid, n): listed only if patterns refer to each other, or are groups or many.

    A message stands for 1 plus a term for each pattern that takes it, and a context's matches are the terms of the product
    over its messages in which no pattern comes twice. Messages with equal terms are counted: their product is a power.
    """
    taking = list(rule.when.elements)
    if len(taking) > MOST_COUNTED or any(isinstance(p, Group) or p.negated or p.on_state or aliases(p.condition) for p in taking):
        return match(rule, messages).groupBy("sid").agg(F.count("*").alias("n"))
    some, names, size, whole = rule.when.kind == "any", [f"_{k}" for k in range(len(taking))], 1 << len(taking), T.DecimalType(38, 0)
    scope = Scope((messages.schema, messages.getter()), {})
    takes = [F.coalesce(reduce(lambda a, b: a & b, (truth(n, scope) for n in split(p.condition)[0])), F.lit(False)).alias(k) for k, p in zip(names, taking)]
    own = messages.df.select(F.col(messages.sid).alias("sid"), F.col(messages.mid).alias("_mid"), *takes).where(reduce(lambda a, b: a | b, map(F.col, names)))
    own = own if len(taking) == 1 and not some else own.where("sid IS NOT NULL")
    counts = [F.count_if(k).alias(k) for k in names]
    alone = F.explode(F.array(*(F.struct(*((F.col(k) if k == j else F.lit(0)).cast("long").alias(k) for k in names)) for j in names))).alias("_k")
    if rule.distinct and len(taking) > 1:  # rows of one identity exclude each other; without one they exclude nothing in an `any`, all in an `all`
        kinds = own.where("_mid IS NOT NULL").groupBy("sid", "_mid").agg(*counts).drop("_mid")
        if some:
            kinds = kinds.unionByName(own.where("_mid IS NULL").select("sid", alone).select("sid", "_k.*"))
        kinds = kinds.groupBy("sid", *names).agg(F.count("*").alias("_n"))
    else:  # each pattern takes its rows whatever the others take
        kinds = own.groupBy("sid").agg(*counts).select("sid", F.lit(1).cast("long").alias("_n"), alone).select("sid", "_n", "_k.*")

    def ways(chosen: int) -> Column:
        """In how many ways these patterns take different messages of a kind."""
        out = F.lit(1).cast(whole)
        for nth, k in enumerate(k for at, k in enumerate(names) if chosen >> at & 1):
            out = (out * (F.col(k) * F.greatest(F.col("_n") - nth, F.lit(0))).cast(whole)).cast(whole)
        return out

    def product(one: Column, other: Column) -> Column:
        term = lambda to, at: (F.get(one, at) * F.get(other, to - at)).cast(whole)
        sums = lambda to: F.aggregate(F.sequence(F.lit(0), to), F.lit(0).cast(whole), lambda x, at: F.when(at.bitwiseAND(to) == at, (x + term(to, at)).cast(whole)).otherwise(x))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), sums)

    terms = kinds.groupBy("sid").agg(F.collect_list(F.array(*map(ways, range(size)))).alias("_w"))
    first = F.array(*(F.lit(int(not k)).cast(whole) for k in range(size)))
    terms = terms.select("sid", F.aggregate("_w", first, product).alias("_w"))
    n = F.aggregate("_w", F.lit(-1).cast(whole), lambda a, b: (a + b).cast(whole)) if some else F.get("_w", F.lit(size - 1))
    return terms.select("sid", n.cast("long").alias("n")).where("n > 0")


def positive(rule: Rule) -> Iterator[Pattern]:
    return (p for p in patterns(rule.when) if not p.negated)


def unmatched(productions: list[Rule], messages: Messages) -> DataFrame:
    """Messages that no pattern of any rule takes (conditions on the message alone), in one pass over them."""
    scope = Scope((messages.schema, messages.getter()), {})
    taken = F.lit(False)
    for rule in productions:
        for p in patterns(rule.when):
            if not p.on_state:
                taken = taken | reduce(lambda a, b: a & b, (condition(n, scope) for n in split(p.condition)[0]), F.lit(True))
    return messages.df.where(~taken)


def taken_by(productions: list[Rule], messages: Messages) -> DataFrame:
    """Each message with the names of the patterns that take it (rule/alias), all found in one pass."""
    scope = Scope((messages.schema, messages.getter()), {})
    tags = [F.when(reduce(lambda a, b: a & b, (condition(n, scope) for n in split(p.condition)[0]), F.lit(True)), F.lit(f"{r.name}/{p.alias}")) for r in productions for p in patterns(r.when) if not p.on_state]
    return messages.df.withColumn("patterns", F.array_compact(F.array(*tags)))


def emptied(pattern: Pattern, before: Messages, after: Messages) -> DataFrame:
    """Contexts in which messages held the pattern before a change and none does after it: when a leading `none` fires."""
    scope = Scope((before.schema, before.getter()), {})
    held = lambda x: x.df.where(truth(pattern.condition, scope)).select(F.col(x.sid).alias("sid")).distinct()
    return held(before).join(held(after), "sid", "left_anti")
