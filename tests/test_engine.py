"""Definitions, joins against a nested-loop evaluation, agenda, chaining, charts, events."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ruleloom.operators.actions import chained, effects_of
from ruleloom.operators.agenda import agenda, batched, first_to_fire, firing_order
from ruleloom.operators.chain import Retract, asserts, closure, fire
from ruleloom.operators.events import consumed_once, lifo_pairs
from ruleloom.operators.flow import Chart, Trigger, current_states, effects_of_chart, run_chart, run_flow
from ruleloom.operators.match import counted, emptied, match, unmatched
from ruleloom.plans.dsl import all_, any_, c, cap, count, distinct, item, m, none_, pri, ruleset, s, timeout, when_all, when_any
from ruleloom.plans.ir import RuleError
from ruleloom.sources import definitions
from ruleloom.sources.messages import Messages, changes, from_json, latest_state, observed, replayed, retracted, union, without_contexts

SCHEMA = "sid string, mid string, seq long, t string, v long"


def messages(spark, rows) -> Messages:
    return Messages(spark.createDataFrame(rows, SCHEMA))


def rows_of(n, seed, sids=3):
    r = random.Random(seed)
    return [(str(r.randrange(sids)), f"m{k}", k, r.choice("abc"), r.choice([None, *range(5)])) for k in range(n)]


def test_definitions():
    with ruleset("x") as r:
        d = when_all(c.first << (m.t == "a"), c.second << (m.v != c.first.v), pri(2), count(3))
        when_any(all_(m.t == "a", m.t == "b"), any_(m.t == "c"), name="groups")

        @d
        def act(ctx):
            return ctx

    assert r.rule("r_0").pri == 2 and r.rule("r_0").run is act and [p.alias for p in r.rule("r_0").when.elements] == ["first", "second"]
    assert r.rule("groups").when.elements[0].elements[1].alias == "m_0.m_1"
    assert (c.first << m.t == "a").alias == "first" and (c.first << m.x.y + 1 > 2).condition.op == "gt"
    for bad in (lambda: when_all(m.t == "a", count(2), cap(2)), lambda: when_all(m.t == c.later.t), lambda: when_all(), lambda: when_all(m.t == "a", pri("x")), lambda: when_all(c.a << +m.t, c.b << m.v.allItems(item == c.a.v))):
        with pytest.raises(RuleError):
            bad()


def test_json_round_trip():
    x = {"all": [{"a": {"$and": [{"t": "a"}, {"$gt": {"v": 3}}]}}, {"b": {"$neq": {"v": {"$add": {"$l": {"a": "v"}, "$r": 1}}}}}, {"n$not": {"$mt": {"t": "c.*"}}}, {"g$any": [{"x": {"$ex": {"v": 1}}}, {"y": {"$iall": {"v": {"$lt": {"$i": 4}}}}}]}], "pri": 4, "cap": 2, "dist": 0}
    r = definitions.rule("r", x)
    assert definitions.to_json(r) == x and r.pri == 4 and not r.distinct
    assert definitions.to_json(definitions.rule("r", definitions.to_json(r))) == x
    for bad in ({"all": [{"a": {"$foo": {"v": 1}}}]}, {"any": []}, {}, {"all": [{"a": {"t": 1}}], "count": "2"}, {"all": [{"a": {"t": 1}}], "foo": 1}):
        with pytest.raises(RuleError):
            definitions.rule("r", bad)


def compare(op, a, b):
    return a is not None and b is not None and {"gt": a > b, "eq": a == b, "neq": a != b}[op]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_joins_against_loops(spark, seed):
    rows = rows_of(40, seed)
    x = messages(spark, rows)
    by = {k: [r for r in rows if r[0] == k] for k in {r[0] for r in rows}}

    def want(*alone, rel=lambda *_: True, dist=True):
        return sorted((k, *(r[1] for r in t)) for k, g in by.items() for t in itertools.product(*([r for r in g if f(r)] for f in alone)) if rel(*t) and (not dist or len({r[1] for r in t}) == len(t)))

    def got(rule, *names):
        return sorted(map(tuple, match(rule, x).select("sid", *(F.col(f"{n}.mid").alias(n.replace("__", "")) for n in names)).collect()))

    is_ = lambda t: lambda r: r[3] == t
    any_v = lambda r: r[4] is not None
    assert got(when_all(c.x << +m.v, c.y << (m.v > c.x.v)).rule, "x", "y") == want(any_v, any_v, rel=lambda a, b: compare("gt", b[4], a[4]))
    assert got(when_all(c.x << +m.v, c.y << +m.v, distinct(False)).rule, "x", "y") == want(any_v, any_v, dist=False)
    assert got(when_all(c.x << m.t == "a", c.y << m.t == "b", c.z << (m.v == c.x.v + c.y.v)).rule, "x", "y", "z") == want(is_("a"), is_("b"), any_v, rel=lambda a, b, z: a[4] is not None and b[4] is not None and z[4] == a[4] + b[4])
    blocked = lambda a: any(r[3] == "b" and compare("gt", r[4], a[4]) and r[1] != a[1] for r in by[a[0]])
    assert got(when_all(c.x << m.t == "a", none_((m.t == "b") & (m.v > c.x.v))).rule, "x") == want(is_("a"), rel=lambda a: not blocked(a))
    lead = when_all(none_((m.t == "c") & (m.v == 4)), c.x << m.t == "a").rule
    assert got(lead, "x") == want(is_("a"), rel=lambda a: not any(r[3] == "c" and r[4] == 4 for r in by[a[0]]))
    some = match(when_any(c.x << (m.t == "a") & (m.v == 1), c.y << (m.t == "b") & (m.v == 2)).rule, x).select("sid", "x.mid", "y.mid").collect()
    xs, ys = want(lambda r: r[3] == "a" and r[4] == 1), want(lambda r: r[3] == "b" and r[4] == 2)
    both = [(k, a, b) for k, a in xs for q, b in ys if k == q]
    assert sorted(map(tuple, some), key=str) == sorted([(k, a, None) for k, a in xs] + [(k, None, b) for k, b in ys] + both, key=str)


def test_correlated_any_never_stands_alone(spark):
    x = messages(spark, [("0", "1", 1, "a", 1), ("0", "2", 2, "b", 1), ("1", "3", 3, "b", 1)])
    rule = when_any(c.x << m.t == "a", c.y << (m.t == "b") & (m.v == c.x.v)).rule
    assert sorted(map(tuple, match(rule, x).select("sid", "x.mid", "y.mid").collect()), key=str) == [("0", "1", "2"), ("0", "1", None)]


def test_agenda_and_batches(spark):
    x = messages(spark, [("0", str(k), k, "a", v) for k, v in enumerate([50, 150, 250, 50, 60])])
    productions = [when_all(m.v < 300, pri(3), name="p3").rule, when_all(m.v < 200, pri(2), name="p2").rule, when_all(m.v < 100, pri(1), name="p1").rule]
    a = agenda(productions, x)
    assert [tuple(r) for r in first_to_fire(a).select("rule", "at").collect()] == [("p1", 4)]
    assert [(r.rule, r.at) for r in firing_order(a).orderBy("nth").collect()][:4] == [("p1", 4), ("p1", 3), ("p1", 0), ("p2", 4)]
    one = agenda(productions[:1], x)
    sizes = lambda d: sorted((r["size"], r.matches[0]["at"]) for r in d.collect())
    assert sizes(batched(one, count=2)) == [(2, 1), (2, 3)] and sizes(batched(one, cap=2)) == [(1, 4), (2, 1), (2, 3)]
    assert unmatched(productions[2:], x).count() == 2


def test_chaining(spark):
    facts = spark.createDataFrame([("0", f"{k}", k, *f) for k, f in enumerate([("Kermit", "eats", "flies"), ("Kermit", "lives", "water"), ("Greedy", "eats", "flies"), ("Greedy", "lives", "land"), ("Tweety", "eats", "worms")])], "sid string, mid string, seq long, subject string, predicate string, object string")
    program = [
        (when_all(c.first << (m.predicate == "eats") & (m.object == "flies"), c.next << (m.predicate == "lives") & (m.object == "water") & (m.subject == c.first.subject), name="frog").rule, [asserts(subject=c.first.subject, predicate="is", object="frog")]),
        (when_all(c.first << (m.predicate == "eats") & (m.object == "flies"), c.next << (m.predicate == "lives") & (m.object == "land") & (m.subject == c.first.subject), name="chameleon").rule, [asserts(subject=c.first.subject, predicate="is", object="chameleon")]),
        (when_all((m.predicate == "eats") & (m.object == "worms"), name="bird").rule, [asserts(subject=m_.subject, predicate="is", object="bird") for m_ in [c.m]]),
        *((when_all((m.predicate == "is") & (m.object == a), name=a + b).rule, [asserts(subject=c.m.subject, predicate="is", object=b)]) for a, b in [("frog", "green"), ("chameleon", "grey"), ("bird", "black")]),
    ]
    out = closure(Messages(facts), program).df
    assert sorted((r.subject, r.object) for r in out.where("predicate = 'is'").collect()) == [("Greedy", "chameleon"), ("Greedy", "grey"), ("Kermit", "frog"), ("Kermit", "green"), ("Tweety", "bird"), ("Tweety", "black")]
    assert out.count() == 11
    with pytest.raises(ValueError):
        closure(Messages(facts), [(program[0][0], [Retract("first")])])


def test_firing_one_by_one(spark):
    x = messages(spark, [("0", "1", 1, "start", 1), ("0", "2", 2, "other", 1), ("1", "3", 3, "start", 1)])
    program = [
        (when_all(m.t == "start", name="go").rule, [asserts(t="next", v=c.m.v + 1), Retract("m")]),
        (when_all(c.n << m.t == "next", none_(m.t == "other"), name="end").rule, [asserts(t="done", v=c.n.v)]),
    ]
    now, fired = fire(x, program)
    assert sorted((r.sid, r.rule, r.nth) for r in fired.collect()) == [("0", "go", 1), ("1", "end", 2), ("1", "go", 1)]
    assert sorted((r.sid, r.t, r.v) for r in now.df.collect()) == [("0", "next", 2), ("0", "other", 1), ("1", "done", 2), ("1", "next", 2)]


def test_facts_and_state(spark):
    x = messages(spark, [("0", "1", 1, "a", 1), ("0", "1", 2, "a", 1), ("0", "2", 3, "b", 2), ("1", "1", 4, "a", 3)])
    first, again = observed(x)
    assert first.df.count() == 3 and [r.seq for r in again.collect()] == [2]
    gone = retracted(first, spark.createDataFrame([("0", "2"), ("0", "nope")], "sid string, mid string"))
    assert sorted(r.seq for r in gone.df.collect()) == [1, 4]
    assert sorted((r.sid, r.seq) for r in latest_state(x).df.collect()) == [("0", 3), ("1", 4)]
    assert [r.sid for r in emptied(none_(m.t == "b").__class__("b", (m.t == "b")), first, gone).collect()] == ["0"]
    assert without_contexts(x, spark.createDataFrame([("0",)], "sid string")).df.count() == 1
    assert union(x, x).df.count() == 8
    rule = when_all(c.st << s.t == "b", c.now << (m.v < s.v)).rule
    assert sorted(r.mid for r in match(rule, x, latest_state(x)).select("now.mid").collect()) == ["1", "1"]


def test_changes_and_replay(spark):
    a = messages(spark, [("0", "1", 1, "a", 1), ("0", "2", 2, "b", 2)])
    b = messages(spark, [("0", "2", 2, "b", 2), ("1", "2", 3, "a", 3)])
    assert sorted(map(tuple, changes(a, b).collect())) == [("delete", "0", "1"), ("store", "1", "2")]
    log = spark.createDataFrame([("store", "0", "1", 1), ("store", "0", "2", 2), ("delete", "0", "1", 3)], "action string, sid string, mid string, seq long")
    assert [r.mid for r in replayed(Messages(log)).df.collect()] == ["2"]


def test_actions_ask_for_effects(spark):
    x = messages(spark, [("0", "1", 1, "a", 5), ("0", "2", 2, "b", 7), ("1", "3", 3, "b", 1)])
    productions = [when_all(m.t == "a", name="one").rule, when_all(c.x << m.t == "b", name="two").rule, when_all(m.t == "b", name="silent").rule]

    def one(ctx):
        ctx.assert_fact({"v": ctx.m.v + 1})
        ctx.post("other", {"v": 0})
        ctx.s.count = ctx.s.get("count", 0) + 1
        ctx.start_timer("T", 5)

    def two(ctx):
        ctx.retract_fact({"id": ctx.x.mid})
        if ctx.x.v == 1:
            raise ValueError("one")

    state = spark.createDataFrame([("0", 4)], "sid string, count long")
    out = effects_of(agenda(productions, x, keep=["v"]), {"one": one, "two": chained(two)}, state).collect()
    said = sorted(((r.sid, r.rule, r.nth, r.kind, r.ruleset, r.payload, r.error) for r in out), key=str)
    assert [r[3] for r in said if r[1] == "one"] == ["fact", "event", "start_timer", "state"]
    assert ("0", "one", 0, "fact", None, '{"v": 6}', None) in said and ("0", "one", 1, "event", "other", '{"v": 0}', None) in said and ("0", "one", 3, "state", None, '{"count": 5}', None) in said
    assert ("1", "two", 1, "error", None, None, "ValueError: one") in said and ("0", "two", 0, "retract", None, '{"id": "2"}', None) in said


def test_groups_refer_across_their_edges(spark):
    rows = rows_of(30, 5)
    x = messages(spark, rows)
    rule = when_all(c.x << m.t == "a", c.g << all_(c.p << (m.v > c.x.v), c.q << (m.v == c.p.v)), c.z << (m.t == "c") & (m.v < c.q.v)).rule
    got = sorted(tuple(r) for r in match(rule, x).select("sid", "x.mid", "g__p.mid", "g__q.mid", "z.mid").collect())
    want = sorted((a[0], a[1], p[1], q[1], z[1]) for a in rows if a[3] == "a" for p in rows if p[0] == a[0] and compare("gt", p[4], a[4]) for q in rows if q[0] == a[0] and q[1] != p[1] and compare("eq", q[4], p[4]) for z in rows if z[0] == a[0] and z[3] == "c" and z[1] != a[1] and compare("gt", q[4], z[4]))
    assert got == want and want
    late = when_all(c.x << m.t == "a", c.e << any_(c.p << (m.t == "b") & (m.v == c.x.v), all_(c.q << m.t == "c", c.r << (m.v == c.x.v)))).rule
    got = sorted((tuple(r) for r in match(late, x).select("sid", "x.mid", "e__p.mid", "e__m_1__q.mid", "e__m_1__r.mid").collect()), key=str)
    want = []
    for a in (r for r in rows if r[3] == "a"):
        same = [r for r in rows if r[0] == a[0]]
        ps = [None, *(p[1] for p in same if p[3] == "b" and compare("eq", p[4], a[4]))]
        qs = [(None, None), *((q[1], r[1]) for q in same if q[3] == "c" for r in same if r[1] != q[1] and compare("eq", r[4], a[4]))]
        want += [(a[0], a[1], p, *q) for p in ps for q in qs if p or q[0]]
    assert got == sorted(want, key=str) and want


def test_any_of_eight(spark):
    x = messages(spark, [("0", str(k), k, "abc"[k % 3], k) for k in range(8)] + [("1", "9", 9, "a", 3)])
    out = match(when_any(*(m.v == k for k in range(8))).rule, x)
    assert out.where("sid = '0'").count() == 2**8 - 1 and out.where("sid = '1'").count() == 1


def test_identities_of_json_messages(spark):
    df = spark.createDataFrame([(1, '{"sid":"1","a":{"id":1}}'), (2, '{"sid":"1","a":{"id":2}}'), (3, '{"a":{"id":1},"sid":"1"}'), (4, '{"sid":"1","t":"\\"id\\":5,"}'), (5, '{"sid":"1","t":"\\"id\\":6,"}')], "n long, j string")
    x = from_json(df, "j", "n")
    first, again = observed(x)
    assert [r.seq for r in again.collect()] == [3] and sorted(r.seq for r in first.df.collect()) == [1, 2, 4, 5]


def test_derived_facts_need_text_ids(spark):
    x = Messages(spark.createDataFrame([("0", 1, 1, "a")], "sid string, mid long, seq long, t string"))
    with pytest.raises(RuleError):
        closure(x, [(when_all(m.t == "a").rule, [asserts(t="b")])])


def test_json_messages(spark):
    df = spark.createDataFrame([(1, '{"sid": 3, "a": {"b": 5}}'), (2, '{"a": {"b": 6}, "id": "x"}'), (3, "nope"), (4, '{"a": {"b": 5}, "sid": 3}'), (5, "[1]")], "n long, j string")
    x = from_json(df, "j", "n")
    rows = {r.seq: (r.sid, r.mid) for r in x.df.select("sid", "mid", "seq").collect()}
    assert set(rows) == {1, 2, 4} and rows[2] == ("0", "x") and rows[1] == rows[4] and rows[1][0] == "3"
    assert [r.mid for r in match(when_all(m.a.b > 5).rule, x).select("m.mid").collect()] == ["x"]


@pytest.mark.parametrize("seed", range(4))
def test_pairs_against_stacks(spark, seed):
    rows = rows_of(80, seed, 4)
    want = []
    for sid in {r[0] for r in rows}:
        stack = []
        for r in (r for r in rows if r[0] == sid and r[3] in "ab"):
            if stack and stack[-1][3] != r[3]:
                o = stack.pop()
                a, b = (r, o) if r[3] == "a" else (o, r)
                want.append((sid, a[1], b[1], r[2]))
            else:
                stack.append(r)
    x = messages(spark, rows)
    assert sorted(map(tuple, lifo_pairs(x, m.t == "a", m.t == "b").collect())) == sorted(want)
    rule = when_all(c.a << m.t == "a", c.b << m.t == "b").rule
    once = consumed_once(agenda([rule], x)).collect()
    assert sorted((r.sid, *r.mids, r["at"]) for r in once) == sorted(want)


def test_consume_once_of_several_rules(spark):
    x = messages(spark, [("0", "1", 1, "a", 50), ("0", "2", 2, "a", 200), ("0", "3", 3, "a", 251)])
    rule = when_all(c.first << m.v < 100, c.second << m.v > 100, c.third << (m.v > c.first.v + c.second.v), name="r").rule
    assert [list(r.mids) for r in consumed_once(agenda([rule], x)).collect()] == [["1", "2", "3"]]


def test_charts(spark):
    chart = (
        Chart("expense")
        .state("input", Trigger("denied", (m.t == "a") & (m.v > 3), name="deny"), Trigger("pending", (m.t == "a") & (m.v <= 3), name="request"))
        .state("pending", Trigger("approved", m.t == "b", name="approve"), Trigger("denied", m.t == "c", name="reject"))
        .state("approved")
        .state("denied")
    )
    assert chart.initial() == "input"
    x = messages(spark, [("0", "1", 1, "a", 1), ("0", "2", 2, "b", 0), ("1", "3", 3, "c", 0), ("1", "4", 4, "a", 2), ("2", "5", 5, "a", 9), ("2", "6", 6, "b", 9)])
    moves = lambda p: sorted((r.sid, r.nth, r.to_state, r.mid) for r in run_chart(x, chart, pending=p).collect())
    assert moves(True) == [("0", 1, "pending", "1"), ("0", 2, "approved", "2"), ("1", 1, "pending", "4"), ("1", 2, "denied", "3"), ("2", 1, "denied", "5")]
    assert moves(False) == [("0", 1, "pending", "1"), ("0", 2, "approved", "2"), ("1", 1, "pending", "4"), ("2", 1, "denied", "5")]
    assert sorted(map(tuple, current_states(run_chart(x, chart)).collect())) == [("0", "approved"), ("1", "denied"), ("2", "denied")]
    assert {(r.sid, r.stage) for r in run_flow(x, chart).where("nth = 0").collect()} == {(k, "input") for k in "012"}


def brute_chart(rows, table, start):
    """Messages one by one; all that wait are looked at again after each step, the newest first."""
    out = []
    for sid in sorted({r[0] for r in rows}):
        state, nth, waiting = start, 0, []
        for r in sorted((r for r in rows if r[0] == sid), key=lambda r: r[2]):
            waiting.append(r)
            moved = True
            while moved:
                moved = False
                for holds, to, name in table[state]:
                    hit = next((w for w in reversed(waiting) if holds(w)), None)
                    if hit:
                        waiting.remove(hit)
                        nth += 1
                        out.append((sid, nth, state, to, name, hit[1]))
                        state, moved = to, True
                        break
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_waiting_messages_against_brute_force(spark, seed):
    rows = rows_of(150, seed, 5)
    chart = Chart("x").state("a", Trigger("b", m.t == "a", name="one"), Trigger("c", (m.t == "b") & (m.v > 2), name="two")).state("b", Trigger("a", (m.t == "b") | (m.v == 1), name="back"), Trigger("b", m.t == "c", name="stay")).state("c", Trigger("b", m.v == 3, name="up"), Trigger("d", m.v == 0, name="end")).state("d")
    chart.initial = lambda: "a"
    is_ = lambda t: lambda r: r[3] == t
    v = lambda n: lambda r: r[4] == n
    table = {"a": [(is_("a"), "b", "one"), (lambda r: r[3] == "b" and (r[4] or 0) > 2, "c", "two")], "b": [(lambda r: r[3] == "b" or r[4] == 1, "a", "back"), (is_("c"), "b", "stay")], "c": [(v(3), "b", "up"), (v(0), "d", "end")], "d": []}
    got = sorted(map(tuple, run_chart(messages(spark, rows), chart).select("sid", "nth", "from_state", "to_state", "trigger", "mid").collect()))
    assert got == brute_chart(rows, table, "a") and got


def test_triggers_of_several_patterns(spark):
    x = messages(spark, [("0", "1", 1, "a", 1), ("0", "2", 2, "b", 2), ("0", "3", 3, "b", 1), ("0", "4", 4, "c", 0), ("0", "5", 5, "c", 0), ("0", "6", 6, "c", 0), ("1", "7", 7, "b", 4), ("1", "8", 8, "a", 4), ("1", "9", 9, "c", 0)])
    pair = when_all(c.x << m.t == "a", c.y << (m.t == "b") & (m.v == c.x.v), name="pair").rule
    seen = []
    chart = Chart("p").state("s", Trigger("t", pair, name="pair")).state("t", Trigger("u", when_all(m.t == "c", count(2), name="two").rule, name="two")).state("u", Trigger("v", when_all(m.t == "c", cap(5), name="rest").rule, name="rest", run=lambda ctx: ctx.post({"from": ctx.m.mid}))).state("v")
    moves = run_chart(x, chart)
    got = sorted((r.sid, r.trigger, r.mid, sorted(r.mids)) for r in moves.collect())
    assert got == [("0", "pair", "3", ["1", "3"]), ("0", "rest", "6", ["6"]), ("0", "two", "5", ["4", "5"]), ("1", "pair", "8", ["7", "8"])] and not seen
    assert [r.payload for r in effects_of_chart(moves, x, chart).collect()] == ['{"from": "6"}']
    j = definitions.ruleset("w$state", {"s": {"pair": {"to": "t", "all": [{"x": {"t": "a"}}, {"y": {"$and": [{"t": "b"}, {"v": {"x": "v"}}]}}]}}, "t": {"two": {"to": "u", "all": [{"m": {"t": "c"}}], "count": 2}}, "u": {"any": {"to": "v", "any": [{"p": {"t": "c"}}, {"q": {"t": "a"}}]}}, "v": {}})
    assert sorted((r.sid, r.trigger, r.mid) for r in run_chart(x, j).collect()) == [("0", "any", "6"), ("0", "pair", "3"), ("0", "two", "5"), ("1", "pair", "8")]


def test_nested_states_and_checks(spark):
    chart = Chart("worker").state("work", Trigger("canceled", m.t == "c", pri=1, name="cancel")).state("work.enter", Trigger("work.process", m.t == "a", name="enter")).state("work.process", Trigger("work.process", m.t == "b", name="go_on")).state("canceled")
    assert chart.initial() == "work.enter"
    x = messages(spark, [("0", str(k), k, t, 0) for k, t in enumerate("abbc")])
    assert [(r.trigger, r.to_state) for r in run_chart(x, chart).orderBy("nth").collect()] == [("enter", "work.process"), ("go_on", "work.process"), ("go_on", "work.process"), ("cancel", "canceled")]
    with pytest.raises(RuleError):
        Chart("two").state("a").state("b").initial()
    with pytest.raises(RuleError):
        Chart("no").state("a", Trigger("zzz", m.t == "a")).initial()
    j = definitions.ruleset("w$state", {"start": {"t1": {"to": "end", "all": [{"m": {"t": "a"}}]}}, "end": {}})
    assert [r.to_state for r in run_chart(x, j).collect()] == ["end"]


def test_timeout_is_a_join(spark):
    rows = spark.createDataFrame([("0", "1", 1, "T", 5, None), ("0", "p", 2, None, None, 9), ("1", "2", 3, "T", 50, None), ("1", "q", 4, None, None, 9)], "sid string, mid string, seq long, timer_name string, base_time long, time long")
    assert [r.sid for r in match(when_all(timeout("T")).rule, Messages(rows)).collect()] == ["0"]


def test_empty_tables(spark):
    x = messages(spark, [])
    rule = when_all(c.a << m.t == "a", c.b << (m.v > c.a.v), none_(m.t == "z")).rule
    assert match(rule, x).count() == 0 and first_to_fire(agenda([rule], x)).count() == 0 and lifo_pairs(x, m.t == "a", m.t == "b").count() == 0
    chart = Chart("x").state("a", Trigger("b", m.t == "a")).state("b")
    assert run_chart(x, chart).count() == 0 and closure(x, [(when_all(m.t == "a").rule, [asserts(t="b")])]).df.count() == 0


def dealt_rules():
    """Rules whose joins are dealt: products, equalities, groups, `any` of groups, none."""
    a, b, k = m.t == "a", m.t == "b", m.t == "c"
    return [
        (when_all(c.x << a, c.y << b, c.z << k & (m.v > c.y.v)).rule, ["x", "y", "z"]),
        (when_all(c.x << +m.v, c.y << (m.v == c.x.v), none_(k & (m.v > c.y.v))).rule, ["x", "y"]),
        (when_any(c.p << all_(c.x << a, c.y << b), c.q << all_(c.x << b, c.y << k)).rule, ["p__x", "p__y", "q__x", "q__y"]),
        (when_all(c.x << a, c.e << any_(c.p << b, c.q << (m.v == c.x.v))).rule, ["x", "e__p", "e__q"]),
        (when_all(c.x << a, c.g << all_(c.p << (m.v > c.x.v), c.q << (m.v == c.p.v)), c.z << k & (m.v < c.q.v)).rule, ["x", "g__p", "g__q", "z"]),
    ]


@pytest.mark.parametrize("sent", [0, 1 << 18])
def test_dealt_joins_find_the_same(spark, monkeypatch, sent):
    x = messages(spark, rows_of(40, 5, sids=2))
    got = lambda rule, names: sorted((tuple(r) for r in match(rule, x).select("sid", *(F.col(f"{n}.mid").alias(n) for n in names)).collect()), key=str)
    plain = [got(rule, names) for rule, names in dealt_rules()]
    monkeypatch.setattr("ruleloom.operators.match.TASK_ROWS", 20)
    monkeypatch.setattr("ruleloom.operators.match.SENT_ROWS", sent)
    monkeypatch.setattr("ruleloom.operators.match.MOST_TASKS", 5)
    assert [got(rule, names) for rule, names in dealt_rules()] == plain


def test_no_task_makes_all_rows_of_a_context(spark, monkeypatch):
    """A context's products are dealt to tasks however few bytes their inputs have."""
    monkeypatch.setattr("ruleloom.operators.match.TASK_ROWS", 5000, raising=False)
    x = messages(spark, [("0", f"m{k}", k, "abc"[k % 3], k) for k in range(120)])
    of = lambda n, t: getattr(c, n) << m.t == t
    for rule, n in ((when_all(of("x", "a"), of("y", "b"), of("z", "c")).rule, 64_000), (when_any(all_(of("x", "a"), of("y", "b")), of("z", "c")).rule, 1600 * 41 + 40)):
        made = [r["count"] for r in match(rule, x).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(made) == n and max(made) < 15_000


def test_counted_as_listed(spark):
    """Overlapping patterns, repeated and missing identities, contexts without matches."""
    r = random.Random(7)
    x = messages(spark, [(r.choice(["0", "1", None]), r.choice([None, *(f"m{k}" for k in range(5))]), k, r.choice("abc"), r.choice([None, *range(5)])) for k in range(24)] + [("2", "m0", 30, "a", 1)])
    one, two, three = c.x << m.t == "a", c.y << (m.v > 1), c.z << (m.t == "b") & (m.v < 4)
    for kind in (when_all, when_any):
        for elements in ([one], [one, two], [one, two, three], [one, two, three, distinct(False)], [one, c.y << (m.v > c.x.v)]):
            rule = kind(*elements).rule
            listed = match(rule, x).groupBy("sid").agg(F.count("*").alias("n"))
            assert sorted(map(tuple, counted(rule, x).collect()), key=str) == sorted(map(tuple, listed.collect()), key=str)


def test_counted_beyond_listing(spark):
    """16 million million combinations, of which none is made."""
    x = Messages(spark.range(8000).selectExpr("'0' AS sid", "CAST(id AS string) AS mid", "id AS seq", "id % 4 AS v"))
    rule = when_any(*(m.v == k for k in range(4))).rule
    assert [tuple(r) for r in counted(rule, x).collect()] == [("0", 2001**4 - 1)]


@pytest.mark.parametrize("read", [1, 32])
def test_firing_reads_only_contexts_that_go_on(spark, monkeypatch, read):
    """Facts of contexts that are done, and those that no pattern takes, are kept but not written in each round."""
    from ruleloom.operators import chain

    monkeypatch.setattr(chain, "TABLES_READ", read, raising=False)
    sizes, written = [], chain.written
    monkeypatch.setattr(chain, "written", lambda df, label: (out := written(df, label), label == "facts" and sizes.append(out.count()))[0])
    rows = [(str(k), f"m{k}", k, "other" if k else "start", 5) for k in range(50)] + [("0", "m0", 60, "other", 9), ("0", "m60", 61, "other", 9)]
    program = [(when_all((m.t == "start") & (m.v > 0), name="down").rule, [asserts(t="start", v=c.m.v - 1), Retract("m")])]
    now, fired = fire(messages(spark, rows), program)
    assert sorted((r.sid, r.nth) for r in fired.collect()) == [("0", k) for k in range(1, 6)]
    assert sorted((r.sid, r.t, r.v) for r in now.df.collect()) == sorted([("0", "start", 0), ("0", "other", 9), *((str(k), "other", 5) for k in range(1, 50))])
    assert sizes == [52, 1, 1, 1, 1, 1]


def spread_of(spark, monkeypatch, rule, task) -> list[int]:
    """Rows of each task for 120 messages of one context, if a task may make this many."""
    monkeypatch.setattr("ruleloom.operators.match.TASK_ROWS", task, raising=False)
    x = messages(spark, [("0", f"m{k}", k, "abc"[k % 3], k) for k in range(120)])
    return [r["count"] for r in match(rule, x).groupBy(F.spark_partition_id()).count().collect()]


def test_group_with_edges_is_dealt(spark, monkeypatch):
    rule = when_all(c.x << (m.t == "a") & (m.v > 90), c.g << all_(c.p << (m.t == "b") & (m.v > c.x.v), c.q << (m.t == "c") & (m.v > c.p.v)), c.z << (m.t == "a") & (m.v < c.q.v)).rule
    v = [range(k, 120, 3) for k in range(3)]
    n = sum(z < q and z != x for x in v[0] if x > 90 for p in v[1] if p > x for q in v[2] if q > p for z in v[0])
    made = spread_of(spark, monkeypatch, rule, 500)
    assert sum(made) == n and max(made) < n / 3


def test_group_of_products_is_dealt(spark, monkeypatch):
    rule = when_all(c.g << all_(c.x << m.t == "a", c.y << (m.t == "b") & (m.v > c.x.v)), c.z << m.t == "c").rule
    made = spread_of(spark, monkeypatch, rule, 3000)
    assert sum(made) == 820 * 40 and max(made) < 10_000


def test_any_within_all_is_dealt(spark, monkeypatch):
    rule = when_all(c.x << m.t == "a", c.e << any_(c.p << m.t == "b", c.q << m.t == "c")).rule
    made = spread_of(spark, monkeypatch, rule, 5000)
    assert sum(made) == 40 * (80 + 1600) and max(made) < 20_000


def test_any_of_two_is_dealt(spark, monkeypatch):
    rule = when_any(c.x << m.t == "a", c.y << m.t == "b").rule
    made = spread_of(spark, monkeypatch, rule, 200)
    assert sum(made) == 41 * 41 - 1 and max(made) < 800


def test_a_context_has_tasks_of_its_own(spark, monkeypatch):
    """What a task makes repeats messages of few contexts, of which its files need few bytes."""
    monkeypatch.setattr("ruleloom.operators.match.TASK_ROWS", 5000)
    x = messages(spark, [(str(s), f"m{s}_{k}", k, "abc"[k % 3], k) for s in range(4) for k in range(90)])
    rule = when_all(c.g << all_(c.x << m.t == "a", c.y << (m.t == "b")), c.z << m.t == "c").rule
    made = match(rule, x).groupBy(F.spark_partition_id()).agg(F.count("*"), F.count_distinct("sid")).collect()
    assert sum(r[1] for r in made) == 4 * 30**3 and max(r[1] for r in made) < 10_000 and all(r[2] == 1 for r in made)


def test_many_frames_are_not_moved(spark, monkeypatch):
    """Frames beyond a bound stay in the tasks that made them, which are many enough."""
    monkeypatch.setattr("ruleloom.operators.match.TASK_ROWS", 500)
    monkeypatch.setattr("ruleloom.operators.match.MOVED_ROWS", 1000, raising=False)
    x = messages(spark, [("0", f"m{k}", k, "abcd"[k % 4], k) for k in range(80)])
    rule = when_all(c.x << m.t == "a", c.y << (m.t == "b"), c.z << (m.t == "c") & (m.v > c.y.v), c.u << m.t == "d").rule
    found = match(rule, x)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    made = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 20 * 210 * 20 and max(made) < 3000 and len(made) > 40


def test_frames_of_joins_in_one_task_come_one_by_one(spark, monkeypatch):
    """Joins compiled as one would hold the product of what a frame makes in all of them."""
    monkeypatch.setattr("ruleloom.operators.match.TASK_ROWS", 500)
    monkeypatch.setattr("ruleloom.operators.match.MOVED_ROWS", 1000)
    x = messages(spark, [("0", f"m{k}", k, "abcd"[k % 4], k) for k in range(120)])
    row = when_all(c.x << m.t == "a", c.y << (m.t == "b"), c.z << (m.t == "c") & (m.v > c.y.v), c.u << m.t == "d").rule
    some = when_all(c.x << m.t == "a", c.z << m.t == "b", c.e << any_(c.y << m.t == "c", c.u << m.t == "d")).rule
    for rule, n in ((row, 30 * 465 * 30), (some, 30 * 30 * (31 * 31 - 1))):
        found = match(rule, x)
        assert len(found.collect()) == n
        joins = [at for at in found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "BroadcastHashJoin" in at]
        assert len(joins) > 1 and "*(" in joins[0] and not any("*(" in at for at in joins[1:-1] or joins[1:])


def test_frames_dealt_finely_are_counted_in_fewer_tasks(spark, monkeypatch):
    """Dealing is for the rows of the last join; a count of the frames before it is no work for as many tasks."""
    monkeypatch.setattr("ruleloom.operators.match.TASK_ROWS", 500)
    monkeypatch.setattr("ruleloom.operators.match.MOVED_ROWS", 1000)
    monkeypatch.setattr("ruleloom.operators.match.COUNT_TASKS", 3, raising=False)
    x = messages(spark, [("0", f"m{k}", k, "abcd"[k % 4], k) for k in range(120)])
    rule = when_all(c.x << m.t == "a", c.y << (m.t == "b"), c.z << (m.t == "c") & (m.v > c.y.v), c.u << m.t == "d").rule
    spark.sparkContext.setJobGroup("planned", "")
    found = match(rule, x)
    spark.sparkContext.setJobGroup("run", "")
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("planned") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    assert tasks and max(tasks) < 40
    made = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 30 * 465 * 30 and len(made) > 40


def test_groups_of_an_any_are_not_repeated(spark, monkeypatch):
    """A group's matches meet those of another as frames and single messages; none are copied for each task."""
    monkeypatch.setattr("ruleloom.operators.match.TASK_ROWS", 500)
    monkeypatch.setattr("ruleloom.operators.match.SENT_ROWS", 100)
    x = messages(spark, [("0", f"m{k}", k, "abcd"[k % 4], k) for k in range(80)])
    rule = when_any(c.p << all_(c.x << m.t == "a", c.y << m.t == "b"), c.q << all_(c.x << m.t == "c", c.y << (m.t == "d") & (m.v > c.x.v), none_((m.t == "a") & (m.v > c.y.v)))).rule
    found = match(rule, x)
    assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()
    n = sum(y > x and y > 76 for x in range(2, 80, 4) for y in range(3, 80, 4))
    rows = found.select(*(F.col(f"{g}__{k}.mid").alias(f"{g}{k}") for g in "pq" for k in "xy")).collect()
    assert n and len(rows) == len(set(rows)) == 401 * (n + 1) - 1
    made = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(made) < 2500


def test_rows_are_repeated_for_few_parts(spark, monkeypatch):
    """Parts of all keys together are as many as tasks may be, so that rows are not copied more often."""
    monkeypatch.setattr("ruleloom.operators.match.TASK_ROWS", 10)
    monkeypatch.setattr("ruleloom.operators.match.SENT_ROWS", 0)
    monkeypatch.setattr("ruleloom.operators.match.MOST_TASKS", 20)
    x = messages(spark, [(str(s), f"m{s}_{k}", k, "ab"[k % 2], k) for s in range(10) for k in range(60)])
    found = match(when_all(c.x << m.t == "a", c.y << m.t == "b").rule, x)
    sc = spark.sparkContext
    bus, store, none = sc._jsc.sc().listenerBus(), sc._jsc.sc().statusStore(), (None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    bus.waitUntilEmpty()
    before = store.stageList(*none).head().stageId()
    assert len(found.collect()) == 10 * 30 * 30
    bus.waitUntilEmpty()
    stages = store.stageList(*none)
    ran = [st for st in (stages.apply(k) for k in range(stages.size())) if st.stageId() > before]
    assert 0 < sum(st.shuffleWriteRecords() for st in ran) < 2000


def test_frames_whose_number_is_known_are_not_listed(spark, monkeypatch):
    """Where only equalities relate the messages, the pairs of one join are the frames of the next."""
    monkeypatch.setattr("ruleloom.operators.match.TASK_ROWS", 500)
    monkeypatch.setattr("ruleloom.operators.match.MOVED_ROWS", 1000)
    x = messages(spark, [("0", f"m{k}", k, "abcd"[k % 4], k % 7) for k in range(120)])
    a, b, c_, d = (m.t == t for t in "abcd")
    edges = when_all(c.x << a, c.y << b, c.z << c_ & (m.v == c.y.v), c.u << d & (m.v > c.z.v)).rule
    some = when_any(c.p << all_(c.x << a, c.y << b), c.q << all_(c.x << c_, c.y << d)).rule
    v = [[k % 7 for k in range(at, 120, 4)] for at in range(4)]
    monkeypatch.setattr("ruleloom.operators.match.COUNT_TASKS", 10_000)
    tracker = spark.sparkContext.statusTracker()
    for name, rule, n in (("edges", edges, 30 * sum(z == y and u > z for y in v[1] for z in v[2] for u in v[3])), ("some", some, 901 * 901 - 1)):
        spark.sparkContext.setJobGroup(name, "")
        found = match(rule, x)
        spark.sparkContext.setJobGroup("run", "")
        tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
        assert tasks and max(tasks) < 100
        made = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(made) == n and max(made) < n / 5


def test_group_of_equals_is_not_listed_before_its_product(spark, monkeypatch):
    """A group's pairs by an equality, then a pattern that meets all of them: planned without a task for the pairs."""
    monkeypatch.setattr("ruleloom.operators.match.TASK_ROWS", 500)
    monkeypatch.setattr("ruleloom.operators.match.MOVED_ROWS", 1000)
    monkeypatch.setattr("ruleloom.operators.match.COUNT_TASKS", 10_000)
    x = messages(spark, [("0", f"m{k}", k, "abc"[k % 3], k % 5) for k in range(360)])
    rule = when_all(c.g << all_(c.x << m.t == "a", c.y << (m.t == "b") & (m.v == c.x.v)), c.z << m.t == "c").rule
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("pairs", "")
    found = match(rule, x)
    spark.sparkContext.setJobGroup("run", "")
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("pairs") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    assert tasks and max(tasks) < 20
    made = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 120 * 24 * 120 and len(made) == 30 and max(made) < 2 * 120 * 24 * 120 / 30
