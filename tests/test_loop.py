"""The firing loop: states, events, timers, errors and messages for other rule sets."""

import pytest
from pyspark.sql import functions as F

from ruleloom.operators import loop
from ruleloom.plans.dsl import c, m, pri, ruleset, s, timeout, when_all
from ruleloom.sources.messages import Messages

SCHEMA = "sid string, mid string, seq long, t string, v long, is_event boolean"
STATE = "sid string, mid string, seq long, n long, status string, exception string"


def fired(done):
    return sorted((r.sid, r.nth, r.rule) for r in done.fired.collect())


def test_states_events_errors_and_posts(spark):
    x = Messages(spark.createDataFrame([("0", "1", 1, "go", 5, True), ("0", "2", 2, "old", 1, False), ("1", "3", 3, "bad", 1, True)], SCHEMA))
    state = Messages(spark.createDataFrame([("0", "s", 0, 0, "new", None), ("1", "s", 0, 0, "new", None)], STATE))

    with ruleset("one") as r:

        @when_all(m.t == "go", pri(2), name="go")
        def go(ctx):
            ctx.s.n += ctx.m.v
            ctx.post({"t": "made", "v": ctx.m.v + 1})
            ctx.assert_fact({"t": "kept", "v": 9})
            ctx.retract_fact({"id": "2"})
            ctx.post("two", {"t": "sent", "v": 7})

        @when_all(c.x << m.t == "made", c.y << (m.v > c.x.v), name="made")
        def made(ctx):
            ctx.s.n += 100 * ctx.y.v
            ctx.s.status = "done"

        @when_all(m.t == "bad", name="bad")
        def bad(ctx):
            raise ValueError("no")

        @when_all(+s.exception, name="caught")
        def caught(ctx):
            ctx.s.status = ctx.s.exception
            ctx.s.exception = None

        @when_all(s.status == "done", name="end")
        def end(ctx):
            ctx.delete_state()

    with ruleset("two") as q:

        @when_all(m.t == "sent", name="got")
        def got(ctx):
            ctx.assert_fact({"t": "answer", "v": ctx.m.v * 2})

    other = Messages(spark.createDataFrame([], SCHEMA))
    out = loop.run_all({"one": r, "two": q}, {"one": x, "two": other}, {"one": state})
    one, two = out["one"][0], out["two"][-1]
    assert fired(one) == [("0", 1, "go"), ("0", 2, "made"), ("0", 3, "end"), ("1", 1, "bad"), ("1", 2, "caught")]
    assert [(x.sid, x.status, x.exception) for x in one.state.df.collect()] == [("1", "ValueError: no", None)]
    assert one.messages.df.isEmpty()  # consumed, retracted, or gone with their context
    assert sorted((x.sid, x.t, x.v) for x in two.messages.df.collect()) == [("0", "answer", 14)] and fired(two) == [("0", 1, "got")]


def test_timers(spark):
    """One-shot, cancelled, restarted and manually reset timers on each context's own clock."""
    x = Messages(spark.createDataFrame([(k, "1", 1, "go", n, True) for k, n in (("once", 1), ("gone", 2), ("kept", 3))], SCHEMA).withColumn("timer_name", F.lit(None).cast("string")).withColumn("base_time", F.lit(None).cast("long")).withColumn("time", F.lit(None).cast("long")))
    state = Messages(spark.createDataFrame([(k, "s", 0, 0, None, None) for k in ("once", "gone", "kept")], STATE))

    with ruleset("t") as r:

        @when_all(m.t == "go", name="go")
        def go(ctx):
            ctx.start_timer("A", 3, manual_reset=ctx.m.v == 3)
            ctx.start_timer("B", 5)
            if ctx.m.v == 2:
                ctx.cancel_timer("C")
                ctx.post({"t": "stop"})

        @when_all(m.t == "stop", name="stop")
        def stop(ctx):
            ctx.cancel_timer("A")
            ctx.cancel_timer("B")

        @when_all(c.a << timeout("A"), name="a")
        def a(ctx):
            ctx.s.n += 1

        @when_all(c.b << timeout("B"), name="b")
        def b(ctx):
            ctx.s.n += 10
            ctx.cancel_timer("A")

    done = loop.run(r, x, state, until=20)
    # the kept one matches each new clock until it is cancelled: at 3 and at 5 (before or beside B)
    assert {q.sid: q.n for q in done.state.df.collect()} == {"once": 11, "gone": 0, "kept": 12}
    with pytest.raises(RuntimeError):
        loop.run(r, x, state, until=20, most=1)
