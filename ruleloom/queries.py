"""Registered queries: productions over the given tables, and the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators import loop
from ruleloom.operators import timers as tm
from ruleloom.operators.actions import effects_of
from ruleloom.operators.agenda import agenda, batched, batches_of, first_to_fire, firing_order
from ruleloom.operators.chain import asserts, closure, fire
from ruleloom.operators.events import consumed_once, lifo_pairs
from ruleloom.operators.flow import Chart, Trigger, run_chart, run_flow
from ruleloom.operators.match import counted, emptied, match, taken_by, unmatched
from ruleloom.plans.dsl import all_, any_, c, cap, count, distinct, item, m, none_, pri, ruleset, s, timeout, when_all, when_any
from ruleloom.sources import definitions
from ruleloom.sources.messages import Messages, changes, from_json, initial_states, latest_state, observed, pending_events, replayed, retracted
from ruleloom.sources.store import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> Messages:
    """Events by user, in order of arrival."""
    return Messages(read(spark, sf_dir, "events"), "user_id", "event_id", "event_id")


def orders(spark: SparkSession, sf_dir: str) -> Messages:
    """Orders by customer."""
    return Messages(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderkey")


def alone(df: DataFrame, key: str) -> Messages:
    """Rows that only meet conditions on themselves."""
    return Messages(df, key, key, key)


def own(rule, messages: Messages, *cols: str) -> DataFrame:
    """Matches of a rule of one pattern, as plain columns of its message."""
    return match(rule, messages, keep=list(cols)).select(*(F.col(f"m.{x}").alias(x) for x in cols))


# conditions on one message


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_totalprice > 100000 AND o_totalprice <= 400000")
def filter_rel_and_or(spark, d):
    rule = when_all(((m.o_orderstatus == "F") | (m.o_orderstatus == "O")) & (m.o_totalprice > 100000) & (m.o_totalprice <= 400000)).rule
    return own(rule, orders(spark, d), "o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity >= 10 AND l_quantity < 20")
def filter_neq_range(spark, d):
    rule = when_all((m.l_returnflag != "N") & (m.l_quantity >= 10) & (m.l_quantity < 20)).rule
    return own(rule, alone(read(spark, d, "lineitem"), "l_orderkey"), "l_orderkey", "l_linenumber", "l_quantity")


def labelled(spark, d) -> Messages:
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    return alone(docs.join(read(spark, d, "labels"), "doc_id", "left"), "doc_id")


@query("SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def filter_exists(spark, d):
    return own(when_all(+m.quality).rule, labelled(spark, d), "doc_id", "lang")


@query("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL")
def filter_not_exists(spark, d):
    return own(when_all(-m.toxic).rule, labelled(spark, d), "doc_id", "lang")


@query("SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL AND d.lang <> 'en'")
def null_test(spark, d):
    return own(when_all((m.quality == None) & (m.lang != "en")).rule, labelled(spark, d), "doc_id", "source")  # noqa: E711


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > l_quantity * 1000 + l_tax")
def same_row_arith(spark, d):
    rule = when_all(m.l_extendedprice > m.l_quantity * 1000 + m.l_tax).rule
    return own(rule, alone(read(spark, d, "lineitem"), "l_orderkey"), "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT p_partkey, p_size FROM part WHERE p_size // 7 = 3 OR p_size - 4 = 0")
def int_division(spark, d):
    return own(when_all((m.p_size / 7 == 3) | (m.p_size - 4 == 0)).rule, alone(read(spark, d, "part"), "p_partkey"), "p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE CAST(p_size AS VARCHAR) = '15' OR CAST(p_size AS VARCHAR) > '45'")
def compare_as_text(spark, d):
    return own(when_all((m.p_size == "15") | (m.p_size > "45")).rule, alone(read(spark, d, "part"), "p_partkey"), "p_partkey", "p_size")


def json_events(spark, d) -> Messages:
    """Events whose properties are one VARIANT column."""
    df = read(spark, d, "events")
    return Messages(df.select("user_id", "event_id", F.parse_json("props").alias("body")), "user_id", "event_id", "event_id", "body")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def nested_json(spark, d):
    found = match(when_all(m.k > 50).rule, json_events(spark, d))
    return found.select(F.col("m.event_id").alias("event_id"), F.try_variant_get("m.body", "$.k", "bigint").alias("k"))


@query("SELECT event_id FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND json_extract(props, '$.missing') IS NULL AND CAST(json_extract(props, '$.k') AS VARCHAR) >= '5'")
def variant_presence(spark, d):
    return match(when_all(+m.k & -m.missing & (m.k >= "5")).rule, json_events(spark, d)).select(F.col("m.event_id").alias("event_id"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '[a-z]+ (widget|ring|gear|bolt).{0,5}')")
def regex_full(spark, d):
    return own(when_all(m.p_name.matches("[z-a]+ (widget|ring|gear|bolt).{0,5}")).rule, alone(read(spark, d, "part"), "p_partkey"), "p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_full_match(lower(c_name), 'customer#0+[0-9]*7')")
def regex_icase(spark, d):
    return own(when_all(m.c_name.imatches("CUSTOMER#0+%d*7")).rule, alone(read(spark, d, "customer"), "c_custkey"), "c_custkey", "c_name")


@query("SELECT event_id, value FROM events WHERE regexp_full_match(printf('%f', value), '[0-9]+\\.[05]0{5}')")
def regex_coerce(spark, d):
    return own(when_all(m.value.matches("%d+%.[05]0{5}")).rule, events(spark, d), "event_id", "value")


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://') AND contains(url, '.example.') AND ends_with(url, '5')")
def regex_prefix_suffix(spark, d):
    rule = when_all(m.url.matches("https://.*") & m.url.matches(".*%.example%..*") & m.url.matches(".*5")).rule
    return own(rule, alone(read(spark, d, "pages").select("page_id", "url"), "page_id"), "page_id", "url")


@query("SELECT doc_id FROM documents WHERE regexp_full_match(text, '(?s)(([a-z]|[A-Z])+[ .,]+)*([^0-9 ]|[0-9]{2})*')")
def regex_repeated_groups(spark, d):
    """Repeated alternations over whole texts: matched in time linear in them."""
    docs = alone(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return own(when_all(m.text.matches("(([a-z]|[A-Z])+[ .,]+)*([^0-9 ]|[0-9]{2})*")).rule, docs, "doc_id")


def order_lines(spark, d) -> Messages:
    """Orders with an array of their lines."""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("qty"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"))).alias("lines"))
    return alone(lines, "l_orderkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_quantity > 10 AND l_returnflag <> 'R')")
def array_all(spark, d):
    return own(when_all(m.lines.allItems((item.qty > 10) & (item.flag != "R"))).rule, order_lines(spark, d), "l_orderkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_quantity * 2 > 98 OR l_discount = 0.1)")
def array_any(spark, d):
    return own(when_all(m.lines.anyItem((item.qty * 2 > 98) | (item.discount == 0.1))).rule, order_lines(spark, d), "l_orderkey")


@query("SELECT l_orderkey FROM (SELECT l_orderkey, l_returnflag, bool_and(l_quantity < 15) AS ok FROM lineitem GROUP BY ALL) GROUP BY l_orderkey HAVING bool_or(ok)")
def array_nested(spark, d):
    inner = read(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.collect_list("l_quantity").alias("q"))
    nested = alone(inner.groupBy("l_orderkey").agg(F.collect_list("q").alias("groups")), "l_orderkey")
    return own(when_all(m.groups.anyItem(item.allItems(item < 15))).rule, nested, "l_orderkey")


@query("SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, list(l_extendedprice) AS prices FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE len(list_filter(prices, lambda p: p > o_totalprice / 2)) > 0")
def array_outer_reference(spark, d):
    prices = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("prices"))
    both = read(spark, d, "orders").join(prices, F.col("o_orderkey") == F.col("l_orderkey"))
    return own(when_all(m.prices.anyItem(item > m.o_totalprice / 2)).rule, alone(both, "o_orderkey"), "o_orderkey")


# joins


@query("SELECT a.o_orderkey AS first_key, b.o_orderkey AS second_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey <> b.o_orderkey WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'")
def seq2_equi(spark, d):
    rule = when_all(c.first << (m.o_orderstatus == "F"), c.second << (m.o_orderstatus == "O") & (m.o_orderpriority == c.first.o_orderpriority)).rule
    return match(rule, orders(spark, d)).select(F.col("first.o_orderkey").alias("first_key"), F.col("second.o_orderkey").alias("second_key"))


@query("SELECT a.user_id AS sid, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.value > a.value * 2 AND a.event_id <> b.event_id WHERE a.event_type = 'purchase' AND b.event_type = 'purchase'")
def seq2_theta(spark, d):
    rule = when_all(c.first << (m.event_type == "purchase"), c.second << (m.event_type == "purchase") & (m.value > c.first.value * 2)).rule
    return match(rule, events(spark, d)).select("sid", F.col("first.event_id").alias("first_id"), F.col("second.event_id").alias("second_id"))


@query("SELECT a.event_id AS a_id, b.event_id AS b_id, x.event_id AS c_id FROM events a JOIN events b ON a.user_id = b.user_id JOIN events x ON x.user_id = a.user_id AND x.value > (a.value + b.value) / 2 WHERE a.event_type = 'signup' AND a.value > 100 AND b.event_type = 'purchase' AND b.value > 150 AND x.event_type = 'error'")
def seq3_arith(spark, d):
    rule = when_all(c.a << (m.event_type == "signup") & (m.value > 100), c.b << (m.event_type == "purchase") & (m.value > 150), c.c << (m.event_type == "error") & (m.value > (c.a.value + c.b.value) / 2)).rule
    return match(rule, events(spark, d)).select(F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"), F.col("c.event_id").alias("c_id"))


@query("SELECT a.o_orderkey AS first_key, b.o_orderkey AS second_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND (b.o_totalprice > a.o_totalprice * 20 OR (b.o_orderpriority = a.o_orderpriority AND b.o_orderstatus = a.o_orderstatus))")
def seq_or_corr(spark, d):
    rule = when_all(c.first << +m.o_totalprice, c.second << (m.o_totalprice > c.first.o_totalprice * 20) | ((m.o_orderpriority == c.first.o_orderpriority) & (m.o_orderstatus == c.first.o_orderstatus))).rule
    return match(rule, orders(spark, d)).select(F.col("first.o_orderkey").alias("first_key"), F.col("second.o_orderkey").alias("second_key"))


@query("SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.value >= a.value WHERE a.event_type = 'error' AND b.event_type = 'error'")
def distinct_off(spark, d):
    rule = when_all(c.first << (m.event_type == "error"), c.second << (m.event_type == "error") & (m.value >= c.first.value), distinct(False)).rule
    return match(rule, events(spark, d)).select(F.col("first.event_id").alias("first_id"), F.col("second.event_id").alias("second_id"))


@query("SELECT a.o_orderkey FROM orders a WHERE a.o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'O' AND b.o_totalprice > a.o_totalprice)")
def none_mid(spark, d):
    rule = when_all(c.first << (m.o_orderstatus == "F"), none_((m.o_orderstatus == "O") & (m.o_totalprice > c.first.o_totalprice))).rule
    return match(rule, orders(spark, d)).select(F.col("first.o_orderkey").alias("o_orderkey"))


@query("SELECT a.event_id AS first_id, b.event_id AS third_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id WHERE a.event_type = 'view' AND b.event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = a.user_id AND x.event_type = 'error' AND x.value > a.value) AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = a.user_id AND x.event_type = 'signup' AND x.event_id > a.event_id AND x.event_id < b.event_id)")
def none_multi(spark, d):
    rule = when_all(c.first << (m.event_type == "view"), none_((m.event_type == "error") & (m.value > c.first.value)), c.third << (m.event_type == "purchase") & (m.event_id > c.first.event_id), none_((m.event_type == "signup") & (m.event_id > c.first.event_id) & (m.event_id < c.third.event_id))).rule
    return match(rule, events(spark, d)).select(F.col("first.event_id").alias("first_id"), F.col("third.event_id").alias("third_id"))


@query("SELECT user_id AS sid FROM events GROUP BY user_id HAVING bool_or(event_type = 'error' AND value > 100 AND event_id % 3 <> 0) AND NOT bool_or(event_type = 'error' AND value > 100 AND event_id % 3 = 0)")
def none_emptied(spark, d):
    before = events(spark, d)
    after = retracted(before, before.df.where("event_id % 3 <> 0"))
    return emptied(when_all(none_((m.event_type == "error") & (m.value > 100))).rule.when.elements[0], before, after)


# groups


def by_nation(spark, d) -> Messages:
    """Customers and suppliers of a nation in one context."""
    cust = read(spark, d, "customer").select(F.col("c_nationkey").alias("sid"), F.concat(F.lit("c"), "c_custkey").alias("mid"), F.col("c_custkey").alias("seq"), F.lit("customer").alias("t"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    supp = read(spark, d, "supplier").select(F.col("s_nationkey").alias("sid"), F.concat(F.lit("s"), "s_suppkey").alias("mid"), F.col("s_suppkey").alias("seq"), F.lit("supplier").alias("t"), F.col("s_acctbal").alias("bal"), F.lit(None).cast("string").alias("segment"))
    return Messages(cust.unionByName(supp))


NATION = "SELECT c_nationkey AS sid, 'c' || c_custkey AS mid, 'customer' AS t, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_nationkey, 's' || s_suppkey, 'supplier', s_acctbal, NULL FROM supplier"


@query(f"WITH n AS ({NATION}) SELECT a.mid AS a_mid, b.mid AS b_mid, x.mid AS c_mid FROM n a JOIN n b ON a.sid = b.sid AND a.mid <> b.mid AND b.segment = a.segment JOIN n x ON x.sid = a.sid WHERE a.t = 'customer' AND a.bal > 9500 AND b.t = 'customer' AND b.bal < -500 AND x.t = 'supplier' AND x.bal > 5000")
def group_all(spark, d):
    rule = when_all(c.pair << all_(c.a << (m.t == "customer") & (m.bal > 9500), c.b << (m.t == "customer") & (m.bal < -500) & (m.segment == c.a.segment)), c.x << (m.t == "supplier") & (m.bal > 5000)).rule
    return match(rule, by_nation(spark, d)).select(F.col("pair__a.mid").alias("a_mid"), F.col("pair__b.mid").alias("b_mid"), F.col("x.mid").alias("c_mid"))


@query(f"WITH n AS ({NATION}), a AS (SELECT sid, mid FROM n WHERE t = 'customer' AND bal > 9000), b AS (SELECT sid, mid FROM n WHERE t = 'supplier' AND bal > 6000) SELECT mid AS a_mid, NULL AS b_mid, sid FROM a UNION ALL SELECT NULL, mid, sid FROM b UNION ALL SELECT a.mid, b.mid, a.sid FROM a JOIN b USING (sid)")
def any_combo(spark, d):
    rule = when_any(c.a << (m.t == "customer") & (m.bal > 9000), c.b << (m.t == "supplier") & (m.bal > 6000)).rule
    return match(rule, by_nation(spark, d)).select(F.col("a.mid").alias("a_mid"), F.col("b.mid").alias("b_mid"), "sid")


@query(f"WITH n AS ({NATION}), p AS (SELECT a.sid, a.mid AS a, b.mid AS b FROM n a JOIN n b ON a.sid = b.sid AND a.mid <> b.mid WHERE a.t = 'customer' AND a.bal > 9600 AND b.t = 'supplier' AND b.bal > 8000), q AS (SELECT a.sid, a.mid AS a, b.mid AS b FROM n a JOIN n b ON a.sid = b.sid AND a.mid <> b.mid WHERE a.t = 'customer' AND a.bal < -900 AND b.t = 'supplier' AND b.bal < 2000) SELECT sid, a AS p_a, b AS p_b, NULL AS q_a, NULL AS q_b FROM p UNION ALL SELECT sid, NULL, NULL, a, b FROM q UNION ALL SELECT p.sid, p.a, p.b, q.a, q.b FROM p JOIN q USING (sid)")
def any_of_alls(spark, d):
    rule = when_any(c.p << all_(c.a << (m.t == "customer") & (m.bal > 9600), c.b << (m.t == "supplier") & (m.bal > 8000)), c.q << all_(c.a << (m.t == "customer") & (m.bal < -900), c.b << (m.t == "supplier") & (m.bal < 2000))).rule
    return match(rule, by_nation(spark, d)).select("sid", *(F.col(f"{g}__{x}.mid").alias(f"{g}_{x}") for g in "pq" for x in "ab"))


@query(f"WITH n AS ({NATION}) SELECT x.mid AS x_mid, a.mid AS a_mid, b.mid AS b_mid, y.mid AS y_mid FROM n x JOIN n a ON a.sid = x.sid AND a.bal > x.bal JOIN n b ON b.sid = x.sid AND a.mid <> b.mid AND b.segment = a.segment JOIN n y ON y.sid = x.sid AND y.mid <> x.mid AND y.bal > b.bal + 9000 WHERE x.t = 'supplier' AND x.bal > 9000 AND a.t = 'customer' AND b.t = 'customer' AND b.bal < 0 AND y.t = 'supplier'")
def group_edges(spark, d):
    """A group that refers to an earlier pattern, and a later pattern that refers into the group."""
    inside = all_(c.a << (m.t == "customer") & (m.bal > c.x.bal), c.b << (m.t == "customer") & (m.bal < 0) & (m.segment == c.a.segment))
    rule = when_all(c.x << (m.t == "supplier") & (m.bal > 9000), c.pair << inside, c.y << (m.t == "supplier") & (m.bal > c.b.bal + 9000)).rule
    return match(rule, by_nation(spark, d)).select(F.col("x.mid").alias("x_mid"), F.col("pair__a.mid").alias("a_mid"), F.col("pair__b.mid").alias("b_mid"), F.col("y.mid").alias("y_mid"))


@query(f"WITH n AS ({NATION}), k AS (SELECT sid, CAST(floor(bal / 1000) AS INT) AS b, count(*) AS c FROM n WHERE t = 'supplier' AND bal >= 6000 AND bal < 10000 GROUP BY ALL) SELECT sid, CAST(round(exp(sum(ln(c + 1)))) - 1 AS BIGINT) AS n FROM k GROUP BY sid")
def any_of_many(spark, d):
    """All combinations of four elements, counted: each is left out or is any of its messages."""
    parts = [(m.t == "supplier") & (m.bal >= 1000 * k) & (m.bal < 1000 * (k + 1)) for k in range(6, 10)]
    return counted(when_any(*parts).rule, by_nation(spark, d))


@query(f"WITH n AS ({NATION}), f AS (SELECT sid, mid FROM n WHERE t = 'supplier' AND bal > 9000), a AS (SELECT sid, mid FROM n WHERE t = 'customer' AND bal > 9700), b AS (SELECT sid, mid FROM n WHERE t = 'customer' AND bal < -950), e AS (SELECT mid AS a, NULL AS b, sid FROM a UNION ALL SELECT NULL, mid, sid FROM b UNION ALL SELECT a.mid, b.mid, sid FROM a JOIN b USING (sid)) SELECT f.mid AS x_mid, e.a AS a_mid, e.b AS b_mid FROM f JOIN e USING (sid)")
def all_of_anys(spark, d):
    rule = when_all(c.x << (m.t == "supplier") & (m.bal > 9000), c.e << any_(c.a << (m.t == "customer") & (m.bal > 9700), c.b << (m.t == "customer") & (m.bal < -950))).rule
    return match(rule, by_nation(spark, d)).select(F.col("x.mid").alias("x_mid"), F.col("e__a.mid").alias("a_mid"), F.col("e__b.mid").alias("b_mid"))


# agenda


def three_productions() -> list:
    return [
        when_all((m.event_type == "purchase") & (m.value > 50), pri(3), name="big").rule,
        when_all((m.event_type == "error") & (m.value > 200), pri(1), name="alarm").rule,
        when_all(m.event_type == "view", pri(2), name="seen").rule,
    ]


PICKED = "SELECT user_id AS sid, event_id, CASE WHEN event_type = 'purchase' AND value > 50 THEN 'big' WHEN event_type = 'error' AND value > 200 THEN 'alarm' WHEN event_type = 'view' THEN 'seen' END AS rule, CASE WHEN event_type = 'purchase' THEN 3 WHEN event_type = 'error' THEN 1 ELSE 2 END AS pri FROM events"


@query(f"SELECT sid, rule, event_id FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY pri, event_id DESC) AS n FROM ({PICKED}) WHERE rule IS NOT NULL) WHERE n = 1")
def agenda_pri(spark, d):
    return first_to_fire(agenda(three_productions(), events(spark, d))).select("sid", "rule", F.col("at").alias("event_id"))


@query(f"SELECT sid, rule, event_id, row_number() OVER (PARTITION BY sid ORDER BY pri, event_id DESC) AS nth FROM ({PICKED}) WHERE rule IS NOT NULL")
def agenda_recency(spark, d):
    return firing_order(agenda(three_productions(), events(spark, d))).select("sid", "rule", F.col("at").alias("event_id"), F.col("nth").cast("long").alias("nth"))


@query("SELECT user_id AS sid, CAST(b AS BIGINT) AS batch, count(*) AS size, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 3 AS b FROM events WHERE value < 100) GROUP BY ALL HAVING count(*) = 3")
def batch_count3(spark, d):
    rule = when_all(m.value < 100, count(3), name="approve").rule
    return _ends(batches_of(rule, events(spark, d)))


@query("SELECT user_id AS sid, CAST(b AS BIGINT) AS batch, count(*) AS size, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 2 AS b FROM events WHERE event_type = 'error') GROUP BY ALL")
def batch_cap2(spark, d):
    rule = when_all(m.event_type == "error", cap(2), name="reject").rule
    return _ends(batches_of(rule, events(spark, d)))


def _ends(b: DataFrame) -> DataFrame:
    return b.select("sid", F.col("batch").cast("long").alias("batch"), "size", F.element_at("matches", -1)["at"].alias("first_id"), F.element_at("matches", 1)["at"].alias("last_id"))


@query("SELECT a.user_id AS sid, a.event_id AS first_id, max(b.event_id) AS second_id, count(*) AS size FROM (SELECT user_id, event_id FROM events WHERE event_type = 'signup') a JOIN (SELECT user_id, event_id FROM events WHERE event_type = 'error' AND value > 150) b ON a.user_id = b.user_id AND b.event_id > a.event_id GROUP BY ALL")
def batch_of_joins(spark, d):
    rule = when_all(c.first << (m.event_type == "signup"), c.second << (m.event_type == "error") & (m.value > 150) & (m.event_id > c.first.event_id), name="pairs").rule
    pairs = match(rule, events(spark, d))
    return pairs.groupBy("sid", F.col("first.event_id").alias("first_id")).agg(F.max("second.event_id").alias("second_id"), F.count("*").alias("size"))


@query("SELECT event_id, event_type FROM events WHERE NOT (event_type = 'purchase' AND value > 50) AND NOT (event_type = 'error' AND value > 200) AND event_type <> 'view'")
def unhandled(spark, d):
    return unmatched(three_productions(), events(spark, d)).select("event_id", "event_type")


@query("SELECT event_id, CASE WHEN event_type = 'purchase' AND value > 50 THEN 'big/m' WHEN event_type = 'error' AND value > 200 THEN 'alarm/m' WHEN event_type = 'view' THEN 'seen/m' ELSE '' END AS patterns FROM events")
def patterns_taken(spark, d):
    return taken_by(three_productions(), events(spark, d)).select("event_id", F.array_join("patterns", ",").alias("patterns"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def observed_dups(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("mid"))
    return observed(Messages(docs, "source", "mid", "doc_id"))[1].select("doc_id")


# facts and state


@query("SELECT a.o_orderkey FROM orders a WHERE a.o_orderstatus = 'P' AND a.o_orderkey % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'F' AND b.o_orderkey % 5 <> 0)")
def retract_effect(spark, d):
    facts = orders(spark, d)
    left = retracted(facts, facts.df.where("o_orderkey % 5 = 0"))
    rule = when_all(c.first << (m.o_orderstatus == "P"), none_(m.o_orderstatus == "F")).rule
    return match(rule, left).select(F.col("first.o_orderkey").alias("o_orderkey"))


@query("SELECT user_id AS sid, max(event_id) AS event_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def latest_states(spark, d):
    return latest_state(events(spark, d)).df.select(F.col("user_id").alias("sid"), "event_id", F.col("event_type").alias("status"))


@query("SELECT DISTINCT user_id AS sid, 'sid-' || user_id AS mid FROM events")
def first_states(spark, d):
    return initial_states(events(spark, d))


@query("WITH st AS (SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS bar FROM events GROUP BY user_id) SELECT e.event_id, e.value FROM events e JOIN st USING (user_id) WHERE st.status <> 'error' AND e.event_type = 'purchase' AND e.value > st.bar")
def state_rule(spark, d):
    ev = events(spark, d)
    state = latest_state(ev)
    rule = when_all(c.now << (s.event_type != "error"), c.buy << (m.event_type == "purchase") & (m.value > s.value)).rule
    return match(rule, ev, state, keep=["value"]).select(F.col("buy.event_id").alias("event_id"), F.col("buy.value").alias("value"))


@query("SELECT a.event_id FROM events a WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_id = a.event_id AND b.value > 100)")
def pending(spark, d):
    ev = events(spark, d)
    views = ev.where("event_type = 'view'")
    return pending_events(views, ev.df.where("value > 100").select("user_id", "event_id")).df.select("event_id")


@query("SELECT event_id, user_id AS sid FROM events WHERE event_type = 'click' AND value > 30")
def json_scan(spark, d):
    text = read(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("user_id").alias("sid"), F.col("event_id").alias("id"), "event_type", "value")).alias("j"))
    found = match(when_all((m.event_type == "click") & (m.value > 30)).rule, from_json(text, "j", "event_id"))
    return found.select(F.col("m.mid").cast("long").alias("event_id"), F.col("sid").cast("long").alias("sid"))


@query("SELECT user_id AS sid, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM events WHERE event_type = 'purchase' AND value > 20 GROUP BY user_id")
def accumulated_state(spark, d):
    bought = match(when_all((m.event_type == "purchase") & (m.value > 20)).rule, events(spark, d), keep=["value"])
    return bought.groupBy("sid").agg(F.count("*").alias("n"), F.round(F.sum("m.value") * 100).cast("long").alias("cents"))


@query("SELECT CASE WHEN a.event_id IS NULL THEN 'store' ELSE 'delete' END AS action, coalesce(a.user_id, b.user_id) AS sid, coalesce(a.event_id, b.event_id) AS mid FROM (SELECT user_id, event_id FROM events WHERE value < 120) a FULL JOIN (SELECT user_id, event_id FROM events WHERE value > 80) b ON a.user_id = b.user_id AND a.event_id = b.event_id WHERE a.event_id IS NULL OR b.event_id IS NULL")
def stored_and_deleted(spark, d):
    ev = events(spark, d)
    return changes(ev.where("value < 120"), ev.where("value > 80"))


@query("SELECT user_id AS sid, event_id AS mid FROM (SELECT user_id, event_id, arg_max(action, pos) AS newest FROM (SELECT user_id, event_id, 'store' AS action, event_id AS pos FROM events UNION ALL SELECT user_id, event_id, 'delete', event_id + 1 FROM events WHERE event_id % 3 = 0) GROUP BY user_id, event_id) WHERE newest = 'store'")
def log_replayed(spark, d):
    ev = events(spark, d).df.select("user_id", "event_id")
    log = ev.select(F.lit("store").alias("action"), "user_id", "event_id", F.col("event_id").alias("at")).unionByName(ev.where("event_id % 3 = 0").select(F.lit("delete").alias("action"), "user_id", "event_id", (F.col("event_id") + 1).alias("at")))
    return replayed(Messages(log, "user_id", "event_id", "at")).df.select(F.col("user_id").alias("sid"), F.col("event_id").alias("mid"))


@query("SELECT user_id AS sid, event_id AS mid, 'fact' AS kind, CAST(event_id * 2 AS BIGINT) AS said FROM events WHERE event_type = 'signup' AND value > 50 UNION ALL SELECT user_id, event_id, 'error', -1 FROM events WHERE event_type = 'signup' AND value <= 50 AND value > 40")
def actions_run(spark, d):
    def act(ctx):
        if ctx.m.value <= 50:
            raise ValueError(ctx.m.event_id)
        ctx.assert_fact({"mid": ctx.m.event_id, "said": ctx.m.event_id * 2})

    rule = when_all((m.event_type == "signup") & (m.value > 40), name="act").rule
    out = effects_of(agenda([rule], events(spark, d), keep=["value"]), {"act": act})
    get = lambda x: F.get_json_object("payload", f"$.{x}").cast("long")
    return out.select(F.col("sid").cast("long").alias("sid"), F.coalesce(get("mid"), F.regexp_extract("error", r"\d+", 0).try_cast("long")).alias("mid"), "kind", F.coalesce(get("said"), F.lit(-1)).cast("long").alias("said"))


DEFINITION = {"suspect": {"all": [{"first": {"event_type": "purchase"}}, {"second": {"$and": [{"event_type": "purchase"}, {"$gt": {"value": {"$add": {"$l": {"first": "value"}, "$r": 250}}}}]}}, {"quiet$not": {"$and": [{"event_type": "error"}, {"$gt": {"event_id": {"second": "event_id"}}}]}}], "pri": 1}}


@query("SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND b.value > a.value + 250 WHERE a.event_type = 'purchase' AND b.event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = a.user_id AND x.event_type = 'error' AND x.event_id > b.event_id)")
def json_rule(spark, d):
    rule = definitions.ruleset("risk", DEFINITION).rule("suspect")
    return match(rule, events(spark, d)).select(F.col("first.event_id").alias("first_id"), F.col("second.event_id").alias("second_id"))


# forward chaining


def geography(spark, d) -> Messages:
    """Facts (subject, predicate, object): nations in regions, customers in nations."""
    text = lambda *cols: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in cols))
    part = lambda df, a, b: df.select(a.alias("subject"), F.lit("in").alias("predicate"), b.alias("object"))
    facts = part(read(spark, d, "nation"), text("n", F.col("n_nationkey")), text("r", F.col("n_regionkey"))).unionByName(part(read(spark, d, "customer"), text("c", F.col("c_custkey")), text("n", F.col("c_nationkey")))).unionByName(part(read(spark, d, "region"), text("r", F.col("r_regionkey")), text("world")))
    return Messages(facts.select(F.lit("0").alias("sid"), F.concat_ws("|", "subject", "predicate", "object").alias("mid"), F.lit(0).cast("long").alias("seq"), "subject", "predicate", "object"))


@query("""WITH RECURSIVE base AS (SELECT 'n' || n_nationkey AS s, 'r' || n_regionkey AS o FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
t AS (SELECT s, o FROM base UNION SELECT t.s, base.o FROM t JOIN base ON t.o = base.s) SELECT s AS subject, o AS object FROM t""")
def chain_closure(spark, d):
    rule = when_all(c.a << (m.predicate == "in"), c.b << (m.predicate == "in") & (m.subject == c.a.object), name="transitive").rule
    done = closure(geography(spark, d), [(rule, [asserts(subject=c.a.subject, predicate="in", object=c.b.object)])])
    return done.df.select("subject", "object").distinct()


@query("SELECT user_id AS sid, CASE WHEN bool_or(event_type = 'error' AND value > 150) THEN 'blocked' WHEN bool_or(event_type = 'purchase' AND value > 100) THEN 'gold' ELSE 'plain' END AS grade FROM events GROUP BY user_id")
def chain_strata(spark, d):
    ev = events(spark, d)
    facts = Messages(ev.df.select(F.col("user_id").alias("sid"), F.col("event_id").cast("string").alias("mid"), F.col("event_id").alias("seq"), "event_type", "value", F.lit(None).cast("string").alias("grade")))
    block = when_all((m.event_type == "error") & (m.value > 150), name="block").rule
    gold = when_all(c.buy << (m.event_type == "purchase") & (m.value > 100), none_(m.grade == "blocked"), name="gold").rule
    plain = when_all(c.any << +m.event_type, none_(+m.grade), name="plain").rule
    one = closure(facts, [(block, [asserts(grade="blocked")])])
    two = closure(one, [(gold, [asserts(grade="gold")])])
    three = closure(two, [(plain, [asserts(grade="plain")])])
    return three.df.where("grade IS NOT NULL").select("sid", "grade").distinct()


@query("SELECT o_custkey AS sid, CAST(count(*) FILTER (o_orderstatus IN ('F', 'O')) AS INT) AS n_fired FROM orders WHERE o_totalprice > 400000 GROUP BY o_custkey HAVING bool_or(o_orderstatus = 'F')")
def chain_fire(spark, d):
    facts = Messages(read(spark, d, "orders").select(F.col("o_custkey").alias("sid"), F.col("o_orderkey").cast("string").alias("mid"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total")))
    begin = when_all((m.status == "F") & (m.total > 400000), name="begin").rule
    go_on = when_all(c.start << (m.status == "begun"), c.open << (m.status == "O") & (m.total > 400000), name="go_on").rule
    _, fired = fire(facts, [(begin, [asserts(status="begun")]), (go_on, [asserts(status="done")])])
    return fired.groupBy("sid").agg(F.count("*").cast("int").alias("n_fired"))


# the whole loop: states, errors, timers


def states_of(df: DataFrame, sid: str, **columns) -> Messages:
    """A state for each row, with these columns."""
    return Messages(df.select(F.col(sid).alias("sid"), F.concat(F.lit("sid-"), F.col(sid).cast("string")).alias("mid"), F.lit(0).cast("long").alias("seq"), *(v.alias(k) for k, v in columns.items())))


def nothing(spark: SparkSession) -> Messages:
    return Messages(spark.createDataFrame([], "sid long, mid string, seq long"))


@query("SELECT c_custkey AS sid, CASE WHEN c_acctbal < 0 THEN 'start review last' ELSE 'start last' END AS path FROM customer")
def flow_state(spark, d):
    """Actions that move each customer's state on, until it is deleted."""
    begin = read(spark, d, "customer")
    state = states_of(begin, "c_custkey", status=F.lit("start"), balance=F.col("c_acctbal"))

    def go(ctx):
        ctx.s.status = "last" if ctx.s.status == "review" or ctx.s.balance >= 0 else "review"

    def end(ctx):
        ctx.delete_state()

    with ruleset("flow") as r:
        when_all(s.status == "start", name="start")(go)
        when_all(s.status == "review", name="review")(go)
        when_all(s.status == "last", name="last")(end)
    done = loop.run(r, nothing(spark), state)
    assert done.state.df.isEmpty()
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "rule"))), lambda x: x["rule"]), " ")
    return done.fired.groupBy("sid").agg(path.alias("path"))


@query("SELECT o_orderkey AS sid, CAST(o_totalprice <= 150000 AS BIGINT) AS paid, CAST(o_totalprice > 150000 AS BIGINT) AS failed FROM orders WHERE o_orderstatus = 'P'")
def exception_rule(spark, d):
    """An action that raises leaves its error in the state, where the next pick finds it."""
    df = read(spark, d, "orders")
    posted = Messages(df.select(F.col("o_orderkey").alias("sid"), F.col("o_orderkey").cast("string").alias("mid"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit(True).alias("is_event")))
    state = states_of(df, "o_orderkey", paid=F.lit(0).cast("long"), failed=F.lit(0).cast("long"), exception=F.lit(None).cast("string"))

    def pay(ctx):
        if ctx.m.price > 150000:
            raise ValueError("too much")
        ctx.s.paid += 1

    def note(ctx):
        ctx.s.failed += 1
        ctx.s.exception = None

    with ruleset("pay") as r:
        when_all(m.status == "P", pri(2), name="pay")(pay)
        when_all(+s.exception, pri(1), name="note")(note)
    done = loop.run(r, posted, state)
    return done.state.df.where("paid + failed > 0").select("sid", "paid", "failed")


@query("SELECT s_suppkey AS sid, CAST(s_nationkey % 3 + 1 AS BIGINT) AS pulses, CAST((s_nationkey % 3 + 1) * 5 AS BIGINT) AS last_time FROM supplier")
def timer_chain(spark, d):
    """Timers that their own action starts again, a number of times that the state knows."""
    supplier = read(spark, d, "supplier")
    state = states_of(supplier, "s_suppkey", pulses=F.lit(0).cast("long"), wanted=(F.col("s_nationkey") % 3 + 1).cast("long"), at=F.lit(0).cast("long"))

    def begin(ctx):
        ctx.start_timer("T", 5)

    def pulse(ctx):
        ctx.s.pulses += 1
        ctx.s.at = ctx.tick__timeout.time
        if ctx.s.pulses < ctx.s.wanted:
            ctx.start_timer("T", 5)

    messages = Messages(supplier.select(F.col("s_suppkey").alias("sid"), F.lit("go").alias("mid"), F.lit(0).cast("long").alias("seq"), F.lit("go").alias("t"), *(F.lit(None).cast(k).alias(n) for n, k in (("timer_name", "string"), ("base_time", "long"), ("time", "long")))))
    with ruleset("pulses") as r:
        when_all(m.t == "go", name="begin")(begin)
        when_all(c.tick << timeout("T"), name="pulse")(pulse)
    done = loop.run(r, messages, state, until=100)
    return done.state.df.select("sid", "pulses", F.col("at").alias("last_time"))


# charts


def shop() -> Chart:
    return (
        Chart("shop")
        .state("start", Trigger("looking", m.event_type == "view", name="look"))
        .state("looking", Trigger("looking", m.event_type == "click", name="browse"), Trigger("bought", (m.event_type == "purchase") & (m.value > 20), name="buy"), Trigger("failed", m.event_type == "error", pri=1, name="fail"))
        .state("bought", Trigger("looking", m.event_type == "view", name="again"))
        .state("failed")
    )


CHART = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
step AS (SELECT user_id, 0 AS rn, 'start' AS st, CAST(NULL AS VARCHAR) AS trig, CAST(NULL AS VARCHAR) AS was, CAST(NULL AS BIGINT) AS event_id FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT e.user_id, e.rn, CASE x.t WHEN 'look' THEN 'looking' WHEN 'browse' THEN 'looking' WHEN 'buy' THEN 'bought' WHEN 'fail' THEN 'failed' WHEN 'again' THEN 'looking' ELSE step.st END, x.t, step.st, e.event_id
FROM step JOIN e ON e.user_id = step.user_id AND e.rn = step.rn + 1, LATERAL (SELECT CASE WHEN step.st = 'start' AND e.event_type = 'view' THEN 'look' WHEN step.st = 'looking' AND e.event_type = 'click' THEN 'browse' WHEN step.st = 'looking' AND e.event_type = 'purchase' AND e.value > 20 THEN 'buy' WHEN step.st = 'looking' AND e.event_type = 'error' THEN 'fail' WHEN step.st = 'bought' AND e.event_type = 'view' THEN 'again' END AS t) x)
"""


@query(CHART + "SELECT user_id AS sid, was AS from_state, st AS to_state, trig AS trigger, event_id AS mid FROM step WHERE trig IS NOT NULL")
def chart_fold(spark, d):
    return run_chart(events(spark, d), shop(), pending=False).select("sid", "from_state", "to_state", "trigger", "mid")


@query(CHART + "SELECT user_id AS sid, count(*) FILTER (trig IS NOT NULL) AS n, count(*) FILTER (st = 'bought' AND trig IS NOT NULL) AS bought FROM step WHERE rn = 0 OR trig IS NOT NULL GROUP BY user_id")
def flow_fold(spark, d):
    stages = run_flow(events(spark, d), shop(), pending=False)
    return stages.groupBy("sid").agg(F.count_if(F.col("nth") > 0).alias("n"), F.count_if(F.col("stage") == "bought").alias("bought"))


@query()
def chart_pending(spark, d):
    return run_chart(events(spark, d), shop()).select("sid", "nth", "from_state", "to_state", "trigger", "mid")


@query("SELECT a.user_id AS sid, 'alarm' AS to_state, min(greatest(a.event_id, b.event_id)) AS mid FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND b.value > a.value + 200 WHERE a.event_type = 'error' AND b.event_type = 'purchase' GROUP BY a.user_id")
def chart_pairs(spark, d):
    """A trigger of two patterns that are related: it fires when the second of them arrives."""
    pair = when_all(c.first << (m.event_type == "error"), c.second << (m.event_type == "purchase") & (m.value > c.first.value + 200), name="pair").rule
    moves = run_chart(events(spark, d), Chart("watch").state("open", Trigger("alarm", pair, name="pair")).state("alarm"))
    return moves.select("sid", "to_state", "mid")


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type = 'error'), t AS (SELECT user_id, event_id FROM e WHERE rn = 3),
f AS (SELECT t.user_id, min(x.event_id) AS event_id FROM t JOIN events x ON x.user_id = t.user_id AND x.event_id > t.event_id AND ((x.event_type = 'purchase' AND x.value > 150) OR (x.event_type = 'signup' AND x.value > 100)) GROUP BY ALL)
SELECT user_id AS sid, 'busy' AS to_state, event_id AS mid FROM t UNION ALL SELECT user_id, 'served', event_id FROM f""")
def chart_counts(spark, d):
    """A trigger that takes three messages, and one of any of two patterns."""
    three = when_all(m.event_type == "error", count(3), name="three").rule
    some = when_any((m.event_type == "purchase") & (m.value > 150), (m.event_type == "signup") & (m.value > 100), name="some").rule
    moves = run_chart(events(spark, d), Chart("desk").state("open", Trigger("busy", three, name="three")).state("busy", Trigger("served", some, name="some")).state("served"), pending=False)
    return moves.select("sid", "to_state", "mid")


# events observed once, timers


LIFO = """WITH e AS (SELECT user_id, event_id, event_type, sum(CASE event_type WHEN 'view' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events WHERE event_type IN ('view', 'click')),
l AS (SELECT *, CASE event_type WHEN 'view' THEN d - 1 ELSE d END AS lv FROM e),
n AS (SELECT *, row_number() OVER w AS rn, lead(event_id) OVER w AS other, FROM l WINDOW w AS (PARTITION BY user_id, lv ORDER BY event_id))
SELECT user_id AS sid, CASE event_type WHEN 'view' THEN event_id ELSE other END AS a, CASE event_type WHEN 'view' THEN other ELSE event_id END AS b FROM n WHERE rn % 2 = 1 AND other IS NOT NULL"""


@query(LIFO)
def event_pairs_lifo(spark, d):
    return lifo_pairs(events(spark, d), m.event_type == "view", m.event_type == "click").select("sid", "a", "b")


@query(LIFO)
def events_once(spark, d):
    rule = when_all(c.a << (m.event_type == "view"), c.b << (m.event_type == "click"), name="pair").rule
    fired = consumed_once(agenda([rule], events(spark, d)))
    return fired.select("sid", F.col("mids")[0].cast("long").alias("a"), F.col("mids")[1].cast("long").alias("b"))


@query("SELECT a.user_id AS sid, a.event_id FROM events a WHERE a.event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR)")
def timeout_join(spark, d):
    ev = read(spark, d, "events")
    started = tm.start_timers(ev.where("event_type = 'signup'"), "user_id", "ts", "first_buy", 12 * 3600)
    out = tm.unanswered(started, ev.where("event_type = 'purchase'"), "user_id", "ts")
    ids = ev.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("started"))
    return out.join(ids, (F.col("sid") == F.col("user_id")) & (out["started"] == ids["started"])).select("sid", "event_id")


@query("SELECT user_id AS sid, epoch_us(max(ts)) AS started_us, epoch_us(max(ts) + INTERVAL 5 MINUTE) AS base_us FROM events WHERE event_type = 'click' GROUP BY user_id HAVING max(ts) + INTERVAL 5 MINUTE <= TIMESTAMP '2024-01-20 00:00:00'")
def timers_restarted(spark, d):
    clicks = tm.start_timers(read(spark, d, "events").where("event_type = 'click'"), "user_id", "ts", "idle", 300)
    out = tm.expired(tm.restarted(clicks), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return out.select("sid", F.unix_micros("started").alias("started_us"), F.unix_micros("base_time").alias("base_us"))


@query("SELECT user_id AS sid, epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS start_us, count(*) AS n FROM events GROUP BY ALL")
def velocity_window(spark, d):
    out = tm.velocity(read(spark, d, "events"), "user_id", "ts", "5 minutes")
    return out.select("sid", F.unix_micros("start").alias("start_us"), "n")


@query("SELECT user_id AS sid, epoch_us(window_start) AS start_us, n FROM (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL) WHERE n >= 2")
def velocity_alarm(spark, d):
    rates = tm.velocity(read(spark, d, "events").where("event_type = 'error'"), "user_id", "ts", "1 hour")
    found = match(when_all(m.n >= 2).rule, Messages(rates, "sid", "start", "start"), keep=["n"])
    return found.select("sid", F.unix_micros("m.start").alias("start_us"), F.col("m.n").alias("n"))


__all__ = ["QUERIES", "SQL", "batched"]
