"""The operators bound to the driver's tables, each beside the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.functions import amounts, dates, hashing, ids, text
from tallyline.operators import assign, joins, ordered, scoring
from tallyline.plans import report, vendor_links

MONEY = "decimal(18,2)"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def bound(sql: str | None = None, double: str = "", text: str = "", number: str = ""):
    """Register a query and its SQL. Both hand over the columns named in double and text as such, and those in
    number with null as -1: clients print decimals, dates and nullable numbers in different ways."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            casts = {c: F.col(c).cast("double") for c in double.split()} | {c: F.col(c).cast("string") for c in text.split()}
            return out.withColumns(casts | {c: F.coalesce(F.col(c).cast("bigint"), F.lit(-1)) for c in number.split()})

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            casts = [f"{c}::DOUBLE AS {c}" for c in double.split()] + [f"{c}::VARCHAR AS {c}" for c in text.split()]
            casts += [f"coalesce({c}::BIGINT, -1) AS {c}" for c in number.split()]
            ORACLE_SQL[fn.__name__] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark, d):
    o = table(spark, d, "orders")
    return o.withColumns({"day": F.col("o_orderdate").cast("date"), "amount": F.col("o_totalprice").cast(MONEY)})


def lines(spark, d):
    x = table(spark, d, "lineitem")
    return x.withColumns({"day": F.col("l_shipdate").cast("date"), "amount": F.col("l_extendedprice").cast(MONEY)})


def events(spark, d):
    # to the nearest second, halves to the even one, as DuckDB's cast of epoch() does
    return table(spark, d, "events").withColumn("sec", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("bigint"))


# ---- views


@bound("""
WITH o AS (SELECT year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(18,2)) AS declared, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice::DECIMAL(18,2) ELSE 0 END) AS open_amount, count(*) AS n FROM orders GROUP BY 1),
l AS (SELECT year(l_shipdate) AS y, sum(l_extendedprice::DECIMAL(18,2)) AS shipped, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice::DECIMAL(18,2) ELSE 0 END) AS returned FROM lineitem GROUP BY 1),
ys AS (SELECT y FROM o UNION SELECT y FROM l)
SELECT ys.y::INTEGER AS year, o.declared::DECIMAL(28,2) AS declared, o.open_amount::DECIMAL(28,2) AS open_amount, coalesce(o.n, 0)::BIGINT AS n_orders, l.shipped::DECIMAL(28,2) AS shipped, l.returned::DECIMAL(28,2) AS returned,
 (o.declared - l.shipped)::DECIMAL(28,2) AS difference, p.declared::DECIMAL(28,2) AS prior_declared
FROM ys LEFT JOIN o USING (y) LEFT JOIN l USING (y) LEFT JOIN o p ON p.y = ys.y - 1""", double="declared open_amount shipped returned difference prior_declared")
def control_totals_by_year(spark, d):
    o = orders(spark, d).groupBy(F.year("day").alias("year")).agg(
        F.sum("amount").alias("declared"), F.sum(F.when(F.col("o_orderstatus") == "O", F.col("amount")).otherwise(0)).alias("open_amount"), F.count(F.lit(1)).alias("n_orders")
    )
    x = lines(spark, d).groupBy(F.year("day").alias("year")).agg(F.sum("amount").alias("shipped"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("amount")).otherwise(0)).alias("returned"))
    years = o.select("year").union(x.select("year")).distinct()
    prior = o.select((F.col("year") + 1).alias("year"), F.col("declared").alias("prior_declared"))
    out = years.join(o, "year", "left").join(x, "year", "left").join(prior, "year", "left")
    wide = {c: F.col(c).cast("decimal(28,2)") for c in ("declared", "open_amount", "shipped", "returned", "prior_declared")}
    return out.withColumns({**wide, "n_orders": F.coalesce("n_orders", F.lit(0)), "difference": (F.col("declared") - F.col("shipped")).cast("decimal(28,2)")})


@bound("""
WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(18,2)) AS total FROM orders GROUP BY 1, 2)
SELECT a.o_custkey, a.y::INTEGER AS year, a.total::DECIMAL(28,2) AS total, p.total::DECIMAL(28,2) AS prior, (a.total - p.total)::DECIMAL(28,2) AS gap FROM y a LEFT JOIN y p ON p.o_custkey = a.o_custkey AND p.y = a.y - 1""", double="total prior gap")
def balance_continuity(spark, d):
    y = orders(spark, d).groupBy("o_custkey", F.year("day").alias("year")).agg(F.sum("amount").cast("decimal(28,2)").alias("total"))
    prior = y.select("o_custkey", (F.col("year") + 1).alias("year"), F.col("total").alias("prior"))
    return y.join(prior, ["o_custkey", "year"], "left").withColumn("gap", (F.col("total") - F.col("prior")).cast("decimal(28,2)"))


@bound("SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS amount FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')", double="amount")
def residual_r1_anti(spark, d):
    back = lines(spark, d).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders(spark, d).select("o_orderkey", "amount").join(back, "o_orderkey", "left_anti")


_VERSIONS = [("outflow_min", "50000", 1, "1990-01-01"), ("outflow_min", "150000", 2, "1997-01-01"), ("outflow_min", "120000", 2, "1999-06-01"), ("outflow_min", "90000", 1, "2000-01-01")]
_VERSIONS_SQL = "(VALUES (50000.00::DECIMAL(18,2), 1, DATE '1990-01-01'), (150000.00, 2, DATE '1997-01-01'), (120000.00, 2, DATE '1999-06-01'), (90000.00, 1, DATE '2000-01-01')) v(value, version, valid_from)"


def _versions(spark):
    v = spark.createDataFrame(_VERSIONS, "key string, value string, version int, valid_from string")
    return v.withColumns({"value": F.col("value").cast(MONEY), "valid_from": F.col("valid_from").cast("date")})


@bound(f"""
SELECT o_orderkey, (SELECT value FROM {_VERSIONS_SQL} WHERE valid_from <= o_orderdate::DATE ORDER BY version DESC, valid_from DESC LIMIT 1)::DECIMAL(18,2) AS outflow_min FROM orders""", double="outflow_min")
def param_asof(spark, d):
    return joins.parameter_asof(orders(spark, d), _versions(spark), "outflow_min", "day").select("o_orderkey", "outflow_min")


@bound(f"""
WITH o AS (SELECT *, (SELECT value FROM {_VERSIONS_SQL} WHERE valid_from <= o_orderdate::DATE ORDER BY version DESC, valid_from DESC LIMIT 1) AS least FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice::DECIMAL(18,2) AS amount FROM o WHERE o_totalprice::DECIMAL(18,2) > least AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey AND event_type = 'error')""", double="amount")
def residual_r2_threshold_anti(spark, d):
    o = joins.parameter_asof(orders(spark, d), _versions(spark), "outflow_min", "day").where("amount > outflow_min")
    bad = events(spark, d).where("event_type = 'error'").select(F.col("user_id").alias("o_custkey"))
    return o.join(bad, "o_custkey", "left_anti").select("o_orderkey", "o_custkey", "amount")


@bound("""
SELECT c_custkey, c_acctbal::DECIMAL(18,2) AS balance FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase')
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 250000)""", double="balance")
def residual_r4_double_anti(spark, d):
    bought = events(spark, d).where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    large = orders(spark, d).where("o_orderstatus = 'P' AND o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast(MONEY).alias("balance"))
    return c.join(bought, "c_custkey", "left_anti").join(large, "c_custkey", "left_anti")


_COVERAGE = """
WITH s AS (SELECT o_custkey, min(o_orderdate::DATE) AS a, max(o_orderdate::DATE) AS b FROM orders GROUP BY 1),
m AS (SELECT o_custkey, unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH))::DATE AS month FROM s),
h AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate)::DATE AS month FROM orders)
"""


def _coverage(spark, d):
    o = orders(spark, d).select("o_custkey", "day")
    spans = o.groupBy("o_custkey").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return ordered.month_coverage(spans, o, "o_custkey", "a", "b", "day", "day")


@bound(_COVERAGE + "SELECT o_custkey, month, h.month IS NOT NULL AS covered FROM m LEFT JOIN h USING (o_custkey, month)".replace("h.month IS NOT NULL", "EXISTS (SELECT 1 FROM h x WHERE x.o_custkey = m.o_custkey AND x.month = m.month)"), text="month")
def statement_coverage(spark, d):
    return _coverage(spark, d)


@bound(_COVERAGE + "SELECT o_custkey, count(*)::BIGINT AS missing FROM m WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.o_custkey = m.o_custkey AND x.month = m.month) GROUP BY 1")
def missing_months(spark, d):
    return _coverage(spark, d).where("NOT covered").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("missing"))


@bound("""
SELECT s_suppkey, coalesce(l.committed, 0)::DECIMAL(28,2) AS committed, coalesce(l.returned, 0)::DECIMAL(28,2) AS returned, greatest(coalesce(l.committed, 0), s_acctbal::DECIMAL(18,2))::DECIMAL(28,2) AS available,
 coalesce(l.first_day, NULL)::DATE AS first_day, coalesce(l.parts, 0)::BIGINT AS parts
FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_extendedprice::DECIMAL(18,2)) AS committed, sum(l_extendedprice::DECIMAL(18,2)) FILTER (WHERE l_returnflag = 'R') AS returned, min(l_shipdate)::DATE AS first_day, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) l ON l_suppkey = s_suppkey""", double="committed returned available", text="first_day")
def works_funding(spark, d):
    sums = lines(spark, d).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.sum("amount").alias("c"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("amount"))).alias("r"), F.min("day").alias("first_day"), F.count_distinct("l_partkey").alias("p")
    )
    zero = F.lit(0).cast("decimal(28,2)")
    s = table(spark, d, "supplier").join(sums, "s_suppkey", "left")
    c, r = F.coalesce(F.col("c").cast("decimal(28,2)"), zero), F.coalesce(F.col("r").cast("decimal(28,2)"), zero)
    return s.select("s_suppkey", c.alias("committed"), r.alias("returned"), F.greatest(c, F.col("s_acctbal").cast(MONEY).cast("decimal(28,2)")).alias("available"), "first_day", F.coalesce("p", F.lit(0)).alias("parts"))


@bound("""
SELECT l_partkey, coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (WHERE l_shipdate >= DATE '1998-06-01'), 0)::DECIMAL(28,2) AS after_amount, coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (WHERE l_shipdate < DATE '1998-06-01'), 0)::DECIMAL(28,2) AS before_amount,
 count(*) FILTER (WHERE l_shipdate >= DATE '1998-06-01' AND l_returnflag = 'R')::BIGINT AS after_returns FROM lineitem GROUP BY 1""", double="after_amount before_amount")
def suspension_status(spark, d):
    after = F.col("day") >= F.lit("1998-06-01").cast("date")
    return lines(spark, d).groupBy("l_partkey").agg(
        F.coalesce(F.sum(F.when(after, F.col("amount"))), F.lit(0)).cast("decimal(28,2)").alias("after_amount"),
        F.coalesce(F.sum(F.when(~after, F.col("amount"))), F.lit(0)).cast("decimal(28,2)").alias("before_amount"),
        F.count_if(after & (F.col("l_returnflag") == "R")).alias("after_returns"),
    )


@bound("""
SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 3 MONTH)::DATE AS short_until, (o_orderdate::DATE + INTERVAL 12 MONTH)::DATE AS long_until, (o_orderdate::DATE + INTERVAL 3 MONTH)::DATE >= DATE '2000-01-01' AS short_open
FROM orders WHERE (o_orderdate::DATE + INTERVAL 12 MONTH)::DATE >= DATE '2000-01-01' AND o_orderdate::DATE <= DATE '2000-01-01'""", text="short_until long_until")
def challenge_windows_asof(spark, d):
    as_of = F.lit("2000-01-01").cast("date")
    w = orders(spark, d).withColumn("w", dates.challenge_windows(F.lit(None).cast("date"), F.col("day")))
    return w.where((F.col("w.long") >= as_of) & (F.col("day") <= as_of)).select("o_orderkey", F.col("w.short").alias("short_until"), F.col("w.long").alias("long_until"), (F.col("w.short") >= as_of).alias("short_open"))


@bound("SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 3 YEAR)::DATE AS after_3, (o_orderdate::DATE + INTERVAL 5 YEAR)::DATE AS after_5, (o_orderdate::DATE + INTERVAL 10 YEAR)::DATE AS after_10 FROM orders", text="after_3 after_5 after_10")
def limitation_clocks(spark, d):
    return orders(spark, d).select("o_orderkey", *(F.add_months("day", 12 * n).alias(f"after_{n}") for n in (3, 5, 10)))


@bound("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_check_per_key(spark, d):
    return ordered.latest(events(spark, d).select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


# ---- reconciliation


def _candidates(spark, d):
    o = orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", F.col("c_nationkey").alias("nation"), F.col("day").alias("o_day"), amounts.cents(F.col("amount")).alias("o_cents"))
    x = lines(spark, d).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    x = x.select("l_orderkey", "l_linenumber", F.col("s_nationkey").alias("nation"), F.col("day").alias("l_day"), amounts.cents(F.col("amount")).alias("l_cents"))
    met = joins.amount_range_join(o, x, ["nation"], "o_cents", "l_cents", 500)
    return met.where(dates.in_payment_window(F.col("o_day"), F.col("l_day")))


@bound("""
SELECT o_orderkey, l_orderkey, l_linenumber, (o_totalprice::DECIMAL(18,2) - l_extendedprice::DECIMAL(18,2))::DECIMAL(18,2) AS off
FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_nationkey = c_nationkey JOIN lineitem ON l_suppkey = s_suppkey
WHERE abs(o_totalprice::DECIMAL(18,2) - l_extendedprice::DECIMAL(18,2)) <= 5 AND l_shipdate::DATE - o_orderdate::DATE BETWEEN -5 AND 120""", double="off")
def link_candidates_range_join(spark, d):
    return _candidates(spark, d).select("o_orderkey", "l_orderkey", "l_linenumber", ((F.col("o_cents") - F.col("l_cents")) / 100).cast(MONEY).alias("off"))


@bound("""
WITH RECURSIVE c AS (SELECT *, row_number() OVER (ORDER BY gap, days, o_orderkey, line) AS n FROM (SELECT o_orderkey, l_orderkey || '-' || l_linenumber AS line, (abs(o_totalprice::DECIMAL(18,2) - l_extendedprice::DECIMAL(18,2)) * 100)::BIGINT AS gap, abs(l_shipdate::DATE - o_orderdate::DATE)::INTEGER AS days
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_nationkey = c_nationkey JOIN lineitem ON l_suppkey = s_suppkey
 WHERE abs(o_totalprice::DECIMAL(18,2) - l_extendedprice::DECIMAL(18,2)) <= 5 AND l_shipdate::DATE - o_orderdate::DATE BETWEEN -5 AND 120)),
f AS (SELECT 0::BIGINT AS n, false AS took, []::BIGINT[] AS l, []::VARCHAR[] AS r UNION ALL
 SELECT n, took, CASE WHEN took THEN list_append(l, o_orderkey) ELSE l END, CASE WHEN took THEN list_append(r, line) ELSE r END FROM (SELECT c.n, c.o_orderkey, c.line, f.l, f.r, NOT list_contains(f.l, c.o_orderkey) AND NOT list_contains(f.r, c.line) AS took FROM f JOIN c ON c.n = f.n + 1))
SELECT o_orderkey, line, gap, days FROM c JOIN f USING (n) WHERE took""")
def payment_assignment(spark, d):
    c = _candidates(spark, d).withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber")).withColumn("gap", F.abs(F.col("o_cents") - F.col("l_cents")))
    c = c.withColumn("days", F.abs(F.datediff("l_day", "o_day"))).select("o_orderkey", "line", "gap", "days")
    return assign.greedy_pairs(c, "o_orderkey", "line", [F.col("gap"), F.col("days")])


@bound("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18,2) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate::DATE, l_linenumber) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey QUALIFY n <= 12),
s AS (SELECT a.l_orderkey, 2 AS k, [a.n, b.n] AS places, [a.l_linenumber, b.l_linenumber] AS ids, a.v + b.v AS total FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.n < b.n
 UNION ALL SELECT a.l_orderkey, 3, [a.n, b.n, c.n], [a.l_linenumber, b.l_linenumber, c.l_linenumber], a.v + b.v + c.v FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.n < b.n JOIN l c ON a.l_orderkey = c.l_orderkey AND b.n < c.n),
f AS (SELECT s.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY k, places) AS r FROM s JOIN orders ON o_orderkey = l_orderkey WHERE abs(total - o_totalprice::DECIMAL(18,2)) <= 2000 * k)
SELECT l_orderkey AS o_orderkey, array_to_string(ids, ',') AS parts, total::DECIMAL(20,2) AS total FROM f WHERE r = 1""", double="total")
def partial_sum_sets(spark, d):
    x = lines(spark, d).select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("amount").alias("part"), F.col("day"))
    o = orders(spark, d).select(F.col("o_orderkey").alias("k"), "o_orderkey", "amount")
    got = assign.partial_sums(o, x, ["k"], "o_orderkey", "amount", "l_linenumber", "part", ["day"], tolerance=2000)
    return got.select("o_orderkey", F.array_join(F.transform("parts", lambda p: p.cast("string")), ",").alias("parts"), "total")


@bound("""
SELECT p.event_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN LATERAL
 (SELECT * FROM events e WHERE e.event_type = 'view' AND e.user_id = p.user_id AND e.ts <= p.ts ORDER BY e.ts DESC, e.event_id DESC LIMIT 1) v ON true""", number="view_id")
def asof_resolution_top1(spark, d):
    e = events(spark, d).select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    right = e.where("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    out = joins.asof_latest(left, right, ["user_id"], "at", "at", ["view_id", "view_value"], ["view_id"])
    return out.select("event_id", F.col("asof_view_id").alias("view_id"), F.col("asof_view_value").alias("view_value"))


@bound("""
WITH u AS (SELECT s_suppkey, s_nationkey, (s_acctbal::DECIMAL(18,2) * 100)::BIGINT AS v FROM supplier), c AS (SELECT c_custkey, c_nationkey, (c_acctbal::DECIMAL(18,2) * 100)::BIGINT AS v FROM customer)
SELECT c_custkey, u.s_suppkey AS near_supplier FROM c LEFT JOIN LATERAL (SELECT * FROM u WHERE u.s_nationkey = c.c_nationkey ORDER BY abs(u.v - c.v), u.s_suppkey LIMIT 1) u ON true""", number="near_supplier")
def nearest_expected(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), amounts.cents(F.col("c_acctbal").cast(MONEY)).alias("v"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), amounts.cents(F.col("s_acctbal").cast(MONEY)).alias("w"))
    return joins.nearest(c, s, ["nation"], "v", "w", "s_suppkey").select("c_custkey", F.col("near_s_suppkey").alias("near_supplier"))


@bound("""
WITH RECURSIVE e AS (SELECT user_id AS u, event_id AS id, epoch(ts)::BIGINT AS t, event_type FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t, id) AS n FROM e WHERE event_type = 'purchase'),
k AS (SELECT u, list(struct_pack(t := t, id := id) ORDER BY t, id) AS closers FROM e WHERE event_type = 'error' GROUP BY 1),
f AS (SELECT u, 0::BIGINT AS n, NULL::BIGINT AS bought, NULL::BIGINT AS failed, []::BIGINT[] AS used FROM k UNION ALL
 SELECT u, n, id, hit, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END FROM (
  SELECT o.u, o.n, o.id, f.used, list_filter(k.closers, lambda x: x.t > o.t AND x.t - o.t <= 324000 AND NOT list_contains(f.used, x.id))[1].id AS hit FROM f JOIN o ON o.u = f.u AND o.n = f.n + 1 JOIN k ON k.u = o.u))
SELECT bought, failed FROM f WHERE failed IS NOT NULL""")
def refund_interval_firstfit(spark, d):
    e = events(spark, d)
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("bought"), "sec")
    failed = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("failed"), F.col("sec").alias("at"))
    return assign.interval_first_fit(bought, failed, ["user_id"], "bought", "failed", "sec", "at", 90 * 3600)


@bound("""
WITH k AS (SELECT c_custkey AS unit, c_nationkey || '-' || ((abs(c_acctbal::DECIMAL(18,2)) * 100)::BIGINT // 20000) AS seg, (abs(c_acctbal::DECIMAL(18,2)) * 100)::BIGINT // 200 AS band FROM customer),
r AS (SELECT s_suppkey, s_nationkey || '-' || ((abs(s_acctbal::DECIMAL(18,2)) * 100)::BIGINT // 20000) AS seg, (abs(s_acctbal::DECIMAL(18,2)) * 100)::BIGINT // 200 AS band FROM supplier),
h AS (SELECT s_suppkey, unit FROM r JOIN k USING (seg) UNION SELECT s_suppkey, unit FROM r JOIN k ON r.band = k.band)
SELECT s_suppkey, min(unit) AS unit FROM h GROUP BY 1 HAVING count(*) = 1""")
def payer_attribution_or_join(spark, d):
    def keyed(name, own, nation, bal, seg, band):
        b = F.abs(F.col(bal).cast(MONEY))
        return table(spark, d, name).select(own, F.concat_ws("-", nation, F.floor(b / 200).cast("bigint")).alias(seg), F.floor(b / 2).cast("bigint").alias(band))

    never = F.lit(None).cast("date")
    k = keyed("customer", F.col("c_custkey").alias("unit"), "c_nationkey", "c_acctbal", "useg", "uband").withColumns({"f": never, "t": never})
    r = keyed("supplier", "s_suppkey", "s_nationkey", "s_acctbal", "seg", "band").withColumn("day", F.lit("2000-01-01").cast("date"))
    return joins.attribute_or(r, k, "s_suppkey", "unit", [("seg", "useg"), ("band", "uband")], "day", "f", "t")


@bound("""
WITH m AS (SELECT o_custkey, count(*) AS n, median(o_totalprice) AS med, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)
SELECT o_custkey, n::BIGINT AS n, med AS median FROM m WHERE n >= 3 AND lo >= med * (1 - 0.9) AND hi <= med * (1 + 0.9)""")
def recurring_median_band(spark, d):
    return ordered.recurring(table(spark, d, "orders"), "o_custkey", "o_totalprice", 3, 0.9)


@bound("""
SELECT o_custkey, year(o_orderdate)::INTEGER AS year, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2) AS total, count(*) FILTER (WHERE o_totalprice::DECIMAL(18,2) >= CASE WHEN o_orderdate::DATE >= DATE '1998-07-11' THEN 100000 ELSE 250000 END)::BIGINT AS over_limit
FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' GROUP BY 1, 2 HAVING sum(o_totalprice::DECIMAL(18,2)) > 300000""", double="total")
def yearly_cash_limits(spark, d):
    limit = F.when(F.col("day") >= F.lit("1998-07-11").cast("date"), 100000).otherwise(250000)
    o = orders(spark, d).where("o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'")
    return o.groupBy("o_custkey", F.year("day").alias("year")).agg(F.sum("amount").cast("decimal(28,2)").alias("total"), F.count_if(F.col("amount") >= limit).alias("over_limit")).where("total > 300000")


# ---- timeline

_STAGES = [("purchase", "view", 0), ("view", "click", 1), ("click", "signup", 2), ("error", "purchase", 0)]


@bound("""
WITH f AS (SELECT user_id, event_type, min(ts)::DATE AS day FROM events GROUP BY 1, 2), r AS (SELECT * FROM (VALUES ('purchase', 'view', 0), ('view', 'click', 1), ('click', 'signup', 2), ('error', 'purchase', 0)) r(event_type, before, tolerance))
SELECT f.user_id, f.event_type, f.day, r.before, b.day AS before_day, (f.day - b.day >= -r.tolerance) AS ok FROM f JOIN r USING (event_type) LEFT JOIN f b ON b.user_id = f.user_id AND b.event_type = r.before""", text="day before_day ok")
def works_sequence_violations(spark, d):
    first = ordered.earliest_per_kind(events(spark, d).withColumn("day", F.col("ts").cast("date")), ["user_id"], "event_type", "day", "event_id").drop("event_id")
    rules = spark.createDataFrame(_STAGES, "event_type string, before string, tolerance_days int")
    return ordered.sequence_check(first, rules, "user_id", "event_type", "day").withColumnRenamed("before_at", "before_day")


# ---- rules and scores


def _hits(spark, d):
    """Hits of three rules on orders: their event is the order, their entity the customer."""
    o = orders(spark, d)
    base = {"family": F.lit("P"), "extraction_quality": F.lit(0.9), "specificity": F.lit(0.9), "independence": F.lit(1.0)}
    large = o.where("amount >= 350000").withColumns({**base, "rule_code": F.lit("P1"), "severity": F.lit(3)})
    urgent = o.where("o_orderpriority LIKE '1%' AND amount >= 300000").withColumns({**base, "family": F.lit("D"), "rule_code": F.lit("D1"), "severity": F.lit(4), "independence": F.lit(0.7)})
    pending = o.where("o_orderstatus = 'P' AND amount >= 320000").withColumns({**base, "family": F.lit("E"), "rule_code": F.lit("E1"), "severity": F.lit(2)})
    cols = ["rule_code", "family", "severity", "extraction_quality", "specificity", "independence"]
    out = large.select("o_orderkey", "o_custkey", "amount", *cols).unionByName(urgent.select("o_orderkey", "o_custkey", "amount", *cols)).unionByName(pending.select("o_orderkey", "o_custkey", "amount", *cols))
    return scoring.scored(out.withColumns({"event_key": F.col("o_orderkey").cast("string"), "document_id": F.col("o_orderkey"), "never_t1_t2": F.lit(False)}))


_HITS = """
WITH h0 AS (
 SELECT o_orderkey, o_custkey, o_totalprice::DECIMAL(18,2) AS amount, 'P1' AS rule_code, 'P' AS family, 3 AS severity, 0.810 AS confidence, 1.0 AS independence FROM orders WHERE o_totalprice::DECIMAL(18,2) >= 350000
 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice::DECIMAL(18,2), 'D1', 'D', 4, 0.567, 0.7 FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice::DECIMAL(18,2) >= 300000
 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice::DECIMAL(18,2), 'E1', 'E', 2, 0.810, 1.0 FROM orders WHERE o_orderstatus = 'P' AND o_totalprice::DECIMAL(18,2) >= 320000
), h AS (SELECT *, severity * confidence AS hit_score FROM h0),
top AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY severity DESC, independence DESC, rule_code) AS n, list(rule_code) OVER (PARTITION BY o_orderkey) AS codes FROM h),
c AS (SELECT *, list_sort(list_filter(codes, lambda x: x <> rule_code)) AS absorbed FROM top WHERE n = 1)
"""


@bound(_HITS + "SELECT o_orderkey, rule_code, severity::INTEGER AS severity, array_to_string(absorbed, ',') AS absorbed FROM c")
def event_collapse(spark, d):
    return scoring.collapse_by_event(_hits(spark, d)).select("o_orderkey", "rule_code", "severity", F.array_join("absorbed", ",").alias("absorbed"))


@bound(_HITS + """, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY hit_score DESC, o_orderkey::VARCHAR) AS k FROM c),
s AS (SELECT o_custkey, sum(CASE k WHEN 1 THEN hit_score WHEN 2 THEN hit_score * 0.5 WHEN 3 THEN hit_score * 0.25 WHEN 4 THEN hit_score * 0.125 ELSE 0 END) AS base, count(DISTINCT family) AS families, count(DISTINCT o_orderkey) AS documents FROM r GROUP BY 1)
SELECT o_custkey, families::BIGINT AS families, documents::BIGINT AS documents, least(8, base * CASE WHEN documents >= 2 AND families >= 3 THEN 2 WHEN documents >= 2 AND families >= 2 THEN 1.5 ELSE 1 END)::DECIMAL(10,4) AS score FROM s""", double="score")
def entity_score_top4(spark, d):
    e = scoring.entity_score(scoring.collapse_by_event(_hits(spark, d)), "o_custkey")
    return e.select("o_custkey", "families", "documents", F.col("score").cast("decimal(10,4)").alias("score"))


@bound(_HITS + """SELECT o_custkey, CASE WHEN bool_or(severity = 4 AND confidence >= 0.8) OR count(DISTINCT family) FILTER (WHERE severity >= 3 AND confidence >= 0.7) >= 2 THEN 'T1' WHEN bool_or(severity >= 2 AND confidence >= 0.5) THEN 'T2' ELSE 'T3' END AS tier FROM c GROUP BY 1""")
def tiering(spark, d):
    return scoring.assign_tier(scoring.collapse_by_event(_hits(spark, d)), "o_custkey")


@bound(_HITS + """, g AS (SELECT c.*, CASE WHEN severity >= 2 AND confidence >= 0.5 THEN 'T2' ELSE 'T3' END AS tier, o_orderkey % 3 = 0 AS replied, o_orderkey % 7 <> 0 AS cited FROM c),
b AS (SELECT CASE WHEN NOT replied AND severity >= 3 THEN 'withheld' WHEN NOT cited THEN 'withheld' WHEN tier = 'T3' THEN 'worklist' ELSE 'published' END AS bucket FROM g) SELECT bucket, count(*)::BIGINT AS n FROM b GROUP BY 1""")
def gates_buckets(spark, d):
    c = scoring.collapse_by_event(_hits(spark, d)).withColumns({"tier": scoring.tier(F.lit(False)), "replied": F.col("o_orderkey") % 3 == 0, "citation_verified": F.col("o_orderkey") % 7 != 0, "base_rate": F.lit(0.0)})
    return scoring.gates(c).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@bound("""
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0)
SELECT k, CASE WHEN b.s IS NULL THEN 'missing' WHEN a.s IS NULL THEN 'unexpected' ELSE 'changed' END AS state FROM a FULL JOIN b USING (k) WHERE a.s IS NULL OR b.s IS NULL OR a.s <> b.s""")
def finding_set_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    new = o.where("k % 7 <> 0").withColumn("s", F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("s")))
    return ordered.set_diff(o.where("k % 5 <> 0"), new, "k", ["s"])


# ---- vendors


@bound("""
WITH s AS (SELECT s_nationkey, l_suppkey, sum(l_extendedprice::DECIMAL(18,2)) AS spend FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2), t AS (SELECT *, sum(spend) OVER (PARTITION BY s_nationkey) AS total, row_number() OVER (PARTITION BY s_nationkey ORDER BY spend DESC, l_suppkey) AS n FROM s)
SELECT s_nationkey, l_suppkey, spend::DECIMAL(28,2) AS spend, (spend / total > 0.2) AS concentrated FROM t WHERE n = 1""", double="spend")
def vendor_concentration(spark, d):
    x = lines(spark, d).groupBy("l_suppkey").agg(F.sum("amount").cast("decimal(28,2)").alias("spend"))
    s = x.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    top = s.groupBy("s_nationkey").agg(F.sum("spend").alias("total"), F.max(F.struct("spend", (-F.col("l_suppkey")).alias("m"))).alias("best"))
    return top.select("s_nationkey", (-F.col("best.m")).alias("l_suppkey"), F.col("best.spend").alias("spend"), (F.col("best.spend") / F.col("total") > 0.2).alias("concentrated"))


@bound("""
WITH v AS (SELECT o_custkey, year(o_orderdate) AS y, min(o_orderkey) AS a, max(o_orderkey) AS b, max(o_orderdate)::DATE - min(o_orderdate)::DATE AS days FROM orders GROUP BY 1, 2)
SELECT o_custkey, y::INTEGER AS year, ((b - a)::DOUBLE / days * 365)::DECIMAL(20,3) AS implied FROM v WHERE days > 0""", double="implied")
def implied_volume(spark, d):
    v = orders(spark, d).groupBy("o_custkey", F.year("day").alias("year")).agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"), F.datediff(F.max("day"), F.min("day")).alias("days"))
    return v.where("days > 0").select("o_custkey", "year", ((F.col("b") - F.col("a")).cast("double") / F.col("days") * 365).cast("decimal(20,3)").alias("implied"))


@bound("""
WITH m AS (SELECT s_suppkey, 'nation' AS kind, s_nationkey::VARCHAR AS value FROM supplier UNION ALL SELECT s_suppkey, 'band', ((s_acctbal::DECIMAL(18,2) * 100)::BIGINT // 50000)::VARCHAR FROM supplier WHERE s_acctbal >= 0)
SELECT kind, value, s_suppkey, n::BIGINT AS n FROM (SELECT *, count(*) OVER (PARTITION BY kind, value) AS n FROM m) WHERE n > 1""")
def shared_attribute_links(spark, d):
    s = table(spark, d, "supplier")
    a = s.select("s_suppkey", F.lit("nation").alias("kind"), F.col("s_nationkey").cast("string").alias("value"))
    b = s.where("s_acctbal >= 0").select("s_suppkey", F.lit("band").alias("kind"), F.floor(F.col("s_acctbal").cast(MONEY) / 500).cast("bigint").cast("string").alias("value"))
    return joins.shared_attributes(a.unionByName(b), "s_suppkey", "kind", "value")


@bound("""
WITH q AS (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM lineitem)
SELECT a.l_partkey, a.l_suppkey AS entity, b.l_suppkey AS other, a.l_orderkey AS number, b.l_orderkey AS other_number FROM q a JOIN q b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey
 AND (b.l_orderkey - a.l_orderkey BETWEEN 1 AND 50 OR (a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey))""")
def quote_sequential_numbers(spark, d):
    q = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey").distinct()
    return joins.numeric_band(q, "l_partkey", "l_suppkey", "l_orderkey", 50)


@bound("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]{3,}')) AS token FROM documents), f AS (SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1)
SELECT token, n::BIGINT AS n, docs::BIGINT AS docs, sqrt(n::DOUBLE * docs)::DECIMAL(20,3) AS rarity FROM f""", double="rarity")
def surname_rarity(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0))).alias("token"))
    f = w.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs"))
    return f.select("token", "n", "docs", F.sqrt(F.col("n").cast("double") * F.col("docs")).cast("decimal(20,3)").alias("rarity"))


@bound("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]{3,}')) AS token FROM documents), f AS (SELECT token, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM w GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total FROM f)
SELECT token, n, docs, sqrt(n::DOUBLE * docs)::DECIMAL(20,3) AS rarity, CASE WHEN n * 10000 < total THEN 1.3 WHEN n * 1000 <= total THEN 1.0 WHEN n * 100 <= total THEN 0.6 ELSE 0.3 END AS weight FROM f, t""", double="rarity weight")
def surname_weight(spark, d):
    """Every token with its statistic and the weight of its frequency per mille."""
    w = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0))).alias("token"))
    f = w.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs"))
    f = f.crossJoin(F.broadcast(w.agg(F.count(F.lit(1)).alias("total"))))
    weight = vendor_links.rarity(F.col("n") * 1000 / F.col("total"))
    return f.select("token", "n", "docs", F.sqrt(F.col("n").cast("double") * F.col("docs")).cast("decimal(20,3)").alias("rarity"), weight.alias("weight"))


@bound("""
WITH s AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 'S8' ELSE upper(event_type) END AS signal, (event_id % 40)::BIGINT AS points FROM events), e AS (SELECT user_id, signal, CASE WHEN signal = 'S8' THEN sum(points) ELSE max(points) END AS p FROM s GROUP BY 1, 2)
SELECT user_id, sum(p)::BIGINT AS points, string_agg(signal, ',' ORDER BY signal) AS signals, CASE WHEN sum(p) >= 80 THEN 'high' WHEN sum(p) >= 40 THEN 'medium' ELSE 'low' END AS band FROM e GROUP BY 1""")
def link_aggregation(spark, d):
    s = table(spark, d, "events").select("user_id", F.lit("r").alias("role"), F.when(F.col("event_type") == "click", "S8").otherwise(F.upper("event_type")).alias("signal"), (F.col("event_id") % 40).alias("points"))
    return scoring.link_points(s, "user_id", "role").select("user_id", "points", F.array_join("signals", ",").alias("signals"), "band")


@bound("""
WITH a AS (SELECT l_partkey, l_suppkey, (l_extendedprice::DECIMAL(18,2) * (1 - 0)) / l_quantity::DECIMAL(18,2) AS unit FROM lineitem WHERE l_quantity > 0), h AS (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS price FROM lineitem WHERE l_quantity > 0 GROUP BY 1)
SELECT p_partkey, ((p_retailprice * 1.0 + coalesce(h.price, 0) * 0.5) / (1.0 + CASE WHEN h.price IS NULL THEN 0 ELSE 0.5 END))::DECIMAL(18,4) AS expected, (1 + (h.price IS NOT NULL)::INT)::BIGINT AS layers FROM part LEFT JOIN h ON l_partkey = p_partkey""", double="expected")
def expected_price_layers(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.lit(1.0).alias("weight"))
    used = table(spark, d, "lineitem").where("l_quantity > 0").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    used = used.join(part.select("p_partkey"), "p_partkey", "left_semi").withColumn("weight", F.lit(0.5))
    layers = part.unionByName(used).withColumns({"low": F.col("price") * 0.8, "high": F.col("price") * 1.2})
    return scoring.expected_price(layers, "p_partkey").select("p_partkey", F.col("expected").cast("decimal(18,4)").alias("expected"), "layers")


@bound("""
WITH m AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate)::DATE AS period, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2), b AS (SELECT *, CASE WHEN period >= DATE '1999-01-01' THEN 'b2' WHEN period >= DATE '1997-01-01' THEN 'b1' ELSE 'b0' END AS base, lag(value) OVER (PARTITION BY series ORDER BY period) AS prev FROM m),
l AS (SELECT *, CASE WHEN lag(base) OVER (PARTITION BY series ORDER BY period) <> base THEN value / prev END AS link FROM b)
SELECT series, period, (value * exp(coalesce(sum(ln(link)) OVER (PARTITION BY series ORDER BY period ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)))::DECIMAL(20,3) AS chained FROM l""", double="chained", text="period")
def index_chain(spark, d):
    m = orders(spark, d).groupBy(F.col("o_orderpriority").alias("series"), F.trunc("day", "MM").alias("period")).agg(F.avg("o_totalprice").alias("value"))
    base = F.when(F.col("period") >= F.lit("1999-01-01"), "b2").when(F.col("period") >= F.lit("1997-01-01"), "b1").otherwise("b0")
    return ordered.chain_index(m.withColumn("base", base), "series", "period", "base", "value").select("series", "period", F.col("chained").cast("decimal(20,3)").alias("chained"))


@bound("""
SELECT n_nationkey, (DATE '2024-01-01' + INTERVAL (m) MONTH)::DATE AS month, (12000.00::DECIMAL(18,2) * (n_nationkey % 5 + 1)::DECIMAL(9,4) / 100 / 12)::DECIMAL(18,2) AS expected FROM nation, (SELECT unnest(range(12)) AS m)""", double="expected", text="month")
def quota_schedule(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 5 + 1).alias("share"))
    return ordered.quota_schedule(n, "n_nationkey", "share", 12000, "2024-01-01", 12)


# ---- folds and groups


@bound("""
WITH e AS (SELECT user_id, event_id, ts, sum(value::DECIMAL(18,2)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events),
p AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END END AS off FROM e),
l AS (SELECT *, coalesce(last_value(off IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT user_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE off <> before)::BIGINT AS breaks FROM l GROUP BY 1""")
def running_balance_reanchor(spark, d):
    e = table(spark, d, "events").withColumns({"amount": F.col("value").cast(MONEY), "open": F.lit(0)})
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    printed = F.when(F.col("event_id") % 7 != 0, F.sum("amount").over(by) + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0))
    return ordered.running_balance(e.withColumn("balance", printed.cast(MONEY)), "user_id", ["ts", "event_id"], "amount", "balance", "open")


@bound("""
WITH RECURSIVE p AS (SELECT conv_id, turn, role, CASE length(text) % 5 WHEN 0 THEN false WHEN 1 THEN true END AS link, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT conv_id, turn, n, 1 AS grp, [role] AS kinds FROM p WHERE n = 1 UNION ALL
 SELECT conv_id, turn, n, CASE WHEN j THEN grp ELSE grp + 1 END, CASE WHEN j THEN list_append(kinds, role) ELSE [role] END FROM (
  SELECT p.*, f.grp, f.kinds, len(f.kinds) < 3 AND coalesce(p.link, p.role = f.kinds[list_position(list_transform(f.kinds, lambda k: len(list_filter(f.kinds, lambda x: x = k))), list_max(list_transform(f.kinds, lambda k: len(list_filter(f.kinds, lambda x: x = k)))))]) AS j
  FROM f JOIN p ON p.conv_id = f.conv_id AND p.n = f.n + 1))
SELECT conv_id, turn, grp::INTEGER AS "group" FROM f""")
def page_grouping(spark, d):
    c = table(spark, d, "conversations").withColumn("link", F.when(F.length("text") % 5 == 0, False).when(F.length("text") % 5 == 1, True))
    return ordered.group_pages(c.select("conv_id", "turn", "role", "link"), "conv_id", "turn", "role", "link", cap=3).select("conv_id", "turn", "group")


@bound("""
WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, max(n) OVER (PARTITION BY source) AS top FROM c)
SELECT source, CASE WHEN count(*) > 1 THEN 'mixed' ELSE arg_min(lang, f) END AS lang, arg_min(lang, f) AS first_seen, max(n)::BIGINT AS votes FROM t WHERE n = top GROUP BY 1""")
def majority_with_tie(spark, d):
    return ordered.majority(table(spark, d, "documents"), "source", "lang", "doc_id")


@bound("""
WITH p AS (SELECT lang, doc_id, n_chars AS t, ('0x' || substr(md5(text), 1, 4))::BIGINT AS b FROM documents)
SELECT a.doc_id, arg_min(b.doc_id, (b.t, b.doc_id)) AS near FROM p a JOIN p b ON a.lang = b.lang AND (b.t < a.t OR (b.t = a.t AND b.doc_id < a.doc_id)) AND a.t - b.t <= 10 AND bit_count(xor(a.b, b.b)) <= 4 GROUP BY 1""")
def near_duplicate_pages(spark, d):
    p = table(spark, d, "documents").select("lang", "doc_id", F.col("n_chars").alias("t"), F.conv(F.substring(F.md5("text"), 1, 4), 16, 10).cast("bigint").alias("b"))
    return ordered.near_pages(p, "lang", "doc_id", "t", "b")


@bound("""
WITH k AS (SELECT doc_id, md5(lower(trim(text))) AS k FROM documents)
SELECT doc_id, CASE WHEN k IS NOT NULL THEN nullif(min(doc_id) OVER (PARTITION BY k), doc_id) END AS twin_of FROM k""", number="twin_of")
def doc_dedupe_twins(spark, d):
    k = table(spark, d, "documents").select("doc_id", F.md5(F.lower(F.trim("text"))).alias("k"))
    return ordered.twins(k, "k", [], "doc_id").select("doc_id", "twin_of")


# ---- functions

_PLAIN = [(a, b) for a, b in zip(text.ACCENTED, text.PLAIN)]


@bound(f"""
SELECT doc_id, md5(nullif(trim(regexp_replace(lower(regexp_replace(translate(translate(text, '·', ' '), '{text.ACCENTED}', '{text.PLAIN}'), '[\\u0300-\\u036f]', '', 'g')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '')) AS folded FROM documents""".replace("\\u0300-\\u036f", "̀-ͯ"))
def normalise_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.norm_text(F.col("text"))).alias("folded"))


@bound("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice::DECIMAL(18,2) WHEN 1 THEN -(o_totalprice::DECIMAL(18,2)) WHEN 2 THEN -(o_totalprice::DECIMAL(18,2)) ELSE NULL END::DECIMAL(18,4) AS parsed FROM orders""", double="parsed")
def parse_amounts(spark, d):
    o = orders(spark, d)
    written = amounts.format_amount(F.col("amount"))
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.concat(written, F.lit(" €"))).when(k == 1, F.concat(written, F.lit("-"))).when(k == 2, F.concat(F.lit("("), written, F.lit(")"))).otherwise(F.concat(F.lit("n/a "), written))
    return o.select("o_orderkey", amounts.parse_amount(shown).alias("parsed"))


@bound("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::DATE END AS parsed FROM orders", text="parsed")
def parse_dates(spark, d):
    k = F.col("o_orderkey") % 4
    #: Catalan month names with their linking words.
    names = ["de gener", "de febrer", "de març", "d'abril", "de maig", "de juny", "de juliol", "d'agost", "de setembre", "d'octubre", "de novembre", "de desembre"]
    worded = F.concat(F.lit("Barcelona, "), F.dayofmonth("day"), F.lit(" "), F.element_at(F.array(*map(F.lit, names)), F.month("day")), F.lit(" de "), F.year("day"))
    shown = F.when(k == 0, F.date_format("day", "dd/MM/yyyy")).when(k == 1, F.date_format("day", "yyyy-MM-dd")).when(k == 2, worded).otherwise(F.date_format("day", "'32/13/'yyyy"))
    return orders(spark, d).select("o_orderkey", dates.parse_date(shown).alias("parsed"))


@bound("""
WITH k AS (SELECT c_custkey, lpad((c_custkey * 7919 % 100000000)::VARCHAR, 8, '0') AS n FROM customer), l AS (SELECT *, substr('TRWAGMYFPDXBNJZSQVHLCKE', (n::BIGINT % 23)::INT + 1, 1) AS right_letter FROM k)
SELECT c_custkey, c_custkey % 3 <> 0 OR right_letter = 'A' AS valid, CASE WHEN c_custkey % 3 <> 0 OR right_letter = 'A' THEN 'DNI' ELSE 'INVALID' END AS kind,
 lpad((98 - ((n || '0000000000' || substr(n, 1, 2) || '142800')::HUGEINT % 97))::VARCHAR, 2, '0') AS check_digits FROM l""")
def validate_ids(spark, d):
    n = F.lpad((F.col("c_custkey") * 7919 % 100000000).cast("string"), 8, "0")
    good = F.substr(F.lit(ids.PERSON_LETTERS), (n.cast("bigint") % 23).cast("int") + 1, F.lit(1))
    nif = F.concat(n, F.when(F.col("c_custkey") % 3 == 0, "A").otherwise(good))
    c = table(spark, d, "customer").withColumn("c", ids.check_nif(nif))
    account = F.concat(n, F.lit("0000000000"), F.substring(n, 1, 2))
    return c.select("c_custkey", "c.valid", "c.kind", ids.iban_check_digits(F.lit("ES"), account).alias("check_digits"))


@bound("SELECT c_custkey, repeat('*', 20) || right('ES00' || lpad(c_custkey::VARCHAR, 20, '0'), 4) AS masked, 'pay [IBAN] or [EMAIL] for ' || c_name AS cleaned FROM customer")
def iban_masking(spark, d):
    iban = F.concat(F.lit("ES00"), F.lpad(F.col("c_custkey").cast("string"), 20, "0"))
    note = F.concat(F.lit("pay "), iban, F.lit(" or c"), F.col("c_custkey"), F.lit("@mail.example for "), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", text.mask_iban(iban).alias("masked"), text.redact(note).alias("cleaned"))


@bound("""
SELECT o_orderstatus, count(*)::BIGINT AS n, sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N'))::DECIMAL(28,2) AS supported,
 count(*) FILTER (WHERE EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey AND event_type = 'signup'))::BIGINT AS confirmed FROM orders GROUP BY 1""", double="supported")
def supported_spend(spark, d):
    kept = lines(spark, d).where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("s", F.lit(True))
    known = events(spark, d).where("event_type = 'signup'").select(F.col("user_id").alias("o_custkey")).distinct().withColumn("c", F.lit(True))
    o = orders(spark, d).join(kept, "o_orderkey", "left").join(known, "o_custkey", "left")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("s"), F.col("amount"))).cast("decimal(28,2)").alias("supported"), F.count_if(F.coalesce("c", F.lit(False))).alias("confirmed"))


@bound("SELECT (SELECT count(*) FROM orders)::BIGINT AS orders, (SELECT count(*) FROM lineitem)::BIGINT AS lines, (SELECT count(DISTINCT user_id) FROM events)::BIGINT AS users, (SELECT count(*) FROM documents WHERE lang = 'en')::BIGINT AS english, (SELECT count(*) FROM pages)::BIGINT AS pages")
def corpus_counters(spark, d):
    parts = [
        orders(spark, d).agg(F.count(F.lit(1)).alias("orders")), lines(spark, d).agg(F.count(F.lit(1)).alias("lines")), events(spark, d).agg(F.count_distinct("user_id").alias("users")),
        table(spark, d, "documents").agg(F.count_if(F.col("lang") == "en").alias("english")), table(spark, d, "pages").agg(F.count(F.lit(1)).alias("pages")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


@bound("SELECT n_regionkey, string_agg(DISTINCT n_name, '; ' ORDER BY n_name) AS names, to_json(list(struct_pack(k := n_nationkey) ORDER BY n_nationkey))::VARCHAR AS items FROM nation GROUP BY 1")
def listagg_arrays(spark, d):
    n = table(spark, d, "nation")
    return n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), "; ").alias("names"), F.to_json(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"))))).alias("items"))


@bound("SELECT o_orderkey, substr(sha256('D1|' || o_orderkey || '|' || o_orderstatus || '|'), 1, 32) AS fp, sha256(o_custkey || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || (o_totalprice::DECIMAL(18,2))::VARCHAR || '|' || o_orderpriority) AS tx FROM orders")
def fingerprints_sha(spark, d):
    o = orders(spark, d)
    return o.select("o_orderkey", hashing.fingerprint(F.lit("D1"), F.col("o_orderkey"), F.col("o_orderstatus"), F.lit(None)).alias("fp"), hashing.transaction_key(F.col("o_custkey"), F.col("day"), F.col("amount"), F.col("o_orderpriority")).alias("tx"))


@bound("""
WITH c AS (SELECT c_custkey, c_nationkey || '-' || ((abs(c_acctbal::DECIMAL(18,2)) * 100)::BIGINT // 1000) AS k1, c_nationkey || '-' || ((abs(c_acctbal::DECIMAL(18,2)) * 100)::BIGINT // 100000) AS k2 FROM customer), s AS (SELECT s_suppkey, s_nationkey || '-' || ((abs(s_acctbal::DECIMAL(18,2)) * 100)::BIGINT // 1000) AS k1, s_nationkey || '-' || ((abs(s_acctbal::DECIMAL(18,2)) * 100)::BIGINT // 100000) AS k2 FROM supplier),
m1 AS (SELECT min(c_custkey) AS c_custkey, min(s_suppkey) AS s_suppkey FROM c JOIN s USING (k1) GROUP BY k1 HAVING count(*) = 1), c2 AS (SELECT * FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM m1)), s2 AS (SELECT * FROM s WHERE s_suppkey NOT IN (SELECT s_suppkey FROM m1))
SELECT c_custkey, s_suppkey, 1::INTEGER AS phase FROM m1 UNION ALL SELECT min(c_custkey), min(s_suppkey), 2 FROM c2 JOIN s2 USING (k2) GROUP BY k2 HAVING count(*) = 1""")
def cadastre_two_phase_match(spark, d):
    def keyed(name, own, nation, bal):
        b = F.abs(F.col(bal).cast(MONEY))
        return table(spark, d, name).select(own, *(F.concat_ws("-", nation, F.floor(b / w).cast("bigint")).alias(k) for k, w in (("k1", 10), ("k2", 1000))))

    return joins.two_phase_match(keyed("customer", "c_custkey", "c_nationkey", "c_acctbal"), keyed("supplier", "s_suppkey", "s_nationkey", "s_acctbal"), [("k1", "k1"), ("k2", "k2")], "c_custkey", "s_suppkey")


@bound("""
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice > 150000 END AS a, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus = 'O' END AS b, o_orderpriority LIKE '1%' AS c FROM orders),
n AS (SELECT o_orderkey, coalesce(a::INT, 0) + coalesce(b::INT, 0) + c::INT AS yes, (a IS NULL)::INT + (b IS NULL)::INT AS open FROM f) SELECT o_orderkey, CASE WHEN yes * 2 > 3 THEN true WHEN (yes + open) * 2 <= 3 THEN false END AS passed FROM n""", text="passed")
def three_valued_majority(spark, d):
    a = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") > 150000)
    b = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus") == "O")
    return table(spark, d, "orders").select("o_orderkey", text.majority([a, b, F.col("o_orderpriority").like("1%")]).alias("passed"))


# ---- distribution tests


@bound("""
WITH d AS (SELECT regexp_extract((abs(l_extendedprice)::DECIMAL(38,6))::VARCHAR, '[1-9]')::INTEGER AS digit FROM lineitem WHERE l_extendedprice <> 0), c AS (SELECT digit, count(*) AS n FROM d GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total, log10(1 + 1.0::DOUBLE / digit) AS e FROM c)
SELECT digit, n::BIGINT AS n, (n / total)::DECIMAL(12,8) AS share, (total * (n / total - e) ** 2 / e)::DECIMAL(20,4) AS chi_square FROM t""", double="share chi_square")
def leading_digits(spark, d):
    out = report.first_digits(table(spark, d, "lineitem"), "l_extendedprice")
    return out.select("digit", "n", F.col("share").cast("decimal(12,8)").alias("share"), F.col("chi_square").cast("decimal(20,4)").alias("chi_square"))


@bound("""
WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS n FROM orders), t AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS a, min(o_totalprice) AS b FROM r WHERE n <= 2 GROUP BY 1)
SELECT o_custkey, n::BIGINT AS n, a AS largest, (a / b)::DECIMAL(20,6) AS factor FROM t WHERE n = 2 AND b > 0""", double="factor")
def relative_size_factor(spark, d):
    out = report.relative_size(table(spark, d, "orders"), "o_custkey", "o_totalprice")
    return out.withColumn("factor", F.col("factor").cast("decimal(20,6)"))


@bound("""
SELECT l_partkey, count(*)::BIGINT AS n, regr_slope(l_extendedprice, (l_shipdate::DATE - DATE '1970-01-01'))::DECIMAL(20,4) AS slope FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND regr_slope(l_extendedprice, (l_shipdate::DATE - DATE '1970-01-01')) IS NOT NULL""", double="slope")
def price_drift(spark, d):
    out = report.price_drift(lines(spark, d), "l_partkey", "day", "l_extendedprice").where("slope IS NOT NULL")
    return out.withColumn("slope", F.col("slope").cast("decimal(20,4)"))


@bound("""
WITH e AS (SELECT n_regionkey, s_suppkey, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2), s AS (SELECT *, v / sum(v) OVER (PARTITION BY n_regionkey) AS s FROM e)
SELECT n_regionkey, sum(s * s)::DECIMAL(12,6) AS hhi FROM s GROUP BY 1""", double="hhi")
def concentration_index(spark, d):
    x = lines(spark, d).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return report.concentration_index(x, "n_regionkey", "s_suppkey", "l_extendedprice").withColumn("hhi", F.col("hhi").cast("decimal(12,6)"))
