"""Ledger queries and their SQL. Closings are scaled down so that most books never close more than they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navloom.operators import ledger as L
from navloom.plans.base import Catalogue, rounded
from navloom.sources.analogue import prelude, view

C = Catalogue()

# Every fifth reversal names the transaction before it in its book; redemptions are a tenth of the event's value.
_T = prelude("txn") + """,
t0 AS (SELECT *, LAG(txn_ref) OVER (PARTITION BY user_id, folio, scheme_id ORDER BY txn_date, txn_ref) AS prev FROM txn),
t AS (SELECT user_id, folio, scheme_id, txn_date, txn_ref, txn_type, CAST(amount AS DOUBLE) AS amount, CASE WHEN txn_type = 'REDEMPTION' THEN CAST(FLOOR(units * 100) / 1000 AS DECIMAL(18,3)) ELSE units END AS units,
        CASE WHEN txn_type = 'REVERSAL' AND txn_ref % 5 = 0 THEN prev END AS reverses_ref FROM t0),
k AS (SELECT * FROM t WHERE txn_type <> 'REVERSAL' AND txn_ref NOT IN (SELECT reverses_ref FROM t WHERE reverses_ref IS NOT NULL))
"""  # fmt: skip


def _all(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("txn_ref").over(Window.partitionBy(*L.BOOK).orderBy("txn_date", "txn_ref"))
    units = F.when(F.col("txn_type") == "REDEMPTION", (F.floor(F.col("units") * 100) / 1000).cast("decimal(18,3)")).otherwise(F.col("units"))
    rows = view(spark, d, "txn").withColumn("reverses_ref", F.when((F.col("txn_type") == "REVERSAL") & (F.col("txn_ref") % 5 == 0), before))
    return rows.withColumn("units", units).withColumn("amount", F.col("amount").cast("double"))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return L.drop_reversed(_all(spark, d))


def _sound(spark: SparkSession, d: str) -> DataFrame:
    kept = _kept(spark, d)
    return kept.join(L.shortfalls(kept).select(*L.BOOK), L.BOOK, "left_anti")


@C.query(_T + "SELECT txn_ref, user_id, folio, scheme_id, txn_date, txn_type, amount, CAST(units AS DOUBLE) AS units FROM k")
def drop_reversed(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d).withColumn("units", F.col("units").cast("double")).drop("reverses_ref")


@C.query(_T + "SELECT txn_ref, ROW_NUMBER() OVER (PARTITION BY user_id, folio, scheme_id, txn_date ORDER BY txn_ref) - 1 AS txn_seq FROM k")
def txn_sequences(spark: SparkSession, d: str) -> DataFrame:
    return L.sequenced(_kept(spark, d)).select("txn_ref", "txn_seq")


@C.query(_T + """, q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, folio, scheme_id, txn_date ORDER BY txn_ref) - 1 AS s FROM k)
SELECT txn_ref, sha256(concat_ws('|', user_id, folio, scheme_id, txn_date, s, txn_type, units, CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR))) AS txn_id FROM q""")  # fmt: skip
def txn_ids_sha256(spark: SparkSession, d: str) -> DataFrame:
    rows = L.sequenced(_kept(spark, d)).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    return L.with_ids(rows).select("txn_ref", "txn_id")


_FLOW = _T + """, f AS (SELECT *, CASE WHEN txn_type IN ('PURCHASE', 'SIP') THEN -ABS(amount) WHEN txn_type IN ('REDEMPTION', 'IDCW_PAYOUT') THEN ABS(amount) END AS flow FROM k)
"""


@C.query(_FLOW + "SELECT user_id, folio, scheme_id, txn_date, ROUND(SUM(flow), 2) AS flow FROM f WHERE flow IS NOT NULL GROUP BY 1, 2, 3, 4")
def cashflows_scheme(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.cashflows(_kept(spark, d), L.BOOK), flow=2)


@C.query(_FLOW + "SELECT user_id, txn_date, ROUND(SUM(flow), 2) AS flow FROM f WHERE flow IS NOT NULL GROUP BY 1, 2")
def cashflows_portfolio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.cashflows(_kept(spark, d), ["user_id"]), flow=2)


@C.query()
def xirr(spark: SparkSession, d: str) -> DataFrame:
    return L.xirr(L.cashflows(_kept(spark, d), ["user_id"]), "user_id")


@C.query(_T + """, h AS (SELECT *, SUM(CASE WHEN txn_type IN ('PURCHASE', 'SIP') THEN units WHEN txn_type = 'REDEMPTION' THEN -units ELSE 0 END) OVER (PARTITION BY user_id, folio, scheme_id ORDER BY txn_date, txn_ref) AS held FROM k)
SELECT user_id, folio, scheme_id, CAST(MIN(held) AS DOUBLE) AS lowest FROM h GROUP BY 1, 2, 3 HAVING MIN(held) < 0""")  # fmt: skip
def ledger_shortfalls(spark: SparkSession, d: str) -> DataFrame:
    return L.shortfalls(_kept(spark, d)).withColumn("lowest", F.col("lowest").cast("double"))


# Independent of the operator: cumulative intervals of lots and closings, joined where they overlap.
_FIFO = _T + """, h AS (SELECT *, SUM(CASE WHEN txn_type IN ('PURCHASE', 'SIP') THEN units WHEN txn_type = 'REDEMPTION' THEN -units ELSE 0 END) OVER (PARTITION BY user_id, folio, scheme_id ORDER BY txn_date, txn_ref) AS held FROM k),
g AS (SELECT user_id, folio, scheme_id FROM h GROUP BY 1, 2, 3 HAVING MIN(held) >= 0), s AS (SELECT k.* FROM k JOIN g USING (user_id, folio, scheme_id) WHERE units > 0),
a AS (SELECT *, SUM(units) OVER (PARTITION BY user_id, folio, scheme_id ORDER BY txn_date, txn_ref) AS e FROM s WHERE txn_type IN ('PURCHASE', 'SIP')),
c AS (SELECT *, SUM(units) OVER (PARTITION BY user_id, folio, scheme_id ORDER BY txn_date, txn_ref) AS e FROM s WHERE txn_type = 'REDEMPTION'),
o AS (SELECT a.user_id, a.folio, a.scheme_id, a.txn_ref AS lot_ref, c.txn_ref AS close_ref, a.txn_date AS ad, c.txn_date AS sale_date, CAST(LEAST(a.e, c.e) - GREATEST(a.e - a.units, c.e - c.units) AS DOUBLE) AS used, LEAST(a.e, c.e) = a.e AS empties,
        ABS(a.amount) AS cost_total, CAST(a.units AS DOUBLE) AS au, ABS(c.amount) AS ca, CAST(c.units AS DOUBLE) AS cu
      FROM a JOIN c ON a.user_id = c.user_id AND a.folio = c.folio AND a.scheme_id = c.scheme_id AND LEAST(a.e, c.e) > GREATEST(a.e - a.units, c.e - c.units)),
r AS (SELECT *, FLOOR(cost_total / au * used * 1e4 + 0.5) / 1e4 AS rough FROM o),
z AS (SELECT *, LEAST(cost_total, SUM(rough) OVER w) AS s1, LEAST(cost_total, COALESCE(SUM(rough) OVER (PARTITION BY lot_ref ORDER BY sale_date, close_ref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s0 FROM r WINDOW w AS (PARTITION BY lot_ref ORDER BY sale_date, close_ref)),
x AS (SELECT *, CASE WHEN empties THEN cost_total - s0 ELSE s1 - s0 END AS cost, ca / cu * used AS proceeds, sale_date - ad AS holding_days, CASE WHEN sale_date - ad > 365 THEN 'LTCG' ELSE 'STCG' END AS gain_type,
        CASE WHEN month(sale_date) >= 4 THEN year(sale_date) || '-' || lpad(CAST((year(sale_date) + 1) % 100 AS VARCHAR), 2, '0') ELSE (year(sale_date) - 1) || '-' || lpad(CAST(year(sale_date) % 100 AS VARCHAR), 2, '0') END AS fy FROM z)
"""  # fmt: skip


def _consumed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sound = _sound(spark, d)
    return sound, L.fifo(sound)


@C.query(_FIFO + "SELECT user_id, folio, scheme_id, lot_ref, close_ref, sale_date, ROUND(used, 3) AS used, ROUND(cost, 4) AS cost, ROUND(proceeds, 3) AS proceeds, holding_days, gain_type, fy FROM x")
def fifo_consumptions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_consumed(spark, d)[1], used=3, cost=4, proceeds=3)


@C.query(_FIFO + """, u AS (SELECT lot_ref, SUM(used) AS used, SUM(cost) AS cost FROM x GROUP BY 1)
SELECT user_id, folio, scheme_id, txn_ref AS lot_ref, txn_date, ROUND(CAST(units AS DOUBLE) - COALESCE(used, 0), 3) AS units_left, ROUND(ABS(amount) - COALESCE(cost, 0), 3) AS cost_left FROM a LEFT JOIN u ON a.txn_ref = u.lot_ref WHERE CAST(units AS DOUBLE) - COALESCE(used, 0) > 0.0005""")  # fmt: skip
def lots_remaining(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.lots_remaining(*_consumed(spark, d)), units_left=3, cost_left=3)


@C.query(_FIFO + """, u AS (SELECT lot_ref, SUM(used) AS used, SUM(cost) AS cost FROM x GROUP BY 1),
l AS (SELECT user_id, folio, scheme_id, SUM(CAST(units AS DOUBLE) - COALESCE(used, 0)) AS units, SUM(ABS(amount) - COALESCE(cost, 0)) AS cost FROM a LEFT JOIN u ON a.txn_ref = u.lot_ref WHERE CAST(units AS DOUBLE) - COALESCE(used, 0) > 0.0005 GROUP BY 1, 2, 3),
v AS (SELECT user_id, folio, scheme_id, SUM(proceeds - cost) AS realised FROM x GROUP BY 1, 2, 3),
b AS (SELECT k.user_id, k.folio, k.scheme_id, MIN(txn_date) AS first_purchase, MAX(txn_date) AS last_purchase, SUM(amount) AS invested FROM k JOIN g USING (user_id, folio, scheme_id) WHERE txn_type IN ('PURCHASE', 'SIP') GROUP BY 1, 2, 3)
SELECT b.user_id, b.folio, b.scheme_id, first_purchase, last_purchase, ROUND(invested, 2) AS invested, ROUND(COALESCE(units, 0), 3) AS units, ROUND(COALESCE(cost, 0), 2) AS cost, ROUND(COALESCE(realised, 0), 2) AS realised, ROUND(CASE WHEN units > 0 THEN cost / units END, 4) AS avg_cost
FROM b LEFT JOIN l USING (user_id, folio, scheme_id) LEFT JOIN v USING (user_id, folio, scheme_id)""")  # fmt: skip
def positions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.positions(*_consumed(spark, d)), invested=2, units=3, cost=2, realised=2, avg_cost=4)


@C.query(_FIFO + "SELECT user_id, fy, gain_type, ROUND(SUM(proceeds), 2) AS proceeds, ROUND(SUM(cost), 2) AS cost, ROUND(SUM(proceeds - cost), 2) AS gain, COUNT(*) AS n FROM x GROUP BY 1, 2, 3")
def realised_by_fy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.realised_by_year(_consumed(spark, d)[1]), proceeds=2, cost=2, gain=2)


@C.query(prelude("nav") + """, e AS (SELECT scheme_id, arg_min(nav, nav_date) AS n0, arg_max(nav, nav_date) AS n1, MAX(nav_date) - MIN(nav_date) AS days FROM nav GROUP BY 1)
SELECT scheme_id, days, ROUND(n1 / n0 - 1, 8) AS twrr, ROUND(CASE WHEN days >= 365 THEN EXP(LN(n1 / n0) * 365.0::DOUBLE / days) - 1 END, 8) AS twrr_annual FROM e""")  # fmt: skip
def twrr(spark: SparkSession, d: str) -> DataFrame:
    ends = view(spark, d, "nav").groupBy("scheme_id").agg(F.min_by("nav", "nav_date").alias("n0"), F.max_by("nav", "nav_date").alias("n1"), F.datediff(F.max("nav_date"), F.min("nav_date")).alias("days"))
    growth, annual = L.twrr(F.col("n0"), F.col("n1"), F.col("days"))
    return ends.select("scheme_id", "days", F.round(growth, 8).alias("twrr"), F.round(annual, 8).alias("twrr_annual"))


@C.query(_FLOW + """, s AS (SELECT user_id, -SUM(CASE WHEN flow < 0 THEN flow ELSE 0 END) AS invested, SUM(CASE WHEN flow > 0 THEN flow ELSE 0 END) AS received FROM f GROUP BY 1)
SELECT user_id, ROUND(invested, 2) AS invested, ROUND(received, 2) AS received, ROUND(CASE WHEN invested > 0 THEN received / invested - 1 END, 8) AS absolute_return FROM s""")  # fmt: skip
def absolute_return(spark: SparkSession, d: str) -> DataFrame:
    flows = L.cashflows(_kept(spark, d).withColumn("day", F.col("txn_ref")), ["user_id", "day"])
    sides = flows.groupBy("user_id").agg((-F.sum(F.when(F.col("flow") < 0, F.col("flow")).otherwise(0.0))).alias("invested"), F.sum(F.when(F.col("flow") > 0, F.col("flow")).otherwise(0.0)).alias("received"))
    return rounded(sides.withColumn("absolute_return", F.when(F.col("invested") > 0, F.col("received") / F.col("invested") - 1)), invested=2, received=2, absolute_return=8)


@C.query(_T + """, b AS (SELECT user_id, folio, scheme_id, CAST(SUM(CASE WHEN txn_type IN ('PURCHASE', 'SIP') THEN units WHEN txn_type = 'REDEMPTION' THEN -units ELSE 0 END) AS DOUBLE) AS u FROM k GROUP BY 1, 2, 3),
p AS (SELECT *, CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 7 = 0 THEN u + 1 WHEN user_id % 5 = 0 THEN u - 1 ELSE u END AS pu FROM b)
SELECT user_id, folio, scheme_id, ROUND(u - pu, 3) AS units_delta, CASE WHEN pu IS NULL THEN 'warn' WHEN ABS(u - pu) > 0.001 THEN 'fail' ELSE 'ok' END AS status,
  CASE WHEN pu IS NULL THEN 'no balance printed' WHEN u - pu < -0.001 THEN 'purchases missing' WHEN u - pu > 0.001 THEN 'redemptions missing' ELSE '' END AS diagnosis FROM p""")  # fmt: skip
def reconcile_units(spark: SparkSession, d: str) -> DataFrame:
    books = _kept(spark, d).groupBy(*L.BOOK).agg(F.sum(L.signed_units(F.col("txn_type"), F.col("units"))).cast("double").alias("units"))
    user = F.col("user_id")
    printed = F.when(user % 11 == 0, F.lit(None)).when(user % 7 == 0, F.col("units") + 1).when(user % 5 == 0, F.col("units") - 1).otherwise(F.col("units"))
    known = books.withColumn("printed_units", printed.cast("double")).withColumn("value", F.lit(None).cast("double")).withColumn("printed_value", F.lit(None).cast("double"))
    return rounded(L.reconcile(known).withColumn("diagnosis", F.array_join("diagnosis", ", ")), units_delta=3)


@C.query(prelude("nav") + """, t AS (SELECT l_suppkey AS scheme_id, CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity AS p FROM lineitem)
SELECT t.scheme_id, COUNT(CASE WHEN ABS(p - nav) <= nav * 0.005::DOUBLE THEN 1 END) AS matched, COUNT(CASE WHEN NOT ABS(p - nav) <= nav * 0.005::DOUBLE THEN 1 END) AS mismatched, COUNT(CASE WHEN nav IS NULL THEN 1 END) AS unavailable
FROM t LEFT JOIN nav ON t.scheme_id = nav.scheme_id AND d = nav_date GROUP BY 1""")  # fmt: skip
def nav_cross_check(spark: SparkSession, d: str) -> DataFrame:
    printed = view(spark, d, "lineitem").select(F.col("l_suppkey").alias("scheme_id"), F.col("l_shipdate").cast("date").alias("txn_date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("printed_nav"))
    return L.price_check(printed, view(spark, d, "nav"))


def _switching(spark: SparkSession, d: str) -> DataFrame:
    """Purchases and redemptions read as legs of switches, with charges by reference."""
    kind = F.when(F.col("txn_type") == "PURCHASE", F.when(F.col("txn_ref") % 5 == 0, "STP_IN").otherwise("SWITCH_IN")).when(F.col("txn_type") == "REDEMPTION", F.when(F.col("txn_ref") % 7 == 0, "STP_OUT").otherwise("SWITCH_OUT")).otherwise(F.col("txn_type"))
    charge = lambda n, step: (F.col("txn_ref") % n * step).cast("decimal(10,2)")
    return _all(spark, d).select("*", charge(3, 0.25).alias("exit_load"), charge(2, 0.1).alias("stt"), charge(4, 0.05).alias("stamp_duty")).withColumn("txn_type", kind)


@C.query(_T.replace("WITH", "WITH RECURSIVE", 1) + """, g AS (
  SELECT user_id, folio, txn_date, txn_ref, txn_type = 'REDEMPTION' AS o,
         CAST(ROUND(ABS(amount) * 10000) AS BIGINT) + CASE WHEN txn_type = 'REDEMPTION' THEN -(txn_ref % 3 * 2500 + txn_ref % 2 * 1000) ELSE txn_ref % 4 * 500 END AS money
  FROM t WHERE txn_type IN ('PURCHASE', 'REDEMPTION')),
n AS (SELECT user_id, folio, txn_date, list(struct_pack(ref := txn_ref, m := money) ORDER BY txn_ref) AS legs FROM g WHERE NOT o GROUP BY ALL),
j AS (SELECT g.*, legs, ROW_NUMBER() OVER (PARTITION BY user_id, folio, txn_date ORDER BY txn_ref) AS rn FROM g LEFT JOIN n USING (user_id, folio, txn_date) WHERE o),
w AS (
  SELECT DISTINCT user_id, folio, txn_date, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS out_ref, CAST(NULL AS BIGINT) AS in_ref FROM j
  UNION ALL
  SELECT user_id, folio, txn_date, rn, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, txn_ref, pick
  FROM (SELECT j.*, w.taken, list_filter(j.legs, lambda x: NOT list_contains(w.taken, x.ref) AND ABS(x.m - j.money) <= 10000)[1].ref AS pick
        FROM w JOIN j ON w.user_id = j.user_id AND w.folio = j.folio AND w.txn_date = j.txn_date AND j.rn = w.rn + 1))
SELECT user_id, folio, txn_date, out_ref, in_ref FROM w WHERE rn > 0""")  # fmt: skip
def link_switches(spark: SparkSession, d: str) -> DataFrame:
    return L.link_switches(_switching(spark, d))


@C.query(_T.replace("WITH", "WITH RECURSIVE", 1) + """, z AS (
  SELECT *, CAST(user_id AS VARCHAR) || '/' || folio || '/' || scheme_id || '/' || CAST(FLOOR(units) AS BIGINT) AS g, txn_type = 'REVERSAL' AS rev FROM t),
v AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY txn_date, rev, txn_ref) AS rn FROM z WHERE g IN (SELECT g FROM z WHERE rev)),
w AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(ref BIGINT, d DATE)[]) AS stack, CAST(NULL AS BIGINT) AS reversal_ref, CAST(NULL AS BIGINT) AS txn_ref FROM v
  UNION ALL
  SELECT g, rn, CASE WHEN NOT rev THEN list_append(stack, struct_pack(ref := txn_ref, d := txn_date)) WHEN hit THEN stack[1:len(stack) - 1] ELSE stack END,
         CASE WHEN rev THEN txn_ref END, CASE WHEN rev AND hit THEN stack[len(stack)].ref END
  FROM (SELECT v.*, w.stack, len(w.stack) > 0 AND v.txn_date - w.stack[len(w.stack)].d <= 30 AS hit FROM w JOIN v ON w.g = v.g AND v.rn = w.rn + 1))
SELECT reversal_ref, txn_ref FROM w WHERE reversal_ref IS NOT NULL""")  # fmt: skip
def link_reversals(spark: SparkSession, d: str) -> DataFrame:
    units = F.floor("units").cast("decimal(18,3)")
    return L.link_reversals(_all(spark, d).withColumn("units", F.when(F.col("txn_type") == "REVERSAL", -units).otherwise(units)))
