"""Returns of positions and reconciliation of books, and their SQL: rates by halving an interval, causes by row arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navloom.operators import lots as L
from navloom.operators import returns as R
from navloom.operators.ledger import BOOK
from navloom.operators.statement import OPENING_TYPES
from navloom.plans.base import Catalogue, rounded
from navloom.plans.lots import _ROWS
from navloom.sources.analogue import view
from navloom.sources.store import shared_folder, written

C = Catalogue()

# A third of the mean price of a fund's rows on a day is its published price, units close at 10 each, units held get a hundredth of a payout's amount, and positions are valued 120 days after the last row.
_PRICE = "SELECT scheme_id, txn_date AS nav_date, FLOOR(CAST(SUM(nav) AS DOUBLE) / COUNT(*) / 3 * 1e4 + 0.5) / 1e4 AS nav FROM {book_txn} GROUP BY scheme_id, txn_date"
_SOUND = _ROWS.replace("WITH", "WITH RECURSIVE", 1) + ", p AS (" + _PRICE.replace("{book_txn}", "book_txn") + """),
g AS (SELECT user_id, folio, scheme_id, SUM(CASE WHEN opens THEN u WHEN closes THEN -u ELSE 0 END) / 1000 AS units FROM h GROUP BY 1, 2, 3 HAVING MIN(held) >= 0),
v AS (SELECT MAX(txn_date) + 120 AS as_of FROM book_txn),
i AS (SELECT * REPLACE (CASE WHEN closes THEN u * 100 WHEN txn_type = 'IDCW_PAYOUT' THEN CASE WHEN held > 0 THEN m // 100 END ELSE m END AS m) FROM h)
"""  # fmt: skip


def _navs(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_PRICE, book_txn=view(spark, d, "book_txn"))


def _as_of(spark: SparkSession, d: str) -> Column:
    return F.lit(view(spark, d, "book_txn").agg(F.date_add(F.max("txn_date"), 120)).first()[0]).cast("date")


def _moved() -> Column:
    return F.when(F.col("txn_type").isin(*OPENING_TYPES), F.col("units")).when(F.col("txn_type").isin(*L.CLOSING_TYPES), -F.col("units")).otherwise(F.lit(0).cast("decimal(20,6)"))


def _running() -> Column:
    return F.sum(_moved()).over(Window.partitionBy(*BOOK).orderBy("txn_date", "txn_ref"))


def _held(rows: DataFrame) -> DataFrame:
    """Units of each book that never closed more than it held, by the ledger's running sum."""
    return rows.withColumn("moved", _moved()).withColumn("running", _running()).groupBy(*BOOK).agg(F.sum("moved").alias("units"), F.min("running").alias("lowest")).filter("lowest >= 0").drop("lowest")


@C.query(_SOUND + """, f AS (
  SELECT user_id, folio, scheme_id, txn_date, SUM(CASE WHEN txn_type = 'IDCW_REINVEST' THEN NULL WHEN opens THEN -m WHEN closes THEN m - taken WHEN txn_type = 'IDCW_PAYOUT' THEN m END) / 10000 AS flow FROM i GROUP BY 1, 2, 3, 4),
o AS (SELECT user_id, folio, scheme_id, SUM(CASE WHEN txn_type = 'IDCW_REINVEST' THEN 0 WHEN opens THEN m ELSE 0 END) / 10000 - SUM(CASE WHEN closes THEN m - taken ELSE 0 END) / 10000 AS net, MIN(CASE WHEN opens THEN txn_date END) AS fp FROM i GROUP BY 1, 2, 3),
b AS (SELECT g.*, o.net, o.fp, v.as_of, (SELECT arg_max(nav, nav_date) FROM p WHERE p.scheme_id = g.scheme_id AND p.nav_date <= o.fp) AS n0, (SELECT arg_max(nav, nav_date) FROM p WHERE p.scheme_id = g.scheme_id AND p.nav_date <= v.as_of) AS n1
      FROM g JOIN o USING (user_id, folio, scheme_id), v WHERE o.fp IS NOT NULL),
a AS (SELECT user_id, folio, scheme_id, txn_date, flow FROM f SEMI JOIN b USING (user_id, folio, scheme_id) WHERE flow IS NOT NULL UNION ALL SELECT user_id, folio, scheme_id, as_of, units * n1 FROM b),
l AS (SELECT user_id, folio, scheme_id, list(struct_pack(y := (txn_date - d0) / 365, f := flow)) AS s FROM (SELECT *, MIN(txn_date) OVER (PARTITION BY user_id, folio, scheme_id) AS d0 FROM a) GROUP BY 1, 2, 3 HAVING COUNT(*) > 1 AND MIN(flow) < 0 AND MAX(flow) > 0),
c AS (SELECT *, list_sum(list_transform(s, lambda x: x.f / EXP(LN(0.0001::DOUBLE) * x.y))) AS at_lo FROM l),
e AS (SELECT *, list_filter(list_transform(range(-91, 139), lambda k: k / 10), lambda z: SIGN(list_sum(list_transform(s, lambda x: x.f / EXP(z * x.y)))) <> SIGN(at_lo))[1] AS first_hi FROM c),
w AS (
  SELECT user_id, folio, scheme_id, s, LN(0.0001::DOUBLE) AS lo, CAST(first_hi AS DOUBLE) AS hi, 0 AS step, at_lo FROM e WHERE first_hi IS NOT NULL
  UNION ALL
  SELECT user_id, folio, scheme_id, s, CASE WHEN same THEN (lo + hi) / 2 ELSE lo END, CASE WHEN same THEN hi ELSE (lo + hi) / 2 END, step + 1, at_lo
  FROM (SELECT *, SIGN(list_sum(list_transform(s, lambda x: x.f / EXP((lo + hi) / 2 * x.y)))) = SIGN(at_lo) AS same FROM w WHERE step < 60)),
r AS (SELECT user_id, folio, scheme_id, EXP(lo) - 1 AS rate FROM w WHERE step = 60),
q AS (SELECT b.*, rate, n1 / n0 - 1 AS cum, CASE WHEN as_of - fp >= 365 THEN POW(n1 / n0, 365.0::DOUBLE / (as_of - fp)) - 1 END AS annual FROM b LEFT JOIN r USING (user_id, folio, scheme_id))
SELECT user_id, folio, scheme_id, as_of, ROUND(units, 3) AS units, ROUND(units * n1, 2) AS market_value, ROUND(rate, 4) AS xirr, ROUND(cum, 6) AS twrr_cum, ROUND(annual, 6) AS twrr_annual, ROUND(rate - annual, 4) AS timing_effect,
  ROUND(CASE WHEN net > 0 THEN (units * n1 - net) / net END, 6) AS absolute_return,
  CASE WHEN rate IS NULL THEN 'XIRR is undefined for this cashflow pattern.' WHEN annual IS NULL THEN 'Held under a year, so the fund return is cumulative and not annualised; the timing effect needs both on the same basis.' END AS note FROM q""")  # fmt: skip
def position_returns(spark: SparkSession, d: str) -> DataFrame:
    rows = L.prepared(view(spark, d, "book_txn"))
    paid_out = F.when(_running() > 0, F.col("amount") / 100)
    amount = F.when(F.col("txn_type").isin(*L.CLOSING_TYPES), F.col("units") * 10).when(F.col("txn_type") == "IDCW_PAYOUT", paid_out).otherwise(F.col("amount"))
    # Written once: positions and flows start from the same rows.
    rows = written(rows.withColumn("amount", amount.cast("decimal(20,4)")), shared_folder(spark, "position-rows"))
    opens, closes = F.col("txn_type").isin(*OPENING_TYPES), F.col("txn_type").isin(*L.CLOSING_TYPES)
    paid = F.when(opens & ~F.col("txn_type").isin(*R.REINVESTED), F.col("amount")).when(closes, F.col("exit_load") + F.col("stt") - F.col("amount")).otherwise(F.lit(0).cast("decimal(20,4)"))
    bought = rows.groupBy(*BOOK).agg(F.min(F.when(opens, F.col("txn_date"))).alias("first_purchase"), F.sum(paid).alias("invested_net")).filter("first_purchase is not null")
    positions = _held(rows).join(bought, BOOK).withColumn("as_of", _as_of(spark, d))
    out = R.position_returns(positions, rows, _navs(spark, d))
    return rounded(out, units=3, market_value=2, xirr=4, twrr_cum=6, twrr_annual=6, timing_effect=4, absolute_return=6)


# Statements that print what the ledger has, units from before it, units taken unseen, or nothing; prices of the fund, of another plan, or none.


@C.query(_SOUND + """, k2 AS (SELECT n.user_id, n.folio, n.scheme_id, n.txn_date, n.txn_ref, u, p.nav, SUM(CASE WHEN opens THEN u WHEN closes THEN -u ELSE 0 END) OVER (PARTITION BY n.user_id, n.folio, n.scheme_id ORDER BY n.txn_date, n.txn_ref) AS running,
        ROW_NUMBER() OVER (PARTITION BY n.user_id, n.folio, n.scheme_id ORDER BY n.txn_date, n.txn_ref) AS nth FROM n SEMI JOIN g USING (user_id, folio, scheme_id) JOIN p ON n.scheme_id = p.scheme_id AND n.txn_date = p.nav_date),
s AS (SELECT *, CASE WHEN user_id % 7 <> 3 THEN running + CASE WHEN user_id % 7 = 0 THEN 5000 WHEN user_id % 7 = 1 THEN -2000 WHEN user_id % 7 = 2 AND nth > 1 THEN 3000 ELSE 0 END END AS bal FROM k2),
x AS (SELECT user_id, folio, scheme_id, COUNT(*) AS n, arg_max(bal, nth) AS bal, arg_min(ABS(bal) = u, nth) AS zero FROM s GROUP BY 1, 2, 3),
y AS (SELECT x.*, g.units * 1000 - bal AS dl, g.units, user_id % 5 = 2 AS wrong, user_id % 5 = 1 AS blind FROM x JOIN g USING (user_id, folio, scheme_id)),
z AS (SELECT *, ABS(dl) > 1 OR (bal > 0 AND ABS(dl) / bal > 0.005::DOUBLE) AS off FROM y)
SELECT user_id, folio, scheme_id, ROUND(units, 3) AS computed, ROUND(bal / 1000, 3) AS printed, ROUND(dl / 1000, 3) AS delta,
  CASE WHEN bal IS NULL THEN 'warn' WHEN off OR wrong THEN 'fail' WHEN blind THEN 'warn' ELSE 'ok' END AS status, CASE WHEN bal IS NULL THEN 'medium' WHEN off OR wrong THEN 'low' WHEN blind THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN bal IS NULL THEN 'NO_REPORTED_BALANCE' WHEN off OR wrong THEN concat_ws(',', CASE WHEN off AND dl < 0 AND NOT COALESCE(zero, FALSE) THEN 'MISSING_EARLY_CAS' WHEN off AND dl >= 0 THEN 'MISSING_REDEMPTION' WHEN off THEN 'UNKNOWN' END,
    CASE WHEN wrong THEN 'WRONG_NAV_SERIES' END, CASE WHEN wrong AND NOT ABS(dl) > 1 THEN 'LIKELY_PLAN_MISMATCH_DIRECT_VS_REGULAR' END) WHEN blind THEN 'NAV_SERIES_UNVERIFIED' ELSE '' END AS diagnosis,
  CASE WHEN wrong OR blind THEN 0 ELSE n END AS matched, CASE WHEN wrong THEN n ELSE 0 END AS mismatched, 0 AS unavailable, CASE WHEN wrong THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS worst_pct FROM z""")  # fmt: skip
def reconcile_books(spark: SparkSession, d: str) -> DataFrame:
    rows = L.prepared(view(spark, d, "book_txn"))
    held, navs, user = _held(rows), _navs(spark, d), F.col("user_id")
    order = Window.partitionBy(*BOOK).orderBy("txn_date", "txn_ref")
    extra = F.when(user % 7 == 0, 5).when(user % 7 == 1, -2).when((user % 7 == 2) & (F.row_number().over(order) > 1), 3).otherwise(0)
    own = navs.withColumnRenamed("nav_date", "txn_date").withColumnRenamed("nav", "own")
    seen = rows.join(held.select(*BOOK), BOOK, "left_semi").withColumn("units_balance", F.when(user % 7 != 3, _running() + extra)).join(own, ["scheme_id", "txn_date"])
    seen = seen.withColumn("printed_nav", F.when(user % 5 == 1, None).when(user % 5 == 2, F.col("own") * 1.1).otherwise(F.col("own")))
    out = R.reconcile_books(held, seen, navs, _as_of(spark, d)).withColumn("diagnosis", F.array_join("diagnosis", ","))
    exact = {c: F.col(c).cast("double") for c in ("computed", "printed", "delta")}
    return rounded(out.withColumns(exact), computed=3, printed=3, delta=3, worst_pct=6)
