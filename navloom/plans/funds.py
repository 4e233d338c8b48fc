"""Weights, prices, windows and peers: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.operators import asof, fund, nav, weights
from navloom.plans.base import Catalogue, rounded, rounded_many
from navloom.sources.analogue import prelude, view

C = Catalogue()
ON = "1997-06-30"


# ---- weights ---------------------------------------------------------------

_EXACT = prelude("holding") + """,
s AS (SELECT *, CAST(ROUND(CAST(mv AS DOUBLE) * 1e2 / CAST(SUM(mv) OVER (PARTITION BY scheme_id) AS DOUBLE), 6) AS DECIMAL(12,6)) AS w FROM holding),
x AS (SELECT *, 100 - SUM(w) OVER (PARTITION BY scheme_id) AS drift, ROW_NUMBER() OVER (PARTITION BY scheme_id ORDER BY ABS(w) DESC, issuer_id) AS rk FROM s)
"""  # fmt: skip


@C.query(_EXACT + "SELECT scheme_id, issuer_id, CAST(CASE WHEN rk = 1 THEN w + drift ELSE w END AS DOUBLE) AS weight FROM x")
def normalised_weights_exact_100(spark: SparkSession, d: str) -> DataFrame:
    return weights.normalised(view(spark, d, "holding")).select("scheme_id", "issuer_id", F.col("weight").cast("double").alias("weight"))


@C.query(_EXACT + "SELECT scheme_id, CAST(SUM(CASE WHEN rk = 1 THEN w + drift ELSE w END) AS DOUBLE) AS total, ABS(SUM(CASE WHEN rk = 1 THEN w + drift ELSE w END) - 100) <= 0.01 AS sound FROM x GROUP BY scheme_id")
def weights_sum_check(spark: SparkSession, d: str) -> DataFrame:
    checked = weights.sums_to_100(weights.normalised(view(spark, d, "holding")))
    return checked.withColumn("total", F.col("total").cast("double"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    lines = view(spark, d, "lineitem").join(view(spark, d, "issuer").select("issuer_id", "instrument_class"), F.col("l_partkey") == F.col("issuer_id"))
    kind = F.when(F.col("l_returnflag") == "R", "cash").otherwise(F.col("instrument_class"))
    return lines.select(F.col("l_suppkey").alias("scheme_id"), "issuer_id", F.col("l_extendedprice").cast("decimal(18,2)").alias("mv"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"), kind.alias("instrument_class"))


@C.query(prelude("issuer") + """, l AS (SELECT l_suppkey AS scheme_id, issuer_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS mv, CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS DECIMAL(18,2)) END AS q,
  CASE WHEN l_returnflag = 'R' THEN 'cash' ELSE instrument_class END AS k FROM lineitem JOIN issuer ON l_partkey = issuer_id)
SELECT scheme_id, issuer_id, CAST(SUM(mv) AS DOUBLE) AS mv, CAST(SUM(q) AS DOUBLE) AS quantity, arg_max(k, {'size': ABS(mv), 'k': k}) AS instrument_class, COUNT(*) AS n_lines FROM l GROUP BY 1, 2""")  # fmt: skip
def issuer_weights_dominant_class(spark: SparkSession, d: str) -> DataFrame:
    return weights.by_issuer(_lines(spark, d)).withColumns({c: F.col(c).cast("double") for c in ("mv", "quantity")})


_UNITS = "SELECT p_partkey AS issuer_id, p_partkey % (SELECT COUNT(*) FROM supplier) + 1 AS held_scheme FROM part WHERE p_partkey % 50 = 1"


@C.query(prelude("weight") + f""", u AS ({_UNITS}), b AS (SELECT scheme_id, issuer_id, weight FROM weight),
r0 AS (SELECT b.scheme_id, b.issuer_id, b.weight, u.held_scheme, b.scheme_id AS p0 FROM b LEFT JOIN u USING (issuer_id)),
r1 AS (SELECT r.scheme_id, CASE WHEN c.issuer_id IS NOT NULL THEN CAST(c.issuer_id AS VARCHAR) WHEN r.held_scheme IS NOT NULL THEN '__MFUNIT__' ELSE CAST(r.issuer_id AS VARCHAR) END AS issuer_id,
  CASE WHEN c.issuer_id IS NOT NULL THEN r.weight * c.weight / 1e2 ELSE r.weight END AS weight, CASE WHEN c.issuer_id IS NOT NULL THEN u.held_scheme END AS held, p0, r.held_scheme AS p1, CASE WHEN c.issuer_id IS NOT NULL THEN 1 ELSE 0 END AS depth
  FROM r0 r LEFT JOIN b c ON r.held_scheme = c.scheme_id AND r.held_scheme <> r.p0 LEFT JOIN u ON c.issuer_id = u.issuer_id),
r2 AS (SELECT r.scheme_id, CASE WHEN c.issuer_id IS NOT NULL THEN CASE WHEN u.held_scheme IS NOT NULL THEN '__MFUNIT__' ELSE CAST(c.issuer_id AS VARCHAR) END WHEN r.held IS NOT NULL THEN '__MFUNIT__' ELSE r.issuer_id END AS issuer_id,
  CASE WHEN c.issuer_id IS NOT NULL THEN r.weight * c.weight / 1e2 ELSE r.weight END AS weight, CASE WHEN c.issuer_id IS NOT NULL THEN 2 ELSE depth END AS depth
  FROM r1 r LEFT JOIN b c ON r.held = c.scheme_id AND r.held <> r.p0 AND r.held <> r.p1 LEFT JOIN u ON c.issuer_id = u.issuer_id)
SELECT scheme_id, issuer_id, ROUND(SUM(weight), 6) AS weight, MAX(depth) AS depth FROM r2 GROUP BY 1, 2""")  # fmt: skip
def fof_expand_depth2(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n"))
    units = view(spark, d, "part").filter("p_partkey % 50 = 1").crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("issuer_id"), (F.col("p_partkey") % F.col("n") + 1).alias("held_scheme"))
    return rounded_many(weights.expand_fund_units(view(spark, d, "weight"), units), weight=6)


def _members(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fund").select("scheme_id", F.concat_ws("-", "amc_id", F.col("scheme_id") % 4).alias("family"))


_MEMBERS = ", m AS (SELECT scheme_id, CONCAT(amc_id, '-', scheme_id % 4) AS family FROM fund)"


@C.query(prelude("fund", "disclosed_weight") + _MEMBERS + """, h AS (SELECT DISTINCT m.scheme_id, family FROM m JOIN disclosed_weight USING (scheme_id)), g AS (SELECT family, MIN(scheme_id) AS giver FROM h GROUP BY family),
s AS (SELECT m.scheme_id, CASE WHEN h.scheme_id IS NOT NULL THEN m.scheme_id ELSE giver END AS src FROM m JOIN g USING (family) LEFT JOIN h ON h.scheme_id = m.scheme_id)
SELECT s.scheme_id, src AS from_scheme, COUNT(*) AS n_issuers, ROUND(SUM(weight), 6) AS weight FROM s JOIN disclosed_weight w ON w.scheme_id = src GROUP BY 1, 2""")  # fmt: skip
def served_family_weights(spark: SparkSession, d: str) -> DataFrame:
    served = weights.served_weights(_members(spark, d), view(spark, d, "disclosed_weight").select("scheme_id", "issuer_id", "weight"))
    return served.groupBy("scheme_id", "from_scheme").agg(F.count(F.lit(1)).alias("n_issuers"), F.round(F.sum("weight"), 6).alias("weight"))


@C.query(prelude("fund", "disclosure") + _MEMBERS + f""", k AS (SELECT scheme_id, MAX(as_of) AS as_of FROM disclosure WHERE NOT quarantined AND as_of <= DATE '{ON}' GROUP BY 1),
o AS (SELECT family, k.scheme_id AS from_scheme, as_of FROM k JOIN m USING (scheme_id))
SELECT scheme_id, family, from_scheme, as_of FROM (SELECT m.*, from_scheme, as_of, ROW_NUMBER() OVER (PARTITION BY scheme_id ORDER BY as_of DESC, (from_scheme = scheme_id) DESC, from_scheme) AS rk FROM m JOIN o USING (family)) WHERE rk = 1""")  # fmt: skip
def disclosure_scheme_for(spark: SparkSession, d: str) -> DataFrame:
    return weights.serving_disclosure(_members(spark, d), view(spark, d, "disclosure"), F.lit(ON).cast("date"))


@C.query(prelude("disclosure") + f""", k AS (SELECT *, MAX(as_of) OVER (PARTITION BY scheme_id) AS newest FROM disclosure WHERE NOT quarantined AND as_of <= DATE '{ON}')
SELECT scheme_id, as_of, tier FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY scheme_id ORDER BY (tier = 'amc') DESC, as_of DESC, tier) AS rk FROM k WHERE newest - as_of <= 45) WHERE rk = 1""")  # fmt: skip
def latest_disclosure_tier(spark: SparkSession, d: str) -> DataFrame:
    return weights.latest_disclosure(view(spark, d, "disclosure"), F.lit(ON).cast("date"))


@C.query(prelude("disclosure") + " SELECT DISTINCT scheme_id FROM disclosure WHERE NOT quarantined")
def disclosed_scheme_ids(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "disclosure").filter("not quarantined").select("scheme_id").distinct()


# ---- lookups in time -------------------------------------------------------


def _asks(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "lineitem").select(F.col("l_suppkey").alias("scheme_id"), F.col("l_shipdate").cast("date").alias("on_date")).distinct()


_ASKS = ", a AS (SELECT DISTINCT l_suppkey AS scheme_id, CAST(l_shipdate AS DATE) AS on_date FROM lineitem)"


@C.query(prelude("nav") + _ASKS + " SELECT a.scheme_id, a.on_date, n.nav_date, n.nav FROM a ASOF LEFT JOIN nav n ON a.scheme_id = n.scheme_id AND a.on_date >= n.nav_date")
def nav_asof(spark: SparkSession, d: str) -> DataFrame:
    return asof.latest_on_or_before(_asks(spark, d), view(spark, d, "nav"), ["scheme_id"], "on_date", "nav_date", ["nav"])


@C.query(prelude("nav") + _ASKS + " SELECT a.scheme_id, a.on_date, n.nav_date, n.nav FROM a ASOF LEFT JOIN nav n ON a.scheme_id = n.scheme_id AND a.on_date <= n.nav_date")
def nav_on_or_after(spark: SparkSession, d: str) -> DataFrame:
    return asof.first_on_or_after(_asks(spark, d), view(spark, d, "nav"), ["scheme_id"], "on_date", "nav_date", ["nav"])


@C.query(prelude("disclosure") + _ASKS + """, s AS (SELECT scheme_id, as_of, aum FROM disclosure WHERE tier = 'amc' AND quarantined)
SELECT a.scheme_id, a.on_date, CASE WHEN a.on_date - s.as_of <= 365 THEN s.as_of END AS as_of, CASE WHEN a.on_date - s.as_of <= 365 THEN CAST(s.aum AS DOUBLE) END AS aum FROM a ASOF LEFT JOIN s ON a.scheme_id = s.scheme_id AND a.on_date >= s.as_of""")  # fmt: skip
def aum_witness_asof(spark: SparkSession, d: str) -> DataFrame:
    facts = view(spark, d, "disclosure").filter("tier = 'amc' and quarantined").select("scheme_id", "as_of", F.col("aum").cast("double").alias("aum"))
    return asof.latest_on_or_before(_asks(spark, d), facts, ["scheme_id"], "on_date", "as_of", ["aum"], max_age_days=365)


@C.query(prelude("disclosure") + _ASKS + """, s AS (SELECT scheme_id, as_of, CAST(aum AS DOUBLE) AS aum FROM disclosure WHERE tier = 'amc' AND quarantined),
b AS (SELECT a.*, s.as_of AS b_date, s.aum AS b_aum FROM a ASOF LEFT JOIN s ON a.scheme_id = s.scheme_id AND a.on_date >= s.as_of),
f AS (SELECT b.*, s.as_of AS f_date, s.aum AS f_aum FROM b ASOF LEFT JOIN s ON b.scheme_id = s.scheme_id AND b.on_date <= s.as_of),
c AS (SELECT *, b_date IS NOT NULL AND (f_date IS NULL OR on_date - b_date <= f_date - on_date) AS back FROM f)
SELECT scheme_id, on_date, CASE WHEN back AND on_date - b_date <= 365 THEN b_date WHEN NOT back AND f_date - on_date <= 365 THEN f_date END AS as_of,
       CASE WHEN back AND on_date - b_date <= 365 THEN b_aum WHEN NOT back AND f_date - on_date <= 365 THEN f_aum END AS aum FROM c""")  # fmt: skip
def nearest_disclosure(spark: SparkSession, d: str) -> DataFrame:
    facts = view(spark, d, "disclosure").filter("tier = 'amc' and quarantined").select("scheme_id", "as_of", F.col("aum").cast("double").alias("aum"))
    return asof.nearest(_asks(spark, d), facts, ["scheme_id"], "on_date", "as_of", ["aum"], 365)


# ---- price series ----------------------------------------------------------


def _broken(spark: SparkSession, d: str) -> DataFrame:
    """Prices with a change of unit in 1995 and another in 1997 for every third fund."""
    factor = F.when((F.col("scheme_id") % 3 == 0) & (F.col("nav_date") < "1995-01-01"), 100.0).when((F.col("scheme_id") % 3 == 0) & (F.col("nav_date") < "1997-01-01"), 10.0).otherwise(1.0)
    return view(spark, d, "nav").withColumn("nav", F.col("nav") * factor)


@C.query(prelude("nav") + """, b AS (SELECT scheme_id, nav_date, nav * CASE WHEN scheme_id % 3 = 0 AND nav_date < DATE '1995-01-01' THEN 1e2 WHEN scheme_id % 3 = 0 AND nav_date < DATE '1997-01-01' THEN 1e1 ELSE 1e0 END AS nav FROM nav),
r AS (SELECT *, nav / LAG(nav) OVER (PARTITION BY scheme_id ORDER BY nav_date) AS q FROM b),
k AS (SELECT *, COALESCE(CASE WHEN ABS(q / 10 - 1) <= 0.1 THEN 1 WHEN ABS(q * 10 - 1) <= 0.1 THEN -1 WHEN ABS(q / 100 - 1) <= 0.1 THEN 2 WHEN ABS(q * 100 - 1) <= 0.1 THEN -2 ELSE 0 END, 0) AS p FROM r)
SELECT scheme_id, nav_date, nav, ROUND(nav * POW(1e1, COALESCE(SUM(p) OVER (PARTITION BY scheme_id ORDER BY nav_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)), 6) AS nav_rescaled,
       COUNT(CASE WHEN p <> 0 THEN 1 END) OVER (PARTITION BY scheme_id) AS n_splits FROM k""")  # fmt: skip
def nav_split_rescale(spark: SparkSession, d: str) -> DataFrame:
    return nav.rescale_splits(_broken(spark, d))


@C.query(prelude("nav") + """, j AS (SELECT *, CASE WHEN month(nav_date) = 3 THEN ROUND(nav * 0.01::DOUBLE, 6) END AS amount, LAG(nav) OVER (PARTITION BY scheme_id ORDER BY nav_date) AS before FROM nav)
SELECT scheme_id, nav_date, nav, amount, ROUND(nav * EXP(SUM(CASE WHEN amount > 0 AND before > amount THEN LN(before / (before - amount)) ELSE 0 END) OVER (PARTITION BY scheme_id ORDER BY nav_date ROWS UNBOUNDED PRECEDING)), 6) AS nav_adj FROM j""")  # fmt: skip
def nav_adj_idcw(spark: SparkSession, d: str) -> DataFrame:
    prices = view(spark, d, "nav")
    payouts = prices.filter(F.month("nav_date") == 3).select("scheme_id", "nav_date", F.round(F.col("nav") * 0.01, 6).alias("amount"))
    return nav.adjust_payouts(prices, payouts)


@C.query(prelude("nav") + """, a AS (SELECT *, scheme_id + 1 AS sibling_id FROM nav WHERE scheme_id % 2 = 1), s AS (SELECT scheme_id AS sid, nav_date AS sd, nav AS sn FROM nav WHERE scheme_id % 2 = 0),
k AS (SELECT a.*, sd, sn FROM a ASOF LEFT JOIN s ON a.sibling_id = s.sid AND a.nav_date >= s.sd),
f AS (SELECT scheme_id, arg_min(nav, nav_date) AS fn, arg_min(sn, nav_date) AS fs FROM k WHERE sn IS NOT NULL GROUP BY 1)
SELECT k.scheme_id, k.nav_date, k.nav, k.sibling_id, k.sd AS sibling_date, k.sn AS sibling_nav, ROUND(fn * sn / fs, 6) AS nav_adj FROM k LEFT JOIN f USING (scheme_id) WHERE EXISTS (SELECT 1 FROM s WHERE s.sid = k.sibling_id)""")  # fmt: skip
def nav_adj_sibling(spark: SparkSession, d: str) -> DataFrame:
    prices = view(spark, d, "nav")
    even = prices.filter("scheme_id % 2 = 0").select((F.col("scheme_id") - 1).alias("scheme_id"), F.col("scheme_id").alias("sibling_id")).distinct()
    return nav.adjust_by_sibling(prices, even)


@C.query(prelude("nav", "scheme") + """, b AS (SELECT scheme_id, nav_date, nav AS sound, nav * CASE WHEN scheme_id % 3 = 0 AND nav_date < DATE '1995-01-01' THEN 1e2 WHEN scheme_id % 3 = 0 AND nav_date < DATE '1997-01-01' THEN 1e1 ELSE 1e0 END AS nav FROM nav),
r AS (SELECT *, nav / LAG(nav) OVER (PARTITION BY scheme_id ORDER BY nav_date) AS q FROM b),
k AS (SELECT *, COALESCE(CASE WHEN ABS(q / 10 - 1) <= 0.1 THEN 1 WHEN ABS(q * 10 - 1) <= 0.1 THEN -1 WHEN ABS(q / 100 - 1) <= 0.1 THEN 2 WHEN ABS(q * 100 - 1) <= 0.1 THEN -2 ELSE 0 END, 0) AS p FROM r),
z AS (SELECT scheme_id, nav_date, sound, ROUND(nav * POW(1e1, COALESCE(SUM(p) OVER (PARTITION BY scheme_id ORDER BY nav_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)), 6) AS nav FROM k),
g AS (SELECT * FROM scheme WHERE option = 'growth' AND scheme_id IN (SELECT scheme_id FROM nav)),
s AS (SELECT s.scheme_id, (SELECT arg_min(g.scheme_id, CASE WHEN g.plan = s.plan THEN 0 ELSE 1000000000 END + g.scheme_id) FROM g WHERE g.family = s.family) AS sid FROM scheme s WHERE option LIKE 'idcw%' AND scheme_id % 7 <> 0),
w AS (SELECT z.*, sid, CASE WHEN z.scheme_id % 7 = 0 AND month(nav_date) = 3 THEN ROUND(sound * 0.01::DOUBLE, 6) END AS amount, LAG(nav) OVER (PARTITION BY z.scheme_id ORDER BY nav_date) AS before FROM z LEFT JOIN s USING (scheme_id)),
x AS (SELECT w.*, z2.nav AS sn FROM w ASOF LEFT JOIN (SELECT scheme_id AS id2, nav_date AS d2, nav FROM z) z2 ON w.sid = z2.id2 AND w.nav_date >= z2.d2),
f AS (SELECT scheme_id, arg_min(nav, nav_date) AS fn, arg_min(sn, nav_date) AS fs FROM x WHERE sn IS NOT NULL GROUP BY 1),
h AS (SELECT scheme_id FROM w GROUP BY 1 HAVING COUNT(amount) > 0)
SELECT x.scheme_id, nav_date, x.nav, CASE WHEN x.sn IS NOT NULL THEN 'sibling' WHEN h.scheme_id IS NOT NULL THEN 'payouts' ELSE 'own' END AS basis,
  ROUND(CASE WHEN x.sn IS NOT NULL THEN fn * sn / fs ELSE x.nav * EXP(SUM(CASE WHEN amount > 0 AND before > amount THEN LN(before / (before - amount)) ELSE 0 END) OVER (PARTITION BY x.scheme_id ORDER BY nav_date ROWS UNBOUNDED PRECEDING)) END, 6) AS nav_adj
FROM x LEFT JOIN f USING (scheme_id) LEFT JOIN h USING (scheme_id)""")  # fmt: skip
def adjusted_prices(spark: SparkSession, d: str) -> DataFrame:
    """All funds with every path: changes of unit, payouts of every seventh, siblings of the other payout classes."""
    sevenths = view(spark, d, "nav").filter((F.col("scheme_id") % 7 == 0) & (F.month("nav_date") == 3))
    payouts = sevenths.select("scheme_id", "nav_date", F.round(F.col("nav") * 0.01, 6).alias("amount"))
    return nav.adjusted_prices(_broken(spark, d), payouts, view(spark, d, "scheme"))


@C.query(prelude("nav") + " SELECT scheme_id, nav_date, nav, ROUND(ret, 9) AS ret FROM (SELECT *, nav / LAG(nav) OVER (PARTITION BY scheme_id ORDER BY nav_date) - 1 AS ret FROM nav) WHERE ret IS NOT NULL")
def daily_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nav.daily_returns(view(spark, d, "nav")), ret=9)


_PEAK = prelude("nav") + """, p AS (SELECT *, MAX(nav) OVER w AS peak, MAX(nav) OVER (PARTITION BY scheme_id ORDER BY nav_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM nav WINDOW w AS (PARTITION BY scheme_id ORDER BY nav_date ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, MAX(CASE WHEN nav = peak AND peak > COALESCE(old, 0) THEN nav_date END) OVER (PARTITION BY scheme_id ORDER BY nav_date ROWS UNBOUNDED PRECEDING) AS peak_date FROM p)
"""  # fmt: skip


@C.query(_PEAK + "SELECT scheme_id, nav_date, nav, peak, peak_date, ROUND(nav / peak - 1, 6) AS drawdown FROM q")
def drawdown_path(spark: SparkSession, d: str) -> DataFrame:
    return nav.with_drawdown(view(spark, d, "nav"))


@C.query(_PEAK + """, w AS (SELECT * FROM (SELECT *, nav / peak - 1 AS depth, ROW_NUMBER() OVER (PARTITION BY scheme_id ORDER BY nav / peak - 1, nav_date) AS rk FROM q) WHERE rk = 1 AND depth < 0),
b AS (SELECT w.scheme_id, MIN(n.nav_date) AS recovery_date FROM w JOIN nav n ON n.scheme_id = w.scheme_id AND n.nav_date > w.nav_date AND n.nav >= w.peak GROUP BY 1)
SELECT w.scheme_id, ROUND(depth, 6) AS depth, peak_date, nav_date AS trough_date, recovery_date, nav_date - peak_date AS fall_days, recovery_date - nav_date AS recovery_days FROM w LEFT JOIN b USING (scheme_id)""")  # fmt: skip
def max_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return nav.max_drawdown(view(spark, d, "nav"))


_ROLL = prelude("nav") + """, sp AS (SELECT scheme_id, MIN(nav_date) AS d0, MAX(nav_date) AS dn FROM nav GROUP BY 1),
st AS (SELECT scheme_id, CAST(unnest(generate_series(CAST(d0 AS TIMESTAMP), CAST(dn - 365 AS TIMESTAMP), INTERVAL 30 DAY)) AS DATE) AS start FROM sp WHERE dn - 365 >= d0),
o AS (SELECT st.*, start + 365 AS stop, nav_date AS from_date, nav AS from_nav FROM st ASOF JOIN nav ON st.scheme_id = nav.scheme_id AND st.start <= nav.nav_date),
c AS (SELECT o.*, nav_date AS to_date, nav AS to_nav FROM o ASOF JOIN nav ON o.scheme_id = nav.scheme_id AND o.stop >= nav.nav_date),
r AS (SELECT *, EXP(LN(to_nav / from_nav) * 365.0::DOUBLE / 365) - 1 AS ret FROM c WHERE from_date < to_date)
"""  # fmt: skip


@C.query(_ROLL + "SELECT scheme_id, start, stop, from_date, from_nav, to_date, to_nav, ROUND(ret, 8) AS ret FROM r")
def rolling_path(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nav.rolling_windows(view(spark, d, "nav"), 365, 30), ret=8)


@C.query(_ROLL + "SELECT scheme_id, COUNT(*) AS n_windows, ROUND(CASE WHEN COUNT(*) >= 12 THEN MIN(ret) END, 8) AS worst, ROUND(CASE WHEN COUNT(*) >= 12 THEN MEDIAN(ret) END, 8) AS median, ROUND(CASE WHEN COUNT(*) >= 12 THEN MAX(ret) END, 8) AS best, ROUND(CASE WHEN COUNT(*) >= 12 THEN AVG(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) * 1e2 END, 6) AS positive_pct FROM r GROUP BY 1")
def rolling_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nav.rolling_summary(nav.rolling_windows(view(spark, d, "nav"), 365, 30)), worst=8, median=8, best=8, positive_pct=6)


@C.query(prelude("nav") + " SELECT scheme_id, nav_date, nav, ROUND(1e4 * nav / FIRST_VALUE(nav) OVER (PARTITION BY scheme_id ORDER BY nav_date), 2) AS value FROM nav")
def growth_path(spark: SparkSession, d: str) -> DataFrame:
    return nav.growth_of(view(spark, d, "nav"))


@C.query(prelude("nav") + """, l AS (SELECT *, LAG(nav) OVER (PARTITION BY scheme_id ORDER BY nav_date) AS b, ROW_NUMBER() OVER (PARTITION BY scheme_id ORDER BY nav_date DESC) AS rk FROM nav)
SELECT scheme_id, nav_date, nav, ROUND(nav - b, 6) AS change, ROUND((nav / b - 1) * 1e2, 6) AS change_pct FROM l WHERE rk = 1""")  # fmt: skip
def day_change(spark: SparkSession, d: str) -> DataFrame:
    return nav.latest_change(view(spark, d, "nav"))


@C.query(prelude("nav") + " SELECT * FROM (SELECT scheme_id, LAG(nav_date) OVER (PARTITION BY scheme_id ORDER BY nav_date) AS from_date, nav_date AS to_date, nav_date - LAG(nav_date) OVER (PARTITION BY scheme_id ORDER BY nav_date) AS days FROM nav) WHERE days > 31")
def nav_gaps(spark: SparkSession, d: str) -> DataFrame:
    return nav.gaps(view(spark, d, "nav"), 31)


@C.query(prelude("nav") + ", g AS (SELECT *, nav_date - LAG(nav_date) OVER (PARTITION BY scheme_id ORDER BY nav_date) AS days FROM nav) SELECT scheme_id, MIN(nav_date) AS first_date, MAX(nav_date) AS last_date, COUNT(*) AS n_prices, MAX(days) AS longest_gap FROM g GROUP BY 1")
def history_coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return nav.coverage(view(spark, d, "nav"))


# ---- windows, risk, peers --------------------------------------------------

_WINDOWS = prelude("nav", "level", "fund") + """, y AS (SELECT * FROM (VALUES ('1y', 1), ('3y', 3), ('5y', 5), ('since_first_nav', NULL)) t("window", years)),
m AS (SELECT *, MAX(nav_date) OVER (PARTITION BY scheme_id) AS as_of FROM nav),
w AS (SELECT m.*, y."window", years FROM m CROSS JOIN y WHERE years IS NULL OR nav_date >= CAST(CASE WHEN as_of = last_day(as_of) THEN as_of - to_years(years) ELSE as_of - to_years(years) END AS DATE)),
f AS (SELECT scheme_id, "window", years, MIN(nav_date) AS from_date, MAX(nav_date) AS to_date, COUNT(*) AS n_obs, COUNT(DISTINCT nav) AS different, arg_min(nav, nav_date) AS n0, arg_max(nav, nav_date) AS n1 FROM w GROUP BY 1, 2, 3),
rw AS (SELECT scheme_id, "window", from_date, to_date, to_date - from_date AS days, n_obs, n1 / n0 - 1 AS ret, EXP(LN(n1 / n0) * 365.0::DOUBLE / (to_date - from_date)) - 1 AS ret_annual,
  CASE WHEN years IS NULL THEN TRUE ELSE to_date - from_date + 7 >= years * 365 END AS spans, CASE WHEN to_date - from_date >= 1095 THEN 'high' WHEN to_date - from_date >= 365 THEN 'medium' ELSE 'low' END AS confidence FROM f WHERE n_obs >= 2 AND different >= 2 AND to_date > from_date),
rt AS (SELECT * FROM (SELECT *, nav / LAG(nav) OVER (PARTITION BY scheme_id, "window" ORDER BY nav_date) - 1 AS ret FROM w) WHERE ret IS NOT NULL),
ri AS (SELECT scheme_id, "window", COUNT(*) AS n_returns, COALESCE(STDDEV_SAMP(ret), 0) * SQRT(252) AS vol, SQRT(SUM(POW(LEAST(ret, 0), 2)) / COUNT(*)) * SQRT(252) AS down FROM rt GROUP BY 1, 2)
"""  # fmt: skip


@C.query(_WINDOWS + 'SELECT scheme_id, "window", from_date, to_date, days, n_obs, ROUND(ret, 8) AS ret, ROUND(ret_annual, 8) AS ret_annual, spans, confidence FROM rw')
def return_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fund.return_windows(view(spark, d, "nav")), ret=8, ret_annual=8)


@C.query(_WINDOWS + """SELECT scheme_id, "window", ROUND(ret_annual, 8) AS ret_annual, n_returns, ROUND(vol, 8) AS volatility, ROUND(down, 8) AS downside,
  ROUND(CASE WHEN vol > 0 THEN (ret_annual - 0.06::DOUBLE) / vol END, 6) AS sharpe, ROUND(CASE WHEN down > 0 THEN (ret_annual - 0.06::DOUBLE) / down END, 6) AS sortino FROM rw JOIN ri USING (scheme_id, "window")""")  # fmt: skip
def window_risk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fund.window_risk(view(spark, d, "nav")), ret_annual=8, volatility=8, downside=8, sharpe=6, sortino=6)


@C.query(_WINDOWS + """, j AS (SELECT scheme_id, nav_date, nav, level FROM nav JOIN level ON nav_date = level_date),
p AS (SELECT * FROM (SELECT *, nav / LAG(nav) OVER (PARTITION BY scheme_id ORDER BY nav_date) - 1 AS f, level / LAG(level) OVER (PARTITION BY scheme_id ORDER BY nav_date) - 1 AS b FROM j) WHERE f IS NOT NULL),
s AS (SELECT scheme_id, COUNT(*) AS n_paired, COVAR_SAMP(f, b) / VAR_SAMP(b) AS beta, STDDEV_SAMP(f - b) * SQRT(252) AS te,
  (EXP(SUM(CASE WHEN b > 0 THEN LN(1 + f) END)) - 1) / (EXP(SUM(CASE WHEN b > 0 THEN LN(1 + b) END)) - 1) AS up, (EXP(SUM(CASE WHEN b < 0 THEN LN(1 + f) END)) - 1) / (EXP(SUM(CASE WHEN b < 0 THEN LN(1 + b) END)) - 1) AS dn FROM p GROUP BY 1),
e AS (SELECT scheme_id, EXP(LN(arg_max(nav, nav_date) / arg_min(nav, nav_date)) * 365.0::DOUBLE / (MAX(nav_date) - MIN(nav_date))) - 1 AS ra, EXP(LN(arg_max(level, nav_date) / arg_min(level, nav_date)) * 365.0::DOUBLE / (MAX(nav_date) - MIN(nav_date))) - 1 AS rb FROM j GROUP BY 1)
SELECT scheme_id, n_paired, ROUND(beta, 6) AS beta, ROUND(te, 6) AS tracking_error, ROUND(ra - (0.06::DOUBLE + beta * (rb - 0.06::DOUBLE)), 6) AS alpha, ROUND(CASE WHEN beta > 0 THEN (ra - 0.06::DOUBLE) / beta END, 6) AS treynor,
  ROUND(CASE WHEN te > 0 THEN (ra - rb) / te END, 6) AS information_ratio, ROUND(up, 6) AS up_capture, ROUND(dn, 6) AS down_capture FROM s JOIN e USING (scheme_id) WHERE n_paired >= 20""")  # fmt: skip
def against_benchmark(spark: SparkSession, d: str) -> DataFrame:
    out = fund.against_benchmark(view(spark, d, "nav"), view(spark, d, "level"))
    return rounded(out, beta=6, tracking_error=6, alpha=6, treynor=6, information_ratio=6, up_capture=6, down_capture=6)


def _three_years(spark: SparkSession, d: str) -> DataFrame:
    figures = fund.return_windows(view(spark, d, "nav")).filter("window = '3y' and spans").select("scheme_id", F.round("ret_annual", 8).alias("ret_annual"))
    return view(spark, d, "fund").select("scheme_id", "category").join(figures, "scheme_id")


@C.query(_WINDOWS + """, t AS (SELECT scheme_id, category, ROUND(ret_annual, 8) AS ret_annual FROM fund JOIN rw USING (scheme_id) WHERE "window" = '3y' AND spans),
k AS (SELECT *, COUNT(*) OVER (PARTITION BY category) AS n_peers, RANK() OVER (PARTITION BY category ORDER BY ret_annual DESC) AS rk FROM t)
SELECT scheme_id, category, ret_annual, n_peers, CASE WHEN n_peers >= 5 THEN rk END AS peer_rank, CASE WHEN n_peers >= 5 THEN CAST(CEIL(4.0 * rk / n_peers) AS INT) END AS quartile, MIN(ret_annual) OVER (PARTITION BY category) AS peer_low, MAX(ret_annual) OVER (PARTITION BY category) AS peer_high FROM k""")  # fmt: skip
def peer_rank_quartile(spark: SparkSession, d: str) -> DataFrame:
    return fund.peer_ranks(_three_years(spark, d), ["category"], "ret_annual")


@C.query(_WINDOWS + """, t AS (SELECT scheme_id, category, ROUND(ret_annual, 8) AS ret_annual FROM fund JOIN rw USING (scheme_id) WHERE "window" = '3y' AND spans)
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY category ORDER BY ret_annual DESC, scheme_id) AS place, COUNT(*) OVER (PARTITION BY category) AS members FROM t) WHERE place <= 5""")  # fmt: skip
def category_leaders(spark: SparkSession, d: str) -> DataFrame:
    return fund.leaders(_three_years(spark, d), "category", "ret_annual")


@C.query(prelude("fund") + " SELECT category, amc_id, COUNT(*) AS n_funds, ROUND(AVG(ter), 6) AS mean_ter FROM fund GROUP BY 1, 2")
def fund_map(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fund").groupBy("category", "amc_id").agg(F.count(F.lit(1)).alias("n_funds"), F.round(F.avg("ter"), 6).alias("mean_ter"))


@C.query(prelude("fund", "nav") + """, x AS (SELECT f.*, scheme_id % 4 AS family, CASE WHEN scheme_id % 2 = 0 THEN 'growth' ELSE 'payout' END AS option FROM fund f), s AS (SELECT scheme_id, MAX(nav_date) AS last_seen FROM nav GROUP BY 1),
l AS (SELECT x.*, last_seen FROM x JOIN s USING (scheme_id) WHERE (SELECT MAX(last_seen) FROM s) - last_seen <= 7)
SELECT scheme_id, amc_id, family, option, last_seen FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY amc_id, family ORDER BY (option = 'growth') DESC, scheme_id) AS rk FROM l) WHERE rk = 1""")  # fmt: skip
def live_funds(spark: SparkSession, d: str) -> DataFrame:
    funds = view(spark, d, "fund").withColumn("family", F.col("scheme_id") % 4).withColumn("option", F.when(F.col("scheme_id") % 2 == 0, "growth").otherwise("payout")).withColumn("plan", F.lit("direct"))
    return fund.live_funds(funds, view(spark, d, "nav")).select("scheme_id", "amc_id", "family", "option", "last_seen")
