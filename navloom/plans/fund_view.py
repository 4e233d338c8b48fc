"""Queries behind a fund's page, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.operators import fund
from navloom.operators import fund_view as V
from navloom.plans.base import Catalogue, rounded
from navloom.plans.funds import _WINDOWS, _three_years
from navloom.sources.analogue import view

C = Catalogue()

_PAGE = _WINDOWS + """, hi AS (SELECT scheme_id, "window", nav_date, nav, MAX(nav) OVER (PARTITION BY scheme_id, "window" ORDER BY nav_date) AS high FROM w),
wf AS (SELECT scheme_id, "window", MIN(nav / high - 1) AS depth FROM hi GROUP BY 1, 2),
tr AS (SELECT hi.scheme_id, hi."window", MIN(nav_date) AS trough FROM hi JOIN wf USING (scheme_id, "window") WHERE nav / high - 1 = depth GROUP BY 1, 2),
lv AS (SELECT tr.scheme_id, tr."window", trough, high FROM tr JOIN hi ON hi.scheme_id = tr.scheme_id AND hi."window" = tr."window" AND hi.nav_date = trough),
pk AS (SELECT lv.scheme_id, lv."window", trough, (SELECT MIN(nav_date) FROM hi WHERE hi.scheme_id = lv.scheme_id AND hi."window" = lv."window" AND hi.nav = lv.high) AS peak, (SELECT MIN(nav_date) FROM hi WHERE hi.scheme_id = lv.scheme_id AND hi."window" = lv."window" AND hi.nav_date > trough AND hi.nav >= lv.high) AS back FROM lv),
falls AS (SELECT scheme_id, "window", depth, CASE WHEN depth < 0 THEN peak END AS peak, CASE WHEN depth < 0 THEN trough END AS trough, CASE WHEN depth < 0 THEN back - trough END AS recovery_days FROM wf JOIN pk USING (scheme_id, "window")),
be AS (SELECT scheme_id, "window", CASE WHEN MAX(nav_date) > MIN(nav_date) THEN POW(arg_max(level, nav_date) / arg_min(level, nav_date), 365.0::DOUBLE / (MAX(nav_date) - MIN(nav_date))) - 1 END AS bench FROM w JOIN level ON nav_date = level_date GROUP BY 1, 2),
pg AS (SELECT rw.*, bench, vol, CASE WHEN vol > 0 THEN (ret_annual - 0.06::DOUBLE) / vol END AS sharpe, CASE WHEN down > 0 THEN (ret_annual - 0.06::DOUBLE) / down END AS sortino, depth, peak, trough, recovery_days
       FROM rw LEFT JOIN be USING (scheme_id, "window") LEFT JOIN ri USING (scheme_id, "window") LEFT JOIN falls USING (scheme_id, "window"))
"""  # fmt: skip


@C.query(_PAGE + 'SELECT scheme_id, "window", ROUND(depth, 8) AS depth, peak, trough, recovery_days FROM falls')
def window_falls(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.window_falls(view(spark, d, "nav")), depth=8)


@C.query(_PAGE + """, ms AS (SELECT scheme_id, "window", unnest([struct_pack(measure := 'ret_annual', value := ret_annual), struct_pack(measure := 'bench_annual', value := bench), struct_pack(measure := 'lead', value := ret_annual - bench), struct_pack(measure := 'volatility', value := vol),
  struct_pack(measure := 'max_dd', value := depth), struct_pack(measure := 'sharpe', value := sharpe), struct_pack(measure := 'sortino', value := sortino)]) AS x FROM pg WHERE spans)
SELECT scheme_id, "window", x.measure AS measure, ROUND(x.value, 6) AS value FROM ms""")  # fmt: skip
def fund_measures(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.measures(view(spark, d, "nav"), view(spark, d, "level")), value=6)


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return fund.peer_ranks(_three_years(spark, d), ["category"], "ret_annual")


_RANKS = """, t3 AS (SELECT scheme_id, category, ROUND(ret_annual, 8) AS ret_annual FROM fund JOIN rw USING (scheme_id) WHERE "window" = '3y' AND spans),
k3 AS (SELECT *, COUNT(*) OVER (PARTITION BY category) AS n_peers, RANK() OVER (PARTITION BY category ORDER BY ret_annual DESC) AS rk, MIN(ret_annual) OVER (PARTITION BY category) AS low, MAX(ret_annual) OVER (PARTITION BY category) AS high FROM t3)
"""


@C.query(_PAGE + _RANKS + """SELECT scheme_id, category, CASE WHEN n_peers < 5 THEN 'fewer than 5 funds to rank' ELSE rk || CASE WHEN rk % 100 BETWEEN 11 AND 13 THEN 'th' WHEN rk % 10 = 1 THEN 'st' WHEN rk % 10 = 2 THEN 'nd' WHEN rk % 10 = 3 THEN 'rd' ELSE 'th' END || ' of ' || n_peers END AS standing,
  ROUND(CASE WHEN high = low THEN 50 ELSE (ret_annual - low) * 100 / (high - low) END, 4) AS place FROM k3""")  # fmt: skip
def peer_standing(spark: SparkSession, d: str) -> DataFrame:
    words = V.rank_words(F.col("peer_rank"), F.col("n_peers"), F.lit("fewer than 5 funds to rank"))
    return _ranks(spark, d).select("scheme_id", "category", words.alias("standing"), F.round(V.range_place(F.col("ret_annual"), F.col("peer_low"), F.col("peer_high")), 4).alias("place"))


@C.query(_PAGE + _RANKS + """, a AS (SELECT scheme_id, CAST(arg_max(aum, as_of) AS DOUBLE) AS aum, MAX(as_of) AS aum_as_of FROM (SELECT l_suppkey AS scheme_id, last_day(CAST(l_shipdate AS DATE)) AS as_of, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS aum FROM lineitem GROUP BY 1, 2) GROUP BY 1),
fw AS (SELECT fund.scheme_id, aum, aum_as_of, CASE WHEN ter > 0 THEN ter END AS ter, rk, n_peers FROM fund LEFT JOIN a USING (scheme_id) LEFT JOIN k3 USING (scheme_id)),
yr AS (SELECT * FROM (VALUES (1, '1y', '1 year'), (2, '3y', '3 years'), (3, '5y', '5 years')) t(place, "window", label)),
tiles AS (
  SELECT fw.scheme_id, yr.place, 'return_' || yr."window" AS tile, CASE WHEN spans THEN ret_annual END AS value,
    CASE WHEN spans THEN CASE WHEN bench IS NOT NULL THEN CASE WHEN ret_annual > bench THEN 'Ahead of' ELSE 'Behind' END || ' its benchmark, ' || printf('%+.1f', CAST(ROUND(CAST(bench * 100 AS DECIMAL(38,12)), 1) AS DOUBLE)) || '% p.a.' END ELSE 'Less than ' || label || ' of prices on record' END AS context,
    CASE WHEN spans AND bench IS NOT NULL THEN CASE WHEN ret_annual > bench THEN 'ahead' ELSE 'behind' END END AS tone
  FROM fw CROSS JOIN yr LEFT JOIN pg ON pg.scheme_id = fw.scheme_id AND pg."window" = yr."window"
  UNION ALL SELECT scheme_id, 4, 'rank', CASE WHEN n_peers >= 5 THEN rk END, CASE WHEN n_peers >= 5 THEN rk || CASE WHEN rk % 100 BETWEEN 11 AND 13 THEN 'th' WHEN rk % 10 = 1 THEN 'st' WHEN rk % 10 = 2 THEN 'nd' WHEN rk % 10 = 3 THEN 'rd' ELSE 'th' END || ' of ' || n_peers ELSE '—' END, NULL FROM fw
  UNION ALL SELECT scheme_id, 5, 'worst_fall', depth, strftime(peak, '%d %b %Y') || ' to ' || strftime(trough, '%d %b %Y') || '; ' || COALESCE('back at its high ' || format('{:,}', recovery_days) || ' days after the low', 'not yet back at that high'), NULL
    FROM fw JOIN pg USING (scheme_id) WHERE "window" = 'since_first_nav' AND days >= 365 AND depth < 0
  UNION ALL SELECT scheme_id, 6, 'volatility', arg_max(vol, "window"), 'Annualised, from ' || CASE MAX("window") WHEN '3y' THEN '3 years' ELSE '1 year' END || ' of daily prices', NULL FROM fw JOIN pg USING (scheme_id) WHERE "window" IN ('3y', '1y') AND spans GROUP BY scheme_id
  UNION ALL SELECT scheme_id, 7, 'fund_size', aum, COALESCE('Quarterly average to ' || strftime(aum_as_of, '%d %b %Y'), 'Not on record'), NULL FROM fw
  UNION ALL SELECT scheme_id, 8, 'ter', ter, CASE WHEN ter IS NULL THEN 'Not on record' ELSE 'Total, a year; ' || strftime(aum_as_of, '%d %b %Y') END, NULL FROM fw)
SELECT scheme_id, CAST(place AS INTEGER) AS place, tile, ROUND(value, 6) AS value, context, tone FROM tiles""")  # fmt: skip
def fund_header(spark: SparkSession, d: str) -> DataFrame:
    sizes = view(spark, d, "disclosure").groupBy("scheme_id", "as_of").agg(F.sum("aum").alias("aum")).groupBy("scheme_id").agg(F.max_by("aum", "as_of").alias("aum"), F.max("as_of").alias("aum_as_of"))
    funds = view(spark, d, "fund").join(sizes, "scheme_id", "left").select("scheme_id", "aum", "aum_as_of", F.when(F.col("ter") > 0, F.col("ter")).alias("ter"), F.col("aum_as_of").alias("ter_as_of"))
    return rounded(V.header_strip(funds, view(spark, d, "nav"), view(spark, d, "level"), _ranks(spark, d)), value=6)
