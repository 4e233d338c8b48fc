"""Queries on published lists and on what is missing from price histories, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.functions import text as T
from navloom.operators import backfill as B
from navloom.plans.base import Catalogue
from navloom.sources import lists as S
from navloom.sources.analogue import prelude, view

C = Catalogue()


# One file per index and year, in three envelopes; every fifth year is spoilt by one row without a readable level.
@C.query(prelude("nav") + """ SELECT CAST(scheme_id * 10000 + year(nav_date) AS BIGINT) AS file_id, 'Index ' || scheme_id AS index_name, nav_date AS level_date, nav AS level, CASE WHEN month(nav_date) % 3 = 1 THEN nav END AS net_level
FROM nav WHERE NOT (year(nav_date) % 5 = 0 AND EXISTS (SELECT 1 FROM nav n WHERE n.scheme_id = nav.scheme_id AND year(n.nav_date) = year(nav.nav_date) AND month(n.nav_date) = 6))""")  # fmt: skip
def index_levels(spark: SparkSession, d: str) -> DataFrame:
    price = F.format_number("nav", 4)
    spoilt = (F.year("nav_date") % 5 == 0) & (F.month("nav_date") == 6)
    net = F.when(F.month("nav_date") % 3 == 0, "-").when(F.month("nav_date") % 3 == 1, price)
    row = F.struct(F.concat(F.lit(" Index "), "scheme_id").alias(S.NAME), F.upper(F.date_format("nav_date", "dd MMM yyyy")).alias(S.DAY), F.when(spoilt, "n/a").otherwise(price).alias(S.LEVEL), net.alias(S.NET))
    files = view(spark, d, "nav").withColumn("file_id", F.col("scheme_id") * 10_000 + F.year("nav_date")).groupBy("file_id").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("rows"))
    i = F.col("file_id") % 3
    content = F.when(i == 0, F.col("rows")).when(i == 1, F.concat(F.lit('{"d": '), "rows", F.lit("}"))).otherwise(F.concat(F.lit("\ufeff"), F.to_json(F.struct(F.col("rows").alias("d")))))
    levels = S.index_levels(files.select("file_id", content.alias("content")), strict=False)
    return levels.select("file_id", "index_name", "level_date", F.col("level").cast("double").alias("level"), F.col("net_level").cast("double").alias("net_level"))


_HEAD = ("Sr. No.", "Company name", "ISIN", "BSE Symbol", "BSE 6 month Avg Total Market Cap", "NSE Symbol", "NSE 6 month Avg Total Market Cap", "MSEI Symbol", "MSEI 6 month Avg Total Market Cap", "Average", "Categorization as per circular")


# One list per type of part; every eleventh company has no quote, every 13th no valid code, every second a stated bucket.
@C.query("""WITH p AS (SELECT p_type AS file_id, p_partkey AS id, CAST(p_retailprice AS DOUBLE) AS r FROM part),
v AS (SELECT *, id % 13 <> 0 AS valid, CASE WHEN id % 11 = 0 OR id % 13 = 0 THEN NULL WHEN id % 3 = 0 THEN r ELSE r + 0.5 END AS cap FROM p),
k AS (SELECT *, CASE WHEN cap IS NOT NULL THEN ROW_NUMBER() OVER (PARTITION BY file_id, cap IS NULL ORDER BY cap DESC, id) END AS rank FROM v),
b AS (SELECT *, CASE WHEN rank <= 100 THEN 'large' WHEN rank <= 250 THEN 'mid' WHEN rank IS NOT NULL THEN 'small' END AS bucket, CASE WHEN valid AND id % 2 = 0 THEN 'large' END AS stated FROM k)
SELECT file_id, DATE '2026-06-30' AS basis_date, 'Company ' || id AS company_name, ROUND(cap, 3) AS market_cap, CAST(rank AS INTEGER) AS rank, bucket, stated AS stated_bucket, CASE WHEN id % 3 <> 0 THEN 'N' || id END AS nse_symbol,
  CASE WHEN NOT valid THEN 'not a valid ISIN: none' WHEN stated <> bucket THEN 'stated large, by rank ' || bucket END AS problem FROM b""")  # fmt: skip
def market_values(spark: SparkSession, d: str) -> DataFrame:
    i, price = F.col("p_partkey"), F.col("p_retailprice")
    body = F.concat(F.lit("INE"), F.lpad(i.cast("string"), 8, "0"))
    none = F.lit("")
    quote = lambda c: F.when(i % 11 == 0, "-").otherwise(F.format_number(c, 3))
    code = F.when(i % 13 == 0, "none").otherwise(F.concat(body, T.isin_check_digit(body).cast("string")))
    cells = F.array(i.cast("string"), F.concat(F.lit("Company "), i.cast("string")), code, none, quote(price), F.when(i % 3 != 0, F.concat(F.lit("N"), i.cast("string"))).otherwise(none), F.when(i % 3 != 0, quote(price + 1)).otherwise(none), none, none, F.lit("=AVERAGE(E2)"), F.when(i % 2 == 0, "Large Cap").otherwise(none))
    parts = view(spark, d, "part").select(F.col("p_type").alias("file_id"), (i + 10).alias("row_number"), cells.alias("cells"))
    top = F.explode(F.array(F.struct(F.lit(1).cast("long").alias("n"), F.array(F.lit("Average Market Capitalization")).alias("c")), F.struct(F.lit(2).cast("long").alias("n"), F.array(*(F.lit(h) for h in _HEAD)).alias("c")))).alias("t")
    heads = parts.select("file_id").distinct().select("file_id", top).select("file_id", F.col("t.n").alias("row_number"), F.col("t.c").alias("cells"))
    listed = parts.unionByName(heads).withColumn("file_name", F.lit("AverageMarketCapitalization30jun2026.xlsx"))
    return S.market_values(listed).select("file_id", "basis_date", "company_name", F.round(F.col("market_cap").cast("double"), 3).alias("market_cap"), "rank", "bucket", "stated_bucket", "nse_symbol", "problem")


@C.query("""WITH n AS (SELECT DISTINCT l_suppkey AS scheme_id, CAST(l_shipdate AS DATE) AS d FROM lineitem), s AS (SELECT scheme_id, MIN(d) AS f, MAX(d) AS l, COUNT(*) AS c FROM n GROUP BY 1), w AS (SELECT MAX(l) AS newest FROM s),
g AS (SELECT scheme_id, MAX(step) AS gap FROM (SELECT scheme_id, d - LAG(d) OVER (PARTITION BY scheme_id ORDER BY d) AS step FROM n, w WHERE d >= newest - 31) GROUP BY 1),
x AS (SELECT s_suppkey AS scheme_id, f, l, c, COALESCE(gap, 0) AS gap, newest, s_suppkey % 60 < 30 AS asked FROM supplier LEFT JOIN s ON s_suppkey = s.scheme_id LEFT JOIN g ON s_suppkey = g.scheme_id, w),
r AS (SELECT *, CASE WHEN f IS NULL THEN 'no prices' WHEN l < newest - 5 THEN 'behind the newest daily file' WHEN f > DATE '2013-02-01' THEN 'starts after the fund''s launch' WHEN c < (l - f) * 0.5 THEN 'only the daily file''s days' WHEN gap > 5 THEN 'a ' || gap || '-day gap in the last month' END AS reason FROM x)
SELECT scheme_id, reason, CAST(y AS INTEGER) AS year, GREATEST(f, make_date(y, 1, 1)) AS chunk_start, LEAST(newest, make_date(y, 12, 31)) AS chunk_end FROM (SELECT *, unnest(range(year(f), year(newest) + 1)) AS y FROM r WHERE reason IS NOT NULL AND NOT (asked AND gap <= 5))""")  # fmt: skip
def backfill_plan(spark: SparkSession, d: str) -> DataFrame:
    """Every fund whose daily prices are short, with the calendar years to ask for from its first price to the newest of all. A fund was last asked for 0 to 59 days ago."""
    navs = view(spark, d, "lineitem").select(F.col("l_suppkey").alias("scheme_id"), F.col("l_shipdate").cast("date").alias("nav_date")).distinct()
    today = F.lit("2026-07-31").cast("date")
    schemes = view(spark, d, "supplier").select(F.col("s_suppkey").alias("scheme_id"), F.lit(None).cast("date").alias("inception"), F.date_sub(today, (F.col("s_suppkey") % 60).cast("int")).alias("fetched"))
    ends = navs.groupBy("scheme_id").agg(F.min("nav_date").alias("first")).crossJoin(F.broadcast(navs.agg(F.max("nav_date").alias("newest"))))
    chunks = B.year_chunks(B.short_histories(schemes, navs, today).join(ends, "scheme_id"), "first", "newest")
    return chunks.select("scheme_id", "reason", F.year("chunk_start").alias("year"), "chunk_start", "chunk_end")
