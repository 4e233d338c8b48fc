"""Queries on disclosures in pages, and their SQL. Each fund's holdings are laid out as a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.plans.base import Catalogue
from navloom.sources import disclosure_pages as P
from navloom.sources.analogue import prelude, view

C = Catalogue()

# Funds by the last digit of their id: 3 states two dates, 4 a total of 1 % more, 5 none, 6 has no data; other natures than equity and debt are unknown.
_LAID = prelude("holding", "issuer") + """, h AS (SELECT h.*, issuer_name, sector, is_synthetic, CASE instrument_class WHEN 'equity' THEN 'EQUITY' WHEN 'debt' THEN 'DEBT' ELSE 'PLEDGE' END AS nature FROM holding h JOIN issuer i ON h.issuer_id = i.issuer_id)
"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    i, fund = F.col("issuer_id"), F.col("scheme_id")
    nature = F.when(F.col("instrument_class") == "equity", "Equity").when(F.col("instrument_class") == "debt", "DEBT").otherwise("pledge")
    instrument = F.when(F.col("is_synthetic"), " Net Payables ").when(i % 17 == 0, "Index Futures").otherwise("Shares")
    stamp = F.when((fund % 10 == 3) & (i % 2 == 0), "2026-05-30T18:30:00.000Z").otherwise("2026-06-29T18:30:00.000Z")
    holding = F.struct(F.col("issuer_name").alias("company_name"), nature.alias("nature_name"), instrument.alias("instrument_name"), F.col("sector").alias("sector_name"), F.col("mv").alias("market_value"), stamp.alias("portfolio_date"), i.alias("place"))
    held = view(spark, d, "holding").join(view(spark, d, "issuer"), "issuer_id").groupBy("scheme_id").agg(F.collect_list(holding).alias("holdings"), F.sum("mv").alias("total"))
    aum = F.when(fund % 10 != 5, F.col("total") * F.when(fund % 10 == 4, F.lit(1.01)).otherwise(F.lit(1.0)).cast("decimal(5,2)"))
    page = F.struct(F.struct(F.struct(F.struct(F.concat(F.lit("Fund "), fund).alias("scheme_name"), aum.alias("aum"), "holdings").alias("mfServerSideData")).alias("pageProps")).alias("props"))
    html = F.concat(F.lit('<html><body><script id="'), F.when(fund % 10 == 6, "other").otherwise("__NEXT_DATA__"), F.lit('" type="application/json">'), F.to_json(page), F.lit("</script></body></html>"))
    return held.select(fund.alias("file_id"), html.alias("html"))


@C.query(_LAID + """SELECT scheme_id AS file_id, DATE '2026-06-30' AS as_of, issuer_name AS name, sector, CAST(mv AS DOUBLE) AS market_value, COUNT(*) OVER (PARTITION BY scheme_id) AS n_rows,
  CASE WHEN issuer_id % 17 = 0 AND NOT is_synthetic THEN 'DERIVATIVES' WHEN is_synthetic THEN 'CASH & CASH EQUIVALENT' WHEN nature = 'EQUITY' THEN 'EQUITY & EQUITY RELATED' WHEN nature = 'DEBT' THEN 'DEBT INSTRUMENTS' ELSE nature END AS section
FROM h WHERE scheme_id % 10 <> 6 AND NOT (scheme_id % 10 = 3 AND EXISTS (SELECT 1 FROM h x WHERE x.scheme_id = h.scheme_id AND x.issuer_id % 2 = 0) AND EXISTS (SELECT 1 FROM h x WHERE x.scheme_id = h.scheme_id AND x.issuer_id % 2 = 1))""")  # fmt: skip
def page_holdings(spark: SparkSession, d: str) -> DataFrame:
    rows = P.page_holdings(_pages(spark, d))
    return rows.select("file_id", "as_of", "name", "sector", F.col("market_value").cast("double").alias("market_value"), "n_rows", "section")


@C.query(_LAID + """, s AS (SELECT scheme_id, SUM(mv) AS total, COUNT(DISTINCT issuer_id % 2) AS sides, MAX(CASE WHEN nature = 'PLEDGE' THEN 1 ELSE 0 END) AS odd FROM h GROUP BY 1),
p AS (SELECT *, CASE WHEN scheme_id % 10 = 6 THEN 'no data in the page' WHEN scheme_id % 10 = 3 AND sides = 2 THEN 'several dates: 2026-05-30T18:30:00.000Z, 2026-06-29T18:30:00.000Z' END AS problem FROM s)
SELECT scheme_id AS file_id, problem, CASE WHEN problem IS NULL THEN CAST(total AS DOUBLE) END AS summed,
  CASE WHEN problem IS NULL THEN concat_ws('; ', CASE WHEN scheme_id % 10 = 5 THEN 'no total stated' WHEN scheme_id % 10 = 4 THEN 'holdings off the stated total by -0.9901%' END, CASE WHEN odd = 1 THEN 'natures without a section: PLEDGE' END) END AS warnings FROM p""")  # fmt: skip
def page_disclosures(spark: SparkSession, d: str) -> DataFrame:
    files = P.page_files(_pages(spark, d))
    return files.select("file_id", "problem", F.when(F.col("problem").isNull(), F.col("summed").cast("double")).alias("summed"), F.array_join("warnings", "; ").alias("warnings"))
