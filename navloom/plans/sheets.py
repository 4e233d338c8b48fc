"""Queries on disclosures read from cells. Each supplier's line items are laid out as a sheet; the SQL says what each row of it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navloom.plans.base import Catalogue
from navloom.sources import sheets as S
from navloom.sources.analogue import prelude, view

C = Catalogue()

HEADER = ("ISIN", "Name of the\nInstrument", "Industry", "Quantity", "Market value (Rs. in Lakhs)", "% to NAV")
EQUITY, LISTED, BUCKET = "Equity & related", "Listed / awaiting listing", "Debt and other papers"

# Rows 1-3: title, day, headings. 4, 5: two nested headings. Then equity, a row that states the sum of all others, those, and what follows the holdings.
_LAID = prelude("holding", "issuer") + """, h AS (SELECT scheme_id, issuer_id, mv, issuer_name, instrument_class = 'equity' AS eq FROM holding JOIN issuer USING (issuer_id)),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY scheme_id ORDER BY NOT eq, issuer_id) AS n, COUNT(CASE WHEN eq THEN 1 END) OVER (PARTITION BY scheme_id) AS e, COUNT(*) OVER (PARTITION BY scheme_id) AS c FROM h),
t AS (SELECT scheme_id, MIN(e) AS e, MIN(c) AS c, SUM(mv) AS total, SUM(CASE WHEN NOT eq THEN mv END) AS rest FROM k GROUP BY 1)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    h = view(spark, d, "holding").join(view(spark, d, "issuer"), "issuer_id").withColumn("eq", F.col("instrument_class") == "equity")
    fund = Window.partitionBy("scheme_id")
    k = h.withColumn("n", F.row_number().over(fund.orderBy(~F.col("eq"), "issuer_id"))).withColumn("e", F.count_if("eq").over(fund))
    t = k.groupBy("scheme_id").agg(F.min("e").alias("e"), F.count(F.lit(1)).alias("c"), F.sum("mv").alias("total"), F.sum(F.when(~F.col("eq"), F.col("mv"))).alias("rest"))
    row = lambda *cells: F.array(*(c if not isinstance(c, str) else F.lit(c) for c in cells))
    text = lambda c: c.cast("string")
    held = k.select("scheme_id", (5 + F.col("n") + F.when(F.col("eq"), 0).otherwise(1)).alias("row_number"), row("", F.col("issuer_name"), F.col("sector"), "10", text(F.col("mv")), "").alias("cells"))
    e, c = F.col("e"), F.col("c")
    fixed = [
        (F.lit(1), row(F.concat(F.lit("Fund "), "scheme_id"), "")),
        (F.lit(2), row("", F.concat(F.lit("Monthly portfolio as on "), F.lpad((F.col("scheme_id") % 28 + 1).cast("string"), 2, "0"), F.lit("-Jul-2026")))),
        (F.lit(3), row(*HEADER)),
        (F.lit(4), row("", EQUITY, "", "", "", "")),
        (F.lit(5), row("", LISTED, "", "", "", "")),
        (6 + e, F.when(F.col("rest").isNotNull(), row("", BUCKET, "", "", text(F.col("rest")), "")).otherwise(row(""))),
        (7 + c, row("", "", "Grand Total", "", text(F.col("total")), "100.00")),
        (8 + c, row("", "Notes: rounded", "", "", "", "")),
        (9 + c, row("", "Late row", "", "5", "7", "")),
        (10 + c, row("Banks", "28.94", "", "", "", "")),
        (11 + c, row("Direct Plan - Growth Option", "2,267.177", "", "", "", "")),
    ]
    pairs = F.explode(F.array(*(F.struct(n.cast("long").alias("row_number"), cells.alias("cells")) for n, cells in fixed))).alias("r")
    out = held.unionByName(t.select("scheme_id", pairs).select("scheme_id", F.col("r.row_number").alias("row_number"), "r.cells"))
    return out.select(F.col("scheme_id").alias("file_id"), F.lit("Portfolio").alias("sheet"), "row_number", "cells")


_ROWS = _LAID + f""", x AS (
  SELECT scheme_id AS file_id, 5 + n + CASE WHEN eq THEN 0 ELSE 1 END AS row_number, 'security' AS kind, CASE WHEN eq THEN '{EQUITY} :: {LISTED}' ELSE '{BUCKET}' END AS section, issuer_name AS name, CAST(mv AS DOUBLE) AS value, NULL AS nav FROM k
  UNION ALL SELECT scheme_id, 4, 'section_header', '{EQUITY}', '{EQUITY}', NULL, NULL FROM t
  UNION ALL SELECT scheme_id, 5, 'section_header', '{EQUITY} :: {LISTED}', '{LISTED}', NULL, NULL FROM t
  UNION ALL SELECT scheme_id, 6 + e, 'subtotal', '{EQUITY} :: {LISTED}', '{BUCKET}', CAST(rest AS DOUBLE), NULL FROM t WHERE rest IS NOT NULL
  UNION ALL SELECT scheme_id, 7 + c, 'total', '{EQUITY} :: {LISTED}', 'Grand Total', CAST(total AS DOUBLE), NULL FROM t
  UNION ALL SELECT scheme_id, 8 + c, 'note', '{EQUITY} :: {LISTED}', 'Notes: rounded', NULL, NULL FROM t
  UNION ALL SELECT scheme_id, 9 + c, 'after_total', '{EQUITY} :: {LISTED}', 'Late row', 7, NULL FROM t
  UNION ALL SELECT scheme_id, 10 + c, 'summary', '{EQUITY} :: {LISTED}', '', NULL, NULL FROM t
  UNION ALL SELECT scheme_id, 11 + c, 'summary', '{EQUITY} :: {LISTED}', '', NULL, 2267.177 FROM t)
"""


def _staged(spark: SparkSession, d: str) -> DataFrame:
    return S.without_subtotals(S.staged_rows(_cells(spark, d)))


@C.query(_ROWS + " SELECT file_id, row_number, kind, section, name, value, CAST(nav AS DOUBLE) AS stated_nav FROM x")
def sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    return _staged(spark, d).select("file_id", "row_number", "kind", "section", "name", F.col("value").cast("double").alias("value"), F.col("stated_nav").cast("double").alias("stated_nav"))


@C.query(_LAID + " SELECT scheme_id AS file_id, c AS n_securities, CAST(total AS DOUBLE) AS securities_value, CAST(total AS DOUBLE) AS stated_total, CAST(0 AS DOUBLE) AS error_pct, 1 AS pct_scale, TRUE AS reconciles FROM t")
def sheet_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    # Only what the sums need: the rows' sections are not worked out.
    rows = S.staged_rows(_cells(spark, d)).select(*S.ROW, "kind", "name", "isin", "quantity", "value", "pct", "is_grand_total")
    files = S.read_files(S.without_subtotals(rows))
    return files.withColumns({"securities_value": F.col("securities_value").cast("double"), "error_pct": F.round("error_pct", 6)})


@C.query(prelude("fund") + """ SELECT scheme_id AS file_id, CASE scheme_id % 4 WHEN 0 THEN DATE '2026-07-31' WHEN 1 THEN DATE '2026-06-05' WHEN 2 THEN DATE '2026-05-04' ELSE NULL END AS as_of FROM fund""")
def sheet_dates(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("scheme_id") % 4
    text = F.when(i == 0, "Portfolio as on 31/July/2026").when(i == 1, "as  ON Jun 5 ,2026 (unaudited)").otherwise("as on no day")
    name = F.when(i == 2, "Monthly Fund - 04 May 2026.xlsx").otherwise("Fund.xlsx")
    files = view(spark, d, "fund").select(F.col("scheme_id").alias("file_id"), name.alias("file_name"), F.lit("s").alias("sheet"), F.lit(1).alias("row_number"), F.array(F.lit(None).cast("string"), text).alias("cells"))
    return S.dates_of_files(files, files.select("file_id", "file_name"))


@C.query(prelude("fund") + """, x AS (SELECT scheme_id AS file_id, CASE scheme_id % 4 WHEN 0 THEN 'Nifty 50 TRI' WHEN 1 THEN 'Index ' || scheme_id WHEN 2 THEN 'Gold price' END AS text FROM fund) SELECT file_id, text FROM x WHERE text IS NOT NULL""")
def sheet_benchmarks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("scheme_id") % 4
    none = F.lit("")
    first = F.when(i == 0, F.array(F.lit("Benchmark : Nifty 50 TRI"), none)).when(i == 1, F.array(F.lit("Scheme name"), F.lit("Benchmark"))).when(i == 2, F.array(F.lit("measured against its benchmark “Gold price” since 2020"), none)).otherwise(F.array(F.lit("no such thing"), none))
    rows = view(spark, d, "fund").select("scheme_id", F.posexplode(F.array(first, F.array(F.lit("Fund"), F.concat(F.lit("Index "), "scheme_id")))).alias("row_number", "cells"))
    return S.declared_texts(rows.select(F.col("scheme_id").alias("file_id"), F.lit("s").alias("sheet"), "row_number", "cells")).select("file_id", "text")
