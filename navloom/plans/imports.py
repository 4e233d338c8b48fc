"""Queries on whole statements: events are printed as account statements, read back and imported; the SQL starts from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navloom.functions.text import group_indian
from navloom.operators import imports as I
from navloom.plans.base import Catalogue
from navloom.sources import statements as S
from navloom.sources.analogue import prelude, view
from navloom.sources.store import shared_folder, written

C = Catalogue()

#: What is printed for an event: wording, whether units leave, whether units and price are printed at all.
WORDINGS = {
    "PURCHASE": ("Purchase - Online", "Purchase Instalment No. 7", "Switch In - From Liquid", "Purchase"), "SIP": ("Systematic Investment (12/36)", "SIP Purchase", "Systematic Investment Purchase", "STP In - weekly"),
    "REDEMPTION": ("Redemption", "Switch Out - To Liquid Fund", "SWP monthly", "STP Out"), "IDCW_PAYOUT": ("IDCW Payout", "IDCW Payout per unit 2.50", "Dividend Payout @ 0.5", "IDCW Payout"),
    "REVERSAL": ("Rejected - Purchase", "Consolidation Adjustment Entry", "Reversal of SIP", "Dishonoured cheque"),
}
KINDS = {
    "PURCHASE": ("PURCHASE", "PURCHASE", "SWITCH_IN", "PURCHASE"), "SIP": ("SIP", "SIP", "SIP", "STP_IN"), "REDEMPTION": ("REDEMPTION", "SWITCH_OUT", "SWP", "STP_OUT"),
    "IDCW_PAYOUT": ("IDCW_PAYOUT",) * 4, "REVERSAL": ("REVERSAL", None, "REVERSAL", "REVERSAL"),
}


def _case(table: dict[str, tuple[str | None, ...]]) -> str:
    return "CASE " + " ".join(f"WHEN txn_type = '{t}' AND txn_ref % 4 = {i} THEN {'NULL' if w is None else chr(39) + w + chr(39)}" for t, ws in table.items() for i, w in enumerate(ws)) + " END"


#: What a statement prints of each event, in one text for both engines. Money is a thousand times the event's.
_PRINTED = f"""SELECT CONCAT('S', CAST(user_id AS STRING)) AS user_id, CONCAT(CAST(user_id * 1000 + 17 AS STRING), '/', SUBSTRING(folio, 2, 1)) AS folio, CONCAT('INF000A0', CAST(scheme_id AS STRING), '1B', CAST(scheme_id AS STRING)) AS isin, scheme_id AS fund,
       txn_date, txn_ref, {_case(WORDINGS)} AS wording, {_case(KINDS)} AS kind, txn_type = 'IDCW_PAYOUT' AS bare, CAST(amount * 1000 AS DECIMAL(18,2)) AS money,
       CAST(CASE WHEN txn_type IN ('REDEMPTION', 'REVERSAL') THEN -units WHEN txn_type = 'IDCW_PAYOUT' THEN 0 ELSE units END AS DECIMAL(18,3)) AS units, CAST(10 + txn_ref % 40 AS DECIMAL(18,4)) AS nav,
       CAST(CASE WHEN txn_type IN ('PURCHASE', 'SIP') THEN 0.25 * (1 + txn_ref % 3) WHEN txn_type = 'REDEMPTION' AND txn_ref % 3 = 0 THEN 1.75 ELSE 0 END AS DECIMAL(18,2)) AS fee, txn_type IN ('PURCHASE', 'SIP') AS buys
FROM {{txn}}"""
_P = prelude("txn") + ", printed AS (" + _PRINTED.replace("{txn}", "txn") + ")"


def _printed(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_PRINTED, txn=view(spark, d, "txn"))


def statement_lines(printed: DataFrame) -> DataFrame:
    """(file, line_no, line): one statement a user, as a registrar prints it, with a line that means nothing in every fund and a summary that repeats holdings."""
    block = Window.partitionBy("user_id", "folio", "isin").orderBy("txn_date", "txn_ref").rowsBetween(Window.unboundedPreceding, 0)
    rows = printed.withColumn("balance", F.sum("units").over(block) + 100000)
    number = lambda c: F.when(c < 0, F.concat(F.lit("("), group_indian(-c, 3), F.lit(")"))).otherwise(group_indian(c, 3))
    day = F.concat_ws("-", F.date_format("txn_date", "dd"), F.element_at(F.split(F.lit("Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec"), ","), F.month("txn_date")), F.date_format("txn_date", "yyyy"))
    middle = F.when(F.col("bare"), F.lit("          ")).otherwise(F.concat_ws("   ", number(F.col("units")), group_indian(F.col("nav"), 4)))
    line = F.concat_ws("   ", day, "wording", group_indian(F.col("money"), 2), middle, number(F.col("balance")))
    fee = F.when(F.col("fee") > 0, F.concat(F.when(F.col("buys"), "   *** Stamp Duty *** ").otherwise("   *** Exit Load *** "), group_indian(F.col("fee"), 2)))
    own = rows.select("user_id", "folio", "isin", F.lit(2).alias("part"), "txn_date", "txn_ref", F.posexplode(F.array_compact(F.array(line, fee))).alias("n", "line"))
    name = F.concat(F.lit("CODE"), "fund", F.lit("-Fund "), "fund", F.lit(" - Growth - ISIN: "), "isin")
    none = lambda kind: F.lit(None).cast(kind)
    blocks = printed.select("user_id", "folio", "isin", "fund").distinct()
    heads = blocks.select("user_id", "folio", "isin", F.lit(1).alias("part"), none("date").alias("txn_date"), none("long").alias("txn_ref"), F.posexplode(F.array(F.concat(F.lit("Folio No: "), F.replace("folio", F.lit("/"), F.lit(" / "))), name, F.lit("   Opening Unit Balance: 1,00,000.000"))).alias("n", "line"))
    tails = blocks.select("user_id", "folio", "isin", F.lit(3).alias("part"), none("date").alias("txn_date"), none("long").alias("txn_ref"), F.posexplode(F.array(F.lit("Page 1 of 1"), F.lit("terms may change"))).alias("n", "line"))
    ends = printed.select("user_id").distinct().select("user_id", F.lit("~").alias("folio"), F.lit("~").alias("isin"), F.lit(4).alias("part"), none("date").alias("txn_date"), none("long").alias("txn_ref"), F.posexplode(F.array(F.lit("Portfolio Summary"), F.lit("01-Jan-2024   Purchase   1,000.00   10.000   100.0000   10.000"))).alias("n", "line"))
    order = Window.partitionBy("user_id").orderBy("folio", "isin", "part", "txn_date", "txn_ref", "n")
    return own.unionByName(heads).unionByName(tails).unionByName(ends).select(F.col("user_id").alias("file"), F.row_number().over(order).alias("line_no"), "line")


def _read(spark: SparkSession, d: str) -> DataFrame:
    # The statements are written as text would be, and read from there.
    return S.read_statement(written(statement_lines(_printed(spark, d)), shared_folder(spark, "statements")))


def _typed(spark: SparkSession, read: DataFrame) -> DataFrame:
    schemes = spark.range(2).select(F.concat(F.lit("INF000A0"), "id", F.lit("1B"), "id").alias("isin"), F.concat(F.lit("S"), "id").alias("scheme_id"))
    return I.typed_rows(read, schemes)


_TYPED = _P + """,
q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, folio, isin, txn_date ORDER BY txn_ref) - 1 AS txn_seq, CASE WHEN fund < 2 THEN 'S' || fund ELSE lower('CODE' || fund || '-Fund ' || fund || ' - Growth') END AS scheme_id FROM printed),
s AS (SELECT *, kind IN ('PURCHASE', 'SIP', 'SWITCH_IN', 'STP_IN') AS opens, CASE WHEN buys THEN fee ELSE 0 END AS stamp_duty, CASE WHEN buys THEN 0 ELSE fee END AS exit_load, CAST(ABS(units) * nav AS DECIMAL(28,4)) AS product FROM q),
t AS (SELECT *, CAST(CASE WHEN opens THEN -1 ELSE 1 END * (money - CASE WHEN NOT bare AND stamp_duty <> 0 AND ABS(money - stamp_duty - product) < ABS(money - product) THEN stamp_duty ELSE 0 END) AS DECIMAL(20,4)) AS amount,
  NOT bare AND stamp_duty = 0 AND kind <> 'REVERSAL' AND units <> 0 AND money <> 0 AND ABS(money - product) > 1 AS off FROM s)
"""  # fmt: skip


@C.query(_TYPED + """SELECT user_id, folio, scheme_id, txn_date, txn_seq, kind AS txn_type, CASE WHEN bare THEN NULL ELSE CAST(units AS DOUBLE) END AS units, CAST(amount AS DOUBLE) AS amount, CAST(stamp_duty AS DOUBLE) AS stamp_duty, CAST(exit_load AS DOUBLE) AS exit_load,
  CAST(100000 + SUM(units) OVER (PARTITION BY user_id, folio, isin ORDER BY txn_date, txn_ref) AS DOUBLE) AS balance, bare AND txn_ref % 4 IN (1, 2) OR wording LIKE '%No. 7' AS solved,
  concat_ws(',', CASE WHEN fund >= 2 THEN 'UNRESOLVED_SCHEME' END, CASE WHEN off THEN 'AMOUNT_NAV_UNITS_DISAGREE' END) AS flags FROM t""")  # fmt: skip
def statement_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _typed(spark, _read(spark, d))
    exact = ("units", "amount", "stamp_duty", "exit_load", "balance")
    return rows.select("user_id", "folio", "scheme_id", "txn_date", "txn_seq", "txn_type", *(F.col(c).cast("double").alias(c) for c in exact), "solved", F.concat_ws(",", "flags").alias("flags"))


@C.query(_TYPED + """, k AS (SELECT user_id, COUNT(CASE WHEN kind IS NOT NULL AND day(txn_date) > 15 THEN 1 END) AS inserted, COUNT(CASE WHEN kind IS NOT NULL AND day(txn_date) <= 15 THEN 1 END) AS duplicate, COUNT(CASE WHEN kind IS NULL THEN 1 END) AS unmatched,
  COUNT(DISTINCT folio || isin) AS unparsed FROM t GROUP BY user_id)
SELECT *, 'partial' AS status FROM k""")  # fmt: skip
def statement_imports(spark: SparkSession, d: str) -> DataFrame:
    """Statements of a whole month after one of its first half: what the first brought is not brought again."""
    first = _typed(spark, S.read_statement(written(statement_lines(_printed(spark, d).filter("day(txn_date) <= 15")), shared_folder(spark, "statements"))))
    # Read lines are written, since both the rows and the lines left over are counted.
    half, read = I.new_rows(first, spark.createDataFrame([], "txn_id string")), written(_read(spark, d), shared_folder(spark, "read"))
    return I.import_report(read, _typed(spark, read), half.select("txn_id"))
