"""Queries on printed statements and on how figures are shown. Events stand for a statement's rows; wordings go by reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.functions import shown as S
from navloom.operators import statement as T
from navloom.plans.base import Catalogue
from navloom.sources.analogue import prelude, view

C = Catalogue()

WORDINGS = (
    "Purchase - Online", "SIP Purchase (12/36)", "Systematic Investment No. 7", "Redemption", "Switch Out - To Liquid Fund", "Switch In", "STP Out", "STP In - weekly",
    "*** Stamp Duty ***", "*** STT ***", "*** Exit Load ***", "IDCW Payout @ 0.5", "Dividend Reinvestment", "Merger of schemes", "Rejected - Purchase", "SWP monthly", "Repurchase", "side pocket", "*** TDS ***", "no such wording",
)
_LINE = prelude("txn") + f""", line AS (
  SELECT user_id, folio, scheme_id, txn_date, txn_ref, txn_ref AS line_no, CAST(txn_ref % 4 AS BIGINT) AS txn_seq,
         CASE txn_ref * 7 % {len(WORDINGS)} {" ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDINGS))} END AS description,
         CASE WHEN txn_ref % 11 = 0 THEN NULL WHEN txn_ref % 3 = 0 THEN -units ELSE units END AS units, amount,
         CASE WHEN txn_ref % 5 = 0 THEN NULL WHEN txn_ref % 2 = 0 THEN units ELSE units + 1 END AS units_balance
  FROM txn)
"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    words = F.element_at(F.array(*(F.lit(w) for w in WORDINGS)), (F.col("txn_ref") * 7 % len(WORDINGS) + 1).cast("int"))
    ref, units = F.col("txn_ref"), F.col("units")
    return view(spark, d, "txn").select(
        "user_id", "folio", "scheme_id", "txn_date", "txn_ref", ref.alias("line_no"), (ref % 4).cast("long").alias("txn_seq"), words.alias("description"),
        F.when(ref % 11 == 0, None).when(ref % 3 == 0, -units).otherwise(units).alias("units"), "amount",
        F.when(ref % 5 == 0, None).when(ref % 2 == 0, units).otherwise(units + 1).alias("units_balance"),
    )


def _case(patterns: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(description, '(?i){p}') THEN '{v}'" for p, v in patterns) + " END"


_TYPED = _LINE + f""", k0 AS (SELECT *, {_case(T.TYPE_PATTERNS)} AS kind0, {_case(T.CHARGE_PATTERNS)} AS charge FROM line),
k AS (SELECT *, CASE WHEN units < 0 AND kind0 IN ('MERGER_IN', 'SWITCH_IN', 'STP_IN') THEN replace(kind0, '_IN', '_OUT') ELSE kind0 END AS kind FROM k0)
"""


@C.query(_TYPED + """SELECT txn_ref, charge, CASE WHEN charge IS NULL THEN kind END AS kind,
CAST(CASE WHEN kind IN ('PURCHASE', 'SIP', 'SWITCH_IN', 'STP_IN', 'IDCW_REINVEST', 'MERGER_IN', 'UNIT_SPLIT') THEN -ABS(amount) ELSE ABS(amount) END AS DOUBLE) AS signed FROM k""")  # fmt: skip
def statement_types(spark: SparkSession, d: str) -> DataFrame:
    kind, charge = T.txn_type(F.col("description"), F.col("units")), T.charge_field(F.col("description"))
    signed = F.when(kind.isNull(), F.abs("amount")).otherwise(T.signed_amount(kind, F.col("amount"))).cast("double")
    return _lines(spark, d).select("txn_ref", charge.alias("charge"), F.when(charge.isNull(), kind).alias("kind"), signed.alias("signed"))


@C.query(_TYPED + """, o AS (SELECT *, MAX(CASE WHEN charge IS NULL THEN line_no END) OVER (PARTITION BY user_id, folio, scheme_id ORDER BY line_no) AS owner FROM k)
SELECT t.txn_ref, """ + ", ".join(f"CAST(COALESCE((SUM(CASE WHEN c.charge = '{c}' THEN ABS(c.amount) END)), 0) AS DOUBLE) AS {c}" for c in T.CHARGES) + """
FROM o t LEFT JOIN o c ON c.charge IS NOT NULL AND c.owner = t.line_no AND c.user_id = t.user_id AND c.folio = t.folio AND c.scheme_id = t.scheme_id WHERE t.charge IS NULL GROUP BY t.txn_ref""")  # fmt: skip
def statement_charges(spark: SparkSession, d: str) -> DataFrame:
    return T.with_charges(_lines(spark, d)).select("txn_ref", *(F.col(c).cast("double").alias(c) for c in T.CHARGES))


@C.query(_LINE + """, x AS (SELECT *, CAST(50 + txn_ref % 7 AS DECIMAL(18,4)) / 10 AS nav0, CAST(CASE WHEN txn_ref % 6 = 0 THEN 0 ELSE txn_ref % 5 END AS DECIMAL(18,4)) AS duty FROM line),
y AS (SELECT *, CAST(nav0 AS DECIMAL(18,4)) AS nav, CAST(ABS(units) * CAST(nav0 AS DECIMAL(18,4)) AS DECIMAL(28,4)) AS product FROM x)
SELECT txn_ref, CAST(CASE WHEN units IS NOT NULL AND duty <> 0 AND ABS(ABS(amount) - duty - product) < ABS(ABS(amount) - product) THEN SIGN(amount) * (ABS(amount) - duty) ELSE amount END AS DOUBLE) AS net,
       COALESCE(units IS NOT NULL AND amount IS NOT NULL AND duty <> 0, FALSE) AS checked FROM y""")  # fmt: skip
def statement_net_amounts(spark: SparkSession, d: str) -> DataFrame:
    ref = F.col("txn_ref")
    nav = ((50 + ref % 7).cast("decimal(18,4)") / 10).cast("decimal(18,4)")
    duty = F.when(ref % 6 == 0, 0).otherwise(ref % 5).cast("decimal(18,4)")
    rows = _lines(spark, d).select("txn_ref", T.net_of_stamp_duty(F.col("amount"), F.col("units"), nav, duty).alias("n"))
    return rows.select("txn_ref", F.col("n.amount").cast("double").alias("net"), "n.checked")


@C.query(_LINE + """, s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, folio, scheme_id ORDER BY txn_date DESC, txn_seq DESC, txn_ref DESC) AS rk FROM line WHERE units_balance IS NOT NULL AND txn_date <= DATE '2024-01-20')
SELECT user_id, folio, scheme_id, CAST(units_balance AS DOUBLE) AS units_balance FROM s WHERE rk = 1""")  # fmt: skip
def latest_reported_balance(spark: SparkSession, d: str) -> DataFrame:
    return T.latest_reported_balance(_lines(spark, d), F.lit("2024-01-20").cast("date")).withColumn("units_balance", F.col("units_balance").cast("double"))


@C.query(_LINE + """, s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, folio, scheme_id ORDER BY txn_date, txn_seq, txn_ref) AS rk FROM line WHERE units IS NOT NULL)
SELECT user_id, folio, scheme_id, ABS(units_balance) = ABS(units) AS starts_at_zero FROM s WHERE rk = 1""")  # fmt: skip
def books_start_at_zero(spark: SparkSession, d: str) -> DataFrame:
    return T.starts_at_zero(_lines(spark, d))


@C.query(_LINE + "SELECT txn_ref, txn_date, CAST(units AS DOUBLE) AS units FROM (SELECT * FROM line UNION ALL SELECT * FROM line WHERE txn_ref % 2 = 0) WHERE txn_ref % 3 <> 0 GROUP BY ALL")
def ignore_known_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).select("txn_ref", "txn_date", F.col("units").cast("double").alias("units"))
    stored, again = lines.filter("txn_ref % 3 = 0"), lines.filter("txn_ref % 2 = 0")
    return T.ignore_known(stored, lines.union(again), "txn_ref")


@C.query(_LINE + """SELECT txn_ref, substr(sha256(concat('lot|', txn_ref)), 1, 32) AS lot_id, sha256(concat(substr(sha256(concat('lot|', txn_ref)), 1, 32), '|', txn_ref + 1, '|', txn_seq)) AS consumption_id,
sha256(concat(user_id, '|', folio, '|', scheme_id, '|', txn_date)) AS reconciliation_id, substr(sha256(description), 1, 64) AS file_id FROM line""")  # fmt: skip
def ledger_digest_ids(spark: SparkSession, d: str) -> DataFrame:
    lot = T.lot_id(F.col("txn_ref"))
    recon = T.reconciliation_id(F.col("user_id"), F.col("folio"), F.col("scheme_id"), F.col("txn_date"))
    return _lines(spark, d).select("txn_ref", lot.alias("lot_id"), T.consumption_id(lot, F.col("txn_ref") + 1, F.col("txn_seq")).alias("consumption_id"), recon.alias("reconciliation_id"), F.sha2("description", 256).alias("file_id"))


@C.query(_LINE + """, l AS (SELECT txn_ref, CAST(ABS(units) AS DECIMAL(18,4)) AS u, CAST(amount AS DECIMAL(18,4)) AS cost, CAST(txn_ref % 13 + 1 AS DECIMAL(18,4)) AS cpu, CAST(CASE WHEN txn_ref % 4 = 0 THEN NULL ELSE txn_ref % 17 END AS DECIMAL(18,4)) AS nav18,
  CAST(txn_ref % 23 AS DECIMAL(18,4)) AS sale, CASE WHEN txn_ref % 2 = 0 THEN 'equity' ELSE 'debt' END AS tax, CAST(DATE '2018-02-10' - CAST(txn_ref % 40 AS INTEGER) AS DATE) AS acquired FROM line WHERE units IS NOT NULL),
o AS (SELECT *, CAST(GREATEST(cpu, LEAST(nav18, sale)) * u AS DECIMAL(28,4)) AS other FROM l)
SELECT txn_ref, CAST(CASE WHEN acquired < DATE '2018-01-31' AND tax = 'equity' AND nav18 IS NOT NULL AND other > cost THEN other ELSE cost END AS DOUBLE) AS cost,
       CASE WHEN acquired < DATE '2018-01-31' AND tax = 'equity' AND nav18 IS NOT NULL AND other > cost THEN 'grandfathered' ELSE 'actual' END AS basis FROM o""")  # fmt: skip
def grandfathered_cost(spark: SparkSession, d: str) -> DataFrame:
    ref, dec = F.col("txn_ref"), lambda c: c.cast("decimal(18,4)")
    rows = _lines(spark, d).filter("units is not null")
    got = T.effective_cost(
        dec(F.col("amount")), dec(ref % 13 + 1), dec(F.abs("units")), F.date_sub(F.lit("2018-02-10").cast("date"), (ref % 40).cast("int")), F.when(ref % 2 == 0, "equity").otherwise("debt"),
        dec(F.when(ref % 4 == 0, None).otherwise(ref % 17)), dec(ref % 23),
    )
    return rows.select("txn_ref", got.alias("c")).select("txn_ref", F.col("c.cost").cast("double").alias("cost"), "c.basis")


@C.query(_LINE + """, c AS (SELECT user_id, txn_ref, CAST(SUM(amount) OVER (PARTITION BY user_id) AS DECIMAL(28,4)) AS total, CAST(ROUND(amount, 0) AS DECIMAL(28,4)) AS part FROM line),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY txn_ref DESC) AS rk, total - SUM(part) OVER (PARTITION BY user_id) AS rest FROM c)
SELECT user_id, txn_ref, CAST(CASE WHEN rk = 1 THEN part + rest ELSE part END AS DOUBLE) AS part FROM r""")  # fmt: skip
def proceeds_residual(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).selectExpr("user_id", "txn_ref", "cast(sum(amount) over (partition by user_id) as decimal(28,4)) as total", "cast(round(amount, 0) as decimal(28,4)) as part")
    return T.settle_residual(rows, "user_id", "txn_ref", "total", "part").select("user_id", "txn_ref", F.col("part").cast("double").alias("part"))


@C.query(_LINE + "SELECT txn_ref, 'L' || ROW_NUMBER() OVER (PARTITION BY user_id, folio, scheme_id ORDER BY txn_date, txn_seq, txn_ref) AS label FROM line")
def lot_labels(spark: SparkSession, d: str) -> DataFrame:
    return T.lot_labels(_lines(spark, d).withColumn("acquired", F.col("txn_date"))).select("txn_ref", "label")


@C.query(_LINE + """, v AS (SELECT txn_ref, CASE WHEN txn_ref % 9 = 0 THEN NULL ELSE CAST(amount - 5 AS DECIMAL(18,2)) END AS v, txn_ref % 2 = 0 AS ann, CAST(CASE WHEN txn_ref % 9 = 0 THEN NULL ELSE txn_ref % 6 END AS BIGINT) AS n, txn_date FROM line)
SELECT txn_ref, CASE WHEN v IS NULL THEN '—' ELSE printf('%.1f', CAST(ROUND(v, 1) AS DOUBLE)) || '%' END AS pct,
 CASE WHEN v IS NULL THEN '—' ELSE (CASE WHEN v >= 0 THEN '+' ELSE '' END) || printf('%.1f', CAST(ROUND(v * 100, 1) AS DOUBLE)) || CASE WHEN ann THEN '% p.a.' ELSE '%' END END AS ret,
 strftime(txn_date, '%d %b %Y') AS day, CASE WHEN n IS NULL THEN '—' WHEN n = 0 THEN 'today' WHEN n = 1 THEN '1 day old' ELSE n || ' days old' END AS age,
 COALESCE(n, 1) || CASE WHEN COALESCE(n, 1) = 1 THEN ' smaller holding' ELSE ' smaller holdings' END AS others,
 list_position(['low', 'medium', 'high'], ['low', 'medium', 'high'][txn_ref % 3 + 1]) < 2 AS hidden FROM v""")  # fmt: skip
def shown_figures(spark: SparkSession, d: str) -> DataFrame:
    ref = F.col("txn_ref")
    rows = _lines(spark, d).select("txn_ref", "txn_date", F.when(ref % 9 != 0, (F.col("amount") - 5).cast("decimal(18,2)")).alias("v"), F.when(ref % 9 != 0, ref % 6).alias("n"))
    level = F.element_at(F.array(*(F.lit(c) for c in S.CONFIDENCE)), (ref % 3 + 1).cast("int"))
    return rows.select(
        "txn_ref", S.pct_text(F.col("v")).alias("pct"), S.return_text(F.col("v"), ref % 2 == 0).alias("ret"), S.date_text(F.col("txn_date")).alias("day"), S.staleness_text(F.col("n")).alias("age"),
        S.others_text(F.coalesce("n", F.lit(1))).alias("others"), S.suppressed(level, F.lit("medium")).alias("hidden"),
    )


@C.query(prelude("nav") + """, s AS (SELECT scheme_id, MIN(nav_date) AS f, MAX(nav_date) AS l, COUNT(*) AS n FROM nav GROUP BY 1), x AS (SELECT *, MAX(l) OVER () AS newest FROM s)
SELECT scheme_id, CAST(last_day(CAST(l - INTERVAL 1 MONTH * CASE WHEN day(l) > 10 THEN 1 ELSE 2 END AS DATE)) AS DATE) AS due, CAST(date_trunc('month', l - INTERVAL 1 MONTH) AS DATE) AS month_before, ABS(CAST(l AS DATE) - CAST(f AS DATE)) AS age,
  year(l) - 1 < year(f) OR year(l) - 1 >= year(l) AS year_needed,
  CASE WHEN l < newest - 5 THEN 'behind the newest daily file' WHEN f > DATE '2013-01-01' + 31 THEN 'starts after the fund''s launch' WHEN n < (l - f) * 0.5 THEN 'only the daily file''s days' WHEN scheme_id % 9 > 5 THEN 'a ' || scheme_id % 9 || '-day gap in the last month' END AS reason FROM x""")  # fmt: skip
def history_dates(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "nav").groupBy("scheme_id").agg(F.min("nav_date").alias("f"), F.max("nav_date").alias("l"), F.count(F.lit(1)).alias("n"))
    s = s.crossJoin(F.broadcast(s.agg(F.max("l").alias("newest"))))
    f, last = F.col("f"), F.col("l")
    return s.select(
        "scheme_id", S.expected_as_of(last).alias("due"), S.last_month(last).alias("month_before"), S.age_days(last, f).cast("long").alias("age"), S.still_needed(F.year(last) - 1, f, last).alias("year_needed"),
        S.short_reason(f, last, F.col("n"), F.col("scheme_id") % 9, F.lit(None).cast("date"), F.col("newest")).alias("reason"),
    )


@C.query(prelude("issuer") + r""", n AS (SELECT issuer_id, CASE issuer_id % 5 WHEN 0 THEN '7.45% ' || issuer_name || ' (21/03/2027) **' WHEN 1 THEN 'CP' WHEN 2 THEN issuer_name || ' - ' WHEN 3 THEN '7.1%' ELSE issuer_name END AS t FROM issuer),
b AS (SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^\s*\d+(\.\d+)?\s*%\s*', ''), '\([^)]*\)', ' ', 'g'), '[*#$^~]+', ' ', 'g'), '\s+', ' ', 'g')), '^[ ,.-]+|[ ,.-]+$', '', 'g') AS bare FROM n)
SELECT issuer_id, bare, len(list_filter(string_split_regex(bare, '[^A-Za-z]+'), lambda w: length(w) > 2)) >= 2 AND NOT regexp_matches(bare, '(?i)^(cp|[\d.\s%]+)$') AND bare <> '' AS informative FROM b""")  # fmt: skip
def borrower_names(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("issuer_id") % 5
    name = F.when(i == 0, F.concat(F.lit("7.45% "), "issuer_name", F.lit(" (21/03/2027) **"))).when(i == 1, "CP").when(i == 2, F.concat("issuer_name", F.lit(" - "))).when(i == 3, "7.1%").otherwise(F.col("issuer_name"))
    return view(spark, d, "issuer").select("issuer_id", S.borrower_name(name).alias("bare"), S.is_informative(name).alias("informative"))


@C.query(prelude("issuer") + """, n AS (SELECT issuer_id, sector || ' ' || instrument_class || ' Index TRI' AS t, CASE issuer_id % 6 WHEN 0 THEN 'Equity Scheme - Mid Cap' WHEN 1 THEN 'Liquid' WHEN 2 THEN 'Hybrid Scheme - Other' WHEN 3 THEN 'Retirement Fund' WHEN 4 THEN 'FoF  Overseas' ELSE 'Income - x' END AS c FROM issuer)
SELECT issuer_id, CASE WHEN issuer_id % 2 = 0 THEN 'NSE' ELSE 'SOME_HOUSE' END || ':' || regexp_replace(regexp_replace(upper(replace(t, ' TRI', ' ')), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || CASE WHEN issuer_id % 3 = 0 THEN '_TRI' ELSE '_PRI' END AS index_id,
  ['equity', 'debt', 'hybrid', 'solution', 'other', 'debt'][issuer_id % 6 + 1] AS family, 'unmapped/' || regexp_replace(lower(c), '[^a-z0-9]+', '_', 'g') AS category FROM n""")  # fmt: skip
def index_ids_and_families(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("issuer_id")
    name = F.concat_ws(" ", "sector", "instrument_class", F.lit("Index TRI"))
    heading = F.element_at(F.array(*(F.lit(h) for h in ("Equity Scheme - Mid Cap", "Liquid", "Hybrid Scheme - Other", "Retirement Fund", "FoF  Overseas", "Income - x"))), (i % 6 + 1).cast("int"))
    provider = F.when(i % 2 == 0, "NSE Indices").otherwise("Some House")
    return view(spark, d, "issuer").select("issuer_id", S.index_id(name, provider, i % 3 == 0).alias("index_id"), S.family_of(heading).alias("family"), S.category_key(heading).alias("category"))
