"""The driver's star schema read as fund tables.

Each view is one portable SQL text, so that Spark and the checking SQL start from the same rows. Suppliers stand for
funds, parts for issuers, line items for holdings and prices, orders for positions, events for transactions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from navloom.session import table

VIEWS = {
    "fund": """
        SELECT s_suppkey AS scheme_id, CAST(s_nationkey AS BIGINT) AS amc_id, s_name AS scheme_name, r_name AS category, s_acctbal AS ter
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "scheme": """
        SELECT scheme_id, amc_id, category, CONCAT('Fund ', CAST(CAST(FLOOR(scheme_id / 5) AS BIGINT) AS STRING)) AS scheme_name,
               CASE WHEN scheme_id % 2 = 0 THEN 'direct' ELSE 'regular' END AS plan, CASE WHEN scheme_id % 5 < 2 THEN 'growth' ELSE 'idcw' END AS option,
               CASE WHEN scheme_id % 3 = 0 THEN NULL ELSE CONCAT('INF', LPAD(CAST(scheme_id AS STRING), 9, '0')) END AS isin,
               CASE WHEN scheme_id % 4 = 0 THEN NULL ELSE CONCAT('C', CAST(CAST(FLOOR(scheme_id / 3) AS BIGINT) AS STRING)) END AS code,
               CONCAT('family ', CAST(amc_id * 10 + scheme_id % 4 AS STRING)) AS family, CONCAT('IX', CAST(scheme_id % 9 AS STRING)) AS key,
               CASE WHEN scheme_id % 6 = 0 THEN NULL ELSE CONCAT('IDX:', CAST(scheme_id % 9 AS STRING)) END AS benchmark_id,
               CASE WHEN scheme_id % 17 = 0 THEN scheme_id - 3 WHEN scheme_id % 5 <> 0 THEN scheme_id + 1 END AS merged_into,
               DATE '2024-01-31' - CAST(scheme_id % 60 AS INT) AS last_seen
        FROM {fund}""",
    "issuer": """
        SELECT p_partkey AS issuer_id,
               CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'MEDIUM', 'LARGE') THEN 'equity' WHEN p_type = 'SMALL' THEN 'debt' ELSE 'other' END AS instrument_class,
               p_brand AS sector, p_partkey % 20 = 0 AS is_synthetic, p_name AS issuer_name,
               CASE WHEN p_size > 45 THEN NULL ELSE p_retailprice END AS market_cap
        FROM {part}""",
    "holding": """
        SELECT l_suppkey AS scheme_id, l_partkey AS issuer_id, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS mv
        FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    "weight": """
        SELECT h.scheme_id, h.issuer_id, i.instrument_class, i.is_synthetic, i.sector,
               CAST(h.mv AS DOUBLE) * 1e2 / CAST(SUM(h.mv) OVER (PARTITION BY h.scheme_id) AS DOUBLE) AS weight
        FROM {holding} h JOIN {issuer} i ON h.issuer_id = i.issuer_id""",
    # Every tenth fund discloses nothing: for what depends on whether a fund is disclosed.
    "disclosed_weight": """
        SELECT scheme_id, issuer_id, instrument_class, is_synthetic, sector, weight FROM {weight} WHERE scheme_id % 10 <> 9""",
    "position": """
        SELECT CAST(c_nationkey AS BIGINT) AS user_id, o_orderpriority AS folio, l_suppkey AS scheme_id,
               CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value_inr
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
        GROUP BY c_nationkey, o_orderpriority, l_suppkey""",
    "nav": """
        SELECT l_suppkey AS scheme_id, last_day(CAST(l_shipdate AS DATE)) AS nav_date,
               FLOOR(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) * 1e4 + 0.5) / 1e4 AS nav
        FROM {lineitem} GROUP BY l_suppkey, last_day(CAST(l_shipdate AS DATE))""",
    "level": """
        SELECT last_day(CAST(l_shipdate AS DATE)) AS level_date,
               FLOOR(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) * 1e4 + 0.5) / 1e4 AS level
        FROM {lineitem} GROUP BY last_day(CAST(l_shipdate AS DATE))""",
    "disclosure": """
        SELECT l_suppkey AS scheme_id, last_day(CAST(l_shipdate AS DATE)) AS as_of, CASE WHEN l_linestatus = 'O' THEN 'amc' ELSE 'aggregator' END AS tier,
               COUNT(*) % 7 = 0 AS quarantined, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS aum
        FROM {lineitem} GROUP BY l_suppkey, last_day(CAST(l_shipdate AS DATE)), l_linestatus""",
    "txn": """
        SELECT user_id, CONCAT('F', CAST(user_id % 7 AS STRING)) AS folio, event_id % 3 AS scheme_id, CAST(ts AS DATE) AS txn_date, event_id AS txn_ref,
               CASE event_type WHEN 'purchase' THEN 'PURCHASE' WHEN 'signup' THEN 'SIP' WHEN 'click' THEN 'REDEMPTION' WHEN 'view' THEN 'IDCW_PAYOUT' ELSE 'REVERSAL' END AS txn_type,
               CAST(ROUND(CAST(value AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS amount, CAST(ROUND(CAST(value AS DECIMAL(18,6)) / 10, 3) AS DECIMAL(18,3)) AS units
        FROM {events}""",
    # Openings go back over years in steps of 600 days, on days of their own, so that no lot opens on the day of a closing.
    "book_txn": """
        SELECT user_id, folio, scheme_id, txn_ref, reverses_ref, txn_type, units, amount,
               CASE WHEN txn_type IN ('REDEMPTION', 'SWITCH_OUT', 'STP_OUT', 'SWP', 'MERGER_OUT') THEN txn_date + CAST(day(txn_date) + 1 AS INT)
                    ELSE txn_date + CAST(day(txn_date) AS INT) - CAST(txn_ref % 5 * 600 AS INT) END AS txn_date,
               CAST(10 + txn_ref % 40 AS DECIMAL(18,6)) AS nav, CASE WHEN scheme_id = 0 THEN NULL ELSE CAST(20 + scheme_id AS DECIMAL(18,6)) END AS nav_2018,
               CAST(CASE WHEN txn_type IN ('PURCHASE', 'SIP', 'SWITCH_IN', 'STP_IN', 'IDCW_REINVEST', 'MERGER_IN') THEN FLOOR(amount) / 2000 ELSE 0 END AS DECIMAL(18,4)) AS stamp_duty,
               CAST(CASE WHEN txn_type IN ('REDEMPTION', 'SWITCH_OUT') AND txn_ref % 3 = 0 THEN FLOOR(amount) / 100 ELSE 0 END AS DECIMAL(18,4)) AS exit_load,
               CAST(CASE WHEN txn_type IN ('REDEMPTION', 'SWITCH_OUT', 'STP_OUT', 'SWP', 'MERGER_OUT') THEN FLOOR(amount) / 1000 ELSE 0 END AS DECIMAL(18,4)) AS stt
        FROM (
          SELECT user_id, folio, scheme_id, txn_ref, txn_date, amount,
                 CASE WHEN txn_type = 'REVERSAL' AND txn_ref % 5 = 0 THEN LAG(txn_ref) OVER (PARTITION BY user_id, folio, scheme_id ORDER BY txn_date, txn_ref) END AS reverses_ref,
                 CASE WHEN txn_type = 'REDEMPTION' THEN CAST(FLOOR(units * 100) / 250 AS DECIMAL(18,3)) ELSE units END AS units,
                 CASE WHEN txn_type = 'PURCHASE' AND txn_ref % 6 = 0 THEN 'SWITCH_IN' WHEN txn_type = 'PURCHASE' AND txn_ref % 6 = 1 THEN 'STP_IN' WHEN txn_type = 'PURCHASE' AND txn_ref % 6 = 2 THEN 'IDCW_REINVEST'
                      WHEN txn_type = 'PURCHASE' AND txn_ref % 6 = 3 THEN 'MERGER_IN' WHEN txn_type = 'REDEMPTION' AND txn_ref % 6 = 0 THEN 'SWITCH_OUT' WHEN txn_type = 'REDEMPTION' AND txn_ref % 6 = 1 THEN 'STP_OUT'
                      WHEN txn_type = 'REDEMPTION' AND txn_ref % 6 = 2 THEN 'SWP' WHEN txn_type = 'REDEMPTION' AND txn_ref % 6 = 3 THEN 'MERGER_OUT' ELSE txn_type END AS txn_type
          FROM {txn}) AS typed""",
}
_NAME = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a driver table, as a DataFrame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    needed = dict.fromkeys(_NAME.findall(VIEWS[name]))
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in needed})


def prelude(*names: str) -> str:
    """``WITH`` clauses that define views, and those they need, in DuckDB."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in out:
            for n in dict.fromkeys(_NAME.findall(VIEWS[name])):
                add(n)
            out[name] = f"{name} AS ({_NAME.sub(lambda m: m[1], VIEWS[name])})"

    for n in names:
        add(n)
    return "WITH " + ",\n".join(out.values())
