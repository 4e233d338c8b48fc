"""A printed account statement's rows as ledger transactions: types, charges, signs, net amounts, balances, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom.operators.ledger import BOOK

# What a row's wording says about its type, first match first.
TYPE_PATTERNS = (
    (r"reversal|rejected|failed|bounce|dishonour|dishonor", "REVERSAL"),
    (r"systematic\s+investment|sip\s+purchase|purchase\s*-\s*sip", "SIP"),
    (r"systematic\s+transfer.*out|stp\s+out|switch\s+out.*stp", "STP_OUT"),
    (r"systematic\s+transfer.*in|stp\s+in", "STP_IN"),
    (r"systematic\s+withdrawal|swp", "SWP"),
    (r"switch\s+out|switch\s*-\s*out|transfer\s+out", "SWITCH_OUT"),
    (r"switch\s+in|switch\s*-\s*in|transfer\s+in", "SWITCH_IN"),
    (r"dividend\s+reinvest|idcw\s+reinvest|reinvestment", "IDCW_REINVEST"),
    (r"dividend\s+payout|idcw\s+payout|dividend\b|idcw\b", "IDCW_PAYOUT"),
    (r"redemption|repurchase", "REDEMPTION"),
    (r"merger|amalgamat", "MERGER_IN"),
    (r"segregat|side\s*pocket", "SEGREGATION"),
    (r"purchase|investment|allotment", "PURCHASE"),
)
# Types whose wording is the same both ways; the sign of the units tells.
OUTWARD = {"MERGER_IN": "MERGER_OUT", "SWITCH_IN": "SWITCH_OUT", "STP_IN": "STP_OUT"}
# Rows that are charges on the transaction before them.
CHARGE_PATTERNS = (
    (r"\*+\s*stamp\s+duty\s*\*+", "stamp_duty"),
    (r"\*+\s*stt\s*\*+|securities\s+transaction\s+tax", "stt"),
    (r"\*+\s*exit\s+load\s*\*+|cdsc", "exit_load"),
    (r"\*+\s*tds\s*\*+|tax\s+deducted", "tds"),
)
# Types that take cash from the investor, and the day before which equity has a cost of its own.
OPENING_TYPES = ("PURCHASE", "SIP", "SWITCH_IN", "STP_IN", "IDCW_REINVEST", "MERGER_IN", "UNIT_SPLIT")
GRANDFATHER_DATE = "2018-01-31"
CHARGES = tuple(name for _, name in CHARGE_PATTERNS)


def _first_match(text: Column, patterns: tuple[tuple[str, str | Column], ...]) -> Column:
    out = F.when(F.lit(False), "")
    for pattern, value in patterns:
        out = out.when(F.regexp_like(text, F.lit(f"(?i){pattern}")), value)
    return out


def charge_field(text: Column) -> Column:
    """Which charge a row is; null for a transaction."""
    return _first_match(text, CHARGE_PATTERNS)


def txn_type(text: Column, units: Column, strict: bool = False) -> Column:
    """The type that a row's wording names; null, or with ``strict`` an error when it is read, if none does."""
    way = lambda kind: F.when(units < 0, OUTWARD[kind]).otherwise(kind) if kind in OUTWARD else kind
    kind = _first_match(text, tuple((pattern, way(kind)) for pattern, kind in TYPE_PATTERNS))
    return F.when(kind.isNull(), F.raise_error(F.concat(F.lit("no type for: "), text)).cast("string")).otherwise(kind) if strict else kind


def signed_amount(kind: Column, printed: Column) -> Column:
    """Cash as the investor sees it: negative when it leaves them. Statements print it without a sign."""
    return F.when(kind.isin(*OPENING_TYPES), -F.abs(printed)).otherwise(F.abs(printed))


def net_of_stamp_duty(amount: Column, units: Column, nav: Column, duty: Column) -> Column:
    """struct<amount, checked>: the amount less stamp duty where units times price shows that it was printed with it."""
    known = amount.isNotNull() & units.isNotNull() & nav.isNotNull() & (F.coalesce(duty, F.lit(0)) != 0)
    product = F.round((F.abs(units) * nav).cast("decimal(28,10)"), 4)
    gross = F.abs(F.abs(amount) - duty - product) < F.abs(F.abs(amount) - product)
    less = F.round((F.when(amount < 0, -1).otherwise(1) * (F.abs(amount) - duty)).cast("decimal(28,10)"), 4)
    return F.struct(F.when(known & gross, less).otherwise(amount).cast("decimal(28,4)").alias("amount"), F.coalesce(known, F.lit(False)).alias("checked"))


def with_charges(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Transactions with the charges printed below them, one column each; charge rows themselves go.

    ``lines`` has the columns of a book, ``order``, description and amount. A charge before any transaction of its book has no owner and goes too.
    """
    field = charge_field(F.col("description"))
    book = Window.partitionBy(*BOOK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    owned = lines.withColumn("charge", field).withColumn("owner", F.last(F.when(field.isNull(), F.col(order)), ignorenulls=True).over(book))
    sums = [F.sum(F.when(F.col("charge") == c, F.abs("amount")).otherwise(0)).cast("decimal(28,4)").alias(c) for c in CHARGES]
    charges = owned.filter("charge is not null and owner is not null").groupBy(*BOOK, "owner").agg(*sums)
    txns = owned.filter("charge is null").drop("charge")
    joined = txns.join(charges, [*BOOK, "owner"], "left").drop("owner")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("decimal(28,4)") for c in CHARGES})


def ignore_known(stored: DataFrame, new: DataFrame, key: str = "txn_id") -> DataFrame:
    """Of ``new`` rows, one for each key that is not stored yet; rows read twice change nothing."""
    return new.dropDuplicates([key]).join(stored.select(key).distinct(), key, "left_anti")


def latest_reported_balance(txns: DataFrame, as_of: Column) -> DataFrame:
    """Per book: the balance printed with its last row up to ``as_of``, by date, sequence and reference; books without one are not listed."""
    known = txns.filter((F.col("txn_date") <= as_of) & F.col("units_balance").isNotNull())
    return known.groupBy(*BOOK).agg(F.max_by("units_balance", F.struct("txn_date", "txn_seq", "txn_ref")).alias("units_balance"))


def starts_at_zero(txns: DataFrame) -> DataFrame:
    """Per book: whether its first row's printed balance is that row's units; null if none was printed."""
    first = txns.filter("units is not null").groupBy(*BOOK).agg(F.min_by(F.struct("units", "units_balance"), F.struct("txn_date", "txn_seq", "txn_ref")).alias("first"))
    return first.select(*BOOK, (F.abs("first.units_balance") == F.abs("first.units")).alias("starts_at_zero"))


def digest_id(*parts: str | Column, size: int = 32) -> Column:
    """The first hex digits of the SHA-256 of the parts, joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, size)


def lot_id(txn_id: Column) -> Column:
    return digest_id("lot", txn_id)


def consumption_id(lot: Column, close_txn_id: Column, sequence: Column) -> Column:
    return digest_id(lot, close_txn_id, sequence, size=64)


def reconciliation_id(user: Column, folio: Column, scheme: Column, as_of: Column) -> Column:
    return digest_id(user, folio, scheme, as_of, size=64)


def effective_cost(cost: Column, cost_per_unit: Column, units: Column, acquired: Column, tax_class: Column, nav_2018: Column, sale_nav: Column) -> Column:
    """struct<cost, basis>: for tax, equity from before the date counts as the greater of its cost and the lesser of that day's and the sale's price."""
    old = (acquired < F.lit(GRANDFATHER_DATE).cast("date")) & (tax_class == "equity") & nav_2018.isNotNull() & sale_nav.isNotNull()
    other = F.round((F.greatest(cost_per_unit, F.least(nav_2018, sale_nav)) * units).cast("decimal(28,10)"), 4)
    better = F.coalesce(old & (other > cost), F.lit(False))
    return F.struct(F.when(better, other).otherwise(cost).cast("decimal(28,4)").alias("cost"), F.when(better, "grandfathered").otherwise("actual").alias("basis"))


def settle_residual(consumed: DataFrame, key: str, order: str, total: str, part: str) -> DataFrame:
    """``part`` so that it sums to ``total`` within each ``key``: what rounding left over goes to the last row."""
    rows = Window.partitionBy(key)
    last = F.row_number().over(rows.orderBy(F.desc(order))) == 1
    rest = F.col(total) - F.sum(part).over(rows)
    return consumed.withColumn(part, F.when(last, F.col(part) + rest).otherwise(F.col(part)))


def lot_labels(lots: DataFrame) -> DataFrame:
    """L1, L2, ... within each book, in the order of acquisition."""
    return lots.withColumn("label", F.concat(F.lit("L"), F.row_number().over(Window.partitionBy(*BOOK).orderBy("acquired", "txn_seq", "txn_ref")).cast("string")))
