"""From a statement's text to ledger rows: typed, signed, net of duty, numbered, resolved, told from rows already stored, linked.

Nothing is guessed: rows whose wording names no type are set aside, unexplained lines are counted, and either makes the
import partial. Loading the same period twice adds nothing, since a row's id comes from what it says and not from where it stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navloom.operators.ledger import link_reversals, link_switches, with_ids
from navloom.operators.lots import CLOSING_TYPES
from navloom.operators.statement import OPENING_TYPES, net_of_stamp_duty, signed_amount, txn_type
from navloom.sources.statements import transactions

# Fixed value: rupees by which an amount may differ from units times price.
AMOUNT_TOLERANCE = 1


def typed_rows(read: DataFrame, schemes: DataFrame) -> DataFrame:
    """Transactions of ``read_statement`` as ledger rows; txn_type is null where the wording names none.

    ``schemes`` (isin, scheme_id) resolves codes. ``user_id`` is the statement's file. ``txn_seq`` counts a book's rows of one day, so it does
    not depend on where a statement begins. Flags: UNRESOLVED_SCHEME, AMOUNT_NAV_UNITS_DISAGREE.
    """
    rows = transactions(read).withColumnRenamed("file", "user_id")
    day = Window.partitionBy("user_id", "folio", "isin", "txn_date").orderBy("line_no")
    rows = rows.withColumn("txn_seq", F.row_number().over(day) - 1).withColumn("txn_type", txn_type(F.col("description"), F.col("units")))
    printed = F.col("amount")
    rows = rows.withColumn("net", net_of_stamp_duty(signed_amount(F.col("txn_type"), printed), F.col("units"), F.col("nav"), F.col("stamp_duty")))
    product = F.round((F.abs("units") * F.col("nav")).cast("decimal(28,10)"), 4)
    priced = F.col("txn_type").isin(*OPENING_TYPES, *CLOSING_TYPES) & (F.col("units") != 0) & (F.col("nav") != 0) & (printed != 0)
    off = F.coalesce(~F.col("net.checked") & priced & (F.abs(F.abs(printed) - product) > AMOUNT_TOLERANCE), F.lit(False))
    known = schemes.select("isin", F.col("scheme_id").cast("string").alias("scheme_id")).dropDuplicates(["isin"])
    rows = rows.withColumn("off", off).withColumn("amount", F.col("net.amount")).drop("net").join(known, "isin", "left")
    flags = F.array_compact(F.array(F.when(F.col("scheme_id").isNull(), "UNRESOLVED_SCHEME"), F.when(F.col("off"), "AMOUNT_NAV_UNITS_DISAGREE")))
    # An unresolved scheme goes by its name, so that two of them stay apart.
    rows = rows.withColumn("flags", flags).withColumn("scheme_id", F.coalesce("scheme_id", F.lower(F.trim("scheme_name")))).drop("off")
    ref = F.concat_ws("-", F.right("isin", F.lit(6)), F.date_format("txn_date", "yyyyMMdd"), F.col("txn_seq"))
    exact = {"units": F.col("units").cast("decimal(20,6)"), "amount": F.col("amount").cast("decimal(20,4)")}
    return with_ids(rows.withColumns(exact)).withColumn("txn_ref", ref)


def new_rows(typed: DataFrame, known_ids: DataFrame) -> DataFrame:
    """Typed rows not stored yet (``known_ids``: txn_id), the first of equal ones, with their links: switch_group_id and reverses_id.

    Flags are added for legs out without a leg in and reversals of nothing.
    """
    first = F.row_number().over(Window.partitionBy("txn_id").orderBy("user_id", "line_no")) == 1
    fresh = typed.filter("txn_type is not null").withColumn("first", first).filter("first").drop("first").join(known_ids.select("txn_id").distinct(), "txn_id", "left_anti")
    # Links go by the place in the statement: legs are taken in that order.
    placed = fresh.withColumn("place", F.format_string("%s:%09d", F.col("user_id").cast("string"), "line_no"))
    work = placed.select("user_id", "folio", "scheme_id", "txn_date", "txn_seq", "txn_type", "units", "amount", "exit_load", "stt", "stamp_duty", F.col("place").alias("txn_ref"))
    switches = link_switches(work).select(F.col("out_ref").alias("place"), "in_ref")
    legs = switches.filter("in_ref is not null").select(F.explode(F.array("place", "in_ref")).alias("leg"), F.concat(F.lit("SW-"), "place").alias("switch_group_id")).withColumnRenamed("leg", "place")
    ids = placed.select(F.col("place").alias("taken"), F.col("txn_id").alias("reverses_id"))
    reversals = link_reversals(work).select(F.col("reversal_ref").alias("place"), F.col("txn_ref").alias("taken")).join(ids, "taken", "left").select("place", "reverses_id")
    linked = placed.join(legs, "place", "left").join(reversals, "place", "left")
    lone_leg = F.col("txn_type").isin("SWITCH_OUT", "STP_OUT") & F.col("switch_group_id").isNull()
    orphan = (F.col("txn_type") == "REVERSAL") & F.col("reverses_id").isNull()
    more = F.array_compact(F.array(F.when(lone_leg, "UNLINKED_SWITCH"), F.when(orphan, "ORPHAN_REVERSAL")))
    return linked.withColumn("flags", F.concat("flags", more)).drop("place")


def import_report(read: DataFrame, typed: DataFrame, known_ids: DataFrame) -> DataFrame:
    """Per statement: inserted, duplicate, unmatched, unparsed and status (``ok``, or ``partial`` when rows or lines are left over)."""
    # Rows of no type are counted beside the others, so that the rows are typed once.
    named = F.col("txn_type").isNotNull()
    rows = typed.select("user_id", "line_no", "txn_id", named.alias("named"))
    first = F.row_number().over(Window.partitionBy("txn_id", "named").orderBy("user_id", "line_no")) == 1
    told = rows.withColumn("first", first).join(known_ids.select("txn_id").distinct().withColumn("stored", F.lit(True)), "txn_id", "left").withColumn("new", F.col("first") & F.col("stored").isNull())
    counts = told.groupBy("user_id").agg(F.count_if(F.col("named") & F.col("new")).alias("inserted"), F.count_if(F.col("named") & ~F.col("new")).alias("duplicate"), F.count_if(~F.col("named")).alias("unmatched"))
    files = read.groupBy(F.col("file").alias("user_id")).agg(F.count_if(F.col("role") == "unparsed").alias("unparsed"))
    joined = files.join(counts, "user_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("inserted", "duplicate", "unmatched", "unparsed")}
    return joined.select("user_id", *(v.alias(k) for k, v in zero.items()), F.when((zero["unmatched"] > 0) | (zero["unparsed"] > 0), "partial").otherwise("ok").alias("status"))


def ledger_rows(new: DataFrame) -> DataFrame:
    """Rows as the lot book takes them (``lots.prepared``): reversed rows are named by id."""
    return new.select("user_id", "folio", "scheme_id", F.col("txn_id").alias("txn_ref"), "txn_date", "txn_seq", "txn_type", "units", "nav", "amount", "stamp_duty", "stt", "exit_load", F.col("reverses_id").alias("reverses_ref"), "switch_group_id")
