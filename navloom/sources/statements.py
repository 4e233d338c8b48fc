"""A consolidated account statement's text as rows: transactions, the charges and balances printed with them, and every line that nothing accounts for.

Lines come as (file, line_no, line). What a line stands under (folio, scheme, summary) is carried along its file in
windows, so a statement is sorted once and no line is looked at twice. Numbers are taken from the right edge of a dated
line: four are amount, units, price and balance, two are amount and balance. With any other count the description ends in
numbers of its own, or columns are blank; then the balance decides: the last number is always the balance, and the columns
are those that lead to it from the balance printed before. A line that neither way explains is reported, not dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom.functions.text import indian_number
from navloom.operators.statement import CHARGES, charge_field

# How statements print folios, schemes, balances, summaries, dates, numbers and furniture.
FOLIO = r"(?i)^Folio\s+No[:.\s]+([\w\-]+(?:\s*/\s*[\w\-]+)*)"
SCHEME = r"(?i)^(.+?)\s*[-–]\s*ISIN[:\s]*(INF[A-Z0-9]{8}[0-9])\b"
OPENING, CLOSING = r"(?i)Opening\s+Unit\s+Balance[:\s]*([\d,.]+)", r"(?i)Closing\s+Unit\s+Balance[:\s]*([\d,.]+)"
SUMMARY = r"(?i)^(Portfolio\s+Summary|Summary\s+of|Total\s+Value|Grand\s+Total)"
FURNITURE = r"(?i)^(Page\s+\d+\s+of\s+\d+|CONSOLIDATED\s+ACCOUNT\s+STATEMENT|Date\s+Transaction\s+|Registrar\s*[:\s]|[-=_*\s]+)$"
DATED = r"^(\d{2}-[A-Za-z]{3}-\d{4})\s+(.*\S)$"
DATE_LENGTH = 11
MAY_CHARGE = r"(?i)\*|securities|cdsc|deducted"
NUMBER = r"\(?-?[\d,]*\d(?:\.\d+)?\)?"


def _got(line: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def _along(value: Column, upto: int = 0) -> Column:
    """The last value that is not null, in a file's lines up to this one (or the one before)."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, upto))


def printed_date(text: Column) -> Column:
    """``04-NOV-2024`` in any case of letters; null for a day that does not exist. Months are English whatever the session speaks."""
    months = F.lit("janfebmaraprmayjunjulaugsepoctnovdec")
    at = F.position(F.lower(F.substring(text, 4, 3)), months)
    return F.when((at > 0) & (at % 3 == 1), F.try_to_date(F.concat(F.substring(text, 8, 4), F.lit("-"), F.lpad(((at + 2) / 3).cast("int").cast("string"), 2, "0"), F.lit("-"), F.substring(text, 1, 2)), "yyyy-MM-dd"))


def read_statement(lines: DataFrame) -> DataFrame:
    """Every line with its role: transaction, charge, opening, closing, unparsed or none; and what was read from it.

    file, line_no, line, role, folio, scheme_name, isin, txn_date, description, amount, units, nav, balance, solved, charge, owner (the line_no of
    the transaction that a charge belongs to).
    """
    text = F.trim("line")
    line, capitals = F.col("line"), F.upper("line")
    # What a line says by itself is found once, patterns that scan it only where a plain word shows that they can hold.
    holds = lambda word, found: F.when(F.contains(capitals, F.lit(word)), found)
    rows = lines.withColumn("line", text).filter("line <> ''").withColumns({
        "summary": F.regexp_like(line, F.lit(SUMMARY)), "folio": _got(line, FOLIO), "said_name": holds("ISIN", _got(line, SCHEME, 1)), "said_isin": holds("ISIN", _got(line, SCHEME, 2)),
        "closing": holds("BALANCE", _got(line, CLOSING)), "opening": holds("BALANCE", _got(line, OPENING)), "charge": F.when(F.regexp_like(line, F.lit(MAY_CHARGE)), charge_field(line)), "rest": _got(line, DATED, 2),
    })
    summary, folio = F.col("summary"), F.col("folio")
    head = F.when(summary, None).when(folio.isNotNull(), F.struct(F.regexp_replace(folio, r"\s+", "").alias("folio"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("isin")))
    rows = rows.withColumn("head", head).withColumns({"zone": _along(F.when(summary, "summary").when(folio.isNotNull(), "folio")), "under": _along(F.col("head"))})
    is_scheme = (F.col("zone").eqNullSafe("folio")) & F.col("said_isin").isNotNull() & folio.isNull()
    block = F.when(is_scheme, F.struct(F.col("under.folio").alias("folio"), F.trim("said_name").alias("name"), F.upper("said_isin").alias("isin")))
    rows = rows.withColumn("under", _along(F.coalesce("head", block)))
    inside = (F.col("zone") == "folio") & F.col("under.isin").isNotNull() & ~is_scheme & folio.isNull()

    closing, opening, charge, rest = (F.col(c) for c in ("closing", "opening", "charge", "rest"))
    body = F.coalesce(rest, F.when(charge.isNotNull(), line), F.lit(""))
    rows = rows.withColumn("body", body).withColumn("tail", F.when(F.col("body") != "", F.regexp_extract("body", rf"((?:(?:^|\s+){NUMBER})*)$", 1)).otherwise(""))
    numbers = F.transform(F.filter(F.split("tail", r"\s+"), lambda t: t != ""), indian_number)
    role = (
        F.when(~inside, None).when(closing.isNotNull(), "closing").when(opening.isNotNull(), "opening").when(charge.isNotNull() & (F.size("numbers") == 1), "charge")
        .when(F.regexp_like(line, F.lit(FURNITURE)), None).when(rest.isNotNull() & charge.isNull(), "dated").otherwise("unparsed")
    )
    rows = rows.withColumn("numbers", numbers).withColumn("role", role)
    # The balance before: of the line above in the same block, whose last number it is.
    last = F.when(F.col("role") == "dated", F.try_element_at("numbers", F.lit(-1))).when(F.col("role") == "opening", indian_number(F.regexp_replace(opening, r"\.$", "")))
    rows = rows.withColumn("known", _along(F.when(last.isNotNull(), F.struct("under", last.alias("balance"))), -1))
    before = F.when(F.col("known.under") == F.col("under"), F.col("known.balance"))
    size, at = F.size("numbers"), lambda i: F.try_element_at("numbers", F.lit(i))
    solved_four = (size > 4) & (before + at(-3) == at(-1))
    solved_two = (size > 2) & (size != 4) & (before == at(-1))
    width = F.when(size.isin(2, 4), size).when(solved_four, 4).when(solved_two, 2)
    day = F.when(rest.isNotNull(), printed_date(F.left(line, F.lit(DATE_LENGTH))))
    # Numbers that belong to the description stay with it.
    tokens = F.split("body", r"\s+")
    said = F.array_join(F.slice(tokens, 1, F.greatest(F.size(tokens) - F.coalesce(F.col("width"), F.lit(0)), F.lit(0))), " ")
    rows = rows.withColumn("width", width).withColumn("description", said).withColumn("txn_date", day)
    reads = (F.col("role") == "dated") & F.col("width").isNotNull() & (F.col("description") != "") & F.col("txn_date").isNotNull()
    rows = rows.withColumn("role", F.when(reads, "transaction").when(F.col("role") == "dated", "unparsed").otherwise(F.col("role")))
    is_txn, four = F.col("role") == "transaction", F.col("width") == 4
    rows = rows.withColumn("owner", F.when(F.col("role") == "charge", _along(F.when(is_txn, F.col("line_no")))))
    rows = rows.withColumn("role", F.when((F.col("role") == "charge") & F.col("owner").isNull(), "unparsed").otherwise(F.col("role")))
    when = lambda c, v: F.when(c, v)
    return rows.select(
        "file", "line_no", "line", "role", F.col("under.folio").alias("folio"), F.col("under.name").alias("scheme_name"), F.col("under.isin").alias("isin"),
        when(is_txn, F.col("txn_date")).alias("txn_date"), when(is_txn, F.col("description")).alias("description"),
        when(is_txn, F.when(four, at(-4)).otherwise(at(-2))).when(F.col("role") == "charge", F.abs(at(-1))).alias("amount"), when(is_txn & four, at(-3)).alias("units"), when(is_txn & four, at(-2)).alias("nav"),
        when(is_txn, at(-1)).when(F.col("role").isin("opening", "closing"), indian_number(F.regexp_replace(F.coalesce(closing, opening), r"\.$", ""))).alias("balance"),
        when(is_txn, ~size.isin(2, 4)).alias("solved"), when(F.col("role") == "charge", charge).alias("charge"), "owner",
    )


def transactions(read: DataFrame) -> DataFrame:
    """Transactions with the charges printed below them, one column each. A charge meets its transaction where the file lies, so a file is read once."""
    own = Window.partitionBy("file", "of")
    rows = read.filter("role in ('transaction', 'charge')").withColumn("of", F.when(F.col("role") == "charge", F.col("owner")).otherwise(F.col("line_no")))
    sums = {c: F.sum(F.when(F.col("charge") == c, F.col("amount")).otherwise(0)).over(own).cast("decimal(24,4)") for c in CHARGES}
    return rows.withColumns(sums).filter("role = 'transaction'").drop("role", "charge", "owner", "line", "of")
