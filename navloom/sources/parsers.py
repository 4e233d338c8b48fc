"""Readers of published files: price text, statements, JSON payloads, pages, wide tables.

Text files come as (file, line_no, line): line numbers make carry-forward independent of partition order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navloom.functions.text import indian_number, is_valid_isin

#: Columns of a price file, by the words its header must hold. Several layouts have them in different places.
NAV_FIELDS = {"code": "scheme code", "isin_payout": "payout", "isin_reinvest": "reinvest", "name": "name", "nav": "net asset value", "date": "date"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of whole text files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def carried(condition: Column, value: Column, by: str = "file", order: str = "line_no") -> Column:
    """The value at the last line so far at which ``condition`` holds."""
    return F.last(F.when(condition, value), ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def parse_nav(lines: DataFrame) -> DataFrame:
    """Prices with house and category carried forward; a repeated header counts from where it stands.

    A row with two codes gives two schemes. Placeholders and malformed codes become null; dates and prices that can't
    be read are null too, and stay visible.
    """
    fields = F.transform(F.split("line", ";"), lambda c: F.trim(c))
    kind = (
        F.when(F.trim("line") == "", "blank").when(F.lower("line").startswith("scheme code"), "header").when(F.size(fields) >= 6, "row")
        .when(F.regexp_like("line", F.lit(r"(?i)mutual fund\s*$")), "house").otherwise("category")
    )
    marked = lines.withColumn("fields", fields).withColumn("kind", kind)
    header = carried(F.col("kind") == "header", F.transform("fields", lambda c: F.lower(c)))
    carried_rows = marked.withColumn("header", header).withColumn("house", carried(F.col("kind") == "house", F.trim("line"))).withColumn("category", carried(F.col("kind") == "category", F.trim("line"))).filter("kind = 'row'")

    def field(name: str) -> Column:
        needle = NAV_FIELDS[name]
        at = F.array_position(F.transform("header", lambda h: F.contains(h, F.lit(needle))), True)
        return F.when(at > 0, F.try_element_at("fields", at.cast("int")))

    isins = F.array_compact(F.array(*(F.when(is_valid_isin(field(n)), F.struct(F.lit(n).alias("variant"), F.upper(field(n)).alias("isin"))) for n in ("isin_payout", "isin_reinvest"))))
    rows = carried_rows.select(
        "file", "line_no", "house", "category", field("code").cast("string").alias("code"), field("name").alias("name"), field("nav").try_cast("decimal(18,6)").alias("nav"),
        F.try_to_timestamp(field("date"), F.lit("dd-MMM-yyyy")).cast("date").alias("nav_date"), isins.alias("isins"),
    )
    return rows.select("*", F.explode_outer("isins").alias("i")).select(*[c for c in rows.columns if c != "isins"], "i.variant", "i.isin")


def parse_statement(lines: DataFrame) -> DataFrame:
    """Transactions of a statement: folio and scheme carried forward, numbers taken from the right edge of a dated line.

    Four numbers are amount, units, price and balance; two are amount and balance. Lines after "Summary" don't count.
    """
    line = F.trim("line")
    folio = F.regexp_extract(line, r"(?i)^folio\s*(?:no\.?)?\s*:\s*([0-9]+(?:\s*/\s*[0-9]+)?)", 1)
    scheme = F.regexp_extract(line, r"(?i)^scheme\s*:\s*(.+)$", 1)
    dated = F.regexp_extract(line, r"^(\d{2}-[A-Za-z]{3}-\d{4})\s", 1)
    number = r"\(?-?[0-9][0-9,]*\.?[0-9]*\)?"
    tail = F.regexp_extract(line, rf"((?:\s+{number})+)$", 1)
    numbers = F.transform(F.regexp_extract_all(tail, F.lit(rf"({number})"), F.lit(1)), indian_number)
    closed = F.max(F.regexp_like(line, F.lit("(?i)^summary"))).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("folio", carried(folio != "", F.regexp_replace(folio, r"\s", ""))).withColumn("scheme", carried(scheme != "", scheme)).withColumn("numbers", numbers).withColumn("closed", closed)
    rows = rows.withColumn("dated", dated).withColumn("what", F.regexp_extract(line, rf"^\d{{2}}-[A-Za-z]{{3}}-\d{{4}}\s+(.*?)(?:\s+{number})*$", 1)).filter("dated <> '' and not closed")
    four, two = F.size("numbers") == 4, F.size("numbers") == 2
    at = lambda i: F.try_element_at("numbers", F.lit(i))
    return rows.select(
        "file", "line_no", "folio", "scheme", F.try_to_timestamp("dated", F.lit("dd-MMM-yyyy")).cast("date").alias("txn_date"), F.trim("what").alias("description"),
        F.when(four | two, at(1)).alias("amount"), F.when(four, at(2)).alias("units"), F.when(four, at(3)).alias("nav"), F.when(four, at(4)).when(two, at(2)).alias("balance"),
    )


def parse_price_json(payloads: DataFrame) -> DataFrame:
    """(code, nav_date, nav) from ``{"meta": .., "data": [{"date": "dd-MM-yyyy", "nav": ".."}]}``; bad or non-positive prices go, the first of a date stays."""
    schema = "meta struct<scheme_code: bigint>, data array<struct<date: string, nav: string>>"
    rows = payloads.select(F.from_json("payload", schema).alias("p")).select(F.col("p.meta.scheme_code").alias("code"), F.posexplode("p.data").alias("at", "d"))
    clean = rows.select("code", "at", F.try_to_timestamp("d.date", F.lit("dd-MM-yyyy")).cast("date").alias("nav_date"), F.col("d.nav").try_cast("decimal(18,6)").alias("nav")).filter("nav_date is not null and nav > 0")
    return clean.groupBy("code", "nav_date").agg(F.min_by("nav", "at").alias("nav"))


def wide_to_long(wide: DataFrame, keys: list[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """One row per key and column that has a value."""
    pairs = F.array(*(F.struct(F.lit(label).alias(name), F.col(c).alias(value)) for c, label in columns.items()))
    return wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, f"p.{name}", f"p.{value}").filter(F.col(value).isNotNull())


def embedded_json(pages: DataFrame, tag: str = "__NEXT_DATA__") -> DataFrame:
    """The JSON text of a script element with the given id, null where a page has none."""
    found = F.regexp_extract("html", rf'(?s)<script[^>]*\bid="{tag}"[^>]*>(.*?)</script>', 1)
    return pages.withColumn("json", F.when(found != "", found))


def page_facts(pages: DataFrame) -> DataFrame:
    """Title, number of links, and text length without tags and scripts."""
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    return pages.select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.regexp_count("html", F.lit(r"(?i)<a\s")).cast("long").alias("links"), F.char_length(F.trim(F.regexp_replace(body, r"\s+", " "))).cast("long").alias("text_chars"))


def quarter_end(label: Column) -> Column:
    """``April - June 2026`` to the last day of June 2026."""
    return F.last_day(F.try_to_timestamp(F.concat(F.lit("01 "), F.regexp_extract(label, r"-\s*(\w+\s+\d{4})", 1)), F.lit("dd MMMM yyyy")).cast("date"))
