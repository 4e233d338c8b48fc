"""Disclosures of single funds that pages carry as JSON in a script element.

A page's holdings stay in one row until it is known whether the page can be read as a whole, so nothing is shuffled. Pages are refused
as wholes, and say why; what can be read but looks wrong is a warning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom.sources.parsers import embedded_json

# Where a page keeps a fund, sections by the nature of a holding, instruments that are cash or derivatives whatever their nature, the zone of dates, percent by which holdings may miss the stated total.
PAYLOAD = "$.props.pageProps.mfServerSideData"
SECTIONS = {"EQUITY": "EQUITY & EQUITY RELATED", "DEBT": "DEBT INSTRUMENTS", "CASH": "CASH & CASH EQUIVALENT", "REALEST": "REITS & INVITS", "MF": "MUTUAL FUND UNITS"}
CASH = r"(?i)^\s*(cblo|treps|tri[- ]?party\s+repo|(reverse\s+)?repo|net\s+(payable|receivable)s?|net\s+current\s+assets?|cash(\s+(&|and)\s+cash\s+equivalents?|\s+margin)?|margin(\s+money)?)\s*$"
DERIVATIVE = r"(?i)\b(deriv|future|option|swap|forward)"
ZONE, DRIFT_PCT = "Asia/Kolkata", 0.5
_EXACT = "decimal(28,6)"


def _said(r: Column, key: str) -> Column:
    """A field's text; null if it is absent, null or blank."""
    text = F.trim(F.try_element_at(r, F.lit(key)))
    return F.when(text != "", text)


def _exact(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast(_EXACT)


def _section(r: Column) -> Column:
    nature, instrument = F.upper(_said(r, "nature_name")), F.coalesce(_said(r, "instrument_name"), F.lit(""))
    known = F.element_at(F.create_map(*(F.lit(x) for kv in SECTIONS.items() for x in kv)), nature)
    return F.when(F.regexp_like(instrument, F.lit(DERIVATIVE)), "DERIVATIVES").when(F.regexp_like(instrument, F.lit(CASH)), SECTIONS["CASH"]).otherwise(F.coalesce(known, nature))


def _once(df: DataFrame) -> DataFrame:
    """``df`` with columns that are computed once a row: without this, filters and columns built on a parsed page each parse it again."""
    names = df.columns
    return df.select(F.explode(F.array(F.struct(*names))).alias("__row")).select(*(F.col("__row")[n].alias(n) for n in names))


def page_files(pages: DataFrame) -> DataFrame:
    """Per page (file_id, html): scheme_name, as_of, rows, stated and summed value, warnings, and the problem for which it is refused (null: none).

    All holdings of a page must state one instant, which is read as a day in the zone of the disclosures; without an offset it is taken in the session's zone.
    """
    found = _once(embedded_json(pages.select("file_id", "html")).withColumn("fund", F.get_json_object("json", PAYLOAD)).withColumn("json", F.col("json").isNotNull()).withColumn("listed", F.get_json_object("fund", "$.holdings")))
    listed = F.col("listed")
    rows = F.when(F.startswith(F.trim(listed), F.lit("[")), F.from_json(listed, "array<map<string,string>>"))
    read = found.select("file_id", "json", F.col("fund").isNotNull().alias("fund"), F.get_json_object("fund", "$.scheme_name").alias("scheme_name"), _exact(F.get_json_object("fund", "$.aum")).alias("stated"), rows.alias("rows"))
    read = _once(read)
    dates = F.array_sort(F.array_distinct(F.array_compact(F.transform("rows", lambda r: _said(r, "portfolio_date")))))
    natures = F.array_sort(F.array_distinct(F.filter(F.array_compact(F.transform("rows", lambda r: F.upper(_said(r, "nature_name")))), lambda n: ~n.isin(*SECTIONS))))
    summed = F.aggregate("rows", F.lit(0).cast(_EXACT), lambda s, r: (s + F.coalesce(_exact(_said(r, "market_value")), F.lit(0))).cast(_EXACT))
    nameless = F.array_position(F.transform("rows", lambda r: r.isNull() | _said(r, "company_name").isNull()), F.lit(True))
    read = _once(read.withColumn("dates", dates).withColumn("unknown", natures).withColumn("summed", summed).withColumn("bad", nameless))
    instant = F.try_to_timestamp(F.get("dates", F.lit(0)))
    day = F.convert_timezone(F.current_timezone(), F.lit(ZONE), instant.cast("timestamp_ntz")).cast("date")
    problem = (
        F.when(~F.col("json"), "no data in the page").when(~F.col("fund"), "no fund in the data").when(F.coalesce(F.size("rows"), F.lit(0)) <= 0, "no holdings")
        .when(F.col("bad") > 0, F.concat(F.lit("no name in holding "), F.col("bad").cast("string"))).when(F.size("dates") == 0, "no date on any holding")
        .when(F.size("dates") > 1, F.concat(F.lit("several dates: "), F.array_join("dates", ", "))).when(day.isNull(), F.concat(F.lit("unreadable date "), F.get("dates", F.lit(0))))
    )
    drift = (F.col("summed") - F.col("stated")).cast("double") / F.col("stated").cast("double") * 100.0
    unstated = F.col("stated").isNull() | (F.col("stated") == 0)
    warnings = F.array_compact(F.array(
        F.when(unstated, "no total stated"), F.when(~unstated & (F.abs(drift) > DRIFT_PCT), F.concat(F.lit("holdings off the stated total by "), F.format_string("%+.4f", drift), F.lit("%"))),
        F.when(F.size("unknown") > 0, F.concat(F.lit("natures without a section: "), F.array_join("unknown", ", "))),
    ))
    return read.withColumn("problem", problem).select("file_id", "scheme_name", F.when(F.col("problem").isNull(), day).alias("as_of"), "rows", "stated", "summed", F.when(F.col("problem").isNull(), warnings).alias("warnings"), "problem")


def page_holdings(pages: DataFrame) -> DataFrame:
    """Holdings of the pages that can be read, in crore as published: name, section, sector, rating, market_value, pct; n_rows is the page's number of them. They carry neither codes nor quantities."""
    rows = page_files(pages).filter("problem is null").select("file_id", "scheme_name", "as_of", F.size("rows").cast("long").alias("n_rows"), F.posexplode("rows").alias("at", "r"))
    r = F.col("r")
    return rows.select(
        "file_id", "scheme_name", "as_of", (F.col("at") + 1).alias("row_number"), _said(r, "company_name").alias("name"), _section(r).alias("section"), _said(r, "sector_name").alias("sector"), _said(r, "rating").alias("rating"),
        _exact(_said(r, "market_value")).alias("market_value"), _exact(_said(r, "corpus_per")).alias("pct"), "n_rows",
    )
