"""Published lists: levels of total-return indices as JSON, and market values of listed companies as cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom.functions.text import is_valid_isin
from navloom.sources.sheets import cell_at, cleaned

# Fields of a level, what stands for no value, headings of a list of market values, wording of its buckets and their last ranks.
NAME, DAY, LEVEL, NET = "Index Name", "Date", "TotalReturnsIndex", "NTR_Value"
PLACEHOLDERS = ("", "-", "--", "na", "n.a.", "nil", "null")
HEADINGS = (("name", "company name"), ("isin", "isin"), ("nse", "nse symbol"), ("bse", "bse symbol"), ("mcap_bse", "bse 6 month"), ("mcap_nse", "nse 6 month"), ("mcap_msei", "msei 6 month"), ("stated", "categorization"))
STATED = {"large cap": "large", "mid cap": "mid", "small cap": "small"}
LARGE_LAST, MID_LAST = 100, 250
_EXACT = "decimal(28,6)"


def _absent(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*PLACEHOLDERS)


def _exact(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast(_EXACT)


def _listed_day(c: Column) -> Column:
    """``28 Mar 2024``, the month by its first three letters in any case; null for anything else."""
    parts = F.split(F.trim(c), r"\s+")
    text = F.concat(F.lpad(F.get(parts, F.lit(0)), 2, "0"), F.initcap(F.left(F.get(parts, F.lit(1)), F.lit(3))), F.get(parts, F.lit(2)))
    return F.when((F.size(parts) == 3) & F.regexp_like(c, F.lit(r"^\s*\d{1,2}\s+[A-Za-z]{3,}\s+\d{4}\s*$")), F.try_to_date(text, "ddMMMyyyy"))


def staged_levels(files: DataFrame) -> DataFrame:
    """(file_id, row_number, index_name, level_date, level, net_level, problem) of files (file_id, content), values as published.

    The rows are a list, a list under ``d``, or such a list as text, with or without a byte-order mark. A file without a list has
    one row, numbered 0, that says so; a row that lacks a field or can't be read says which. A net level may be missing.
    """
    text = F.trim(F.regexp_replace("content", "^\uFEFF", ""))
    wrapped = F.concat(F.lit('{"d":'), text, F.lit("}"))
    under = F.get_json_object(wrapped, "$.d.d")
    listed = F.when(F.startswith(text, F.lit("{")), under).otherwise(F.get_json_object(wrapped, "$.d"))
    rows = F.when(F.startswith(F.trim(listed), F.lit("[")), F.from_json(listed, "array<map<string,string>>"))
    # One empty row for a file that has no list, so that it is told and not lost.
    spread = files.select("file_id", F.coalesce(F.transform(rows, lambda r, i: F.struct((i + 1).alias("n"), r.alias("r"))), F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("map<string,string>").alias("r")))).alias("rows"))
    one = spread.select("file_id", F.explode("rows").alias("x")).select("file_id", F.col("x.n").alias("row_number"), "x.r")
    at = lambda k: F.try_element_at("r", F.lit(k))
    lacks = F.concat_ws(", ", *(F.when(~F.map_contains_key("r", k), F.lit(k)) for k in (NAME, DAY, LEVEL)))
    day, level, net = _listed_day(at(DAY)), _exact(at(LEVEL)), F.when(~_absent(at(NET)), _exact(at(NET)))
    problem = (
        F.when(F.col("row_number") == 0, "no list of rows").when(F.col("r").isNull(), "not an object").when(lacks != "", F.concat(F.lit("missing "), lacks))
        .when(day.isNull(), F.concat(F.lit("unreadable day "), F.coalesce(at(DAY), F.lit("null")))).when(level.isNull(), F.concat(F.lit("unreadable level "), F.coalesce(at(LEVEL), F.lit("null"))))
        .when(~_absent(at(NET)) & net.isNull(), F.concat(F.lit("unreadable net level "), at(NET)))
    )
    return one.select("file_id", "row_number", F.trim(at(NAME)).alias("index_name"), day.alias("level_date"), level.alias("level"), net.alias("net_level"), problem.alias("problem"))


def index_levels(files: DataFrame, strict: bool = True) -> DataFrame:
    """Levels of files that can be read as wholes. A series with a hole is worse than none: one bad row is an error, or leaves its file out if not ``strict``."""
    staged = staged_levels(files)
    if strict:
        bad = F.concat_ws(" ", F.lit("file"), F.col("file_id").cast("string"), F.lit("row"), F.col("row_number").cast("string"), F.col("problem"))
        return staged.filter(F.when(F.col("problem").isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True)).drop("problem")
    refused = staged.filter("problem is not null").select("file_id").distinct()
    return staged.join(refused, "file_id", "left_anti").drop("problem")


def basis_date(name: Column) -> Column:
    """The day to which a list applies, from its file's name (``..30Jun2026.xlsx``). A name without one is an error: a guessed day would apply a list to days it doesn't know."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d{2}[A-Za-z]{3}\d{4})"), F.lit(1))
    text = F.get(parts, F.lit(0))
    day = F.try_to_date(F.concat(F.left(text, F.lit(2)), F.initcap(F.substr(text, F.lit(3), F.lit(3))), F.right(text, F.lit(4))), "ddMMMyyyy")
    return F.coalesce(day, F.raise_error(F.concat(F.lit("no day in file name: "), F.coalesce(name, F.lit("null")))).cast("date"))


def _positions(cells: Column, headings: Sequence[tuple[str, str]]) -> Column:
    """struct of 0-based places of the first cell that contains each heading; null unless name, code and first market value are found."""
    lowered = F.transform(cells, F.lower)
    place = lambda needle: F.array_position(F.transform(lowered, lambda c: F.contains(c, F.lit(needle))), F.lit(True)).cast("int")
    found = F.struct(*(F.when(place(needle) > 0, place(needle) - 1).alias(field) for field, needle in headings))
    return F.when(found["name"].isNotNull() & found["isin"].isNotNull() & found["mcap_bse"].isNotNull(), found)


def market_values(cells: DataFrame) -> DataFrame:
    """Companies of lists (file_id, file_name, row_number, cells): basis_date, isin, company_name, market_cap, rank, bucket, stated_bucket, symbols, problem.

    The market value is the mean of the exchanges that quote the company. Ranks go by value, then code, within a list; a company without a
    value has neither rank nor bucket. A row without a valid code has no company and a problem, as has one whose stated bucket is not the computed one.
    A list is one sort key: some thousand companies.
    """
    rows = cleaned(cells).withColumn("found", _positions(F.col("cells"), HEADINGS))
    heads = rows.filter("found is not null").groupBy("file_id").agg(F.min(F.struct("row_number", "found")).alias("h")).select("file_id", F.col("h.row_number").alias("head"), "h.found")
    body = rows.drop("found").join(heads, "file_id").filter("row_number > head")
    at = lambda field: F.when(F.col(f"found.{field}").isNotNull(), cell_at(F.col("cells"), F.col(f"found.{field}")))
    body = body.withColumn("code", at("isin")).withColumn("company_name", at("name")).filter("code <> '' or company_name <> ''").withColumn("valid", is_valid_isin(F.col("code")))
    quotes = F.filter(F.array(*(_exact(at(f)) for f in ("mcap_bse", "mcap_nse", "mcap_msei"))), lambda v: v > 0)
    mean = F.when(F.size("quotes") > 0, (F.aggregate("quotes", F.lit(0).cast(_EXACT), lambda s, v: (s + v).cast(_EXACT)) / F.size("quotes")).cast(_EXACT))
    said = F.element_at(F.create_map(*(F.lit(x) for kv in STATED.items() for x in kv)), F.lower(F.trim(at("stated"))))
    body = body.withColumn("quotes", quotes).withColumn("market_cap", F.when(F.col("valid"), mean)).withColumn("isin", F.when(F.col("valid"), F.upper("code"))).withColumn("stated_bucket", F.when(F.col("valid"), said))
    ranked = F.col("market_cap").isNotNull()
    order = Window.partitionBy("file_id", ranked).orderBy(F.desc("market_cap"), "isin", "row_number")
    # A code that is listed twice has the later of its places.
    body = body.withColumn("place", F.when(ranked, F.row_number().over(order))).withColumn("rank", F.when(ranked, F.max("place").over(Window.partitionBy("file_id", "isin"))))
    bucket = F.when(F.col("rank") <= LARGE_LAST, "large").when(F.col("rank") <= MID_LAST, "mid").when(F.col("rank").isNotNull(), "small")
    blank = lambda c: F.when(F.trim(c) != "", c)
    problem = F.when(~F.col("valid"), F.concat(F.lit("not a valid ISIN: "), "code")).when(F.col("stated_bucket") != F.col("bucket"), F.concat(F.lit("stated "), "stated_bucket", F.lit(", by rank "), "bucket"))
    out = body.withColumn("bucket", bucket)
    return out.select("file_id", basis_date(F.col("file_name")).alias("basis_date"), "row_number", "isin", "company_name", "market_cap", "rank", "bucket", "stated_bucket", blank(at("nse")).alias("nse_symbol"), blank(at("bse")).alias("bse_symbol"), problem.alias("problem"))
