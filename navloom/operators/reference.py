"""Reference data: what a scheme is, belongs to, merged into and is measured by; which issuer an unresolved code stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom.functions.shown import borrower_name, is_informative, word_number
from navloom.functions.text import is_composite, issuer_segment, state_code
from navloom.operators.asof import latest_on_or_before
from navloom.sources.store import shared_folder, written

# How long after the newest file a scheme counts as live.
LIVE_WINDOW_DAYS = 30


def risk_free_on(asks: DataFrame, rates: DataFrame, on: str) -> DataFrame:
    """``asks`` with the rate of the newest observation (observed, rate) not after ``on``; null before the first one.

    Rates are looked up for days, of which there are as many as the calendar has, and joined to the asks by day.
    """
    days = asks.select(F.col(on).alias("__day")).distinct().withColumn("__all", F.lit(0))
    listed = rates.groupBy("observed").agg(F.max("rate").alias("risk_free")).withColumn("__all", F.lit(0))
    known = latest_on_or_before(days, listed, ["__all"], "__day", "observed", ["risk_free"])
    return asks.join(known.select(F.col("__day").alias(on), "risk_free"), on, "left").select(*asks.columns, "risk_free")


def newest(rows: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Per key the value of its newest date; on one date the greatest."""
    return rows.groupBy(key).agg(F.max(F.struct(date, value)).alias("x")).select(key, f"x.{date}", f"x.{value}")


def exact_level(asks: DataFrame, levels: DataFrame, date: str) -> DataFrame:
    """``asks`` with the total-return level of their index on the very date, null otherwise; nothing is carried forward."""
    on = levels.filter("is_total_return").select("index_id", F.col("level_date").alias(date), "level")
    return asks.join(on, ["index_id", date], "left")


def price_history(navs: DataFrame, benchmark: DataFrame, levels: DataFrame) -> DataFrame:
    """Each fund's prices with its benchmark's level of the same day; null where there is none."""
    indexed = navs.join(benchmark.select("scheme_id", F.col("benchmark_id").alias("index_id")), "scheme_id", "left")
    return exact_level(indexed, levels, "nav_date")


def sibling_plans(schemes: DataFrame) -> DataFrame:
    """Per scheme the one of the other plan with its name and option; null if there is none or more than one."""
    own = schemes.select("scheme_id", "scheme_name", "option", "plan")
    sets = own.groupBy("scheme_name", "option", "plan").agg(F.count(F.lit(1)).alias("n"), F.min("scheme_id").alias("sibling_id"))
    other = F.when(F.col("plan") == "direct", "regular").otherwise("direct")
    wanted = own.select("scheme_id", "scheme_name", "option", other.alias("plan"))
    return wanted.join(sets.filter("n = 1").drop("n"), ["scheme_name", "option", "plan"], "left").select("scheme_id", "sibling_id")


def resolve_schemes(asks: DataFrame, schemes: DataFrame) -> DataFrame:
    """``asks`` (ask_id, isin, code, name) with scheme_id and how it was found: by code of security, else by the published code, else by exact name.

    A code of security that is given decides alone. The other two count only where exactly one scheme has them.
    """
    by_isin = schemes.filter("isin is not null").groupBy("isin").agg(F.min("scheme_id").alias("by_isin"))
    single = lambda key, name: schemes.filter(key.isNotNull()).groupBy(key.alias(name)).agg(F.min("scheme_id").alias(f"by_{name}"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    joined = asks.withColumn("lower", F.lower(F.trim("name"))).join(by_isin, "isin", "left").join(single(F.col("code"), "code"), "code", "left").join(single(F.lower("scheme_name"), "lower"), "lower", "left")
    given = F.col("isin").isNotNull() & (F.col("isin") != "")
    how = F.when(given, F.when(F.col("by_isin").isNotNull(), "isin")).when(F.col("by_code").isNotNull(), "code").when(F.col("by_lower").isNotNull(), "name")
    found = F.when(given, F.col("by_isin")).otherwise(F.coalesce("by_code", "by_lower"))
    return joined.select("ask_id", found.alias("scheme_id"), F.coalesce(how, F.lit("unresolved")).alias("found_by"))


def merger_chains(schemes: DataFrame) -> DataFrame:
    """(scheme_id, step, predecessor, successor) along ``merged_into``; a chain ends where it would come back to a scheme on it.

    Ways are doubled: a scheme's first steps and those of the scheme where they end make twice as many, so a chain of any
    length takes as many rounds as its length has binary digits. Each round starts from a written table.
    """
    spark = schemes.sparkSession
    links = schemes.filter("merged_into is not null and merged_into <> scheme_id").select("scheme_id", F.lit(1).alias("step"), F.col("merged_into").alias("at"))
    ways, reach = written(links, shared_folder(spark, "ways")), 1
    while True:
        far = ways.filter(F.col("step") == reach)
        ahead = ways.select(F.col("scheme_id").alias("at"), F.col("step").alias("more"), F.col("at").alias("next"))
        longer = far.join(ahead, "at").select("scheme_id", (F.col("step") + F.col("more")).alias("step"), F.col("next").alias("at"))
        # A scheme met again closes a circle: its first meeting counts, and nothing beyond the last new one.
        met = ways.unionByName(longer).filter("at <> scheme_id").groupBy("scheme_id", "at").agg(F.min("step").alias("step"))
        grown = written(met.select("scheme_id", "step", "at"), shared_folder(spark, "ways"))
        if grown.filter(F.col("step") > reach).limit(1).count() == 0:
            break
        ways, reach = grown, 2 * reach
    before = grown.select("scheme_id", (F.col("step") + 1).alias("step"), F.col("at").alias("from"))
    steps = grown.withColumnRenamed("at", "successor").join(before, ["scheme_id", "step"], "left")
    return steps.select("scheme_id", "step", F.coalesce("from", "scheme_id").alias("predecessor"), "successor")


def declared_per_scheme(stated: DataFrame, known: DataFrame) -> DataFrame:
    """Per sheet (of texts with their ``key``): the one index that all its stated benchmarks name, and why if there is none."""
    joined = stated.join(known.select("key", "index_id"), "key", "left")
    kinds = joined.groupBy("sheet_id").agg(
        F.bool_or(is_composite(F.col("text"))).alias("composite"), F.bool_or(F.col("index_id").isNull()).alias("unknown"), F.min("index_id").alias("low"), F.max("index_id").alias("high")
    )
    reason = F.when(F.col("composite"), "composite").when(F.col("unknown"), "not a listed index").when(F.col("low") != F.col("high"), "states two indices").otherwise("declared")
    return kinds.select("sheet_id", F.when(reason == "declared", F.col("low")).alias("index_id"), reason.alias("reason"))


def newest_per_family(stated: DataFrame) -> DataFrame:
    """Per (amc_id, family): the benchmark that its newest disclosure states; null where two of that day differ."""
    last = Window.partitionBy("amc_id", "family")
    current = stated.withColumn("newest", F.max("as_of").over(last)).filter("as_of = newest")
    return current.groupBy("amc_id", "family").agg(F.when(F.countDistinct("index_id") == 1, F.min("index_id")).alias("index_id"), F.max("as_of").alias("as_of"))


def apply_declared(schemes: DataFrame, plan: DataFrame) -> DataFrame:
    """Every share class with its family's declared benchmark, and whether that was null, changed, unchanged or not declared."""
    joined = schemes.join(plan.filter("index_id is not null").select("amc_id", "family", F.col("index_id").alias("declared")), ["amc_id", "family"], "left")
    status = F.when(F.col("declared").isNull(), "not declared").when(F.col("benchmark_id").isNull(), "was null").when(F.col("benchmark_id") == F.col("declared"), "unchanged").otherwise("changed")
    return joined.select("scheme_id", F.coalesce("declared", "benchmark_id").alias("benchmark_id"), status.alias("status"))


def filled_benchmarks(schemes: DataFrame, inferred: DataFrame) -> DataFrame:
    """A benchmark read from a fund's name fills a null one and never replaces one."""
    return schemes.join(inferred.select("scheme_id", F.col("index_id").alias("inferred")), "scheme_id", "left").withColumn("benchmark_id", F.coalesce("benchmark_id", "inferred")).drop("inferred")


def trackers(declared: DataFrame, first_prices: DataFrame, is_index_fund: Column) -> DataFrame:
    """(benchmark key, place, scheme_id): index funds by the benchmark they declare, the longest price record first."""
    funds = declared.filter(is_index_fund).join(first_prices, "scheme_id")
    return funds.select("key", "scheme_id", F.row_number().over(Window.partitionBy("key").orderBy("first_date", "scheme_id")).alias("place"))


def proxies(declared: DataFrame, tracked: DataFrame) -> DataFrame:
    """Per fund: the first tracker of its benchmark that is not the fund itself."""
    first_two = tracked.filter("place <= 2").select("key", F.col("scheme_id").alias("proxy_id"), "place")
    met = declared.join(first_two, "key", "left").withColumn("proxy_id", F.when(F.col("proxy_id") != F.col("scheme_id"), F.col("proxy_id")))
    return met.groupBy("scheme_id").agg(F.min_by("proxy_id", F.when(F.col("proxy_id").isNotNull(), F.col("place"))).alias("proxy_id"))


def share_classes(schemes: DataFrame, days: int = LIVE_WINDOW_DAYS) -> DataFrame:
    """(family, plan, scheme_id) of live share classes, of families that belong to one house only."""
    last = F.broadcast(schemes.agg(F.max("last_seen").alias("newest")))
    live = schemes.filter("family is not null").crossJoin(last).filter(F.col("last_seen") >= F.date_sub("newest", days))
    family = Window.partitionBy("family")
    return live.withColumn("one", F.min("amc_id").over(family) == F.max("amc_id").over(family)).filter("one").select("family", "plan", "scheme_id")


def new_charges(figures: DataFrame, classes: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to append: each share class with its fund's figure of a day, where it is not what is stored, at the next revision."""
    held = stored.groupBy("scheme_id", "valid_from").agg(F.max("revision").alias("newest"), F.max_by("ter", "revision").alias("before"))
    spread = figures.join(classes, ["family", "plan"]).select("scheme_id", "valid_from", "ter")
    joined = spread.join(held, ["scheme_id", "valid_from"], "left").filter(~F.col("ter").eqNullSafe(F.col("before")))
    return joined.select("scheme_id", "valid_from", "ter", (F.coalesce("newest", F.lit(0)) + 1).alias("revision"))


def detect_house(sheets: DataFrame, names: DataFrame) -> DataFrame:
    """Per file: the house that more than half of its telling sheets name, else null, and the votes.

    ``sheets`` has file_id, sheet_id and line (normalised); ``names`` has name (of a house or family) and amc_id. A
    sheet that names two houses votes for neither. Lines and names meet on a name's rarest word.
    """
    word = F.explode(F.array_distinct(F.split("line", " ")))
    words = names.filter("name <> ''").select("name", "amc_id", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    often = words.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    rarest = words.join(often, "word").groupBy("name", "amc_id").agg(F.min_by("word", F.struct("often", "word")).alias("word"))
    hits = sheets.select("file_id", "sheet_id", "line", word.alias("word")).join(rarest, "word").filter(F.contains(F.concat(F.lit(" "), "line", F.lit(" ")), F.concat(F.lit(" "), "name", F.lit(" "))))
    votes = hits.groupBy("file_id", "sheet_id").agg(F.min("amc_id").alias("low"), F.max("amc_id").alias("high")).filter("low = high")
    tally = votes.groupBy("file_id", F.col("low").alias("amc_id")).agg(F.count(F.lit(1)).alias("votes"))
    best = tally.groupBy("file_id").agg(F.max(F.struct("votes", (-F.col("amc_id")).alias("less"))).alias("best"), F.sum("votes").alias("total"))
    return best.select("file_id", F.when(F.col("best.votes") * 2 > F.col("total"), -F.col("best.less")).alias("amc_id"), F.col("best.votes").alias("votes"), "total")


def disclosed_issuers(holdings: DataFrame) -> DataFrame:
    """Per segment of unresolved codes: an issuer of its own with the most telling disclosed name; null where no name tells anything.

    ``holdings`` has isin, raw_name. Most words first, then the longest name, then the last in order.
    """
    rows = holdings.filter((F.length("isin") == 12)).select(issuer_segment(F.col("isin")).alias("segment"), F.upper("isin").alias("isin"), "raw_name").filter("segment is not null")
    bare = borrower_name(F.col("raw_name"))
    best = F.max(F.when(is_informative(F.col("raw_name")), F.struct(word_number(bare).alias("words"), F.length(bare).alias("size"), bare.alias("name"))))
    found = rows.groupBy("segment").agg(best.alias("best"), F.countDistinct("isin").alias("instruments"))
    country = F.when(F.startswith(F.col("segment"), F.lit("IN")), "IN").otherwise(F.substring("segment", 1, 2))
    return found.select(F.concat(F.lit("DISC:"), "segment").alias("issuer_id"), F.col("best.name").alias("issuer_name"), country.alias("country"), "instruments")


def state_issuers(holdings: DataFrame, states: DataFrame) -> DataFrame:
    """Per state code seen: its issuer, and whether a row names another state, in which case none is made.

    ``states`` (code, state) is a list of fixed size.
    """
    rows = holdings.select(state_code(F.col("isin")).alias("code"), F.upper("isin").alias("isin"), F.lower("raw_name").alias("name")).filter("code is not null")
    listed = states.agg(F.collect_list(F.struct("code", F.lower("state").alias("state"))).alias("all"))
    other = F.exists("all", lambda s: (s["code"] != F.col("code")) & F.contains(F.col("name"), s["state"]))
    seen = rows.crossJoin(F.broadcast(listed)).groupBy("code").agg(F.bool_or(other).alias("conflict"), F.countDistinct("isin").alias("instruments"))
    return seen.join(F.broadcast(states), "code").select(F.concat(F.lit("STATE:IN"), "code").alias("issuer_id"), F.concat(F.lit("Government of "), "state").alias("issuer_name"), "conflict", "instruments")


def scheme_master(rows: DataFrame) -> DataFrame:
    """(isin, scheme_name, launched) from rows with ``codes``, a cell that may hold several; a code listed under two names is left out.

    ``place`` orders the rows; of rows with one name the last gives the date.
    """
    code = F.explode(F.regexp_extract_all("codes", F.lit("IN[A-Z0-9]{10}"), F.lit(0))).alias("isin")
    spread = rows.select(code, F.trim("scheme_name").alias("scheme_name"), "launched", "place")
    return spread.groupBy("isin").agg(F.min("scheme_name").alias("scheme_name"), F.max("scheme_name").alias("high"), F.max_by("launched", "place").alias("launched")).filter("scheme_name = high").drop("high")


def list_in_force(lists: DataFrame, on: Column) -> DataFrame:
    """All rows of the newest list that is not after ``on``."""
    last = lists.filter(F.col("list_date") <= on).agg(F.max("list_date").alias("list_date"))
    return lists.join(F.broadcast(last), "list_date")


def catalogue_update(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The index catalogue after registering ``new``: names and providers are replaced, the span of dates seen is never touched."""
    both = stored.join(new.select("index_id", F.col("name").alias("new_name")), "index_id", "full")
    return both.select("index_id", F.coalesce("new_name", "name").alias("name"), "first_seen", "last_seen")


def registered(catalogue: DataFrame, strict: bool = True) -> DataFrame:
    """Per key the one index registered under it. Two under one key are an error when read, or, without ``strict``, no answer."""
    found = catalogue.groupBy("key").agg(F.min("index_id").alias("index_id"), F.countDistinct("index_id").alias("n"))
    clash = F.raise_error(F.concat(F.lit("two indices under "), "key")).cast("string") if strict else F.lit(None).cast("string")
    return found.select("key", F.when(F.col("n") == 1, F.col("index_id")).otherwise(clash).alias("index_id"))


def scheme_facts(schemes: DataFrame, houses: DataFrame, benchmarks: DataFrame, sizes: DataFrame, ters: DataFrame, on: Column) -> DataFrame:
    """Per scheme: house, benchmark's name, newest size and the charge in force."""
    size = newest(sizes, "scheme_id", "as_of", "aum")
    rank = F.row_number().over(Window.partitionBy("scheme_id").orderBy(F.desc("valid_from"), F.desc("revision")))
    charge = ters.filter(F.col("valid_from") <= on).withColumn("rank", rank).filter("rank = 1").select("scheme_id", "ter")
    return schemes.join(F.broadcast(houses), "amc_id", "left").join(benchmarks, "benchmark_id", "left").join(size, "scheme_id", "left").join(charge, "scheme_id", "left").select(
        "scheme_id", "amc_name", "benchmark_name", "as_of", "aum", "ter"
    )


def rates_in_force(asks: DataFrame, ters: DataFrame, on: str) -> DataFrame:
    """``asks`` with the charge in force on their date; a charge counts from its first day."""
    last = ters.groupBy("scheme_id", "valid_from").agg(F.max_by("ter", "revision").alias("ter"))
    return latest_on_or_before(asks, last, ["scheme_id"], on, "valid_from", ["ter"])


def health(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(name, n_rows, newest) of each table by its date column."""
    out = None
    for name, (df, date) in tables.items():
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.max(date).cast("date").alias("newest"))
        out = row if out is None else out.union(row)
    return out
