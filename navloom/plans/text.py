"""Names, codes, resolution, validation, merging, parsing and streaming: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navloom.functions import text as T
from navloom.operators import merge, resolve, series, validate
from navloom.plans.base import Catalogue, rounded
from navloom.sources import parsers
from navloom.sources.analogue import prelude, view
from navloom.streaming.activity import activity

C = Catalogue()

# ---- functions -------------------------------------------------------------

_ISIN = """c AS (SELECT p_partkey AS id, 'INE' || lpad(CAST(p_partkey % 97 AS VARCHAR), 3, '0') || chr(CAST(65 + p_partkey % 26 AS INT)) || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || CAST(p_partkey % 10 AS VARCHAR) AS isin FROM part)"""


def _codes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    body = F.concat(F.lit("INE"), F.lpad((key % 97).cast("string"), 3, "0"), F.chr((65 + key % 26).cast("int")), F.lpad((key % 10000).cast("string"), 4, "0"), (key % 10).cast("string"))
    return view(spark, d, "part").select(key.alias("id"), body.alias("isin"))


@C.query("WITH " + _ISIN + """, s AS (SELECT id, isin, array_to_string(list_transform(string_split(isin[1:11], ''), lambda ch: CASE WHEN ch BETWEEN '0' AND '9' THEN ch ELSE CAST(ascii(ch) - 55 AS VARCHAR) END), '') AS w FROM c),
v AS (SELECT *, list_sum(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(w[len(w) - i + 1] AS INT) * 2 > 9 THEN CAST(w[len(w) - i + 1] AS INT) * 2 - 9 ELSE CAST(w[len(w) - i + 1] AS INT) * 2 END ELSE CAST(w[len(w) - i + 1] AS INT) END)) AS t FROM s)
SELECT id, isin, (10 - t % 10) % 10 = CAST(isin[12] AS INT) AS valid, isin[1:7] AS segment FROM v""")  # fmt: skip
def isin_validate(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d).select("id", "isin", T.is_valid_isin(F.col("isin")).alias("valid"), T.issuer_segment(F.col("isin")).alias("segment"))


@C.query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9_\s]', ' ', 'g'), '\b(?:ltd|limited|pvt|private|plc|inc|corp|corporation|co|company|the|and)\b', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM benchmark""")
def normalise_name(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "benchmark").select("item_id", T.normalise_name(F.col("text")).alias("name"))


_SCHEME = "fund_name AS (SELECT s_suppkey AS id, s_name || CASE s_suppkey % 5 WHEN 0 THEN ' Flexi Cap Fund - Direct Plan - Growth Option' WHEN 1 THEN ' Growth Fund (Regular Plan) - IDCW Reinvestment' WHEN 2 THEN ' Nifty 50 Index TRI' WHEN 3 THEN ' Mutual Fund' ELSE ' Income Fund - Payout' END AS name FROM supplier)"


def _names(spark: SparkSession, d: str) -> DataFrame:
    tails = F.array(*(F.lit(x) for x in (" Flexi Cap Fund - Direct Plan - Growth Option", " Growth Fund (Regular Plan) - IDCW Reinvestment", " Nifty 50 Index TRI", " Mutual Fund", " Income Fund - Payout")))
    return view(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.element_at(tails, (F.col("s_suppkey") % 5 + 1).cast("int"))).alias("name"))


_WORDS = ", ".join(f"'{w}'" for w in T.SHARE_CLASS_WORDS)


@C.query("WITH " + _SCHEME + rf""", p AS (SELECT id, list_filter(regexp_split_to_array(trim(regexp_replace(name, '\s+', ' ', 'g')), '\s*[-–—]\s*|\s*\(\s*|\s*\)\s*'), lambda x: x <> '') AS parts FROM fund_name),
k AS (SELECT id, list_filter(parts, lambda x: NOT (len(list_filter(regexp_split_to_array(lower(x), '[^a-z0-9]+'), lambda w: w <> '')) > 0 AND len(list_filter(regexp_split_to_array(lower(x), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains([{_WORDS}], w))) = 0)) AS kept FROM p)
SELECT id, trim(regexp_replace(lower(array_to_string(kept, ' ')), '[^a-z0-9]+', ' ', 'g')) AS family FROM k""")  # fmt: skip
def family_key(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("id", T.family_key(F.col("name")).alias("family"))


@C.query("WITH " + _SCHEME + r""" SELECT id, regexp_replace(regexp_replace(trim(regexp_replace(upper(replace(lower(name), ' tri', ' ')), '[^A-Z0-9]+', ' ', 'g')), '( INDEX)+$', ''), '[^A-Z0-9]', '', 'g') AS key,
CASE WHEN trim(regexp_replace(regexp_replace(lower(name), '\bmutual\s+fund\b', '', 'g'), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'unknown' ELSE trim(regexp_replace(regexp_replace(lower(name), '\bmutual\s+fund\b', '', 'g'), '[^a-z0-9]+', '_', 'g'), '_') END AS amc,
CASE WHEN name ILIKE '%direct%' THEN 'direct' WHEN name ILIKE '%regular%' THEN 'regular' ELSE 'unknown' END AS plan,
CASE WHEN name ILIKE '%reinvest%' THEN 'reinvest' WHEN name ILIKE '%growth%' THEN 'growth' WHEN name ILIKE '%payout%' OR name ILIKE '%idcw%' OR name ILIKE '%dividend%' THEN 'payout' ELSE 'unknown' END AS option FROM fund_name""")  # fmt: skip
def index_key_and_plan(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    return _names(spark, d).select("id", T.index_key(name).alias("key"), T.amc_id(name).alias("amc"), T.plan_of(name).alias("plan"), T.option_of(name).alias("option"))


_HEADERS = ("Market Value (Rs. in Lakhs)", "Value Rs in Cr.", "Amount (000s)", "Market Value (Rs.)", "Value in Million", "Quantity")


@C.query("WITH h AS (SELECT p_partkey AS id, [" + ", ".join(f"'{h}'" for h in _HEADERS) + """][p_partkey % 6 + 1] AS header, p_retailprice AS v FROM part)
SELECT id, CASE id % 6 WHEN 0 THEN 'lakh' WHEN 1 THEN 'crore' WHEN 2 THEN 'thousand' WHEN 3 THEN 'absolute' END AS unit, ROUND(v * CASE id % 6 WHEN 0 THEN 100000 WHEN 1 THEN 10000000 WHEN 2 THEN 1000 WHEN 3 THEN 1 END, 2) AS inr FROM h""")  # fmt: skip
def unit_scale(spark: SparkSession, d: str) -> DataFrame:
    headers = F.array(*(F.lit(h) for h in _HEADERS))
    rows = view(spark, d, "part").select(F.col("p_partkey").alias("id"), F.element_at(headers, (F.col("p_partkey") % 6 + 1).cast("int")).alias("header"), F.col("p_retailprice").alias("v"))
    unit = T.unit_of(F.col("header"), strict=False)
    return rows.select("id", unit.alias("unit"), F.round(T.to_inr(F.col("v"), unit), 2).alias("inr"))


@C.query("""WITH x AS (SELECT o_orderkey AS id, CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,4)) * 100, 2) AS DECIMAL(18,2)) * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS v FROM orders),
s AS (SELECT id, v, string_split(CAST(ABS(v) AS VARCHAR), '.')[1] AS w, string_split(CAST(ABS(v) AS VARCHAR), '.')[2] AS f FROM x)
SELECT id, CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN len(w) <= 3 THEN w ELSE reverse(regexp_replace(reverse(w[1:len(w) - 3]), '(\\d{2})', '\\1,', 'g')) || ',' || right(w, 3) END || '.' || f AS grouped, CAST(v AS DOUBLE) AS parsed FROM s""".replace("\\\\", "\\").replace("reverse(regexp_replace(reverse(w[1:len(w) - 3]), '(\\d{2})', '\\1,', 'g'))", "ltrim(reverse(regexp_replace(reverse(w[1:len(w) - 3]), '(\\d{2})', '\\1,', 'g')), ',')"))  # fmt: skip
def indian_numbers(spark: SparkSession, d: str) -> DataFrame:
    value = F.round(F.col("o_totalprice").cast("decimal(18,4)") * 100, 2).cast("decimal(18,2)") * F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1)
    rows = view(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.group_indian(value).alias("grouped"))
    return rows.withColumn("parsed", T.indian_number(F.col("grouped")).cast("double"))


@C.query("""SELECT o_orderkey AS id, CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') ELSE (year(o_orderdate) - 1) || '-' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') END AS fy,
day(o_orderdate) = 15 OR CAST(o_orderdate AS DATE) = last_day(o_orderdate) AS period_end, CASE WHEN o_orderkey % 100 BETWEEN 11 AND 13 THEN o_orderkey || 'th' WHEN o_orderkey % 10 = 1 THEN o_orderkey || 'st' WHEN o_orderkey % 10 = 2 THEN o_orderkey || 'nd' WHEN o_orderkey % 10 = 3 THEN o_orderkey || 'rd' ELSE o_orderkey || 'th' END AS ordinal FROM orders""")  # fmt: skip
def dates_and_ordinals(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return view(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.financial_year(day).alias("fy"), T.is_period_end(day).alias("period_end"), T.ordinal(F.col("o_orderkey")).alias("ordinal"))


@C.query("WITH " + _SCHEME + r""" SELECT a.id AS id_a, b.id AS id_b, ROUND(len(list_intersect(string_split(lower(a.name), ' '), string_split(lower(b.name), ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(lower(a.name), ' '), string_split(lower(b.name), ' ')))), 9) AS jaccard FROM fund_name a JOIN fund_name b ON b.id = a.id + 1""")
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    names = _names(spark, d)
    other = names.select((F.col("id") - 1).alias("id_a"), F.col("id").alias("id_b"), F.col("name").alias("other"))
    return names.withColumnRenamed("id", "id_a").join(other, "id_a").select("id_a", "id_b", F.round(T.token_jaccard(F.lower("name"), F.lower("other")), 9).alias("jaccard"))


# ---- resolution ------------------------------------------------------------

_SECTIONS = ("Equity & Equity related", "Government Securities", "Index Futures", "TREPS", "Certificate of Deposit", "Units of Mutual Fund", "Somewhere")


@C.query("""WITH r AS (SELECT p_partkey AS id, p_partkey % 7 AS s, p_partkey % 3 AS i FROM part) SELECT id, CASE WHEN i = 1 AND s <> 2 THEN 'cash' WHEN i = 2 THEN 'derivative' WHEN s = 0 THEN 'equity' WHEN s = 1 THEN 'debt' WHEN s = 2 THEN 'derivative' WHEN s = 3 THEN 'cash' WHEN s = 4 THEN 'debt' WHEN s = 5 THEN 'mfunit' ELSE 'equity' END AS instrument_class FROM r""")
def instrument_class(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    section = F.element_at(F.array(*(F.lit(s) for s in _SECTIONS)), (key % 7 + 1).cast("int"))
    issuer = F.element_at(F.array(F.lit("X1"), F.lit("__TREPS__"), F.lit("__DERIV__")), (key % 3 + 1).cast("int"))
    return view(spark, d, "part").select(key.alias("id"), T.instrument_class(section, issuer).alias("instrument_class"))


def _raw_rows(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("id")
    codes = _codes(spark, d)
    digit = T.isin_check_digit(F.left("isin", F.lit(11))).cast("string")
    isin = F.when(key % 4 == 0, F.concat(F.left("isin", F.lit(11)), digit)).when(key % 4 == 1, "IN0020240011").when(key % 4 == 2, "junk")
    name = F.when(key % 5 == 0, "TREPS 31-Dec").when(key % 5 == 1, "Net Receivables / (Payables)").when(key % 5 == 2, F.concat(F.lit("Part "), key.cast("string"), F.lit(" Limited"))).otherwise("Nowhere Plc")
    return codes.select(F.col("id").alias("row_id"), name.alias("raw_name"), isin.alias("raw_isin"), F.lit("equity").alias("kind"))


@C.query("""WITH r AS (SELECT p_partkey AS row_id, p_partkey % 4 AS i, p_partkey % 5 AS n FROM part), m AS (SELECT row_id, i, n, CASE WHEN i = 0 THEN 'isin' WHEN i = 1 OR n IN (0, 1) THEN 'synthetic' WHEN n = 2 AND row_id % 2 = 0 THEN 'alias' ELSE 'unresolved' END AS method FROM r)
SELECT row_id, method, CASE method WHEN 'isin' THEN 'P' || row_id WHEN 'synthetic' THEN CASE WHEN i = 1 THEN '__GSEC__' WHEN n = 0 THEN '__TREPS__' ELSE '__RECV__' END WHEN 'alias' THEN 'A' || row_id ELSE '__UNRESOLVED__' END AS issuer_id FROM m""")  # fmt: skip
def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    codes = _codes(spark, d)
    instruments = codes.select(F.concat(F.left("isin", F.lit(11)), T.isin_check_digit(F.left("isin", F.lit(11))).cast("string")).alias("isin"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("issuer_id"), "id").filter("id % 4 = 0")
    # Codes repeat only if parts do: each body holds the part's number.
    aliases = codes.filter("id % 2 = 0").select(F.concat(F.lit("Part "), F.col("id").cast("string")).alias("alias"), F.concat(F.lit("A"), F.col("id").cast("string")).alias("issuer_id"))
    issuers = aliases.select("issuer_id", F.col("alias").alias("issuer_name"))
    return resolve.resolve(_raw_rows(spark, d), instruments.select("isin", "issuer_id"), aliases, issuers).select("row_id", "method", "issuer_id")


@C.query("""WITH t AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS body FROM benchmark), l AS (SELECT item_id, body, string_split(body, ' ') AS ws FROM t),
k AS (SELECT DISTINCT key FROM (SELECT unnest(ws) AS key FROM l UNION ALL SELECT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM l) WHERE key <> ''),
h AS (SELECT item_id, k.key, len(k.key) AS n FROM t JOIN k ON contains(' ' || body || ' ', ' ' || k.key || ' ')), b AS (SELECT item_id, MAX(n) AS n FROM h GROUP BY 1),
g AS (SELECT h.item_id, CASE WHEN COUNT(DISTINCT key) = 1 THEN MIN(key) END AS key FROM h JOIN b ON h.item_id = b.item_id AND h.n = b.n GROUP BY 1)
SELECT t.item_id, CASE WHEN regexp_matches(body, '\\bplus\\b') AND NOT regexp_matches(body, '\\bplus\\s*aaa') THEN NULL ELSE g.key END AS key FROM t LEFT JOIN g USING (item_id)""")  # fmt: skip
def benchmark_match_longest(spark: SparkSession, d: str) -> DataFrame:
    texts = view(spark, d, "benchmark").select("item_id", F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")).alias("body"))
    # Keys of every length: single words and runs of two.
    words = F.split("body", " ")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 2), " "))
    keys = texts.select(F.explode(F.concat(words, runs)).alias("key")).distinct().filter("key <> ''")
    return resolve.longest_contained(texts, keys, "body", "key").select("item_id", "key")


@C.query(prelude("fund") + " SELECT scheme_id, amc_id, category FROM (SELECT *, COUNT(*) OVER (PARTITION BY amc_id) AS n FROM fund) WHERE n = 1 OR amc_id IN (SELECT amc_id FROM fund GROUP BY amc_id HAVING COUNT(DISTINCT scheme_id) = 1)")
def contested_refusal(spark: SparkSession, d: str) -> DataFrame:
    return resolve.refuse_contested(view(spark, d, "fund").select("scheme_id", "amc_id", "category"), "amc_id", "scheme_id")


@C.query(prelude("fund") + """, x AS (SELECT *, 'fam ' || scheme_id % 3 AS k FROM fund), g AS (SELECT k, amc_id % 7 AS house, COUNT(DISTINCT category) AS c, COUNT(*) AS m FROM x GROUP BY 1, 2)
SELECT x.scheme_id, x.amc_id % 7 AS amc_id, CASE WHEN c = 1 THEN x.k END AS family, m AS members FROM x JOIN g ON x.k = g.k AND x.amc_id % 7 = g.house""")  # fmt: skip
def scheme_families(spark: SparkSession, d: str) -> DataFrame:
    funds = view(spark, d, "fund").withColumn("amc_id", F.col("amc_id") % 7)
    return resolve.families(funds, F.concat(F.lit("fam "), (F.col("scheme_id") % 3).cast("string")))


@C.query()
def fuzzy_best_matches(spark: SparkSession, d: str) -> DataFrame:
    texts = view(spark, d, "benchmark")
    return resolve.best_matches(texts.select(F.col("item_id").alias("name_id"), F.col("text").alias("name")), texts.select(F.col("item_id").alias("issuer_id"), F.col("text").alias("issuer_name")))


@C.query("""WITH c AS (SELECT p_partkey AS id, p_name AS n, lower(p_name) AS l FROM part) SELECT id, n AS name FROM c WHERE l LIKE '%r%' AND l LIKE '%e%' ORDER BY l LIKE 'r%' DESC, len(n), n, id LIMIT 20""")
def search_schemes(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("p_name")
    hits = view(spark, d, "part").filter(F.contains(low, F.lit("r")) & F.contains(low, F.lit("e")))
    return hits.orderBy(F.desc(F.startswith(low, F.lit("r"))), F.char_length("p_name"), "p_name", "p_partkey").limit(20).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


# ---- validation and merging ------------------------------------------------

_VALID = """WITH r AS (SELECT l_suppkey AS scheme_id, last_day(CAST(l_shipdate AS DATE)) AS as_of, CASE WHEN l_partkey % 50 = 0 THEN '__UNRESOLVED__' ELSE CAST(l_partkey AS VARCHAR) END AS issuer_id, CAST(l_partkey AS VARCHAR) AS isin, l_partkey % 40 <> 0 AS ok,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS mv, CASE WHEN l_partkey % 60 = 0 THEN -1 ELSE 1 END AS sg FROM lineitem),
t AS (SELECT *, SUM(mv) OVER (PARTITION BY scheme_id, as_of) AS total FROM r),
f AS (SELECT scheme_id, as_of, SUM(CAST(mv AS DOUBLE) / CAST(total AS DOUBLE) * 1e2) AS pct, CAST(SUM(mv * sg) AS DOUBLE) AS mv, CAST(MAX(total) AS DOUBLE) AS aum, SUM(CASE WHEN issuer_id = '__UNRESOLVED__' THEN CAST(mv AS DOUBLE) / CAST(total AS DOUBLE) * 1e2 ELSE 0 END) AS un,
  COUNT(DISTINCT isin) < COUNT(isin) AS rep, COUNT(CASE WHEN mv * sg < 0 THEN 1 END) AS neg, COUNT(CASE WHEN NOT ok THEN 1 END) AS bad FROM t GROUP BY 1, 2),
k AS (SELECT scheme_id, as_of, unnest([{'c': 'V1', 'p': pct BETWEEN 95 AND 105, 'b': TRUE}, {'c': 'V2', 'p': ABS(mv - aum) / aum * 100 <= 3, 'b': TRUE}, {'c': 'V3', 'p': un < 2, 'b': FALSE}, {'c': 'V7', 'p': NOT rep, 'b': FALSE}, {'c': 'V8', 'p': neg = 0, 'b': FALSE}, {'c': 'V10', 'p': bad = 0, 'b': FALSE}, {'c': 'V11', 'p': as_of <= DATE '2000-01-01', 'b': TRUE}]) AS x FROM f)
"""  # fmt: skip


def _checks(spark: SparkSession, d: str) -> DataFrame:
    line = view(spark, d, "lineitem").select(F.col("l_suppkey").alias("scheme_id"), F.last_day(F.col("l_shipdate").cast("date")).alias("as_of"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").cast("decimal(18,2)").alias("mv"))
    total = F.sum("mv").over(Window.partitionBy("scheme_id", "as_of"))
    rows = line.select(
        "scheme_id", "as_of", F.when(F.col("part") % 50 == 0, "__UNRESOLVED__").otherwise(F.col("part").cast("string")).alias("issuer_id"), F.col("part").cast("string").alias("isin"), (F.col("part") % 40 != 0).alias("isin_ok"),
        (F.col("mv") * F.when(F.col("part") % 60 == 0, -1).otherwise(1)).cast("double").alias("mv"), (F.col("mv").cast("double") / total.cast("double") * 100.0).alias("pct"), F.lit("equity").alias("instrument_class"),
    )
    witnesses = line.groupBy("scheme_id", "as_of").agg(F.sum("mv").cast("double").alias("aum"), F.lit("point").alias("basis"))
    return validate.validate(rows, witnesses, F.lit("2000-01-01").cast("date"))


@C.query(prelude("disclosure") + " SELECT DISTINCT scheme_id, as_of, unnest(['V4', 'V5', 'V6', 'V9', 'V12', 'V13', 'V14']) AS \"check\", NULL::BOOLEAN AS passed, FALSE AS blocking FROM (SELECT DISTINCT scheme_id, as_of FROM disclosure)")
def checks_not_run(spark: SparkSession, d: str) -> DataFrame:
    return validate.not_evaluated(view(spark, d, "disclosure").select("scheme_id", "as_of").distinct())


@C.query(_VALID + 'SELECT scheme_id, as_of, x.c AS "check", x.p AS passed, x.b AS blocking FROM k')
def validation_checks(spark: SparkSession, d: str) -> DataFrame:
    # A witness of one moment blocks; so does an impossible ratio.
    return _checks(spark, d)


@C.query(_VALID + "SELECT scheme_id, as_of, CASE WHEN COUNT(CASE WHEN NOT x.p AND x.b THEN 1 END) > 0 THEN 'quarantined' WHEN COUNT(CASE WHEN NOT x.p THEN 1 END) > 0 THEN 'warn' ELSE 'ok' END AS status, COUNT(CASE WHEN NOT x.p THEN 1 END) AS n_failed, COUNT(CASE WHEN x.p IS NULL THEN 1 END) AS n_not_run FROM k GROUP BY 1, 2")
def promote_status(spark: SparkSession, d: str) -> DataFrame:
    return validate.promote(_checks(spark, d))


def _priced(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    prices = view(spark, d, "nav")
    return prices.filter("scheme_id % 2 = 0").withColumn("load", F.lit(1)), prices.filter("scheme_id % 4 <> 2").withColumn("nav", F.col("nav") + 1).withColumn("load", F.lit(2))


@C.query(prelude("nav") + " SELECT scheme_id, nav_date, CASE WHEN scheme_id % 4 <> 2 THEN nav + 1 ELSE nav END AS nav, CASE WHEN scheme_id % 4 <> 2 THEN 2 ELSE 1 END AS load FROM nav")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return merge.last_wins(*_priced(spark, d), ["scheme_id", "nav_date"], "load")


@C.query(prelude("nav") + " SELECT scheme_id, nav_date, CASE WHEN scheme_id % 2 = 0 THEN nav ELSE nav + 1 END AS nav, CASE WHEN scheme_id % 2 = 0 THEN 1 ELSE 2 END AS load FROM nav")
def insert_where_absent(spark: SparkSession, d: str) -> DataFrame:
    return merge.where_absent(*_priced(spark, d), ["scheme_id", "nav_date"])


@C.query("WITH r AS (SELECT DISTINCT l_suppkey AS scheme_id, l_partkey AS issuer_id, CASE WHEN l_linestatus = 'O' THEN 2 ELSE 1 END AS revision FROM lineitem), m AS (SELECT *, MAX(revision) OVER (PARTITION BY scheme_id) AS n FROM r) SELECT scheme_id, issuer_id, revision FROM m WHERE revision = n")
def revision_current_view(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "lineitem").select(F.col("l_suppkey").alias("scheme_id"), F.col("l_partkey").alias("issuer_id"), F.when(F.col("l_linestatus") == "O", 2).otherwise(1).alias("revision")).distinct()
    return merge.current_revision(rows, ["scheme_id"])


@C.query("SELECT l_suppkey AS scheme_id, l_returnflag AS flag, MIN(CAST(l_shipdate AS DATE)) AS first_seen, MAX(CAST(l_shipdate AS DATE)) AS last_seen FROM lineitem GROUP BY 1, 2")
def seen_span_merge(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    rows = view(spark, d, "lineitem").select(F.col("l_suppkey").alias("scheme_id"), F.col("l_returnflag").alias("flag"), day.alias("first_seen"), day.alias("last_seen"), "l_linestatus")
    return merge.seen_spans(rows.filter("l_linestatus = 'F'").drop("l_linestatus"), rows.filter("l_linestatus <> 'F'").drop("l_linestatus"), ["scheme_id", "flag"])


@C.query("SELECT l_partkey AS id, COUNT(DISTINCT (l_returnflag, l_linestatus)) AS different FROM lineitem GROUP BY 1 HAVING COUNT(DISTINCT (l_returnflag, l_linestatus)) > 1")
def key_collisions(spark: SparkSession, d: str) -> DataFrame:
    return merge.collisions(view(spark, d, "lineitem").withColumnRenamed("l_partkey", "id"), "id", ["l_returnflag", "l_linestatus"])


_RATES = "r AS (SELECT l_suppkey AS scheme_id, CAST(l_shipdate AS DATE) AS valid_from, l_orderkey * 10 + l_linenumber AS revision, l_tax AS ter FROM lineitem)"


def _rates(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "lineitem").select(F.col("l_suppkey").alias("scheme_id"), F.col("l_shipdate").cast("date").alias("valid_from"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("revision"), F.col("l_tax").alias("ter"))


@C.query("WITH " + _RATES + " SELECT scheme_id, valid_from, revision, ter FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY scheme_id ORDER BY valid_from DESC, revision DESC) AS rk FROM r WHERE valid_from <= DATE '1997-01-01') WHERE rk = 1")
def ter_in_force(spark: SparkSession, d: str) -> DataFrame:
    return merge.in_force(_rates(spark, d), ["scheme_id"], F.lit("1997-01-01").cast("date"))


@C.query("WITH " + _RATES + ", m AS (SELECT *, CAST(date_trunc('month', valid_from) AS DATE) AS mo, MAX(valid_from) OVER (PARTITION BY scheme_id, date_trunc('month', valid_from)) AS la FROM r) SELECT scheme_id, mo AS \"month\", MAX(valid_from) AS valid_from, MIN(ter) AS ter FROM m WHERE valid_from = la GROUP BY 1, 2 HAVING COUNT(DISTINCT ter) = 1")
def ter_month_end(spark: SparkSession, d: str) -> DataFrame:
    return merge.last_of_month(_rates(spark, d), ["scheme_id"], "valid_from", "ter")


@C.query(prelude("fund", "disclosure") + """, s AS (SELECT scheme_id, MAX(as_of) AS last FROM disclosure WHERE NOT quarantined GROUP BY 1), n AS (SELECT MAX(last) AS newest FROM s)
SELECT amc_id, COUNT(*) AS expected, COUNT(last) AS disclosed, MIN(last) AS oldest, COUNT(CASE WHEN last = newest THEN 1 END) AS current FROM fund LEFT JOIN s USING (scheme_id) CROSS JOIN n GROUP BY 1""")  # fmt: skip
def house_standings(spark: SparkSession, d: str) -> DataFrame:
    last = view(spark, d, "disclosure").filter("not quarantined").groupBy("scheme_id").agg(F.max("as_of").alias("last"))
    joined = view(spark, d, "fund").join(last, "scheme_id", "left").crossJoin(F.broadcast(last.agg(F.max("last").alias("newest"))))
    return joined.groupBy("amc_id").agg(F.count(F.lit(1)).alias("expected"), F.count("last").alias("disclosed"), F.min("last").alias("oldest"), F.count_if(F.col("last") == F.col("newest")).alias("current"))


# ---- parsing, thinning, streaming ------------------------------------------


@C.query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_explode(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k")


@C.query("SELECT l_orderkey, l_linenumber, kind, rate FROM (SELECT l_orderkey, l_linenumber, unnest(['tax', 'discount']) AS kind, unnest([NULLIF(l_tax, 0), NULLIF(l_discount, 0)]) AS rate FROM lineitem) WHERE rate IS NOT NULL")
def unpivot_ter(spark: SparkSession, d: str) -> DataFrame:
    wide = view(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"), F.nullif("l_discount", F.lit(0.0)).alias("l_discount"))
    return parsers.wide_to_long(wide, ["l_orderkey", "l_linenumber"], {"l_tax": "tax", "l_discount": "discount"}, "kind", "rate")


@C.query(prelude("nav", "fund") + " SELECT 'House ' || amc_id || ' Mutual Fund' AS house, category, CAST(scheme_id AS VARCHAR) AS code, scheme_name AS name, CAST(nav AS DOUBLE) AS nav, nav_date FROM fund JOIN nav USING (scheme_id)")
def parse_nav_lines(spark: SparkSession, d: str) -> DataFrame:
    """Prices written as text lines, one file per fund, and read back."""
    funds, prices = view(spark, d, "fund"), view(spark, d, "nav")
    rows = prices.join(funds, "scheme_id")
    cells = F.concat_ws(";", F.col("scheme_id").cast("string"), F.lit("-"), F.lit("-"), "scheme_name", F.col("nav").cast("decimal(18,4)").cast("string"), F.date_format("nav_date", "dd-MMM-yyyy"))
    body = rows.select(F.col("scheme_id").cast("string").alias("file"), (F.datediff("nav_date", F.lit("1970-01-01")) + 10).alias("line_no"), cells.alias("line"))
    head = F.array(F.lit("Scheme Code;ISIN Div Payout/ ISIN Growth;ISIN Div Reinvestment;Scheme Name;Net Asset Value;Date"), F.lit(""), F.col("category"), F.concat(F.lit("House "), F.col("amc_id").cast("string"), F.lit(" Mutual Fund")))
    heads = funds.select(F.col("scheme_id").cast("string").alias("file"), F.posexplode(head).alias("line_no", "line"))
    parsed = parsers.parse_nav(heads.unionByName(body))
    return parsed.select("house", "category", "code", "name", F.col("nav").cast("double").alias("nav"), "nav_date")


@C.query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '(?i)<a\s'))::BIGINT AS links FROM pages")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return parsers.page_facts(view(spark, d, "pages")).drop("text_chars")


@C.query()
def lttb_downsample(spark: SparkSession, d: str) -> DataFrame:
    return series.thinned(view(spark, d, "nav"), "scheme_id", "nav_date", "nav", 40)


@C.query("SELECT date_trunc('hour', ts) AS window_start, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value FROM events GROUP BY 1, 2")
def event_activity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(activity(view(spark, d, "events")).drop("users"), value=4)
