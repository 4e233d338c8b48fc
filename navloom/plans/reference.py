"""Queries on reference data. Suppliers stand for share classes; names, codes, benchmarks and mergers go by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.operators import merge as M
from navloom.operators import reference as R
from navloom.plans.base import Catalogue
from navloom.sources.analogue import prelude, view

C = Catalogue()

# Yearly observations of a rate, made up.
RATES = (("1992-06-01", 9.1), ("1993-06-01", 8.3), ("1994-06-01", 8.9), ("1995-06-01", 7.7), ("1996-06-01", 7.2), ("1997-06-01", 6.4), ("1998-06-01", 6.6))
_RATES = ", rates AS (SELECT CAST(column0 AS DATE) AS observed, CAST(column1 AS DOUBLE) AS rate FROM (VALUES " + ", ".join(f"('{d}', {r})" for d, r in RATES) + ") v(column0, column1))"


@C.query(prelude("nav") + _RATES + " SELECT scheme_id, nav_date, (SELECT arg_max(rate, observed) FROM rates WHERE observed <= nav_date) AS risk_free FROM nav")
def risk_free_asof(spark: SparkSession, d: str) -> DataFrame:
    rates = spark.createDataFrame(list(RATES), "observed string, rate double").withColumn("observed", F.to_date("observed"))
    return R.risk_free_on(view(spark, d, "nav").select("scheme_id", "nav_date"), rates, "nav_date")


@C.query(prelude("disclosure") + " SELECT scheme_id, arg_max(as_of, as_of) AS as_of, CAST(max_by(aum, struct_pack(a := as_of, b := aum)) AS DOUBLE) AS aum FROM disclosure GROUP BY 1")
def newest_fund_size(spark: SparkSession, d: str) -> DataFrame:
    return R.newest(view(spark, d, "disclosure"), "scheme_id", "as_of", "aum").withColumn("aum", F.col("aum").cast("double"))


@C.query(prelude("scheme", "nav", "level") + """, l AS (SELECT 'IDX:' || i AS index_id, level_date, level * (i + 1) AS level, i % 2 = 0 AS tri FROM level, range(9) r(i) WHERE month(level_date) <> 5)
SELECT nav.scheme_id, nav_date, nav, benchmark_id AS index_id, ROUND(level, 6) AS level FROM nav LEFT JOIN scheme USING (scheme_id) LEFT JOIN l ON l.index_id = benchmark_id AND tri AND level_date = nav_date""")  # fmt: skip
def price_history(spark: SparkSession, d: str) -> DataFrame:
    level = view(spark, d, "level").filter("month(level_date) <> 5").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8))))
    levels = level.select(F.concat(F.lit("IDX:"), "i").alias("index_id"), "level_date", (F.col("level") * (F.col("i") + 1)).alias("level"), (F.col("i") % 2 == 0).alias("is_total_return"))
    out = R.price_history(view(spark, d, "nav"), view(spark, d, "scheme"), levels)
    return out.select("scheme_id", "nav_date", "nav", "index_id", F.round("level", 6).alias("level"))


@C.query(prelude("scheme") + """ SELECT s.scheme_id, CASE WHEN COUNT(o.scheme_id) = 1 THEN MIN(o.scheme_id) END AS sibling_id FROM scheme s
LEFT JOIN scheme o ON o.scheme_name = s.scheme_name AND o.option = s.option AND o.plan <> s.plan GROUP BY s.scheme_id""")  # fmt: skip
def sibling_plans(spark: SparkSession, d: str) -> DataFrame:
    return R.sibling_plans(view(spark, d, "scheme"))


_ASKS = """, ask AS (SELECT p_partkey AS ask_id, CASE WHEN p_partkey % 4 = 0 THEN CONCAT('INF', LPAD(CAST(p_partkey % 150 AS VARCHAR), 9, '0')) END AS isin, CASE WHEN p_partkey % 3 = 0 THEN CONCAT('C', p_partkey % 60) END AS code,
  CONCAT(' FUND ', p_partkey % 40) AS name FROM part)"""


@C.query(prelude("scheme") + _ASKS + """, c AS (SELECT code, MIN(scheme_id) AS id FROM scheme WHERE code IS NOT NULL GROUP BY code HAVING COUNT(*) = 1), n AS (SELECT lower(scheme_name) AS name, MIN(scheme_id) AS id FROM scheme GROUP BY 1 HAVING COUNT(*) = 1)
SELECT ask_id, CASE WHEN ask.isin IS NOT NULL THEN s.scheme_id ELSE COALESCE(c.id, n.id) END AS scheme_id,
 CASE WHEN ask.isin IS NOT NULL THEN CASE WHEN s.scheme_id IS NULL THEN 'unresolved' ELSE 'isin' END WHEN c.id IS NOT NULL THEN 'code' WHEN n.id IS NOT NULL THEN 'name' ELSE 'unresolved' END AS found_by
FROM ask LEFT JOIN scheme s ON s.isin = ask.isin LEFT JOIN c ON c.code = ask.code LEFT JOIN n ON n.name = lower(trim(ask.name))""")  # fmt: skip
def resolve_schemes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    asks = view(spark, d, "part").select(
        p.alias("ask_id"), F.when(p % 4 == 0, F.concat(F.lit("INF"), F.lpad((p % 150).cast("string"), 9, "0"))).alias("isin"), F.when(p % 3 == 0, F.concat(F.lit("C"), p % 60)).alias("code"), F.concat(F.lit(" FUND "), p % 40).alias("name")
    )
    return R.resolve_schemes(asks, view(spark, d, "scheme"))


@C.query(prelude("scheme").replace("WITH", "WITH RECURSIVE", 1) + """, w AS (
  SELECT scheme_id, 1 AS step, scheme_id AS predecessor, merged_into AS successor, [scheme_id, merged_into] AS path FROM scheme WHERE merged_into IS NOT NULL
  UNION ALL SELECT w.scheme_id, step + 1, w.successor, s.merged_into, list_append(path, s.merged_into) FROM w JOIN scheme s ON s.scheme_id = w.successor WHERE s.merged_into IS NOT NULL AND NOT list_contains(path, s.merged_into))
SELECT scheme_id, step, predecessor, successor FROM w""")  # fmt: skip
def merger_chains(spark: SparkSession, d: str) -> DataFrame:
    return R.merger_chains(view(spark, d, "scheme"))


# Sheets of a disclosure are numbered by scheme and month; each states one or two benchmarks.
_STATED = """, stated AS (SELECT scheme_id * 1000 + month(as_of) * 10 + x.i AS line_id, scheme_id * 100 + month(as_of) AS sheet_id, CASE WHEN (scheme_id + month(as_of) * x.i) % 10 = 0 THEN 'Nifty plus gold' ELSE 'Index ' || (scheme_id + x.i * (scheme_id % 3)) % 9 END AS text,
  'IX' || (scheme_id + x.i * (scheme_id % 3)) % 9 AS key FROM (SELECT DISTINCT scheme_id, as_of FROM disclosure) d, range(2) x(i))"""


@C.query(prelude("disclosure") + _STATED + """, g AS (SELECT sheet_id, bool_or(text LIKE '%plus%') AS comp, bool_or(key = 'IX8') AS unk, MIN(key) AS lo, MAX(key) AS hi FROM stated GROUP BY 1)
SELECT sheet_id, CASE WHEN NOT comp AND NOT unk AND lo = hi THEN replace(lo, 'IX', 'IDX:') END AS index_id, CASE WHEN comp THEN 'composite' WHEN unk THEN 'not a listed index' WHEN lo <> hi THEN 'states two indices' ELSE 'declared' END AS reason FROM g""")  # fmt: skip
def declared_benchmarks(spark: SparkSession, d: str) -> DataFrame:
    dis, i, m = view(spark, d, "disclosure").select("scheme_id", "as_of").distinct().withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))), F.col("i"), F.month("as_of")
    number = (F.col("scheme_id") + i * (F.col("scheme_id") % 3)) % 9
    text = F.when((F.col("scheme_id") + m * i) % 10 == 0, "Nifty plus gold").otherwise(F.concat(F.lit("Index "), number))
    stated = dis.select((F.col("scheme_id") * 100 + m).alias("sheet_id"), text.alias("text"), F.concat(F.lit("IX"), number).alias("key"))
    known = spark.range(8).select(F.concat(F.lit("IX"), "id").alias("key"), F.concat(F.lit("IDX:"), "id").alias("index_id"))
    return R.declared_per_scheme(stated, known)


_FAMILY = """, st AS (SELECT amc_id, family, as_of, 'IDX:' || (scheme_id + month(as_of)) % 4 AS index_id FROM scheme JOIN disclosure USING (scheme_id) WHERE day(as_of) > 27 AND scheme_id % 3 > 0),
nw AS (SELECT amc_id, family, CASE WHEN COUNT(DISTINCT index_id) = 1 THEN MIN(index_id) END AS index_id, MAX(as_of) AS as_of FROM (SELECT *, MAX(as_of) OVER (PARTITION BY amc_id, family) AS m FROM st) WHERE as_of = m GROUP BY 1, 2)"""


def _newest(spark: SparkSession, d: str) -> DataFrame:
    joined = view(spark, d, "scheme").join(view(spark, d, "disclosure"), "scheme_id").filter("day(as_of) > 27 and scheme_id % 3 > 0")
    stated = joined.select("amc_id", "family", "as_of", F.concat(F.lit("IDX:"), (F.col("scheme_id") + F.month("as_of")) % 4).alias("index_id"))
    return R.newest_per_family(stated)


@C.query(prelude("scheme", "disclosure") + _FAMILY + " SELECT * FROM nw")
def newest_declared_per_family(spark: SparkSession, d: str) -> DataFrame:
    return _newest(spark, d)


@C.query(prelude("scheme", "disclosure") + _FAMILY + """ SELECT scheme_id, COALESCE(index_id, benchmark_id) AS benchmark_id, CASE WHEN index_id IS NULL THEN 'not declared' WHEN benchmark_id IS NULL THEN 'was null' WHEN benchmark_id = index_id THEN 'unchanged' ELSE 'changed' END AS status
FROM scheme LEFT JOIN nw USING (amc_id, family)""")  # fmt: skip
def apply_declared(spark: SparkSession, d: str) -> DataFrame:
    return R.apply_declared(view(spark, d, "scheme"), _newest(spark, d))


@C.query(prelude("scheme") + " SELECT scheme_id, COALESCE(benchmark_id, CASE WHEN scheme_id % 12 = 0 THEN 'IDX:named' END) AS benchmark_id FROM scheme")
def filled_benchmarks(spark: SparkSession, d: str) -> DataFrame:
    inferred = view(spark, d, "scheme").filter("scheme_id % 4 = 0").select("scheme_id", F.when(F.col("scheme_id") % 12 == 0, "IDX:named").alias("index_id"))
    return R.filled_benchmarks(view(spark, d, "scheme"), inferred).select("scheme_id", "benchmark_id")


_TRACK = """, f AS (SELECT scheme_id, MIN(nav_date) AS first_date FROM nav GROUP BY 1), tr AS (SELECT key, scheme_id, ROW_NUMBER() OVER (PARTITION BY key ORDER BY first_date, scheme_id) AS place FROM scheme JOIN f USING (scheme_id) WHERE scheme_id % 2 = 0)"""


def _tracked(spark: SparkSession, d: str) -> DataFrame:
    first = view(spark, d, "nav").groupBy("scheme_id").agg(F.min("nav_date").alias("first_date"))
    return R.trackers(view(spark, d, "scheme").select("scheme_id", "key"), first, F.col("scheme_id") % 2 == 0)


@C.query(prelude("scheme", "nav") + _TRACK + " SELECT key, scheme_id, place FROM tr")
def benchmark_trackers(spark: SparkSession, d: str) -> DataFrame:
    return _tracked(spark, d)


@C.query(prelude("scheme", "nav") + _TRACK + " SELECT s.scheme_id, (SELECT arg_min(tr.scheme_id, place) FROM tr WHERE tr.key = s.key AND tr.scheme_id <> s.scheme_id) AS proxy_id FROM scheme s")
def benchmark_proxies(spark: SparkSession, d: str) -> DataFrame:
    return R.proxies(view(spark, d, "scheme").select("scheme_id", "key"), _tracked(spark, d))


_CLASS = """, fam AS (SELECT *, CASE WHEN scheme_id % 10 = 0 THEN 'shared' ELSE family END AS fml FROM scheme), lv AS (SELECT * FROM fam WHERE last_seen >= (SELECT MAX(last_seen) FROM fam) - 30),
sc AS (SELECT fml AS family, plan, scheme_id FROM lv WHERE fml IN (SELECT fml FROM lv GROUP BY fml HAVING COUNT(DISTINCT amc_id) = 1))"""


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return R.share_classes(view(spark, d, "scheme").withColumn("family", F.when(F.col("scheme_id") % 10 == 0, "shared").otherwise(F.col("family"))))


@C.query(prelude("scheme") + _CLASS + " SELECT * FROM sc")
def share_classes(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d)


@C.query(prelude("scheme") + _CLASS + """, fig AS (SELECT DISTINCT fml AS family, plan, DATE '2024-01-15' AS valid_from, CAST(length(fml) + CASE WHEN plan = 'direct' THEN 0 ELSE 1 END AS BIGINT) AS ter FROM fam),
st AS (SELECT scheme_id, DATE '2024-01-15' AS valid_from, CAST(9 + scheme_id % 3 AS BIGINT) AS ter, 1 + scheme_id % 2 AS revision FROM scheme WHERE scheme_id % 4 > 0)
SELECT sc.scheme_id, fig.valid_from, fig.ter, COALESCE(st.revision, 0) + 1 AS revision FROM fig JOIN sc USING (family, plan) LEFT JOIN st ON st.scheme_id = sc.scheme_id WHERE st.ter IS DISTINCT FROM fig.ter""")  # fmt: skip
def charge_revisions(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit("2024-01-15").cast("date").alias("valid_from")
    fam = view(spark, d, "scheme").withColumn("family", F.when(F.col("scheme_id") % 10 == 0, "shared").otherwise(F.col("family")))
    figures = fam.select("family", "plan", day, (F.length("family") + F.when(F.col("plan") == "direct", 0).otherwise(1)).cast("long").alias("ter")).distinct()
    stored = view(spark, d, "scheme").filter("scheme_id % 4 > 0").select("scheme_id", day, (9 + F.col("scheme_id") % 3).cast("long").alias("ter"), (1 + F.col("scheme_id") % 2).alias("revision"))
    return R.new_charges(figures, _classes(spark, d), stored)


@C.query(prelude("scheme") + """, ln AS (SELECT CAST(o_custkey % 50 AS BIGINT) AS file_id, o_orderkey AS sheet_id, 'notes on family ' || (o_custkey % 25 * 10 + o_orderkey % 4) || CASE WHEN o_orderkey % 5 = 0 THEN ' and family ' || (o_custkey % 24 * 10) || ' too' ELSE ' alone' END AS line FROM orders),
nm AS (SELECT DISTINCT family AS name, amc_id FROM scheme),
v AS (SELECT file_id, sheet_id, MIN(amc_id) AS amc_id FROM ln JOIN nm ON contains(' ' || line || ' ', ' ' || name || ' ') GROUP BY 1, 2 HAVING MIN(amc_id) = MAX(amc_id)),
t AS (SELECT file_id, amc_id, COUNT(*) AS votes FROM v GROUP BY 1, 2), b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY votes DESC, amc_id) AS rk, CAST(SUM(votes) OVER (PARTITION BY file_id) AS BIGINT) AS total FROM t)
SELECT file_id, CASE WHEN votes * 2 > total THEN amc_id END AS amc_id, votes, total FROM b WHERE rk = 1""")  # fmt: skip
def detect_house(spark: SparkSession, d: str) -> DataFrame:
    cust, order = F.col("o_custkey"), F.col("o_orderkey")
    tail = F.when(order % 5 == 0, F.concat(F.lit(" and family "), cust % 24 * 10, F.lit(" too"))).otherwise(" alone")
    lines = view(spark, d, "orders").select((cust % 50).cast("long").alias("file_id"), order.alias("sheet_id"), F.concat(F.lit("notes on family "), cust % 25 * 10 + order % 4, tail).alias("line"))
    return R.detect_house(lines, view(spark, d, "scheme").select(F.col("family").alias("name"), "amc_id").distinct())


_DISC = """, h AS (SELECT issuer_id, CASE issuer_id % 4 WHEN 0 THEN 'INE' || LPAD(CAST(issuer_id % 300 AS VARCHAR), 4, '0') || LPAD(CAST(issuer_id AS VARCHAR), 5, '0') WHEN 1 THEN 'US' || LPAD(CAST(issuer_id % 100 AS VARCHAR), 6, '0') || LPAD(CAST(issuer_id % 9999 AS VARCHAR), 4, '0')
  WHEN 2 THEN 'INF' || LPAD(CAST(issuer_id AS VARCHAR), 9, '0') ELSE 'IN' || LPAD(CAST(10 + issuer_id % 5 AS VARCHAR), 2, '0') || '20' || LPAD(CAST(issuer_id AS VARCHAR), 6, '0') END AS isin,
  CASE WHEN issuer_id % 3 = 0 THEN 'CP' ELSE issuer_name END AS raw_name FROM issuer)"""


def _disclosed(spark: SparkSession, d: str) -> DataFrame:
    i, pad = F.col("issuer_id"), lambda c, n: F.lpad(c.cast("string"), n, "0")
    isin = F.when(i % 4 == 0, F.concat(F.lit("INE"), pad(i % 300, 4), pad(i, 5))).when(i % 4 == 1, F.concat(F.lit("US"), pad(i % 100, 6), pad(i % 9999, 4)))
    isin = isin.when(i % 4 == 2, F.concat(F.lit("INF"), pad(i, 9))).otherwise(F.concat(F.lit("IN"), pad(10 + i % 5, 2), F.lit("20"), pad(i, 6)))
    return view(spark, d, "issuer").select("issuer_id", isin.alias("isin"), F.when(i % 3 == 0, "CP").otherwise(F.col("issuer_name")).alias("raw_name"))


@C.query(prelude("issuer") + _DISC + r""", g AS (SELECT CASE WHEN isin LIKE 'INE%' THEN left(isin, 7) ELSE left(isin, 8) END AS segment, isin, raw_name, len(list_filter(string_split_regex(raw_name, '[^A-Za-z]+'), lambda w: length(w) > 2)) AS w FROM h WHERE isin LIKE 'INE%' OR isin LIKE 'US%'),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY w DESC, length(raw_name) DESC, raw_name DESC) AS rk FROM g WHERE w >= 2 AND raw_name <> 'CP')
SELECT 'DISC:' || g.segment AS issuer_id, MIN(b.raw_name) AS issuer_name, CASE WHEN g.segment LIKE 'IN%' THEN 'IN' ELSE left(g.segment, 2) END AS country, COUNT(DISTINCT g.isin) AS instruments FROM g LEFT JOIN b ON b.segment = g.segment AND b.rk = 1 GROUP BY g.segment""")  # fmt: skip
def disclosed_issuers(spark: SparkSession, d: str) -> DataFrame:
    return R.disclosed_issuers(_disclosed(spark, d))


_STATES = (("10", "almond"), ("11", "azure"), ("12", "Nowhere"), ("13", "lace"))


@C.query(prelude("issuer") + _DISC + ", st AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in _STATES) + """) v(code, state)), r AS (SELECT substr(isin, 3, 2) AS code, isin, lower(raw_name) AS name FROM h WHERE regexp_matches(isin, '^IN[0-9][0-9]20'))
SELECT 'STATE:IN' || r.code AS issuer_id, 'Government of ' || MIN(st.state) AS issuer_name, bool_or(EXISTS (SELECT 1 FROM st o WHERE o.code <> r.code AND contains(r.name, lower(o.state)))) AS conflict, COUNT(DISTINCT isin) AS instruments FROM r JOIN st USING (code) GROUP BY r.code""")  # fmt: skip
def state_issuers(spark: SparkSession, d: str) -> DataFrame:
    return R.state_issuers(_disclosed(spark, d), spark.createDataFrame(list(_STATES), "code string, state string"))


@C.query(r"""WITH m AS (SELECT p_partkey AS place, 'IN' || LPAD(CAST(p_partkey % 700 AS VARCHAR), 10, '0') || CASE WHEN p_partkey % 3 = 0 THEN ' IN' || LPAD(CAST(p_partkey % 500 AS VARCHAR), 10, '0') ELSE '' END AS codes, ' Fund ' || p_partkey % 350 || ' ' AS nm, DATE '2020-01-01' + CAST(p_partkey % 365 AS INTEGER) AS launched FROM part),
e AS (SELECT unnest(regexp_extract_all(codes, 'IN[A-Z0-9]{10}')) AS isin, trim(nm) AS scheme_name, launched, place FROM m)
SELECT isin, MIN(scheme_name) AS scheme_name, arg_max(launched, place) AS launched FROM e GROUP BY isin HAVING COUNT(DISTINCT scheme_name) = 1""")  # fmt: skip
def scheme_master(spark: SparkSession, d: str) -> DataFrame:
    p, pad = F.col("p_partkey"), lambda c: F.lpad(c.cast("string"), 10, "0")
    codes = F.concat(F.lit("IN"), pad(p % 700), F.when(p % 3 == 0, F.concat(F.lit(" IN"), pad(p % 500))).otherwise(""))
    return R.scheme_master(view(spark, d, "part").select(p.alias("place"), codes.alias("codes"), F.concat(F.lit(" Fund "), p % 350, F.lit(" ")).alias("scheme_name"), F.date_add(F.lit("2020-01-01").cast("date"), (p % 365).cast("int")).alias("launched")))


@C.query(prelude("scheme", "disclosure") + " SELECT DISTINCT benchmark_id FROM scheme JOIN disclosure USING (scheme_id) WHERE benchmark_id IS NOT NULL")
def held_indices(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "scheme").join(view(spark, d, "disclosure"), "scheme_id", "left_semi").select("benchmark_id").filter("benchmark_id is not null").distinct()


@C.query(prelude("issuer", "level") + """, ls AS (SELECT issuer_id, CASE WHEN issuer_id % 2 = 0 THEN DATE '1995-06-30' WHEN issuer_id % 3 = 0 THEN DATE '1996-06-30' ELSE DATE '1999-12-31' END AS list_date, market_cap FROM issuer)
SELECT list_date, issuer_id, market_cap FROM ls WHERE list_date = (SELECT MAX(list_date) FROM ls WHERE list_date <= DATE '1998-01-01')""")  # fmt: skip
def mcap_list_in_force(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("issuer_id") % 2 == 0, "1995-06-30").when(F.col("issuer_id") % 3 == 0, "1996-06-30").otherwise("1999-12-31").cast("date")
    return R.list_in_force(view(spark, d, "issuer").select("issuer_id", day.alias("list_date"), "market_cap"), F.lit("1998-01-01").cast("date"))


@C.query(prelude("scheme") + """ SELECT key, CASE WHEN COUNT(DISTINCT id) = 1 THEN MIN(id) END AS index_id FROM (SELECT key, CASE WHEN scheme_id = 3 THEN 'IDX:extra' ELSE 'IDX:' || key END AS id FROM scheme) GROUP BY key""")
def registered_index(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "scheme").select("key", F.when(F.col("scheme_id") == 3, "IDX:extra").otherwise(F.concat(F.lit("IDX:"), "key")).alias("index_id"))
    return R.registered(rows, strict=False)


@C.query(prelude("scheme") + """, s AS (SELECT scheme_id AS index_id, scheme_name AS name, last_seen - 40 AS first_seen, last_seen FROM scheme WHERE scheme_id % 3 > 0), n AS (SELECT scheme_id AS index_id, upper(scheme_name) AS name FROM scheme WHERE scheme_id % 2 = 0)
SELECT COALESCE(s.index_id, n.index_id) AS index_id, COALESCE(n.name, s.name) AS name, first_seen, last_seen FROM s FULL JOIN n ON s.index_id = n.index_id""")  # fmt: skip
def index_catalogue(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "scheme")
    stored = s.filter("scheme_id % 3 > 0").select(F.col("scheme_id").alias("index_id"), F.col("scheme_name").alias("name"), F.date_sub("last_seen", 40).alias("first_seen"), "last_seen")
    return R.catalogue_update(stored, s.filter("scheme_id % 2 = 0").select(F.col("scheme_id").alias("index_id"), F.upper("scheme_name").alias("name")))


@C.query(prelude("disclosure") + """, s AS (SELECT scheme_id, as_of, scheme_id % 3 + 1 AS revision, 'f' || (scheme_id % 3) AS file_id, 'r1' AS resolver FROM disclosure GROUP BY 1, 2 UNION ALL SELECT scheme_id, as_of, 0, 'f9', 'r1' FROM disclosure GROUP BY 1, 2),
n AS (SELECT scheme_id, as_of, CASE WHEN scheme_id % 5 = 0 THEN 'f9' ELSE 'f' || (scheme_id % 3) END AS file_id, CASE WHEN scheme_id % 7 = 0 THEN 'r2' ELSE 'r1' END AS resolver FROM disclosure GROUP BY 1, 2)
SELECT n.scheme_id, n.as_of, n.file_id, n.resolver, m.revision + 1 AS revision FROM n JOIN s m ON m.scheme_id = n.scheme_id AND m.as_of = n.as_of AND m.revision > 0 WHERE m.file_id <> n.file_id OR m.resolver <> n.resolver""")  # fmt: skip
def next_revisions(spark: SparkSession, d: str) -> DataFrame:
    days, i = view(spark, d, "disclosure").select("scheme_id", "as_of").distinct(), F.col("scheme_id")
    file = F.concat(F.lit("f"), i % 3)
    stored = days.select("scheme_id", "as_of", (i % 3 + 1).alias("revision"), file.alias("file_id"), F.lit("r1").alias("resolver")).union(days.select("scheme_id", "as_of", F.lit(0).cast("long"), F.lit("f9"), F.lit("r1")))
    new = days.select("scheme_id", "as_of", F.when(i % 5 == 0, "f9").otherwise(file).alias("file_id"), F.when(i % 7 == 0, "r2").otherwise("r1").alias("resolver"))
    return M.next_revisions(stored, new, ["scheme_id", "as_of"], ["file_id", "resolver"])


@C.query(prelude("scheme", "disclosure", "fund") + """, z AS (SELECT scheme_id, MAX(as_of) AS as_of FROM disclosure GROUP BY 1), y AS (SELECT scheme_id, as_of, CAST(MAX(aum) AS DOUBLE) AS aum FROM disclosure JOIN z USING (scheme_id, as_of) GROUP BY 1, 2)
SELECT scheme_id, 'House ' || amc_id AS amc_name, CASE WHEN benchmark_id IS NOT NULL THEN 'Name of ' || benchmark_id END AS benchmark_name, as_of, aum, CAST(scheme_id % 7 AS DOUBLE) AS ter FROM scheme LEFT JOIN y USING (scheme_id)""")  # fmt: skip
def scheme_facts(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "scheme")
    houses = view(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("amc_id"), F.concat(F.lit("House "), "n_nationkey").alias("amc_name"))
    names = s.select("benchmark_id", F.concat(F.lit("Name of "), "benchmark_id").alias("benchmark_name")).filter("benchmark_id is not null").distinct()
    ters = s.select("scheme_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")).select("scheme_id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i") * 30).alias("valid_from"), F.lit(1).alias("revision"), (F.col("scheme_id") % 7 + F.when(F.col("i") == 2, 100).otherwise(0) - F.when(F.col("i") == 0, 50).otherwise(0)).cast("double").alias("ter"))
    out = R.scheme_facts(s, houses, names, view(spark, d, "disclosure").select("scheme_id", "as_of", "aum"), ters, F.lit("2024-02-15").cast("date"))
    return out.withColumn("aum", F.col("aum").cast("double"))


@C.query(prelude("nav", "txn", "disclosure") + " SELECT 'nav' AS name, COUNT(*) AS n_rows, MAX(nav_date) AS newest FROM nav UNION ALL SELECT 'txn', COUNT(*), MAX(txn_date) FROM txn UNION ALL SELECT 'disclosure', COUNT(*), MAX(as_of) FROM disclosure")
def health_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return R.health({n: (view(spark, d, n), c) for n, c in (("nav", "nav_date"), ("txn", "txn_date"), ("disclosure", "as_of"))})
