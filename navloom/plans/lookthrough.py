"""Look-through queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.operators import lookthrough as L
from navloom.plans.base import Catalogue, rounded, rounded_many
from navloom.sources.analogue import prelude, view

C = Catalogue()

_CONTRIB = """,
p AS (SELECT user_id, scheme_id, SUM(value_inr) AS value_inr FROM position GROUP BY user_id, scheme_id),
c AS (
  SELECT p.user_id, p.scheme_id, COALESCE(CAST(w.issuer_id AS VARCHAR), '__NO_DISCLOSURE__') AS issuer_id,
         CASE WHEN w.issuer_id IS NULL THEN 'unknown' ELSE w.instrument_class END AS instrument_class,
         w.issuer_id IS NULL OR w.is_synthetic AS is_synthetic,
         CASE WHEN w.issuer_id IS NULL THEN p.value_inr ELSE p.value_inr * w.weight / 1e2 END AS contribution_inr
  FROM p LEFT JOIN disclosed_weight w ON p.scheme_id = w.scheme_id),
e AS (
  SELECT user_id, issuer_id, instrument_class, is_synthetic, SUM(contribution_inr) AS exposure_inr, COUNT(DISTINCT scheme_id) AS n_schemes
  FROM c GROUP BY ALL)
"""


def _contributed(spark: SparkSession, d: str) -> DataFrame:
    return L.contributions(view(spark, d, "position"), view(spark, d, "disclosed_weight"))


def _exposed(spark: SparkSession, d: str) -> DataFrame:
    return L.exposures(_contributed(spark, d))


def _base() -> str:
    return prelude("position", "disclosed_weight") + _CONTRIB


@C.query(_base() + "SELECT user_id, issuer_id, instrument_class, is_synthetic, ROUND(exposure_inr, 2) AS exposure_inr, n_schemes, ROUND(exposure_inr / SUM(exposure_inr) OVER (PARTITION BY user_id) * 1e2, 6) AS exposure_pct FROM e")
def lookthrough_exposure(spark: SparkSession, d: str) -> DataFrame:
    contributed = L.checked_closure(view(spark, d, "position"), _contributed(spark, d))
    return rounded(L.exposures(contributed), exposure_inr=2, exposure_pct=6)


@C.query(_base() + "SELECT scheme_id, issuer_id, ROUND(SUM(contribution_inr), 2) AS contribution_inr, COUNT(*) AS n_users FROM c GROUP BY scheme_id, issuer_id")
def lookthrough_contribution(spark: SparkSession, d: str) -> DataFrame:
    return _contributed(spark, d).groupBy("scheme_id", "issuer_id").agg(F.round(F.sum("contribution_inr"), 2).alias("contribution_inr"), F.count(F.lit(1)).alias("n_users"))


@C.query(_base() + """SELECT user_id, ROUND(SUM(contribution_inr), 2) AS total_inr,
  ROUND(SUM(CASE WHEN issuer_id <> '__NO_DISCLOSURE__' THEN contribution_inr ELSE 0 END) / SUM(contribution_inr) * 1e2, 6) AS coverage_pct,
  ROUND(SUM(CASE WHEN issuer_id <> '__NO_DISCLOSURE__' AND is_synthetic THEN contribution_inr ELSE 0 END) / SUM(contribution_inr) * 1e2, 6) AS synthetic_pct,
  COUNT(DISTINCT CASE WHEN NOT is_synthetic THEN issuer_id END) AS n_issuers FROM c GROUP BY user_id""")  # fmt: skip
def lookthrough_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.summary(_contributed(spark, d)), total_inr=2, coverage_pct=6, synthetic_pct=6)


@C.query(_base() + "SELECT user_id, ROUND(SUM(contribution_inr), 2) AS no_disclosure_inr, COUNT(*) AS n_schemes FROM c WHERE issuer_id = '__NO_DISCLOSURE__' GROUP BY user_id")
def no_disclosure_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _contributed(spark, d).filter(F.col("issuer_id") == L.NO_DISCLOSURE).groupBy("user_id").agg(F.round(F.sum("contribution_inr"), 2).alias("no_disclosure_inr"), F.count(F.lit(1)).alias("n_schemes"))


@C.query(_base() + """, t AS (SELECT user_id, SUM(value_inr) AS v FROM position GROUP BY user_id), x AS (SELECT user_id, SUM(contribution_inr) AS s FROM c GROUP BY user_id)
SELECT user_id, ROUND(v, 2) AS positions_inr, ROUND(s, 2) AS exposures_inr, ABS(v - s) <= 1 AS closes FROM t JOIN x USING (user_id)""")  # fmt: skip
def closure_check(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.closure(view(spark, d, "position"), _contributed(spark, d)), positions_inr=2, exposures_inr=2)


def _concentration_sql(scope: str) -> str:
    where = "" if scope == "all" else f" AND instrument_class = '{scope}'"
    return _base() + f""", r AS (
  SELECT user_id, issuer_id, exposure_inr, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY exposure_inr DESC, issuer_id) AS lg,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY exposure_inr, issuer_id) AS sm, exposure_inr / SUM(exposure_inr) OVER (PARTITION BY user_id) AS sh
  FROM e WHERE NOT is_synthetic{where})
SELECT user_id, COUNT(*) AS n_issuers, ROUND(SUM(sh * sh), 9) AS hhi, ROUND(1 / SUM(sh * sh), 4) AS effective_n,
       ROUND(SUM(CASE WHEN lg <= 1 THEN sh ELSE 0 END) * 1e2, 6) AS top_1_pct, ROUND(SUM(CASE WHEN lg <= 5 THEN sh ELSE 0 END) * 1e2, 6) AS top_5_pct,
       ROUND(SUM(CASE WHEN lg <= 10 THEN sh ELSE 0 END) * 1e2, 6) AS top_10_pct, ROUND(SUM(CASE WHEN lg <= 20 THEN sh ELSE 0 END) * 1e2, 6) AS top_20_pct,
       ROUND(2 * SUM(sm * exposure_inr) / (COUNT(*) * SUM(exposure_inr)) - (COUNT(*) + 1)::DOUBLE / COUNT(*), 6) AS gini, MAX(CASE WHEN lg = 1 THEN issuer_id END) AS largest_issuer
FROM r GROUP BY user_id"""


def _concentration(scope: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(L.concentration(_exposed(spark, d), scope), hhi=9, effective_n=4, top_1_pct=6, top_5_pct=6, top_10_pct=6, top_20_pct=6, gini=6)

    return run


for _scope in ("all", "equity", "debt"):
    C.add(f"concentration_{_scope}", _concentration(_scope), _concentration_sql(_scope))


@C.query(_base() + """SELECT user_id, ROW_NUMBER() OVER w AS point, ROUND(ROW_NUMBER() OVER w / COUNT(*) OVER (PARTITION BY user_id), 9) AS issuer_share,
  ROUND(SUM(exposure_inr) OVER (PARTITION BY user_id ORDER BY exposure_inr, issuer_id ROWS UNBOUNDED PRECEDING) / SUM(exposure_inr) OVER (PARTITION BY user_id), 9) AS exposure_share
FROM e WHERE NOT is_synthetic WINDOW w AS (PARTITION BY user_id ORDER BY exposure_inr, issuer_id)""")  # fmt: skip
def lorenz_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.lorenz_curve(_exposed(spark, d)), issuer_share=9, exposure_share=9)


@C.query(prelude("weight", "position") + """, v AS (SELECT scheme_id, SUM(value_inr) AS value_inr FROM position GROUP BY scheme_id),
r AS (SELECT * FROM weight WHERE NOT is_synthetic),
f AS (SELECT scheme_id, COUNT(*) AS n, CASE WHEN SUM(CASE WHEN instrument_class = 'equity' THEN weight ELSE 0 END) = 0 THEN 1 ELSE SUM(CASE WHEN instrument_class = 'equity' THEN weight ELSE 0 END) END AS eq FROM r GROUP BY scheme_id),
g AS (SELECT f.*, COALESCE(value_inr, 0) AS value_inr FROM f LEFT JOIN v USING (scheme_id)),
m AS (SELECT r.*, g.eq, g.value_inr FROM r JOIN g USING (scheme_id)),
s AS (SELECT a.scheme_id AS sa, b.scheme_id AS sb, SUM(LEAST(a.weight, b.weight)) AS o,
        SUM(CASE WHEN a.instrument_class = 'equity' THEN LEAST(a.weight / a.eq, b.weight / b.eq) * 1e2 ELSE 0 END) AS q,
        SUM(LEAST(a.weight * a.value_inr, b.weight * b.value_inr) / 1e2) AS i, COUNT(*) AS k
      FROM m a JOIN m b ON a.issuer_id = b.issuer_id AND a.scheme_id < b.scheme_id GROUP BY 1, 2)
SELECT x.scheme_id AS scheme_a, y.scheme_id AS scheme_b, ROUND(o, 6) AS overlap_pct, ROUND(q, 6) AS equity_overlap_pct, ROUND(i, 2) AS overlap_inr,
       k AS common, x.n + y.n - k AS union_issuers, ROUND(k / (x.n + y.n - k), 9) AS jaccard
FROM g x JOIN g y ON x.scheme_id < y.scheme_id JOIN s ON s.sa = x.scheme_id AND s.sb = y.scheme_id""")  # fmt: skip
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded_pairs(L.paired(fund_lists(spark, d)))


def fund_lists(spark: SparkSession, d: str) -> DataFrame:
    return L.fund_lists(view(spark, d, "weight"), view(spark, d, "position").groupBy("scheme_id").agg(F.sum("value_inr").alias("value_inr")))


def rounded_pairs(pairs: DataFrame) -> DataFrame:
    return rounded_many(pairs, overlap_pct=6, equity_overlap_pct=6, overlap_inr=2, jaccard=9)


@C.query(prelude("weight") + """, r AS (SELECT scheme_id, issuer_id, weight FROM weight WHERE NOT is_synthetic),
s AS (SELECT a.scheme_id AS sa, SUM(LEAST(a.weight, b.weight)) AS o, b.scheme_id AS sb FROM r a JOIN r b ON a.issuer_id = b.issuer_id AND a.scheme_id <> b.scheme_id GROUP BY a.scheme_id, b.scheme_id)
SELECT sa AS scheme_id, ROUND(MAX(o), 6) AS max_overlap_pct FROM s GROUP BY sa""")  # fmt: skip
def max_pairwise_overlap(spark: SparkSession, d: str) -> DataFrame:
    pairs = L.overlap_pairs(view(spark, d, "weight"))
    ends = pairs.select(F.explode(F.array("scheme_a", "scheme_b")).alias("scheme_id"), "overlap_pct", "common").filter("common > 0")
    return ends.groupBy("scheme_id").agg(F.round(F.max("overlap_pct"), 6).alias("max_overlap_pct"))


@C.query(_base() + """, i AS (SELECT user_id, issuer_id, SUM(contribution_inr) AS s, MAX(contribution_inr) AS m, COUNT(DISTINCT scheme_id) AS n FROM c WHERE NOT is_synthetic GROUP BY 1, 2),
t AS (SELECT user_id, SUM(contribution_inr) AS total_inr FROM c GROUP BY user_id),
u AS (SELECT user_id, SUM(CASE WHEN n > 1 THEN s - m ELSE 0 END) AS dup, COUNT(CASE WHEN n > 1 THEN 1 END) AS di, COUNT(*) AS ni FROM i GROUP BY user_id)
SELECT user_id, ROUND(total_inr, 2) AS total_inr, ROUND(dup, 2) AS duplicated_inr, di AS duplicated_issuers, ni AS n_issuers, ROUND(dup / total_inr * 1e2, 6) AS duplicated_pct FROM t JOIN u USING (user_id)""")  # fmt: skip
def duplication(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.duplication(_contributed(spark, d)), total_inr=2, duplicated_inr=2, duplicated_pct=6)


@C.query(_base() + """, i AS (SELECT user_id, issuer_id, instrument_class, scheme_id, SUM(contribution_inr) AS own FROM c WHERE NOT is_synthetic GROUP BY ALL),
pt AS (SELECT *, SUM(own) OVER (PARTITION BY user_id, issuer_id, instrument_class) AS al, COUNT(*) OVER (PARTITION BY user_id, issuer_id, instrument_class) AS n FROM i),
q AS (SELECT user_id, issuer_id, SUM(own) AS x FROM i WHERE instrument_class = 'equity' GROUP BY 1, 2), w1 AS (SELECT user_id, SUM(x) AS sx, SUM(x * x) AS sxx FROM q GROUP BY user_id),
f AS (SELECT user_id, scheme_id, COUNT(CASE WHEN n = 1 THEN 1 END) AS ni, SUM(CASE WHEN n = 1 THEN own ELSE 0 END) AS ne,
       SUM(CASE WHEN instrument_class = 'equity' THEN own ELSE 0 END) AS lx, SUM(CASE WHEN instrument_class = 'equity' THEN al * al - (al - own) * (al - own) ELSE 0 END) AS lxx FROM pt GROUP BY 1, 2)
SELECT user_id, scheme_id, ni AS new_issuers, ROUND(ne, 2) AS new_exposure_inr, ROUND(sxx / (sx * sx) - (sxx - lxx) / ((sx - lx) * (sx - lx)), 9) AS hhi_delta,
       ROUND((sx * sx) / sxx - ((sx - lx) * (sx - lx)) / (sxx - lxx), 4) AS effective_n_delta FROM f JOIN w1 USING (user_id)""")  # fmt: skip
def marginal_contribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.marginal(view(spark, d, "position"), view(spark, d, "disclosed_weight")), new_exposure_inr=2, hhi_delta=9, effective_n_delta=4)


_BUCKET = """, b AS (SELECT issuer_id, CASE WHEN market_cap IS NULL THEN 'unranked' WHEN rk <= 100 THEN 'large' WHEN rk <= 250 THEN 'mid' ELSE 'small' END AS bucket
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY market_cap IS NULL ORDER BY market_cap DESC, issuer_id) AS rk FROM issuer))"""


@C.query(_base() + _BUCKET + """, z AS (SELECT user_id, bucket, SUM(exposure_inr) AS inr FROM e JOIN b ON e.issuer_id = CAST(b.issuer_id AS VARCHAR) WHERE NOT is_synthetic AND instrument_class = 'equity' GROUP BY 1, 2),
n AS (SELECT DISTINCT user_id, unnest(['large', 'mid', 'small', 'unranked']) AS bucket FROM e)
SELECT n.user_id, n.bucket, ROUND(COALESCE(inr, 0), 2) AS inr, ROUND(COALESCE(inr, 0) / SUM(inr) OVER (PARTITION BY n.user_id) * 1e2, 6) AS pct FROM n LEFT JOIN z ON n.user_id = z.user_id AND n.bucket = z.bucket""")  # fmt: skip
def mcap_tilts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.size_tilts(_exposed(spark, d), L.size_buckets(view(spark, d, "issuer"))), inr=2, pct=6)


def _composition(by: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(L.composition(view(spark, d, "weight"), by), weight=6)

    return run


for _by, _name in (("instrument_class", "class"), ("sector", "sector")):
    C.add(f"composition_by_{_name}", _composition(_by), prelude("weight") + f" SELECT scheme_id, {_by}, ROUND(SUM(weight), 6) AS weight, COUNT(*) AS n_issuers FROM weight GROUP BY 1, 2")


@C.query(prelude("weight", "issuer") + _BUCKET + " SELECT scheme_id, bucket, ROUND(SUM(weight), 6) AS weight, COUNT(*) AS n_issuers FROM weight JOIN b USING (issuer_id) WHERE instrument_class = 'equity' GROUP BY 1, 2")
def composition_by_size(spark: SparkSession, d: str) -> DataFrame:
    sized = view(spark, d, "weight").filter("instrument_class = 'equity'").join(L.size_buckets(view(spark, d, "issuer")).select("issuer_id", "bucket"), "issuer_id")
    return rounded(L.composition(sized, "bucket"), weight=6)


@C.query(_base() + """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY exposure_inr DESC, issuer_id) AS rk FROM e)
SELECT user_id, LEAST(rk, 11) AS rank, CASE WHEN rk > 10 THEN 'others' ELSE issuer_id END AS issuer_id, ROUND(SUM(exposure_inr), 2) AS exposure_inr, COUNT(*) AS n_issuers FROM r GROUP BY 1, 2, 3""")  # fmt: skip
def topk_others(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.top_with_others(_exposed(spark, d)), exposure_inr=2)


@C.query(_base() + """, t AS (SELECT user_id, issuer_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY exposure_inr DESC, issuer_id) AS rk FROM e) WHERE rk <= 15)
SELECT c.user_id, CAST(c.scheme_id AS VARCHAR) AS link_from, CASE WHEN t.issuer_id IS NULL THEN 'others' ELSE c.issuer_id END AS link_to, ROUND(SUM(contribution_inr), 2) AS inr
FROM c LEFT JOIN t ON c.user_id = t.user_id AND c.issuer_id = t.issuer_id GROUP BY 1, 2, 3""")  # fmt: skip
def sankey_links(spark: SparkSession, d: str) -> DataFrame:
    top = L.top_with_others(_exposed(spark, d), 15).filter("rank <= 15").select("user_id", "issuer_id")
    links = L.top_links(view(spark, d, "position"), view(spark, d, "disclosed_weight"), top)
    return links.select("user_id", F.col("scheme_id").cast("string").alias("link_from"), "link_to", F.round("inr", 2).alias("inr"))
